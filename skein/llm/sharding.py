"""Balanced sharding by label propagation under capacity quotas (operator 10).

Law `rows`: the shards' row counts differ by one at most. Documents with equal
texts are linked. All documents start in the shard of their id's hash, and each
group of linked documents takes the label that most of its members have. Linked
documents are cliques, so one round settles the labels as long as quotas have
room; what remains is which groups a quota admits. That is decided on the driver
from how many groups there are of each size and label (distinct sizes number at
most the root of twice the rows): largest first, a group goes whole to its label's
shard, or else whole to the fullest shard that can hold it. Only a group that no
shard can hold any more is split: it fills up the emptiest shard and its rest goes
on as a smaller group, so a group above a quota fills whole shards, and with S
shards there are S splits at most. Unlinked rows give way to linked ones: rows
beyond a shard's quota fill the others up. Which groups go first is a heuristic;
a packing that splits fewer may exist.

Nulls count as empty texts (size 1) but link only with nulls; repeated rows are
linked documents; an empty table gives an empty result.
"""

from __future__ import annotations

import heapq

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import save

SHARDS, CELLS = 16, 256


def text_key(text: Column) -> list[Column]:
    """128 bits of xxhash of the text's bytes."""
    return [F.xxhash64(text).alias("g1"), F.xxhash64(F.lit("skein"), text).alias("g2")]


def _quotas(total: int, shards: int) -> list[int]:
    return [total // shards + (s < total % shards) for s in range(shards)]


def _pairs(values: list[int]) -> Column:
    return F.array(*[F.lit(int(v)).cast("long") for v in values])


def admit(classes: list[tuple[int, int, int]], quotas: list[int]) -> tuple[list[tuple], dict[tuple, list[tuple[int, int]]]]:
    """classes: (n, label, how many groups of n documents have that label); the quotas hold all of them.

    Gives (n, label, low, high, shard) for the groups of a class with ranks from low to below high that go whole to a
    shard, and for each split group (n, label, rank) its (documents, shard).
    """
    room, whole, split = list(quotas), [], {}
    # (-size, 0 for those that try their label's shard first, n, label, first rank, count); pieces of split groups have size < n
    todo = [(-n, 0, n, label, 0, count) for n, label, count in classes]
    heapq.heapify(todo)
    while todo:
        size, tried, n, label, rank, count = heapq.heappop(todo)
        size = -size
        if not tried:
            into = label
            k = min(count, room[label] // size)
        elif any(r >= size for r in room):
            into = min((r, s) for s, r in enumerate(room) if r >= size)[1]
            k = min(count, room[into] // size)
        else:
            into, k = max(range(len(room)), key=lambda s: (room[s], -s)), 0
            split.setdefault((n, label, rank), []).append((room[into], into))
            heapq.heappush(todo, (room[into] - size, 1, n, label, rank, 1))
            room[into], rank, count = 0, rank + 1, count - 1
        if k and (n, label, rank) in split:
            split[n, label, rank].append((size, into))
        elif k:
            whole.append((n, label, rank, rank + k, into))
        room[into] -= k * size
        if count > k:
            heapq.heappush(todo, (-size, 1, n, label, rank + k, count - k))
    return whole, split


def propagate(groups: DataFrame, total: int, shards: int = SHARDS) -> tuple[DataFrame, list[tuple]]:
    """groups: (g1, g2, home, n), n linked documents that start in shard home.

    Gives (g1, g2, home, shard), where whole groups go, and (g1, g2, ends, shards) per split group: the ranks at which its parts end.
    """
    spark = groups.sparkSession
    # the shard with most neighbours; ties go round the shards by the group's hash
    turn = F.pmod(F.col("home") - F.xxhash64("g1", F.lit(0)), F.lit(shards))
    labels = groups.groupBy("g1", "g2").agg(F.max(F.struct("n", turn.alias("turn"), "home")).alias("top"), F.sum("n").alias("n"))
    labels = labels.select("g1", "g2", "n", F.col("top.home").alias("label"), F.pmod(F.xxhash64("g2", "g1"), F.lit(CELLS)).cast("int").alias("cell"))
    labels = save(labels, "labels")
    classes = [tuple(r) for r in labels.groupBy("n", "label").agg(F.count("*")).collect()]
    whole, split = admit(classes, _quotas(total, shards))
    ranked = save(_rank(labels, ["n", "label"], "cell", [F.col("g1"), F.col("g2")], "rank"), "ranks")
    to = spark.createDataFrame(whole, "n long, label int, low long, high long, shard int")
    went = ranked.join(F.broadcast(to), ["n", "label"]).where("rank >= low and rank < high").select("g1", "g2", "shard")
    parts = []
    if split:
        keys = spark.createDataFrame(list(split), "n long, label int, rank long")
        for r in ranked.join(F.broadcast(keys), ["n", "label", "rank"]).select("g1", "g2", "n", "label", "rank").collect():
            ends, into = [], []
            for m, s in split[r["n"], r["label"], r["rank"]]:
                if m:
                    ends.append((ends or [0])[-1] + m)
                    into.append(s)
            parts.append((r["g1"], r["g2"], ends, into))
    return groups.join(went, ["g1", "g2"]).select("g1", "g2", "home", "shard"), parts


def _rank(df: DataFrame, by: list[str], cell: str, order: list[Column], name: str) -> DataFrame:
    """A gapless rank from 0 within `by`, whose rows are dealt over cells of even size; (by, cell) counts are few."""
    keys = [*by, cell]
    counts = df.groupBy(*keys).agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*by).orderBy(cell).rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select(*keys, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    local = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_local", local).join(F.broadcast(base), keys).withColumn(name, (F.col("_base") + F.col("_local") - 1).cast("long")).drop("_base", "_local")


def shard(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """(doc_id, text) to doc_id, size, text_crc32, law, shard, slot, grown_shard."""
    text = F.col("text").cast("string")
    own = F.pmod(F.xxhash64(F.col("doc_id"), text), F.lit(shards)).cast("int")
    docs = save(docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32"),
        *text_key(text),
        own.alias("home"),
    ), "keys")
    total = docs.count()
    quotas = _quotas(total, shards)
    by_home = docs.groupBy("g1", "g2", "home").agg(F.count("*").alias("n"))
    sizes = by_home.groupBy("g1", "g2").agg(F.sum("n").alias("_all")).where("_all > 1").select("g1", "g2")
    moved, parts = propagate(save(by_home.join(sizes, ["g1", "g2"]), "groups"), total, shards)
    went = moved.select("g1", "g2", "home", F.col("shard").alias("_to"))
    tie = [F.col("doc_id"), F.col("text_crc32"), F.col("g1")]
    cell = F.pmod(F.xxhash64("doc_id", "text_crc32", F.lit(7)), F.lit(CELLS)).cast("int")
    columns = [*docs.columns, "_to"]
    split = F.broadcast(docs.sparkSession.createDataFrame(parts, "g1 long, g2 long, ends array<long>, into array<int>"))
    placed = (docs.join(split, ["g1", "g2"], "left_anti") if parts else docs).join(went, ["g1", "g2", "home"], "left").select(*columns)
    if parts:
        pieces = _rank(docs.join(split, ["g1", "g2"]).withColumn("cell", cell), ["g1", "g2"], "cell", tie, "rank")
        to = F.get("into", F.size(F.filter("ends", lambda x: x <= F.col("rank"))))
        placed = placed.unionByName(pieces.withColumn("_to", to).select(*columns))
    # linked rows come first in a shard, so that its quota keeps them
    placed = placed.select("doc_id", "size", "text_crc32", "g1", F.coalesce("_to", "home").alias("wish"), F.when(F.col("_to").isNull(), cell + CELLS).otherwise(cell).alias("cell"))
    placed = save(placed, "wishes")
    ranked = save(_rank(placed, ["wish"], "cell", tie, "slot"), "slots")
    quota = F.element_at(_pairs(quotas), F.col("wish") + 1)
    kept = ranked.where(F.col("slot") < quota).select("doc_id", "size", "text_crc32", F.col("wish").alias("shard"), "slot")
    # What a shard can't hold goes, by its number among all such rows, to the free slots.
    held = {r["wish"]: r["n"] for r in placed.groupBy("wish").agg(F.count("*").alias("n")).collect()}
    spare = _rank(ranked.where(F.col("slot") >= quota).withColumn("all", F.lit(0)), ["all"], "cell", [*tie, F.col("wish")], "k")
    first, firsts, begins = 0, [], []
    for s in range(shards):
        used = min(held.get(s, 0), quotas[s])
        firsts.append(first)
        begins.append(used)
        first += quotas[s] - used
    to = F.size(F.filter(_pairs(firsts), lambda x: x <= F.col("k")))  # shards without room share the first of the next one
    filled = spare.withColumn("shard", (to - 1).cast("int")).select(
        "doc_id", "size", "text_crc32", "shard", (F.col("k") - F.element_at(_pairs(firsts), F.col("shard") + 1) + F.element_at(_pairs(begins), F.col("shard") + 1)).alias("slot")
    )
    return kept.unionByName(filled).select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
