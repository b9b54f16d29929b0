"""Near-duplicate classes with SetSketch registers (operator 1).

A document's set is its distinct word shingles. Each of 128 registers keeps the
minimum of a hash over the set; as an exponential variate it is truncated to a
power of a base, so registers are small integers, mergeable by maximum, and
equal with a probability near the similarity. Bands of four registers give
candidate buckets: two sets of similarity 0.85 miss each other in all 32 bands
with a probability of 6e-11 (0.8: 5e-8).

Equal sets are one row with a number of its own, so copies cost nothing. Each
bucket first offers its members a leader, the member that shares most buckets
with others. Pairs are judged by the joint likelihood of their registers and
then on their full sets. Where a bucket still holds several classes, a bound
that needs no pair (shingles that no other set of such buckets has, and set
sizes) proves most members unlinkable; the others meet in blocks of at most
BLOCK members, and exactly the pairs that the bounds leave are verified too. So
no link is lost and no cap is needed.

Null and empty texts have an empty set and link with nothing, also where another
row has the same doc_id; rows with a null doc_id get a null component and are
kept; rows that repeat a doc_id with different texts share a component, whichever
of the texts has the link, and of rows with the same doc_id that have words all
are kept or none. Very long texts are sets like others. Columns other than doc_id
and text are not read, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import batches_of, drop, keeps, lean, save, shuffle_partitions
from .components import components

REGISTERS, ROWS, BANDS = 128, 4, 32
BASE, TOP = 1.001, (1 << 16) - 1
#: Candidate keys up to which they are broadcast to fetch their texts (16 bytes each); beyond it the join shuffles.
BROADCAST_ROWS = 2_000_000
#: Members of a bucket that meet in one task, shingles counted in one part, and sets whose counts are added up in one.
BLOCK, PART_SHINGLES, BLOCK_SETS = 4096, 500_000, 200_000
_U = np.uint64
_MULTIPLIERS = (np.random.Generator(np.random.Philox(20240)).integers(0, 1 << 63, REGISTERS, dtype=np.uint64) << _U(1)) | _U(1)


def _mix(x: np.ndarray) -> np.ndarray:
    """The finisher of splitmix64."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


class _WordHashes(dict):
    KEEP = 200_000

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if not self:
            keeps("words", self.clear)
        if len(self) >= self.KEEP:
            self.clear()
        h = xxhash.xxh3_64_intdigest(word)
        if len(word) <= 64:
            self[word] = h
        return h


_hashes = _WordHashes()


def shingles(text: str | None, k: int) -> np.ndarray:
    """The sorted distinct 64-bit hashes of a text's k-word shingles; of fewer words, one hash of all."""
    words = text.encode().lower().split() if text else []
    n = len(words)
    if not n:
        return np.zeros(0, dtype=np.uint64)
    h = np.fromiter(map(_hashes.__getitem__, words), dtype=np.uint64, count=n)
    size = min(n, k)
    s = np.full(n - size + 1, size, dtype=np.uint64)
    for j in range(size):
        s = _mix(s * _U(0x9E3779B97F4A7C15) + h[j : n - size + 1 + j])
    return np.unique(s)


def registers(items: np.ndarray) -> np.ndarray:
    """SetSketch registers of a non-empty set of hashes."""
    low = np.full(REGISTERS, ~_U(0), dtype=np.uint64)
    for i in range(0, len(items), 2048):
        np.minimum(low, (_MULTIPLIERS[:, None] * items[None, i : i + 2048]).min(axis=1), out=low)
    smallest = -np.log1p(-(low.astype(np.float64) + 0.5) / 2.0**64)  # the smallest of exponential variates
    return np.clip(1 - np.floor(np.log(np.maximum(smallest, 1e-300)) / np.log(BASE)), 0, TOP).astype("<u2")


def likelihood_similarity(a: np.ndarray, b: np.ndarray, n_a: int, n_b: int) -> float:
    """The similarity that makes the registers' order relations likeliest, given both sizes (Ertl's joint estimate)."""
    above, below = int(np.count_nonzero(a > b)), int(np.count_nonzero(a < b))
    u, v = n_a / (n_a + n_b), n_b / (n_a + n_b)
    j = np.linspace(0, min(u / v, v / u), 201)
    p = lambda x: -np.log1p(-np.clip(x, 0, 1) * (BASE - 1) / BASE) / np.log(BASE)
    more, less = p(u - v * j), p(v - u * j)
    equal = np.maximum(1 - more - less, 1e-12)
    score = above * np.log(np.maximum(more, 1e-12)) + below * np.log(np.maximum(less, 1e-12)) + (len(a) - above - below) * np.log(equal)
    return float(j[int(np.argmax(score))])


def _sketch(k: int):
    def run(batches):
        import pyarrow as pa
        import xxhash

        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                part = batch.slice(at, 2000)
                n, one, two, bands = [], [], [], []
                for text in part.column(2).to_pylist():
                    s = shingles(text, k)
                    n.append(len(s))
                    raw = s.tobytes()
                    h = xxhash.xxh3_128_digest(raw)
                    one.append(int.from_bytes(h[:8], "little", signed=True))
                    two.append(int.from_bytes(h[8:], "little", signed=True))
                    bands.append(registers(s).view("<i8") if len(s) else None)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(n, pa.int64()), pa.array(one, pa.int64()), pa.array(two, pa.int64()), pa.array(bands, pa.list_(pa.int64()))],
                    names=["doc_id", "tie", "n", "s1", "s2", "bands"],
                )

    return run


def _sets(k: int):
    """Per candidate: its sorted shingles, behind its registers."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                blobs = []
                for text in part.column(1).to_pylist():
                    s = shingles(text, k)
                    blobs.append(registers(s).tobytes() + s.tobytes())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(blobs, pa.binary())], names=["set", "items"])

    return run


def _packed(to: np.ndarray, n: int, *columns: np.ndarray) -> list[tuple]:
    """Rows (part, bytes of each column's share) of the parts that get something."""
    order = np.argsort(to, kind="stable")
    cuts = np.searchsorted(to[order], np.arange(n + 1))
    return [(p, *(c[order[a:b]].tobytes() for c in columns)) for p, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)) if a < b]


def _rows(rows: list[tuple], names: list[str]):
    import pyarrow as pa

    cols = list(zip(*rows, strict=True))
    return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32())] + [pa.array(c, pa.binary()) for c in cols[1:]], names=names)


def _spread(parts: int):
    """Deals shingles with their owners over parts, packed: a few rows per task, whatever the number of shingles."""

    def run(batches):
        for batch in batches:
            sets = [np.frombuffer(b, dtype="<u8", offset=2 * REGISTERS) for b in batch.column(1).to_pylist()]
            if sets:
                items, owner = np.concatenate(sets), np.repeat(np.array(batch.column(0).to_pylist(), dtype="<i8"), [len(s) for s in sets])
                yield _rows(_packed((items >> _U(40)) % _U(parts), parts, items, owner), ["part", "items", "owners"])

    return run


def _gathered(batches):
    """(part, its two columns whole) of rows that are sorted by part."""
    part, one, two = None, [], []
    for batch in batches:
        for p, a, b in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            if p != part and one:
                yield part, np.frombuffer(b"".join(one), dtype="<u8"), np.frombuffer(b"".join(two), dtype="<i8")
                one, two = [], []
            part = p
            one.append(a)
            two.append(b)
    if one:
        yield part, np.frombuffer(b"".join(one), dtype="<u8"), np.frombuffer(b"".join(two), dtype="<i8")


def _lonely(blocks: int):
    """How many shingles of each owner no other owner has, by part: packed into a row for each block of owners."""

    def run(batches):
        for _, items, owners in _gathered(batches):
            order = np.argsort(items, kind="stable")
            s = items[order]
            differs = s[1:] != s[:-1]
            alone = order[np.concatenate([[True], differs]) & np.concatenate([differs, [True]])]
            sets, counts = np.unique(owners[alone], return_counts=True)
            if len(sets):
                yield _rows(_packed(_mix(sets.view("<u8")) % _U(blocks), blocks, sets, counts.astype("<i8")), ["block", "sets", "counts"])

    return run


def _sums(batches):
    """Adds up a block's counts as they come."""
    import pyarrow as pa

    block, sets, counts = None, np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)

    def out():
        return pa.RecordBatch.from_arrays([pa.array(sets, pa.int64()), pa.array(counts, pa.int64())], names=["set", "own"])

    for batch in batches:
        for b, a, n in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            if b != block:
                if len(sets):
                    yield out()
                block, sets, counts = b, np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
            both = np.concatenate([sets, np.frombuffer(a, dtype="<i8")])
            sets, at = np.unique(both, return_inverse=True)
            counts = np.bincount(at, weights=np.concatenate([counts, np.frombuffer(n, dtype="<i8")])).astype(np.int64)
    if len(sets):
        yield out()


def _verify(num: int, den: int):
    def run(batches):
        import pyarrow as pa

        lax = num / den - 6 * (num / den * (1 - num / den) / REGISTERS) ** 0.5
        for batch in batches:
            linked, miss = [], []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                x, y = x.as_buffer(), y.as_buffer()
                s, t = np.frombuffer(x, dtype="<u8", offset=2 * REGISTERS), np.frombuffer(y, dtype="<u8", offset=2 * REGISTERS)
                r, q = np.frombuffer(x, dtype="<u2", count=REGISTERS), np.frombuffer(y, dtype="<u2", count=REGISTERS)
                if likelihood_similarity(r, q, len(s), len(t)) < lax / 2:
                    linked.append(False)  # far beyond what the estimate can err
                    miss.append(None)
                    continue
                lacks = np.setdiff1d(t, s, assume_unique=True)
                both = len(t) - len(lacks)
                linked.append(bool(den * both >= num * (len(s) + len(t) - both)))
                miss.append(lacks.view("<i8") if 10 * len(lacks) <= 3 * len(t) else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(linked, pa.bool_()), pa.array(miss, pa.list_(pa.int64()))], names=["set", "lead", "linked", "miss"])

    return run


def _could(n_x: Column, u_x: Column, n_y: Column, u_y: Column, num: int, den: int) -> Column:
    """Whether two sets can reach the similarity: they share nothing of u_x and u_y, shingles that no other set has."""
    most = F.least(n_x - u_x, n_y - u_y)
    least = F.greatest(n_x + u_y, n_y + u_x)
    return den * most >= num * least


def near_duplicates(docs: DataFrame, k: int = 5, num: int = 4, den: int = 5) -> DataFrame:
    """Per row of (doc_id, text): doc_id, n_shingles, component_id, kept. Sets link at similarity num / den."""
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.col("text").cast("string")).alias("tie"), F.col("text").cast("string").alias("text"))
    with batches_of(keyed.sparkSession, 2000):
        sketches = save(keyed.mapInArrow(lean(_sketch(k), "words"), "doc_id long, tie long, n long, s1 long, s2 long, bands array<long>"), "sketches")
    # Equal sets are one: a text of the smallest doc_id stands for them.
    sets = sketches.where("n > 0 and doc_id is not null").groupBy("s1", "s2", "n", "bands").agg(F.min(F.struct("doc_id", "tie")).alias("r"))
    sets = save(sets.select(F.monotonically_increasing_id().alias("set"), F.col("r.doc_id").alias("low"), F.col("r.tie").alias("tie"), "n", "s1", "s2", "bands"), "distinct_sets")
    rows = save(sketches.select("doc_id", "n", "s1", "s2").join(sets.select("s1", "s2", "n", "set", "low"), ["s1", "s2", "n"], "left").select("doc_id", "n", "set", "low"), "rows")
    # Different texts of one doc_id belong together.
    several = rows.where("doc_id is not null and set is not null").groupBy("doc_id").agg(F.min("set").alias("a"), F.max("set").alias("z")).where("a <> z").select("doc_id", "a")
    same_id = rows.join(several, "doc_id").where("set <> a").select("a", F.col("set").alias("b")).distinct()
    with batches_of(keyed.sparkSession, 500):
        links = save(_links(keyed, sets, k, num, den).unionByName(same_id), "all_links")
    labels = components(links)
    found = labels.join(sets.select(F.col("set").alias("node"), "low"), "node")
    least = found.groupBy("label").agg(F.min("low").alias("component"))
    of_set = found.join(least, "label").select(F.col("node").alias("set"), "component")
    rows = rows.join(of_set, "set", "left")
    component = F.when(F.col("doc_id").isNull(), None).when(F.col("n") == 0, F.col("doc_id")).otherwise(F.coalesce("component", "low"))
    found = rows.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"))
    return found.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def _links(keyed: DataFrame, known: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """(a, b): numbers of sets that reach the similarity; enough of these pairs to connect every class."""
    bands = known.select("set", "n", F.posexplode("bands").alias("band", "key"))
    full = bands.groupBy("band", "key").agg(F.count("*").alias("m")).where("m > 1")
    members = save(bands.join(full, ["band", "key"]), "members")
    shared = save(members.groupBy("set", "n").agg(F.sum("m").alias("meets")), "shared")
    wanted = known.join(shared.select("set"), "set", "left_semi").select(F.col("low").alias("doc_id"), "tie", "set")
    wanted = F.broadcast(wanted) if shared.count() <= BROADCAST_ROWS else wanted
    texts = keyed.join(wanted, ["doc_id", "tie"]).select("set", "text").dropDuplicates(["set"])
    sets = save(texts.mapInArrow(lean(_sets(k), "words"), "set long, items binary"), "sets")
    # 1. Every member with its bucket's leader.
    lead = members.join(shared.select("set", "meets"), "set").groupBy("band", "key").agg(F.max(F.struct("meets", "set", "n")).alias("l"))
    lead = save(lead.select("band", "key", F.col("l.set").alias("lead"), F.col("l.n").alias("lead_n")), "leads")
    zero = F.lit(0)
    led = members.join(lead, ["band", "key"]).where(F.col("set") != F.col("lead")).where(_could(F.col("n"), zero, F.col("lead_n"), zero, num, den))
    judged = save(_judge(save(led.select("set", "lead").distinct(), "pairs"), sets, num, den), "judged")
    tested = judged.select(F.least("set", "lead").alias("a"), F.greatest("set", "lead").alias("b")).distinct()
    links = judged.where("linked").select(F.least("set", "lead").alias("a"), F.greatest("set", "lead").alias("b")).distinct()
    labels = components(links)
    # 2. Buckets that still hold several classes: the pairs that the bounds leave, each in the first band that both share.
    labelled = members.join(labels.withColumnRenamed("node", "set"), "set", "left").select("set", "n", "band", "key", F.coalesce("label", "set").alias("label"))
    several = labelled.groupBy("band", "key").agg(F.min("label").alias("x"), F.max("label").alias("y"), F.min("n").alias("least")).where("x <> y")
    open_ = save(labelled.join(several.select("band", "key", "least"), ["band", "key"]).join(lead, ["band", "key"]), "open")
    # counted with the leaders, so that none of a set's own shingles is its leader's
    own = _own(open_.select("set").distinct(), sets, known.join(open_.select("set"), "set", "left_semi"))
    # A partner of a set has at most this size, since it lacks the set's own shingles.
    able = den * (F.col("n") - F.col("own")) >= num * (F.col("least") + F.col("own"))
    left = open_.where(F.col("set") != F.col("lead")).join(own, "set", "left").withColumn("own", F.coalesce("own", F.lit(0))).where(able)
    left = save(left.join(known.select("set", "bands"), "set").join(judged.select("set", "lead", "miss"), ["set", "lead"], "left"), "left")
    more = save(_judge(_rest(left, tested, num, den), sets, num, den).where("linked").select(F.col("set").alias("a"), F.col("lead").alias("b")), "links")
    drop(open_, left)
    return links.unionByName(more)


def _own(some: DataFrame, sets: DataFrame, known: DataFrame) -> DataFrame:
    """(set, own): how many of a set's shingles no other of these sets has."""
    spark = sets.sparkSession
    count, total = known.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    parts = max(shuffle_partitions(spark), int(total) // PART_SHINGLES)
    blocks = 1 + int(count) // BLOCK_SETS
    dealt = sets.join(some, "set", "left_semi").mapInArrow(lean(_spread(parts), "words"), "part int, items binary, owners binary").repartition(parts, "part").sortWithinPartitions("part")
    counts = dealt.mapInArrow(lean(_lonely(blocks), "words"), "block int, sets binary, counts binary").repartition(blocks, "block").sortWithinPartitions("block")
    return save(counts.mapInArrow(lean(_sums, "words"), "set long, own long"), "own")


def _rest(left: DataFrame, tested: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs (set, lead) of different classes in a bucket that the bounds can't rule out and that weren't tested yet."""
    sizes = left.groupBy("band", "key").agg(F.count("*").alias("m")).where("m > 1").select("band", "key", F.ceil(F.col("m") / BLOCK).cast("int").alias("blocks"))
    left = left.join(sizes, ["band", "key"])
    # A large bucket is cut into blocks: a member goes to one of them as x and to each as y.
    x = left.withColumn("block", F.pmod(F.xxhash64("set"), F.col("blocks")).cast("int")).alias("x")
    y = left.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).alias("y")
    earlier = F.zip_with(F.slice("x.bands", 1, F.col("x.band")), F.slice("y.bands", 1, F.col("y.band")), lambda p, q: p == q)
    # Inside the leader's set the two share all but what either misses; outside it at most what isn't their own.
    inside = F.col("x.lead_n") - F.size("x.miss") - F.size("y.miss") + F.size(F.array_intersect("x.miss", "y.miss"))
    spare = lambda s: F.col(f"{s}.n") - (F.col(f"{s}.lead_n") - F.size(f"{s}.miss")) - F.col(f"{s}.own")
    both = inside + F.least(spare("x"), spare("y"))
    unknown = F.col("x.miss").isNull() | F.col("y.miss").isNull()
    close = F.when(unknown, F.lit(True)).otherwise(den * both >= num * (F.col("x.n") + F.col("y.n") - both))
    on = (F.col("x.band") == F.col("y.band")) & (F.col("x.key") == F.col("y.key")) & (F.col("x.block") == F.col("y.block")) & (F.col("x.set") < F.col("y.set"))
    on = on & (F.col("x.label") != F.col("y.label")) & _could(F.col("x.n"), F.col("x.own"), F.col("y.n"), F.col("y.own"), num, den) & ~F.array_contains(earlier, True) & close
    rest = x.join(y, on).select(F.col("x.set").alias("a"), F.col("y.set").alias("b")).join(tested, ["a", "b"], "left_anti")
    return save(rest.distinct().select(F.col("a").alias("set"), F.col("b").alias("lead")), "pairs")


def _judge(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """pairs (set, lead) with `linked`, by their full sets, and `miss`: the leader's shingles that the member lacks, where these are few."""
    one = sets.select("set", F.col("items").alias("items_a"))
    two = sets.select(F.col("set").alias("lead"), F.col("items").alias("items_b"))
    both = pairs.join(one, "set").join(two, "lead").select("set", "lead", "items_a", "items_b")
    return both.mapInArrow(lean(_verify(num, den), "words"), "set long, lead long, linked boolean, miss array<long>")


def drop_near_duplicates(docs: DataFrame, k: int = 5, num: int = 4, den: int = 5) -> DataFrame:
    """The rows of the table that stand for their class."""
    gone = near_duplicates(docs, k, num, den).where("not kept").select(F.col("doc_id").alias("_gone")).distinct()
    return docs.join(gone, (F.col("doc_id").cast("long") == F.col("_gone")) & F.col("text").cast("string").rlike(r"[^\x20\x09-\x0D]"), "left_anti")
