"""Best-fit packing with certified bin counts (operator 8).

Documents are tokenised once; each input split is one *shard* of the packing
problem (several, if it has more than SHARD_PIECES pieces) and keeps only a
histogram of its piece lengths. Best-fit decreasing runs on the histogram (at
most `capacity` distinct lengths, whatever the number of documents), and dual
feasible functions give a lower bound on the bin count, for each shard and for
the whole. Shards that meet their bounds still lose part-filled bins against the
whole, so the whole's bound decides: as long as the count is above it, shards
exchange documents and best-fit decreasing runs again on what they gave. First
they give the pieces of the bins that are not full, then those of all bins, and
the best of the three packings counts. No split of the input can therefore cost
more than best-fit decreasing over all documents at once.

Exchanged pieces are numbered length by length over the shards. The pool's plan
depends on `capacity` only (at most that many lengths), so every shard gets it
whole and its pieces take their places by rank; no step holds more than one
shard's rows, and none compares pieces with each other.

Nulls and empty texts become a document with the end id alone; repeated rows and
repeated doc_ids are packed one by one; a very long text is cut into pieces as it
is read; other columns, whatever their names, are left out; an empty table gives
an empty result.
"""

from __future__ import annotations

import bisect
from collections import defaultdict

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import lean, save, text_slices

CAPACITY = 2048
#: Pieces of a shard: its rows are one frame where they take their places.
SHARD_PIECES = 500_000
#: Bytes of text that are Python strings and Arrow pieces at a time.
SLICE_BYTES = 1_000_000
#: A plan row: `times` bins from number `bin` on hold, `offset` ids from their start, the pieces of `length` with ranks from `first` on.
PLAN = "length long, first long, times long, bin long, offset long"


def best_fit(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, tuple[int, ...]]]:
    """Best-fit decreasing over a histogram: (number of bins, lengths in the bin) patterns."""
    by_room: dict[int, list[list]] = defaultdict(list)  # room left -> [[bins, lengths]]
    rooms: list[int] = []

    def put(room: int, bins: int, lengths: tuple[int, ...]) -> None:
        if room not in by_room or not by_room[room]:
            bisect.insort(rooms, room)
        by_room[room].append([bins, lengths])

    for length in sorted(counts, reverse=True):
        left = counts[length]
        while left:
            i = bisect.bisect_left(rooms, length)
            if i == len(rooms):
                each = capacity // length
                bins, rest = divmod(left, each)
                if bins:
                    put(capacity - each * length, bins, (length,) * each)
                if rest:
                    put(capacity - rest * length, 1, (length,) * rest)
                left = 0
                continue
            room = rooms[i]
            group = by_room[room][-1]
            each = room // length
            bins = min(group[0], left // each)
            take = each if bins else left
            bins = bins or 1
            group[0] -= bins
            if not group[0]:
                by_room[room].pop()
                if not by_room[room]:
                    rooms.pop(i)
            put(room - take * length, bins, group[1] + (length,) * take)
            left -= bins * take
    return [(bins, lengths) for room in sorted(by_room) for bins, lengths in by_room[room]]


def lower_bound(counts: dict[int, int], capacity: int = CAPACITY) -> int:
    """The largest of the volume bound and two families of dual feasible functions (Fekete and Schepers)."""
    items = sorted(counts.items())
    best = -(-sum(x * n for x, n in items) // capacity)
    # u: lengths over capacity - e count as whole bins, those under e as nothing
    edges = sorted({x for x, _ in items if 2 * x <= capacity} | {capacity - x for x, _ in items if 2 * x > capacity})
    total, large, cum = 0, 0, []
    for x, n in items:
        total += x * n
        large += n
        cum.append((x, total, large))
    keys = [c[0] for c in cum]

    def upto(x: int) -> tuple[int, int]:
        i = bisect.bisect_right(keys, x)
        return (cum[i - 1][1], cum[i - 1][2]) if i else (0, 0)

    for e in edges:
        if 2 * e > capacity:
            continue
        below, (mid, n_mid) = upto(e - 1)[0], upto(capacity - e)
        best = max(best, (large - n_mid) + -(-(mid - below) // capacity))
    # rounding: x counts as floor((k + 1) x / capacity) / k, or x / capacity where that is whole
    for k in (1, 2, 3, 4, 5, 7, 9, 15):
        weight = 0
        for x, n in items:
            weight += n * (k * x if (k + 1) * x % capacity == 0 else (k + 1) * x // capacity * capacity)
        best = max(best, -(-weight // (k * capacity)))
    return best


def place(patterns: list[tuple[int, tuple[int, ...]]], first_bin: int, used: dict[int, int]) -> list[tuple]:
    """PLAN rows for patterns; used: how many pieces of each length already have a place."""
    rows = []
    for times, lengths in patterns:
        offset = 0
        for length in lengths:
            rows.append((length, used.get(length, 0), times, first_bin, offset))
            used[length] = used.get(length, 0) + times
            offset += length
        first_bin += times
    return rows


def tokenize_pieces(docs: DataFrame, path: str, end_id: int, capacity: int) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32 and (shard, rank), its number among the shard's pieces of that length."""

    def run(batches):
        import zlib

        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext

        from .tokens import encoder

        enc, end = encoder(path), end_id.to_bytes(4, "little")
        shard, seen, held = TaskContext.get().partitionId() << 20, np.zeros(capacity + 1, dtype=np.int64), 0
        for batch in batches:
            for start, texts in text_slices(batch, 1, SLICE_BYTES):
                out = []
                docs_here = batch.column(0).slice(start, len(texts)).to_pylist()
                for doc, ids in zip(docs_here, enc.encode([t or "" for t in texts]), strict=True):
                    ids += end
                    n, at, view = len(ids) // 4, 0, memoryview(ids)
                    size = n % capacity or capacity
                    for k in range(-(-n // capacity)):
                        if held == SHARD_PIECES:
                            shard, seen, held = shard + 1, np.zeros(capacity + 1, dtype=np.int64), 0
                        out.append((doc, k, at, size, zlib.crc32(view[4 * at : 4 * (at + size)]), shard, int(seen[size])))
                        seen[size] += 1
                        held += 1
                        at, size = at + size, capacity
                cols = list(zip(*out, strict=True))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int32())] + [pa.array(c, pa.int64()) for c in cols[2:]],
                    names=["doc_id", "piece", "start", "length", "ids_crc32", "shard", "rank"],
                )

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, shard long, rank long"
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(lean(run, "tokens"), schema)


def _shard_plan(capacity: int):
    """For one shard's histogram: the plan of its full bins, of its others, and (kind bins) how many of each and its bound."""

    def run(pdf):
        import pandas as pd

        counts = dict(zip(pdf["length"].tolist(), pdf["n"].tolist(), strict=True))
        patterns = best_fit(counts, capacity)
        full = [p for p in patterns if sum(p[1]) == capacity]
        rest = [p for p in patterns if sum(p[1]) < capacity]
        used: dict[int, int] = {}
        n_full, n_rest = sum(n for n, _ in full), sum(n for n, _ in rest)
        rows = [(*r, "full") for r in place(full, 0, used)]
        rows += [(length, used.get(length, 0), n - used.get(length, 0), 0, 0, "given") for length, n in counts.items() if n > used.get(length, 0)]
        rows += [(*r, "rest") for r in place(rest, n_full, used)]
        rows.append((n_full, lower_bound(counts, capacity), n_rest, 0, 0, "bins"))
        out = pd.DataFrame(rows, columns=["length", "first", "times", "bin", "offset", "kind"])
        return out.assign(shard=int(pdf["shard"].iloc[0]))

    return run


_OUT = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]


def _find(plan, length, rank):
    """(bin, offset) of the pieces with these lengths and ranks; plan: columns of PLAN as arrays."""
    import numpy as np

    stride = max(int((plan["first"] + plan["times"]).max()), int(rank.max()) + 1)
    order = np.argsort(plan["length"] * stride + plan["first"], kind="stable")
    at = (plan["length"] * stride + plan["first"])[order]
    want = length * stride + rank
    row = order[np.searchsorted(at, want, side="right") - 1]
    return plan["bin"][row] + rank - plan["first"][row], plan["offset"][row]


def _assign(pooled: list[tuple]):
    """A shard's pieces take the places of its own plan, those it gave the places of the pool's."""

    def run(key, pieces, plan):
        import numpy as np
        import pandas as pd

        if pieces.empty:
            return pd.DataFrame({c: [] for c in _OUT})
        names = ["length", "first", "times", "bin", "offset"]
        length, rank = pieces["length"].to_numpy(), pieces["rank"].to_numpy()
        sequence, offset = np.empty(len(pieces), dtype=np.int64), np.empty(len(pieces), dtype=np.int64)
        given = plan[plan["kind"] == "given"]
        first = np.full(int(length.max()) + 1, np.iinfo(np.int64).max)
        first[given["length"].to_numpy()] = given["first"].to_numpy()
        shift = np.zeros(len(first), dtype=np.int64)
        shift[given["length"].to_numpy()] = given["pool_first"].to_numpy() - given["first"].to_numpy()
        away = rank >= first[length]
        if away.any():
            pool = dict(zip(names, np.array(pooled, dtype=np.int64).T, strict=True))
            bins, offset[away] = _find(pool, length[away], (rank + shift[length])[away])
            sequence[away] = -1 - bins
        if not away.all():
            own = plan[plan["kind"] != "given"]
            bins, offset[~away] = _find({c: own[c].to_numpy().astype(np.int64) for c in names}, length[~away], rank[~away])
            sequence[~away] = int(key[0]) * (SHARD_PIECES + 1) + bins
        return pieces.assign(sequence_id=sequence, offset=offset)[_OUT]

    return run


def exchange(counts: dict[int, int], shards: tuple[int, int], given: dict[int, int], capacity: int = CAPACITY) -> tuple[str, list[tuple[int, tuple[int, ...]]], int, int]:
    """What the shards give up: `nothing`, `rest` (all bins that aren't full) or `all`, as long as the whole isn't certified.

    counts: the lengths of the whole; shards: how many full and other bins all shards have; given: the lengths of the others.
    Gives (what, the pool's patterns, number of bins, lower bound).
    """
    bound, best = lower_bound(counts, capacity), ("nothing", [], sum(shards))
    for what, pool, kept in (("rest", given, shards[0]), ("all", counts, 0)):
        if best[2] == bound:
            break
        patterns = best_fit(pool, capacity)
        bins = kept + sum(n for n, _ in patterns)
        if bins < best[2]:
            best = (what, patterns, bins)
    return (*best, bound)


def pack(docs: DataFrame, path: str, end_id: int = 0, capacity: int = CAPACITY) -> DataFrame:
    """Pack every document of (doc_id, text) into sequences of at most `capacity` ids; one row per piece."""
    pieces = save(tokenize_pieces(docs, path, end_id, capacity), "pieces")
    counts = save(pieces.groupBy("shard", "length").agg(F.count("*").alias("n")), "lengths")
    plans = save(counts.groupBy("shard").applyInPandas(_shard_plan(capacity), f"{PLAN}, kind string, shard long"), "plans")
    # What reaches the driver has one row per length at most.
    whole = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    given = {r["length"]: r["n"] for r in plans.where("kind = 'given'").groupBy("length").agg(F.sum("times").alias("n")).collect()}
    shards = plans.where("kind = 'bins'").agg(F.coalesce(F.sum("length"), F.lit(0)), F.coalesce(F.sum("times"), F.lit(0))).first()
    what, patterns, _, _ = exchange(whole, tuple(map(int, shards)), given, capacity)
    if what == "all":
        gave = counts.select("shard", "length", F.lit(0).cast("long").alias("first"), F.col("n").alias("times"))
    else:
        gave = plans.where("kind = 'given'" if what == "rest" else "false").select("shard", "length", "first", "times")
    before = Window.partitionBy("length").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    none = F.lit(0).cast("long")
    gave = gave.select("length", "first", "times", none.alias("bin"), none.alias("offset"), F.lit("given").alias("kind"), "shard", F.coalesce(F.sum("times").over(before), none).alias("pool_first"))
    kinds = {"nothing": ["full", "rest"], "rest": ["full"], "all": []}[what]
    plan = plans.where(F.col("kind").isin(kinds)).withColumn("pool_first", none).unionByName(gave)
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    return pieces.groupBy("shard").cogroup(plan.groupBy("shard")).applyInPandas(_assign(place(patterns, 0, {})), schema)


def certificate(counts: dict[int, int], capacity: int = CAPACITY) -> tuple[int, int]:
    """(bins that best-fit decreasing uses, lower bound) of a histogram."""
    return sum(n for n, _ in best_fit(counts, capacity)), lower_bound(counts, capacity)
