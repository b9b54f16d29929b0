"""Removal of repeated line runs (operator 7, DataFrame and SQL functions only).

The corpus is a sequence of line ids (128-bit hashes of lines with words). Only
lines that occur more than once can be part of a repeated run, so all others end
their run at once. Prefix doubling then names the blocks of 2, 4, 8 ... lines
that start at each remaining line, from the names of the two halves; equal names
are suffixes whose common prefix is that long, an interval of the suffix array.
A run counts from `min_words` words on. The shortest such runs from a line on and
up to a line depend only on their lines, have at most `min_words` of them, and are
named by two overlapping blocks, so doubling stops once it covers `min_words`
lines: each line of a longer repeated run lies in one of the shortest runs within
it, so deeper intervals can't change what is deleted. All but the first place of
an interval are later copies; overlapping ones join to the maximal repeated run,
and its lines are deleted.

The first copy is the one with the smallest doc_id (nulls first), then the first
row, then the first line. Null and empty texts have no lines and stay; repeated
rows are copies; a document of which no line with a word is left is dropped; an
empty table gives an empty result. Lines stay as they are, spaces included. Very
long texts are so many lines more: no step but the last holds a text's lines
together. Columns can have any names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import range_bounds, save, save_parts

MIN_WORDS = 50
#: Deleted lines in one broadcast (4 bytes each), and what a row counts besides its lines.
BLOCK_LINES, ROW_LINES = 8_000_000, 16
_WORD = r"[^\x20\x09-\x0D]+"


def _name(*parts: Column) -> tuple[Column, Column]:
    return F.xxhash64(*parts), F.xxhash64(F.lit("skein"), *parts)


def _lines(docs: DataFrame) -> DataFrame:
    """Per line with words: rid, line (its number), a1, a2 (its id) and words."""
    cut = docs.select("rid", F.col("doc_id").alias("doc"), F.posexplode(F.split("text", "\n")).alias("line", "content"))
    words = F.size(F.split(F.trim(F.regexp_replace("content", r"[\x20\x09-\x0D]+", " ")), " "))
    cut = cut.where(F.col("content").rlike(_WORD))
    a1, a2 = _name(F.col("content"))
    return cut.select("rid", "doc", "line", a1.alias("a1"), a2.alias("a2"), words.cast("long").alias("words"))


def copies(rows: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """rows: rid, doc_id, text. Gives rid and, per maximal later copy, its lines: (rid, line), one row per deleted line."""
    lines = save(_lines(rows), "lines")
    common = lines.groupBy("a1", "a2").agg(F.count("*").alias("n")).where("n > 1").select("a1", "a2")
    again = lines.withColumn("at", F.row_number().over(Window.partitionBy("rid").orderBy("line")))
    again = save(again.join(common, ["a1", "a2"], "left_semi"), "again")
    by_doc = Window.partitionBy("rid").orderBy("at")
    again = again.withColumn("run", F.col("at") - F.row_number().over(by_doc))
    by_run = Window.partitionBy("rid", "run").orderBy("at")
    ahead = F.sum("words").over(by_run) - F.col("words")
    again = again.withColumn("before", ahead)
    reach = F.collect_list(F.col("before") + F.col("words")).over(by_run.rowsBetween(0, min_words - 1))
    again = again.withColumn("reach", reach)
    # names[k]: the block of 2**k lines from here
    names, k = [("a1", "a2")], 0
    while 2 ** (k + 1) <= min_words:
        p, q = names[k]
        far = [F.lead(c, 2**k).over(by_run) for c in (p, q)]
        b1, b2 = _name(F.col(p), F.col(q), *far)
        names.append((f"b{k}_1", f"b{k}_2"))
        again = again.withColumns({names[-1][0]: b1, names[-1][1]: b2})
        k += 1
    # Sizes of the runs from here: the shortest that has min_words words, if the lines left reach so far, and all that lack them without this line.
    shortest = F.size(F.filter("reach", lambda x: x < F.col("before") + min_words)) + 1
    without = F.size(F.filter("reach", lambda x: x < F.col("before") + F.col("words") + min_words))
    again = again.withColumn("shortest", shortest).withColumn("without", without)
    sizes = F.when(F.col("shortest") <= F.size("reach"), F.sequence("shortest", F.greatest("shortest", "without")))
    halves = F.array(*[F.struct(F.col(p).alias("x"), F.col(q).alias("y")) for p, q in names])
    held = again.withColumn("halves", halves).withColumn("ahead", F.collect_list("halves").over(by_run.rowsBetween(0, min_words - 1)))

    def named(size: Column) -> Column:
        # The second, overlapping half is the block at offset size - 2**depth.
        depth = F.floor(F.log2(size)).cast("int")
        first, second = F.col("halves")[depth], F.col("ahead")[size - F.pow(F.lit(2), depth).cast("int")][depth]
        w1, w2 = _name(size, first["x"], first["y"], second["x"], second["y"])
        return F.struct(size.alias("size"), w1.alias("w1"), w2.alias("w2"))

    windows = held.select("rid", "doc", "line", "at", F.explode(F.transform(sizes, named)).alias("z"))
    windows = save(windows.select("rid", "doc", "line", "at", "z.size", "z.w1", "z.w2"), "windows")
    place = F.struct("doc", "rid", "at")
    firsts = windows.groupBy("w1", "w2").agg(F.min(place).alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    later = windows.join(firsts, ["w1", "w2"]).where(
        # not the first place itself, nor a copy that overlaps it
        ~((F.col("rid") == F.col("first.rid")) & (F.col("at") < F.col("first.at") + F.col("size")))
    )
    gone = later.select("rid", F.explode(F.sequence("at", F.col("at") + F.col("size") - 1)).alias("at")).distinct()
    return gone.join(again.select("rid", "at", "line"), ["rid", "at"]).select("rid", "line")


def _cut(rows: DataFrame, gone: DataFrame) -> DataFrame:
    """rows (rid, row) without the lines of gone (rid, gone), and n_removed and removed_runs; gone is broadcast."""
    out = rows.join(F.broadcast(gone), "rid", "left")
    kept = F.filter(F.split("row.text", "\n"), lambda x, i: ~F.array_contains(F.col("gone"), i))
    text = F.when(F.col("gone").isNull(), F.col("row.text")).otherwise(F.array_join(kept, "\n"))
    starts = F.filter("gone", lambda x: ~F.array_contains(F.col("gone"), x - 1))
    ends = F.filter("gone", lambda x: ~F.array_contains(F.col("gone"), x + 1))
    runs = F.coalesce(F.zip_with(starts, ends, lambda a, b: F.struct(a.alias("first"), b.alias("last"))), F.array().cast("array<struct<first:int,last:int>>"))
    out = out.select("row", text.alias("text"), F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_removed"), runs.alias("removed_runs"))
    return out.where((F.col("n_removed") == 0) | F.col("text").rlike(_WORD))


def dedup_lines(docs: DataFrame, min_words: int = MIN_WORDS, report: bool = True) -> DataFrame:
    """The table without later copies of repeated line runs.

    report: with n_removed (lines) and removed_runs (first and last line of each), in place of columns that have these names.
    """
    # the row travels whole, so that its columns can have any names
    rows = save(docs.select(F.monotonically_increasing_id().alias("rid"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")), "numbered")
    gone = copies(rows.select("rid", F.col("row.doc_id").alias("doc_id"), F.col("row.text").cast("string").alias("text")), min_words)
    gone = save(gone.groupBy("rid").agg(F.array_sort(F.collect_set("line")).alias("gone")), "gone")
    # No text is shuffled: the deleted lines come to the rows, in ranges of rid if they are too many for one broadcast.
    size = gone.agg(F.coalesce(F.sum(F.size("gone") + ROW_LINES), F.lit(0))).first()[0]
    if size <= BLOCK_LINES:
        out = _cut(rows, gone)
    else:
        bounds = [None, *range_bounds(gone, "rid", -(-size // BLOCK_LINES)), None]
        within = lambda a, b: F.expr(" and ".join(x for x in (f"rid >= {a}" if a is not None else "", f"rid < {b}" if b is not None else "", "true") if x))
        out = save_parts((_cut(rows.where(within(a, b)), gone.where(within(a, b))) for a, b in zip(bounds, bounds[1:], strict=False)), "cut")
    added = ["n_removed", "removed_runs"] if report else []
    own = [F.col("text").cast(docs.schema["text"].dataType) if c == "text" else F.col(f"row.`{c}`") for c in docs.columns if c not in added]
    return out.select(*[x.alias(c) for x, c in zip(own, [c for c in docs.columns if c not in added], strict=True)], *added)
