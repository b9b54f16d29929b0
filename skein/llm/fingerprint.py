"""Exact document fingerprints (operator 6, DataFrame and SQL functions only).

A text is brought to its canonical form (compatibility composition, full case
folding, runs of white space as one space, ends trimmed) and digested with two
xxhash values, 128 bits. Rows whose digests are equal are compared byte by byte
in canonical form: if a digest should ever stand for several forms, each form
after the first gets its number behind the digest.

Fingerprints are exact, so the likeness of two is 1 or 0. Null texts count as
empty. Repeated rows share their fingerprint; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import range_bounds, range_bucket, save, shuffle_partitions

_NFKC = ("com.ibm.icu.text.Normalizer", "compose")
_FOLD = ("com.ibm.icu.lang.UCharacter", "foldCase")


def canonical(text: Column) -> Column:
    """NFKC, full case folding, NFKC again; \\s and the other Unicode spaces fold to one space."""

    def nfkc(c: Column) -> Column:
        return F.java_method(F.lit(_NFKC[0]), F.lit(_NFKC[1]), c, F.lit(True))

    folded = nfkc(F.java_method(F.lit(_FOLD[0]), F.lit(_FOLD[1]), nfkc(text), F.lit(True)))
    # plain ASCII needs only lower(): the two agree there
    plain = F.octet_length(text) == F.char_length(text)
    form = F.when(plain, F.lower(text)).otherwise(folded)
    return F.trim(F.regexp_replace(form, r"[\s\x1c-\x1f\x85\p{Z}]+", " "))


def digest(form: Column) -> Column:
    """Two xxhash values of the canonical form as 32 hex digits."""
    halves = (F.xxhash64(form), F.xxhash64(F.lit("skein"), form))
    return F.concat(*[F.lpad(F.lower(F.hex(h)), 16, "0") for h in halves])


#: Rows up to which the keys of texts to compare are broadcast (16 bytes each); beyond it the join shuffles.
BROADCAST_ROWS = 2_000_000
NO_ID = -(1 << 63)


def settle(digests: DataFrame, forms_of, keys: list[str]) -> DataFrame | None:
    """Compares canonical forms inside equal buckets of (keys, digest).

    forms_of(rows) gives (keys, digest, form) for rows of the table. Returns (keys, digest, number) of rows whose form isn't
    the first of its bucket, or None if every digest stands for one form. Copies of a form meet as one row per task.
    """
    shared = digests.groupBy("digest").agg(F.count("*").alias("n")).where("n > 1").select("digest")
    again = save(digests.join(shared, "digest", "left_semi"), "buckets")
    forms = forms_of(again)
    texts = forms.groupBy("digest", "form").agg(F.count("*").alias("n"))
    several = save(texts.groupBy("digest").agg(F.count("*").alias("k")).where("k > 1").select("digest"), "clashes")
    if several.isEmpty():
        return None
    number = (F.row_number().over(Window.partitionBy("digest").orderBy("form")) - 1).alias("number")
    clash = texts.join(several, "digest", "left_semi").select("digest", "form", number).where("number > 0")
    return save(forms.join(clash, ["digest", "form"]).select(*keys, "digest", "number"), "moved")


def _named(digest_col: Column, number: Column) -> Column:
    return F.when(number.isNull(), digest_col).otherwise(F.concat_ws("-", digest_col, number.cast("string")))


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, id (never null), tie (of the text), text (never null)."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    doc_id = F.col("doc_id").cast("long")
    return docs.select(doc_id.alias("doc_id"), F.coalesce(doc_id, F.lit(NO_ID)).alias("id"), F.xxhash64(text).alias("tie"), text.alias("text"))


def _texts_of(docs: DataFrame, need: DataFrame) -> DataFrame:
    """The texts of some (id, tie) keys, one row each."""
    need = save(need.distinct(), "need")
    side = F.broadcast(need) if need.count() <= BROADCAST_ROWS else need
    return save(keyed(docs).join(side, ["id", "tie"]).select("id", "tie", "text").dropDuplicates(["id", "tie"]), "texts")


def fingerprint(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint for every row of (doc_id, text)."""
    rows = save(keyed(docs).select("doc_id", "id", "tie", digest(canonical(F.col("text"))).alias("digest")), "digests")

    def forms_of(some):
        texts = _texts_of(docs, some.select("id", "tie"))
        return some.join(texts, ["id", "tie"]).select("id", "tie", "digest", canonical(F.col("text")).alias("form"))

    moved = settle(rows.select("id", "tie", "digest"), forms_of, ["id", "tie"])
    if moved is None:
        return rows.select("doc_id", F.col("digest").alias("fingerprint"))
    return rows.join(moved.distinct(), ["id", "tie", "digest"], "left").select("doc_id", _named(F.col("digest"), F.col("number")).alias("fingerprint"))


def edited_text(text: Column, following: Column) -> Column:
    n = F.char_length(text)
    half = F.floor(n / 2).cast("int")
    return F.concat(F.substring(text, F.lit(1), n - half), F.substring(following, F.lit(1), half))


def with_next(rows: DataFrame) -> DataFrame:
    """Adds next_id, next_tie, next_text, next_digest: the row after this one in descending id, after the last the first.

    Rows (id, tie, text, digest) are dealt into key ranges; a range's last row takes its neighbour from the next range
    that has rows.
    """
    bounds = range_bounds(rows, "id", 4 * shuffle_partitions(rows.sparkSession))
    rows = rows.withColumn("bucket", range_bucket(F.col("id"), bounds))
    inside = Window.partitionBy("bucket").orderBy(F.col("id").desc(), F.col("tie"))
    fields = ["id", "tie", "text", "digest"]
    led = rows.withColumn("after", F.lead(F.struct(*fields)).over(inside))
    # The first row of each range, one per range, for the range above it.
    heads = rows.groupBy("bucket").agg(F.max_by(F.struct(*fields), F.struct(F.col("id"), F.bitwise_not("tie"))).alias("head"))
    heads = save(heads, "heads")
    down = [r[0] for r in heads.select("bucket").orderBy(F.col("bucket").desc()).collect()]
    to = dict(zip(down, down[1:] + down[:1], strict=True))
    links = rows.sparkSession.createDataFrame([(b, a) for a, b in to.items()] or [], "bucket int, above int")
    entry = heads.join(links, "bucket").select(F.col("above").alias("bucket"), "head")
    after = F.coalesce(F.col("after"), F.col("head"))
    return led.join(entry, "bucket", "left").withColumns({f"next_{f}": after[f] for f in fields}).drop("after", "head", "bucket")


def compare_edited(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next of every row."""
    rows = keyed(docs).withColumn("digest", digest(canonical(F.col("text"))))
    rows = with_next(rows).withColumn("edited", edited_text(F.col("text"), F.col("next_text")))
    rows = save(rows.select(
        "doc_id", "id", "tie", "next_id", "next_tie", F.char_length("text").cast("long").alias("n_chars"), F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        "digest", digest(canonical(F.col("edited"))).alias("edited_digest"), "next_digest",
    ), "edited")
    keys = ["id", "tie", "next_id", "next_tie", "kind"]
    none = F.lit(None).cast("long")
    own = rows.select("id", "tie", none.alias("next_id"), none.alias("next_tie"), F.lit(0).alias("kind"), "digest")
    edited = rows.select("id", "tie", "next_id", "next_tie", F.lit(1).alias("kind"), F.col("edited_digest").alias("digest"))

    def forms_of(some):
        need = some.select("id", "tie").unionByName(some.where("kind = 1").select(F.col("next_id").alias("id"), F.col("next_tie").alias("tie")))
        texts = _texts_of(docs, need)
        following = texts.select(F.col("id").alias("next_id"), F.col("tie").alias("next_tie"), F.col("text").alias("following"))
        whole = some.join(texts, ["id", "tie"])
        first = whole.where("kind = 0").select(*keys, "digest", canonical(F.col("text")).alias("form"))
        second = whole.where("kind = 1").join(following, ["next_id", "next_tie"]).select(*keys, "digest", canonical(edited_text(F.col("text"), F.col("following"))).alias("form"))
        return first.unionByName(second)

    moved = settle(own.unionByName(edited), forms_of, keys)
    if moved is not None:
        moved = moved.distinct()
        m0 = moved.where("kind = 0").select("id", "tie", F.col("number").alias("a"))
        m1 = moved.where("kind = 1").select("id", "tie", "next_id", "next_tie", F.col("number").alias("b"))
        m2 = m0.select(F.col("id").alias("next_id"), F.col("tie").alias("next_tie"), F.col("a").alias("c"))
        rows = rows.join(m0, ["id", "tie"], "left").join(m1, ["id", "tie", "next_id", "next_tie"], "left").join(m2, ["next_id", "next_tie"], "left")
        rows = rows.withColumns({"digest": _named(F.col("digest"), F.col("a")), "edited_digest": _named(F.col("edited_digest"), F.col("b")), "next_digest": _named(F.col("next_digest"), F.col("c"))})
    same = lambda x, y: (F.col(x) == F.col(y)).cast("double")
    return rows.select(
        "doc_id", "n_chars", "edited_sha256", F.col("digest").alias("fingerprint"), F.col("edited_digest").alias("edited_fingerprint"),
        same("digest", "edited_digest").alias("near_edited"), same("digest", "next_digest").alias("near_next"),
    )
