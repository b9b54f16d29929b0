"""Static range asymmetric numeral system for token ids (operator 9).

Ids are written in ascending doc_id order (nulls first, repeated doc_ids by text
hash). The input is dealt into key ranges, each range is sorted, and its ids are
cut into blocks of whole documents. One frequency table over all ids is shared by
all blocks. A block holds interleaved lanes whose states are coded side by side,
checkpoints (word position and lane states) from which decoding can start in the
middle, and a checksum. Blocks are independent, so any number of readers can
decode them in parallel.

Nulls and empty texts are a document of the end id alone; an empty table gives an
empty file set.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import drop, lean, range_bounds, range_bucket, save, shuffle_partitions

BITS, LOW, WORD = 20, 1 << 31, 32
BLOCK_IDS, MAX_LANES, CHECK_STEPS = 1 << 18, 1024, 128
_HEAD = struct.Struct("<4sQQIIIIII")
MAGIC = b"SKR1"


def normalise(counts: np.ndarray) -> np.ndarray:
    """Frequencies that sum to 2**BITS, at least 1 for every id that occurs."""
    total, size = int(counts.sum()), 1 << BITS
    if not total:
        return np.zeros(len(counts), dtype=np.uint64)
    used = counts > 0
    if int(used.sum()) > size:
        raise ValueError(f"more than {size} distinct ids")
    freq = np.where(used, np.maximum(1, counts.astype(np.float64) * size / total).astype(np.int64), 0)
    rest = size - int(freq.sum())
    order = np.argsort(-counts, kind="stable")[: int(used.sum())]
    i = 0
    while rest:
        step = max(-(int(freq[order[i]]) - 1), rest) if rest < 0 else rest
        freq[order[i]] += step
        rest -= step
        i += 1
    return freq.astype(np.uint64)


def encode_ids(ids: np.ndarray, freq: np.ndarray) -> tuple[int, np.ndarray, list[tuple[int, int, np.ndarray]], np.ndarray]:
    """(lanes, final states, checkpoints, words) of one block; freq from normalise()."""
    cum = np.concatenate([[0], np.cumsum(freq)[:-1]]).astype(np.uint64)
    n = len(ids)
    lanes = int(min(MAX_LANES, max(1, n // 64)))
    steps = -(-n // lanes)
    grid = np.full(steps * lanes, ids[0] if n else 0, dtype=np.int64)
    grid[:n] = ids
    grid = grid.reshape(steps, lanes)
    x = np.full(lanes, LOW, dtype=np.uint64)
    shift, keep, word, top = np.uint64(BITS), np.uint64(0xFFFFFFFF), np.uint64(WORD), np.uint64(63 - BITS)
    out, marks, emitted = [], [], 0
    for t in range(steps - 1, -1, -1):
        f = freq[grid[t]]
        full = x >= (f << top)
        if full.any():
            out.append((x[full] & keep).astype("<u4"))
            emitted += len(out[-1])
            x[full] >>= word
        q = x // f
        x = (q << shift) + (x - q * f) + cum[grid[t]]
        if t and t % CHECK_STEPS == 0:
            marks.append((t, emitted, x.copy()))
    words = np.concatenate(out[::-1]) if out else np.zeros(0, dtype="<u4")
    return lanes, x, [(t, emitted - at, s) for t, at, s in reversed(marks)], words


class Decoder:
    """Holds what all blocks share: the frequency table and its inverse."""

    def __init__(self, freq: np.ndarray):
        self.freq = freq.astype(np.uint64)
        self.cum = np.concatenate([[0], np.cumsum(self.freq)[:-1]]).astype(np.uint64)
        self.symbol = np.repeat(np.arange(len(freq), dtype=np.int32), self.freq.astype(np.int64))

    def steps(self, x: np.ndarray, words: np.ndarray, at: int, first: int, last: int) -> np.ndarray:
        mask, shift, word, low = np.uint64((1 << BITS) - 1), np.uint64(BITS), np.uint64(WORD), np.uint64(LOW)
        x, out = x.copy(), np.empty((last - first, len(x)), dtype=np.int32)
        for t in range(last - first):
            slot = x & mask
            s = self.symbol[slot.astype(np.int64)]
            out[t] = s
            x = self.freq[s] * (x >> shift) + slot - self.cum[s]
            need = x < low
            k = int(np.count_nonzero(need))
            if k:
                x[need] = (x[need] << word) | words[at : at + k].astype(np.uint64)
                at += k
        return out

    def block(self, payload: bytes, from_checkpoint: int | None = None) -> dict:
        """A block's documents and ids; from_checkpoint: start at that checkpoint and return the ids from there on."""
        magic, n, start, lanes, steps, docs, n_words, checks, crc = _HEAD.unpack_from(payload)
        body = memoryview(payload)[_HEAD.size :]
        if magic != MAGIC or zlib.crc32(body) != crc:
            raise ValueError("damaged block")
        at = 0

        def take(kind: str, count: int) -> np.ndarray:
            nonlocal at
            a = np.frombuffer(body, dtype=kind, count=count, offset=at)
            at += a.nbytes
            return a

        doc_ids, nulls, lengths, x = take("<i8", docs), take("u1", docs), take("<u4", docs), take("<u8", lanes)
        marks = [(*take("<u4", 2).tolist(), take("<u8", lanes)) for _ in range(checks)]
        words = take("<u4", n_words)
        first = position = 0
        if from_checkpoint is not None:
            first, position, x = marks[from_checkpoint]
        ids = self.steps(x, words, position, first, steps).reshape(-1)[: n - first * lanes]
        return {"start": start, "doc_ids": doc_ids, "nulls": nulls, "lengths": lengths, "ids": ids, "first": first * lanes}


def encode_block(ids: np.ndarray, doc_ids: np.ndarray, nulls: np.ndarray, lengths: np.ndarray, start: int, freq: np.ndarray) -> bytes:
    lanes, x, marks, words = encode_ids(ids, freq)
    body = b"".join(
        [doc_ids.astype("<i8").tobytes(), nulls.astype("u1").tobytes(), lengths.astype("<u4").tobytes(), x.astype("<u8").tobytes()]
        + [np.array([t, at], dtype="<u4").tobytes() + s.astype("<u8").tobytes() for t, at, s in marks]
        + [words.tobytes()]
    )
    steps = -(-len(ids) // lanes)
    return _HEAD.pack(MAGIC, len(ids), start, lanes, steps, len(doc_ids), len(words), len(marks), zlib.crc32(body)) + body


def id_type(path: str, end_id: int) -> str:
    """How ids are kept on the way to their blocks: in 16 bits if all of the vocabulary's fit, else in 32."""
    from tokenizers import Tokenizer

    return "<u2" if max([end_id, *Tokenizer.from_file(path).get_vocab(True).values()]) < 1 << 16 else "<u4"


def _tokenise(path: str, end_id: int, kept: str):
    def run(batches):
        import pyarrow as pa
        import zstandard

        from .tokens import encoder, slices

        enc, end, press = encoder(path), end_id.to_bytes(4, "little"), zstandard.ZstdCompressor(level=1)
        for batch in batches:
            rows = list(zip(zip(*(batch.column(i).to_pylist() for i in (0, 1, 2)), strict=True), [t or "" for t in batch.column(3).to_pylist()], strict=True))
            for part in slices(rows):
                ids = [np.frombuffer(x + end, dtype="<u4").astype(kept) for x in enc.encode([t for _, t in part])]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([k[0] for k, _ in part], pa.int32()),
                        pa.array([k[1] for k, _ in part], pa.int64()),
                        pa.array([k[2] for k, _ in part], pa.int64()),
                        pa.array([press.compress(a.tobytes()) for a in ids], pa.binary()),
                    ],
                    names=["bucket", "doc_id", "tie", "ids"],
                )

    return run


def _group(batches, kept: str):
    """Sorted documents in; blocks of whole documents out. A block ends with its bucket or at BLOCK_IDS ids."""
    import pyarrow as pa
    import zstandard

    press, unpress = zstandard.ZstdCompressor(level=3), zstandard.ZstdDecompressor()
    docs, ids, size, bucket, number, first = [], [], 0, None, 0, 0

    def flush():
        nonlocal docs, ids, size, number, first
        arrays = np.concatenate(ids)
        packed = press.compress(arrays.tobytes())
        row = pa.RecordBatch.from_arrays(
            [
                pa.array([bucket], pa.int32()),
                pa.array([number], pa.int32()),
                pa.array([first], pa.int64()),
                pa.array([size], pa.int64()),
                pa.array([docs], pa.list_(pa.int64())),
                pa.array([[len(a) for a in ids]], pa.list_(pa.int64())),
                pa.array([packed], pa.binary()),
            ],
            names=["bucket", "block", "first", "n", "docs", "lengths", "ids"],
        )
        docs, ids, number, first, size = [], [], number + 1, first + size, 0
        return row

    for batch in batches:
        for b, doc, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(3).to_pylist(), strict=True):
            if docs and (b != bucket or size >= BLOCK_IDS):
                yield flush()
            if b != bucket:
                bucket, number, first = b, 0, 0
            a = np.frombuffer(unpress.decompress(blob), dtype=kept)
            docs.append(doc)
            ids.append(a)
            size += len(a)
    if docs:
        yield flush()


def _count(batches, kept: str):
    import pyarrow as pa
    import zstandard

    unpress, counts = zstandard.ZstdDecompressor(), np.zeros(1, dtype=np.int64)
    for batch in batches:
        for blob in batch.column(0).to_pylist():
            own = np.bincount(np.frombuffer(unpress.decompress(blob), dtype=kept))
            if len(own) > len(counts):
                counts = np.concatenate([counts, np.zeros(len(own) - len(counts), dtype=np.int64)])
            counts[: len(own)] += own
    some = np.nonzero(counts)[0]
    yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(counts[some], pa.int64())], names=["id", "n"])


def write(docs: DataFrame, path: str, end_id: int = 1) -> tuple[DataFrame, DataFrame]:
    """Encode (doc_id, text); gives the written files as tables: blocks (bucket, block, payload) and frequencies (id, freq)."""
    spark = docs.sparkSession
    n, kept = shuffle_partitions(spark), id_type(path, end_id)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    bounds = range_bounds(docs, "doc_id", 4 * n)
    keyed = docs.select(range_bucket(F.col("doc_id"), bounds).cast("int").alias("bucket"), "doc_id", F.xxhash64("text").alias("tie"), "text")
    ids = keyed.mapInArrow(lean(_tokenise(path, end_id, kept), "tokens"), "bucket int, doc_id long, tie long, ids binary")
    ordered = ids.repartition(n, "bucket").sortWithinPartitions("bucket", F.col("doc_id").asc_nulls_first(), "tie")
    raw = save(ordered.mapInArrow(lean(lambda it: _group(it, kept)), "bucket int, block int, first long, n long, docs array<long>, lengths array<long>, ids binary"), "id_blocks")
    # The table has one entry per id of the vocabulary, the offsets one per key range: both are bounded.
    found = raw.select("ids").mapInArrow(lean(lambda it: _count(it, kept)), "id int, n long").groupBy("id").agg(F.sum("n").alias("n")).collect()
    counts = np.zeros(max([0, *(r["id"] for r in found)]) + 1, dtype=np.int64)
    for r in found:
        counts[r["id"]] = r["n"]
    freq = normalise(counts)
    starts, at = {}, 0
    for r in raw.groupBy("bucket").agg(F.sum("n").alias("n")).orderBy("bucket").collect():
        starts[r["bucket"]] = at
        at += r["n"]

    def encode(batches):
        import pyarrow as pa
        import zstandard

        unpress = zstandard.ZstdDecompressor()
        for batch in batches:
            for r in batch.to_pylist():
                a = np.frombuffer(unpress.decompress(r["ids"]), dtype=kept).astype(np.int64)
                doc_ids, nulls = np.array([d or 0 for d in r["docs"]]), np.array([d is None for d in r["docs"]])
                payload = encode_block(a, doc_ids, nulls, np.array(r["lengths"]), starts[r["bucket"]] + r["first"], freq)
                yield pa.RecordBatch.from_arrays([pa.array([r["bucket"]], pa.int32()), pa.array([r["block"]], pa.int32()), pa.array([payload], pa.binary())], names=["bucket", "block", "payload"])

    blocks = save(raw.mapInArrow(lean(encode), "bucket int, block int, payload binary"), "rans_blocks")
    drop(raw)
    table = save(spark.createDataFrame([(i, int(f)) for i, f in enumerate(freq) if f], "id int, freq long"), "rans_table")
    return blocks, table


def read(blocks: DataFrame, table: DataFrame) -> DataFrame:
    """Decode files of write(): one row per document with doc_id, start, n_tokens and ids_crc32."""
    rows = table.collect()
    freq = np.zeros(max([0, *(r["id"] for r in rows)]) + 1, dtype=np.uint64)
    for r in rows:
        freq[r["id"]] = r["freq"]

    def decode(batches):
        import pyarrow as pa

        decoder = None
        for batch in batches:
            decoder = decoder or Decoder(freq)
            for payload in batch.column(0).to_pylist():
                b = decoder.block(payload)
                ids, ends = b["ids"].astype("<u4"), np.cumsum(b["lengths"], dtype=np.int64)
                begins = ends - b["lengths"]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([None if z else d for d, z in zip(b["doc_ids"].tolist(), b["nulls"].tolist(), strict=True)], pa.int64()),
                        pa.array(begins + b["start"], pa.int64()),
                        pa.array(b["lengths"].astype(np.int64), pa.int64()),
                        pa.array([zlib.crc32(ids[i:j].tobytes()) for i, j in zip(begins, ends, strict=True)], pa.int64()),
                    ],
                    names=["doc_id", "start", "n_tokens", "ids_crc32"],
                )

    return blocks.select("payload").mapInArrow(lean(decode), "doc_id long, start long, n_tokens long, ids_crc32 long")


def round_trip(spark: SparkSession, docs: DataFrame, path: str) -> DataFrame:
    return read(*write(docs, path))
