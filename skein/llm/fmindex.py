"""Benchmark decontamination with an FM-index per training shard (operator 5).

A worker turns each shard of documents (SHARD_BYTES of text) into word ids of
the benchmark's vocabulary, a document at a time. Only runs of benchmark words as long as the
shortest window can hold an occurrence, so the shard's index covers exactly
those runs, each closed by a separator. It has a suffix array, its
Burrows-Wheeler transform in a wavelet matrix, and sampled suffix positions; all
windows of the benchmark are searched backwards side by side through the
wavelet ranks, located by walking to the next sample, and merged into spans.

The benchmark reaches the workers in blocks of items with a bounded number of
bytes (BLOCK_BYTES); every shard is searched for every block.

Null and empty texts have no words. Items without words have no window; items
with a null id mark words but aren't listed. Repeated item ids are one item;
repeated documents are searched one by one; an empty table gives an empty result.
"""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean, text_slices

WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
WIDTH, SHARD_BYTES, SAMPLE, BLOCK_BYTES = 10, 2_000_000, 8, 32_000_000


def words(text: str | None) -> list[bytes]:
    return WORD.findall(text.encode().lower()) if text else []


class Phrases:
    """Distinct windows of a block of items: word ids by length, and the items of each window."""

    def __init__(self, items: list[tuple[str | None, str | None]], width: int = WIDTH):
        self.vocab: dict[bytes, int] = {}
        self.names = sorted({name for name, _ in items if name is not None})
        number = {name: i for i, name in enumerate(self.names)}
        found: dict[tuple[int, ...], set[int]] = {}
        for name, text in items:
            ids = [self.vocab.setdefault(w, len(self.vocab) + 1) for w in words(text)]
            for i in range(max(1, len(ids) - width + 1) if ids else 0):
                own = found.setdefault(tuple(ids[i : i + width]), set())
                if name is not None:
                    own.add(number[name])
        by_length: dict[int, list[tuple[tuple[int, ...], set[int]]]] = {}
        for w, own in found.items():
            by_length.setdefault(len(w), []).append((w, own))
        self.groups = []
        for length, ws in sorted(by_length.items()):
            ends = np.cumsum([0] + [len(own) for _, own in ws])
            self.groups.append((length, np.array([w for w, _ in ws], dtype=np.int32), ends, np.array([i for _, own in ws for i in sorted(own)], dtype=np.int64)))
        self.shortest = min(by_length, default=0)


def suffix_array(rank: np.ndarray) -> np.ndarray:
    """By prefix doubling; rank: an int64 per position. Equal suffixes must differ somewhere (closed runs do)."""
    n, h = len(rank), 1
    _, rank = np.unique(rank, return_inverse=True)
    rank = rank.astype(np.int64)
    while True:
        nxt = np.full(n, -1, dtype=np.int64)
        nxt[: n - h] = rank[h:] if h < n else []
        key = rank * (n + 1) + nxt + 1
        order = np.argsort(key, kind="stable")
        key = key[order]
        fresh = np.concatenate([[0], np.cumsum(key[1:] != key[:-1])])
        rank = np.empty(n, dtype=np.int64)
        rank[order] = fresh
        if fresh[-1] == n - 1 or h >= n:
            return order
        h *= 2


class FMIndex:
    """Over ids >= 1 in runs that end with a 0."""

    def __init__(self, text: np.ndarray, sigma: int):
        n = len(text)
        zero = text == 0
        first = text.astype(np.int64) + n
        first[zero] = np.arange(int(zero.sum()))  # each separator is a letter of its own
        sa = suffix_array(first)
        before = text[sa - 1]
        before[sa == 0] = 0
        self.bwt = before
        self.starts = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=sigma + 1))])[: sigma + 1]
        self.bits = max(1, int(sigma).bit_length())
        self.levels = []
        seq = before
        for b in range(self.bits - 1, -1, -1):
            bit = (seq >> b) & 1
            ones = np.concatenate([[0], np.cumsum(bit)]).astype(np.int32)
            self.levels.append((b, ones, n - int(ones[-1])))
            seq = np.concatenate([seq[bit == 0], seq[bit == 1]])
        kept = (sa % SAMPLE == 0) | (before == 0)
        self.sampled = kept
        self.positions = np.where(kept, sa, -1)

    def rank(self, letters: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each letter occurs in the transform before each place."""
        low, at = np.zeros_like(at), at.copy()
        for b, ones, zeros in self.levels:
            one = ((letters >> b) & 1).astype(bool)
            a, z = ones[at], ones[low]
            at = np.where(one, zeros + a, at - a)
            low = np.where(one, zeros + z, low - z)
        return at - low

    def find(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(number of the pattern, position) of each occurrence; patterns: one per row, of one length."""
        which = np.arange(len(patterns))
        low = np.zeros(len(patterns), dtype=np.int64)
        high = np.full(len(patterns), len(self.bwt), dtype=np.int64)
        for j in range(patterns.shape[1] - 1, -1, -1):
            c = patterns[which, j]
            low, high = self.starts[c] + self.rank(c, low), self.starts[c] + self.rank(c, high)
            some = low < high
            which, low, high = which[some], low[some], high[some]
            if not len(which):
                break
        count = high - low
        which = np.repeat(which, count)
        at = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count) + np.repeat(low, count)
        steps, open_ = np.zeros(len(at), dtype=np.int64), ~self.sampled[at]
        while open_.any():
            i = at[open_]
            c = self.bwt[i]
            at[open_] = self.starts[c] + self.rank(c, i)
            steps[open_] += 1
            open_ = ~self.sampled[at]
        return which, self.positions[at] + steps


def coded(texts: list[str | None], blocks: list[Phrases]) -> tuple[np.ndarray, list[np.ndarray]]:
    """Each text's number of words, and for each block all words' ids in its vocabulary (0: unknown); only one text's words are Python objects at a time."""
    sizes, ids = np.zeros(len(texts), dtype=np.int64), [[] for _ in blocks]
    for i, text in enumerate(texts):
        own = words(text)
        sizes[i] = len(own)
        for out, phrases in zip(ids, blocks, strict=True):
            get = phrases.vocab.get
            out.append(np.fromiter((get(w, 0) for w in own), dtype=np.int32, count=len(own)))
    return sizes, [np.concatenate([np.zeros(0, dtype=np.int32), *out]) for out in ids]


def search(sizes: np.ndarray, ids: np.ndarray, phrases: Phrases) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A flag per word of the concatenated documents, and the distinct (document, item number) pairs; sizes, ids: from coded()."""
    total = len(ids)
    none = np.zeros(0, dtype=np.int64)
    if not total or not phrases.shortest:
        return np.zeros(total, dtype=bool), none, none
    ends = np.cumsum(sizes)
    doc_of_start = np.zeros(total, dtype=bool)
    doc_of_start[(ends - sizes)[sizes > 0]] = True
    known = ids > 0
    if not known.any():
        return np.zeros(total, dtype=bool), none, none
    opens = known & (doc_of_start | ~np.concatenate([[False], known[:-1]]))
    run = np.cumsum(opens) - 1
    lengths = np.bincount(run[known], minlength=int(opens.sum()))
    keep = known & (lengths[np.maximum(run, 0)] >= phrases.shortest)
    if not keep.any():
        return np.zeros(total, dtype=bool), none, none
    place = np.nonzero(keep)[0]
    # each kept run is followed by a separator
    new = np.concatenate([[0], np.cumsum((run[place][1:] != run[place][:-1]))])
    at = np.arange(len(place)) + new
    text = np.zeros(len(place) + int(new[-1]) + 1, dtype=np.int32)
    text[at] = ids[place]
    back = np.zeros(len(text), dtype=np.int64)
    back[at] = place
    del ids, doc_of_start, known, opens, run, lengths, keep, place, new, at
    index = FMIndex(text, len(phrases.vocab))
    edge = np.zeros(total + 1, dtype=np.int64)
    pairs = []
    for length, patterns, first, items in phrases.groups:
        which, position = index.find(patterns)
        if not len(which):
            continue
        begin = back[position]
        np.add.at(edge, begin, 1)
        np.add.at(edge, begin + length, -1)
        both = np.unique(np.searchsorted(ends, begin, side="right") * len(patterns) + which)
        doc, w = both // len(patterns), both % len(patterns)
        count = first[w + 1] - first[w]
        own = items[np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count) + np.repeat(first[w], count)]
        pairs.append(np.repeat(doc, count) * max(1, len(phrases.names)) + own)
    pair = np.unique(np.concatenate(pairs)) if pairs else none
    names = max(1, len(phrases.names))
    return np.cumsum(edge[:-1]) > 0, pair // names, pair % names


def phrase_blocks(benchmark: DataFrame, width: int = WIDTH, block_bytes: int = BLOCK_BYTES) -> list:
    """Broadcasts of Phrases, each of items with about block_bytes bytes of text."""
    spark = benchmark.sparkSession
    rows = benchmark.select(F.col("item_id").cast("string").alias("i"), F.col("text").cast("string").alias("t"))
    size = rows.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    blocks = -(-size // block_bytes)
    cut = F.pmod(F.xxhash64("i", "t"), F.lit(max(1, blocks)))
    return [spark.sparkContext.broadcast(Phrases([tuple(r) for r in rows.where(cut == k).collect()], width)) for k in range(blocks)]


def _scan(batches, blocks, text_at: int, give):
    """Calls give(batch slice, texts, documents' numbers of words, flags, per-document item names) for each shard."""
    import pyarrow as pa

    for batch in batches:
        for i, texts in text_slices(batch, text_at, SHARD_BYTES):
            sizes, coded_texts = coded(texts, [block.value for block in blocks])
            flags = np.zeros(int(sizes.sum()), dtype=bool)
            items: dict[int, set[str]] = {}
            for block, ids in zip(blocks, coded_texts, strict=True):
                phrases = block.value
                hit, doc, item = search(sizes, ids, phrases)
                flags |= hit
                for d, k in zip(doc.tolist(), item.tolist(), strict=True):
                    items.setdefault(d, set()).add(phrases.names[k])
            yield give(pa, batch.slice(i, len(texts)), texts, sizes, flags, items)


def find(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH) -> DataFrame:
    """Per document: doc_id, n_words, n_hit, items (ids as sorted strings) and spans (first and last word of each hit run)."""
    blocks = phrase_blocks(benchmark, width)

    def give(pa, batch, _, sizes, flags, items):
        ends = np.cumsum(sizes)
        total = np.concatenate([[0], np.cumsum(flags)])
        hits = total[ends] - total[ends - sizes]
        spans = []
        for k in range(len(sizes)):
            if not hits[k]:
                spans.append([])
                continue
            own = np.concatenate([[0], flags[ends[k] - sizes[k] : ends[k]].astype(np.int8), [0]])
            turn = np.diff(own)
            spans.append([[int(a), int(b) - 1] for a, b in zip(np.nonzero(turn == 1)[0], np.nonzero(turn == -1)[0], strict=True)])
        return pa.RecordBatch.from_arrays(
            [
                batch.column(0),
                pa.array(sizes, pa.int64()),
                pa.array(hits, pa.int64()),
                pa.array([sorted(items.get(k, ())) for k in range(len(sizes))], pa.list_(pa.string())),
                pa.array(spans, pa.list_(pa.list_(pa.int32()))),
            ],
            names=["doc_id", "n_words", "n_hit", "items", "spans"],
        )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(lean(lambda it: _scan(it, blocks, 1, give)), "doc_id long, n_words long, n_hit long, items array<string>, spans array<array<int>>")


def remove(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH) -> DataFrame:
    """The same table with each hit span cut out of `text`, from its first word's first byte to its last word's last."""
    blocks = phrase_blocks(benchmark, width)
    at = docs.columns.index("text")

    def give(pa, batch, texts, sizes, flags, items):
        end, out = 0, list(texts)
        for k, n in enumerate(sizes.tolist()):
            begin, end = end, end + n
            if k not in items and not flags[begin:end].any():
                continue
            raw = texts[k].encode()
            keep, last = [], 0
            run = None
            for m, hit in zip(WORD.finditer(raw.lower()), flags[begin:end].tolist(), strict=True):
                if hit and run is None:
                    keep.append(raw[last : m.start()])
                    run = True
                if hit:
                    last = m.end()
                else:
                    run = None
            out[k] = b"".join([*keep, raw[last:]]).decode()
        return batch.set_column(at, batch.schema.field(at), pa.array(out, batch.schema.field(at).type))

    return docs.mapInArrow(lean(lambda it: _scan(it, blocks, at, give)), docs.schema)
