"""Language-model scores from a log-frequency Bloom filter (operator 2).

Bigrams of the training texts are counted exactly: each task packs its counts by
key, one blob per part, and each part adds them up. A part then writes its own
segment of a log-frequency Bloom filter: an n-gram of count c is entered with
the levels 1 .. 1 + log2(c), so its quantised count is read back by probing level
after level until one is missing. Words' counts and back-off weights are entered
in finer levels. Every bigram is entered at any corpus size, so the segments, which
are broadcast, grow with the events: BITS_PER_EVENT for each. Only a caller that
gives a bound makes parts raise the count from which bigrams are entered, and then
the mass of the others goes to the back-off.

A bigram's probability is (c - D) / c(v) for the entered ones plus the back-off
weight of v times the word's add-one probability: absolute discounting, with
D = n1 / (n1 + 2 n2) from the counts of counts and weights that make the sum over
words 1. The end token is also the context of a text's first word.

The base score needs the exact count of each word. Frequent words' counts (at
most TOP_WORDS) are broadcast; the others are joined.

Null and empty texts are the end token alone; a null doc_id is in training;
repeated rows are scored and counted one by one; an empty table gives an empty
result, and without training rows every word is unknown.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import lean, save, shuffle_partitions, text_slices

BITS_PER_EVENT, PROBES = 8, 4
HOT_WORDS, TOP_WORDS = 1024, 1 << 19
FINE = float(np.log(1.15))
END = 0x5851F42D4C957F2D
PART_TOKENS, SLICE_BYTES = 2_000_000, 1_000_000
_U = np.uint64


def token_hashes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """All tokens' 64-bit hashes, text after text, and how many each text has (its words and the end)."""
    from .minhash import _hashes

    split = [t.encode().lower().split() if t else [] for t in texts]
    sizes = np.array([len(s) + 1 for s in split], dtype=np.int64)
    out = np.full(int(sizes.sum()), END, dtype=np.uint64)
    is_word = np.ones(len(out), dtype=bool)
    is_word[np.cumsum(sizes) - 1] = False
    out[is_word] = np.fromiter((h for s in split for h in map(_hashes.__getitem__, s)), dtype=np.uint64, count=int(is_word.sum()))
    return out, sizes


def short(tokens: np.ndarray) -> np.ndarray:
    """32 bits of each token, as uint64."""
    from .minhash import _mix

    return _mix(tokens) >> _U(32)


def pair_keys(tokens: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """(context, token) of every token: the token before it, or the end before a text's first."""
    s = short(tokens)
    before = np.concatenate([s[-1:], s[:-1]])
    first = np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype(np.int64)
    if len(first):
        before[first] = short(np.array([END], dtype=np.uint64))[0]
    return (before << _U(32)) | s


def part_of(keys: np.ndarray, hot: np.ndarray, parts: int) -> np.ndarray:
    """A bigram goes with its context; those of hot contexts are dealt out one by one. hot: sorted short hashes."""
    from .minhash import _mix

    context = keys >> _U(32)
    spread = np.isin(context, hot)
    return (_mix(np.where(spread, keys, context)) % _U(parts)).astype(np.int64)


def levels_of(counts: np.ndarray) -> np.ndarray:
    return 1 + np.floor(np.log2(counts)).astype(np.int64)


def fine_levels(counts: np.ndarray) -> np.ndarray:
    return 1 + np.round(np.log(counts) / FINE).astype(np.int64)


def _places(keys: np.ndarray, kind: int, level: np.ndarray | int, size: np.ndarray | int) -> list[np.ndarray]:
    from .minhash import _mix

    h = _mix(keys ^ (_U(0x9E3779B97F4A7C15) * (np.atleast_1d(level).astype(np.uint64) * _U(4) + _U(kind))))
    step = (h >> _U(33)) | _U(1)
    return [(h + step * _U(i)) % np.asarray(size).astype(np.uint64) for i in range(PROBES)]


BIGRAM, COUNT, BACK_OFF = 0, 1, 2


def build_segment(keys: np.ndarray, counts: np.ndarray, hot: np.ndarray, max_bits: int | None = None) -> tuple[bytes, int, float, int, tuple]:
    """(bits, how many, discount, smallest entered count, hot contexts' sums) of one part; keys are sorted and distinct."""
    n1, n2 = int((counts == 1).sum()), int((counts == 2).sum())
    discount = min(0.98, max(0.1, n1 / (n1 + 2 * n2))) if n1 else 0.1
    level = levels_of(counts)
    context = keys >> _U(32)
    heads = np.concatenate([[0], np.nonzero(context[1:] != context[:-1])[0] + 1])
    words, total = context[heads], np.add.reduceat(counts, heads)
    least = 1
    while max_bits is not None and least < 1 << 40 and BITS_PER_EVENT * (int(level[counts >= least].sum()) + 8 * len(words)) > max_bits and (counts >= least).any():
        least += 1 if least < 4 else least // 4
    entered = counts >= least
    mass = np.add.reduceat(np.where(entered, counts - discount, 0.0), heads)
    is_hot = np.isin(words, hot)
    cold = ~is_hot
    back = np.clip(1 - mass / total, 1e-3, 1)
    fine, away = fine_levels(total[cold]), np.round(-np.log(back[cold]) / FINE).astype(np.int64)
    events = int(level[entered].sum() + fine.sum() + away.sum())
    size = max(64, -(-BITS_PER_EVENT * events // 64) * 64)
    if max_bits is not None and size > max_bits >= 64:
        size = max_bits // 64 * 64
    bits = np.zeros(size, dtype=bool)
    for kind, k, lv in ((BIGRAM, keys[entered], level[entered]), (COUNT, words[cold], fine), (BACK_OFF, words[cold], away)):
        j = 1
        while len(k):
            k, lv = k[lv >= j], lv[lv >= j]
            for place in _places(k, kind, j, size):
                bits[place] = True
            j += 1
    return np.packbits(bits, bitorder="little").tobytes(), size, discount, least, (words[is_hot], total[is_hot], mass[is_hot])


class Model:
    """What the workers get: the filter's segments, frequent words' exact counts and hot contexts' weights."""

    def __init__(self, segments: list, words: np.ndarray, counts: np.ndarray, hot: np.ndarray, hot_back: np.ndarray, total: int, distinct: int, parts: int):
        self.parts, self.total, self.distinct = parts, total, distinct
        self.size = np.full(parts, 64, dtype=np.int64)
        self.discount, self.least = np.full(parts, 0.5), np.ones(parts)
        blobs = {p: (b, s, d, m) for p, b, s, d, m in segments}
        for p, (_, s, d, m) in blobs.items():
            self.size[p], self.discount[p], self.least[p] = s, d, m
        self.offset = np.concatenate([[0], np.cumsum(self.size)])[:-1]
        empty = bytes(8)
        self.bits = np.frombuffer(b"".join(blobs[p][0] if p in blobs else empty for p in range(parts)), dtype=np.uint8)
        order = np.argsort(words)
        self.words, self.counts = words[order], counts[order]
        order = np.argsort(hot)
        self.hot, self.hot_back = hot[order], hot_back[order]

    def probe(self, keys: np.ndarray, parts: np.ndarray, kind: int) -> np.ndarray:
        """How many levels in a row the filter has for each key."""
        out = np.zeros(len(keys), dtype=np.int64)
        left, level = np.arange(len(keys)), 0
        while len(left):
            level += 1
            own = parts[left]
            size, offset = self.size[own], self.offset[own]
            ok = np.ones(len(left), dtype=bool)
            for place in _places(keys[left], kind, level, size):
                at = offset + place.astype(np.int64)
                ok &= ((self.bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1).astype(bool)
            left = left[ok]
            out[left] = level
            if level > 400:
                break
        return out

    def exact(self, words: np.ndarray) -> np.ndarray:
        """Exact counts of frequent words, -1 for the others."""
        if not len(self.words):
            return np.full(len(words), -1, dtype=np.int64)
        i = np.minimum(np.searchsorted(self.words, words), len(self.words) - 1)
        return np.where(self.words[i] == words, self.counts[i], -1)

    def log_probabilities(self, tokens: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """log10 of the model's probability of each token, and each token's exact count or -1."""
        words, back = np.unique(tokens, return_inverse=True)
        exact = self.exact(words)
        s = short(words)
        order = np.argsort(s)
        known = exact.astype(np.float64)
        rare = exact < 0
        where = part_of(s << _U(32), np.zeros(0, dtype=np.uint64), self.parts)
        lv = self.probe(s[rare], where[rare], COUNT)
        known[rare] = np.where(lv > 0, np.exp((lv - 1) * FINE), 0)
        back_off = np.ones(len(words))
        is_hot = np.isin(s, self.hot)
        if is_hot.any():
            back_off[is_hot] = self.hot_back[np.searchsorted(self.hot, s[is_hot])]
        cold = ~is_hot & (known > 0)
        back_off[cold] = np.exp(-FINE * self.probe(s[cold], where[cold], BACK_OFF))
        single = (known + 1) / (self.total + self.distinct + 1)
        keys, at = np.unique(pair_keys(tokens, sizes), return_inverse=True)
        own = part_of(keys, self.hot, self.parts)
        lv = self.probe(keys, own, BIGRAM)
        count = np.where(lv > 1, 1.5 * 2.0 ** (lv - 1) - 0.5, lv)
        gain = np.where((lv > 0) & (count >= self.least[own]), count - self.discount[own], 0.0)
        context = np.searchsorted(s[order], keys >> _U(32))
        context = order[np.minimum(context, len(order) - 1)]
        total = np.maximum(known[context], 1)
        p = np.where(known[context] > 0, back_off[context], 1.0)[at] * single[back] + np.minimum(gain / total, 1.0)[at]
        return np.log10(np.minimum(p, 1.0)), exact[back]


def _count_words(batches):
    import pyarrow as pa

    for batch in batches:
        for _, texts in text_slices(batch, 0, SLICE_BYTES):
            words, n = np.unique(token_hashes(texts)[0], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(words.view("<i8"), pa.int64()), pa.array(n, pa.int64())], names=["w", "c"])


def _count_pairs(hot: np.ndarray, parts: int):
    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for _, texts in text_slices(batch, 0, SLICE_BYTES):
                keys, n = np.unique(pair_keys(*token_hashes(texts)), return_counts=True)
                to = part_of(keys, hot, parts)
                order = np.argsort(to * 2 + (n > 1), kind="stable")
                cuts = np.searchsorted((to * 2 + (n > 1))[order], np.arange(2 * parts + 1))
                rows = []
                for p in range(parts):
                    one, many = order[cuts[2 * p] : cuts[2 * p + 1]], order[cuts[2 * p + 1] : cuts[2 * p + 2]]
                    if len(one) or len(many):
                        rows.append((p, keys[one].tobytes(), keys[many].tobytes(), n[many].astype("<u4").tobytes()))
                cols = list(zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32())] + [pa.array(c, pa.binary()) for c in cols[1:]], names=["part", "one", "many", "n"])

    return run


def _add_up(hot: np.ndarray, max_bits: int | None = None):
    def run(batches):
        import pyarrow as pa

        keys, counts, part = [], [], None

        def flush():
            k, c = np.concatenate(keys), np.concatenate(counts)
            order = np.argsort(k, kind="stable")
            k, c = k[order], c[order]
            heads = np.concatenate([[0], np.nonzero(k[1:] != k[:-1])[0] + 1])
            bits, size, discount, least, (words, total, mass) = build_segment(k[heads], np.add.reduceat(c, heads), hot, max_bits)
            return pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int32()), pa.array([bits], pa.binary()), pa.array([size], pa.int64()), pa.array([discount], pa.float64()), pa.array([least], pa.int64())]
                + [pa.array([words.view("<i8")], pa.list_(pa.int64())), pa.array([total.astype(np.float64)], pa.list_(pa.float64())), pa.array([mass], pa.list_(pa.float64()))],
                names=["part", "bits", "size", "discount", "least", "hot", "total", "mass"],
            )

        for batch in batches:
            for p, one, many, n in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if p != part and keys:
                    yield flush()
                    keys, counts = [], []
                part = p
                keys += [np.frombuffer(one, dtype="<u8"), np.frombuffer(many, dtype="<u8")]
                counts += [np.ones(len(one) // 8, dtype=np.int64), np.frombuffer(n, dtype="<u4").astype(np.int64)]
        if keys:
            yield flush()

    return run


def train(texts: DataFrame, max_bits: int | None = None) -> tuple[Model, DataFrame]:
    """texts: (text). Gives the model and the exact word counts (w, c)."""
    spark = texts.sparkSession
    counts = save(texts.mapInArrow(lean(_count_words, "words"), "w long, c long").groupBy("w").agg(F.sum("c").alias("c")), "words")
    total, distinct = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    # The count from which a word is frequent, from a histogram of a few hundred cells.
    cell = F.floor(F.log2("c") * 16).cast("int")
    cells = sorted(counts.groupBy(cell.alias("cell")).agg(F.count("*").alias("n"), F.min("c").alias("low")).collect(), key=lambda r: -r["cell"])
    limits = {}
    for name, most in (("top", TOP_WORDS), ("hot", HOT_WORDS)):
        seen, low = 0, 1 << 62
        for r in cells:
            seen += r["n"]
            if seen > most:
                break
            low = r["low"]
        limits[name] = low
    top = counts.where(F.col("c") >= limits["top"]).toArrow()
    words, c = top["w"].to_numpy().astype("int64").view("uint64"), top["c"].to_numpy().astype("int64")
    hot = np.unique(short(words[c >= limits["hot"]]))
    parts = max(shuffle_partitions(spark), total // PART_TOKENS)
    dealt = texts.mapInArrow(lean(_count_pairs(hot, parts), "words"), "part int, one binary, many binary, n binary").repartition(parts, "part").sortWithinPartitions("part")
    schema = "part int, bits binary, size long, discount double, least long, hot array<long>, total array<double>, mass array<double>"
    built = save(dealt.mapInArrow(lean(_add_up(hot, None if max_bits is None else max_bits // parts), "words"), schema), "segments")
    segments = [tuple(r) for r in built.select("part", "bits", "size", "discount", "least").toLocalIterator()]
    one = F.explode(F.arrays_zip("hot", "total", "mass")).alias("z")
    sums = built.select(one).groupBy(F.col("z.hot").alias("h")).agg(F.sum("z.total").alias("t"), F.sum("z.mass").alias("m")).collect()
    h = np.array([r["h"] for r in sums], dtype=np.int64).view("uint64")
    weights = np.array([min(1.0, max(1e-3, 1 - r["m"] / r["t"])) for r in sums], dtype=np.float64)
    return Model(segments, words, c, h, weights, int(total), int(distinct), int(parts)), counts


def score(docs: DataFrame, model: Model, counts: DataFrame) -> DataFrame:
    """doc_id, held_out, text to doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        import pyarrow as pa

        m = shared.value
        for batch in batches:
            for start, texts in text_slices(batch, 3, SLICE_BYTES):
                tokens, sizes = token_hashes(texts)
                logp, exact = m.log_probabilities(tokens, sizes)
                first = np.cumsum(sizes) - sizes
                rare = exact < 0
                doc = np.repeat(np.arange(len(texts)), sizes)
                pair = np.rec.fromarrays([doc[rare], tokens[rare]])
                own, n = np.unique(pair, return_counts=True) if len(pair) else (pair, np.zeros(0, dtype=np.int64))
                cuts = np.searchsorted(own["f0"], np.arange(len(texts) + 1))
                cut = lambda a, c=cuts: [a[i:j] for i, j in zip(c, c[1:], strict=False)]
                part = batch.slice(start, len(texts))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), part.column(2), pa.array(sizes, pa.int64()), pa.array(np.add.reduceat((exact > 0).astype(np.int64), first), pa.int64())]
                    + [pa.array(np.add.reduceat(np.log10(np.maximum(exact, 0) + 1.0), first)), pa.array(np.add.reduceat(logp, first))]
                    + [pa.array(cut(own["f1"].view("<i8")), pa.list_(pa.int64())), pa.array(cut(n), pa.list_(pa.int64()))],
                    names=["rid", "doc_id", "held_out", "n_tokens", "n_known", "base", "score", "w", "n"],
                )

    rows = docs.select(F.monotonically_increasing_id().alias("rid"), "doc_id", "held_out", "text")
    scored = save(rows.mapInArrow(lean(run, "words"), "rid long, doc_id long, held_out boolean, n_tokens long, n_known long, base double, score double, w array<long>, n array<long>"), "scored")
    shared.unpersist()
    rest = scored.select("rid", F.explode(F.arrays_zip("w", "n")).alias("z")).select("rid", F.col("z.w").alias("w"), F.col("z.n").alias("n"))
    found = rest.join(counts, "w").groupBy("rid").agg(F.sum(F.col("n") * F.log10(F.col("c") + 1)).alias("more"), F.sum("n").alias("known"))
    down = float(np.log10(model.total + model.distinct + 1))
    return scored.join(found, "rid", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce("known", F.lit(0))).alias("n_known"), F.lit(model.total).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("more", F.lit(0.0)) - F.col("n_tokens") * down).alias("base_score"), "score",
    )


def held_out(doc_id: Column, modulus: int, remainder: int = 2) -> Column:
    """Whether a document is held out of training: crc32 of its id as text; null ids never are."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(modulus)) == remainder, F.lit(False))


def score_documents(docs: DataFrame) -> DataFrame:
    """Trains on the documents that aren't held out and scores all."""
    doc_id = F.col("doc_id").cast("long")
    rows = docs.select(doc_id.alias("doc_id"), held_out(doc_id, 7).alias("held_out"), F.col("text").cast("string").alias("text"))
    model, counts = train(rows.where("not held_out").select("text"))
    return score(rows, model, counts)
