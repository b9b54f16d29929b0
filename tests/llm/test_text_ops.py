"""Operators 1, 2, 3, 4 and 7 and the pipeline against brute force, exact counts or held-out accuracy."""

import hashlib
import itertools
import math
import re
import zlib
from collections import Counter, defaultdict

import corpus_pipeline
import numpy as np
import pytest
from pyspark.sql import functions as F
from skein.llm import components, fmindex, linededup, lm, minhash, packing, pii, queries, toxicity

from .test_small_ops import check_packing, encoded, hits


@pytest.fixture(scope="module")
def rows(spark, sf_dir):
    return [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")


# --- 1: near duplicates


def shingle_set(text, k):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def classes(rows, k, num, den):
    sets = {}
    for d, t in rows:
        sets.setdefault(d, []).append(shingle_set(t, k))
    label = {d: d for d in sets}
    index = defaultdict(set)
    for d, many in sets.items():
        for s in many:
            for x in s:
                index[x].add(d)
    pairs = {p for ds in index.values() if len(ds) > 1 for p in itertools.combinations(sorted(ds), 2)}
    links = [(a, b) for a, b in pairs if any(den * len(s & t) >= num * len(s | t) for s in sets[a] for t in sets[b])]
    changed = True
    while changed:
        changed = False
        for a, b in links:
            low = min(label[a], label[b])
            if label[a] != low or label[b] != low:
                label[a] = label[b] = low
                changed = True
    return label


def test_op1(spark, sf_dir, rows):
    want = classes(rows, 3, 85, 100)
    got = {r.doc_id: r for r in queries.op1_minhash_near_dedup(spark, sf_dir).collect()}
    assert {d: r.component_id for d, r in got.items()} == want
    assert all(r.n_shingles == len(shingle_set(t, 3)) and got[d].kept == (want[d] == d) for (d, t) in rows for r in [got[d]])


def near_rows():
    """A base text whose copies differ by 0 to 25 % of their words, a chain of small steps, and odd rows."""
    rng = np.random.default_rng(11)
    base = [f"w{i}" for i in range(300)]
    out = []
    for i in range(120):
        w = list(base)
        for j in rng.choice(300, int(rng.integers(0, 40)), replace=False):
            w[j] = f"x{i}_{j}"
        out.append((i, " ".join(w)))
    w = [f"c{i}" for i in range(300)]
    for i in range(200, 230):
        w = list(w)
        for j in rng.choice(300, 5, replace=False):
            w[j] = f"y{i}_{j}"
        out.append((i, " ".join(w)))
    return out + [(300, "two words"), (301, "Two  words"), (302, "two other"), (303, ""), (304, None), (305, " \t"), (306, "w0 w1 w2"), (306, "w0 w1 w2"), (306, "another text of this id")]


def test_op1_loses_no_link(spark):
    data = near_rows()
    docs = spark.createDataFrame([(d, t, 1) for d, t in data] + [(None, "two words", 1)], "doc_id long, text string, bands int")
    got = minhash.near_duplicates(docs, 3, 85, 100).collect()
    want = classes(data, 3, 85, 100)
    assert {r.doc_id: r.component_id for r in got if r.doc_id is not None} == want
    assert len(got) == len(data) + 1 and [(r.component_id, r.kept) for r in got if r.doc_id is None] == [(None, True)]
    assert len({want[i] for i in range(120)}) > 5  # the fixture has members that link with no one


def test_op1_keeps_one_row_per_class(spark, empty):
    docs = spark.createDataFrame([(d, t) for d, t in near_rows() if d != 306], "doc_id long, text string")
    want = classes([(r.doc_id, r.text) for r in docs.collect()], 5, 4, 5)
    assert {r.doc_id for r in minhash.drop_near_duplicates(docs).collect()} == {d for d, c in want.items() if c == d}
    assert minhash.near_duplicates(empty).count() == 0


def test_sketches_estimate_and_merge():
    rng = np.random.default_rng(2)
    items = rng.integers(0, 1 << 63, 3000).astype(np.uint64)
    a, b = items[:2000], items[1000:]
    ra, rb = minhash.registers(a), minhash.registers(b)
    assert (np.maximum(ra, rb) == minhash.registers(items)).all()
    assert abs(minhash.likelihood_similarity(ra, rb, 2000, 2000) - 1 / 3) < 0.15


def test_components(spark):
    rng = np.random.default_rng(4)
    links = [(int(a), int(b)) for a, b in rng.integers(0, 300, (220, 2))] + [(i, i + 1) for i in range(1000, 1060)] + [(5000, i) for i in range(5001, 5300)]
    label = {n: n for p in links for n in p}
    for _ in range(100):
        for a, b in links:
            label[a] = label[b] = min(label[a], label[b])
    linked = {n for a, b in links if a != b for n in (a, b)}
    got = {r.node: r.label for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {n: label[n] for n in linked}


# --- 2: language model


def test_op2_base_is_exact_and_scores_are_better(spark, sf_dir, rows):
    got = {r.doc_id: r for r in queries.op2_lm_scoring(spark, sf_dir).collect()}
    tokens = {d: [*(t or "").encode().lower().split(), b"\x00end"] for d, t in rows}
    held = {d: zlib.crc32(str(d).encode()) % 7 == 2 for d, _ in rows}
    counts = Counter(w for d, t in tokens.items() if not held[d] for w in t)
    n, v = sum(counts.values()), len(counts)
    for d, t in tokens.items():
        r = got[d]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[d], len(t), sum(w in counts for w in t), n)
        assert math.isclose(r.base_score, sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in t), rel_tol=1e-9)
    mine = [r for r in got.values() if r.held_out]
    assert sum(r.score for r in mine) > sum(r.base_score for r in mine)
    assert all(r.score <= 0 for r in got.values())


def test_op2_filter_reads_counts_back():
    rng = np.random.default_rng(8)
    keys = np.unique(rng.integers(0, 1 << 62, 4000).astype(np.uint64))
    counts = rng.geometric(0.4, len(keys)).astype(np.int64)
    none = np.zeros(0, dtype=np.uint64)
    bits, size, discount, least, _ = lm.build_segment(keys, counts, none, 1 << 20)
    model = lm.Model([(0, bits, size, discount, least)], none, none.astype(np.int64), none, np.zeros(0), int(counts.sum()), 10, 1)
    read = model.probe(keys, np.zeros(len(keys), dtype=np.int64), lm.BIGRAM)
    assert least == 1 and (read >= lm.levels_of(counts)).all() and (read == lm.levels_of(counts)).mean() > 0.9
    other = rng.integers(0, 1 << 62, 4000).astype(np.uint64)
    assert (model.probe(other, np.zeros(4000, dtype=np.int64), lm.BIGRAM) > 0).mean() < 0.1
    # a small budget raises the smallest count that is entered, and the rest goes to the back-off
    bits, size, _, least, _ = lm.build_segment(keys, counts, none, 40_000)
    assert least > 1 and size <= 40_000 and len(bits) * 8 <= 40_064


def test_op2_enters_every_bigram_at_any_size(spark, monkeypatch):
    bounds, add_up = [], lm._add_up
    monkeypatch.setattr(lm, "_add_up", lambda hot, bound=None: bounds.append(bound) or add_up(hot, bound))
    monkeypatch.setattr(lm, "shuffle_partitions", lambda _: 64)
    model, _ = lm.train(spark.createDataFrame([("a b a c",), ("b a",)], "text string"))
    assert model.parts == 64 and (model.least == 1).all()
    # a part's events, more than 2^30 bits hold for 64 parts
    none, keys = np.zeros(0, dtype=np.uint64), (np.arange(2_200_000, dtype=np.uint64) // np.uint64(1000) << np.uint64(32)) + np.arange(2_200_000, dtype=np.uint64) % np.uint64(1000)
    _, size, _, least, _ = lm.build_segment(keys, np.ones(len(keys), dtype=np.int64), none, bounds[0])
    assert least == 1 and size >= lm.BITS_PER_EVENT * len(keys)


def test_op2_probabilities_sum_to_one(spark):
    docs = spark.createDataFrame([("a b a b a c",), ("a b c",), ("b a",)], "text string")
    model, _ = lm.train(docs)
    words = np.concatenate([lm.token_hashes([w])[0][:1] for w in "abc"] + [np.array([lm.END], dtype=np.uint64)])
    for v in words[:3]:
        total = sum(10 ** model.log_probabilities(np.array([v, w], dtype=np.uint64), np.array([2]))[0][1] for w in words)
        assert 0.85 < total < 1.15  # counts are known to within a step of 15 %


def test_op2_edges(spark, empty):
    docs = spark.createDataFrame([(1, None, 0), (2, "", 0), (3, "A a", 0), (3, "A a", 0), (None, "b", 0)], "doc_id long, text string, w int")
    got = lm.score_documents(docs).collect()
    assert sorted(r.n_tokens for r in got) == [1, 1, 2, 3, 3] and len(got) == 5
    assert lm.score_documents(empty).count() == 0


# --- 3: toxicity


def test_op3_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    got = {r.doc_id: r for r in queries.op3_toxicity(spark, sf).collect()}
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) and r.held_out == (zlib.crc32(str(d).encode()) % 4 == 2) for d, r in got.items())
    held = [(r.score, labels[d]) for d, r in got.items() if r.held_out and d in labels]
    good, bad = [s for s, y in held if y], [s for s, y in held if not y]
    assert np.mean([(a > b) + 0.5 * (a == b) for a in good for b in bad]) > 0.8
    assert sum(s >= 0.3 for s in bad) <= 0.05 * len(bad)


def test_op3_marginals_are_exact():
    rng = np.random.default_rng(1)
    sizes = np.array([1, 0, 7, 3, 150])
    emit, first = rng.normal(0, 2, int(sizes.sum())), toxicity._firsts(sizes)
    chain, start = rng.normal(0, 1, (2, 2)), rng.normal(0, 1, 2)
    got, at = toxicity.marginals(emit, first, chain, start), 0
    for n in sizes:
        e = emit[at : at + n]
        if n and n <= 7:
            weights = {y: math.exp(start[y[0]] + sum(e[i] * y[i] for i in range(n)) + sum(chain[y[i], y[i + 1]] for i in range(n - 1))) for y in itertools.product((0, 1), repeat=int(n))}
            for i in range(n):
                assert math.isclose(got[at + i], sum(w for y, w in weights.items() if y[i]) / sum(weights.values()), rel_tol=1e-6)
        at += n


def test_op3_edges(spark, empty):
    texts = [f"good words here {i} fine text" for i in range(60)] + [f"good {i} words zork here fine text zork" for i in range(20)]
    tagger = toxicity.fit(texts, [0] * 60 + [1] * 20)
    docs = spark.createDataFrame([(1, None, 0), (2, "", 0), (3, "good Zork, here fine text zork", 0), (4, "fine text", 0)], "doc_id long, text string, score2 int")
    got = {r.doc_id: r for r in toxicity.score(docs, tagger).collect()}
    assert got[3].score > 0.5 > got[4].score and got[3].spans == [[5, 9], [26, 30]] and got[1].score == got[2].score
    assert {r.score for r in toxicity.score(docs, None).collect()} == {0.0}
    assert toxicity.score(empty, tagger).count() == 0 and toxicity.fit(["a"], [1]) is None


# --- 4: personal data

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def plain_base(text):
    out = []
    for k, (kind, p) in enumerate(PATTERNS.items()):
        for m in re.finditer(p, text):
            digits = re.sub(r"[^0-9]", "", m[0])
            ok = {"email": True, "ip": all(int(x) <= 255 for x in m[0].split(".")) if kind == "ip" else True, "card": 12 <= len(digits) <= 19 and pii.luhn(digits) if digits else False, "phone": 9 <= len(digits) <= 15}[kind]
            if ok:
                out.append((m.start(), k, f"{kind}:{m.start()}:{m.end()}"))
    return sorted(out)


def test_op4_base(spark, sf_dir, rows):
    got = {r.doc_id: r for r in queries.op4_pii(spark, sf_dir).collect()}
    found = Counter()
    for d, t in rows:
        base = plain_base(t or "")
        r = got[d]
        assert r.base_sha256 == hashlib.sha256(",".join(x[2] for x in base).encode()).hexdigest()
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(x[1] == k for x in base) for k in range(4))
        assert {x[2] for x in base} <= set(r.spans.split(","))
        found.update(x[1] for x in base)
    assert found[0] and found[1] and found[3]


def test_op4_base_on_random_text():
    rng = np.random.default_rng(3)
    letters = list("a1234567890..@@++--  ()bZ\né")
    for _ in range(3000):
        text = "".join(rng.choice(letters, int(rng.integers(0, 60))))
        assert [f"{pii.KINDS[k]}:{a}:{b}" for k, a, b in pii.base_spans(text)] == [x[2] for x in plain_base(text)]
    assert pii.base_spans("4" * 200_000 + "a" * 200_000 + "." * 1000 + "1." * 1000) is not None


def test_op4_decoding_and_additions(spark, empty):
    rng = np.random.default_rng(5)
    for _ in range(100):
        spans = sorted({(0, int(a), int(a + n)) for a, n in zip(rng.integers(0, 20, 6), rng.integers(1, 8, 6), strict=True)}, key=lambda s: (s[2], s[1]))
        scores = rng.normal(0, 2, len(spans))
        before = pii._before(spans, list(range(len(spans))))
        sets = [c for n in range(len(spans) + 1) for c in itertools.combinations(range(len(spans)), n) if all(spans[i][2] <= spans[j][1] or spans[j][2] <= spans[i][1] for i, j in itertools.combinations(c, 2))]
        totals = np.array([sum(scores[i] for i in c) for c in sets])
        assert math.isclose(sum(scores[i] for i in pii.best_segments(scores.tolist(), before)), totals.max(), abs_tol=1e-9)
        p = np.exp(totals - totals.max())
        want = [p[[i in c for c in sets]].sum() / p.sum() for i in range(len(spans))]
        assert np.allclose(pii.segment_marginals(scores, before), want)
    weights = pii.fit([f"mail bob{i}@host{i}.example.com now, call +1 (555) 234-{1000 + i} or 10.0.{i % 200}.7 x" for i in range(300)])
    text = "write to bob [at] mail.example.com or call (555) 234-5678 ok"
    assert {k for k, _, _ in pii.added_spans(text, [], weights)} == {0, 3}
    assert pii.added_spans("in 1234 5678 9012 3456 of 999[.]888[.]777[.]666", [], weights) == []
    docs = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (None, "a@b.cc", "x")], "doc_id long, text string, spans string")
    assert {(r.doc_id, r.spans) for r in pii.find(docs, weights).collect()} == {(1, ""), (2, ""), (None, "email:0:6")}
    assert pii.find(empty, pii.train(empty)).count() == 0


def test_op4_marginals_of_many_groups():
    rng = np.random.default_rng(6)
    for n in (1, 3, 7):
        scores, before = rng.normal(0, 2, (20, n)), np.array([[int(rng.integers(0, k + 1)) for k in range(n)] for _ in range(20)])
        want = [pii.segment_marginals(s, b.tolist()) for s, b in zip(scores, before, strict=True)]
        assert np.allclose(pii.segment_marginals_of(scores, before), want)


def test_op4_recall_on_planted_spans():
    """Loose spans and secrets at known places, in writing that the training texts share only in part, and texts that hold none."""
    rng = np.random.default_rng(11)
    pick = lambda letters, n: "".join(rng.choice(list(letters), n))
    low, digits, hexes = "abcdefghijklmnopqrstuvwxyz", "0123456789", "0123456789abcdef"
    words = "the of and river house seven over under walked spoke quiet morning letter stone about between again".split()
    prose = lambda n: " ".join(rng.choice(words, n))
    weights = pii.fit([])
    hits = total = exact = false = 0
    for k in range(600):
        n10 = f"{rng.integers(2, 10)}{pick(digits, 9)}"
        card = "5" + pick(digits, 14)
        card += next(c for c in digits if pii.luhn(card + c))
        ip = [str(x) for x in rng.integers(1, 256, 4)]
        lead, kind, body, close = [
            ("", "email", f"{pick(low, 6)} [at] {pick(low, 7)}.com", ""), ("", "email", f"{pick(low, 4)}.{pick(low, 5)}(at){pick(low, 7)}(dot)org", ""), ("", "email", f"{pick(low, 6)} @ {pick(low, 7)}.net", ""),
            ("", "phone", f"({n10[:3]}) {n10[3:6]}-{n10[6:]}", ""), ("", "phone", f"{n10[:3]}-{n10[3:6]}-{n10[6:]}", ""), ("", "ip", "[.]".join(ip), ""), ("", "card", ".".join(card[i : i + 4] for i in range(0, 16, 4)), ""),
            ("db_password = '", "secret", pick(low + digits, 11) + "7", "'"), ("", "secret", "AKIA" + pick("ABCDEFGH234567", 16), ""), ("SESSION_KEY: ", "secret", pick(hexes, 31) + "e", ""), ('token="', "secret", pick(hexes, 40), '"'),
        ][k % 11]
        left = f"{prose(8)} {lead}"
        text = f"{left}{body}{close} {prose(8)}"
        got = pii.added_spans(text, pii.base_spans(text), weights)
        total += 1
        hits += any(a < len(left) + len(body) and b > len(left) for _, a, b in got)
        exact += (pii.ALL_KINDS.index(kind), len(left), len(left) + len(body)) in got
        plain = f"{prose(6)} {rng.integers(1900, 2030)}-{rng.integers(10, 13)}-{rng.integers(10, 28)} {prose(3)} page {rng.integers(1, 900)} to {rng.integers(1, 900)} {prose(3)} v{rng.integers(1, 9)}.{rng.integers(1, 30)}.{rng.integers(1, 30)} {pick(low, 12)}{k} key to {prose(4)}"
        false += bool(pii.added_spans(plain, pii.base_spans(plain), weights))
    assert hits >= 0.95 * total and exact >= 0.9 * total, (hits, exact, total)
    assert false <= 0.02 * total, false


def test_op4_long_texts_and_edges(spark):
    weights = pii.fit([])
    long = "1 " * 20_000 + "a" * 20_000 + "1" * 20_000 + "at x dot " * 5000 + "@" * 10_000 + "a1" * 10_000 + "[dot]" * 2000 + " 1234" * 2000
    before = pii.base_spans(long)
    assert all(b <= c or d <= a for _, a, b in pii.added_spans(long, before, weights) for _, c, d in before)
    assert pii.added_spans("", [], weights) == [] and list(pii.places("")) == []
    text = "x " * 500 + "bob@a.com " + "y " * 500 + "10.0.0.1"
    assert [pii.base_spans(p)[0][0] for p in pii.places(text)] == [0, 1]
    many = spark.range(300).selectExpr("concat('call +1 555 ', 1000000 + id) AS text", "id AS doc_id")
    few = pii.train(many, max_places=20)  # a share of the windows by hash
    assert np.array_equal(few, pii.train(many.repartition(7), max_places=20)) and few.any()
    docs = spark.createDataFrame([(1, "key = 'a1b2c3d4e5f6a7b8'", 5, "z")] * 2, "doc_id long, text string, n_spans int, place string")
    assert [(r.n_secret, r.n_spans, r.spans) for r in pii.find(docs, pii.train(docs)).collect()] == [(1, 1, "secret:7:23")] * 2


# --- 7: repeated line runs


def lines_of_maximal_copies(rows, min_words):
    """By brute force over runs of every length: per row, the lines of later copies of runs that have min_words words."""
    seen, gone = {}, defaultdict(set)
    times = Counter(x for _, t in rows for x in (t or "").split("\n"))
    for k, (d, t) in sorted(enumerate(rows), key=lambda x: (x[1][0] is not None, x[1][0] or 0, x[0])):
        lines = [(i, x) for i, x in enumerate((t or "").split("\n")) if x.encode().split()]
        for at in range(len(lines)):
            for end in range(at + 1, len(lines) + 1):
                if times[lines[end - 1][1]] == 1:
                    break
                run = tuple(x for _, x in lines[at:end])
                if sum(len(x.encode().split()) for x in run) >= min_words:
                    first = seen.setdefault(run, (k, at))
                    if first != (k, at) and not (first[0] == k and at < first[1] + len(run)):
                        gone[k].update(i for i, _ in lines[at:end])
    return gone


def without_copies(rows, min_words=50):
    """By brute force: the rows (doc_id, text, lines deleted) that are left, and the deleted lines of each row."""
    gone = lines_of_maximal_copies(rows, min_words)
    out = []
    for k, (d, t) in enumerate(rows):
        kept = "\n".join(x for i, x in enumerate((t or "").split("\n")) if i not in gone[k])
        if not gone[k]:
            out.append((d, t, 0))
        elif kept.encode().split():
            out.append((d, kept, len(gone[k])))
    return Counter(out), gone


def test_op7(spark, sf_dir, rows):
    got = linededup.dedup_lines(spark.read.parquet(f"{sf_dir}/documents.parquet")).collect()
    want, gone = without_copies(rows)
    assert Counter((r.doc_id, r.text, r.n_removed) for r in got) == want and any(gone.values())


def test_op7_edges(spark, empty):
    line = lambda i, n: " ".join(f"w{i}_{j}" for j in range(n))
    a, b, c, d = line(1, 30), line(2, 30), line(3, 60), line(4, 9)
    data = [(5, f"{a}\n{b}\nown five"), (2, f"x\n{a}\n\n{b}\ny"), (3, f"{c}\n{c}\n{c}"), (4, c), (7, None), (8, ""), (9, f"{a}\nz"), (1, "\n".join([d] * 40)), (1, "\n".join([d] * 40)), (None, c)]
    docs = spark.createDataFrame([(i, t, 1, "k") for i, t in data], "doc_id long, text string, line int, rid string").coalesce(1)
    got = linededup.dedup_lines(docs).collect()
    assert Counter((r.doc_id, r.text, r.n_removed) for r in got) == without_copies(data)[0]
    assert {r.rid for r in got} == {"k"}
    assert linededup.dedup_lines(empty).count() == 0


def test_op7_deletes_whole_maximal_runs(spark, sf_dir, rows):
    line = lambda i, n: " ".join(f"w{i}_{j}" for j in range(n))
    tail, long = "\n".join([line(1, 30), line(2, 25), line(3, 10)]), f"{line(4, 60)}\n{line(5, 30)}"
    data = [(1, f"a\n{tail}\nb"), (2, f"c\n{tail}\nd"), (3, long), (4, f"e\n{long}\n{line(6, 3)}"), (5, f"{line(6, 3)}\n{long}")]
    gone = lines_of_maximal_copies(data, 50)
    assert gone == {1: {1, 2, 3}, 3: {1, 2}, 4: {1, 2}}
    draw = np.random.default_rng(7)
    pool = [line(10 + i, n) for i, n in enumerate([1, 2, 5, 9, 14, 20, 26, 33, 49, 50, 70])]
    passages = ["\n".join(pool[i] for i in draw.integers(0, len(pool), 12)) for _ in range(6)]
    for d in range(6, 66):
        cut = passages[draw.integers(0, 6)].split("\n")
        a, b = sorted(draw.integers(0, 13, 2))
        data.append((d, "\n".join([f"own {d}", *cut[a:b], "", pool[draw.integers(0, len(pool))], *cut[b:]])))
    for docs, data in ((spark.createDataFrame(data, "doc_id long, text string").coalesce(1), data), (spark.read.parquet(f"{sf_dir}/documents.parquet"), rows)):
        gone = lines_of_maximal_copies(data, 50)
        want = [(d, "\n".join(x for i, x in enumerate((t or "").split("\n")) if i not in gone[k]) if gone[k] else t, len(gone[k])) for k, (d, t) in enumerate(data)]
        got = linededup.dedup_lines(docs).collect()
        assert Counter((r.doc_id, r.text, r.n_removed) for r in got) == Counter(w for w in want if not w[2] or w[1].encode().split())


# --- the pipeline


def test_pipeline_stages(spark, sf_dir):
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet")
    docs = documents
    steps = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf_dir)
        steps[name] = (docs.collect(), out.collect())
        if name != "packing":
            assert out.columns == documents.columns and [t for _, t in out.dtypes] == [t for _, t in documents.dtypes]
            docs = spark.createDataFrame(out.collect(), documents.schema)
    before, after = steps["toxicity"]
    tagger = toxicity.train(documents, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scores = toxicity._scores(tagger, [r.text for r in before])[0]
    assert {r.doc_id for r in after} == {r.doc_id for r, s in zip(before, scores, strict=True) if s < 0.3}
    before, after = steps["line_dedup"]
    assert Counter((r.doc_id, r.text) for r in after) == Counter((d, t) for d, t, _ in without_copies([(r.doc_id, r.text) for r in before])[0].elements())
    assert all(r.n_chars == len(r.text) for r in after)
    before, after = steps["near_dedup"]
    want = classes([(r.doc_id, r.text) for r in before], 5, 4, 5)
    assert {r.doc_id for r in after} == {d for d, c in want.items() if c == d}
    before, after = steps["decontamination"]
    bench = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text").collect()]
    found, texts = hits([(r.doc_id, r.text) for r in before], bench), {r.doc_id: r.text for r in before}
    assert len(after) == len(before)
    for r in after:
        n_words, n_hit = found[r.doc_id][:2]
        assert (r.text == texts[r.doc_id]) if not n_hit else len(fmindex.words(r.text)) == n_words - n_hit
    before, after = steps["packing"]
    n = check_packing(after, encoded([(r.doc_id, r.text) for r in before], "byte_bpe_50k.json", 0))
    counts = Counter(r.length for r in after)
    bins, bound = packing.certificate(counts)
    assert bound <= n <= bins + 2


def test_run_chains_the_stages(spark, sf_dir):
    out = corpus_pipeline.run(spark, sf_dir)
    assert out.columns[:3] == ["doc_id", "piece", "start"] and out.agg(F.count("*")).first()[0] > 0
