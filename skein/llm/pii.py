"""Personal data as labelled spans from a semi-Markov conditional random field (operator 4).

Four kinds have an exact base: email, ip, card, phone. A semi-Markov field adds
spans of these and of a fifth kind, secret (keys, tokens, passwords). Candidates
are whole segments: every run of neighbouring digit groups up to MAX_GROUPS long,
every host of up to MAX_GROUPS labels after an at sign or its spelling, and every
unbroken run of letters and digits that mixes both or is assigned to a name. Each
is scored by features of the whole span and its surroundings; dynamic programming
over a text's candidates chooses boundaries and kinds together, so that the
chosen segments are disjoint and their summed score is the largest. Base spans
always stay and the added ones never overlap them.

The field is fitted by conditional likelihood on a bounded sample: at most
MAX_PLACES distinct windows of the table around possible spans, those with the
smallest hash. Their base spans are the positive segments, and all but the first
of every two are also shown in loose writing (an at sign spelled out, a missing
plus), so that features which only the base writing has don't carry all the
weight; other candidates are negative. GENERATED texts from a fixed seed join
them with spans of every base kind and, as secrets have no base, with secrets and
with segments that are none.

All scans take time linear in the text, whatever its runs of letters or digits.
Null texts count as empty; repeated rows are treated one by one; very long texts
are searched whole; an empty table gives an empty result; columns other than
doc_id and text are not read, so their names cannot clash.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterable
from math import log2

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop, lean, save, text_slices

KINDS = ("email", "ip", "card", "phone")
ALL_KINDS = (*KINDS, "secret")
MAX_PLACES, MAX_GROUPS, GENERATED = 8000, 6, 400
SLICE_BYTES = 4_000_000
Span = tuple[int, int, int]  # kind, start, end

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_HOST = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_DOTTED = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++)++")  # a run of digits is tried from its start only
_PART = re.compile(r"[0-9]+")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")


def luhn(digits: str) -> bool:
    odd, even = digits[-1::-2], digits[-2::-2]
    return (sum(map(int, odd)) + sum(sum(divmod(2 * int(d), 10)) for d in even)) % 10 == 0


def emails(text: str) -> Iterable[tuple[int, int]]:
    """The matches of the local part, an at sign and a dotted host, found from the at signs so that long runs cost nothing."""
    done, at = 0, text.find("@")
    while at >= 0:
        begin = at
        while begin > done and text[begin - 1] in _LOCAL:
            begin -= 1
        if begin < at and (m := _HOST.match(text, at + 1)):
            yield begin, m.end()
            done = m.end()
            at = text.find("@", done)
        else:
            at = text.find("@", at + 1)


def base_spans(text: str) -> list[Span]:
    """The exact spans of the four kinds, by start and then kind."""
    out = [(0, a, b) for a, b in emails(text)] if "@" in text else []
    if _DIGIT.search(text):
        if "." in text:
            for m in _DOTTED.finditer(text):
                parts = list(_PART.finditer(text, m.start(), m.end()))
                for i in range(0, len(parts) - 3, 4):
                    if all(len(p[0].lstrip("0")) <= 3 and int(p[0].lstrip("0") or 0) <= 255 for p in parts[i : i + 4]):
                        out.append((1, parts[i].start(), parts[i + 3].end()))
        for m in _CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19 and luhn(digits):
                out.append((2, m.start(), m.end()))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 9 <= len(_DIGIT.findall(m[0])) <= 15:
                    out.append((3, m.start(), m.end()))
    return sorted(out, key=lambda s: (s[1], s[0]))


_DOT = r"(?:\.| ?[\[({<] ?(?:\.|dot) ?[\])}>] ?| dot )"
_AT = re.compile(r"[\[({<] ?(?:at|@) ?[\])}>]|(?<= )at(?= )|@", re.I)
_LABELS = re.compile(rf"[A-Za-z0-9-]++(?:{_DOT}[A-Za-z0-9-]++){{1,{MAX_GROUPS}}}+", re.I)
_CHAIN = re.compile(r"[0-9]++(?:(?: ?[\[({](?:\.|dot)[\])}] ?|[ .-]?[()][ .-]?|[ ./-])[0-9]++)*+", re.I)
_MIXED = re.compile(r"(?<![A-Za-z0-9_+/~-])(?=[A-Za-z_+/~-]*+[0-9])[A-Za-z0-9_+/~-]{8,}+={0,2}")
_ASSIGNED = re.compile(r"(?:key|token|secret|passw(?:or)?d|pwd|credential|bearer)[\"']? ?(?:[:=]|\bis\b)[:=>]? ?[\"']?([^\s\"'<>,;]{6,})", re.I)
_OBSCURED = re.compile(r"[\[({<](?:at|dot|\.)[\])}>]", re.I)
_CONTEXT = (
    re.compile(r"(?:mail|contact|write|reach|address)\w*\W{0,4}(?:(?:is|to|at|me|us)\W{0,2}){0,2}$", re.I),
    re.compile(r"(?:ip|address|server|host|addr|from)\W{0,4}(?:(?:is|at)\W{0,2})?$", re.I),
    re.compile(r"(?:card|visa|mastercard|amex|payment|account)\w*\W{0,4}(?:(?:is|no|number|nr)\W{0,2}){0,2}$", re.I),
    re.compile(r"(?:phone|call|tel|fax|mobile|cell|contact|dial)\w*\W{0,4}(?:(?:is|me|us|at|on|number)\W{0,2}){0,2}$", re.I),
    re.compile(r"(?:key|token|secret|passw(?:or)?d|pwd|auth\w*|credential|bearer|api)\w*[\"']?\W{0,4}(?:is\W{0,2})?$", re.I),
)
_NAMED = re.compile(r"\w[\"']?\s{0,2}[:=]>?\s{0,2}[\"']?$")
#: How widely known keys begin.
_PREFIX = re.compile(r"(?:AKIA|ASIA|ghp_|gho_|github_pat_|glpat-|sk-|sk_live_|pk_live_|xox[abprs]-|AIza|eyJ)")


def _number_spans(text: str) -> Iterable[Span]:
    for chain in _CHAIN.finditer(text):
        parts = [m.span() for m in _PART.finditer(text, *chain.span())]
        for i, (begin, _) in enumerate(parts):
            digits = 0
            for j in range(i, min(i + MAX_GROUPS, len(parts))):
                size = parts[j][1] - parts[j][0]
                digits += size
                if digits > 19:
                    break
                a, b = begin, parts[j][1]
                if j == i + 3 and all(y - x <= 3 for x, y in parts[i : j + 1]):
                    yield 1, a, b
                if digits >= 12 and all(y - x >= 3 for x, y in parts[i : j + 1]):
                    yield 2, a, b
                if 7 <= digits <= 15 and all(2 <= y - x <= 8 for x, y in parts[i + 1 : j + 1]):
                    if text[a - 1 : a] == "(" and ")" in text[a:b]:
                        a -= 1
                    if text[a - 1 : a] == "+":
                        a -= 1
                    if j > i or text[a] == "+" or text.startswith("00", a):
                        yield 3, a, b


def _mail_spans(text: str) -> Iterable[Span]:
    for at in _AT.finditer(text):
        end = at.start() - (text[at.start() - 1 : at.start()] == " ")
        begin = end
        while begin and text[begin - 1] in _LOCAL:
            begin -= 1
        start = at.end() + (text[at.end() : at.end() + 1] == " ")
        if begin < end and (host := _LABELS.match(text, start)):
            ends = [m.end() for m in re.finditer(r"[A-Za-z0-9-]++", host[0]) if m[0].lower() != "dot" or not _spelled(host[0], m.start(), m.end())]
            for e in ends[1:MAX_GROUPS]:
                yield 0, begin, start + e


def _spelled(host: str, a: int, b: int) -> bool:
    """Whether the word dot stands for a dot here."""
    return host[a - 1 : a] in tuple(" [({<") and host[b : b + 1] in tuple(" ])}>")


def loose_spans(text: str) -> list[Span]:
    """Candidate segments beyond the base."""
    out: list[Span] = list(_mail_spans(text))
    if _DIGIT.search(text):
        out += _number_spans(text)
        for m in _MIXED.finditer(text):
            if not _ONE_KIND.fullmatch(m[0]):
                out.append((4, *m.span()))
    out += [(4, *m.span(1)) for m in _ASSIGNED.finditer(text)]
    return list(dict.fromkeys(out))


_ONE_KIND = re.compile(r"[0-9_+/~=-]++|[A-Za-z_+/~=-]++")
N_SPAN = 14
N_FEATURES = N_SPAN * len(ALL_KINDS)


def _number_features(kind: int, text: str, a: int, b: int) -> list[float]:
    body = text[a:b]
    groups = _PART.findall(body)
    number, sizes = "".join(groups), [len(g) for g in groups]
    marks = re.split(r"[0-9]+", body)[1:-1]
    even = len(set(marks)) <= 1
    joined = (text[a - 2 : a - 1].isdigit() and text[a - 1 : a] in tuple(" ./-")) + (text[b + 1 : b + 2].isdigit() and text[b] in tuple(" ./-"))
    if kind == 1:
        own = [all(int(g) <= 255 for g in groups), even, all(m.strip(" ") in (".", "[.]", "(.)", "{.}") or "dot" in m.lower() for m in marks), not any(g[0] == "0" and len(g) > 1 for g in groups), False]
    elif kind == 2:
        own = [luhn(number), even, len(sizes) == 1 or (set(sizes[:-1]) == {4} and sizes[-1] <= 4) or sizes in ([4, 6, 5], [4, 6, 4]), len(number) in (15, 16), number[0] in "23456"]
    else:
        own = [9 <= len(number) <= 15, even, sizes[-2:] == [3, 4], body[0] == "+" or body.startswith("00") or "(" in body, len(number) == 10 and number[0] in "23456789" and sizes[-1] == 4]
    return [len(number) / 10, float(joined), float(len(groups) == 1), float(bool(_OBSCURED.search(body))), *map(float, own)]


def _mail_features(text: str, a: int, b: int) -> list[float]:
    body = text[a:b]
    at = _AT.search(body)
    local, host = body[: at.start()].rstrip(" "), body[at.end() :]
    top = re.search(r"[A-Za-z0-9-]*$", host)[0]
    more = text[b : b + 1] == "." and text[b + 1 : b + 2].isalnum()
    return [
        float(top.isalpha() and 2 <= len(top) <= 6), float(at[0] == "@"), float(at[0].lower() == "at"), float(at[0][0] in "[({<"), float(" " in host or "[" in host or "(" in host),
        float(more or bool(re.match(r"(?: dot | ?[\[({<] ?(?:\.|dot))", text[b : b + 7], re.I))), float("." in host), float(1 < len(local) <= 40),
    ]


def _secret_features(text: str, a: int, b: int) -> list[float]:
    body = text[a:b]
    n = len(body)
    entropy = -sum(c / n * log2(c / n) for c in Counter(body).values())
    kinds = "".join("d" if c.isdigit() else "u" if c.isupper() else "l" if c.islower() else "o" for c in body)
    turns = sum(x != y for x, y in zip(kinds, kinds[1:], strict=False)) / n
    return [
        min(n, 60) / 20, entropy / 5, turns, float(n >= 16 and bool(re.fullmatch(r"[0-9a-fA-F]+", body))), float(n >= 16 and set(kinds) == {"u", "d"}), float(n >= 16 and {"u", "l", "d"} <= set(kinds)),
        float(bool(_PREFIX.match(body)) and n >= 16), float(bool(_NAMED.search(text[max(0, a - 8) : a]))), kinds.count("o") / n * 5,
    ]


def span_features(text: str, span: Span) -> np.ndarray:
    """Features of a whole segment, in its kind's block."""
    kind, a, b = span
    before, after = text[a - 1 : a] if a else "", text[b : b + 1]
    f = [
        1.0,
        float(bool(_CONTEXT[kind].search(text[max(0, a - 28) : a]))),
        float(not before.isalnum() and not after.isalnum() and before not in tuple("_%+-") or not before and not after.isalnum()),
        float(bool(before) and before in "\"'`" and after == before),
        0.0,
    ]
    own = _mail_features(text, a, b) if kind == 0 else _secret_features(text, a, b) if kind == 4 else _number_features(kind, text, a, b)
    f += own
    out = np.zeros(N_FEATURES)
    out[kind * N_SPAN : kind * N_SPAN + len(f)] = f
    return out


def lattice(spans: list[Span]) -> list[list[int]]:
    """Groups of candidates that overlap directly or through others, in order of their ends."""
    groups: list[list[int]] = []
    reach = -1
    for i in sorted(range(len(spans)), key=lambda i: (spans[i][1], spans[i][2])):
        if spans[i][1] >= reach:
            groups.append([])
        groups[-1].append(i)
        reach = max(reach, spans[i][2])
    return [sorted(g, key=lambda i: (spans[i][2], spans[i][1])) for g in groups]


def _before(spans: list[Span], group: list[int]) -> list[int]:
    """For each member the number of members that end before it starts."""
    return np.searchsorted([spans[i][2] for i in group], [spans[i][1] for i in group], side="right").tolist()


def segment_marginals(scores: np.ndarray, before: list[int]) -> np.ndarray:
    """Each segment's probability under the semi-Markov field; segments in order of their ends."""
    n = len(scores)
    alpha = np.zeros(n + 1)
    for k in range(n):
        alpha[k + 1] = np.logaddexp(alpha[k], alpha[before[k]] + scores[k])
    beta = np.full(n + 1, -np.inf)
    beta[n] = 0
    for k in range(n - 1, -1, -1):
        beta[k] = np.logaddexp(beta[k], beta[k + 1])
        beta[before[k]] = np.logaddexp(beta[before[k]], scores[k] + beta[k + 1])
    return np.array([np.exp(alpha[before[k]] + scores[k] + beta[k + 1] - alpha[n]) for k in range(n)])


def best_segments(scores: list[float], before: list[int]) -> list[int]:
    """The disjoint segments of largest total score (bounded-entity Viterbi)."""
    best = [0.0]
    for s, b in zip(scores, before, strict=True):
        best.append(max(best[-1], best[b] + s))
    out, k = [], len(scores)
    while k:
        if best[k] == best[k - 1]:
            k -= 1
        else:
            out.append(k - 1)
            k = before[k - 1]
    return out[::-1]


def _loosened(text: str, span: Span, style: int) -> str:
    """The span as people write it to be read but not found."""
    kind, a, b = span
    body = text[a:b]
    if kind == 0:
        at = (" [at] ", "(at)", " at ", " @ ")[style % 4]
        dot = (".", "(dot)", " dot ", ".", "[.]")[style % 5] if style % 4 != 2 else " dot "
        local, host = body.split("@", 1)
        return local + at + host.replace(".", dot)
    digits = "".join(_DIGIT.findall(body))
    if kind == 3:
        if style % 2:
            n = digits[-10:]
            return (f"({n[:3]}) {n[3:6]}-{n[6:]}", f"{n[:3]}-{n[3:6]}-{n[6:]}", f"{n[:3]}.{n[3:6]}.{n[6:]}", f"{n[:3]} {n[3:6]} {n[6:]}")[style // 2 % 4]
        return "00" + body.lstrip("+")
    if kind == 1:
        return body.replace(".", ("[.]", "(.)", "[dot]", " dot ")[style % 3])
    return (" ", "-", ".", "/")[style % 4].join(digits[i : i + 4] for i in range(0, len(digits), 4))


def written(n: int = GENERATED) -> list[str]:
    """Texts that each hold one span of every base kind, from a fixed seed, so that a table without a kind doesn't leave its weights unset."""
    rng = np.random.default_rng(5)
    low, digits = list("abcdefghijklmnopqrstuvwxyz"), list("0123456789")
    pick = lambda letters, lo, hi: "".join(rng.choice(letters, int(rng.integers(lo, hi))))
    out = []
    for k in range(n):
        local = (pick(low, 2, 10), f"{pick(low, 2, 8)}.{pick(low, 2, 8)}", f"{pick(low, 2, 8)}{pick(digits, 1, 4)}", f"{pick(low, 2, 6)}_{pick(low, 2, 6)}")[k % 4]
        host = pick(low, 3, 10) + ("", f"-{pick(low, 2, 6)}", f".{pick(low, 2, 8)}")[k % 3] + "." + ("com", "org", "net", "de", "info", "co.uk")[k % 6]
        ip = ".".join(str(x) for x in rng.integers(1, 256, 4))
        card = "4" + pick(digits, 14, 15)
        card += next(c for c in "0123456789" if luhn(card + c))
        n10 = str(rng.integers(2, 10)) + pick(digits, 9, 10)
        phone = (f"+1 ({n10[:3]}) {n10[3:6]}-{n10[6:]}", f"+44 {n10[:2]} {n10[2:6]} {n10[6:]}", f"+49 {n10[:3]} {n10[3:]}", f"+1-{n10[:3]}-{n10[3:6]}-{n10[6:]}", f"+33 {n10[0]} {n10[1:3]} {n10[3:5]} {n10[5:7]} {n10[7:9]}")[k % 5]
        a, b, c, d = (("mail", "from", "card", "call"), (pick(low, 2, 8), pick(low, 2, 8), pick(low, 2, 8), pick(low, 2, 8)))[k % 2]
        out.append(f"{pick(low, 2, 8)} {a} {local}@{host} {b} {ip} {pick(low, 2, 8)} {c} {card} {pick(low, 2, 8)} {d} {phone} {pick(low, 2, 8)}")
    return out


def generated(n: int = GENERATED) -> list[tuple[str, list[tuple[int, str]]]]:
    """Texts with the (kind, body) of all segments in them that are right: secrets, which have no base, and numbers, names and paths that are none."""
    rng = np.random.default_rng(4)
    pick = lambda letters, size: "".join(rng.choice(list(letters), size))
    hexes, low, up, digits = "0123456789abcdef", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
    word = lambda: pick(low, int(rng.integers(2, 10)))
    names = ("token", "password", "secret", "api_key", "key", "passwd", "access_token", "client_secret", "pwd", "auth")
    links = (" = ", "=", ": ", ":", " is ", '="', ' = "', "='")
    out = []
    for k in range(n):
        size = int(rng.integers(16, 48))
        body = (pick(hexes, size), pick(low + up + digits, size), pick(hexes, 16 + 8 * (k % 4)).upper(), "AKIA" + pick(up + digits, 16), "ghp_" + pick(low + up + digits, 36), pick(low + up + digits + "+/", size), pick(low + digits, 10 + k % 8))[k % 7]
        link = links[k // 7 % len(links)]
        close = link[-1] if link[-1] in "\"'" else ""
        name = names[k // 3 % len(names)]
        bare = k % 7 in (1, 3, 4) and k % 2 and any(c in body for c in digits)
        text = f"{word()} {word()} {body} {word()}" if bare else f"{word()} {word()} {name.upper() if k % 5 == 0 else name}{link}{body}{close} {word()}"
        out.append((text, [(4, body)]))
        x = pick(digits, 16)
        wrong = (
            f"no {x[:4]} {x[4:8]} {x[8:12]} {x[12:]} a {300 + k}[.]{400 + k}[.]{x[:3]}[.]{x[3:6]} b 1{x[:2]}-{x[2:5]}-{x[5:9]} c",
            f"{word()} {word()}{x[:2]}_{word()}-{x[2:4]} {word()}/{word()}{x[:1]}/{word()} v{x[0]}.{x[1]}.{x[2]}-{word()}{x[3]}",
            f"on 20{x[:2]}-0{x[2]}-1{x[3]} {word()} 20{x[:2]}/0{x[2]}/1{x[3]} at {x[4]}.{x[5]}{x[6]} {x[7:9]}.{x[9:12]} or {x[:7]} {word()}",
            f"{word()} {pick(low, 14)}{x[0]} {pick(low, 3)}{x[:3]}{pick(low, 9)} the key is {word()} and token {pick(low, 5)}",
            f"look at this dot {word()} and at {word()}. {word()} {word()} at {word()}.{word()} {word()}",
            f"isbn {x[:3]}-{x[3]}-{x[4:8]}-{x[8:12]}-{x[12]} pages {x[:3]}-{x[3:6]} {x[:2]} {x[2:4]} {x[4:6]} {x[6:8]} {x[8:10]}",
        )[k % 6]
        right = [(2, wrong[s[1] : s[2]]) for s in loose_spans(wrong) if s[0] == 2 and k % 6 == 0 and s[2] - s[1] == 19 and luhn("".join(_DIGIT.findall(wrong[s[1] : s[2]])))]
        out.append((wrong, right))
    return out


class _Groups:
    """Overlap groups of one size, for forward-backward over all of them at once."""

    def __init__(self, members: list[tuple[np.ndarray, list[int], np.ndarray]]):
        self.x = np.stack([m[0] for m in members])
        self.before = np.array([m[1] for m in members])
        self.y = np.stack([m[2] for m in members])

    def gradient(self, w: np.ndarray) -> np.ndarray:
        return np.einsum("gnf,gn->f", self.x, self.y - segment_marginals_of(self.x @ w, self.before))


def segment_marginals_of(scores: np.ndarray, before: np.ndarray) -> np.ndarray:
    """segment_marginals() of many groups of one size."""
    g, n = scores.shape
    row = np.arange(g)
    alpha, beta = np.zeros((g, n + 1)), np.full((g, n + 1), -np.inf)
    beta[:, n] = 0
    for k in range(n):
        alpha[:, k + 1] = np.logaddexp(alpha[:, k], alpha[row, before[:, k]] + scores[:, k])
    for k in range(n - 1, -1, -1):
        beta[:, k] = np.logaddexp(beta[:, k], beta[:, k + 1])
        at = before[:, k]
        beta[row, at] = np.logaddexp(beta[row, at], scores[:, k] + beta[:, k + 1])
    return np.exp(np.stack([alpha[row, before[:, k]] + scores[:, k] + beta[:, k + 1] for k in range(n)], axis=1) - alpha[:, n:])


def fit(texts: list[str | None], steps: int = 300) -> np.ndarray:
    """Feature weights by gradient ascent on the conditional likelihood of the base segments and of generated ones."""
    sized: dict[int, list[tuple[np.ndarray, list[int], np.ndarray]]] = defaultdict(list)

    def learn(text: str, truth: set[Span], known: tuple[int, ...] = (0, 1, 2, 3)) -> None:
        spans = [s for s in dict.fromkeys([*sorted(truth), *loose_spans(text)]) if s[0] in known]
        for g in lattice(spans):
            own = [spans[i] for i in g]
            y = np.array([float(s in truth) for s in own])
            right = sorted(s[1:] for s, p in zip(own, y, strict=True) if p)
            if any(b > c for (_, b), (c, _) in zip(right, right[1:], strict=False)):
                continue  # the base has overlapping kinds here
            sized[len(g)].append((np.stack([span_features(text, s) for s in own]), _before(spans, g), y))

    styles: Counter[int] = Counter()
    for text in [*texts, *written()]:
        if not text:
            continue
        base = base_spans(text)
        learn(text, set(base))
        for span in base:
            styles[span[0]] += 1
            if styles[span[0]] % 2 == 0:
                body = _loosened(text, span, styles[span[0]] // 2)
                left = text[max(0, span[1] - 28) : span[1]]
                short = left + body + text[span[2] : span[2] + 20]
                want = (span[0], len(left), len(left) + len(body))
                if want in loose_spans(short):
                    learn(short, {want})
    for text, right in generated():
        learn(text, {(k, text.index(body), text.index(body) + len(body)) for k, body in right}, known=(0, 1, 2, 3, 4))
    parts = [_Groups(m) for m in sized.values()]
    total = sum(len(m) for m in sized.values())
    w, first, second = np.zeros(N_FEATURES), np.zeros(N_FEATURES), np.zeros(N_FEATURES)
    for step in range(1, steps + 1):
        g = (sum(p.gradient(w) for p in parts) - 0.05 * w) / total
        first, second = 0.9 * first + 0.1 * g, 0.999 * second + 0.001 * g * g
        w = w + 0.1 * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-9)
    return w


def added_spans(text: str, base: list[Span], weights: np.ndarray) -> list[Span]:
    """Segments that the field adds to the base ones."""
    taken = np.array([s[1:] for s in sorted(base, key=lambda s: s[1])]).reshape(-1, 2)
    reach = np.maximum.accumulate(taken[:, 1]) if len(taken) else taken[:, 1]
    spans = []
    for s in loose_spans(text):
        k = int(np.searchsorted(taken[:, 0], s[2]))  # base spans that begin before its end
        if not k or reach[k - 1] <= s[1]:
            spans.append(s)
    out = []
    for g in lattice(spans):
        scores = [float(span_features(text, spans[i]) @ weights) for i in g]
        out += [spans[g[k]] for k in best_segments(scores, _before(spans, g))]
    return out


def write(spans: list[Span]) -> str:
    return ",".join(f"{ALL_KINDS[k]}:{a}:{b}" for k, a, b in sorted(spans, key=lambda s: (s[1], s[0])))


_PLACE = re.compile(r"@|\+[0-9]|[0-9]{4}|[0-9]\.[0-9]")


def places(text: str, width: int = 80) -> Iterable[str]:
    """Windows around possible spans, cut at white space; together at most twice the text."""
    done, m = 0, _PLACE.search(text)
    while m:
        begin, end = max(0, m.start() - width), min(len(text), m.end() + width)
        own = text[begin:end]
        if begin and " " in own[:20]:
            own = own[own.index(" ") :]
        if end < len(text) and " " in own[-20:]:
            own = own[: own.rindex(" ")]
        yield own
        done = end
        m = _PLACE.search(text, done)


def train(docs: DataFrame, max_places: int = MAX_PLACES) -> np.ndarray:
    """Fit on at most max_places distinct windows around an at sign, a plus or digits, those with the smallest hash."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for _, own in text_slices(batch, 0, SLICE_BYTES):
                yield pa.RecordBatch.from_arrays([pa.array([p for t in own if t for p in places(t)], pa.string())], names=["place"])

    text = docs.select(F.col("text").cast("string").alias("text")).where("text rlike '@|[+][0-9]|[0-9]{4}|[0-9][.][0-9]'")
    found = save(text.mapInArrow(lean(run), "place string").distinct().withColumn("h", F.xxhash64("place")), "places")
    n, some = found.count(), found
    if n > 2 * max_places:  # hashes are even, so that this leaves about 1.5 times the rows wanted, whatever the table's size
        some = found.where(F.col("h") < int(2**64 * (1.5 * max_places / n)) - 2**63)
    rows = some.orderBy("h", "place").limit(max_places).collect()
    drop(found)
    return fit([r["place"] for r in rows])


def find(docs: DataFrame, weights: np.ndarray) -> DataFrame:
    """Per document: doc_id, a count per kind of the base, the number of secrets and of all spans, base (written spans) and spans (base and added)."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for start, own in text_slices(batch, 1, SLICE_BYTES):
                rows = []
                for text in own:
                    base = base_spans(text) if text else []
                    extra = added_spans(text, base, weights) if text else []
                    counts = [sum(k == j for k, _, _ in base) for j in range(4)]
                    rows.append((*counts, sum(k == 4 for k, _, _ in extra), len(base) + len(extra), write(base), write(base + extra)))
                cols = list(zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(start, len(own))] + [pa.array(c, pa.int64()) for c in cols[:6]] + [pa.array(c, pa.string()) for c in cols[6:]], names=names)

    names = ["doc_id", *(f"n_{k}" for k in ALL_KINDS), "n_spans", "base", "spans"]
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(lean(run), ", ".join(f"{n} {'string' if n in ('base', 'spans') else 'long'}" for n in names))
