"""Tokenising with the tokenizers library, one call for each distinct piece of text between single spaces.

Two kinds of vocabulary split a text before merging so that a single space
between two non-space characters is always a boundary: the space belongs to what
follows it (byte level) or to nothing (words of one case). So a piece's ids don't
depend on its neighbours, and a worker keeps the ids of pieces that it has met.
Arrow cuts a slice of texts and finds its distinct pieces, and their ids are put
back by position, so Python handles a piece once a slice. A new piece of plain
Latin text is cut into words by the vocabulary's own pattern and each new word
goes to the library's merging model; any other piece goes through the library's
whole chain. Which kind a file is, is read from the file;
with a file of any other kind whole texts go to the library.
"""

from __future__ import annotations

import gc
import json
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .common import keeps

_TWO_SPACES = re.compile(r"\s\s")
_SPLIT = re.compile(r"(?<=\S) (?=\S)")
#: Where every library agrees on what is a letter, a digit or a space, and a lower-case form is one per character.
_PLAIN = re.compile(r"[\n\t\r\x20-\x7e\xa1\xa7\xab\xb0\xbb\xbf-\xff]*")
_LETTER, _DIGIT, _OTHER = r"[^\W\d_]", r"[0-9\xb2\xb3\xb9\xbc-\xbe]", r"(?:(?!\s|[^\W\d_]|[0-9\xb2\xb3\xb9\xbc-\xbe]).)"
#: The two vocabularies' patterns for words.
_BYTE_WORDS = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?{_LETTER}+| ?{_DIGIT}+| ?{_OTHER}+|\s+(?!\S)|\s+")
_LOWER_WORDS = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|{_LETTER}+|{_DIGIT}|{_OTHER}+")

#: A piece that is one word of Latin-1 letters and at most one of the marks, which every pattern above cuts off.
_MARKS, _EASY = ",.!?;:", r"^ ?[A-Za-z\x{c0}-\x{d6}\x{d8}-\x{f6}\x{f8}-\x{ff}]+[,.!?;:]?\z"
_MARK_PLACE = np.array([_MARKS.find(chr(b)) + 1 for b in range(256)], dtype=np.int64)


def _byte_letters() -> dict[int, str]:
    """Byte-level vocabularies write a byte as itself if it is printable in Latin-1, else as the next free code point from 256."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}


_BYTE_LETTERS = _byte_letters()
#: How a file of each kind describes its normalizer and pre-tokenizer.
_BYTE_CHAIN = (None, {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True})
_LOWER_CHAIN = (
    {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]},
    {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
)


def kind_of(path: str) -> str | None:
    """`byte`, `lower` or None, from what the file says of its chain, its model and its added tokens."""
    with open(path, encoding="utf-8") as f:
        d = json.load(f)
    model, tokens = d["model"], d.get("added_tokens") or []
    plain = model["type"] == "BPE" and not any(model.get(k) for k in ("dropout", "byte_fallback", "ignore_merges", "continuing_subword_prefix", "fuse_unk"))
    plain = plain and not d.get("truncation") and not d.get("padding")
    # added tokens are found by their first letters, inside one piece
    if not plain or any(not t["content"].startswith("<|") or " " in t["content"] or t["single_word"] or t["lstrip"] or t["rstrip"] for t in tokens):
        return None
    return {str(_BYTE_CHAIN): "byte", str(_LOWER_CHAIN): "lower"}.get(str((d.get("normalizer"), d.get("pre_tokenizer"))))


class PieceEncoder:
    """encode(texts) gives each text's ids as little-endian unsigned 32-bit integers."""

    #: Words and other pieces kept in each of two generations, and the longest that is kept.
    WORDS, PIECES, LONGEST = 350_000, 100_000, 64

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.kind = kind_of(path)
        self.spaces_count = self.kind == "byte"
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.words: dict[str, bytes] = {}
        self.old_words: dict[str, bytes] = {}
        self.merge = self.tokenizer.model.tokenize
        self.ids = [i.to_bytes(4, "little") for i in range(self.tokenizer.get_vocab_size())]

    def split(self, texts: list[str]):
        """(which, pieces, starts): the pieces of all texts in the order `which`, and where each text's begin; the space before a piece is left out."""
        plain, odd = list(range(len(texts))), []
        if self.spaces_count:
            odd = [i for i, t in enumerate(texts) if t[:1].isspace() or t[-1:].isspace() or _TWO_SPACES.search(t)]
            kept = set(odd)
            plain = [i for i in plain if i not in kept]
        cut = pc.split_pattern(pa.array([texts[i] for i in plain], pa.large_string()), " ")
        parts = [_SPLIT.split(texts[i]) for i in odd]
        pieces = pa.concat_arrays([cut.flatten(), pa.array([p for some in parts for p in some], pa.large_string())])
        counts = np.concatenate([pc.list_value_length(cut).to_numpy(zero_copy_only=False), [len(some) for some in parts]]).astype(np.int64)
        return plain + odd, pieces, np.cumsum(counts) - counts

    def word(self, word: str) -> bytes:
        """Ids of one word of the vocabulary's pattern."""
        v = self.words.get(word)
        if v is None:
            v = self.old_words.get(word)
            if v is None:
                if word.isascii() and word[1:].isalpha():
                    letters = "\u0120" + word[1:] if word[0] == " " else word
                else:
                    letters = word.encode().decode("latin-1").translate(_BYTE_LETTERS)
                ids = self.ids
                v = b"".join([ids[t.id] for t in self.merge(letters)])
            if len(word) <= self.LONGEST:
                if len(self.words) >= self.WORDS:
                    self.old_words, self.words = self.words, {}
                self.words[word] = v
        return v

    def learn(self, wanted: list[str]) -> list[bytes]:
        """Ids of pieces that no cache holds."""
        out, whole = [], []
        spaces, encode = self.spaces_count, self.word
        pattern, plain, marks = _BYTE_WORDS if spaces else _LOWER_WORDS, _PLAIN.fullmatch, {c: encode(c) for c in ",.!?;:"}
        for piece in wanted:
            # the common case: letters, then at most one mark
            tail = marks.get(piece[-1:])
            word = piece[:-1] if tail else piece
            if (word[1:] if spaces and word[:1] == " " else word).isalpha() and (word.isascii() or plain(word)):
                v = encode(word if spaces else word.lower())
                out.append(v + tail if tail else v)
            elif "<|" in piece or not plain(piece):
                whole.append(len(out))
                out.append(b"")
            else:
                out.append(b"".join([encode(w) for w in pattern.findall(piece if spaces else piece.lower())]))
        if whole:
            for i, e in zip(whole, self.tokenizer.encode_batch_fast([wanted[i] for i in whole], add_special_tokens=False), strict=True):
                out[i] = b"".join([self.ids[t] for t in e.ids])
        return out

    def encode(self, texts: list[str]) -> list[bytes]:
        """Each text's ids; the cycle collector rests meanwhile, as nothing here makes cycles."""
        if self.kind is None:
            return [b"".join([self.ids[i] for i in e.ids]) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        if not texts:
            return []
        gc.disable()
        try:
            return self._encode(texts)
        finally:
            gc.enable()

    def _words(self, words: list[str]) -> list[bytes]:
        """Ids of distinct words, from the caches or merged."""
        values = list(map(self.words.get, words))
        for i in [i for i, v in enumerate(values) if v is None]:
            values[i] = self.word(words[i])
        return values

    def _pieces(self, pieces: list[str]) -> list[bytes]:
        """Ids of distinct pieces, from the caches or learnt."""
        young, old = self.young, self.old
        values = list(map(young.get, pieces))
        fresh = []
        for i in [i for i, v in enumerate(values) if v is None]:
            piece = pieces[i]
            v = old.get(piece)
            if v is None:
                fresh.append(i)
            else:
                values[i] = young[piece] = v
        for i, v in zip(fresh, self.learn([pieces[i] for i in fresh]), strict=True):
            values[i] = v
            if len(pieces[i]) <= self.LONGEST:
                young[pieces[i]] = v
        if len(young) > self.PIECES:
            self.old, self.young = young, {}
        return values

    def _values(self, pieces):
        """(ids, place): ids of distinct pieces in an order of their own, and each piece's place there."""
        easy = pc.match_substring_regex(pieces, _EASY)
        flags = easy.to_numpy(zero_copy_only=False)
        # letters, then at most one mark: the words, and the marks' ids behind them
        simple = pieces.filter(easy)
        found = pa.array([], pa.large_binary())
        if len(simple):
            _, ends, letters = simple.buffers()
            last = np.frombuffer(letters, dtype=np.uint8)[np.frombuffer(ends, dtype=np.int64)[1 : len(simple) + 1] - 1]
            tail = pa.array([b"", *(self.word(c) for c in _MARKS)], pa.large_binary()).take(pa.array(_MARK_PLACE[last]))
            words = pc.utf8_rtrim(simple, characters=_MARKS)
            words = (words if self.spaces_count else pc.utf8_lower(words)).dictionary_encode()
            ids = pa.array(self._words(words.dictionary.to_pylist()), pa.large_binary()).take(words.indices)
            found = pc.binary_join_element_wise(ids, tail, pa.scalar(b"", pa.large_binary()))
        rest = pa.array(self._pieces(pieces.filter(pc.invert(easy)).to_pylist()), pa.large_binary())
        place = np.empty(len(pieces), dtype=np.int64)
        place[flags], place[~flags] = np.arange(len(found)), np.arange(len(found), len(pieces))
        return pa.concat_arrays([found, rest]), place

    def _encode(self, texts: list[str]) -> list[bytes]:
        which, pieces, starts = self.split(texts)
        coded = pieces.dictionary_encode()
        codes, distinct = coded.indices.to_numpy(), coded.dictionary
        if self.spaces_count:
            # a text's first piece has no space before it
            first, codes = pieces.take(pa.array(starts)).dictionary_encode(), codes.copy()
            codes[starts] = first.indices.to_numpy() + len(distinct)
            spaced = pc.binary_join_element_wise(pa.scalar(" ", pa.large_string()), distinct, pa.scalar("", pa.large_string()))
            distinct = pa.concat_arrays([spaced, first.dictionary])
        values, place = self._values(distinct)
        found = values.take(pa.array(place[codes]))
        _, ends, ids = found.buffers()
        ends, ids = np.frombuffer(ends, dtype=np.int64), memoryview(ids or b"")
        cuts = ends[np.append(starts, len(codes))].tolist()
        out = [b""] * len(texts)
        for i, a, b in zip(which, cuts, cuts[1:], strict=False):
            out[i] = bytes(ids[a:b])
        return out


_encoders: dict[str, PieceEncoder] = {}


def encoder(path: str) -> PieceEncoder:
    """This worker's encoder for a vocabulary file."""
    if path not in _encoders:
        keeps("tokens", _encoders.clear)
        _encoders[path] = PieceEncoder(path)
    return _encoders[path]


def slices(rows: list, budget: int = 4_000_000):
    """Cut a list of (key, text) rows where the texts reach the budget in characters."""
    start = size = 0
    for i, row in enumerate(rows):
        size += len(row[1])
        if size >= budget:
            yield rows[start : i + 1]
            start, size = i + 1, 0
    if start < len(rows):
        yield rows[start:]
