"""Byte-pair encoding and decoding, exact and in linear time.

The tokenizer file's normalizer and pre-tokenizer cut a text into words; a word's
bytes, with a mark for the word's end, are encoded by backtracking: one pass of
an Aho-Corasick automaton over the word notes the longest token that starts at each
place. The encoder goes on with the longest token that is compatible with the token
before it, takes the next shorter one otherwise, and steps back where none is
left. Two neighbours are compatible if merging would not have joined anything
across their border: a chain of pairwise compatible tokens is what merging in
order of rank gives, and there is one such chain. Places found dead are never tried
again, so the work is linear. Words that a task met lately are looked up; the rest of
the work on a text (normal form, lower case, cutting) is done on the whole of it.

Decoding gathers from one string of all tokens by a table of offsets.

Defined results: a null text is empty and an empty text has no tokens; texts that
repeat are encoded each; there is no limit on length; an empty table gives an empty
result; further columns pass through, and a column that has an output's name is
replaced by it.
"""

from __future__ import annotations

import json
import re
import unicodedata
from array import array
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from noticeflow.llm.common import arrow_columns, sliced, small_batches, with_fields

# Where the tokenizer's character tables and those of Unicode 15.1 differ. Its letters and numbers are those of
# Unicode 16, its lower case is that of 17, and its combining classes are those of an older version, in which these
# characters are no marks and the last one composes with none.
LETTERS = (
    (0x1C89, 0x1C8A), (0xA7CB, 0xA7CD), (0xA7DA, 0xA7DC), (0x105C0, 0x105F3), (0x10D4A, 0x10D65), (0x10D6F, 0x10D85), (0x10EC2, 0x10EC4), (0x11380, 0x11389),
    (0x1138B, 0x1138B), (0x1138E, 0x1138E), (0x11390, 0x113B5), (0x113B7, 0x113B7), (0x113D1, 0x113D1), (0x113D3, 0x113D3), (0x11BC0, 0x11BE0),
    (0x13460, 0x143FA), (0x16100, 0x1611D), (0x16D40, 0x16D6C), (0x18CFF, 0x18CFF), (0x1E5D0, 0x1E5ED), (0x1E5F0, 0x1E5F0),
)
NUMBERS = ((0x10D40, 0x10D49), (0x116D0, 0x116E3), (0x11BF0, 0x11BF9), (0x16130, 0x16139), (0x16D70, 0x16D79), (0x1CCF0, 0x1CCF9), (0x1E5F1, 0x1E5FA))
LOWERED = {
    0x1C89: 0x1C8A, 0xA7CB: 0x264, 0xA7CC: 0xA7CD, 0xA7CE: 0xA7CF, 0xA7D2: 0xA7D3, 0xA7D4: 0xA7D5, 0xA7DA: 0xA7DB, 0xA7DC: 0x19B,
    **{c: c + 0x20 for c in range(0x10D50, 0x10D66)}, **{c: c + 0x1B for c in range(0x16EA0, 0x16EB9)},
}
NO_MARKS = (
    (0x7FD, 0x7FD), (0x898, 0x89F), (0x8CA, 0x8D3), (0x9FE, 0x9FE), (0xC3C, 0xC3C), (0xD3B, 0xD3C), (0xEBA, 0xEBA), (0x1715, 0x1715), (0x1ABF, 0x1ACE),
    (0x1DF6, 0x1DFA), (0xA82C, 0xA82C), (0x10D24, 0x10D27), (0x10EAB, 0x10EAC), (0x10EFD, 0x10EFF), (0x10F46, 0x10F50), (0x10F82, 0x10F85), (0x11070, 0x11070),
    (0x1133B, 0x1133B), (0x1145E, 0x1145E), (0x11839, 0x1183A), (0x1193D, 0x1193E), (0x11943, 0x11943), (0x119E0, 0x119E0), (0x11A34, 0x11A34),
    (0x11A47, 0x11A47), (0x11A99, 0x11A99), (0x11D42, 0x11D42), (0x11D44, 0x11D45), (0x11D97, 0x11D97), (0x11F41, 0x11F42), (0x16FF0, 0x16FF1),
    (0x1E08F, 0x1E08F), (0x1E130, 0x1E136), (0x1E2AE, 0x1E2AE), (0x1E2EC, 0x1E2EF), (0x1E4EC, 0x1E4EF), (0x11930, 0x11930),
)
#: The tokenizer's white space; Python's has 0x1C to 0x1F as well.
SPACES = ((0x09, 0x0D), (0x20, 0x20), (0x85, 0x85), (0xA0, 0xA0), (0x1680, 0x1680), (0x2000, 0x200A), (0x2028, 0x2029), (0x202F, 0x202F), (0x205F, 0x205F), (0x3000, 0x3000))
#: Encoded words that a worker keeps in a young and in an old table each, and pairs known to be compatible or not.
MAX_CACHED = 200_000
#: Characters of the basic plane that stand for those beyond it while a text is cut, by kind: a class with characters of other planes is slow.
STAND_INS = {"L": "\ua000", "N": "\u2460"}
OTHER_STAND_IN = "\ue000"


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte: itself if it is visible Latin-1, else the next one from 256 on."""
    visible = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in set(visible) else chr(next(spare)) for b in range(256)]


def _listed(ranges) -> str:
    """Ranges of code points as the inside of a character class."""
    return "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in ranges)


MORE = {c: name for name, ranges in (("L", LETTERS), ("N", NUMBERS)) for a, b in ranges for c in range(a, b + 1)}


def kind(c: int) -> str:
    """The first letter of a code point's category, as the tokenizer has it."""
    return MORE.get(c) or unicodedata.category(chr(c))[0]


def _ranges(chars: set[int]):
    return zip(sorted(c for c in chars if c - 1 not in chars), sorted(c for c in chars if c + 1 not in chars), strict=True)


def pinned(pattern: str) -> str:
    """The pattern, for texts of the basic plane, with the tokenizer's letters, numbers and white space listed, whatever a module's tables know."""
    kinds = [kind(c) for c in range(0x10000)]
    listed = {r"\s": _listed(SPACES)}
    for name in "LN":
        listed[rf"\p{{{name}}}"] = _listed(_ranges({c for c, k in enumerate(kinds) if k == name}))
    out, inside = [], False
    for part in re.findall(r"\\[pP]\{\w+\}|\\.|.", pattern, re.DOTALL):
        if part in listed:
            out.append(listed[part] if inside else f"[{listed[part]}]")
        elif part[0] == "\\" and part[1] in "pPSwWdDbB":
            raise ValueError(f"this encoder does not know {part} in a pattern")
        else:
            inside = part == "[" or inside and part != "]"
            out.append(part)
    return "".join(out)


def read_spec(path: str) -> dict:
    """What the encoder needs of a tokenizer file; about the size of the vocabulary. Raises if it asks for other rules."""
    with open(path, encoding="utf-8") as f:
        raw = json.load(f)
    model = raw["model"]
    steps = [n["type"] for n in (raw.get("normalizer") or {}).get("normalizers", [])]
    split, level = raw["pre_tokenizer"]["pretokenizers"]
    if steps != ["NFC", "Replace", "Lowercase"] or split["type"] != "Split" or level["type"] != "ByteLevel":
        raise ValueError("this encoder knows NFC, white space to one space, lower case, a split by pattern and byte level")
    if model["type"] != "BPE" or not model.get("end_of_word_suffix") or raw.get("decoder"):
        raise ValueError("this encoder knows BPE with a word-end suffix and no decoder")
    if any(t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"] for t in raw["added_tokens"]):
        raise ValueError("added tokens have to match raw text exactly")
    vocab, suffix = model["vocab"], model["end_of_word_suffix"]
    tokens = [""] * (1 + max([*vocab.values(), *[t["id"] for t in raw["added_tokens"]]]))
    for t, i in vocab.items():
        tokens[i] = t
    merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
    # few large objects, so that each worker's copy is small: tokens in order of id, merges as (left, right, result)
    triples = np.array([(vocab[a], vocab[b], vocab[a + b]) for a, b in merges], np.int32).reshape(-1, 3)
    return {
        "tokens": "\0".join(tokens), "merges": triples, "suffix": suffix, "pattern": pinned(split["pattern"]["Regex"]),
        "added": {t["content"]: t["id"] for t in raw["added_tokens"]},
    }


def tokens_of(spec: dict) -> list[str]:
    """Token by id; ids of added tokens, and ids that are not used, are empty here."""
    return spec["tokens"].split("\0")


class Lately(dict):
    """What ``make`` gave by word. A full table becomes the old one, so what is used often stays."""

    def __init__(self, make):
        super().__init__()
        self.make, self.old = make, {}

    def __missing__(self, word: str) -> bytes:
        got = self.old.get(word)
        if got is None:
            got = self.make(word)
        if len(self) >= MAX_CACHED:
            self.old = self.copy()
            self.clear()
        if len(word) < 100:
            self[word] = got
        return got


class Encoder:
    """Tables of one tokenizer: automaton, merges, pair compatibility and offsets."""

    END = "\n"  # the word's end; never a letter of the byte alphabet

    def __init__(self, spec: dict):
        import ahocorasick

        suffix, self.added_ids = spec["suffix"], spec["added"]
        tokens = tokens_of(spec)
        inner = lambda t: t[: -len(suffix)] + self.END if t.endswith(suffix) and t != suffix else t
        self.alphabet = dict(enumerate(byte_alphabet()))
        self.ids = {inner(t): i for i, t in enumerate(tokens) if t}
        size = self.size = len(tokens)
        self.rank, self.left, self.right = [-1] * size, [-1] * size, [-1] * size
        self.joined: dict[int, int] = {}  # by left * size + right
        for k, (x, y, z) in enumerate(spec["merges"].tolist()):
            self.joined[x * size + y] = k
            if self.rank[z] < 0:
                self.rank[z], self.left[z], self.right[z] = k, x, y
        self.length = [0] * size
        self.automaton = ahocorasick.Automaton()
        for t, i in self.ids.items():
            self.length[i] = len(t)
            if len(t) > 1:
                self.automaton.add_word(t, i)
        self.automaton.make_automaton()
        # a letter's own token, where no longer one starts; the end mark is none by itself
        self.single = {c: self.ids.get(c, -1) for c in self.alphabet.values()} | {self.END: -1}
        self.shorter = [-1] * size  # the longest token that is a proper prefix
        for t, i in self.ids.items():
            self.shorter[i] = next((self.ids[t[:n]] for n in range(len(t) - 1, 0, -1) if t[:n] in self.ids), -1)
        self.fits: dict[int, bool] = {}  # by left * size + right
        self.words = re.compile(spec["pattern"])
        self.late = re.compile("[\u0530-\U0010ffff]")  # before that all versions of the tables agree
        self.beyond = re.compile("[\U00010000-\U0010ffff]")
        self.added = re.compile("(" + "|".join(map(re.escape, sorted(spec["added"], key=len, reverse=True))) + ")") if spec["added"] else None
        self.apart, self.upper = re.compile(f"([{_listed(NO_MARKS)}])"), re.compile(f"[{_listed(_ranges(set(LOWERED)))}]")
        self.known = Lately(self.ids_of)

    def compatible(self, a: int, b: int) -> bool:
        """Whether merging leaves the border between tokens a and b open; ``fits`` keeps the answer.

        The merges of both sides are undone from the last one back. If the pieces that
        then meet at the border have a merge that comes before the one just undone,
        merging would have joined them.
        """
        x, y, rank = a, b, self.rank
        bound = len(self.joined)  # a merge across the border counts if it came before this one
        fine = True
        while True:
            across = self.joined.get(x * self.size + y)
            if across is not None and across < bound:
                fine = False
                break
            rx, ry = rank[x], rank[y]
            if rx < 0 and ry < 0:
                break
            if rx > ry:  # of two equal merges the left one is done first, so the right one is undone first
                bound, x = rx, self.right[x]
            else:
                bound, y = ry + 1, self.left[y]
        if len(self.fits) >= MAX_CACHED:
            self.fits.clear()
        self.fits[a * self.size + b] = fine
        return fine

    def word(self, letters: str) -> list[int]:
        """Tokens of one word, given in letters of the byte alphabet."""
        s = letters + self.END
        whole = self.ids.get(s)
        if whole is not None:  # the longest token at the start is the whole word
            return [whole]
        n, size, length, shorter, fits = len(s), self.size, self.length, self.shorter, self.fits
        longest = list(map(self.single.__getitem__, s))
        for last, i in self.automaton.iter(s):
            longest[last + 1 - length[i]] = i  # ends come in order, so the last is the longest
        alive = [True] * (n + 1)
        alive[n - 1] = False  # the end mark is no token by itself
        out: list[int] = []
        at, token, before = 0, longest[0], -1
        while at < n:
            while token >= 0:
                to = at + length[token]
                if alive[to]:
                    if before < 0:
                        break
                    fine = fits.get(before * size + token)
                    if fine is None:
                        fine = self.compatible(before, token)
                    if fine:
                        break
                token = shorter[token]
            if token >= 0:
                out.append(token)
                before, at = token, to
                token = longest[at] if at < n else -1
            else:
                alive[at] = False
                if not out:
                    raise ValueError("the vocabulary lacks a byte")
                token = out.pop()
                before = out[-1] if out else -1
                at -= length[token]
                token = shorter[token]
        return out

    def ids_of(self, word: str) -> bytes:
        """Ids, as int32 bytes, of a word as the pattern cuts it."""
        letters = word if word.isalpha() and word.isascii() else word.encode().decode("latin-1").translate(self.alphabet)
        return array("i", self.word(letters)).tobytes()

    def plain(self, text: str) -> bytes:
        """Ids, as int32 bytes, of a text without added tokens.

        No white space joins or is joined by a neighbour, whatever the step, so a text's
        words are those of its parts between white space.
        """
        if text.isascii():
            low = text.lower()
        elif not self.late.search(text):
            low = unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()
        else:
            # what the tokenizer takes for no mark keeps apart what is before and behind it
            low = "".join(unicodedata.normalize("NFC", t) for t in self.apart.split(text))
            low = low.replace("Σ", "σ").lower()  # each character is lowered by itself: a final sigma is a sigma
            if self.upper.search(low):
                low = low.translate(LOWERED)
        if low.isascii() or not self.beyond.search(low):
            words = self.words.findall(low)
        else:
            cut = self.beyond.sub(lambda m: STAND_INS.get(kind(ord(m[0])), OTHER_STAND_IN), low)
            words = [low[m.start() : m.end()] for m in self.words.finditer(cut)]
        return b"".join(map(self.known.__getitem__, words))

    def encode(self, text: str) -> bytes:
        if not any(t in text for t in self.added_ids):
            return self.plain(text)
        return b"".join(
            array("i", [self.added_ids[part]]).tobytes() if k % 2 else self.plain(part) for k, part in enumerate(self.added.split(text))
        )


class Decoder:
    """One string of all tokens and where in it each begins."""

    def __init__(self, spec: dict):
        strings = tokens_of(spec)
        for t, i in spec["added"].items():
            strings[i] = t
        pieces = [f"{s} ".encode() for s in strings]  # decoding parts tokens by a space
        self.blob = np.frombuffer(b"".join(pieces), np.uint8)
        self.sizes = np.array([len(p) for p in pieces], np.int32)
        self.starts = (np.cumsum(self.sizes) - self.sizes).astype(np.int32)

    def decode(self, ids: np.ndarray) -> bytes:
        """UTF-8 of the tokens, parted by single spaces."""
        sizes = self.sizes[ids]
        ends = np.cumsum(sizes)
        total = int(ends[-1]) if len(ends) else 0
        if not total:
            return b""
        shift = np.repeat(self.starts[ids] - (ends - sizes), sizes)
        return self.blob[shift + np.arange(total)][: total - 1].tobytes()


_READY: dict = {}


def _ready(kind: type, tables):
    """One encoder and one decoder a worker process, made from the broadcast tables."""
    spec = tables.value
    if _READY.get("of") is not spec:
        _READY.clear()
        _READY["of"] = spec
    if kind not in _READY:
        _READY[kind] = kind(spec)
    return _READY[kind]


def _encode(batches: Iterator[pa.RecordBatch], tables, text: str, ids: str) -> Iterator[pa.RecordBatch]:
    enc = _ready(Encoder, tables)
    for batch in sliced(batches):
        parts = [enc.encode(t or "") for t in batch.column(text).to_pylist()]
        ends = np.cumsum([0, *[len(p) // 4 for p in parts]]).astype(np.int32)
        flat = np.frombuffer(b"".join(parts), np.int32)
        yield arrow_columns(batch, {ids: pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))})


def _decode(batches: Iterator[pa.RecordBatch], tables, ids: str, out: str) -> Iterator[pa.RecordBatch]:
    dec = _ready(Decoder, tables)
    for batch in sliced(batches):
        col = batch.column(ids)
        flat, ends = col.values.to_numpy(zero_copy_only=False), col.offsets.to_numpy()
        texts = [dec.decode(flat[a:b]) for a, b in zip(ends[:-1], ends[1:], strict=True)]
        yield arrow_columns(batch, {out: pa.array(texts, pa.binary()).cast(pa.string())})


def _both(batches: Iterator[pa.RecordBatch], tables, text: str, ids: str, out: str) -> Iterator[pa.RecordBatch]:
    coded = _encode(batches, tables, text, ids)
    yield from _decode((arrow_columns(b, {}, drop={text} - {ids, out}) for b in coded), tables, ids, out)


def load(spark, path: str):
    """The tokenizer's tables, read once by the driver and sent to the tasks; their size is the vocabulary's."""
    return spark.sparkContext.broadcast(read_spec(path))


def encode(docs: DataFrame, tokenizer, text: str = "text", ids: str = "ids") -> DataFrame:
    """``docs`` with the token ids of every whole text. ``tokenizer`` comes from ``load``."""
    small_batches(docs.sparkSession)
    return docs.mapInArrow(partial(_encode, tables=tokenizer, text=text, ids=ids), with_fields(docs, {ids: T.ArrayType(T.IntegerType())}))


def decode(tokens: DataFrame, tokenizer, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """``tokens`` with the text of the ids, special tokens included."""
    small_batches(tokens.sparkSession)
    return tokens.mapInArrow(partial(_decode, tables=tokenizer, ids=ids, out=out), with_fields(tokens, {out: T.StringType()}))


def recode(docs: DataFrame, tokenizer, text: str = "text", ids: str = "ids", out: str = "decoded") -> DataFrame:
    """``decode`` of ``encode`` without the texts themselves, in one pass: each task has one worker, and neither texts nor ids go back and forth."""
    small_batches(docs.sparkSession)
    fields = with_fields(docs, {ids: T.ArrayType(T.IntegerType()), out: T.StringType()}, drop={text} - {ids, out})
    return docs.mapInArrow(partial(_both, tables=tokenizer, text=text, ids=ids, out=out), fields)
