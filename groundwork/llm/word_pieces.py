"""Byte-pair encoding and decoding of words with a contiguous array of ranks.

A text is normalised, cut into words, and each word into symbols. A word is held as two parallel arrays: the
symbols between its boundaries, and for each boundary the rank of the merge of the symbols on both sides. The
array is scanned for the smallest rank, leftmost first; that boundary is deleted, and the ranks on both sides
of the new symbol are looked up anew, until no boundary has a rank.

Words longer than SHORT symbols have the same two arrays as numpy arrays: a scan finds the smallest rank, and
all its boundaries are deleted at once, from left to right where they overlap. The result is the same, because
a merge is ranked after those that make its parts (checked when the vocabulary is read): no deletion can bring
up a smaller rank.

No word of such a pattern has white space, and none depends on what stands beside it. So a text is cut at white space
first, and a task remembers the ids of these stretches as well as of their words: most are met again.

What a vocabulary file asks for is supported if it is: canonical composition and lower case, words by a
pattern, bytes as characters, an end-of-word mark, special tokens cut out of the raw text, no decoder. Any
other setting fails when the file is read.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from itertools import chain, groupby

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Regex, normalizers, pre_tokenizers

NONE = 1 << 60
SHORT = 64
# Stretches, and words, that a task remembers before the older ones are forgotten, and their characters together.
REMEMBERED, REMEMBERED_CHARACTERS = 300_000, 8_000_000
ROWS_AT_ONCE = 256
LIBRARY = normalizers.Sequence([normalizers.NFC(), normalizers.Lowercase()])
# Patterns of words that white space ends: literal letters, classes of letters and numbers, and what is neither nor space.
_ONE = r"(?:'[a-z]+|\[(?:\\p\{[LN]\})+\]\+?|\[\^\\s(?:\\p\{[LN]\})*\]\+?)"
WITHIN_SPACES = re.compile(rf"{_ONE}(?:\|{_ONE})*")
# What str.split takes for white space and a pattern does not.
HALF_SPACES = [chr(i) for i in range(0x110000) if chr(i).isspace() and not regex.match(r"\s", chr(i))]


def byte_characters() -> list[str]:
    """The character that stands for each byte: printable ones of Latin-1 for themselves, the others by order from U+0100."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in plain]
    return [chr(b) if b in plain else chr(256 + others.index(b)) for b in range(256)]


def _ranges(numbers: list[int]) -> str:
    rows = [[i for _, i in row] for _, row in groupby(enumerate(numbers), lambda x: x[1] - x[0])]
    return "".join(f"\\U{row[0]:08x}-\\U{row[-1]:08x}" for row in rows)


def later_characters(pattern: str) -> tuple[str, str]:
    """The letters and numbers that are younger than this Python's Unicode tables, as ranges, and the pattern with
    only those of them that the tokenizer library knows."""
    present = regex.compile(r"[\p{L}\p{N}]")
    later = [i for i in range(0x110000) if unicodedata.category(chr(i)) == "Cn" and present.match(chr(i))]
    for name in (r"\p{L}", r"\p{N}"):
        removed = pre_tokenizers.Split(Regex(name), "removed").pre_tokenize_str
        other = _ranges([i for i in later if regex.match(name, chr(i)) and removed(chr(i))])
        pattern = pattern.replace(name, f"[{name}--[{other}]]") if other else pattern
    return _ranges(later), pattern


def lowered(text: str) -> str:
    """Lower case of each character by itself: a capital sigma is the same at the end of a word."""
    return text.replace("Σ", "σ").lower()


@dataclass(frozen=True)
class Vocabulary:
    """The merges and names of a vocabulary file, as plain values that can be sent to every executor."""

    names: list[str]
    merges: list[tuple[int, int, int]]
    first_symbols: list[int]
    last_symbols: list[int]
    special: dict[str, int]
    pattern: str
    later: str
    later_pattern: str

    @staticmethod
    def load(path: str) -> "Vocabulary":
        """Read on the driver."""
        with open(path, encoding="utf-8") as file:
            given = json.load(file)
        model = given["model"]
        steps = [n["type"] for n in given["normalizer"]["normalizers"]]
        cut, to_bytes = given["pre_tokenizer"]["pretokenizers"]
        end = model["end_of_word_suffix"]
        plain = (model["type"] == "BPE" and end and not any(model.get(k) for k in (
            "dropout", "unk_token", "continuing_subword_prefix", "fuse_unk", "byte_fallback", "ignore_merges")))
        words = (cut["type"], cut["behavior"], cut["invert"]) == ("Split", "Removed", True)
        as_bytes = (to_bytes["type"], to_bytes["add_prefix_space"], to_bytes["use_regex"]) == ("ByteLevel", False, False)
        as_they_are = not any(t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"] for t in given["added_tokens"])
        spaces_only = all(n["pattern"] == {"Regex": "\\s+"} and n["content"] == " "
                          for n in given["normalizer"]["normalizers"] if n["type"] == "Replace")
        if not (plain and words and as_bytes and as_they_are and spaces_only and given["decoder"] is None
                and steps == ["NFC", "Replace", "Lowercase"]):
            raise ValueError(f"{path} asks for settings that are not supported")
        special = {t["content"]: t["id"] for t in given["added_tokens"]}
        numbers = model["vocab"]
        names = {i: name for name, i in [*numbers.items(), *special.items()]}
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        merges = [(numbers[a], numbers[b], numbers[a + b]) for a, b in pairs]
        made = {whole: rank for rank, (_, _, whole) in reversed(list(enumerate(merges)))}
        if any(rank <= max(made.get(a, -1), made.get(b, -1)) for rank, (a, b, _) in enumerate(merges)):
            raise ValueError("a merge is ranked before one that makes its parts")
        symbols = byte_characters()
        return Vocabulary([names[i] for i in range(len(names))], merges, [numbers[c] for c in symbols],
                          [numbers[c + end] for c in symbols], special, cut["pattern"]["Regex"],
                          *later_characters(cut["pattern"]["Regex"]))


class Remembered(dict):
    """Ids of words; computes what it lacks. Once it is large, between texts, its words become the older ones, and the
    older ones before them are forgotten; an older word that is met again is a new one."""

    def __init__(self, compute: Callable[[str], tuple[int, ...]]):
        super().__init__()
        self.compute, self.characters = compute, 0
        self.older: dict[str, tuple[int, ...]] = {}

    def __missing__(self, word: str) -> tuple[int, ...]:
        found = self.older.get(word)
        if found is None:
            found = self.compute(word)
        self[word] = found
        self.characters += len(word)
        return found

    def shrink(self) -> None:
        if len(self) > REMEMBERED or self.characters > REMEMBERED_CHARACTERS:
            self.older = dict(self)
            self.clear()
            self.characters = 0


class Codec:
    """Encodes and decodes with one vocabulary."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary, self.names = vocabulary, vocabulary.names
        self.size = len(self.names)
        self.decimals = list(map(str, range(self.size)))
        self.ranks = {a * self.size + b: rank for rank, (a, b, _) in enumerate(vocabulary.merges)}
        self.made = [whole for _, _, whole in vocabulary.merges]
        pairs = np.array([a * self.size + b for a, b, _ in vocabulary.merges], np.int64)
        self.order = np.argsort(pairs)
        self.pairs = pairs[self.order]
        self.wholes = np.array(self.made, np.int64)
        self.find_words = regex.compile(vocabulary.pattern).findall
        self.find_later_words = regex.compile(vocabulary.later_pattern, regex.V1).findall
        self.is_high = re.compile(f"[{vocabulary.later[:10]}-\\U0010ffff]").search if vocabulary.later else lambda part: None
        self.has_later = regex.compile(f"[{vocabulary.later or 'a'}]").search
        self.cut = regex.compile("(" + "|".join(map(regex.escape, vocabulary.special)) + ")") if vocabulary.special else None
        self.within_spaces = WITHIN_SPACES.fullmatch(vocabulary.pattern) is not None
        self.known = Remembered(self.word)
        self.stretches = Remembered(self.stretch)

    def short(self, symbols: list[int]) -> list[int]:
        """The symbols after all merges, one boundary at a time."""
        look, size, made = self.ranks.get, self.size, self.made
        ranks = [look(a * size + b, NONE) for a, b in zip(symbols, symbols[1:])]
        while ranks:
            best = min(ranks)  # equal ranks are equal pairs, so the first of them is the leftmost
            if best == NONE:
                break
            at = ranks.index(best)
            symbols[at] = whole = made[best]
            del symbols[at + 1], ranks[at]
            if at:
                ranks[at - 1] = look(symbols[at - 1] * size + whole, NONE)
            if at < len(ranks):
                ranks[at] = look(whole * size + symbols[at + 1], NONE)
        return symbols

    def _ranks_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        pairs = left * self.size + right
        at = np.minimum(np.searchsorted(self.pairs, pairs), len(self.pairs) - 1)
        return np.where(self.pairs[at] == pairs, self.order[at], NONE)

    def long(self, symbols: np.ndarray) -> np.ndarray:
        """The same for a long word: all boundaries of the smallest rank at once."""
        ranks = self._ranks_of(symbols[:-1], symbols[1:])
        while len(ranks):
            best = int(ranks.min())
            if best == NONE:
                break
            at = np.flatnonzero(ranks == best)
            # In a row of adjacent boundaries, as in aaaa, every second one is deleted from the left.
            row = np.flatnonzero(np.diff(at, prepend=-2) != 1)
            at = at[(np.arange(len(at)) - np.repeat(row, np.diff(row, append=len(at)))) % 2 == 0]
            symbols[at] = self.wholes[best]
            symbols, ranks = np.delete(symbols, at + 1), np.delete(ranks, at)
            at = at - np.arange(len(at))  # places of the new symbols
            beside = np.unique(np.concatenate([at - 1, at]))
            beside = beside[(beside >= 0) & (beside < len(ranks))]
            ranks[beside] = self._ranks_of(symbols[beside], symbols[beside + 1])
        return symbols

    def word(self, word: str) -> tuple[int, ...]:
        raw = word.encode()
        first, last = self.vocabulary.first_symbols, self.vocabulary.last_symbols
        symbols = [first[b] for b in raw[:-1]] + [last[raw[-1]]]
        return tuple(self.short(symbols) if len(symbols) <= SHORT else self.long(np.array(symbols, np.int64)).tolist())

    def stretch(self, text: str) -> tuple[int, ...]:
        """The ids of a normalised stretch."""
        words = self.find_words(text)
        return self.known[text] if words == [text] else tuple(chain.from_iterable(map(self.known.__getitem__, words)))

    def found(self, part: str) -> Iterable[tuple[int, ...]]:
        """The ids of a text without special tokens, word by word or stretch by stretch. Texts with characters younger
        than this Python are normalised by the library."""
        if self.is_high(part) and self.has_later(part):
            return map(self.known.__getitem__, self.find_later_words(LIBRARY.normalize_str(part)))
        part = lowered(unicodedata.normalize("NFC", part))
        if self.within_spaces and not any(space in part for space in HALF_SPACES):
            return map(self.stretches.__getitem__, part.split())
        return map(self.known.__getitem__, self.find_words(part))

    def encode(self, text: str | None) -> list[int]:
        """The ids of a whole text. Special tokens in it are found before anything else."""
        ids: list[int] = []
        self.known.shrink()
        self.stretches.shrink()
        for part in self.cut.split(text or "") if self.cut else [text or ""]:
            if part in self.vocabulary.special:
                ids.append(self.vocabulary.special[part])
                continue
            ids.extend(chain.from_iterable(self.found(part)))
        return ids

    def decode(self, ids: Iterable[int]) -> str:
        """The names of the ids, special ones too, joined by spaces: the file has no decoder."""
        return " ".join(map(self.names.__getitem__, ids))

    def decimal(self, ids: Iterable[int]) -> str:
        """The ids as decimal numbers, joined by spaces."""
        return " ".join(map(self.decimals.__getitem__, ids))


# A worker keeps its codec from task to task: one for each vocabulary file it has met.
_CODECS: dict[str, Codec] = {}


def mapped(docs: DataFrame, path: str, row_id: str, text: str, schema: str,
           columns: Callable[[Codec, pa.Array, pa.Array], dict]) -> DataFrame:
    """`columns(codec, ids, texts)` gives the columns of `schema` for a batch of rows."""
    vocabulary = docs.sparkSession.sparkContext.broadcast(Vocabulary.load(path))  # a few MB, fixed by the file

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if path not in _CODECS:
            _CODECS[path] = Codec(vocabulary.value)
        codec = _CODECS[path]
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS_AT_ONCE):
                part = batch.slice(at, ROWS_AT_ONCE)
                yield pa.RecordBatch.from_pydict(columns(codec, part.column(0), part.column(1)))

    return docs.select(F.col(row_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(run, schema)


def encode(docs: DataFrame, path: str, row_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, ids (array<int>), decoded (the names of these ids joined by spaces) for every row.

    A null, empty or blank text has no ids and an empty decoded text. Texts and words of any length are
    encoded whole. Merges that tie in rank are taken from the left. Rows with a null id and repeated rows
    stay. An empty table gives an empty result. Columns other than the two named are ignored.
    """
    def columns(codec: Codec, ids: pa.Array, texts: pa.Array) -> dict:
        encoded = [codec.encode(t.as_py()) for t in texts]
        return {"doc_id": ids, "ids": pa.array(encoded, pa.list_(pa.int32())),
                "decoded": pa.array([codec.decode(e) for e in encoded], pa.string())}

    return mapped(docs, path, row_id, text, "doc_id long, ids array<int>, decoded string", columns)
