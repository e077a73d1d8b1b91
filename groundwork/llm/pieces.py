"""SentencePiece encoding and decoding by exact backtracking over longest matches.

For a vocabulary of merge pieces, a sequence of pieces is the result of merging exactly if every two
neighbours are: merging the text of both alone gives these two again. So a text is encoded from left to
right with the longest piece that matches (found by an Aho-Corasick automaton), each new piece is
checked against the one before it by merging the pair again, and on a dead end the last piece is taken
back for a shorter one. A bit for each position records dead ends, so none is entered twice.

No piece of such a vocabulary has a space sign after another character, so words (leading space signs
and what follows) are encoded one by one, and recent words are remembered in a table of bounded size.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import islice

import ahocorasick
import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SPACE = "▁"
REMEMBERED = 500_000
LETTER = "[A-Za-zÀ-ÖØ-öø-ɏ]"
WORDS_AT_ONCE = 100_000
ROWS_AT_ONCE = 256


@dataclass(frozen=True)
class Vocabulary:
    """The pieces of a model file, as plain values that can be sent to every executor."""

    names: list[str]
    scores: list[float]
    special: frozenset[int]
    bytes_from: dict[int, int]
    unknown: int
    begin: int
    end: int

    @staticmethod
    def load(path: str) -> "Vocabulary":
        """Read on the driver; fails if the model needs text to be normalised or has other kinds of pieces."""
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        size = model.vocab_size()
        names = [model.id_to_piece(i) for i in range(size)]
        bytes_from = {int(names[i][3:5], 16): i for i in range(size) if model.is_byte(i)}
        special = frozenset(i for i in range(size) if model.is_control(i) or model.is_unknown(i) or model.is_byte(i))
        probe = " A  é　Ａﬁ\t\n "
        if model.decode(model.encode(probe)) != probe or any(model.is_unused(i) for i in range(size)) or len(bytes_from) != 256:
            raise ValueError("only merge models with byte fallback and without normalisation are supported")
        if any(SPACE in name.lstrip(SPACE) for i, name in enumerate(names) if i not in special):
            raise ValueError("a piece has a space sign after another character")
        return Vocabulary(names, [model.get_score(i) for i in range(size)], special, bytes_from,
                          model.unk_id(), model.bos_id(), model.eos_id())


class Remembered(dict):
    """Encoded words as little-endian 32-bit ids; computes what it lacks."""

    def __init__(self, compute):
        super().__init__()
        self.compute = compute

    def __missing__(self, word: str) -> bytes:
        found = self[word] = np.array(self.compute(word), "<u4").tobytes()
        return found


class Codec:
    """Encodes and decodes with one vocabulary."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        normal = [i for i in range(len(vocabulary.names)) if i not in vocabulary.special]
        self.ids = {vocabulary.names[i]: i for i in normal}
        self.scores = {vocabulary.names[i]: vocabulary.scores[i] for i in normal}
        self.alphabet = {c for name in self.ids for c in name}
        self.automaton = ahocorasick.Automaton()
        for name, i in self.ids.items():
            # A piece that merging its own text does not give can never be in a result.
            if len(name) == 1 or self.merged(name) == [name]:
                self.automaton.add_word(name, name)
        self.automaton.make_automaton()
        # For each piece the longest shorter piece it begins with, or "".
        self.shorter = {name: next((name[:n] for n in range(len(name) - 1, 0, -1) if name[:n] in self.automaton), "")
                        for name in self.automaton}
        self.compatible: dict[tuple[str, str], bool] = {}
        self.words = Remembered(self.encode_word)
        self.parts = self._parts()
        self._prepare_decoding()

    def _parts(self) -> re.Pattern:
        """Cuts a text at places that no piece goes across: before space signs, around line ends, and
        between a letter and a mark that no piece has after a letter."""
        pieces = [name for name in self.ids if len(name) > 1]
        apart = "" if any("\n" in name for name in pieces) else "\n"
        letter = re.compile(LETTER)
        after = {name[i + 1] for name in pieces for i in range(len(name) - 1) if letter.match(name[i])}
        marks = re.escape("".join(c for c in ".,;:!?" if c not in after))
        shapes = [f"{SPACE}*{LETTER}+(?=[{marks}])"] if marks else []
        shapes += [f"{SPACE}*[^{SPACE}{apart}]+", f"{SPACE}+"] + ([f"{apart}+"] if apart else [])
        return re.compile("|".join(shapes))

    def merged(self, text: str) -> list[str]:
        """The text after merging: always the pair whose piece has the best score, leftmost first."""
        parts, scores = list(text), self.scores
        while True:
            best, at = None, -1
            for i in range(len(parts) - 1):
                score = scores.get(parts[i] + parts[i + 1])
                if score is not None and (best is None or score > best):
                    best, at = score, i
            if best is None:
                return parts
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def fit(self, left: str, right: str) -> bool:
        """Whether the two pieces may stand side by side."""
        known = self.compatible.get((left, right))
        if known is None:
            if len(self.compatible) >= REMEMBERED:
                self.compatible.clear()
            known = self.compatible[left, right] = self.merged(left + right) == [left, right]
        return known

    def encode_word(self, word: str) -> list[int]:
        """Ids of a word; characters outside the alphabet become the ids of their UTF-8 bytes."""
        if self.alphabet.issuperset(word):
            return [self.ids[p] for p in self.backtracked(word)]
        out: list[int] = []
        at = 0
        for i, c in enumerate(word):
            if c not in self.alphabet:
                out += [self.ids[p] for p in self.backtracked(word[at:i])]
                out += [self.vocabulary.bytes_from[b] for b in c.encode("utf-8")]
                at = i + 1
        return out + [self.ids[p] for p in self.backtracked(word[at:])]

    def backtracked(self, text: str) -> list[str]:
        """The pieces of a text over the alphabet."""
        taken = [piece for _, piece in self.automaton.iter_long(text)]  # longest matches, one after another
        good = 1
        while good < len(taken) and self.fit(taken[good - 1], taken[good]):
            good += 1
        if good >= len(taken):
            return taken
        piece = taken[good]
        del taken[good:]
        size, at = len(text), sum(map(len, taken))
        failed = bytearray((size >> 3) + 1)  # a bit for each position that no valid sequence passes
        while True:
            before = taken[-1] if taken else None
            while piece:
                end = at + len(piece)
                if not failed[end >> 3] >> (end & 7) & 1 and (before is None or self.fit(before, piece)):
                    break
                piece = self.shorter[piece]
            if piece:
                taken.append(piece)
                at = end
                if at == size:
                    return taken
                piece = next(self.automaton.iter_long(text, at))[1]
            else:
                failed[at >> 3] |= 1 << (at & 7)
                last = taken.pop()
                at -= len(last)
                piece = self.shorter[last]

    def encode(self, text: str | None) -> Iterator[bytes]:
        """The ids of a whole text without begin and end, as little-endian 32-bit integers, in stretches."""
        if not text:
            return
        found = self.parts.finditer(SPACE + text.replace(" ", SPACE))
        get = self.words.__getitem__
        while words := [m.group() for m in islice(found, WORDS_AT_ONCE)]:
            yield b"".join(map(get, words))
            if len(self.words) > REMEMBERED:
                self.words.clear()

    def with_ends(self, text: str | None) -> np.ndarray:
        """All ids of a text with begin and end ids."""
        ends = (np.array([i], "<u4").tobytes() for i in (self.vocabulary.begin, self.vocabulary.end))
        first, last = ends
        return np.frombuffer(b"".join([first, *self.encode(text), last]), "<u4")

    def _prepare_decoding(self) -> None:
        shown = []
        byte_of = {i: b for b, i in self.vocabulary.bytes_from.items()}
        for i, name in enumerate(self.vocabulary.names):
            if i in byte_of:
                shown.append(bytes([byte_of[i]]))
            elif i == self.vocabulary.unknown:
                shown.append(" ⁇ ".encode())
            else:
                shown.append(b"" if i in self.vocabulary.special else name.replace(SPACE, " ").encode())
        self.shown = np.frombuffer(b"".join(shown), np.uint8)
        self.widths = np.array([len(s) for s in shown], np.int64)
        self.offsets = np.cumsum(self.widths) - self.widths
        self.is_byte = np.zeros(len(shown), bool)
        self.is_byte[list(byte_of)] = True

    def decode_bytes(self, ids: np.ndarray) -> bytes:
        """The UTF-8 text of ids: pieces are joined, space signs become spaces, the first one is dropped."""
        silent = np.isin(ids, [i for i in self.vocabulary.special if not self.widths[i]])
        ids = ids[~silent]
        widths = self.widths[ids]
        total = int(widths.sum())
        if not total:
            return b""
        out = np.empty(total, np.uint8)
        done = 0
        for at in range(0, len(ids), WORDS_AT_ONCE):  # so that the index of a long text stays small
            part = widths[at : at + WORDS_AT_ONCE]
            shift = np.cumsum(part) - part
            n = int(part.sum())
            out[done : done + n] = self.shown[np.repeat(self.offsets[ids[at : at + WORDS_AT_ONCE]] - shift, part) + np.arange(n)]
            done += n
        first = self.vocabulary.names[ids[0]].startswith(SPACE) and not self.is_byte[ids[0]]
        raw = out.tobytes()[int(first):]
        if not self.is_byte[ids].any():
            return raw
        try:
            raw.decode("utf-8")
            return raw
        except UnicodeDecodeError:  # each byte that begins no character becomes the replacement sign
            return "".join(_lenient(raw)).encode()


def _lenient(raw: bytes) -> Iterator[str]:
    at = 0
    while at < len(raw):
        for width in (1, 2, 3, 4):
            try:
                yield raw[at : at + width].decode("utf-8")
                at += width
                break
            except UnicodeDecodeError:
                continue
        else:
            yield "�"
            at += 1


def mapped(docs: DataFrame, model_path: str, row_id: str, text: str, schema: str, columns) -> DataFrame:
    """`columns(codec, ids, texts)` gives the columns of `schema` for a batch of rows."""
    vocabulary = docs.sparkSession.sparkContext.broadcast(Vocabulary.load(model_path))  # a few MB, fixed by the model

    def run(batches: Iterable[pa.RecordBatch]):
        codec = Codec(vocabulary.value)
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS_AT_ONCE):
                part = batch.slice(at, ROWS_AT_ONCE)
                yield pa.RecordBatch.from_pydict(columns(codec, part.column(0), part.column(1)))

    return docs.select(F.col(row_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, schema)


def encode(docs: DataFrame, model_path: str, row_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, ids (array<int> with begin and end ids), decoded (the text these ids give) for every row.

    A null text counts as empty: its ids are begin and end. Rows with a null doc_id and repeated rows
    stay. Texts of any length are encoded whole. An empty table gives an empty result. Columns other
    than the two named are ignored.
    """
    def columns(codec: Codec, ids, texts):
        encoded = [codec.with_ends(t.as_py()) for t in texts]
        return {"doc_id": ids, "ids": pa.array([e.astype(np.int32) for e in encoded], pa.list_(pa.int32())),
                "decoded": pa.array([codec.decode_bytes(e).decode() for e in encoded], pa.string())}

    return mapped(docs, model_path, row_id, text, "doc_id long, ids array<int>, decoded string", columns)
