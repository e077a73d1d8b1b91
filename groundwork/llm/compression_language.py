"""Language identification by compression with per-language dictionaries.

Each language has a zstandard dictionary of raw content: text of that language. A text in lower case is
compressed with every dictionary, and the language whose result is smallest wins. Where the two smallest results
are too close, the text is rejected.

The dictionaries are fitted on a bounded sample: of each language at most `Sample.documents` distinct
texts (those whose hash is smallest), and of each at most `Sample.characters` code points. Everything
that is classified is compressed whole.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from groundwork.llm.common import best_rows

UNKNOWN = "und"
LETTER = re.compile(r"[^\W\d_]")
# Lazy matching down to four bytes: shorter matches than usual, as the dictionary is all that tells languages apart.
SETTINGS = dict(min_match=4, strategy=zstandard.STRATEGY_LAZY2, window_log=18, write_content_size=0, write_checksum=0, write_dict_id=0)
LEVEL = 7
# Sizes are whole bytes, so of a shorter text than this a narrow margin says nothing, and it is not rejected for it.
LEAST_CHARACTERS = 200
# A long text is compressed in blocks, or its own earlier parts would outweigh the dictionary.
BLOCK_BYTES = 4096
MAX_LANGUAGES = 1000


@dataclass(frozen=True)
class Sample:
    """Bound of the texts that the dictionaries are made of."""

    documents: int = 64
    characters: int = 2000


@dataclass(frozen=True)
class Model:
    """Languages, the commonest in the labelled rows first, and the content of their dictionaries."""

    languages: list[str]
    contents: list[bytes]


def fit(labelled: DataFrame, sample: Sample = Sample(), text: str = "text", lang: str = "lang") -> Model:
    """Learns from rows that have a language and a text with a letter; others are passed over.

    Raises if there are more than MAX_LANGUAGES languages, which the driver would have to hold.
    """
    rows = labelled.select(F.col(lang).alias("lang"), F.col(text).alias("text")).filter(
        F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    sizes = rows.groupBy("lang").count().orderBy(F.col("count").desc(), "lang").limit(MAX_LANGUAGES + 1).collect()
    if len(sizes) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    # The hash of the text puts copies side by side, so each text is taken once.
    short = rows.select("lang", F.xxhash64("text").alias("h"), F.substring("text", 1, sample.characters).alias("text"))
    kept = best_rows(short.dropDuplicates(["lang", "h"]), "lang", [F.col("h"), F.col("text")], sample.documents, "h")
    parts: dict[str, list[str]] = {}
    for row in kept.select("lang", "rank", "text").orderBy("lang", F.col("rank").desc()).collect():
        parts.setdefault(row.lang, []).append(row.text)
    names = [row.lang for row in sizes]
    return Model(names, ["\n".join(parts[name]).lower().encode() for name in names])


class Scorer:
    """Compressed sizes of a text with each dictionary."""

    def __init__(self, model: Model):
        self.languages = model.languages
        self.compressors = []
        for content in model.contents:
            made = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            settings = zstandard.ZstdCompressionParameters.from_level(LEVEL, **SETTINGS)
            made.precompute_compress(compression_params=settings)
            self.compressors.append(zstandard.ZstdCompressor(dict_data=made, compression_params=settings))

    def sizes(self, text: str) -> list[int]:
        raw = text.lower().encode()
        blocks = [raw[at : at + BLOCK_BYTES] for at in range(0, len(raw), BLOCK_BYTES)]
        return [sum(len(c.compress(block)) for block in blocks) for c in self.compressors]

    def predict(self, text: str | None) -> tuple[str, float]:
        """(language, margin): how much smaller the best result is than the second best, from 0 to 1."""
        if text is None or not self.languages or not LETTER.search(text):
            return UNKNOWN, 0.0
        sizes = self.sizes(text)
        best = min(range(len(sizes)), key=sizes.__getitem__)  # a tie goes to the commoner language
        others = sizes[:best] + sizes[best + 1 :]
        return self.languages[best], (1.0 - sizes[best] / min(others) if others else 1.0)


def predict(docs: DataFrame, model: Model, min_margin: float = 0.0, carry: tuple[str, ...] = ("doc_id",),
            text: str = "text") -> DataFrame:
    """The columns `carry` of every row, and lang_pred, score, rejected.

    score is the margin between the two smallest sizes. rejected is true where the language is `und`
    (a null text, or one without a letter, or no language learned), or where the margin of a text of
    LEAST_CHARACTERS or more is below `min_margin`.
    Repeated rows and rows with nulls in other columns stay; an empty table gives an empty result.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)  # bounded by MAX_LANGUAGES and Sample
    kept = docs.select(*carry, F.col(text).alias("_text"), F.length(text).alias("_size"))
    names = list(carry)
    schema = kept.drop("_text", "_size").schema.add("lang_pred", "string").add("score", "double").add("rejected", "boolean")

    def run(batches):
        scorer = Scorer(sent.value)
        for batch in batches:
            found = [scorer.predict(t.as_py()) for t in batch.column("_text")]
            sizes = batch.column("_size").to_pylist()
            low = [lang == UNKNOWN or (margin < min_margin and size >= LEAST_CHARACTERS)
                   for (lang, margin), size in zip(found, sizes)]
            yield pa.record_batch([*(batch.column(n) for n in names), pa.array([f[0] for f in found], pa.string()),
                                   pa.array([f[1] for f in found], pa.float64()), pa.array(low, pa.bool_())],
                                  [*names, "lang_pred", "score", "rejected"])

    return kept.mapInArrow(run, schema)
