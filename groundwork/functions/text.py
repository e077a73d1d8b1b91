"""Column expressions over ticket text: derived texts, tokens, stemming, stop words."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# English stop words (the list of 127 words distributed with NLTK), each a single token.
STOP_WORDS = (
    "i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her "
    "hers herself it its itself they them their theirs themselves what which who whom this that these "
    "those am is are was were be been being have has had having do does did doing a an the and but if or "
    "because as until while of at by for with about against between into through during before after "
    "above below to from up down in out on off over under again further then once here there when where "
    "why how all any both each few more most other some such no nor not only own same so than too very "
    "s t can will just don should now"
).split()

TOKEN_PATTERN = r"[\p{L}\p{N}]+"


def _blank_to_null(name: str) -> Column:
    return F.nullif(F.col(name), F.lit(""))


def embedding_text() -> Column:
    """Title, description and resolution on lines of their own; blanks and the code left out."""
    return F.concat_ws("\n", *[_blank_to_null(c) for c in ("title", "description", "resolution")])


def search_text() -> Column:
    """The text that is matched by keyword: the same parts and the error code."""
    return F.concat_ws(" ", *[_blank_to_null(c) for c in ("title", "description", "resolution", "error_code")])


def tokens(text: Column | str) -> Column:
    """Lower-cased runs of letters and digits, in order."""
    column = F.col(text) if isinstance(text, str) else text
    return F.regexp_extract_all(F.lower(column), F.lit(f"({TOKEN_PATTERN})"), F.lit(1))


def padded(words: Column | str) -> Column:
    """Tokens as one string with a space on both sides of every token, for phrase containment."""
    return F.concat(F.lit(" "), F.array_join(words, " "), F.lit(" "))


def stem(word: Column) -> Column:
    """The S-stemmer of Harman (1991): plural endings only, first matching rule wins."""
    cut = F.length(word)
    return (
        F.when(word.endswith("ies") & ~word.endswith("eies") & ~word.endswith("aies"),
               F.concat(F.substr(word, F.lit(1), cut - 3), F.lit("y")))
        .when(word.endswith("es") & ~word.endswith("aes") & ~word.endswith("ees") & ~word.endswith("oes"),
              F.substr(word, F.lit(1), cut - 1))
        .when(word.endswith("s") & ~word.endswith("us") & ~word.endswith("ss"),
              F.substr(word, F.lit(1), cut - 1))
        .otherwise(word)
    )


def stem_of(word: str) -> str:
    """`stem` of one word, in workers."""
    if word.endswith("ies") and not word.endswith(("eies", "aies")):
        return word[:-3] + "y"
    if word.endswith("es") and not word.endswith(("aes", "ees", "oes")):
        return word[:-1]
    if word.endswith("s") and not word.endswith(("us", "ss")):
        return word[:-1]
    return word


def is_stop_word(word: Column) -> Column:
    return word.isin(STOP_WORDS)


def normal_words(words: Column | str) -> Column:
    """Stems at the place of their tokens; a stop word leaves an empty place."""
    return F.transform(words, lambda w: F.when(is_stop_word(w), F.lit("")).otherwise(stem(w)))


def normal_terms(words: Column | str) -> Column:
    """Stems of the tokens that are not stop words, in order."""
    return F.filter(normal_words(words), lambda w: w != "")


def phrase_text(words: Column | str) -> Column:
    """A phrase of normal words for containment in `padded`; stop words at its ends are dropped."""
    return F.concat(F.lit(" "), F.trim(F.array_join(words, " ")), F.lit(" "))
