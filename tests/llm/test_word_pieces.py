"""Word byte-pairs against the tokenizer library."""

import hashlib
import json
import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from groundwork.llm import queries, word_pieces
from tests.llm.conftest import SF

PATH = public_tokenizers.path(queries.WORD_VOCABULARY)


@pytest.fixture(scope="module")
def codec():
    return word_pieces.Codec(word_pieces.Vocabulary.load(PATH))


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def equal(codec, library, text):
    ids = library.encode(text, add_special_tokens=False).ids
    return codec.encode(text) == ids and codec.decode(ids) == library.decode(ids, skip_special_tokens=False)


def test_every_character_of_some_planes(codec, library):
    """Alone, in words, after an accent: composition, lower case, letters and marks as the library has them."""
    points = [*range(0xD800), *range(0xE000, 0x12000), *range(0x1D000, 0x20000), *range(0x2A6D0, 0x2A6F0), *range(0x323A0, 0x323C0)]
    for at in range(0, len(points), 512):
        text = " ".join(f"a{chr(p)}Z{chr(p)}{chr(p)} 1{chr(p)}" for p in points[at : at + 512])
        assert equal(codec, library, text), hex(points[at])


def test_words_of_all_lengths(codec, library):
    rng = random.Random(2)
    for n in (1, 2, 5, word_pieces.SHORT - 1, word_pieces.SHORT, word_pieces.SHORT + 1, 200, 3000):
        for letters in ("a", "ab", "abcde", "eéß日", "thein", "ing"):
            assert equal(codec, library, "".join(rng.choice(letters) for _ in range(n)))


def test_odd_texts(codec, library):
    for text in ("", " \n", "<|endoftext|>x<|startoftext|><|endoftext|>", "<|END", "<|ENDOFTEXT|>", "I'LL we'Ve 'S 'r", "\x00 ́e e", "Σας ΣΑΣ",
                 "İI ǅ", "日本 😀👍🏽", "12345", "a_b--c...", "😀" * 300):
        assert equal(codec, library, text), text


def test_texts_are_cut_at_white_space_as_the_pattern_has_it(codec, library):
    """All that Python or the pattern takes for white space, between words and inside of them; what a pattern must be."""
    spaces = [chr(p) for p in range(0x110000) if chr(p).isspace()] + ["\u180e", "\u200b", "\ufeff"]
    for space in spaces:
        assert equal(codec, library, f"a{space}b's{space}{space}12'{space}s,{space}C.") and equal(codec, library, f"it{space}'s it's{space}")
    for pattern, is_within in ((codec.vocabulary.pattern, True), (r"[\p{L}]+(?!\S)|[^\s\p{L}]+", False), (r"\s?[\p{L}]+", False), (r"[^\p{L}]+", False)):
        assert (word_pieces.WITHIN_SPACES.fullmatch(pattern) is not None) == is_within, pattern


def test_what_is_met_again_is_remembered(codec, library, monkeypatch):
    """However many words are met once, a frequent one is merged once, and no more are held than the two bounds."""
    merged, fresh = [], word_pieces.Codec(codec.vocabulary)
    monkeypatch.setattr(word_pieces, "REMEMBERED", 100)
    monkeypatch.setattr(fresh.known, "compute", lambda word: merged.append(word) or codec.word(word))
    for i in range(200):
        text = "usual words, " + " ".join(f"rare{chr(97 + i % 26)}{'x' * (i // 26)}{chr(97 + j)}" for j in range(20))
        assert fresh.encode(text) == library.encode(text, add_special_tokens=False).ids
        assert all(len(held) + len(held.older) <= 2 * (100 + 43) for held in (fresh.known, fresh.stretches))
    assert [merged.count(word) for word in ("usual", "words", ",", "rareaa")] == [1, 1, 1, 1]


def test_query_equals_the_library(spark, documents, odd_documents, library, tmp_path):
    odd_documents.write.parquet(f"{tmp_path}/odd/documents.parquet")
    odd_documents.limit(0).write.parquet(f"{tmp_path}/none/documents.parquet")
    assert queries.op11_word_pieces(spark, f"{tmp_path}/none").collect() == []
    for path, docs in ((SF, documents), (f"{tmp_path}/odd", odd_documents)):
        want = []
        for row in docs.select("doc_id", "text").collect():
            ids = library.encode(row.text or "", add_special_tokens=False).ids
            digests = [" ".join(map(str, ids)), library.decode(ids, skip_special_tokens=False)]
            want.append((row.doc_id, len(ids), *[hashlib.sha256(d.encode()).hexdigest() for d in digests]))
        assert sorted(map(tuple, queries.op11_word_pieces(spark, path).collect()), key=repr) == sorted(want, key=repr)


def test_general_interface(spark, library):
    got = word_pieces.encode(spark.createDataFrame([(1, "Hello world's", 5)], "n long, t string, ids int"), PATH, "n", "t").first()
    assert got.ids == library.encode("Hello world's", add_special_tokens=False).ids and got.decoded == "hello</w> world</w> 's</w>"


def test_other_files_are_refused(tmp_path):
    given = json.load(open(PATH))
    given["decoder"] = {"type": "BPEDecoder"}
    path = tmp_path / "other.json"
    path.write_text(json.dumps(given))
    with pytest.raises(ValueError):
        word_pieces.Vocabulary.load(str(path))
