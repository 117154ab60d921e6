import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from fieldweave.llm.packing import WordIds, pack, piece_lengths

PATH = public_tokenizers.path("word_bpe_49k.json")
TEXTS = [
    "Hello, world. It's 2024!  two  blanks\n\nand\tTabs <|endoftext|>x don't", "", None, "É café ÉTÉ. ΣΑΣ Σ. İstanbul ... a.b ?!", " lead", "x" * 3000,
    "word " * 5000, "日本語。テスト 한국어,  nbsp \x1c ctrl", "same text", "same text", "A, b; C: d! e? ,", "🙂🙂 emoji.",
]


def test_lengths_are_powers_of_two_that_sum():
    for n in range(1, 5000):
        parts = piece_lengths(n, 2048)
        assert sum(parts) == n and all(p & (p - 1) == 0 and p <= 2048 for p in parts) and sorted(parts, reverse=True) == parts


def test_ids_are_the_library_s():
    t = Tokenizer.from_file(PATH)
    texts = [x or "" for x in TEXTS]
    for text, ids in zip(texts, WordIds(PATH).of(texts), strict=True):
        assert ids.tolist() == t.encode(text, add_special_tokens=False).ids


def test_pieces_cover_each_document(spark):
    t = Tokenizer.from_file(PATH)
    rows = [(None if k == 3 else k, x, "other") for k, x in enumerate(TEXTS)]
    got = pack(spark.createDataFrame(rows, "doc_id long, text string, length string"), PATH).collect()
    assert len({r.sequence_id for r in got}) == len(got) and {r.offset for r in got} == {0}
    for k, text, _ in rows:
        ids = np.array([*t.encode(text or "", add_special_tokens=False).ids, 1], dtype="<u4")
        own = sorted((r for r in got if r.doc_id == k), key=lambda r: r.start)
        assert [r.length for r in own] == piece_lengths(len(ids), 2048)
        assert [r.ids_crc32 for r in own] == [zlib.crc32(ids[r.start : r.start + r.length].tobytes()) for r in own]
        assert all(r.doc_tokens == len(ids) and 1 << r.bucket == r.length for r in own)


def test_no_rows(spark):
    assert pack(spark.createDataFrame([], "doc_id long, text string"), PATH).count() == 0


@pytest.mark.parametrize("limit", [1, 64])
def test_other_limits_and_ids(spark, limit):
    got = pack(spark.createDataFrame([(1, "some words " * 30)], "doc_id long, text string"), PATH, limit=limit, with_ids=True).orderBy("start").collect()
    ids = Tokenizer.from_file(PATH).encode("some words " * 30, add_special_tokens=False).ids
    assert [i for r in got for i in r.ids] == [*ids, 1] and max(r.length for r in got) <= limit


LIBRARY, OWN = Tokenizer.from_file(PATH), WordIds(PATH)


@pytest.mark.parametrize("text", ["\u0958! \u0958", "\u0130! \u0130.", "\ufb1d.", "a\ufb1d, b", "don't!'s it's,", "<|ENDOFTEXT|>!! x<|endoftext|>."])
def test_letters_that_come_apart_and_marks_behind_them(text):
    assert next(OWN.of([text])).tolist() == LIBRARY.encode(text, add_special_tokens=False).ids


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="abXYst' .,!&<|>\n\té\u0130\u0131Σσ\u212a\u0301\u0958\u05d9\u05b4\ufb1dя語1²", max_size=30) | st.text(max_size=20))
def test_any_text(text):
    assert next(OWN.of([text])).tolist() == LIBRARY.encode(text, add_special_tokens=False).ids


class Counting:
    def __init__(self, tokenizer):
        self.tokenizer, self.calls = tokenizer, 0

    def encode_batch_fast(self, texts, **options):
        self.calls += len(texts)
        return self.tokenizer.encode_batch_fast(texts, **options)


def test_words_are_not_encoded_again_for_the_marks_behind_them():
    words = [a + b + c for a in "bcdfgklmnp" for b in "aeiou" for c in "bcdfgklmnp"]
    texts = [" ".join(f"{w}{m}" for w in words) for m in ("", ".", "&&&", ",***", ")", "!!")] + [" ".join(words).upper()]
    ids = WordIds(PATH)
    ids.tokenizer = Counting(ids.tokenizer)
    found = [i.tolist() for i in ids.of(texts)]
    assert found == [LIBRARY.encode(t, add_special_tokens=False).ids for t in texts]
    assert ids.tokenizer.calls <= 10


def test_forgotten_words_are_learnt_again():
    ids = WordIds(PATH, remembered=3)
    for text in ["some words, here", "other ones. here!", "", "some Words, there"] * 2:
        assert next(ids.of([text])).tolist() == LIBRARY.encode(text, add_special_tokens=False).ids


def test_ids_of_many_rows(spark):
    rows = [(k, "some Words, " * k) for k in range(40)]
    got = pack(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1), PATH, limit=16, with_ids=True).collect()
    for k, text in rows:
        own = sorted((r for r in got if r.doc_id == k), key=lambda r: r.start)
        assert [i for r in own for i in r.ids] == [*LIBRARY.encode(text, add_special_tokens=False).ids, 1]
        assert all(len(r.ids) == r.length for r in own)
