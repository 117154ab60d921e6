import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from fieldweave.llm.token_counts import Counter, merged_count, token_counts

PATH = public_tokenizers.path("byte_bpe_50k.json")
LIBRARY, OWN = Tokenizer.from_file(PATH), Counter(PATH)
TEXTS = ["", "Hello world's best, 12 3", "a  b\n\nc \n d\t\te ", "<|endoftext|>x <|endoftext|>", " lead", "\n", "x" * 5000, "été naïve ß ñ", "日本語 テスト", "🙂   \x1c\x85 z", "don't we'll I'm\n'd", "!!!??? ...\nA line.\nAnother line"]


def test_counts_are_the_library_s():
    for text in TEXTS:
        assert OWN.count(text) == len(LIBRARY.encode(text, add_special_tokens=False).ids), text


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="abe th.,'\n1é <|>", max_size=60) | st.text(max_size=30).filter(lambda t: t.isprintable()))
def test_any_text(text):
    assert OWN.count(text) == len(LIBRARY.encode(text, add_special_tokens=False).ids)


def test_merges_by_rank_then_leftmost():
    assert merged_count(list("aaa"), {("a", "a"): 0}) == 2
    assert merged_count(list("abc"), {("a", "b"): 1, ("b", "c"): 0, ("a", "bc"): 2}) == 1
    assert merged_count([], {}) == 0


def test_rows(spark):
    rows = [(1, "two words", 0), (1, "two words", 0), (None, None, 0), (2, "w " * 600, 0)]
    got = sorted(token_counts(spark.createDataFrame(rows, "doc_id long, text string, n_tokens long"), PATH).collect(), key=lambda r: (r.doc_id or 0, r.n_bytes))
    assert [(r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) for r in got] == [(None, 0, 0, False), (1, 9, 2, False), (1, 9, 2, False), (2, 1200, 601, True)]
    assert token_counts(spark.createDataFrame([], "doc_id long, text string"), PATH).count() == 0
