import os

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from scholia.llm.bpe import TOKENIZER_DIR, Encoder, PrefixEncoder, TextEncoder, encoder
from scholia.llm.encode import count_tokens, encode_corpus

pytestmark = pytest.mark.skipif(not os.path.isdir(TOKENIZER_DIR), reason="no vocabulary files here")


@pytest.fixture(scope="module")
def public():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(os.path.join(TOKENIZER_DIR, "byte_bpe_50k.json"))
    t.encode_special_tokens = True
    return lambda text: t.encode(text, add_special_tokens=False).ids


TEXTS = ["", "a", " a  b\n\n\tc ", "don't won't I'll 'sx", "<|endoftext|>", "日本語のテキスト。한국어", "é́ 　\xa0x\x1c\x1dy", "a" * 700, " " * 99 + "x", "x = foo(bar[12345]) # ½ ℃ ✓", "😀😃 \U0001f468‍\U0001f469"]


@pytest.mark.parametrize("text", TEXTS)
def test_ids(public, text):
    assert encoder().encode(text) == public(text)


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=60))
def test_any_text(public, text):
    assert encoder().encode(text) == public(text)
    assert encoder().decode(encoder().encode(text)).decode() == text


@settings(max_examples=60, deadline=None)
@given(st.text("abcdeé ", max_size=20), st.integers(0, 20), st.integers(0, 20), st.text("abcd", max_size=5))
def test_appends_and_edits_are_exact(text, a, b, new):
    v, data = encoder().vocabulary, text.encode()
    a, b = sorted((min(a, len(data)), min(b, len(data))))
    grown = PrefixEncoder(v)
    for i in range(len(data)):
        grown.append(data[i : i + 1])
        assert grown.ids() == PrefixEncoder(v, data[: i + 1]).ids()
    grown.edit(a, b, new.encode())
    assert grown.ids() == PrefixEncoder(v, data[:a] + new.encode() + data[b:]).ids()


@settings(max_examples=150, deadline=None)
@given(st.text("ab1 \n'té", max_size=30), st.integers(0, 30), st.integers(0, 30), st.text("ab1 \n's", max_size=5), st.text("a \n't", max_size=4))
def test_whole_texts_are_edited_exactly(text, a, b, new, more):
    a, b = sorted((min(a, len(text)), min(b, len(text))))
    changed = TextEncoder(encoder(), text)
    changed.edit(a, b, new)
    assert changed.text == text[:a] + new + text[b:] and changed.ids() == encoder().encode(changed.text)
    changed.append(more)
    assert changed.ids() == encoder().encode(text[:a] + new + text[b:] + more)


def test_an_edit_redoes_little():
    changed = TextEncoder(encoder(), "the cat sat on the mat. " * 2_000)
    assert changed.edit(24_000, 24_003, "dog") < 10 and changed.ids() == encoder().encode(changed.text)


def test_a_small_cache_changes_nothing(public):
    small = Encoder(os.path.join(TOKENIZER_DIR, "byte_bpe_50k.json"), cache_size=3)
    for text in [*TEXTS, *TEXTS, "a b c d e f g h a b c d"]:
        assert small.encode(text) == public(text)


def test_corpus(spark, public):
    rows = [(i, t, "clash", None) for i, t in enumerate(TEXTS)] + [(50, None, "x", 1), (50, None, "x", 1), (None, "a b", "x", 1)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, ids string, id int")
    got = {r.doc_id: r.ids for r in encode_corpus(df).collect()}
    assert got == {i: public(t) for i, t in enumerate(TEXTS)} | {50: [], None: public("a b")}
    assert encode_corpus(df).count() == len(rows) and encode_corpus(df.limit(0)).count() == 0
    assert {r.doc_id: r.n_tokens for r in count_tokens(df).collect()} == {k: len(v) for k, v in got.items()}


@settings(max_examples=150, deadline=None)
@given(st.text(st.characters(max_codepoint=127), max_size=40) | st.text("a1 '\n\tstrevmld\x1c.", max_size=40))
def test_plain_pattern_is_the_pattern(text):
    assert encoder().split_plain(text) == encoder().split(text)
    assert encoder().words(text + "é") == encoder().split(text + "é")
