import os

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from scholia.llm.bpe import TOKENIZER_DIR, Encoder, encoder
from scholia.llm.splitting import Units, merge, split_all, split_text, split_texts

pytestmark = pytest.mark.skipif(not os.path.isdir(TOKENIZER_DIR), reason="no vocabulary files here")
LIMITS = [(80, 16), (80, 0), (128, 16), (300, 64)]


def check(text):
    encode = encoder()
    for (most, overlap), pieces in zip(LIMITS, split_text(text, LIMITS, encode)):
        assert bool(pieces) == (encode.count(text) > most)
        if pieces:
            assert "".join(text[own:end] for _, own, end, _ in pieces) == text
        for k, (start, own, end, n) in enumerate(pieces):
            assert n == encode.count(text[start:end]) and n <= most
            if k == 0 or not overlap:
                assert start == own
            else:
                assert start == 0 or encode.count(text[start:own] + "x") >= overlap


@settings(max_examples=80, deadline=None)
@given(st.lists(st.sampled_from(["The quick fox. ", "one, two; three\n", "\n\n", "日本語です。", "abc", " ", "\t", "don't ", "x" * 90, "!?", "😀", "\r\n", "12345 "]), max_size=120))
def test_pieces(parts):
    check("".join(parts))


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 12), st.integers(0, 3)), min_size=1, max_size=25), st.integers(12, 40))
def test_merging_is_weakest_boundary_first(parts, most):
    left = [(i + 1, n, grade) for i, (n, grade) in enumerate(parts)]
    found = merge(left, most)
    while pairs := [(a[2], a[1] + b[1], i) for i, (a, b) in enumerate(zip(left, left[1:])) if a[1] + b[1] <= most]:
        _, total, i = min(pairs)
        left[i : i + 2] = [(left[i + 1][0], total, left[i + 1][2])]
    assert found == left


@pytest.mark.parametrize("text", ["x" * 5000, "日本語" * 900, "a\n\n" * 700, "  " * 900 + "b", "😀" * 300, "the cat. " * 2000, "\n" * 3000])
def test_long_texts(text):
    check(text)


def test_natural_boundaries_come_first():
    text = "\n\n".join("word " * 30 + f"end{i}." for i in range(12))
    for _, own, _, _ in split_text(text, [(80, 0)], encoder())[0][1:]:
        assert text[:own].endswith("\n\n")
    sentences = " ".join(f"This is sentence number {i} of the text." for i in range(60))
    for _, own, _, _ in split_text(sentences, [(80, 0)], encoder())[0][1:]:
        assert sentences[:own].endswith(".")


def test_table(spark):
    rows = [(1, "the cat sat. " * 100), (2, "short"), (3, None), (4, ""), (1, "the cat sat. " * 100)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr("*", "1 as id", "2 as piece", "3 as n_tokens")
    got = split_texts(df, [(7, 128, 16), (9, 1000, 0)]).collect()
    assert {r.doc_id for r in got} == {1} and {r.limit_id for r in got} == {7}
    first = sorted({(r.piece, r.own_start, r.end, r.text) for r in got})
    assert "".join(rows[0][1][a:b] for _, a, b, _ in first) == rows[0][1] and len(got) == 2 * len(first)
    assert split_texts(df.limit(0), [(7, 128, 16)]).count() == 0
    with pytest.raises(ValueError):
        split_text("x", [(100, 90)], encoder())


@pytest.mark.parametrize("unit", ["The cat sat down. ", "one, two; three four five, six\n", "A line of words here\nand one more. "])
def test_pieces_of_a_limit_do_not_depend_on_the_others(unit):
    encode = encoder()
    text = "\n\n".join(unit * (1 + 7 * i % 13) + "word, " * (i * 31 % 90) for i in range(40))
    limits = [(128, 16), (512, 64), (1024, 128), (80, 0)]
    for limit, pieces in zip(limits, split_text(text, limits, encode)):
        assert pieces and pieces == split_text(text, [limit], encode)[0]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.sampled_from(["The quick fox. ", "one, two; three\n", "\n\n", "日本語です。", " ", "x" * 90, "!?", "😀" * 40, "\r\n", "\x1c", "12345 "]), min_size=1, max_size=90).map("".join), max_size=6))
def test_texts_worked_on_together_are_split_as_each_alone(texts):
    encode = encoder()
    for k, (text, start, own, end, n) in enumerate(split_all(texts, LIMITS, encode)):
        found = [[] for _ in texts]
        for i, *piece in zip(text, start, own, end, n):
            found[i].append(tuple(piece))
        assert found == [split_text(t, LIMITS, encode)[k] for t in texts]


def test_counting_packs_no_ids():
    encode = Encoder(os.path.join(TOKENIZER_DIR, "byte_bpe_50k.json"))
    texts = ["zimibimaze `kegitata`, tepuritela(rows) 18662191f5dde261e8982d90d1fa477b0f4564fe", "Katapuseha[]: dejalihili é"]
    units = Units(texts, encode)
    assert not encode.cache
    assert units.totals.tolist() == [encode.count(t) for t in texts]
