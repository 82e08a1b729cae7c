import itertools
import pickle
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from scholia.llm import details
from scholia.llm.pii import KINDS, Model, find_private, fit, redact

FIRST = "Anna Lars Maria Jonas Elena Pavel Greta Hugo Nina Oskar".split()
LAST = "Holmberg Vikander Castellani Brandis Nowicki Oduya Ferreira Lindqvist Tanaka Moreau Kessler Ivanova".split()


def sample(n, seed):
    """Texts with their kinds, from templates."""
    r = random.Random(seed)
    out = []
    for _ in range(n):
        d = lambda k: "".join(r.choice("0123456789") for _ in range(k))
        person = f"{r.choice(FIRST)} {r.choice(LAST)}"
        mail = f"{r.choice(FIRST).lower()}.{r.choice(LAST).lower()}@firm{d(1)}.example"
        out.append(
            r.choice(
                [
                    (f"// TODO: ask {mail} before removing run_fast()", {"email"}),
                    (f"// TODO: ask {mail.replace('@', '[at]')} before removing this", {"email"}),
                    (f"# FIXME: call {person}, +49 (0)30 23125 {d(3)}, if it hangs", {"person_name", "phone"}),
                    (f"# on-call for parser: 850-555-0{d(3)} x{d(3)}", {"phone"}),
                    (f"// fixture still holds SSN {d(3)}-{d(2)}-{d(4)}", {"id_number"}),
                    (f"// remove customer record CPF {d(3)}.{d(3)}.{d(3)}-{d(2)}", {"id_number"}),
                    (f"// ships to {d(3)} Lake Ave, Apt {d(2)}, Springville {d(5)} by default", {"address"}),
                    (f"// per review of {person}: drop it", {"person_name"}),
                    (f"// it reads rows {d(3)}-{d(3)}-{d(4)} in the wrong order", set()),
                    (f"// needs build {d(10)} or newer", set()),
                    ("// rename Main Loop in run_it() to Event Loop", set()),
                    ("// Document How The Parser Works For Every File", set()),
                    (f"// pin lib@{d(1)}.{d(2)}.{d(1)} until the loader is fixed", set()),
                    (f"// the limit of {d(2)} entries was only a guess, @{r.choice(FIRST).lower()}x", set()),
                ]
            )
        )
    return out


@pytest.fixture(scope="module")
def model():
    names = [f"{a} {b}" for a in FIRST for b in LAST]
    return fit([t for t, _ in sample(3000, 1)], names)


def test_held_out_accuracy(model):
    data = sample(1500, 2)
    wrong = [(t, k, f) for (t, k), f in zip(data, model.find([t for t, _ in data])) if {x for _, _, x in f} != k]
    assert len(wrong) <= 0.01 * len(data), wrong[:5]


def test_repeated_names_are_found_in_both_places(model):
    text = "// per review of Anna Holmberg: drop it; Anna Holmberg"
    assert [text[a:b] for a, b, k in model.find([text])[0] if k == "person_name"][:1] == ["Anna Holmberg"]


@pytest.mark.parametrize(
    ("text", "kind", "value"),
    [
        ("SSN: 123-45-6789 ok", "id_number", "123-45-6789"),
        ("call +1 212 5550123", "phone", "+1 212 5550123"),
        ("tel 010-1234-5678", "phone", "010-1234-5678"),
        ("tel 030 334 7788 / 030 334 9911", "phone", "030 334 7788"),
        ("Lives at 221B Baker Street, London NW1 6XE", "address", "221B Baker Street, London NW1 6XE"),
        ("NHS number 943 476 5919", "id_number", "943 476 5919"),
        ("ask Иван Петров", "person_name", "Иван Петров"),
        ("Marco di Stefano wrote it", "person_name", "Marco di Stefano"),
        ("ask anna holmberg", "person_name", "anna holmberg"),
        ("thanks to Greta  Moreau for this", "person_name", "Greta  Moreau"),
        ("thanks to Greta\nMoreau for this", "person_name", "Greta\nMoreau"),
    ],
)
def test_formats_that_no_label_pattern_knows(model, text, kind, value):
    assert (value, kind) in [(text[a:b], k) for a, b, k in model.find([text])[0]]


def without_skips(model):
    other = pickle.loads(pickle.dumps(model))
    other.skip = np.zeros_like(model.skip)
    return other


def test_skip_edges_decide_doubtful_repetitions(model):
    r = random.Random(99)
    data = [details.joined(details.sentence(r, [])) for _ in range(4000)]
    twice = [(t, s) for t, s in data if len(s) == 2 and t[slice(*s[0][:2])] == t[slice(*s[1][:2])]]

    def right(m):
        found = m.find([t for t, _ in twice])
        return [{(a, b, KINDS[k - 1]) for a, b, k in s} == set(f) for (_, s), f in zip(twice, found)]

    tied, alone = right(model), right(without_skips(model))
    assert len(twice) > 500 and sum(tied) >= 0.85 * len(twice)
    assert sum(a and not b for a, b in zip(tied, alone)) >= 5 and sum(tied) > sum(alone)


def test_beliefs_are_marginals():
    r = np.random.RandomState(0)
    m = Model({}, {}, {}, move=r.randn(6, 6).astype(np.float32), skip=r.randn(6, 6).astype(np.float32))
    e = r.randn(4, 6).astype(np.float32)
    # One edge beside a chain without potentials makes a tree, where message passing is exact.
    for move, skip in ((m.move, (np.array([], int), np.array([], int))), (np.zeros((6, 6), np.float32), (np.array([0]), np.array([3])))):
        m.move = move
        exact = np.zeros((4, 6))
        for y in itertools.product(range(6), repeat=4):
            score = sum(e[i, y[i]] for i in range(4)) + sum(move[y[i], y[i + 1]] for i in range(3)) + sum(m.skip[y[a], y[b]] for a, b in zip(*skip))
            for i in range(4):
                exact[i, y[i]] += np.exp(score)
        found, pairs, tied = m.beliefs(e, np.array([0, 4]), skip, pairs=True)
        assert np.allclose(np.exp(found), exact / exact.sum(axis=1, keepdims=True), atol=1e-4)
        assert pairs.sum() == pytest.approx(3, abs=1e-3) and tied.sum() == pytest.approx(len(skip[0]), abs=1e-3)


def test_edges(model):
    assert model.find(["", "x", "…", "9" * 3000, "@ @ @"]) == [[], [], [], [], []] or model.find([""]) == [[]]
    assert model.find([]) == []
    long = "word " * 20_000 + "ask anna.holmberg@firm1.example before removing this"
    assert [k for _, _, k in model.find([long])[0]] == ["email"]


def test_table(spark, model):
    text = "// TODO: ask anna.holmberg@firm1.example before removing this"
    rows = [(1, text, None), (2, None, "Anna"), (3, "", text), (1, text, None)]
    df = spark.createDataFrame(rows, "task_id bigint, text string, label string").selectExpr("*", "1 as field", "2 as start", "3 as kind")
    fields = {"text": F.col("text"), "label": F.col("label")}
    got = sorted((r.task_id, r.field, r.kind) for r in find_private(df, model, "task_id", fields).collect())
    assert got == [(1, "text", "email"), (1, "text", "email"), (3, "label", "email")]
    clean = {r.task_id: (r.text, r.label) for r in redact(df, model, "task_id", fields).collect()}
    assert clean == {1: ("// TODO: ask [email] before removing this", None), 2: (None, "Anna"), 3: ("", "// TODO: ask [email] before removing this")}
    assert find_private(df.limit(0), model, "task_id", fields).count() == 0
