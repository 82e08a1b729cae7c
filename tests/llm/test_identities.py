import itertools
import random

import pytest

from pyspark.sql import functions as F

from scholia.llm.identities import _classes, edits, link, pairs, parse

USERS = [
    (1, "José Kilsohir", "jose.kilsohir@a.example"),
    (2, "Pepe Kilsohir", "kilsohir.j@mail.example"),
    (3, "KILSOHIR José", None),
    (4, "jkilsohir", "jose.kilsohir+git@A.example"),
    (5, "", "jose.kilsohir@other.example"),
    (6, "J. Kilsohir", "9911+jkilsohir@users.example"),
    (7, "José Kilsoihr", "jose_kilsohir@x.example"),
    (8, "Maria Kilsohir", "maria.kilsohir@a.example"),
    (9, "José Kilsohirr", "jo.kilsohirr7@b.example"),
    (20, "Anna Berg", "team@a.example"),
    (21, "Lars Holm", "team@a.example"),
    (30, "Vikoson Labs Inc.", "dev@vikoson.example"),
    (31, "The Vikoson Laboratories Team", "ci@vikoson.example"),
    (32, "vikoson-laboratories-bot", "ci@vikoson.example"),
    (33, "Vikosom Robotics AG", "dev@vikosom.example"),
    (40, None, None),
    (41, None, None),
    (42, "", ""),
]


def groups(spark, rows):
    df = spark.createDataFrame(rows, "user_id bigint, name string, email string").selectExpr("*", "1 as entity", "2 as form", "'x' as n_commits")
    out = {}
    for r in link(df).distinct().collect():
        out.setdefault(r.entity, set()).add(r.user_id)
    return sorted(map(sorted, out.values()))


def test_groups(spark):
    assert groups(spark, USERS) == [[1, 2, 3, 4, 5, 6, 7], [8], [9], [20], [21], [30, 31, 32], [33], [40], [41], [42]]


def test_edges(spark):
    assert groups(spark, []) == []
    assert groups(spark, [(1, "Anna Berg", None)] * 3 + [(2, "Berg, Anna", "?")]) == [[1, 2]]
    assert groups(spark, [(1, "x" * 5000, None), (2, "…", "@"), (3, "李 明", None), (4, "李 明", None)]) in ([[1], [2], [3, 4]], [[1], [2], [3], [4]])
    hot = [(i, "Anna Berg", "anna.berg@a.example") for i in range(1, 400)] + [(1000 + i, f"{a}o{b}a Dahl{b}{a}qvist", None) for i, (a, b) in enumerate(itertools.product("bdfgklmnpr", "stvwxzbdfg"))]
    assert max(map(len, groups(spark, hot))) == 399


def test_pairs(spark):
    df = spark.createDataFrame([(1, 1), (2, 1), (3, 1), (4, 4), (2, 1)], "user_id bigint, entity bigint")
    assert sorted(map(tuple, pairs(df).collect())) == [(1, 2), (1, 3), (2, 3)]


def test_edits(spark):
    df = spark.createDataFrame([("abc", "abc", 0), ("abc", "acb", 1), ("abc", "ab", 1), ("abc", "xyz", 3), ("ab", "ba", 1)], "a string, b string, d int")
    assert df.where(edits(F.col("a"), F.col("b")) != F.col("d")).count() == 0


def test_parse_handles_anything():
    for name in (None, "", " ", "'", "A", "Ärger", "B.V.", "(x)"):
        for email in (None, "", "@", "a@", "a@b", "no address", "a+b@c.d"):
            assert parse(name, email)["kind"] in ("p", "o")


@pytest.mark.parametrize("times", [5])
def test_errors_do_not_become_names_in_larger_tables(spark, times):
    letters = [a + b for a in "bdfgklmnpr" for b in "stvwxz"]
    rows = [(i, f"Johannes {x.title()}o{x}a", None) for i, x in enumerate(letters)]
    wrong = [(1000 + i, f"Johannnes {x.title()}o{x}a", None) for i, x in enumerate(letters[:times])]
    marie = [(2000 + i, f"{n} {x.title()}u{x}i", None) for i, x in enumerate(letters[:20]) for n in ("Mario", "Maria")]
    found = groups(spark, rows + [(500 + i, n, e) for i, n, e in rows] + wrong + [(3000, "Karla Tamsen", None)] + marie[::2] + [(i + 500, n, e) for i, n, e in marie[1::2]])
    assert [[i, 500 + i, 1000 + i] if i < times else [i, 500 + i] for i in range(60)] == found[:60]
    assert all(len(g) == 1 for g in found[60:]) and len(found) == 60 + 40 + 1


def test_every_kind_of_change_is_undone(spark):
    """What the channel does, one by one, to a name that stands among many others."""
    others = [(1000 + i, f"{a} {b}o{c}ansen", f"{a.lower()}.{b.lower()}o{c}ansen@n{i % 7}.example") for i, (a, b, c) in enumerate(itertools.product(("Robert", "Anna", "Rita", "Karl"), "BDFGKLMT", "bdfgklm"))]
    true = [(1, "Robert Wérdmüller", "robert.werdmueller@a.example"), (2, "Robert Wérdmüller", "rwerdmueller@b.example")]
    changed = {
        "order": ("WÉRDMÜLLER, Robert", None),
        "nickname": ("Bob Werdmüller", "bob@c.example"),
        "transliteration": ("Robert Werdmueller", None),
        "typing error": ("Robert Wedrmüller", None),
        "initial": ("R. Werdmüller", None),
        "handle": ("rwerdmueller", None),
        "address only": ("", "werdmueller.r@d.example"),
        "first name and address": ("Robert", "rwerdmueller@e.example"),
        "first name and initial": ("Robert W.", "robert.werdmueller@f.example"),
        "two errors": ("Robret Wedrmüler", "robert.werdmueller@g.example"),
        "seen address": ("RW", "robert.werdmueller+x@a.example"),
    }
    rows = others + true + [(10 + i, *c) for i, c in enumerate(changed.values())]
    found = next(g for g in groups(spark, rows) if 1 in g)
    assert found == [1, 2, *range(10, 10 + len(changed))], [n for i, n in enumerate(changed) if 10 + i not in found]


def test_doubt_stays_alone(spark):
    rows = [(1, "Anna Berglund", "a.b@x.example"), (2, "Astrid Berglund", "a.c@x.example"), (3, "A. Berglund", None), (4, "Robert", None), (5, "Robert Kolm", None), (6, "Rita Kolm", None)]
    assert groups(spark, rows) == [[1], [2], [3], [4], [5], [6]]


def test_hot_blocks_lend_out_few(spark):
    """Hundreds of people under one name and initial, and a mailbox that everybody uses."""
    letters = [a + b + c for a in "bdfgklm" for b in "aeiou" for c in "stvwxz"]
    rows = [(i, f"Anna S{x}o{x}a", "all@x.example") for i, x in enumerate(letters)] + [(1000 + i, "Anna S.", f"box{i}@y.example") for i in range(50)] + [(2000, "Anna S.", f"s{letters[7]}o{letters[7]}a.anna@z.example")]
    found = groups(spark, rows)
    assert [7, 2000] in found and all(len(g) == 1 for g in found if g != [7, 2000])


def test_no_candidate_is_left_out(spark):
    """Candidates far down in every block they share with a spelling, rivals of one domain, and a mailbox under many names."""
    rows, number = [], itertools.count(1)

    def add(name, email=None, times=1):
        ids = [next(number) for _ in range(times)]
        rows.extend((i, name, email) for i in ids)
        return ids

    # Third of all under either key, first under both together.
    for x in "bdg":
        add(f"Anna Ku{x}o{x}", None, 2)
        add(f"A{x}u{x}o Kolmar", None, 2)
    third = add("Anna Kolmar", None) + add("akolmar", "anna.k@x.example")
    # More frequent than any other of the domain, not than all of them.
    rivals = [add(f"Mario T{x}u{x}e", f"mario.t{x}u{x}e@y.example", 5 if x == "bab" else 1)[0] for x in map("".join, itertools.product("bdfg", "aeiou", "b"))]
    doubtful = add("Mario T.", "box1@y.example")
    # One person's mailbox, with two errors in each of many spellings.
    owner = add("Robert Werdmüller", "werdm7@z.example", 10)
    for x in map("".join, itertools.product("bcdfg", "hjklm")):
        owner += add(f"R{x[0]}bert Werdm{x[1]}ller", "werdm7@z.example")
    # Another's first name as the mailbox of many people.
    crowd = [add(f"Rita V{x}e{x}o{x}", "rita7@z.example", 3 if x == "l" else 1) for x in map("".join, itertools.product("bdfgl", "rstvwmnp"))]
    found = groups(spark, rows)
    assert third in found
    assert doubtful in found and all(any(r in g and doubtful[0] not in g for g in found) for r in rivals)
    assert owner in found
    assert all(g in found for g in crowd)


def test_blocks_stand_for_all_their_candidates(spark):
    """Rows for candidates of equal evidence add up to what a join of everything with everything gives."""
    r = random.Random(3)
    who = {f"c{c}": (r.choice((1, 1, 2, 5)), c // 2, r.random() < 0.7) for c in range(60)}
    lent = [(k, c) for k in "pqr" for c in who if r.random() < 0.6]
    homes = {(c, d) for c in who if who[c][2] for d in "xyz" if r.random() < 0.5}
    wanted = {(f"u{u}", ("", "x", "y", "w")[u % 4], k): (r.random() < 0.7, True) for u in range(40) for k in "pqr"[u % 3 :]}
    known = {(f"u{u}", c) for u in range(40) for c in who if r.random() < (0.02, 0.3, 0.9)[u // 4 % 3]}
    rows = _classes(
        spark.createDataFrame([(*k, *how) for k, how in wanted.items()], "v string, at string, key string, initial boolean, short boolean"),
        spark.createDataFrame([(c, k, *who[c]) for k, c in lent], "c string, key string, n bigint, id bigint, home boolean"),
        spark.createDataFrame(sorted(homes), "c string, at string"),
        spark.createDataFrame(sorted(known), "v string, c string"),
    )
    true: dict = {}
    for (v, at, k), how in wanted.items():
        for key, c in lent:
            if key == k and (v, c) not in known:
                true.setdefault((v, (c, at) in homes, who[c][2], *how, k), []).append((-who[c][0], who[c][1], c))
    got = sorted((q.v, q.domain, q.home, q.initial, q.short, q.m, q.s, q.n, q.id, q.c) for q in rows.collect())
    assert got == sorted((*e[:5], len(cs), -sum(n for n, _, _ in cs), -min(cs)[0], min(cs)[1], min(cs)[2]) for e, cs in true.items())
    assert max(q[5] for q in got) > 10
