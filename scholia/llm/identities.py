"""Variant spellings of people's and organisations' names, attributed through a noisy channel.

Every row is a spelling: a name and an address as someone typed them. Names typed in full (or an
organisation's domain) are candidates for canonical forms, ranked by their frequency. Every other
spelling is what the channel made of one of them: words in another order, a nickname, another
transliteration, a typing error, an initial in place of a name, a handle, or nothing but an address made
of the name. Keys of blocks only decide who meets whom. A spelling goes to the candidate of maximum
posterior: the frequency prior times the likelihoods of what happened to name, address and
domain, and of what the words would look like if this were somebody else; where two candidates
are about as probable it stays by itself. The likelihoods are estimated from the collection in a
second round, from the attributions of the first.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scholia.plans.tables import materialize

#: Short forms of first names.
NICKNAMES = {
    short: full
    for full, shorts in {
        "alexander": "alex sasha xander", "andrew": "andy drew", "benjamin": "ben benny", "charlotte": "lottie charlie", "christopher": "chris kit",
        "daniel": "dan danny", "ekaterina": "katya katia", "elizabeth": "liz beth betty lizzie", "francisco": "paco pancho", "frederik": "fred freddy",
        "giuseppe": "beppe pino", "guadalupe": "lupe lupita", "jennifer": "jen jenny", "johannes": "hannes hans", "jonathan": "jon jonny",
        "jose": "pepe", "katherine": "kathy kate katie", "magdalena": "lena magda", "margaret": "peggy maggie meg", "michael": "mike micha",
        "mikhail": "misha", "nicholas": "nick nicky", "patricia": "pat patty trish", "robert": "rob bob bobby", "stanislaw": "stas staszek",
        "susanna": "susie sanna sue", "theodore": "theo ted", "thomas": "tom tommy", "victoria": "vicky tori", "william": "will bill billy",
        "wojciech": "wojtek", "zachary": "zach zack",
    }.items()
    for short in shorts.split()
}
_TITLES = {"dr", "mr", "mrs", "ms", "prof", "herr", "frau", "sr", "sra", "jr"}
_PARTICLES = {"van", "von", "de", "der", "den", "del", "della", "di", "da", "la", "le", "dos", "du", "ter", "ten"}
_ORG_FORMS = {"inc", "llc", "gmbh", "ag", "ltd", "corp", "co", "plc", "bv", "sa", "srl", "oy", "ab", "kg"}
_ORG_WORDS = _ORG_FORMS | {
    "labs", "lab", "laboratories", "laboratory", "tech", "technologies", "technology", "software", "sw", "systems", "sys", "robotics", "robot",
    "networks", "network", "net", "research", "institute", "ri", "foundation", "found", "fdn", "team", "bot", "group", "university", "company",
}
_STRIP = str.maketrans({"ı": "i", "ł": "l", "ø": "o", "ß": "ss", "đ": "d", "æ": "ae", "œ": "oe", "þ": "th", "ð": "d", "'": "", "’": "", "‐": "", "-": ""})
_UMLAUTS = str.maketrans({"ä": "ae", "ö": "oe", "ü": "ue"})
#: Mailboxes that belong to nobody in particular.
_ROLES = set(
    "team teams eng hello build builds dev devs info contact release releases ci bot bots oss admin noreply support office mail all help root ops jobs "
    "security git github gitlab code sales service webmaster postmaster abuse billing legal press hr it me us staff list lists".split()
)
#: (probability where both are the same, where they are not) of each piece of evidence, before the collection is looked at:
#: the address was seen with the candidate, is made of its full name, of a name and an initial, is unlike it; the name has
#: one name and an initial of it; the domains agree, differ.
EVIDENCE = {"same": (0.3, 0.0007), "made": (0.3, 0.002), "short": (0.3, 0.01), "unlike": (0.05, 0.5), "initial": (0.3, 0.01), "domain": (0.5, 0.04), "elsewhere": (0.3, 0.5)}
#: What blocks are made of is frequent among the pairs that meet, so only its first probability is estimated from them.
KEYS = ("same", "made", "short", "initial")
#: Pairs that these count as when the collection's own are added.
BELIEF = 500
#: Natural logs of an edit in a given place of a word, of a letter of a word nobody else has, of names that hardly agree, and
#: of a typing error that comes about as often as the right form or stands in the address too.
EDIT, LETTER, MANGLED, PART, UNRELATED, HABIT = math.log(0.02 / 50), -2.0, -2.0, -3.0, -12.0, -20.0
#: The same of an address that another candidate explains.
MINE = -8.0
#: How much more probable than all others together the best candidate must be, as a natural log.
MARGIN = 0.7
#: Of two words that differ by a typing error, up to this share of the right one's partners may be errors, however many rows there are.
ERROR_SHARE = 0.1

def fold(text: str) -> str:
    """Lower case without accents, apostrophes and hyphens."""
    text = unicodedata.normalize("NFKD", text.lower().replace("i̇", "i").translate(_STRIP))
    return "".join(c for c in text if not unicodedata.combining(c))


def _tokens(name: str, umlauts: bool) -> list[str]:
    lowered = unicodedata.normalize("NFC", name.lower())
    return re.findall(r"[^\W\d_]+", fold(lowered.translate(_UMLAUTS) if umlauts else lowered))


def _address(email: str | None) -> tuple[str, str]:
    """(local part, domain) in lower case, without tags and the number of a forwarding address."""
    found = re.search(r"([\w.+'%-]+)@([\w.-]+)", (email or "").lower())
    if not found:
        return "", ""
    local = re.sub(r"^\d+\+", "", found.group(1))
    return re.sub(r"\+.*", "", local).strip("."), found.group(2).strip(".")


def squash(word: str) -> str:
    """Transliterated umlauts as the plain vowel."""
    return word.replace("ae", "a").replace("oe", "o").replace("ue", "u")


def _initials(words: list[str]) -> list[str]:
    """``last|initial`` keys of a full name; either word may be the last name, and nicknames have two initials."""
    out = set()
    for a, b in (words, words[::-1]):
        out.update((f"{squash(b)}|{a[0]}", f"{squash(NICKNAMES.get(b, b))}|{NICKNAMES.get(a, a)[0]}", f"{squash(b)}|{NICKNAMES.get(a, a)[0]}"))
    return sorted(out)


def _handle(letters: str) -> list[str]:
    """``last|initial`` keys of a name and one initial written as one word."""
    return [f"{squash(letters[1:])}|{letters[0]}", f"{squash(letters[:-1])}|{letters[-1]}"] if len(letters) > 4 else []


def parse(name: str | None, email: str | None) -> dict:
    """What a spelling says.

    ``kind`` p or o; ``typed`` the two words of a full name as typed, ``words`` the same without
    nicknames and transliterations in alphabetic order (an organisation's first word and the
    begin of its second); ``written`` which of ``words`` the address holds; ``names`` and
    ``initials`` what the spelling, if it has no full name, may be short for; ``made`` and ``short``
    the same for its address; ``address`` if it is a personal one, and ``domain``.
    """
    name, (local, domain) = (name or "").strip(), _address(email)
    inside = re.sub(r"\(.*?\)|\[.*?\]", " ", name)
    inside = re.sub(rf"\b({'|'.join(sorted(_PARTICLES))})(?=[A-ZÀ-Þ])", r"\1 ", inside)
    words = [w for w in _tokens(re.sub(r"\bB\.?\s*V\b\.?", " bv ", re.sub(r"\bS\.?\s*A\b\.?", " sa ", inside), flags=re.I) if not inside.islower() else inside, False)]
    hyphenated = re.findall(r"[a-z]+", inside.lower()) if re.fullmatch(r"[a-z]+(-[a-z]+)*-bot", inside.lower()) else []
    out: dict = {"kind": "p", "typed": "", "words": [], "written": [], "names": [], "initials": [], "made": [], "short": [], "address": "", "domain": domain}
    if hyphenated or len(words) > 1 and _ORG_WORDS.intersection(words):
        base = [w for w in (hyphenated or words) if w != "the" and w not in _ORG_FORMS and w not in ("team", "bot") and len(w) > 1]
        out |= {"kind": "o", "words": [base[0], (base + [""])[1][:3]] if base else []}
        return out | {"written": [w in domain for w in out["words"]]}
    plain = [t for t in _tokens(inside, False) if t not in _TITLES]
    long = [t for t in plain if len(t) > 1 and t not in _PARTICLES]
    particles = "".join(t for t in plain if t in _PARTICLES)
    letters = re.sub(r"[^a-z]", "", fold(local))
    parts = [p for p in (re.sub(r"[^a-z]", "", fold(p)) for p in re.split(r"[._-]+", local)) if p]
    personal = bool(letters) and local not in _ROLES
    if len(long) >= 2:
        typed = [long[0], long[-1]]
        norm = [squash(NICKNAMES.get(w, w)) for w in typed]
        order = sorted((0, 1), key=lambda i: norm[i])
        # A mailbox that has nothing of its user's name is shared and identifies nobody.
        marks = {t[:3] for u in (False, True) for t in _tokens(inside, u) if len(t) > 1}
        personal = personal and any(m in letters or m in squash(letters) for m in marks | {n[:3] for n in norm})
        out |= {"typed": " ".join(typed), "words": [norm[i] for i in order], "initials": _initials(typed)}
        out["written"] = [personal and (typed[i] in letters or norm[i] in squash(letters)) for i in order]
        joined = {x + y for a, b in ((typed[0], typed[1]), (NICKNAMES.get(typed[0], typed[0]), typed[1])) for x, y in ((a, b), (b, a))}
        if particles:
            joined |= {x for a, b in ((typed[0], typed[1]),) for x in (a + particles + b, particles + a + b, particles + b + a)}
        out["names"] = sorted({squash(j) for j in joined})
    else:
        initials = [t for t in plain if len(t) == 1]
        if len(long) == 1:
            out["initials"] = sorted({f"{squash(long[0])}|{i}" for i in initials} | set(_handle(long[0]) if not initials and name.islower() else ()))
            if not initials and len(long[0]) >= 7:
                out["names"] = [squash(long[0])]
    if personal:
        out["address"] = f"{local}@{domain}"
        if not re.search(r"\d", local) and len(letters) >= 7:
            made = {squash(letters)}
            if len(parts) == 2 and min(map(len, parts)) >= 3:
                a, b = (NICKNAMES.get(p, p) for p in parts)
                made |= {squash(a + b), squash(b + a)}
            out["made"] = sorted(made)
        if len(parts) == 2:
            out["short"] = sorted({f"{squash(b)}|{a[0]}" for a, b in (parts, parts[::-1]) if len(a) <= 2 < len(b)})
        elif len(parts) == 1 and not re.search(r"\d[a-z]", local):
            out["short"] = _handle(letters)
        if len(long) == 1:
            # A first name and an address of the other name complete each other.
            whole = {squash(w + x) for x, i in (s.split("|") for s in out["short"]) if i == long[0][0] and all(x[0] == t for t in plain if len(t) == 1) for w in (long[0], NICKNAMES.get(long[0], long[0]))}
            out["made"] = sorted({*out["made"], *whole})
    return out


_ARRAY = T.ArrayType(T.StringType())
_SCHEMA = (
    "form bigint, n bigint, name string, email string, kind string, typed string, words array<string>, written array<boolean>, names array<string>, initials array<string>, "
    "made array<string>, short array<string>, address string, domain string"
)


def _parsed(users: DataFrame) -> DataFrame:
    """Distinct spellings with their parse, number of rows and smallest id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        text, many = pa.string(), pa.list_(pa.string())
        kinds = {"kind": text, "typed": text, "words": many, "written": pa.list_(pa.bool_()), "names": many, "initials": many, "made": many, "short": many, "address": text, "domain": text}
        for batch in batches:
            rows = [parse(n, e) for n, e in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(3), batch.column(1), batch.column(2), *(pa.array([r[k] for r in rows], kind) for k, kind in kinds.items())], ["form", "n", "name", "email", *kinds])

    forms = users.groupBy("name", "email").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("n")).select("id", "name", "email", "n")
    return forms.mapInArrow(run, _SCHEMA)


def edits(a: Column, b: Column) -> Column:
    """Edit distance of two words, 1 where two letters have changed places."""
    letters = lambda x: F.array_sort(F.split(x, ""))
    far = F.levenshtein(a, b)
    return F.when((far == 2) & (F.length(a) == F.length(b)) & (letters(a) == letters(b)), 1).otherwise(far)


def _deletions(word: Column) -> Column:
    """The word, and the word without each of its letters."""
    return F.concat(F.array(word), F.transform(F.sequence(F.lit(1), F.length(word)), lambda i: F.concat(F.substring(word, F.lit(1), i - 1), F.substring(word, i + 1, F.length(word)))))


def _weights(counted: dict[str, tuple[float, float]]) -> dict[str, float]:
    """Log likelihood ratio of each piece of evidence."""
    return {k: math.log(same) - math.log(other) for k, (same, other) in counted.items()}


def _weigh(df: DataFrame, weights: dict[str, float]) -> DataFrame:
    """``p``: the log posterior, up to a constant, of each (v, c)."""
    told = {k: weights[k] - F.col("crowd") if k == "same" else F.lit(weights[k]) for k in ("same", "made", "short")}
    strongest = F.greatest(*(F.when(F.col(k), w).otherwise(0.0) for k, w in told.items()), F.lit(0.0))
    others = sum((F.when(F.col(k), F.lit(weights[k])).otherwise(0.0) for k in ("unlike", "initial")), F.when(F.col("domain"), weights["domain"]).when(F.col("elsewhere"), weights["elsewhere"]).otherwise(0.0))
    return df.withColumn("p", F.log(F.col("n").cast("double")) + F.col("name_p") + strongest + others)


def _best(df: DataFrame, of: str = "c") -> DataFrame:
    """(v, b) of the candidates of maximum posterior that stand out from all others together and from somebody new; ``of`` holds what counts as one."""
    top, order = F.struct("p", "c", F.least("m", F.lit(1.0)).alias("m"), *EVIDENCE), F.struct("p", (-F.col("id")).alias("i"))
    p = F.least("p", F.lit(60.0))
    # A row stands for m candidates of the same evidence, s times together, of whom it names the most frequent.
    one = df.groupBy("v", of).agg(F.max(order).alias("o"), F.max_by(top, order).alias("b"), F.sum(F.exp(p)).alias("own"), F.sum(F.exp(p) * (F.col("s") / F.col("n") - 1)).alias("more"))
    ranked = one.groupBy("v").agg(F.max_by(F.struct("b", "own"), "o").alias("t"), F.sum("own").alias("every"), F.sum("more").alias("more"))
    others = F.greatest(F.col("every") - F.col("t.own"), F.lit(0.0)) + F.col("more")
    return ranked.where((F.col("t.b.p") > 0) & (F.col("t.b.p") - F.log(others + 1e-9) >= MARGIN)).select("v", F.col("t.b").alias("b"))


def _counted(pairs: DataFrame) -> dict[str, float]:
    """Log likelihood ratios with the evidence of pairs that are and are not chosen by those of ``EVIDENCE``."""
    counts = lambda df: df.agg(*(F.coalesce(F.sum(x * F.col("m")), F.lit(0.0)).alias(k) for k, x in [("all", F.lit(1)), *((k, F.col(k).cast("long")) for k in EVIDENCE)])).first()
    every, chosen = counts(pairs), counts(_best(_weigh(pairs, _weights(EVIDENCE))).select("b.*"))

    def shares(k: str) -> tuple[float, float]:
        same, other = EVIDENCE[k]
        same = (BELIEF * same + chosen[k]) / (BELIEF + chosen["all"])
        return same, other if k in KEYS else (BELIEF * other + every[k] - chosen[k]) / (BELIEF + every["all"] - chosen["all"])

    return _weights({k: shares(k) for k in EVIDENCE})


def attribute(pairs: DataFrame) -> DataFrame:
    """(v, c): each variant with its candidate of maximum posterior.

    ``pairs`` has v, c, id (breaks ties), n (the candidate's frequency), m and s (how many candidates the row
    stands for, and their frequency together), name_p, crowd and a column for each piece of evidence. Attributes
    once with the likelihoods of ``EVIDENCE``, counts the evidence of pairs that were and were not
    chosen, and attributes again with these counts added.
    """
    pairs = materialize(pairs)
    return _best(_weigh(pairs, _counted(pairs))).select("v", F.col("b.c").alias("c"))


def _follow(steps: DataFrame, nodes: DataFrame) -> DataFrame:
    """(v, root): where each node ends up if every step (v, c) is followed; steps only go up in rank, so they end."""
    at = nodes.select("v", F.col("v").alias("root")).join(steps, "v", "left").select("v", F.coalesce("c", "root").alias("root"))
    while True:
        onward = steps.select(F.col("v").alias("root"), F.col("c").alias("next"))
        moved = materialize(at.join(onward, "root", "left").select("v", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        at = moved.select("v", "root")
        if not moved.where("moved").limit(1).count():
            return at


def _settle(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """(v, root): like ``attribute`` where candidates may themselves be variants of each other, with every step followed.

    Candidates that are found to be the same do not compete. At first everything goes to its most
    probable candidate; whatever does not stand out from those that end up elsewhere is taken back, until nothing is.
    """
    pairs = materialize(pairs)
    weighed = materialize(_weigh(pairs, _counted(pairs)))
    steps = materialize(weighed.where("p > 0").groupBy("v").agg(F.max_by("c", F.struct("p", (-F.col("id")).alias("i"))).alias("c")))
    known = steps.count()
    while True:
        at = _follow(steps, nodes)
        ends = at.select(F.col("v").alias("c"), "root")
        steps = materialize(_best(weighed.join(ends, "c"), "root").select("v", F.col("b.c").alias("c")))
        if (left := steps.count()) >= known:
            return at
        known = left


def _canonical(forms: DataFrame) -> DataFrame:
    """(w, id, n, kind, home, a, b, a_written, b_written, a_d, b_d, rank): canonical forms with their frequency and smallest form.

    ``a_d`` and ``b_d`` are the numbers of forms that hold these words. Forms are ranked by their
    frequency; equally frequent ones by how common their words are, then by whether addresses hold them.

    Full names that agree but for order, case, accents, nickname and transliteration are one
    canonical form from here on: against somebody else of the same words, these likelihoods
    leave no doubt. An organisation is known by its domain, or by its words where it has none.
    """
    most = F.max_by("words", F.struct("n", (-F.col("form")).alias("f")))
    spelt = forms.where(F.col("w").isNotNull()).groupBy("w", "words").agg(F.sum("n").alias("n"), F.min("form").alias("form"), F.first("kind").alias("kind"), F.max(F.col("domain") != "").alias("home"), F.max(F.element_at("written", 1)).alias("x"), F.max(F.element_at("written", 2)).alias("y"))
    whole = spelt.groupBy("w").agg(F.min("form").alias("id"), F.sum("n").alias("n"), F.min("kind").alias("kind"), F.max("home").alias("home"), most.alias("words"), F.max("x").alias("a_written"), F.max("y").alias("b_written"))
    whole = whole.select("w", "id", "n", "kind", "home", F.col("words")[0].alias("a"), F.col("words")[1].alias("b"), "a_written", "b_written")
    word = whole.select("kind", F.explode(F.array_distinct(F.array("a", "b"))).alias("word")).groupBy("kind", "word").agg(F.count(F.lit(1)).alias("d"))
    for p in ("a", "b"):
        whole = whole.join(word.select("kind", F.col("word").alias(p), F.col("d").alias(f"{p}_d")), ["kind", p], "left")
    held = F.coalesce(F.col("a_written").cast("int"), F.lit(0)) + F.coalesce(F.col("b_written").cast("int"), F.lit(0))
    rank = F.struct("n", F.coalesce(F.col("a_d") + F.col("b_d"), F.lit(0)).alias("d"), held.alias("held"), "w")
    return whole.withColumn("rank", rank)


def _name_likelihood(pairs: DataFrame, roots: DataFrame) -> DataFrame:
    """``name_p`` of each (v, c): how probable the channel makes v's words of c's, against v's words being somebody's own.

    A word that other names have too is somebody's own with the share of names that hold it, less
    what may be errors of the other word; a word that no other name has, letter by letter.
    """
    total = F.broadcast(roots.groupBy("kind").agg(F.count(F.lit(1)).alias("total")))
    side = lambda p: roots.select(F.col("w").alias(p), *(F.col(x).alias(f"{p}_{x}") for x in ("n", "id", "kind", "home", "a", "b", "a_written", "b_written", "a_d", "b_d", "rank")))
    # Steps go up in rank only.
    both = pairs.join(side("v"), "v").join(side("c"), "c").where("c_rank > v_rank")
    both = both.withColumn("elsewhere", F.col("v_home") & F.col("c_home") & ~F.col("domain"))
    straight, crossed = edits(F.col("v_a"), F.col("c_a")) + edits(F.col("v_b"), F.col("c_b")), edits(F.col("v_a"), F.col("c_b")) + edits(F.col("v_b"), F.col("c_a"))
    both = both.withColumn("d", F.least(straight, crossed)).withColumn("turned", crossed < straight)
    c_a, c_b = F.when(F.col("turned"), F.col("c_b")).otherwise(F.col("c_a")), F.when(F.col("turned"), F.col("c_a")).otherwise(F.col("c_b"))
    both = both.withColumn("in_a", F.col("v_a") != c_a).withColumn("wrong", F.when(F.col("in_a"), F.col("v_a")).otherwise(F.col("v_b"))).withColumn("right", F.when(F.col("in_a"), c_a).otherwise(c_b))
    both = both.withColumn("written", F.coalesce(F.when(F.col("in_a"), F.col("v_a_written")).otherwise(F.col("v_b_written")), F.lit(False)))
    first = F.col("in_a") != F.col("turned")
    both = both.withColumn("wrong_d", F.when(F.col("in_a"), F.col("v_a_d")).otherwise(F.col("v_b_d"))).withColumn("right_d", F.when(first, F.col("c_a_d")).otherwise(F.col("c_b_d")))
    both = both.join(total, both.v_kind == total.kind, "left")
    beyond = F.greatest(F.col("wrong_d") - 1 - ERROR_SHARE * (F.col("right_d") - 1), F.lit(0.0))
    # Below three partners more than an error share, a word says nothing by itself.
    own = F.when((F.col("wrong_d") > 3) & (beyond > 0), beyond / F.col("total")).otherwise(0.0) + F.exp(LETTER * F.length("wrong"))
    habit = F.when(F.col("written") & ~F.col("same") & ~F.col("made"), HABIT).when((F.col("v_n") > 1) & (F.col("c_n") < 2 * F.col("v_n")) & ~F.col("domain") & ~F.col("same"), -8.0).otherwise(0.0)
    one_equal = (F.col("v_a") == F.col("c_a")) | (F.col("v_b") == F.col("c_b")) | (F.col("v_a") == F.col("c_b")) | (F.col("v_b") == F.col("c_a"))
    name_p = (
        F.when(F.col("d") == 0, 10.0)
        .when((F.col("d") == 1) & (F.length("right") > 3), EDIT - F.log(own) + habit)
        .when((F.col("d") <= 4) & (F.length("v_a") + F.length("v_b") > 8), MANGLED)
        .when(one_equal, PART)
        .otherwise(UNRELATED)
    )
    # Names that have met in a mailbox of many only are more likely those of many, and each of them counts once.
    crowded = F.when(F.col("only"), F.greatest(F.col("crowd") - math.log(EVIDENCE["same"][0] / EVIDENCE["same"][1]), F.lit(0.0))).otherwise(0.0)
    return both.select("v", "c", F.col("c_id").alias("id"), F.col("c_n").alias("n"), F.when(F.col("only"), F.exp(-F.col("crowd") / 2)).otherwise(1.0).alias("m"), F.col("c_n").alias("s"), (name_p - crowded).alias("name_p"), "crowd", *EVIDENCE)


def _merged(found: DataFrame, home: DataFrame) -> DataFrame:
    """One row per (v, c) with the evidence of all its rows; ``found`` has v, c, how, crowd and at (a domain of v); ``home`` (c, at)."""
    told = found.join(home.select("c", "at", F.lit(True).alias("shared")), ["c", "at"], "left")
    flags = (F.max(F.col("how") == k).alias(k) for k in KEYS)
    return told.groupBy("v", "c").agg(F.min("crowd").alias("crowd"), F.min(F.col("how") == "same").alias("only"), *flags, F.coalesce(F.max("shared"), F.lit(False)).alias("domain")).withColumn("unlike", F.lit(False))


def _twice(wanted: DataFrame, lent: DataFrame) -> DataFrame:
    """(v, c) that have met under two keys or more."""
    twin = lambda df, k: df.select(k, F.col("key").alias("one")).join(df.select(k, F.col("key").alias("two")), k).where("one < two")
    asked = materialize(twin(wanted, "v"))
    keys = asked.select(F.explode(F.array("one", "two")).alias("key")).distinct()
    return asked.join(twin(lent.join(keys, "key", "left_semi"), "c"), ["one", "two"]).select("v", "c").distinct()


def _classes(wanted: DataFrame, lent: DataFrame, of_domain: DataFrame, known: DataFrame) -> DataFrame:
    """What blocks lend: a row for each unit and all of its candidates of equal evidence, (v, c, id, n, m, s, home, domain, initial, short).

    ``wanted`` has v, at, key, initial and short, ``lent`` c, key, n, id and home, ``of_domain`` c and at,
    ``known`` the (v, c) that have rows of their own and are left out. Candidates of one key differ in
    frequency, in whether they have a domain and whether it is the unit's. So each key has lists by frequency, one of those
    with a domain, one of those without, and one for each domain. The first left of a list can be told from the places that are taken,
    and what is left from sums, so that no block is multiplied out, and nothing in it is lost.
    """
    window = lambda *by: Window.partitionBy(*by).orderBy(F.desc("n"), "id", "c")
    lists = ["key", "home", "dom"]
    general = [F.lit(True).alias("home"), F.lit("").alias("dom")]
    lent = materialize(lent.join(wanted.select("key").distinct(), "key", "left_semi").withColumn("place", F.row_number().over(window("key", "home"))))
    local = materialize(lent.join(of_domain, "c").withColumn("at_place", F.row_number().over(window("key", "at"))))
    entries = lent.select("key", "home", F.lit("").alias("dom"), "place", "c", "n", "id").unionByName(local.select("key", F.lit(True).alias("home"), F.col("at").alias("dom"), F.col("at_place").alias("place"), "c", "n", "id"))
    totals = materialize(entries.groupBy(*lists).agg(F.count(F.lit(1)).alias("m"), F.sum("n").alias("s")))

    def skipped(asked: DataFrame, members: Column, x: str) -> DataFrame:
        """``asked`` (key, at, x) with the number of the domain's members below x in the list of all domains."""
        both = local.select("key", "at", members.alias(x), F.lit(1).alias("member")).unionByName(asked.select("key", "at", x, F.lit(0).alias("member")).distinct())
        below = F.sum("member").over(Window.partitionBy("key", "at").orderBy(x, "member").rowsBetween(Window.unboundedPreceding, 0))
        return both.withColumn("skipped", below).where("member = 0").select("key", "at", x, "skipped", *general)

    # Places that known ones take, counted without the members of the unit's domain where these have a list of their own.
    taken = known.join(wanted.select("v", "at", "key"), "v").join(lent.select("key", "c", "home", "place", "n"), ["key", "c"]).join(local.select("key", "at", "c", "at_place"), ["key", "at", "c"], "left")
    taken = materialize(taken.select("v", "key", "at", "home", F.when(F.col("at_place").isNotNull(), F.col("at")).otherwise("").alias("dom"), F.coalesce("at_place", "place").alias("place"), "n"))
    general_taken = skipped(taken.where("home and dom = ''"), F.col("place"), "place")
    taken = taken.join(general_taken, ["key", "at", "place", "home", "dom"], "left").withColumn("place", F.col("place") - F.coalesce("skipped", F.lit(0)))
    taken = taken.withColumn("nth", F.row_number().over(Window.partitionBy("v", *lists).orderBy("place")))
    taken = taken.groupBy("v", *lists).agg(F.count(F.lit(1)).alias("m_taken"), F.sum("n").alias("s_taken"), F.sum((F.col("nth") == F.col("place")).cast("int")).alias("ahead"))

    none = lambda c: F.coalesce(F.col(c), F.lit(0))
    each = F.array_distinct(F.array(*(F.struct(F.lit(h).alias("home"), d.alias("dom")) for h, d in ((True, F.lit("")), (False, F.lit("")), (True, F.col("at"))))))
    out = wanted.select("*", F.explode(each).alias("l")).select("v", "at", "key", "initial", "short", "l.home", "l.dom").join(totals, lists)
    out = out.join(totals.where("dom <> ''").select("key", F.col("dom").alias("at"), *general, F.col("m").alias("m_local"), F.col("s").alias("s_local")), ["key", "at", "home", "dom"], "left").join(taken, ["v", *lists], "left")
    out = out.withColumn("m", F.col("m") - none("m_local") - none("m_taken")).withColumn("s", F.col("s") - none("s_local") - none("s_taken")).withColumn("place", none("ahead") + 1)
    out = materialize(out.where("m > 0").select("v", "at", *lists, "initial", "short", "m", "s", "place"))
    # The first left is at this place of a list without the domain's members: how many of them stand before it?
    before = skipped(out.where("home and dom = ''"), F.col("place") - F.col("at_place"), "place")
    out = out.join(before, ["key", "at", "place", "home", "dom"], "left").withColumn("place", F.col("place") + none("skipped"))
    return out.join(entries, [*lists, "place"]).select("v", "c", "id", "n", "m", "s", "home", (F.col("dom") != "").alias("domain"), "initial", "short")


def link(users: DataFrame, id_col: str = "user_id", name_col: str = "name", email_col: str = "email") -> DataFrame:
    """(id, entity): each row with the smallest id of its person or organisation.

    Rows with neither a name nor an address, and rows whose name and address say nothing, are
    entities of their own. Equal spellings are one form from the start, so a form that a third of
    all rows share costs no more than any other. Every spelling is weighed against all candidates of its
    blocks, those of equal evidence together. Repeated ids, null ids and an empty table are fine.
    """
    users = users.select(F.col(id_col).cast("bigint").alias("id"), F.col(name_col).alias("name"), F.col(email_col).alias("email"))
    said = users.where((F.coalesce(F.trim("name"), F.lit("")) != "") | (F.coalesce(F.trim("email"), F.lit("")) != ""))
    named_by = F.when(F.col("kind") == "o", F.when(F.col("domain") != "", F.concat(F.lit("@"), "domain")).when(F.size("words") > 0, F.concat(F.lit("o:"), F.array_join("words", " ")))).when(
        F.col("typed") != "", F.concat(F.lit("p:"), F.array_join("words", " "))
    )
    forms = materialize(_parsed(said.where("id is not null")).withColumn("w", named_by))
    roots = materialize(_canonical(forms))
    named = forms.where("w is not null")

    # Canonical forms among themselves: typing errors, and mangled names with a telling address.
    a, b = F.coalesce("a", F.lit("")), F.coalesce("b", F.lit(""))
    blocks = F.concat(F.transform(_deletions(a), lambda x: F.concat(x, F.lit(" "), b)), F.transform(_deletions(b), lambda x: F.concat(a, F.lit(" "), x)))
    # Errors in the first letter may change the order of a person's words.
    turned = F.when(F.col("kind") == "p", F.transform(blocks, lambda x: F.concat(F.substring_index(x, " ", -1), F.lit(" "), F.substring_index(x, " ", 1)))).otherwise(F.array().cast(_ARRAY))
    deleted = roots.where("a is not null").select("w", "rank", "kind", F.explode(F.array_distinct(F.concat(blocks, turned))).alias("block"))
    near = deleted.alias("v").join(deleted.alias("c"), (F.col("v.block") == F.col("c.block")) & (F.col("v.kind") == F.col("c.kind")) & (F.col("c.rank") > F.col("v.rank"))).select(F.col("v.w").alias("v"), F.col("c.w").alias("c"), F.lit("near").alias("how"))
    people = materialize(named.where("kind = 'p'").select("w", "names", "made", "initials", "address", "domain").join(roots.select("w", "rank"), "w"))
    # The more names a mailbox has, the likelier somebody else has it, and the more there are who may be meant.
    users_of = people.where("address <> ''").select("address", "w", "rank").distinct()
    crowd = users_of.groupBy("address").agg((2 * F.log(F.greatest(F.count(F.lit(1)) - 1, F.lit(1)).cast("double"))).alias("crowd"))
    same = users_of.alias("v").join(users_of.alias("c"), "address").where("c.rank > v.rank").join(crowd, "address").groupBy(F.col("v.w").alias("v"), F.col("c.w").alias("c")).agg(F.min("crowd").alias("crowd")).withColumn("how", F.lit("same"))
    of_letters = people.select(F.col("w").alias("c"), "rank", F.explode("names").alias("key")).distinct()
    made = people.select(F.col("w").alias("v"), F.col("rank").alias("r"), F.explode("made").alias("key")).distinct().join(of_letters, "key").where("rank > r").select("v", "c", F.lit("made").alias("how"))
    at_home = materialize(named.where("domain <> ''").select("w", F.col("domain").alias("at")).distinct())
    # Each step is written before the next, which keeps plans small.
    found = materialize(near.unionByName(made).distinct().unionByName(same, allowMissingColumns=True)).withColumn("crowd", F.coalesce("crowd", F.lit(0.0)))
    pairs = _merged(found.join(at_home.withColumnRenamed("w", "v"), "v", "left"), at_home.withColumnRenamed("w", "c"))
    at = _settle(_name_likelihood(pairs, roots), roots.select(F.col("w").alias("v")))
    of_root = at.withColumnRenamed("v", "w")
    rooted = materialize(of_root.join(roots.select("w", "n", "id", "home"), "w"))
    root_n = materialize(rooted.groupBy(F.col("root").alias("c")).agg(F.sum("n").alias("n"), F.min("id").alias("id"), F.max("home").alias("home")))

    # Spellings without a full name: one unit per personal address, else each by itself.
    unit = F.when(F.col("address") != "", F.concat(F.lit("e:"), "address")).otherwise(F.concat(F.lit("f:"), F.col("form").cast("string")))
    rest = materialize(forms.where("w is null").select("form", unit.alias("v"), "names", "initials", "made", "short", "address", F.col("domain").alias("at")))
    people = materialize(people.drop("rank").join(of_root.withColumnRenamed("root", "c"), "w").drop("w"))
    of_domain = materialize(at_home.join(of_root.withColumnRenamed("root", "c"), "w").select("c", "at").distinct())
    seen = rest.where("address <> ''").select("v", "at", "address").distinct().join(people.where("address <> ''").select("address", "c").distinct(), "address").select("v", "c", "at", F.lit("same").alias("how"))
    letters = rest.select("v", "at", F.explode(F.concat("names", "made")).alias("key")).distinct().join(people.select("c", F.explode("names").alias("key")).distinct(), "key").select("v", "c", "at", F.lit("made").alias("how"))
    lent = materialize(people.select("c", F.explode("initials").alias("key")).distinct().join(root_n, "c"))
    keys = F.explode(F.concat(*(F.transform(k, lambda x: F.struct(x.alias("key"), F.lit(h).alias("how"))) for k, h in (("initials", "initial"), ("short", "short")))))
    wanted = materialize(rest.select("v", "at", keys.alias("k")).groupBy("v", "at", "k.key").agg(*(F.max(F.col("k.how") == h).alias(h) for h in ("initial", "short"))))
    # Candidates met in more than one way have rows of their own, all others one for each block.
    met = materialize(seen.unionByName(letters).distinct())
    known = materialize(met.select("v", "c").unionByName(_twice(wanted, lent)).distinct())
    how = F.explode(F.array_compact(F.array(*(F.when(F.col(h), F.lit(h)) for h in ("initial", "short")))))
    by_key = known.join(wanted, "v").join(lent.select("c", "key"), ["c", "key"]).select("v", "c", "at", how.alias("how"))
    met = _merged(met.unionByName(by_key).withColumn("crowd", F.lit(0.0)), of_domain).drop("crowd", "only").join(root_n, "c").withColumn("m", F.lit(1).cast("bigint")).withColumn("s", F.col("n"))
    blocks = _classes(wanted, lent, of_domain, known).withColumn("same", F.lit(False)).withColumn("made", F.lit(False)).withColumn("unlike", F.lit(False))
    met = materialize(met.unionByName(blocks)).withColumn("crowd", F.lit(0.0))
    # What a unit's domain is and whether its address says anything, and whether some candidate explains that address:
    # others hardly come by the very address that one candidate explains.
    units = rest.groupBy("v").agg(F.max(F.col("at") != "").alias("v_home"), F.max((F.size("made") > 0) | (F.size("short") > 0)).alias("told"))
    explained = F.col("same") | F.col("made") | F.col("short")
    some = met.groupBy("v").agg(F.max(explained).alias("explained"))
    met = met.join(units.join(some, "v"), "v").withColumn("unlike", F.col("told") & ~explained).withColumn("elsewhere", F.col("v_home") & F.col("home") & ~F.col("domain"))
    met = met.withColumn("name_p", F.when(F.col("explained") & F.col("unlike"), MINE).otherwise(0.0))
    chosen = materialize(attribute(met.select("v", "c", "id", "n", "m", "s", "name_p", "crowd", *EVIDENCE)))

    where = named.select("form", "w").join(of_root, "w").select("form", F.col("root").alias("r")).unionByName(rest.select("form", "v").join(chosen, "v", "left").select("form", F.coalesce("c", "v").alias("r")))
    where = materialize(where)
    entity = materialize(where.join(where.groupBy("r").agg(F.min("form").alias("entity")), "r").select("form", "entity").join(forms.select("form", "name", "email"), "form").drop("form"))
    out = users.join(entity, users.name.eqNullSafe(entity.name) & users.email.eqNullSafe(entity.email), "left")
    return out.select(F.col("id").alias(id_col), F.coalesce("entity", "id").alias("entity"))


def pairs(linked: DataFrame, id_col: str = "user_id") -> DataFrame:
    """(id_a, id_b): every pair of rows of one entity, smaller id first; the result's size is that of the groups squared."""
    distinct = linked.where(F.col(id_col).isNotNull()).distinct()
    a, b = distinct.select("entity", F.col(id_col).alias(f"{id_col}_a")), distinct.select("entity", F.col(id_col).alias(f"{id_col}_b"))
    return a.join(b, "entity").where(F.col(f"{id_col}_a") < F.col(f"{id_col}_b")).drop("entity")
