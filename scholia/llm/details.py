"""Invented private details, and values that only look like some, to train the field model of ``pii`` on.

A model that saw nothing but the collection's own details would learn their formats by heart.
Here numbers, addresses and names are drawn from rules that leave groups, separators, order and
spelling open, and stand in sentences of their own or in place of the details of a real text.
"""

from __future__ import annotations

import random
from collections.abc import Sequence

#: A text as a row of strings, each with its label (0 for none).
Pieces = list[tuple[str, int]]
EMAIL, PHONE, ID, ADDRESS, NAME = range(1, 6)

# Words that stand around details and look-alikes.
_STREETS_AFTER = "Street Road Avenue Lane Drive Court Way Close Square Terrace Boulevard St Rd Ave Ln Dr Blvd".split()
_STREETS_BEFORE = ["rue de", "rue du", "avenue des", "place de", "Calle", "Avenida", "Via", "Viale", "Piazza", "Rua", "ul.", "Plaza", "Corso"]
_STREETS_INSIDE = "straße strasse weg platz gasse allee straat gracht gatan vej".split()
_PARTICLES = ["van", "von", "de", "der", "van der", "de la", "di", "da", "del", "al"]
_AROUND = {
    EMAIL: ["mail {}", "ask {} before this goes out", "{} knows more", "write to {} first", "reported by {}", "owner {}", "bitte an {} melden", "see the mail from {}", "contact: {}", "{}"],
    PHONE: ["call {} if it hangs", "tel {}", "phone: {}", "pager {}", "on-call: {}", "ring {} at night", "mobile {}", "fax {}", "hotline {} for this", "appeler le {}", "Telefon {}", "{}"],
    ID: [
        "SSN: {} ok", "ssn {}", "social security number {}", "NHS number {}", "passport {}", "passport number {} is real", "tax id {}", "tax number {}", "national insurance no. {}", "identity card {}",
        "ID card no {}", "NIF {}", "DNI {}", "CPF {}", "PESEL {}", "CURP {}", "personnummer {}", "Steuernummer {}", "fixture holds passport {}", "replace SSN {} by a dummy", "Ausweis {}", "insurance number {}",
    ],
    ADDRESS: ["lives at {}", "ships to {}", "send it to {}", "address: {}", "invoice goes to {}", "default is {}", "Anschrift {}", "do not hard-code {}", "moved to {} last year", "{}"],
    NAME: [
        "ask {}", "thanks to {} for this", "per review of {}: drop it", "written by {}", "{} knows why", "pair with {} on this", "mit {} abklären", "voir avec {}", "author: {}", "contact {}", "assigned to {}",
        "{} wrote this", "talk to {} first", "reviewed by {}", "cc {}", "signed off by {}", "leaks the record of {}",
    ],
}
_IN_LABEL = ["TODO({}): this loop is slow", "// FIXME({}) - drop the cache, see run_all()", "# HACK({}, core): remove the workaround", "/* todo({}): why does it fail here */"]
_AGAIN = ["; {}", ", see {}", " ({})", " - {} again", "; {} has the details", "; drop it when {} is back", " / {}"]
_TITLES = "Main Loop,Event Loop,Path Filter,Rich Text,Grant Access,Road Map,Read Only,Hash Map,Token Reader,Build Server,Open Source,Blue Green,Parse Tree,Unit Test,Dead Letter,Word Count,Page Cache,Start Menu,Base Class,Pull Request".split(",")
_NUMBERED = ["needs build {} or newer", "issue #{}", "rows {} are wrong", "port {}", "size {} is out of range", "version {}", "trace id {}", "offset {}", "broke on {}", "at {}", "commit {}", "ticket {}", "returns {} rows", "host {}", "error {}", "limit of {} entries", "see RFC {}", "chunk {}", "{}"]
_CALLED = ["rename {}", "see {}", "the {} is slow", "{} breaks here", "enable {} first", "{}: not yet", "pin {} for now"]
_STARTS = ["// ", "# ", "-- ", "/* ", "// TODO: ", "# FIXME(core): ", "* TODO(#31): ", "TODO ", "", "// HACK - "]
_SOUNDS = ("b d f g h k l m n p r s t v w z br st tr gr kl".split(), "a e i o u ai ei o a e".split(), "n r s l t m k nd rt ".split(" "))
_SOUNDS_CYRILLIC = ("б в г д з к л м н п р с т".split(), "а е и о у".split(), ["н", "р", "л", ""])


def _digits(r: random.Random, n: int) -> str:
    return "".join(r.choices("0123456789", k=n))


def _word(r: random.Random, least: int = 2, most: int = 3, sounds=_SOUNDS) -> str:
    return "".join(r.choice(sounds[0]) + r.choice(sounds[1]) + (r.choice(sounds[2]) if r.random() < 0.4 else "") for _ in range(r.randint(least, most))).title()


def phone(r: random.Random) -> str:
    mark = r.choice(["-", " ", " ", ".", "/", ""])
    start = r.choice(["+{c} ", "+{c} ", "+{c}", "00{c} ", "+{c} (0)", "({a}) ", "({a})", "0{a}" + (mark or " "), "{a}" + (mark or "-"), "tel:+{c}"])
    start = start.format(c=r.choice(["1", str(r.randint(20, 99)), str(r.randint(200, 999))]), a=("0" if r.random() < 0.4 else "") + _digits(r, r.choice([2, 3, 3, 4])))
    groups = [_digits(r, r.choice([2, 2, 3, 3, 4, 4, 5])) for _ in range(r.randint(2, 4))]
    while sum(map(len, groups)) + sum(c.isdigit() for c in start) < 8:
        groups.append(_digits(r, 3))
    return start + mark.join(groups) + (f" x{_digits(r, 3)}" if r.random() < 0.1 else "")


def identity(r: random.Random) -> str:
    capital = lambda n: "".join(r.choices("ABCDEFGHJKLMNPRSTXYZ", k=n))
    mark = r.choice(["-", " ", ".", "", ""])
    form = r.random()
    if form < 0.15:
        return f"{_digits(r, 3)}-{_digits(r, 2)}-{_digits(r, 4)}"
    if form < 0.25:
        return f"{_digits(r, 3)}.{_digits(r, 3)}.{_digits(r, 3)}-{_digits(r, 2)}"
    if form < 0.4:
        return capital(r.choice([1, 2])) + r.choice(["", " "]) + _digits(r, r.choice([6, 7, 8]))
    if form < 0.5:
        return f"{capital(2)} {_digits(r, 2)} {_digits(r, 2)} {_digits(r, 2)} {capital(1)}"
    groups = [_digits(r, r.choice([2, 3, 3, 4, 5])) for _ in range(r.choice([1, 2, 3, 3, 4]))]
    while sum(map(len, groups)) < 7:
        groups.append(_digits(r, 3))
    return mark.join(groups) + (mark + capital(1) if r.random() < 0.25 else "")


def address(r: random.Random) -> str:
    n, city = str(r.randint(1, 480)) + (r.choice("abcAB") if r.random() < 0.2 else ""), _word(r) + (f" {_word(r, 1, 2)}" if r.random() < 0.2 else "")
    code = r.choice([_digits(r, 5), _digits(r, 4), f"{_digits(r, 4)} {''.join(r.choices('ABCDEH', k=2))}", f"{_digits(r, 2)}-{_digits(r, 3)}", f"D-{_digits(r, 5)}"])
    flat = r.choice([f", {r.choice(['Apt', 'Flat', 'Unit', 'Suite'])} {r.randint(1, 99)}", f", {r.randint(1, 9)}º {r.choice('ABCD')}"]) if r.random() < 0.25 else ""
    form = r.random()
    if form < 0.25:
        state = "".join(r.choices("ACDFGILMNTWXY", k=2))
        return f"{n} {_word(r)}{' ' + _word(r) if r.random() < 0.2 else ''} {r.choice(_STREETS_AFTER)}{flat}, {city}{r.choice(['', ', ' + state, ' ' + state])} {_digits(r, 5)}"
    if form < 0.45:
        outward = "".join(r.choices("ABCEGLMNSW", k=r.choice([1, 2]))) + str(r.randint(1, 29))
        return f"{n} {_word(r)} {r.choice(_STREETS_AFTER)}, {city} {outward} {r.randint(1, 9)}{''.join(r.choices('ABDEFGHJ', k=2))}"
    if form < 0.65:
        return f"{_word(r)}{r.choice(_STREETS_INSIDE)} {n}, {code} {city}"
    if form < 0.8:
        return f"{r.choice(_STREETS_BEFORE)} {_word(r)} {n}{flat}, {code} {city}"
    if form < 0.93:
        return f"{n}{r.choice(['', ','])} {r.choice(_STREETS_BEFORE[:5])} {_word(r)}, {code} {city}"
    return f"P.O. Box {r.randint(1, 999)}, {city} {_digits(r, 5)}"


def person(r: random.Random, first_names: Sequence[str]) -> str:
    sounds = _SOUNDS_CYRILLIC if r.random() < 0.08 else _SOUNDS
    first = r.choice(first_names) if first_names and r.random() < 0.5 and sounds is _SOUNDS else _word(r, 1, 3, sounds)
    last = _word(r, 2, 3, sounds) + (r.choice(["ов", "ев", "ин", "ский"]) if sounds is _SOUNDS_CYRILLIC else r.choice(["", "", "ov", "sen", "ski", "er", "ez", "man"]))
    if r.random() < 0.1:
        last = r.choice(["O'", "Mc", _word(r, 1, 2) + "-"]) + last
    if r.random() < 0.08:
        last = f"{r.choice(_PARTICLES)} {last}"
    form = r.random()
    if form < 0.6:
        return f"{first} {last}"
    if form < 0.7:
        return f"{first} {first[0]}. {last}"
    if form < 0.8:
        return f"{last}, {first}"
    if form < 0.92:
        return r.choice(["", "Dr. "]) + f"{first[0]}. {last}"
    return f"{first} {last}".lower() if first in first_names else f"{first} {last}"


def email(r: random.Random) -> str:
    local = r.choice(["{a}.{b}", "{a}_{b}", "{a}-{b}", "{b}{a}", "{a}{n}", "{b}.{a}+x", "{a}"]).format(a=_word(r, 1, 2).lower(), b=_word(r).lower(), n=r.randint(1, 99))
    at, dot = r.choice([("@", ".")] * 6 + [("[at]", "."), (" AT ", " DOT "), (" (at) ", " (dot) "), ("[at]", "[dot]"), ("(at)", "(dot)")])
    whole = f"{local}{at}{_word(r).lower()}{dot}{r.choice('example com org net io de'.split())}"
    return whole.upper() if r.random() < 0.1 and at == "@" else whole


def lookalike(r: random.Random) -> str:
    d = lambda n: _digits(r, n)
    form = r.randrange(16)
    if form < 3:
        return r.choice(_TITLES) if r.random() < 0.5 else f"{_word(r)} {r.choice(_TITLES).split()[1]}"
    return [
        d(10), d(9), f"{d(3)}-{d(3)}-{d(4)}", f"{d(3)}-{d(2)} x {d(4)}", f"{d(1)}.{d(2)}.{d(3)}", f"10.{d(2)}.{d(2)}.{d(1)}", f"20{d(2)}-0{r.randint(1, 9)}-1{d(1)} at {r.randint(10, 23)}:{d(2)}",
        f"{d(2)}.{d(6)}, {d(2)}.{d(6)}", f"{d(8)}-{d(4)}-{d(4)}", "".join(r.choices("0123456789abcdef", k=40)), f"{d(4)}", f"@{_word(r).lower()}", f"lib@{d(1)}.{d(1)}.{d(2)}",
    ][form - 3]


_INVENT = {EMAIL: email, PHONE: phone, ID: identity, ADDRESS: address}


def invent(kind: int, r: random.Random, first_names: Sequence[str]) -> str:
    return person(r, first_names) if kind == NAME else _INVENT[kind](r)


def _around(template: str, value: str, label: int) -> Pieces:
    before, _, after = template.partition("{}")
    return [(before, 0), (value, label), (after, 0)]


def sentence(r: random.Random, first_names: Sequence[str]) -> Pieces:
    """A comment with one or two details, or with none but look-alikes; every third detail is named twice."""
    out: Pieces = [(r.choice(_STARTS), 0)]
    if r.random() < 0.35:
        value = lookalike(r)
        out += _around(r.choice(_NUMBERED if value[0].isdigit() else _CALLED), value, 0)
        return out + (_around(r.choice(_AGAIN), value, 0) if r.random() < 0.4 else [])
    kind = r.choice([EMAIL, PHONE, ID, ADDRESS, NAME, NAME])
    value = invent(kind, r, first_names)
    if kind in (EMAIL, PHONE, NAME) and r.random() < 0.2:
        out = _around(r.choice(_IN_LABEL), value, kind)
    else:
        out += _around(r.choice(_AROUND[kind]), value, kind)
    if r.random() < 0.3:
        out += _around(r.choice(_AGAIN), value, kind)
    elif r.random() < 0.3:
        other = r.choice([EMAIL, PHONE, ID, NAME, ADDRESS])
        # A number alone behind another detail might be anything.
        again = invent(other, r, first_names)
        out += [(r.choice([", ", " / ", " "]), 0), *(_around("passport {}", again, ID) if other == ID else [(again, other)])]
    return out


def varied(text: str, spans: Sequence[tuple[int, int, int]], r: random.Random, first_names: Sequence[str]) -> Pieces:
    """A real text with its details replaced by invented ones, equal ones alike, and sometimes named again at the end."""
    out: Pieces = []
    new: dict[str, str] = {}
    at = 0
    for start, end, kind in sorted(spans):
        if start < at:
            continue
        old = text[start:end]
        value = new.setdefault(old, old if r.random() < 0.2 else invent(kind, r, first_names))
        out += [(text[at:start], 0), (value, kind)]
        at = end
    out.append((text[at:], 0))
    details = [p for p in out if p[1]]
    if details and r.random() < 0.25:
        out += _around(r.choice(_AGAIN), *r.choice(details))
    return out


def joined(pieces: Pieces) -> tuple[str, list[tuple[int, int, int]]]:
    """The text and the (start, end, label) of its details."""
    at, spans = 0, []
    for part, label in pieces:
        if label:
            spans.append((at, at + len(part), label))
        at += len(part)
    return "".join(part for part, _ in pieces), spans
