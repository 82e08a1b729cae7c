"""Private details in free text, found with a skip-chain conditional random field.

Tokens of a text form a chain; tokens far apart that are equal, or a word and an address that holds
it, are tied by skip edges, so that what is plain in one place is found in the other too. Emission,
transition and skip potentials are trained together: the gradient is what the labels say less what
loopy message passing expects (the chain is summed out exactly, then messages travel over the skip
edges, a few times in turn). Labels come from patterns and known names on a sample of the
collection, in which most details are then replaced by invented ones (see ``details``); no pattern
decides anything when the model is applied. Texts are worked on in batches of arrays.

A detail must have an anchor, or its text is not looked at: an address sign or its disguise, a run
of four digits, a number beside a capitalised word, two capitalised words in a row, or a first
name of the training names in whatever case. Found spans are checked at last: a name needs a
surname, a phone number seven digits.
"""

from __future__ import annotations

import random
import re
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scholia.llm import details
from scholia.plans.tables import bounded_sample

KINDS = ("email", "phone", "id_number", "address", "person_name")
O, EMAIL, PHONE, ID, ADDRESS, NAME = range(6)
#: Bounds of the training sample: values of the collection, characters of each, invented sentences.
SAMPLE_ROWS, SAMPLE_CHARS, INVENTED = 16_000, 2_000, 6_000
#: Rounds of training and of message passing, and texts in a step of training.
EPOCHS, ROUNDS, STEP = 3, 3, 400
_HASHED = 1 << 16

#: An address sign or its disguise, four digits, a number beside a capitalised word, two capitalised words or initials.
_PARTICLE = r"(?:v[ao]n|de[nrl]?|d[aiou]|del|dos|al?|l[ae]|ter|ten)"
SCREEN = (
    r"@|\[at\]|\(at\)|\bAT\b|\d(?:[^\n]{0,3}\d){3}|\p{Lu}[\p{L}'’.-]*,?\s+(?:%s\s+){0,3}\p{Lu}|\p{Lu}\p{L}{2,}\s+\d+\s?\p{L}?,\s|(?<![\p{L}\d#])\d+\p{L}?,?\s+\p{Lu}\p{L}" % _PARTICLE
)

_L = r"[^\W\d_]"
_TOKEN = re.compile(
    r"(?P<mail>[\w.+'%-]*\w(?:@|\[at\]|\(at\)| \(at\) )[\w-]+(?:(?:\.|\[dot\]|\(dot\)| \(dot\) )[\w-]+)*|[\w.+-]*\w AT [\w-]+(?: DOT [\w-]+)+)"
    r"|(?P<ident>\w+(?:::\w+)+(?:\(\))?|\w*[A-Za-z]\w*_\w+(?:\(\))?|\w+\(\)|\w+\.(?:go|py|rs|ts|js|sql|yml|yaml|java|c|rb)\b|https?://\S+|[a-z]+[A-Z]\w*)"
    r"|(?P<number>(?:tel:)?\+?(?:\(\d{1,5}\)[ -]?)?\d(?:(?:[-./:]| ?[()] ?| {1,2})?\d)*(?: x\d+)?)"
    rf"|(?P<word>{_L}+(?:['’-]{_L}+)*)(?![\w])"
    r"|(?P<mixed>\w+)|(?P<mark>[^\w\s])"
)

# Formats of numbers and addresses that the training sample is labelled by.
_PHONE = re.compile(r"(?<![\w.-])(?:tel:\+?\d{8,14}|\+\d{1,3}(?:[ .-]?\(?\d{1,5}\)?){2,6}|00\d{2} \d{2} \d{6,8}|\(0?\d{3}\) ?\d{3,4}[ -]\d{4}|0\d{2}/\d{5}-\d{3}|0\d(?:\.\d\d){4}|\d{3}([.-])555\1\d{4}(?: x\d+)?)(?![\w-])")
_ID_FORMS = (
    r"[A-Z]{2} ?\d{7}|[A-Z]\d{8}|L[A-Z\d]{8}|\d{3}\.\d{3}\.\d{3}-\d\d|[A-Z]{2}(?: ?\d\d){3} ?[A-D]|\d\d\.?\d{3}\.?\d{3}[ -]?[A-Z]"
    r"|\d\d \d{3} \d{3} \d{3}|\d{3}-?\d\d-?\d{4}|\d{6}-\d{4}"
)
_ID = re.compile(
    rf"(?i:passport(?: no\.?)?|personalausweis|cpf|ni number|dni:?|steuer-id|ssn[=: ]?|national id)[ :]*({_ID_FORMS})(?!\w)"
    r"|(?<![\w.-])(\d{3}\.\d{3}\.\d{3}-\d\d|\d{3}-\d\d-\d{4}|QQ(?: \d\d){3} [A-D])(?![\w-])"
)
_W = r"[A-ZÀ-ÞŁŚŻ][\w'’-]*"
_ADDRESS = re.compile(
    rf"(?<![\w.])(?:P\.O\. Box \d+, {_W}(?: {_W})? \d{{4,5}}|(?:Calle|Via|Avenida|Rua|Piazza|ul\.) {_W}(?: {_W})? \d+(?:, \d+º ?\w)?, \d{{5}} {_W}"
    rf"|\d+,? (?:rue|avenue|place) (?:de |du |des )?{_W}, \d{{5}} {_W}|{_L}+(?:straße|strasse|weg|platz|gasse|allee) \d+ ?[a-z]?, (?:D-)?\d{{5}} {_W}"
    rf"|\d+ {_W}(?: {_W})? (?:St|Ave|Blvd|Rd|Street|Avenue|Road|Lane|Ln|Drive|Dr|Way|Court)\b\.?(?:, (?:Apt|Suite|Unit|Flat)\.? \w+)?, {_W}(?: {_W})?(?:,? [A-Z]{{2}})?(?: \d{{5}})?)"
)
_NAME = re.compile(rf"(?:Dr\. )?((?:[A-Z]\. )?{_W}|[A-ZÀ-Þ]\.)(?:,)? (?:[A-ZÀ-Þ]\. )?(?:(?:van|von|de|der|del|di|da) )?({_W})")
_WORDS = re.compile(rf"{_L}+").findall
#: Texts times tokens that message passing holds at once, unless one text alone has more.
_CELLS = 1 << 15


def _shape(kind: str, token: str) -> str:
    if kind == "mail":
        host = re.split(r"@|\[at\]|\(at\)| AT ", token)[-1]
        return "mail:none" if token[0] == "@" else "mail:version" if re.match(r"\d", host.strip()) else "mail:git" if token.startswith("git@") else "mail" if re.search(r"\.|dot|DOT", host) else "mail:bare"
    if kind == "number":
        return "n" + re.sub(r"\d", "9", token)
    if kind == "mixed":
        return "m" + re.sub(r"[a-z]+", "x", re.sub(r"[A-Z]", "X", re.sub(r"\d", "9", token)))[:12]
    if kind == "word":
        if len(token) == 1:
            return "X" if token.isupper() else "x"
        return "XX" if token.isupper() else "Xx" if token[0].isupper() and token[1:].islower() else "Xy" if token[0].isupper() else "xx"
    return kind if kind == "ident" else token


def _coarse(kind: str, token: str) -> int:
    """A number for what kind of token this is, the same for numbers of like make-up: digits in all, groups, separators, sign."""
    if kind in ("number", "mixed"):
        n = sum(c.isdigit() for c in token)
        groups = min(5, len(re.findall(r"\d+", token)))
        marks = sum(1 << i for i, c in enumerate("-. /(:+") if c in token)
        letters = 0 if kind == "number" else 1 + token[0].isalpha() + 2 * token[-1].isalpha()
        return 10 + ((min(n, 15) * 6 + groups) * 128 + marks) * 5 + letters
    return {"X": 1, "x": 2, "XX": 3, "Xx": 4, "Xy": 5, "xx": 6, "ident": 7}.get(_shape(kind, token), 8 if kind == "mail" else 9)


@dataclass
class Tokens:
    """Tokens of many texts in one row of arrays; ``starts`` has the first token of each text."""

    spans: list[list[tuple[int, int]]]
    words: np.ndarray
    shapes: np.ndarray
    tails: np.ndarray
    coarse: np.ndarray
    keys: list[list[str]]
    starts: np.ndarray


@dataclass
class Model:
    """Vocabularies and potentials. Index 0 of each vocabulary stands for unknown, the last for outside the text."""

    words: dict[str, int]
    shapes: dict[str, int]
    tails: dict[str, int]
    weights: np.ndarray = field(default=None)
    move: np.ndarray = field(default=None)
    skip: np.ndarray = field(default=None)
    first_names: frozenset[str] = frozenset()

    def __post_init__(self) -> None:
        self._known: dict[tuple[str, str], tuple[int, int, int, int, str]] = {}
        w, s, t = len(self.words) + 2, len(self.shapes) + 2, len(self.tails) + 2
        sizes = [w] * 5 + [s] * 5 + [t] * 3 + [_HASHED]
        self._at = np.concatenate(([0], np.cumsum(sizes)))
        self._screen = regex.compile(SCREEN)

    def __getstate__(self):
        return {k: self.__dict__[k] for k in ("words", "shapes", "tails", "weights", "move", "skip", "first_names")}

    def __setstate__(self, state) -> None:
        self.__dict__.update(state)
        self.__post_init__()

    def anchored(self, text: str) -> bool:
        """Whether a text has what a detail must have."""
        return self._screen.search(text) is not None or not self.first_names.isdisjoint(_WORDS(text.lower()))

    def _look_up(self, kind: str, token: str) -> tuple[int, int, int, int, str]:
        found = self._known.get((kind, token))
        if found is None:
            lower = token.lower()
            shape = _shape(kind, token)
            key = lower if shape in ("Xx", "XX", "Xy") or kind in ("mail", "number") and len(token) > 4 else ""
            found = self.words.get(lower, 0), self.shapes.get(shape, 0), self.tails.get(lower[-4:], 0), _coarse(kind, token), key
            if len(self._known) > 200_000:
                self._known.clear()
            self._known[kind, token] = found
        return found

    def tokens(self, texts: Sequence[str]) -> Tokens:
        spans, keys, ids, starts = [], [], [], [0]
        look_up = self._look_up
        for text in texts:
            own, key = [], []
            for m in _TOKEN.finditer(text):
                *numbers, k = look_up(m.lastgroup, m.group())
                ids.append(numbers)
                own.append(m.span())
                key.append(k)
            spans.append(own)
            keys.append(key)
            starts.append(len(ids))
        w, s, t, c = np.array(ids, dtype=np.int64).reshape(-1, 4).T
        return Tokens(spans, w, s, t, c, keys, np.array(starts))

    def features(self, t: Tokens) -> np.ndarray:
        """Weight rows of each token: words and shapes around it, word ends, and hashed combinations."""
        n = len(t.words)
        text_of = np.repeat(np.arange(len(t.starts) - 1), np.diff(t.starts))

        def near(values: np.ndarray, offset: int, outside: int) -> np.ndarray:
            if offset == 0:
                return values
            out = np.full(n, outside, dtype=np.int64)
            to, of = (slice(0, max(0, n - offset)), slice(offset, n)) if offset > 0 else (slice(-offset, n), slice(0, max(0, n + offset)))
            same = text_of[to] == text_of[of]
            out[to] = np.where(same, values[of], outside)
            return out

        w = {o: near(t.words, o, len(self.words) + 1) for o in range(-3, 3)}
        s = {o: near(t.shapes, o, len(self.shapes) + 1) for o in range(-2, 3)}
        e = {o: near(t.tails, o, len(self.tails) + 1) for o in range(-1, 2)}
        c = {o: near(t.coarse, o, 0) for o in range(-1, 2)}
        plain = [self._at[i] + w[o] for i, o in enumerate(range(-2, 3))]
        plain += [self._at[5 + i] + s[o] for i, o in enumerate(range(-2, 3))]
        plain += [self._at[10 + i] + e[o] for i, o in enumerate(range(-1, 2))]

        def mix(tag: int, *parts: np.ndarray) -> np.ndarray:
            h = np.full(n, tag * 0x51ED27, dtype=np.uint64)
            for p in parts:
                h = (h ^ p.astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
                h ^= h >> np.uint64(29)
            return self._at[13] + (h & np.uint64(_HASHED - 1)).astype(np.int64)

        mixed = [
            mix(1, s[-1], s[0]), mix(2, s[0], s[1]), mix(3, s[-1], s[0], s[1]), mix(4, w[-1], s[0]), mix(5, s[0], w[1]),
            mix(6, w[-2], w[-1], s[0]), mix(7, s[0], s[1], s[2]), mix(8, s[-2], s[-1], s[0]), mix(9, w[-1], s[0], s[1]), mix(10, w[-1], w[0]),
            mix(11, c[0]), mix(12, w[-1], c[0]), mix(13, w[-2], c[0]), mix(14, c[-1], c[0], c[1]), mix(15, c[0], w[1]), mix(16, w[-3], w[-2], c[0]),
        ]
        return np.stack(plain + mixed, axis=1)

    def skips(self, t: Tokens) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of tied tokens: equal telling tokens (next occurrence), and a word with an address that holds it."""
        a, b = [], []
        for i, keys in enumerate(t.keys):
            base, last, mails = int(t.starts[i]), {}, []
            for k, key in enumerate(keys):
                if not key:
                    continue
                if key in last:
                    a.append(base + last[key])
                    b.append(base + k)
                last[key] = k
                if "@" in key or "at" in key and (" at " in key or "[at]" in key or "(at)" in key):
                    mails.append((k, key))
            for k, mail in mails:
                for key, other in last.items():
                    if other != k and len(key) > 3 and key in mail:
                        a.append(base + other)
                        b.append(base + k)
        return np.array(a, dtype=np.int64), np.array(b, dtype=np.int64)

    def label(self, texts: Sequence[str]) -> tuple[Tokens, np.ndarray]:
        """The most probable label of each token after loopy message passing."""
        t = self.tokens(texts)
        if not len(t.words):
            return t, np.zeros(0, dtype=np.int64)
        emission = np.zeros((len(t.words), 6), dtype=np.float32)
        for column in self.features(t).T:
            emission += self.weights[column]
        return t, self.beliefs(emission, t.starts, self.skips(t))[0].argmax(axis=1)

    def beliefs(self, emission: np.ndarray, starts: np.ndarray, skips: tuple[np.ndarray, np.ndarray], pairs: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Log marginals of the tokens; with ``pairs``, expected counts of neighbours' and of tied tokens' labels too."""
        a, b = skips
        tied = emission
        sent_a = sent_b = np.zeros((len(a), 6), dtype=np.float32)
        belief, counts = self._chain(tied, starts, pairs and not len(a))
        tied_counts = np.zeros((6, 6))
        for i in range(ROUNDS if len(a) else 0):
            # What a token sends over an edge leaves out what came in over the same edge.
            out_a, out_b = belief[a] - sent_b, belief[b] - sent_a
            sent_a = _normal(_log_sum(out_a[:, :, None] + self.skip[None], 1))
            sent_b = _normal(_log_sum(out_b[:, :, None] + self.skip.T[None], 1))
            tied = emission.copy()
            np.add.at(tied, b, sent_a)
            np.add.at(tied, a, sent_b)
            belief, counts = self._chain(tied, starts, pairs and i == ROUNDS - 1)
        if pairs and len(a):
            joint = (belief[a] - sent_b)[:, :, None] + (belief[b] - sent_a)[:, None, :] + self.skip[None]
            tied_counts = np.exp(_normal(joint.reshape(-1, 36))).sum(axis=0).reshape(6, 6)
        return belief, counts, tied_counts

    def _chain(self, emission: np.ndarray, starts: np.ndarray, pairs: bool) -> tuple[np.ndarray, np.ndarray]:
        """Log marginals of the chains and, with ``pairs``, expected counts of neighbouring labels; texts of similar length at once."""
        out = np.empty_like(emission)
        counts = np.zeros((6, 6))
        move = np.exp(self.move)
        sizes = np.diff(starts)
        order = np.argsort(sizes, kind="stable")
        order = order[sizes[order] > 0]
        first = 0
        while first < len(order):
            # Texts times the longest one's tokens are bounded, so one very long text pads no others.
            last = first + 1
            while last < len(order) and (last + 1 - first) * sizes[order[last]] <= _CELLS:
                last += 1
            group, first = order[first:last], last
            longest = int(sizes[group[-1]])
            at = starts[group][:, None] + np.arange(longest)[None]
            inside = np.arange(longest)[None] < sizes[group][:, None]
            e = emission[np.minimum(at, len(emission) - 1)]
            e = np.where(inside[:, :, None], np.exp(np.maximum(e - e.max(axis=2, keepdims=True), -60)), 1)
            # Tokens first, so that each step works on memory in one piece.
            e = np.ascontiguousarray(e.swapaxes(0, 1))
            ahead, back = np.empty_like(e), np.ones_like(e)
            ahead[0] = e[0] / e[0].sum(axis=1, keepdims=True)
            for k in range(1, longest):
                x = (ahead[k - 1] @ move) * e[k]
                ahead[k] = x / x.sum(axis=1, keepdims=True)
            for k in range(longest - 2, -1, -1):
                x = (back[k + 1] * e[k + 1]) @ move.T
                back[k] = np.where(inside[:, k + 1][:, None], x / x.sum(axis=1, keepdims=True), 1)
            whole = np.log(ahead * back + 1e-30).swapaxes(0, 1)
            out[at[inside]] = _normal(whole[inside])
            if pairs and longest > 1:
                joint = ahead[:-1, :, :, None] * move[None, None] * (e[1:] * back[1:])[:, :, None, :]
                joint /= joint.sum(axis=(2, 3), keepdims=True)
                counts += joint[inside.T[1:]].sum(axis=0)
        return out, counts

    def find(self, texts: Sequence[str]) -> list[list[tuple[int, int, str]]]:
        """(start, end, kind) of the private details in each text, checked for what each kind must have."""
        t, labels = self.label(texts)
        out = []
        for i, text in enumerate(texts):
            base, spans, found = int(t.starts[i]), t.spans[i], []
            own = labels[base : base + len(spans)]
            if own.any():
                k = 0
                while k < len(spans):
                    if own[k] == O:
                        k += 1
                        continue
                    end = k
                    while end + 1 < len(spans) and own[end + 1] == own[k]:
                        end += 1
                    start, stop = spans[k][0], spans[end][1]
                    span = text[start:stop].strip(" ,;:[<>]\"'`-/")
                    if span.count("(") != span.count(")"):
                        span = span.strip("() ")
                    if span and _holds(int(own[k]), span, self.first_names):
                        start = text.index(span, start)
                        found.append((start, start + len(span), KINDS[own[k] - 1]))
                    k = end + 1
            out.append(found)
        return out


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return np.log(np.exp(x - top).sum(axis=axis)) + top.squeeze(axis)


def _normal(x: np.ndarray) -> np.ndarray:
    top = x.max(axis=-1, keepdims=True)
    return x - top - np.log(np.exp(x - top).sum(axis=-1, keepdims=True))


def _holds(label: int, span: str, first_names: frozenset[str]) -> bool:
    """What a span of a kind must have, whatever the model says."""
    digits = sum(c.isdigit() for c in span)
    if label == EMAIL:
        return bool(re.search(r"\w\s?(@|\[at\]|\(at\)| AT )\s?[\w-]+\s?(\.|\[dot\]|\(dot\)| DOT )\s?[A-Za-z]", span))
    if label == PHONE:
        return digits >= 7
    if label == ID:
        return digits >= 4
    if label == ADDRESS:
        return digits >= 1 and bool(re.search(rf"{_L}{{3}}", span))
    words = re.findall(rf"{_L}+(?:['’-]{_L}+)*", re.sub(r"\bDr\.", "", span))
    return len(words) >= 2 and any(len(w) > 1 for w in words) and any(w[0].isupper() or w in first_names for w in words)


def weak_labels(text: str, first_names: set[str], surnames: set[str]) -> list[tuple[int, int, int]]:
    """(start, end, label) by patterns and known names: what the training sample is labelled with."""
    out = []
    for m in _TOKEN.finditer(text):
        if m.lastgroup == "mail" and _shape("mail", m.group()) == "mail" and not text[m.end() : m.end() + 1] == ":":
            out.append((*m.span(), EMAIL))
    out += [(*m.span(), ADDRESS) for m in _ADDRESS.finditer(text)]
    out += [(*m.span(1 if m.group(1) else 2), ID) for m in _ID.finditer(text)]
    out += [(*m.span(), PHONE) for m in _PHONE.finditer(text)]
    at = 0
    while m := _NAME.search(text, at):
        at = m.start() + 1
        a, b = m.group(1), m.group(2)
        initial = a.endswith(".") and (text[max(0, m.start() - 1) : m.start()] != "." or m.group().startswith("Dr."))
        known = a in first_names and b not in _NOT_NAMES or (b in surnames and (initial or len(a) > 1 and not a.endswith(".") and a not in _NOT_NAMES)) or (a in surnames and b in first_names and "," in m.group())
        if known and not any(s < m.end() and m.start() < e for s, e, _ in out):
            out.append((*m.span(), NAME))
            at = m.end()
    return out


_NOT_NAMES = {"The", "A", "Is", "In", "And", "Of", "To", "Inc", "LLC", "Ltd", "AG", "GmbH"}


def known_names(names: Sequence[str]) -> tuple[set[str], set[str]]:
    """First names and surnames in full names: a word is a first name if it stands before three different ones."""
    parts = [re.sub(r"\(.*?\)|\b[A-Z]\. ", " ", n).replace(",", " ").split() for n in names if n and n != n.lower() and n != n.upper()]
    counted = Counter(p[0] for p in parts if len(p) >= 2)
    partners: dict[str, set[str]] = {}
    for p in parts:
        if len(p) >= 2:
            partners.setdefault(p[0], set()).add(p[-1])
    first_names = {w for w in counted if len(partners[w]) >= 3} - _NOT_NAMES
    surnames = {w for p in parts if len(p) >= 2 and p[0] in first_names for w in p[1:] if w[:1].isupper()} - first_names
    return first_names | {p[-1] for p in parts if len(p) == 2 and p[0] in surnames and p[-1] in counted}, surnames


def labelled(texts: Sequence[str], names: Sequence[str], invented: int, r: random.Random) -> tuple[list[str], list[list[tuple[int, int, int]]], frozenset[str]]:
    """Training texts, their details and the first names: real texts as they are and with other details, and invented ones."""
    first_names, surnames = known_names(names)
    plain = sorted(w for w in first_names if len(w) > 2)
    whole: list[tuple[str, list[tuple[int, int, int]]]] = []
    for text in texts:
        spans = weak_labels(text, first_names, surnames)
        whole.append((text, spans))
        if spans:
            whole.append(details.joined(details.varied(text, spans, r, plain)))
    whole += [details.joined(details.sentence(r, plain)) for _ in range(invented)]
    return [t for t, _ in whole], [s for _, s in whole], frozenset(w.lower() for w in plain)


def fit(texts: Sequence[str], names: Sequence[str], epochs: int = EPOCHS, seed: int = 0, invented: int = INVENTED) -> Model:
    """Train on real and invented texts; ``names`` are known full names, first name first."""
    texts, spans, first_names = labelled(texts, names, invented, random.Random(seed))
    words, shapes, tails = Counter(), Counter(), Counter()
    for text in texts:
        for m in _TOKEN.finditer(text):
            lower = m.group().lower()
            if m.lastgroup in ("word", "mark", "ident"):
                words[lower] += 1
                tails[lower[-4:]] += 1
            shapes[_shape(m.lastgroup, m.group())] += 1
    index = lambda c, least: {w: i for i, w in enumerate(sorted(w for w, n in c.items() if n >= least), 1)}
    model = Model(index(words, 4), index(shapes, 3), index(tails, 4), first_names=first_names)
    model.weights = np.zeros((int(model._at[-1]), 6), dtype=np.float32)
    model.move, model.skip = np.zeros((6, 6), dtype=np.float32), np.zeros((6, 6), dtype=np.float32)
    slow, slow_move, slow_skip = np.full_like(model.weights, 1e-4), np.full((6, 6), 1e-4), np.full((6, 6), 1e-4)
    random_order = np.random.RandomState(seed)
    for _ in range(epochs):
        order = random_order.permutation(len(texts))
        for at in range(0, len(order), STEP):
            batch = order[at : at + STEP].tolist()
            t = model.tokens([texts[i] for i in batch])
            if not len(t.words):
                continue
            gold = np.zeros(len(t.words), dtype=np.int64)
            for k, i in enumerate(batch):
                for start, end, label in spans[i]:
                    for j, (a, b) in enumerate(t.spans[k]):
                        if a >= start and b <= end:
                            gold[t.starts[k] + j] = label
            rows, (a, b) = model.features(t), model.skips(t)
            belief, moved, tied = model.beliefs(model.weights[rows].sum(axis=1), t.starts, (a, b), pairs=True)
            wrong = np.exp(belief)
            wrong[np.arange(len(gold)), gold] -= 1
            flat, inverse = np.unique(rows, return_inverse=True)
            inverse = inverse.ravel()
            step = np.stack([np.bincount(inverse, np.repeat(wrong[:, k], rows.shape[1]), len(flat)) for k in range(6)], axis=1).astype(np.float32)
            slow[flat] += step * step
            model.weights[flat] -= 0.25 * step / np.sqrt(slow[flat])
            within = np.ones(max(0, len(gold) - 1), dtype=bool)
            border = t.starts[1:-1]
            within[border[(border > 0) & (border < len(gold))] - 1] = False
            np.add.at(moved, (gold[:-1][within], gold[1:][within]), -1)
            slow_move += moved * moved
            model.move = (model.move - 0.25 * moved / np.sqrt(slow_move)).astype(np.float32)
            np.add.at(tied, (gold[a], gold[b]), -1)
            slow_skip += tied * tied
            model.skip = (model.skip - 0.25 * tied / np.sqrt(slow_skip)).astype(np.float32)
    return model


def train(df: DataFrame, id_col: str, fields: dict[str, Column], name: Column, more_names: DataFrame) -> Model:
    """Fit on at most ``SAMPLE_ROWS`` values that may hold a detail, and as many distinct names, chosen by hashes.

    One pass: rows are thinned by the hash of their ids to a number that does not grow with the
    table, and of these at most an even share of each field is taken, the first
    ``SAMPLE_CHARS`` characters of each value. ``name`` is a column of authors' names,
    ``more_names`` a table with a column ``name``.
    """
    total = df.count()
    width = 1 << 40
    order = F.pmod(F.xxhash64(F.col(id_col)), F.lit(width))
    most = SAMPLE_ROWS // max(1, len(fields))
    thin = df.where(order < int(width * min(1.0, 8 * SAMPLE_ROWS / max(1, total))))
    values = F.array(*(F.struct(F.lit(f).alias("f"), F.when(c.rlike(SCREEN), F.substring(c, 1, SAMPLE_CHARS)).alias("v")) for f, c in fields.items()), F.struct(F.lit("").alias("f"), name.alias("v")))
    each = thin.select(order.alias("o"), F.explode(values).alias("x")).select("o", "x.f", "x.v").where("v is not null and v <> ''")
    # The first field is the text itself and has half of the sample.
    text = next(iter(fields))
    limit = F.when(F.col("f") == "", SAMPLE_ROWS).when(F.col("f") == text, SAMPLE_ROWS // 2).otherwise(most // 2 + 1)
    rank = F.row_number().over(Window.partitionBy("f").orderBy("o", "v"))
    taken = each.withColumn("r", rank).where((F.col("r") <= SAMPLE_ROWS) & (F.col("r") <= limit)).select("f", "v").collect()
    known = more_names.where("name is not null").select("name").distinct()
    names = {r.v for r in taken if r.f == ""} | {r.name for r in bounded_sample(known, F.col("name"), SAMPLE_ROWS)}
    return fit([r.v for r in taken if r.f != ""], sorted(names))


def _found(model: Model, values: Sequence[str | None]) -> dict[str, list[tuple[int, int, str]]]:
    """The details of each distinct value that has some."""
    distinct = [v for v in dict.fromkeys(values) if v and model.anchored(v)]
    out = {}
    for first in range(0, len(distinct), 2_000):
        part = distinct[first : first + 2_000]
        out.update((v, found) for v, found in zip(part, model.find(part)) if found)
    return out


def find_private(df: DataFrame, model: Model, id_col: str, fields: dict[str, Column]) -> DataFrame:
    """(id, field, kind, start, end): one row per private detail.

    ``start`` and ``end`` are character offsets. Null and empty values have none; repeated rows
    repeat theirs; an empty table gives an empty result; other columns are never read. No shuffle.
    The broadcast model is bounded by the training sample.
    """
    shared = df.sparkSession.sparkContext.broadcast(model)
    names = list(fields)
    id_type = df.schema[id_col].dataType.simpleString()

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, out = [], []
            for k, name in enumerate(names):
                values = batch.column(k + 1).to_pylist()
                found = _found(shared.value, values)
                for i, value in enumerate(values):
                    for start, end, kind in found.get(value, ()):
                        at.append(i)
                        out.append((name, kind, start, end))
            columns = list(zip(*out)) or [()] * 4
            kinds = (pa.string(), pa.string(), pa.int32(), pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int32())), *(pa.array(c, k) for c, k in zip(columns, kinds))], ["id", "field", "kind", "start", "end"])

    taken = df.select(F.col(id_col).alias("__id"), *(c.alias(n) for n, c in fields.items())).where(F.coalesce(*(F.col(n) for n in names)).isNotNull())
    return taken.mapInArrow(find, f"id {id_type}, field string, kind string, start int, end int").withColumnRenamed("id", id_col)


def redact(df: DataFrame, model: Model, id_col: str, fields: dict[str, Column]) -> DataFrame:
    """(id, one column per field): the fields with each private detail replaced by its kind in square brackets.

    Rows keep their order of columns; values without a detail come out unchanged, nulls as nulls.
    """
    shared = df.sparkSession.sparkContext.broadcast(model)
    names = list(fields)
    id_type = df.schema[id_col].dataType.simpleString()

    def replace(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            arrays = [batch.column(0)]
            for k in range(len(names)):
                values = batch.column(k + 1).to_pylist()
                clean = {}
                for value, found in _found(shared.value, values).items():
                    text = value
                    for start, end, kind in reversed(found):
                        text = f"{text[:start]}[{kind}]{text[end:]}"
                    clean[value] = text
                arrays.append(pa.array([clean.get(v, v) for v in values], pa.string()))
            yield pa.RecordBatch.from_arrays(arrays, ["id", *names])

    taken = df.select(F.col(id_col).alias("__id"), *(c.alias(n) for n, c in fields.items()))
    return taken.mapInArrow(replace, f"id {id_type}, " + ", ".join(f"`{n}` string" for n in names)).withColumnRenamed("id", id_col)
