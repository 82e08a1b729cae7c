"""Text that was decoded with a wrong character encoding: finding and restoring it.

A multinomial classifier over hashed byte bigrams tells clean words from words garbled by each
encoding chain, for instance UTF-8 read as Windows-1252, twice. It is trained on records of the
collection that are garbled here, chain by chain, on purpose. The predicted chain is then undone word
by word. A word only counts for a chain if undoing it decodes strictly at every step and the result
is more probable as clean text than the word was. A text is reported if the words that speak for a
chain outweigh a threshold; words that are clean in a partly garbled text stay as they are.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scholia.plans.tables import bounded_sample

#: Buckets of hashed byte bigrams.
BUCKETS = 1 << 14
#: Log odds that all words of a text together must reach.
THRESHOLD = 7.0
#: How much a word may speak against a chain, as a log, and still be undone with words that speak for it.
SLACK = 4.0
#: What each place in a word where two alphabets meet costs, as a log.
MIXTURE = 6.0
#: Bounds of the training sample, texts and characters of each, and texts garbled for each chain.
SAMPLE_TEXTS, SAMPLE_CHARS, PER_CHAIN = 8_000, 2_000, 400

#: Single-byte encodings are total here: bytes an encoding leaves undefined stand for themselves.
_SINGLE = ("latin-1", "cp1252", "cp1250", "cp1251", "cp1254", "iso8859-2", "iso8859-9", "koi8-r", "cp866", "cp437", "cp850", "mac-roman")
#: (true encoding, encoding it was read with) of one step.
_UTF8_READ_AS = ("cp1252", "latin-1", "cp1251", "cp437", "mac-roman", "cp850", "cp1250", "koi8-r", "cp866", "cp1254", "gb18030", "big5", "shift_jis", "euc-kr")
_OTHER_STEPS = (
    *(("cp1251", w) for w in ("latin-1", "cp1252", "koi8-r", "mac-roman")),
    *(("koi8-r", w) for w in ("latin-1", "cp1252", "cp1251")),
    *(("cp866", w) for w in ("latin-1", "cp1252", "cp1251", "koi8-r")),
    *((t, w) for t in ("gb18030", "euc-kr", "shift_jis", "euc-jp", "big5") for w in ("latin-1", "cp1252")),
    *((t, w) for t in ("cp1250", "iso8859-2") for w in ("latin-1", "cp1252")),
    *((t, w) for t in ("cp1254",) for w in ("latin-1", "cp1252")),
    *(("cp1252", w) for w in ("cp1250", "cp1251", "cp437", "mac-roman", "cp850", "koi8-r")),
    ("gb18030", "shift_jis"),
    ("shift_jis", "gb18030"),
    ("euc-jp", "gb18030"),
    ("euc-kr", "gb18030"),
)
_CYRILLIC = {"cp1251", "koi8-r", "cp866"}
Chain = tuple[tuple[str, str], ...]
LOSSY = "lossy"


def chains() -> list[Chain]:
    """All encoding chains that are told apart; repeated steps up to three times for the commonest."""
    once: list[Chain] = [(("utf-8", w),) for w in _UTF8_READ_AS]
    once += [(step,) for step in _OTHER_STEPS]
    twice: list[Chain] = [(("utf-8", w),) * 2 for w in ("cp1252", "latin-1", "cp1251", "cp437", "mac-roman", "cp850", "cp1250")]
    mixed: list[Chain] = [(("utf-8", "latin-1"), ("utf-8", "cp1252")), (("utf-8", "cp1252"), ("utf-8", "latin-1"))]
    thrice: list[Chain] = [(("utf-8", w),) * 3 for w in ("cp1252", "latin-1")]
    return once + twice + mixed + thrice


def name(chain: Chain) -> str:
    return " > ".join(f"{true} as {wrong}" for true, wrong in chain)


@cache
def _tables(encoding: str) -> tuple[list[str], dict[str, int]]:
    chars = []
    for b in range(256):
        try:
            chars.append(bytes([b]).decode(encoding))
        except UnicodeDecodeError:
            chars.append(chr(b))
    back = {c: b for b, c in reversed(list(enumerate(chars)))}
    return chars, back


def _encode(text: str, encoding: str) -> bytes | None:
    if encoding in _SINGLE:
        back = _tables(encoding)[1]
        try:
            return bytes([back[c] for c in text])
        except KeyError:
            return None
    try:
        return text.encode(encoding)
    except UnicodeEncodeError:
        return None


def _decode(data: bytes, encoding: str, strict: bool = True) -> str | None:
    if encoding in _SINGLE:
        chars = _tables(encoding)[0]
        return "".join([chars[b] for b in data])
    try:
        return data.decode(encoding, "strict" if strict else "replace")
    except UnicodeDecodeError:
        return None


def garble(text: str, chain: Chain) -> str | None:
    """``text`` after the wrong decodings of ``chain``; None if it cannot be written in the true encoding."""
    for true, wrong in chain:
        data = _encode(text, true)
        if data is None:
            return None
        text = _decode(data, wrong, strict=False)
    return text


def restore(text: str, chain: Chain) -> str | None:
    """``text`` with the decodings of ``chain`` undone; None unless every step decodes strictly."""
    for true, wrong in reversed(chain):
        data = _encode(text, wrong)
        if data is None:
            return None
        text = _decode(data, true)
        if text is None:
            return None
    return text


def _buckets(word: str) -> np.ndarray:
    data = np.frombuffer(b" " + word.encode("utf-8", "replace") + b" ", np.uint8).astype(np.uint32)
    pairs = data[:-1] * 256 + data[1:]
    # Pairs of two ASCII bytes say nothing about encodings.
    pairs = pairs[(data[:-1] > 127) | (data[1:] > 127)]
    return ((pairs * np.uint32(2654435761)) >> np.uint32(18)).astype(np.int64)


_MIXTURE = re.compile(r"[A-Za-zÀ-ɏ][Ͱ-ӿ]|[Ͱ-ӿ][A-Za-zÀ-ɏ]|[Ͱ-Ͽ][Ѐ-ӿ]|[Ѐ-ӿ][Ͱ-Ͽ]|[ｦ-ﾟ][A-Za-zÀ-ӿ]|[A-Za-zÀ-ӿ][ｦ-ﾟ]|[^\W\d_][─-▟]|[─-▟][^\W\d_]")


def _mixtures(word: str) -> int:
    """Places where letters of two alphabets, or a letter and a box drawing, stand side by side."""
    return len(_MIXTURE.findall(word))


_QUOTED = re.compile(r"(?<![^\s(])([\"'`])([^\s\w]{0,2}[^\s]{1,12})\1(?![^\s.,;:!?)])")


def _odd_words(text: str) -> list[str]:
    """Words between plain spaces with other than ASCII characters, if not just unusual spaces."""
    return [w for w in text.split(" ") if not w.isascii() and any(ord(c) > 127 and not c.isspace() for c in w)]


@dataclass
class Model:
    """Log odds of each chain against clean text, and log probabilities of clean text, per bucket."""

    chains: list[Chain]
    odds: np.ndarray
    clean: np.ndarray

    def __post_init__(self) -> None:
        self._words: dict[str, tuple[np.ndarray, dict[int, tuple[str, float]]]] = {}

    def __getstate__(self):
        return {"chains": self.chains, "odds": self.odds, "clean": self.clean}

    def __setstate__(self, state) -> None:
        self.__dict__.update(state)
        self.__post_init__()

    def word(self, word: str) -> tuple[np.ndarray, dict[int, tuple[str, float]]]:
        """For each chain what the word says for it, zero if not in favour or not strictly decodable; and the restored forms with how much more, or a little less, probable they are."""
        found = self._words.get(word)
        if found is None:
            here = _buckets(word)
            odds = self.odds[:, here].sum(axis=1)
            as_it_is = self.clean[here]
            restored = {}
            mixed = _mixtures(word)
            for c in np.flatnonzero(odds > -SLACK):
                back = restore(word, self.chains[c])
                gain = -SLACK
                if back is not None and back != word:
                    gain = self._gain(as_it_is, self.clean[_buckets(back)], self.chains[c]) - MIXTURE * max(0, _mixtures(back) - mixed)
                odds[c] = min(odds[c], gain)
                if gain > -SLACK:
                    restored[int(c)] = back, gain
            found = np.maximum(odds, 0), restored
            if len(self._words) > 100_000:
                self._words.clear()
            self._words[word] = found
        return found

    def _only_case(self, words: Sequence[str], c: int) -> bool:
        """Whether a chain between Cyrillic encodings gains by letter case alone: one has capitals where others have small letters, and texts in capitals are few."""
        if not {e for step in self.chains[c] for e in step} <= _CYRILLIC:
            return False
        return sum(self._lower(self.word(w)[1][c][0]) - self._lower(w) for w in words if c in self.word(w)[1]) <= 0

    def _lower(self, word: str) -> float:
        return float(self.clean[_buckets(word.lower())].sum())

    def _regained(self, words: Sequence[str], c: int) -> float:
        """How much more probable the words are with chain ``c`` undone, the worse of as they stand and in small letters."""
        undone = [(w, *self.word(w)[1][c]) for w in words if c in self.word(w)[1]]
        return min(sum(gain for _, _, gain in undone), sum(gain + self._lower(back) - float(self.clean[_buckets(back)].sum()) for _, back, gain in undone))

    def _one_character(self, quoted: str) -> bool:
        """Whether a quoted run is one character, as it stands or with some chain undone."""
        return not quoted.isascii() and (len(quoted) == 1 or any(len(restore(quoted, c) or "") == 1 for c in self.chains))

    @staticmethod
    def _gain(before: np.ndarray, after: np.ndarray, chain: Chain) -> float:
        """How much more probable the restored word is.

        A chain without UTF-8 keeps the number of characters, so there the word must also be more
        probable for its length: scripts differ in bytes per character.
        """
        if not len(after):
            return -1.0
        gain = after.sum() - before.sum()
        if all(true != "utf-8" for true, _ in chain):
            gain = min(gain, (after.mean() - before.mean()) * len(after))
        return float(gain)

    def detect(self, text: str | None, again: int = 3, lenient: bool = False) -> tuple[str, str | None] | None:
        """(chain, restored text) of a garbled text, None for a clean one.

        Where characters are lost the chain is ``lossy`` and the restored text keeps the words that
        hold a replacement character; it is null if no other word can be restored. A garbled
        character that stands alone in quotation marks is an example, not a case. ``lenient``
        reports texts in Cyrillic capitals too, which is right only for leaving texts out.
        """
        if not text or text.isascii():
            return None
        looked = _QUOTED.sub(lambda m: m.group(1) * 2 if self._one_character(m.group(2)) else m.group(), text)
        words = _odd_words(looked)
        if not words:
            return None
        lossy = "�" in looked
        if lossy:
            words = [w for w in words if "�" not in w]
        total = sum((self.word(w)[0] for w in words), np.zeros(len(self.chains)))
        while total[best := int(total.argmax())] >= THRESHOLD and not lenient and self._only_case(words, best):
            total[best] = 0
        if total[best] < THRESHOLD:
            return (LOSSY, None) if lossy else None
        # Chains that explain the words about as well are told apart by what they restore.
        rivals = np.flatnonzero(total >= 0.6 * total[best]).tolist()
        if len(rivals) > 1:
            best = max(rivals, key=lambda c: (self._regained(words, c), total[c]))
        chain = self.chains[best]

        def undo(word: str) -> str:
            odds, restored = self.word(word)
            back, gain = restored.get(best, (word, 0.0))
            # A word that alone would rather stay is undone with the others if they leave no doubt.
            return back if gain > 0 or total[best] - odds[best] >= THRESHOLD else word

        back = " ".join(w if w.isascii() or "�" in w else undo(w) for w in text.split(" "))
        if lossy:
            return LOSSY, back if back != text else None
        # What was garbled more than once may come out garbled once less.
        inner = self.detect(back, again - 1) if back != text and again else None
        if inner and inner[1] is not None and inner[0].startswith("utf-8") and chain[0][0] == "utf-8":
            return f"{inner[0]} > {name(chain)}", inner[1]
        return name(chain), back


def fit(texts: Sequence[str], per_chain: int = PER_CHAIN, rounds: int = 2) -> Model:
    """Train on clean texts and on the same texts garbled by each chain.

    ``texts`` may hold some garbled ones: those the first model reports are left out of the next.
    """
    every = chains()
    clean = [t for t in texts if t and "�" not in t]
    model = None
    for _ in range(max(1, rounds)):
        if model is not None:
            clean = [t for t in clean if model.detect(t, lenient=True) is None]
        counts = np.zeros((len(every) + 1, BUCKETS))
        for text in clean:
            for word in _odd_words(text):
                np.add.at(counts[0], _buckets(word), 1)
                # Texts in capitals are few, but no less clean.
                for other in {word.upper(), word.title()} - {word}:
                    np.add.at(counts[0], _buckets(other), 0.2)
        odd = [t for t in clean if not t.isascii()]
        for i, chain in enumerate(every, 1):
            left = per_chain
            for text in odd:
                bad = garble(text, chain)
                if bad is None or bad == text:
                    continue
                for word in _odd_words(bad):
                    if "�" not in word:
                        np.add.at(counts[i], _buckets(word), 1)
                left -= 1
                if not left:
                    break
        smoothed = counts + 0.02
        logs = np.log(smoothed / smoothed.sum(axis=1, keepdims=True))
        odds = np.clip(logs[1:] - logs[0], -6, 6)
        odds[counts[1:].sum(axis=1) == 0] = -6
        model = Model(every, odds.astype(np.float32), logs[0].astype(np.float32))
    return model


def train(df: DataFrame, id_col: str, fields: Iterable[str]) -> Model:
    """Fit on at most ``SAMPLE_TEXTS`` texts with other than ASCII characters (``SAMPLE_CHARS`` of each), chosen by the hash of their ids in one pass."""
    first = next(iter(fields))
    texts = df.select(F.substring(F.col(first), 1, SAMPLE_CHARS).alias("t"), F.col(id_col).alias("key"))
    return fit([r.t for r in bounded_sample(texts, F.col("key"), SAMPLE_TEXTS, F.col("t").rlike(r"[^\x00-\x7f]"), spare=6)])


def find_garbled(df: DataFrame, model: Model, id_col: str, fields: Sequence[str]) -> DataFrame:
    """(id, field, chain, restored) of each garbled field.

    ``chain`` names the wrong decodings or is ``lossy`` (then ``restored`` is what can be restored, or null). Null, empty and
    ASCII fields are never garbled; repeated rows are reported each; an empty table gives an empty
    result; other columns are never read. No shuffle; the broadcast model has a fixed size.
    """
    shared = df.sparkSession.sparkContext.broadcast(model)
    fields = list(fields)
    id_type = df.schema[id_col].dataType.simpleString()
    odd = lambda f: F.when(F.col(f).rlike(r"[^\x00-\x7f]"), F.col(f)).alias(f)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        detect = shared.value.detect
        for batch in batches:
            at, out = [], []
            for k, field in enumerate(fields):
                for i, text in enumerate(batch.column(k + 1).to_pylist()):
                    found = detect(text) if text else None
                    if found:
                        at.append(i)
                        out.append((field, *found))
            columns = list(zip(*out)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int32())), *(pa.array(c, pa.string()) for c in columns)], ["id", "field", "chain", "restored"])

    candidates = df.select(F.col(id_col).alias("__id"), *(odd(f) for f in fields)).where(F.coalesce(*(F.col(f) for f in fields)).isNotNull())
    return candidates.mapInArrow(find, f"id {id_type}, field string, chain string, restored string").withColumnRenamed("id", id_col)
