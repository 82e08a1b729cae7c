"""Natural language inside source code: sentences in comments and string literals.

Words are broken into the pieces of a public tokenizer's vocabulary and scored under unigram counts
of each language, and under counts of program code as a class of its own. A comment or literal is
labelled word by word with the labelling of maximum posterior (a switch of language costs
more inside a line than at a line's end), so that blocks in several languages and sentences broken
over lines come out right. A run of five words in one language is a sentence; for Chinese and
Japanese, ten characters.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scholia.functions.langs import by_alias, language_of, rules_of
from scholia.llm.bpe import TOKENIZER_DIR
from scholia.operators.lexer import scan
from scholia.plans.tables import bounded_sample

CODE = "code"
#: Scripts written without spaces between words: a sentence is measured in characters.
UNSPACED = ("zh", "ja")
MIN_WORDS, MIN_CHARS = 5, 10
#: Costs of a change of class, in nats, inside a line and between lines.
SWITCH_IN_LINE, SWITCH_AT_LINE = 7.0, 3.0
#: What one word can say against a class, in nats; keeps a stray identifier from ending a sentence.
FLOOR = 12.0
#: Bounds of the training sample: rows and characters of labelled text, rows of source files.
SAMPLE_TEXTS, SAMPLE_CHARS, SAMPLE_FILES = 3_000, 1_500, 500

_ESCAPE = re.compile(r"\\(?:u\{([0-9a-fA-F]{1,6})\}|u([0-9a-fA-F]{4})|U([0-9a-fA-F]{8})|x([0-9a-fA-F]{2})|x\{([0-9a-fA-F]{1,6})\}|([\s\S]))")
_PLAIN = {"n": "\n", "t": "\t", "r": "\r", "0": " ", "b": " ", "f": " ", "v": " ", "a": " "}
_DECORATION = re.compile(r"(?m)^[\s*#;%!/|-]+")
_PUNCTUATION = "\"'`.,;:!?()[]{}<>«»„“”‘’‚…—–-*#/\\=+|~^&$。，、；：！？（）「」『』【】《》・"
_CODE_LIKE = re.compile(r"[_\\=<>{}()\[\]$%#@|^~&*]|::|\w/|/\w|[a-zа-я][A-ZА-Я]|\d[a-zA-Z]|[a-zA-Z]\d|\w\.\w|--\w")
_LETTER = re.compile(r"[^\W\d_]")
_UNSPACED_CHAR = re.compile(r"[぀-ヿ㐀-鿿豈-﫿ー]")
_UNSPACED_RUN = re.compile(r"[぀-ヿ㐀-鿿豈-﫿ー、。，；：！？（）「」]+")


def unescape(body: str) -> str:
    """The characters that a literal's escapes stand for."""
    if "\\" not in body:
        return body

    def one(m: re.Match) -> str:
        number = next((g for g in m.groups()[:5] if g), None)
        if number:
            n = int(number, 16)
            return chr(n) if n < 0x110000 else " "
        return _PLAIN.get(m.group(6), m.group(6))

    out = _ESCAPE.sub(one, body)
    return out.encode("utf-16", "surrogatepass").decode("utf-16", "replace")


def snippets(text: str, rules) -> Iterator[str]:
    """Plain text of each comment and literal of a source text."""
    for t in scan(text, rules):
        body = t.text[len(t.start) : len(t.text) - len(t.end or "")]
        if t.kind == "string":
            rule = next(r for r in rules.strings if (r.start, r.end) == (t.start, t.end))
            if rule.escape == "\\":
                body = unescape(body)
            elif rule.escape == "double":
                body = body.replace(rule.end * 2, rule.end)
        else:
            body = _DECORATION.sub("", body.replace("\r", ""))
        yield body


@lru_cache(maxsize=2)
def _processor(directory: str):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=os.path.join(directory, "piece_bpe_32k.model"))


def _words(line: str) -> Iterator[str]:
    """Words of a line; a stretch in a script without spaces is taken apart from what touches it."""
    for word in line.split():
        if _UNSPACED_CHAR.search(word):
            at = 0
            for m in _UNSPACED_RUN.finditer(word):
                if m.start() > at:
                    yield word[at : m.start()]
                yield m.group()
                at = m.end()
            if at < len(word):
                yield word[at:]
        else:
            yield word


@dataclass
class Model:
    """Log probabilities of pieces: one row per piece, one column per class, the last is code.

    Natural classes see words in lower case, code sees them as they stand.
    """

    classes: list[str]
    table: np.ndarray
    directory: str = TOKENIZER_DIR

    def __post_init__(self) -> None:
        self._scores: dict[str, np.ndarray] = {}
        self._found: dict[str, tuple[tuple[str, int], ...]] = {}

    def __getstate__(self):
        return {"classes": self.classes, "table": self.table, "directory": self.directory}

    def __setstate__(self, state) -> None:
        self.__dict__.update(state)
        self.__post_init__()

    def score(self, word: str) -> np.ndarray:
        out = self._scores.get(word)
        if out is None:
            encode = _processor(self.directory).encode
            bare = word.strip(_PUNCTUATION) or word
            out = self.table[encode(bare.lower())].sum(axis=0)
            out[-1] = self.table[encode(bare), -1].sum()
            if _CODE_LIKE.search(word.strip("\"'`.,;:!?()[]{}-*#")):
                out[:-1] -= 6
            elif bare != bare.lower():
                out[:-1] -= 4 if bare.isupper() and len(bare) > 1 else 1.5
            # A stretch in a script without spaces says as much as the words it holds.
            units = max(1, len(word) // 4) if _UNSPACED_CHAR.search(word) else 1
            out = np.maximum(out, out.max() - FLOOR * units).astype(np.float32)
            if len(self._scores) > 200_000:
                self._scores.clear()
            self._scores[word] = out
        return out

    def label(self, text: str) -> list[tuple[str, str]]:
        """(word, class) of the labelling with maximum posterior."""
        words, switch = [], []
        for line in text.split("\n"):
            for k, word in enumerate(w for w in _words(line) if _LETTER.search(w)):
                words.append(word)
                switch.append(SWITCH_IN_LINE if k else SWITCH_AT_LINE)
        if not words:
            return []
        best, back = self.score(words[0]), []
        for word, cost in zip(words[1:], switch[1:]):
            top = int(best.argmax())
            moved = best[top] - cost
            stay = best >= moved
            back.append((stay, top))
            best = np.where(stay, best, moved) + self.score(word)
        at = int(best.argmax())
        path = [at]
        for stay, top in reversed(back):
            at = at if stay[at] else top
            path.append(at)
        return [(w, self.classes[c]) for w, c in zip(words, reversed(path))]

    def sentences(self, text: str) -> tuple[tuple[str, int], ...]:
        """(language, characters) of each sentence of a comment or literal."""
        found = self._found.get(text)
        if found is None:
            found = tuple(self._sentences(text))
            if len(text) <= 400:
                if len(self._found) > 100_000:
                    self._found.clear()
                self._found[text] = found
        return found

    def _sentences(self, text: str) -> Iterator[tuple[str, int]]:
        language, words, chars, gap = "", 0, 0, 0

        def long_enough() -> bool:
            return chars >= MIN_CHARS if language in UNSPACED else words >= MIN_WORDS

        for word, kind in self.label(text):
            if kind == CODE:
                gap += 1
                if gap <= 2:
                    continue
            if kind != language or gap > 2:
                if language and long_enough():
                    yield language, chars
                language, words, chars = ("" if kind == CODE else kind), 0, 0
            if kind != CODE:
                gap = 0
                words += 1
                chars += len(_UNSPACED_CHAR.findall(word)) if language in UNSPACED else len(word)
        if language and long_enough():
            yield language, chars


def fit(samples: Iterable[tuple[str, str]], code: Iterable[str], classes: list[str], directory: str = TOKENIZER_DIR, rounds: int = 2) -> Model:
    """Piece counts per class from labelled texts, whose labels may be wrong, and from program code.

    After the first round a line counts only where its own most probable class is its text's label,
    which takes out wrongly labelled texts, quoted code and logs.
    """
    processor = _processor(directory)
    size, names = processor.vocab_size(), [*classes, CODE]
    lines = [(classes.index(language), line) for language, text in samples if language in classes for line in text.split("\n") if _LETTER.search(line)]
    code_counts = np.zeros(size)
    for text in code:
        for word in text.split():
            np.add.at(code_counts, processor.encode(word.strip(_PUNCTUATION) or word), 1)
    pieces: dict[str, list[int]] = {}
    model = None
    for _ in range(max(1, rounds)):
        counts = np.zeros((size, len(names)))
        counts[:, -1] = code_counts
        for column, line in lines:
            words = [w for w in _words(line) if _LETTER.search(w)]
            if model is not None:
                total = sum((model.score(w) for w in words), np.zeros(len(names)))
                if total.argmax() != column:
                    continue
            for w in words:
                if w not in pieces:
                    pieces[w] = processor.encode((w.strip(_PUNCTUATION) or w).lower())
                counts[pieces[w], column] += 1
        smoothed = counts + 0.05
        model = Model(names, np.log(smoothed / smoothed.sum(axis=0)).astype(np.float32), directory)
    return model


def code_only(text: str, rules) -> str:
    """A source text without its comments and literals."""
    out = text
    for t in scan(text, rules):
        out = out.replace(t.text, " ", 1)
    return out


def train(documents: DataFrame, files: DataFrame, classes: list[str], directory: str = TOKENIZER_DIR) -> Model:
    """Fit on at most ``SAMPLE_TEXTS`` labelled texts and ``SAMPLE_FILES`` source files, chosen by the hash of their ids."""
    labelled = F.col("lang").isin(*classes) & F.col("text").isNotNull() & ~F.coalesce(F.col("source"), F.lit("")).isin("ci_log", "source")
    texts = bounded_sample(documents.select("lang", F.substring("text", 1, SAMPLE_CHARS).alias("text"), "source", "doc_id"), F.col("doc_id"), SAMPLE_TEXTS, labelled)
    filled = files.select("path", F.substring("content", 1, 2 * SAMPLE_CHARS).alias("content"), "file_id")
    sources = bounded_sample(filled, F.col("file_id"), SAMPLE_FILES, F.length("content") > 0)
    code = (code_only(r.content, rules) for r in sources if (rules := rules_of(language_of(r.path, r.content))))
    return fit(((r.lang, r.text) for r in texts), code, classes, directory)


def find_languages(files: DataFrame, model: Model, id_col: str = "file_id", path_col: str = "path", content_col: str = "content", lang_col: str | None = "lang") -> DataFrame:
    """(id, nat_lang, n_sentences, n_chars): languages of the sentences in each file's comments and literals.

    The programming language comes from the path, else from ``lang_col``. Files with null or empty
    content, of unknown type or without a sentence give no rows; repeated rows repeat theirs; an
    empty table gives an empty result. The model is broadcast; its size is bounded by the vocabulary.
    """
    shared = files.sparkSession.sparkContext.broadcast(model)
    id_type = files.schema[id_col].dataType.simpleString()

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sentences = shared.value.sentences
        for batch in batches:
            ids, out = [], []
            paths, contents, langs = (batch.column(i).to_pylist() for i in (1, 2, 3))
            for i, (path, content, named) in enumerate(zip(paths, contents, langs)):
                if not content:
                    continue
                rules = rules_of(language_of(path, content) or by_alias(named or ""))
                if rules is None:
                    continue
                totals: dict[str, list[int]] = {}
                for text in snippets(content, rules):
                    for language, chars in sentences(text):
                        t = totals.setdefault(language, [0, 0])
                        t[0] += 1
                        t[1] += chars
                ids.extend([i] * len(totals))
                out.extend((language, *t) for language, t in totals.items())
            columns = list(zip(*out)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(ids, pa.int32())), pa.array(columns[0], pa.string()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.int64())],
                ["id", "nat_lang", "n_sentences", "n_chars"],
            )

    named = F.col(lang_col) if lang_col else F.lit(None).cast("string")
    taken = files.select(F.col(id_col).alias("id"), F.col(path_col).alias("p"), F.col(content_col).alias("c"), named.alias("l"))
    return taken.mapInArrow(find, f"id {id_type}, nat_lang string, n_sentences bigint, n_chars bigint").withColumnRenamed("id", id_col)
