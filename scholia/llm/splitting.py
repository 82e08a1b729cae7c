"""Long texts cut into overlapping pieces under a size limit, by agglomerative merging.

A text is taken apart at its natural boundaries into atomic segments: paragraphs, lines, sentences,
and, only where such a segment alone is too large, clauses, words and characters. Adjacent pairs
wait by their size; the pair with the weakest boundary is merged first, while its size plus the overlap
fits the limit. What is left are the pieces, each preceded by the overlap.
"""

from __future__ import annotations

import gc
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scholia.llm.bpe import TOKENIZER_DIR, Encoder, encoder

#: Strength of a boundary: end of a text, paragraph, line, sentence, clause, word, none.
TEXT, PARAGRAPH, LINE, SENTENCE, CLAUSE, WORD, NONE = 9, 5, 4, 3, 2, 1, 0
#: Tokens an overlap may have beyond what is asked for before a piece is checked again.
_SLACK = 2
#: A unit is never larger: longer stretches without a boundary are cut between whole characters.
_UNIT = 32
#: Inside a stretch of plain characters without white space, where there is no natural boundary, a unit has at least so many, except the last.
_GRAIN = 8
#: Texts worked on together, and characters after which no other text joins them; no piece depends on it.
_TEXTS, _CHARS = 200, 400_000

#: Splits a text into what lies between marks and the marks, in turn.
_BREAK = re.compile(r"([\r\n.!?…。！？]+[\"'”’»)\]」』）]*\s*)")
_CLAUSE = re.compile(r"[,;:]+\s+|[，、；：]")


class _Grades(dict):
    """Twice the strength of the boundary behind a mark, and one more where its last character belongs to what follows."""

    def __missing__(self, mark: str) -> int:
        lines, code = mark.count("\n"), 0
        if lines or mark[-1:].isspace() or mark[:1] in set("。！？"):
            # A single space belongs to the word that follows, as it does in the tokens.
            code = 2 * (PARAGRAPH if lines > 1 else LINE if lines or "\r" in mark else SENTENCE) + (mark[-1] == " ")
        if len(mark) <= 12 and len(self) < 10_000:
            self[mark] = code
        return code


_GRADES = _Grades()


class Units:
    """Texts as one row of small units whose tokens add up to each text's.

    Units are words with the space before them and runs of white space, as pre-tokenisation cuts
    them; long ones are cut further, between pre-tokens or between tokens that end with a whole
    character. ``words`` are the units, ``ends`` character offsets in all texts laid end to end,
    ``tokens`` running totals; both begin with 0. The units of text ``i`` begin at ``firsts[i]``.
    """

    def __init__(self, texts: list[str], encode: Encoder):
        self.texts, self.encode = texts, encode
        self.words: list[str] = []
        #: Units that end where no word does.
        self.inside: list[int] = []
        sizes: list[int] = []
        firsts = [0]
        for text in texts:
            chunks = encode.split(text) if encode.separators(text) else encode.chunk(text)
            counts = list(map(encode.sizes.__getitem__, chunks))
            large: list[int] = []
            if text.isascii():
                if chunks and (max(counts) > _UNIT or not min(counts)):
                    large = [i for i, n in enumerate(counts) if n > _UNIT or not n]
            elif max(map(len, chunks)) > 12:
                large = [i for i, word in enumerate(chunks) if len(word) > 12 and (len(word) > 60 or counts[i] > _UNIT or not word.isascii())]
            done = 0
            for i in large:
                self.words += chunks[done:i]
                sizes += counts[done:i]
                first = len(self.words)
                self._part(chunks[i], sizes)
                self.inside += range(first, len(self.words) - 1)
                done = i + 1
            self.words += chunks[done:] if done else chunks
            sizes += counts[done:] if done else counts
            firsts.append(len(self.words))
        n = len(self.words)
        self.ends, self.tokens, self.firsts = np.zeros(n + 1, dtype=np.int64), np.zeros(n + 1, dtype=np.int64), np.array(firsts)
        np.cumsum(np.fromiter(map(len, self.words), np.int64, n), out=self.ends[1:])
        np.cumsum(np.fromiter(sizes, np.int64, n), out=self.tokens[1:])
        #: Where each text begins, and its tokens.
        self.begins, self.totals = self.ends[self.firsts], np.diff(self.tokens[self.firsts])

    def _part(self, chunk: str, sizes: list[int]) -> None:
        """Add a long stretch as several units."""
        plain = chunk.isascii()
        least = _GRAIN if plain else 0
        encode, words = self.encode, self.words
        start = at = n = 0
        for word in encode.words(chunk):
            # Plain characters are one token each at most.
            tokens = encode.word_sizes[word] if plain and len(word) <= _UNIT else len(encode.ids_of(word)) >> 2
            if tokens <= _UNIT:
                at += len(word)
                n += tokens
                if n >= least:
                    words.append(chunk[start:at])
                    sizes.append(n)
                    start, n = at, 0
            else:
                if n:
                    words.append(chunk[start:at])
                    sizes.append(n)
                self._cut(encode.ids_of(word), sizes)
                at += len(word)
                start, n = at, 0
        if n:
            words.append(chunk[start:at])
            sizes.append(n)

    def _cut(self, ids: bytes, sizes: list[int]) -> None:
        part, n = b"", 0
        for token in array("i", ids):
            piece = self.encode.vocabulary.bytes_of[token]
            if n >= _UNIT and piece[0] & 0xC0 != 0x80:
                self.words.append(part.decode("utf-8"))
                sizes.append(n)
                part, n = b"", 0
            part += piece
            n += 1
        self.words.append(part.decode("utf-8"))
        sizes.append(n)

    def __len__(self) -> int:
        return len(self.words)

    def text_of(self, ends: np.ndarray) -> np.ndarray:
        """The texts that units ``ends - 1`` belong to."""
        return np.searchsorted(self.firsts, ends) - 1

    def count(self, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """Tokens of units ``first`` to ``last - 1`` as a text of their own: white space at its end is one run there."""
        words, tokens = self.words, self.tokens
        n = tokens[last] - tokens[first]
        for i, tail in enumerate(last.tolist()):
            if words[tail - 1].isspace():
                end, least = tail, int(first[i])
                while tail > least and words[tail - 1].isspace():
                    tail -= 1
                space = words[tail] if end - tail == 1 else "".join(words[tail:end])
                n[i] = tokens[tail] - tokens[least] + (self.encode.sizes[space] or self.encode.count(space))
        return n

    def overlap(self, at: np.ndarray, wanted: int) -> tuple[np.ndarray, np.ndarray]:
        """(character offset, tokens) of the ``wanted`` tokens before units ``at``; more only for a whole character, word end or space."""
        begin = self.firsts[self.text_of(at + 1)]
        if not wanted:
            return self.ends[at], np.zeros(len(at), dtype=np.int64)
        unit = np.maximum(begin, np.searchsorted(self.tokens, self.tokens[at] - wanted, "right") - 1)
        start, have = self.ends[unit], self.tokens[at] - self.tokens[unit]
        drop = have - wanted
        for i in np.flatnonzero(drop > 0).tolist():
            word = self.words[unit[i]]
            if not word.isspace() and "'" not in word:
                chars, tokens = self._without(word, int(drop[i]))
                start[i] += chars
                have[i] -= tokens
        return start, have

    def _without(self, word: str, drop: int) -> tuple[int, int]:
        """(characters, tokens) of a word's first ``drop`` tokens, fewer only to leave a character whole."""
        ids = array("i", self.encode.ids_of(word))
        bytes_of = self.encode.vocabulary.bytes_of
        while drop and bytes_of[ids[drop]][0] & 0xC0 == 0x80:
            drop -= 1
        return len(b"".join([bytes_of[i] for i in ids[:drop]]).decode("utf-8")), drop

    def boundaries(self) -> np.ndarray:
        """Strength of the boundary at the end of each unit, clauses aside."""
        strength = np.full(len(self), WORD, dtype=np.int8)
        strength[self.inside] = NONE
        parts: list[str] = []
        for text in self.texts:
            parts += _BREAK.split(text)
            parts.append("")
        at = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)))[1::2]
        code = np.fromiter(map(_GRADES.__getitem__, parts[1::2]), np.int64, len(parts) // 2)
        # What is found at the end of a text makes no boundary before it.
        found = (code > 0) & ~np.isin(at, self.begins)
        self._mark(strength, at[found] - (code[found] & 1), code[found] >> 1)
        strength[self.firsts[1:] - 1] = TEXT
        return strength

    def mark_clauses(self, strength: np.ndarray, text: int, first: int, last: int) -> None:
        """Add the boundaries of clauses within units ``first`` to ``last - 1`` of a text."""
        base, content = int(self.begins[text]), self.texts[text]
        at = [m.end() - (content[m.end() - 1] == " ") for m in _CLAUSE.finditer(content, int(self.ends[first]) - base, int(self.ends[last]) - base)]
        # The segment's own end keeps its grade.
        self._mark(strength[: last - 1], np.array(at, dtype=np.int64) + base, CLAUSE)

    def _mark(self, strength: np.ndarray, at: np.ndarray, grade: np.ndarray | int) -> None:
        """Boundaries that do not fall between two units are none."""
        unit = np.searchsorted(self.ends, at)
        right = (self.ends[unit] == at) & (unit <= len(strength))
        # No two marks end at the same unit.
        before = unit[right] - 1
        strength[before] = np.maximum(strength[before], grade if isinstance(grade, int) else grade[right])


def atoms(units: Units, strength: np.ndarray, chosen: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """(end units, tokens) of the segments of the chosen texts, each of at most ``most`` tokens.

    Cuts at sentences and stronger boundaries; a segment above ``most`` is cut at its clauses, what
    is still above at its words, and then anywhere.
    """
    ends = np.flatnonzero(strength >= SENTENCE) + 1
    sizes = np.diff(units.tokens[ends], prepend=0)
    text = units.text_of(ends)
    mine = chosen[text]
    large = mine & (sizes > most)
    if not large.any():
        return ends[mine], sizes[mine]
    more_ends, more_sizes = [], []
    for i in np.flatnonzero(large).tolist():
        first, last = int(ends[i - 1]) if i else 0, int(ends[i])
        units.mark_clauses(strength, int(text[i]), first, last)
        _take(units, strength, first, last, CLAUSE, most, more_ends, more_sizes)
    mine &= ~large
    ends = np.concatenate([ends[mine], np.array(more_ends, dtype=np.int64)])
    order = np.argsort(ends, kind="stable")
    return ends[order], np.concatenate([sizes[mine], np.array(more_sizes, dtype=np.int64)])[order]


def _take(units: Units, strength: np.ndarray, first: int, last: int, level: int, most: int, out_ends: list[int], out_sizes: list[int]) -> None:
    """Add units ``first`` to ``last - 1``, cut at boundaries of ``level``, and where that is still too large, below."""
    ends = np.flatnonzero(strength[first : last - 1] >= level) + first + 1
    bounds = [*ends.tolist(), last]
    totals = [*units.tokens[ends].tolist(), int(units.tokens[last])]
    before = int(units.tokens[first])
    for end, total in zip(bounds, totals):
        n = total - before
        if n <= most or level == NONE:
            out_ends.append(end)
            out_sizes.append(n)
        else:
            _take(units, strength, first, end, {CLAUSE: WORD, WORD: NONE}[level], most, out_ends, out_sizes)
        first, before = end, total


Segments = list[tuple[int, int, int]]


def merge(segments: Segments, most: int) -> Segments:
    """The segments left of (end, tokens, strength of the boundary there) in one text, see ``merge_all``."""
    if not segments:
        return []
    ends, sizes, grades = (np.array(c, dtype=np.int64) for c in zip(*segments))
    grades[-1] = TEXT
    ends, sizes, left = merge_all(ends, sizes, grades, most)
    return list(zip(ends.tolist(), sizes.tolist(), [*left[:-1].tolist(), segments[-1][2]]))


def merge_all(ends: np.ndarray, sizes: np.ndarray, grades: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The segments left after merging neighbours across the weakest boundaries while they hold at most ``most`` tokens.

    Among equal boundaries the smaller pair goes first, then the earlier one; ends of texts stay. A
    pair that is too large once stays so, as segments only grow; so grades of boundaries can be
    worked off one by one, and within a grade each run of segments between other boundaries by
    itself. Only in a run that does not fit as a whole the order counts.
    """
    for grade in range(NONE, PARAGRAPH + 1):
        stays = grades != grade
        stops = np.flatnonzero(stays)
        if len(stops) == len(grades):
            continue
        totals = np.cumsum(sizes)
        run = np.diff(stops, prepend=-1)
        large = (np.diff(totals[stops], prepend=0) > most) & (run > 1)
        if large.any():
            stays = stays | np.repeat(large, run) & ~_merge_runs(sizes, ~stays, np.repeat(large, run), most)
        sizes = np.diff(totals[stays], prepend=0)
        ends, grades = ends[stays], grades[stays]
    return ends, sizes, grades


def _merge_runs(sizes: np.ndarray, joins: np.ndarray, large: np.ndarray, most: int) -> np.ndarray:
    """The same for all large runs at once: which segments have gone into the next.

    ``joins`` tells which segments may. Runs do not touch each other, so pairs of all of them wait
    by their size; a pair that a merge brings about is larger than the one merged.
    """
    pairs = np.flatnonzero(joins & large)
    total = sizes[pairs] + sizes[pairs + 1]
    waiting: list[list[int]] = [[] for _ in range(most + 1)]
    for n, i in zip(total[total <= most].tolist(), pairs[total <= most].tolist()):
        waiting[n].append(i)
    size, may, gone = sizes.tolist(), joins.tolist(), bytearray(len(sizes))
    after, before = list(range(1, len(size) + 1)), list(range(-1, len(size) - 1))
    for n, row in enumerate(waiting):
        row.sort()
        for i in row:
            if gone[i]:
                continue
            j = after[i]
            if size[i] + size[j] != n:
                continue
            # The merged segment lives on as j, whose end and boundary are the later ones.
            gone[i] = 1
            size[j] = n
            h = before[j] = before[i]
            if h >= 0:
                after[h] = j
                if may[h] and size[h] + n <= most:
                    waiting[size[h] + n].append(h)
            if may[j]:
                pair = n + size[after[j]]
                if pair <= most:
                    waiting[pair].append(j)
    return np.frombuffer(gone, dtype=bool)


Pieces = tuple[list[int], list[int], list[int], list[int], list[int]]


def split_all(texts: list[str], limits: list[tuple[int, int]], encode: Encoder) -> list[Pieces]:
    """For each (most tokens, overlap): text, start, own start, end, tokens of the pieces of all texts above that limit.

    A piece is ``text[start:end]``; what lies before its own start is the overlap with the piece
    before: ``overlap`` tokens, more only where a whole character or white space needs it, fewer
    only where no more text lies before. Own parts together are the text. No piece has more than
    ``most`` tokens. Every limit merges from the atoms; its pieces do not depend on the other limits.
    """
    if not all(0 <= overlap <= most - 2 * _UNIT for most, overlap in limits):
        raise ValueError("an overlap must leave room in a piece")
    out: list[Pieces] = [([], [], [], [], []) for _ in limits]
    if not texts or not limits:
        return out
    units = Units(texts, encode)
    natural = None
    for (most, overlap), pieces in zip(limits, out):
        chosen = units.totals > most
        if not chosen.any():
            continue
        if natural is None:
            natural = units.boundaries()
        room = most - overlap - (_SLACK if overlap else 0)
        # Atoms mark the clauses they need; those of one limit are not another's.
        strength = natural.copy()
        ends, sizes = atoms(units, strength, chosen, room)
        last, _, _ = merge_all(ends, sizes, strength[ends - 1], room)
        text = units.text_of(last)
        first = np.maximum(np.append(0, last[:-1]), units.firsts[text])
        begin, n = _fit(units, first, last, overlap)
        large = (n > most) & (last - first > 1)
        if large.any():
            cut: list[tuple[int, int, int, int]] = []
            for i in np.flatnonzero(large).tolist():
                _cut_best(units, strength, int(first[i]), int(last[i]), most, overlap, cut)
            rows = np.concatenate([np.array([first, last, begin, n])[:, ~large], np.array(cut).T], axis=1)
            first, last, begin, n = rows[:, np.argsort(rows[0], kind="stable")]
            text = units.text_of(last)
        base = units.begins[text]
        for column, values in zip(pieces, (text, begin - base, units.ends[first] - base, units.ends[last] - base, n)):
            column += values.tolist()
    return out


def _fit(units: Units, first: np.ndarray, last: np.ndarray, overlap: int) -> tuple[np.ndarray, np.ndarray]:
    """Where the pieces of units ``first`` to ``last - 1`` begin with their overlaps, and their tokens."""
    begin, shared = units.overlap(first, overlap)
    return begin, shared + units.count(first, last)


def _cut_best(units: Units, strength: np.ndarray, first: int, last: int, most: int, overlap: int, out: list[tuple[int, int, int, int]]) -> None:
    """Add the piece, cut at its best inner boundary if its overlap makes it too large after all."""
    begin, n = _fit(units, np.array([first]), np.array([last]), overlap)
    if n[0] <= most or last - first == 1:
        out.append((first, last, int(begin[0]), int(n[0])))
        return
    inner = strength[first : last - 1]
    middle = first + 1 + int(max(np.flatnonzero(inner == inner.max()).tolist(), key=lambda i: -abs(2 * i + 2 - (last - first))))
    _cut_best(units, strength, first, middle, most, overlap, out)
    _cut_best(units, strength, middle, last, most, overlap, out)


def split_text(text: str | None, limits: list[tuple[int, int]], encode: Encoder) -> list[list[tuple[int, int, int, int]]]:
    """For each (most tokens, overlap): (start, own start, end, tokens) of the pieces of a text above that limit, else none, as in ``split_all``."""
    return [list(zip(*pieces[1:])) for pieces in split_all([text] if text else [], limits, encode)]


def _groups(texts: list[str], least: int) -> Iterator[list[int]]:
    """The indices of texts of more than ``least`` bytes, a token being one at least, in groups to work on together."""
    group: list[int] = []
    size = 0
    for i, text in enumerate(texts):
        if len(text.encode("utf-8")) > least:
            group.append(i)
            size += len(text)
            if len(group) >= _TEXTS or size >= _CHARS:
                yield group
                group, size = [], 0
    if group:
        yield group


def split_texts(df: DataFrame, limits: list[tuple[int, int, int]], id_col: str = "doc_id", text_col: str = "text", directory: str = TOKENIZER_DIR) -> DataFrame:
    """(limit_id, id, piece, start, own_start, end, n_tokens, text): the pieces of every text above a limit.

    ``limits`` has (limit_id, most tokens, overlap). Offsets are in characters, ends exclusive; a
    piece's own part is ``own_start`` to ``end``, and own parts follow each other without gaps.
    Texts within a limit, and null and empty ones, give no rows; repeated rows repeat theirs; an
    empty table gives an empty result. No shuffle.
    """

    sizes = [(most, overlap) for _, most, overlap in limits]

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(directory)
        # Nothing here refers to itself; looking for such garbage takes a tenth of the time.
        collects = gc.isenabled()
        gc.disable()
        try:
            for batch in batches:
                for first in range(0, batch.num_rows, _TEXTS):
                    texts = batch.column(1).slice(first, _TEXTS).to_pylist()
                    for rows in _groups(texts, min((most for most, _ in sizes), default=0)):
                        part = [texts[i] for i in rows]
                        for (limit_id, _, _), (at, start, own, end, n) in zip(limits, split_all(part, sizes, encode)):
                            which = np.array(at, dtype=np.int64)
                            # Pieces of a text stand side by side.
                            number = np.arange(len(which)) - np.searchsorted(which, which)
                            ids = batch.column(0).take(pa.array(first + np.array(rows)[which]))
                            kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32())
                            arrays = [pa.array(c, k) for c, k in zip((number, start, own, end, n), kinds)]
                            text = pa.array([part[i][a:b] for i, a, b in zip(at, start, end)], pa.string())
                            yield pa.RecordBatch.from_arrays([pa.array([limit_id] * len(at), pa.int32()), ids, *arrays, text], ["limit_id", "id", "piece", "start", "own_start", "end", "n_tokens", "text"])
        finally:
            if collects:
                gc.enable()

    id_type = df.schema[id_col].dataType.simpleString()
    schema = f"limit_id int, id {id_type}, piece int, start bigint, own_start bigint, end bigint, n_tokens int, text string"
    return df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where("length(text) > 0").mapInArrow(split, schema).withColumnRenamed("id", id_col)
