"""Byte-level BPE by dynamic programming over prefixes.

For every byte prefix of a text the valid encoding ends in exactly one token. A token that ends at
position ``i`` and starts at ``j`` is that token if and only if it may follow the last token of
prefix ``j``; a pair may stand side by side if BPE, run over the two tokens' bytes, would not merge
across their border. So one array of last tokens holds the encodings of all prefixes: text is
appended by extending the array, and after an edit only the positions from the edit on are redone.

The vocabulary and its merges are read from a public tokenizer's file at run time.
"""

from __future__ import annotations

import bisect
import json
import os
import re
from array import array
from collections.abc import Iterable
from functools import lru_cache

import ahocorasick
import regex

#: Folder of the public tokenizers' files unless a caller names another.
TOKENIZER_DIR = os.environ.get("SCHOLIA_TOKENIZERS", "/opt/tokenizers")

#: Fixed value: the pre-tokenisation pattern that belongs to the byte_bpe_50k vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: Distinct stretches a worker remembers, twice over: a full generation becomes the old one, and
#: what is used again moves to the new. A larger number costs memory only, about 150 bytes each.
CACHE_SIZE = 500_000


def _byte_of_char() -> dict[str, int]:
    """The vocabulary file writes printable Latin-1 bytes as themselves, others from U+0100 on in order."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


class Vocabulary:
    """Tokens as bytes, the two halves of each merged token, and the token each pair merges to."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        byte_of = _byte_of_char()
        names = {name: i for name, i in model["vocab"].items() if all(c in byte_of for c in name)}
        self.id_of = {bytes(byte_of[c] for c in name): i for name, i in names.items()}
        self.halves: dict[int, tuple[int, int]] = {}
        self.merged: dict[tuple[int, int], int] = {}
        for merge in model["merges"]:
            a, b = merge.split(" ") if isinstance(merge, str) else merge
            whole = names[a + b]
            self.halves[whole] = names[a], names[b]
            self.merged[names[a], names[b]] = whole
        self.bytes_of = {i: b for b, i in self.id_of.items()}
        self.size_of = {i: len(b) for b, i in self.id_of.items()}
        #: What is known of ``may_follow``.
        self.pairs: dict[int, bool] = {}
        #: All tokens that end at each position of a text, longest first; bytes stand as Latin-1 characters.
        self.ends = ahocorasick.Automaton()
        for b, i in self.id_of.items():
            self.ends.add_word(b.decode("latin-1"), (i, len(b)))
        self.ends.make_automaton()
        self.longest = max(map(len, self.id_of))

    def may_follow(self, left: int, right: int) -> bool:
        """Whether BPE leaves ``left`` and ``right`` apart when their bytes stand side by side.

        Walks back through the merges that made the two tokens, latest first; a merge across the
        border that comes before the one undone last would have happened instead.
        """
        merged, halves = self.merged, self.halves
        limit = 1 << 40
        while True:
            across = merged.get((left, right))
            if across is not None and across < limit:
                return False
            undo_left = left > right
            if undo_left and left not in halves:
                undo_left = False
                if right not in halves:
                    return True
            elif not undo_left and right not in halves:
                undo_left = True
                if left not in halves:
                    return True
            if undo_left:
                limit = left
                left = halves[left][1]
            else:
                limit = right + 1
                right = halves[right][0]


def extend_last_tokens(v: Vocabulary, data: bytes, last: list[int]) -> None:
    """Continue ``last``, the last token of each prefix of ``data`` (-1 for the empty one), to the whole of ``data``."""
    pairs, may_follow, done = v.pairs, v.may_follow, len(last) - 1
    last += [-1] * (len(data) - done)
    for end, (token, size) in v.ends.iter(data.decode("latin-1"), max(0, done - v.longest)):
        end += 1
        if last[end] < 0:
            start = end - size
            if start:
                pair = (last[start] << 20) + token
                fits = pairs.get(pair)
                if fits is None:
                    if len(pairs) > 1_000_000:
                        pairs.clear()
                    fits = pairs[pair] = may_follow(last[start], token)
                if not fits:
                    continue
            last[end] = token


class PrefixEncoder:
    """The last token of every prefix of one byte string, with exact appends and edits.

    Works on a stretch that the pre-tokenisation pattern leaves whole.
    """

    def __init__(self, vocabulary: Vocabulary, text: bytes = b""):
        self.vocabulary = vocabulary
        self.text = bytearray()
        self.last: list[int] = [-1]
        self.append(text)

    def append(self, more: bytes) -> None:
        self.text += more
        extend_last_tokens(self.vocabulary, bytes(self.text), self.last)

    def edit(self, start: int, end: int, new: bytes) -> None:
        """Replace bytes ``start:end`` by ``new``; prefixes before ``start`` are kept."""
        tail = bytes(self.text[end:])
        del self.text[start:]
        del self.last[start + 1 :]
        self.append(new + tail)

    def ids(self, end: int | None = None) -> list[int]:
        """The encoding of the prefix of ``end`` bytes, of the whole text by default."""
        at = len(self.text) if end is None else end
        out = []
        while at:
            token = self.last[at]
            out.append(token)
            at -= len(self.vocabulary.bytes_of[token])
        return out[::-1]


class _Known(dict):
    """What is known of stretches; ``find`` is asked for the others, and may remember what it finds."""

    def __init__(self, find):
        super().__init__()
        self.find = find

    def __missing__(self, piece: str):
        return self.find(piece)


class Encoder:
    """Encodes texts; distinct stretches between white space are encoded once and remembered.

    A match of the pre-tokenisation pattern never runs on from something else into white space, so
    a text can first be cut before each white space, which is a much cheaper pattern.
    """

    def __init__(self, path: str, cache_size: int = CACHE_SIZE):
        self.vocabulary = Vocabulary(path)
        self.pattern = regex.compile(PATTERN)
        self.split = self.pattern.findall
        self.chunk = re.compile(r" ?\S+|\s+(?!\S)|\s+").findall
        # White space to the standard library, but not to the pattern.
        self.separators = re.compile("[\x1c-\x1f]").search
        self.cache: dict[str, bytes] = _Known(self._unknown)
        self.old: dict[str, bytes] = {}
        #: Tokens of short stretches; zero for the others, which are counted piece by piece.
        self.sizes: dict[str, int] = _Known(self._size)
        #: Tokens of pre-tokens.
        self.word_sizes: dict[str, int] = _Known(self._word_size)
        # The pattern for plain characters, the most frequent case first; the cases exclude each other.
        self.split_plain = re.compile(r" ?[A-Za-z]+|'(?:[stmd]|re|ve|ll)| ?[0-9]+| ?[^\sA-Za-z0-9]+|\s+(?!\S)|\s+", re.ASCII).findall
        self.cache_size = cache_size

    def _encode_word(self, word: str) -> bytes:
        data = word.encode("utf-8")
        whole = self.vocabulary.id_of.get(data)
        if whole is not None:
            return array("i", (whole,)).tobytes()
        last = [-1]
        extend_last_tokens(self.vocabulary, data, last)
        at, ids, size = len(data), [], self.vocabulary.size_of
        while at:
            ids.append(last[at])
            at -= size[last[at]]
        ids.reverse()
        return array("i", ids).tobytes()

    def _encode_chunk(self, chunk: str) -> bytes:
        # Letters with a space before them are one pre-token.
        words = [chunk] if chunk.isalpha() or chunk[:1] == " " and chunk[1:].isalpha() else self.split(chunk)
        out = []
        for word in words:
            ids = self.cache.get(word)
            if ids is None:
                ids = self.old.get(word) or self._encode_word(word)
                self._remember(word, ids)
            out.append(ids)
        ids = b"".join(out)
        if len(words) > 1:
            self._remember(chunk, ids)
        return ids

    def _unknown(self, piece: str) -> bytes:
        ids = self.old.get(piece)
        if ids is None:
            return self._encode_chunk(piece)
        self._remember(piece, ids)
        return ids

    def words(self, piece: str) -> list[str]:
        """The pre-tokens of a piece."""
        return self.split_plain(piece) if piece.isascii() else self.split(piece)

    def _size(self, piece: str) -> int:
        if len(piece) > 60:
            return 0
        if len(self.sizes) >= self.cache_size:
            self.sizes.clear()
        known = self.word_sizes
        n = self.sizes[piece] = known[piece] if piece.isalpha() else sum([known[word] for word in self.words(piece)])
        return n

    def _word_size(self, word: str) -> int:
        data, n = word.encode("utf-8"), 1
        if data not in self.vocabulary.id_of:
            last = [-1]
            extend_last_tokens(self.vocabulary, data, last)
            at, n, size = len(data), 0, self.vocabulary.size_of
            while at:
                at -= size[last[at]]
                n += 1
        if len(word) <= 60:
            if len(self.word_sizes) >= self.cache_size:
                self.word_sizes.clear()
            self.word_sizes[word] = n
        return n

    def _remember(self, piece: str, ids: bytes) -> None:
        if len(piece) <= 100:
            if len(self.cache) >= self.cache_size:
                self.old, self.cache = self.cache, _Known(self._unknown)
            self.cache[piece] = ids

    def packed(self, text: str | None) -> bytes:
        """The ids as native 32-bit integers, four bytes each; nothing for an empty or null text."""
        if not text:
            return b""
        return b"".join(map(self.cache.__getitem__, self.split(text) if self.separators(text) else self.chunk(text)))

    def encode(self, text: str | None) -> list[int]:
        """Ids without special tokens; an empty list for an empty or null text."""
        return array("i", self.packed(text)).tolist()

    def count(self, text: str | None) -> int:
        return len(self.packed(text)) // 4

    def ids_of(self, piece: str) -> bytes:
        """The packed ids of one pre-token or one stretch between white space."""
        return self.cache[piece]

    def decode(self, ids: Iterable[int]) -> bytes:
        return b"".join(self.vocabulary.bytes_of[i] for i in ids)


class TextEncoder:
    """The ids of a whole text, with exact appends and edits that redo only the pre-tokens around the change.

    The pattern looks one character ahead and never back, so what it makes of a text from one of
    its borders on depends on the rest alone. Work starts at the last border that the change
    cannot have moved, and ends at the first border behind it that stands where one stood before.
    """

    def __init__(self, encode: Encoder, text: str = ""):
        self.encode, self.text = encode, ""
        #: Where each pre-token begins, and its packed ids.
        self.starts: list[int] = []
        self.parts: list[bytes] = []
        self.append(text)

    def append(self, more: str) -> None:
        self.edit(len(self.text), len(self.text), more)

    def edit(self, start: int, end: int, new: str) -> int:
        """Replace characters ``start:end`` by ``new``; returns how many pre-tokens were encoded again."""
        # A pre-token that ends right before the change has looked at its first character.
        first = max(0, bisect.bisect_left(self.starts, start) - 2)
        at = self.starts[first] if first < len(self.starts) else 0
        self.text = self.text[:start] + new + self.text[end:]
        shift = len(new) - (end - start)
        after = bisect.bisect_left(self.starts, end)
        starts, parts = [], []
        for m in self.encode.pattern.finditer(self.text, at):
            if m.start() >= start + len(new):
                while after < len(self.starts) and self.starts[after] + shift < m.start():
                    after += 1
                if after < len(self.starts) and self.starts[after] + shift == m.start():
                    break
            starts.append(m.start())
            parts.append(self.encode.ids_of(m.group()))
        else:
            after = len(self.starts)
        self.starts[first:] = starts + [x + shift for x in self.starts[after:]]
        self.parts[first:] = parts + self.parts[after:]
        return len(parts)

    def ids(self) -> list[int]:
        return array("i", b"".join(self.parts)).tolist()


@lru_cache(maxsize=2)
def encoder(directory: str = TOKENIZER_DIR, name: str = "byte_bpe_50k.json") -> Encoder:
    """One encoder per worker process."""
    return Encoder(os.path.join(directory, name))
