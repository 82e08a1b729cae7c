"""Decoding of file contents."""

from __future__ import annotations

import codecs

#: Names that mean something else here: plain ASCII supersets are read as UTF-8.
_ALIASES = {"iso-8859-1": "utf-8", "gb-18030": "gb18030"}
DEFAULT_CHARSET, DETECT = "UTF-8", "detect"


class CharsetError(ValueError):
    """An unknown charset, or bytes that cannot be told to be text in any."""


def resolve(name: str) -> str:
    """The codec of a charset name; raises CharsetError for an unknown one."""
    wanted = _ALIASES.get(name.strip().lower(), name.strip())
    try:
        return codecs.lookup(wanted).name
    except LookupError as e:
        raise CharsetError(f"unsupported character set: {name}") from e


#: Charsets that are told apart by how plausible their text is; earlier ones win ties.
_CANDIDATES = ("shift_jis", "euc_jp", "gb18030", "euc_kr", "big5", "cp1251", "koi8-r", "cp1252", "cp1250", "cp1253", "cp1254", "iso8859-5", "iso8859-7", "cp866")
#: Bytes looked at.
_HEAD = 1 << 16


def _plausible(text: str, high: int) -> float:
    """How much text of ``high`` bytes above ASCII looks like writing, per such byte; runs of one alphabet count, small letters most."""
    total, last = 0.0, ""
    for c in text:
        if c < "\x80":
            total -= c.isalpha() and last in ("r", "g")
            last = "a" if c.isalpha() else ""
            continue
        n = ord(c)
        if 0x3040 <= n <= 0x30FF or 0xAC00 <= n <= 0xD7A3:
            kind, worth = "k" if n < 0x4000 else "h", 2.2
        elif 0x4E00 <= n <= 0x9FFF:
            kind, worth = "c", 1.8
        elif n in (0x3001, 0x3002) or 0xFF01 <= n <= 0xFF5E:
            kind, worth = last, 2.0
        elif c.isalpha():
            kind = "r" if 0x400 <= n <= 0x4FF else "g" if 0x370 <= n <= 0x3FF else "a" if n < 0x250 else "x"
            worth = (0.9 if c.islower() else 0.3) if kind != "x" else -1.0
            # Latin text has accents between plain letters, other alphabets stand by themselves.
            if kind == "a":
                worth = worth - 0.2 if last == "a" else worth - 0.6
            elif last == "a":
                worth -= 1.0
            elif last == kind:
                worth += 0.1
        elif 0x2010 <= n <= 0x2026 or n in (0xA0, 0xA7, 0xA9, 0xAB, 0xB0, 0xBB):
            kind, worth = "", 0.3
        else:
            kind, worth = "", -1.5
        total, last = total + worth, kind
    return total / max(1, high)


def detect(data: bytes) -> str:
    """A byte order mark, strict UTF-8, or the charset that decodes strictly to the most plausible text, else Windows-1252."""
    for mark, name in ((codecs.BOM_UTF8, "utf-8-sig"), (codecs.BOM_UTF32_LE, "utf-32"), (codecs.BOM_UTF32_BE, "utf-32"), (codecs.BOM_UTF16_LE, "utf-16"), (codecs.BOM_UTF16_BE, "utf-16")):
        if data.startswith(mark):
            return name
    try:
        data.decode("utf-8")
        return "utf-8"
    except UnicodeDecodeError:
        pass
    # Whole lines, so that no character is cut in two.
    head = data[: data.find(b"\n", _HEAD) + 1 or len(data)]
    high = sum(b > 127 for b in head)
    best, found = float("-inf"), "cp1252"
    for name in _CANDIDATES:
        try:
            worth = _plausible(head.decode(name), high)
        except UnicodeDecodeError:
            continue
        if worth > best + 1e-9:
            best, found = worth, name
    return found


def decode(data: bytes, charset: str = DEFAULT_CHARSET) -> str:
    """Text of ``data``; bytes that do not fit become replacement characters."""
    name = detect(data) if charset == DETECT else resolve(charset)
    return data.decode(name, "replace")
