"""Listing of source files: directories are pruned before anything in them is read."""

from __future__ import annotations

import os
import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

from scholia.functions.globs import glob_to_regex
from scholia.operators.paths import VCS_DIRS, vendored_name

IGNORE_FILES = (".gitignore", ".scholiaignore")


@dataclass
class WalkOptions:
    exclude: Sequence[str] = ()
    exclude_dirs: Sequence[str] = ()
    exclude_hidden: bool = False
    include_vcs: bool = False
    include_vendored: bool = False
    follow: bool = False
    ignore_files: Sequence[str] = IGNORE_FILES


@dataclass
class Listing:
    """Files found, with whether each was named explicitly, and errors by path."""

    files: list[tuple[str, bool]] = field(default_factory=list)
    errors: list[tuple[str, str]] = field(default_factory=list)


@dataclass(frozen=True)
class Folder:
    """A folder that is still to be listed: its path as shown, where it really is, and the ignore rules above it."""

    shown: str
    real: str
    rules: tuple[IgnoreRule, ...] = ()


@dataclass
class Opened:
    """What stands directly in a folder."""

    files: list[str] = field(default_factory=list)
    folders: list[Folder] = field(default_factory=list)
    errors: list[tuple[str, str]] = field(default_factory=list)


@dataclass(frozen=True)
class IgnoreRule:
    folder: str
    regex: re.Pattern
    negated: bool
    dirs_only: bool

    def matches(self, path: str, is_dir: bool) -> bool:
        if self.dirs_only and not is_dir:
            return False
        inside = os.path.relpath(path, self.folder)
        return not inside.startswith("..") and self.regex.match(inside.replace(os.sep, "/")) is not None


def parse_ignore_line(line: str, folder: str) -> IgnoreRule | None:
    """One line of an ignore file; None for a comment or an empty line."""
    line = line.rstrip("\r\n").rstrip() if not line.rstrip("\r\n").endswith("\\ ") else line.rstrip("\r\n")
    if not line or line.startswith("#"):
        return None
    negated = line.startswith("!")
    line = line[negated:]
    dirs_only, anchored = line.endswith("/"), "/" in line.rstrip("/")
    parts = []
    for part in line.strip("/").split("/"):
        parts.append(".*" if part == "**" else glob_to_regex(part).replace("(?s:.*)", "[^/]*").replace("(?s:.)", "[^/]"))
    body = "/".join(parts).replace(".*/", "(?:.*/)?")
    return IgnoreRule(folder, re.compile((body if anchored else f"(?:.*/)?{body}") + r"\Z"), negated, dirs_only)


def _rules(folder: str, names: Sequence[str]) -> list[IgnoreRule]:
    out = []
    for name in names:
        try:
            with open(os.path.join(folder, name), encoding="utf-8", errors="replace") as f:
                out += [r for r in (parse_ignore_line(line, folder) for line in f) if r]
        except OSError:
            continue
    return out


def ignored(path: str, is_dir: bool, rules: Sequence[IgnoreRule]) -> bool:
    """Some rule excludes the path and none includes it again, in whatever order they stand."""
    hit = [r for r in rules if r.matches(path, is_dir)]
    return any(not r.negated for r in hit) and not any(r.negated for r in hit)


def _loops(link: str) -> bool:
    """Whether a link leads to its own directory or above it."""
    parent = os.path.realpath(os.path.dirname(link))
    return os.path.relpath(os.path.realpath(link), parent).split(os.sep)[0] in ("..", ".")


def roots(paths: Sequence[str]) -> tuple[list[Folder], Listing]:
    """The folders among ``paths``, and the rest: a path that is a file itself is taken whatever the options say."""
    folders, out = [], Listing()
    for path in paths or ["."]:
        if os.path.isdir(path):
            folders.append(Folder(path, path))
        elif os.path.exists(path):
            out.files.append((path, True))
        else:
            out.errors.append((path, "no such file or directory"))
    return folders, out


def open_folder(folder: Folder, o: WalkOptions) -> Opened:
    """One folder's files and folders in order, pruned by the options."""
    out = Opened()
    any_of = lambda globs: re.compile("|".join(f"(?:{glob_to_regex(g)})" for g in globs) + r"\Z") if globs else None
    files_rx, dirs_rx = any_of(list(o.exclude)), any_of([g.rstrip("/") for g in o.exclude_dirs])
    try:
        names = sorted(os.listdir(folder.real))
    except OSError as e:
        out.errors.append((folder.shown, e.strerror or str(e)))
        return out
    rules = (*folder.rules, *_rules(folder.real, o.ignore_files))
    for name in names:
        path, at = os.path.join(folder.shown, name), os.path.join(folder.real, name)
        if os.path.islink(at):
            if not os.path.exists(at):
                out.errors.append((path, "no such file or directory"))
                continue
            if not o.follow:
                continue
            if os.path.isdir(at) and _loops(at):
                out.errors.append((path, "symbolic link loop"))
                continue
            at = os.path.realpath(at)
        is_dir = os.path.isdir(at)
        rx = dirs_rx if is_dir else files_rx
        if rx is not None and rx.match(name):
            continue
        if o.exclude_hidden and name.startswith("."):
            continue
        if is_dir and (not o.include_vcs and name in VCS_DIRS or not o.include_vendored and vendored_name(name)):
            continue
        if ignored(at, is_dir, rules):
            continue
        if is_dir:
            out.folders.append(Folder(path, at, rules))
        elif os.path.isfile(at):
            out.files.append(path)
    return out


def walk(folder: Folder, options: WalkOptions) -> Iterator[tuple[str, str | None]]:
    """(path, error) of every file in and below a folder; only paths on the way are held in memory."""
    waiting = [folder]
    while waiting:
        found = open_folder(waiting.pop(), options)
        yield from found.errors
        yield from ((path, None) for path in found.files)
        waiting.extend(reversed(found.folders))


def list_files(paths: Sequence[str], options: WalkOptions | None = None) -> Listing:
    """Files under ``paths`` and what could not be listed."""
    folders, out = roots(paths)
    for folder in folders:
        for path, error in walk(folder, options or WalkOptions()):
            if error is None:
                out.files.append((path, False))
            else:
                out.errors.append((path, error))
    return out
