"""Lexical rules of each language, and how a file's language is found."""

from __future__ import annotations

import re
from dataclasses import dataclass, field


@dataclass(frozen=True)
class Line:
    start: str
    at_line_start: bool = False


@dataclass(frozen=True)
class Block:
    start: str
    end: str
    at_first_column: bool = False
    nested: bool = False


@dataclass(frozen=True)
class Str:
    """``escape`` is one character that escapes the end, ``"double"`` or ``""`` (none)."""

    start: str
    end: str
    escape: str = ""


@dataclass(frozen=True)
class Rules:
    lines: tuple[Line, ...] = ()
    blocks: tuple[Block, ...] = ()
    strings: tuple[Str, ...] = ()
    starts: tuple[str, ...] = field(init=False)

    def __post_init__(self) -> None:
        object.__setattr__(self, "starts", tuple(r.start for r in (*self.lines, *self.blocks, *self.strings)))


def _line(*starts: str) -> tuple[Line, ...]:
    return tuple(Line(s) for s in starts)


def _quotes(marks: str, escape: str = "\\") -> tuple[Str, ...]:
    return tuple(Str(q, q, escape) for q in marks.split())


_C_BLOCK = (Block("/*", "*/"),)
_XML_BLOCK = (Block("<!--", "-->"),)
_PAIR = _quotes("\" '")
_DOUBLE = _quotes('"')
_C = Rules(_line("//"), _C_BLOCK, _PAIR)
_HASH = Rules(_line("#"), (), _PAIR)
_XML = Rules((), _XML_BLOCK, _PAIR)
_ASM = Rules(_line(";"), _C_BLOCK, _quotes("\" '", ""))
_FORTRAN = Rules(_line("!"), (), _quotes("\" '", ""))
_BASIC = Rules(_line("'"), (), _DOUBLE)
_LINE_START_HASH = Rules((Line("#", True),))

GENERIC = "<generic>"

#: The delimiters of each language. Order inside a kind matters, the first that fits wins.
LANGUAGES: dict[str, Rules] = {
    GENERIC: Rules(_line("//", "#"), _C_BLOCK + _XML_BLOCK, _PAIR),
    "Assembly": _ASM,
    "C": _C,
    "C#": _C,
    "C++": _C,
    "CODEOWNERS": _LINE_START_HASH,
    "Clojure": Rules(_line(";"), (), _DOUBLE),
    "CoffeeScript": Rules(_line("#"), (Block("###", "###"),), _PAIR),
    "Dart": Rules(_line("//", "///"), _C_BLOCK, _PAIR),
    "Dockerfile": _HASH,
    "EditorConfig": Rules(_line("#")),
    "Elixir": Rules(_line("#"), (Block('@moduledoc """', '"""'), Block('@doc """', '"""')), _quotes("' \" \"\"\" '''")),
    "Emacs Lisp": Rules(_line(";"), (), _DOUBLE),
    "Erlang": Rules(_line("%"), (), _PAIR),
    "Fortran": _FORTRAN,
    "Fortran Free Form": _FORTRAN,
    "Git Config": Rules(_line("#", ";"), (), _DOUBLE),
    "Go": Rules(_line("//"), _C_BLOCK, _PAIR + _quotes("`", "")),
    "Go Module": Rules(_line("//"), (), _DOUBLE + _quotes("`", "")),
    "GraphQL": Rules(_line("#"), (Block('"""', '"""'),), _DOUBLE),
    "Groovy": Rules(_line("//"), _C_BLOCK, _PAIR + _quotes("'''")),
    "HCL": Rules(_line("#", "//"), (), _DOUBLE),
    "HTML": _XML,
    "HTML+ERB": Rules((), _XML_BLOCK + (Block("<%#", "%>"),), _PAIR),
    "Haskell": Rules(_line("--"), (Block("{-", "-}"),), _PAIR),
    "INI": Rules(_line(";", "#"), (), _PAIR),
    "Ignore List": _LINE_START_HASH,
    "JSON": Rules(_line("//", "#"), _C_BLOCK, _PAIR),
    "JSON with Comments": _C,
    "JSON5": _C,
    "Java": _C,
    "JavaScript": _C,
    "Julia": Rules(
        _line("#"),
        (Block("#=", "=#", nested=True),),
        (Str('raw"', '"'), *_PAIR, Str('raw"""', '"""'), Str('"""', '"""', "\\")),
    ),
    "Kotlin": _C,
    "Lua": Rules(_line("--"), (Block("--[[", "--]]"),), _PAIR),
    "MATLAB": Rules(_line("%"), (Block("%{", "}%"),), _PAIR),
    "Makefile": _HASH,
    "Markdown": Rules((), _XML_BLOCK, _quotes("` ```", "")),
    "Nix": Rules(_line("#"), _C_BLOCK),
    "OCaml": Rules((), (Block("(*", "*)", nested=True),), _PAIR),
    "Objective-C": _C,
    "PHP": Rules(_line("#", "//"), _C_BLOCK, _PAIR),
    "Pascal": Rules(_line("//"), (Block("(*", "*)"), Block("{", "}")), _quotes("\" '", "double")),
    "Perl": Rules(_line("#"), (Block("=", "=cut", at_first_column=True),), _PAIR),
    "Pip Requirements": Rules(_line("#")),
    "PowerShell": Rules(_line("#"), (Block("<#", "#>"),), _quotes("\" '", "`")),
    "Puppet": _HASH,
    "Python": Rules(_line("#"), (Block('"""', '"""'),), _PAIR),
    "R": _HASH,
    "Ruby": Rules(_line("#"), (Block("=begin", "=end", at_first_column=True),), _PAIR + (Str("%{", "}", "\\"),)),
    "Rust": Rules(_line("//"), _C_BLOCK, _DOUBLE),
    "SQL": Rules(_line("--"), _C_BLOCK, _quotes("\" '", "double")),
    "Scala": _C,
    "Shell": _HASH,
    "Svelte": Rules(_line("//"), _XML_BLOCK + _C_BLOCK, _PAIR),
    "Swift": Rules(_line("//"), _C_BLOCK, _DOUBLE),
    "TOML": _HASH,
    "TeX": Rules(_line("%")),
    "TypeScript": _C,
    "Unix Assembly": _ASM,
    "VBA": _BASIC,
    "Vim Script": Rules(_line('"'), (), _PAIR),
    "Visual Basic .NET": _BASIC,
    "XML": _XML,
    "XSLT": _XML,
    "YAML": _HASH,
}

#: Programming or markup languages without rules of their own: they get the generic ones.
GENERIC_LANGUAGES = ("Coq", "Rocq Prover", "Zig", "CSS", "Less", "SCSS", "Thrift", "Protocol Buffer", "CMake", "Awk", "TSX", "Solidity", "Vue")
#: Known, but not scanned.
UNSUPPORTED_LANGUAGES = ("Text", "CSV", "Diff", "SVG")

#: File names and extensions of common use. A caller adds others with the ``extra`` parameter of
#: ``language_of``; where an extension belongs to several languages, ``_by_content`` decides.
NAMES: dict[str, str] = {
    name: language
    for language, names in {
        "CODEOWNERS": "CODEOWNERS",
        "CoffeeScript": "Cakefile",
        "Dockerfile": "Containerfile Dockerfile",
        "EditorConfig": ".editorconfig",
        "Elixir": "mix.lock",
        "Git Config": ".gitconfig .gitmodules",
        "Go Module": "go.mod",
        "Groovy": "Jenkinsfile",
        "INI": ".coveragerc .flake8 .pylintrc pylintrc",
        "Ignore List": ".dockerignore .eslintignore .gitignore .npmignore .prettierignore",
        "JSON with Comments": ".babelrc devcontainer.json tsconfig.json .eslintrc.json",
        "Makefile": "Makefile makefile GNUmakefile",
        "Perl": "Makefile.PL cpanfile",
        "Pip Requirements": "requirements.txt dev-requirements.txt requirements-dev.txt",
        "Python": "SConstruct wscript",
        "Ruby": "Gemfile Rakefile Vagrantfile",
        "Shell": ".bashrc .bash_profile .profile .zshrc",
        "TOML": "Cargo.lock Pipfile poetry.lock uv.lock",
        "Vim Script": ".vimrc vimrc",
        "XML": "App.config Web.config packages.config",
        "YAML": ".clang-format .clang-tidy yarn.lock",
    }.items()
    for name in names.split()
}
EXTENSIONS: dict[str, str] = {
    extension: language
    for language, extensions in {
        "Assembly": "asm nasm",
        "C": "c h",
        "C#": "cs csx",
        "C++": "cpp cc cxx hh hpp hxx ino",
        "Clojure": "clj cljs cljc",
        "CoffeeScript": "coffee",
        "Dart": "dart",
        "Dockerfile": "dockerfile containerfile",
        "Elixir": "ex exs",
        "Emacs Lisp": "el",
        "Erlang": "erl hrl",
        "Fortran": "f f77 for",
        "Fortran Free Form": "f90 f03 f08 f95",
        "Go": "go",
        "GraphQL": "graphql gql",
        "Groovy": "groovy",
        "HCL": "hcl tf tfvars nomad",
        "HTML": "html htm xhtml",
        "HTML+ERB": "erb",
        "Haskell": "hs hsc",
        "INI": "ini cfg properties",
        "JSON": "json geojson webmanifest",
        "JSON with Comments": "jsonc code-workspace",
        "JSON5": "json5",
        "Java": "java",
        "JavaScript": "js cjs mjs jsx es6",
        "Julia": "jl",
        "Kotlin": "kt kts",
        "Lua": "lua rockspec",
        "MATLAB": "matlab",
        "Makefile": "mk mak",
        "Markdown": "md markdown",
        "Nix": "nix",
        "OCaml": "ml mli mll mly",
        "Objective-C": "m",
        "PHP": "php phtml",
        "Pascal": "pas dpr lpr",
        "Perl": "pl pm t",
        "PowerShell": "ps1 psm1 psd1",
        "Puppet": "pp",
        "Python": "py pyi pyw",
        "R": "r rd",
        "Ruby": "rb gemspec rake",
        "Rust": "rs",
        "SQL": "sql ddl",
        "Scala": "scala sbt sc",
        "Shell": "sh bash zsh ksh bats",
        "Svelte": "svelte",
        "Swift": "swift",
        "TOML": "toml",
        "TeX": "tex sty cls",
        "TSX": "tsx",
        "TypeScript": "ts mts cts",
        "Unix Assembly": "s",
        "VBA": "bas frm",
        "Vim Script": "vim",
        "Visual Basic .NET": "vb",
        "XML": "xml xsd svg plist csproj",
        "XSLT": "xsl xslt",
        "YAML": "yml yaml",
        "Coq": "coq v",
        "CSS": "css",
        "SCSS": "scss",
        "Less": "less",
        "CMake": "cmake",
        "Awk": "awk",
        "Protocol Buffer": "proto",
        "Zig": "zig",
        "Vue": "vue",
        "Text": "txt",
        "CSV": "csv",
        "Diff": "diff patch",
    }.items()
    for extension in extensions.split()
}
ALIASES: dict[str, str] = {name.lower(): name for name in (*LANGUAGES, *GENERIC_LANGUAGES, *UNSUPPORTED_LANGUAGES) if name != GENERIC} | {
    "bash": "Shell",
    "sh": "Shell",
    "zsh": "Shell",
    "golang": "Go",
    "py": "Python",
    "python3": "Python",
    "js": "JavaScript",
    "node": "JavaScript",
    "ts": "TypeScript",
    "rs": "Rust",
    "rb": "Ruby",
    "yml": "YAML",
    "csharp": "C#",
    "cpp": "C++",
    "objc": "Objective-C",
    "objective-c": "Objective-C",
    "vim": "Vim Script",
    "viml": "Vim Script",
    "elisp": "Emacs Lisp",
    "make": "Makefile",
    "latex": "TeX",
    "vb.net": "Visual Basic .NET",
    "terraform": "HCL",
    "nasm": "Assembly",
    "posh": "PowerShell",
    "pwsh": "PowerShell",
}
_INTERPRETERS = {"sh", "bash", "zsh", "ksh", "dash", "python", "perl", "ruby", "node", "php", "lua", "rscript", "escript", "julia", "elixir", "groovy", "make", "pwsh"}


def _by_content(extension: str, head: str) -> str | None:
    if extension == "ts" and re.match(r"\s*(<\?xml|<!DOCTYPE TS)", head):
        return "XML"
    if extension == "m" and not re.search(r"@(interface|implementation|import|end\b)|#(import|include)", head) and re.search(r"(?m)^[^\S\n]*(%|function\b)", head):
        return "MATLAB"
    if extension == "h":
        if re.search(r"@interface|#import|@protocol", head):
            return "Objective-C"
        if re.search(r"\btemplate\s*<|\bnamespace\b|\bclass\s+\w+|std::", head):
            return "C++"
    if extension == "pp" and re.search(r"(?mi)^[^\S\n]*(unit|program|uses)\s+\w+", head):
        return "Pascal"
    if extension == "rs" and head.lstrip().startswith("<?xml"):
        return "XML"
    if extension == "cls" and re.search(r"(?mi)^\s*(VERSION \d|Attribute VB_)", head):
        return "VBA"
    return None


def language_of(path: str | None, head: str | None = "", extra: dict[str, str] | None = None) -> str | None:
    """The language of a file from its name, then its first line, then its extension; None if unknown.

    ``extra`` maps further file names, and extensions without their first dot, to languages and wins
    over the built-in ones; of several extensions the longest counts. See ``languages_in``.
    """
    base = (path or "").rsplit("/", 1)[-1]
    if extra:
        if base in extra:
            return extra[base]
        parts = base.lower().split(".")
        for i in range(1, len(parts)):
            if ".".join(parts[i:]) in extra:
                return extra[".".join(parts[i:])]
    if base in NAMES:
        return NAMES[base]
    head = head or ""
    extension = base.rsplit(".", 1)[-1].lower() if "." in base else ""
    if extension not in EXTENSIONS:
        name = _interpreter(head)
        if name in _INTERPRETERS:
            return ALIASES.get({"rscript": "r", "escript": "erlang", "dash": "sh", "ksh": "sh"}.get(name, name))
    return _by_content(extension, head) or EXTENSIONS.get(extension)


_ENTRY = re.compile(r"""(?P<name>\S.*?):\s*|\s+(?P<key>\w+):\s*|\s+-\s*(?P<quote>["']?)(?P<value>.*?)(?P=quote)\s*""")


def languages_in(text: str) -> dict[str, str]:
    """File names and extensions of languages with rules, from a language list, for the parameter ``extra``.

    The list is in the common YAML form: a language's name at the start of a line, below it lists
    ``extensions`` and ``filenames``. The table built in covers names of common use; a full list has
    hundreds more and is a parameter. An extension that is built in, or that several languages
    list, keeps what is built in or goes to the first.
    """
    out: dict[str, str] = {}
    language, key = None, ""
    for line in text.splitlines():
        m = _ENTRY.fullmatch(line)
        if not m or line.lstrip().startswith("#"):
            continue
        if m.group("name"):
            language, key = by_alias(m.group("name").strip("\"'")), ""
        elif m.group("key"):
            key = m.group("key")
        elif language and rules_of(language) and key in ("extensions", "filenames"):
            value = m.group("value").removeprefix(".").lower() if key == "extensions" else m.group("value")
            if value not in (EXTENSIONS if key == "extensions" else NAMES):
                out.setdefault(value, language)
    return out


def _interpreter(head: str) -> str:
    """The interpreter's base name in a shebang line, without its version; empty if there is none."""
    line = head.split("\n", 1)[0]
    if not line.startswith("#!"):
        return ""
    words = line[2:].split()
    if words and words[0].rsplit("/", 1)[-1] == "env":
        words = [w for w in words[1:] if not w.startswith("-") and "=" not in w]
    return words[0].rsplit("/", 1)[-1].lower().rstrip("0123456789.") if words else ""


def rules_of(language: str | None) -> Rules | None:
    """The rules of a language, the generic ones for a known language without own rules, else None."""
    if language in LANGUAGES:
        return LANGUAGES[language]
    return LANGUAGES[GENERIC] if language in GENERIC_LANGUAGES else None


def by_alias(name: str) -> str | None:
    """The language a user names, regardless of case; None if unknown."""
    return ALIASES.get(name.strip().lower())
