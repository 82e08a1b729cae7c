"""Predicates on paths, as column expressions, and the order in which a scan applies them."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from scholia.functions.globs import any_glob

VCS_DIRS = (".git", ".hg", ".svn")

#: Names of directories that hold code of others. They are matched against one
#: directory name and a slash, so of the public list of vendored paths only these can ever fire.
_VENDORED_WHOLE = (
    r"cache", r"[Dd]ependencies", r"dist", r"deps", r"node_modules", r"bower_components", r"testdata", r"vendors?", r"[Ee]xtern(?:als?)?",
    r"[Vv]+endor", r"debian", r"bootstrap-datepicker", r"\.vscode", r"ace-builds", r"MathJax", r"admin_media", r"env", r"Carthage", r"Sparkle",
    r"Crashlytics\.framework", r"Fabric\.framework", r"BuddyBuildSDK\.framework", r"puphpet", r"\.google_apis",
)
_VENDORED_END = (r"(?:3rd|[Tt]hird)[-_]?[Pp]arty", r"\.xctemplate", r"\.imageset")
_VENDORED_BEGIN = (
    r"aclocal\.m4", r"libtool\.m4", r"ltoptions\.m4", r"ltsugar\.m4", r"ltversion\.m4", r"lt~obsolete\.m4", r"cpplint\.py", r"erlang\.mk",
    r"\.indent\.pro", r"jquery\.fn\.gantt\.js", r"jquery\.fancybox\.(?:js|css)", r"fuelux\.js", r"jquery\.dataTables\.js", r"bootbox\.js",
    r"pdf\.worker\.js", r"leaflet\.draw-src\.js", r"leaflet\.draw\.css", r"Control\.FullScreen\.css", r"Control\.FullScreen\.js",
    r"leaflet\.spin\.js", r"wicket-leaflet\.js", r"\.sublime-project", r"\.sublime-workspace", r"Realm\.framework", r"RealmSwift\.framework",
    r"octicons\.css", r"sprockets-octicons\.scss",
)
VENDORED = rf"^(?:{'|'.join(_VENDORED_WHOLE)})/|(?:{'|'.join(_VENDORED_END)})/|^(?:{'|'.join(_VENDORED_BEGIN)})"


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def dir_names(path: Column) -> Column:
    """Names of the directories on the way, without empty ones and dots."""
    parts = F.split(path, "/")
    return F.filter(F.slice(parts, 1, F.size(parts) - 1), lambda s: ~s.isin("", ".", ".."))


def excluded(path: Column, globs: Sequence[str]) -> Column:
    """The base name matches one of ``globs``."""
    return any_glob(base_name(path), globs)


def in_excluded_dir(path: Column, globs: Sequence[str]) -> Column:
    """A directory on the way matches one of ``globs``; slashes at a glob's end do not count."""
    stripped = [g.rstrip("/") for g in globs]
    return F.exists(dir_names(path), lambda s: any_glob(s, stripped))


def hidden(path: Column) -> Column:
    """A directory on the way or the file itself begins with a dot."""
    return F.exists(F.split(path, "/"), lambda s: s.startswith(".") & ~s.isin(".", ".."))


def in_vcs_dir(path: Column) -> Column:
    return F.exists(dir_names(path), lambda s: s.isin(*VCS_DIRS))


def vendored(path: Column) -> Column:
    return F.exists(dir_names(path), lambda s: F.concat(s, F.lit("/")).rlike(VENDORED))


# Names of lock files and of code that tools write, and what such tools say in the head of a file. Approximate.
GENERATED_NAME = (
    r"(?:^|/)(?:package-lock\.json|npm-shrinkwrap\.json|composer\.lock|Gopkg\.lock|glide\.lock|go\.sum|yarn\.lock|poetry\.lock|pdm\.lock|Pipfile\.lock|pnpm-lock\.yaml|Cargo\.lock|uv\.lock|esy\.lock|deno\.lock|flake\.lock"
    r"|\.pnp\.(?:c|m)?js|ppport\.h|gradlew(?:\.bat)?|mvnw(?:\.cmd)?)$|(?:^|/)__generated__/|[.-]min\.(?:js|css)$|\.(?:js|css)\.map$|\.pb\.(?:go|cc|h)$|_pb2(?:_grpc)?\.py$|\.designer\.(?:cs|vb)$|\.g\.dart$|\.(?:nib|xcworkspacedata|xcuserstate)$"
)
GENERATED_HEAD = (
    r"(?mi)^(?://|#|--|/\*|<!--|;|%)?[\s*]*(?:Code generated .* DO NOT EDIT|@generated\b|Autogenerated by Thrift|Generated by the protocol buffer compiler|This file (?:was|is) (?:auto-?|automatically )?generated"
    r"|DO NOT EDIT THIS FILE - it is machine generated|Generated by (?:CoffeeScript|Haxe|roxygen2|the gRPC)|The following code was generated by JFlex|generated code - do not modify|THIS IS AN AUTOGENERATED FILE)"
)
#: Characters a line of a script or style sheet has on average if its white space has been taken out.
MINIFIED = 110


def generated(path: Column, content: Column) -> Column:
    """Whether a file looks generated, by name, by its first 2,000 characters or by the length of its lines; false for nulls."""
    lines = F.length(content) - F.length(F.replace(content, F.lit("\n"), F.lit(""))) + 1
    minified = path.rlike(r"\.(?:js|css)$") & (F.length(content) > MINIFIED * lines)
    return F.coalesce(path.rlike(GENERATED_NAME), F.lit(False)) | F.coalesce(F.substring(content, 1, 2000).rlike(GENERATED_HEAD), F.lit(False)) | F.coalesce(minified, F.lit(False))


def keep(
    path: Column,
    exclude: Sequence[str] = (),
    exclude_dirs: Sequence[str] = (),
    exclude_hidden: bool = False,
    include_vcs: bool = False,
    include_vendored: bool = False,
) -> Column:
    """Whether a scan reads ``path``: one predicate, so that it can be pushed to wherever paths come from."""
    out = ~excluded(path, exclude) & ~in_excluded_dir(path, exclude_dirs)
    if exclude_hidden:
        out &= ~hidden(path)
    if not include_vcs:
        out &= ~in_vcs_dir(path)
    if not include_vendored:
        out &= ~vendored(path)
    return out


def vendored_name(name: str) -> bool:
    """The same test for one directory name on the driver."""
    return re.search(VENDORED, name + "/") is not None
