"""Paths, media types, hashes and globs as column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column, functions as F

# Media types by lower-case extension.
MEDIA_TYPES = {
    "html": "text/html",
    "htm": "text/html",
    "md": "text/markdown",
    "markdown": "text/markdown",
    "txt": "text/plain",
    "rs": "text/rust",
    "json": "application/json",
    "toml": "application/toml",
    "yaml": "application/yaml",
    "yml": "application/yaml",
    "xml": "application/xml",
    "csv": "text/csv",
    "css": "text/css",
    "js": "text/javascript",
    "ts": "text/typescript",
    "png": "image/png",
    "jpg": "image/jpeg",
    "jpeg": "image/jpeg",
    "gif": "image/gif",
    "svg": "image/svg+xml",
    "pdf": "application/pdf",
    "zip": "application/zip",
}

EXTENSION = r"[^/][.]([^./]*)$"


def slashes(path: Column) -> Column:
    """Backslashes become slashes."""
    return F.replace(path, F.lit("\\"), F.lit("/"))


def url_path(url: Column) -> Column:
    """A URL without scheme, query and fragment."""
    return F.regexp_replace(F.regexp_replace(url, "[?#].*$", ""), "^[A-Za-z][A-Za-z0-9+.-]*://", "")


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def extension(path: Column) -> Column:
    """The last extension in lower case; empty if there is none, as for a dot-file."""
    return F.lower(F.regexp_extract(path, EXTENSION, 1))


def media_type(path: Column) -> Column:
    """The media type of a path's extension, or null."""
    table = F.create_map(*(F.lit(x) for pair in MEDIA_TYPES.items() for x in pair))
    return F.try_element_at(table, extension(path))


def media_type_of(path: str) -> str | None:
    m = re.search(EXTENSION, path)
    return MEDIA_TYPES.get(m[1].lower()) if m else None


def content_hash(content: Column) -> Column:
    """Lower-case hex SHA-256 of a text's UTF-8, or of bytes."""
    return F.sha2(content, 256)


NOT_RELATIVE, EMPTY = "not_relative", "empty"


def relative_path_error(path: Column, convert_first: bool = False) -> Column:
    """Why a path cannot be an item's key, or null.

    Absolute paths and ``..`` components are refused; with ``convert_first``
    backslashes count as slashes in that test.
    """
    tested = slashes(path) if convert_first else path
    return F.when(tested.startswith("/") | tested.rlike("(^|/)[.][.](/|$)"), NOT_RELATIVE).when(relative_path(path).isin("", "."), EMPTY)


def relative_path(path: Column) -> Column:
    """Slashes only, and one leading ``./`` dropped."""
    return F.regexp_replace(slashes(path), "^[.]/", "")


def same_path(path: Column) -> Column:
    """A form that is equal for equivalent paths: no empty or interior ``.`` components."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(path, "/+", "/"), "(/[.])+(?=/|$)", ""), "(?<=.)/$", "")


def is_blank(text: Column) -> Column:
    """Empty but for Unicode white space."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "") == ""


def folder_of(path: Column) -> Column:
    """The path up to its last slash; empty at the root."""
    return F.regexp_replace(path, "/?[^/]*$", "")


def glob_regex(pattern: str) -> str:
    """A glob as an anchored regular expression that Java, RE2 and Python read alike.

    ``*`` and ``?`` stay within one component, ``**/`` stands for any number of
    folders, ``[...]`` and ``{a,b}`` for choices.
    """
    out, i, depth = [], 0, 0
    while i < len(pattern):
        c = pattern[i]
        if pattern.startswith("**/", i) and (i == 0 or pattern[i - 1] == "/"):
            out.append("(?:[^/]*/)*")
            i += 3
            continue
        if pattern.startswith("**", i):
            out.append(".*")
            i += 2
            continue
        if c == "*":
            out.append("[^/]*")
        elif c == "?":
            out.append("[^/]")
        elif c == "[" and (end := pattern.find("]", i + 2)) > 0:
            inner = pattern[i + 1 : end].replace("\\", "\\\\")
            out.append("[" + ("^" + inner[1:] if inner[0] in "!^" else inner) + "]")
            i = end
        elif c == "{" and "}" in pattern[i:]:
            depth += 1
            out.append("(?:")
        elif c == "," and depth:
            out.append("|")
        elif c == "}" and depth:
            depth -= 1
            out.append(")")
        else:
            out.append(c if c.isalnum() or c in "/_- " or ord(c) > 127 else f"[{c}]" if c not in "^\\" else f"\\{c}")
        i += 1
    return "^" + "".join(out) + "$"


def split_patterns(include, exclude) -> tuple[list[str], list[str]]:
    """Includes and excludes; ``!x`` among either is an exclude, no include means everything."""
    patterns = [*(include or ["**/*"]), *(p if p.startswith("!") else f"!{p}" for p in exclude)]
    keep = [p for p in patterns if not p.startswith("!")]
    drop = [p[1:] for p in patterns if p.startswith("!") and len(p) > 1]
    return keep or ["**/*"], drop


def pattern_regexes(include, exclude) -> tuple[str, str | None]:
    keep, drop = split_patterns(include, exclude)
    return "|".join(map(glob_regex, keep)), "|".join(map(glob_regex, drop)) or None


def selected(path: Column, include, exclude) -> Column:
    """Whether a relative path matches an include and no exclude."""
    keep, drop = pattern_regexes(include, exclude)
    return path.rlike(keep) & ~path.rlike(drop) if drop else path.rlike(keep)


def static_prefix(pattern: str) -> str:
    """The folder that every match of a glob is below."""
    parts = []
    for part in pattern.split("/")[:-1]:
        if re.search(r"[*?\[{]", part):
            break
        parts.append(part)
    return "/".join(parts)
