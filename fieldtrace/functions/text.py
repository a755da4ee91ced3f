"""Column expressions on text, paths and ids. All of them stay inside the JVM."""

from __future__ import annotations

import re

from pyspark.sql import Column, functions as F

from fieldtrace import fixed


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def decapitalise(c) -> Column:
    """`FirstName` -> `firstName`."""
    c = _col(c)
    return F.concat(F.lower(F.substring(c, 1, 1)), c.substr(F.lit(2), F.length(c)))


def snake_to_camel(c) -> Column:
    """`SPECIAL_NOTE` -> `specialNote`; a word without `_` becomes lower case."""
    words = F.split(F.lower(_col(c)), "_")
    return F.array_join(
        F.transform(words, lambda w, i: F.when(i == 0, w).otherwise(F.initcap(w))), ""
    )


def percent_text(c, digits: int = 2) -> Column:
    """0.1234 -> `12.34%`."""
    rounded = F.round(_col(c).cast("double") * 100, digits)
    return F.format_string(f"%.{digits}f%%", rounded)


def default_text(c, text: str = "N/A") -> Column:
    return F.coalesce(_col(c), F.lit(text))


def filled(c) -> Column:
    """The text, with an empty one counted as missing."""
    return F.nullif(_col(c), F.lit(""))


def first_filled(*cols, default: str = "") -> Column:
    """The first column that is neither null nor empty."""
    return F.coalesce(*[filled(c) for c in cols], F.lit(default))


def not_blank(c) -> Column:
    return _col(c).rlike(r"\S")


def preview(c, n: int) -> Column:
    return F.substring(_col(c), 1, n)


def clip(c, n: int, marker: str) -> Column:
    """Texts over `n` characters cut there, with the marker behind."""
    c = _col(c)
    return F.when(F.length(c) > n, F.concat(F.substring(c, 1, n), F.lit(marker))).otherwise(c)


def embed_input(c) -> Column:
    return clip(c, fixed.EMBED_MAX_CHARS, fixed.EMBED_MARKER)


def embed_retry_input(c) -> Column:
    return clip(c, fixed.EMBED_RETRY_MAX_CHARS, fixed.EMBED_RETRY_MARKER)


def basename(path) -> Column:
    return F.element_at(F.split(_col(path), "/"), -1)


def suffix(path) -> Column:
    """The last extension with its dot; empty for dot files and names without one."""
    return F.regexp_extract(basename(path), r"[^.](\.[^.]+)$", 1)


def forward_slashes(path) -> Column:
    return F.translate(_col(path), "\\", "/")


def unix_newlines(c) -> Column:
    return F.regexp_replace(_col(c), "\r\n?", "\n")


def lenient_utf8(content) -> Column:
    """Bytes to text with undecodable bytes dropped and newlines made `\\n`.

    `make_valid_utf8` puts U+FFFD for a bad byte run. A text that holds U+FFFD of its own is valid
    and passes untouched when nothing in it is broken.
    """
    text = _col(content).cast("string")
    dropped = F.regexp_replace(F.make_valid_utf8(text), "�", "")
    return unix_newlines(F.when(F.is_valid_utf8(text), text).otherwise(dropped))


def strict_utf8_error(content) -> Column:
    """Error text for bytes that are not UTF-8, else null."""
    return F.when(~F.is_valid_utf8(_col(content).cast("string")), F.lit("invalid UTF-8"))


def file_id(path) -> Column:
    return F.md5(_col(path))


def chunk_id(path, index) -> Column:
    """md5 of the path; chunks of a longer file carry their index."""
    index = _col(index)
    return F.when(index.isNull(), file_id(path)).otherwise(
        F.concat(file_id(path), F.lit("_chunk_"), index.cast("string"))
    )


def excluded(path, patterns: list[str]) -> Column:
    """Whether a path matches one of the globs. One regular expression for all of them.

    `**` crosses folders, `*` and `?` do not. A pattern without `**` is matched against the whole
    path with `*` crossing folders, or as plain text anywhere in the path.
    """
    if not patterns:
        return F.lit(False)
    return forward_slashes(path).rlike("|".join(f"(?:{glob_regex(p)})" for p in patterns))


def glob_regex(pattern: str) -> str:
    pattern = pattern.replace("\\", "/")
    deep = "**" in pattern
    pieces = re.findall(r"\*\*/|\*\*|\*|\?|\[[^\]/]+\]|.", pattern, flags=re.S)
    inside = "[^/]" if deep else "."
    rules = {"**/": "(?:.*/)?", "**": ".*", "*": inside + "*", "?": inside}
    out = []
    for piece in pieces:
        if piece in rules:
            out.append(rules[piece])
        elif len(piece) > 1:
            out.append(piece.replace("[!", "[^"))
        else:
            out.append(re.escape(piece))
    whole = "(?s)^" + "".join(out) + "$"
    return whole if deep else f"{whole}|{re.escape(pattern)}"
