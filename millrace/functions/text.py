"""Text, path and time expressions. All are built-in functions, so they stay in generated code."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Special tokens with ids 0 to 5.
SPECIAL_TOKENS = ("[PAD]", "[UNK]", "[SEP]", "[CLS]", "[MASK]", "[NEXT]")
PAD, UNK, SEP, CLS, MASK, NEXT = range(6)


def sha256(value: Column) -> Column:
    """SHA-256 of text or bytes, in lower-case hexadecimal."""
    return F.sha2(value.cast("binary"), 256)


def cache_name(path: Column) -> Column:
    """Name of a cached copy: eight digits of the MD5 of the folder, and the file's name."""
    return F.concat(F.substring(F.md5(dirname(path).cast("binary")), 1, 8), F.lit("-"), basename(path))


def timestamp_tag(at: Column) -> Column:
    """``20000101-000000``."""
    return F.date_format(at, "yyyyMMdd-HHmmss")


def iso_utc(at: Column) -> Column:
    """ISO 8601 with ``Z``; microseconds only where there are any."""
    fraction = F.date_format(at, "SSSSSS")
    return F.concat(F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss"), F.when(fraction == "000000", "").otherwise(F.concat(F.lit("."), fraction)), F.lit("Z"))


def basename(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)$", 1)


def dirname(path: Column) -> Column:
    """All before the last slash, itself and slashes before it left out; the root stays."""
    head = F.regexp_extract(path, r"^(.*/)[^/]*$", 1)
    return F.when(F.regexp_extract(head, r"^(/*)$", 1) != "", head).otherwise(F.regexp_replace(head, r"/+$", ""))


def extension(path: Column) -> Column:
    """Last dot of the name and what follows; none for a name that only begins with dots."""
    return F.regexp_extract(path, r"[^/.][^/]*?(\.[^/.]*)$", 1)


def stem(path: Column) -> Column:
    """Path without its extension."""
    return F.substring(path, F.lit(1), F.length(path) - F.length(extension(path)))


def enforce_extension(path: Column, wanted: str) -> Column:
    """Replace or add the extension."""
    return F.concat(stem(path), F.lit(wanted))


def join_path(*parts: Column | str) -> Column:
    return F.concat_ws("/", *[F.lit(p) if isinstance(p, str) else p for p in parts])


def normalized(value: Column) -> Column:
    """Lower case, without white space at either end."""
    return F.regexp_replace(F.lower(value), r"^\s+|\s+$", "")


def tokens(value: Column) -> Column:
    """Array of the runs of anything but white space."""
    return F.filter(F.split(value, r"\s+"), lambda x: x != "")


def is_immediate(token: Column) -> Column:
    """Whether a token is an integer literal, single underscores between digits included."""
    return token.rlike(r"^[+-]?[0-9]+(_[0-9]+)*$")


def sanitize(value: Column) -> Column:
    """One-line model input: white space collapsed and all lowered but ``[CAPITALS]`` in brackets; null is empty."""
    flat = F.regexp_replace(F.regexp_replace(F.coalesce(value, F.lit("")), r"^\s+|\s+$", ""), r"\s+", " ")
    parts = F.regexp_extract_all(flat, F.lit(r"(\[[A-Z]+\]|[^\[]+|\[)"), F.lit(1))
    return F.array_join(F.transform(parts, lambda p: F.when(p.rlike(r"^\[[A-Z]+\]$"), p).otherwise(F.lower(p))), "")


def lines_to_next(value: Column) -> Column:
    """Trimmed lines that are not empty, joined by ``[NEXT]``."""
    lines = F.transform(F.split(value, "\n"), lambda x: F.regexp_replace(x, r"^\s+|\s+$", ""))
    return F.array_join(F.filter(lines, lambda x: x != ""), " [NEXT] ")


def next_to_lines(value: Column) -> Column:
    """A line for each instruction."""
    return F.regexp_replace(value, r"\s*\[NEXT\]\s*", "\n")


def highlight(value: Column, query: str) -> Column:
    """Wrap every occurrence of ``query``, whatever its case, in ``<mark>``."""
    if not query:
        return value
    return F.regexp_replace(value, f"(?i)({re.escape(query)})", "<mark>$1</mark>")


def format_tokens(value: Column, bold: str = "[MASK]") -> Column:
    """Markdown for decoded tokens: a line for each instruction, masks in bold."""
    return F.replace(F.replace(value, F.lit("[NEXT] "), F.lit("[NEXT]\n")), F.lit(bold), F.lit(f"**{bold}**"))


def strip_padding(value: Column) -> Column:
    return F.regexp_replace(F.replace(value, F.lit("[PAD]"), F.lit("")), r"^\s+|\s+$", "")


def decode_enum(code: Column, names: dict[int, str]) -> Column:
    """Name of a code; null for null or an unknown one."""
    out = None
    for value, name in names.items():
        out = F.when(code == value, name) if out is None else out.when(code == value, name)
    return F.lit(None).cast("string") if out is None else out


def task_text(title: Column, statement: Column) -> Column:
    return F.concat(F.lit("<h2>"), title, F.lit("</h2>\n"), statement)


def searched(value: Column, query: str) -> Column:
    """Whether text holds a query, both trimmed and lowered; an empty query is in all."""
    q = query.strip().lower()
    return F.lit(True) if not q else F.contains(F.lower(value), F.lit(q))


_UNITS = {"": 1, "b": 1, "kb": 10**3, "mb": 10**6, "gb": 10**9, "tb": 10**12, "kib": 2**10, "mib": 2**20, "gib": 2**30, "tib": 2**40, "k": 10**3, "m": 10**6, "g": 10**9}


def parse_size(value: int | str) -> int:
    """Bytes of a number or of text such as ``25MB`` or ``1.5GiB``."""
    if isinstance(value, int):
        return value
    m = re.fullmatch(r"\s*([0-9]*\.?[0-9]+)\s*([A-Za-z]*)\s*", value)
    if not m or m[2].lower() not in _UNITS:
        raise ValueError(f"cannot read size {value!r}")
    return int(float(m[1]) * _UNITS[m[2].lower()])
