"""Text expressions with Python's string semantics, evaluated in the JVM."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, functions as F

# str.isspace() characters: Java's Unicode white space plus the four separators.
WS = r"[\s\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
WS_CHARS = "".join(
    map(chr, [*range(9, 14), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680,
              *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000])
)
# str.isalnum() characters and the underscore.
WORD = r"[\p{L}\p{N}_]"
# Line breaks other than \n and the pair \r\n.
OTHER_BREAKS = "\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029"


def lines(text: Column) -> Column:
    """``str.splitlines()``: a break at the very end opens no further line.

    Texts with breaks other than ``\\n`` are brought to ``\\n`` first; all others go
    straight to the split.
    """
    unix = F.when(
        text.rlike(f"[{OTHER_BREAKS}]"),
        F.translate(
            F.replace(text, F.lit("\r\n"), F.lit("\n")), OTHER_BREAKS,
            "\n" * len(OTHER_BREAKS),
        ),
    ).otherwise(text)
    none = F.array().cast("array<string>")
    return F.when(text == "", none).otherwise(
        F.split(F.regexp_replace(unix, r"\n\z", ""), "\n")
    )


def strip(text: Column) -> Column:
    """``str.strip()``; plain ``trim`` would remove blanks only."""
    return F.btrim(text, F.lit(WS_CHARS))


def base_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def snippet(code: Column, width: int = 120) -> Column:
    """First characters on one line."""
    return F.translate(F.left(code, F.lit(width)), "\n", " ")


def percent(share: Column) -> Column:
    """Whole percent with ties to even, like ``format(x, '.0%')``."""
    return F.concat(F.bround(share * 100, 0).cast("long").cast("string"), F.lit("%"))


def contains_any(text: Column, needles) -> Column:
    return reduce(or_, [text.contains(n) for n in needles], F.lit(False))


def starts_with_any(text: Column, prefixes) -> Column:
    return reduce(or_, [text.startswith(p) for p in prefixes], F.lit(False))


def fill(template: str, **values: Column) -> Column:
    """Fill ``{name}`` slots of a text from columns, in one concat."""
    pieces, rest = [], template
    while rest:
        hits = [(rest.find("{" + k + "}"), k) for k in values]
        hits = [h for h in hits if h[0] >= 0]
        if not hits:
            pieces.append(F.lit(rest))
            break
        at, key = min(hits)
        if at:
            pieces.append(F.lit(rest[:at]))
        pieces.append(values[key].cast("string"))
        rest = rest[at + len(key) + 2:]
    return F.concat(*pieces)


def chunk_id(file_path: Column, function_name: Column, start_line: Column) -> Column:
    key = F.concat_ws("::", file_path, function_name, start_line.cast("string"))
    return F.left(F.sha1(key), F.lit(12))


def path_order(path: Column) -> Column:
    """Sort key of a path: by parts, so that ``a/b.py`` comes before ``a-b.py``."""
    return F.split(path, "/")


def repo_name(url: Column) -> Column:
    """Last segment of a repository URL without ``.git``."""
    last = F.element_at(F.split(F.regexp_replace(url, "/+$", ""), "/"), -1)
    return F.regexp_replace(last, r"\.git$", "")


def collection_name(url: Column) -> Column:
    """Lower-case slug of the last URL segment, 40 characters at most."""
    last = F.element_at(F.split(F.regexp_replace(url, "/+$", ""), "/"), -1)
    slug = F.regexp_replace(F.lower(last), r"[^\p{L}\p{N}]", "-")
    slug = F.left(F.regexp_replace(slug, "^-+|-+$", ""), F.lit(40))
    return F.when(slug == "", F.lit("default")).otherwise(slug)
