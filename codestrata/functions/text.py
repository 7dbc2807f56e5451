"""Column helpers that pin down semantics once: rounding, globs, url templates, names. No UDFs."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def js_round(x: Column, digits: int = 0) -> Column:
    """Half up towards +infinity, also for negative numbers: floor(x + 0.5)."""
    scale = 10**digits
    return F.floor(x * F.lit(scale) + F.lit(0.5)) / F.lit(scale) if digits else F.floor(x + F.lit(0.5))


def glob_regex(glob: str) -> str:
    """``**`` crosses slashes, ``*`` and ``?`` do not; ``**/`` may match nothing."""
    out, i = "", 0
    while i < len(glob):
        if glob.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
        elif glob.startswith("**", i):
            out, i = out + ".*", i + 2
        elif glob[i] in "*?":
            out, i = out + ("[^/]*" if glob[i] == "*" else "[^/]"), i + 1
        else:
            out, i = out + re.escape(glob[i]), i + 1
    return f"^{out}$"


def base_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)$", 1)


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"(\.[^./]+)$", 1))


def line_count(content: Column) -> Column:
    return F.size(F.split(content, "\n", -1)).cast("long")


def segments(url: Column) -> Column:
    """Lower-cased path segments of a call or endpoint, without query, slashes at the ends and an /api or /api/vN prefix."""
    path = F.regexp_replace(F.lower(F.regexp_replace(url, r"[?#].*$", "")), r"^[a-z]+://[^/]*", "")
    path = F.regexp_replace(F.regexp_replace(path, r"^/+|/+$", ""), r"^api(/v[0-9]+)?(/|$)", "")
    return F.split(path, "/", -1)


def is_parameter(segment: Column) -> Column:
    """{x} or :x."""
    return segment.rlike(r"^(\{.*\}|:.+)$")


ROLE_SUFFIX = r"(controller|service|serviceimpl|repository|component|resource|handler|router|routes?|page|view|screen|client|api|impl|dao)$"


def domain_keyword(path: Column) -> Column:
    """A file's subject: name without extension and role suffix, lower-case letters and digits; null if shorter than 3."""
    name = F.regexp_replace(F.lower(F.regexp_replace(base_name(path), r"\.[^.]*$", "")), "[^a-z0-9]", "")
    for _ in range(2):
        name = F.regexp_replace(name, ROLE_SUFFIX, "")
    return F.when(F.length(name) >= 3, name)


def node_id(prefix: str, name: Column) -> Column:
    """Graph id of a name. Never shortened, so long paths do not collide."""
    return F.concat(F.lit(f"{prefix}_"), F.regexp_replace(name, r"[^A-Za-z0-9]+", "_"))


def camel_words(text: Column) -> Column:
    """Lower-case pieces of an identifier or phrase: split at case changes, acronym ends and non-letters."""
    cut = F.regexp_replace(F.regexp_replace(text, "([a-z0-9])([A-Z])", "$1 $2"), "([A-Z]+)([A-Z][a-z])", "$1 $2")
    return F.filter(F.split(F.lower(cut), "[^a-z]+", -1), lambda w: F.length(w) >= 3)


def tokens_of(content: Column) -> Column:
    """Token estimate: a quarter of the characters, rounded up."""
    return F.ceil(F.length(content) / 4).cast("long")
