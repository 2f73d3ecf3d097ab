"""Scalar functions on names, code and specs, as native column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def glob_regex(pattern: str, question: bool = False) -> str:
    """A glob with `*` (and `?` if asked for) as an anchored regular expression."""
    return "^" + "".join(".*" if c == "*" else "." if question and c == "?" else re.escape(c) for c in pattern) + "$"


def pat_match(c: Column, pattern: str) -> Column:
    return c.rlike("(?s)" + glob_regex(pattern))


def glob_match(c: Column, pattern: str) -> Column:
    return c.rlike("(?s)" + glob_regex(pattern, True))


def word_tokens(name: Column) -> Column:
    """Lower-case words of camelCase, snake_case and acronym names."""
    apart = F.regexp_replace(F.regexp_replace(name, "([a-z0-9])([A-Z])", "$1 $2"), "([A-Z]+)([A-Z][a-z])", "$1 $2")
    return F.filter(F.split(F.lower(apart), "[^a-z0-9]+"), lambda w: w != "")


def lc_first(name: Column) -> Column:
    return F.concat(F.lower(F.substring(name, 1, 1)), F.substring(name, 2, 1 << 30))


def type_base(name: Column) -> Column:
    """The last part of a type's name after dots, colons, slashes and pointer marks."""
    return F.regexp_extract(name, r"([^.:/*&]*)[*&]*$", 1)


def spec_name(spec: Column) -> Column:
    """A sink or source spec's plain name: without `::`, `@...` and receiver."""
    return F.regexp_extract(F.regexp_replace(F.regexp_replace(spec, "^::", ""), "@.*$", ""), r"([^.]*)$", 1)


def spec_index(spec: Column) -> Column:
    """k of `name@k` or `name@out<k>`; null for others."""
    return F.nullif(F.regexp_extract(spec, r"@(?:out)?(\d+)$", 1), F.lit("")).cast("int")


def is_invocation(code: Column, name: Column) -> Column:
    """Whether a name stands in code as a whole word with a parenthesis right after it."""
    return F.regexp_like(code, F.concat(F.lit(r"(^|[^A-Za-z0-9_])"), F.regexp_replace(name, r"([^A-Za-z0-9_])", r"\\$1"), F.lit(r"\(")))


def is_operator(name: Column) -> Column:
    return ~name.rlike("^[A-Za-z_]")


def is_plain_assignment(name: Column) -> Column:
    return name.isin("=", "<operator>.assignment")


def literal_string(code: Column) -> Column:
    """The inside of a quoted literal; null for other code."""
    inside = F.regexp_extract(code, r"""(?s)^(["'`])(.*)\1$""", 2)
    return F.when(code.rlike(r"""(?s)^(["'`])(.*)\1$"""), inside)


def qualified_spelling(code: Column) -> Column:
    return F.trim(F.split(code, r"\(", 2)[0])


def positional(spec: Column) -> Column:
    """`name@file:line` as struct(name, file, line); null for other specs."""
    p = r"^([^@]+)@(.+):(\d+)$"
    return F.when(spec.rlike(p), F.struct(F.regexp_extract(spec, p, 1).alias("name"), F.regexp_extract(spec, p, 2).alias("file"), F.regexp_extract(spec, p, 3).cast("int").alias("line")))


def is_capacity_call(name: Column) -> Column:
    low = F.lower(F.regexp_replace(name, "^:+", ""))
    return low.rlike("^(reserve|resize|expand|grow)|prepbuff|realloc") | (low.contains("ensure") & low.contains("capacity"))


def is_route_literal(code: Column) -> Column:
    return F.coalesce(literal_string(code).startswith("/"), F.lit(False))


def is_router_type(name: Column) -> Column:
    return F.lower(type_base(name)).rlike("(router|mux|engine|routergroup|group|app|server|blueprint)$")


def xml_escape(c: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def dot_escape(c: Column) -> Column:
    return F.replace(F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit("\n"), F.lit("\\n"))


def file_name(c: Column) -> Column:
    return F.regexp_replace(c, r"[^A-Za-z0-9_.\-]", "_")


def path_to_uri(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit("\\"), F.lit("/")), F.lit(" "), F.lit("%20"))


def sarif_level(severity: Column) -> Column:
    s = F.lower(severity)
    return F.when(s.isin("critical", "high", "error"), "error").when(s.isin("medium", "warning"), "warning").otherwise("note")


def feature_hash(c: Column) -> Column:
    """FNV-1a of 32 bits over the UTF-8 bytes."""
    codes = F.transform(F.sequence(F.lit(1), F.octet_length(c)), lambda i: F.conv(F.hex(F.substring(F.encode(c, "UTF-8"), i, F.lit(1))), 16, 10).cast("long"))
    start = F.lit(2166136261).cast("long")
    return F.when(F.octet_length(c) == 0, start).otherwise(F.aggregate(codes, start, lambda h, b: F.shiftright(F.shiftleft(h.bitwiseXOR(b) * 16777619, 32), 32).bitwiseAND(F.lit(0xFFFFFFFF).cast("long"))))
