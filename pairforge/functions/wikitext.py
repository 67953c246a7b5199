"""Column helpers for wiki text: lines, headings, query templates and links."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pairforge.fixed_values import QUERY_HOST, SHORT_HOST
from pairforge.functions.text import strip_all

HEADING = r"(?d)^ *==+.*==+"
TEMPLATE = r"(?s)\{\{SPARQL\d*\|query=(.*?)\}\}"
PAIR = "struct<key:string,value:string>"


def page_lines(text: Column) -> Column:
    """Lines as ``str.splitlines`` gives them: no empty line after a final break."""
    body = F.regexp_replace(text, r"(\R|[\x1c-\x1e])\z", "")
    return F.split(body, r"\R|[\x1c-\x1e]", -1)


def is_heading(line: Column) -> Column:
    return line.rlike(HEADING)


def heading_level(line: Column, rule: str = "leading") -> Column:
    """``leading`` counts the opening signs; ``first_word`` counts every sign of the first word,
    so that an unspaced ``==Head==`` has level 4."""
    word = F.split_part(strip_all(line), F.lit(" "), F.lit(1))
    if rule == "leading":
        word = F.regexp_extract(word, "^=+", 0)
    elif rule != "first_word":
        raise ValueError(f"unknown level rule {rule!r}")
    return F.regexp_count(word, F.lit("="))


def heading_text(line: Column) -> Column:
    return strip_all(F.regexp_replace(strip_all(line), "^=+|=+$", ""))


def template_bodies(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(TEMPLATE), F.lit(1))


def template_query(body: Column) -> Column:
    """Lines of a template that are not comments, each ending in a line break."""
    lines = F.filter(F.split(strip_all(body), "\n", -1), lambda l: ~l.startswith("#"))
    return F.array_join(F.transform(lines, lambda l: F.concat(l, F.lit("\n"))), "")


def template_pairs(body: Column) -> Column:
    """Comment lines of a template as key/value pairs; one without a colon has the key ``comment``."""

    def pair(line: Column) -> Column:
        rest = F.substr(line, F.lit(2))
        colon = F.instr(rest, ":")
        key = F.when(colon > 0, F.substr(rest, F.lit(1), colon - 1)).otherwise("comment")
        value = F.when(colon > 0, F.substr(rest, colon + 1)).otherwise(rest)
        return F.struct(strip_all(key).alias("key"), strip_all(value).alias("value"))

    lines = F.filter(F.split(strip_all(body), "\n", -1), lambda l: l.startswith("#"))
    return F.transform(lines, pair).cast(f"array<{PAIR}>")


def residual_text(text: Column, keep_tail: bool = True) -> Column:
    """Text without its templates. ``keep_tail=False`` also drops what follows the last one."""
    pieces = F.split(text, TEMPLATE, -1)
    if not keep_tail:
        pieces = F.slice(pieces, 1, F.size(pieces) - 1)
    return F.array_join(pieces, "")


def strip_embed(query: Column) -> Column:
    mark = "embed.html"
    return F.when(query.startswith(mark), F.substr(query, F.lit(len(mark) + 1))).otherwise(query)


def url_unquote(text: Column) -> Column:
    """Percent-decode; ``+`` and percent signs without two hex digits stay."""
    safe = F.regexp_replace(F.replace(text, F.lit("+"), F.lit("%2B")), "%(?![0-9A-Fa-f]{2})", "%25")
    return F.coalesce(F.try_url_decode(safe), text)


def _host(host: str) -> str:
    return host.replace(".", r"\.")


def query_links(text: Column, host: str = QUERY_HOST) -> Column:
    """``[https://host/QUERY label]`` as (target, label); greedy, so at most one per line."""
    pattern = F.lit(rf"(?d)\[https://{_host(host)}/(\S+) +(.*)\]")
    return F.arrays_zip(
        F.regexp_extract_all(text, pattern, F.lit(1)).alias("target"),
        F.regexp_extract_all(text, pattern, F.lit(2)).alias("label"),
    )


def short_links(text: Column, host: str = SHORT_HOST) -> Column:
    pattern = F.lit(rf"(?d)\[(https://{_host(host)}/\S+) +(.*)\]")
    return F.arrays_zip(
        F.regexp_extract_all(text, pattern, F.lit(1)).alias("short_url"),
        F.regexp_extract_all(text, pattern, F.lit(2)).alias("label"),
    )


def link_target(url: Column, host: str = QUERY_HOST) -> Column:
    """The query part of a query-service url, or an empty string."""
    return F.regexp_extract(url, rf"https://{_host(host)}/(\S+)", 1)
