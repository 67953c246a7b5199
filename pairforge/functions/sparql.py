"""Column helpers that read and extend query text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pairforge.fixed_values import ALL_PREFIXES, END_TAG, ID_PREFIXES, SCHEMA_PREFIXES, START_TAG
from pairforge.functions.binding import bind
from pairforge.functions.text import strip_all

ID = r":([QPL]\d+)(?!\d)"
ANNOTATION = r"""(?U)\[(entity|property):([\w\s,:;'`".!?]+)\]"""
KINDS = {"Q": "entity", "P": "property", "L": "lexeme"}


def item_ids(query: Column) -> Column:
    """Distinct item, property and lexeme ids in order of first use."""
    return F.array_distinct(F.regexp_extract_all(query, F.lit(ID), F.lit(1)))


def id_kind(item: Column) -> Column:
    kind = F.lit(None).cast("string")
    for letter, name in KINDS.items():
        kind = F.when(item.startswith(letter), name).otherwise(kind)
    return kind


def _any_of(prefixes: dict[str, str]) -> str:
    return "|".join(prefixes)


def id_terms_pattern() -> str:
    """One pass over all id prefixes; the word boundary keeps ``xp:P1`` from counting as ``p``."""
    return rf"(?i)\b(?:{_any_of(ID_PREFIXES)}):[A-Z]\d+"


def id_terms(query: Column) -> Column:
    return F.regexp_extract_all(query, F.lit(id_terms_pattern()), F.lit(0))


def schema_terms(query: Column) -> Column:
    return F.regexp_extract_all(query, F.lit(rf"(?i)\b(?:{_any_of(SCHEMA_PREFIXES)}):\w+"), F.lit(0))


def term_prefix(term: Column) -> Column:
    return F.lower(F.split_part(term, F.lit(":"), F.lit(1)))


def _prefix_rows(prefixes: dict[str, str]) -> Column:
    return F.array(*[F.struct(F.lit(k).alias("name"), F.lit(u).alias("url")) for k, u in prefixes.items()])


def prepend_schema_prefixes(query: Column) -> Column:
    """Put a PREFIX line before the query for each schema word it uses, the last one on top."""
    hits = bind(
        F.array_distinct(F.transform(schema_terms(query), term_prefix)),
        lambda used: F.filter(_prefix_rows(SCHEMA_PREFIXES), lambda p: F.array_contains(used, p["name"])),
    )
    lines = F.transform(hits, lambda p: F.concat(F.lit("PREFIX "), p["name"], F.lit(": <"), p["url"], F.lit("> \n")))
    return F.concat(F.array_join(F.reverse(lines), ""), query)


def add_missing_prefixes(query: Column) -> Column:
    """Declare every used and undeclared prefix, in dictionary order, with a blank line after the block."""
    # One look-behind scan finds all used prefixes, instead of one scan per prefix.
    pattern = rf"(?<=\W)({_any_of(ALL_PREFIXES)}):"
    found = F.array_distinct(F.regexp_extract_all(query, F.lit(pattern), F.lit(1)))

    def line(p: Column) -> Column:
        return F.concat(F.lit("PREFIX "), p["name"], F.lit(": <"), p["url"], F.lit(">"))

    missing = bind(
        found,
        lambda used: F.filter(
            _prefix_rows(ALL_PREFIXES),
            lambda p: F.array_contains(used, p["name"]) & ~F.contains(query, line(p)),
        ),
    )
    block = F.array_join(F.transform(missing, lambda p: F.concat(line(p), F.lit("\n"))), "")
    return bind(block, lambda b: F.when(b == "", query).otherwise(F.concat(b, F.lit("\n"), query)))


def annotations(text: Column) -> Column:
    """``[entity:…]`` and ``[property:…]`` marks as (kind, name) pairs in text order."""
    return F.arrays_zip(
        F.regexp_extract_all(text, F.lit(ANNOTATION), F.lit(1)).alias("kind"),
        F.regexp_extract_all(text, F.lit(ANNOTATION), F.lit(2)).alias("name"),
    )


def tagged_query(text: Column, start: str = START_TAG, end: str = END_TAG) -> Column:
    """The text between the first start tag and the next end tag, or else the next start tag."""
    first = F.instr(text, start)
    rest = F.substr(text, first + len(start))
    close = F.instr(rest, end)
    again = F.instr(rest, start)
    stop = F.when(close > 0, close).otherwise(again)
    return F.when((first > 0) & (stop > 0), strip_all(F.substr(rest, F.lit(1), stop - 1))).otherwise("")


# --- query structure, read by pattern and not by grammar -------------------------------------

def declared_prefixes(query: Column) -> Column:
    """PREFIX declarations as (name, url) pairs."""
    pattern = F.lit(r"(?i)PREFIX\s+([\w-]*):\s*<(.*?)>")
    return F.arrays_zip(
        F.regexp_extract_all(query, pattern, F.lit(1)).alias("name"),
        F.regexp_extract_all(query, pattern, F.lit(2)).alias("url"),
    )


def projected_variables(query: Column) -> Column:
    """Variables between SELECT and the opening brace."""
    head = F.regexp_extract(query, r"(?is)\bSELECT\b(.*?)\{", 1)
    return F.regexp_extract_all(head, F.lit(r"\?(\w+)"), F.lit(1))


def row_limit(query: Column) -> Column:
    return F.regexp_extract(query, r"(?i)\bLIMIT\s+(\d+)", 1).try_cast("bigint")


def row_offset(query: Column) -> Column:
    return F.regexp_extract(query, r"(?i)\bOFFSET\s+(\d+)", 1).try_cast("bigint")


def value_rows(query: Column) -> Column:
    """Rows of the first VALUES block: parenthesised tuples, or single terms."""
    block = F.regexp_extract(query, r"(?is)\bVALUES\s*(?:\([^)]*\)|\?\w+)\s*\{(.*?)\}", 1)
    tuples = F.regexp_count(block, F.lit(r"\("))
    terms = F.size(F.filter(F.split(strip_all(block), r"\s+", -1), lambda t: t != ""))
    return F.when(tuples > 0, tuples).otherwise(terms)


_VALUES = r"(?is)\bVALUES\s*(?:\([^)]*\)|\?\w+)\s*\{.*?\}"
# One token of a brace block: an IRI, a string, a comment, a number, a sign, or any other run of characters.
_TOKEN = r"""<[^<>\s]*>|"(?:[^"\\]|\\.)*"|'(?:[^'\\]|\\.)*'|#[^\n]*|[+-]?\d*\.\d+|[(),.;{}]|[^\s(),.;{}<>"'#]+"""
_CLAUSES = ("filter", "bind", "optional", "union", "minus", "service", "graph", "values", "select", "where")


def triple_count(query: Column) -> Column:
    """Statements in the first brace block, by one pass over its tokens.

    A statement has two terms at least and ends at `.`, `;`, `}` or a clause word; each further object of a
    `,` list is one more. What stands in parentheses, VALUES blocks, and the words in front of `{` are none.
    Dots and signs inside IRIs, strings and numbers end nothing. Nested `[ … ]` counts as terms.
    """
    body = F.regexp_extract(F.regexp_replace(query, _VALUES, " "), r"(?s)\{(.*)\}", 1)
    found = F.regexp_extract_all(body, F.lit(_TOKEN), F.lit(0))
    # A sign per token: `e` ends a statement, `t` is a term, braces, commas and parentheses stand for themselves.
    signs = F.array_join(F.transform(found, lambda t: bind(F.lower(t), _sign)), "")
    return bind(signs, lambda signs: bind(_flat(signs), lambda f: F.when(f.rlike("[()]"), _folded(signs)).otherwise(_counted(f))))


def _flat(signs: Column) -> Column:
    """Without what stands in parentheses, up to two deep; none are left if they were well nested."""
    return F.regexp_replace(F.regexp_replace(signs, r"\([^()]*\)", ""), r"\([^()]*\)", "")


def _sign(token: Column) -> Column:
    return (
        F.when(token.isin("(", ")", ",", "{"), token)
        .when(token.isin(".", ";", "}", *_CLAUSES), "e")
        .when(token.startswith("#"), "")
        .otherwise("t")
    )


def _counted(signs: Column) -> Column:
    """Runs of two terms at least that do not end at `{`, and their commas."""
    ended = F.regexp_replace(signs, r"(?<![t,])[t,]*+\{", "{")
    runs = F.regexp_replace(ended, r"(?<![t,]),*t?,*(?![t,])", "")
    return F.regexp_count(runs, F.lit("[t,]+")) + F.length(runs) - F.length(F.replace(runs, F.lit(","), F.lit("")))


def _folded(signs: Column) -> Column:
    """The same sign by sign, for parentheses nested deeper or left open."""
    state = "struct<depth:int,terms:int,more:int,found:int>"

    def step(s: Column, sign: Column) -> Column:
        opens, closes = sign == "(", sign == ")"
        outside = (s["depth"] == 0) & ~opens & ~closes
        ends = outside & sign.isin("e", "{")
        comma = outside & (sign == ",")
        whole = F.when(s["terms"] >= 2, s["more"] + 1).otherwise(0)
        return F.struct(
            (s["depth"] + F.when(opens, 1).when(closes, -1).otherwise(0)).alias("depth"),
            F.when(ends, 0).when(outside & ~comma, s["terms"] + 1).otherwise(s["terms"]).alias("terms"),
            F.when(ends, 0).when(comma, s["more"] + 1).otherwise(s["more"]).alias("more"),
            (s["found"] + F.when(ends & (sign != "{"), whole).otherwise(0)).alias("found"),
        ).cast(state)

    def last(s: Column) -> Column:
        return s["found"] + F.when(s["terms"] >= 2, s["more"] + 1).otherwise(0)

    start = F.struct(*[F.lit(0).alias(n) for n in ("depth", "terms", "more", "found")]).cast(state)
    return F.aggregate(F.filter(F.split(signs, ""), lambda c: c != ""), start, step, last)
