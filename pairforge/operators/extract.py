"""Queries and their context out of page text.

A page is one row and its text one cell: lines, sections, ancestry and templates are arrays inside
the row, so the whole step is a narrow transform however many pages one source has.
"""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pairforge.fixed_values import QUERY_HOST, SHORT_HOST
from pairforge.functions import wikitext as wt
from pairforge.functions.binding import bind

METADATA = "array<struct<description:string,context:string>>"


def _sections(level_rule: str) -> Column:
    """Level, heading and text of the sections of ``text``. Lines and their headings are found once per page."""

    def of(lines: Column, heads: Column) -> Column:
        def section(start: Column, k: Column) -> Column:
            line = F.element_at(lines, start)
            stop = F.coalesce(F.get(heads, k + 1), F.size(lines) + 1)
            text = F.array_join(F.slice(lines, start + 1, stop - start - 1), "\n")
            return F.struct(
                wt.heading_level(line, level_rule).alias("level"), wt.heading_text(line).alias("heading"), text.alias("text")
            )

        return F.transform(heads, section)

    def heads(lines: Column) -> Column:
        return F.filter(F.sequence(F.lit(1), F.size(lines)), lambda i: wt.is_heading(F.element_at(lines, i)))

    return bind(wt.page_lines(F.col("text")), lambda lines: bind(heads(lines), lambda found: of(lines, found)))


def _cut(pages: DataFrame, level_rule: str) -> DataFrame:
    """(page_id, _sections): an array of level, heading and text per page."""
    return pages.select("page_id", _sections(level_rule).alias("_sections"))


@F.pandas_udf(T.ArrayType(T.IntegerType()))
def _parents(levels: pd.Series) -> pd.Series:
    """For each section of a page the 1-based place of the section around it, 0 for none: one pass with a stack."""

    def of(page) -> list[int]:
        stack: list[tuple[int, int]] = []
        out = []
        for place, level in enumerate(page, 1):
            while stack and stack[-1][0] >= level:
                stack.pop()
            out.append(stack[-1][1] if stack else 0)
            stack.append((level, place))
        return out

    return levels.map(of)


def _with_parents(pages: DataFrame, level_rule: str) -> DataFrame:
    levels = F.transform("_sections", lambda s: s["level"])
    return _cut(pages, level_rule).withColumn("_parents", _parents(levels))


def _path(i: Column) -> Column:
    """Places of the ancestors of section ``i`` and its own, from the top: up by parents, as many steps as it is deep."""
    chain = F.struct(F.array(i).alias("path"), F.element_at("_parents", i).alias("above"))
    steps = F.sequence(F.lit(1), F.greatest(F.element_at("_sections", i)["level"], F.lit(1)))

    def up(acc: Column, _: Column) -> Column:
        above = F.element_at("_parents", F.greatest(acc["above"], F.lit(1)))
        return F.when(acc["above"] == 0, acc).otherwise(
            F.struct(F.array_prepend(acc["path"], acc["above"]).alias("path"), above.alias("above"))
        )

    return F.aggregate(steps, chain, up, lambda acc: acc["path"])


def _exploded(rows: DataFrame, keep: list[str], items: Column, place: str, item: str) -> DataFrame:
    """One row per item with its place. The outer form, without its empty rows: the plain one would have the
    optimizer put a filter on the array before it, which computes the whole array once more for each test."""
    return rows.select(*keep, F.posexplode_outer(items).alias(place, item)).where(F.col(place).isNotNull())


def _places() -> Column:
    n = F.size("_sections")
    return F.when(n > 0, F.sequence(F.lit(1), F.greatest(n, F.lit(1)))).otherwise(F.array().cast("array<int>"))


def outline(pages: DataFrame, level_rule: str = "leading") -> DataFrame:
    """``pages(page_id, text)`` to one row per section: its level, heading and own text.

    Lines before the first heading belong to no section.
    """
    rows = _exploded(_cut(pages, level_rule), ["page_id"], F.col("_sections"), "section_id", "section")
    return rows.select("page_id", "section_id", "section.*")


def residuals(pages: DataFrame, level_rule: str = "leading", keep_tail: bool = True) -> DataFrame:
    """:func:`outline` with the text of each section without its templates."""
    return outline(pages, level_rule).withColumn("residual", wt.residual_text(F.col("text"), keep_tail))


def sections(pages: DataFrame, level_rule: str = "leading", keep_tail: bool = True) -> DataFrame:
    """:func:`residuals` with the path of each section: level, heading and residual text from the top to itself.

    Texts of ancestors stand in every section below them; :func:`ancestry` has the headings alone.
    """
    rows = _with_parents(pages, level_rule)

    def described(rest: Column) -> Column:
        def of(i: Column) -> Column:
            s = F.element_at("_sections", i)
            return F.struct(s["level"].alias("level"), s["heading"].alias("heading"), F.element_at(rest, i).alias("text"))

        return F.transform(
            _places(),
            lambda i: F.struct(
                F.element_at("_sections", i).alias("section"), F.element_at(rest, i).alias("residual"),
                F.transform(_path(i), of).alias("path"),
            ),
        )

    rest = F.transform("_sections", lambda s: wt.residual_text(s["text"], keep_tail))
    cut = _exploded(rows, ["page_id"], bind(rest, described), "section_id", "row")
    return cut.select("page_id", "section_id", "row.section.*", "row.residual", "row.path")


def ancestry(pages: DataFrame, level_rule: str = "leading") -> DataFrame:
    """(page_id, section_id, path): level and heading from the top section down to each section."""

    def named(i: Column) -> Column:
        s = F.element_at("_sections", i)
        return F.struct(s["level"].alias("level"), s["heading"].alias("heading"))

    paths = F.transform(_places(), lambda i: F.transform(_path(i), named))
    return _exploded(_with_parents(pages, level_rule), ["page_id"], paths, "section_id", "path")


def section_context(path: Column) -> Column:
    """Headings and texts down the ancestry, each on a new line."""
    return F.array_join(
        F.transform(path, lambda s: F.concat(F.lit("\n"), s["heading"], F.lit("\n"), s["text"])), ""
    )


def _record(query: Column, description: Column, context: Column) -> list[Column]:
    metadata = F.array(F.struct(description.alias("description"), context.alias("context")))
    return [wt.strip_embed(query).alias("query"), metadata.cast(METADATA).alias("metadata")]


def _contexts(rest: Column) -> Column:
    """Context of the sections that hold a template: headings and texts along their path."""

    def part(i: Column) -> Column:
        return F.concat(F.lit("\n"), F.element_at("_sections", i)["heading"], F.lit("\n"), F.element_at(rest, i))

    def of(i: Column) -> Column:
        section = F.element_at("_sections", i)
        holds = section["text"].rlike(wt.TEMPLATE)
        return F.struct(section["text"].alias("text"), F.when(holds, F.array_join(F.transform(_path(i), part), "")).alias("context"))

    return F.transform(_places(), of)


def _templates(rows: DataFrame, *more: str) -> DataFrame:
    return _exploded(rows, ["page_id", "section_id", *more], wt.template_bodies(F.col("text")), "pos", "body")


def template_rows(pages: DataFrame, level_rule: str = "leading") -> DataFrame:
    """One row per query template: its comment pairs and query, without the context of its section."""
    found = _templates(outline(pages, level_rule))
    query = wt.strip_embed(wt.template_query(F.col("body")))
    return found.select("page_id", "section_id", "pos", wt.template_pairs(F.col("body")).alias("pairs"), query.alias("query"))


def template_queries(pages: DataFrame, level_rule: str = "leading", keep_tail: bool = True) -> DataFrame:
    """One row per query template: query, its comment pairs, and description and context.

    The text of ancestors is put together for sections that hold a template, and for no other.
    """
    rest = F.transform("_sections", lambda s: wt.residual_text(s["text"], keep_tail))
    rows = _exploded(_with_parents(pages, level_rule), ["page_id"], bind(rest, _contexts), "section_id", "row")
    found = _templates(rows.select("page_id", "section_id", "row.*"), "context")
    pairs = wt.template_pairs(F.col("body"))
    description = F.array_join(F.transform(pairs, lambda p: p["value"]), "\n")
    return found.select(
        "page_id",
        "section_id",
        "pos",
        pairs.alias("pairs"),
        *_record(wt.template_query(F.col("body")), description, F.col("context")),
    )


def link_queries(pages: DataFrame, host: str = QUERY_HOST) -> DataFrame:
    """Queries written into links to the query service."""
    links = pages.select("page_id", F.posexplode(wt.query_links(F.col("text"), host)).alias("pos", "link"))
    return links.select(
        "page_id", "pos", *_record(wt.url_unquote(F.col("link.target")), F.col("link.label"), F.lit(""))
    )


def short_link_queries(
    pages: DataFrame, redirects: DataFrame, host: str = QUERY_HOST, short_host: str = SHORT_HOST
) -> DataFrame:
    """Queries behind shortened links; ``redirects(short_url, target)`` has one row per short url."""
    links = pages.select(
        "page_id", F.posexplode(wt.short_links(F.col("text"), short_host)).alias("pos", "link")
    ).select("page_id", "pos", "link.*")
    target = wt.link_target(F.col("target"), host)
    return (
        links.join(redirects, "short_url")
        .where(target != "")
        .select(
            "page_id",
            "pos",
            *_record(wt.url_unquote(target), F.split_part("label", F.lit("]"), F.lit(1)), F.lit("")),
        )
    )


def harvested(*parts: DataFrame) -> DataFrame:
    """All queries of all ways to find them. ``page_id, origin, section_id, pos`` name each one:
    ``origin`` is the place of its part among the arguments."""

    def named(origin: int, part: DataFrame) -> DataFrame:
        section = F.col("section_id") if "section_id" in part.columns else F.lit(0).alias("section_id")
        return part.select("page_id", F.lit(origin).alias("origin"), section, "pos", "query", "metadata")

    return reduce(DataFrame.unionByName, [named(i, part) for i, part in enumerate(parts)])


def queries_per_page(pages: DataFrame) -> DataFrame:
    """Templates inside sections per page, pages without any included.

    Counted inside each row: no join and no shuffle.
    """
    counts = F.transform(
        "_sections", lambda s: F.size(F.regexp_extract_all(s["text"], F.lit(wt.TEMPLATE), F.lit(1)))
    )
    return _cut(pages, "leading").select(
        "page_id", F.aggregate(counts, F.lit(0), lambda acc, n: acc + n).cast("bigint").alias("n_queries")
    )


def malformed_sections(pages: DataFrame) -> DataFrame:
    """Sections that mention the template name but hold no well-formed template."""
    text = F.col("text")
    return outline(pages).where(
        F.contains(text, F.lit("SPARQL")) & (F.regexp_count(text, F.lit(wt.TEMPLATE)) == 0)
    )
