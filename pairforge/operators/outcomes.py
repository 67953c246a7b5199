"""Execution outcomes and error classes: CASE columns and small aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pairforge.fixed_values import ERROR_INDEX, OUTCOMES
from pairforge.functions.binding import bind


def outcome_class(execution: Column) -> Column:
    return (
        F.when(execution == "timeout", "timeout")
        .when(execution.startswith("[]"), "empty")
        .when(execution.startswith("exception"), "fail")
        .otherwise("no_errors")
    )


def with_outcome(executions: DataFrame) -> DataFrame:
    return executions.withColumn("outcome", outcome_class(F.col("execution")))


def outcome_subset(executions: DataFrame, outcome: str) -> DataFrame:
    return executions.where(outcome_class(F.col("execution")) == outcome)


def outcome_counts(executions: DataFrame) -> DataFrame:
    """Count and share (percent, one decimal) of each outcome, zeros included.

    One aggregate row is unpivoted, so no label table is joined and no window is needed.
    """
    counts = with_outcome(executions).agg(
        *[F.count_if(F.col("outcome") == o).alias(o) for o in OUTCOMES], F.count("*").alias("_all")
    )
    cells = [F.struct(F.lit(o).alias("outcome"), F.col(o).alias("n")) for o in OUTCOMES]
    return counts.select("_all", F.inline(F.array(*cells))).select(
        "outcome", "n", F.round(F.try_divide(100 * F.col("n"), F.col("_all")), 1).alias("share")
    )


def outcomes_by_variant(executions: DataFrame, variants: list) -> DataFrame:
    """Outcome rows, one count column per dataset variant."""
    wide = with_outcome(executions).groupBy("outcome").pivot("variant", variants).count()
    return wide.na.fill(0)


def error_type(execution: Column) -> Column:
    """Status code, ``requests``, ``server timeout``, ``empty query`` or null; the first that fits, wherever it stands.

    Only the status code is looked for at the beginning; the tag never depends on how long the text is.
    """
    code = F.regexp_extract(execution, "^exception: ([0-9]+)", 1)
    return (
        F.when(code != "", code)
        .when(_has(execution, "exception: module 'requests.exceptions'"), "requests")
        .when(_has(execution, "java.util.concurrent.TimeoutException"), "server timeout")
        .when(_has(execution, "exception: query is empty"), "empty query")
    )


def _tags(cases: list[tuple[Column, str]]) -> Column:
    return F.array_compact(F.array(*[F.when(F.coalesce(test, F.lit(False)), tag) for test, tag in cases]))


def last_cause(execution: Column) -> Column:
    return F.try_element_at(F.regexp_extract_all(execution, F.lit("(?d)(Caused by: .+)"), F.lit(1)), F.lit(-1))


def _has(text: Column, part: str) -> Column:
    return F.contains(text, F.lit(part))


def client_error_tags(execution: Column) -> Column:
    def tags(cause: Column) -> Column:
        limit = _has(cause, "limit") | _has(cause, "LIMIT")
        parse = cause.rlike("ast.ParseException")
        return _tags(
            [
                (_has(cause, "undefined prefix"), "undefined prefix"),
                (parse & limit, "parse exception due to limit"),
                (parse & ~limit, "parse exception"),
                (_has(cause, "Lexical error"), "lexical error"),
                (
                    _has(cause, "Non-aggregate variable in select expression"),
                    "non-aggregate variable in select expression",
                ),
                (_has(cause, "Multiple prefix declarations for prefix"), "Prefix duplicates"),
            ]
        )

    return bind(last_cause(execution), tags)


def server_error_tags(execution: Column) -> Column:
    chunk = "exception: 500 Server Error: the response has an Invalid chunk length"

    def tags(cause: Column) -> Column:
        return _tags(
            [
                (_has(cause, "StackOverflowError"), "stack overflow"),
                (
                    _has(cause, "Input could not be resolved as point"),
                    "GeoSpatialSearchException: input could not be resolved as point",
                ),
                (_has(cause, "The estimated execution time"), "estimated time to execute too long"),
                (_has(cause, "MemoryManagerOutOfMemory"), "Out of memory"),
                (cause.rlike("java.lang.NullPointerException"), "NullPointerException"),
                (_has(execution, chunk), "Invalid JSON"),
            ]
        )

    return bind(F.coalesce(last_cause(execution), F.lit("")), tags)


def request_error_tags(execution: Column) -> Column:
    text = "exception: module 'requests.exceptions' has no attribute 'JSONDecodeError'"
    return _tags([(_has(execution, text), "no attribute 'JSONDecodeError'")])


def error_tags(execution: Column) -> Column:
    """Tags by error type; null without a type, ``other`` for a status code without rules."""

    def tags(kind: Column) -> Column:
        return (
            F.when(kind == "400", client_error_tags(execution))
            .when(kind == "500", server_error_tags(execution))
            .when(kind == "requests", request_error_tags(execution))
            .when(kind.isin("server timeout", "empty query"), F.array(kind))
            .when(kind.isNotNull(), F.array(F.lit("other")))
        )

    return bind(error_type(execution), tags)


def error_number(tags: Column) -> Column:
    """Number of the first tag; null for no tag or one without a number."""
    numbers = F.create_map(*[F.lit(x) for pair in ERROR_INDEX.items() for x in pair])
    return F.try_element_at(numbers, F.try_element_at(tags, F.lit(1)))


def with_errors(executions: DataFrame) -> DataFrame:
    """Failed executions with their error type, tags and tag number."""
    execution = F.col("execution")
    failed = outcome_subset(executions, "fail").withColumns(
        {"error_type": error_type(execution), "tags": error_tags(execution)}
    )
    return failed.withColumn("error_number", error_number(F.col("tags")))


def error_type_examples(errors: DataFrame, key: str = "id", width: int = 256) -> DataFrame:
    """Each error type (null included) with its count and the start of its first execution."""
    return errors.groupBy("error_type").agg(
        F.count("*").alias("n"), F.min_by(F.left("execution", F.lit(width)), key).alias("example")
    )


def tag_counts(errors: DataFrame) -> DataFrame:
    """Count of each tag combination, most frequent first."""
    return (
        errors.where("tags is not null")
        .groupBy(F.array_join("tags", ", ").alias("tags"))
        .agg(F.count("*").alias("n"))
        .orderBy(F.desc("n"), "tags")
    )


def type_counts(errors: DataFrame) -> DataFrame:
    return (
        errors.where("error_type is not null")
        .groupBy("error_type")
        .agg(F.count("*").alias("n"))
        .orderBy(F.desc("n"), "error_type")
    )


def sides_by_variant(errors: DataFrame, variants: list) -> DataFrame:
    """Client-side (400) and server-side (500) error counts per dataset variant."""
    wide = errors.where(F.col("error_type").isin("400", "500")).groupBy("error_type").pivot("variant", variants)
    return wide.count().na.fill(0)


def tag_index(errors: DataFrame) -> DataFrame:
    """Distinct tag combinations numbered in sorted order, keyed by their first tag."""
    combos = errors.where(F.size("tags") > 0).select("tags").distinct()
    # Combinations are drawn from a fixed list of tags, so the single-task window sees few rows.
    number = F.row_number().over(Window.orderBy(F.col("tags"))) - 1
    return combos.select(F.get("tags", F.lit(0)).alias("tag"), F.array_join("tags", ", ").alias("tags"), number.alias("number"))
