"""Generated texts to per-row scores and their means."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairforge.functions.binding import bind
from pairforge.functions.sparql import tagged_query
from pairforge.operators import match, profile, scoring, tables

TEXT_SCORES = ["bleu", "weighted_bleu", "rouge1", "rouge2", "rougeL", "rougeLsum", "exact_match"]


def text_scores(generations: DataFrame) -> DataFrame:
    """``generations(id, target, raw)`` to one row of text scores each; the query is read between its tags."""
    pairs = generations.select("id", "target", tagged_query(F.col("raw")).alias("generated"))
    parts = [scoring.bleu(pairs), scoring.weighted_bleu(pairs).drop("plain_bleu"), scoring.rouge_n(pairs), scoring.rouge_lcs(pairs)]
    same = pairs.select("id", (F.col("target") == F.col("generated")).cast("double").alias("exact_match"))
    return reduce(lambda left, right: left.join(right, "id"), parts, same)


def _matched(lefts: Column, rights: Column, least: float) -> Column:
    """Set scores of the columns of two results that are matched one to one by the rule score; ties stay."""
    scores = F.transform(
        lefts, lambda a: F.transform(rights, lambda b: match.rule_score_of(a["name"], b["name"], a["kinds"], b["kinds"]))
    )

    def compared(a: Column, b: Column) -> Column:
        sizes = F.size(F.array_intersect(a["values"], b["values"])), F.size(a["values"]), F.size(b["values"])
        return F.struct(*scoring.set_ratios(*sizes))

    def chosen(table: Column, of_left: Column, of_right: Column) -> Column:
        def one(score: Column, i: Column, j: Column) -> Column:
            best = (score >= least) & (score == F.get(of_left, i)) & (score == F.get(of_right, j))
            return F.when(best, compared(F.get(lefts, i), F.get(rights, j)))

        return F.flatten(F.transform(table, lambda line, i: F.array_compact(F.transform(line, lambda score, j: one(score, i, j)))))

    of_left = lambda table: F.transform(table, lambda line: F.array_max(line))
    of_right = lambda table: F.transform(rights, lambda _, j: F.array_max(F.transform(table, lambda line: F.get(line, j))))
    return bind(scores, lambda table: bind(of_left(table), lambda x: bind(of_right(table), lambda y: chosen(table, x, y))))


def result_scores(results: DataFrame, least: float = 0.5) -> DataFrame:
    """(id, overlap, jaccard, dice): mean set scores of the matched columns of the two results of each id.

    ``results(id, target, generated)``, JSON bindings, dealt by id: all groups are parts of an id, so no cell
    moves again. A result was one text of one row, and its columns become one row again.
    """
    sides = F.array(*[F.struct(F.lit(side).alias("side"), F.col(side).alias("bindings")) for side in ("target", "generated")])
    cells = tables.binding_values(results.select("id", F.inline(sides)), ["id", "side"])
    columns = profile.typed_sets(cells, ["id", "side"])
    kinds = F.struct(*[f"is_{t}" for t in profile.TYPES]).alias("kinds")
    column = F.struct(match.normalised_name(F.col("column")).alias("name"), kinds, "values")
    both = columns.select("id", "side", column.alias("column")).groupBy("id").agg(
        *[F.collect_list(F.when(F.col("side") == side, F.col("column"))).alias(side) for side in ("target", "generated")]
    )
    matched = _matched(F.col("target"), F.col("generated"), least)
    mean = lambda rows, n: F.try_divide(F.aggregate(rows, F.lit(0.0), lambda total, m: total + m[n]), F.size(rows)).alias(n)
    means = bind(matched, lambda rows: F.struct(*[mean(rows, n) for n in scoring.SCORES]))
    return both.select("id", means.alias("means")).select("id", "means.*")


def execution_scores(results: DataFrame, least: float = 0.5) -> DataFrame:
    """Set scores and syntax of executed queries: ``results(id, outcome, target, generated)``, results as JSON bindings.

    Bindings are flattened, columns matched, matched columns compared as sets, and the outcome of the
    generated query decides what counts. Outcomes without a score are left out (``scoring.unscored``);
    a missing or unreadable result has no rows. The results are dealt out by id once, whatever the splits
    of their source. Rows without an id are left out; results of one id count as one, and each of its
    outcomes is judged by each of its targets.
    """
    dealt = results.where(F.col("id").isNotNull()).repartition("id")
    n_rows = F.coalesce(F.size(F.from_json("target", tables.BINDINGS)), F.lit(0))
    rows = dealt.select("id", F.struct("outcome", F.greatest(n_rows, F.lit(0)).alias("target_rows")).alias("row"))
    own = rows.groupBy("id").agg(F.collect_list("row").alias("rows"))
    scored = own.join(result_scores(dealt, least), "id", "left")
    each = scored.select("*", F.inline("rows")).select("*", F.explode("rows.target_rows").alias("shown_rows"))
    shown = each.withColumns({n: F.when(F.col("shown_rows") > 0, F.col(n)).otherwise(0.0) for n in scoring.SCORES})
    return scoring.outcome_scores(shown).select("id", "outcome", *scoring.SCORES, "syntax")


def report(rows: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Means of all scores that the rows hold."""
    names = [c for c in [*TEXT_SCORES, *scoring.SCORES, "syntax"] if c in rows.columns]
    return scoring.column_means(rows, names, by)
