"""Scores of generated queries: text overlap, label agreement and result-table overlap."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairforge.fixed_values import QUERY_KEYWORDS
from pairforge.functions import ngrams as ng
from pairforge.functions.binding import bind
from pairforge.functions.sampling import draw
from pairforge.functions.similarity import rouge_l
from pairforge.functions.text import round_significant

OTHER_WORD_WEIGHT = 0.2


def aligned(targets: DataFrame, generated: DataFrame, key: str = "id") -> DataFrame:
    """Every target with its generation; generations without a target are dropped."""
    return targets.join(generated, key, "left")


# --- n-gram overlap ----------------------------------------------------------------------------

def _matches(reference: Column, candidate: Column, weight=None) -> Column:
    """Clipped matches of two gram arrays: equal grams stand together after a sort, those of the reference
    first; each one of the candidate uses one of them up. One pass, whatever repeats."""
    side = lambda grams, n: F.transform(grams, lambda g: F.struct(g.alias("gram"), F.lit(n).alias("side")))
    unit = weight or (lambda _: F.lit(1.0))

    def step(acc: Column, x: Column) -> Column:
        left = F.when(acc["gram"] == x["gram"], acc["left"]).otherwise(0)
        hit = (x["side"] == 1) & (left > 0)
        return F.struct(
            x["gram"].alias("gram"),
            F.when(x["side"] == 0, left + 1).otherwise(F.greatest(left - 1, F.lit(0))).alias("left"),
            F.when(hit, acc["found"] + unit(x["gram"])).otherwise(acc["found"]).alias("found"),
        )

    start = F.struct(F.lit("").alias("gram"), F.lit(0).alias("left"), F.lit(0.0).alias("found"))
    return F.aggregate(F.sort_array(F.concat(side(reference, 0), side(candidate, 1))), start, step, lambda acc: acc["found"])


def ngram_overlap(
    pairs: DataFrame, reference: Column, candidate: Column, max_n: int, key: str = "id", weight=None
) -> DataFrame:
    """Per pair and order n: clipped matches ``match_n`` and sizes ``ref_n``, ``can_n``.

    A narrow step: both texts are in one row and their n-grams are sorted inside it. ``weight`` maps a
    unigram Column to its weight and adds ``weighted_match_1`` and ``weight_1``. Null texts have no tokens.
    """

    def counts(ref: Column, can: Column) -> Column:
        fields = []
        for n in range(1, max_n + 1):
            fields += [
                _matches(ng.ngrams(ref, n), ng.ngrams(can, n)).alias(f"match_{n}"),
                F.greatest(F.size(ref) - (n - 1), F.lit(0)).alias(f"ref_{n}"),
                F.greatest(F.size(can) - (n - 1), F.lit(0)).alias(f"can_{n}"),
            ]
        if weight:
            total = F.aggregate(can, F.lit(0.0), lambda acc, g: acc + weight(g))
            fields += [_matches(ref, can, weight).alias("weighted_match_1"), total.alias("weight_1")]
        return F.struct(*fields)

    none = F.array().cast("array<string>")
    tokens = [F.coalesce(c, none) for c in (reference, candidate)]
    bound = bind(tokens[0], lambda ref: bind(tokens[1], lambda can: counts(ref, can)))
    return pairs.select(key, bound.alias("_n")).select(key, "_n.*")


def _bleu(precisions: list[Column]) -> Column:
    log_mean = sum((F.log(p) for p in precisions), F.lit(0.0)) / len(precisions)
    brevity = F.when(F.col("can_1") > F.col("ref_1"), 1.0).otherwise(
        F.exp(1 - F.try_divide(F.col("ref_1"), F.col("can_1")))
    )
    positive = F.lit(True)
    for p in precisions:
        positive = positive & (F.coalesce(p, F.lit(0.0)) > 0)
    return F.when(positive, F.exp(log_mean) * brevity).otherwise(0.0)


def bleu(pairs: DataFrame, reference: str = "target", candidate: str = "generated", key: str = "id") -> DataFrame:
    """Sentence BLEU with orders 1 to 4, one reference and no smoothing."""
    counts = ngram_overlap(pairs, ng.bleu_tokens(F.col(reference)), ng.bleu_tokens(F.col(candidate)), 4, key)
    precisions = [F.try_divide(F.col(f"match_{n}"), F.col(f"can_{n}")) for n in range(1, 5)]
    return counts.select(key, _bleu(precisions).alias("bleu"))


def weighted_bleu(pairs: DataFrame, reference: str = "target", candidate: str = "generated", key: str = "id") -> DataFrame:
    """BLEU over blank-separated tokens: with query keywords weighing five times other words, and ``plain_bleu`` without."""

    def weight(gram: Column) -> Column:
        return F.when(F.upper(gram).isin(QUERY_KEYWORDS), 1.0).otherwise(OTHER_WORD_WEIGHT)

    counts = ngram_overlap(
        pairs, ng.plain_tokens(F.col(reference)), ng.plain_tokens(F.col(candidate)), 4, key, weight
    )
    every = [F.try_divide(F.col(f"match_{n}"), F.col(f"can_{n}")) for n in range(1, 5)]
    keyword = F.try_divide(F.col("weighted_match_1"), F.col("weight_1"))
    return counts.select(key, _bleu([keyword, *every[1:]]).alias("weighted_bleu"), _bleu(every).alias("plain_bleu"))


def rouge_n(pairs: DataFrame, reference: str = "target", candidate: str = "generated", key: str = "id") -> DataFrame:
    """ROUGE-1 and ROUGE-2 F-measures."""
    counts = ngram_overlap(pairs, ng.rouge_tokens(F.col(reference)), ng.rouge_tokens(F.col(candidate)), 2, key)

    def f_measure(n: int) -> Column:
        p = F.try_divide(F.col(f"match_{n}"), F.col(f"can_{n}"))
        r = F.try_divide(F.col(f"match_{n}"), F.col(f"ref_{n}"))
        return F.coalesce(F.try_divide(2 * p * r, p + r), F.lit(0.0))

    return counts.select(key, f_measure(1).alias("rouge1"), f_measure(2).alias("rouge2"))


def rouge_lcs(pairs: DataFrame, reference: str = "target", candidate: str = "generated", key: str = "id") -> DataFrame:
    """ROUGE-L and ROUGE-Lsum; a narrow step, in Arrow batches. Null texts count as empty."""
    both = rouge_l(*[ng.rouge_sentences(F.coalesce(F.col(c), F.lit(""))) for c in (reference, candidate)])
    return pairs.select(key, both.alias("_r")).select(key, "_r.*")


# --- label agreement ---------------------------------------------------------------------------

def exact_match(pairs: DataFrame, reference: str = "target", candidate: str = "generated") -> DataFrame:
    return pairs.agg(F.avg((F.col(reference) == F.col(candidate)).cast("double")).alias("exact_match"))


def macro_f1(pairs: DataFrame, reference: str = "target", candidate: str = "generated") -> DataFrame:
    """Mean over all labels seen on either side of 2tp/(2tp+fp+fn)."""
    same = (F.col(reference) == F.col(candidate)).cast("int")
    sides = F.array(
        F.struct(F.col(reference).alias("label"), same.alias("tp"), (1 - same).alias("fn"), F.lit(0).alias("fp")),
        F.struct(F.col(candidate).alias("label"), F.lit(0).alias("tp"), F.lit(0).alias("fn"), (1 - same).alias("fp")),
    )
    per_label = (
        pairs.select(F.inline(sides))
        .groupBy("label")
        .agg(F.sum("tp").alias("tp"), F.sum("fn").alias("fn"), F.sum("fp").alias("fp"))
    )
    twice = 2 * F.col("tp")
    f1 = F.coalesce(F.try_divide(twice, twice + F.col("fp") + F.col("fn")), F.lit(0.0))
    return per_label.agg(F.avg(f1).alias("f1"))


# --- value-set overlap -------------------------------------------------------------------------

def set_scores(members: DataFrame, key: list[str], value: str, side: str) -> DataFrame:
    """Overlap, Jaccard and Dice of the two value sets of each key; ``side`` is 'left' or 'right'.

    Repeats fold on the map side of the first grouping, and the second one adds up partial counts,
    so a key with a third of all rows is never held by one task. Nulls are no members.
    """
    distinct = (
        members.where(F.col(value).isNotNull())
        .groupBy(*key, value)
        .agg(F.max(F.col(side) == "left").alias("l"), F.max(F.col(side) == "right").alias("r"))
    )
    sizes = distinct.groupBy(*key).agg(
        F.count_if(F.col("l") & F.col("r")).alias("both"),
        F.count_if("l").alias("left_size"),
        F.count_if("r").alias("right_size"),
    )
    return sizes.select(*key, "both", "left_size", "right_size", *set_ratios(F.col("both"), F.col("left_size"), F.col("right_size")))


def set_ratios(both: Column, left: Column, right: Column) -> list[Column]:
    """Overlap, Jaccard and Dice from the sizes of two sets and of what they share."""
    zero = F.lit(0.0)
    return [
        F.coalesce(F.try_divide(both, F.least(left, right)), zero).alias("overlap"),
        F.coalesce(F.try_divide(both, left + right - both), zero).alias("jaccard"),
        F.coalesce(F.try_divide(2 * both, left + right), zero).alias("dice"),
    ]


def table_scores(left: DataFrame, right: DataFrame, matches: DataFrame, tables: DataFrame, key: str = "id") -> DataFrame:
    """Mean set scores over the matched columns of each result-table pair.

    ``left``/``right``: (key, column, value); ``matches``: (key, left_column, right_column);
    ``tables``: (key, has_rows) lists every pair. Pairs whose left table has no rows score 0;
    pairs without matched columns score null.
    """

    def members(values: DataFrame, side: str) -> DataFrame:
        wanted = matches.withColumn("column", F.col(f"{side}_column"))
        return values.join(wanted, [key, "column"]).select(
            key, "left_column", "right_column", "value", F.lit(side).alias("side")
        )

    scored = set_scores(
        members(left, "left").unionByName(members(right, "right")),
        [key, "left_column", "right_column"], "value", "side",
    )
    # Matched columns without any value on either side are absent from the scores and count as 0.
    all_matched = matches.join(scored, [key, "left_column", "right_column"], "left")
    means = all_matched.groupBy(key).agg(*[F.avg(F.coalesce(n, F.lit(0.0))).alias(n) for n in SCORES])
    return tables.join(means, key, "left").select(
        key, *[F.when(F.col("has_rows"), F.col(n)).otherwise(0.0).alias(n) for n in SCORES]
    )


SCORES = ["overlap", "jaccard", "dice"]
OUTCOMES = ["ok", "no_bindings", "bad_syntax", "server_error", "timeout"]


def outcome_scores(rows: DataFrame) -> DataFrame:
    """Scores by execution outcome of the generated query.

    ``ok`` keeps the table scores; ``bad_syntax`` scores 0 throughout; ``server_error`` scores 1 if the
    target has no rows and 0 otherwise; ``timeout`` and ``no_bindings`` score 0; each of these but bad
    syntax counts as valid syntax. Rows with another outcome are left out (see :func:`unscored`).
    """
    outcome = F.col("outcome")

    def score(name: str) -> Column:
        return (
            F.when(outcome == "ok", F.col(name))
            .when(outcome == "server_error", F.when(F.col("target_rows") == 0, 1.0).otherwise(0.0))
            .otherwise(0.0)
        )

    kept = rows.where(outcome.isin(OUTCOMES))
    return kept.withColumns(
        {**{n: score(n) for n in SCORES}, "syntax": F.when(outcome == "bad_syntax", 0.0).otherwise(1.0)}
    )


def unscored(rows: DataFrame) -> DataFrame:
    return rows.where(~F.coalesce(F.col("outcome").isin(OUTCOMES), F.lit(False)))


def training_outcome_scores(rows: DataFrame) -> DataFrame:
    """The variant used while training: no row is left out.

    Failures other than bad syntax score 0 and have null syntax; a target that cannot be read has valid
    syntax and null scores. Means skip nulls, so each score keeps its own denominator.
    """
    outcome = F.col("outcome")

    def score(name: str) -> Column:
        return F.when(outcome == "ok", F.col(name)).when(outcome != "unreadable_target", 0.0)

    syntax = F.when(outcome.isin("ok", "no_bindings", "unreadable_target"), 1.0).when(outcome == "bad_syntax", 0.0)
    return rows.withColumns({**{n: score(n) for n in SCORES}, "syntax": syntax})


# --- reports -----------------------------------------------------------------------------------

def column_means(rows: DataFrame, columns: list[str], by: list[str] | None = None) -> DataFrame:
    """Column means that skip null and NaN."""
    return rows.groupBy(*(by or [])).agg(
        *[F.avg(F.nullif(F.col(c).cast("double"), F.lit(float("nan")))).alias(c) for c in columns]
    )


def error_map(errors: DataFrame, message: str = "message", row: str = "id", part_rows: int = 10000) -> DataFrame:
    """Row numbers per message, in parts of at most ``part_rows`` consecutive row numbers.

    One message may hold most rows, so a message is a run of bounded lists and not one list; ``n`` is
    the count in the part.
    """
    return (
        errors.withColumn("part", F.floor(F.col(row) / part_rows))
        .groupBy(message, "part")
        .agg(F.sort_array(F.collect_list(row)).alias("rows"), F.count("*").alias("n"))
    )


def error_counts(errors: DataFrame, message: str = "message") -> DataFrame:
    return errors.groupBy(message).agg(F.count("*").alias("n_errors"))


def score_grid(rows: DataFrame, model: str, annotated: str, metrics: list[str]) -> DataFrame:
    """One row per model with a column per (metric, annotated)."""
    cells = [F.avg(m).alias(m) for m in metrics]
    wide = rows.groupBy(model).pivot(annotated, [False, True])
    out = wide.agg(*cells)
    if len(metrics) == 1:
        return out.toDF(model, *[f"{flag}_{metrics[0]}" for flag in ("false", "true")])
    return out


def sampled_rows(rows: DataFrame, n: int = 5, seed: int = 0, key: str = "id") -> DataFrame:
    """n rows by hash of (key, seed)."""
    return rows.orderBy(draw(seed, key), key).limit(n)


def snippet(rows: DataFrame, columns: list[str], numbers: list[str], n: int = 5, order: str = "id") -> DataFrame:
    """The first n rows for display, numbers rounded to significant digits."""
    return rows.orderBy(order).limit(n).select(
        order, *[round_significant(F.col(c)).alias(c) if c in numbers else F.col(c) for c in columns]
    )
