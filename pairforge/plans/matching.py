"""Column matching as two jobs: train members and store them, then match columns with stored members."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairforge.operators import match
from pairforge.session import pinned


def features(pairs: DataFrame, name_vectors: DataFrame, embeddings: DataFrame) -> DataFrame:
    """All features of profiled column pairs (``match.column_pairs``); other columns, such as ``label``, go along.

    ``name_vectors(name, embedding)`` by normalised name, ``embeddings(table, column, embedding)`` of text columns.
    """
    rows = match.instance_similarity(match.name_features(match.profile_differences(pairs), name_vectors), embeddings)
    return rows.drop("left", "right")


def training_rows(labelled: DataFrame, per_positive: int = 9, seed: int = 200) -> DataFrame:
    """Labelled features with their share of negatives, and every fifth pair again with its names hidden."""
    return match.masked_copies(match.balanced_overall(labelled, per_positive, seed))


def train(spark: SparkSession, labelled: DataFrame, path: str, trees: int = 2, linear: bool = True, seed: int = 0) -> None:
    """Trains members on ``labelled`` features and stores them under ``path``.

    Each tree member leaves a share of the pairs out and takes its threshold from them; a logistic member
    sees all of them. The training rows are schema-sized and stored once, since every member reads them.
    """
    rows = pinned(training_rows(labelled))
    models = match.train_matchers(rows, trees, seed)
    members = [match.Member(0.5, trees=model) for model in models]
    members = [
        match.Member(_threshold(member, match.left_out(rows.where("NOT masked"), m, trees, seed)), trees=member.trees)
        for m, member in enumerate(members)
    ]
    if linear:
        member = match.Member(0.5, weights=match.linear_weights(rows))
        members.append(match.Member(_threshold(member, rows.where("NOT masked")), weights=member.weights))
    match.save_members(spark, members, path)


def _threshold(member: match.Member, rows: DataFrame) -> float:
    return match.best_threshold(member.scored(rows).join(rows.select(*match.PAIR, "label"), match.PAIR))


def matched(spark: SparkSession, pairs: DataFrame, path: str, strategy: str = "one-to-one", threshold: float | None = None) -> DataFrame:
    """(PAIR, score, label, predicted) of every pair of features by the stored members; ``predicted`` by the strategy."""
    scores = pinned(match.combined(match.said(pairs, match.load_members(spark, path), threshold)))
    chosen = match.selected(scores, strategy).select(*match.PAIR, F.lit(1).alias("predicted"))
    return scores.join(chosen, match.PAIR, "left").withColumn("predicted", F.coalesce("predicted", F.lit(0)))
