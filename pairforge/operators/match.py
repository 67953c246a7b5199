"""Column matching over many table pairs at once.

A row is one pair of columns. Column rows are schema-sized (one per column of a table), and pairs are
formed by equal joins through a list of table pairs, never by a cross join.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pairforge.functions import similarity as sim
from pairforge.functions.sampling import draw
from pairforge.functions.text import strip_all
from pairforge.operators.profile import FEATURES, TYPES
from pairforge.session import pinned

PAIR = ["left_table", "right_table", "left_column", "right_column"]
TABLES = PAIR[:2]
DIFFS = [f"diff_{f}" for f in FEATURES]
NAMES = ["name_bleu", "name_edits", "name_lcs", "name_cosine", "name_contained"]
PAIR_FEATURES = [*DIFFS, *NAMES, "instance_cosine"]
# Name features of a pair whose names are hidden.
MASKED_NAMES = [0.0, 12.0, 0.0, 0.2, 0.0]


def column_pairs(profiles: DataFrame, table_pairs: DataFrame) -> DataFrame:
    """Every column of the left with every column of the right table of each listed table pair.

    Profiles are one small row per column but cost a scan of all values, and both sides need them, so
    they are computed once and pinned.
    """
    profiles = pinned(profiles)

    def side(name: str) -> DataFrame:
        rest = [c for c in profiles.columns if c not in ("table", "column")]
        return profiles.select(
            F.col("table").alias(f"{name}_table"), F.col("column").alias(f"{name}_column"), F.struct(*rest).alias(name)
        )

    return table_pairs.select(*TABLES).join(side("left"), "left_table").join(side("right"), "right_table")


def normalised_name(name: Column) -> Column:
    """Lower case, with white space, underscores and points as blanks."""
    return strip_all(F.regexp_replace(F.lower(name), r"[\s_.]", " "))


def gold_labels(pairs: DataFrame, mapping: DataFrame) -> DataFrame:
    """Label 1 for pairs of names listed in ``mapping(a, b)`` in either order."""

    def ordered(a: str, b: str) -> list[Column]:
        return [F.least(a, b).alias("_a"), F.greatest(a, b).alias("_b")]

    listed = mapping.select(*ordered("a", "b")).distinct().withColumn("_hit", F.lit(1))
    named = pairs.select("*", *ordered("left_column", "right_column"))
    return (
        named.join(listed, ["_a", "_b"], "left")
        .withColumn("label", F.coalesce("_hit", F.lit(0)))
        .drop("_a", "_b", "_hit")
    )


def balanced(labelled: DataFrame, per_positive: int = 9, seed: int = 200) -> DataFrame:
    """All positives and, per table pair, at most ``per_positive`` negatives for each of them, by hash."""
    tables = Window.partitionBy(*TABLES)
    by_hash = Window.partitionBy(*TABLES, "label").orderBy(draw(seed, *PAIR), *PAIR)
    return (
        labelled.withColumns({"_positives": F.sum("label").over(tables), "_rank": F.row_number().over(by_hash)})
        .where((F.col("label") == 1) | (F.col("_rank") <= per_positive * F.col("_positives")))
        .drop("_positives", "_rank")
    )


def balanced_overall(labelled: DataFrame, per_positive: int = 9, seed: int = 200) -> DataFrame:
    """All positives and a share of all negatives, by hash, so that a tenth is positive whatever one table pair holds.

    The share is ``per_positive`` times the positives over the negatives, one number for all table pairs:
    pairs of tables without a positive keep their share of the negatives. Without any positive nothing is left out.
    """
    positives, negatives = F.sum("label"), F.count_if(F.col("label") == 0)
    share = labelled.agg(F.when(positives > 0, per_positive * positives / negatives).otherwise(1.0))
    return labelled.where((F.col("label") == 1) | (draw(seed, *PAIR) < share.scalar() * 2.0**60))


def profile_differences(pairs: DataFrame) -> DataFrame:
    """|a-b| / (a+b+1e-8) for each profile feature."""

    def diff(f: str) -> Column:
        a, b = F.col(f"left.{f}"), F.col(f"right.{f}")
        return F.coalesce(F.try_divide(F.abs(a - b), a + b + 1e-8), F.lit(0.0)).alias(f"diff_{f}")

    return pairs.select("*", *[diff(f) for f in FEATURES])


def name_features(pairs: DataFrame, name_vectors: DataFrame | None = None) -> DataFrame:
    """Character BLEU, Damerau and LCS distance, embedding cosine and containment of the names.

    ``name_vectors(name, embedding)`` holds an embedding per normalised name; without it the cosine is 0.
    """
    named = pairs.withColumns(
        {"_left": normalised_name(F.col("left_column")), "_right": normalised_name(F.col("right_column"))}
    )
    cosine = F.lit(0.0)
    if name_vectors is not None:
        for side in ("left", "right"):
            own = name_vectors.select(F.col("name").alias(f"_{side}"), F.col("embedding").alias(f"_{side}_vector"))
            named = named.join(own, f"_{side}", "left")
        cosine = F.coalesce(sim.cosine(F.col("_left_vector"), F.col("_right_vector")), F.lit(0.0))
    out = named.withColumns(
        {
            "_names": sim.name_distances("_left", "_right"),
            "name_cosine": cosine,
            "name_contained": sim.containment(F.col("_left"), F.col("_right")).cast("double"),
        }
    )
    return out.select("*", "_names.*").drop("_names", "_left", "_right", "_left_vector", "_right_vector")


def instance_similarity(pairs: DataFrame, embeddings: DataFrame, constant: float | None = -999.0) -> DataFrame:
    """Cosine of the two column embeddings.

    Columns without one are columns that hold no text: they all have the same vector, ``constant`` in every
    place, so that two of them are alike (1) and one of them is compared with the other's direction. With
    ``constant=None`` a missing vector gives 0.
    """
    for side in ("left", "right"):
        own = embeddings.select(
            F.col("table").alias(f"{side}_table"), F.col("column").alias(f"{side}_column"),
            F.col("embedding").alias(f"_{side}"),
        )
        pairs = pairs.join(own, [f"{side}_table", f"{side}_column"], "left")
    left, right = F.col("_left"), F.col("_right")
    cosine = sim.cosine(left, right)
    if constant is not None:
        one = F.coalesce(left, right)
        total = F.aggregate(one, F.lit(0.0), lambda acc, x: acc + x.cast("double"))
        against = F.try_divide(total, F.sqrt(sim.dot(one, one)) * F.sqrt(F.size(one))) * (1.0 if constant > 0 else -1.0)
        cosine = F.when(one.isNull(), 1.0).when(left.isNull() | right.isNull(), against).otherwise(cosine)
    return pairs.withColumn("instance_cosine", F.coalesce(cosine, F.lit(0.0))).drop("_left", "_right")


def masked_copies(pairs: DataFrame, every: int = 5) -> DataFrame:
    """Training pairs plus every fifth one again with its name features hidden."""
    place = Window.partitionBy(*TABLES).orderBy("left_column", "right_column")
    numbered = pairs.withColumn("_place", F.row_number().over(place) - 1)
    hidden = numbered.where(F.col("_place") % every == 0).withColumns(
        {n: F.lit(v) for n, v in zip(NAMES, MASKED_NAMES)}
    )
    return pairs.withColumn("masked", F.lit(False)).unionByName(hidden.drop("_place").withColumn("masked", F.lit(True)))


def rule_score(pairs: DataFrame) -> DataFrame:
    """A score without a model: half name similarity, half agreement of the column types."""
    names = [normalised_name(F.col(f"{side}_column")) for side in ("left", "right")]
    return pairs.withColumn("score", rule_score_of(*names, F.col("left"), F.col("right")))


def rule_score_of(left_name: Column, right_name: Column, left: Column, right: Column) -> Column:
    """The score of :func:`rule_score` from normalised names and structs with the type indicators."""
    name = 1 - F.levenshtein(left_name, right_name) / F.greatest(F.length(left_name), F.length(right_name))
    gaps = sum((F.abs(left[f"is_{t}"] - right[f"is_{t}"]) for t in TYPES), F.lit(0.0))
    return 0.5 * name + 0.5 * (1 - gaps / 2)


# --- classifier ----------------------------------------------------------------------------------

def _fold(members: int, seed: int) -> Column:
    return F.pmod(F.xxhash64(*PAIR, F.lit(seed)), F.lit(members + 1))


def train_matchers(labelled: DataFrame, members: int = 2, seed: int = 0, rounds: int = 5) -> list[PipelineModel]:
    """One boosted-tree model per member, each on its own hash share of the pairs left out."""
    models = []
    for m in range(members):
        stages = [
            VectorAssembler(inputCols=PAIR_FEATURES, outputCol="features", handleInvalid="keep"),
            GBTClassifier(featuresCol="features", labelCol="label", maxIter=rounds, maxDepth=3, seed=seed + m),
        ]
        models.append(Pipeline(stages=stages).fit(labelled.where(_fold(members, seed) != m)))
    return models


def left_out(labelled: DataFrame, member: int, members: int, seed: int = 0) -> DataFrame:
    """The pairs that a member of :func:`train_matchers` has not seen."""
    return labelled.where(_fold(members, seed) == member)


def linear_weights(labelled: DataFrame, penalty: float = 0.01) -> dict[str, float]:
    """Weights of a logistic member by feature, its constant under the empty name."""
    assembled = VectorAssembler(inputCols=PAIR_FEATURES, outputCol="features", handleInvalid="keep").transform(labelled)
    model = LogisticRegression(featuresCol="features", labelCol="label", regParam=penalty).fit(assembled)
    return {**dict(zip(PAIR_FEATURES, map(float, model.coefficients), strict=True)), "": float(model.intercept)}


@dataclass(frozen=True)
class Member:
    """A stored member: boosted trees, or the weights of a logistic score, and the score above which it says yes."""

    threshold: float
    trees: PipelineModel | None = None
    weights: dict[str, float] | None = None

    def scored(self, pairs: DataFrame) -> DataFrame:
        """PAIR and ``score``. A logistic member is one expression; features it does not name count nothing."""
        if self.trees is not None:
            return self.trees.transform(pairs).select(*PAIR, F.get(vector_to_array("probability"), F.lit(1)).alias("score"))
        terms = [F.col(f) * F.lit(w) for f, w in sorted(self.weights.items()) if f and w]
        total = reduce(lambda a, b: a + b, terms, F.lit(self.weights.get("", 0.0)))
        return pairs.select(*PAIR, (1 / (1 + F.exp(-total))).alias("score"))


def best_threshold(scored: DataFrame, bins: int = 1000, default: float = 0.5) -> float:
    """The threshold of best F1 of ``scored(score, label)``, in steps of 1/``bins``; the lowest among equals."""
    bin_ = F.floor(F.col("score") * bins).cast("int").alias("bin")
    counts = scored.groupBy(bin_).agg(F.sum("label").alias("p"), F.count(F.lit(1)).alias("n"))
    above = Window.orderBy(F.desc("bin"))  # at most bins + 1 rows
    upto = counts.select("bin", F.sum("p").over(above).alias("tp"), F.sum("n").over(above).alias("said"), F.sum("p").over(Window.partitionBy()).alias("all"))
    rated = upto.select("bin", F.try_divide(2.0 * F.col("tp"), F.col("said") + F.col("all")).alias("f1"))
    best = rated.where("f1 > 0").orderBy(F.desc("f1"), "bin").first()
    return default if best is None else max(0.0, best["bin"] / bins - 1e-9)


def save_members(spark: SparkSession, members: list[Member], path: str) -> None:
    """A folder with a saved pipeline per tree member, and tables of thresholds and weights."""
    kinds = [(m, member.threshold, member.trees is not None) for m, member in enumerate(members)]
    weights = [(m, f, w) for m, member in enumerate(members) for f, w in (member.weights or {}).items()]
    for m, member in enumerate(members):
        if member.trees is not None:
            member.trees.write().overwrite().save(f"{path}/trees/{m}")
    spark.createDataFrame(weights, "member int, feature string, weight double").write.mode("overwrite").parquet(f"{path}/weights")
    spark.createDataFrame(kinds, "member int, threshold double, trees boolean").write.mode("overwrite").parquet(f"{path}/members")


def load_members(spark: SparkSession, path: str) -> list[Member]:
    """The members of a folder, in order. What is read is a row per member and feature."""
    weights: dict[int, dict[str, float]] = {}
    for m, feature, weight in spark.read.parquet(f"{path}/weights").collect():
        weights.setdefault(m, {})[feature] = weight
    rows = spark.read.parquet(f"{path}/members").orderBy("member").collect()
    return [
        Member(r["threshold"], PipelineModel.load(f"{path}/trees/{r['member']}") if r["trees"] else None, weights.get(r["member"]))
        for r in rows
    ]


def said(pairs: DataFrame, members: list[Member], threshold: float | None = None) -> DataFrame:
    """(PAIR, member, score, label) of every member; ``threshold`` overrides the stored ones."""
    rows = [
        m.scored(pairs).select(*PAIR, F.lit(i).alias("member"), "score", (F.col("score") > F.lit(m.threshold if threshold is None else threshold)).cast("int").alias("label"))
        for i, m in enumerate(members)
    ]
    return reduce(DataFrame.unionByName, rows)


def predicted(pairs: DataFrame, models: list[PipelineModel], threshold: float | list[float] = 0.5) -> DataFrame:
    """Score and label of every pair by every member: label 1 when the score exceeds the threshold."""
    limits = threshold if isinstance(threshold, list) else [threshold] * len(models)
    return said(pairs, [Member(limit, trees=model) for model, limit in zip(models, limits, strict=True)])


def combined(scores: DataFrame, pair: list[str] | None = None) -> DataFrame:
    """Mean score of the members, and 1 when more than half of them say so."""
    return scores.groupBy(*(pair or PAIR)).agg(
        F.avg("score").alias("score"), (F.avg("label") > 0.5).cast("int").alias("label")
    )


def selected(
    scores: DataFrame, strategy: str = "one-to-one", tables: list[str] | None = None,
    left: str = "left_column", right: str = "right_column",
) -> DataFrame:
    """Predicted pairs: all of them, the best of their row, or the best of row and column. Ties stay.

    The best score per row or column is a grouped maximum joined back, not a window, so a column with
    very many partners is folded on the map side and split by the adaptive join.
    """
    groups = TABLES if tables is None else tables
    out = scores.where(F.col("label") == 1)
    sides = {"many-to-many": [], "one-to-many": [left], "one-to-one": [left, right]}[strategy]
    for side in sides:
        best = scores.groupBy(*groups, side).agg(F.max("score").alias("_best"))
        out = out.join(best, [*groups, side]).where(F.col("score") == F.col("_best")).drop("_best")
    return out


def score_matrix(scores: DataFrame, right_columns: list[str], value: str = "score") -> DataFrame:
    """Left columns as rows, the named right columns as columns."""
    return scores.groupBy("left_column").pivot("right_column", right_columns).agg(F.max(value))


def evaluated(labelled: DataFrame, truth: str = "truth", label: str = "label") -> DataFrame:
    """Confusion counts with precision, recall and F1 of the positive class."""
    t, p = F.col(truth) == 1, F.col(label) == 1
    counts = labelled.agg(
        F.count_if(t & p).alias("tp"), F.count_if(~t & p).alias("fp"),
        F.count_if(t & ~p).alias("fn"), F.count_if(~t & ~p).alias("tn"),
    )
    zero = F.lit(0.0)
    precision = F.coalesce(F.try_divide(F.col("tp"), F.col("tp") + F.col("fp")), zero)
    recall = F.coalesce(F.try_divide(F.col("tp"), F.col("tp") + F.col("fn")), zero)
    f1 = F.coalesce(F.try_divide(2 * precision * recall, precision + recall), zero)
    return counts.select("*", precision.alias("precision"), recall.alias("recall"), f1.alias("f1"))
