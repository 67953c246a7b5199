"""The matcher's features, its stored members, and the two jobs around them."""

import math
import random

import pytest
from pyspark.sql import functions as F

from pairforge.operators import match as mt
from pairforge.plans import matching


@pytest.fixture(scope="module")
def rows(spark):
    """Pairs of three table pairs, the last without a positive; the label follows two of the features."""
    draw = random.Random(3)
    made = []
    for tables, n in ((("a", "b"), 12), (("c", "d"), 12), (("e", "f"), 10)):
        for i in range(n):
            for j in range(n):
                features = {f: draw.random() for f in mt.PAIR_FEATURES}
                label = int(i == j and tables[0] != "e")
                features["name_edits"] = float(draw.randrange(3) if label else draw.randrange(2, 12))
                features["instance_cosine"] = draw.uniform(0.6, 1) if label else draw.uniform(-0.5, 0.8)
                made.append((*tables, f"l{i}", f"r{j}", label, *[features[f] for f in mt.PAIR_FEATURES]))
    schema = ", ".join(f"{c} string" for c in mt.PAIR) + ", label int, " + ", ".join(f"{f} double" for f in mt.PAIR_FEATURES)
    return spark.createDataFrame(made, schema).cache()


def test_negatives_by_one_share(spark, rows):
    got = {tuple(r[:2]): (r["p"], r["n"]) for r in mt.balanced_overall(rows, 5).groupBy(*mt.TABLES).agg(F.sum("label").alias("p"), F.count_if(F.col("label") == 0).alias("n")).collect()}
    assert {k: v[0] for k, v in got.items()} == {("a", "b"): 12, ("c", "d"): 12, ("e", "f"): 0}
    assert got["e", "f"][1] > 0 and 80 < sum(v[1] for v in got.values()) < 160
    assert mt.balanced_overall(rows.where("label = 0")).count() == 364 and mt.balanced_overall(rows.limit(0)).count() == 0
    assert mt.balanced_overall(rows.where("label = 1")).count() == 24


def test_columns_without_text_are_alike(spark):
    pairs = spark.createDataFrame([("a", "b", x, y) for x in "ntz" for y in "ntz"], ", ".join(f"{c} string" for c in mt.PAIR))
    vectors = spark.createDataFrame([(t, c, v) for t in "ab" for c, v in (("t", [3.0, 4.0]), ("z", [0.0, 0.0]))], "table string, column string, embedding array<double>")
    got = {(r["left_column"], r["right_column"]): r["instance_cosine"] for r in mt.instance_similarity(pairs, vectors).collect()}
    assert got["n", "n"] == 1.0 and got["t", "t"] == pytest.approx(1.0) and got["n", "z"] == 0.0
    assert got["n", "t"] == got["t", "n"] == pytest.approx(-7 / (5 * math.sqrt(2)))
    none = mt.instance_similarity(pairs, vectors, constant=None).where("left_column = 'n'").select("instance_cosine").distinct().collect()
    assert [r[0] for r in none] == [0.0]


def test_stored_members_score_as_before(spark, rows, tmp_path):
    seen, unseen = rows.where("left_table <> 'c'"), rows.where("left_table = 'c'")
    kept = matching.training_rows(seen)
    members = [mt.Member(0.3, trees=m) for m in mt.train_matchers(kept, 2)] + [mt.Member(0.6, weights=mt.linear_weights(kept))]
    mt.save_members(spark, members, str(tmp_path / "m"))
    loaded = mt.load_members(spark, str(tmp_path / "m"))
    assert [(m.threshold, m.weights) for m in loaded] == [(m.threshold, m.weights) for m in members]
    order = lambda frame: sorted(map(tuple, frame.collect()))
    assert order(mt.said(unseen, loaded)) == order(mt.said(unseen, members))
    over = mt.said(unseen, loaded, threshold=2.0)
    assert over.agg(F.max("label")).first()[0] == 0


def test_linear_members_are_plain_arithmetic(rows):
    weights = {"": 0.5, "name_edits": -0.7, "instance_cosine": 2.0}
    for r in mt.Member(0.5, weights=weights).scored(rows).join(rows, mt.PAIR).limit(50).collect():
        assert r["score"] == pytest.approx(1 / (1 + math.exp(-(0.5 - 0.7 * r["name_edits"] + 2 * r["instance_cosine"]))))


def test_thresholds_by_f1(spark):
    scored = spark.createDataFrame([(0.9, 1), (0.8, 1), (0.7, 0), (0.6, 1), (0.2, 0), (0.1, 0)], "score double, label int")
    at = mt.best_threshold(scored)
    assert scored.where(F.col("score") > at).count() == 4
    assert mt.best_threshold(scored.where("label = 0")) == 0.5


def test_two_jobs(spark, rows, tmp_path):
    seen, unseen = rows.where("left_table <> 'c'"), rows.where("left_table = 'c'")
    matching.train(spark, seen, str(tmp_path / "m"))
    found = matching.matched(spark, unseen.drop("label"), str(tmp_path / "m"))
    rated = mt.evaluated(found.join(unseen.select(*mt.PAIR, F.col("label").alias("truth")), mt.PAIR), label="predicted").first()
    assert rated["f1"] > 0.6 and found.count() == 144


def test_no_feature_of_the_catalog_is_constant(spark):
    from pairforge.bindings import match as bound

    features = bound.pair_features(spark, "/root/testdata/sf0.001")
    kinds = features.agg(*[F.count_distinct(F.round(f, 9)).alias(f) for f in mt.PAIR_FEATURES]).first().asDict()
    constant = {f for f, n in kinds.items() if n < 2}
    assert not constant & {"name_bleu", "name_edits", "name_lcs", "name_cosine", "instance_cosine"}  # no name holds another one


def test_embeddings_of_the_catalog_read_the_stored_types(spark, monkeypatch):
    from pairforge.bindings import match as bindings

    read, every = [], bindings.catalog
    monkeypatch.setattr(bindings, "catalog", lambda *a: read.append(a) or every(*a))
    assert bindings.catalog_similarity(spark, "/root/testdata/sf0.001").count() > 0
    assert len(read) == 2  # once for the types, once for the values
    read.clear()
    bindings.pair_features(spark, "/root/testdata/sf0.001")
    assert len(read) == 2
