"""Plans hold what large tables need: early limits, few shuffles, narrow reads, no row-wise Python."""

import re

import pytest
from pyspark.sql import functions as F

from pairforge import bindings
from pairforge.bindings.inputs import table, turn_pairs
from pairforge.operators import annotate as an
from pairforge.operators import clean as cl
from pairforge.operators import extract as ex
from pairforge.operators import profile as pf
from pairforge.operators import scoring as sc

SF = "/root/testdata/sf0.001"
bindings.load_all()


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_no_row_wise_python_and_no_cross_join(spark):
    for name, build in bindings.QUERIES.items():
        if name.startswith(("X18", "S")):
            continue  # trains models or writes files while building
        text = plan(build(spark, SF))
        assert "BatchEvalPython" not in text, name
        assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text, name


def exchanged(df):
    """The columns that each exchange of the plan moves."""
    text = df._jdf.queryExecution().explainString(df._sc._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    return re.findall(r"\) Exchange\s*\nInput \[\d+\]: \[([^\]]*)\]", text)


def test_top_k_is_cut_before_the_shuffle(spark):
    text = plan(bindings.QUERIES["D8_D9_cosine_top_k"](spark, SF))
    assert text.count("WindowGroupLimit") == 4  # two merges, each cut before its shuffle
    assert not any("vector" in moved for moved in exchanged(bindings.QUERIES["D8_D9_cosine_top_k"](spark, SF)))


def test_only_ids_look_for_labels(spark):
    queries = spark.sql("SELECT 1 AS id, 'wd:Q1 [entity:x]' AS query")
    labels = spark.sql("SELECT 'Q1' AS id, 'entity' AS kind, 'en' AS lang, 'x' AS label")
    for build in (an.annotate_ids, an.readable_ids, an.resolve_annotations):
        moved = exchanged(build(queries.repartition(2), labels))
        assert sum("query" in columns for columns in moved) <= 2, moved  # the test's own and one to the map of labels
        assert any("_item" in columns for columns in moved)
        assert not any("query" in columns and "_item" in columns for columns in moved)


def test_sampled_embeddings_are_cut_before_the_shuffle(spark):
    cells = table(spark, SF, "embeddings").selectExpr("'t' AS `table`", "'c' || label AS `column`", "vec_id AS id", "embedding")
    assert plan(pf.column_embeddings(cells, sample=20)).count("WindowGroupLimit") == 2


def test_no_cell_text_crosses_the_network(spark):
    cells = spark.createDataFrame([("t", "a", "1"), ("t", "b", "x y")], "table string, column string, value string")
    profiles = pf.column_profiles(cells)
    for exchange in re.findall(r"Exchange hashpartitioning[^\n]*", plan(profiles)):
        assert "value" not in exchange
    assert {r["column"]: (r["num_unique"], r["digit_mean"] > 0) for r in profiles.collect()} == {"a": (1.0, False), "b": (-1.0, True)}


def test_ngrams_do_not_cross_the_network(spark):
    pairs = spark.createDataFrame([(1, "a", "b")], "id int, target string, generated string")
    for scores in (sc.bleu(pairs), sc.rouge_n(pairs), sc.weighted_bleu(pairs)):
        assert "Exchange" not in plan(scores)


def test_page_extraction_is_narrow(spark):
    pages = table(spark, SF, "documents").selectExpr("doc_id AS page_id", "text")
    for rows in (ex.template_queries(pages), ex.sections(pages), ex.queries_per_page(pages)):
        assert "Exchange" not in plan(rows)


def test_scans_read_only_what_is_used(spark):
    text = plan(cl.shorter_than(table(spark, SF, "documents"), "text", 300).select("doc_id"))
    assert re.search(r"ReadSchema: struct<doc_id:bigint,text:string>", text)
    pushed = plan(table(spark, SF, "documents").where(F.col("source").isin("src0", "src1")).select("doc_id"))
    assert "PushedFilters: [In(source" in pushed


@pytest.mark.parametrize("name", ["M8_overlap", "R11_tag_counts", "L8_upserted"])
def test_aggregates_fold_on_the_map_side(spark, name):
    text = plan(bindings.QUERIES[name](spark, SF))
    assert re.search(r"(Hash|Sort|ObjectHash)Aggregate.*partial_", text)


def test_only_contexts_know_the_path_of_a_section(spark):
    from pairforge.operators import extract as ex

    pages = spark.createDataFrame([(1, "== a ==")], "page_id bigint, text string")
    plan = lambda frame: frame._jdf.queryExecution().optimizedPlan().toString()
    for rows in (ex.outline(pages), ex.residuals(pages), ex.template_rows(pages), ex.malformed_sections(pages)):
        assert "_parents" not in plan(rows) and "path" not in plan(rows)
    assert "_parents" in plan(ex.template_queries(pages))


def test_a_page_of_many_headings_is_one_pass(spark):
    import time

    from pairforge.operators import extract as ex

    def took(n):
        text = "\n".join(f"{'=' * (2 + i % 5)} H{i} {'=' * (2 + i % 5)}\ntext {i} {{{{SPARQL|query=#a: b\nSELECT {i}}}}}" for i in range(n))
        pages = spark.createDataFrame([(1, text)], "page_id bigint, text string")
        began = time.time()
        assert ex.template_queries(pages).count() == n and ex.ancestry(pages).count() == n
        return time.time() - began

    took(10)
    assert took(20_000) < 12 * max(took(4_000), 1)
