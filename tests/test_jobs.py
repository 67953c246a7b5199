"""The end-to-end jobs on small tables."""

from pairforge.operators import retrieve as rt
from pairforge.plans import corpus, evaluation, training
from pyspark.sql import functions as F

PAGE = "== A ==\n{{SPARQL|query=\n# title: héllo\nPREFIX x: <y>\nselect ?x { ?x wdt:P31 wd:Q5 } LIMIT 3\n}}\n[https://query.wikidata.org/#SELECT%20%3Fy t]"


def test_corpus(spark):
    pages = spark.createDataFrame([(1, PAGE), (2, PAGE)], "page_id bigint, text string")
    redirects = spark.createDataFrame([], "short_url string, target string")
    labels = spark.createDataFrame([("Q5", "en", "human")], "id string, lang string, label string")
    table = corpus.query_corpus(pages, redirects)
    rows = corpus.annotated_corpus(table, labels).orderBy("id").collect()
    assert [r["id"] for r in rows] == [0, 1, 2, 3]
    assert {r["query"] for r in rows} == {"SELECT ?y", "SELECT ?x { ?x wdt:P31 wd:Q5 } LIMIT 3"}
    assert {r["description"] for r in rows} == {"hello", "t"}
    marked = [r["query_annotated"] for r in rows if "LIMIT" in r["query"]]
    assert all(m.endswith("SELECT ?x { ?x wdt:[property:P31] wd:[entity:human] } LIMIT 3") for m in marked)
    profile = corpus.corpus_profile(table).first()
    assert (profile["n_queries"], profile["n_limited"]) == (4, 2)


def _rows(spark):
    data = [(i, [f"ask {i}", f"tell {i}"], f"SELECT {i}", f"SELECT [{i}]") for i in range(6)]
    return spark.createDataFrame(data, "id bigint, instructions array<string>, sparql_query string, sparql_annotated string")


def test_training_text(spark):
    rows = training.training_text(_rows(spark), "mistral", samples=2, seed=3).collect()
    assert len(rows) == 12
    for r in rows:
        assert f"[QUERY]\nSELECT {r['id']}\n[/QUERY]</s>" in r["text"] and r["text"].startswith("<s>[INST] You are")


def test_evaluation_prompts(spark):
    rows = _rows(spark)
    vector = F.array(F.cos("id"), F.sin("id"))
    asked = rows.where("id < 2").select(F.col("id").alias("query_id"), vector.alias("vector"))
    base = rows.where("id >= 2").select(F.col("id").alias("base_id"), vector.alias("vector"))
    got = training.evaluation_prompts(rows.where("id < 2"), rows, rt.cosine_top_k(asked, base, 3), "phi3", 1).collect()
    assert len(got) == 2
    nearest = {0: 5, 1: 2}
    for r in got:
        assert f"Examples:\n- User: ask {nearest[r['id']]}\nAnswer" in r["prompt"] and r["prompt"].endswith("<|assistant|>\n")


def test_report(spark):
    rows = spark.createDataFrame(
        [(1, "a b c d e", "[QUERY]a b c d e[/QUERY]"), (2, "a b c d", "no tags")], "id bigint, target string, raw string"
    )
    means = evaluation.report(evaluation.text_scores(rows)).first().asDict()
    assert set(means) == set(evaluation.TEXT_SCORES) and set(means.values()) == {0.5}


def test_execution_scores_of_odd_results(spark):
    hit = '[{"x": {"type": "uri", "value": "a"}}]'
    rows = [(1, "ok", hit, hit), (2, "ok", None, hit), (3, "server_error", "no json", None), (4, "other", hit, hit), (5, "ok", hit, "[]"),
            (6, "bad_syntax", hit, None), (7, None, hit, hit)]
    results = spark.createDataFrame(rows, "id bigint, outcome string, target string, generated string")
    got = {r["id"]: (r["dice"], r["syntax"]) for r in evaluation.execution_scores(results).collect()}
    assert got == {1: (1.0, 1.0), 2: (0.0, 1.0), 3: (1.0, 1.0), 5: (None, 1.0), 6: (0.0, 0.0)}
    assert evaluation.execution_scores(results.limit(0)).count() == 0


def test_execution_scores_deal_the_results_out_once(spark):
    hit, more = '[{"x": {"type": "uri", "value": "a"}}, {"x": {"type": "uri", "value": "--"}}]', '[{"x": {"type": "uri", "value": "b"}}]'
    rows = [(1, "ok", hit, more), (1, "ok", None, hit), (None, "ok", hit, hit), (2, "ok", hit, '[{"y": {"type": "uri", "value": "a"}}]')]
    results = spark.createDataFrame(rows, "id bigint, outcome string, target string, generated string")
    scores = evaluation.execution_scores(results)
    # Two reads of the source move, with whole results; no cell does, and no join deals anything anew.
    text = scores._jdf.queryExecution().executedPlan().toString()
    assert text.count("Exchange hashpartitioning(id#") == text.count("Exchange") == 2
    # Results of one id are one: type {uri} and {uri}, value {a, --} and {b, a, --}; each outcome meets each target.
    got = sorted((r["id"], round(r["overlap"], 6), round(r["jaccard"], 6)) for r in scores.collect())
    assert got == [(1, 0.0, 0.0), (1, 0.0, 0.0), (1, 1.0, 0.833333), (1, 1.0, 0.833333), (2, 1.0, 0.75)]
