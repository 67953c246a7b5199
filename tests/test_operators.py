"""Operators on hand-made tables: hot keys, quirks and properties."""

import random
import statistics

import pytest
from pyspark.sql import functions as F

from pairforge.operators import annotate as an
from pairforge.operators import assemble as asm
from pairforge.operators import extract as ex
from pairforge.operators import match as mt
from pairforge.operators import ordered as od
from pairforge.operators import outcomes as oc
from pairforge.operators import profile as pf
from pairforge.operators import responses as rs
from pairforge.operators import scoring as sc
from pairforge.operators import tables as tb
from pairforge.sources import readers as rd
from pairforge.sources import writers as wr


# --- order over whole tables ---------------------------------------------------------------------

def test_dense_index_and_running_total(spark):
    rng = random.Random(2)
    ids = rng.sample(range(10**6), 500)
    frame = spark.createDataFrame([(i, i % 7) for i in ids], "id bigint, v bigint").repartition(5)
    got = {r["id"]: r["n"] for r in od.dense_index(frame, ["id"], "n", partitions=6).collect()}
    assert got == {x: n for n, x in enumerate(sorted(ids))}
    total, want = 0, {}
    for x in sorted(ids):
        total += x % 7
        want[x] = total
    assert {r["id"]: r["t"] for r in od.running_total(frame, ["id"], "v", "t", partitions=6).collect()} == want
    wide = frame.withColumn("text", F.concat(F.lit("t"), "id")).withColumn("id", F.expr("nullif(id, %d)" % min(ids)))
    rows = od.dense_index(wide, ["id"], "v", partitions=6).collect()  # a null key, and a name that is taken
    assert sorted((r["v"], r["text"]) for r in rows) == [(n, f"t{x}") for n, x in enumerate(sorted(ids))]
    totals = {r["text"]: r["v"] for r in od.running_total(wide, ["id"], "v", "v", partitions=6).collect()}
    assert totals == {f"t{x}": t for x, t in want.items()}


def test_order_pins_no_other_column(spark):
    wide = spark.range(20).withColumn("text", F.lit("x")).withColumn("v", F.lit(1))
    for made in (od.dense_index(wide, ["id"]), od.running_total(wide, ["id"], "v", "t")):
        plan = made._jdf.queryExecution().optimizedPlan().toString()
        stored = [line for line in plan.splitlines() if "LogicalRDD" in line]
        assert stored and not any("text" in line for line in stored)


@pytest.mark.parametrize("step", [1, 1_000_000])
def test_forward_fill_cuts_a_hot_key(spark, step):
    rng = random.Random(3)
    some = ["a", "b", None, None, None]
    rows = [(rng.choice([1, 1, 1, 1, 2, 3, None]), i * step, rng.choice(some), rng.choice(some), i) for i in range(600)]
    frame = spark.createDataFrame(rows, "k int, p bigint, v string, w string, x int").repartition(5)
    filled = od.forward_fill(frame, "k", "p", ["v", "w"], partitions=12)
    last, want = {}, {}
    for k, p, v, w, x in rows:
        before = last.get(k, (None, None))
        last[k] = (v or before[0], w or before[1])
        want[p] = (k, *last[k], x)
    assert filled.columns == frame.columns
    assert {r["p"]: (r["k"], r["v"], r["w"], r["x"]) for r in filled.collect()} == want
    cut = frame.repartitionByRange(12, "k", "p").where("k = 1").select(F.spark_partition_id()).distinct().count()
    assert cut > 4  # the hot key stands in several parts, however sparse


def test_incomplete_triples_go(spark):
    rows = [(1, 1, "s", "p", "o"), (1, 2, None, "q", "o"), (1, 3, None, None, "o2"), (1, 4, None, "r", None), (2, 1, None, "p", "o")]
    frame = spark.createDataFrame(rows, "query_id int, pos int, s string, p string, o string")
    order = lambda f: sorted(tuple(r) for r in f.collect())
    assert order(an.complete_triples(frame)) == [(1, 1, "s", "p", "o"), (1, 2, "s", "q", "o")]
    assert order(an.complete_triples(frame, fill=("s", "p"))) == [(1, 1, "s", "p", "o"), (1, 2, "s", "q", "o"), (1, 3, "s", "q", "o2")]


# --- page text ---------------------------------------------------------------------------------------

PAGE = """lost line
== A ==
a1
=== A1 ===
{{SPARQL|query=
#title: first
SELECT 1
}} tail
==== A11 ====
deep {{SPARQL2|query=SELECT 2}}{{SPARQL|query=SELECT 3}}
== B ==
SPARQL is named here"""


def test_extraction_keeps_the_tree(spark):
    pages = spark.createDataFrame([(1, PAGE), (2, "no heading"), (3, "")], "page_id bigint, text string")
    rows = {r["heading"]: r for r in ex.sections(pages).collect()}
    assert {h: [p["heading"] for p in r["path"]] for h, r in rows.items()} == {
        "A": ["A"], "A1": ["A", "A1"], "A11": ["A", "A1", "A11"], "B": ["B"],
    }
    queries = {r["query"]: r for r in ex.template_queries(pages).collect()}
    assert set(queries) == {"SELECT 1\n", "SELECT 2\n", "SELECT 3\n"}
    entry = queries["SELECT 1\n"]["metadata"][0]
    assert entry["description"] == "first" and entry["context"] == "\nA\na1\nA1\n tail"
    lost = {r["query"]: r["metadata"][0]["context"] for r in ex.template_queries(pages, keep_tail=False).collect()}
    assert lost["SELECT 2\n"] == "\nA\n\nA1\n\nA11\ndeep "
    assert {r["page_id"]: r["n_queries"] for r in ex.queries_per_page(pages).collect()} == {1: 3, 2: 0, 3: 0}
    assert [r["heading"] for r in ex.malformed_sections(pages).collect()] == ["B"]


def test_short_links_need_a_query_target(spark):
    pages = spark.createDataFrame([(1, "[https://w.wiki/a Title] x]\n[https://w.wiki/b B]\n[https://w.wiki/c C]")], "page_id int, text string")
    targets = [("https://w.wiki/a", "https://query.wikidata.org/embed.html#SELECT%201"), ("https://w.wiki/b", "https://other.org/x")]
    redirects = spark.createDataFrame(targets, "short_url string, target string")
    rows = ex.short_link_queries(pages, redirects).collect()
    assert [(r["query"], r["metadata"][0]["description"]) for r in rows] == [("#SELECT 1", "Title")]


# --- ids and labels -----------------------------------------------------------------------------------

def test_annotations_round_trip_and_respect_id_borders(spark):
    labels = spark.createDataFrame(
        [("Q1", "entity", "de", "Weltall"), ("Q1", "entity", "en", " universe "), ("Q10", "entity", "en", "ten"),
         ("P31", "property", "fr", "nature"), ("L5", "lexeme", "en", "word")],
        "id string, kind string, lang string, label string",
    )
    text = "SELECT ?x { ?x wdt:P31 wd:Q1, wd:Q10, wd:Q99 ; l:L5 }"
    queries = spark.createDataFrame([(1, text), (2, "SELECT 1")], "id int, query string")
    got = {r["id"]: r["query_annotated"] for r in an.annotate_ids(queries, labels).collect()}
    assert got[1] == "SELECT ?x { ?x wdt:[property:nature] wd:[entity:universe], wd:[entity:ten], wd:[entity:Q99] ; l:[lexeme:word] }"
    assert got[2] == "SELECT 1"
    trimmed = labels.withColumn("label", F.trim("label"))
    marked = spark.createDataFrame(list(got.items()), "id int, query string")
    back = {r["id"]: r["query_resolved"] for r in an.resolve_annotations(marked, trimmed).collect()}
    assert back[1] == text.replace("L5", "[lexeme:word]") and back[2] == "SELECT 1"


@pytest.mark.parametrize("hot", [0, 1, 1000])
def test_labels_of_hot_and_rare_ids(spark, monkeypatch, hot):
    monkeypatch.setattr(an, "HOT", hot)
    labels = spark.createDataFrame(
        [("Q1", "entity", "en", "one"), ("Q2", "entity", "en", "two"), ("P3", "property", "en", "three")],
        "id string, kind string, lang string, label string",
    )
    rows = [(i, f"wd:Q1 wd:Q1 wd:Q{i % 4}") for i in range(1, 9)] + [(9, None), (None, "wd:Q1"), (10, ""), (11, "wdt:P3"), (11, "wd:Q2")]
    queries = spark.createDataFrame(rows, "id int, query string")
    names = {"Q0": "Q0", "Q1": "one", "Q2": "two", "Q3": "Q3"}
    want = [(i, f"wd:[entity:one] wd:[entity:one] wd:[entity:{names[f'Q{i % 4}']}]") for i in range(1, 9)]
    want += [(-1, "wd:[entity:Q1]"), (10, ""), (11, "wdt:[property:three]"), (11, "wd:[entity:two]")]
    got = an.annotate_ids(queries, labels)
    assert sorted((-1 if r[0] is None else r[0], r[1]) for r in got.collect()) == sorted(want)
    back = an.resolve_annotations(got.where("id is not null").withColumnRenamed("query_annotated", "query"), labels)
    assert sorted(tuple(r) for r in back.collect()) == sorted((i, q) for i, q in rows if i and q is not None)
    read = {r["id"]: (r["query_readable"][-6:], r["resolved"]) for r in an.readable_ids(queries.where("id < 9"), labels).collect()}
    assert read[1] == ("wd:one", True) and read[2] == ("wd:two", True) and read[3] == (" wd:Q3", False)


@pytest.mark.parametrize("partitions", [1, 5])
def test_exact_medians(spark, partitions):
    rng = random.Random(4)
    groups = {"one": [7], "even": [1, 2, 3, 10], "hot": [5] * 200 + [1, 9, 9], "many": [rng.randrange(1000) for _ in range(301)]}
    values = spark.createDataFrame([(m, v) for m, vs in groups.items() for v in [*vs, None]], "measure string, value bigint")
    got = {r["measure"]: (r["n"], r["median"]) for r in an.exact_medians(values, partitions).collect()}
    assert got == {m: (len(vs), statistics.median(vs)) for m, vs in groups.items()}


def test_readable_ids_drop_unknown(spark):
    labels = spark.createDataFrame([("Q5", "entity", "en", "human being")], "id string, kind string, lang string, label string")
    queries = spark.createDataFrame([(1, "SELECT { ?x a wd:Q5 }"), (2, "SELECT { wd:Q6 }"), (3, "ASK {}")], "id int, query string")
    got = {r["id"]: r["template"] for r in an.query_templates(queries, labels).collect()}
    url = "http://www.wikidata.org/entity/"
    assert got == {
        1: f"PREFIX wd: <{url}> \n# wd:human_being is the text label corresponding to ID:Q5 (<{url}Q5>)\nSELECT {{ ?x a wd:human_being }}",
        3: "ASK {}",
    }


def test_name_fallback(spark):
    labels = spark.createDataFrame(
        [("P1", "property", "en", "Born"), ("Q2", "entity", "en", "Paris"), ("Q11", "entity", "en", "Paris")],
        "id string, kind string, lang string, label string",
    )
    names = spark.createDataFrame(
        [("entity", "paris"), ("entity", "born"), ("property", "Paris France"), ("entity", "nowhere land"), ("entity", "x")],
        "kind string, name string",
    )
    got = {r["name"]: r["id"] for r in an.resolve_names(names, labels).collect()}
    assert got == {"paris": "Q2", "born": "P1", "Paris France": "Q2", "nowhere land": "nowhere land", "x": "x"}


# --- answers of a text model ----------------------------------------------------------------------------

def test_upsert_is_idempotent_and_keeps_the_newest(spark):
    log = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), ("b", 1, "z")], "id string, attempt int, raw string")
    once = rs.latest(log)
    again = rs.upserted(once, log)
    assert sorted(map(tuple, once.collect())) == sorted(map(tuple, again.collect())) == [("a", 2, "y"), ("b", 1, "z")]


def test_budget_stops_after_the_request_that_reaches_it(spark):
    log = spark.createDataFrame([(i, 4.0) for i in range(10)], "id int, cost double")
    assert sorted(r["id"] for r in rs.within_budget(log, ["id"], "cost", 20.0).collect()) == [0, 1, 2, 3, 4]


def test_samples_belong_to_their_row(spark):
    rows = spark.createDataFrame([(1, ["a", "b"]), (2, ["c"]), (3, [])], "id int, instructions array<string>")
    got = asm.sampled_instructions(rows, 3, seed=1)
    assert got.count() == 6 and got.where("NOT array_contains(instructions, instruction)").count() == 0
    assert sorted(map(tuple, got.select("id", "draw", "instruction").collect())) == sorted(
        map(tuple, asm.sampled_instructions(rows.repartition(3), 3, seed=1).select("id", "draw", "instruction").collect())
    )


def test_published_types_overflow_is_an_error(spark):
    row = {c: "x" for c in asm.PUBLISHED} | {"id": 40000, "instructions": ["x"]}
    frame = spark.createDataFrame([row], "id bigint, instructions array<string>, " + ", ".join(
        f"{c} string" for c in asm.PUBLISHED if c not in ("id", "instructions")))
    with pytest.raises(Exception, match="OVERFLOW"):
        asm.published(frame, id_type="smallint").collect()
    assert asm.published(frame).first()["id"] == 40000


def test_unknown_split_is_refused(spark):
    with pytest.raises(ValueError, match="unknown splits"):
        asm.routed({"all": spark.range(1)})


# --- scores --------------------------------------------------------------------------------------------------

def test_set_scores_with_a_hot_key(spark):
    rng = random.Random(4)
    rows = [(1 if rng.random() < 0.5 else rng.randint(2, 9), rng.randint(0, 40), rng.choice(["left", "right"])) for _ in range(900)]
    rows.append((77, 1, "left"))
    got = {r["k"]: r for r in sc.set_scores(spark.createDataFrame(rows, "k int, v int, side string"), ["k"], "v", "side").collect()}
    for k in {r[0] for r in rows}:
        x = {v for q, v, s in rows if q == k and s == "left"}
        y = {v for q, v, s in rows if q == k and s == "right"}
        assert got[k]["jaccard"] == pytest.approx(len(x & y) / len(x | y))
        assert got[k]["dice"] == pytest.approx(2 * len(x & y) / (len(x) + len(y)))
        assert got[k]["jaccard"] <= got[k]["dice"] <= got[k]["overlap"] or not x or not y
    assert got[77]["overlap"] == 0.0


def test_bleu_edges(spark):
    rows = [(1, "a b c d e", "a b c d e"), (2, "a b c d", ""), (3, "a b c", "a b c"), (4, "a b c d e f", "a b c d")]
    got = {r["id"]: r["bleu"] for r in sc.bleu(spark.createDataFrame(rows, "id int, target string, generated string")).collect()}
    assert got[1] == 1.0 and got[2] == 0.0 and got[3] == 0.0
    assert got[4] == pytest.approx(2.718281828459045 ** (1 - 6 / 4))


def test_outcome_tags_every_class(spark):
    cause = "exception: 400 x\nCaused by: old\nCaused by: "
    rows = [
        (1, cause + "undefined prefix"), (2, cause + "ast.ParseException limit"), (3, cause + "ast.ParseException Lexical error"),
        (4, "exception: 400 without a cause"), (5, "exception: 500 StackOverflowError"), (6, "exception: 418 x"), (7, "exception: odd"),
        (8, "exception: x" + " " * 6000 + "java.util.concurrent.TimeoutException"), (9, "exception: java.util.concurrent.TimeoutException" + " " * 12000),
    ]
    got = {r["id"]: r for r in oc.with_errors(spark.createDataFrame(rows, "id int, execution string")).collect()}
    assert got[1]["tags"] == ["undefined prefix"] and got[1]["error_number"] == 0
    assert got[2]["tags"] == ["parse exception due to limit"]
    assert got[3]["tags"] == ["parse exception", "lexical error"] and got[3]["error_number"] == 2
    assert got[4]["tags"] == [] and got[4]["error_number"] is None
    assert got[5]["tags"] == [] and got[6]["tags"] == ["other"] and got[7]["tags"] is None
    assert got[8]["error_type"] == got[9]["error_type"] == "server timeout"


# --- tables and matching ------------------------------------------------------------------------------------

def test_flatten_json_shapes(spark):
    docs = spark.createDataFrame(
        [(1, '{"a": 1, "b": {"c": [1, {"d": null}], "e": {"f": {"g": "x"}}}}'), (2, "[[1, 2], 3]"), (3, "[]")], "id int, json string"
    )
    got = sorted(tuple(r)[:1] + tuple(r)[2:] for r in tb.flatten_json(docs).collect())
    want = [(1, ".a", "1"), (1, "b.c", "1"), (1, "c.d", None), (1, "f.g", "x"), (2, "TOPLEVEL", "3"), (2, "TOPLEVEL", "[1, 2]")]
    assert sorted(got, key=str) == sorted(want, key=str)


@pytest.mark.parametrize(
    ("value", "number", "digits", "date", "url"),
    [
        ("1,234.5", 1234.5, True, False, True), ("12万", 120000.0, True, False, False), ("3K+", 3000.0, True, False, False),
        ("-7 apples", -7.0, False, False, False), ("1e3", 1000.0, True, False, False), ("none", None, False, False, False),
        ("2024-05-06", 2024.0, True, True, False), ("6 May 2019", 6.0, True, True, False), ("1999-05-06", 1999.0, True, False, False),
        ("2021年", 2021.0, True, True, False), ("http://a.org/x", None, False, False, True), ("2024-13-01", 2024.0, True, False, False),
    ],
)
def test_value_tests(spark, value, number, digits, date, url):
    v = F.col("v")
    row = spark.createDataFrame([(value,)], "v string").select(
        pf.number(v).alias("n"), pf.is_mostly_digits(v).alias("d"), pf.is_date(v).alias("t"), pf.is_url(v).alias("u")
    ).first()
    assert (row["n"], row["d"], row["t"], row["u"]) == (number, digits, date, url)


def test_selection_strategies_nest(spark):
    rng = random.Random(6)
    rows = [(f"l{i}", f"r{j}", rng.randint(0, 5) / 5, rng.randint(0, 1)) for i in range(8) for j in range(9)]
    scores = spark.createDataFrame(rows, "left_column string, right_column string, score double, label int")
    picked = {
        s: {(r["left_column"], r["right_column"]) for r in mt.selected(scores, s, tables=[]).collect()}
        for s in ("many-to-many", "one-to-many", "one-to-one")
    }
    assert picked["one-to-one"] <= picked["one-to-many"] <= picked["many-to-many"]
    best_row = lambda i: max(s for l, r, s, _ in rows if l == i)
    best_column = lambda j: max(s for l, r, s, _ in rows if r == j)
    assert picked["one-to-one"] == {(l, r) for l, r, s, y in rows if y and s == best_row(l) == best_column(r)}


# --- files -----------------------------------------------------------------------------------------------------

def test_json_array_file_and_suffixes(spark, tmp_path):
    path = tmp_path / "queries.json"
    path.write_text('[{"query": "a\\nb", "metadata": [{"description": "d", "context": "c"}]},\n {"query": "x", "metadata": []}]')
    assert rd.json_records(spark, str(path), rd.RAW_QUERY).count() == 2
    assert rd.table_by_suffix(spark, str(path), rd.RAW_QUERY).count() == 2
    with pytest.raises(ValueError, match="unknown table format"):
        rd.table_by_suffix(spark, "table.pkl")


def test_columnar_json_file(spark, tmp_path):
    path = tmp_path / "seed.json"
    path.write_text('{"query": {"0": "a", "1": "b"},\n "context": {"1": "c"}}')
    rows = sorted((r["idx"], r["query"], r["context"]) for r in rd.columnar_json(spark, str(path), ["query", "context"]).collect())
    assert rows == [(0, "a", None), (1, "b", "c")]


def test_column_mapping_file(spark, tmp_path):
    path = tmp_path / "mapping.txt"
    path.write_text("<a>, <b c>\n< d >,<e>\nalone\n")
    assert {tuple(r) for r in rd.column_mapping(spark, str(path)).collect()} == {("a", "b c"), ("d", "e")}
    assert rd.column_mapping(spark, str(tmp_path / "missing.txt")).count() == 0
    assert rd.column_mapping(spark, None).count() == 0


def test_csv_round_trip(spark, tmp_path):
    rows = [("a", ' "q", x\ny '), ("b", ""), ("c", None)]
    wr.write_csv(spark.createDataFrame(rows, "k string, v string"), str(tmp_path / "t"))
    got = {r["k"]: r["v"] for r in rd.csv_table(spark, str(tmp_path / "t")).collect()}
    assert got["a"] == ' "q", x\ny '


def test_published_ids_grow_beyond_sixteen_bits(spark):
    from pairforge.operators import assemble as asm

    columns = ", ".join(f"`{c}` {t}" for c, t in asm.PUBLISHED.items())
    rows = spark.createDataFrame([(k, ["i"], *["x"] * 6) for k in (1, 40_000, 2**40)], columns)
    assert sorted(r["id"] for r in asm.published(rows).collect()) == [1, 40_000, 2**40]
    assert dict(asm.published(rows.limit(0), id_type="smallint").dtypes)["id"] == "smallint"
