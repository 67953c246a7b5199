"""Column functions on hand-made texts."""

import pytest
from pyspark.sql import functions as F

from pairforge.functions import ngrams as ng
from pairforge.functions import sparql as sq
from pairforge.functions import text as tx
from pairforge.functions import wikitext as wt


def one(spark, value, column):
    frame = spark.createDataFrame([(value,)], "t string")
    return frame.select(column(F.col("t")).alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("column", "text", "expected"),
    [
        (tx.normalise_text, "  Ünïcode – “straße”  \r\n\r\n  œuvre\t\tx y ☃ ", 'Unicode - "strasse"\noeuvre x y'),
        (tx.strip_preamble, "#defaultView:Map\nPREFIX a: <b>\nselect ?x", "select ?x"),
        (tx.strip_preamble, "Select ?x { SELECT ?y }", "Select ?x { SELECT ?y }"),
        (tx.strip_preamble, "ASK { ?x ?y ?z }", "ASK { ?x ?y ?z }"),
        (tx.strip_comments, "# a\n  # b\nPREFIX x: <y>\nselect ?x # keep\n# keep too", "PREFIX x: <y>\nSELECT ?x # keep\n# keep too"),
        (tx.strip_comments, "# a\nASK {}\n", "ASK {}\n"),
        (tx.remove_urls, "see https://a.org/b_c?d=1 now", "see  ?d=1 now"),
        (tx.remove_style_attributes, 'a class="b" id="c" z', "a   z"),
        (tx.remove_markup, "<b>x</b> <a href=''> <h1> y <i a=1 />", " x     "),
        (tx.post_trim, "\n a\n\n\n\nb \n", "a\n\nb"),
        (tx.label_slug, "United States (of A.)", "United_States_of_A"),
        (tx.word_count, "a  b ", 4),
        (wt.strip_embed, "embed.html#SELECT", "#SELECT"),
        (wt.url_unquote, "a%20b+c%zz%C3%A9%", "a b+c%zzé%"),
        (wt.heading_text, "=== A = b ===  ", "A = b"),
        (wt.heading_level, " ==Head==", 2),
        (lambda c: wt.heading_level(c, "first_word"), " ==Head==", 4),
        (lambda c: wt.heading_level(c, "first_word"), "== Head ==", 2),
        (lambda c: wt.residual_text(c, True), "a{{SPARQL|query=x}}b{{SPARQL2|query=y}}c", "abc"),
        (lambda c: wt.residual_text(c, False), "a{{SPARQL|query=x}}b{{SPARQL2|query=y}}c", "ab"),
        (lambda c: wt.residual_text(c, False), "no template", ""),
        (wt.template_query, "\n#k: v\nSELECT\n# c\nx ", "SELECT\nx\n"),
        (sq.item_ids, "wd:Q1 wdt:P10/wdt:P1 wd:Q1 l:L5", ["Q1", "P10", "P1", "L5"]),
        (sq.tagged_query, "a [QUERY] x [/QUERY] [QUERY] y [/QUERY]", "x"),
        (sq.tagged_query, "[QUERY] x [QUERY] y", "x"),
        (sq.tagged_query, "[QUERY] x", ""),
        (sq.tagged_query, "none", ""),
        (ng.bleu_tokens, "Hello, world! 1,000.5 a-b 3-4 (x)", ["Hello", ",", "world", "!", "1,000.5", "a-b", "3", "-", "4", "(", "x", ")"]),
        (ng.rouge_tokens, "It's 2 Nice-days é", ["it", "s", "2", "nice", "days"]),
        (lambda c: ng.ngrams(ng.plain_tokens(c), 3), "a b c d", ["a b c", "b c d"]),
        (lambda c: ng.ngrams(ng.plain_tokens(c), 3), "a b", []),
        (sq.row_limit, "SELECT ?x {} limit 10 OFFSET 100", 10),
        (sq.row_offset, "SELECT ?x {} LIMIT 10 OFFSET 100", 100),
    ],
)
def test_column(spark, column, text, expected):
    assert one(spark, text, column) == expected


def test_template_pairs(spark):
    pairs = one(spark, "#title: a: b\n#no colon\nSELECT 1", wt.template_pairs)
    assert [(p["key"], p["value"]) for p in pairs] == [("title", "a: b"), ("comment", "no colon")]


def test_links_are_https_and_greedy_per_line(spark):
    text = "[https://query.wikidata.org/#a x] [https://query.wikidata.org/#b y]\n[http://query.wikidata.org/#c z]"
    links = one(spark, text, wt.query_links)
    assert [(l["target"], l["label"]) for l in links] == [("#a", "x] [https://query.wikidata.org/#b y")]


def test_missing_prefixes(spark):
    url = "http://www.wikidata.org/"
    query = f"PREFIX wd: <{url}entity/>\nSELECT ?x {{ ?x wdt:P31/wdt:P279 wd:Q5 ; rdfs:label ?l . ?x xwdt:P1 ?z }}"
    expected = f"PREFIX rdfs: <http://www.w3.org/2000/01/rdf-schema#>\nPREFIX wdt: <{url}prop/direct/>\n\n{query}"
    assert one(spark, query, sq.add_missing_prefixes) == expected
    assert one(spark, "SELECT 1", sq.add_missing_prefixes) == "SELECT 1"


def test_query_structure(spark):
    query = (
        "PREFIX crm: <http://x.org/crm/> SELECT ?s ?o WHERE { ?s crm:P1 ?o . ?o a ?type . "
        "VALUES (?type) { (crm:E41) (crm:E42) } } LIMIT 10"
    )
    assert [tuple(p) for p in one(spark, query, sq.declared_prefixes)] == [("crm", "http://x.org/crm/")]
    assert one(spark, query, sq.projected_variables) == ["s", "o"]
    assert one(spark, query, sq.value_rows) == 2
    assert one(spark, query, sq.triple_count) == 2
    assert one(spark, query, sq.row_offset) is None


@pytest.mark.parametrize(
    ("body", "n"),
    [
        ("?x wdt:P1 ?y, ?z, wd:Q3 ; wdt:P2 1.5, -0.25 .", 5),
        ("?x a wd:Q1. ?x ex:v 3.14", 2),
        ('?x rdfs:label "a. b; c, d"@en ; ex:u <http://a.b/c;d,e> .', 2),
        ("?x a ?y . FILTER(?x > 1.5 && (regex(?y, 'a,b') || ?z)) ?y a ?w", 2),
        ("?x a ?y OPTIONAL { ?x ex:p ?z } FILTER NOT EXISTS { ?z a ex:T . }", 3),
        ("SERVICE wikibase:label { bd:serviceParam wikibase:language 'en' . }", 1),
        ("?x a ?y # a note. with; signs, {all}\n ; a ?z .", 2),
        ("", 0),
    ],
)
def test_triple_count_knows_lists_numbers_and_clauses(spark, body, n):
    assert one(spark, f"SELECT * {{ {body} }}", sq.triple_count) == n


@pytest.mark.parametrize(
    ("x", "expected"), [(0.123456, 0.123), (123456.0, 123000.0), (-9.8765, -9.88), (0.0, 0.0), (5.0, 5.0), (1e-7, 1e-7)]
)
def test_round_significant(spark, x, expected):
    row = spark.createDataFrame([(x,)], "x double").select(tx.round_significant(F.col("x")).alias("r")).first()
    assert row["r"] == pytest.approx(expected, rel=1e-12)


def test_statements_are_counted_once_per_text(spark):
    cases = [
        ("SELECT ?x { ?x a ?y , ?z . ?x b ?c }", 3), ("{ ?x a ( b ( c ( d , e ) . f ) ; g ) , h . }", 2), ("{ a b ) c d . e f }", 1),
        ("{ ) ( a b . ) c d }", 1), ("{ a b { c d . } e }", 1), ("{ a . b c }", 1), ("{ # a b .\n a \"b . c\" ; <x,y> }", 1), ("{}", 0), ("", 0), (None, None),
    ]
    rows = spark.createDataFrame([(i, q) for i, (q, _) in enumerate(cases)], "i int, q string").select("i", sq.triple_count(F.col("q")).alias("n"))
    assert [r["n"] for r in rows.orderBy("i").collect()] == [n for _, n in cases]
    # Tokens are signs of one text; they meet a fold only where parentheses are nested deeper or left open.
    assert "regexp_count" in rows._jdf.queryExecution().analyzed().toString().lower()
