"""Ids to labels and back, and the structure of queries."""

from pyspark.sql import functions as F

from pairforge.bindings import query
from pairforge.bindings.inputs import LABEL_CTE, QUERY_CTE, label_table, query_texts, table
from pairforge.fixed_values import ALL_PREFIXES, ID_PREFIXES, SCHEMA_PREFIXES
from pairforge.functions import sparql as sq
from pairforge.operators import annotate as an


def _values(prefixes):
    return ", ".join(f"({i}, '{k}', '{u}')" for i, (k, u) in enumerate(prefixes.items()))


_CTE = f"""{QUERY_CTE}, {LABEL_CTE},
all_prefixes(ord, name, url) AS (VALUES {_values(ALL_PREFIXES)}),
id_prefixes(ord, name, url) AS (VALUES {_values(ID_PREFIXES)}),
schema_prefixes(ord, name, url) AS (VALUES {_values(SCHEMA_PREFIXES)}),
pieces AS (SELECT id, unnest(ps) AS piece, generate_subscripts(ps, 1) AS n, ts FROM
  (SELECT id, string_split_regex(query, ':[QPL][0-9]+') AS ps, regexp_extract_all(query, ':([QPL][0-9]+)', 1) AS ts FROM queries)),
tokens AS (SELECT id, n, piece, list_extract(ts, n) AS token FROM pieces),
annotated AS (SELECT t.id, string_agg(piece || coalesce(':[' || CASE left(token, 1) WHEN 'Q' THEN 'entity' WHEN 'P' THEN 'property' ELSE 'lexeme' END
    || ':' || coalesce(b.label, token) || ']', ''), '' ORDER BY n) AS query_annotated
  FROM tokens t LEFT JOIN best b ON b.id = t.token GROUP BY t.id)"""


@query("A1_item_ids", f"WITH {_CTE} SELECT DISTINCT id, token AS item FROM tokens WHERE token IS NOT NULL")
def item_ids(spark, sf):
    return query_texts(spark, sf).select("id", F.explode(sq.item_ids(F.col("query"))).alias("item"))


@query(
    "A2_id_terms",
    f"""WITH {_CTE}, terms AS (SELECT q.id, p.name AS prefix,
    len(regexp_extract_all(q.query, '(^|[^A-Za-z0-9_])(?i:' || p.name || '):[A-Z][0-9]+')) AS n
  FROM queries q, id_prefixes p) SELECT id, prefix, n::BIGINT AS n FROM terms WHERE n > 0""",
)
def id_terms(spark, sf):
    terms = query_texts(spark, sf).select("id", F.explode(sq.id_terms(F.col("query"))).alias("term"))
    return terms.groupBy("id", sq.term_prefix(F.col("term")).alias("prefix")).agg(F.count("*").alias("n"))


@query("A2_prefix_usage", f"""WITH {_CTE} SELECT p.name AS prefix, count(*) AS n_queries FROM queries q, id_prefixes p
  WHERE regexp_matches(q.query, '(^|[^A-Za-z0-9_])(?i:' || p.name || '):[A-Z][0-9]+') GROUP BY 1""")
def prefix_usage(spark, sf):
    return an.prefix_usage(query_texts(spark, sf))


@query(
    "A3_schema_terms",
    f"""WITH {_CTE} SELECT id, p.name AS prefix FROM queries q, schema_prefixes p
  WHERE regexp_matches(q.query, '(^|[^A-Za-z0-9_])(?i:' || p.name || '):[A-Za-z0-9_]+')""",
)
def schema_terms(spark, sf):
    used = F.array_distinct(F.transform(sq.schema_terms(F.col("query")), sq.term_prefix))
    return query_texts(spark, sf).select("id", F.explode(used).alias("prefix"))


@query(
    "A4_label_lookup",
    f"""WITH {_CTE} SELECT u.id, coalesce(b.label, u.id) AS label
  FROM (SELECT DISTINCT token AS id FROM tokens WHERE token IS NOT NULL) u LEFT JOIN best b USING (id)""",
)
def label_lookup(spark, sf):
    return an.label_lookup(an.used_ids(query_texts(spark, sf)), label_table(spark, sf))


@query("A5_annotate_ids", f"WITH {_CTE} SELECT id, query_annotated FROM annotated")
def annotate_ids(spark, sf):
    return an.annotate_ids(query_texts(spark, sf), label_table(spark, sf))


_READABLE = f"""{_CTE},
rpieces AS (SELECT id, unnest(ps) AS piece, generate_subscripts(ps, 1) AS n, ts FROM
  (SELECT id, string_split_regex(query, '\\b(?:{"|".join(ID_PREFIXES)}):[A-Z][0-9]+') AS ps,
     regexp_extract_all(query, '\\b(?:{"|".join(ID_PREFIXES)}):[A-Z][0-9]+') AS ts FROM queries)),
rtokens AS (SELECT id, n, piece, split_part(list_extract(ts, n), ':', 1) AS prefix, split_part(list_extract(ts, n), ':', 2) AS item,
    list_extract(ts, n) AS token FROM rpieces),
rjoined AS (SELECT t.*, b.label, p.ord, p.url,
    prefix || ':' || replace(regexp_replace(b.label, '[^a-zA-Z0-9 ]', '', 'g'), ' ', '_') AS term
  FROM rtokens t LEFT JOIN best b ON b.id = t.item LEFT JOIN id_prefixes p ON p.name = t.prefix),
rbody AS (SELECT id, string_agg(piece || coalesce(term, token, ''), '' ORDER BY n) AS body,
    bool_and(token IS NULL OR label IS NOT NULL) AS resolved FROM rjoined GROUP BY id),
rblock AS (SELECT id, ord, 'PREFIX ' || any_value(prefix) || ': <' || any_value(url) || '> ' || chr(10)
    || string_agg('# ' || term || ' is the text label corresponding to ID:' || item || ' (<' || url || item || '>)' || chr(10), '' ORDER BY n DESC) AS block
  FROM rjoined WHERE token IS NOT NULL AND label IS NOT NULL GROUP BY id, ord),
rhead AS (SELECT id, string_agg(block, '' ORDER BY ord DESC) AS head FROM rblock GROUP BY id),
readable AS (SELECT id, coalesce(head, '') || body AS query_readable, resolved FROM rbody LEFT JOIN rhead USING (id))"""


@query("A6_readable_ids", f"WITH {_READABLE} SELECT id, query_readable FROM readable WHERE resolved")
def readable_ids(spark, sf):
    return an.readable_ids(query_texts(spark, sf), label_table(spark, sf)).where("resolved").drop("resolved")


_SCHEMA_HEAD = """coalesce((SELECT string_agg('PREFIX ' || p.name || ': <' || p.url || '> ' || chr(10), '' ORDER BY p.ord DESC)
  FROM schema_prefixes p WHERE regexp_matches({0}, '(^|[^A-Za-z0-9_])' || p.name || ':[A-Za-z0-9_]+')), '')"""


@query("A7_schema_prefixes", f"WITH {_CTE} SELECT id, {_SCHEMA_HEAD.format('query')} || query AS query FROM queries")
def schema_prefixes(spark, sf):
    return query_texts(spark, sf).withColumn("query", sq.prepend_schema_prefixes(F.col("query")))


_MISSING = """(SELECT string_agg('PREFIX ' || p.name || ': <' || p.url || '>' || chr(10), '' ORDER BY p.ord) || chr(10)
  FROM all_prefixes p WHERE regexp_matches(query, '[^A-Za-z0-9_]' || p.name || ':')
    AND NOT contains(query, 'PREFIX ' || p.name || ': <' || p.url || '>'))"""


@query("A8_missing_prefixes", f"WITH {_CTE} SELECT id, coalesce({_MISSING}, '') || query AS query FROM queries")
def missing_prefixes(spark, sf):
    return query_texts(spark, sf).withColumn("query", sq.add_missing_prefixes(F.col("query")))


@query(
    "A9_annotate_queries",
    f"WITH {_CTE} SELECT id, coalesce({_MISSING}, '') || query_annotated AS query_annotated FROM queries JOIN annotated USING (id)",
)
def annotate_queries(spark, sf):
    return an.annotate_queries(query_texts(spark, sf), label_table(spark, sf))


@query(
    "A10_query_templates",
    f"WITH {_READABLE} SELECT id, {_SCHEMA_HEAD.format('query_readable')} || query_readable AS template FROM readable WHERE resolved",
)
def query_templates(spark, sf):
    return an.query_templates(query_texts(spark, sf), label_table(spark, sf))


_MARK = r"""\[(entity|property):([\p{L}\p{N}_\s,:;''`".!?]+)\]"""
_MARKS = f"""{_CTE},
mpieces AS (SELECT id, unnest(ps) AS piece, generate_subscripts(ps, 1) AS n, ks, ns FROM
  (SELECT id, string_split_regex(query_annotated, '{_MARK}') AS ps, regexp_extract_all(query_annotated, '{_MARK}', 1) AS ks,
     regexp_extract_all(query_annotated, '{_MARK}', 2) AS ns FROM annotated)),
marks AS (SELECT id, n, piece, list_extract(ks, n) AS kind, list_extract(ns, n) AS name FROM mpieces),
names AS (SELECT DISTINCT kind, name FROM marks WHERE kind IS NOT NULL),
tries AS (SELECT kind, name, 0 AS r, kind AS k, lower(name) AS t FROM names
  UNION ALL SELECT kind, name, 1, CASE kind WHEN 'entity' THEN 'property' ELSE 'entity' END, lower(name) FROM names
  UNION ALL SELECT kind, name, 2, kind, lower(split_part(name, ' ', 1)) FROM names
  UNION ALL SELECT kind, name, 3, CASE kind WHEN 'entity' THEN 'property' ELSE 'entity' END, lower(split_part(name, ' ', 1)) FROM names),
hits AS (SELECT t.kind, t.name, arg_min(l.id, t.r * 100000000000 + length(l.id) * 1000000000 + substr(l.id, 2)::BIGINT) AS item
  FROM tries t JOIN label_rows l ON l.kind = t.k AND lower(l.label) = t.t GROUP BY ALL),
resolved_names AS (SELECT n.kind, n.name, coalesce(h.item, n.name) AS id FROM names n LEFT JOIN hits h USING (kind, name))"""


def _annotated(spark, sf):
    return an.annotate_ids(query_texts(spark, sf), label_table(spark, sf)).withColumnRenamed("query_annotated", "query")


@query("A11_annotation_marks", f"WITH {_MARKS} SELECT id, (n - 1)::INT AS pos, kind, name FROM marks WHERE kind IS NOT NULL")
def annotation_marks(spark, sf):
    return an.annotation_marks(_annotated(spark, sf))


@query(
    "A12_resolve_annotations",
    f"""WITH {_MARKS} SELECT m.id, string_agg(piece || coalesce(r.id, ''), '' ORDER BY n) AS query_resolved
  FROM marks m LEFT JOIN resolved_names r ON m.kind = r.kind AND m.name = r.name GROUP BY m.id""",
)
def resolve_annotations(spark, sf):
    return an.resolve_annotations(_annotated(spark, sf), label_table(spark, sf))


# Names to look up: region and nation names asked for in the wrong kind, with extra words, or unknown.
_ASKED_KIND = "CASE WHEN c_custkey % 2 = 0 THEN 'entity' ELSE 'property' END AS kind"
_ASKED_NAME = """CASE c_custkey % 4 WHEN 0 THEN 'NATION_' || c_nationkey WHEN 1 THEN 'nation_' || c_nationkey || ' of the world'
  WHEN 2 THEN replace(c_name, '#', ' ') ELSE 'nothing known ' || c_custkey END AS name"""
_ASKED_MARKS = _MARKS.replace(
    "names AS (SELECT DISTINCT kind, name FROM marks WHERE kind IS NOT NULL)",
    f"names AS (SELECT DISTINCT {_ASKED_KIND}, {_ASKED_NAME} FROM customer)",
)


@query("A13_name_fallback", f"WITH {_ASKED_MARKS} SELECT kind, name, id FROM resolved_names")
def name_fallback(spark, sf):
    names = table(spark, sf, "customer").selectExpr(_ASKED_KIND, _ASKED_NAME)
    return an.resolve_names(names, label_table(spark, sf))


@query(
    "A14_follow_redirects",
    """SELECT o_orderkey, 'Q' || coalesce(c.c_nationkey, o.o_custkey) AS id FROM orders o
  LEFT JOIN customer c ON o.o_custkey = c.c_custkey AND c.c_custkey % 2 = 0""",
)
def follow_redirects(spark, sf):
    ids = table(spark, sf, "orders").selectExpr("o_orderkey", "'Q' || o_custkey AS id")
    moved = table(spark, sf, "customer").where("c_custkey % 2 = 0").selectExpr(
        "'Q' || c_custkey AS old_id", "'Q' || c_nationkey AS new_id"
    )
    return an.follow_redirects(ids, moved)


_HIT = "CASE WHEN p_partkey % 3 = 0 THEN p_name END AS label, CASE WHEN p_partkey % 4 < 2 THEN p_type END AS description"


@query(
    "A15_display_labels",
    f"WITH h AS (SELECT p_partkey, {_HIT} FROM part) SELECT p_partkey, coalesce(label, description) AS display FROM h WHERE coalesce(label, description) IS NOT NULL",
)
def display_labels(spark, sf):
    hits = table(spark, sf, "part").selectExpr("p_partkey", *[f"{e}" for e in _HIT.split(", ")])
    return an.display_labels(hits).select("p_partkey", "display")


_STRUCTURE = f"""{QUERY_CTE},
structure AS (SELECT id, len(regexp_extract_all(query, 'PREFIX [A-Za-z]*: <')) AS n_prefixes,
    len(regexp_extract_all(regexp_extract(query, '(?is)select(.*?)\\{{', 1), '\\?([a-z]+)', 1)) AS n_variables,
    try_cast(nullif(regexp_extract(query, 'LIMIT ([0-9]+)', 1), '') AS BIGINT) AS row_limit,
    try_cast(nullif(regexp_extract(query, 'OFFSET ([0-9]+)', 1), '') AS BIGINT) AS row_offset,
    CASE WHEN id % 7 = 0 THEN 2 ELSE 0 END AS value_rows,
    2 + CASE WHEN id % 4 = 0 THEN 1 ELSE 0 END + CASE WHEN id % 9 = 0 THEN 1 ELSE 0 END AS triples FROM queries)"""


@query(
    "A16_query_structure",
    f"""WITH {_STRUCTURE} SELECT id, n_prefixes::INT AS n_prefixes, n_variables::INT AS n_variables, coalesce(row_limit, -1) AS row_limit,
  coalesce(row_offset, -1) AS row_offset, value_rows::INT AS value_rows, triples::INT AS triples FROM structure""",
)
def query_structure(spark, sf):
    none = F.lit(-1).cast("bigint")
    return an.query_structure(query_texts(spark, sf)).select(
        "id", F.size("prefixes").alias("n_prefixes"), F.size("variables").alias("n_variables"),
        F.coalesce("limit", none).alias("row_limit"), F.coalesce("offset", none).alias("row_offset"),
        "value_rows", "triples",
    )


@query(
    "A16_corpus_profile",
    f"""WITH {_STRUCTURE} SELECT count(*) AS n_queries, avg(triples)::DOUBLE AS mean_triples, max(n_variables)::INT AS max_variables,
  count(row_limit) AS n_limited, count(*) FILTER (WHERE value_rows > 0) AS n_with_values FROM structure""",
)
def corpus_profile(spark, sf):
    return an.query_structure(query_texts(spark, sf)).agg(
        F.count("*").alias("n_queries"), F.avg("triples").alias("mean_triples"),
        F.max(F.size("variables")).alias("max_variables"), F.count("limit").alias("n_limited"),
        F.count_if(F.col("value_rows") > 0).alias("n_with_values"),
    )


_MEASURES = " UNION ALL ".join(
    f"SELECT '{m}' AS measure, {c}::BIGINT AS value FROM structure"
    for m, c in {"prefixes": "n_prefixes", "variables": "n_variables", "value_rows": "value_rows", "triples": "triples"}.items()
)


@query(
    "A16_structure_medians",
    f"WITH {_STRUCTURE}, measures AS ({_MEASURES}) SELECT measure, count(*) AS n, median(value)::DOUBLE AS median FROM measures GROUP BY measure",
)
def structure_medians(spark, sf):
    return an.structure_medians(query_texts(spark, sf))


@query("A16_exact_medians", """SELECT l_returnflag AS measure, count(*) AS n, median(l_partkey)::DOUBLE AS median FROM lineitem GROUP BY 1""")
def exact_medians(spark, sf):
    """Few measures of many values each."""
    return an.exact_medians(table(spark, sf, "lineitem").selectExpr("l_returnflag AS measure", "l_partkey AS value"))


@query(
    "A16_declared_prefixes",
    f"""WITH {QUERY_CTE}, declared AS (SELECT DISTINCT id, unnest(regexp_extract_all(query, '(?i)PREFIX\\s+([A-Za-z0-9_-]*):\\s*<(.*?)>', 1)) AS name,
    unnest(regexp_extract_all(query, '(?i)PREFIX\\s+([A-Za-z0-9_-]*):\\s*<(.*?)>', 2)) AS url FROM queries)
SELECT name, url, count(*) AS n_queries FROM declared GROUP BY ALL""",
)
def declared_prefixes(spark, sf):
    return an.declared_usage(query_texts(spark, sf))


@query(
    "A16_property_usage",
    f"""WITH {QUERY_CTE}, used AS (SELECT id, unnest(regexp_extract_all(query, ':([QPL][0-9]+)', 1)) AS property FROM queries)
SELECT property, count(*) AS n_uses, count(DISTINCT id) AS n_queries FROM used WHERE property LIKE 'P%' GROUP BY property""",
)
def property_usage(spark, sf):
    return an.property_usage(query_texts(spark, sf))


# Statements with lists, decimals, strings, IRIs and clauses; the SQL counts what it put in.
_STATEMENTS = """'SELECT ?x WHERE { ?x a wd:Q' || l_partkey || CASE WHEN l_partkey % 2 = 0 THEN ', wd:Q5 , <http://x.org/a,b.c;d>' ELSE '' END
  || ' ; wdt:P' || l_suppkey || ' ' || l_linenumber || '.5' || CASE WHEN l_linenumber > 3 THEN ', -0.25' ELSE '' END || '. '
  || CASE WHEN l_suppkey % 3 = 0 THEN 'FILTER(?x > 1.5 && regex(?y, "a.b;c")) ' ELSE '' END
  || CASE WHEN l_suppkey % 5 = 0 THEN 'OPTIONAL { ?x rdfs:label "one. two; three, {four}" } ' ELSE '' END
  || 'VALUES ?z { wd:Q1 wd:Q2 } # a note; with, signs.' || chr(10) || '}'"""


@query(
    "A16_statement_counts",
    """SELECT l_orderkey, l_linenumber, (2 + CASE WHEN l_partkey % 2 = 0 THEN 2 ELSE 0 END + CASE WHEN l_linenumber > 3 THEN 1 ELSE 0 END
  + CASE WHEN l_suppkey % 5 = 0 THEN 1 ELSE 0 END)::INT AS triples FROM lineitem""",
)
def statement_counts(spark, sf):
    queries = table(spark, sf, "lineitem").selectExpr("l_orderkey", "l_linenumber", f"{_STATEMENTS} AS query")
    return queries.select("l_orderkey", "l_linenumber", sq.triple_count(F.col("query")).alias("triples"))


# Statements of an order: the first line and every fifth part name the subject, some lack an object.
_SUBJECT = "CASE WHEN l_linenumber = 1 OR l_partkey % 5 = 0 THEN 's' || l_suppkey END"
_OBJECT = "CASE WHEN l_partkey % 9 <> 0 THEN 'o' || l_partkey END"


@query(
    "A17_subject_fill",
    f"""WITH t AS (SELECT l_orderkey AS query_id, l_linenumber * 1000000 + l_partkey AS pos, max({_SUBJECT}) AS s, max({_OBJECT}) AS o FROM lineitem GROUP BY ALL),
filled AS (SELECT query_id, pos, o, last_value(s IGNORE NULLS) OVER (PARTITION BY query_id ORDER BY pos) AS s FROM t)
SELECT query_id, pos, s, o FROM filled WHERE s IS NOT NULL AND o IS NOT NULL""",
)
def subject_fill(spark, sf):
    triples = (
        table(spark, sf, "lineitem")
        .selectExpr("l_orderkey AS query_id", "l_linenumber * 1000000 + l_partkey AS pos", f"{_SUBJECT} AS s", f"{_OBJECT} AS o")
        .groupBy("query_id", "pos")
        .agg(F.max("s").alias("s"), F.max("o").alias("o"))
    )
    return an.complete_triples(triples).select("query_id", "pos", "s", "o")


_PREDICATE = "CASE WHEN l_linenumber = 1 OR l_partkey % 3 = 0 THEN 'p' || l_suppkey % 7 END"


@query(
    "A17_predicate_fill",
    f"""WITH t AS (SELECT l_orderkey % 5 AS query_id, l_orderkey * 1000 + l_linenumber * 100000000000 + l_partkey % 1000 AS pos, max({_SUBJECT}) AS s, max({_PREDICATE}) AS p,
    max({_OBJECT}) AS o FROM lineitem GROUP BY ALL),
filled AS (SELECT query_id, pos, o, last_value(s IGNORE NULLS) OVER w AS s, last_value(p IGNORE NULLS) OVER w AS p FROM t WINDOW w AS (PARTITION BY query_id ORDER BY pos))
SELECT query_id, pos, s, p, o FROM filled WHERE s IS NOT NULL AND p IS NOT NULL AND o IS NOT NULL""",
)
def predicate_fill(spark, sf):
    """Few keys of many rows each, at sparse positions."""
    place = "l_orderkey * 1000 + l_linenumber * 100000000000 + l_partkey % 1000 AS pos"
    triples = (
        table(spark, sf, "lineitem")
        .selectExpr("l_orderkey % 5 AS query_id", place, f"{_SUBJECT} AS s", f"{_PREDICATE} AS p", f"{_OBJECT} AS o")
        .groupBy("query_id", "pos")
        .agg(F.max("s").alias("s"), F.max("p").alias("p"), F.max("o").alias("o"))
    )
    return an.complete_triples(triples, fill=("s", "p")).select("query_id", "pos", "s", "p", "o")
