"""Operator inputs derived from the shared tables.

Expressions in capitals are SQL text that means the same in both engines, so that both sides of a
check start from the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairforge.session import spread


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def sql_draw(seed: int, *parts: str) -> str:
    """SQL of the draw that samples are picked by."""
    return f"('0x' || substr(md5(concat_ws(':', {', '.join(parts)}, '{seed}')), 1, 15))::BIGINT"


# --- wiki pages: each document is a page; headings, templates and stray marks around its lines -------

_HEAD = """CASE WHEN i % 3 <> 1 THEN '' WHEN doc_id % 7 = 0 THEN '==Part ' || i || '==' || chr(10)
  ELSE repeat('=', CAST(2 + (doc_id + i) % 3 AS INT)) || ' Part ' || i || ' '
       || repeat('=', CAST(2 + (doc_id + i) % 3 AS INT)) || chr(10) END"""
_TEMPLATE = """CASE WHEN (doc_id + i) % 4 = 2 THEN chr(10) || 'lead {{SPARQL' || CASE WHEN i % 2 = 0 THEN '' ELSE '2' END
  || '|query=' || chr(10) || '# title: note ' || i || chr(10) || '#plain remark' || chr(10)
  || 'SELECT ?x WHERE { ?x wdt:P' || (doc_id % 25) || ' wd:Q' || doc_id || ' . }' || chr(10) || '}} tail ' || i
  WHEN (doc_id + i) % 11 = 3 THEN chr(10) || 'SPARQL without a template' ELSE '' END"""
WIKI_LINE = f"({_HEAD}) || line || ({_TEMPLATE})"


def wiki_pages(spark: SparkSession, sf: str) -> DataFrame:
    text = f"array_join(transform(split(text, '\\n', -1), (line, i) -> {WIKI_LINE}), '\\n')"
    return spread(table(spark, sf, "documents")).selectExpr("doc_id AS page_id", "source AS title", f"{text} AS text")


WIKI_CTE = f"""
doc_lines AS (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) - 1 AS i
  FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents)),
wiki AS (SELECT doc_id AS page_id, string_agg({WIKI_LINE}, chr(10) ORDER BY i) AS text FROM doc_lines GROUP BY doc_id),
wiki_lines AS (SELECT page_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS n
  FROM (SELECT page_id, string_split(regexp_replace(text, '\\n$', ''), chr(10)) AS ls FROM wiki)),
marked AS (SELECT *, regexp_matches(line, '^ *==+.*==+') AS is_head FROM wiki_lines),
numbered AS (SELECT *, sum(is_head::INT) OVER (PARTITION BY page_id ORDER BY n) - 1 AS section_id FROM marked),
sections AS (SELECT page_id, section_id::INT AS section_id, max(CASE WHEN is_head THEN line END) AS head,
    coalesce(string_agg(line, chr(10) ORDER BY n) FILTER (WHERE NOT is_head), '') AS text
  FROM numbered WHERE section_id >= 0 GROUP BY ALL),
outline AS (SELECT page_id, section_id, length(regexp_extract(trim(head), '^=+'))::INT AS level,
    trim(trim(trim(head), '=')) AS heading, text FROM sections)"""

# --- pages with links ----------------------------------------------------------------------------

LINK_TEXT = """'see [https://query.wikidata.org/' || CASE WHEN page_id % 2 = 0 THEN 'embed.html' ELSE '' END
  || '#SELECT%20%3Fx%20' || page_id || CASE WHEN page_id % 3 = 0 THEN '%zz' WHEN page_id % 3 = 1 THEN '+y' ELSE '%2B' END
  || ' Link to ' || url || '] and more' || chr(10)
  || '[http://query.wikidata.org/#ASK not this one]' || chr(10)
  || '[https://w.wiki/' || page_id || ' Short ' || page_id || '] and [b]' || chr(10) || html"""
REDIRECT_URL = "'https://w.wiki/' || page_id"
REDIRECT_TARGET = "CASE WHEN page_id % 4 = 0 THEN 'https://query.wikidata.org/#SELECT%20' || page_id ELSE url END"


def link_pages(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "pages").selectExpr("page_id", f"{LINK_TEXT} AS text")


def short_redirects(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "pages").where("page_id % 5 <> 0").selectExpr(
        f"{REDIRECT_URL} AS short_url", f"{REDIRECT_TARGET} AS target"
    )


LINK_CTE = f"""
link_pages AS (SELECT page_id, {LINK_TEXT} AS text FROM pages),
redirects AS (SELECT {REDIRECT_URL} AS short_url, {REDIRECT_TARGET} AS target FROM pages WHERE page_id % 5 <> 0)"""

# --- query texts: one per customer ---------------------------------------------------------------

QUERY_TEXT = """CASE WHEN c_custkey % 2 = 0 THEN '# note for ' || c_mktsegment || chr(10) ELSE '' END
  || CASE WHEN c_custkey % 5 = 0 THEN 'PREFIX wd: <http://www.wikidata.org/entity/>' || chr(10) ELSE '' END
  || CASE WHEN c_custkey % 3 = 0 THEN 'select' ELSE 'SELECT' END || ' ?x ?y WHERE {' || chr(10)
  || '  ?x wdt:P' || c_nationkey || ' wd:Q' || c_custkey || ' ;' || chr(10)
  || '     p:P' || CASE WHEN c_custkey % 8 = 1 THEN c_nationkey || '1' ELSE '' || (c_nationkey * 7) % 25 END
  || ' wd:Q' || CASE WHEN c_custkey % 4 = 3 THEN c_custkey || '0' ELSE '' || c_custkey % 100 END || ' .'
  || CASE WHEN c_custkey % 4 = 0 THEN ' ?x rdfs:label ?y .' ELSE '' END
  || CASE WHEN c_custkey % 7 = 0 THEN ' VALUES ?y { wd:Q1 wd:Q2 } .' ELSE '' END
  || CASE WHEN c_custkey % 9 = 0 THEN ' ?y xwd:Q3 wds:L' || c_nationkey || ' .' ELSE '' END || ' }'
  || CASE WHEN c_custkey % 6 = 0 THEN ' LIMIT ' || c_custkey || ' OFFSET 5' ELSE '' END"""
CUSTOMER_LABEL = "replace(c_name, '#', ' ')"


def query_texts(spark: SparkSession, sf: str) -> DataFrame:
    return spread(table(spark, sf, "customer")).selectExpr("c_custkey AS id", f"{QUERY_TEXT} AS query")


def label_table(spark: SparkSession, sf: str) -> DataFrame:
    """Items are customers and properties nations; every third item has no English label."""
    customer, nation = table(spark, sf, "customer"), table(spark, sf, "nation")
    item, label = "'Q' || c_custkey AS id", CUSTOMER_LABEL
    english = customer.where("c_custkey % 3 <> 0").selectExpr(item, "'entity' AS kind", "'en' AS lang", f"{label} AS label")
    german = customer.selectExpr(item, "'entity' AS kind", "'de' AS lang", f"'de ' || {label} || ' ' AS label")
    french = customer.selectExpr(item, "'entity' AS kind", "'fr' AS lang", f"'fr ' || {label} AS label")
    props = nation.selectExpr("'P' || n_nationkey AS id", "'property' AS kind", "'en' AS lang", "n_name AS label")
    return english.unionByName(german).unionByName(french).unionByName(props)


QUERY_CTE = f"queries AS (SELECT c_custkey AS id, {QUERY_TEXT} AS query FROM customer)"
LABEL_CTE = f"""
label_rows AS (
  SELECT 'Q' || c_custkey AS id, 'entity' AS kind, 'en' AS lang, {CUSTOMER_LABEL} AS label FROM customer WHERE c_custkey % 3 <> 0
  UNION ALL SELECT 'Q' || c_custkey, 'entity', 'de', 'de ' || {CUSTOMER_LABEL} || ' ' FROM customer
  UNION ALL SELECT 'Q' || c_custkey, 'entity', 'fr', 'fr ' || {CUSTOMER_LABEL} FROM customer
  UNION ALL SELECT 'P' || n_nationkey, 'property', 'en', n_name FROM nation),
best AS (SELECT id, trim(coalesce(max(label) FILTER (WHERE lang = 'en'), arg_min(label, lang))) AS label
  FROM label_rows GROUP BY id)"""

# --- execution outcomes: one per event -------------------------------------------------------------

EXECUTION = """CASE event_type WHEN 'view' THEN 'timeout' WHEN 'click' THEN '[]' || CASE WHEN event_id % 2 = 0 THEN ' ' ELSE '' END
  WHEN 'purchase' THEN '[{''k'': ' || event_id || '}]'
  WHEN 'error' THEN 'exception: 400 ' || repeat('at x.y.z(T.java) ', CAST(event_id % 40 AS INT)) || chr(10) || 'Caused by: first' || chr(10)
    || CASE event_id % 7 WHEN 0 THEN 'Caused by: undefined prefix: foo'
       WHEN 1 THEN 'Caused by: org.openrdf.query.parser.sparql.ast.ParseException: near limit 10'
       WHEN 2 THEN 'Caused by: org.openrdf.query.parser.sparql.ast.ParseException: Encountered x'
       WHEN 3 THEN 'Caused by: ast.ParseException: Lexical error at line 1'
       WHEN 4 THEN 'Caused by: Non-aggregate variable in select expression: y'
       WHEN 5 THEN 'Caused by: Multiple prefix declarations for prefix ''wd'''
       ELSE 'no known cause' END
  ELSE CASE event_id % 11 WHEN 0 THEN 'exception: 500 ' || chr(10) || 'Caused by: java.lang.StackOverflowError'
       WHEN 1 THEN 'exception: 500 ' || chr(10) || 'Caused by: Input could not be resolved as point: z'
       WHEN 2 THEN 'exception: 500 ' || chr(10) || 'Caused by: The estimated execution time is too long'
       WHEN 3 THEN 'exception: 500 ' || chr(10) || 'Caused by: MemoryManagerOutOfMemory' || chr(10) || 'Caused by: java.lang.NullPointerException'
       WHEN 4 THEN 'exception: 500 Server Error: the response has an Invalid chunk length'
       WHEN 5 THEN 'exception: module ''requests.exceptions'' has no attribute ''JSONDecodeError'''
       WHEN 6 THEN 'exception: query is empty'
       WHEN 7 THEN 'exception: x ' || repeat('abcde ', 1000) || 'java.util.concurrent.TimeoutException' || repeat(' y', 300)
       WHEN 8 THEN 'exception: x ' || 'java.util.concurrent.TimeoutException' || repeat(' 12345', 2000)
       WHEN 9 THEN 'exception: 429 Too many requests' ELSE 'exception: other' END END"""
VARIANT = "CASE user_id % 3 WHEN 0 THEN 'original' WHEN 1 THEN 'limit_10' ELSE 'no_limit' END"
VARIANTS = ["original", "limit_10", "no_limit"]


def executions(spark: SparkSession, sf: str) -> DataFrame:
    return spread(table(spark, sf, "events")).selectExpr(
        "event_id AS id", f"{VARIANT} AS variant", f"{EXECUTION} AS execution"
    )


EXECUTION_CTE = f"executions AS (SELECT event_id AS id, {VARIANT} AS variant, {EXECUTION} AS execution FROM events)"

# --- question and answer turns -----------------------------------------------------------------------

PAIR_ID = "u.conv_id * 1000 + u.turn"
GENERATED = """CASE (u.conv_id + u.turn) % 5 WHEN 0 THEN u.text WHEN 1 THEN replace(u.text, 'e', 'a')
  WHEN 2 THEN u.text || ' ' || a.text WHEN 3 THEN a.text ELSE '' END"""
TAGGED = """CASE (u.conv_id + u.turn) % 6 WHEN 0 THEN a.text WHEN 1 THEN 'Here: [QUERY]' || chr(10) || a.text || ' [/QUERY] end'
  WHEN 2 THEN '[QUERY] ' || a.text || '[QUERY] again' WHEN 3 THEN '[QUERY] ' || a.text
  WHEN 4 THEN '[/QUERY] x [QUERY]   [/QUERY]' ELSE '[QUERY]a[/QUERY] [QUERY]b[/QUERY]' END"""


def turn_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """User turns with the turn that follows; (conv_id, turn) is unique, so the join is one to one."""
    turns = table(spark, sf, "conversations")
    asked = turns.where("role = 'user'").alias("u")
    follow = turns.alias("a")
    joined = asked.join(follow, F.expr("u.conv_id = a.conv_id AND u.turn + 1 = a.turn"))
    return joined.selectExpr(
        f"{PAIR_ID} AS id", "u.text AS target", "a.text AS reply", f"{GENERATED} AS generated", f"{TAGGED} AS raw"
    )


PAIR_CTE = f"""turn_pairs AS (SELECT {PAIR_ID} AS id, u.text AS target, a.text AS reply, {GENERATED} AS generated, {TAGGED} AS raw
  FROM conversations u JOIN conversations a ON u.conv_id = a.conv_id AND u.turn + 1 = a.turn WHERE u.role = 'user')"""

# --- question-query rows: documents with instructions -------------------------------------------------

ROW_QUERY = "'SELECT ?x WHERE { ?x wdt:P31 wd:Q' || doc_id || ' . } # ' || text"
COMPLEXITY = "CASE doc_id % 3 WHEN 0 THEN 'simple' WHEN 1 THEN 'medium' ELSE 'complex' END"
SPLIT = "CASE WHEN doc_id % 10 = 0 THEN 'test' WHEN doc_id % 10 = 1 THEN 'validation' ELSE 'train' END"


def question_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Instructions are the sentences of the document."""
    return table(spark, sf, "documents").selectExpr(
        "doc_id AS id",
        "split(text, '[.] ', -1) AS instructions",
        f"{ROW_QUERY} AS sparql_query",
        f"{ROW_QUERY} || ' annotated' AS sparql_annotated",
        "text AS sparql_raw",
        f"{COMPLEXITY} AS complexity",
        "lang AS complexity_description",
        "source AS query_results",
        f"{SPLIT} AS split",
    )


ROW_CTE = f"""question_rows AS (SELECT doc_id AS id, string_split(text, '. ') AS instructions, {ROW_QUERY} AS sparql_query,
  {ROW_QUERY} || ' annotated' AS sparql_annotated, text AS sparql_raw, {COMPLEXITY} AS complexity,
  lang AS complexity_description, source AS query_results, {SPLIT} AS split FROM documents)"""

# --- answers of a text model: one per event -----------------------------------------------------------

RAW_ANSWER = """CASE event_id % 6 WHEN 0 THEN '{"instructions": ["Find ' || event_id || '", "Show ' || user_id || '?"]}'
  WHEN 1 THEN '{"nl_generation": ["List ' || event_id || '"], "x": 1}' WHEN 2 THEN 'Sure! {"instructions": []}'
  WHEN 3 THEN '{"other": ["a"]}' WHEN 4 THEN '["instructions"]' ELSE '{"x": {"instructions": 1}}' END"""
RAW_CLASS = """CASE event_id % 5 WHEN 0 THEN '{"complexity": "simple", "complexity_description": "one triple"}'
  WHEN 1 THEN '{"complexity": "hard", "complexity_description": "odd"}' WHEN 2 THEN '{"complexity": "complex"}'
  WHEN 3 THEN 'simple' ELSE '{"complexity_description": "d' || event_id || '", "complexity": "medium"}' END"""


def answer_log(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").selectExpr(
        "event_id AS attempt", "user_id AS id", f"{RAW_ANSWER} AS raw", f"{RAW_CLASS} AS raw_class",
        "event_type <> 'error' AS ok", "CAST(round(value * 100) AS BIGINT) AS cents",
    )


ANSWER_CTE = f"""answer_log AS (SELECT event_id AS attempt, user_id AS id, {RAW_ANSWER} AS raw, {RAW_CLASS} AS raw_class,
  event_type <> 'error' AS ok, CAST(round(value * 100) AS BIGINT) AS cents FROM events)"""
