"""Cleaning, projections and filters."""

from pyspark.sql import functions as F

from pairforge.bindings import query
from pairforge.bindings.inputs import (
    EXECUTION_CTE, QUERY_CTE, ROW_CTE, executions, query_texts, question_rows, table,
)
from pairforge.functions import text as tx
from pairforge.operators import annotate as an
from pairforge.operators import assemble as asm
from pairforge.operators import clean as cl
from pairforge.operators import outcomes as oc
from pairforge.operators.ordered import dense_index
from pairforge.session import spread

# The fold by another way: strip accents, widen the sharp s, and drop what is left outside ASCII.
_FOLD = "regexp_replace(strip_accents(replace({0}, 'ß', 'ss')), '[^\\x00-\\x7F]', '', 'g')"
_SPACE = r"""regexp_replace(regexp_replace(regexp_replace({0}, '\s*\n\s*', chr(10), 'g'), '[ \t]+', ' ', 'g'), '^\s+|\s+$', '', 'g')"""


def _normal(column: str) -> str:
    return _SPACE.format(_FOLD.format(column))


def _trimmed(text: str) -> str:
    return f"replace(regexp_replace({text}, '^\\s+|\\s+$', '', 'g'), chr(10) || chr(10), chr(10))"


@query("C1_normalise_text", f"SELECT doc_id, {_normal('text')} AS text FROM documents")
def normalise_text(spark, sf):
    return spread(table(spark, sf, "documents")).select("doc_id", tx.normalise_text(F.col("text")).alias("text"))


@query(
    "C2_strip_preamble",
    f"""WITH {QUERY_CTE} SELECT id, CASE WHEN instr(upper(query), 'SELECT') > 0
  THEN substr(query, instr(upper(query), 'SELECT')) ELSE query END AS query FROM queries""",
)
def strip_preamble(spark, sf):
    return query_texts(spark, sf).withColumn("query", tx.strip_preamble(F.col("query")))


@query("C3_first_metadata", "SELECT page_id, url AS description, html AS context FROM pages")
def first_metadata(spark, sf):
    entry = F.struct(F.col("url").alias("description"), F.col("html").alias("context"))
    other = F.struct(F.lit("x").alias("description"), F.lit("y").alias("context"))
    return cl.first_metadata(table(spark, sf, "pages").select("page_id", F.array(entry, other).alias("metadata")))


_MARKUP = r"""regexp_replace({0}, '</?[a-zA-z?;="'' ]*>|<.+[\W]>', ' ', 'g')"""
_STYLE = """regexp_replace({0}, '(?:class|colspan|style|rowspan)=".+"', ' ', 'g')"""
_URL = "regexp_replace({0}, 'https:[a-zA-Z%:./#_0-9]+', ' ', 'g')"


@query("C4_remove_markup", f"SELECT page_id, {_MARKUP.format('html')} AS text FROM pages")
def remove_markup(spark, sf):
    return spread(table(spark, sf, "pages")).select("page_id", tx.remove_markup(F.col("html")).alias("text"))


@query("C5_remove_style_attributes", f"SELECT page_id, {_STYLE.format('html')} AS text FROM pages")
def remove_style(spark, sf):
    return spread(table(spark, sf, "pages")).select("page_id", tx.remove_style_attributes(F.col("html")).alias("text"))


@query("C6_remove_urls", f"SELECT page_id, {_URL.format('url || chr(10) || html')} AS text FROM pages")
def remove_urls(spark, sf):
    both = F.concat("url", F.lit("\n"), "html")
    return spread(table(spark, sf, "pages")).select("page_id", tx.remove_urls(both).alias("text"))


_LOOSE = "' ' || replace(text, '. ', chr(10) || chr(10) || chr(10)) || chr(9) || chr(10)"


@query("C7_post_trim", f"SELECT doc_id, {_trimmed(_LOOSE)} AS text FROM documents")
def post_trim(spark, sf):
    return spread(table(spark, sf, "documents")).select("doc_id", tx.post_trim(F.expr(_LOOSE)).alias("text"))


@query(
    "C8_remove_styling",
    f"""SELECT page_id AS id, url AS query, {_trimmed(_URL.format("url || ' ' || html"))} AS description,
  {_trimmed(_MARKUP.format(_STYLE.format('html')))} AS context FROM pages""",
)
def remove_styling(spark, sf):
    records = table(spark, sf, "pages").selectExpr(
        "page_id AS id", "url AS query", "url || ' ' || html AS description", "html AS context"
    )
    return cl.remove_styling(records)


@query(
    "C1_C3_clean_queries",
    f"""SELECT c_custkey AS id, {_normal("'éa  ' || c_name")} AS description, {_normal('c_mktsegment')} AS context,
  'SELECT ?x {{ wd:Q' || c_custkey || ' }}' AS query FROM customer""",
)
def clean_queries(spark, sf):
    records = table(spark, sf, "customer").selectExpr(
        "c_custkey AS id",
        "'#défaut View:Map' || chr(13) || chr(10) || chr(10) || 'SELECT  ?x { wd:Q' || c_custkey || ' } ' AS query",
        "array(struct('éa  ' || c_name AS description, c_mktsegment AS context)) AS metadata",
    )
    return cl.clean_queries(records)


@query(
    "C9_strip_comments",
    f"""WITH {QUERY_CTE}, cut AS (SELECT id, query, instr(upper(query), 'SELECT') AS pos FROM queries)
SELECT id, regexp_replace(substr(query, 1, pos - 1), '(?m)^\\s*#.*\\n', '', 'g') || 'SELECT' || substr(query, pos + 6) AS query FROM cut""",
)
def strip_comments(spark, sf):
    return cl.strip_comments(query_texts(spark, sf))


@query(
    "C10_label_slug",
    "SELECT p_partkey, replace(regexp_replace(p_name || ' (' || p_brand || ')', '[^a-zA-Z0-9 ]', '', 'g'), ' ', '_') AS slug FROM part",
)
def label_slug(spark, sf):
    return table(spark, sf, "part").select(
        "p_partkey", tx.label_slug(F.expr("p_name || ' (' || p_brand || ')'")).alias("slug")
    )


_PARSED = "CASE WHEN event_id % 3 = 0 THEN 'Query syntax parsing failed with the following error: ' || props ELSE 'SelectQuery' END"


@query(
    "C11_ids_and_validity",
    f"""SELECT row_number() OVER (ORDER BY user_id, event_id) - 1 AS id, event_id,
  NOT starts_with({_PARSED}, 'Query syntax parsing failed') AS valid FROM events""",
)
def ids_and_validity(spark, sf):
    rows = table(spark, sf, "events").selectExpr("event_id", "user_id", f"{_PARSED} AS parsed_query")
    return an.flag_parses(dense_index(rows, ["user_id", "event_id"], "id")).select("id", "event_id", "valid")


@query(
    "C11_invalid_count",
    f"SELECT count(*) AS n, count(*) FILTER (WHERE starts_with({_PARSED}, 'Query syntax parsing failed')) AS n_invalid FROM events",
)
def invalid_count(spark, sf):
    rows = an.flag_parses(table(spark, sf, "events").selectExpr(f"{_PARSED} AS parsed_query"))
    return rows.agg(F.count("*").alias("n"), F.count_if(~F.col("valid")).alias("n_invalid"))


@query("C12_word_count_filter", "SELECT doc_id, n_chars FROM documents WHERE len(string_split(text, ' ')) < 300")
def word_count_filter(spark, sf):
    return cl.shorter_than(table(spark, sf, "documents"), "text", 300).select("doc_id", "n_chars")


_DROP = "SELECT doc_id FROM labels WHERE quality = 0"


@query("C13_drop_listed_ids", f"SELECT doc_id, source FROM documents WHERE doc_id NOT IN ({_DROP})")
def drop_listed(spark, sf):
    listed = table(spark, sf, "labels").where("quality = 0")
    return cl.drop_ids(table(spark, sf, "documents"), listed, "doc_id").select("doc_id", "source")


@query(
    "C13_drop_exact_copies",
    f"SELECT min(doc_id) AS doc_id FROM documents GROUP BY lower({_normal('text')})",
)
def drop_copies(spark, sf):
    docs = spread(table(spark, sf, "documents"))
    return cl.drop_exact_copies(docs, F.lower(tx.normalise_text(F.col("text"))), "doc_id").select("doc_id")


@query(
    "C14_drop_rename_reorder",
    f"""WITH {ROW_CTE} SELECT id, len(instructions)::INT AS n_instructions, sparql_query AS query, complexity FROM question_rows""",
)
def drop_rename_reorder(spark, sf):
    rows = question_rows(spark, sf).drop("sparql_raw", "sparql_annotated", "complexity_description", "query_results", "split")
    return rows.select("id", F.size("instructions").alias("n_instructions"), F.col("sparql_query").alias("query"), "complexity")


@query(
    "C15_published_types",
    f"""WITH {ROW_CTE} SELECT id::BIGINT AS id, array_to_string(instructions, '|') AS instructions, sparql_raw, sparql_annotated,
  sparql_query, complexity, complexity_description, query_results FROM question_rows""",
)
def published_types(spark, sf):
    rows = asm.published(question_rows(spark, sf))
    return rows.withColumn("instructions", F.array_join("instructions", "|"))


@query("C16_first_rows", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_orderkey LIMIT 25")
def first_rows(spark, sf):
    return cl.first_rows(table(spark, sf, "orders"), 25, "o_orderkey").select("o_orderkey", "o_totalprice")


@query(
    "C17_outcome_subset",
    f"WITH {EXECUTION_CTE} SELECT id, variant FROM executions WHERE execution <> 'timeout' AND starts_with(execution, '[]')",
)
def outcome_subset(spark, sf):
    return oc.outcome_subset(executions(spark, sf), "empty").select("id", "variant")
