"""Sources and sinks: each query writes rows of a shared table and reads them back."""

from pyspark.sql import functions as F

from pairforge.bindings import query
from pairforge.bindings.inputs import EXECUTION_CTE, ROW_CTE, executions, question_rows, table
from pairforge.bindings.outcomes import _CTE as ERROR_CTE
from pairforge.bindings.retrieve import _RANK_CTE, ranked
from pairforge.operators import outcomes as oc
from pairforge.operators import retrieve as rt
from pairforge.operators import scoring as sc
from pairforge.session import shared_path
from pairforge.sources import readers as rd
from pairforge.sources import writers as wr

_TITLES = ["src0", "src3", "src5"]


@query("S1_pages", "SELECT doc_id AS page_id, source AS title, text FROM documents WHERE source IN ('src0', 'src3', 'src5')")
def pages(spark, sf):
    path = shared_path(spark, "pages")
    wr.write_parquet(table(spark, sf, "documents").selectExpr("doc_id AS page_id", "source AS title", "text"), path)
    return rd.pages(spark, path, _TITLES)


@query(
    "S2_json_arrays",
    """SELECT url AS query, html AS description, page_id::VARCHAR AS context FROM pages
  UNION ALL SELECT 'second ' || page_id, '', '' FROM pages""",
)
def json_arrays(spark, sf):
    def record(query, description, context):
        entry = F.struct(F.expr(description).alias("description"), F.expr(context).alias("context"))
        return F.struct(F.expr(query).alias("query"), F.array(entry).alias("metadata"))

    both = F.array(record("url", "html", "string(page_id)"), record("'second ' || page_id", "''", "''"))
    path = shared_path(spark, "arrays")
    wr.write_json_arrays(table(spark, sf, "pages").select(F.inline(both)), path)
    return rd.json_records(spark, path, rd.RAW_QUERY).select("query", F.inline("metadata"))


@query("S3_columnar_json", "SELECT p_partkey AS idx, p_name AS query, p_type AS context, p_retailprice::VARCHAR AS price FROM part")
def columnar_json(spark, sf):
    path = shared_path(spark, "columns")
    rows = table(spark, sf, "part").selectExpr("p_partkey AS idx", "p_name AS query", "p_type AS context", "p_retailprice AS price")
    wr.write_columnar_json(rows, path, "idx")
    return rd.columnar_json(spark, path, ["query", "context", "price"]).drop("doc")


@query(
    "S3_columnar_texts",
    """SELECT p_partkey AS doc, 0::BIGINT AS idx, p_name AS query, '' AS context FROM part
  UNION ALL SELECT p_partkey, 1, p_brand, p_type FROM part""",
)
def columnar_texts(spark, sf):
    cells = F.create_map(
        F.lit("query"), F.create_map(F.lit("0"), F.col("p_name"), F.lit("1"), F.col("p_brand")),
        F.lit("context"), F.create_map(F.lit("1"), F.col("p_type")),
    )
    docs = table(spark, sf, "part").select(F.col("p_partkey").alias("doc"), F.to_json(cells).alias("json"))
    return rd.columnar_rows(docs, ["query", "context"]).na.fill({"context": ""})


@query("S4_table_by_suffix", "SELECT o_orderkey, o_orderstatus, 'parquet' AS kind FROM orders UNION ALL SELECT c_custkey, c_name, 'json' FROM customer")
def table_by_suffix(spark, sf):
    first, second = shared_path(spark, "orders") + ".parquet.gzip", shared_path(spark, "customers") + ".json"
    wr.write_parquet(table(spark, sf, "orders"), first, "gzip")
    wr.write_json(table(spark, sf, "customer"), second)
    orders = rd.table_by_suffix(spark, first).selectExpr("o_orderkey", "o_orderstatus", "'parquet' AS kind")
    customers = rd.table_by_suffix(spark, second, "c_custkey bigint, c_name string", lines=True)
    return orders.union(customers.withColumn("kind", F.lit("json")))


@query("S5_csv_table", "SELECT conv_id::VARCHAR AS conv_id, turn::VARCHAR AS turn, '\"q\", ' || chr(10) || chr(10) || text || chr(10) AS text FROM conversations")
def csv_table(spark, sf):
    path = shared_path(spark, "turns")
    wr.write_csv(table(spark, sf, "conversations").selectExpr("conv_id", "turn", "'\"q\", ' || char(10) || char(10) || text || char(10) AS text"), path)
    return rd.csv_table(spark, path)


@query(
    "S6_column_mapping",
    "SELECT DISTINCT trim(c_name) AS a, c_mktsegment AS b FROM customer WHERE c_custkey % 2 = 0",
)
def column_mapping(spark, sf):
    path = shared_path(spark, "mapping")
    line = "CASE WHEN c_custkey % 2 = 0 THEN '<' || c_name || '>, < ' || c_mktsegment || '>' ELSE c_name END"
    table(spark, sf, "customer").selectExpr(f"{line} AS value").write.text(path)
    return rd.column_mapping(spark, path)


_PUBLISHED = "id::BIGINT AS id, array_to_string(instructions, '|') AS instructions, sparql_query, complexity"


@query("S7_dataset_split", f"WITH {ROW_CTE} SELECT {_PUBLISHED} FROM question_rows WHERE split = 'test'")
def dataset_split(spark, sf):
    root = shared_path(spark, "dataset")
    wr.write_dataset(question_rows(spark, sf), f"{root}/no_limit")
    rows = rd.dataset(spark, root, "no_limit", "test")
    return rows.select("id", F.array_join("instructions", "|").alias("instructions"), "sparql_query", "complexity")


@query("S8_neighbour_index", f"WITH {_RANK_CTE} SELECT query_id, rank::INT AS rank, base_id FROM ranked")
def neighbour_index(spark, sf):
    path = shared_path(spark, "neighbours")
    wr.write_neighbour_index(rt.neighbour_lists(ranked(spark, sf)), path)
    return rd.neighbour_index(spark.read.text(path))


@query("S9_json_sink", "SELECT c_custkey, c_name, c_acctbal FROM customer")
def json_sink(spark, sf):
    path = shared_path(spark, "customers")
    wr.write_json(table(spark, sf, "customer"), path)
    return rd.json_lines(spark, path, "c_custkey bigint, c_name string, c_acctbal double")


@query("S10_parquet_sink", "SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem")
def parquet_sink(spark, sf):
    path = shared_path(spark, "lines")
    wr.write_parquet(table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice"), path, "gzip")
    return spark.read.parquet(path)


@query("S11_csv_sink", f"WITH {EXECUTION_CTE} SELECT id, variant, execution FROM executions")
def csv_sink(spark, sf):
    path = shared_path(spark, "executions")
    wr.write_csv(executions(spark, sf), path)
    return rd.csv_table(spark, path, "id bigint, variant string, execution string")


@query("S12_typed_export", f"WITH {ROW_CTE} SELECT split, {_PUBLISHED} FROM question_rows")
def typed_export(spark, sf):
    path = shared_path(spark, "export")
    wr.write_dataset(question_rows(spark, sf), path, max_rows_per_file=200)
    rows = rd.dataset(spark, path)
    return rows.select("split", "id", F.array_join("instructions", "|").alias("instructions"), "sparql_query", "complexity")


@query("S12_shards_by_bytes", f"WITH {ROW_CTE} SELECT split, {_PUBLISHED} FROM question_rows")
def shards_by_bytes(spark, sf):
    path = shared_path(spark, "shards")
    wr.write_dataset(question_rows(spark, sf), path, max_bytes_per_file=2_000_000)
    rows = rd.dataset(spark, path)
    return rows.select("split", "id", F.array_join("instructions", "|").alias("instructions"), "sparql_query", "complexity")


@query(
    "S13_error_map_sink",
    f"""WITH {ERROR_CTE} SELECT coalesce(error_type, 'none') AS message, id // 10000 AS part, count(*) AS n,
  string_agg(id, ',' ORDER BY id) AS rows FROM errors GROUP BY 1, 2""",
)
def error_map_sink(spark, sf):
    errors = oc.with_errors(executions(spark, sf)).selectExpr("coalesce(error_type, 'none') AS message", "id")
    path = shared_path(spark, "errors")
    wr.write_error_map(sc.error_map(errors), path)
    rows = rd.json_lines(spark, path, "message string, part bigint, rows array<bigint>, n bigint")
    return rows.withColumn("rows", F.array_join("rows", ","))
