"""Few-shot retrieval."""

from pyspark.sql import functions as F

from pairforge.bindings import query
from pairforge.bindings.inputs import ROW_CTE, question_rows, table
from pairforge.operators import retrieve as rt
from pairforge.plans import training

_RANK_CTE = """vectors AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings),
scored AS (SELECT q.vec_id AS query_id, b.vec_id AS base_id,
    round(list_dot_product(q.v, b.v) / (sqrt(list_dot_product(q.v, q.v)) * sqrt(list_dot_product(b.v, b.v))), 9) AS similarity
  FROM vectors q JOIN vectors b ON q.vec_id % 10 = 0 AND b.vec_id % 10 <> 0),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, base_id) AS rank FROM scored
  QUALIFY rank <= 10)"""


def ranked(spark, sf, **blocks):
    """Every tenth vector asks, the others answer."""
    vectors = table(spark, sf, "embeddings")
    asked = vectors.where("vec_id % 10 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    base = vectors.where("vec_id % 10 <> 0").select(F.col("vec_id").alias("base_id"), F.col("embedding").alias("vector"))
    return rt.cosine_top_k(asked, base, 10, **blocks)


@query("D8_D9_cosine_top_k", f"WITH {_RANK_CTE} SELECT query_id, base_id, rank::INT AS rank, round(similarity, 6) AS similarity FROM ranked")
def cosine_top_k(spark, sf):
    return ranked(spark, sf).withColumn("similarity", F.round("similarity", 6))


@query(
    "D10_neighbour_lists",
    f"WITH {_RANK_CTE} SELECT query_id, string_agg(base_id, ',' ORDER BY rank) AS neighbours FROM ranked GROUP BY query_id",
)
def neighbour_lists(spark, sf):
    return rt.neighbour_lists(ranked(spark, sf)).withColumn("neighbours", F.array_join("neighbours", ","))


_SHOT_CTE = f"""{_RANK_CTE}, {ROW_CTE},
shots AS (SELECT query_id, rank, '- User: ' || instructions[1] || chr(10) || 'Answer: Here is the SPARQL query: ' || chr(10) || '[QUERY]' || chr(10)
    || sparql_query || chr(10) || '[/QUERY]' || chr(10) AS text FROM ranked JOIN question_rows ON base_id = id)"""


def _train(spark, sf):
    return question_rows(spark, sf).select(
        F.col("id").alias("base_id"), F.get("instructions", F.lit(0)).alias("instruction"), "sparql_query"
    )


@query(
    "D11_shot_blocks",
    f"""WITH {_SHOT_CTE} SELECT query_id, 'Examples:' || chr(10) || coalesce(string_agg(text, '' ORDER BY rank), '') AS few_shots
  FROM ranked LEFT JOIN shots USING (query_id, rank) WHERE rank <= 3 GROUP BY query_id""",
)
def shot_blocks(spark, sf):
    return rt.shot_blocks(ranked(spark, sf), _train(spark, sf), 3)


@query(
    "D9_D11_few_shot_job",
    f"""WITH {ROW_CTE}, vectors AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings),
asked AS (SELECT id, v FROM question_rows JOIN vectors ON id = vec_id WHERE split = 'test'),
pool AS (SELECT id, v, instructions, sparql_query FROM question_rows JOIN vectors ON id = vec_id WHERE split = 'train' AND len(string_split(sparql_raw, ' ')) < 300),
scored AS (SELECT q.id AS query_id, b.id AS base_id, round(list_dot_product(q.v, b.v) / (sqrt(list_dot_product(q.v, q.v)) * sqrt(list_dot_product(b.v, b.v))), 9) AS similarity,
    '- User: ' || instructions[1] || chr(10) || 'Answer: Here is the SPARQL query: ' || chr(10) || '[QUERY]' || chr(10) || sparql_query || chr(10) || '[/QUERY]' || chr(10) AS text
  FROM asked q, pool b),
best AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, base_id) AS rank FROM scored QUALIFY rank <= 5)
SELECT query_id, string_agg(base_id, ',' ORDER BY rank) AS neighbours, 'Examples:' || chr(10) || string_agg(text, '' ORDER BY rank) FILTER (WHERE rank <= 2) AS few_shots
  FROM best GROUP BY query_id""",
)
def few_shot_job(spark, sf):
    rows = question_rows(spark, sf)
    vectors = table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    found = training.few_shots(rows.where("split = 'test'"), rows.where("split = 'train'"), vectors, k=5, shots=2, length_of="sparql_raw")
    return found.withColumn("neighbours", F.array_join("neighbours", ","))


@query("D11_retrieval_pool", f"WITH {ROW_CTE} SELECT id FROM question_rows WHERE len(string_split(sparql_raw, ' ')) < 300 AND split = 'train'")
def retrieval_pool(spark, sf):
    return rt.retrieval_pool(question_rows(spark, sf).where("split = 'train'"), "sparql_raw").select("id")


@query(
    "D12_sweep",
    f"""WITH {ROW_CTE} SELECT id, shots::INT AS shots, model FROM question_rows, (VALUES (0), (3), (5)) s(shots), (VALUES ('small'), ('large')) m(model)
  WHERE split = 'test'""",
)
def sweep(spark, sf):
    rows = question_rows(spark, sf).where("split = 'test'").select("id")
    return rt.sweep(rows, shots=[0, 3, 5], model=["small", "large"])
