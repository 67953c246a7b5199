"""Assembly of the published tables."""

from pyspark.sql import functions as F

from pairforge.bindings import query
from pairforge.bindings.inputs import ROW_CTE, question_rows, sql_draw, table
from pairforge.operators import assemble as asm


@query(
    "D1_reindexed",
    """SELECT o_orderkey AS id, row_number() OVER (ORDER BY o_orderkey) - 1 AS "index" FROM orders
  WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_quantity >= 49)""",
)
def reindexed(spark, sf):
    rows = table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"))
    listed = table(spark, sf, "lineitem").where("l_quantity >= 49").select(F.col("l_orderkey").alias("id"))
    return asm.reindexed_without(rows, listed)


@query(
    "D2_enriched",
    """SELECT d.doc_id AS id, d.lang, coalesce(l.quality, -1)::INT AS quality, coalesce(i.note, '') AS note FROM documents d
  LEFT JOIN labels l ON l.doc_id = d.doc_id LEFT JOIN (SELECT item_id, text AS note FROM benchmark) i ON i.item_id = d.doc_id""",
)
def enriched(spark, sf):
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "lang")
    marks = table(spark, sf, "labels").select(F.col("doc_id").alias("id"), "quality")
    notes = table(spark, sf, "benchmark").select(F.col("item_id").alias("id"), F.col("text").alias("note"))
    return asm.enriched(docs, marks, notes).na.fill({"quality": -1, "note": ""})


@query("D3_routed_splits", f"WITH {ROW_CTE} SELECT id, split, 'no_limit' AS variant FROM question_rows UNION ALL SELECT id, 'full', 'no_limit' FROM question_rows")
def routed(spark, sf):
    rows = question_rows(spark, sf).select("id", "split")
    parts = {name: rows.where(F.col("split") == name).drop("split") for name in ("train", "validation", "test")}
    return asm.routed({"full": rows.drop("split"), **parts}, "no_limit")


@query(
    "D4_first_instructions",
    f"WITH {ROW_CTE} SELECT id, unnest(instructions[1:2]) AS instruction, complexity FROM question_rows",
)
def first_instructions(spark, sf):
    return asm.first_instructions(question_rows(spark, sf), 2).select("id", "instruction", "complexity")


@query(
    "D5_sampled_instructions",
    f"""WITH {ROW_CTE} SELECT id, d::INT AS draw, instructions[1 + ({sql_draw(7, 'id', 'd')} % len(instructions))::INT] AS instruction
  FROM question_rows, (VALUES (0), (1), (2)) v(d)""",
)
def sampled_instructions(spark, sf):
    return asm.sampled_instructions(question_rows(spark, sf), 3, seed=7).select("id", "draw", "instruction")


@query("D7_first_instruction", f"WITH {ROW_CTE} SELECT id, instructions[1] AS instruction FROM question_rows")
def first_instruction(spark, sf):
    return asm.first_instruction(question_rows(spark, sf)).select("id", "instruction")
