"""Tables around an external text model."""

from pyspark.sql import functions as F

from pairforge.bindings import query
from pairforge.bindings.inputs import ANSWER_CTE, QUERY_CTE, answer_log, query_texts, table
from pairforge.fixed_values import COMPLEXITY_PROMPT, INSTRUCTION_PROMPT
from pairforge.operators import responses as rs


def _sql_text(text: str) -> str:
    """A SQL expression for a text with line breaks."""
    return "'" + text.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"


_FENCED = "'SPARQL query: ```' || query || '```' || chr(10)"
_CONTEXT = "c_mktsegment"
_DESCRIPTION = "CASE WHEN c_custkey % 3 = 0 THEN '' ELSE c_name END"
_SEED_CTE = f"""{QUERY_CTE}, seeds AS (SELECT q.id, q.query, {_CONTEXT} AS context, {_DESCRIPTION} AS description
  FROM queries q JOIN customer c ON c.c_custkey = q.id)"""


def _seeds(spark, sf):
    about = table(spark, sf, "customer").selectExpr("c_custkey AS id", f"{_CONTEXT} AS context", f"{_DESCRIPTION} AS description")
    return query_texts(spark, sf).join(about, "id")


def _contents(messages):
    return F.array_join(F.transform(messages, lambda m: F.concat(m["role"], F.lit(": "), m["content"])), "|")


@query(
    "L1_instruction_prompt",
    f"""WITH {_SEED_CTE} SELECT id, 'system: ' || {_sql_text(INSTRUCTION_PROMPT)} || '|user: Context: "' || context || '"' || chr(10)
  || CASE WHEN description <> '' THEN 'Description: "' || description || '"' || chr(10) || chr(10) ELSE '' END || {_FENCED} AS prompt FROM seeds""",
)
def instruction_prompt(spark, sf):
    return _seeds(spark, sf).select("id", _contents(rs.instruction_messages()).alias("prompt"))


@query(
    "L1_instruction_prompt_without_context",
    f"""WITH {_SEED_CTE} SELECT id, 'system: ' || {_sql_text(INSTRUCTION_PROMPT)} || '|user: '
  || CASE WHEN description <> '' THEN 'Context: "' || description || '"' || chr(10) || chr(10) ELSE '' END || {_FENCED} AS prompt FROM seeds""",
)
def instruction_prompt_without_context(spark, sf):
    return _seeds(spark, sf).select("id", _contents(rs.instruction_messages(with_context=False)).alias("prompt"))


@query(
    "L2_complexity_prompt",
    f"WITH {_SEED_CTE} SELECT id, 'system: ' || {_sql_text(COMPLEXITY_PROMPT)} || '|user: ' || {_FENCED} AS prompt FROM seeds",
)
def complexity_prompt(spark, sf):
    return _seeds(spark, sf).select("id", _contents(rs.complexity_messages()).alias("prompt"))


def _count(text):
    return f"len(regexp_extract_all({text}, '[A-Za-z0-9_]+|[^A-Za-z0-9_\\s]'))"


# Two messages, each with its role as one token; 4 (or 3) more per message and 3 for the reply.
_TOKEN_CTE = f"""{_SEED_CTE}, chats AS (SELECT id, (2 * 4 + 3 + 2 + {_count(_sql_text(COMPLEXITY_PROMPT))} + {_count(_FENCED)})::INT AS tokens FROM seeds)"""


@query("L3_message_tokens", f"WITH {_TOKEN_CTE} SELECT id, tokens FROM chats")
def message_tokens(spark, sf):
    return _seeds(spark, sf).select("id", rs.message_tokens(rs.complexity_messages()).alias("tokens"))


@query(
    "L4_cost_estimate",
    f"""WITH {_TOKEN_CTE} SELECT sum(tokens)::BIGINT AS total_tokens, round(avg(tokens), 6)::DOUBLE AS mean_tokens, max(tokens) AS max_tokens,
  round(sum(tokens) / 1000 * 0.002, 6)::DOUBLE AS cost FROM chats""",
)
def cost_estimate(spark, sf):
    return rs.cost_estimate(message_tokens(spark, sf)).withColumns(
        {"mean_tokens": F.round("mean_tokens", 6), "cost": F.round("cost", 6)}
    )


@query(
    "L5_within_budget",
    f"""WITH {ANSWER_CTE}, s AS (SELECT attempt, cents, sum(cents) OVER (ORDER BY attempt) AS spent, sum(cents) OVER () * 0.4 AS budget FROM answer_log)
SELECT attempt, spent::BIGINT AS spent FROM s WHERE spent - cents < budget""",
)
def within_budget(spark, sf):
    log = answer_log(spark, sf)
    budget = log.agg(F.sum("cents") * F.lit(0.4)).first()[0]
    return rs.within_budget(log, ["attempt"], "cents", float(budget)).select("attempt", "spent")


_VALID_CTE = f"""{ANSWER_CTE}, checked AS (SELECT *, CASE event_kind WHEN 0 THEN true WHEN 1 THEN true ELSE false END AS valid
  FROM (SELECT *, attempt % 6 AS event_kind FROM answer_log)),
parsed AS (SELECT *, json_valid(raw) AND json_type(CASE WHEN json_valid(raw) THEN raw ELSE 'null' END) = 'OBJECT'
    AND (json_exists(CASE WHEN json_valid(raw) THEN raw ELSE 'null' END, '$.instructions')
      OR json_exists(CASE WHEN json_valid(raw) THEN raw ELSE 'null' END, '$.nl_generation')) AS is_valid FROM checked)"""


@query(
    "L6_parsed_instructions",
    f"""WITH {_VALID_CTE} SELECT attempt, is_valid AS valid, CASE WHEN is_valid THEN
  array_to_string(coalesce(json_extract(raw, '$.instructions')::VARCHAR[], json_extract(raw, '$.nl_generation')::VARCHAR[]), '|') ELSE '' END AS instructions
  FROM parsed""",
)
def parsed_instructions(spark, sf):
    rows = rs.parsed_instructions(answer_log(spark, sf))
    return rows.select("attempt", "valid", F.coalesce(F.array_join("instructions", "|"), F.lit("")).alias("instructions"))


@query(
    "L6_parsed_complexity",
    f"""WITH {ANSWER_CTE}, j AS (SELECT attempt, CASE WHEN json_valid(raw_class) THEN raw_class ELSE 'null' END AS doc FROM answer_log)
SELECT attempt, coalesce(json_extract_string(doc, '$.complexity'), '') AS complexity,
  coalesce(json_extract_string(doc, '$.complexity_description'), '') AS complexity_description,
  coalesce(json_exists(doc, '$.complexity') AND json_exists(doc, '$.complexity_description'), false) AS valid,
  coalesce(json_extract_string(doc, '$.complexity') IN ('simple', 'medium', 'complex'), false) AS known FROM j""",
)
def parsed_complexity(spark, sf):
    rows = rs.parsed_complexity(answer_log(spark, sf), "raw_class")
    return rows.select("attempt", "complexity", "complexity_description", "valid", "known").na.fill("")


# Half of the answers: what was in the store before the last run.
_OLD, _NEW = "attempt % 2 = 0", "attempt % 2 = 1"


def _log(spark, sf):
    return answer_log(spark, sf).withColumnRenamed("ok", "valid").select("id", "attempt", "valid", "raw")


@query(
    "L7_pending",
    f"""WITH {ANSWER_CTE} SELECT c_custkey AS id FROM customer
  WHERE c_custkey NOT IN (SELECT id FROM answer_log WHERE ok)""",
)
def pending(spark, sf):
    seeds = table(spark, sf, "customer").select(F.col("c_custkey").alias("id"))
    return rs.pending(seeds, _log(spark, sf))


@query(
    "L8_upserted",
    f"""WITH {ANSWER_CTE} SELECT id, attempt, ok AS valid, raw FROM answer_log QUALIFY row_number() OVER (PARTITION BY id ORDER BY attempt DESC) = 1""",
)
def upserted(spark, sf):
    log = _log(spark, sf)
    return rs.upserted(log.where(_OLD), log.where(_NEW))


@query(
    "L9_extended",
    f"""WITH {_VALID_CTE}, answers AS (SELECT id, max_by(raw, attempt) AS raw FROM parsed WHERE is_valid GROUP BY id)
SELECT c_custkey AS id, c_name, coalesce(array_to_string(coalesce(json_extract(raw, '$.instructions')::VARCHAR[],
  json_extract(raw, '$.nl_generation')::VARCHAR[]), '|'), '') AS instructions FROM customer LEFT JOIN answers ON id = c_custkey""",
)
def extended(spark, sf):
    answers = rs.latest(rs.parsed_instructions(answer_log(spark, sf)).where("valid").select("id", "attempt", "instructions"))
    seeds = table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), "c_name")
    rows = rs.extended(seeds, answers)
    return rows.withColumn("instructions", F.coalesce(F.array_join("instructions", "|"), F.lit("")))


@query("L10_progress", f"WITH {ANSWER_CTE} SELECT count(*) AS done, count(*) FILTER (WHERE NOT ok) AS invalid FROM answer_log")
def progress(spark, sf):
    return rs.progress(_log(spark, sf))
