"""Execution outcomes and error classes."""

from pyspark.sql import functions as F

from pairforge.bindings import query
from pairforge.bindings.inputs import EXECUTION_CTE, VARIANTS, executions
from pairforge.fixed_values import ERROR_INDEX
from pairforge.operators import outcomes as oc

_TIMEOUT = "java.util.concurrent.TimeoutException"
_NUMBERS = ", ".join("('%s', %d)" % (k.replace("'", "''"), v) for k, v in ERROR_INDEX.items())
_CTE = f"""{EXECUTION_CTE},
classed AS (SELECT *, CASE WHEN execution = 'timeout' THEN 'timeout' WHEN starts_with(execution, '[]') THEN 'empty'
    WHEN starts_with(execution, 'exception') THEN 'fail' ELSE 'no_errors' END AS outcome FROM executions),
typed AS (SELECT *, CASE WHEN regexp_matches(execution, '^exception: [0-9]+') THEN regexp_extract(execution, '^exception: ([0-9]+)', 1)
    WHEN contains(execution, 'exception: module ''requests.exceptions''') THEN 'requests'
    WHEN contains(execution, '{_TIMEOUT}') THEN 'server timeout'
    WHEN contains(execution, 'exception: query is empty') THEN 'empty query' END AS error_type
  FROM classed WHERE outcome = 'fail'),
caused AS (SELECT *, list_extract(regexp_extract_all(execution, 'Caused by: .+'), -1) AS cause FROM typed),
tag_rows AS (SELECT id, 1 AS k, 'undefined prefix' AS tag FROM caused WHERE error_type = '400' AND contains(cause, 'undefined prefix')
  UNION ALL SELECT id, 2, 'parse exception due to limit' FROM caused WHERE error_type = '400' AND contains(cause, 'ast.ParseException') AND regexp_matches(cause, 'limit|LIMIT')
  UNION ALL SELECT id, 3, 'parse exception' FROM caused WHERE error_type = '400' AND contains(cause, 'ast.ParseException') AND NOT regexp_matches(cause, 'limit|LIMIT')
  UNION ALL SELECT id, 4, 'lexical error' FROM caused WHERE error_type = '400' AND contains(cause, 'Lexical error')
  UNION ALL SELECT id, 5, 'non-aggregate variable in select expression' FROM caused WHERE error_type = '400' AND contains(cause, 'Non-aggregate variable in select expression')
  UNION ALL SELECT id, 6, 'Prefix duplicates' FROM caused WHERE error_type = '400' AND contains(cause, 'Multiple prefix declarations for prefix')
  UNION ALL SELECT id, 1, 'stack overflow' FROM caused WHERE error_type = '500' AND contains(cause, 'StackOverflowError')
  UNION ALL SELECT id, 2, 'GeoSpatialSearchException: input could not be resolved as point' FROM caused WHERE error_type = '500' AND contains(cause, 'Input could not be resolved as point')
  UNION ALL SELECT id, 3, 'estimated time to execute too long' FROM caused WHERE error_type = '500' AND contains(cause, 'The estimated execution time')
  UNION ALL SELECT id, 4, 'Out of memory' FROM caused WHERE error_type = '500' AND contains(cause, 'MemoryManagerOutOfMemory')
  UNION ALL SELECT id, 5, 'NullPointerException' FROM caused WHERE error_type = '500' AND contains(cause, 'java.lang.NullPointerException')
  UNION ALL SELECT id, 6, 'Invalid JSON' FROM caused WHERE error_type = '500' AND contains(execution, 'exception: 500 Server Error: the response has an Invalid chunk length')
  UNION ALL SELECT id, 1, 'no attribute ''JSONDecodeError''' FROM caused WHERE error_type = 'requests' AND contains(execution, 'has no attribute ''JSONDecodeError''')
  UNION ALL SELECT id, 1, error_type FROM caused WHERE error_type IN ('server timeout', 'empty query')
  UNION ALL SELECT id, 1, 'other' FROM caused WHERE error_type NOT IN ('400', '500', 'requests', 'server timeout', 'empty query')),
tagged AS (SELECT c.id, c.variant, c.error_type, c.execution, string_agg(tag, ', ' ORDER BY k) AS tags, arg_min(tag, k) AS first_tag
  FROM caused c LEFT JOIN tag_rows t ON c.id = t.id GROUP BY ALL),
numbers(tag, number) AS (VALUES {_NUMBERS}),
errors AS (SELECT t.*, n.number FROM tagged t LEFT JOIN numbers n ON t.first_tag = n.tag)"""


def _errors(spark, sf):
    return oc.with_errors(executions(spark, sf))


def _joined_tags(tags="tags"):
    """Tags as text; no tags at all as null, as the SQL side has them."""
    return F.when(F.size(tags) > 0, F.array_join(tags, ", "))


@query("R1_outcome_class", f"WITH {_CTE} SELECT id, outcome FROM classed")
def outcome_class(spark, sf):
    return oc.with_outcome(executions(spark, sf)).select("id", "outcome")


@query(
    "R2_outcome_counts",
    f"""WITH {_CTE} SELECT l.outcome, count(c.id) AS n, round(100.0 * count(c.id) / (SELECT count(*) FROM classed), 1)::DOUBLE AS share
  FROM (VALUES ('timeout'), ('empty'), ('fail'), ('no_errors')) l(outcome) LEFT JOIN classed c USING (outcome) GROUP BY ALL""",
)
def outcome_counts(spark, sf):
    return oc.outcome_counts(executions(spark, sf))


_BY_VARIANT = ", ".join(f"count(*) FILTER (WHERE variant = '{v}') AS {v}" for v in VARIANTS)


@query("R3_outcomes_by_variant", f"WITH {_CTE} SELECT outcome, {_BY_VARIANT} FROM classed GROUP BY outcome")
def outcomes_by_variant(spark, sf):
    return oc.outcomes_by_variant(executions(spark, sf), VARIANTS)


@query("R4_error_type", f"WITH {_CTE} SELECT id, error_type FROM typed")
def error_type(spark, sf):
    return _errors(spark, sf).select("id", "error_type")


@query(
    "R5_error_type_examples",
    f"""WITH {_CTE} SELECT coalesce(error_type, 'none') AS error_type, count(*) AS n, arg_min(left(execution, 256), id) AS example
  FROM typed GROUP BY 1""",
)
def error_type_examples(spark, sf):
    return oc.error_type_examples(_errors(spark, sf)).na.fill({"error_type": "none"})


def _tags_of(kind):
    return f"WITH {_CTE} SELECT id, tags FROM errors WHERE error_type = '{kind}'"


@query("R6_client_error_tags", _tags_of("400"))
def client_error_tags(spark, sf):
    return _errors(spark, sf).where("error_type = '400'").select("id", _joined_tags(oc.client_error_tags(F.col("execution"))).alias("tags"))


@query("R7_server_error_tags", _tags_of("500"))
def server_error_tags(spark, sf):
    return _errors(spark, sf).where("error_type = '500'").select("id", _joined_tags(oc.server_error_tags(F.col("execution"))).alias("tags"))


@query("R8_request_error_tags", _tags_of("requests"))
def request_error_tags(spark, sf):
    return _errors(spark, sf).where("error_type = 'requests'").select("id", _joined_tags(oc.request_error_tags(F.col("execution"))).alias("tags"))


@query("R9_error_tags", f"WITH {_CTE} SELECT id, error_type, tags FROM errors")
def error_tags(spark, sf):
    return _errors(spark, sf).select("id", "error_type", _joined_tags().alias("tags"))


@query("R10_error_number", f"WITH {_CTE} SELECT id, number::INT AS error_number FROM errors WHERE number IS NOT NULL")
def error_number(spark, sf):
    return _errors(spark, sf).where("error_number is not null").select("id", "error_number")


@query("R11_error_type_counts", f"WITH {_CTE} SELECT error_type, count(*) AS n FROM errors WHERE error_type IS NOT NULL GROUP BY 1")
def error_type_counts(spark, sf):
    return oc.type_counts(_errors(spark, sf))


@query(
    "R11_tag_counts",
    f"WITH {_CTE} SELECT coalesce(tags, '') AS tags, count(*) AS n FROM errors WHERE error_type IS NOT NULL GROUP BY 1",
)
def tag_counts(spark, sf):
    return oc.tag_counts(_errors(spark, sf))


@query("R12_sides_by_variant", f"WITH {_CTE} SELECT error_type, {_BY_VARIANT} FROM errors WHERE error_type IN ('400', '500') GROUP BY 1")
def sides_by_variant(spark, sf):
    return oc.sides_by_variant(_errors(spark, sf), VARIANTS)


@query(
    "R13_tag_index",
    f"""WITH {_CTE}, combos AS (SELECT DISTINCT first_tag AS tag, tags FROM errors WHERE tags IS NOT NULL)
SELECT tag, tags, (row_number() OVER (ORDER BY string_split(tags, ', ')) - 1)::INT AS number FROM combos""",
)
def tag_index(spark, sf):
    return oc.tag_index(_errors(spark, sf))
