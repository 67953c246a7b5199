"""Column profiles and column matching over a catalog of tables."""

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairforge.bindings import query
from pairforge.bindings.inputs import sql_draw, table
from pairforge.fixed_values import PUNCTUATION, SPECIAL_CHARACTERS, UNITS
from pairforge.functions import similarity as sim
from pairforge.functions.sampling import draw
from pairforge.operators import match as mt
from pairforge.operators import profile as pf
from pairforge.operators import tables as tb
from pairforge.plans import matching
from pairforge.session import pinned, shared_path, spread

# Catalog columns as SQL text of both engines: real columns, and some made from them for the rarer types.
CATALOG = {
    "customer": {
        "c_custkey": "CAST(c_custkey AS STRING)", "c_name": "c_name", "c_nationkey": "CAST(c_nationkey AS STRING)",
        "c_acctbal": "CAST(c_acctbal AS STRING)", "c_mktsegment": "c_mktsegment",
        "c_marks": "'--'", "Unnamed: 0": "c_name", "c_sales": "c_custkey || ',000K+'",
    },
    "supplier": {
        "s_suppkey": "CAST(s_suppkey AS STRING)", "s_name": "s_name", "s_nationkey": "CAST(s_nationkey AS STRING)",
        "s_acctbal": "CAST(s_acctbal AS STRING)",
    },
    "orders": {
        "o_orderkey": "CAST(o_orderkey AS STRING)", "o_custkey": "CAST(o_custkey AS STRING)", "o_orderstatus": "o_orderstatus",
        "o_totalprice": "CAST(o_totalprice AS STRING)", "o_orderdate": "left(CAST(o_orderdate AS STRING), 10)",
        "o_orderpriority": "o_orderpriority",
    },
    "lineitem": {
        "l_orderkey": "CAST(l_orderkey AS STRING)", "l_partkey": "CAST(l_partkey AS STRING)", "l_suppkey": "CAST(l_suppkey AS STRING)",
        "l_quantity": "CAST(l_quantity AS STRING)", "l_extendedprice": "CAST(l_extendedprice AS STRING)",
        "l_returnflag": "l_returnflag", "l_shipdate": "left(CAST(l_shipdate AS STRING), 10)",
    },
    "pages": {"page_url": "url", "page_text": "html"},
    "events": {
        "event_ts": "left(CAST(ts AS STRING), 19)", "event_type": "event_type", "event_props": "props",
        "event_day": "event_id % 28 || '日'", "event_note": "CASE WHEN event_id % 50 = 0 THEN '--' ELSE 'n ' || event_id END",
    },
}
# A fixed value: what counts as a URL in a cell.
URL_PATTERN = r"[-a-zA-Z0-9@:%._\+~#=]{1,256}\.[a-zA-Z0-9()]{1,6}\b([-a-zA-Z0-9()@:%_\+.~#?&//=]*)"
_TABLE_PAIRS = [("customer", "supplier"), ("orders", "lineitem"), ("customer", "orders"), ("events", "pages")]


def catalog(spark, sf) -> DataFrame:
    """All cells as (table, column, value); each table is scanned once."""
    parts = []
    for name, columns in CATALOG.items():
        cells = [F.struct(F.lit(c).alias("column"), F.expr(e).alias("value")) for c, e in columns.items()]
        parts.append(spread(table(spark, sf, name)).select(F.lit(name).alias("table"), F.inline(F.array(*cells))))
    return reduce(DataFrame.unionByName, parts)


_CATALOG_CTE = "cells AS (" + " UNION ALL ".join(
    f"""SELECT '{t}' AS "table", '{c}' AS "column", {e} AS value FROM {t}""" for t, cs in CATALOG.items() for c, e in cs.items()
) + ")"


def _pairs_table(spark):
    rows = ", ".join(f"('{a}', '{b}')" for a, b in _TABLE_PAIRS)
    return spark.sql(f"SELECT * FROM VALUES {rows} AS t(left_table, right_table)")


# --- flattening and column filters ------------------------------------------------------------------------

_JSON = """'[{"item": {"type": "uri", "value": "Q' || user_id || '"}, "tags": ["a", {"k": ' || event_id || '}], "n": ' || event_id || '}, {"n": null, "props": '
  || props || ', "deep": {"er": {"x": true}}}, "loose"]'"""


def _json_docs(spark, sf):
    return spread(table(spark, sf, "events")).selectExpr("event_id AS id", f"{_JSON} AS json")


_PROP = "regexp_extract(props, '[0-9]+')"
_LEAVES = f"""SELECT event_id AS id, 0::BIGINT AS row, 'item.type' AS "column", 'uri' AS value FROM events
  UNION ALL SELECT event_id, 0, 'item.value', 'Q' || user_id FROM events UNION ALL SELECT event_id, 0, 'tags', 'a' FROM events
  UNION ALL SELECT event_id, 0, 'tags.k', event_id::VARCHAR FROM events UNION ALL SELECT event_id, 0, 'n', event_id::VARCHAR FROM events
  UNION ALL SELECT event_id, 1, 'n', NULL FROM events UNION ALL SELECT event_id, 1, 'props.k', {_PROP} FROM events
  UNION ALL SELECT event_id, 1, 'er.x', 'true' FROM events UNION ALL SELECT event_id, 2, 'TOPLEVEL', 'loose' FROM events"""


@query("X1_flatten_json", _LEAVES)
def flatten_json(spark, sf):
    return tb.flatten_json(_json_docs(spark, sf))


@query(
    "X1_binding_values",
    """SELECT event_id AS id, 0::BIGINT AS row, 'user.type' AS "column", 'uri' AS value FROM events
  UNION ALL SELECT event_id, 0, 'user.value', 'Q' || user_id FROM events
  UNION ALL SELECT event_id, 1, 'kind.type', 'literal' FROM events UNION ALL SELECT event_id, 1, 'kind.value', event_type FROM events""",
)
def binding_values(spark, sf):
    text = """'[{"user": {"type": "uri", "value": "Q' || user_id || '"}}, {"kind": {"type": "literal", "value": "' || event_type || '"}}]'"""
    return tb.binding_values(table(spark, sf, "events").selectExpr("event_id AS id", f"{text} AS bindings"))


_PRESENT = "value IS NOT NULL AND value NOT IN ('--', 'NaN')"


@query(
    "X2_kept_columns",
    f"""WITH {_CATALOG_CTE} SELECT "table", "column", count(*) FILTER (WHERE {_PRESENT}) AS n_values FROM cells
  WHERE NOT contains("column", 'Unnamed:') GROUP BY ALL HAVING count(*) FILTER (WHERE {_PRESENT}) > 0""",
)
def kept_columns(spark, sf):
    return tb.kept_columns(catalog(spark, sf))


@query(
    "X3_unpivoted",
    " UNION ALL ".join(
        f"""SELECT 'supplier' AS "table", s_suppkey, '{c}' AS "column", {c}::VARCHAR AS value FROM supplier""" for c in ("s_name", "s_nationkey", "s_acctbal")
    ),
)
def unpivoted(spark, sf):
    return tb.unpivoted(table(spark, sf, "supplier"), "supplier", ["s_suppkey"])


# --- profiles ------------------------------------------------------------------------------------------------

def _replaced(text, removed):
    return reduce(lambda t, x: f"replace({t}, '{x}', '')", removed, text)


def _quoted(text):
    return "'" + text.replace("'", "''") + "'"


_BARE = "replace(value, ',', '')"
_DIGITS = _replaced(_BARE, UNITS)
_UNIT = "CASE " + " ".join(f"WHEN contains({_BARE}, '{u}') THEN {f}" for u, f in UNITS.items()) + " ELSE 1 END"
# Dates by another way: each shape apart, with the year read and compared as a number.
_DAY, _MONTHS = "(?:0?[1-9]|[12][0-9]|3[01])", "(?:jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]*[.]?"
_SHAPES = [
    rf"^\s*(\d{{4}})[-/.](?:0?[1-9]|1[0-2])[-/.]{_DAY}", rf"^\s*{_DAY}[-/.]{_DAY}[-/.](\d{{4}})",
    rf"(?i)^\s*{_MONTHS} {_DAY},? (\d{{4}})", rf"(?i)^\s*{_DAY} {_MONTHS},? (\d{{4}})",
]
_TIME = "([ T]\\d{1,2}:\\d{2}.*)?$"
_YEAR = "coalesce(" + ", ".join(f"nullif(regexp_extract(value, '{s}{_TIME}', 1), '')" for s in _SHAPES) + ")::INT"


def _among(chars):
    return f"(length(value) - length(translate(value, {chars}, '')))::DOUBLE / length(value) + 1e-12"


_PROFILE_CTE = f"""{_CATALOG_CTE},
read_cells AS (SELECT "table", "column", regexp_matches(value, '{pf.FLOAT_TEXT}') AS is_float,
    length(regexp_replace({_DIGITS}, '[^0-9]', '', 'g')) AS n_digits, length({_DIGITS}) AS n_bare,
    regexp_matches(value, '{URL_PATTERN}') AS is_url,
    coalesce(regexp_matches(value, '[月日年]') OR {_YEAR} BETWEEN 2000 AND 2030, false) AS is_date,
    CASE WHEN regexp_matches({_BARE}, '{pf.FLOAT_TEXT}') THEN try_cast({_BARE} AS DOUBLE)
      ELSE try_cast(nullif(regexp_extract({_BARE}, '-?(?:[0-9]*[.])?[0-9]+', 0), '') AS DOUBLE) * ({_UNIT}) END AS num,
    length(value)::DOUBLE AS len, {_among("' ' || chr(9) || chr(10)")} AS space, {_among(_quoted(PUNCTUATION))} AS punct,
    {_among(_quoted(SPECIAL_CHARACTERS))} AS special, {_among(_quoted('0123456789'))} AS digit
  FROM cells WHERE {_PRESENT} AND NOT contains("column", 'Unnamed:')),
folded AS (SELECT "table", "column", count(*) AS n_values,
    count(*) FILTER (WHERE is_float) >= 0.95 * count(*) AS strict, count(*) FILTER (WHERE n_digits > 0 AND n_digits >= 0.5 * n_bare) >= 0.9 * count(*) AS mainly,
    count(*) FILTER (WHERE is_url) >= 0.9 * count(*) AS url, count(*) FILTER (WHERE is_date) >= 0.9 * count(*) AS date,
    {", ".join(f"avg({x}) AS {p}_mean, min({x}) AS {p}_min, max({x}) AS {p}_max, var_pop({x}) AS {p}_var, var_pop({x}) / nullif(avg({x}), 0) AS {p}_cv, count(DISTINCT {x})::DOUBLE / count({x}) AS {p}_unique" for p, x in (("num", "num"), ("len", "len")))},
    {", ".join(f"avg({c}) AS {c}_mean, var_pop({c}) / avg({c}) AS {c}_cv" for c in pf.CHARS)}
  FROM read_cells GROUP BY ALL),
typed AS (SELECT *, CASE WHEN url THEN 'url' WHEN date THEN 'date' WHEN strict OR mainly THEN 'numeric' ELSE 'string' END AS type FROM folded),
profiles AS (SELECT "table", "column", n_values, type, strict, mainly,
    {", ".join(f"(type = '{t}')::INT::DOUBLE AS is_{t}" for t in pf.TYPES)},
    {", ".join(f"CASE WHEN type = 'numeric' THEN num_{s} ELSE -1 END AS num_{s}" for s in pf.STATS)},
    {", ".join(f"len_{s}" for s in pf.STATS)},
    {", ".join(f"CASE WHEN type = 'string' OR (mainly AND NOT strict) THEN {c}_{s} ELSE -1 END AS {c}_{s}" for s in ("mean", "cv") for c in pf.CHARS)}
  FROM typed)"""


def _leading_sql(x):
    """Leading digits of a number: comparable whatever its size. Noise around zero is zero."""
    return f"CASE WHEN abs({x}) < 1e-11 THEN 0.0 ELSE round(round({x} / pow(10, floor(log10(abs({x})))), 9), 5) END"


def _leading(rows, names):
    return rows.withColumns({n: F.expr(f"coalesce({_leading_sql(n)}, -9.0)") for n in names})


def _leading_list(names):
    return ", ".join(f"coalesce({_leading_sql(n)}, -9.0)::DOUBLE AS {n}" for n in names)


def profiles(spark, sf):
    return pf.column_profiles(catalog(spark, sf))


_KEY = '"table", "column"'


@query("X4_X8_column_types", f"WITH {_PROFILE_CTE} SELECT {_KEY}, n_values, type, strict AS strict_numeric, mainly AS mainly_numeric FROM profiles")
def column_types(spark, sf):
    return pf.column_types(catalog(spark, sf)).select("table", "column", "n_values", "type", "strict_numeric", "mainly_numeric")


_TESTS = {
    "X4_strict_numeric": ("is_float", pf.is_float, "is_float"),
    "X5_mostly_digits": ("mostly_digits", pf.is_mostly_digits, "n_digits > 0 AND n_digits >= 0.5 * n_bare"),
    "X6_urls": ("is_url", pf.is_url, "is_url"),
    "X7_dates": ("is_date", pf.is_date, "is_date"),
}


def _register_test(name, alias, test, sql):
    @query(name, f"WITH {_PROFILE_CTE} SELECT {_KEY}, count(*) FILTER (WHERE {sql}) AS {alias} FROM read_cells GROUP BY ALL")
    def counted(spark, sf):
        cells = catalog(spark, sf).where(tb.present(F.col("value")) & ~F.contains("column", F.lit("Unnamed:")))
        return cells.groupBy("table", "column").agg(F.count_if(test(F.col("value"))).alias(alias))


for _name, (_alias, _test, _sql) in _TESTS.items():
    _register_test(_name, _alias, _test, _sql)


@query(
    "X9_numbers",
    f"""WITH {_PROFILE_CTE} SELECT {_KEY}, count(num) AS n, {_leading_sql('sum(num)')} AS total FROM read_cells GROUP BY ALL HAVING count(num) > 0""",
)
def numbers(spark, sf):
    cells = catalog(spark, sf).where(tb.present(F.col("value")) & ~F.contains("column", F.lit("Unnamed:")))
    rows = cells.groupBy("table", "column").agg(
        F.count(pf.number(F.col("value"))).alias("n"), F.sum(pf.number(F.col("value"))).alias("total")
    )
    return _leading(rows.where("n > 0"), ["total"])


def _register_features(name, features, build=pf.column_profiles):
    @query(name, f"WITH {_PROFILE_CTE} SELECT {_KEY}, {_leading_list(features)} FROM profiles")
    def selected(spark, sf):
        return _leading(build(catalog(spark, sf)), features).select("table", "column", *features)


_register_features("X8_type_indicators", [f"is_{t}" for t in pf.TYPES], pf.column_types)
_register_features("X10_numeric_features", [f"num_{s}" for s in pf.STATS])
_register_features("X11_length_features", [f"len_{s}" for s in pf.STATS])
_register_features("X12_character_features", [f"{c}_{s}" for s in ("mean", "cv") for c in pf.CHARS])


def _vector_cells(spark, sf):
    return table(spark, sf, "embeddings").selectExpr(
        "'set' || vec_id % 2 AS `table`", "'label_' || label AS `column`", "vec_id AS id", "embedding"
    )


_VECTOR_CTE = """dims AS (SELECT 'set' || vec_id % 2 AS t, 'label_' || label AS c, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS d FROM embeddings),
column_means AS (SELECT t, c, d, avg(x) AS x FROM dims GROUP BY ALL),
column_vectors AS (SELECT t, c, list(x ORDER BY d) AS v FROM column_means GROUP BY ALL)"""


@query(
    "X13_column_embeddings",
    f"""WITH {_VECTOR_CTE} SELECT t AS "table", c AS "column", d::INT - 1 AS dim, round(x, 6) AS x FROM column_means""",
)
def column_embeddings(spark, sf):
    every = pf.column_embeddings(_vector_cells(spark, sf), sample=None)
    return every.select("table", "column", F.posexplode("embedding").alias("dim", "x")).withColumn("x", F.round("x", 6))


@query(
    "X13_sampled_column_embeddings",
    f"""WITH picked AS (SELECT 'set' || vec_id % 2 AS t, 'label_' || label AS c, embedding FROM embeddings
  QUALIFY row_number() OVER (PARTITION BY vec_id % 2, label ORDER BY {sql_draw(0, 'vec_id')}, vec_id) <= 20),
d AS (SELECT t, c, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1)::INT - 1 AS dim FROM picked)
SELECT t AS "table", c AS "column", dim, round(avg(x), 6) AS x FROM d GROUP BY ALL""",
)
def sampled_column_embeddings(spark, sf):
    rows = pf.column_embeddings(_vector_cells(spark, sf), sample=20)
    return rows.select("table", "column", F.posexplode("embedding").alias("dim", "x")).withColumn("x", F.round("x", 6))


# --- pairs -------------------------------------------------------------------------------------------------------

_PAIRS_SQL = ", ".join(f"('{a}', '{b}')" for a, b in _TABLE_PAIRS)
_PAIR_CTE = f"""{_PROFILE_CTE}, table_pairs(lt, rt) AS (VALUES {_PAIRS_SQL}),
pairs AS (SELECT lt AS left_table, rt AS right_table, a."column" AS left_column, b."column" AS right_column,
    {", ".join(f"a.{f} AS l_{f}, b.{f} AS r_{f}" for f in pf.FEATURES)}
  FROM table_pairs JOIN profiles a ON a."table" = lt JOIN profiles b ON b."table" = rt),
gold AS (SELECT c AS a, d AS b FROM (SELECT DISTINCT a."column" AS c, b."column" AS d FROM profiles a, profiles b
  WHERE substr(a."column", 3) = substr(b."column", 3) AND a."column" < b."column")),
labelled AS (SELECT p.*, EXISTS (SELECT 1 FROM gold g WHERE (g.a, g.b) = (least(left_column, right_column), greatest(left_column, right_column)))::INT AS label FROM pairs p)"""


def column_pairs(spark, sf):
    """Pairs of the kept columns by name, without their profiles."""
    return mt.column_pairs(tb.kept_columns(catalog(spark, sf)), _pairs_table(spark))


def profiled_pairs(spark, sf):
    return mt.column_pairs(profiles(spark, sf), _pairs_table(spark))


def _mapping(spark):
    """Gold pairs: equal names after the two-letter table mark, listed in either order."""
    names = [c for columns in CATALOG.values() for c in columns]
    pairs = [(a, b) for a in names for b in names if a != b and a[2:] == b[2:]]
    return spark.createDataFrame(pairs, "a string, b string")


def _labelled(spark, sf):
    return mt.gold_labels(column_pairs(spark, sf), _mapping(spark))


@query("X14_column_pairs", f"WITH {_PAIR_CTE} SELECT left_table, right_table, left_column, right_column FROM pairs")
def all_column_pairs(spark, sf):
    return column_pairs(spark, sf).select(*mt.PAIR)


@query("X15_gold_labels", f"WITH {_PAIR_CTE} SELECT left_table, right_table, left_column, right_column, label FROM labelled")
def gold_labels(spark, sf):
    return _labelled(spark, sf).select(*mt.PAIR, "label")


@query(
    "X16_balanced_counts",
    f"""WITH {_PAIR_CTE} SELECT left_table, right_table, sum(label)::BIGINT AS positives,
  least(count(*) - sum(label), 2 * sum(label))::BIGINT AS negatives FROM labelled GROUP BY ALL HAVING sum(label) > 0""",
)
def balanced_counts(spark, sf):
    rows = mt.balanced(_labelled(spark, sf), per_positive=2)
    return rows.groupBy(*mt.TABLES).agg(
        F.sum("label").alias("positives"), F.count_if(F.col("label") == 0).alias("negatives")
    )


@query(
    "X16_balanced_pairs",
    f"""WITH {_PAIR_CTE}, r AS (SELECT left_table, right_table, left_column, right_column, label, sum(label) OVER (PARTITION BY left_table, right_table) AS positives,
    row_number() OVER (PARTITION BY left_table, right_table, label ORDER BY {sql_draw(200, 'left_table', 'right_table', 'left_column', 'right_column')}) AS k FROM labelled)
SELECT left_table, right_table, left_column, right_column, label FROM r WHERE label = 1 OR k <= 2 * positives""",
)
def balanced_pairs(spark, sf):
    return mt.balanced(_labelled(spark, sf), per_positive=2).select(*mt.PAIR, "label")


@query(
    "X17_normalised_names",
    f"""WITH {_CATALOG_CTE} SELECT DISTINCT "column", trim(regexp_replace(lower("column"), '[\\s_.]', ' ', 'g')) AS name FROM cells""",
)
def normalised_names(spark, sf):
    return catalog(spark, sf).select("column").distinct().withColumn("name", mt.normalised_name(F.col("column")))


_NAME_SQL = "trim(regexp_replace(lower({0}), '[\\s_.]', ' ', 'g'))"
_LEFT, _RIGHT = _NAME_SQL.format("left_column"), _NAME_SQL.format("right_column")


@query(
    "X17b_name_edits",
    f"""WITH {_PAIR_CTE} SELECT left_table, right_table, left_column, right_column, damerau_levenshtein({_LEFT}, {_RIGHT})::DOUBLE AS name_edits,
  (contains({_LEFT}, {_RIGHT}) OR contains({_RIGHT}, {_LEFT}))::INT::DOUBLE AS name_contained FROM pairs""",
)
def name_edits(spark, sf):
    return mt.name_features(column_pairs(spark, sf)).select(*mt.PAIR, "name_edits", "name_contained")


@query("X17b_name_features")
def name_features(spark, sf):
    return mt.name_features(column_pairs(spark, sf)).select(*mt.PAIR, *mt.NAMES)


_DIFF_SQL = ", ".join(
    f"coalesce({_leading_sql(f'(abs(l_{f} - r_{f}) / nullif(l_{f} + r_{f} + 1e-8, 0))')}, 0.0)::DOUBLE AS diff_{f}" for f in pf.FEATURES
)


@query("X17c_profile_differences", f"WITH {_PAIR_CTE} SELECT left_table, right_table, left_column, right_column, {_DIFF_SQL} FROM pairs")
def profile_differences(spark, sf):
    rows = mt.profile_differences(profiled_pairs(spark, sf)).select(*mt.PAIR, *mt.DIFFS)
    return rows.withColumns({d: F.expr(f"coalesce({_leading_sql(d)}, 0.0)") for d in mt.DIFFS})


@query(
    "X17d_instance_similarity",
    f"""WITH {_VECTOR_CTE} SELECT a.t AS left_table, b.t AS right_table, a.c AS left_column, b.c AS right_column,
  round(list_cosine_similarity(a.v, b.v), 6) AS instance_cosine FROM column_vectors a JOIN column_vectors b ON a.t <> b.t""",
)
def instance_similarity(spark, sf):
    vectors = pf.column_embeddings(_vector_cells(spark, sf), sample=None)
    tables = spark.sql("SELECT * FROM VALUES ('set0', 'set1'), ('set1', 'set0') AS t(left_table, right_table)")
    pairs = mt.column_pairs(vectors.select("table", "column", F.lit(1).alias("x")), tables).select(*mt.PAIR)
    return mt.instance_similarity(pairs, vectors).withColumn("instance_cosine", F.round("instance_cosine", 6))


@query(
    "X17e_text_similarity",
    """SELECT a.vec_id, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS similarity
  FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1""",
)
def text_similarity(spark, sf):
    vectors = table(spark, sf, "embeddings")
    after = vectors.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    return vectors.join(after, "vec_id").select("vec_id", F.round(sim.cosine(F.col("embedding"), F.col("other")), 6).alias("similarity"))


@query(
    "X17f_masked_copies",
    f"""WITH {_PAIR_CTE}, placed AS (SELECT left_table, right_table, left_column, right_column, damerau_levenshtein({_LEFT}, {_RIGHT})::DOUBLE AS name_edits,
  row_number() OVER (PARTITION BY left_table, right_table ORDER BY left_column, right_column) - 1 AS place FROM pairs)
SELECT * EXCLUDE (place), false AS masked FROM placed
  UNION ALL SELECT * REPLACE (12.0::DOUBLE AS name_edits) EXCLUDE (place), true FROM placed WHERE place % 5 = 0""".replace(
        "* REPLACE (12.0::DOUBLE AS name_edits) EXCLUDE (place)", "left_table, right_table, left_column, right_column, 12.0::DOUBLE"
    ),
)
def masked_copies(spark, sf):
    return mt.masked_copies(mt.name_features(column_pairs(spark, sf))).select(*mt.PAIR, "name_edits", "masked")


# A vector of a name or a cell is one of the given vectors, picked by hash.
_VECTORS = 100


def _vector_of(seed, *parts):
    return (draw(seed, *parts) % _VECTORS).alias("vec_id")


def _vectors(spark, sf):
    return table(spark, sf, "embeddings").select("vec_id", "embedding")


def name_vectors(spark, sf):
    """A vector of each normalised name of the catalog, one row per name."""
    names = [c for columns in CATALOG.values() for c in columns]
    rows = spark.createDataFrame([(n,) for n in names], "name string").select(mt.normalised_name(F.col("name")).alias("name")).distinct()
    return rows.select("name", _vector_of(7, "name")).join(_vectors(spark, sf), "vec_id").drop("vec_id")


def catalog_embeddings(spark, sf, types):
    """Embeddings of the text columns of stored ``types``: the mean over up to twenty of their different values."""
    cells = catalog(spark, sf).where(tb.present(F.col("value")) & ~F.contains("column", F.lit("Unnamed:")))
    types = types.where(pf.is_textual()).select("table", "column")
    # Only numbers of values cross the network, each once.
    values = cells.join(F.broadcast(types), ["table", "column"]).select("table", "column", draw(3, "value").alias("id")).distinct()
    picked = pf.sampled_cells(values, 20).withColumn("vec_id", F.col("id") % _VECTORS)
    return pf.column_embeddings(picked.join(F.broadcast(_vectors(spark, sf).where(F.col("vec_id") < _VECTORS)), "vec_id"))


def pair_features(spark, sf):
    """All 30 features of the catalog pairs, with their gold label."""
    types = pinned(profiles(spark, sf))
    labelled = mt.gold_labels(mt.column_pairs(types, _pairs_table(spark)), _mapping(spark))
    rows = matching.features(labelled, name_vectors(spark, sf), catalog_embeddings(spark, sf, types))
    return rows.select(*mt.PAIR, "label", *mt.PAIR_FEATURES)


_FEATURE_CTE = f"""{_PAIR_CTE}, vectors AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings),
text_values AS (SELECT DISTINCT "table", "column", {sql_draw(3, 'value')} AS id FROM cells JOIN profiles USING ("table", "column")
  WHERE {_PRESENT} AND (type = 'string' OR (mainly AND NOT strict))),
text_picked AS (SELECT * FROM text_values QUALIFY row_number() OVER (PARTITION BY "table", "column" ORDER BY {sql_draw(0, 'id')}, id) <= 20),
text_dims AS (SELECT "table", "column", unnest(v) AS x, generate_subscripts(v, 1) AS d FROM text_picked JOIN vectors ON vec_id = id % {_VECTORS}),
text_vectors AS (SELECT "table", "column", list(x ORDER BY d) AS v FROM (SELECT "table", "column", d, avg(x) AS x FROM text_dims GROUP BY ALL) GROUP BY ALL),
every_vector AS (SELECT p."table", p."column", coalesce(v, list_transform(range(64), lambda i: -999.0::DOUBLE)) AS v FROM profiles p LEFT JOIN text_vectors USING ("table", "column")),
featured AS (SELECT p.*, {_LEFT} AS left_name, {_RIGHT} AS right_name, damerau_levenshtein({_LEFT}, {_RIGHT})::DOUBLE AS name_edits,
    (contains({_LEFT}, {_RIGHT}) OR contains({_RIGHT}, {_LEFT}))::INT::DOUBLE AS name_contained,
    list_cosine_similarity(x.v, y.v) AS name_cosine, list_cosine_similarity(a.v, b.v) AS instance_cosine
  FROM labelled p JOIN every_vector a ON (a."table", a."column") = (left_table, left_column) JOIN every_vector b ON (b."table", b."column") = (right_table, right_column)
  JOIN vectors x ON x.vec_id = {sql_draw(7, _LEFT)} % {_VECTORS} JOIN vectors y ON y.vec_id = {sql_draw(7, _RIGHT)} % {_VECTORS})"""


@query(
    "X17b_name_cosine",
    f"WITH {_FEATURE_CTE} SELECT left_table, right_table, left_column, right_column, round(name_cosine, 6) AS name_cosine, name_edits, name_contained FROM featured",
)
def name_cosine(spark, sf):
    rows = mt.name_features(column_pairs(spark, sf), name_vectors(spark, sf))
    return rows.select(*mt.PAIR, F.round("name_cosine", 6).alias("name_cosine"), "name_edits", "name_contained")


@query(
    "X17d_catalog_similarity",
    f"WITH {_FEATURE_CTE} SELECT left_table, right_table, left_column, right_column, round(instance_cosine, 6) AS instance_cosine FROM featured",
)
def catalog_similarity(spark, sf):
    types = pinned(pf.column_types(catalog(spark, sf)))
    pairs = mt.column_pairs(types.select("table", "column", "n_values"), _pairs_table(spark)).select(*mt.PAIR)
    rows = mt.instance_similarity(pairs, catalog_embeddings(spark, sf, types))
    return rows.withColumn("instance_cosine", F.round("instance_cosine", 6))


_KEPT_CTE = f"""{_FEATURE_CTE}, share AS (SELECT 3 * sum(label) / count(*) FILTER (WHERE label = 0) AS s FROM featured),
kept AS (SELECT f.* FROM featured f, share WHERE label = 1 OR {sql_draw(200, 'left_table', 'right_table', 'left_column', 'right_column')} < s * pow(2.0, 60))"""


@query("X16_balanced_overall", f"WITH {_KEPT_CTE} SELECT left_table, right_table, left_column, right_column, label FROM kept")
def balanced_overall(spark, sf):
    return mt.balanced_overall(_labelled(spark, sf), per_positive=3).select(*mt.PAIR, "label")


@query(
    "X17f_training_rows",
    f"""WITH {_KEPT_CTE}, placed AS (SELECT *, row_number() OVER (PARTITION BY left_table, right_table ORDER BY left_column, right_column) - 1 AS place FROM kept)
SELECT left_table, right_table, left_column, right_column, label, false AS masked, name_edits, round(name_cosine, 6) AS name_cosine, round(instance_cosine, 6) AS instance_cosine FROM placed
  UNION ALL SELECT left_table, right_table, left_column, right_column, label, true, 12.0::DOUBLE, 0.2::DOUBLE, round(instance_cosine, 6) FROM placed WHERE place % 5 = 0""",
)
def training_rows(spark, sf):
    rows = matching.training_rows(pair_features(spark, sf), per_positive=3)
    return rows.select(*mt.PAIR, "label", "masked", "name_edits", F.round("name_cosine", 6).alias("name_cosine"), F.round("instance_cosine", 6).alias("instance_cosine"))


# Members with given weights: their scores are plain arithmetic.
_GIVEN = [
    (0.4, {"": 1.5, "name_edits": -0.6, "name_contained": 1.0, "name_cosine": 0.5, "diff_is_string": -1.0, "diff_is_numeric": -0.5}),
    (0.55, {"": -0.5, "name_edits": -0.1, "instance_cosine": 1.25, "diff_len_mean": -2.0, "diff_len_unique": -0.25}),
    (0.5, {"": 0.25, "name_cosine": 2.0, "diff_digit_mean": -0.75, "diff_is_date": -2.0, "instance_cosine": -0.5}),
]


def _given_sql():
    def value(f):
        g = f.removeprefix("diff_")
        return f"coalesce(abs(l_{g} - r_{g}) / nullif(l_{g} + r_{g} + 1e-8, 0), 0)" if f.startswith("diff_") else f

    rows = [
        f"SELECT *, {m} AS member, 1 / (1 + exp(-({w['']} + {' + '.join(f'{x} * {value(f)}' for f, x in w.items() if f)}))) AS score, {t} AS least FROM featured"
        for m, (t, w) in enumerate(_GIVEN)
    ]
    return f"""WITH {_FEATURE_CTE}, told AS ({" UNION ALL ".join(rows)}),
mixed AS (SELECT left_table, right_table, left_column, right_column, avg(score) AS score, (avg((score > least)::INT) > 0.5)::INT AS label FROM told GROUP BY ALL)
SELECT left_table, right_table, left_column, right_column, round(score, 6) AS score, label, (label = 1
    AND score = max(score) OVER (PARTITION BY left_table, right_table, left_column) AND score = max(score) OVER (PARTITION BY left_table, right_table, right_column))::INT AS predicted FROM mixed"""


@query("X18_stored_members", _given_sql())
def stored_members(spark, sf):
    path = shared_path(spark, "members")
    mt.save_members(spark, [mt.Member(t, weights=w) for t, w in _GIVEN], path)
    return matching.matched(spark, pair_features(spark, sf).drop("label"), path).withColumn("score", F.round("score", 6))


@query("X18_trained_matcher")
def trained_matcher(spark, sf):
    """Members trained on two pairs of tables, stored, and loaded again for the others."""
    rows, path = pinned(pair_features(spark, sf)), shared_path(spark, "members")
    seen = F.col("left_table").isin("customer", "orders") & F.col("right_table").isin("supplier", "lineitem")
    matching.train(spark, rows.where(seen), path)
    return matching.matched(spark, rows.where(~seen).drop("label"), path)


@query(
    "X18_rule_score",
    f"""WITH {_PAIR_CTE} SELECT left_table, right_table, left_column, right_column,
  round(0.5 * (1 - levenshtein({_LEFT}, {_RIGHT}) / greatest(length({_LEFT}), length({_RIGHT})))
    + 0.5 * (1 - ({' + '.join(f'abs(l_is_{t} - r_is_{t})' for t in pf.TYPES)}) / 2), 6)::DOUBLE AS score FROM pairs""",
)
def rule_score(spark, sf):
    return mt.rule_score(mt.column_pairs(pf.column_types(catalog(spark, sf)), _pairs_table(spark))).select(*mt.PAIR, F.round("score", 6).alias("score"))


# --- selection: scores of (brand, type) pairs by three members --------------------------------------------------

_MEMBERS_CTE = """members AS (SELECT p_brand AS left_column, p_type AS right_column, p_partkey % 3 AS member,
    floor(avg(p_size) / 5) / 10 AS score, (avg(p_size) > 24)::INT AS label FROM part GROUP BY ALL),
combined AS (SELECT left_column, right_column, round(avg(score), 6)::DOUBLE AS score, (avg(label) > 0.5)::INT AS label FROM members GROUP BY ALL)"""


def _combined(spark, sf):
    members = (
        table(spark, sf, "part")
        .groupBy(F.col("p_brand").alias("left_column"), F.col("p_type").alias("right_column"), F.expr("p_partkey % 3").alias("member"))
        .agg(F.expr("CAST(floor(avg(p_size) / 5) / 10 AS DOUBLE)").alias("score"), F.expr("CAST(avg(p_size) > 24 AS INT)").alias("label"))
    )
    return mt.combined(members, ["left_column", "right_column"]).withColumn("score", F.round("score", 6))


@query("X19_combined_scores", f"WITH {_MEMBERS_CTE} SELECT * FROM combined")
def combined_scores(spark, sf):
    return _combined(spark, sf)


_BEST = {
    "many-to-many": "true",
    "one-to-many": "score = row_best",
    "one-to-one": "score = row_best AND score = column_best",
}


def _register_selection(strategy, test):
    name = "X20_" + strategy.replace("-", "_")

    @query(
        name,
        f"""WITH {_MEMBERS_CTE}, b AS (SELECT *, max(score) OVER (PARTITION BY left_column) AS row_best, max(score) OVER (PARTITION BY right_column) AS column_best FROM combined)
SELECT left_column, right_column, score FROM b WHERE label = 1 AND {test}""",
    )
    def chosen(spark, sf):
        return mt.selected(_combined(spark, sf), strategy, tables=[]).select("left_column", "right_column", "score")


for _strategy, _test in _BEST.items():
    _register_selection(_strategy, _test)

_TYPES = ["ECONOMY", "STANDARD", "PROMO", "SMALL", "MEDIUM", "LARGE"]


@query(
    "X21_score_matrix",
    f"WITH {_MEMBERS_CTE} SELECT left_column, {', '.join(f'''max(score) FILTER (WHERE right_column = '{t}') AS {t}''' for t in _TYPES)} FROM combined GROUP BY 1",
)
def score_matrix(spark, sf):
    return mt.score_matrix(_combined(spark, sf), _TYPES)


@query(
    "X22_classifier_evaluation",
    f"""WITH {_MEMBERS_CTE}, c AS (SELECT label, (score > 0.45)::INT AS truth FROM combined),
k AS (SELECT count(*) FILTER (WHERE truth = 1 AND label = 1) AS tp, count(*) FILTER (WHERE truth = 0 AND label = 1) AS fp,
  count(*) FILTER (WHERE truth = 1 AND label = 0) AS fn, count(*) FILTER (WHERE truth = 0 AND label = 0) AS tn FROM c)
SELECT *, round(tp / (tp + fp), 6)::DOUBLE AS "precision", round(tp / (tp + fn), 6)::DOUBLE AS recall, round(2 * tp / (2 * tp + fp + fn), 6)::DOUBLE AS f1 FROM k""",
)
def classifier_evaluation(spark, sf):
    rows = _combined(spark, sf).withColumn("truth", (F.col("score") > 0.45).cast("int"))
    return mt.evaluated(rows).withColumns({n: F.round(n, 6) for n in ("precision", "recall", "f1")})
