"""Scores of generated queries."""

from pyspark.sql import functions as F

from pairforge.bindings import query
from pairforge.bindings.inputs import EXECUTION_CTE, PAIR_CTE, executions, sql_draw, table, turn_pairs
from pairforge.fixed_values import QUERY_KEYWORDS
from pairforge.functions.sparql import tagged_query
from pairforge.functions.text import round_significant
from pairforge.operators import outcomes as oc
from pairforge.operators import scoring as sc
from pairforge.plans import evaluation


@query(
    "M1_tagged_query",
    f"""WITH {PAIR_CTE}, o AS (SELECT id, instr(raw, '[QUERY]') AS a, substr(raw, instr(raw, '[QUERY]') + 7) AS rest FROM turn_pairs),
c AS (SELECT *, CASE WHEN instr(rest, '[/QUERY]') > 0 THEN instr(rest, '[/QUERY]') ELSE instr(rest, '[QUERY]') END AS b FROM o)
SELECT id, CASE WHEN a > 0 AND b > 0 THEN regexp_replace(left(rest, b - 1), '^\\s+|\\s+$', '', 'g') ELSE '' END AS query FROM c""",
)
def tagged(spark, sf):
    return turn_pairs(spark, sf).select("id", tagged_query(F.col("raw")).alias("query"))


# --- n-gram scores in SQL: tokens, n-grams, clipped counts ----------------------------------------------

_BLEU_TEXT = r"""regexp_replace(regexp_replace(regexp_replace(regexp_replace(
  ' ' || replace(replace(replace(replace(replace(replace(replace({0}, '<skipped>', ''), '-' || chr(10), ''), chr(10), ' '),
    '&quot;', '"'), '&amp;', '&'), '&lt;', '<'), '&gt;', '>') || ' ',
  '([\{{-\~\[-\` -\&\(-\+\:-\@\/])', ' \1 ', 'g'), '([^0-9])([\.,])', '\1 \2 ', 'g'), '([\.,])([^0-9])', ' \1 \2', 'g'), '([0-9])(-)', '\1 \2 ', 'g')"""
_PLAIN_TEXT = "{0}"
_ROUGE_TEXT = "regexp_replace(lower({0}), '[^a-z0-9]+', ' ', 'g')"


def _gram_cte(text: str, orders: int) -> str:
    values = ", ".join(f"({n})" for n in range(1, orders + 1))
    token = lambda column: f"list_filter(string_split_regex({text.format(column)}, '\\s+'), lambda x: x <> '')"
    return f"""{PAIR_CTE},
tokens AS (SELECT id, 'r' AS side, {token('target')} AS ts FROM turn_pairs UNION ALL SELECT id, 'c', {token('generated')} FROM turn_pairs),
grams AS (SELECT id, side, n, unnest(list_transform(range(1, len(ts) - n + 2), lambda i: array_to_string(ts[i:i + n - 1], ' '))) AS gram
  FROM tokens, (VALUES {values}) v(n) WHERE len(ts) >= n),
counted AS (SELECT id, n, gram, count(*) FILTER (WHERE side = 'r') AS r, count(*) FILTER (WHERE side = 'c') AS c FROM grams GROUP BY ALL),
orders_of AS (SELECT p.id, v.n, coalesce(sum(least(r, c)), 0) AS hits, coalesce(sum(r), 0) AS r, coalesce(sum(c), 0) AS c,
    coalesce(sum(least(r, c) * w), 0) AS whits, coalesce(sum(c * w), 0) AS wc
  FROM turn_pairs p CROSS JOIN (VALUES {values}) v(n)
  LEFT JOIN (SELECT *, CASE WHEN upper(gram) IN ({", ".join(f"'{k}'" for k in QUERY_KEYWORDS)}) THEN 1.0 ELSE 0.2 END AS w FROM counted) k
    ON k.id = p.id AND k.n = v.n GROUP BY ALL),
lengths AS (SELECT id, r AS r1, c AS c1 FROM orders_of WHERE n = 1)"""


_BREVITY = "CASE WHEN c1 > r1 THEN 1.0 ELSE exp(1 - r1 / c1) END"


@query(
    "M2_bleu",
    f"""WITH {_gram_cte(_BLEU_TEXT, 4)} SELECT id, CASE WHEN min(hits) = 0 OR min(c) = 0 THEN 0.0
  ELSE round(exp(sum(ln(CASE WHEN hits > 0 THEN hits / c ELSE 1 END)) / 4) * any_value({_BREVITY}), 6) END::DOUBLE AS bleu
  FROM orders_of JOIN lengths USING (id) GROUP BY id""",
)
def bleu(spark, sf):
    return sc.bleu(turn_pairs(spark, sf)).withColumn("bleu", F.round("bleu", 6))


@query(
    "M3_rouge_n",
    f"""WITH {_gram_cte(_ROUGE_TEXT, 2)}, f AS (SELECT id, n, CASE WHEN hits = 0 THEN 0.0 ELSE 2 * (hits / c) * (hits / r) / (hits / c + hits / r) END AS f FROM orders_of)
SELECT id, round(max(f) FILTER (WHERE n = 1), 6)::DOUBLE AS rouge1, round(max(f) FILTER (WHERE n = 2), 6)::DOUBLE AS rouge2 FROM f GROUP BY id""",
)
def rouge_n(spark, sf):
    rows = sc.rouge_n(turn_pairs(spark, sf))
    return rows.withColumns({"rouge1": F.round("rouge1", 6), "rouge2": F.round("rouge2", 6)})


@query("M4_rouge_lcs")
def rouge_lcs(spark, sf):
    return sc.rouge_lcs(turn_pairs(spark, sf))


@query("M5_exact_match", f"WITH {PAIR_CTE} SELECT round(avg((target = generated)::INT), 9)::DOUBLE AS exact_match FROM turn_pairs")
def exact_match(spark, sf):
    return sc.exact_match(turn_pairs(spark, sf)).withColumn("exact_match", F.round("exact_match", 9))


_GUESS = "CASE WHEN doc_id % 4 = 0 THEN 'en' WHEN doc_id % 9 = 0 THEN 'xx' ELSE lang END"


@query(
    "M6_macro_f1",
    f"""WITH p AS (SELECT lang AS t, {_GUESS} AS g FROM documents), l AS (SELECT t AS label FROM p UNION SELECT g FROM p),
s AS (SELECT label, count(*) FILTER (WHERE t = label AND g = label) AS tp, count(*) FILTER (WHERE t = label AND g <> label) AS fn,
    count(*) FILTER (WHERE t <> label AND g = label) AS fp FROM l, p GROUP BY label)
SELECT round(avg(CASE WHEN tp = 0 THEN 0.0 ELSE 2 * tp / (2 * tp + fp + fn) END), 9)::DOUBLE AS f1 FROM s""",
)
def macro_f1(spark, sf):
    pairs = table(spark, sf, "documents").selectExpr("lang AS target", f"{_GUESS} AS generated")
    return sc.macro_f1(pairs).withColumn("f1", F.round("f1", 9))


@query(
    "M7_weighted_bleu",
    f"""WITH {_gram_cte(_PLAIN_TEXT, 4)} SELECT id, CASE WHEN min(hits) = 0 OR min(c) = 0 THEN 0.0
  ELSE round(exp(sum(ln(CASE WHEN hits = 0 THEN 1 WHEN n = 1 THEN whits / wc ELSE hits / c END)) / 4) * any_value({_BREVITY}), 6) END::DOUBLE AS weighted_bleu
  FROM orders_of JOIN lengths USING (id) GROUP BY id""",
)
def weighted_bleu(spark, sf):
    rows = sc.weighted_bleu(turn_pairs(spark, sf)).drop("plain_bleu")
    return rows.withColumn("weighted_bleu", F.round("weighted_bleu", 6))


@query(
    "M7_plain_bleu",
    f"""WITH {_gram_cte(_PLAIN_TEXT, 4)} SELECT id, CASE WHEN min(hits) = 0 OR min(c) = 0 THEN 0.0
  ELSE round(exp(sum(ln(CASE WHEN hits > 0 THEN hits / c ELSE 1 END)) / 4) * any_value({_BREVITY}), 6) END::DOUBLE AS plain_bleu
  FROM orders_of JOIN lengths USING (id) GROUP BY id""",
)
def plain_bleu(spark, sf):
    return sc.weighted_bleu(turn_pairs(spark, sf)).select("id", F.round("plain_bleu", 6).alias("plain_bleu"))


_SET_CTE = """members AS (SELECT DISTINCT l_suppkey, l_partkey, l_returnflag AS side FROM lineitem WHERE l_returnflag IN ('R', 'N')),
both_sides AS (SELECT l_suppkey, l_partkey, bool_or(side = 'R') AS l, bool_or(side = 'N') AS r FROM members GROUP BY ALL),
sizes AS (SELECT l_suppkey, count(*) FILTER (WHERE l AND r) AS b, count(*) FILTER (WHERE l) AS x, count(*) FILTER (WHERE r) AS y, count(*) AS u
  FROM both_sides GROUP BY 1)"""


def _set_scores(spark, sf):
    """Parts a supplier had returned against parts it did not."""
    side = "CASE l_returnflag WHEN 'R' THEN 'left' ELSE 'right' END"
    members = table(spark, sf, "lineitem").where("l_returnflag IN ('R', 'N')").selectExpr("l_suppkey", "l_partkey", f"{side} AS side")
    return sc.set_scores(members, ["l_suppkey"], "l_partkey", "side")


def _register_set_score(number, name, formula):
    @query(f"M{number}_{name}", f"WITH {_SET_CTE} SELECT l_suppkey, round(coalesce({formula}, 0), 9)::DOUBLE AS {name} FROM sizes")
    def score(spark, sf):
        return _set_scores(spark, sf).select("l_suppkey", F.round(name, 9).alias(name))


for _number, _name, _formula in [
    (8, "overlap", "b / nullif(least(x, y), 0)"), (9, "jaccard", "b / nullif(u, 0)"), (10, "dice", "2 * b / nullif(x + y, 0)"),
]:
    _register_set_score(_number, _name, _formula)

# --- result tables: two columns per user and side, matched for most users ------------------------------

_LEFT_ITEM, _RIGHT_ITEM = "event_type || event_id % 20", "event_type || event_id % 17"
_TABLE_CTE = f"""lefts AS (SELECT user_id AS id, 'item' AS col, {_LEFT_ITEM} AS value FROM events WHERE event_id % 2 = 0
  UNION ALL SELECT user_id, 'n', props FROM events WHERE event_id % 2 = 0),
rights AS (SELECT user_id AS id, 'thing' AS col, {_RIGHT_ITEM} AS value FROM events WHERE event_id % 3 <> 0
  UNION ALL SELECT user_id, 'm', props FROM events WHERE event_id % 3 <> 0),
ids AS (SELECT DISTINCT user_id AS id FROM events),
matched AS (SELECT id, 'item' AS lc, 'thing' AS rc FROM ids WHERE id % 7 <> 3 UNION ALL SELECT id, 'n', 'm' FROM ids WHERE id % 2 = 0 AND id % 7 <> 3),
flags AS (SELECT m.id, m.lc, v.value, bool_or(v.l) AS l, bool_or(NOT v.l) AS r FROM matched m
  JOIN (SELECT id, col, value, true AS l FROM lefts UNION ALL SELECT id, col, value, false FROM rights) v
    ON v.id = m.id AND ((v.l AND v.col = m.lc) OR (NOT v.l AND v.col = m.rc)) GROUP BY ALL),
per_column AS (SELECT id, lc, count(*) FILTER (WHERE l AND r) AS b, count(*) FILTER (WHERE l) AS x, count(*) FILTER (WHERE r) AS y, count(*) AS u FROM flags GROUP BY ALL),
means AS (SELECT id, avg(coalesce(b / nullif(least(x, y), 0), 0)) AS overlap, avg(b / u) AS jaccard, avg(2 * b / (x + y)) AS dice FROM per_column GROUP BY id),
scored AS (SELECT i.id, CASE WHEN i.id % 5 = 0 THEN 0.0 ELSE overlap END AS overlap, CASE WHEN i.id % 5 = 0 THEN 0.0 ELSE jaccard END AS jaccard,
    CASE WHEN i.id % 5 = 0 THEN 0.0 ELSE dice END AS dice FROM ids i LEFT JOIN means USING (id))"""


def table_scores_of(spark, sf):
    events = table(spark, sf, "events")

    def side(rows, item, item_name, other_name):
        cells = F.array(
            F.struct(F.lit(item_name).alias("column"), F.expr(item).alias("value")),
            F.struct(F.lit(other_name).alias("column"), F.col("props").alias("value")),
        )
        return rows.select(F.col("user_id").alias("id"), F.inline(cells))

    ids = events.select(F.col("user_id").alias("id")).distinct()
    pair = lambda left, right: [F.lit(left).alias("left_column"), F.lit(right).alias("right_column")]
    paired = ids.where("id % 7 <> 3")
    matches = paired.select("id", *pair("item", "thing")).unionByName(paired.where("id % 2 = 0").select("id", *pair("n", "m")))
    return sc.table_scores(
        side(events.where("event_id % 2 = 0"), _LEFT_ITEM, "item", "n"),
        side(events.where("event_id % 3 <> 0"), _RIGHT_ITEM, "thing", "m"),
        matches,
        ids.withColumn("has_rows", F.expr("id % 5 <> 0")),
    )


_ROUNDED = ", ".join(f"coalesce(round({n}, 6), -1)::DOUBLE AS {n}" for n in sc.SCORES)


def _rounded(rows, *names):
    return rows.withColumns({n: F.coalesce(F.round(n, 6), F.lit(-1.0)) for n in (names or sc.SCORES)})


@query("M11_table_scores", f"WITH {_TABLE_CTE} SELECT id, {_ROUNDED} FROM scored")
def table_scores(spark, sf):
    return _rounded(table_scores_of(spark, sf))


# --- outcomes: one per event, on top of table-like scores ------------------------------------------------

_OUTCOME = """CASE event_id % 7 WHEN 0 THEN 'ok' WHEN 1 THEN 'bad_syntax' WHEN 2 THEN 'server_error' WHEN 3 THEN 'timeout'
  WHEN 4 THEN 'other' WHEN 5 THEN 'unreadable_target' ELSE 'ok' END"""
_RAW_SCORES = "(event_id % 10) / 10.0"


def _outcome_rows(spark, sf):
    score = f"CAST({_RAW_SCORES} AS DOUBLE)"
    return table(spark, sf, "events").selectExpr(
        "event_id AS id", f"{_OUTCOME} AS outcome", "user_id % 2 AS target_rows", *[f"{score} AS {n}" for n in sc.SCORES]
    )


_OUTCOME_CTE = f"rows_of AS (SELECT event_id AS id, {_OUTCOME} AS outcome, user_id % 2 AS target_rows, CAST({_RAW_SCORES} AS DOUBLE) AS score FROM events)"
_SCORED = """CASE outcome WHEN 'ok' THEN score WHEN 'server_error' THEN CASE WHEN target_rows = 0 THEN 1.0 ELSE 0.0 END ELSE 0.0 END"""


@query(
    "M12_outcome_scores",
    f"""WITH {_OUTCOME_CTE} SELECT id, {', '.join(f'({_SCORED})::DOUBLE AS {n}' for n in sc.SCORES)},
  CASE outcome WHEN 'bad_syntax' THEN 0.0 ELSE 1.0 END::DOUBLE AS syntax FROM rows_of WHERE outcome IN ('ok', 'bad_syntax', 'server_error', 'timeout')""",
)
def outcome_scores(spark, sf):
    return sc.outcome_scores(_outcome_rows(spark, sf)).select("id", *sc.SCORES, "syntax")


@query("M12_unscored", f"WITH {_OUTCOME_CTE} SELECT id, outcome FROM rows_of WHERE outcome IN ('other', 'unreadable_target')")
def unscored(spark, sf):
    return sc.unscored(_outcome_rows(spark, sf)).select("id", "outcome")


# --- from executed results to scores: flattened, matched, compared, judged by outcome ---------------------


def _cell(variable, kind, value):
    return f"""'"{variable}": {{"type": "{kind}", "value": "' || {value} || '"}}'"""


_OTHER = "CASE WHEN event_id % 3 = 0 THEN 'other' ELSE event_type END"
_TARGET = f"""CASE WHEN event_id % 5 = 0 THEN '[]' ELSE '[{{' || {_cell("user", "literal", "event_type")} || '}}, {{'
  || {_cell("user", "literal", "event_type || ' x'")} || ', ' || {_cell("kind", "uri", "event_type")} || '}}]' END"""
_GENERATED = f"""'[{{' || {_cell("user", "literal", "event_type")} || ', ' || {_cell("sort", "uri", _OTHER)} || '}}]'"""
_CHAIN_CTE = f"""docs AS (SELECT event_id AS id, event_type AS e, event_id % 5 <> 0 AS has_rows, {_OUTCOME} AS outcome, {_OTHER} AS o FROM events),
cells AS (SELECT id, true AS l, unnest(['user.type', 'user.value', 'user.value', 'kind.type', 'kind.value']) AS col,
    unnest(['literal', e, e || ' x', 'uri', e]) AS value FROM docs WHERE has_rows
  UNION ALL SELECT id, false, unnest(['user.type', 'user.value', 'sort.type', 'sort.value']), unnest(['literal', e, 'uri', o]) FROM docs),
cols AS (SELECT DISTINCT id, l, col FROM cells),
pairs AS (SELECT a.id, a.col AS lc, b.col AS rc, 0.5::DOUBLE * (1 - levenshtein(a.col, b.col)::DOUBLE / greatest(length(a.col), length(b.col))) + 0.5 AS score
  FROM cols a JOIN cols b ON a.id = b.id AND a.l AND NOT b.l),
best AS (SELECT *, max(score) OVER (PARTITION BY id, lc) AS row_best, max(score) OVER (PARTITION BY id, rc) AS column_best FROM pairs),
matched AS (SELECT id, lc, rc FROM best WHERE score >= 0.5 AND score = row_best AND score = column_best),
flags AS (SELECT m.id, m.lc, m.rc, v.value, bool_or(v.l) AS l, bool_or(NOT v.l) AS r FROM matched m
  JOIN cells v ON v.id = m.id AND ((v.l AND v.col = m.lc) OR (NOT v.l AND v.col = m.rc)) GROUP BY ALL),
per_column AS (SELECT id, lc, rc, count(*) FILTER (WHERE l AND r) AS b, count(*) FILTER (WHERE l) AS x, count(*) FILTER (WHERE r) AS y, count(*) AS u FROM flags GROUP BY ALL),
means AS (SELECT id, avg(b / least(x, y)) AS overlap, avg(b / u) AS jaccard, avg(2 * b / (x + y)) AS dice FROM per_column GROUP BY id)"""


def _judged(name):
    return f"""coalesce(round(CASE outcome WHEN 'ok' THEN CASE WHEN has_rows THEN {name} ELSE 0.0 END
    WHEN 'server_error' THEN CASE WHEN has_rows THEN 0.0 ELSE 1.0 END ELSE 0.0 END, 6), -1)::DOUBLE AS {name}"""


@query(
    "M11_M12_execution_scores",
    f"""WITH {_CHAIN_CTE} SELECT id, outcome, {', '.join(_judged(n) for n in sc.SCORES)}, CASE outcome WHEN 'bad_syntax' THEN 0.0 ELSE 1.0 END::DOUBLE AS syntax
  FROM docs LEFT JOIN means USING (id) WHERE outcome IN ('ok', 'bad_syntax', 'server_error', 'timeout')""",
)
def execution_scores(spark, sf):
    results = table(spark, sf, "events").selectExpr(
        "event_id AS id", f"{_OUTCOME} AS outcome", f"{_TARGET} AS target", f"{_GENERATED} AS generated"
    )
    return _rounded(evaluation.execution_scores(results))


_TRAIN = "CASE outcome WHEN 'ok' THEN score WHEN 'unreadable_target' THEN NULL ELSE 0.0 END"


@query(
    "M12b_training_means",
    f"""WITH {_OUTCOME_CTE} SELECT {', '.join(f'round(avg({_TRAIN}), 6)::DOUBLE AS {n}' for n in sc.SCORES)},
  round(avg(CASE outcome WHEN 'bad_syntax' THEN 0.0 WHEN 'ok' THEN 1.0 WHEN 'unreadable_target' THEN 1.0 END), 6)::DOUBLE AS syntax FROM rows_of""",
)
def training_means(spark, sf):
    names = [*sc.SCORES, "syntax"]
    return _rounded(sc.column_means(sc.training_outcome_scores(_outcome_rows(spark, sf)), names), *names)


@query(
    "M13_column_means",
    """SELECT p_brand, round(avg(CASE WHEN p_size % 5 <> 0 THEN p_size END), 6)::DOUBLE AS p_size, round(avg(p_retailprice), 6) AS p_retailprice
  FROM part GROUP BY p_brand""",
)
def column_means(spark, sf):
    rows = table(spark, sf, "part").withColumn("p_size", F.expr("CASE WHEN p_size % 5 = 0 THEN double('NaN') ELSE p_size END"))
    return _rounded(sc.column_means(rows, ["p_size", "p_retailprice"], ["p_brand"]), "p_size", "p_retailprice")


@query(
    "M14_error_map",
    f"""WITH {EXECUTION_CTE} SELECT execution AS message, id // 500 AS part, count(*) AS n, string_agg(id, ',' ORDER BY id) AS rows
  FROM executions WHERE starts_with(execution, 'exception') GROUP BY 1, 2""",
)
def error_map(spark, sf):
    errors = oc.outcome_subset(executions(spark, sf), "fail").select("id", F.col("execution").alias("message"))
    return sc.error_map(errors, part_rows=500).withColumn("rows", F.array_join("rows", ","))


@query(
    "M14_error_counts",
    f"""WITH {EXECUTION_CTE} SELECT execution AS message, count(*) AS n_errors FROM executions WHERE starts_with(execution, 'exception') GROUP BY 1""",
)
def error_counts(spark, sf):
    errors = oc.outcome_subset(executions(spark, sf), "fail").select("id", F.col("execution").alias("message"))
    return sc.error_counts(errors)


@query(
    "M15_score_grid",
    """SELECT lang, round(avg(quality) FILTER (WHERE toxic = 0), 6)::DOUBLE AS false_quality, round(avg(quality) FILTER (WHERE toxic = 1), 6)::DOUBLE AS true_quality,
  round(avg(n_chars) FILTER (WHERE toxic = 0), 6)::DOUBLE AS false_n_chars, round(avg(n_chars) FILTER (WHERE toxic = 1), 6)::DOUBLE AS true_n_chars
  FROM documents JOIN labels USING (doc_id) GROUP BY lang""",
)
def score_grid(spark, sf):
    rows = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id").withColumn("flagged", F.col("toxic") == 1)
    grid = sc.score_grid(rows, "lang", "flagged", ["quality", "n_chars"])
    return grid.select("lang", *[F.round(c, 6).alias(c) for c in grid.columns if c != "lang"])


@query(
    "M16_round_significant",
    """SELECT o_orderkey, CASE WHEN x = 0 THEN 0.0 WHEN e <= 2 THEN round_even(x * pow(10, 2 - e), 0) / pow(10, 2 - e)
  ELSE round_even(x / pow(10, e - 2), 0) * pow(10, e - 2) END AS rounded
  FROM (SELECT o_orderkey, x, CASE WHEN x = 0 THEN 0 ELSE floor(log10(abs(x))) END AS e
    FROM (SELECT o_orderkey, (o_totalprice - 200000) * (o_orderkey % 5) / 1000000 AS x FROM orders))""",
)
def significant(spark, sf):
    x = F.expr("(o_totalprice - 200000) * (o_orderkey % 5) / 1000000")
    return table(spark, sf, "orders").select("o_orderkey", round_significant(x).alias("rounded"))


@query("M17_sampled_rows", f"WITH {PAIR_CTE} SELECT id, target FROM turn_pairs ORDER BY {sql_draw(3, 'id')}, id LIMIT 5")
def sampled_rows(spark, sf):
    return sc.sampled_rows(turn_pairs(spark, sf), 5, seed=3).select("id", "target")


@query(
    "M18_aligned",
    """SELECT c.conv_id AS id, c.text AS target, coalesce(g.text, 'none') AS generated FROM conversations c
  LEFT JOIN conversations g ON g.conv_id = c.conv_id AND g.turn = 3 WHERE c.turn = 0""",
)
def aligned(spark, sf):
    turns = table(spark, sf, "conversations")
    targets = turns.where("turn = 0").selectExpr("conv_id AS id", "text AS target")
    generated = turns.where("turn = 3").selectExpr("conv_id AS id", "text AS generated")
    return sc.aligned(targets, generated).na.fill({"generated": "none"})


@query("M19_snippet", "SELECT p_partkey, p_name, round(p_retailprice / 100) * 100 / 10 AS price FROM part ORDER BY p_partkey LIMIT 5")
def snippet(spark, sf):
    rows = table(spark, sf, "part").withColumn("price", F.col("p_retailprice") / 10)
    return sc.snippet(rows, ["p_name", "price"], ["price"], order="p_partkey")
