"""The operators of this subpackage applied to the shared tables, and SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairforge.functions.binding import bind
from pairforge.llm import alignment, bpe, decontaminate, exact, langid, lm, ngram_join, quality, runs, secrets, suffixes, urls, warc
from pairforge.llm.common import fold

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

#: The contract's rules, host and path together.
URL_RULES = [
    ("com/", "allow"), ("example.com/en/", "block"), ("www.example.com/en/", "allow"), ("net/es/", "block"), ("net/fr/", "block"),
]
QUALITY_LEAST = 0.7


def _query(name: str, sql: str | None = None):
    def register(build):
        QUERIES[name] = build
        if sql is not None:
            ORACLES[name] = sql
        return build

    return register


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@_query(
    "op1_exact_dedup",
    """SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = max(doc_id) OVER g AS kept,
       sha256(coalesce(text, '')) AS text_sha256
  FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))""",
)
def exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.exact_groups(_table(spark, sf_dir, "documents"), smallest=False)


@_query("op2_quality_classifier")
def quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    held_out = fold(F.col("doc_id"), 4) == 2
    return quality.scored(docs, labels, fold(F.col("id"), 4) != 2).select(
        "doc_id", held_out.alias("held_out"), "score", (F.col("score") >= QUALITY_LEAST).cast("int").alias("predicted")
    )


@_query("op3_secret_scan")
def secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(_table(spark, sf_dir, "documents"))


@_query(
    "op4_ngram_jaccard_join",
    r"""WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM documents),
sets AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] || ' ' || w[i + 3])) END AS s
  FROM words),
each AS (SELECT doc_id, len(s) AS n, unnest(s) AS shingle FROM sets),
pairs AS (SELECT a.doc_id AS x, b.doc_id AS y, a.n AS nx, b.n AS ny, count(*) AS common FROM each a JOIN each b
    ON a.shingle = b.shingle AND a.doc_id <> b.doc_id AND 100 * least(a.n, b.n) >= 85 * greatest(a.n, b.n) GROUP BY ALL),
links AS (SELECT x, y FROM pairs WHERE 100 * common >= 85 * (nx + ny - common)),
reach AS (SELECT doc_id AS x, doc_id AS y FROM documents UNION SELECT r.x, l.y FROM reach r JOIN links l ON r.y = l.x)
SELECT doc_id, len(s) AS n_shingles, component_id FROM sets JOIN (SELECT x AS doc_id, min(y) AS component_id FROM reach GROUP BY x) USING (doc_id)""",
)
def ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.linked(_table(spark, sf_dir, "documents"), words=4, percent=85)


@_query("op5_lm_scoring")
def lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.scored(_table(spark, sf_dir, "documents"), fold(F.col("id"), 7) != 2)


@_query("op6_byte_bpe")
def byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return bpe.round_trip(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


@_query("op7_language_id")
def language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    held_out = fold(F.col("doc_id"), 3) == 1
    return langid.languages(docs, fold(F.col("id"), 3) != 1).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def _sql_words(table: str, key: str) -> str:
    """Word lists of ``table`` in both canonical forms, and their windows."""
    units = "|".join(decontaminate.UNITS)
    name, split = r"([\p{Ll},;:] )(\p{Lu}\p{Ll}+)", r"[^\p{L}\p{N}#§@]+"

    def numbered(text: str) -> str:
        return rf"regexp_replace(regexp_replace(lower({text}), '\p{{Nd}}+', '#', 'g'), '# ({units})([^\p{{L}}\p{{N}}]|$)', '# §\2', 'g')"

    def listed(text: str) -> str:
        return f"list_filter(string_split_regex({text}, '{split}'), lambda w: w <> '')"

    named = rf"regexp_replace(regexp_replace(regexp_replace(t, '{name}', '\1@\2', 'g'), '{name}', '\1@\2', 'g'), '@\p{{Lu}}\p{{Ll}}+', '@', 'g')"
    return f"""{table}_words AS (SELECT {key} AS id, {listed(numbered("t"))} AS plain, {listed(numbered(named))} AS template, {listed("lower(t)")} AS words
    FROM (SELECT {key}, translate(coalesce(text, ''), '#§@', '   ') AS t FROM {table})),
{table}_at AS (SELECT *, unnest(range(1, len(plain) - 3)) AS pos FROM {table}_words),
{table}_windows AS (
  SELECT DISTINCT id, pos, w, words[pos:pos + 4] AS said FROM (
    SELECT id, pos, plain[pos:pos + 4] AS w, words FROM {table}_at UNION ALL SELECT id, pos, template[pos:pos + 4], words FROM {table}_at))"""


@_query(
    "op8_benchmark_decontamination",
    f"""WITH {_sql_words("documents", "doc_id")},
{_sql_words("benchmark", "item_id")},
known AS (SELECT * FROM benchmark_windows WHERE len(list_filter(w, lambda x: x NOT IN ('#', '§', '@'))) >= 3),
sizes AS (SELECT id AS item_id, count(DISTINCT pos) AS n_windows FROM known GROUP BY id),
found AS (SELECT d.id AS doc_id, b.id AS item_id, b.pos AS place, d.pos - b.pos AS off, d.w AS w, b.said AS was, d.said AS is_,
    list_filter(range(1, 6), lambda k: d.w[k] IN ('#', '§', '@')) AS slots FROM documents_windows d JOIN known b ON d.w = b.w),
valued AS (SELECT doc_id, item_id, off, was[k] AS v, is_[k] AS said FROM (SELECT *, unnest(slots) AS k FROM found)),
unlike AS (SELECT DISTINCT doc_id, item_id, off FROM (SELECT doc_id, item_id, off FROM valued GROUP BY doc_id, item_id, off, v HAVING min(said) <> max(said))),
checked AS (SELECT f.* FROM found f WHERE len(slots) = 0 OR NOT EXISTS (SELECT 1 FROM unlike u WHERE u.doc_id = f.doc_id AND u.item_id = f.item_id AND u.off = f.off)),
once AS (SELECT doc_id, item_id, place, min(len(list_filter(slots, lambda k: was[k] <> is_[k])) > 0) AS reworded FROM checked GROUP BY ALL),
counted AS (SELECT doc_id, item_id, count(*) AS n_found, max(reworded) AS reworded FROM once GROUP BY ALL)
SELECT doc_id, item_id, n_found, n_windows, n_found / n_windows AS share, reworded FROM counted JOIN sizes USING (item_id) WHERE n_found / n_windows >= 0.8""",
)
def benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


@_query(
    "op9_warc",
    """WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS hex FROM pages),
bits AS (SELECT *, array_to_string(list_transform(range(1, 41), lambda i: format('{:04b}', instr('0123456789abcdef', hex[i]) - 1)), '') AS b FROM p),
d AS (SELECT page_id, payload_bytes, array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    (16 * b[5 * i + 1]::INT + 8 * b[5 * i + 2]::INT + 4 * b[5 * i + 3]::INT + 2 * b[5 * i + 4]::INT + b[5 * i + 5]::INT + 1)::BIGINT, 1)), '') AS payload_digest FROM bits),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM d)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN first = page_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN first <> page_id THEN first END AS refers_to FROM f""",
)
def warc_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder, index = warc.archive(_table(spark, sf_dir, "pages"))
    return warc.read(folder, index).select(
        warc.page_of(F.col("record_id")).alias("page_id"), "payload_bytes", "payload_digest", "record_type",
        warc.page_of(F.col("refers_to")).alias("refers_to"),
    )


def _sql_verdict() -> str:
    fits = []
    for rule, _ in sorted(URL_RULES, key=lambda r: (-len(r[0]), r[0])):
        domain, slash, rest = rule.partition("/")
        fits.append(f"WHEN (host = '{domain}' OR ends_with(host, '.{domain}')) AND starts_with(path, '{slash + rest}') THEN '{rule}'")
    allowed = ", ".join(f"'{rule}'" for rule, verdict in URL_RULES if verdict == "allow")
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

    def backed(length: int) -> str:
        def one(n: str, p: str) -> str:
            return f"CASE WHEN {n}_all = 0 THEN s.{p} ELSE ({n} + {n}_kinds * s.{p}) / ({n}_all + {n}_kinds) END AS {p}"

        return f"""p{length} AS (SELECT gram, {one("a", "p")}, {one("b", "q")} FROM joined JOIN
    (SELECT gram AS shorter, p, q FROM p{length - 1}) s ON substr(gram, 2) = s.shorter WHERE length(gram) = {length})"""

    def scores(name: str, where: str) -> str:
        return f"""{name} AS (SELECT page_id, any_value(host) AS host, any_value(path) AS path, any_value(rule) AS rule, any_value(accepted) AS accepted,
    coalesce(avg(coalesce(d3.delta, d2.delta, d1.delta, 0.0)) FILTER (g IS NOT NULL), 0.0) AS score
  FROM (SELECT * FROM parts LEFT JOIN (SELECT uid AS gid, unnest(list_transform(range(1, length(text) + 1), lambda i: substr('^^' || text, i, 3))) AS g FROM parts) x ON gid = uid WHERE {where})
  LEFT JOIN deltas d1 ON d1.gram = substr(g, 3, 1) LEFT JOIN deltas d2 ON d2.gram = substr(g, 2, 2) LEFT JOIN deltas d3 ON d3.gram = g GROUP BY uid, page_id)"""

    bin_ = f"greatest({-10 * urls.BINS}, least({10 * urls.BINS}, floor(round(score, 6) * {urls.BINS})))::INT"
    return rf"""WITH rest AS (SELECT row_number() OVER () AS uid, page_id, url, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS r FROM pages),
cut AS (SELECT *, translate(regexp_extract(r, '^[^/?#]*'), '{upper}', '{lower}') AS host, regexp_extract(r, '^[^/?#]*([^?#]*)', 1) AS path FROM rest),
parts AS (SELECT uid, page_id, host, path, rule, CASE WHEN rule IS NOT NULL THEN rule IN ({allowed}) END AS accepted, substr(md5(coalesce(url, '')), 1, 1) < '3' AS held_back,
    regexp_replace(regexp_replace(translate(coalesce(url, ''), '{upper}', '{lower}'), '[^a-z0-9/.\-_?=&#:%]', '~', 'g'), '[0-9]', '0', 'g') AS text
  FROM (SELECT *, CASE {" ".join(fits)} END AS rule FROM cut)),
every AS (SELECT accepted, substr('^^' || text, i + 3 - k, k) AS gram
  FROM (SELECT accepted, text, unnest(range(1, length(text) + 1)) AS i FROM parts WHERE rule IS NOT NULL AND NOT held_back), (VALUES (1), (2), (3)) v(k)),
counts AS (SELECT gram, substr(gram, 1, length(gram) - 1) AS context, count(*) FILTER (accepted) AS a, count(*) FILTER (NOT accepted) AS b FROM every GROUP BY 1, 2),
contexts AS (SELECT context, sum(a) AS a_all, sum(b) AS b_all, count(*) FILTER (a > 0) AS a_kinds, count(*) FILTER (b > 0) AS b_kinds FROM counts GROUP BY 1),
joined AS (SELECT * FROM counts JOIN contexts USING (context)),
p1 AS (SELECT gram, (a + 1) / (a_all + {urls.ALPHABET}) AS p, (b + 1) / (b_all + {urls.ALPHABET}) AS q FROM joined WHERE length(gram) = 1),
{backed(2)},
{backed(3)},
deltas AS (SELECT gram, ln(p) - ln(q) AS delta FROM (SELECT * FROM p1 UNION ALL SELECT * FROM p2 UNION ALL SELECT * FROM p3)),
{scores("tried", "rule IS NOT NULL AND held_back")},
{scores("marked", "true")},
bins AS (SELECT {bin_} AS bin, count(*) FILTER (accepted) AS a, count(*) FILTER (NOT accepted) AS b FROM tried GROUP BY 1),
rates AS (SELECT bin, round(coalesce(sum(a) OVER before, 0) / sum(a) OVER whole + 1 - coalesce(sum(b) OVER before, 0) / sum(b) OVER whole, 9) AS wrong FROM bins
  WINDOW before AS (ORDER BY bin ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), whole AS (ORDER BY bin ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
least_bin AS (SELECT bin FROM rates WHERE wrong IS NOT NULL AND NOT isnan(wrong) ORDER BY wrong, abs(bin), bin LIMIT 1)
SELECT page_id, host, path, rule, CASE WHEN coalesce(accepted, {bin_} >= coalesce((SELECT bin FROM least_bin), 0)) THEN 'allow' ELSE 'block' END AS verdict FROM marked"""


@_query("op10_url_filter", _sql_verdict())
def url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judged(_table(spark, sf_dir, "pages"), URL_RULES).drop("score")


@_query("op11_suffix_dedup")
def suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.repeats_removed(_table(spark, sf_dir, "documents"), least=50, compare_nulls=False).select(
        "doc_id", "n_bytes", F.aggregate("removed", F.lit(0).cast("bigint"), lambda n, r: n + r["length"]).alias("n_removed"),
        F.size("removed").cast("bigint").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"),
    )


@_query("op12_tokenizer_alignment")
def tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    models = alignment.Models.read(public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
    return alignment.scored(_table(spark, sf_dir, "documents"), models)


def with_periods(docs: DataFrame) -> DataFrame:
    """(doc_id, text): every tenth document by crc32 of its id is made periodic from some word on, as the contract says."""
    words = F.filter(F.split(F.coalesce("text", F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != "")
    g = F.expr("h div 10")

    def periodic(w):
        n = F.size(w).cast("bigint")
        a = g % n
        p = 1 + F.floor((n - a) / (3 + g % 8))
        place = lambda i: F.when(i >= a, a + (i - a) % p).otherwise(i)
        return F.array_join(F.transform(F.sequence(F.lit(0).cast("bigint"), n - 1), lambda i: F.get(w, place(i).cast("int"))), " ")

    marked = docs.select("doc_id", "text", F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")).alias("h"))
    made = F.when(F.col("h") % 10 == 0, bind(words, lambda w: F.when(F.size(w) > 0, periodic(w)))).otherwise(F.col("text"))
    return marked.select("doc_id", made.alias("text"))


@_query("op13_periodic_runs")
def periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = runs.periodic_runs(with_periods(_table(spark, sf_dir, "documents")))
    listed = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    return found.withColumn("best", runs.strongest(F.col("runs"))).select(
        "doc_id", F.size("runs").cast("bigint").alias("n_runs"), "best.start", "best.length", "best.period",
        F.expr("(1000 * best.length) div best.period").alias("exponent_milli"),
        F.sha2(listed, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
