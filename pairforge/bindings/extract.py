"""Extraction from page text."""

from pyspark.sql import functions as F

from pairforge.bindings import query
from pairforge.bindings.inputs import LINK_CTE, WIKI_CTE, link_pages, short_redirects, wiki_pages
from pairforge.operators import extract as ex

_TEMPLATE = r"\{\{SPARQL\d*\|query=(.*?)\}\}"
_ROWS_CTE = f"""{WIKI_CTE},
bodies AS (SELECT page_id, section_id, unnest(bs) AS body, generate_subscripts(bs, 1) - 1 AS pos
  FROM (SELECT *, regexp_extract_all(text, '{_TEMPLATE}', 1, 's') AS bs FROM sections)),
body_lines AS (SELECT page_id, section_id, pos, unnest(ls) AS line, generate_subscripts(ls, 1) AS n
  FROM (SELECT *, string_split(regexp_replace(body, '^\\s+|\\s+$', '', 'g'), chr(10)) AS ls FROM bodies)),
template_rows AS (SELECT page_id, section_id, pos::INT AS pos,
    coalesce(string_agg(line || chr(10), '' ORDER BY n) FILTER (WHERE NOT starts_with(line, '#')), '') AS query,
    string_agg(CASE WHEN contains(line, ':') THEN trim(split_part(substr(line, 2), ':', 1)) ELSE 'comment' END, '|' ORDER BY n)
      FILTER (WHERE starts_with(line, '#')) AS keys,
    coalesce(string_agg(CASE WHEN contains(line, ':') THEN trim(substr(line, instr(line, ':') + 1)) ELSE trim(substr(line, 2)) END,
      chr(10) ORDER BY n) FILTER (WHERE starts_with(line, '#')), '') AS description
  FROM body_lines GROUP BY ALL),
residuals AS (SELECT page_id, section_id, level, heading, regexp_replace(text, '{_TEMPLATE}', '', 'gs') AS residual FROM outline),
ancestors AS (SELECT i.page_id, i.section_id, j.section_id AS anc, j.level, j.heading, j.residual
  FROM residuals i JOIN residuals j ON i.page_id = j.page_id AND j.section_id <= i.section_id
  WHERE NOT EXISTS (SELECT 1 FROM residuals k WHERE k.page_id = i.page_id AND k.section_id > j.section_id
    AND k.section_id <= i.section_id AND k.level <= j.level)),
contexts AS (SELECT page_id, section_id, string_agg(chr(10) || heading || chr(10) || residual, '' ORDER BY anc) AS context,
    string_agg(level || ':' || heading, ' > ' ORDER BY anc) AS path FROM ancestors GROUP BY ALL)"""


@query("E1_section_outline", f"WITH {WIKI_CTE} SELECT page_id, section_id, level, heading, text FROM outline")
def section_outline(spark, sf):
    return ex.outline(wiki_pages(spark, sf))


@query(
    "E1_outline_first_word_levels",
    f"""WITH {WIKI_CTE} SELECT page_id, section_id,
  (length(split_part(trim(head), ' ', 1)) - length(replace(split_part(trim(head), ' ', 1), '=', '')))::INT AS level FROM sections""",
)
def first_word_levels(spark, sf):
    return ex.outline(wiki_pages(spark, sf), level_rule="first_word").select("page_id", "section_id", "level")


@query("E2_section_ancestry", f"WITH {_ROWS_CTE} SELECT page_id, section_id, path FROM contexts")
def section_ancestry(spark, sf):
    step = lambda s: F.concat(s["level"].cast("string"), F.lit(":"), s["heading"])
    return ex.ancestry(wiki_pages(spark, sf)).select(
        "page_id", "section_id", F.array_join(F.transform("path", step), " > ").alias("path")
    )


@query("E3_template_queries", f"WITH {_ROWS_CTE} SELECT page_id, section_id, pos, query FROM template_rows")
def template_queries(spark, sf):
    return ex.template_rows(wiki_pages(spark, sf)).select("page_id", "section_id", "pos", "query")


@query(
    "E4_template_pairs",
    f"WITH {_ROWS_CTE} SELECT page_id, section_id, pos, keys, description AS vals FROM template_rows",
)
def template_pairs(spark, sf):
    field = lambda name, sep: F.array_join(F.transform("pairs", lambda p: p[name]), sep)
    return ex.template_rows(wiki_pages(spark, sf)).select(
        "page_id", "section_id", "pos", field("key", "|").alias("keys"), field("value", "\n").alias("vals")
    )


@query("E5_residual_text", f"WITH {_ROWS_CTE} SELECT page_id, section_id, residual FROM residuals")
def residual_text(spark, sf):
    return ex.residuals(wiki_pages(spark, sf)).select("page_id", "section_id", "residual")


@query(
    "E5_residual_text_before_last",
    f"""WITH {WIKI_CTE} SELECT page_id, section_id, CASE WHEN regexp_matches(text, '{_TEMPLATE}', 's')
  THEN array_to_string(list_slice(string_split_regex(text, '(?s){_TEMPLATE}'), 1, -2), '') ELSE '' END AS residual FROM sections""",
)
def residual_before_last(spark, sf):
    return ex.residuals(wiki_pages(spark, sf), keep_tail=False).select("page_id", "section_id", "residual")


@query(
    "E6_query_context",
    f"""WITH {_ROWS_CTE} SELECT page_id, section_id, pos, query, description, context
  FROM template_rows JOIN contexts USING (page_id, section_id)""",
)
def query_context(spark, sf):
    first = F.get("metadata", F.lit(0))
    return ex.template_queries(wiki_pages(spark, sf)).select(
        "page_id", "section_id", "pos", "query",
        first["description"].alias("description"), first["context"].alias("context"),
    )


_LINK_ROWS = f"""{LINK_CTE},
link_rows AS (SELECT page_id, unnest(regexp_extract_all(text, '\\[https://query\\.wikidata\\.org/(\\S+) +(.*)\\]', 1)) AS target,
    unnest(regexp_extract_all(text, '\\[https://query\\.wikidata\\.org/(\\S+) +(.*)\\]', 2)) AS description FROM link_pages),
link_queries AS (SELECT page_id, url_decode(target) AS raw, description FROM link_rows),
short_rows AS (SELECT page_id, unnest(regexp_extract_all(text, '\\[(https://w\\.wiki/\\S+) +(.*)\\]', 1)) AS short_url,
    unnest(regexp_extract_all(text, '\\[(https://w\\.wiki/\\S+) +(.*)\\]', 2)) AS label FROM link_pages),
short_queries AS (SELECT page_id, url_decode(regexp_extract(target, 'https://query\\.wikidata\\.org/(\\S+)', 1)) AS raw,
    split_part(label, ']', 1) AS description
  FROM short_rows JOIN redirects USING (short_url) WHERE regexp_matches(target, 'https://query\\.wikidata\\.org/\\S+'))"""
_UNEMBED = "CASE WHEN starts_with(raw, 'embed.html') THEN substr(raw, 11) ELSE raw END AS query"


@query("E7_embed_prefix", f"WITH {_LINK_ROWS} SELECT page_id, starts_with(raw, 'embed.html') AS embedded, {_UNEMBED} FROM link_queries")
def embed_prefix(spark, sf):
    from pairforge.functions import wikitext as wt

    links = link_pages(spark, sf).select("page_id", F.inline(wt.query_links(F.col("text"))))
    raw = wt.url_unquote(F.col("target"))
    return links.select("page_id", raw.startswith("embed.html").alias("embedded"), wt.strip_embed(raw).alias("query"))


@query("E8_link_queries", f"WITH {_LINK_ROWS} SELECT page_id, {_UNEMBED}, description, '' AS context FROM link_queries")
def link_queries(spark, sf):
    return ex.link_queries(link_pages(spark, sf)).select("page_id", "query", F.inline("metadata"))


@query("E9_short_links", f"WITH {_LINK_ROWS} SELECT page_id, {_UNEMBED}, description FROM short_queries")
def short_links(spark, sf):
    rows = ex.short_link_queries(link_pages(spark, sf), short_redirects(spark, sf))
    return rows.select("page_id", "query", F.inline("metadata")).drop("context")


@query(
    "E10_harvested_queries",
    f"""WITH {_ROWS_CTE}, {_LINK_ROWS} SELECT page_id, query FROM template_rows
  UNION ALL SELECT page_id, {_UNEMBED} FROM link_queries UNION ALL SELECT page_id, {_UNEMBED} FROM short_queries""",
)
def harvested(spark, sf):
    links = link_pages(spark, sf)
    parts = [
        ex.template_queries(wiki_pages(spark, sf)),
        ex.link_queries(links),
        ex.short_link_queries(links, short_redirects(spark, sf)),
    ]
    return ex.harvested(*parts).select("page_id", "query")


@query(
    "E11_queries_per_page",
    f"""WITH {WIKI_CTE} SELECT page_id, coalesce(sum(len(regexp_extract_all(sections.text, '{_TEMPLATE}', 1, 's'))), 0)::BIGINT AS n_queries
  FROM wiki LEFT JOIN sections USING (page_id) GROUP BY page_id""",
)
def queries_per_page(spark, sf):
    return ex.queries_per_page(wiki_pages(spark, sf))


@query(
    "E12_malformed_templates",
    f"""WITH {WIKI_CTE} SELECT page_id, section_id, heading FROM outline
  WHERE contains(text, 'SPARQL') AND NOT regexp_matches(text, '{_TEMPLATE}', 's')""",
)
def malformed(spark, sf):
    return ex.malformed_sections(wiki_pages(spark, sf)).select("page_id", "section_id", "heading")
