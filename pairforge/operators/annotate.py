"""Ids to labels and back, inside query text.

Replacement never loops over ids, and only ids look for labels: pairs of a text's key and an id are stored,
the labels of the :data:`HOT` most frequent ids are broadcast and the others joined, and each text gets a
map of its own labels, with which it is put together inside its row. A hot id (say, one that a third of all
queries use) meets no partition. Texts move once, whole, to their map. Keys are unique; a text with a null
key keeps its ids, and a null text gives no row.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairforge.fixed_values import ID_PREFIXES, PARSE_FAILURE
from pairforge.functions import sparql as sq
from pairforge.functions.binding import bind
from pairforge.functions.text import label_slug
from pairforge.operators.ordered import forward_fill, running_total
from pairforge.session import pinned

HOT = 1000  # labels that are broadcast


def best_labels(labels: DataFrame) -> DataFrame:
    """``labels(id, lang, label)`` to one label per id: English, else the first language."""
    return labels.groupBy("id").agg(
        F.trim(
            F.coalesce(
                F.max(F.when(F.col("lang") == "en", F.col("label"))), F.min_by("label", "lang")
            )
        ).alias("label")
    )


def follow_redirects(ids: DataFrame, redirects: DataFrame) -> DataFrame:
    """Replace a redirected ``id`` by its target; ``redirects(old_id, new_id)``."""
    return ids.join(redirects.withColumnRenamed("old_id", "id"), "id", "left").select(
        *[F.coalesce("new_id", "id").alias("id") if c == "id" else F.col(c) for c in ids.columns]
    )


def display_labels(hits: DataFrame) -> DataFrame:
    """Text shown for search hits: the label or else the description; hits with neither are dropped."""
    return hits.withColumn("display", F.coalesce("label", "description")).where("display is not null")


def used_ids(queries: DataFrame) -> DataFrame:
    """Distinct ids of all queries, reduced before the shuffle by the map side of ``distinct``."""
    return queries.select(F.explode(sq.item_ids(F.col("query"))).alias("id")).distinct()


def label_lookup(ids: DataFrame, labels: DataFrame) -> DataFrame:
    """A label for each id; an unknown id is its own label."""
    return ids.join(best_labels(labels), "id", "left").select(
        "id", F.coalesce("label", "id").alias("label")
    )


def _asked(df: DataFrame, key: str, items: Column) -> DataFrame:
    """Pairs of (key, _item), stored, as they are counted and read twice."""
    pairs = df.where(F.col(key).isNotNull()).select(key, F.explode(F.array_distinct(items)).alias("_item"))
    return pinned(pairs)


def _with_known(df: DataFrame, key: str, text: str, asked: DataFrame, known: DataFrame) -> DataFrame:
    """(key, text, _known): each text with the map of its items to their ``known(_item, _label)``."""
    often = asked.groupBy("_item").count().orderBy(F.desc("count"), "_item").limit(HOT).select("_item")
    hot = often.join(known, "_item", "left").select("_item", F.col("_label").alias("_hot"), F.lit(True).alias("_is_hot"))
    marked = asked.join(F.broadcast(hot), "_item", "left")
    rest = marked.where("_is_hot is null").select(key, "_item").join(known, "_item").select(key, "_item", "_label")
    hits = marked.where("_hot is not null").select(key, "_item", F.col("_hot").alias("_label")).union(rest)
    maps = hits.groupBy(key).agg(F.map_from_entries(F.collect_set(F.struct("_item", "_label"))).alias("_known"))
    return df.where(F.col(text).isNotNull()).select(key, text).join(maps, key, "left")


def _parts(text: str, pattern: str, part: Callable[[Column, Column], Column]) -> Column:
    """``part(piece, token)`` of each piece of the text with the token behind it; the last piece has none."""
    tokens = F.regexp_extract_all(F.col(text), F.lit(pattern), F.lit(0))
    return F.zip_with(F.split(F.col(text), pattern, -1), tokens, part)


def _replaced(text: str, pattern: str, replacement: Callable[[Column], Column]) -> Column:
    parts = _parts(text, pattern, lambda piece, token: F.concat(piece, F.coalesce(replacement(token), F.lit(""))))
    return F.array_join(parts, "")


def _known_labels(labels: DataFrame) -> DataFrame:
    return best_labels(labels).select(F.col("id").alias("_item"), F.col("label").alias("_label")).where("_label is not null")


def annotate_ids(queries: DataFrame, labels: DataFrame, key: str = "id", text: str = "query") -> DataFrame:
    """``:Q5`` becomes ``:[entity:label]``, likewise for properties and lexemes."""
    asked = _asked(queries, key, sq.item_ids(F.col(text)))
    found = _with_known(queries, key, text, asked, _known_labels(labels))

    def mark(token: Column) -> Column:
        item = F.substr(token, F.lit(2))
        label = F.coalesce(F.try_element_at("_known", item), item)
        return F.concat(F.lit(":["), sq.id_kind(item), F.lit(":"), label, F.lit("]"))

    return found.select(key, _replaced(text, sq.ID, mark).alias("query_annotated"))


def annotate_queries(queries: DataFrame, labels: DataFrame) -> DataFrame:
    """Missing PREFIX lines first, then labels for ids."""
    return annotate_ids(queries.withColumn("query", sq.add_missing_prefixes(F.col("query"))), labels)


def readable_ids(queries: DataFrame, labels: DataFrame, key: str = "id") -> DataFrame:
    """``wd:Q5`` becomes ``wd:human``, with a legend line per use and a PREFIX line per prefix on top.

    ``resolved`` is false when an id of the query has no label.
    """
    def item_of(token: Column) -> Column:
        return F.split_part(token, F.lit(":"), F.lit(2))

    asked = _asked(queries, key, F.transform(sq.id_terms(F.col("query")), item_of))
    found = _with_known(queries, key, "query", asked, _known_labels(labels))
    url = F.create_map(*[F.lit(x) for pair in ID_PREFIXES.items() for x in pair])
    rank = F.create_map(*[F.lit(x) for i, k in enumerate(ID_PREFIXES) for x in (k, i)])

    def part(piece: Column, token: Column) -> Column:
        item, prefix = item_of(token), sq.term_prefix(token)
        label = F.try_element_at("_known", item)
        term = F.concat(prefix, F.lit(":"), label_slug(label))
        legend = F.concat(
            F.lit("# "), term, F.lit(" is the text label corresponding to ID:"), item,
            F.lit(" (<"), F.element_at(url, prefix), item, F.lit(">)\n"),
        )
        return F.struct(
            F.concat(piece, F.coalesce(term, token, F.lit(""))).alias("text"),
            F.element_at(rank, prefix).alias("rank"),
            F.concat(F.lit("PREFIX "), prefix, F.lit(": <"), F.element_at(url, prefix), F.lit("> \n")).alias("head"),
            legend.alias("legend"),
            (token.isNull() | label.isNotNull()).alias("resolved"),
        )

    def whole(parts: Column) -> Column:
        def head(used: Column) -> Column:
            def block(r: Column) -> Column:
                own = F.filter(used, lambda p: p["rank"] == r)
                return F.concat(
                    F.get(own, F.lit(0))["head"], F.array_join(F.transform(F.reverse(own), lambda p: p["legend"]), "")
                )

            ranks = F.reverse(F.array_sort(F.array_distinct(F.transform(used, lambda p: p["rank"]))))
            return F.array_join(F.transform(ranks, block), "")

        body = F.array_join(F.transform(parts, lambda p: p["text"]), "")
        return F.struct(
            F.concat(bind(F.filter(parts, lambda p: p["rank"].isNotNull()), head), body).alias("query_readable"),
            F.forall(parts, lambda p: p["resolved"]).alias("resolved"),
        )

    made = bind(_parts("query", sq.id_terms_pattern(), part), whole)
    return found.select(key, F.inline(F.array(made)))


def query_templates(queries: DataFrame, labels: DataFrame, key: str = "id") -> DataFrame:
    """Readable ids and schema PREFIX lines; queries with an unknown id are dropped."""
    readable = readable_ids(queries, labels, key).where("resolved")
    return readable.select(key, sq.prepend_schema_prefixes(F.col("query_readable")).alias("template"))


def flag_parses(templates: DataFrame) -> DataFrame:
    """``valid`` is false for rows whose parse text is a failure message."""
    return templates.withColumn("valid", ~F.col("parsed_query").startswith(PARSE_FAILURE))


def annotation_marks(queries: DataFrame, key: str = "id", text: str = "query") -> DataFrame:
    """One row per ``[entity:…]`` or ``[property:…]`` mark."""
    return queries.select(key, F.posexplode(sq.annotations(F.col(text))).alias("pos", "mark")).select(
        key, "pos", "mark.*"
    )


def resolve_names(names: DataFrame, labels: DataFrame) -> DataFrame:
    """Ids for distinct ``names(kind, name)``.

    Candidates in order: the name in its kind, the name in the other kind, then the same with the
    first word; a name that nothing matches is its own id. All candidates meet the labels in one join.
    """
    other = F.when(F.col("kind") == "entity", "property").otherwise("entity")
    word = F.split_part("name", F.lit(" "), F.lit(1))

    def candidate(rank: int, kind: Column, text: Column) -> Column:
        return F.struct(F.lit(rank).alias("rank"), kind.alias("_kind"), F.lower(text).alias("_text"))

    tries = [
        candidate(0, F.col("kind"), F.col("name")),
        candidate(1, other, F.col("name")),
        candidate(2, F.col("kind"), word),
        candidate(3, other, word),
    ]
    asked = names.distinct().select("kind", "name", F.inline(F.array(*tries)))
    # The search ranking is the lowest id: the first hit per (kind, label).
    known = labels.groupBy(F.col("kind").alias("_kind"), F.lower("label").alias("_text")).agg(
        F.min_by("id", F.struct(F.length("id"), "id")).alias("_id")
    )
    hits = asked.join(known, ["_kind", "_text"], "left")
    best = F.min_by("_id", F.when(F.col("_id").isNotNull(), F.col("rank")))
    return hits.groupBy("kind", "name").agg(best.alias("_best")).select(
        "kind", "name", F.coalesce("_best", "name").alias("id")
    )


def resolve_annotations(queries: DataFrame, labels: DataFrame, key: str = "id", text: str = "query") -> DataFrame:
    """Marks back to ids: the reverse of :func:`annotate_ids`."""
    # The kind has no colon, so kind and name can be told apart again.
    items = F.transform(sq.annotations(F.col(text)), lambda m: F.concat(m["kind"], F.lit(":"), m["name"]))
    asked = _asked(queries, key, items)
    kind, name = F.substring_index("_item", ":", 1), F.expr("substr(_item, instr(_item, ':') + 1)")
    known = resolve_names(asked.select(kind.alias("kind"), name.alias("name")), labels).select(
        F.concat("kind", F.lit(":"), "name").alias("_item"), F.col("id").alias("_label")
    )
    found = _with_known(queries, key, text, asked, known)

    def resolved(mark: Column) -> Column:
        return F.try_element_at("_known", F.substring(mark, 2, F.length(mark) - 2))

    return found.select(key, _replaced(text, sq.ANNOTATION, resolved).alias("query_resolved"))


# --- corpus structure ------------------------------------------------------------------------

def query_structure(queries: DataFrame, key: str = "id") -> DataFrame:
    """Prefixes, projected variables, row limits, value rows and triples of each query."""
    q = F.col("query")
    return queries.select(
        key,
        sq.declared_prefixes(q).alias("prefixes"),
        sq.projected_variables(q).alias("variables"),
        sq.row_limit(q).alias("limit"),
        sq.row_offset(q).alias("offset"),
        sq.value_rows(q).alias("value_rows"),
        sq.triple_count(q).alias("triples"),
    )


def prefix_usage(queries: DataFrame) -> DataFrame:
    """How many queries use each id prefix."""
    used = F.array_distinct(F.transform(sq.id_terms(F.col("query")), sq.term_prefix))
    return queries.select(F.explode(used).alias("prefix")).groupBy("prefix").agg(F.count("*").alias("n_queries"))


def declared_usage(queries: DataFrame) -> DataFrame:
    """(name, url, n_queries): how many queries declare each prefix."""
    declared = F.array_distinct(sq.declared_prefixes(F.col("query")))
    return queries.select(F.inline(declared)).groupBy("name", "url").agg(F.count("*").alias("n_queries"))


def property_usage(queries: DataFrame) -> DataFrame:
    """(property, n_uses, n_queries): how often each property occurs, and in how many queries."""
    ids = F.regexp_extract_all(F.col("query"), F.lit(sq.ID), F.lit(1))
    properties = F.array_sort(F.filter(ids, lambda i: i.startswith("P")))
    used = queries.select(F.posexplode(properties).alias("pos", "property"), properties.alias("all"))
    first = (F.col("pos") == 0) | (F.get("all", F.col("pos") - 1) != F.col("property"))
    return used.groupBy("property").agg(F.count("*").alias("n_uses"), F.count_if(first).alias("n_queries"))


def exact_medians(values: DataFrame, partitions: int | None = None) -> DataFrame:
    """(measure, n, median) of ``values(measure, value)``, exactly; nulls are left out.

    Equal values are counted first, on the map side too; the counts are ranked by a running sum over ranges of
    (measure, value), so neither a measure nor a value is ever one task's.
    """
    counts = values.dropna(subset=["measure", "value"]).groupBy("measure", "value").agg(F.count("*").alias("n"))
    ranked = running_total(counts, ["measure", "value"], "n", "upto", partitions)
    totals = ranked.groupBy("measure").agg(F.sum("n").alias("total"), F.max("upto").alias("end"))
    upto = F.col("upto") - (F.col("end") - F.col("total"))
    low, high = F.ceil(F.col("total") / 2), F.floor(F.col("total") / 2) + 1
    found = ranked.join(totals, "measure").groupBy("measure", "total").agg(
        F.min(F.when(upto >= low, F.col("value"))).alias("low"), F.min(F.when(upto >= high, F.col("value"))).alias("high")
    )
    return found.select("measure", F.col("total").alias("n"), ((F.col("low") + F.col("high")) / 2).alias("median"))


def structure_medians(queries: DataFrame) -> DataFrame:
    """Exact medians of prefixes, variables, value rows and triples per query: (measure, n, median)."""
    structure = query_structure(queries)
    measures = {"prefixes": F.size("prefixes"), "variables": F.size("variables"), "value_rows": F.col("value_rows"), "triples": F.col("triples")}
    pairs = F.array(*[F.struct(F.lit(m).alias("measure"), v.cast("bigint").alias("value")) for m, v in measures.items()])
    return exact_medians(structure.select(F.inline(pairs)))


def complete_triples(triples: DataFrame, fill: tuple[str, ...] = ("s",)) -> DataFrame:
    """``triples(query_id, pos, s, o, …)`` with missing parts taken from the statement before;
    rows that still lack a part are dropped.

    A subject is left out behind ``;``. With ``fill=("s", "p")`` the predicate left out behind ``,`` is filled too.
    """
    parts = [c for c in ("s", "p", "o") if c in triples.columns]
    return forward_fill(triples, "query_id", "pos", list(fill)).dropna(subset=parts)
