"""Pages to a clean and annotated query table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairforge.operators import annotate, clean, extract
from pairforge.operators.ordered import dense_index


def query_corpus(pages: DataFrame, redirects: DataFrame) -> DataFrame:
    """All queries of the pages, cleaned, with ids 0..n-1 in page order."""
    found = extract.harvested(
        extract.template_queries(pages), extract.link_queries(pages), extract.short_link_queries(pages, redirects)
    )
    tidy = clean.strip_comments(clean.remove_styling(clean.clean_queries(found)))
    return dense_index(tidy, ["page_id", "origin", "section_id", "pos"], "id")


def annotated_corpus(corpus: DataFrame, labels: DataFrame) -> DataFrame:
    """The corpus with a column in which ids are replaced by labels."""
    return corpus.join(annotate.annotate_queries(corpus.select("id", "query"), labels), "id")


def corpus_profile(corpus: DataFrame) -> DataFrame:
    """Size and shape of the corpus in one row; medians are exact."""
    shape = annotate.query_structure(corpus).agg(
        F.count("*").alias("n_queries"),
        F.avg("triples").alias("mean_triples"),
        F.count("limit").alias("n_limited"),
    )
    medians = annotate.structure_medians(corpus).agg(
        *[F.max(F.when(F.col("measure") == m, F.col("median"))).alias(f"median_{m}") for m in ("variables", "triples")]
    )
    one = F.lit(1).alias("_one")
    return shape.select(one, "*").join(medians.select(one, "*"), "_one").drop("_one")
