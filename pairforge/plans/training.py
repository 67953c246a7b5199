"""Published rows to rendered training and evaluation chats."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairforge.functions import chat
from pairforge.operators import assemble, prompts, retrieve
from pairforge.session import pinned


def training_text(
    rows: DataFrame, model_type: str, annotated: bool = False, samples: int = 1, seed: int = 0
) -> DataFrame:
    """One rendered chat per sampled instruction: narrow from scan to text."""
    drawn = assemble.sampled_instructions(rows, samples, seed)
    chats = drawn.select(
        "id",
        "draw",
        prompts.chat_messages(F.col("instruction"), prompts.target_query(annotated), True, annotated).alias("messages"),
        F.lit(model_type).alias("format"),
    )
    return prompts.render_chats(chats).select("id", "draw", "text")


def evaluation_prompts(
    test: DataFrame, train: DataFrame, ranked: DataFrame, model_type: str, shots: int, annotated: bool = False
) -> DataFrame:
    """Prompts of test rows with their nearest training rows as shots.

    ``ranked(query_id, base_id, rank)`` comes from ``cosine_top_k`` over the ids of both tables.
    """
    target = "sparql_annotated" if annotated else "sparql_query"
    pool = train.select(F.col("id").alias("base_id"), F.get("instructions", F.lit(0)).alias("instruction"), target)
    blocks = retrieve.shot_blocks(ranked, pool, shots, target).withColumnRenamed("query_id", "id")
    asked = assemble.first_instructions(test, 1).join(blocks, "id", "left")
    messages = prompts.eval_messages(F.col("instruction"), F.coalesce("few_shots", F.lit("")), annotated)
    return asked.select("id", chat.render(messages, F.lit(model_type), cue=True).alias("prompt"))


def few_shots(
    test: DataFrame, train: DataFrame, vectors: DataFrame, k: int = 10, shots: int = 3, words: int = 300,
    length_of: str = "sparql_query", annotated: bool = False,
) -> DataFrame:
    """(query_id, neighbours, few_shots): nearest short training rows of each test row, as ids and as prompt text.

    ``vectors(id, embedding)`` holds the instructions' vectors of both tables. Training rows of ``words`` words or
    more (counted in ``length_of``) are left out before the search, so that no place of the k goes to them.
    """
    pool = retrieve.retrieval_pool(train, length_of, words)
    vector = lambda rows, name: rows.select("id").join(vectors, "id").select(F.col("id").alias(name), F.col("embedding").alias("vector"))
    ranked = pinned(retrieve.cosine_top_k(vector(test, "query_id"), vector(pool, "base_id"), k))
    target = "sparql_annotated" if annotated else "sparql_query"
    base = pool.select(F.col("id").alias("base_id"), F.get("instructions", F.lit(0)).alias("instruction"), target)
    return retrieve.neighbour_lists(ranked).join(retrieve.shot_blocks(ranked, base, shots, target), "query_id")
