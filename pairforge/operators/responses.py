"""Tables around an external text model: prompts out, validated and merged answers in."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairforge.fixed_values import (
    COMPLEXITIES,
    COMPLEXITY_PROMPT,
    INSTRUCTION_PROMPT,
    MESSAGE_OVERHEAD,
    NAME_OVERHEAD,
    PRICE_PER_1000,
    REPLY_OVERHEAD,
)
from pairforge.functions.ngrams import count_words_and_signs
from pairforge.operators.ordered import running_total


def message(role: str, content: Column) -> Column:
    return F.struct(F.lit(role).alias("role"), content.alias("content"))


def _fenced(query: Column) -> Column:
    return F.concat(F.lit("SPARQL query: ```"), query, F.lit("```\n"))


def instruction_messages(with_context: bool = True) -> Column:
    """Messages asking for instructions; without context the description takes its place."""
    context, description = F.col("context"), F.col("description")
    if with_context:
        told = F.when(description != "", F.concat(F.lit('Description: "'), description, F.lit('"\n\n'))).otherwise("")
        lead = F.concat(F.lit('Context: "'), context, F.lit('"\n'), told)
    else:
        lead = F.when(description != "", F.concat(F.lit('Context: "'), description, F.lit('"\n\n'))).otherwise("")
    return F.array(
        message("system", F.lit(INSTRUCTION_PROMPT)), message("user", F.concat(lead, _fenced(F.col("query"))))
    )


def complexity_messages() -> Column:
    return F.array(message("system", F.lit(COMPLEXITY_PROMPT)), message("user", _fenced(F.col("query"))))


def message_tokens(
    messages: Column, model: str = "gpt-3.5-turbo", counter=count_words_and_signs, named: bool = False
) -> Column:
    """Tokens of a chat: overhead per message, every value counted, and the reply priming.

    ``counter`` maps a string Column to its token count; ``named`` says that messages have a
    nullable ``name`` field.
    """

    def one(total: Column, m: Column) -> Column:
        size = counter(m["role"]) + counter(m["content"]) + MESSAGE_OVERHEAD[model]
        if named:
            size = size + F.when(m["name"].isNotNull(), counter(m["name"]) + NAME_OVERHEAD[model]).otherwise(0)
        return total + size

    return F.aggregate(messages, F.lit(REPLY_OVERHEAD), one)


def price(tokens: Column, model: str = "gpt-3.5-turbo") -> Column:
    return tokens / 1000 * PRICE_PER_1000[model]


def cost_estimate(chats: DataFrame, model: str = "gpt-3.5-turbo", tokens: str = "tokens") -> DataFrame:
    return chats.agg(
        F.sum(tokens).alias("total_tokens"),
        F.avg(tokens).alias("mean_tokens"),
        F.max(tokens).alias("max_tokens"),
        price(F.sum(tokens), model).alias("cost"),
    )


def within_budget(log: DataFrame, order: list[str], cost: str, budget: float) -> DataFrame:
    """Requests sent until the accumulated cost reaches the budget, the one that reaches it included."""
    summed = running_total(log, order, cost, "spent")
    return summed.where(F.col("spent") - F.col(cost) < budget)


def parsed_instructions(log: DataFrame, raw: str = "raw") -> DataFrame:
    """``valid`` when the answer is a JSON object with the instruction field (either name)."""
    parsed = F.try_parse_json(raw)
    names = ["instructions", "nl_generation"]
    has = [F.try_variant_get(parsed, f"$.{n}", "variant").isNotNull() for n in names]
    lists = [F.try_variant_get(parsed, f"$.{n}", "array<string>") for n in names]
    texts = [F.try_variant_get(parsed, f"$.{n}", "string") for n in names]
    single = F.coalesce(*texts)
    valid = has[0] | has[1]
    return log.withColumns(
        {
            "instructions": F.when(
                valid, F.coalesce(*lists, F.when(single.isNotNull(), F.array(single)))
            ),
            "valid": F.coalesce(valid, F.lit(False)),
        }
    )


def parsed_complexity(log: DataFrame, raw: str = "raw") -> DataFrame:
    """``valid`` when the answer is a JSON object with both fields; ``known`` when the class is one of three."""
    parsed = F.try_parse_json(raw)
    level = F.try_variant_get(parsed, "$.complexity", "string")
    told = F.try_variant_get(parsed, "$.complexity_description", "string")
    return log.withColumns(
        {
            "complexity": level,
            "complexity_description": told,
            "valid": level.isNotNull() & told.isNotNull(),
            "known": F.coalesce(level.isin(COMPLEXITIES), F.lit(False)),
        }
    )


def pending(seeds: DataFrame, log: DataFrame, key: str = "id") -> DataFrame:
    """Seeds without a valid answer yet."""
    return seeds.join(log.where("valid").select(key).distinct(), key, "left_anti")


def latest(log: DataFrame, key: str = "id", attempt: str = "attempt") -> DataFrame:
    """The newest answer per key; ``max_by`` folds repeats on the map side, so hot keys stay small."""
    rest = [c for c in log.columns if c != key]
    newest = log.groupBy(key).agg(F.max_by(F.struct(*rest), attempt).alias("_row"))
    return newest.select(key, "_row.*")


def upserted(old: DataFrame, new: DataFrame, key: str = "id", attempt: str = "attempt") -> DataFrame:
    """Old answers with new ones added or put in their place."""
    return latest(old.unionByName(new), key, attempt)


def extended(seeds: DataFrame, answers: DataFrame, key: str = "id") -> DataFrame:
    """Seeds with the instructions of their answer, where there is one."""
    return seeds.join(answers.select(key, "instructions"), key, "left")


def progress(log: DataFrame) -> DataFrame:
    return log.agg(F.count("*").alias("done"), F.count_if(~F.col("valid")).alias("invalid"))
