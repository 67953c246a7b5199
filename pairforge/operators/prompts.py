"""Prompts and training text from question-query rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairforge.fixed_values import ANNOTATED_PROMPT, END_TAG, PLAIN_PROMPT, START_TAG
from pairforge.functions import chat
from pairforge.operators.responses import message


def system_prompt(annotated: Column | bool) -> Column:
    if isinstance(annotated, bool):
        return F.lit(ANNOTATED_PROMPT if annotated else PLAIN_PROMPT)
    return F.when(annotated, ANNOTATED_PROMPT).otherwise(PLAIN_PROMPT)


def target_query(annotated: Column | bool) -> Column:
    if isinstance(annotated, bool):
        return F.col("sparql_annotated" if annotated else "sparql_query")
    return F.when(annotated, F.col("sparql_annotated")).otherwise(F.col("sparql_query"))


def answer(query: Column, start: str = START_TAG, end: str = END_TAG) -> Column:
    return F.concat(F.lit(f"Here is the SPARQL query:\n\n{start}\n"), query, F.lit(f"\n{end}\n"))


def plain_prompt(instruction: Column, query: Column, train: Column | bool, annotated: Column | bool = False) -> Column:
    """``### Question`` / ``### Answer`` text; only training text holds the answer."""
    train = F.lit(train) if isinstance(train, bool) else train
    return F.concat(
        system_prompt(annotated), F.lit("\n\n### Question: "), instruction, F.lit("\n### Answer: "),
        F.when(train, answer(query)).otherwise(""),
    )


def chat_messages(instruction: Column, query: Column, train: Column | bool, annotated: Column | bool = False) -> Column:
    """System and user message, and for training the answer."""
    train = F.lit(train) if isinstance(train, bool) else train
    asked = F.array(message("system", system_prompt(annotated)), message("user", instruction))
    return F.when(train, F.array_append(asked, message("assistant", answer(query)))).otherwise(asked)


def eval_messages(instruction: Column, few_shots: Column, annotated: Column | bool = False) -> Column:
    """Evaluation chat; a few-shot text follows the system prompt."""
    base = system_prompt(annotated)
    system = F.when(few_shots != "", F.concat(base, F.lit("\n\n "), few_shots)).otherwise(base)
    return F.array(message("system", system), message("user", instruction))


def render_chats(chats: DataFrame, model_type: str = "format", cue: bool = False) -> DataFrame:
    """Rendered ``text``; a chat that its format refuses is retried with the system text merged into
    the first user message, and has null text if that is refused too."""
    messages, kind = F.col("messages"), F.col(model_type)
    merged = chat.merge_system_into_user(messages)
    return chats.withColumns(
        {
            "text": F.when(chat.accepted(messages, kind), chat.render(messages, kind, cue)).when(
                chat.accepted(merged, kind), chat.render(merged, kind, cue)
            ),
            "alternates": chat.roles_alternate(messages),
        }
    )


def rejected(rendered: DataFrame) -> DataFrame:
    """Chats no rendering accepts."""
    return rendered.where("text is null")
