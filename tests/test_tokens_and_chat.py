"""Loss masks against a plain loop, and chat formats against written-out text."""

import random

import pytest
from pyspark.sql import functions as F

from pairforge.functions import chat
from pairforge.functions import tokens as tk

M = -100


def starts(tokens, template):
    return [i for i in range(len(tokens) - len(template) + 1) if tokens[i:i + len(template)] == template]


def loop_completion(tokens, response):
    found = starts(tokens, response)
    if not found:
        return [M] * len(tokens)
    end = found[-1] + len(response)
    return [M] * end + tokens[end:]


def loop_multi_turn(tokens, response, human):
    labels = list(tokens)
    ends = [i + len(response) for i in starts(tokens, response)]
    heads = starts(tokens, human)
    if not ends or not heads:
        return [M] * len(tokens)
    if heads[0] > ends[0]:
        heads = [0, *heads]
    for k, (a, b) in enumerate(zip(heads, ends)):
        for i in range(a if k else 0, b):
            labels[i] = M
    if len(ends) < len(heads):
        for i in range(heads[-1], len(labels)):
            labels[i] = M
    return labels


def test_masks_equal_a_plain_loop(spark):
    rng = random.Random(5)
    rows = [(i, [rng.randint(1, 4) for _ in range(rng.randint(1, 30))]) for i in range(300)]
    response, human = [1, 2], [3, 1]
    lit = lambda xs: F.array(*[F.lit(x) for x in xs])
    t = F.col("t")
    frame = spark.createDataFrame(rows, "id int, t array<int>").select(
        "id",
        tk.completion_labels(t, lit(response)).alias("a"),
        tk.multi_turn_labels(t, lit(response), lit(human)).alias("b"),
        tk.prompt_attention(t, lit(response)).alias("c"),
        tk.pad_right(t, 12, 0).alias("d"),
        tk.kept_ids(t, lit([2, 3])).alias("e"),
    )
    got = {r["id"]: r for r in frame.collect()}
    for i, tokens in rows:
        assert got[i]["a"] == loop_completion(tokens, response)
        assert got[i]["b"] == loop_multi_turn(tokens, response, human)
        found = starts(tokens, response)
        keep = found[-1] + 2 if found else len(tokens)
        assert got[i]["c"] == [1] * keep + [0] * (len(tokens) - keep)
        assert got[i]["d"] == tokens + [0] * max(0, 12 - len(tokens))
        assert got[i]["e"] == [x for x in tokens if x in (2, 3)]


def test_the_last_label_is_restored_before_masking(spark):
    rows = [(1, [5, 6, 7]), (2, [5, 1, 2]), (3, [1, 2, 9, 8])]  # no template, one at the end, one before
    frame = spark.createDataFrame(rows, "id int, tokens array<int>")
    tokens, template = F.col("tokens"), F.array(F.lit(1), F.lit(2))
    padded = F.transform(tokens, lambda t, i: F.when(i == F.size(tokens) - 1, F.lit(-100)).otherwise(t))
    fixed = tk.completion_labels(tokens, template, tk.keep_last_token(padded, tokens))
    got = {r["id"]: r["x"] for r in frame.select("id", fixed.alias("x")).collect()}
    assert got == {1: [-100] * 3, 2: [-100] * 3, 3: [-100, -100, 9, 8]}


CHAT = [("system", " S "), ("user", " U "), ("assistant", " A ")]
TEXTS = {
    "chatml": "<|im_start|>system\n S <|im_end|>\n<|im_start|>user\n U <|im_end|>\n<|im_start|>assistant\n A <|im_end|>\n",
    "mistral": "<s>[INST] S\n\nU [/INST] A</s>",
    "llama": "<s>[INST] <<SYS>>\nS\n<</SYS>>\n\n U [/INST] A </s>",
    "llama3": "<|begin_of_text|><|start_header_id|>system<|end_header_id|>\n\nS<|eot_id|>"
    "<|start_header_id|>user<|end_header_id|>\n\nU<|eot_id|><|start_header_id|>assistant<|end_header_id|>\n\nA<|eot_id|>",
    "phi3": "<|startoftext|><|system|>\nS<|end|>\n<|user|>\nU<|end|>\n<|assistant|>\nA<|end|>\n",
    "qwen2": "<|im_start|>system\n S <|im_end|>\n<|im_start|>user\n U <|im_end|>\n<|im_start|>assistant\n A <|im_end|>\n",
}


@pytest.mark.parametrize("name", TEXTS)
def test_chat_text(spark, name):
    rows = spark.createDataFrame([(CHAT, name)], "m array<struct<role:string,content:string>>, f string")
    assert rows.select(chat.render(F.col("m"), F.col("f")).alias("x")).first()["x"] == TEXTS[name]


def test_unknown_type_renders_as_default_and_roles_are_checked(spark):
    rows = spark.createDataFrame(
        [(CHAT, "new"), ([("user", "a"), ("user", "b")], "llama3"), ([("assistant", "a")], "qwen2")],
        "m array<struct<role:string,content:string>>, f string",
    )
    m, f = F.col("m"), F.col("f")
    got = rows.select(chat.render(m, f).alias("x"), chat.roles_alternate(m).alias("ok"), chat.accepted(m, f).alias("use")).collect()
    assert got[0]["x"] == TEXTS["chatml"] and got[0]["ok"]
    assert not got[1]["ok"] and not got[1]["use"]
    assert not got[2]["ok"] and got[2]["use"]
