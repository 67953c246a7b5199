"""Chat rendering: messages (``array<struct<role,content>>``) to one prompt string, all as Columns."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from pairforge.fixed_values import QWEN_SYSTEM, QWEN_TOOLS_HEAD, QWEN_TOOLS_TAIL
from pairforge.functions.binding import bind
from pairforge.functions.text import strip_all


@dataclass(frozen=True)
class Marks:
    """Special tokens of a chat format."""

    bos: str
    eos: str
    pad: str
    assistant: str
    response: str


# Special tokens, assistant cues and response templates of the chat formats.
MARKS = {
    "chatml": Marks("<|im_start|>", "<|im_end|>", "<|im_end|>", "<|im_start|>assistant",
                    "\n<|im_start|>assistant\n Here is the SPARQL"),
    "mistral": Marks("<s>", "</s>", "</s>", "[/INST]", " [/INST] Here is the SPARQL"),
    "llama": Marks("<s>", "</s>", "</s>", "[/INST]", " [/INST] Here is the SPARQL"),
    "llama3": Marks("<|begin_of_text|>", "<|eot_id|>", "<|eot_id|>",
                    "<|start_header_id|>assistant<|end_header_id|>\n\n",
                    "<|eot_id|><|start_header_id|>assistant<|end_header_id|>\n\nHere is the SPARQL"),
    "phi3": Marks("<|startoftext|>", "<|endoftext|>", "<|endoftext|>", "<|assistant|>\n",
                  "\n<|assistant|>\nHere is the SPARQL"),
    "qwen2": Marks("<|im_start|>", "<|im_end|>", "<|endoftext|>", "<|im_start|>assistant",
                   "\n<|im_start|>assistant\nHere is the SPARQL"),
}
DEFAULT_FORMAT = "chatml"


def _first(messages: Column) -> Column:
    return F.get(messages, F.lit(0))


def has_system(messages: Column) -> Column:
    return F.coalesce(_first(messages)["role"] == "system", F.lit(False))


def _without_system(messages: Column) -> Column:
    return F.when(has_system(messages), F.slice(messages, 2, F.size(messages))).otherwise(messages)


def _joined(messages: Column, render) -> Column:
    return F.array_join(F.transform(messages, render), "")


def _cue(text: str, wanted: bool) -> Column:
    return F.lit(text if wanted else "")


def render_chatml(messages: Column, cue: bool = False) -> Column:
    m = MARKS["chatml"]
    body = _joined(
        messages,
        lambda x: F.concat(F.lit(m.bos), x["role"], F.lit("\n"), x["content"], F.lit(m.eos + "\n")),
    )
    return F.concat(body, _cue(m.assistant + "\n", cue))


def render_mistral(messages: Column, cue: bool = False) -> Column:
    """The system text opens the first instruction; roles other than user and assistant render nothing."""
    m = MARKS["mistral"]
    system = F.when(has_system(messages), F.concat(strip_all(_first(messages)["content"]), F.lit("\n\n"))).otherwise("")

    def turn(x: Column) -> Column:
        text = strip_all(x["content"])
        return (
            F.when(x["role"] == "user", F.concat(text, F.lit(" [/INST]")))
            .when(x["role"] == "assistant", F.concat(F.lit(" "), text, F.lit(m.eos)))
            .otherwise("")
        )

    return F.concat(F.lit(m.bos + "[INST] "), system, _joined(_without_system(messages), turn))


def render_llama(messages: Column, cue: bool = False) -> Column:
    m = MARKS["llama"]
    system = F.when(
        has_system(messages),
        F.concat(F.lit("<<SYS>>\n"), strip_all(_first(messages)["content"]), F.lit("\n<</SYS>>\n\n")),
    ).otherwise("")

    def turn(x: Column, i: Column) -> Column:
        text = strip_all(F.when(i == 0, F.concat(system, x["content"])).otherwise(x["content"]))
        return (
            F.when(x["role"] == "user", F.concat(F.lit(m.bos + "[INST] "), text, F.lit(" [/INST]")))
            .when(x["role"] == "assistant", F.concat(F.lit(" "), text, F.lit(" " + m.eos)))
            .otherwise("")
        )

    return _joined(_without_system(messages), turn)


def render_llama3(messages: Column, cue: bool = False) -> Column:
    m = MARKS["llama3"]
    body = _joined(
        messages,
        lambda x: F.concat(
            F.lit("<|start_header_id|>"), x["role"], F.lit("<|end_header_id|>\n\n"), strip_all(x["content"]), F.lit(m.eos)
        ),
    )
    return F.concat(F.lit(m.bos), body, _cue(m.assistant, cue))


def render_phi3(messages: Column, cue: bool = False) -> Column:
    m = MARKS["phi3"]
    body = _joined(
        messages,
        lambda x: F.concat(F.lit("<|"), x["role"], F.lit("|>\n"), strip_all(x["content"]), F.lit("<|end|>\n")),
    )
    return F.concat(F.lit(m.bos), body, _cue(m.assistant, cue))


def render_qwen2(
    messages: Column, cue: bool = False, tools: Column | None = None, calls: bool = False
) -> Column:
    """Qwen2 text. ``tools`` is an array of JSON texts, empty or null meaning none; ``calls`` says that
    messages have ``tool_calls array<struct<name,arguments>>`` with arguments as JSON text."""
    m = MARKS["qwen2"]
    system = F.when(has_system(messages), _first(messages)["content"]).otherwise(QWEN_SYSTEM)
    plain_head = F.concat(F.lit("<|im_start|>system\n"), system, F.lit("<|im_end|>\n"))
    head = plain_head
    if tools is not None:
        listing = _joined(tools, lambda t: F.concat(F.lit("\n"), t))
        with_tools = F.concat(
            F.lit("<|im_start|>system\n"), system, F.lit(QWEN_TOOLS_HEAD), listing, F.lit(QWEN_TOOLS_TAIL)
        )
        head = F.when(F.size(tools) > 0, with_tools).otherwise(plain_head)
    return F.concat(head, _joined(messages, _qwen2_turn(messages, calls)), _cue(m.assistant + "\n", cue))


def _qwen2_turn(messages: Column, calls: bool):
    def turn(x: Column, i: Column) -> Column:
        role, content = x["role"], x["content"]
        said = F.concat(F.lit("<|im_start|>"), role, F.lit("\n"), content, F.lit("<|im_end|>\n"))
        before = F.get(messages, i - 1)["role"]
        after = F.get(messages, i + 1)["role"]
        reply = F.concat(
            F.when((i == 0) | (before != "tool"), "<|im_start|>user").otherwise(""),
            F.lit("\n<tool_response>\n"), content, F.lit("\n</tool_response>"),
            F.when(after.isNull() | (after != "tool"), "<|im_end|>\n").otherwise(""),
        )
        out = F.when((role == "system") & (i == 0), "").when(role == "tool", reply)
        if calls:
            called = _joined(
                x["tool_calls"],
                lambda c: F.concat(
                    F.lit('\n<tool_call>\n{"name": "'), c["name"], F.lit('", "arguments": '), c["arguments"],
                    F.lit("}\n</tool_call>"),
                ),
            )
            lead = F.when(F.coalesce(content, F.lit("")) != "", F.concat(F.lit("\n"), content)).otherwise("")
            out = out.when(
                (role == "assistant") & (F.size(x["tool_calls"]) > 0),
                F.concat(F.lit("<|im_start|>"), role, lead, called, F.lit("<|im_end|>\n")),
            )
        return out.when(role.isin("user", "system", "assistant"), said).otherwise("")

    return turn


RENDERERS = {
    "chatml": render_chatml,
    "mistral": render_mistral,
    "llama": render_llama,
    "llama3": render_llama3,
    "phi3": render_phi3,
    "qwen2": render_qwen2,
}
# Formats that refuse a chat whose roles do not alternate, starting with the user.
STRICT_FORMATS = ["mistral", "llama", "llama3", "phi3"]


def roles_alternate(messages: Column) -> Column:
    """Whether user turns are exactly every other message after an optional system message."""
    turns = _without_system(messages)
    flags = F.transform(turns, lambda x, i: (x["role"] == "user") == (i % 2 == 0))
    return F.forall(flags, lambda ok: ok)


def accepted(messages: Column, model_type: Column) -> Column:
    """Whether the format of the model type renders the chat at all."""
    return ~F.coalesce(model_type.isin(STRICT_FORMATS), F.lit(False)) | roles_alternate(messages)


def render(messages: Column, model_type: Column, cue: bool = False) -> Column:
    """Render by model type; unknown types use the default format."""


    def by_type(m: Column) -> Column:
        out = RENDERERS[DEFAULT_FORMAT](m, cue)
        for name, renderer in RENDERERS.items():
            if name != DEFAULT_FORMAT:
                out = F.when(model_type == name, renderer(m, cue)).otherwise(out)
        return out

    return bind(messages, by_type)


def merge_system_into_user(messages: Column) -> Column:
    """Fold the system text into the first user message, for formats without a system role."""
    rest = _without_system(messages)
    merged = F.transform(
        rest,
        lambda x, i: F.struct(
            x["role"].alias("role"),
            F.when(i == 0, F.concat(_first(messages)["content"], F.lit("\n\n"), x["content"]))
            .otherwise(x["content"])
            .alias("content"),
        ),
    )
    return F.when(has_system(messages), merged).otherwise(messages)
