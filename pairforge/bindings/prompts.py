"""Prompt rendering, chat formats and loss masks."""

from pyspark.sql import functions as F

from pairforge.bindings import query
from pairforge.bindings.inputs import PAIR_CTE, ROW_CTE, question_rows, table, turn_pairs
from pairforge.bindings.responses import _sql_text
from pairforge.fixed_values import ANNOTATED_PROMPT, PLAIN_PROMPT, QWEN_SYSTEM, QWEN_TOOLS_HEAD, QWEN_TOOLS_TAIL
from pairforge.functions import chat
from pairforge.functions import tokens as tk
from pairforge.operators import prompts as pr

_PLAIN, _ANNOTATED = _sql_text(PLAIN_PROMPT), _sql_text(ANNOTATED_PROMPT)
_IS_ANNOTATED = "id % 2 = 1"
_SYSTEM = f"CASE WHEN {_IS_ANNOTATED} THEN {_ANNOTATED} ELSE {_PLAIN} END"
_TARGET = f"CASE WHEN {_IS_ANNOTATED} THEN sparql_annotated ELSE sparql_query END"
_ANSWER = f"'Here is the SPARQL query:' || chr(10) || chr(10) || '[QUERY]' || chr(10) || {_TARGET} || chr(10) || '[/QUERY]' || chr(10)"


def _rows(spark, sf):
    return question_rows(spark, sf).withColumns(
        {"annotated": F.expr(_IS_ANNOTATED), "instruction": F.get("instructions", F.lit(0))}
    )


@query("P1_system_prompt_and_target", f"WITH {ROW_CTE} SELECT id, {_SYSTEM} AS system, {_TARGET} AS target FROM question_rows")
def system_prompt_and_target(spark, sf):
    flag = F.col("annotated")
    return _rows(spark, sf).select("id", pr.system_prompt(flag).alias("system"), pr.target_query(flag).alias("target"))


@query("P2_answer", f"WITH {ROW_CTE} SELECT id, {_ANSWER} AS answer FROM question_rows")
def answer(spark, sf):
    return _rows(spark, sf).select("id", pr.answer(pr.target_query(F.col("annotated"))).alias("answer"))


@query(
    "P3_plain_prompt",
    f"""WITH {ROW_CTE} SELECT id, {_SYSTEM} || chr(10) || chr(10) || '### Question: ' || instructions[1] || chr(10) || '### Answer: '
  || CASE WHEN split = 'train' THEN {_ANSWER} ELSE '' END AS text FROM question_rows""",
)
def plain_prompt(spark, sf):
    flag, train = F.col("annotated"), F.col("split") == "train"
    text = pr.plain_prompt(F.col("instruction"), pr.target_query(flag), train, flag)
    return _rows(spark, sf).select("id", text.alias("text"))


def _flat(messages):
    return F.array_join(F.transform(messages, lambda m: F.concat(m["role"], F.lit("="), m["content"])), "|")


@query(
    "P4_chat_messages",
    f"""WITH {ROW_CTE} SELECT id, 'system=' || {_SYSTEM} || '|user=' || instructions[1]
  || CASE WHEN split = 'train' THEN '|assistant=' || {_ANSWER} ELSE '' END AS messages FROM question_rows""",
)
def chat_messages(spark, sf):
    flag, train = F.col("annotated"), F.col("split") == "train"
    rows = pr.chat_messages(F.col("instruction"), pr.target_query(flag), train, flag)
    return _rows(spark, sf).select("id", _flat(rows).alias("messages"))


@query(
    "P5_eval_messages",
    f"""WITH {ROW_CTE} SELECT id, 'system=' || {_SYSTEM} || CASE WHEN id % 3 = 0 THEN '' ELSE chr(10) || chr(10) || ' Examples:' || complexity END
  || '|user=' || instructions[1] AS messages FROM question_rows""",
)
def eval_messages(spark, sf):
    shots = F.expr("CASE WHEN id % 3 = 0 THEN '' ELSE 'Examples:' || complexity END")
    rows = pr.eval_messages(F.col("instruction"), shots, F.col("annotated"))
    return _rows(spark, sf).select("id", _flat(rows).alias("messages"))


# --- chats: a user turn and its reply, with a system text on two thirds, the wrong order on some ------

_S = "CASE WHEN id % 3 <> 0 THEN ' Be brief ' || id || chr(10) END"
_SWAP = "id % 11 = 5"
_FIRST_ROLE, _SECOND_ROLE = f"CASE WHEN {_SWAP} THEN 'assistant' ELSE 'user' END", f"CASE WHEN {_SWAP} THEN 'user' ELSE 'assistant' END"
_FORMAT = "CASE id % 7 WHEN 0 THEN 'chatml' WHEN 1 THEN 'mistral' WHEN 2 THEN 'llama' WHEN 3 THEN 'llama3' WHEN 4 THEN 'phi3' WHEN 5 THEN 'qwen2' ELSE 'gemma' END"
_CHAT_CTE = f"""{PAIR_CTE}, chats AS (SELECT id, {_S} AS s, {_FIRST_ROLE} AS r1, ' ' || target AS c1, {_SECOND_ROLE} AS r2, reply || chr(10) AS c2,
  {_FORMAT} AS format, NOT ({_SWAP}) AS good FROM turn_pairs)"""


def _chats(spark, sf):
    message = lambda role, content: F.struct(F.expr(role).alias("role"), F.expr(content).alias("content"))
    turns = F.array(message(_FIRST_ROLE, "' ' || target"), message(_SECOND_ROLE, "reply || chr(10)"))
    system = F.array(message("'system'", _S))
    return turn_pairs(spark, sf).select(
        "id", F.when(F.expr("id % 3 <> 0"), F.concat(system, turns)).otherwise(turns).alias("messages"),
        F.expr(_FORMAT).alias("format"), F.expr(f"NOT ({_SWAP})").alias("good"),
    )


def _trim(x):
    return f"regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"


_NL = "chr(10)"


def _each(turn, with_system=True):
    """The rendering of two turns, and of the system message where it is a turn like the others."""
    parts = [turn.format(role="r1", content="c1"), turn.format(role="r2", content="c2")]
    if with_system:
        parts.insert(0, "coalesce(" + turn.format(role="'system'", content="s") + ", '')")
    return " || ".join(f"({p})" for p in parts)


_CHATML_TURN = f"'<|im_start|>' || {{role}} || {_NL} || {{content}} || '<|im_end|>' || {_NL}"
_MISTRAL_TURN = f"CASE {{role}} WHEN 'user' THEN {_trim('{content}')} || ' [/INST]' ELSE ' ' || {_trim('{content}')} || '</s>' END"
_LLAMA_TURN = f"CASE {{role}} WHEN 'user' THEN '<s>[INST] ' || {_trim('{content}')} || ' [/INST]' ELSE ' ' || {_trim('{content}')} || ' </s>' END"
_LLAMA3_TURN = f"'<|start_header_id|>' || {{role}} || '<|end_header_id|>' || {_NL} || {_NL} || {_trim('{content}')} || '<|eot_id|>'"
_PHI3_TURN = f"'<|' || {{role}} || '|>' || {_NL} || {_trim('{content}')} || '<|end|>' || {_NL}"
_RENDERED = {
    "chatml": f"{_each(_CHATML_TURN)} || '<|im_start|>assistant' || {_NL}",
    "mistral": f"'<s>[INST] ' || coalesce({_trim('s')} || {_NL} || {_NL}, '') || {_each(_MISTRAL_TURN, False)}",
    "llama": "(" + _LLAMA_TURN.format(role="r1", content=f"(coalesce('<<SYS>>' || {_NL} || {_trim('s')} || {_NL} || '<</SYS>>' || {_NL} || {_NL}, '') || c1)")
    + ") || (" + _LLAMA_TURN.format(role="r2", content="c2") + ")",
    "llama3": f"'<|begin_of_text|>' || {_each(_LLAMA3_TURN)} || '<|start_header_id|>assistant<|end_header_id|>' || {_NL} || {_NL}",
    "phi3": f"'<|startoftext|>' || {_each(_PHI3_TURN)} || '<|assistant|>' || {_NL}",
    "qwen2": _CHATML_TURN.format(role="'system'", content=f"coalesce(s, '{QWEN_SYSTEM}')") + f" || {_each(_CHATML_TURN, False)} || '<|im_start|>assistant' || {_NL}",
}


def _register_format(number: int, name: str) -> None:
    @query(f"P{number}_render_{name}", f"WITH {_CHAT_CTE} SELECT id, {_RENDERED[name]} AS text FROM chats WHERE good")
    def rendered(spark, sf):
        text = chat.RENDERERS[name](F.col("messages"), True)
        return _chats(spark, sf).where("good").select("id", text.alias("text"))


for _number, _name in enumerate(_RENDERED, 6):
    _register_format(_number, _name)

_TOOL = '{"name": "search", "parameters": {}}'


@query(
    "P11_render_qwen2_tools",
    f"""WITH {_CHAT_CTE} SELECT id, '<|im_start|>system' || {_NL} || coalesce(s, '{QWEN_SYSTEM}')
  || CASE WHEN id % 2 = 0 THEN {_sql_text(QWEN_TOOLS_HEAD)} || {_NL} || '{_TOOL}' || {_sql_text(QWEN_TOOLS_TAIL)} ELSE '<|im_end|>' || {_NL} END
  || '<|im_start|>user' || {_NL} || c1 || '<|im_end|>' || {_NL}
  || '<|im_start|>assistant' || CASE WHEN id % 5 = 0 THEN '' ELSE {_NL} || 'Let me see' END || {_NL} || '<tool_call>' || {_NL}
  || '{{"name": "search", "arguments": {{"q": ' || id || '}}}}' || {_NL} || '</tool_call><|im_end|>' || {_NL}
  || '<|im_start|>user' || {_NL} || '<tool_response>' || {_NL} || c2 || {_NL} || '</tool_response>' || {_NL} || '<tool_response>' || {_NL}
  || 'done' || {_NL} || '</tool_response><|im_end|>' || {_NL}
  || '<|im_start|>assistant' || {_NL} || 'ok<|im_end|>' || {_NL} AS text FROM chats""",
)
def render_qwen2_tools(spark, sf):
    none = F.array().cast("array<struct<name:string,arguments:string>>")
    call = F.array(F.struct(F.lit("search").alias("name"), F.expr("""'{"q": ' || id || '}'""").alias("arguments")))

    def message(role, content, calls=none):
        return F.struct(F.lit(role).alias("role"), content.alias("content"), calls.alias("tool_calls"))

    turns = F.array(
        message("user", F.expr("' ' || target")),
        message("assistant", F.expr("CASE WHEN id % 5 = 0 THEN '' ELSE 'Let me see' END"), call),
        message("tool", F.expr("reply || chr(10)")),
        message("tool", F.lit("done")),
        message("assistant", F.lit("ok")),
    )
    system = F.array(message("system", F.expr(_S)))
    messages = F.when(F.expr("id % 3 <> 0"), F.concat(system, turns)).otherwise(turns)
    tools = F.when(F.expr("id % 2 = 0"), F.array(F.lit(_TOOL))).otherwise(F.array().cast("array<string>"))
    rows = turn_pairs(spark, sf).select("id", messages.alias("messages"), tools.alias("tools"))
    return rows.select("id", chat.render_qwen2(F.col("messages"), False, F.col("tools"), calls=True).alias("text"))


@query("P12_roles_alternate", f"WITH {_CHAT_CTE} SELECT id, good AS alternates FROM chats")
def roles_alternate(spark, sf):
    return _chats(spark, sf).select("id", chat.roles_alternate(F.col("messages")).alias("alternates"))


@query(
    "P13_merge_system",
    f"""WITH {_CHAT_CTE} SELECT id, r1 || '=' || coalesce(s || {_NL} || {_NL}, '') || c1 || '|' || r2 || '=' || c2 AS messages FROM chats""",
)
def merge_system(spark, sf):
    return _chats(spark, sf).select("id", _flat(chat.merge_system_into_user(F.col("messages"))).alias("messages"))


_BY_FORMAT = "CASE format " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in _RENDERED.items()) + f" ELSE {_RENDERED['chatml']} END"


@query(
    "P14_render_by_model_type",
    f"""WITH {_CHAT_CTE} SELECT id, format, good AS alternates,
  coalesce(CASE WHEN good OR format IN ('chatml', 'qwen2', 'gemma') THEN {_BY_FORMAT} END, 'rejected') AS text FROM chats""",
)
def render_by_model_type(spark, sf):
    rows = pr.render_chats(_chats(spark, sf), cue=True)
    return rows.select("id", "format", "alternates", F.coalesce("text", F.lit("rejected")).alias("text"))


# --- token arrays: word lengths of each turn -----------------------------------------------------------

_RESPONSE, _HUMAN = [2, 3], [5, 2]
_TOKEN_CTE = """words AS (SELECT conv_id * 1000 + turn AS id, string_split(text, ' ') AS ws FROM conversations),
toks AS (SELECT id, unnest(ws) AS w, generate_subscripts(ws, 1) - 1 AS i, len(ws) AS n FROM words),
tok AS (SELECT id, i, n, length(w)::INT AS t, lead(length(w)) OVER (PARTITION BY id ORDER BY i) AS t2 FROM toks),
ends AS (SELECT id, i + 2 AS b, row_number() OVER (PARTITION BY id ORDER BY i) AS k FROM tok WHERE t = 2 AND t2 = 3),
heads AS (SELECT id, i AS a FROM tok WHERE t = 5 AND t2 = 2),
tail AS (SELECT id, max(b) AS b FROM ends GROUP BY id)"""


def _tokens(spark, sf):
    words = F.split("text", " ", -1)
    return table(spark, sf, "conversations").select(
        F.expr("conv_id * 1000 + turn").alias("id"), F.transform(words, F.length).alias("tokens")
    )


def _ints(values):
    return F.array(*[F.lit(v) for v in values])


def _row_per_array(name, value):
    return f"string_agg({value}, ',' ORDER BY i) AS {name}"


@query(
    "P15_completion_labels",
    f"""WITH {_TOKEN_CTE} SELECT tok.id, {_row_per_array('labels', 'CASE WHEN tail.b IS NULL OR i < tail.b THEN -100 ELSE t END')},
  {_row_per_array('fixed', 'CASE WHEN tail.b IS NULL OR i < tail.b THEN -100 ELSE t END')} FROM tok LEFT JOIN tail USING (id) GROUP BY tok.id""",
)
def completion_labels(spark, sf):
    rows = _tokens(spark, sf).withColumn("labels", tk.completion_labels(F.col("tokens"), _ints(_RESPONSE)))
    # A collator whose padding is the end mark has masked the last label; it is restored before the masking.
    padded = F.transform("tokens", lambda t, i: F.when(i == F.size("tokens") - 1, F.lit(tk.IGNORE)).otherwise(t))
    restored = tk.keep_last_token(padded, F.col("tokens"))
    fixed = tk.completion_labels(F.col("tokens"), _ints(_RESPONSE), restored)
    return rows.select("id", F.array_join("labels", ",").alias("labels"), F.array_join(fixed, ",").alias("fixed"))


@query(
    "P16_multi_turn_labels",
    f"""WITH {_TOKEN_CTE},
starts0 AS (SELECT id, a FROM heads UNION ALL SELECT h.id, -1 FROM (SELECT id, min(a) AS a FROM heads GROUP BY id) h JOIN ends e ON e.id = h.id AND e.k = 1 WHERE h.a > e.b),
starts AS (SELECT id, greatest(a, 0) AS a, row_number() OVER (PARTITION BY id ORDER BY a) AS k FROM starts0),
spans AS (SELECT s.id, CASE WHEN s.k = 1 THEN 0 ELSE s.a END AS a, e.b FROM starts s JOIN ends e ON s.id = e.id AND s.k = e.k),
sizes AS (SELECT w.id, (SELECT count(*) FROM starts s WHERE s.id = w.id) AS ns, (SELECT count(*) FROM ends e WHERE e.id = w.id) AS ne,
    (SELECT max(a) FROM starts s WHERE s.id = w.id) AS last FROM words w)
SELECT tok.id, string_agg(CASE WHEN ne = 0 OR ns = 0 THEN -100 WHEN ne < ns AND i >= last THEN -100
  WHEN EXISTS (SELECT 1 FROM spans p WHERE p.id = tok.id AND tok.i >= p.a AND tok.i < p.b) THEN -100 ELSE t END, ',' ORDER BY i) AS labels
FROM tok JOIN sizes ON sizes.id = tok.id GROUP BY tok.id""",
)
def multi_turn_labels(spark, sf):
    labels = tk.multi_turn_labels(F.col("tokens"), _ints(_RESPONSE), _ints(_HUMAN))
    return _tokens(spark, sf).select("id", F.array_join(labels, ",").alias("labels"))


@query(
    "P17_kept_ids",
    f"WITH {_TOKEN_CTE} SELECT id, coalesce({_row_per_array('x', 't').removesuffix(' AS x')} FILTER (WHERE t IN (2, 3, 5, 7)), '') AS kept FROM tok GROUP BY id",
)
def kept_ids(spark, sf):
    return _tokens(spark, sf).select("id", F.array_join(tk.kept_ids(F.col("tokens"), _ints([2, 3, 5, 7])), ",").alias("kept"))


@query(
    "P18_pad_right",
    f"WITH {_TOKEN_CTE} SELECT id, {_row_per_array('x', 't').removesuffix(' AS x')} || repeat(',0', greatest(40 - max(n), 0)::INT) AS padded FROM tok GROUP BY id",
)
def pad_right(spark, sf):
    return _tokens(spark, sf).select("id", F.array_join(tk.pad_right(F.col("tokens"), 40, 0), ",").alias("padded"))


@query(
    "P19_unmask",
    f"WITH {_TOKEN_CTE} SELECT tok.id, {_row_per_array('labels', 'CASE WHEN tail.b IS NULL OR i < tail.b THEN 0 ELSE t END')} FROM tok LEFT JOIN tail USING (id) GROUP BY tok.id",
)
def unmask(spark, sf):
    masked = tk.completion_labels(F.col("tokens"), _ints(_RESPONSE))
    rows = _tokens(spark, sf).withColumn("labels", masked)
    return rows.select("id", F.array_join(tk.unmask(F.col("labels"), 0), ",").alias("labels"))


@query(
    "P20_prompt_attention",
    f"WITH {_TOKEN_CTE} SELECT tok.id, {_row_per_array('mask', 'CASE WHEN tail.b IS NULL OR i < tail.b THEN 1 ELSE 0 END')} FROM tok LEFT JOIN tail USING (id) GROUP BY tok.id",
)
def prompt_attention(spark, sf):
    return _tokens(spark, sf).select("id", F.array_join(tk.prompt_attention(F.col("tokens"), _ints(_RESPONSE)), ",").alias("mask"))
