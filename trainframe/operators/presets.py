"""Layouts of samples and the ways between them, as columns chosen by the schema and, in mixed data, by the row."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.rows import turns_array
from ..functions.values import ORDINAL, truthy

MESSAGE = "struct<role:string,content:string>"
TO_SHAREGPT = {"system": "system", "user": "human", "assistant": "gpt", "tool": "observation"}
FROM_SHAREGPT = {"system": "system", "human": "user", "gpt": "assistant", "observation": "tool", "function_call": "assistant"}
PAIRS = (("instruction", "output"), ("q", "a"), ("question", "answer"), ("query", "response"), ("prompt", "chosen"))


def _has(schema: T.StructType, *names: str) -> bool:
    return set(names) <= set(schema.names)


def _text(name: str) -> Column:
    return F.col(f"`{name}`").cast("string")


def _present(schema: T.StructType, *names: str) -> Column:
    out = F.lit(True)
    for n in names:
        out = out & truthy(F.col(f"`{n}`"), schema[n].dataType)
    return out


def message(role: str | Column, content: Column) -> Column:
    return F.struct((F.lit(role) if isinstance(role, str) else role).alias("role"), content.alias("content"))


def _map(c: Column, table: dict[str, str]) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for kv in table.items() for x in kv)), c), c)


def messages_of(schema: T.StructType, user: str | None = None, assistant: str | None = None) -> Column:
    """Each row's (role, content) messages whatever its layout; null where none fits.

    Fields that are named come first, then a conversation, then the pairs of ``PAIRS`` in order; a pair counts where both
    sides hold something.
    """
    options: list[Column] = []
    if user and assistant:
        if not _has(schema, user, assistant):
            raise ValueError(f"rows have no {user!r} and {assistant!r}")
        return F.when(_present(schema, user, assistant), F.array(message("user", _text(user)), message("assistant", _text(assistant))))
    said = turns_array(schema)
    if said is not None:
        options.append(F.when(F.size(said) > 0, F.transform(said, lambda m: message(_map(m.role, FROM_SHAREGPT), m.content))))
    for a, b in PAIRS:
        if _has(schema, a, b) and isinstance(schema[a].dataType, T.StringType):
            ask = _text(a)
            if a == "instruction" and "input" in schema.names:
                ask = F.when(_present(schema, "input"), F.concat(_text(a), F.lit("\n"), _text("input"))).otherwise(_text(a))
            options.append(F.when(_present(schema, a, b), F.array(message("user", ask), message("assistant", _text(b)))))
    if not options:
        return F.lit(None).cast(f"array<{MESSAGE}>")
    return F.coalesce(*options)


def _out(df: DataFrame, *cols: Column | str) -> DataFrame:
    """The columns of a layout, and the hidden place of its rows where they have one."""
    return df.select(*cols, *([ORDINAL] if ORDINAL in df.columns else []))


def _kept(df: DataFrame, test: Column, strict: bool) -> DataFrame:
    return df.where(F.when(~test, F.raise_error(F.lit("a row's layout is not known"))).otherwise(F.lit(True))) if strict else df.where(test)


def openai_chat(df: DataFrame, user_field: str | None = None, assistant_field: str | None = None, system_prompt: str | None = None, strict: bool = False) -> DataFrame:
    """-> messages; rows of no known layout drop out, or end a strict query. A system prompt goes before others' turns."""
    m = messages_of(df.schema, user_field, assistant_field)
    if system_prompt:
        m = F.when(F.try_element_at(m, F.lit(1)).role == "system", m).otherwise(F.concat(F.array(message("system", F.lit(system_prompt))), m))
    return _out(_kept(df, m.isNotNull(), strict), m.alias("messages"))


def _first(m: Column, role: str) -> Column:
    return F.try_element_at(F.filter(m, lambda t: t.role == role), F.lit(1)).content


def alpaca(df: DataFrame, strict: bool = False) -> DataFrame:
    """-> instruction, input, output: the first of each side of a conversation."""
    if _has(df.schema, "instruction", "output"):
        extra = F.coalesce(_text("input"), F.lit("")) if "input" in df.columns else F.lit("")
        return _out(_kept(df, _present(df.schema, "instruction", "output"), strict), "instruction", extra.alias("input"), "output")
    m = messages_of(df.schema)
    a, b = _first(m, "user"), _first(m, "assistant")
    return _out(_kept(df, a.isNotNull() & b.isNotNull(), strict), a.alias("instruction"), F.lit("").alias("input"), b.alias("output"))


def sharegpt(df: DataFrame, roles: dict[str, str] | None = None, strict: bool = False) -> DataFrame:
    """-> conversations of (from, value); a call becomes a turn of its own."""
    said = turns_array(df.schema)
    table = roles or TO_SHAREGPT
    if said is None:
        m = messages_of(df.schema)
        turns = F.transform(m, lambda t: F.struct(_map(t.role, table).alias("from"), t.content.alias("value")))
        return _out(_kept(df, m.isNotNull(), strict), turns.alias("conversations"))

    def one(t: Column) -> Column:
        text = F.struct(_map(_map(t.role, FROM_SHAREGPT), table).alias("from"), t.content.alias("value"))
        called = F.transform(t.calls, lambda k: F.struct(F.lit("function_call").alias("from"), F.to_json(F.struct(k["name"].alias("name"), k.arguments.alias("arguments"))).alias("value")))
        return F.when(F.size(t.calls) == 0, F.array(text)).when(t.content == "", called).otherwise(F.concat(F.array(text), called))

    return _out(_kept(df, said.isNotNull(), strict), F.flatten(F.transform(said, one)).alias("conversations"))


def sharegpt_to_messages(df: DataFrame) -> DataFrame:
    """conversations -> messages: calls in a row are one assistant message, observations answer them first in first out.

    One fold over the turns carries the calls still open and a running number, so ids are ``call_0``, ``call_1`` ...
    """
    made = "array<struct<role:string,content:string,tool_calls:array<struct<id:string,name:string,arguments:string>>,tool_call_id:string>>"
    none = F.array().cast("array<struct<id:string,name:string,arguments:string>>")
    start = F.struct(F.array().cast(made).alias("out"), F.lit(0).alias("n"), F.array().cast("array<string>").alias("open"))

    def step(s: Column, t: Column) -> Column:
        who, text = t.getField("from"), F.coalesce(t.value, F.lit(""))
        call_id = F.concat(F.lit("call_"), s.n.cast("string"))
        call = F.struct(call_id.alias("id"), F.coalesce(F.get_json_object(text, "$.name"), F.lit("?")).alias("name"), F.coalesce(F.get_json_object(text, "$.arguments"), F.lit("")).alias("arguments"))
        last = F.try_element_at(s.out, F.lit(-1))
        goes_on = F.coalesce((F.size(last.tool_calls) > 0), F.lit(False))
        merged = F.concat(F.slice(s.out, 1, F.greatest(F.size(s.out) - 1, F.lit(0))), F.array(F.struct(last.role.alias("role"), last.content.alias("content"), F.concat(last.tool_calls, F.array(call)).alias("tool_calls"), last.tool_call_id.alias("tool_call_id"))))
        fresh = F.concat(s.out, F.array(F.struct(F.lit("assistant").alias("role"), F.lit("").alias("content"), F.array(call).alias("tool_calls"), F.lit(None).cast("string").alias("tool_call_id"))))
        plain = F.concat(s.out, F.array(F.struct(_map(who, FROM_SHAREGPT).alias("role"), text.alias("content"), none.alias("tool_calls"), F.when(who == "observation", F.try_element_at(s.open, F.lit(1))).alias("tool_call_id"))))
        is_call = who == "function_call"
        return F.struct(
            F.when(is_call & goes_on, merged).when(is_call, fresh).otherwise(plain).cast(made).alias("out"),
            F.when(is_call, s.n + 1).otherwise(s.n).alias("n"),
            F.when(is_call, F.concat(s.open, F.array(call_id))).when(who == "observation", F.slice(s.open, 2, F.greatest(F.size(s.open) - 1, F.lit(0)))).otherwise(s.open).cast("array<string>").alias("open"),
        )

    return df.withColumn("messages", F.aggregate("conversations", start, step, lambda s: s.out)).drop("conversations")


def dpo_pair(df: DataFrame, prompt: str = "prompt", chosen: str = "chosen", rejected: str = "rejected", strict: bool = False) -> DataFrame:
    test = _present(df.schema, prompt, chosen, rejected)
    return _out(_kept(df, test, strict), _text(prompt).alias("prompt"), _text(chosen).alias("chosen"), _text(rejected).alias("rejected"))


def simple_qa(df: DataFrame, strict: bool = False) -> DataFrame:
    m = messages_of(df.schema)
    a, b = _first(m, "user"), _first(m, "assistant")
    return _out(_kept(df, a.isNotNull() & b.isNotNull(), strict), a.alias("question"), b.alias("answer"))


PRESETS = {"openai_chat": openai_chat, "alpaca": alpaca, "sharegpt": sharegpt, "dpo_pair": dpo_pair, "simple_qa": simple_qa}


def get_preset(name: str):
    if name not in PRESETS:
        raise ValueError(f"no preset {name!r}; there are {', '.join(PRESETS)}")
    return PRESETS[name]


# converters

def to_openai_batch(df: DataFrame, model: str, order: list[str], id_field: str | None = None, url: str = "/v1/chat/completions") -> DataFrame:
    """-> custom_id, method, url, body; without an id field requests are numbered in order."""
    from .order import ranked_rows

    m = messages_of(df.schema)
    if id_field is None:
        df = ranked_rows(df, [F.col(f"`{c}`") for c in order], "_n")
        custom = F.concat(F.lit("request-"), F.col("_n").cast("string"))
    else:
        custom = _text(id_field)
    body = F.struct(F.lit(model).alias("model"), m.alias("messages"))
    return _out(df, custom.alias("custom_id"), F.lit("POST").alias("method"), F.lit(url).alias("url"), body.alias("body"))


def from_openai_batch(df: DataFrame) -> DataFrame:
    """Results with status 200 -> custom_id, content, model, usage."""
    body = F.col("response.body")
    return df.where("response.status_code = 200").select("custom_id", F.try_element_at(body.choices, F.lit(1)).message.content.alias("content"), body.model.alias("model"), body.usage.alias("usage"))


def to_hf_chat(df: DataFrame, add_generation_prompt: bool = False) -> DataFrame:
    out = _out(df, messages_of(df.schema).alias("messages"))
    return out.withColumn("add_generation_prompt", F.lit(True)) if add_generation_prompt else out


def _split_system(m: Column) -> tuple[Column, Column]:
    return _first(m, "system"), F.filter(m, lambda t: t.role != "system")


def _pairs(m: Column) -> Column:
    """Complete (user, assistant) pairs of a conversation, in one fold."""
    start = F.struct(F.array().cast("array<array<string>>").alias("pairs"), F.lit(None).cast("string").alias("ask"))

    def step(s: Column, t: Column) -> Column:
        done = (t.role == "assistant") & s.ask.isNotNull()
        return F.struct(F.when(done, F.concat(s.pairs, F.array(F.array(s.ask, t.content)))).otherwise(s.pairs).cast("array<array<string>>").alias("pairs"), F.when(t.role == "user", t.content).when(done, F.lit(None)).otherwise(s.ask).alias("ask"))

    return F.aggregate(m, start, step, lambda s: s.pairs)


def to_llama_factory(df: DataFrame) -> DataFrame:
    """-> instruction, input, output, system, history: the last pair is the sample, earlier ones its history."""
    system, m = _split_system(messages_of(df.schema))
    pairs = _pairs(m)
    last = F.try_element_at(pairs, F.lit(-1))
    return _out(df, last[0].alias("instruction"), F.lit("").alias("input"), last[1].alias("output"), F.coalesce(system, F.lit("")).alias("system"), F.slice(pairs, 1, F.greatest(F.size(pairs) - 1, F.lit(0))).alias("history"))


def to_llama_factory_sharegpt(df: DataFrame) -> DataFrame:
    system, m = _split_system(messages_of(df.schema))
    return _out(df, F.transform(m, lambda t: F.struct(_map(t.role, TO_SHAREGPT).alias("from"), t.content.alias("value"))).alias("conversations"), F.coalesce(system, F.lit("")).alias("system"))


def _media(df: DataFrame, *names: str) -> list[Column]:
    out = []
    for n in names:
        if n in df.columns:
            c = F.col(f"`{n}`")
            out.append((c if isinstance(df.schema[n].dataType, T.ArrayType) else F.when(c.isNotNull(), F.array(c)).otherwise(F.array().cast("array<string>"))).alias(n))
    return out


def to_llama_factory_vlm(df: DataFrame) -> DataFrame:
    m = messages_of(df.schema)

    def last(role: str) -> Column:
        return F.coalesce(F.try_element_at(F.filter(m, lambda t: t.role == role), F.lit(-1)).content, F.lit(""))

    return _out(df, last("user").alias("instruction"), F.lit("").alias("input"), last("assistant").alias("output"), *_media(df, "images", "videos"))


def to_llama_factory_vlm_sharegpt(df: DataFrame) -> DataFrame:
    system, m = _split_system(messages_of(df.schema))
    return _out(df, F.transform(m, lambda t: F.struct(_map(t.role, TO_SHAREGPT).alias("from"), t.content.alias("value"))).alias("conversations"), F.coalesce(system, F.lit("")).alias("system"), *_media(df, "images", "videos"))


def to_axolotl(df: DataFrame) -> DataFrame:
    m = messages_of(df.schema)
    return _out(df, F.transform(m, lambda t: F.struct(_map(t.role, TO_SHAREGPT).alias("from"), t.content.alias("value"))).alias("conversations"))


def to_swift_messages(df: DataFrame, system: str | None = None) -> DataFrame:
    m = messages_of(df.schema)
    if system:
        m = F.when(F.try_element_at(m, F.lit(1)).role == "system", m).otherwise(F.concat(F.array(message("system", F.lit(system))), m))
    return _out(df, m.alias("messages"))


def to_swift_query_response(df: DataFrame) -> DataFrame:
    system, m = _split_system(messages_of(df.schema))
    pairs = _pairs(m)
    last = F.try_element_at(pairs, F.lit(-1))
    return _out(df, last[0].alias("query"), last[1].alias("response"), F.coalesce(system, F.lit("")).alias("system"), F.slice(pairs, 1, F.greatest(F.size(pairs) - 1, F.lit(0))).alias("history"))


def to_swift_vlm(df: DataFrame) -> DataFrame:
    m = F.filter(messages_of(df.schema), lambda t: t.role.isin("user", "assistant", "system"))
    return _out(df, m.alias("messages"), *_media(df, "images", "videos"))


CONVERTERS = {"llama-factory": to_llama_factory, "llama-factory-sharegpt": to_llama_factory_sharegpt, "llama-factory-vlm": to_llama_factory_vlm, "llama-factory-vlm-sharegpt": to_llama_factory_vlm_sharegpt, "axolotl": to_axolotl, "swift-messages": to_swift_messages, "swift-query-response": to_swift_query_response, "swift-vlm": to_swift_vlm, "hf-chat": to_hf_chat}


def detect_format(schema: T.StructType) -> str:
    """openai_chat, sharegpt, dpo, alpaca, simple_qa or unknown."""
    for name, fields in (("openai_chat", ("messages",)), ("sharegpt", ("conversations",)), ("dpo", ("prompt", "chosen", "rejected")), ("alpaca", ("instruction", "output"))):
        if _has(schema, *fields):
            return name
    return "simple_qa" if any(_has(schema, a, b) for a, b in PAIRS) else "unknown"


@dataclass
class Compatibility:
    valid: bool
    errors: list[str]
    warnings: list[str]


def check_compatibility(df: DataFrame, framework: str) -> Compatibility:
    """Whether rows of this layout can train in a framework; roles are looked at in the first 10 rows."""
    kind, errors, warnings = detect_format(df.schema), [], []
    if framework not in ("llama-factory", "swift", "axolotl"):
        raise ValueError(f"no framework {framework!r}")
    if kind == "unknown":
        errors.append("the layout is not known")
    if kind == "dpo" and framework == "axolotl":
        warnings.append("preference pairs need a type of their own in the config")
    if kind == "sharegpt":
        roles = {r[0] for r in df.limit(10).select(F.explode("conversations").alias("t")).select("t.from").distinct().collect()}
        if odd := roles - set(FROM_SHAREGPT):
            warnings.append(f"roles that are not usual: {', '.join(map(str, sorted(odd, key=str)))}")
    return Compatibility(not errors, errors, warnings)
