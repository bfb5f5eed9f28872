"""Chat formatting: schema fingerprints select declarative mappings from many layouts to turns, then a template.

A record is JSON. The nested field paths (``[]`` for list items) that some layout names are hashed; ``declared`` has the
fingerprints of all sets of paths that a layout allows, and the hash selects the layout's mapping there. Only a record
whose set is none of those (fields of two layouts at once) is matched by the paths that layouts need, in their order.
The template marks turns; control strings inside texts are escaped, so the output can be parsed back.
"""

from __future__ import annotations

import hashlib
import json
import re
from dataclasses import dataclass, field

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

ROLES = {"human": "user", "prompter": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant", "chatbot": "assistant"}


@dataclass(frozen=True)
class Layout:
    """How a layout's records become turns: ``turns`` is a list of messages, ``fields`` are (role, path) in order."""

    name: str
    needs: tuple[str, ...]
    turns: str = ""
    role: str = ""
    text: str = ""
    fields: tuple[tuple[str, str], ...] = ()
    roles: dict = field(default_factory=lambda: ROLES)


LAYOUTS = (
    Layout("messages", ("messages[].role", "messages[].content"), "messages", "role", "content"),
    Layout("sharegpt", ("conversations[].from", "conversations[].value"), "conversations", "from", "value"),
    Layout("dialog", ("dialog[].speaker", "dialog[].text"), "dialog", "speaker", "text"),
    Layout("instruction", ("instruction", "output"), fields=(("system", "system"), ("user", "instruction+input"), ("assistant", "output"))),
    Layout("prompt-response", ("prompt", "response"), fields=(("system", "system"), ("user", "prompt"), ("assistant", "response"))),
    Layout("prompt-completion", ("prompt", "completion"), fields=(("system", "system"), ("user", "prompt"), ("assistant", "completion"))),
    Layout("preference", ("prompt", "chosen"), fields=(("system", "system"), ("user", "prompt"), ("assistant", "chosen"))),
    Layout("qa", ("question", "answer"), fields=(("system", "system"), ("user", "question"), ("assistant", "answer"))),
    Layout("qa-nested", ("qa.question", "qa.answer"), fields=(("user", "qa.question"), ("assistant", "qa.answer"))),
)
#: Messages whose roles are what the template knows already; none is an alias of another.
CONVERSATION = Layout("conversation", ("messages[].role", "messages[].content"), "messages", "role", "content", roles={})


def paths(value, at: str = "") -> set[str]:
    """The nested field paths of a record that hold a value; an empty list of messages has none."""
    if isinstance(value, dict):
        return set().union(*(paths(v, f"{at}.{k}" if at else str(k)) for k, v in value.items())) if value else set()
    if isinstance(value, list):
        return set().union(*(paths(v, f"{at}[]") for v in value)) if value else {f"{at}[]"}
    return {at} if value is not None or "[]" in at else set()


def fingerprint(found: set[str]) -> str:
    return xxhash.xxh64_hexdigest("\n".join(sorted(found)).encode(errors="surrogatepass"))


def named(layout: Layout) -> set[str]:
    """All paths that a layout names, needed or not."""
    return {*layout.needs, *(p for _, path in layout.fields for p in path.split("+")), *([f"{layout.turns}[]"] if layout.turns else [])}


def declared(layouts: tuple[Layout, ...] = LAYOUTS) -> dict[str, Layout]:
    """The fingerprint of every set of paths that one layout allows: what it needs, with any of what else it names."""
    table: dict[str, Layout] = {}
    for x in layouts:
        if x.turns:
            sets = [set(x.needs), {f"{x.turns}[]"}]
        else:
            more = sorted(named(x) - set(x.needs))
            sets = [set(x.needs) | {m for k, m in enumerate(more) if pick >> k & 1} for pick in range(1 << len(more))]
        for found in sets:
            table.setdefault(fingerprint(found), x)
    return table


def select_layout(found: set[str], layouts: tuple[Layout, ...] = LAYOUTS) -> Layout | None:
    """The first layout whose needed paths are there; a list without items counts by its name."""
    for x in layouts:
        if set(x.needs) <= found or x.turns and f"{x.turns}[]" in found:
            return x
    return None


#: Half of a surrogate pair, which JSON can escape and UTF-8 cannot hold.
HALF = re.compile("[\ud800-\udfff]")


def _text(value) -> str:
    text = "" if value is None else value if isinstance(value, str) else json.dumps(value, ensure_ascii=False)
    return HALF.sub("\ufffd", text)


def _at(record: dict, path: str):
    for k in path.split("."):
        record = record.get(k) if isinstance(record, dict) else None
    return record


def turns(record: dict, layout: Layout) -> list[tuple[str, str]]:
    """(role, text) of each turn. A null role or text is empty; roles keep their name but for known aliases."""
    if layout.turns:
        got = [m if isinstance(m, dict) else {} for m in record.get(layout.turns) or []]
        return [(layout.roles.get(r := _text(m.get(layout.role)), r), _text(m.get(layout.text))) for m in got]
    out = []
    for role, path in layout.fields:
        values = [_text(_at(record, p)) for p in path.split("+")]
        values = [v for k, v in enumerate(values) if v or not k]
        if role != "system" or values[0]:
            out.append((role, "\n".join(values)))
    return out


#: What marks turns. No mark holds < or [ but at its start, so none can begin in a text and end in a mark.
CONTROL = re.compile(r"</?s>|\[/?INST\]|\[/?ROLE\]|\[:\]|\\")
ESCAPED = re.compile(r"\\(</?s>|\[/?INST\]|\[/?ROLE\]|\[:\]|\\)")
TOKEN = re.compile(r"\\(?:</?s>|\[/?INST\]|\[/?ROLE\]|\[:\]|\\)|(</?s>|\[/?INST\]|\[/?ROLE\]|\[:\])")


def escape(text: str) -> str:
    return CONTROL.sub(lambda m: "\\" + m[0], text)


def unescape(text: str) -> str:
    return ESCAPED.sub(r"\1", text)


def render(said: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
    """The formatted text and its loss mask: code-point spans [start, end) of the assistant's (escaped) texts."""
    out, spans, n = [], [], 0
    for role, text in said:
        body = escape(text)
        if role == "user":
            piece = f"<s>[INST] {body} [/INST]"
        elif role == "assistant":
            spans.append((n + 1, n + 1 + len(body)))
            piece = f" {body}</s>"
        else:
            piece = f"[ROLE]{escape(role)}[:]{body}[/ROLE]"
        out.append(piece)
        n += len(piece)
    return "".join(out), spans


def parse(formatted: str) -> list[tuple[str, str]]:
    """The turns of a formatted text: the inverse of ``render``."""
    said, at, role, mark = [], 0, None, None
    for m in TOKEN.finditer(formatted):
        if m[1] is None:
            continue
        text, at = formatted[at : m.start()], m.end()
        if m[1] == "[/INST]":
            said.append(("user", unescape(text[1:-1])))
        elif m[1] == "</s>":
            said.append(("assistant", unescape(text[1:])))
        elif m[1] == "[:]":
            role = unescape(text)
        elif m[1] == "[/ROLE]":
            said.append((role, unescape(text)))
    return said


FORMATTED = "layout string, fingerprint string, n_turns long, formatted string, loss_spans array<struct<start:long,end:long>>"


def format_chat(records: DataFrame, key: str, record: str, layouts: tuple[Layout, ...] = LAYOUTS) -> DataFrame:
    """Format JSON records of mixed layouts: ``key`` and the columns of ``FORMATTED``, a row for each row.

    A record that is null, no JSON object (or one nested deeper than Python's parser goes) or of no known layout has null
    in all but ``fingerprint`` (of what paths it has), so nothing is dropped. A lone surrogate in a text becomes U+FFFD.
    Rows that repeat a key each give a row. Other columns are not read.
    """
    given = records.select(F.col(f"`{key}`").cast("long").alias("key"), F.col(f"`{record}`").cast("string").alias("record"))
    spans_type = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    types = (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), spans_type)
    names = ["key", "layout", "fingerprint", "n_turns", "formatted", "loss_spans"]

    def run(batches):
        table, core = declared(layouts), set().union(*map(named, layouts))

        def one(raw: str | None) -> tuple:
            try:
                value = json.loads(raw) if raw is not None else None
                found = paths(value) if isinstance(value, dict) else set()
                layout = table.get(fingerprint(found & core)) or select_layout(found, layouts)
                if layout is None:
                    return None, fingerprint(found), None, None, None
                said = turns(value, layout)
            except (ValueError, RecursionError):
                return None, fingerprint(set()), None, None, None
            formatted, spans = render(said)
            return layout.name, fingerprint(found), len(said), formatted, [{"start": a, "end": b} for a, b in spans]

        for batch in batches:
            _, at = common.text_bytes(batch.column(1))
            for i, j in common.parts(at, 8 << 20):
                out = [(k, *one(raw)) for k, raw in zip(batch.column(0)[i:j].to_pylist(), batch.column(1)[i:j].to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names)

    return given.mapInArrow(run, "key long, " + FORMATTED).withColumnRenamed("key", key)


def conversation_records(conversations: DataFrame) -> DataFrame:
    """(conv_id, record): the rows of each conversation as JSON messages in the order of turn, role and text.

    A null text or role is empty, null turns come first, repeated rows count each, rows with a null conv_id are one
    conversation. A conversation is one row here, as it is in what is formatted.
    """
    rows = common.columns(conversations, "conv_id", "turn", "role", "text")
    said = F.struct("turn", F.coalesce(F.col("role"), F.lit("")).alias("role"), F.coalesce(F.col("text"), F.lit("")).alias("content"))
    messages = F.transform(F.sort_array(F.collect_list(said)), lambda m: F.struct(m.role.alias("role"), m.content.alias("content")))
    return rows.groupBy("conv_id").agg(F.to_json(F.struct(messages.alias("messages"))).alias("record"))


def read_back(formatted: DataFrame) -> DataFrame:
    """Digests of formatted conversations, from the output alone: the formatted text and its loss spans.

    Records that were not formatted count as conversations without turns.
    """

    def run(batches):
        for batch in batches:
            out = []
            for k, text, spans in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                text, spans = text or "", spans or ()
                said = parse(text)
                loss = "".join(unescape(text[s["start"] : s["end"]]) for s in spans)
                whole = "".join(f"{r}\n{t}\n" for r, t in said)
                out.append((k, len(said), hashlib.sha256(whole.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(text)))
            if out:
                types = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    return formatted.select("conv_id", "formatted", "loss_spans").mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def op1_chat_formatting(spark, sf_dir: str) -> DataFrame:
    """All conversations as messages, and conversation -1 in another layout, formatted and read back."""
    said = "</s>[INST] ok [/INST]"
    extra = spark.range(1).select(F.lit(-1).cast("long").alias("conv_id"), F.to_json(F.struct(F.lit(said).alias("prompt"), F.lit(said).alias("response"))).alias("record"))
    records = conversation_records(spark.read.parquet(f"{sf_dir}/conversations.parquet")).union(extra)
    return read_back(format_chat(records, "conv_id", "record", (CONVERSATION, *LAYOUTS[1:])))
