"""Operator 4: chat formatting by schema fingerprints.

A record's fingerprint is the SHA-256 of its sorted nested field paths. It selects
a declarative mapping from a registry - which field holds the turns, the role, the text, or which
fixed role each plain field has - and the mapping turns the record into canonical (role, text)
turns. New layouts are added by registering a sample and a mapping; no code.

The template: `<|turn|>` role, newline, escaped text, `<|end|>`, newline. In texts and roles `&`, `<`
and `[` are written as entities (and a newline in a role), so no control string - this template's,
or any other that begins with `<` or `[` - can appear inside one, and unescaping gives the exact text
back. The loss mask is a list of spans, in code points of the output: the escaped text of each
assistant turn.

Records: null text and role count as empty strings, a record without turns (none, an empty list or null)
gives empty output. A plain field is a turn also where it is empty, unless its mapping says that it is optional.
A record of an unknown layout, one that isn't JSON and one that nests too deeply for the parser has null output and says
so in `problem`; the others are formatted all the same. Half a surrogate pair, which JSON can name but no text can hold,
becomes U+FFFD, and `problem` says so beside the output. A conversation is one record and so one row: it must fit in
memory, like a text. Rows of a conversation are ordered by turn (nulls first), then role, then
text; repeated rows are turns of their own; a null conv_id is a conversation of its own. An empty
table gives only what the query adds.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import small_batches, table

HALF = re.compile("[\ud800-\udfff]")
TURN, END = "<|turn|>", "<|end|>\n"


@dataclass(frozen=True)
class Mapping:
    """Either `turns` with `role` and `text` inside each, or `fields`: (fixed role, path) in order; those in `optional` are left out where they are empty."""

    turns: str = ""
    role: str = ""
    text: str = ""
    fields: tuple[tuple[str, str], ...] = ()
    roles: tuple[tuple[str, str], ...] = ()
    optional: tuple[str, ...] = ()


def field_paths(value, path: str = "") -> set[str]:
    """Nested paths; list items share one; nulls count as strings so that they don't change the layout."""
    if isinstance(value, dict):
        return {p for k, v in value.items() for p in field_paths(v, f"{path}.{k}" if path else k)} or {f"{path}{{}}"}
    if isinstance(value, list):
        return {p for v in value for p in field_paths(v, path + "[]")} or {path + "[]"}
    return {path}


def fingerprint(record) -> str:
    return hashlib.sha256("\n".join(sorted(field_paths(record))).encode()).hexdigest()


class Registry:
    """Mappings by fingerprint."""

    def __init__(self) -> None:
        self.mappings: dict[str, Mapping] = {}

    def add(self, sample, mapping: Mapping) -> Registry:
        self.mappings[fingerprint(sample)] = mapping
        if mapping.turns:  # the same layout without any turn
            for none in ([], None):
                self.mappings.setdefault(fingerprint({**sample, mapping.turns: none}), mapping)
        return self

    def turns(self, record) -> list[tuple[str, str]]:
        mapping = self.mappings.get(fingerprint(record))
        if mapping is None:
            raise ValueError(f"no mapping for the layout {sorted(field_paths(record))}")
        names = dict(mapping.roles)
        if mapping.turns:
            return [(names.get(_text(t.get(mapping.role)), _text(t.get(mapping.role))), _text(t.get(mapping.text))) for t in record[mapping.turns] or []]
        found = [(role, path, _text(_at(record, path))) for role, path in mapping.fields]
        return [(role, text) for role, path, text in found if text or path not in mapping.optional]


def _at(record, path: str):
    for key in path.split("."):
        record = record.get(key) if isinstance(record, dict) else None
    return record


def _text(value) -> str:
    return "" if value is None else value if isinstance(value, str) else json.dumps(value, ensure_ascii=False)


def default_registry() -> Registry:
    """Common public layouts of chat, instruction and prompt data."""
    said = (("human", "user"), ("gpt", "assistant"), ("bot", "assistant"))
    return (
        Registry()
        .add({"messages": [{"role": "", "content": ""}]}, Mapping("messages", "role", "content"))
        .add({"messages": [{"role": "", "text": ""}]}, Mapping("messages", "role", "text"))
        .add({"id": 0, "messages": [{"role": "", "content": ""}]}, Mapping("messages", "role", "content"))
        .add({"conversations": [{"from": "", "value": ""}]}, Mapping("conversations", "from", "value", roles=said))
        .add({"id": "", "conversations": [{"from": "", "value": ""}]}, Mapping("conversations", "from", "value", roles=said))
        .add({"system": "", "conversations": [{"from": "", "value": ""}]}, Mapping("conversations", "from", "value", roles=said))
        .add({"instruction": "", "input": "", "output": ""}, Mapping(fields=(("user", "instruction"), ("user", "input"), ("assistant", "output")), optional=("input",)))
        .add({"instruction": "", "output": ""}, Mapping(fields=(("user", "instruction"), ("assistant", "output"))))
        .add({"instruction": "", "context": "", "response": "", "category": ""}, Mapping(fields=(("system", "context"), ("user", "instruction"), ("assistant", "response")), optional=("context",)))
        .add({"prompt": "", "completion": ""}, Mapping(fields=(("user", "prompt"), ("assistant", "completion"))))
        .add({"prompt": "", "response": ""}, Mapping(fields=(("user", "prompt"), ("assistant", "response"))))
        .add({"question": "", "answer": ""}, Mapping(fields=(("user", "question"), ("assistant", "answer"))))
        .add({"prompt": {"system": "", "user": ""}, "response": ""}, Mapping(fields=(("system", "prompt.system"), ("user", "prompt.user"), ("assistant", "response")), optional=("prompt.system",)))
    )


def escape(text: str) -> str:
    return text.replace("&", "&amp;").replace("<", "&lt;").replace("[", "&#91;")


def unescape(text: str) -> str:
    return text.replace("&#91;", "[").replace("&lt;", "<").replace("&amp;", "&")


def render(turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
    """(formatted, loss spans)."""
    out, spans, at = [], [], 0
    for role, text in turns:
        head, body = f"{TURN}{escape(role).replace('\n', '&#10;')}\n", escape(text)
        if role == "assistant":
            spans.append((at + len(head), at + len(head) + len(body)))
        out += [head, body, END]
        at += len(head) + len(body) + len(END)
    return "".join(out), spans


def parse(formatted: str) -> list[tuple[str, str]]:
    """The turns of a formatted conversation."""
    turns = []
    for part in formatted.split(TURN)[1:]:
        role, _, text = part.partition("\n")
        turns.append((unescape(role.replace("&#10;", "\n")), unescape(text.removesuffix(END))))
    return turns


def format_records(df: DataFrame, registry: Registry, record: str = "record", keep: list[str] | None = None) -> DataFrame:
    """df's rows with formatted, loss_spans and problem in place of `record`, a JSON string of any registered layout."""
    small_batches(df.sparkSession)
    added = (record, "formatted", "loss_spans", "problem")
    fields = [f for f in df.schema.fields if f.name not in added and (keep is None or f.name in keep)]
    from pyspark.sql import types as T

    span = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
    schema = T.StructType([*fields, T.StructField("formatted", T.StringType()), T.StructField("loss_spans", span), T.StructField("problem", T.StringType())])

    def one(raw: str | None) -> tuple:
        try:
            turns = registry.turns(json.loads(raw)) if raw is not None else []
        except (ValueError, RecursionError) as e:  # no mapping, not JSON, or too deep
            return None, None, HALF.sub("\ufffd", str(e))
        whole = [(HALF.sub("\ufffd", role), HALF.sub("\ufffd", text)) for role, text in turns]
        return *render(whole), None if whole == turns else "half a surrogate pair was replaced"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        for batch in batches:
            done = [one(r) for r in batch.column(record).to_pylist()]
            spans = pa.array([None if s is None else [{"start": a, "end": b} for a, b in s] for _, s, _ in done], kind)
            yield pa.RecordBatch.from_arrays([*[batch.column(f.name) for f in fields], pa.array([t for t, _, _ in done], pa.string()), spans, pa.array([p for _, _, p in done], pa.string())], names=schema.names)

    return df.mapInArrow(run, schema)


def read_back(df: DataFrame) -> DataFrame:
    """Digests of formatted conversations, taken from the output alone; nulls where there is none."""
    small_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[], [], [], [], []]
            for formatted, spans in zip(batch.column("formatted").to_pylist(), batch.column("loss_spans").to_pylist(), strict=True):
                if formatted is None:
                    for column in out:
                        column.append(None)
                    continue
                turns = parse(formatted)
                loss = "".join(unescape(formatted[s["start"] : s["end"]]) for s in spans)
                whole = "".join(f"{r}\n{t}\n" for r, t in turns)
                for column, value in zip(out, (len(turns), hashlib.sha256(whole.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(formatted)), strict=True):
                    column.append(value)
            yield pa.RecordBatch.from_arrays([batch.column("conv_id"), *[pa.array(c, pa.string() if k % 2 else pa.int64()) for k, c in enumerate(out)]], names=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    return df.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def as_records(conversations: DataFrame) -> DataFrame:
    """(conv_id, record): flat rows (conv_id, turn, role, text) as JSON records.

    Of four kinds, by a hash of conv_id, as data from several sources comes: messages with content, messages with text,
    conversations of from and value, and prompts with a response where there are just these two.
    """
    rows = conversations.select("conv_id", F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).alias("m"))
    grouped = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list("m")).alias("m"))

    def turns(role: str, text: str):
        return F.transform("m", lambda m: F.struct(m["role"].alias(role), m["text"].alias(text)))

    def record(**fields):
        return F.to_json(F.struct(*[c.alias(k) for k, c in fields.items()]), {"ignoreNullFields": "false"})

    kind = F.pmod(F.xxhash64("conv_id"), F.lit(4))
    renamed = F.exists("m", lambda m: m["role"].isin("human", "gpt", "bot"))  # the layout of from and value has its own names for roles
    asked = (F.size("m") == 2) & (F.get("m", F.lit(0))["role"] == "user") & (F.get("m", F.lit(1))["role"] == "assistant")
    plain = record(messages=turns("role", "content"))
    made = (
        F.when(kind == 1, record(messages=turns("role", "text"))).when((kind == 2) & ~renamed, record(conversations=turns("from", "value")))
        .when((kind == 3) & asked, record(prompt=F.get("m", F.lit(0))["text"], response=F.get("m", F.lit(1))["text"])).otherwise(plain)
    )
    return grouped.select("conv_id", made.alias("record"))


def op4_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], rows.schema)
    return read_back(format_records(as_records(rows.unionByName(extra)), default_registry()))


_TEXT = "replace(replace(replace(coalesce(text, ''), '&', '&amp;'), '<', '&lt;'), '[', '&#91;')"
_ROLE = "replace(replace(replace(replace(coalesce(role, ''), '&', '&amp;'), '<', '&lt;'), '[', '&#91;'), chr(10), '&#10;')"
OP4_SQL = f"""
WITH r AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text, {_TEXT} AS et, {_ROLE} AS er FROM (
    SELECT conv_id, turn, role, text FROM conversations
    UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'))
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(coalesce(sum(CASE WHEN role = 'assistant' THEN length(text) END), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text ELSE '' END, '' ORDER BY turn NULLS FIRST, role, text), '')) AS loss_sha256,
  CAST(sum(length('<|turn|>') + length(er) + 1 + length(et) + length('<|end|>') + 1) AS BIGINT) AS formatted_chars
FROM r GROUP BY conv_id"""
