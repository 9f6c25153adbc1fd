"""Chat formatting: tool calls linked with their results.

Calls (in assistant messages) and results (tool messages) meet in a hash join on conversation and identifier.  Calls are
put in a topological order: level 0 refers to no other call, the others come one level after the last call they refer
to.  Arguments are validated against the tools' schemas, and calls are serialised as canonical JSON: sorted keys, no
spaces, UTF-8 as it is.  A conversation's references, without its texts, are folded in one task; those of very large
conversations are taken by rounds over a table of open references, where chains of single references are halved in each.
"""

from __future__ import annotations

import json
import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cutloom.llm.common import staged, table

_REFERENCE = re.compile(r"^\$\{([^{}]+)\}$")


def canonical(value) -> str:
    """Canonical JSON: sorted keys, no spaces, whole floats as integers; NaN and infinities are refused."""

    def plain(x):
        if isinstance(x, float):
            if not math.isfinite(x):
                raise ValueError("not a JSON number")
            return int(x) if x.is_integer() and abs(x) < 2**53 else x
        if isinstance(x, dict):
            return {str(k): plain(v) for k, v in x.items()}
        return [plain(v) for v in x] if isinstance(x, list) else x

    return json.dumps(plain(value), sort_keys=True, ensure_ascii=False, separators=(",", ":"), allow_nan=False)


def _is(value, kind: str) -> bool:
    if kind == "integer":
        return not isinstance(value, bool) and (isinstance(value, int) or isinstance(value, float) and value.is_integer())
    if kind == "number":
        return not isinstance(value, bool) and isinstance(value, (int, float))
    return isinstance(value, {"string": str, "boolean": bool, "array": list, "object": dict, "null": type(None)}.get(kind, ()))


def faults(value, schema: dict, at: str = "$") -> list[str]:
    """What a JSON-schema subset finds wrong: type, enum, minimum, maximum, required, properties, additionalProperties,
    items.  A reference to another call fits any type; nothing fits a type of an unknown name."""
    if isinstance(value, str) and _REFERENCE.match(value):
        return []
    out = []
    kinds = schema.get("type")
    if kinds and not any(_is(value, k) for k in ([kinds] if isinstance(kinds, str) else kinds)):
        return [f"{at}: not {kinds}"]
    if "enum" in schema and value not in schema["enum"]:
        out.append(f"{at}: not in enum")
    if "minimum" in schema and _is(value, "number") and value < schema["minimum"]:
        out.append(f"{at}: below minimum")
    if "maximum" in schema and _is(value, "number") and value > schema["maximum"]:
        out.append(f"{at}: above maximum")
    if isinstance(value, dict):
        known = schema.get("properties", {})
        out += [f"{at}.{k}: missing" for k in schema.get("required", []) if k not in value]
        for k in sorted(value):
            if k in known:
                out += faults(value[k], known[k], f"{at}.{k}")
            elif schema.get("additionalProperties", True) is False:
                out.append(f"{at}.{k}: unknown")
    if isinstance(value, list) and "items" in schema:
        for i, x in enumerate(value):
            out += faults(x, schema["items"], f"{at}[{i}]")
    return out


def references(value) -> set[str]:
    """Identifiers of the calls that a value refers to as "${id}"."""
    if isinstance(value, dict):
        return set().union(*map(references, value.values())) if value else set()
    if isinstance(value, list):
        return set().union(*map(references, value)) if value else set()
    found = _REFERENCE.match(value) if isinstance(value, str) else None
    return {found[1]} if found else set()


def _is_text(value) -> bool:
    """A string without lone surrogates, which JSON can hold and UTF-8 can't."""
    try:
        return isinstance(value, str) and value.encode() is not None
    except UnicodeEncodeError:
        return False


def _checked(call: dict, schemas: dict[str, dict]) -> tuple[str | None, str | None, list[str], list[str]]:
    """Name, canonical line, references and faults of a call."""
    name, arguments, wrong = call.get("name"), call.get("arguments"), []
    if isinstance(arguments, str):  # some formats quote the arguments once more
        try:
            arguments = json.loads(arguments)
        except (ValueError, RecursionError):
            pass
    if not _is_text(name):
        name, wrong = None, ["name is not a string"]
    elif name not in schemas:
        wrong = [f"unknown tool {name}"]
    try:
        wrong += faults(arguments, {"type": "object"} | schemas[name]) if name in schemas else []
        refers = references(arguments)
        line = canonical({"id": call["id"], "name": name, "arguments": arguments})
    except ValueError as e:
        line = None
        wrong.append(str(e))
    except RecursionError:
        return name, None, [], [*wrong, "nested too deep"]
    if line is not None and not _is_text(line):
        line = None
        wrong.append("not valid Unicode")
    known = sorted(r for r in refers if _is_text(r))
    return name, line, known, [w.encode("utf-8", "replace").decode() for w in wrong]


def _parse(schemas: dict[str, dict]):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for conv, turn, text in zip(batch["conv_id"], batch["turn"], batch["text"]):
                try:
                    calls = json.loads(text)["tool_calls"]
                except (ValueError, KeyError, TypeError, RecursionError):
                    continue
                for pos, call in enumerate(calls if isinstance(calls, list) else []):
                    if isinstance(call, dict) and _is_text(call.get("id")):
                        rows.append((conv, turn, pos, call["id"], *_checked(call, schemas)))
            yield pd.DataFrame(rows, columns=["conv_id", "turn", "pos", "call_id", "name", "canonical", "refers", "faults"]).astype({"conv_id": "Int64", "turn": "Int64"})

    return run


def link_calls(messages: DataFrame, schemas: dict[str, dict]) -> DataFrame:
    """messages(conv_id, turn, role, text) -> a row per call.

    A call stands in an assistant message's JSON {"tool_calls": [{"id", "name", "arguments"}]}, a result in a tool message's
    {"tool_call_id", "content"}.  Columns: conv_id, turn, call_id, name, status (linked; missing: no result; early: its
    result stands before it), result_turn and result (the first after the call, else the first), level (null for calls in
    a circle or after one), faults, valid (no faults, all references known and level not null), canonical.  References to calls of no
    known id are faults.  Null conversations, messages that are no such JSON (or nested beyond what can be parsed) and calls
    whose id isn't a string of valid Unicode are left out; a name that is none is null and a fault; arguments nested too deep
    or not valid Unicode are faults, and such a call has no canonical line; of repeated ids in a conversation the first call counts; results without a call are left out.
    """
    said = messages.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text")
    ).filter("conv_id is not null and turn is not null and text is not null")
    fields = "conv_id long, turn long, pos int, call_id string, name string, canonical string, refers array<string>, faults array<string>"
    parsed = said.filter("role = 'assistant' and text like '%\"tool_calls\"%'").mapInPandas(_parse(schemas), fields)
    first = F.min(F.struct("turn", "pos", "name", "canonical", "refers", "faults")).alias("c")
    calls = staged(parsed.groupBy("conv_id", "call_id").agg(first).select("conv_id", "call_id", "c.*"), "calls")
    results = said.filter("role = 'tool'").select(
        F.col("conv_id").alias("r_conv"), F.col("turn").alias("r_turn"),
        F.get_json_object("text", "$.tool_call_id").alias("r_id"), F.get_json_object("text", "$.content").alias("r_content"),
    ).filter("r_id is not null")
    joined = calls.select("conv_id", "call_id", "turn").join(results, (F.col("conv_id") == F.col("r_conv")) & (F.col("call_id") == F.col("r_id")))
    # The first result after its call, else the first one: a minimum, so repeated results are combined before they move.
    ranked = joined.groupBy("conv_id", "call_id").agg(F.min(F.struct(F.col("r_turn") <= F.col("turn"), F.col("r_turn"), F.col("r_content"))).alias("r"))
    ranked = ranked.select(F.col("conv_id").alias("k_conv"), F.col("call_id").alias("k_id"), F.col("r.col1").alias("early"), F.col("r.r_turn").alias("result_turn"), F.col("r.r_content").alias("result"))
    links = calls.select("conv_id", "call_id", F.explode("refers").alias("target"))
    known = calls.select(F.col("conv_id").alias("t_conv"), F.col("call_id").alias("t_id"))
    links = staged(links.join(known, (F.col("conv_id") == F.col("t_conv")) & (F.col("target") == F.col("t_id")), "left").select("conv_id", "call_id", "target", F.col("t_id").isNull().alias("unknown")), "links")
    levels = _levels(calls, links.filter("not unknown"))
    lost = links.filter("unknown").groupBy("conv_id", "call_id").agg(F.sort_array(F.collect_set("target")).alias("lost"))
    out = calls.join(ranked, (F.col("conv_id") == F.col("k_conv")) & (F.col("call_id") == F.col("k_id")), "left")
    out = out.join(levels, ["conv_id", "call_id"], "left").join(lost, ["conv_id", "call_id"], "left")
    all_faults = F.concat("faults", F.transform(F.coalesce("lost", F.array().cast("array<string>")), lambda x: F.concat(F.lit("unknown call "), x)))
    status = F.when(F.col("result_turn").isNull(), "missing").when(F.col("early"), "early").otherwise("linked")
    return out.select(
        "conv_id", "turn", "pos", "call_id", "name", status.alias("status"), "result_turn", "result", "level", all_faults.alias("faults"),
        ((F.size(all_faults) == 0) & F.col("level").isNotNull()).alias("valid"), "canonical",
    )


def _fold_levels(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Levels of the waiting calls of conversations whose links stand together, each link once."""

    def levels(links: list[tuple[str, str]]) -> list[tuple[str, int]]:
        left, behind = Counter(c for c, _ in links), defaultdict(list)
        for c, t in links:
            behind[t].append(c)
        out: list[tuple[str, int]] = []
        ready = [(t, 0) for t in behind if t not in left]
        while ready:  # by ascending levels, so the last target that is met is the highest
            ahead = []
            for t, level in ready:
                for c in behind[t]:
                    left[c] -= 1
                    if not left[c]:
                        ahead.append((c, level + 1))
            out, ready = out + ahead, ahead
        return out

    conv, links, rows = None, [], []
    for batch in batches:
        for own, c, t in zip(*(batch.column(k).to_pylist() for k in ("conv_id", "call_id", "target"))):
            if own != conv:
                rows += [(conv, *x) for x in levels(links)]
                conv, links = own, []
            links.append((c, t))
    rows += [(conv, *x) for x in levels(links)]
    columns = zip(*rows) if rows else [[]] * 3
    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.string(), pa.int64()))], names=["conv_id", "call_id", "level"])


def _levels(calls: DataFrame, links: DataFrame, most: int | None = None) -> DataFrame:
    """conv_id, call_id, level: 0 without references, else one more than the highest of the calls that it refers to; calls in
    circles, and those after one, have none.

    Conversations of up to most links are folded in one task each, after one shuffle of their links; larger ones are taken by
    rounds over all tasks."""
    most = LINKS if most is None else most
    links = links.select("conv_id", "call_id", "target").distinct()
    free = calls.select("conv_id", "call_id").join(links.select("conv_id", "call_id").distinct(), ["conv_id", "call_id"], "left_anti").withColumn("level", F.lit(0))
    large = links.groupBy("conv_id").count().filter(F.col("count") > most).select("conv_id")
    small = links
    rounds = None
    if not large.isEmpty():  # one conversation for each most links at most
        large = staged(large, "large")
        small = links.join(large, "conv_id", "left_anti")
        rounds = _levels_by_rounds(calls.select("conv_id", "call_id").join(large, "conv_id", "left_semi"), links.join(large, "conv_id", "left_semi")).filter("level > 0")
    folded = small.repartition("conv_id").sortWithinPartitions("conv_id").mapInArrow(_fold_levels, "conv_id long, call_id string, level long")
    out = free.unionByName(folded.withColumn("level", F.col("level").cast("int")))
    return out if rounds is None else out.unionByName(rounds)


def _levels_by_rounds(calls: DataFrame, links: DataFrame) -> DataFrame:
    """conv_id, call_id, level: rounds that take the calls whose references all have a level.

    An open link says that its call's level is at least least, and at least step above its target's.  A link whose target has
    just got its level ends.  A link whose target waits for one link only passes on to that link's target, so chains are
    halved in each round.  A round without a new level leaves circles, and calls after one."""
    # No path of calls is so long: steps grow without end in circles only.
    long = F.lit(1 << 40)
    links = links.select("conv_id", "call_id", "target", F.lit(1).cast("long").alias("step"), F.lit(0).cast("long").alias("least"))
    waiting = links.select("conv_id", "call_id").distinct()
    fresh = calls.select("conv_id", "call_id").join(waiting, ["conv_id", "call_id"], "left_anti").withColumn("level", F.lit(0).cast("long"))
    done = fresh = staged(fresh, "levels")
    one_call = Window.partitionBy("conv_id", "call_id")
    while True:
        ended = fresh.select("conv_id", F.col("call_id").alias("target"), "level")
        now = links.join(ended, ["conv_id", "target"], "left").select(
            "conv_id", "call_id", F.when(F.col("level").isNull(), F.col("target")).alias("target"), "step",
            F.greatest("least", F.col("step") + F.col("level")).alias("least"),
        )
        now = staged(now.withColumns({"open": F.count("target").over(one_call), "least": F.max("least").over(one_call)}), "open-links")
        fresh = now.filter("open = 0").groupBy("conv_id", "call_id").agg(F.max("least").alias("level"))
        if fresh.isEmpty():
            return done.withColumn("level", F.col("level").cast("int"))
        done = done.unionByName(fresh)
        single = now.filter("open = 1 and target is not null").select("conv_id", F.col("call_id").alias("target"), F.col("target").alias("next"), F.col("step").alias("more"), F.col("least").alias("at_least"))
        links = now.filter("target is not null").join(single, ["conv_id", "target"], "left").select(
            "conv_id", "call_id", F.coalesce("next", "target").alias("target"), F.least(F.col("step") + F.coalesce("more", F.lit(0)), long).alias("step"),
            F.greatest("least", F.col("step") + F.col("at_least")).alias("least"),
        )


def ordered(calls: DataFrame) -> DataFrame:
    """place: the topological order of the valid levels in each conversation, ties by turn and position."""
    w = Window.partitionBy("conv_id").orderBy(F.col("level").asc_nulls_last(), "turn", "pos")
    return calls.withColumn("place", F.row_number().over(w) - 1)


#: Links of a conversation that one task folds.
LINKS = 200_000

SCHEMAS = {
    "lookup": {"required": ["query", "top"], "additionalProperties": False, "properties": {"query": {"type": "string"}, "top": {"type": "integer", "minimum": 1, "maximum": 300}, "after": {"type": "string"}}},
    "summarise": {"required": ["text", "words"], "additionalProperties": False, "properties": {"text": {"type": "string"}, "words": {"type": "integer", "minimum": 2}, "style": {"type": "string", "enum": ["short", "long"]}, "after": {"type": "string"}}},
}


def as_tool_messages(conversations: DataFrame) -> DataFrame:
    """Tool traffic derived from every row of conversations: an assistant turn becomes a call whose
    arguments hold its whole text (from the third turn on it refers to the call two turns before, so that references form
    chains as long as a conversation), a user turn the result of the turn before it, with its whole text."""
    words = F.size(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(r"\S+"), F.lit(0)))
    call_id = lambda turn: F.concat(F.lit("call_"), turn.cast("string"))
    after = F.when(F.col("turn") > 2, F.concat(F.lit("${"), call_id(F.col("turn") - 2), F.lit("}")))
    lookup = F.struct(F.col("text").alias("query"), words.alias("top"), after.alias("after"))
    summarise = F.struct("text", words.alias("words"), F.when(words % 3 == 0, "brief").when(words % 2 == 0, "short").otherwise("long").alias("style"), after.alias("after"))
    call = F.when(
        F.col("turn") % 3 == 0, F.concat(F.lit('{"tool_calls":[{"name":"summarise","id":"'), call_id(F.col("turn")), F.lit('","arguments":'), F.to_json(summarise), F.lit("}]}"))
    ).otherwise(F.concat(F.lit('{"tool_calls":[{"name":"lookup","id":"'), call_id(F.col("turn")), F.lit('","arguments":'), F.to_json(lookup), F.lit("}]}")))
    result = F.to_json(F.struct(call_id(F.col("turn") - 1).alias("tool_call_id"), F.col("text").alias("content")))
    role = F.when(F.col("role") == "user", "tool").otherwise(F.col("role"))
    return conversations.select("conv_id", "turn", role.alias("role"), F.when(F.col("role") == "assistant", call).when(F.col("role") == "user", result).otherwise(F.col("text")).alias("text"))


def op6_toolcalls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tool traffic derived from all conversations, linked, ordered, validated and serialised."""
    linked = ordered(link_calls(as_tool_messages(table(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text")), SCHEMAS))
    return linked.select("conv_id", "turn", "call_id", "name", "status", "result_turn", "result", "level", "place", F.array_join("faults", "; ").alias("faults"), "valid", "canonical")
