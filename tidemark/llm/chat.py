"""Chat formatting with tool calls: link calls to results, order them, validate arguments, write canonical JSON.

Messages are rows; a tool call is a row with a call_id, a tool name and arguments as JSON, a result is a row that
answers a call_id. Calls and results meet in a hash join on (conversation, call_id), so neither a long conversation
nor a busy tool is ever gathered in one task. A call may name calls whose results it uses (`after`). Runs of calls
that wait for one call each are first contracted by pointer doubling; then levels follow from peeling: calls that
wait for nothing settle, round by round, and what never settles is cyclic. Conversations of up to `IN_TASK` calls are
ordered by one task each, in one pass, whatever their depth. Sorting by (root_turn, level, turn) is a
topological order: root_turn is the largest turn of a call and all calls before it, level twice the number of
calls on the longest chain before it. Calls on a cycle, or after one, are marked and keep their own turn.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import checkpointed, new_path

_TYPES: dict[str, tuple[type, ...]] = {"string": (str,), "integer": (int,), "number": (int, float), "boolean": (bool,), "array": (list,), "object": (dict,), "null": (type(None),)}


#: Arguments nested deeper, and integers of more digits, are not taken apart.
DEPTH, DIGITS = 64, 4000
#: Calls of a conversation that one task orders; longer conversations are ordered by rounds of joins.
IN_TASK = 1000


def canonical(value: Any) -> str:
    """JSON with sorted keys, no spaces and no escapes beyond the needed ones."""
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False)


class _Unfit(ValueError):
    """Why a text that may be JSON can't be written as canonical JSON."""


def _integer(digits: str) -> int:
    if len(digits) > DIGITS:
        raise _Unfit("number too long")
    return int(digits)


def _real(number: str) -> float:
    value = float(number)
    if not math.isfinite(value):
        raise _Unfit("number not finite")
    return value


def _no_constant(name: str) -> None:
    raise ValueError(name)  # NaN and Infinity are no JSON


def parsed(text: str) -> tuple[Any, str | None]:
    """The value of a JSON text; or the text itself, and why: not JSON, nested too deeply, a number that is too long or not finite, a lone surrogate."""
    try:
        value = json.loads(text, parse_int=_integer, parse_float=_real, parse_constant=_no_constant)
    except RecursionError:
        return text, "nested too deeply"
    except _Unfit as e:
        return text, str(e)
    except ValueError:
        return text, "not JSON"
    level, rest = 0, [value]
    while rest:
        level += 1
        if level > DEPTH:
            return text, "nested too deeply"
        rest = [x for v in rest if isinstance(v, (dict, list)) for x in (v.values() if isinstance(v, dict) else v)]
    if "\\u" in text:
        try:
            canonical(value).encode()
        except UnicodeEncodeError:
            return text, "lone surrogate"
    return value, None


def problems(value: Any, schema: dict[str, Any], at: str = "$") -> list[str]:
    """Where a value breaks a schema of type, enum, minLength, minimum, maximum, required, properties, additionalProperties and items."""
    out: list[str] = []
    kind = schema.get("type")
    if kind is not None:
        kinds = [kind] if isinstance(kind, str) else kind
        if not any(isinstance(value, _TYPES[k]) and (k == "boolean" or not isinstance(value, bool)) for k in kinds):
            return [f"{at}: not {'/'.join(kinds)}"]
    if "enum" in schema and value not in schema["enum"]:
        out.append(f"{at}: not one of the enum")
    if isinstance(value, str) and len(value) < schema.get("minLength", 0):
        out.append(f"{at}: too short")
    if isinstance(value, (int, float)) and not isinstance(value, bool):
        if value < schema.get("minimum", value):
            out.append(f"{at}: under the minimum")
        if value > schema.get("maximum", value):
            out.append(f"{at}: over the maximum")
    if isinstance(value, dict):
        known = schema.get("properties", {})
        out += [f"{at}.{k}: missing" for k in schema.get("required", []) if k not in value]
        for k, v in sorted(value.items()):
            if k in known:
                out += problems(v, known[k], f"{at}.{k}")
            elif schema.get("additionalProperties") is False:
                out.append(f"{at}.{k}: unknown")
    if isinstance(value, list) and "items" in schema:
        for k, v in enumerate(value):
            out += problems(v, schema["items"], f"{at}[{k}]")
    return out


def _formatted(schemas: dict[str, dict[str, Any]]):
    def one(role: str | None, text: str | None, call: str | None, tool: str | None, arguments: str | None, answers: str | None) -> tuple[str, list[str]]:
        message: dict[str, Any] = {"role": role, "content": text}
        found: list[str] = []
        if call is not None:
            value, unfit = (None, None) if arguments is None else parsed(arguments)
            if unfit:
                found = [f"$: {unfit}"]
            elif tool not in schemas:
                found = ["unknown tool"]
            else:
                found = problems(value, schemas[tool])
            message["tool_calls"] = [{"id": call, "name": tool, "arguments": value}]
        if answers is not None:
            message["tool_call_id"] = answers
        return canonical(message), found

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["role", "text", "call_id", "tool", "arguments", "answers"]
        for batch in batches:
            made = [one(*x) for x in zip(*(batch.column(n).to_pylist() for n in names), strict=True)]
            rest = [n for n in batch.schema.names if n not in ("arguments", "text", "tool")]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in rest), pa.array([m[0] for m in made], pa.string()), pa.array([m[1] for m in made], pa.list_(pa.string()))], names=[*rest, "message", "problems"])

    return rows


def _ordered(turns: dict[str, int], after: dict[str, list[str | None]]) -> dict[str, tuple[int, int]]:
    """level and root_turn of each call of one conversation that is on no cycle and after none."""
    waits: dict[str, int] = {}
    then: dict[str, list[str]] = {}
    for call, names in after.items():
        known = {n for n in names or [] if n in turns}
        waits[call] = len(known)
        for n in known:
            then.setdefault(n, []).append(call)
    found = {call: (0, turn) for call, turn in turns.items()}
    ready, settled = [call for call, n in waits.items() if not n], {}
    while ready:
        call = ready.pop()
        level, root = settled[call] = found[call]
        for other in then.get(call, []):
            found[other] = max(found[other][0], level + 1), max(found[other][1], root)
            waits[other] -= 1
            if not waits[other]:
                ready.append(other)
    return settled


def _in_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The levels of conversations that come one after the other."""

    def ended(rows: list[dict]) -> pa.RecordBatch:
        own = {r["call_id"]: r["turn"] for r in rows}
        settled = _ordered(own, {r["call_id"]: r["after"] for r in rows})
        made = [{"conv": r["conv"], "call_id": (c := r["call_id"]), "level": settled.get(c, (0, 0))[0], "root_turn": settled[c][1] if c in settled else r["turn"], "cyclic": c not in settled} for r in rows]
        return pa.RecordBatch.from_pylist(made, schema=pa.schema([("conv", conv), ("call_id", pa.string()), ("level", pa.int32()), ("root_turn", pa.int64()), ("cyclic", pa.bool_())]))

    held: list[dict] = []
    for batch in batches:
        conv = batch.schema.field("conv").type
        for row in batch.to_pylist():
            if held and held[-1]["conv"] != row["conv"]:
                yield ended(held)
                held = []
            held.append(row)
    if held:
        yield ended(held)


def _levels(calls: DataFrame) -> DataFrame:
    """conv, call_id, level, root_turn and cyclic of each call: of conversations of up to IN_TASK calls in one pass, of others by rounds."""
    long = calls.groupBy("conv").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > IN_TASK).select("conv")
    rest = calls.join(long, "conv", "left_anti").select("conv", "call_id", F.col("turn").cast("long").alias("turn"), "after")
    schema = "conv struct<none:boolean,name:string>, call_id string, level int, root_turn long, cyclic boolean"
    short = rest.repartition("conv").sortWithinPartitions("conv").mapInArrow(_in_task, schema)
    if long.isEmpty():
        return short
    by_rounds = _rounds(checkpointed(calls.join(long, "conv", "left_semi"))).select("conv", "call_id", "level", F.col("root_turn").cast("long").alias("root_turn"), "cyclic")
    return short.unionByName(by_rounds)


def _rounds(calls: DataFrame) -> DataFrame:
    """conv, call_id, level, root_turn and cyclic of each call: the calls of the longest chain before it, and the largest turn of it and all before it.

    calls: conv and call_id (unique, not null), turn, after. References to unknown calls are ignored. A call that
    waits for one other points to it, and pointers are doubled until they reach a call that waits for none or
    several: a chain of n calls takes log2(n) rounds. Those calls are peeled: a round settles the ones whose
    predecessors are settled, so there are as many as such calls follow each other; settled rows go to the shared
    folder, and a round carries on only those that wait. Pointers that still move after log2 of all calls go round.
    """
    edges = calls.select("conv", "call_id", F.explode("after").alias("before")).where("before is not null").distinct()
    known = calls.select("conv", F.col("call_id").alias("before"), F.col("turn").alias("before_turn"))
    edges = checkpointed(edges.join(known.hint("shuffle_hash"), ["conv", "before"]))
    own = calls.select("conv", "call_id", F.col("turn").alias("root_turn"))
    if edges.isEmpty():
        return own.select("*", F.lit(0).alias("level"), F.lit(False).alias("cyclic"))
    waits = edges.groupBy("conv", "call_id").agg(F.count(F.lit(1)).alias("waits"), F.first("before").alias("ahead"))
    nodes = checkpointed(own.join(waits, ["conv", "call_id"], "left").select("conv", "call_id", "root_turn", F.coalesce("waits", F.lit(0)).alias("waits"), "ahead"))
    # single: a call that waits for one; ahead, steps and top: the call it has reached, over how many, and the largest turn on the way, its own included
    single = checkpointed(nodes.where("waits = 1").select("conv", "call_id", "ahead", F.lit(1).cast("long").alias("steps"), F.col("root_turn").alias("top")))
    rounds = int(single.count()).bit_length()
    for _ in range(rounds):
        onward = single.select("conv", F.col("call_id").alias("ahead"), F.col("ahead").alias("next"), F.col("steps").alias("more"), F.col("top").alias("up"))
        step = single.join(onward.hint("shuffle_hash"), ["conv", "ahead"], "left")
        single = checkpointed(step.select(
            "conv", "call_id", F.coalesce("next", "ahead").alias("ahead"), (F.col("steps") + F.coalesce("more", F.lit(0))).alias("steps"), F.greatest("top", "up").alias("top"), F.col("next").isNotNull().alias("moved"),
        ))
        if single.where("moved").isEmpty():
            break
    inner = nodes.where("waits = 1").select("conv", F.col("call_id").alias("ahead"))
    reached = single.join(inner, ["conv", "ahead"], "left_anti").select("conv", "call_id", "ahead", "steps", "top")  # the others go round
    # the calls that wait for none or several, over the edges among them
    via = reached.select("conv", F.col("call_id").alias("before"), F.col("ahead").alias("via"), "steps", "top")
    several = edges.join(nodes.where("waits > 1").select("conv", "call_id"), ["conv", "call_id"]).join(via.hint("shuffle_hash"), ["conv", "before"], "left")
    several = checkpointed(several.select("conv", "call_id", F.coalesce("via", "before").alias("before"), F.coalesce("steps", F.lit(0).cast("long")).alias("steps"), F.coalesce("top", "before_turn").alias("top")))
    state = checkpointed(nodes.where("waits <> 1").select("conv", "call_id", "waits", F.lit(0).alias("level"), "root_turn"))
    spark, out = calls.sparkSession, new_path(calls.sparkSession, "levels")
    while True:
        ready = state.where("waits = 0")
        ready.drop("waits").write.mode("append").parquet(out)
        if ready.isEmpty():
            break
        settled = ready.select("conv", F.col("call_id").alias("before"), F.col("level").alias("l"), F.col("root_turn").alias("r"))
        step = several.join(settled.hint("shuffle_hash"), ["conv", "before"]).groupBy("conv", "call_id").agg(F.count(F.lit(1)).alias("n"), F.max(F.col("l") + F.col("steps")).alias("l"), F.max(F.greatest("r", "top")).alias("r"))
        state = checkpointed(state.where("waits > 0").join(step, ["conv", "call_id"], "left").select(
            "conv", "call_id", (F.col("waits") - F.coalesce("n", F.lit(0))).alias("waits"),
            F.greatest("level", F.coalesce(F.col("l") + 1, F.lit(0))).cast("int").alias("level"), F.greatest("root_turn", "r").alias("root_turn"),
        ))
    settled = checkpointed(spark.read.schema(state.drop("waits").schema).parquet(out))
    ends = settled.select("conv", F.col("call_id").alias("ahead"), F.col("level").alias("l"), F.col("root_turn").alias("r"))
    runs = reached.join(ends.hint("shuffle_hash"), ["conv", "ahead"]).select("conv", "call_id", (F.col("l") + F.col("steps")).cast("int").alias("level"), F.greatest("r", "top").alias("root_turn"))
    ordered = settled.select("conv", "call_id", "level", "root_turn").unionByName(runs).withColumn("cyclic", F.lit(False))
    cyclic = own.join(ordered, ["conv", "call_id"], "left_anti").select("conv", "call_id", F.lit(0).alias("level"), "root_turn", F.lit(True).alias("cyclic"))
    return ordered.unionByName(cyclic)


def linked(messages: DataFrame, schemas: dict[str, dict[str, Any]]) -> DataFrame:
    """Of messages (conv, turn, role, text, call_id, tool, arguments, answers, after): conv, turn, role, call_id,
    answers, root_turn, level, status, problems and message (canonical JSON); root_turn, level, turn sort a conversation.

    status: `plain` (neither call nor result), `linked`, `open` (a call without result), `orphan` (a result without
    call), `repeated` (a call_id used before in its conversation, or a further result of one call), `cyclic`. The
    smallest turn is a call's or result's own; of rows equal in turn too each comes out alike, with the least `after` among them.
    Arguments that are no JSON, nested too deeply, or hold a number too long or not finite or a lone surrogate are a problem,
    and stand as text in the message, which is always JSON. Null conversations
    are one conversation; they and null turns sort first. Other columns are ignored. Each message gives one row,
    chains may have any length, and empty tables give none.
    """
    m = messages.select("conv", "turn", "role", "text", "call_id", "tool", "arguments", "answers", "after")
    # joins go by a conversation that is never null
    m = m.withColumn("_key", F.coalesce("call_id", "answers")).withColumn("_conv", F.struct(F.col("conv").isNull().alias("none"), F.coalesce(F.col("conv").cast("string"), F.lit("")).alias("name")))
    first = F.coalesce(F.col("turn"), F.lit(-(2**63)))  # a null turn is the first
    calls = m.where("call_id is not null").groupBy(F.col("_conv").alias("conv"), "call_id").agg(F.min(first).alias("turn"), F.min_by("after", F.struct(first, F.sort_array("after"))).alias("after"))
    calls = checkpointed(calls)
    results = m.where("answers is not null").groupBy(F.col("_conv").alias("conv"), F.col("answers").alias("call_id")).agg(F.min(first).alias("result_turn"))
    links = calls.drop("after").withColumnRenamed("turn", "call_turn").join(results.hint("shuffle_hash"), ["conv", "call_id"], "full")
    links = links.join(_levels(calls).hint("shuffle_hash"), ["conv", "call_id"], "left")
    links = links.select(F.col("conv").alias("_conv"), F.col("call_id").alias("_key"), "call_turn", "result_turn", F.col("level").alias("_level"), F.col("root_turn").alias("_root"), "cyclic")
    joined = m.join(links.hint("shuffle_hash"), ["_conv", "_key"], "left")
    is_call = F.col("call_id").isNotNull()
    status = (
        F.when(F.col("_key").isNull(), "plain")
        .when(is_call & (first > F.col("call_turn")), "repeated")
        .when(~is_call & F.col("call_turn").isNull(), "orphan")
        .when(~is_call & (first > F.col("result_turn")), "repeated")
        .when(F.col("cyclic"), "cyclic")
        .when(F.col("result_turn").isNull(), "open")
        .otherwise("linked")
    )
    found = F.col("status").isin("linked", "open")
    root = F.when(F.col("_root") != -(2**63), F.col("_root")).cast(dict(messages.dtypes)["turn"])
    rows = joined.withColumn("status", status).select(
        "conv", "turn", "role", "text", "call_id", "tool", "arguments", "answers", "status",
        F.when(found, root).otherwise(F.col("turn")).alias("root_turn"),
        F.when(found, 2 * F.col("_level") + F.when(is_call, 0).otherwise(1)).otherwise(0).cast("int").alias("level"),
    )
    kinds = dict(rows.dtypes)
    out = ["conv", "turn", "role", "call_id", "answers", "status", "root_turn", "level"]
    schema = ", ".join(f"{c} {kinds[c]}" for c in out) + ", message string, problems array<string>"
    return rows.mapInArrow(_formatted(schemas), schema)


def transcripts(rows: DataFrame) -> DataFrame:
    """conv and its messages as one JSON array, for conversations that fit in a row."""
    order = F.struct("root_turn", "level", "turn", "message")
    return rows.groupBy("conv").agg(F.concat(F.lit("["), F.array_join(F.transform(F.array_sort(F.collect_list(order)), lambda x: x["message"]), ","), F.lit("]")).alias("transcript"))
