"""Chat formatting: tool calls linked with their results, ordered, validated and serialised.

Calls and results meet in a hash join on conversation and identifier. Repeated identifiers are
reduced first, on each side, to their earliest row, by aggregates that combine before the shuffle.

Order: a call comes after the calls it depends on. Calls stand by position; only a call that names
a later one moves behind it, and its own dependents with it. A conversation whose calls are in order takes no more
work. In the others, calls without open dependencies are peeled off until none is left; what never peels waits for itself.
A conversation is peeled in one task while its edges are ``EDGES_IN_TASK`` at most, and in rounds over tables beyond
that: as many as its longest chain from its first call that is out of order. Both give the same order. Places in a
conversation are counted over range partitions, so that a conversation of any size is dealt over many tasks.

Arguments are checked against a JSON schema for each tool (type, one or a list; required, properties,
additionalProperties, enum, minimum, maximum, minLength, maxLength, items; each keyword judges values of its own kind
only) and written with the call and its result as canonical JSON: keys sorted, no blanks, text as it is.

Defined results: rows with a null conversation or identifier are left out; a call without a result is
``unanswered``, a result without a call ``orphan``; both keep their place; calls that wait for each
other, and those that depend on them, are ``cyclic`` and come last; a null position is before all others; dependencies that no call has are counted and ignored; null
or broken arguments and unknown tools are invalid, and so are numbers beyond doubles and lone surrogates, which
canonical JSON cannot hold; of a key repeated in an object the last counts; schemas with a type that does not exist, or of over
``SCHEMA_CHARACTERS`` characters in all, are refused before anything runs; very long texts are taken whole; empty tables give no rows;
columns besides the named ones play no part.
"""

from __future__ import annotations

import json
import math

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .staging import shuffle_partitions, staged

SCHEMA_CHARACTERS, EDGES_IN_TASK = 1_000_000, 1_000_000
#: After so many rounds what is settled is written, so that its plan stays short.
STAGED_ROUNDS = 16
KEY = ["conversation", "call_id"]
ORDER = "ready long, wait long, cyclic boolean"


def canonical(value: object) -> str:
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False)


def _whole(number: str) -> int | float:
    return int(value) if (value := float(number)).is_integer() else value


def _by_value(value: object) -> str:
    """Canonical JSON in which numbers of one value are written alike."""
    return canonical(json.loads(canonical(value), parse_float=_whole))


def _is_number(value: object) -> bool:
    return isinstance(value, (int, float)) and not isinstance(value, bool)


KINDS = {
    "object": lambda v: isinstance(v, dict),
    "array": lambda v: isinstance(v, list),
    "string": lambda v: isinstance(v, str),
    "boolean": lambda v: isinstance(v, bool),
    "null": lambda v: v is None,
    "number": _is_number,
    "integer": lambda v: _is_number(v) and v == int(v),
}
LIMITS = {
    "minimum": (_is_number, lambda v, limit: v >= limit), "maximum": (_is_number, lambda v, limit: v <= limit),
    "minLength": (KINDS["string"], lambda v, limit: len(v) >= limit), "maxLength": (KINDS["string"], lambda v, limit: len(v) <= limit),
}


def _kinds(schema: dict) -> list[str]:
    kinds = schema.get("type", [])
    return [kinds] if isinstance(kinds, str) else kinds


def refuse_unknown_types(schema: dict, path: str = "$") -> None:
    for kind in _kinds(schema):
        if kind not in KINDS:
            raise ValueError(f"{path}: no type {kind!r}")
    for name, inner in schema.get("properties", {}).items():
        refuse_unknown_types(inner, f"{path}.{name}")
    if "items" in schema:
        refuse_unknown_types(schema["items"], f"{path}[]")


def violations(value: object, schema: dict, path: str = "$") -> list[str]:
    """What is wrong with a value under a schema, in the order of the schema's properties."""
    kinds = _kinds(schema)
    if kinds and not any(KINDS[k](value) for k in kinds):
        return [f"{path}: not of type {' or '.join(kinds)}"]
    out = []
    if "enum" in schema and _by_value(value) not in map(_by_value, schema["enum"]):
        out.append(f"{path}: not in enum")
    out += [f"{path}: {name} is {schema[name]}" for name, (own, fits) in LIMITS.items() if name in schema and own(value) and not fits(value, schema[name])]
    if isinstance(value, dict):
        properties = schema.get("properties", {})
        out += [f"{path}.{name}: missing" for name in schema.get("required", []) if name not in value]
        if schema.get("additionalProperties") is False:
            out += [f"{path}.{name}: not allowed" for name in sorted(value) if name not in properties]
        for name, inner in properties.items():
            if name in value:
                out += violations(value[name], inner, f"{path}.{name}")
    if isinstance(value, list) and "items" in schema:
        for k, item in enumerate(value):
            out += violations(item, schema["items"], f"{path}[{k}]")
    return out


def _refused(number: str) -> float:
    value = float(number)
    if not math.isfinite(value):
        raise ValueError(f"{number} is no number of JSON")
    return value


def parsed(text: str | None) -> tuple[bool, object]:
    """Whether a text is JSON that canonical JSON can hold, and its value."""
    try:
        value = json.loads(text, parse_constant=_refused, parse_float=_refused)
        canonical({"arguments": value}).encode("utf-8")  # as deep as the message will be
    except (TypeError, ValueError, RecursionError):
        return False, None
    return True, value


def _checked(schemas: dict[str, dict]):
    if len(canonical(schemas)) > SCHEMA_CHARACTERS:
        raise ValueError(f"schemas of over {SCHEMA_CHARACTERS} characters; join them to the calls as a table")
    for name, schema in schemas.items():
        refuse_unknown_types(schema, name)

    @F.pandas_udf(T.StructType([T.StructField("errors", T.ArrayType(T.StringType())), T.StructField("message", T.StringType())]))
    def checked(ids: pd.Series, names: pd.Series, arguments: pd.Series, results: pd.Series, is_call: pd.Series) -> pd.DataFrame:
        out = []
        for call_id, name, text, result, call in zip(ids, names, arguments, results, is_call, strict=True):
            good, value = parsed(text)
            if not call:
                errors = []
            elif not good:
                errors = ["$: not JSON"]
            else:
                errors = violations(value, schemas[name]) if name in schemas else [f"unknown tool {name}"]
            out.append((errors, canonical({"arguments": value, "id": call_id, "name": name, "result": result})))
        return pd.DataFrame(out, columns=["errors", "message"])

    return checked


def _earliest(rows: DataFrame, columns: list[str], count: str) -> DataFrame:
    """One row for each key, the earliest by position and then by content, with the number of rows."""
    return (
        rows.where(F.col("conversation").isNotNull() & F.col("call_id").isNotNull())
        .groupBy(*KEY)
        .agg(F.min(F.struct("position", *columns)).alias("one"), F.count(F.lit(1)).alias(count))
        .select(*KEY, "one.*", count)
    )


def peeled(positions: dict[str, int], needs: dict[str, list[str]]) -> dict[str, tuple[int, int, bool]]:
    """For each call ready, wait and cyclic; ``needs`` names calls of ``positions`` only."""
    dependents: dict[str, list[str]] = {}
    for call, needed in needs.items():
        for n in needed:
            dependents.setdefault(n, []).append(call)
    open_ = {c: len(needs.get(c, ())) for c in positions}
    state = {c: (p, 0) for c, p in positions.items()}
    free = [c for c, n in open_.items() if not n]
    done = 0
    while done < len(free):
        call = free[done]
        done += 1
        ready, wait = state[call]
        for d in dependents.get(call, ()):
            state[d] = max(state[d], (ready, wait + 1))
            open_[d] -= 1
            if not open_[d]:
                free.append(d)
    return {c: (*state[c], False) if not open_[c] else (positions[c], 0, True) for c in positions}


def _in_task(state: DataFrame, edges: DataFrame) -> DataFrame:
    """conversation, call_id, ready, wait, cyclic of whole conversations, each in one task."""
    kinds = {f.name: f.dataType.simpleString() for f in state.schema}

    def order(calls: pa.Table, own: pa.Table) -> pa.Table:
        needs: dict[str, list[str]] = {}
        for call, needed in zip(own.column("call_id").to_pylist(), own.column("needed").to_pylist(), strict=True):
            needs.setdefault(call, []).append(needed)
        ids = calls.column("call_id").to_pylist()
        found = peeled(dict(zip(ids, calls.column("position").to_pylist(), strict=True)), needs)
        ready, wait, cyclic = zip(*(found[c] for c in ids), strict=True) if ids else ((), (), ())
        return calls.select(KEY).append_column("ready", pa.array(ready, pa.int64())).append_column("wait", pa.array(wait, pa.int64())).append_column("cyclic", pa.array(cyclic, pa.bool_()))

    schema = f"conversation {kinds['conversation']}, call_id string, {ORDER}"
    return state.select(*KEY, "position").groupBy("conversation").cogroup(edges.groupBy("conversation")).applyInArrow(order, schema)


def _in_rounds(state: DataFrame, edges: DataFrame, first: DataFrame) -> DataFrame:
    """The same by rounds over tables; ``first``: conversation and its first position that is out of order."""
    start = state.join(first, "conversation").select(*KEY, "position", (F.col("position") < F.col("first")).alias("settled"))
    open_ = staged(start.where(~F.col("settled")).select(*KEY, "position", F.col("position").alias("ready"), F.lit(0).cast("long").alias("wait")), "call-open")
    done = start.where("settled").select(*KEY, F.col("position").alias("ready"), F.lit(0).cast("long").alias("wait"), F.lit(False).alias("cyclic"))
    left = staged(edges.join(open_.select("conversation", F.col("call_id").alias("needed")), ["conversation", "needed"], "left_semi"), "call-edges-open")
    # a call that is open may depend on a settled one, which stands before it: that moves nothing
    rounds = 0
    while True:
        rounds += 1
        if rounds % STAGED_ROUNDS == 0:
            done = staged(done, "call-done")
        free = staged(open_.join(left.select(*KEY).distinct(), KEY, "left_anti"), "call-free")
        if free.isEmpty():
            break
        done = done.unionByName(free.select(*KEY, "ready", "wait", F.lit(False).alias("cyclic")))
        told = free.select("conversation", F.col("call_id").alias("needed"), F.struct("ready", F.expr("wait + 1 as wait")).alias("after"))
        pushed = left.join(told, ["conversation", "needed"]).groupBy(*KEY).agg(F.max("after").alias("after"))
        left = staged(left.join(told, ["conversation", "needed"], "left_anti"), "call-edges-open")
        moved = open_.join(free.select(*KEY), KEY, "left_anti").join(pushed, KEY, "left").withColumn("to", F.greatest(F.struct("ready", "wait"), F.coalesce("after", F.struct("ready", "wait"))))
        open_ = staged(moved.select(*KEY, "position", "to.ready", "to.wait"), "call-open")
    return done.unionByName(open_.select(*KEY, F.col("position").alias("ready"), F.lit(0).cast("long").alias("wait"), F.lit(True).alias("cyclic")))


def _ready(calls: DataFrame) -> DataFrame:
    """For each call: ready, wait, cyclic. Its order is that of (cyclic, ready, wait, position, call_id)."""
    state = calls.select(*KEY, "position")
    needs = calls.select(*KEY, "position", F.explode("depends_on").alias("needed")).distinct()
    known = calls.select("conversation", F.col("call_id").alias("needed"), F.col("position").alias("from"))
    edges = staged(needs.join(known, ["conversation", "needed"]), "call-edges")
    astray = edges.groupBy("conversation").agg(F.min(F.when(F.col("from") >= F.col("position"), F.col("position"))).alias("first"), F.count(F.lit(1)).alias("edges")).where("first is not null")
    astray = staged(astray, "call-astray")
    in_order = state.join(astray, "conversation", "left_anti").select(*KEY, F.col("position").alias("ready"), F.lit(0).cast("long").alias("wait"), F.lit(False).alias("cyclic"))
    small, large = (astray.where(f"edges {sign} {EDGES_IN_TASK}") for sign in ("<=", ">"))
    # calls without any edge are not peeled: their number has no bound
    linked = staged(edges.select(*KEY).union(edges.select("conversation", "needed")).distinct(), "calls-with-edges")
    with_edges = state.join(linked, KEY, "left_semi")
    alone = state.join(astray, "conversation", "left_semi").join(linked, KEY, "left_anti").select(*KEY, F.col("position").alias("ready"), F.lit(0).cast("long").alias("wait"), F.lit(False).alias("cyclic"))
    rows = in_order.unionByName(alone)
    if not small.isEmpty():
        rows = rows.unionByName(_in_task(with_edges.join(small, "conversation", "left_semi"), edges.join(small, "conversation", "left_semi").select(*KEY, "needed")))
    if not large.isEmpty():
        rows = rows.unionByName(_in_rounds(with_edges.join(large, "conversation", "left_semi"), edges.join(large, "conversation", "left_semi").select(*KEY, "needed"), large.select("conversation", "first")))
    return rows


def _numbered(rows: DataFrame, order: list[Column | str]) -> DataFrame:
    """``rows`` with ``place``, counted from 0 in each conversation, whatever its size."""
    dealt = rows.repartitionByRange(shuffle_partitions(rows.sparkSession), "conversation", *order).withColumn("range", F.spark_partition_id())
    dealt = staged(dealt, "call-ranges")
    ranges = dealt.groupBy("conversation", "range").agg(F.count(F.lit(1)).alias("many"))
    earlier = Window.partitionBy("conversation").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    ranges = staged(ranges.select("conversation", "range", F.coalesce(F.sum("many").over(earlier), F.lit(0)).alias("first")), "call-range-starts")
    within = Window.partitionBy("conversation", "range").orderBy(*order)
    return (
        dealt.withColumn("number", F.row_number().over(within))
        .join(ranges, ["conversation", "range"])
        .withColumn("place", F.col("first") + F.col("number") - 1)
        .drop("range", "number", "first")
    )


def link(calls: DataFrame, results: DataFrame, schemas: dict[str, dict]) -> DataFrame:
    """Linked calls.

    ``calls``: conversation, call_id, position, name, arguments (JSON text), depends_on (array of call ids).
    ``results``: conversation, call_id, position, content.
    Returns conversation, call_id, place, status, cyclic, n_calls, n_results, missing_dependencies, valid, errors, message
    (canonical JSON of the call with its arguments and its result).
    """
    checked = _checked(schemas)
    first = F.coalesce(F.col("position"), F.lit(-1)).cast("long")
    calls, results = calls.withColumn("position", first), results.withColumn("position", first)
    calls = calls.withColumn("depends_on", F.array_sort(F.array_distinct(F.filter(F.coalesce("depends_on", F.array().cast("array<string>")), lambda x: x.isNotNull()))))
    one_call = staged(_earliest(calls, ["name", "arguments", "depends_on"], "n_calls"), "calls")
    one_result = _earliest(results, ["content"], "n_results").withColumnRenamed("position", "result_position")
    found = one_call.select("conversation", F.col("call_id").alias("needed"), F.lit(1).alias("found"))
    wanted = one_call.select(*KEY, F.explode("depends_on").alias("needed"))
    missing = wanted.join(found, ["conversation", "needed"], "left_anti").groupBy(*KEY).agg(F.count(F.lit(1)).alias("missing_dependencies"))
    both = (
        one_call.join(_ready(one_call), KEY).join(missing, KEY, "left")
        .join(one_result, KEY, "full_outer")
        .withColumn("check", checked("call_id", "name", "arguments", "content", F.col("n_calls").isNotNull()))
        .select(
            *KEY,
            F.when(F.col("n_calls").isNull(), "orphan").when(F.col("n_results").isNull(), "unanswered").otherwise("linked").alias("status"),
            F.coalesce("cyclic", F.lit(False)).alias("cyclic"),
            F.coalesce("ready", "result_position").alias("ready"),
            F.coalesce("wait", F.lit(0)).alias("wait"),
            F.coalesce("position", "result_position").alias("position"),
            F.coalesce("n_calls", F.lit(0)).alias("n_calls"),
            F.coalesce("n_results", F.lit(0)).alias("n_results"),
            F.coalesce("missing_dependencies", F.lit(0)).alias("missing_dependencies"),
            (F.col("n_calls").isNotNull() & (F.size("check.errors") == 0)).alias("valid"),
            "check.errors",
            "check.message",
        )
    )
    order = ["cyclic", "ready", "wait", "position", "call_id"]
    return _numbered(both, order).select(*KEY, "place", "status", "cyclic", "n_calls", "n_results", "missing_dependencies", "valid", "errors", "message")


#: Schema of the tool that a user's turn stands for.
REPLY_SCHEMA = {
    "type": "object",
    "required": ["prompt", "turn"],
    "additionalProperties": False,
    "properties": {"prompt": {"type": "string", "minLength": 1}, "turn": {"type": "integer", "minimum": 0}, "after": {"type": "string"}},
}


def from_turns(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Calls and results of a chat without tools: conv_id, turn, role, text.

    A user's turn calls the tool ``reply``, the n-th of a conversation by its turn halved. Every third of them depends on the call two turns later, the one after
    it on none, and all others on the call two turns before, if there is one; in every seventh conversation the second kind depends on the call before as well, so that
    both wait for each other. Every fifth call writes its turn as text, and every eleventh leaves its arguments unfinished. The assistant's next turn
    is the result. Turns of other roles are results of their own: no call asked for them.
    """

    def place(move: int) -> Column:
        return F.concat_ws(":", F.col("conv_id").cast("string"), (F.col("turn") + move).cast("string"))

    none = F.array().cast("array<string>")
    nth = F.floor(F.col("turn") / 2)
    before = F.when(F.col("turn") >= 2, F.array(place(-2))).otherwise(none)
    needed = F.when(nth % 3 == 0, F.array(place(2))).when((nth % 3 == 1) & (F.col("conv_id") % 7 != 0), none).otherwise(before)
    earlier = F.when(F.col("turn") >= 2, place(-2))
    as_number = F.to_json(F.struct(F.col("turn"), F.col("text").alias("prompt"), earlier.alias("after")))
    as_text = F.to_json(F.struct(F.col("turn").cast("string").alias("turn"), F.col("text").alias("prompt"), earlier.alias("after")))
    written = F.when(nth % 5 == 4, as_text).otherwise(as_number)
    calls = turns.where(F.col("role") == "user").select(
        F.col("conv_id").alias("conversation"), place(0).alias("call_id"), F.col("turn").alias("position"), F.lit("reply").alias("name"),
        F.when(nth % 11 == 10, F.left(written, F.length(written) - 1)).otherwise(written).alias("arguments"), needed.alias("depends_on"),
    )
    results = turns.where(~F.coalesce(F.col("role") == "user", F.lit(False))).select(
        F.col("conv_id").alias("conversation"), F.when(F.col("role") == "assistant", place(-1)).otherwise(place(0)).alias("call_id"), F.col("turn").alias("position"), F.col("text").alias("content")
    )
    return calls, results
