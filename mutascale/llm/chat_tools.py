"""Tool-call linking for chat formatting.

Calls and results are joined by their identifier within a conversation. A call may name the call it depends on; its depth in
that forest is found by pointer doubling, so a chain of n calls takes log2(n) joins however long the conversation is, and no
conversation is collected into one task. Sorting by ``depth, position`` is a topological order. Arguments are
validated against the schema of their tool, and call and result become one canonical JSON text.

Defined results: of calls with one identifier in a conversation the first by position (then by name, arguments) holds it and
the others have status ``duplicate``; of several results the first answers and the others are counted. A call without
result is ``unanswered``, a result without call ``orphan``. A call that depends on an unknown one is a root; calls that depend on
each other in a circle, or on such calls, have a null depth and the status ``circular``. A null identifier, conversation or position never
links: such calls are ``unanswered`` roots and such results ``orphan``. Null or malformed arguments are invalid. Repeated rows are
duplicates. An empty table gives an empty result. Only the named columns are read.
"""

from __future__ import annotations

import json
from math import isfinite

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mutascale.llm.texts import splittable, stored

TYPES = {"string": str, "integer": int, "number": (int, float), "boolean": bool, "array": list, "object": dict}
#: tool -> argument -> (type, required)
Schemas = dict[str, dict[str, tuple[str, bool]]]


def _strict(pairs: list[tuple]) -> dict:
    out = dict(pairs)
    if len(out) != len(pairs):
        raise ValueError("repeated key")
    return out


def parse(arguments: str | None):
    """The JSON value, or None if there is none: repeated keys and non-finite numbers are malformed."""
    def reject(_):
        raise ValueError("not finite")

    def number(text: str) -> float:
        value = float(text)
        return value if isfinite(value) else reject(text)

    try:
        return json.loads(arguments, object_pairs_hook=_strict, parse_constant=reject, parse_float=number)
    except (TypeError, ValueError, RecursionError):
        return None


def problems(name: str | None, arguments: str | None, schemas: Schemas) -> list[str]:
    """What is wrong with a call, sorted; empty if it is valid."""
    schema = schemas.get(name or "")
    if schema is None:
        return ["unknown tool"]
    value = parse(arguments)
    if not isinstance(value, dict):
        return ["arguments are no object"]
    found = [f"missing {key}" for key, (_, required) in schema.items() if required and key not in value]
    for key, item in value.items():
        if key not in schema:
            found.append(f"unexpected {key}")
        elif not isinstance(item, TYPES[schema[key][0]]) or (isinstance(item, bool) and schema[key][0] != "boolean"):
            found.append(f"{key} is no {schema[key][0]}")
    return sorted(found)


def canonical(value) -> str:
    """Keys sorted, no spaces, non-ASCII text as it is."""
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def depths(calls: DataFrame) -> DataFrame:
    """``conv, call, depth`` of each call of a forest ``conv, call, parent``; null where it never reaches a root.

    Each round doubles the distance that is jumped, so calls that still point somewhere after more rounds than the number of calls
    has binary digits are in or behind a circle.
    """
    known = calls.select("conv", F.col("call").alias("parent"))
    roots = calls.join(known, ["conv", "parent"], "left_anti").select("conv", "call", F.lit(None).cast("string").alias("up"), F.lit(0).alias("jump"))
    linked = calls.join(known, ["conv", "parent"], "left_semi").select("conv", "call", F.col("parent").alias("up"), F.lit(1).alias("jump"))
    state = stored(roots.unionByName(linked), "jumps")
    for _ in range(state.count().bit_length() + 1):
        if not state.filter("up IS NOT NULL").limit(1).count():
            break
        target = state.select("conv", F.col("call").alias("up"), F.col("up").alias("next"), F.col("jump").alias("more"))
        done = state.filter("up IS NULL")
        moved = state.filter("up IS NOT NULL").join(target, ["conv", "up"]).select(
            "conv", "call", F.col("next").alias("up"), (F.col("jump") + F.col("more")).alias("jump")
        )
        state = stored(done.unionByName(moved), "jumps")
    return state.select("conv", "call", F.when(F.col("up").isNull(), F.col("jump")).alias("depth"))


def link_calls(
    messages: DataFrame, schemas: Schemas, conv: str = "conv_id", position: str = "position", kind: str = "kind",
    call: str = "call_id", name: str = "name", arguments: str = "arguments", parent: str = "depends_on", content: str = "content",
) -> DataFrame:
    """One row per call and per orphan result: ``conv_id, call_id, position, depth, status, errors, n_results, json``.

    ``kind`` is ``call`` or ``result``; other messages are no part of the result.
    """
    rows = messages.select(
        F.col(conv).alias("conv"), F.col(position).cast("long").alias("position"), F.col(kind).alias("kind"),
        F.col(call).cast("string").alias("call"), F.col(name).alias("name"), F.col(arguments).alias("arguments"),
        F.col(parent).cast("string").alias("parent"), F.col(content).alias("content"),
    ).filter("kind IN ('call', 'result')")
    rows = stored(rows, "messages")
    first = Window.partitionBy("conv", "call").orderBy("position", "name", "arguments", "parent", "content")
    calls, results = rows.filter("kind = 'call'").drop("kind", "content"), rows.filter("kind = 'result'")
    named = F.col("conv").isNotNull() & F.col("call").isNotNull() & F.col("position").isNotNull()
    # identifiers are unique but for duplicates; the first of each is found with a limit per task before the shuffle
    order = Window.partitionBy("conv", "call").orderBy("position", "name", "arguments", "parent")
    holders = calls.filter(named).withColumn("place", F.row_number().over(order)).filter("place = 1").drop("place")
    holders = stored(holders, "calls")
    answers = results.filter(named).withColumn("place", F.row_number().over(first)).filter("place = 1").select("conv", "call", "content")
    counts = results.filter(named).groupBy("conv", "call").agg(F.count(F.lit(1)).alias("n_results"))
    answers = answers.join(counts, ["conv", "call"])
    linked = holders.join(splittable(answers), ["conv", "call"], "left")
    linked = linked.join(depths(holders.select("conv", "call", "parent")), ["conv", "call"], "left").withColumn(
        "status", F.when(F.col("depth").isNull(), "circular").when(F.col("n_results").isNull(), "unanswered").otherwise("linked")
    )
    same = ["conv", "call", "position", "name", "arguments", "parent"]
    copies = calls.filter(named).groupBy(*same).agg(F.count(F.lit(1)).alias("n"))
    held = holders.select(*(F.col(c).alias(f"h_{c}") for c in same))
    both = [F.col(c).eqNullSafe(F.col(f"h_{c}")) for c in same]
    copies = copies.join(held, both[0] & both[1] & both[2] & both[3] & both[4] & both[5], "left")
    copies = copies.withColumn("n", F.col("n") - F.col("h_call").isNotNull().cast("int")).filter("n > 0")
    copies = copies.select(*same, F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))).alias("__copy")).drop("__copy")
    loose = calls.filter(~named)
    empty = {"content": F.lit(None).cast("string"), "n_results": F.lit(None).cast("long")}
    copies = copies.withColumns({**empty, "depth": F.lit(None).cast("int"), "status": F.lit("duplicate")})
    loose = loose.withColumns({**empty, "depth": F.lit(0), "status": F.lit("unanswered")})
    orphans = results.join(holders.select("conv", "call"), ["conv", "call"], "left_anti").drop("kind").withColumns(
        {"n_results": F.lit(1).cast("long"), "depth": F.lit(None).cast("int"), "status": F.lit("orphan")}
    )

    @F.pandas_udf("errors array<string>, json string")
    def checked(batch: pd.DataFrame) -> pd.DataFrame:
        out = []
        for row in batch.to_dict("records"):
            row = {k: None if pd.isna(v) else v for k, v in row.items()}
            if row["status"] == "orphan":
                out.append(([], canonical({"id": row["call"], "result": row["content"]})))
                continue
            value = parse(row["arguments"])
            record = {"arguments": value if value is not None else row["arguments"], "id": row["call"], "name": row["name"]}
            if row["status"] == "linked":
                record["result"] = row["content"]
            out.append((problems(row["name"], row["arguments"], schemas), canonical(record)))
        return pd.DataFrame(out, columns=["errors", "json"])

    names = ["conv", "call", "position", "name", "arguments", "content", "depth", "status", "n_results"]
    every = linked.select(*names)
    for part in (copies, loose, orphans):
        every = every.unionByName(part.select(*names))
    return every.withColumn("c", checked(F.struct("call", "name", "arguments", "content", "status"))).select(
        F.col("conv").alias(conv), F.col("call").alias(call), "position", "depth", "status", "c.errors",
        F.coalesce("n_results", F.lit(0).cast("long")).alias("n_results"), "c.json",
    )


def calls_of_turns(turns: DataFrame) -> DataFrame:
    """Messages with tool calls, derived from plain conversations: each user turn asks a tool, and the assistant answers.

    A user turn becomes a call of ``search`` (texts with a question mark or under 40 words) or ``write``; the call depends on
    the user turn two before it. The assistant turn that follows it becomes its result. System turns become results that no call asked for.
    """
    words = F.size(F.split(F.trim(F.coalesce("text", F.lit(""))), r"\s+"))
    at = lambda n: F.concat_ws("-", F.lit("call"), (F.col("turn") + n).cast("string"))
    short = (words < 40) | F.coalesce(F.col("text").contains("?"), F.lit(False))
    user = F.col("role") == "user"
    return turns.select(
        "conv_id", F.col("turn").alias("position"),
        F.when(user, "call").when(F.col("role").isin("assistant", "system"), "result").alias("kind"),
        F.when(user, at(0)).when(F.col("role") == "assistant", at(-1)).otherwise("system").alias("call_id"),
        F.when(user & short, "search").when(user, "write").alias("name"),
        F.when(user & short, F.to_json(F.struct(F.col("text").alias("query"), words.alias("limit")))).when(
            user, F.to_json(F.struct(words.alias("words"), F.col("text").alias("topic")))
        ).alias("arguments"),
        F.when(user, at(-2)).alias("depends_on"), F.when(~user, F.col("text")).alias("content"),
    )
