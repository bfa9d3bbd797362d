"""Chat formatting: tool calls linked to their results, ordered, validated and serialised.

* Calls and results are joined by (conversation, identifier). Of repeated calls or results of one
  identifier the first by ``seq`` counts.
* Calls are ordered topologically: the level of a call is the longest chain of calls that it waits
  for. A call that waits for one open call points at it with x -> max(b, x + w); such functions
  compose, so chains are followed by doubling the pointers, in rounds that grow with the logarithm of
  their length. Calls that wait for several open ones get their levels when those are known, so rounds
  beyond that are only as many as such calls follow one another. Each round is written to shared
  storage. Calls on a cycle, or behind one, get no level and come last. Prerequisites that aren't
  calls are ignored.
* Arguments are parsed to variants and checked against the tool's schema in place: required
  parameters, types, enumerated values, and parameters of objects in arguments ("object.parameter").
* The linked call is serialised as canonical JSON: keys in order, no white space, numbers normalised.

Positions in a conversation are ranks by (level, seq, call_id) found from counts of ranges, so that
a conversation with a third of all calls isn't sorted by one task.

Edge cases: calls and results without conversation or identifier aren't linked; each is one row of its
own with status ``no_id``. Results without a call are ``orphan_result``; arguments that are null, no
JSON, no object or have repeated keys are ``not_json`` and serialised as the string they are; empty
tables give empty results; other columns are ignored. ``seq`` is a number from 0 on; null counts as 0.
"""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from deltaweave.llm.literals import table
from deltaweave.session import discard, materialize

KEY = ["conv_id", "call_id"]
RANGE = 256
MAX_SENT_SCHEMAS = 10_000
LAST = 2**31 - 1

#: Schemas of the tools in the query's conversations: (tool, parameter, type, required).
SCHEMAS = (("search", "query", "string", True), ("search", "top", "integer", False), ("configure", "query", "string", True), ("configure", "top", "number", False))

# JSON types and the names that Spark gives to variants of them.
TYPES = {"string": "STRING", "integer": "BIGINT", "number": "BIGINT|DECIMAL.*|DOUBLE|FLOAT", "boolean": "BOOLEAN", "array": "ARRAY<.*", "object": "OBJECT<.*"}


def schemas(spark: SparkSession, rows: tuple = SCHEMAS) -> DataFrame:
    """(name, params) with an array of (param, kind, required, allowed) for each tool.

    Rows are (tool, parameter, type, required[, values]); kind is a pattern of variant types, allowed the
    values as JSON (null: any). A parameter "a.b" is b in the object a, and required only if a is there.
    """
    flat = [(r[0], r[1], f"^({TYPES[r[2]]})$", r[3], json.dumps(list(r[4])) if len(r) > 4 else None) for r in rows]
    s = table(spark, flat, "name string, param string, kind string, required boolean, allowed string")
    s = s.withColumn("allowed", F.expr("transform(try_cast(try_parse_json(allowed) as array<variant>), x -> to_json(x))"))
    return s.groupBy("name").agg(F.sort_array(F.collect_list(F.struct("param", "kind", "required", "allowed"))).alias("params"))


def levels(calls: DataFrame) -> DataFrame:
    """(conv_id, call_id, level) for calls (conv_id, call_id, after); null on and behind cycles."""
    names = calls.select("conv_id", F.col("call_id").alias("need"))
    waits = calls.select(*KEY, F.explode(F.array_distinct("after")).alias("need")).join(names, ["conv_id", "need"]).select(*KEY, "need", F.lit(1).cast("long").alias("w"))
    waits = materialize(waits, "waits")
    base = calls.select(*KEY, F.lit(0).cast("long").alias("b"))
    left = waits.count()
    while left:
        ends = _followed(waits, base)
        new_waits, new_base = _contracted(waits, base, ends)
        now = new_waits.count()
        waits, base = new_waits, new_base
        if now == left and new_waits.join(_open(new_waits), ["conv_id", "need"], "left_anti").isEmpty():
            break  # all that is left waits for what waits: cycles and calls behind them
        left = now
    stuck = _open(waits).select("conv_id", F.col("need").alias("call_id"), F.lit(True).alias("_stuck"))
    return base.join(stuck, KEY, "left").select(*KEY, F.when(F.col("_stuck").isNull(), F.col("b").cast("int")).alias("level"))


def _open(waits: DataFrame) -> DataFrame:
    """(conv_id, need): calls that still wait."""
    return waits.select("conv_id", F.col("call_id").alias("need")).distinct()


def _followed(waits: DataFrame, base: DataFrame) -> DataFrame:
    """(conv_id, call_id, to, w, b, round) of calls that wait for one: the function x -> max(b, x + w) of the level of ``to``,
    the first call on the way that waits for none or several; ``round`` is set for calls that only lead round a cycle."""
    one = waits.groupBy(*KEY).agg(F.count("*").alias("n"), F.min("need").alias("to"), F.min("w").alias("w")).where("n = 1")
    jumps, before = materialize(one.join(base, KEY).select(*KEY, "to", "w", "b"), "jumps"), None
    while True:
        on = jumps.select("conv_id", F.col("call_id").alias("to"), F.col("to").alias("_to"), F.col("w").alias("_w"), F.col("b").alias("_b"))
        more = jumps.join(on, ["conv_id", "to"], "left")
        still = more.where("_to is not null").count()
        # calls at the end of a chain drop out with each doubling, so an equal number is cycles alone
        if still == 0 or still == before:
            return more.select(*KEY, "to", "w", "b", F.col("_to").isNotNull().alias("round"))
        new = materialize(more.select(*KEY, F.coalesce("_to", "to").alias("to"), (F.col("w") + F.coalesce("_w", F.lit(0))).alias("w"), F.greatest("b", F.col("_b") + F.col("w")).alias("b")), "jumps")
        discard(jumps)
        jumps, before = new, still


def _contracted(waits: DataFrame, base: DataFrame, ends: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``waits`` and ``base`` after following chains to their ends and taking the levels of calls that wait no more."""
    several = waits.join(ends.select(*KEY), KEY, "left_anti")
    via = ends.where("not round").select("conv_id", F.col("call_id").alias("need"), F.col("to").alias("_to"), F.col("w").alias("_w"), F.col("b").alias("_b"))
    hop = several.join(via, ["conv_id", "need"], "left").select(*KEY, F.coalesce("_to", "need").alias("need"), (F.col("w") + F.coalesce("_w", F.lit(0))).alias("w"), (F.col("_b") + F.col("w")).alias("b"))
    step = materialize(hop.unionByName(ends.select(*KEY, F.col("to").alias("need"), "w", "b")), "steps")
    done = base.join(waits.select(*KEY).distinct(), KEY, "left_anti").select("conv_id", F.col("call_id").alias("need"), F.col("b").alias("_level"))
    met = step.join(done, ["conv_id", "need"], "left")
    new_base = base.unionByName(met.select(*KEY, F.greatest("b", F.col("_level") + F.col("w")).alias("b")).where("b is not null")).groupBy(*KEY).agg(F.max("b").alias("b"))
    new_waits = met.where("_level is null").groupBy(*KEY, "need").agg(F.max("w").alias("w"))
    return materialize(new_waits, "waits"), materialize(new_base, "base")


def positions(ordered: DataFrame) -> DataFrame:
    """(conv_id, call_id, position) by (level, seq, call_id), from 0 in each conversation; ``ordered`` has one row for each call."""
    rows = ordered.select(*KEY, "seq", F.coalesce("level", F.lit(LAST)).alias("_l"), F.expr(f"seq div {RANGE}").alias("_b"))
    sizes = rows.groupBy("conv_id", "_l", "_b").agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.partitionBy("conv_id").orderBy("_l", "_b").rowsBetween(Window.unboundedPreceding, 0)) - F.col("_n")
    starts = sizes.select("conv_id", "_l", "_b", before.alias("_start"))
    rank = F.row_number().over(Window.partitionBy("conv_id", "_l", "_b").orderBy("seq", "call_id")) - 1
    return rows.withColumn("_r", rank).join(starts, ["conv_id", "_l", "_b"]).select(*KEY, (F.col("_start") + F.col("_r")).alias("position"))


def validated(calls: DataFrame, tools: DataFrame) -> DataFrame:
    """``calls`` with ``_v`` (arguments as a variant) and ``errors`` (sorted, joined by commas; empty: valid)."""
    tools = F.broadcast(tools) if tools.count() <= MAX_SENT_SCHEMAS else tools
    parsed = calls.withColumn("_v", F.expr("try_parse_json(arguments)")).withColumn("_m", F.expr("try_cast(_v as map<string, variant>)")).join(tools.withColumnRenamed("params", "_p"), "name", "left")
    # arguments by name, and those of objects among them as "object.parameter"
    inner = "transform(map_entries(try_cast(e.value as map<string, variant>)), c -> struct(concat(e.key, '.', c.key) as key, c.value as value))"
    parsed = parsed.withColumn("_n", F.expr(f"map_from_entries(flatten(transform(map_entries(_m), e -> coalesce({inner}, array()))))")).withColumn("_o", F.expr("transform(_p, p -> p.param)"))
    found = "coalesce(_m[p.param], _n[p.param])"
    errors = F.expr(
        f"""case when _m is null then array('not_json') when _p is null then array('unknown_tool') else concat(
        transform(filter(_p, p -> p.required and {found} is null and (not p.param like '%.%' or map_contains_key(_m, split(p.param, '[.]')[0]))), p -> concat('missing:', p.param)),
        transform(filter(_p, p -> {found} is not null and not schema_of_variant({found}) rlike p.kind), p -> concat('type:', p.param)),
        transform(filter(_p, p -> {found} is not null and schema_of_variant({found}) rlike p.kind and p.allowed is not null and not array_contains(p.allowed, to_json({found}))), p -> concat('value:', p.param)),
        transform(filter(map_keys(_m), k -> not array_contains(_o, k) and not exists(_o, o -> startswith(o, concat(k, '.')))), k -> concat('unexpected:', k)),
        transform(filter(map_keys(_n), k -> not array_contains(_o, k) and exists(_o, o -> startswith(o, concat(split(k, '[.]')[0], '.')))), k -> concat('unexpected:', k))) end"""
    )
    return parsed.withColumn("errors", F.concat_ws(",", F.sort_array(errors))).drop("_m", "_p", "_n", "_o")


def link(calls: DataFrame, results: DataFrame, tools: DataFrame) -> DataFrame:
    """One row for each identified call, each orphan result, and each call or result without identifier.

    ``calls`` is (conv_id, call_id, seq, name, arguments, after), ``results`` (conv_id, call_id, seq,
    content). Columns: conv_id, call_id, name, status, level, position, errors, canonical.
    """
    calls = calls.select("conv_id", F.col("call_id").cast("string"), F.coalesce(F.col("seq").cast("long"), F.lit(0).cast("long")).alias("seq"), "name", "arguments", F.coalesce("after", F.array().cast("array<string>")).alias("after"))
    results = results.select("conv_id", F.col("call_id").cast("string"), F.coalesce(F.col("seq").cast("long"), F.lit(0).cast("long")).alias("seq"), "content")
    named = F.col("conv_id").isNotNull() & F.col("call_id").isNotNull()
    first = calls.where(named).groupBy(*KEY).agg(F.min(F.struct("seq", "name", "arguments", "after")).alias("c")).select(*KEY, "c.*")
    first = materialize(first, "calls")
    answer = results.where(named).groupBy(*KEY).agg(F.min(F.struct("seq", "content")).alias("r")).select(*KEY, F.col("r.content").alias("result"), F.lit(True).alias("_answered"))
    order = levels(first.select(*KEY, "after"))
    place = positions(first.select(*KEY, "seq").join(order, KEY))
    whole = validated(first, tools).withColumn("_called", F.lit(True)).join(order, KEY).join(place, KEY).join(answer, KEY, "full_outer")
    status = F.when(F.col("_called").isNull(), "orphan_result").when(F.col("_answered").isNull(), "missing_result").when(F.col("level").isNull(), "cycle").otherwise("ok")
    linked = whole.withColumn("status", status)
    none = {"status": F.lit("no_id"), "level": F.lit(None).cast("int"), "position": F.lit(None).cast("long")}
    lost = validated(calls.where(~named), tools).withColumns(none | {"result": F.lit(None).cast("string")})
    blank = {"name": F.lit(None).cast("string"), "arguments": F.lit(None).cast("string"), "errors": F.lit(None).cast("string"), "_v": F.expr("cast(null as variant)"), "result": F.col("content")}
    unheard = results.where(~named).withColumns(none | blank)
    return reduce(DataFrame.unionByName, [_serialised(x) for x in (linked, lost, unheard)])


def _serialised(rows: DataFrame) -> DataFrame:
    """With the canonical JSON of what is there: arguments, id, name and result."""
    args = F.when(F.col("errors").contains("not_json"), F.expr("cast(arguments as variant)")).otherwise(F.col("_v"))
    canonical = F.to_json(F.struct(args.alias("arguments"), F.col("call_id").alias("id"), F.col("name"), F.col("result")))
    return rows.select(*KEY, "name", "status", "level", "position", "errors", canonical.alias("canonical"))


def conversation_calls(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Calls and results read out of ``conversations``: what isn't an assistant's turn calls, what is answers.

    By the conversation's number some arguments are damaged, some results misnamed and some calls
    wait in a cycle, so that every status occurs.
    """
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    quoted = F.expr("substring(to_json(named_struct('q', text)), 6, length(to_json(named_struct('q', text))) - 6)")
    arguments = (
        F.when(F.expr("conv_id % 17 = 5"), F.lit('{"query": '))
        .when(F.expr("conv_id % 11 = 3"), F.lit('{"top": 5}'))
        .when(F.expr("conv_id % 13 = 4"), F.concat(F.lit('{"top": "5", "query": '), quoted, F.lit("}")))
        .when(F.expr("conv_id % 19 = 6"), F.concat(F.lit('{"top": 5,  "lang": "xx", "query": '), quoted, F.lit("}")))
        .otherwise(F.concat(F.lit('{ "top": 5, "query": '), quoted, F.lit(" }")))
    )
    name = F.expr("case when role = 'user' then 'search' when conv_id % 7 = 0 then 'reset' else 'configure' end")
    after = F.expr("case when conv_id % 23 = 7 and turn = 0 then array('t2') when turn >= 2 and (turn div 2) % 3 <> 0 then array(concat('t', turn - 2)) else array() end")
    calls = turns.where("role <> 'assistant'").select("conv_id", F.expr("concat('t', turn)").alias("call_id"), F.col("turn").alias("seq"), name.alias("name"), arguments.alias("arguments"), after.alias("after"))
    results = turns.where("role = 'assistant'").select("conv_id", F.expr("case when conv_id % 29 = 8 then concat('x', turn) else concat('t', turn - 1) end").alias("call_id"), F.col("turn").alias("seq"), F.col("text").alias("content"))
    return calls, results


def op4_tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = link(*conversation_calls(spark, sf_dir), schemas(spark))
    return found.select("conv_id", "call_id", "name", "status", F.col("level").cast("long").alias("level"), F.col("position").cast("long").alias("position"), "errors", F.sha2("canonical", 256).alias("canonical_sha256"))


OP4_SQL = """WITH RECURSIVE a AS (SELECT *, to_json(text) AS q FROM conversations),
c0 AS (SELECT conv_id, 't' || turn AS call_id, turn AS seq, CASE WHEN role = 'user' THEN 'search' WHEN conv_id % 7 = 0 THEN 'reset' ELSE 'configure' END AS name,
 CASE WHEN conv_id % 17 = 5 THEN 0 WHEN conv_id % 11 = 3 THEN 1 WHEN conv_id % 13 = 4 THEN 2 WHEN conv_id % 19 = 6 THEN 3 ELSE 4 END AS k, q,
 CASE WHEN conv_id % 23 = 7 AND turn = 0 THEN 't2' WHEN turn >= 2 AND (turn // 2) % 3 <> 0 THEN 't' || (turn - 2) END AS need
 FROM a WHERE role <> 'assistant'),
c AS MATERIALIZED (SELECT * FROM c0 QUALIFY row_number() OVER (PARTITION BY conv_id, call_id ORDER BY seq, name, k, q) = 1),
r AS MATERIALIZED (SELECT conv_id, call_id, min_by(x, (turn, text)) AS x FROM (SELECT conv_id, CASE WHEN conv_id % 29 = 8 THEN 'x' || turn ELSE 't' || (turn - 1) END AS call_id, turn, text, q AS x FROM a WHERE role = 'assistant') GROUP BY ALL),
l(conv_id, call_id, level) AS (SELECT c.conv_id, c.call_id, 0 FROM c LEFT JOIN c d ON d.conv_id = c.conv_id AND d.call_id = c.need WHERE d.call_id IS NULL
 UNION ALL SELECT c.conv_id, c.call_id, l.level + 1 FROM l JOIN c ON c.conv_id = l.conv_id AND c.need = l.call_id),
p AS (SELECT c.*, l.level, row_number() OVER (PARTITION BY c.conv_id ORDER BY coalesce(l.level, 2147483647), c.seq, c.call_id) - 1 AS position FROM c LEFT JOIN l USING (conv_id, call_id)),
j AS (SELECT coalesce(p.conv_id, r.conv_id) AS conv_id, coalesce(p.call_id, r.call_id) AS call_id, p.name, p.k, p.q, p.level, p.position, r.x, p.call_id IS NOT NULL AS called, r.call_id IS NOT NULL AS answered FROM p FULL JOIN r ON r.conv_id = p.conv_id AND r.call_id = p.call_id)
SELECT conv_id, call_id, name, CASE WHEN NOT called THEN 'orphan_result' WHEN NOT answered THEN 'missing_result' WHEN level IS NULL THEN 'cycle' ELSE 'ok' END AS status, CAST(level AS BIGINT) AS level, position,
CASE WHEN NOT called THEN NULL WHEN k = 0 THEN 'not_json' WHEN name = 'reset' THEN 'unknown_tool' WHEN k = 1 THEN 'missing:query' WHEN k = 2 THEN 'type:top' WHEN k = 3 THEN 'unexpected:lang' ELSE '' END AS errors,
sha256('{' || CASE WHEN called THEN '"arguments":' || CASE k WHEN 0 THEN '"{\\"query\\": "' WHEN 1 THEN '{"top":5}' WHEN 2 THEN '{"query":' || q || ',"top":"5"}' WHEN 3 THEN '{"lang":"xx","query":' || q || ',"top":5}' ELSE '{"query":' || q || ',"top":5}' END || ',' ELSE '' END
 || '"id":"' || call_id || '"' || CASE WHEN called THEN ',"name":"' || name || '"' ELSE '' END || CASE WHEN answered THEN ',"result":' || x ELSE '' END || '}') AS canonical_sha256 FROM j"""
