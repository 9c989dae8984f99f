"""Inter-procedural taint from summaries of functions, composed at call sites to a fix point.

flows: fn, src_kind, src, dst_kind, dst, arg, mask. What enters a function is a ``param`` (src: its index), a ``source`` (src: its id,
unique in the program) or the ``result`` of a call (src: the call's id). It leaves as ``return`` (dst 0, arg 0), as ``arg`` of a call
(dst: the call, arg: the index) or into a ``sink`` (dst: the sink's id, arg: its kind, one bit). mask: the kinds neutralised on the way.
calls: call (unique), fn, callee.

A path leaves a kind alive if none of its flows neutralises that kind, so what is kept of all paths between two ends are the kinds that
some path leaves alive, as bits (live): one row, not a row for each mask.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import dropped, written
from .security import Levels

#: A place: a parameter (fn, index), the result of a call that goes on to all callers or not, and what a function returns of its own.
PARAM, RESULT, INNER, RETURNED = range(4)
PLACE = ["k", "a", "b"]
#: A round with up to so many new rows is broadcast to the moves instead of shuffling these.
SMALL_ROUND = 100_000


def _hinted(fresh: DataFrame, n: int) -> DataFrame:
    return F.broadcast(fresh) if n <= SMALL_ROUND else fresh


def _added(new: DataFrame, known: DataFrame, keys: list[str]) -> DataFrame:
    """keys, live: the kinds of new that known has not got for these keys."""
    none = F.lit(0).cast("int")
    both = new.select(*keys, F.col("live").alias("new"), none.alias("old")).unionByName(known.select(*keys, none.alias("new"), F.col("live").alias("old")))
    both = both.groupBy(*keys).agg(F.bit_or("new").alias("new"), F.bit_or("old").alias("old"))
    return both.select(*keys, F.expr("new & ~old").alias("live")).where("live <> 0")


def compose(into: DataFrame, back: DataFrame, most: int = 1000) -> DataFrame:
    """src_kind, fn, src, live: the kinds that get alive from a parameter, or from a call's result, to the return of its function.

    back: the flows into returns; into: the flows into arguments with their call and callee. What goes into an argument goes on as the
    call's result by the callee's summary of that parameter, so a call's way in and out belong together. Each round composes what
    has at least one new part, until nothing changes: however deep calls lie in each other.
    """
    keys = ["src_kind", "fn", "src"]
    fresh = written(_added(back, back.where("false"), keys), "summaries")
    known = Levels(fresh)

    def through(params: DataFrame, results: DataFrame) -> DataFrame:
        p = params.where("src_kind = 'param'").select(F.col("fn").alias("callee"), F.col("src").cast("int").alias("arg"), F.col("live").alias("by"))
        r = results.where("src_kind = 'result'").select(F.col("src").alias("call"), F.col("live").alias("out"))
        return into.join(p, ["callee", "arg"]).join(r, "call").select(*keys, F.expr("live & by & out").alias("live")).where("live <> 0")

    for r in range(most):
        rows = known.rows()
        kinds = {k["src_kind"]: k["count"] for k in fresh.groupBy("src_kind").count().collect()}
        if not kinds:
            return rows.groupBy(*keys).agg(F.bit_or("live").alias("live"))
        new = through(_hinted(fresh, sum(kinds.values())), rows)
        if r and "result" in kinds:
            new = new.unionByName(through(rows, _hinted(fresh, sum(kinds.values()))))
        fresh = written(_added(new, rows, keys), "summaries")
        known.add(fresh)
    raise RuntimeError(f"summaries did not settle in {most} rounds")


def _spread(first: DataFrame, moves: DataFrame, own: list[str], most: int) -> DataFrame:
    """own, place, live: where the first ones get over moves (k, a, b to k2, a2, b2) with which kinds alive; a round joins what is new."""
    keys = [*own, *PLACE]
    fresh = written(_added(first, first.where("false"), keys), "states")
    known = Levels(fresh)
    for _ in range(most):
        n = fresh.count()
        if not n:
            return known.rows().groupBy(*keys).agg(F.bit_or("live").alias("live"))
        step = _hinted(fresh.withColumnRenamed("live", "had"), n).join(moves, PLACE).select(*own, *[F.col(f"{c}2").alias(c) for c in PLACE], F.expr("had & live").alias("live")).where("live <> 0")
        fresh = written(_added(step, known.rows(), keys), "states")
        known.add(fresh)
    raise RuntimeError(f"taint did not settle in {most} rounds")


def findings(flows: DataFrame, calls: DataFrame, most: int = 1000) -> DataFrame:
    """source, fn, sink, kind: sinks that a source reaches, in its function or by calls and returns, with that kind not neutralised.

    A tainted argument goes down into the callee, and over the callee's summary to the call's result; what a function returns of its own
    source goes up to all its callers. Places from which no sink can be reached are found first, backwards and without sources, and no source is followed there.
    """
    name = "bigint" if flows.schema["fn"].dataType == flows.schema["dst"].dataType else "string"
    f = written(flows.select("fn", "src_kind", "src", "dst_kind", "dst", "arg", "mask"), "flows")
    kinds = f.where("dst_kind = 'sink'").agg(F.bit_or("arg")).first()[0] or 0
    f = f.select("fn", "src_kind", "src", "dst_kind", "dst", "arg", F.expr(f"cast(~mask & {kinds} as int)").alias("live")).where("live <> 0")
    calls = written(calls.select("call", "fn", "callee").distinct(), "calls")
    into = f.where("dst_kind = 'arg'").select("fn", "src_kind", "src", F.col("dst").alias("call"), F.col("arg").cast("int").alias("arg"), "live").join(calls.select("call", "callee"), "call")
    into = written(into.select("fn", "src_kind", "src", "call", "callee", "arg", "live"), "into")
    back = f.where("dst_kind = 'return'")
    goes_on = f.where("src_kind = 'result' and dst_kind <> 'sink'").select(F.col("src").alias("call")).distinct()
    whole = written(compose(into.where("src_kind <> 'source'").join(goes_on, "call", "left_semi"), back.where("src_kind <> 'source'"), most), "whole")
    summary = whole.where("src_kind = 'param'").select(F.col("fn").alias("callee"), F.col("src").cast("int").alias("arg"), F.col("live").alias("by"))
    into, last = written(into.join(summary, ["callee", "arg"], "left").withColumn("by", F.expr("live & coalesce(by, 0)")), "used"), into
    dropped(last)

    def at(k: int, a: str, b: str | None = None, end: str = "") -> list[Column]:
        return [F.lit(k).alias(f"k{end}"), F.col(a).cast(name).alias(f"a{end}"), (F.col(b) if b else F.lit(0)).cast("int").alias(f"b{end}")]

    def moves(rows: DataFrame, start: list, end: list, live: str = "live") -> DataFrame:
        return rows.select(*start, *end, F.expr(live).cast("int").alias("live")).where("live <> 0")

    param, result = into.where("src_kind = 'param'"), into.where("src_kind = 'result'")
    callee = at(PARAM, "callee", "arg", "2")
    every = moves(param, at(PARAM, "fn", "src"), callee).unionByName(moves(param, at(PARAM, "fn", "src"), at(INNER, "call", end="2"), "by"))
    for k in (RESULT, INNER):
        every = every.unionByName(moves(result, at(k, "src"), callee)).unionByName(moves(result, at(k, "src"), at(k, "call", end="2"), "by"))
    every = every.unionByName(moves(back.where("src_kind = 'result'"), at(RESULT, "src"), at(RETURNED, "fn", end="2")))
    every = written(every.unionByName(moves(calls, at(RETURNED, "callee"), at(RESULT, "call", end="2"), str(kinds))), "moves")

    ends = f.where("dst_kind = 'sink'").select("fn", "src_kind", "src", F.col("dst").alias("sink"), F.col("arg").alias("kind"), F.expr("live & arg").alias("live")).where("live <> 0")
    sinks = None
    for k, kind in ((PARAM, "param"), (RESULT, "result"), (INNER, "result")):
        part = ends.where(F.col("src_kind") == kind).select(*(at(k, "fn", "src") if k == PARAM else at(k, "src")), "fn", "sink", "kind", "live")
        sinks = part if sinks is None else sinks.unionByName(part)
    turned = every.select(*[F.col(f"{c}2").alias(c) for c in PLACE], *[F.col(c).alias(f"{c}2") for c in PLACE], "live")
    useful = written(_spread(sinks.select(*PLACE, "live"), turned, [], most), "useful")
    onward = useful.select(*[F.col(c).alias(f"{c}2") for c in PLACE], F.col("live").alias("worth"))
    every, last = written(every.join(onward, [f"{c}2" for c in PLACE]).select(*PLACE, *[f"{c}2" for c in PLACE], F.expr("live & worth").alias("live")).where("live <> 0"), "moves"), every
    dropped(last)

    origin = F.col("src").alias("origin")
    source = into.where("src_kind = 'source'")
    seeds = moves(source, [origin], at(PARAM, "callee", "arg")).unionByName(moves(source, [origin], at(RESULT, "call"), "by"))
    seeds = seeds.unionByName(moves(back.where("src_kind = 'source'"), [origin], at(RETURNED, "fn")))
    seeds = seeds.join(useful.withColumnRenamed("live", "worth"), PLACE).select("origin", *PLACE, F.expr("live & worth").alias("live")).where("live <> 0")
    states = _spread(seeds, every, ["origin"], most)
    far = states.withColumnRenamed("live", "had").join(sinks, PLACE).where("had & live <> 0").select(F.col("origin").alias("source"), "fn", "sink", "kind")
    near = ends.where("src_kind = 'source'").select(F.col("src").alias("source"), "fn", "sink", "kind")
    return far.unionByName(near).distinct()
