"""Propagation over call, alias and module graphs, round by round."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import round_half_up
from ..storage import cut

# fixed values: the most that a caller may claim by the kind of its edge, in a cycle, and the least of a circular one that is reported
CAPS = {"call": 0.85, "member-call": 0.85, "return-identity": 0.88, "return-member": 0.88, "assign-alias": 0.92}
CYCLE, LEAST_CIRCULAR = 0.4, 0.45
DEEPEST = 64


def reachable(edges: DataFrame, seeds: DataFrame, depth: int) -> DataFrame:
    """(node, hops): what is reached from the seeds (node) along edges (src, dst) in at most ``depth`` hops.

    Only the frontier is joined in each round; the reached set meets it by an anti-join."""
    seen = cut(seeds.select("node").distinct().withColumn("hops", F.lit(0)))
    frontier = seen
    for hop in range(1, depth + 1):
        found = frontier.join(edges, frontier.node == edges.src).select(F.col("dst").alias("node")).distinct()
        frontier = cut(found.join(seen, "node", "left_anti").withColumn("hops", F.lit(hop)))
        if frontier.isEmpty():
            break
        seen = seen.union(frontier)
    return seen


def wrappers(edges: DataFrame, seeds: DataFrame, depth: int = DEEPEST) -> DataFrame:
    """(node, target, confidence, hops, kind, circular, chain): functions that lead to a seed (node, confidence), seeds included.

    Edges: caller, callee, confidence, and kind (call if there is no such column). A chain is as sure as its least sure
    edge, and no surer than its kinds allow; one that meets a function again is circular and counts for little. Of several chains of a
    function a clean one counts before a circular one, then the surest, then the shortest. Confidence only falls along a
    chain, so relaxing the best records round by round converges."""
    if "kind" not in edges.columns:
        edges = edges.withColumn("kind", F.lit("call"))
    cap = F.coalesce(*[F.when(F.col("e.kind") == k, v) for k, v in CAPS.items()], F.lit(CAPS["call"]))
    best = cut(seeds.select("node", F.col("node").alias("target"), "confidence", F.lit("seed").alias("kind"), F.lit(False).alias("circular"), F.array("node").alias("chain")))
    frontier = best
    better = lambda c, s, n: F.struct((~F.col(c)).alias("a"), F.col(s).alias("b"), (-F.size(n)).alias("c"))
    for _ in range(depth):
        met = frontier.alias("f").join(edges.alias("e"), F.col("f.node") == F.col("e.callee"))
        loop = F.array_contains("f.chain", F.col("e.caller"))
        kind = F.when(F.col("e.kind").isin("call", "member-call"), F.when(F.size("f.chain") > 1, "nested").otherwise("passthrough")).otherwise("return-alias")
        step = met.select(
            F.col("e.caller").alias("node"), "f.target", F.least("f.confidence", "e.confidence", F.when(loop, F.lit(CYCLE)).otherwise(cap)).alias("confidence"), kind.alias("kind"), loop.alias("circular"),
            F.when(loop, F.col("f.chain")).otherwise(F.concat(F.array("e.caller"), F.col("f.chain"))).alias("chain"),
        )
        top = F.max_by(F.struct("target", "confidence", "kind", "circular", "chain"), better("circular", "confidence", "chain")).alias("r")
        step = step.groupBy("node").agg(top).select("node", "r.*")
        known = best.select("node", F.col("confidence").alias("c0"), F.col("circular").alias("x0"), F.col("chain").alias("n0"))
        news = F.col("c0").isNull() | (better("circular", "confidence", "chain") > better("x0", "c0", "n0"))
        frontier = cut(step.join(known, "node", "left").where(news).drop("c0", "x0", "n0"))
        if frontier.isEmpty():
            break
        best = cut(best.join(frontier, "node", "left_anti").unionByName(frontier))
    kept = best.where(~(F.col("circular") & (F.col("confidence") < LEAST_CIRCULAR)))
    return kept.select("node", "target", round_half_up(F.col("confidence"), 2).alias("confidence"), (F.size("chain") - 1).alias("hops"), "kind", "circular", "chain")


def aliases(bindings: DataFrame) -> DataFrame:
    """(name, target, hops, circular): what each alias (name, target) stands for in the end; cycles have no target.

    Every round doubles the hops that each alias has gone, so the rounds are the logarithm of the longest chain; what is
    still on its way after as many hops as there are aliases runs in a cycle."""
    step = cut(bindings.select("name", "target", F.lit(1).cast("long").alias("hops")))
    names, hops = step.count(), 1
    done = None
    while True:
        ahead = step.select(F.col("name").alias("target"), F.col("target").alias("_next"), F.col("hops").alias("_hops"))
        if done is not None:
            ahead = ahead.union(done.select(F.col("name").alias("target"), F.col("target").alias("_next"), F.col("hops").alias("_hops")))
        walked = cut(step.join(ahead, "target", "left"))
        ended = walked.where("_next is null").select("name", "target", "hops")
        done = cut(ended if done is None else done.union(ended))
        on = walked.where("_next is not null").select("name", F.col("_next").alias("target"), (F.col("hops") + F.col("_hops")).alias("hops"))
        step, hops = cut(on), 2 * hops
        if step.isEmpty() or hops > 2 * names:
            break
    cycles = step.select("name", F.lit(None).cast("string").alias("target"), F.lit(names).cast("long").alias("hops"), F.lit(True).alias("circular"))
    return done.withColumn("circular", F.lit(False)).union(cycles).withColumn("hops", F.col("hops").cast("int"))


def resolve_calls(calls: DataFrame, found: DataFrame) -> DataFrame:
    """(call_id, target, confidence, chain) of calls (call_id, callee, confidence) that lead to a translation function through wrappers."""
    return calls.alias("c").join(found.alias("w"), F.col("c.callee") == F.col("w.node")).select(
        "c.call_id", "w.target", F.least("c.confidence", "w.confidence").alias("confidence"), F.array_join("w.chain", ">").alias("chain")
    )


def parameter_namespaces(calls: DataFrame, depth: int = DEEPEST) -> DataFrame:
    """(fn, namespaces): what a translator parameter of a function may be bound to, by all call sites and through nested ones.

    Calls: fn (the callee), ns (the namespace passed, or null), from_fn (the function whose own parameter is passed on, or null)."""
    direct = cut(calls.where("ns is not null").select("fn", "ns").distinct())
    nested = cut(calls.where("from_fn is not null").select("fn", "from_fn").distinct())
    known, frontier = direct, direct
    for _ in range(depth):
        more = frontier.withColumnRenamed("fn", "from_fn").join(nested, "from_fn").select("fn", "ns").distinct()
        frontier = cut(more.join(known, ["fn", "ns"], "left_anti"))
        if frontier.isEmpty():
            break
        known = cut(known.union(frontier))
    return known.groupBy("fn").agg(F.sort_array(F.collect_set("ns")).alias("namespaces"))
