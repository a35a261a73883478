"""Path probes on large directed graphs: is there a way from one vertex to another, for very many pairs?

The graph is condensed to its strong components first. Each component then gets labels: ranges of random numbers over all
it reaches and over all that reach it. What reaches something has ranges that enclose the other's, so most probes
without a path are refused by their labels alone. A few components with the most links are hubs, whose reach is
known in full; a way through one of them settles most probes that have a path. Only what neither settles is searched
for, step by step from its start, and a step is not taken where the labels say that the goal lies elsewhere.

Each round is a written table whose size is that of what changed, not of all pairs; vertices may have ids of any type.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.sources.store import Stored, small, store

SEEDS = 3
"""Random numbers of a component; each gives two ranges."""
HUBS = 8


def _spread(links: DataFrame, start: DataFrame, keys: list[str], lows: list[str], highs: list[str]) -> DataFrame:
    """``start(*keys, v, values)`` with the least of ``lows`` and the greatest of ``highs`` of all that leads to ``v`` along ``links(u, v)``.

    Only vertices whose values moved in the last round hand them on.
    """
    values = [*lows, *highs]
    best = [*[F.min(c).alias(c) for c in lows], *[F.max(c).alias(c) for c in highs]]
    state = store(start.select(*keys, "v", *values).groupBy(*keys, "v").agg(*best).withColumn("_moved", F.lit(True)), "spread", moved=F.count_if("_moved"))
    while state.seen["moved"]:
        front = small(int(state.seen["moved"]), state.df.filter("_moved").select(*keys, F.col("v").alias("u"), *values))
        came = links.join(front, "u").groupBy(*keys, "v").agg(*best).withColumn("_old", F.lit(False))
        both = state.df.drop("_moved").withColumn("_old", F.lit(True)).unionByName(came)
        was = [F.max(F.when(F.col("_old"), F.col(c))).alias(f"_{c}") for c in values]
        after = both.groupBy(*keys, "v").agg(*best, *was)
        same = F.lit(True)
        for c in values:
            same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
        before, state = state, store(after.select(*keys, "v", *values, (~same).alias("_moved")), "spread", moved=F.count_if("_moved"))
        before.drop()
    return state.df.drop("_moved")


def _trimmed(links: Stored) -> Stored:
    """The links between vertices that have a way in and a way out; others are no part of a cycle."""
    while links.rows:
        ends = links.df.select("u").distinct().join(links.df.select(F.col("v").alias("u")).distinct(), "u", "left_semi")
        ends = store(ends, "ends")
        inner = small(ends.rows, ends.df)
        left = store(links.df.join(inner, "u", "left_semi").join(inner.withColumnRenamed("u", "v"), "v", "left_semi").select("u", "v"), "trim")
        before, links = links, left
        if left.rows == before.rows:
            break
    return links


def strong_components(edges: DataFrame) -> DataFrame:
    """``(id, comp)`` for every vertex of ``edges(u, v)``: the least vertex of its strong component.

    What lies on no cycle is trimmed off. Of the rest, every vertex takes the least vertex that reaches it, and
    those that also reach that one back are a component; the others go on without them. Rows with a null end
    are no edges.
    """
    slim = store(edges.select("u", "v").filter("u IS NOT NULL AND v IS NOT NULL").distinct(), "links")
    vertices = slim.df.select(F.col("u").alias("id")).unionByName(slim.df.select(F.col("v").alias("id"))).distinct()
    found: DataFrame | None = None
    left = _trimmed(store(slim.df.filter("u <> v"), "left"))
    while left.rows:
        ids = left.df.select(F.col("u").alias("v")).unionByName(left.df.select("v")).distinct()
        first = store(_spread(left.df, ids.withColumn("c", F.col("v")), [], ["c"], []), "first").df
        # back along links inside one colour, from the vertex that gave it its name
        of_u, of_v = first.select(F.col("v").alias("u"), F.col("c").alias("cu")), first.select("v", F.col("c").alias("cv"))
        inside = store(left.df.join(of_u, "u").join(of_v, "v").filter("cu = cv").select(F.col("v").alias("u"), F.col("u").alias("v")), "inside").df
        back = _spread(inside, first.filter("v = c"), [], ["c"], [])
        done = store(back.select(F.col("v").alias("id"), F.col("c").alias("comp")), "components")
        found = done.df if found is None else found.unionByName(done.df)
        gone = small(done.rows, done.df.select("id"))
        rest = left.df.join(gone.withColumnRenamed("id", "u"), "u", "left_anti").join(gone.withColumnRenamed("id", "v"), "v", "left_anti")
        left = _trimmed(store(rest.select("u", "v"), "left"))
    if found is None:
        return vertices.withColumn("comp", F.col("id"))
    return vertices.join(found, "id", "left").withColumn("comp", F.coalesce("comp", "id"))


def _labels(links: DataFrame, ids: DataFrame, side: str) -> DataFrame:
    """Ranges of each vertex's random numbers over all that reaches it along ``links``, itself included."""
    lows, highs = [f"{side}l{k}" for k in range(SEEDS)], [f"{side}h{k}" for k in range(SEEDS)]
    own = {c: F.xxhash64("v", F.lit(k)) for names in (lows, highs) for k, c in enumerate(names)}
    return _spread(links, ids.select(F.col("id").alias("v")).withColumns(own), [], lows, highs).withColumnRenamed("v", "id")


def _may_reach(start: str, goal: str) -> Column:
    """Whether the labels leave a way open: what the start reaches encloses what the goal reaches, and the other way round."""
    out = F.lit(True)
    for k in range(SEEDS):
        for side, outer, inner in (("d", start, goal), ("a", goal, start)):
            out = out & (F.col(f"{outer}.{side}l{k}") <= F.col(f"{inner}.{side}l{k}")) & (F.col(f"{outer}.{side}h{k}") >= F.col(f"{inner}.{side}h{k}"))
    return out


def connected(edges: DataFrame, probes: DataFrame, start: str, goal: str) -> DataFrame:
    """``probes`` with ``found``: does a way lead from the row's ``start`` to its ``goal``?

    A vertex reaches itself, known to ``edges`` or not; a null reaches nothing. Repeated probes are answered alike.
    """
    comp = store(strong_components(edges), "comp").df
    ends = comp.select(F.col("id").alias("u"), F.col("comp").alias("cu")), comp.select(F.col("id").alias("v"), F.col("comp").alias("cv"))
    links = store(edges.select("u", "v").join(ends[0], "u").join(ends[1], "v").filter("cu <> cv")
                  .select(F.col("cu").alias("u"), F.col("cv").alias("v")).distinct(), "dag").df
    back = links.select(F.col("v").alias("u"), F.col("u").alias("v"))
    ids = comp.select(F.col("comp").alias("id")).distinct()
    label = F.struct(*[f"{s}{x}{k}" for s in "da" for x in "lh" for k in range(SEEDS)])
    labels = store(_labels(back, ids, "d").join(_labels(links, ids, "a"), "id").select("id", label.alias("label")), "labels").df

    pairs = probes.select(F.col(start).alias("s"), F.col(goal).alias("g")).filter("s IS NOT NULL AND g IS NOT NULL AND s <> g").distinct()
    by_comp = pairs.join(comp.select(F.col("id").alias("s"), F.col("comp").alias("cs")), "s").join(
        comp.select(F.col("id").alias("g"), F.col("comp").alias("cg")), "g")
    by_comp = store(by_comp, "pairs").df
    asked = by_comp.filter("cs <> cg").select("cs", "cg").distinct()
    asked = asked.join(labels.select(F.col("id").alias("cs"), F.col("label").alias("sl")), "cs").join(
        labels.select(F.col("id").alias("cg"), F.col("label").alias("gl")), "cg").filter(_may_reach("sl", "gl"))
    asked = store(asked, "asked")

    # hubs: the components with the most links, and all they reach and are reached by
    degree = links.select("u").unionByName(links.select(F.col("v").alias("u"))).groupBy("u").agg(F.count(F.lit(1)).alias("n"))
    hubs = store(degree.orderBy(F.desc("n"), "u").limit(HUBS).select(F.col("u").alias("hub"), F.col("u").alias("v"), F.lit(0).alias("z")), "hubs").df
    ahead = _spread(links, hubs, ["hub"], ["z"], []).groupBy(F.col("v").alias("cg")).agg(F.collect_set("hub").alias("from"))
    behind = _spread(back, hubs, ["hub"], ["z"], []).groupBy(F.col("v").alias("cs")).agg(F.collect_set("hub").alias("to"))
    settled = asked.df.join(ahead, "cg", "left").join(behind, "cs", "left")
    through = F.coalesce(F.arrays_overlap("from", "to"), F.lit(False))
    # a hub is among what it reaches, so either end tells whether it is one
    at_hub = F.coalesce(F.array_contains("from", F.col("cg")), F.lit(False)) | F.coalesce(F.array_contains("to", F.col("cs")), F.lit(False))
    settled = store(settled.select("cs", "cg", "gl", through.alias("found"), (through | at_hub).alias("known")), "settled")
    yes = [settled.df.filter("found").select("cs", "cg")]

    # search for what is left, each probe from its start
    seen = store(settled.df.filter("NOT known").select("cs", "cg", F.col("cs").alias("x")), "search")
    goals = settled.df.filter("NOT known").select("cs", "cg", "gl")
    front = seen
    while front.rows:
        step = links.join(small(front.rows, front.df.withColumnRenamed("x", "u")), "u").select("cs", "cg", F.col("v").alias("x")).distinct()
        step = step.join(labels.select(F.col("id").alias("x"), F.col("label").alias("xl")), "x").join(goals, ["cs", "cg"]).filter(_may_reach("xl", "gl"))
        fresh = store(step.select("cs", "cg", "x").join(seen.df, ["cs", "cg", "x"], "left_anti"), "step")
        hit = store(fresh.df.filter("x = cg").select("cs", "cg"), "hit")
        yes.append(hit.df)
        seen = store(seen.df.unionByName(fresh.df), "search")
        front = store(fresh.df.join(small(hit.rows, hit.df), ["cs", "cg"], "left_anti"), "front")
    hits = yes[0]
    for more in yes[1:]:
        hits = hits.unionByName(more)
    there = by_comp.join(hits.withColumn("_hit", F.lit(True)), ["cs", "cg"], "left").filter("_hit OR cs = cg")
    answers = there.select(F.col("s").alias("_s"), F.col("g").alias("_g"), F.lit(True).alias("_found"))
    out = probes.join(answers, (F.col(start) == F.col("_s")) & (F.col(goal) == F.col("_g")), "left")
    same = F.coalesce(F.col(start) == F.col(goal), F.lit(False))
    return out.withColumn("found", F.coalesce("_found", same)).drop("_s", "_g", "_found")
