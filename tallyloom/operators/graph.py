"""Graph operators over edge tables ``(u, v, w)`` and successor tables ``(id, succ)``.

Every loop writes its state once per round, reads its stop condition from that write, and works on
all sources, components or chains at the same time. The frontier is broadcast only when its observed
row count is small.
"""

from __future__ import annotations

from functools import reduce
from math import ceil, log2

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.sources.store import BROADCAST_ROWS, Stored, dealt, small, store


SPLICED = BROADCAST_ROWS
"""Edges of chains from which on pointers are doubled, over a table that every executor holds."""
MOST_TABLES = 32
"""Tables of settled rows that are kept apart before they are written as one."""


def _slim(edges: DataFrame, size: int = 0) -> Stored:
    """One row per (u, v) with the smallest weight; ``size``, where known, says how many edges there are at most."""
    return store(dealt(edges, size, "u", "v").groupBy("u", "v").agg(F.min("w").alias("w")), "edges")


def or_infinity(distance: Column) -> Column:
    """Unreachable as infinity instead of NULL."""
    return F.coalesce(distance.cast("double"), F.lit(float("inf")))


# --- reachability and distances ------------------------------------------------------------------

def _stepped(edges: Stored, front: DataFrame, rows: int) -> DataFrame:
    """Edges that leave the front; a large front meets them in tasks of bounded rows."""
    links = edges.df if rows <= BROADCAST_ROWS else dealt(edges.df, edges.rows, "u")
    return links.join(small(rows, front), "u")


def _relax(edges: Stored, start: DataFrame, keys: list[str], value: str,
           step: Column, rounds: int | None, keep: Column | None = None) -> DataFrame:
    """Propagate ``value`` (the smallest wins) from ``start(keys, v, value)`` along the edges.

    The state holds the round in which a row last improved; only those rows move on. With a bound on
    the rounds, improvements beyond it mean that the values fall forever.
    """
    changed = F.count_if(F.col("_r") == F.col("_now"))
    state = store(start.select(*keys, "v", value).withColumns({"_r": F.lit(0), "_now": F.lit(0)}),
                  "relax", changed=changed)
    now = 0
    while state.seen["changed"]:
        now += 1
        if rounds is not None and now > rounds:
            raise ValueError("negative cycle: distances still improve after V - 1 rounds")
        front = state.df.filter(F.col("_r") == now - 1)
        if keep is not None:
            front = front.filter(keep)
        front = front.withColumnRenamed("v", "u").drop("_r", "_now")
        moved = (
            _stepped(edges, front, int(state.seen["changed"])).select(*keys, "v", step.alias(value))
            .groupBy(*keys, "v").agg(F.min(value).alias(value)).withColumn("_r", F.lit(now))
        )
        merged = (
            state.df.drop("_now").unionByName(moved).groupBy(*keys, "v")
            .agg(F.min(F.struct(value, "_r")).alias("_best"))
            .select(*keys, "v", f"_best.{value}", "_best._r").withColumn("_now", F.lit(now))
        )
        before, state = state, store(merged, "relax", changed=changed)
        before.drop()
    return state.df.select(*keys, "v", value)


def reachable(edges: DataFrame, sources: DataFrame) -> DataFrame:
    """``(source, target, hops)`` for everything each source reaches, itself included (0 hops)."""
    links = store(edges.select("u", "v").distinct(), "links")
    start = sources.select(F.col("source"), F.col("source").alias("v"), F.lit(0).cast("bigint").alias("hops"))
    found = _relax(links, start.distinct(), ["source"], "hops", F.col("hops") + 1, None)
    return found.withColumnRenamed("v", "target")


def path_exists(edges: DataFrame, probes: DataFrame, start: str, goal: str) -> DataFrame:
    """Add ``found``: is there a path from the row's start to its goal? A vertex reaches itself."""
    sources = probes.select(F.col(start).alias("source")).distinct()
    hits = reachable(edges, sources).select(
        F.col("source").alias(start), F.col("target").alias(goal), F.lit(True).alias("found"))
    return probes.join(hits, [start, goal], "left").withColumn("found", F.coalesce("found", F.lit(False)))


def shortest_from(edges: DataFrame, source: Column | int, max_rounds: int | None = None, size: int = 0) -> DataFrame:
    """``(v, dist)`` for every vertex; NULL where unreachable. Negative edges are fine, negative cycles raise."""
    slim = _slim(edges, size)
    vertices = store(
        slim.df.select(F.col("u").alias("v")).unionByName(slim.df.select("v")).distinct(), "vertices")
    kind = slim.df.schema["w"].dataType
    first = source if isinstance(source, Column) else F.lit(source)
    start = vertices.df.sparkSession.range(1).select(
        first.cast(vertices.df.schema["v"].dataType).alias("v"), F.lit(0).cast(kind).alias("dist"))
    found = _relax(slim, start, [], "dist", F.col("dist") + F.col("w"), max_rounds or max(vertices.rows, 1))
    everyone = vertices.df.unionByName(start.select("v")).distinct()
    return everyone.join(found, "v", "left")


def shortest_pair(edges: DataFrame, source, goal, size: int = 0) -> DataFrame:
    """One row ``(source, goal, dist)`` for positive lengths; NULL if unreachable. Ids may be of any type.

    Vertices at or beyond the best length known for the goal are not expanded.
    """
    slim = _slim(edges, size)
    kind = slim.df.schema["w"].dataType
    spark = edges.sparkSession
    same = F.col("source") == F.col("goal")
    node = slim.df.schema["v"].dataType
    ends = spark.range(1).select(F.lit(source).cast(node).alias("source"), F.lit(goal).cast(node).alias("goal"))
    state = store(ends.select(F.col("source").alias("v"), F.lit(0).cast(kind).alias("dist"),
                              F.lit(0).alias("_r"), F.lit(0).alias("_now")),
                  "pair", open=F.count(F.lit(1)), best=F.min(F.when(F.col("v") == goal, F.col("dist"))))
    now = 0
    while state.seen["open"]:
        now += 1
        front = state.df.filter(F.col("_r") == now - 1)
        if state.seen.get("best") is not None:
            front = front.filter(F.col("dist") < F.lit(state.seen["best"]))
        front = front.select(F.col("v").alias("u"), "dist")
        moved = (
            _stepped(slim, front, int(state.seen["open"])).select("v", (F.col("dist") + F.col("w")).alias("dist"))
            .groupBy("v").agg(F.min("dist").alias("dist")).withColumn("_r", F.lit(now))
        )
        merged = (
            state.df.drop("_now").unionByName(moved).groupBy("v")
            .agg(F.min(F.struct("dist", "_r")).alias("_b")).select("v", "_b.dist", "_b._r")
            .withColumn("_now", F.lit(now))
        )
        before, state = state, store(
            merged, "pair", open=F.count_if(F.col("_r") == F.col("_now")),
            best=F.min(F.when(F.col("v") == goal, F.col("dist"))))
        before.drop()
    hit = state.df.filter(F.col("v") == goal).select(F.col("v").alias("goal"), "dist")
    return ends.join(hit, "goal", "left").select(
        "source", "goal", F.when(same, F.lit(0).cast(kind)).otherwise(F.col("dist")).alias("dist"))


def all_pairs(edges: DataFrame) -> DataFrame:
    """``(u, v, dist)`` for every reachable pair, by doubling the number of edges per round.

    A vertex is 0 from itself unless a negative self-edge says otherwise.
    """
    slim = _slim(edges)
    vertices = slim.df.select(F.col("u").alias("x")).unionByName(slim.df.select(F.col("v").alias("x"))).distinct()
    own = vertices.select(F.col("x").alias("u"), F.col("x").alias("v"),
                          F.lit(0).cast(slim.df.schema["w"].dataType).alias("w"))
    start = slim.df.unionByName(own).groupBy("u", "v").agg(F.min("w").alias("dist"))
    state = store(start, "pairs", total=F.sum("dist"), loops=F.count_if(F.col("u") == F.col("v")))
    for _ in range(ceil(log2(max(state.seen["loops"], 2))) + 2):
        second = state.df.select(F.col("u").alias("_mid"), F.col("v").alias("_end"), F.col("dist").alias("_more"))
        longer = (
            state.df.join(second, F.col("v") == F.col("_mid"))
            .groupBy("u", F.col("_end").alias("v")).agg(F.min(F.col("dist") + F.col("_more")).alias("dist"))
        )
        before, state = state, store(longer, "pairs", total=F.sum("dist"))
        done = before.rows == state.rows and before.seen["total"] == state.seen["total"]
        before.drop()
        if done:
            return state.df
    raise ValueError("negative cycle: distances still improve")


# --- order and trees -----------------------------------------------------------------------------

def _spliced(marked: DataFrame) -> tuple[Stored, list[DataFrame], list[Stored]]:
    """Edges ``(u, v, n, ui, vi)`` with most inner vertices taken out: the open ones, finished ones, and rounds ``(id, head, n)``.

    A round takes out each inner vertex that tosses heads behind one that does not: no two neighbours, about a
    quarter of all. Both edges of such a vertex meet in one shuffle and become one, so all rounds together move a few
    times the edges. Open edges have an inner end. They end as few, or as cycles that lose no vertex any more.
    """
    is_open = F.col("ui") | F.col("vi")
    state = store(marked, "splice", open=F.count_if(is_open))
    finished, rounds = [state.df.filter(~is_open)], []
    while state.seen["open"] > SPLICED:
        def may_go(v: str) -> Column:
            return F.col(f"{v}i") & (F.pmod(F.xxhash64(v, F.lit(len(rounds))), F.lit(2)) == 1)

        at = state.df.filter(is_open)
        into = at.filter(may_go("v") & ~may_go("u")).select(F.col("v").alias("id"), F.col("u").alias("a"), F.col("n").alias("na"), F.col("ui").alias("ai"))
        off = at.filter(may_go("u")).select(F.col("u").alias("id"), F.col("v").alias("b"), F.col("n").alias("nb"), F.col("vi").alias("bi"))
        gone = F.col("a").isNotNull() & F.col("b").isNotNull()
        met = into.join(off, "id", "full").select(
            F.coalesce("a", "id").alias("u"), F.coalesce("b", "id").alias("v"),
            (F.coalesce("na", F.lit(0)) + F.coalesce("nb", F.lit(0))).alias("n"),
            F.coalesce("ai", F.lit(True)).alias("ui"), F.coalesce("bi", F.lit(True)).alias("vi"),
            F.when(gone, F.col("id")).alias("id"), F.when(gone, F.col("a")).alias("head"), F.when(gone, F.col("na")).alias("m"))
        rest = at.filter(~may_go("v") & ~may_go("u"))
        after = store(met.unionByName(rest, allowMissingColumns=True), "splice", open=F.count_if(is_open), gone=F.count("id"))
        edges = after.df.select("u", "v", "n", "ui", "vi")
        finished.append(edges.filter(~is_open))
        rounds.append(Stored(after.df.filter("id IS NOT NULL").select("id", "head", F.col("m").alias("n")), after.path, after.seen["gone"]))
        state = Stored(edges, after.path, after.rows, after.seen)
        if not after.seen["gone"]:
            break
    return Stored(state.df.filter(is_open), state.path, state.seen["open"]), finished, rounds


def _chain_heads(edges: Stored) -> list[Stored]:
    """Tables ``(id, head, n)``: the vertex ``n`` steps before ``id`` that starts its chain.

    ``edges(u, v, n, ui, vi)`` tell which ends have one edge in and one out. Pointers to predecessors are doubled; a row
    leaves the loop once it points to a vertex that is not inner. A round in which none leaves proves that
    only cycles are left, and those get no row.
    """
    ids = small(edges.rows, edges.df.filter("vi").select(F.col("v").alias("head"), F.lit(True).alias("_inner")))

    def split(rows: DataFrame) -> Stored:
        marked = rows.join(ids, "head", "left").select("id", "head", "n", F.col("_inner").isNull().alias("done"))
        return store(marked, "heads", open=F.count_if(~F.col("done")))

    state = split(edges.df.filter("vi").select(F.col("u").alias("head"), F.col("v").alias("id"), "n"))
    finished, before = [], None
    while True:
        if state.rows > state.seen["open"]:
            finished.append(state)
        if not state.seen["open"] or state.seen["open"] == before:
            return finished
        before = state.seen["open"]
        going = state.df.filter(~F.col("done")).drop("done")
        known = reduce(DataFrame.unionByName, [t.df.filter("done").drop("done") for t in finished], going)
        known = known.select(F.col("id").alias("head"), F.col("head").alias("_far"), F.col("n").alias("_more"))
        state = split(going.join(known, "head").select("id", F.col("_far").alias("head"), (F.col("n") + F.col("_more")).alias("n")))


def topological_levels(edges: DataFrame, vertices: DataFrame | None = None) -> DataFrame:
    """``(id, level)``: level 0 has no predecessor, every other vertex is one above its highest one.

    Vertices on a cycle or behind one get no row, and a NULL end is no vertex. Runs of vertices with one
    edge in and one out are first contracted to one edge with a length, by splicing while they are many and
    by pointer doubling then, so the rounds that follow count the branchings of the longest path and not its steps. Each of those rounds
    closes the edges sent out by the vertices settled last; settled vertices leave the loop.
    """
    links = store(edges.filter(F.col("u").isNotNull() & F.col("v").isNotNull()).select("u", "v").distinct(), "links").df
    ends = links.select(F.col("u").alias("id"), F.lit(0).alias("i"), F.lit(1).alias("o")).unionByName(
        links.select(F.col("v").alias("id"), F.lit(1).alias("i"), F.lit(0).alias("o")))
    if vertices is not None:
        alone = vertices.filter(F.col("id").isNotNull()).select("id", F.lit(0).alias("i"), F.lit(0).alias("o"))
        ends = ends.unionByName(alone)
    degrees = store(ends.groupBy("id").agg(F.sum("i").alias("i"), F.sum("o").alias("o")), "degrees").df
    is_inner = (F.col("i") == 1) & (F.col("o") == 1)
    inner = store(degrees.filter(is_inner).select("id"), "inner")
    of_u = inner.df.select(F.col("id").alias("u"), F.lit(True).alias("ui"))
    of_v = inner.df.select(F.col("id").alias("v"), F.lit(True).alias("vi"))
    one, no = F.lit(1).cast("bigint"), F.lit(False)
    marked = links.join(small(inner.rows, of_u), "u", "left").join(small(inner.rows, of_v), "v", "left").select(
        "u", "v", one.alias("n"), F.coalesce("ui", no).alias("ui"), F.coalesce("vi", no).alias("vi"))
    left, finished, rounds = _spliced(marked)
    chains = [t.df.filter("done").select("id", "head", "n") for t in _chain_heads(left)]
    runs = reduce(DataFrame.unionByName, chains) if chains else None

    joined = left.df.filter("NOT vi").select("u", "v", "n")
    if runs is not None:
        joined = joined.withColumnRenamed("n", "m").join(runs.withColumnRenamed("id", "u"), "u", "left").select(
            F.coalesce("head", "u").alias("u"), "v", (F.col("m") + F.coalesce("n", F.lit(0))).alias("n"))
    joined = reduce(DataFrame.unionByName, [joined, *[t.select("u", "v", "n") for t in finished]])
    short = store(joined.groupBy("u", "v").agg(F.max("n").alias("length")), "contracted").df

    incoming = short.groupBy(F.col("v").alias("id")).agg(F.count(F.lit(1)).alias("open"))
    start = degrees.filter(~is_inner).select("id").join(incoming, "id", "left").select(
        "id", F.coalesce("open", F.lit(0)).alias("open"), F.lit(0).cast("bigint").alias("level"))
    state = store(start, "topo", settled=F.count_if(F.col("open") == 0))
    settled = []
    while state.seen["settled"]:
        settled.append(state)
        front = state.df.filter(F.col("open") == 0).select(F.col("id").alias("u"), "level")
        closed = (
            short.join(small(int(state.seen["settled"]), front), "u").groupBy(F.col("v").alias("id"))
            .agg(F.count(F.lit(1)).alias("_closed"), F.max(F.col("level") + F.col("length")).alias("_level"))
        )
        advanced = state.df.filter(F.col("open") > 0).join(closed, "id", "left").select(
            "id", (F.col("open") - F.coalesce("_closed", F.lit(0))).alias("open"), F.greatest("level", "_level").alias("level"))
        state = store(advanced, "topo", settled=F.count_if(F.col("open") == 0))
        if len(settled) == MOST_TABLES:
            together = store(_settled(settled), "settled")
            for t in settled:
                t.drop()
            settled = [together]
    if not settled:
        return degrees.select("id", F.lit(0).cast("bigint").alias("level")).limit(0)
    levels = _settled(settled).select("id", "level")

    def behind(table: DataFrame) -> DataFrame:
        return table.join(levels.withColumnRenamed("id", "head"), "head").select("id", (F.col("level") + F.col("n")).alias("level"))

    if runs is not None:
        levels = levels.unionByName(behind(runs) if not rounds else store(behind(runs), "levels").df)
    for table in reversed(rounds):  # the head of a vertex that was taken out stayed longer than it
        levels = levels.unionByName(store(behind(table.df), "levels").df)
    return levels


def _settled(tables: list[Stored]) -> DataFrame:
    return reduce(DataFrame.unionByName, [t.df.filter(F.col("open") == 0) for t in tables])


def spanning_forest(edges: DataFrame) -> DataFrame:
    """Minimum spanning forest of undirected edges, as their ``(u, v, w)`` rows; ties by (w, u, v).

    Each round every component picks its smallest outgoing edge, components joined by picked edges
    collapse to one by pointer jumping, and the edges are relabelled and thinned to the smallest per
    pair of components.
    """
    pick = F.struct("w", "u", "v")
    linked = store(
        edges.filter(F.col("u") != F.col("v"))
        .select(F.least("u", "v").alias("a"), F.greatest("u", "v").alias("b"), "u", "v", "w")
        .groupBy("a", "b").agg(F.min(pick).alias("e")), "forest")
    chosen = None
    while linked.rows:
        ends = linked.df.select(F.col("a").alias("c"), F.col("b").alias("o"), "e").unionByName(
            linked.df.select(F.col("b").alias("c"), F.col("a").alias("o"), "e"))
        best = store(ends.groupBy("c").agg(F.min(F.struct("e", "o")).alias("m"))
                     .select("c", F.col("m.o").alias("p"), F.col("m.e").alias("e")), "best")
        picked = best.df.select("e.u", "e.v", "e.w").distinct()
        chosen = picked if chosen is None else chosen.unionByName(picked)
        # two components may pick each other: the smaller of the two becomes the root
        back = best.df.select(F.col("c").alias("p"), F.col("p").alias("pp"))
        hook = best.df.join(back, "p").select(
            "c", F.when((F.col("pp") == F.col("c")) & (F.col("c") < F.col("p")), F.col("c"))
            .otherwise(F.col("p")).alias("p"))
        roots = _jump_to_roots(store(hook, "hook"))
        by_a = roots.df.toDF("a", "ra")
        by_b = roots.df.toDF("b", "rb")
        relabelled = (
            linked.df.join(small(roots.rows, by_a), "a").join(small(roots.rows, by_b), "b")
            .filter(F.col("ra") != F.col("rb"))
            .select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b"), "e")
            .groupBy("a", "b").agg(F.min("e").alias("e"))
        )
        before, linked = linked, store(relabelled, "forest")
        before.drop()
        roots.drop()
    if chosen is None:
        return edges.select("u", "v", "w").limit(0)
    return chosen


def _jump_to_roots(parents: Stored) -> Stored:
    """Replace every parent by its parent until all point to a root (a row with p = c)."""
    while True:
        up = parents.df.select(F.col("c").alias("p"), F.col("p").alias("pp"))
        jumped = store(
            parents.df.join(small(parents.rows, up), "p")
            .select("c", F.col("pp").alias("p"), (F.col("pp") != F.col("p")).alias("moved")),
            "roots", moved=F.count_if("moved"))
        parents.drop()
        result = Stored(jumped.df.select("c", "p"), jumped.path, jumped.rows)
        if not jumped.seen["moved"]:
            return result
        parents = result


# --- successor chains ------------------------------------------------------------------------------

def cyclic(chain: DataFrame) -> DataFrame:
    """``(id, cyclic)``: does following ``succ`` from here never end?

    Pointers are doubled. Chains that end drop out; since a chain of length n passes through every
    smaller length, a round that loses no row proves that only endless ones are left.
    """
    ids = store(chain.select("id", "succ"), "chain")
    known = ids.df.select(F.col("id").alias("succ"))
    alive = store(ids.df.filter(F.col("succ").isNotNull()).join(known, "succ", "left_semi").select("id", "succ"), "jump")
    while alive.rows:
        ahead = alive.df.select(F.col("id").alias("succ"), F.col("succ").alias("far"))
        jumped = store(alive.df.join(small(alive.rows, ahead), "succ").select("id", F.col("far").alias("succ")), "jump")
        done = jumped.rows == alive.rows
        alive.drop()
        alive = jumped
        if done:
            break
    endless = alive.df.select("id", F.lit(True).alias("cyclic"))
    return ids.df.select("id").join(endless, "id", "left").withColumn("cyclic", F.coalesce("cyclic", F.lit(False)))


def reverse_chain(chain: DataFrame) -> DataFrame:
    """Successor table of the reversed chains: every row points to the row that pointed to it."""
    back = chain.filter(F.col("succ").isNotNull()).select(F.col("succ").alias("id"), F.col("id").alias("succ"))
    return chain.select("id").join(back, "id", "left")


def chain_ranks(chain: DataFrame) -> DataFrame:
    """``(id, tail, rank)``: the end of the row's chain and how many steps away it is.

    A ``succ`` that is not in the table ends the chain like a NULL, as in ``cyclic``. Doubling needs
    log2(longest chain) rounds; a cycle raises.
    """
    done_cond = F.col("nxt").isNull()
    known = chain.select(F.col("id").alias("succ"), F.lit(True).alias("_known"))
    chain = chain.select("id", "succ").join(known, "succ", "left")
    chain = chain.select("id", F.when(F.col("_known"), F.col("succ")).alias("succ"))
    state = store(
        chain.select("id", F.col("succ").alias("nxt"), F.coalesce("succ", "id").alias("tail"),
                     F.when(F.col("succ").isNull(), 0).otherwise(1).cast("bigint").alias("rank")),
        "ranks", open=F.count_if(~done_cond))
    rounds = ceil(log2(max(state.rows, 2))) + 1
    for _ in range(rounds):
        if not state.seen["open"]:
            return state.df.select("id", "tail", "rank")
        far = state.df.select(F.col("id").alias("nxt"), F.col("nxt").alias("_n"),
                              F.col("tail").alias("_t"), F.col("rank").alias("_r"))
        going = state.df.filter(~done_cond).join(small(state.rows, far), "nxt").select(
            "id", F.col("_n").alias("nxt"), F.col("_t").alias("tail"), (F.col("rank") + F.col("_r")).alias("rank"))
        before, state = state, store(
            state.df.filter(done_cond).unionByName(going), "ranks", open=F.count_if(~done_cond))
        before.drop()
    if state.seen["open"]:
        raise ValueError("the chain has a cycle")
    return state.df.select("id", "tail", "rank")
