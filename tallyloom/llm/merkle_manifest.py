"""Merkle manifest of a dataset: one proof per row, by rolling nested structs up along the digits of its rank.

Rows of a tree are ranked, and the rank is written in base ``fan``. The last ``LEVELS`` digits name a place in
a block, the rest names the block. A block is rolled up by grouping its digit columns away, the last one
first: each group nests its up to ``fan`` child structs, in order, below the hash of their hashes. All of it
happens in the partition that the block was sent to, sorted once, so a level costs no shuffle. A block is
then one struct of bounded size, whatever the tree, and its hash is a leaf of the next, ``fan**LEVELS`` times
smaller table; that repeats until a tree is one node.

Proofs go the other way. The nodes above a block and the block itself are brought together by a union and a
grouping on the block's number, and one nested ``transform`` and ``explode`` hands each leaf its siblings from
the block's bottom to the root. No join takes part in that, and nothing is gathered beyond a block.

Every table but the first is ``fan**LEVELS`` times smaller than the one below; each is written under
``spark.checkpoint.dir``, so a lost executor costs the running step only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.llm import base

FAN, LEVELS = 2, 10
STEP = "struct<left:string,right:string>"
MASK = (1 << 33) - 1
"""The places of ``monotonically_increasing_id`` that count the rows of a partition."""


def digest(*parts: Column) -> Column:
    """Lowercase hex sha256 of some strings one behind the other."""
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def field(value: Column) -> Column:
    """A value with its length in bytes before it, so that no two rows read alike; ``-`` if null."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def ranked(rows: DataFrame, tree: str, order: list[str], parts: int) -> tuple[DataFrame, int]:
    """``rows`` with ``rank`` (from 0, by ``order``) and ``total`` of their ``tree``; the largest total.

    Range partitions hold trees one behind the other, so a rank is the place in the partition plus what earlier
    partitions hold of the tree: one number for each partition and tree in it.
    """
    placed = rows.repartitionByRange(parts, tree, *order).sortWithinPartitions(tree, *order)
    mark = F.monotonically_increasing_id()
    placed = base.written(placed.withColumn("mark", mark)).withColumns(
        {"part": F.shiftright("mark", 33), "at": F.col("mark").bitwiseAND(F.lit(MASK))})
    runs = placed.groupBy(tree, "part").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy(tree).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    runs = base.written(runs.select(
        F.col(tree).alias("of"), F.col("part").alias("in"), (F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("first")).alias("shift"),
        F.sum("n").over(Window.partitionBy(tree)).alias("total")))
    joined = placed.join(runs, F.col(tree).eqNullSafe(F.col("of")) & (F.col("part") == F.col("in")))
    ready = joined.withColumn("rank", F.col("at") + F.col("shift")).drop("mark", "part", "at", "of", "in", "shift")
    return ready, runs.agg(F.max("total")).first()[0] or 0


def rolled(leaves: DataFrame, tree: str, fan: int, levels: int, parts: int) -> DataFrame:
    """``(tree, rank, total, node)``: a row for each block of ``leaves(tree, rank, total, node)``, where a node
    is a struct with ``hash``. A level that the tree hasn't got (``total`` is reached) leaves the hash as it is."""
    digits = [f"d{k}" for k in range(levels, 0, -1)]
    block = F.floor(F.col("rank") / fan**levels).cast("long")
    at = leaves.select(tree, "total", block.alias("block"), *[
        (F.floor(F.col("rank") / fan ** (k - 1)) % fan).cast("int").alias(f"d{k}") for k in range(levels, 0, -1)], "node")
    at = at.repartition(parts, tree, "block").sortWithinPartitions(tree, "block", *digits)
    for level in range(1, levels + 1):
        digit = digits.pop()
        kids = F.array_compact(F.array(*[F.first(F.when(F.col(digit) == j, F.col("node")), ignorenulls=True) for j in range(fan)]))
        at = at.groupBy(tree, "block", *digits).agg(F.first("total").alias("total"), kids.alias("kids"))
        more = F.col("total") > fan ** (level - 1)
        own = F.when(more, F.sha2(F.array_join(F.col("kids")["hash"], "").cast("binary"), 256)).otherwise(F.col("kids")[0]["hash"])
        at = at.withColumn("node", F.struct(own.alias("hash"), more.alias("more"), "kids")).drop("kids")
    return at.select(tree, F.col("block").alias("rank"), F.ceil(F.col("total") / fan**levels).cast("long").alias("total"), "node")


def unrolled(blocks: DataFrame, keep: list[str], levels: int) -> DataFrame:
    """A row for each leaf of ``blocks(*keep, node, above)``: ``keep``, ``leaf``, and ``path``, its siblings by level,
    lowest first, with those ``above`` the block behind them."""

    def leaves(node: Column, level: int, path: Column) -> Column:
        if not level:
            return F.array(F.struct(node.alias("leaf"), path.alias("path")))

        def child(kid: Column, i: Column) -> Column:
            hashes = node["kids"]["hash"]
            step = F.struct(F.array_join(F.slice(hashes, F.lit(1), i), "").alias("left"),
                            F.array_join(F.slice(hashes, i + 2, F.size(hashes)), "").alias("right"))
            return leaves(kid, level - 1, F.concat(F.when(node["more"], F.array(step)).otherwise(F.array().cast(f"array<{STEP}>")), path))

        return F.flatten(F.transform(node["kids"], child))

    each = F.explode(leaves(F.col("node"), levels, F.col("above")))
    return blocks.select(*keep, each.alias("each")).select(*keep, "each.leaf", "each.path")


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf hash and its siblings lead to."""
    return F.aggregate(path, leaf, lambda h, s: F.sha2(F.concat(s["left"], h, s["right"]).cast("binary"), 256))


def built(leaves: DataFrame, tree: str, order: list[str], fan: int, levels: int) -> list[tuple[DataFrame, int]]:
    """Tables of blocks of ``leaves(<tree>, *order, hash, ...)`` and their levels, the lowest first; the last has one row a tree.

    A leaf's node is the struct of all columns but the tree; a leaf of a higher table holds its block's number.
    """
    spark = leaves.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    own = F.struct(*[c for c in leaves.columns if c != tree])
    at, most = ranked(leaves, tree, order, parts)
    at = at.select(tree, "rank", "total", own.alias("node"))
    tables: list[tuple[DataFrame, int]] = []
    while not tables or most > 1:
        here = 1
        while here < levels and fan**here < most:
            here += 1
        at = base.written(rolled(at, tree, fan, here, parts))
        tables.append((at, here))
        most = -(-most // fan**here)
        at = at.select(tree, "rank", "total", F.struct(F.col("node.hash").alias("hash"), F.col("rank").alias("block")).alias("node"))
    return tables


def proven(tables: list[tuple[DataFrame, int]], tree: str, above: DataFrame) -> DataFrame:
    """``(<tree>, *carried, leaf, path)`` of every leaf, given ``above(<tree>, *carried, above)``: what each tree stands in."""
    carried = [c for c in above.columns if c not in (tree, "above")]
    above = above.withColumn("block", F.lit(0).cast("long"))
    for k, (table, levels) in reversed(list(enumerate(tables))):
        blocks = table.select(tree, F.col("rank").alias("block"), "node")
        both = blocks.unionByName(above, allowMissingColumns=True).groupBy(tree, "block").agg(*[
            F.first(c, ignorenulls=True).alias(c) for c in (*carried, "node", "above")])
        out = unrolled(both, [tree, *carried], levels)
        if k:
            above = base.written(out.select(tree, *carried, F.col("leaf.block").alias("block"), F.col("path").alias("above")))
    return out


def manifest(docs: DataFrame, fields: list[str], key: str, tree: str, tampered: dict[str, Column] | None = None,
             fan: int = FAN, levels: int = LEVELS) -> DataFrame:
    """``(<key>, leaf, subroot, root, path, proof_sha256, folded_root, verified)`` of every row of ``docs``.

    A leaf is the digest of ``fields``, each with its length, a null as ``-``. The rows of one ``tree`` value, in
    ascending order of ``key`` (null first, then by leaf), make a subtree, and the subtrees, in order of that
    value (null first, then bytewise), make the tree of the whole. ``path`` holds, from the leaf to the root,
    what stands left and right of the node in its run. ``folded_root`` is built from ``path`` and the leaf that
    the row has once ``tampered`` columns are put in its place, so ``verified`` tells whether the manifest notices.

    Repeated rows are leaves of their own. A null or empty text is a field as any other. A table without rows
    has no proofs. Columns other than ``fields``, ``key`` and ``tree`` are not read, and names of helper columns
    cannot clash with those, as all are renamed first.
    """
    changed = tampered or {}
    first = digest(*[field(docs[c]) for c in fields])
    second = digest(*[field(changed.get(c, docs[c])) for c in fields])
    leaves = docs.select(docs[tree].alias("tree"), docs[key].alias("key"), first.alias("hash"), F.nullif(second, first).alias("other"))
    lower = built(leaves, "tree", ["key", "hash"], fan, levels)
    roots = lower[-1][0].select(F.lit(0).alias("whole"), "tree", F.col("node.hash").alias("hash"))
    upper = built(roots, "whole", ["tree", "hash"], fan, levels)
    above = upper[-1][0].select("whole", F.col("node.hash").alias("root"), F.array().cast(f"array<{STEP}>").alias("above"))
    above = base.written(proven(upper, "whole", above).select(
        F.col("leaf.tree").alias("tree"), "root", F.col("leaf.hash").alias("subroot"), F.col("path").alias("above")))
    rows = proven(lower, "tree", above)
    sides = F.flatten(F.transform("path", lambda s: F.array(s["left"], s["right"])))
    out = rows.select(F.col("leaf.key").alias("key"), F.col("leaf.hash").alias("leaf"), "subroot", "root", "path",
                      F.sha2(F.array_join(sides, "").cast("binary"), 256).alias("proof_sha256"),
                      folded(F.coalesce("leaf.other", "leaf.hash"), F.col("path")).alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root")).withColumnRenamed("key", key)


SQL = """
WITH RECURSIVE
crc_table AS (
    SELECT list(list_reduce(list_prepend(n, [0, 0, 0, 0, 0, 0, 0, 0]),
                            lambda c, k: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END) ORDER BY n) AS t
    FROM (SELECT CAST(range AS BIGINT) AS n FROM range(256))),
marked AS (
    SELECT doc_id, source, lang, n_chars, text,
           xor(4294967295, list_reduce(list_prepend(CAST(4294967295 AS BIGINT),
                   list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda d: CAST(ascii(d) AS BIGINT))),
               lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]))) % 7 = 0 AS hit
    FROM documents, crc_table),
lengths AS (
    SELECT *, coalesce(octet_length(encode(CAST(doc_id AS VARCHAR))) || ':' || doc_id, '-')
              || coalesce(octet_length(encode(source)) || ':' || source, '-') || coalesce(octet_length(encode(lang)) || ':' || lang, '-') AS head,
           coalesce(octet_length(encode(text)) || ':' || text, '-') AS tail, n_chars + CASE WHEN hit THEN 1 ELSE 0 END AS n_other
    FROM marked),
leaves AS (
    SELECT doc_id, lang, sha256(head || coalesce(length(CAST(n_chars AS VARCHAR)) || ':' || n_chars, '-') || tail) AS leaf,
           sha256(head || coalesce(length(CAST(n_other AS VARCHAR)) || ':' || n_other, '-') || tail) AS other
    FROM lengths),
placed AS (
    SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY lang) AS n FROM leaves),
lower_nodes AS (
    SELECT lang, 0 AS level, pos, n, leaf AS h FROM placed
    UNION ALL
    SELECT lang, level + 1, pos // 2, (n + 1) // 2, sha256(string_agg(h, '' ORDER BY pos)) FROM lower_nodes WHERE n > 1
    GROUP BY lang, level, pos // 2, n),
subroots AS (
    SELECT lang, h AS subroot, row_number() OVER (ORDER BY encode(lang) NULLS FIRST) - 1 AS place, count(*) OVER () AS trees
    FROM lower_nodes WHERE n = 1),
upper_nodes AS (
    SELECT 0 AS level, place AS pos, trees AS n, subroot AS h FROM subroots
    UNION ALL
    SELECT level + 1, pos // 2, (n + 1) // 2, sha256(string_agg(h, '' ORDER BY pos)) FROM upper_nodes WHERE n > 1
    GROUP BY level, pos // 2, n),
lower_steps AS (
    SELECT doc_id, lang, leaf, other, pos, n, 0 AS level, pos AS here, n AS left_over, '' AS proof, other AS fold FROM placed
    UNION ALL
    SELECT s.doc_id, s.lang, s.leaf, s.other, s.pos, s.n, s.level + 1, s.here // 2, (s.left_over + 1) // 2, s.proof || coalesce(o.h, ''),
           sha256(CASE WHEN s.here % 2 = 0 THEN s.fold || coalesce(o.h, '') ELSE o.h || s.fold END)
    FROM lower_steps s LEFT JOIN lower_nodes o ON o.lang IS NOT DISTINCT FROM s.lang AND o.level = s.level AND o.pos = xor(s.here, 1)
    WHERE s.left_over > 1),
upper_steps AS (
    SELECT l.doc_id, l.leaf, u.subroot, 0 AS level, u.place AS here, u.trees AS left_over, l.proof, l.fold
    FROM lower_steps l JOIN subroots u ON u.lang IS NOT DISTINCT FROM l.lang WHERE l.left_over = 1
    UNION ALL
    SELECT s.doc_id, s.leaf, s.subroot, s.level + 1, s.here // 2, (s.left_over + 1) // 2, s.proof || coalesce(o.h, ''),
           sha256(CASE WHEN s.here % 2 = 0 THEN s.fold || coalesce(o.h, '') ELSE o.h || s.fold END)
    FROM upper_steps s LEFT JOIN upper_nodes o ON o.level = s.level AND o.pos = xor(s.here, 1)
    WHERE s.left_over > 1)
SELECT s.doc_id, s.leaf, s.subroot, r.h AS root, sha256(s.proof) AS proof_sha256, s.fold AS folded_root, s.fold = r.h AS verified
FROM upper_steps s, (SELECT h FROM upper_nodes WHERE n = 1) r WHERE s.left_over = 1
"""
