"""Line dedup by a log-template tree, in DataFrame functions only.

Lines are parsed as logs are: a tree of fixed depth sorts them by their number of tokens and their
``LEADING`` first tokens, tokens with a digit counting as a variable field. In each leaf a token that few lines
share at its place is a variable field too, and a line's template is its tokens with the variable fields
left open. Lines that keep at least 4/5 (``CONSTANT``) of their tokens belong to their template. A template is
boilerplate if it recurs in ``min_docs`` independent documents, and all its lines are dropped.

Copies are not boilerplate: equal texts are one document, and a document that consists mostly of recurring
templates is a copy of others (whole-document dedup deals with those), so it is no witness.

The work is on distinct texts and distinct lines wherever it can be. Leaves are counted first, on hashes,
so only lines of leaves that recur are looked at token by token. A line that a third of all
documents share is one row from there on; all counts are aggregated on the map side, and what is joined to
occurrences are written tables, so that Spark splits hot keys.
"""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.llm import base

LEADING, LEAST_TOKENS, CONSTANT, MIN_DOCS = 3, 4, (4, 5), 3
SPACES = r"[ \t\x0B\f\r]+"


def _pair(name: str, *of: Column | str) -> list[Column]:
    """A 128-bit key as two columns."""
    return [F.xxhash64(F.lit(k), *[F.col(c) if isinstance(c, str) else c for c in of]).alias(f"{name}{k}") for k in (1, 2)]


def tokens(line: Column) -> Column:
    """Tokens of a line; a line of white space has one empty one."""
    return F.split(F.btrim(line, F.lit(" \t\x0b\f\r")), SPACES)


def masked(token: Column) -> Column:
    return F.when(token.rlike("[0-9]"), "<*>").otherwise(token)


def leaf(words: Column) -> Column:
    """The place of a line in the tree: token count and leading tokens."""
    return F.xxhash64(F.size(words), *[masked(F.get(words, F.lit(i))) for i in range(LEADING)])


def boilerplate(docs: DataFrame, text: str = "text", min_docs: int = MIN_DOCS) -> DataFrame:
    """``(d1, d2, drop)``: for each text, by a 128-bit key, the numbers (from 0) of its lines to drop."""
    lines = docs.filter(F.col(text).isNotNull()).select(
        *_pair("d", text), F.length(text).alias("size"), F.posexplode(F.split(text, "\n")).alias("pos", "line"))
    words = tokens(F.col("line"))
    lines = lines.withColumn("words", words).filter(F.size("words") >= LEAST_TOKENS)
    lines = lines.select("d1", "d2", "size", "pos", "line", leaf(F.col("words")).alias("leaf"))

    # leaves that recur, on hashes alone
    leaves = lines.select("leaf", "d1", "d2").distinct().groupBy("leaf").agg(F.count(F.lit(1)).alias("n"))
    leaves = base.written(leaves.filter(F.col("n") >= min_docs).select("leaf"))
    found = base.written(lines.join(leaves, "leaf", "left_semi").select(
        "d1", "d2", "size", "pos", "leaf", "line", *_pair("l", "line")))

    # distinct lines, and the tokens that enough of them share at a place of their leaf
    distinct = found.select("leaf", "l1", "l2", "d1", "d2").distinct().groupBy("leaf", "l1", "l2").agg(F.count(F.lit(1)).alias("docs"))
    text_of = found.groupBy("l1", "l2").agg(F.min("line").alias("line"))
    distinct = base.written(distinct.join(text_of, ["l1", "l2"]))
    at = distinct.select("leaf", "l1", "l2", "docs", F.posexplode(F.transform(tokens(F.col("line")), masked)).alias("at", "token"))
    shared = base.written(at.filter("token <> '<*>'").groupBy("leaf", "at", "token").agg(F.sum("docs").alias("n"))
                          .filter(F.col("n") >= min_docs).select("leaf", "at", "token", F.lit(True).alias("constant")))
    open_ = at.join(shared, ["leaf", "at", "token"], "left").select(
        "leaf", "l1", "l2", F.struct("at", F.when(F.col("constant"), F.col("token")).alias("token")).alias("t"))
    templates = open_.groupBy("leaf", "l1", "l2").agg(F.sort_array(F.collect_list("t")).alias("t"))
    constants = F.size(F.filter("t", lambda t: t["token"].isNotNull()))
    template = F.array_join(F.transform("t", lambda t: F.coalesce(t["token"], F.lit("<*>"))), " ")
    templates = base.written(templates.filter(constants * CONSTANT[1] >= F.size("t") * CONSTANT[0]).select("l1", "l2", *_pair("t", template)))

    # in how many documents a template recurs, then in how many that are no copies
    held = found.select("d1", "d2", "size", "pos", "l1", "l2", F.length("line").alias("chars")).join(templates, ["l1", "l2"])
    held = base.written(held.select("d1", "d2", "size", "pos", "chars", "t1", "t2").distinct())
    base.free(found, distinct, shared)
    recurring = base.written(_recurring(held, min_docs))
    again = held.join(recurring, ["t1", "t2"], "left_semi")
    copies = again.groupBy("d1", "d2").agg(F.sum("chars").alias("chars"), F.min("size").alias("size")).filter("chars * 2 >= size")
    witnessed = held.join(base.written(copies.select("d1", "d2")), ["d1", "d2"], "left_anti")
    final = base.written(_recurring(witnessed, min_docs))
    return base.written(held.join(final, ["t1", "t2"], "left_semi").groupBy("d1", "d2").agg(F.collect_set("pos").alias("drop")))


def _recurring(held: DataFrame, min_docs: int) -> DataFrame:
    """Templates of at least ``min_docs`` documents."""
    once = held.select("t1", "t2", "d1", "d2").distinct().groupBy("t1", "t2").agg(F.count(F.lit(1)).alias("n"))
    return once.filter(F.col("n") >= min_docs).select("t1", "t2")


def drop_lines(docs: DataFrame, text: str = "text", min_docs: int = MIN_DOCS,
               n_lines: str = "n_lines", n_dropped: str = "n_dropped") -> DataFrame:
    """``docs`` without boilerplate lines, with ``n_lines`` and ``n_dropped``.

    Lines end at ``\\n``; what is left is joined by it and otherwise unchanged, and a document may be left
    with an empty text. Lines of fewer than ``LEAST_TOKENS`` tokens are never dropped. A null text stays
    null and has no lines. All rows and columns stay (columns named ``n_lines`` or ``n_dropped`` are
    replaced); repeated rows and equal texts are treated alike and count as one document.
    """
    drops = boilerplate(docs, text, min_docs)
    own = uuid4().hex
    keys, drop = [f"d1_{own}", f"d2_{own}"], f"drop_{own}"
    keyed = docs.select("*", *[c.alias(k) for k, c in zip(keys, _pair("d", text), strict=True)])
    drops = drops.select(F.col("d1").alias(keys[0]), F.col("d2").alias(keys[1]), F.col("drop").alias(drop))
    lines = F.split(text, "\n")
    kept = F.filter(lines, lambda _, i: ~F.array_contains(drop, i))
    out = keyed.join(drops, keys, "left").withColumns({
        n_lines: F.when(F.col(text).isNull(), 0).otherwise(F.size(lines)).cast("long"),
        n_dropped: F.coalesce(F.size(drop), F.lit(0)).cast("long"),
        text: F.when(F.col(drop).isNull(), F.col(text)).otherwise(F.array_join(kept, "\n"))})
    return out.drop(drop, *keys)


#: The same for ``op2_line_templates`` in DuckDB's SQL, on strings instead of keys.
SQL = f"""
WITH texts AS (SELECT DISTINCT text FROM documents WHERE text IS NOT NULL),
split AS (SELECT text, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos FROM texts),
parsed AS (
  SELECT *, list_filter(string_split_regex(line, '[ \\t\\x0B\\f\\r]+'), lambda t: t <> '') AS words FROM split),
lines AS (
  SELECT text, pos, line, list_transform(words, lambda t: CASE WHEN regexp_matches(t, '[0-9]') THEN '<*>' ELSE t END) AS words
  FROM parsed WHERE len(words) >= {LEAST_TOKENS}),
leaved AS (SELECT *, len(words) AS n, list_slice(words, 1, {LEADING}) AS head_words FROM lines),
leaves AS (SELECT n, head_words FROM leaved GROUP BY ALL HAVING count(DISTINCT text) >= {MIN_DOCS}),
found AS (SELECT leaved.* FROM leaved JOIN leaves USING (n, head_words)),
uniq AS (SELECT n, head_words, line, words, count(DISTINCT text) AS docs FROM found GROUP BY ALL),
placed AS (SELECT n, head_words, line, docs, unnest(words) AS token, generate_subscripts(words, 1) AS place FROM uniq),
shared AS (SELECT n, head_words, place, token FROM placed WHERE token <> '<*>' GROUP BY ALL HAVING sum(docs) >= {MIN_DOCS}),
opened AS (
  SELECT p.n, p.head_words, p.line, p.place, s.token FROM placed p LEFT JOIN shared s
  ON p.n = s.n AND p.head_words = s.head_words AND p.place = s.place AND p.token = s.token),
templates AS (
  SELECT line, string_agg(coalesce(token, '<*>'), ' ' ORDER BY place) AS template
  FROM opened GROUP BY n, head_words, line HAVING count(token) * {CONSTANT[1]} >= {CONSTANT[0]} * count(*)),
held AS (SELECT f.text, f.pos, length(f.line) AS chars, t.template FROM found f JOIN templates t USING (line)),
recurring AS (SELECT template FROM held GROUP BY template HAVING count(DISTINCT text) >= {MIN_DOCS}),
copies AS (
  SELECT text FROM held JOIN recurring USING (template) GROUP BY text HAVING sum(chars) * 2 >= length(text)),
final AS (
  SELECT template FROM held WHERE text NOT IN (SELECT text FROM copies) GROUP BY template HAVING count(DISTINCT text) >= {MIN_DOCS}),
drops AS (SELECT text, list(pos) AS gone FROM held JOIN final USING (template) GROUP BY text),
done AS (
  SELECT doc_id, d.text, gone, string_split(d.text, chr(10)) AS rows FROM documents d LEFT JOIN drops ON d.text = drops.text)
SELECT doc_id, coalesce(len(rows), 0)::BIGINT AS n_lines, coalesce(len(gone), 0)::BIGINT AS n_dropped,
  CASE WHEN text IS NOT NULL THEN sha256(CASE WHEN gone IS NULL THEN text ELSE array_to_string(
    list_filter(rows, lambda r, i: NOT list_contains(gone, i - 1)), chr(10)) END) END AS kept_sha256
FROM done
"""
