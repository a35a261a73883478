"""Queries over documents, labels, benchmark passages, pages and conversations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.functions import tables
from tallyloom.functions import text as tx
from tallyloom.operators import nested as ne
from tallyloom.operators import ordered as od
from tallyloom.operators import similarity as si
from tallyloom.operators import worklist as wl
from tallyloom.plans.registry import query
from tallyloom.sources import files
from tallyloom.sources.store import new_path
from tallyloom.sources.tables import load, spread

# SQL spellings of the same fixed values
WS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
STRIP = f"trim({{}}, {WS})"


def sql_strip(expr: str) -> str:
    return STRIP.format(expr)


# --- scans, keys and work lists ------------------------------------------------------------------------

@query("scan_documents", "SELECT doc_id, source, length(text) AS length, md5(text) AS digest FROM documents")
def scan_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "documents").select(
        "doc_id", "source", F.length("text").cast("bigint").alias("length"), F.md5("text").alias("digest"))


@query("url_keys", r"""
SELECT page_id, regexp_extract(url, '^https?://([^/?#]+)', 1) AS host,
       regexp_extract(url, '^https?://[^/?#]+/(?:[^?#]*/)?([^/?#]*)', 1) AS key, starts_with(url, 'https:') AS secure
FROM pages""")
def url_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "pages").select(
        "page_id", F.regexp_extract("url", r"^https?://([^/?#]+)", 1).alias("host"),
        F.regexp_extract("url", r"^https?://[^/?#]+/(?:[^?#]*/)?([^/?#]*)", 1).alias("key"),
        F.col("url").startswith("https:").alias("secure"))


SCORED = """
SELECT d.doc_id, d.source, d.n_chars, l.quality, CASE WHEN l.doc_id IS NULL THEN 'PENDING' WHEN l.quality = 1 THEN 'PASSED' ELSE 'FAILED' END AS status
FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id"""


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One record a document, as a scoring step would leave it."""
    labels = load(spark, sf_dir, "labels").select("doc_id", "quality")
    status = F.when(F.col("_known").isNull(), "PENDING").when(F.col("quality") == 1, "PASSED").otherwise("FAILED")
    return load(spark, sf_dir, "documents").select("doc_id", "source", "n_chars").join(
        labels.withColumn("_known", F.lit(True)), "doc_id", "left").select("doc_id", "source", "n_chars", "quality", status.alias("status"))


@query("record_files", f"SELECT CAST(doc_id AS VARCHAR) AS key, s.* FROM ({SCORED}) s")
def record_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scored documents written as one JSON file each and read back."""
    records, path = scored(spark, sf_dir), new_path(spark, "records")
    files.write_records(records, path, F.col("doc_id"))
    return files.read_records(spark, path, records.schema).filter(~F.col("bad")).select("key", "record.*")


@query("text_files", f"""
SELECT CAST(doc_id AS VARCHAR) AS key, octet_length(encode(body)) AS bytes, md5(body) AS digest
FROM (SELECT doc_id, coalesce({sql_strip("replace(text, chr(13) || chr(10), chr(10))")}, '') AS body FROM documents)""")
def text_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cleaned texts written as one file each, next to files of another suffix, and read back by name."""
    docs, path = load(spark, sf_dir, "documents"), new_path(spark, "texts")
    body = tx.strip(F.replace("text", F.lit("\r\n"), F.lit("\n")))
    files.write_files(docs, path, F.col("doc_id"), body, ".txt")
    files.write_files(load(spark, sf_dir, "labels"), path, F.col("doc_id"), F.lit("a note, not a text"), "_note.txt", append=True)
    back = files.read_files(spark, path, ".txt", "_note.txt")
    return back.filter(F.col("problem").isNull()).select("key", "bytes", F.md5("text").alias("digest"))


@query("record_phases", f"""
WITH s AS ({SCORED}), texts AS (SELECT doc_id, length(text) % 5 = 0 AS torn FROM documents)
SELECT s.source, CASE WHEN t.torn THEN 'UNREADABLE' ELSE s.status END AS status, count(*) AS files,
       coalesce(CAST(sum(CASE WHEN NOT t.torn THEN s.n_chars END) AS BIGINT), 0) AS chars
FROM s JOIN texts t ON t.doc_id = s.doc_id GROUP BY 1, 2""")
def record_phases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From pending to summary over files: records are written, some of them torn off as by a crash, read back, and
    counted by what they say; a torn one is counted too and known by its key."""
    docs, path = load(spark, sf_dir, "documents"), new_path(spark, "phases")
    records = scored(spark, sf_dir)
    torn = docs.select("doc_id", (F.length("text") % 5 == 0).alias("torn"))
    whole = F.to_json(F.struct(*records.columns), {"ignoreNullFields": "false"})
    text = F.when(F.col("torn"), F.substring(whole, F.lit(1), F.length(whole) - F.lit(7))).otherwise(whole)
    files.write_files(records.join(torn, "doc_id"), path, F.col("doc_id"), text, ".json")
    back = files.read_records(spark, path, records.schema)
    known = docs.select(F.col("doc_id").cast("string").alias("key"), F.col("source").alias("of"))
    return back.join(known, "key").groupBy(
        F.col("of").alias("source"), F.when(F.col("bad"), "UNREADABLE").otherwise(F.col("record.status")).alias("status")).agg(
        F.count(F.lit(1)).alias("files"), F.coalesce(F.sum("record.n_chars"), F.lit(0)).alias("chars"))


@query("pending_documents", """
SELECT doc_id, source FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)""")
def pending_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = load(spark, sf_dir, "documents").select("doc_id", "source")
    return wl.pending(documents, load(spark, sf_dir, "labels"), ["doc_id"])


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = load(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return wl.with_context(documents, load(spark, sf_dir, "labels"), ["doc_id"], "has_label")


@query("labelled_documents", """
SELECT d.doc_id, d.source, coalesce(l.quality, -1) AS quality, l.doc_id IS NOT NULL AS has_label
FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id""")
def labelled_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labelled(spark, sf_dir).select(
        "doc_id", "source", F.coalesce("quality", F.lit(-1)).alias("quality"), "has_label")


@query("outcome_status", """
SELECT d.doc_id, CASE WHEN l.doc_id IS NULL THEN 'UNKNOWN' WHEN l.toxic = 1 THEN 'FAILED'
       WHEN l.quality = 1 THEN 'PASSED' ELSE 'NEEDS_REVIEW' END AS status
FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id""")
def outcome_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = wl.outcome(F.col("toxic") == 0, F.col("quality") == 1, F.col("has_label"))
    return labelled(spark, sf_dir).select("doc_id", status.alias("status"))


@query("phase_status", """
SELECT 'label' AS phase, count(l.doc_id) AS completed, count(*) - count(l.doc_id) AS pending
FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id
UNION ALL SELECT 'accept', count(*) FILTER (toxic = 0), count(*) FILTER (toxic <> 0) FROM labels WHERE quality = 1""")
def phase_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelling of all documents, and acceptance (not toxic) of those labelled as good."""
    documents, labels = load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels")
    good = labels.filter(F.col("quality") == 1)
    return wl.phase_status({"label": (documents, labels), "accept": (good, good.filter(F.col("toxic") == 0))}, ["doc_id"])


@query("phase_chain", """
WITH s AS (SELECT d.doc_id, count(l.doc_id) > 0 AS a, coalesce(bool_or(l.quality = 1), false) AS b,
                  coalesce(bool_or(l.toxic = 0), false) AS c FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id GROUP BY 1)
SELECT 'label' AS phase, count(*) FILTER (a) AS completed, count(*) FILTER (NOT a) AS ready, 0::BIGINT AS blocked FROM s
UNION ALL SELECT 'pass', count(*) FILTER (b), count(*) FILTER (NOT b AND a), count(*) FILTER (NOT b AND NOT a) FROM s
UNION ALL SELECT 'accept', count(*) FILTER (c), count(*) FILTER (NOT c AND a AND b), count(*) FILTER (NOT c AND NOT (a AND b)) FROM s""")
def phase_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents through labelling, a good quality and acceptance: what is done, ready and waiting at each step."""
    documents, labels = load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels")
    phases = [("label", labels), ("pass", labels.filter("quality = 1")), ("accept", labels.filter("toxic = 0"))]
    return wl.phase_chain(documents, phases, ["doc_id"])


# --- text functions ------------------------------------------------------------------------------------

@query("request_text", r"""
SELECT c.conv_id, c.turn, 'Turn ' || c.turn || ' by ' || c.role || ':' || chr(10) || c.text ||
  CASE WHEN p.text IS NULL OR p.text = '' THEN ''
       ELSE chr(10) || 'Context:' || chr(10) || p.text END || chr(10) || CASE WHEN c.turn = 0 THEN 'Answer directly.'
       ELSE 'Answer step by step.' END AS request
FROM conversations c LEFT JOIN conversations p ON p.conv_id = c.conv_id AND p.turn = c.turn - 1""")
def request_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = load(spark, sf_dir, "conversations")
    earlier = turns.select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("context"))
    fields = {"turn": F.col("turn"), "role": F.col("role"), "text": F.col("text"),
              "ask": F.when(F.col("turn") == 0, "Answer directly.").otherwise("Answer step by step.")}
    request = tx.request_text("Turn {turn} by {role}:\n{text}{context}\n{ask}", "Context:", fields, F.col("context"))
    # the context label starts on its own line and is followed by the context itself
    return turns.join(earlier, ["conv_id", "turn"], "left").select("conv_id", "turn", request.alias("request"))


@query("extract_block", rf"""
WITH p AS (SELECT page_id, html, {sql_strip("regexp_extract(html, '(?s)<title>(.*?)</title>', 1)")} AS title,
  list_transform(regexp_extract_all(html, '(?s)<p>(.*?)</p>', 1), lambda x: x) AS ps FROM pages)
SELECT page_id, CASE WHEN title <> '' THEN title WHEN len(ps) > 0 THEN
  {sql_strip("ps[list_position(list_transform(ps, lambda x: length(x)), list_max(list_transform(ps, lambda x: length(x))))]")}
  ELSE {sql_strip("regexp_replace(html, '<[^>]*>', ' ', 'g')")} END AS block FROM p""")
def extract_block(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "pages").select("page_id", tx.page_block(F.col("html")).alias("block"))


@query("longest_paragraph", rf"""
WITH p AS (SELECT page_id, regexp_extract_all(html, '(?s)<p>(.*?)</p>', 1) AS ps FROM pages)
SELECT page_id, ps[list_position(list_transform(ps, lambda x: length(x)),
       list_max(list_transform(ps, lambda x: length(x))))] AS paragraph FROM p""")
def longest_paragraph(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = F.regexp_extract_all("html", F.lit(r"(?s)<p>(.*?)</p>"), F.lit(1))
    return load(spark, sf_dir, "pages").select("page_id", tx.longest(found).alias("paragraph"))


RESPONSE_SQL = """
WITH r AS (SELECT d.doc_id, d.text, l.quality, l.toxic,
  CASE WHEN l.quality = 1 THEN 'VALIDATION: PASSED' || chr(10) || 'ISSUES: None'
       ELSE 'VALIDATION: FAILED' || chr(10) || 'ISSUES: quality' || chr(10) || 'CORRECTED_CODE:' ||
            CASE WHEN l.toxic = 1 THEN ' ' ELSE chr(10) || '```python' || chr(10) || d.source || chr(10) || '```' END
  END AS response, d.source FROM documents d JOIN labels l ON l.doc_id = d.doc_id)
"""


@query("labelled_sections", RESPONSE_SQL + """
SELECT doc_id, quality = 1 AS passed, md5(CASE WHEN quality = 1 OR toxic = 1 THEN text ELSE source END) AS final_digest,
       quality <> 1 AND toxic = 1 AS empty_correction FROM r""")
def labelled_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict texts written from the labels, parsed back into flag, corrected text and empty mark."""
    fence = "```"
    corrected = F.when(F.col("toxic") == 1, " ").otherwise(
        F.concat(F.lit(f"\n{fence}python\n"), F.col("source"), F.lit(f"\n{fence}")))
    response = F.when(F.col("quality") == 1, "VALIDATION: PASSED\nISSUES: None").otherwise(
        F.concat(F.lit("VALIDATION: FAILED\nISSUES: quality\nCORRECTED_CODE:"), corrected))
    answered = labelled(spark, sf_dir).filter("has_label").withColumn("response", response)
    parts = tx.verdict_parts(F.col("response"), F.col("text"))
    return answered.select("doc_id", parts["passed"].alias("passed"), F.md5(parts["final_text"]).alias("final_digest"),
                           parts["empty_correction"].alias("empty_correction"))


@query("classify_messages", r"""
SELECT doc_id, len(list_filter(ls, lambda x: regexp_matches(lower(x), '429|quota|rate|limit')))::BIGINT AS flagged,
       len(list_filter(ls, lambda x: regexp_matches(lower(x), '(^|[^\p{L}\p{N}_])(429|quota|rate|limit)([^\p{L}\p{N}_]|$)')))::BIGINT AS flagged_words,
       len(ls)::BIGINT AS lines
FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents)""")
def classify_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = spread(load(spark, sf_dir, "documents").select("doc_id", "text"))
    rows = tx.lines(F.col("text"))

    def hits(whole_words: bool) -> Column:
        return F.size(F.filter(rows, lambda x: tx.is_rate_limited(x, whole_words))).cast("bigint")

    return documents.select(
        "doc_id", hits(False).alias("flagged"), hits(True).alias("flagged_words"),
        F.size(rows).cast("bigint").alias("lines"))


CUT = r"""'^((?:[^#"''\\]|\\+[^#\\]|"(?:[^"\\]|\\+[^\\])*"|''(?:[^''\\]|\\+[^\\])*'')*\\*)#.*$'"""

NORMAL = (
    "array_to_string(list_filter(list_transform(string_split({0}, chr(10)), lambda x: "
    + sql_strip(f"regexp_replace(x, {CUT}, '\\1')") + "), lambda x: x <> ''), chr(10))"
)


@query("normalise_text", f"SELECT doc_id, md5({NORMAL.format('text')}) AS digest, "
                         f"length({NORMAL.format('text')}) AS length FROM documents")
def normalise_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = spread(load(spark, sf_dir, "documents").select("doc_id", "text"))
    clean = documents.select("doc_id", tx.normalise(F.col("text")).alias("t"))
    return clean.select("doc_id", F.md5("t").alias("digest"), F.length("t").cast("bigint").alias("length"))


def in_braces(pattern: str) -> str:
    """A pattern inside a text that ``format`` will fill."""
    return pattern.replace("{", "{{").replace("}", "}}")


TOKENS = "regexp_extract_all({0}, '" + in_braces(tx.TOKEN) + "')"


@query("token_counts", f"""
SELECT token, count(*) AS n, count(DISTINCT doc_id) AS docs
FROM (SELECT doc_id, unnest({TOKENS.format('text')}) AS token FROM documents) GROUP BY token""")
def token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """In a document's sorted tokens each token knows if it is its first, so one map-side combined count is all."""
    sorted_ = spread(load(spark, sf_dir, "documents").select("text")).select(F.sort_array(tx.tokens(F.col("text"))).alias("w"))
    first = F.transform("w", lambda t, i: F.struct(t.alias("token"), (~F.get("w", i - 1).eqNullSafe(t)).alias("first")))
    words = sorted_.select(F.inline(first))
    return words.groupBy("token").agg(F.count(F.lit(1)).alias("n"), F.count_if("first").alias("docs"))


CHUNK_SQL = """
WITH RECURSIVE cut(doc_id, chunk_no, piece, rest) AS (
  SELECT doc_id, -1::BIGINT, '', text FROM documents
  UNION ALL
  SELECT doc_id, chunk_no + 1, substr(rest, 1, cut_to), CASE WHEN cut_to < length(rest) THEN substr(rest, cut_to + 1) END FROM (
    SELECT *, CASE WHEN length(rest) <= 400 THEN length(rest)
                   WHEN sp > 0 THEN sp ELSE 400 END AS cut_to
    FROM (SELECT *, 401 - strpos(reverse(substr(rest, 2, 400)), ' ')
                    - CASE WHEN strpos(reverse(substr(rest, 2, 400)), ' ') = 0 THEN 401 ELSE 0 END AS sp
          FROM cut WHERE rest IS NOT NULL)))
SELECT doc_id, chunk_no, length(piece) AS length, md5(piece) AS digest FROM cut WHERE chunk_no >= 0"""


@query("chunk_table_function", CHUNK_SQL)
def chunk_table_function(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same in SQL, as a lateral join with a row generator."""
    tables.register(spark)
    return spark.sql("""SELECT doc_id, no AS chunk_no, CAST(length(piece) AS BIGINT) AS length, md5(piece) AS digest
        FROM {docs} AS d, LATERAL wrap_text(d.text, 400)""", docs=spread(load(spark, sf_dir, "documents").select("doc_id", "text")))


@query("chunk_documents", CHUNK_SQL)
def chunk_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = spread(load(spark, sf_dir, "documents").select("doc_id", "text"))
    pieces = documents.select(
        "doc_id", F.posexplode(tx.wrap(F.col("text"), 400)).alias("chunk_no", "piece"))
    return pieces.select("doc_id", F.col("chunk_no").cast("bigint"), F.length("piece").cast("bigint").alias("length"),
                         F.md5("piece").alias("digest"))


# --- pages ---------------------------------------------------------------------------------------------

TAG_STEPS = r"regexp_extract_all(html, '</?p[ >]')"


@query("balanced_tags", rf"""
WITH t AS (SELECT page_id, unnest({TAG_STEPS}) AS tag, generate_subscripts({TAG_STEPS}, 1) AS pos FROM pages),
s AS (SELECT page_id, sum(CASE WHEN starts_with(tag, '</') THEN -1 ELSE 1 END) OVER (PARTITION BY page_id ORDER BY pos) AS depth,
      CASE WHEN starts_with(tag, '</') THEN -1 ELSE 1 END AS step FROM t),
b AS (SELECT page_id, min(depth) >= 0 AND sum(step) = 0 AS balanced FROM s GROUP BY page_id)
SELECT p.page_id, coalesce(b.balanced, true) AS balanced FROM pages p LEFT JOIN b ON b.page_id = p.page_id""")
def balanced_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = F.regexp_extract_all("html", F.lit("</?p[ >]"), F.lit(0))
    steps = F.transform(found, lambda t: F.when(t.startswith("</"), -1).otherwise(1))
    return load(spark, sf_dir, "pages").select("page_id", od.array_balance(steps).alias("balanced"))


def link_lists() -> Column:
    """Per list block of a page the array of its link targets."""
    blocks = F.regexp_extract_all("html", F.lit(r"(?s)<ul>(.*?)</ul>"), F.lit(1))
    return F.transform(blocks, lambda b: F.regexp_extract_all(b, F.lit(r'href="([^"]*)"'), F.lit(1)))


@query("flatten_tags", r"""
WITH b AS (SELECT page_id, unnest(regexp_extract_all(html, '(?s)<ul>(.*?)</ul>', 1)) AS block,
                  generate_subscripts(regexp_extract_all(html, '(?s)<ul>(.*?)</ul>', 1), 1) AS i FROM pages),
h AS (SELECT page_id, i, unnest(regexp_extract_all(block, 'href="([^"]*)"', 1)) AS href,
             generate_subscripts(regexp_extract_all(block, 'href="([^"]*)"', 1), 1) AS j FROM b)
SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY i, j) - 1 AS pos, href FROM h""")
def flatten_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    flat = load(spark, sf_dir, "pages").select("page_id", F.posexplode(F.flatten(link_lists())).alias("pos", "href"))
    return flat.withColumn("pos", F.col("pos").cast("bigint"))


@query("flatten_variants", r"""
WITH b AS (SELECT page_id, unnest(regexp_extract_all(html, '(?s)<ul>(.*?)</ul>', 1)) AS block,
                  generate_subscripts(regexp_extract_all(html, '(?s)<ul>(.*?)</ul>', 1), 1) AS i FROM pages),
h AS (SELECT page_id, i, unnest(regexp_extract_all(block, 'href="([^"]*)"', 1)) AS href,
             generate_subscripts(regexp_extract_all(block, 'href="([^"]*)"', 1), 1) AS j FROM b)
SELECT page_id, '1,' || (i - 1) || ',' || (j - 1) AS path, href AS leaf FROM h
UNION ALL SELECT page_id, '0', CAST(page_id AS VARCHAR) FROM pages""")
def flatten_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same links as leaves of ``[page_id, [[href, ...], ...], []]``, nested to uneven depth."""
    nested = F.parse_json(F.concat(F.lit("["), F.col("page_id"), F.lit(", "), F.to_json(link_lists()), F.lit(", []]")))
    pages = load(spark, sf_dir, "pages").select("page_id", nested.alias("tree"))
    leaves = ne.flatten_variant(pages, ["page_id"], "tree")
    return leaves.select("page_id", F.array_join(F.col("path").cast("array<string>"), ",").alias("path"),
                         F.variant_get("leaf", "$", "string").alias("leaf"))


# --- pairs of texts ------------------------------------------------------------------------------------

def document_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document with the previous one that opens with the same line."""
    documents = load(spark, sf_dir, "documents").select("doc_id", "text")
    first_line = F.sha2(F.substring_index("text", "\n", 1), 256)
    return si.versions(documents, first_line, "doc_id", "text")


VERSIONS_SQL = """
WITH linked AS (
  SELECT doc_id AS id_b, lag(doc_id) OVER (PARTITION BY split_part(text, chr(10), 1) ORDER BY doc_id) AS id_a, text
  FROM documents),
pairs AS (SELECT l.id_a, l.id_b, d.text AS text_a, l.text AS text_b FROM linked l JOIN documents d ON d.doc_id = l.id_a)
"""


def sql_scores(source: str, kinds: dict[str, str]) -> str:
    """CTE ``scores(id_a, id_b, <kind>_score...)``: multiset overlap of the units of ``ta`` and ``tb``."""
    parts = " UNION ALL ".join(
        f"SELECT id_a, id_b, '{kind}' AS kind, unnest({unit.format(col)}) AS unit, {one} AS na, {1 - one} AS nb FROM {source}"
        for kind, unit in kinds.items() for col, one in (("ta", 1), ("tb", 0)))
    cols = ", ".join(
        f"CASE WHEN coalesce(sum(na + nb) FILTER (kind = '{k}'), 0) = 0 THEN 1.0::DOUBLE ELSE 2.0::DOUBLE * "
        f"sum(least(na, nb)) FILTER (kind = '{k}') / sum(na + nb) FILTER (kind = '{k}') END AS {k}_score" for k in kinds)
    return (f", units AS ({parts}), counted AS (SELECT id_a, id_b, kind, unit, sum(na)::BIGINT AS na, sum(nb)::BIGINT AS nb "
            f"FROM units GROUP BY ALL), scores AS (SELECT s.id_a, s.id_b, {cols} FROM {source} s "
            f"LEFT JOIN counted c ON c.id_a = s.id_a AND c.id_b = s.id_b GROUP BY s.id_a, s.id_b)")


CHARS = "CASE WHEN {0} = '' THEN [] ELSE string_split({0}, '') END"
LINES = "list_filter(string_split({0}, chr(10)), lambda x: x <> '')"
MARKS = "regexp_extract_all({0}, '" + in_braces(tx.MARK) + "')"
KINDS_SQL = {"character": CHARS, "line": LINES, "token": TOKENS, "structure": MARKS}

SCORES_SQL = VERSIONS_SQL + f""", clean AS (
  SELECT id_a, id_b, {NORMAL.format('text_a')} AS ta, {NORMAL.format('text_b')} AS tb,
         {sql_strip('text_a')} = {sql_strip('text_b')} AS exact_match FROM pairs)
""" + sql_scores("clean", KINDS_SQL)


def scored_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = document_versions(spark, sf_dir).select(
        "id_a", "id_b", tx.normalise(F.col("text_a")).alias("a"), tx.normalise(F.col("text_b")).alias("b"),
        (tx.strip(F.col("text_a")) == tx.strip(F.col("text_b"))).alias("exact_match"))
    a, b = F.col("a"), F.col("b")
    units = {
        "line": (tx.line_units(a), tx.line_units(b)), "token": (tx.tokens(a), tx.tokens(b)),
        "structure": (tx.punctuation(a), tx.punctuation(b)),
    }
    return si.overlap_scores(pairs, ["id_a", "id_b", "exact_match"], units, {"character": (a, b)})


@query("pair_similarity", SCORES_SQL + """
SELECT d.doc_id AS id_b, coalesce(s.id_a, -1) AS id_a, coalesce(c.exact_match, false) AS exact_match, s.id_a IS NOT NULL AS comparison_available,
       character_score, line_score, token_score, structure_score
FROM documents d LEFT JOIN scores s ON s.id_b = d.doc_id LEFT JOIN clean c ON c.id_b = d.doc_id""")
def pair_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overlap scores of every document with its earlier version, if there is one."""
    documents = load(spark, sf_dir, "documents").select(F.col("doc_id").alias("id_b"))
    scored = scored_versions(spark, sf_dir)
    joined = wl.with_context(documents, scored, ["id_b"], "comparison_available")
    return joined.withColumns({"id_a": F.coalesce("id_a", F.lit(-1)),
                               "exact_match": F.coalesce("exact_match", F.lit(False))})


OVERALL_SQL = ("0.2::DOUBLE * character_score + 0.3::DOUBLE * line_score + 0.3::DOUBLE * token_score "
               "+ 0.2::DOUBLE * structure_score")


def overall_column() -> Column:
    return si.overall({name: F.col(f"{name}_score") for name in si.WEIGHTS})


@query("overall_similarity", SCORES_SQL + f"SELECT id_a, id_b, round({OVERALL_SQL}, 9) AS overall FROM scores")
def overall_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored_versions(spark, sf_dir).select("id_a", "id_b", F.round(overall_column(), 9).alias("overall"))


TIER_SQL = (SCORES_SQL + f""", tiers AS (
  SELECT d.doc_id, s.id_a IS NOT NULL AS available, coalesce(c.exact_match, false) AS exact_match, round({OVERALL_SQL}, 9) AS score
  FROM documents d LEFT JOIN scores s ON s.id_b = d.doc_id LEFT JOIN clean c ON c.id_b = d.doc_id)
""")


def tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pair_similarity(spark, sf_dir).select(
        F.col("id_b").alias("doc_id"), F.col("comparison_available").alias("available"),
        "exact_match", F.round(overall_column(), 9).alias("score"))


@query("tier_summary", TIER_SQL + """
SELECT count(*) AS compared, round(avg(score), 6) AS mean_score, count(*) FILTER (exact_match) AS exact,
       count(*) FILTER (score > 0.8) AS high, count(*) FILTER (score >= 0.5 AND score <= 0.8) AS medium,
       count(*) FILTER (score < 0.5) AS low FROM tiers WHERE available""")
def tier_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wl.similarity_summary(tiers(spark, sf_dir), F.col("score"), F.col("exact_match"), F.col("available"))


@query("tier_labels", TIER_SQL + """
SELECT doc_id, score, CASE WHEN NOT available THEN 'UNKNOWN' WHEN exact_match THEN 'EXACT' WHEN score > 0.8 THEN 'HIGH'
       WHEN score > 0.5 THEN 'MED' ELSE 'LOW' END AS tier FROM tiers""")
def tier_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = wl.tier(F.col("score"), F.col("exact_match"))
    return tiers(spark, sf_dir).select(
        "doc_id", "score", F.when(F.col("available"), label).otherwise("UNKNOWN").alias("tier"))


@query("exact_similarity")
def exact_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Matching-block ratios of every version pair, whole texts on both sides."""
    pairs = document_versions(spark, sf_dir).select(
        "id_a", "id_b", tx.normalise(F.col("text_a")).alias("a"), tx.normalise(F.col("text_b")).alias("b"))
    a, b = F.col("a"), F.col("b")
    ratios = si.exact_scores(pairs, ["id_a", "id_b"], {
        "character": (a, b), "line": (tx.line_units(a), tx.line_units(b)),
        "token": (tx.tokens(a), tx.tokens(b)), "structure": (tx.punctuation(a), tx.punctuation(b))})
    total = si.overall({name: F.col(f"{name}_ratio") for name in si.WEIGHTS})
    return ratios.withColumn("overall_ratio", total)


@query("sequence_overlap")
def sequence_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Longest ordered token overlap of every version pair."""
    a, b = tx.tokens(F.col("text_a")), tx.tokens(F.col("text_b"))
    return document_versions(spark, sf_dir).select("id_a", "id_b", si.common_length(a, b).alias("common"))


@query("page_structure", r"""
WITH linked AS (
  SELECT page_id AS id_b, html AS tb, lag(page_id) OVER (
    PARTITION BY regexp_extract(url, '^https?://([^/?#]+)', 1) ORDER BY page_id) AS id_a FROM pages),
pairs AS (SELECT l.id_a, l.id_b, p.html AS ta, l.tb FROM linked l JOIN pages p ON p.page_id = l.id_a)
""" + sql_scores("pairs", {"structure": "regexp_extract_all({0}, '</?[A-Za-z][A-Za-z0-9]*')"}) + """
SELECT id_a, id_b, structure_score FROM scores""")
def page_structure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tag structure of every page against the previous page of its host."""
    pages = load(spark, sf_dir, "pages").select("page_id", "url", "html")
    host = F.regexp_extract("url", r"^https?://([^/?#]+)", 1)
    pairs = si.versions(pages, host, "page_id", "html")
    units = {"structure": (tx.tags(F.col("text_a")), tx.tags(F.col("text_b")))}
    return si.overlap_scores(pairs, ["id_a", "id_b"], units)


@query("line_diff", VERSIONS_SQL + """, sides AS (
  SELECT id_a, id_b, '-' AS tag, string_split(text_a, chr(10)) AS ls FROM pairs
  UNION ALL SELECT id_a, id_b, '+', string_split(text_b, chr(10)) FROM pairs),
ls AS (SELECT id_a, id_b, tag, unnest(ls) AS line, generate_subscripts(ls, 1) - 1 AS line_no FROM sides),
k AS (SELECT *, row_number() OVER (PARTITION BY id_a, id_b, tag, line ORDER BY line_no) AS rn FROM ls)
SELECT x.id_a, x.id_b, x.tag, x.line_no, md5(x.line) AS digest FROM k x WHERE NOT EXISTS (
  SELECT 1 FROM k y WHERE y.id_a = x.id_a AND y.id_b = x.id_b AND y.line = x.line AND y.rn = x.rn AND y.tag <> x.tag)""")
def line_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    diff = si.line_diff(document_versions(spark, sf_dir), ["id_a", "id_b"], "text_a", "text_b")
    return diff.select("id_a", "id_b", "tag", "line_no", F.md5("line").alias("digest"))


@query("contamination_run", f"""
WITH d AS (SELECT doc_id, {TOKENS.format('text')} AS w FROM documents),
b AS (SELECT item_id, {TOKENS.format('text')} AS w FROM benchmark),
dt AS (SELECT doc_id, unnest(w) AS t, generate_subscripts(w, 1) AS i, w FROM d),
bt AS (SELECT item_id, unnest(w) AS t, generate_subscripts(w, 1) AS j, w FROM b),
dg AS (SELECT doc_id, i, array_to_string(w[i:i+4], chr(1)) AS g FROM dt WHERE i + 4 <= len(w)),
bg AS (SELECT item_id, j, array_to_string(w[j:j+4], chr(1)) AS g FROM bt WHERE j + 4 <= len(w)),
m AS (SELECT doc_id, item_id, i, i - j AS diag FROM dg JOIN bg ON dg.g = bg.g),
k AS (SELECT *, i - row_number() OVER (PARTITION BY doc_id, item_id, diag ORDER BY i) AS island FROM m),
r AS (SELECT doc_id, item_id, diag, island, count(*) + 4 AS run FROM k GROUP BY ALL)
SELECT doc_id, item_id, max(run) AS longest_run, count(*) AS runs FROM r GROUP BY ALL""")
def contamination_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = tx.tokens(F.col("text"))
    documents = spread(load(spark, sf_dir, "documents").select("doc_id", "text"))
    return si.shared_runs(documents, load(spark, sf_dir, "benchmark"),
                          "doc_id", "item_id", words, words, 5)
