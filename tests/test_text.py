"""Text functions and pair operators against plain Python rules."""

import random
import re
from collections import Counter
from difflib import SequenceMatcher

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyloom.functions import text as tx
from tallyloom.operators import similarity as si
from tallyloom.operators import worklist as wl


def column(spark, texts, build):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i bigint, t string")
    return [r.o for r in df.select("i", build(F.col("t")).alias("o")).orderBy("i").collect()]


#: lines and what is left of them without the comment
COMMENTS = [
    ("a = 1  # one", "a = 1"), ("b = '#no' # yes", "b = '#no'"), ('x = "it\'s # in" # out', 'x = "it\'s # in"'), ("'open # stays", "'open # stays"),
    ("a \\' # cut", "a \\'"), ("q = 'a\\'#b' # c", "q = 'a\\'#b'"), ("\u00a0wide # gone", "wide"), ("###", ""), ("", ""), ("  ", ""),
    ("no comment", "no comment"), ('"a" "b" # c', '"a" "b"'), ("''#x", "''"), ('"\'" # y', '"\'"'), ("\\# z", "\\"), ("\\\\' # still one", "\\\\'"),
    ("'a' '#' \"#\" # d # e", "'a' '#' \"#\""), ("x#", "x"), ("tab\t#\t", "tab"),
]


def test_normalise(spark):
    lines = [line for line, _ in COMMENTS]
    assert column(spark, lines, tx.normalise) == [left for _, left in COMMENTS]
    together = ["\n".join(lines), "\n".join(reversed(lines)), "long " * 30_000 + "# tail", "\n \n"]
    left = [left for _, left in COMMENTS if left]
    assert column(spark, together, tx.normalise) == ["\n".join(left), "\n".join(reversed(left)), ("long " * 30_000).strip(), ""]


def test_tokens_and_units(spark):
    texts = ["x_1 = f(a, 'b')  # ok", "Été ça_va: 3½ !", "", " \t", "a\nb\n\n c ", "prix\u00a012\u202f€", "全\u3000角", "a\u2003b\x1cc\x85d"]
    assert column(spark, texts, tx.tokens) == [re.findall(r"\w+|[^\w\s]", t) for t in texts]
    assert column(spark, texts, tx.characters) == [list(t) for t in texts]
    assert column(spark, texts, tx.line_units) == [[x.strip() for x in t.split("\n") if x.strip()] for t in texts]


@pytest.mark.parametrize(("text", "pieces"), [
    ("", [""]), ("short", ["short"]), ("one two three", ["one two", " three"]), ("abcdefghij", ["abcdefg", "hij"]),
    (" yyyyyyyyy z", [" yyyyyy", "yyy z"]), ("a b c d e f", ["a b c d", " e f"]), ("1234567 8", ["1234567", " 8"]),
])
def test_wrap_by_hand(spark, text, pieces):
    assert column(spark, [text], lambda t: tx.wrap(t, 7)) == [pieces]


@pytest.mark.parametrize("cols", [1, 7, 50])
def test_wrap_properties(spark, cols):
    """Pieces add up to the text, none is too long, and each ends at the last space that fits, if there is one."""
    rng = random.Random(6)
    texts = ["".join(rng.choice("ab  \né") for _ in range(rng.randrange(120))) for _ in range(200)]
    texts += ["", "short", "x" * 130, " " + "y" * 60 + " z", "one two\nthree " * 20]
    for text, got in zip(texts, column(spark, texts, lambda t: tx.wrap(t, cols)), strict=True):
        assert "".join(got) == text and all(len(p) <= cols for p in got)
        for i, piece in enumerate(got[:-1]):
            reach = "".join(got[i:])[1 : cols + 1]
            if " " in reach:
                assert got[i + 1][0] == " " and " " not in reach[len(piece) :]
            else:
                assert len(piece) == cols


def test_code_block(spark):
    f = "```"
    cases = {
        f"Here:\n{f}python\nx = 1\n{f}\n{f}python\ny\n{f}": "x = 1",
        f"{f}\nab\n{f} and {f}\nlonger one\n{f}": "longer one",
        f"{f}\naa\n{f} {f}\nbb\n{f}": "aa",
        "text\ndef f(x):\n    return x\n\n  odd\ndef g():\n\treturn 1\nafter\n    no": "def f(x):\n    return x\n\n  odd\ndef g():\n\treturn 1",
        f"one {f} fence only": f"one {f} fence only",
        "  just text \n": "just text",
        "": "",
        "def f():\n" + "    x = 1\n" * 20_000 + "end": "def f():\n" + "    x = 1\n" * 19_999 + "    x = 1",
    }
    assert column(spark, list(cases), tx.code_block) == list(cases.values())


def test_bare_code(spark):
    f = "```"
    cases = {f"{f}python\nx = 1\n{f}\n": "x = 1", f"{f}\na\nb\n{f}": "a\nb", f"{f} a{f}": "a", "  plain ": "plain",
             f"say {f}x{f}": f"say {f}x{f}"}
    assert column(spark, list(cases), tx.bare_code) == list(cases.values())


def test_verdicts(spark):
    rows = [
        ("VALIDATION: PASSED\nISSUES: None", True, "old", False),
        ("VALIDATION: FAILED\nCORRECTED_CODE:\n```python\nnew\n```", False, "new", False),
        ("VALIDATION: PASSED\nCORRECTED_CODE:", True, "old", True),
        ("VALIDATION: PASSED\nCORRECTED_CODE: \n ", True, "old", True),
        ("CORRECTED_CODE: a CORRECTED_CODE: b", False, "a", False),
        ("nothing", False, "old", False),
    ]
    df = spark.createDataFrame([(i, r[0]) for i, r in enumerate(rows)], "i bigint, t string")
    parts = tx.verdict_parts(F.col("t"), F.lit("old"))
    got = df.select("i", *[c.alias(n) for n, c in parts.items()]).orderBy("i").collect()
    assert [tuple(r)[1:] for r in got] == [r[1:] for r in rows]


def test_messages_and_request(spark):
    texts = ["Error 429", "QUOTA exceeded", "generate it", "rate limit", "fine", "limits", "érate"]
    assert column(spark, texts, tx.is_rate_limited) == [True, True, True, True, False, True, True]
    assert column(spark, texts, lambda t: tx.is_rate_limited(t, True)) == [True, True, False, True, False, False, False]
    build = lambda t: tx.request_text("Do {t}.{context}!", "Note:", {"t": t}, F.when(t != "fine", F.upper(t)))
    assert column(spark, ["a", "fine"], build) == ["Do a.\nNote:\nA!", "Do fine.!"]


def test_tiers_and_status(spark):
    scores = spark.createDataFrame([(0.5, False), (0.51, False), (0.8, False), (0.81, False), (0.1, True)],
                                   "s double, e boolean")
    assert [r.t for r in scores.select(wl.tier(F.col("s"), F.col("e")).alias("t")).collect()] == [
        "LOW", "MED", "MED", "HIGH", "EXACT"]
    summary = wl.similarity_summary(scores, F.col("s"), F.col("e"), F.lit(True)).first()
    assert (summary.compared, summary.exact, summary.high, summary.medium, summary.low) == (5, 1, 1, 3, 1)
    flags = spark.createDataFrame([(None, None, None), (False, None, True), (True, True, True), (True, None, True)],
                                  "ok boolean, passed boolean, known boolean")
    got = flags.select(wl.outcome(F.col("ok"), F.col("passed"), F.col("known")).alias("s")).collect()
    assert [r.s for r in got] == ["UNKNOWN", "FAILED", "PASSED", "NEEDS_REVIEW"]


# --- pairs -------------------------------------------------------------------------------------------

def word_pairs(seed, n=60, alphabet="abc", longest=40):
    rng = random.Random(seed)
    make = lambda: [rng.choice(alphabet) for _ in range(rng.randrange(longest))]
    return [(make(), make()) for _ in range(n)]


def common(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        above = row[:]
        for j, y in enumerate(b, 1):
            row[j] = above[j - 1] + 1 if x == y else max(above[j], row[j - 1])
    return row[-1]


def run(a, b):
    best, row = 0, [0] * (len(b) + 1)
    for x in a:
        row = [0] + [row[j - 1] + 1 if x == y else 0 for j, y in enumerate(b, 1)]
        best = max(best, max(row))
    return best


def test_scores_bound_the_exact_ratio(spark):
    pairs = word_pairs(7) + [([], []), (["a"], []), (list("witch"), list("sandwich"))]
    df = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pairs)], "i bigint, a array<string>, b array<string>")
    units = {"token": (F.col("a"), F.col("b"))}
    upper = {r.i: r.token_score for r in si.overlap_scores(df, ["i"], units).collect()}
    exact = {r.i: r.token_ratio for r in si.exact_scores(df, ["i"], units).collect()}
    for i, (a, b) in enumerate(pairs):
        both = sum((Counter(a) & Counter(b)).values())
        assert upper[i] == pytest.approx(2 * both / (len(a) + len(b)) if a or b else 1.0)
        assert exact[i] == pytest.approx(SequenceMatcher(None, a, b).ratio())
        assert upper[i] >= exact[i] - 1e-12
    lengths = {r.i: r.n for r in df.select("i", si.common_length("a", "b").alias("n")).collect()}
    assert lengths == {i: common(a, b) for i, (a, b) in enumerate(pairs)}


@pytest.mark.parametrize("n", [1, 3])
def test_shared_runs(spark, n):
    rng = random.Random(8)
    make = lambda count: [(i, "".join(rng.choice("aab") for _ in range(rng.randrange(30)))) for i in range(count)]
    left, right = make(15) + [(90, "a" * 25), (91, "witch")], make(12) + [(90, "a" * 18), (91, "sandwich")]
    a = spark.createDataFrame(left, "l bigint, t string")
    b = spark.createDataFrame(right, "r bigint, t string")
    units = tx.characters(F.col("t"))
    got = {(r.l, r.r): r.longest_run for r in si.shared_runs(a, b, "l", "r", units, units, n).collect()}
    want = {(i, j): run(s, t) for i, s in left for j, t in right}
    assert got == {k: v for k, v in want.items() if v >= n}


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        above, row = row, [i]
        for j, y in enumerate(b, 1):
            row.append(min(above[j] + 1, row[-1] + 1, above[j - 1] + (x != y)))
    return row[-1]


@pytest.mark.parametrize("d", [1, 2, 4])
def test_fuzzy_pairs(spark, d):
    rng = random.Random(9)
    words = {"".join(rng.choice("abcd") for _ in range(rng.randrange(1, 14))) for _ in range(150)}
    words |= {"electron", "neutron", "kitten", "sitting", "", "hello", "olleh"}
    df = spark.createDataFrame([(w,) for w in [*words, "hello"]], "w string")
    got = {(r.name_a, r.name_b): r.distance for r in si.fuzzy_pairs(df, "w", d).collect()}
    want = {(a, b): edits(a, b) for a in words for b in words if a < b}
    assert got == {k: v for k, v in want.items() if v <= d}


def test_fuzzy_pairs_of_short_strings(spark):
    words = {a + b + c for a in ("", "a", "b", "é") for b in ("", "a", "c", "中") for c in ("", "b", "aa")}
    df = spark.createDataFrame([(w,) for w in [*words, None, None, "a"]], "w string")
    got = {(r.name_a, r.name_b): r.distance for r in si.fuzzy_pairs(df, "w", 2).collect()}
    assert got == {(a, b): edits(a, b) for a in words for b in words if a < b and edits(a, b) <= 2}
    assert si.fuzzy_pairs(df.limit(0), "w", 2).count() == 0
    plan = si.fuzzy_pairs(df, "w", 2)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_deletions(spark):
    row = spark.createDataFrame([("abca", "", "x")], "w string, e string, x string").select(
        si.deletions(F.col("w"), 2).alias("w"), si.deletions(F.col("e"), 2).alias("e"), si.deletions(F.col("x"), 3).alias("x"))
    want = {"abca", "bca", "aca", "aba", "abc", "ca", "ba", "bc", "aa", "ac", "ab"}
    hashes = {r.h for r in spark.createDataFrame([(v,) for v in want], "v string").select(F.xxhash64("v").alias("h")).collect()}
    got = row.first()
    assert set(got.w) == hashes and len(got.e) == 1 and len(got.x) == 2


def test_line_diff(spark):
    pairs = [(1, "a\nb\na\nc", "a\nc\nc"), (2, "same\n", "same\n"), (3, "", "x")]
    df = spark.createDataFrame(pairs, "i bigint, t string, u string")
    got = sorted((r.i, r.tag, r.line_no, r.line) for r in si.line_diff(df, ["i"], "t", "u").collect())
    assert got == [(1, "+", 2, "c"), (1, "-", 1, "b"), (1, "-", 2, "a"), (3, "+", 0, "x"), (3, "-", 0, "")]


def test_versions_chain_in_a_hot_key(spark):
    spark.conf.set("spark.tallyloom.maxGroupRows", "10")
    try:
        df = spark.createDataFrame([(i, f"k{0 if i % 3 else i}", f"text {i}") for i in range(90)], "id bigint, k string, t string")
        got = {(r.id_a, r.id_b, r.text_a, r.text_b) for r in si.versions(df, F.col("k"), "id", "t").collect()}
    finally:
        spark.conf.unset("spark.tallyloom.maxGroupRows")
    hot = [i for i in range(90) if i % 3 or i == 0]
    assert got == {(a, b, f"text {a}", f"text {b}") for a, b in zip(hot, hot[1:])}


def test_matching_ratio_of_odd_rows(spark):
    from difflib import SequenceMatcher

    rows = [("abcd", "bcde"), (None, None), (None, "x"), ("", ""), ("é中\U0001f600a", "中\U0001f600b"), ("a" * 5000, "a" * 4000 + "b"), ("x y " * 80, "y x " * 90)]
    df = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(rows)], "i int, a string, b string")
    words = lambda c: F.split(F.coalesce(c, F.lit("")), " ")
    got = {r.i: r for r in si.exact_scores(df, ["i"], {"text": (F.col("a"), F.col("b")), "word": (words(F.col("a")), words(F.col("b")))}).collect()}
    for i, (a, b) in enumerate(rows):
        a, b = a or "", b or ""
        assert got[i].text_ratio == pytest.approx(SequenceMatcher(None, a, b).ratio(), abs=1e-12)
        assert got[i].word_ratio == pytest.approx(SequenceMatcher(None, a.split(" "), b.split(" ")).ratio(), abs=1e-12)


def test_exact_similarity_equals_the_plain_rule(spark):
    """The whole query against the standard matcher, pair by pair."""
    from difflib import SequenceMatcher

    from tallyloom.functions import text as tx
    from tallyloom.plans import text_plans

    where = "/root/testdata/sf0.001"
    got = {(r.id_a, r.id_b): r for r in text_plans.exact_similarity(spark, where).collect()}
    pairs = text_plans.document_versions(spark, where).select("id_a", "id_b", tx.normalise(F.col("text_a")).alias("a"), tx.normalise(F.col("text_b")).alias("b"))
    a, b = F.col("a"), F.col("b")
    rows = pairs.select("id_a", "id_b", F.struct("a", tx.line_units(a).alias("l"), tx.tokens(a).alias("t"), tx.punctuation(a).alias("p")).alias("a"),
                        F.struct(b, tx.line_units(b).alias("l"), tx.tokens(b).alias("t"), tx.punctuation(b).alias("p")).alias("b")).collect()
    assert len(rows) == len(got) > 0
    weights = [si.WEIGHTS[k] for k in ("character", "line", "token", "structure")]
    for r in rows:
        want = [SequenceMatcher(None, x, y).ratio() for x, y in zip(tuple(r.a), tuple(r.b))]
        found = got[r.id_a, r.id_b]
        assert [found.character_ratio, found.line_ratio, found.token_ratio, found.structure_ratio] == pytest.approx(want, abs=1e-12)
        assert found.overall_ratio == pytest.approx(sum(w * x for w, x in zip(weights, want)), abs=1e-9)


def test_overlap_of_shared_ids_nulls_and_wide_characters(spark):
    """Rows sharing their ids are one pair; a null side gives 1.0 by units and null by characters."""
    rows = [(1, "aé中\U0001f600", "a中中", ["x", "y", "x"], ["x", None]), (2, "ab", "ba", ["p"], ["q"]), (2, "ba", "ab", ["q"], ["q"]),
            (3, None, "b", ["x"], []), (4, "", "", [], []), (5, "b", "b", None, ["x"]), (None, "c", "d", ["x"], ["x"])]
    df = spark.createDataFrame(rows, "i int, a string, b string, u array<string>, v array<string>").repartition(3)
    got = {r.i: (r.character_score, r.unit_score) for r in si.overlap_scores(
        df, ["i"], {"unit": (F.col("u"), F.col("v"))}, {"character": (F.col("a"), F.col("b"))}).collect()}
    assert got == {1: (4 / 7, 0.4), 2: (1.0, 0.5), 3: (None, 0.0), 4: (1.0, 1.0), 5: (1.0, 1.0), None: (0.0, 1.0)}


def test_pairs_go_to_python_in_bounded_batches(spark, monkeypatch):
    """Whole texts of many pairs are never in one batch, and the session's own setting stays."""
    monkeypatch.setitem(si.BATCH, "spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    df = spark.range(100).repartition(1).select("id", F.lit("ab").alias("a"), F.lit("ba").alias("b"))
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    got = si._by_row(df, ["id"], {"n": (F.col("a"), F.col("b"))}, "rows", lambda left, _: np.full(len(left[1]), float(len(left[1])))).collect()
    assert len(got) == 100 and max(r.n_rows for r in got) <= 7
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == before
