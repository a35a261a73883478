import hashlib
import random
import re
import string
from collections import Counter

import numpy as np

from tallyloom.llm import plans, quality, secrets

from .rules import words

SF = "/root/testdata/sf0.001"


def base_counts(text):
    w = words(text)
    three = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    covered = {i + k for i in range(len(w) - 2) if three[tuple(w[i : i + 3])] > 1 for k in range(3)}
    seen, twice = set(), 0
    for line in (text or "").split("\n"):
        twice += bool(words(line)) and line in seen
        seen.add(line)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), twice, len(covered)


def test_counts_and_verdicts(spark):
    pick = random.Random(2)
    odd = [None, "", " \n\t ", "a a a a", "a a a a\n\na a a a\n\n a a a a", "é" * 30, "x" * 100_000, "w " * 40_000, "#|<> & $" * 9, "a b c\r\na b c\r\na b c"]
    prose = [" ".join(pick.choice(["the", "of", *(f"{c}{pick.randrange(900)}" for c in ("mo", "ne", "li", "ka"))]) for _ in range(120)) for _ in range(200)]
    shout = [" ".join(x.upper() + "!!" for x in p.split()) for p in prose[:12]]
    noise = [" ".join(x + "***" for x in p.split()) for p in prose[12:24]]
    rows = list(enumerate(odd + prose + shout + noise)) + [(None, prose[0]), (3, "a a a a")]
    docs = spark.createDataFrame([(i, t, "x", True) for i, t in rows], "doc_id long, text string, n_words string, kept boolean").repartition(4)
    got = quality.judge(docs).collect()
    assert len(got) == len(rows)
    texts = dict(rows)
    for r in got:
        want = base_counts(texts[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0])
        assert r.kept is (not r.base_failed and r.posterior >= 0.5)
    by = {r.doc_id: r.kept for r in got if r.doc_id is not None}
    first = len(odd)
    assert all(by[i] for i in range(first, first + 200)) and not any(by[i] for i in range(first + 200, first + 224))
    assert quality.judge(docs.limit(0)).count() == 0


def test_expectation_maximisation_finds_the_accuracies():
    draw = np.random.default_rng(3)
    good = draw.random(40_000) < 0.85
    right_good, right_bad, speaks = [0.95, 0.9, 0.97, 0.99, 0.92], [0.8, 0.7, 0.9, 0.6, 0.85], [1, 0.8, 0.9, 0.7, 1]
    votes = np.zeros((len(good), 5), np.int64)
    for j in range(5):
        right = draw.random(len(good)) < np.where(good, right_good[j], right_bad[j])
        votes[:, j] = np.where(right == good, 1, -1) * (draw.random(len(good)) < speaks[j])
    patterns, counts = np.unique(votes, axis=0, return_counts=True)
    model = quality.expectation_maximisation(patterns, counts.astype(float))
    assert abs(model.prior - 0.85) < 0.02
    assert np.abs(model.on_good[:, 1] - right_good).max() < 0.03 and np.abs(model.on_bad[:, 0] - right_bad).max() < 0.06
    assert ((model.log_odds(votes) > 0) == good).mean() > 0.97


def test_clean_documents_stay_and_bad_ones_go(spark):
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    got = plans.op3_quality_rules(spark, "/root/testdata/sf0.01").join(labels, "doc_id").filter("not base_failed").toPandas()
    assert got[got.quality == 1].kept.mean() >= 0.98
    assert got[got.quality == 0].kept.mean() <= 0.3


def plain_model(rows, steps=2000):
    """Expectation-maximisation document by document, in plain numbers; rows are lists of votes."""
    m = len(rows[0])
    good = [(sum(v > 0 for v in r) + 1) / (sum(v != 0 for v in r) + 2) for r in rows]
    for _ in range(steps):
        prior = (sum(good) + 9) / (len(rows) + 10)
        right = {}
        for kind, weight, drawn in ((1, good, {-1: 0.02, 1: 9.98}), (0, [1 - g for g in good], {-1: 4, 1: 6})):
            for j in range(m):
                n = {v: drawn[v] + sum(w for w, r in zip(weight, rows, strict=True) if r[j] == v) for v in (-1, 1)}
                right[kind, j] = {v: n[v] / (n[-1] + n[1]) for v in n}
        before, good = good, []
        for r in rows:
            a, b = prior, 1 - prior
            for j, v in enumerate(r):
                if v:
                    a, b = a * right[1, j][v], b * right[0, j][v]
            good.append(a / (a + b))
        if max(abs(x - y) for x, y in zip(before, good, strict=True)) < 1e-11:
            break
    return good


def plain_vote(row, rule):
    value, good_from, good_to, bad_below, bad_above = rule
    top, _, under = value.partition(" / ")
    if under and not row[under]:
        return 0
    x = row[top] / row[under] if under else row[top]
    if bad_below is not None and x < bad_below or bad_above is not None and x > bad_above:
        return -1
    return int((good_from is None or x >= good_from) and (good_to is None or x <= good_to))


def test_query_equals_a_plain_model(spark):
    got = plans.op3_quality_rules(spark, SF).collect()
    counts = {r.doc_id: r for r in quality.features(spark.read.parquet(f"{SF}/documents.parquet")).collect()}
    votes = [[plain_vote(counts[r.doc_id], rule) for rule in quality.RULES.values()] for r in got]
    for r, want in zip(got, plain_model(votes), strict=True):
        assert abs(r.posterior - want) < 1e-6
        assert r.kept is (not r.base_failed and want >= 0.5)


def test_posterior_weighs_votes_and_overrules_a_lone_one(spark):
    """Short documents are mostly good by their labels: the one vote against them is overruled."""
    sf = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    got = quality.judge(docs).join(labels, "doc_id").toPandas()
    votes = np.array([[plain_vote(r, rule) for rule in quality.RULES.values()] for r in got.to_dict("records")])
    against, said = (votes < 0).sum(1), got.posterior >= 0.5
    assert said[against == 0].all() and not said[against >= 3].any()
    lone = (against == 1) & (votes[:, 0] < 0)
    assert lone.sum() > 5 and said[lone].all() and got.quality[lone].mean() > 0.8
    assert ((got.quality == 1) == said).mean() > 0.95
    right = {r.rule: r for r in quality.accuracies(docs).collect()}
    assert list(right) == list(quality.RULES) and right["symbols"].right_on_good > 0.99 and right["symbols"].right_on_bad > 0.4
    assert right["length"].right_on_bad < 0.2  # a weak rule is found out


def test_keys_named_like_a_count_and_empty_tables(spark):
    docs = spark.createDataFrame([("a", "x y z " * 30), (None, None)], "n_words string, _text string")
    got = quality.judge(docs, "n_words", "_text")
    assert got.columns.count("n_words") == 1 and sorted(str(r.n_words) for r in got.collect()) == ["None", "a"]
    empty = quality.accuracies(docs.limit(0), "_text").collect()
    assert len(empty) == len(quality.RULES) and all((r.right_on_good, r.right_on_bad) == (0.998, 0.4) for r in empty)


def base_spans(text):
    out = []
    for kind, pattern, least, group in (
        ("assign", r"""((?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy]))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 8, 2),
        ("access", r"AKIA[A-Z0-9]+", 16, 0), ("hex", r"[0-9a-f]+", 32, 0)):
        out += [(m.start(), ["assign", "access", "hex"].index(kind), m.end(), kind) for m in re.finditer(pattern, text or "") if len(m[group]) >= least]
    return ",".join(f"{k}:{a}:{b}" for a, _, b, k in sorted(out)), Counter(k for *_, k in out)


def test_base_spans_and_random_keys(spark):
    pick = random.Random(7)
    keys = ["".join(pick.choice(string.ascii_letters + string.digits) for _ in range(40)) for _ in range(120)]
    texts = ["password=hunter2hunter2 é token : 'abcdefgh' API_KEY=\"short\" apikey=12345678", "AKIA" + "A" * 11, "AKIA" + "A7" * 8, "deadbeef" * 4,
             "g" + "0" * 31 + "x" + "a" * 32, "tokentoken=abcdefghi secret=secret=abcdefgh", None, "", "中" * 50 + "passwd:" + "q" * 9,
             "card 4041894974608795 and " + "longwordwithoutanynumber" * 3, "f" * 100_000]
    texts += [f"the key is {k} here" for k in keys]
    parts = "inter nation al iza tion un contro vers ial ly mis under stand ings dis pro por ate char acter istic counter revolu ary".split()
    texts += [" ".join("".join(pick.choice(parts) for _ in range(pick.randint(4, 6))) for _ in range(30)) for _ in range(400)]
    docs = spark.createDataFrame([(i, t, 0, "x") for i, t in enumerate(texts)] + [(None, texts[0], 0, "x")], "doc_id long, text string, n_hex int, found string").repartition(4)
    got = {r.doc_id: r for r in secrets.digests(docs).collect()}
    assert len(got) == len(texts) + 1
    for i, text in enumerate(texts):
        want, n = base_spans(text)
        r = got[i]
        assert (r.n_assign, r.n_access, r.n_hex) == (n["assign"], n["access"], n["hex"]), text
        assert r.base_sha256 == hashlib.sha256(want.encode()).hexdigest()
        assert ",".join(s for s in r.spans.split(",") if s and not s.startswith("random")) == want
    found = sum("random:11:51" == got[11 + i].spans for i in range(120))
    assert found >= 60 and not any("random" in got[11 + 120 + i].spans for i in range(400)) and "random" not in got[9].spans
    assert secrets.digests(docs.limit(0)).count() == 0


def syllables(pick, n):
    parts = "inter nation al iza tion un contro vers ial ly mis under stand ings dis pro por ate char acter istic counter revolu ary".split()
    return " ".join("".join(pick.choice(parts) for _ in range(pick.randint(1, 5))) for _ in range(n))


def test_keys_after_names_in_paths_and_without_digits(spark):
    pick = random.Random(11)
    alnum = string.ascii_letters + string.digits

    def key(letters, n=40):
        return "".join(pick.choice(letters) for _ in range(n))

    keys = {"named": [("KEY_NAME=", key(alnum + "+/"), "") for _ in range(60)], "query": [("http://site?auth=", key(alnum), "") for _ in range(60)],
            "padded": [("name=", key(alnum, 38), "==") for _ in range(60)], "path": [("some_name/", key(alnum), "/last-part") for _ in range(60)],
            "letters": [("", key(string.ascii_letters), "") for _ in range(60)]}
    rows = [(kind, f"{syllables(pick, 4)} ", *k) for kind, some in keys.items() for k in some]
    texts = [before + a + k + b + " here" for _, before, a, k, b in rows] + [syllables(pick, 60) for _ in range(600)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    got = {r.doc_id: r.spans for r in secrets.digests(docs).collect()}
    found = Counter()
    for i, (kind, before, a, k, b) in enumerate(rows):
        at = len(before + a)
        spans = [tuple(map(int, s.split(":")[1:])) for s in got[i].split(",") if s.startswith("random")]
        found[kind] += any(x <= at and at + len(k) <= y for x, y in spans)
    assert all(found[kind] >= 30 for kind in keys), found
    assert sum("random" in got[len(rows) + i] for i in range(600)) <= 6


def test_strings_of_a_run():
    key = "Zk3v9QpL7xW2mT8bN4rY6cHd"
    for run, want in (("sig=" + key, [key]), ("AWS_SECRET_ACCESS_KEY=" + key + "==", ["AWS_SECRET_ACCESS_KEY", key + "=="]), (key, [key]),
                      ("a-b/" + key + "/c_d", ["b/" + key + "/c", key]), ("x=1=" + key, [key])):
        assert sorted({run[a:b] for a, b in secrets.parts(run)}) == sorted(want)


def test_null_distribution_is_all_letters():
    pick = random.Random(5)
    texts = [syllables(pick, 900).title() + " x1y " + "a" * 500 + " " + syllables(pick, n) + " ABCDEF" * n for n in (1, 40, 300)] + [None, "", "é1 no 2"]
    letters = ["".join(re.findall("[A-Za-z]", " ".join(w for w in (t or "").split() if not re.search(r"\d", w)))) for t in texts]
    for c, bins in secrets.null_counts(texts).items():
        cut = [x[i : i + c] for x in letters for i in range(0, len(x) - c + 1, c)]
        want = np.sort([secrets.distance(w, secrets.encoding(w)) for w in cut])
        rows = np.frombuffer("".join(cut).encode(), np.uint8).reshape(-1, c)
        assert bins.sum() == len(cut) > 20 and np.allclose(np.sort(secrets.distances(rows)), want)
    assert secrets.null_counts(["f" * 2_000_000])[128].sum() == 15_625


def test_one_rule_for_every_number_of_words():
    """One more string of words hardly moves the limit of a class."""
    def last(n):
        words = [(secrets.NULL, 16, place, 40) for place in range(60, 160)] + [(secrets.NULL, 32, 150, n)]
        return secrets.limits(words + [(secrets.WITH_DIGIT, 32, place, 1) for place in range(40, 160)])[secrets.WITH_DIGIT, 32]
    got = [last(n) for n in range(290, 311)]
    assert max(got) - min(got) <= 1


def test_a_rare_key_among_many_candidates(spark):
    pick = random.Random(13)
    keys = ["".join(pick.choice(string.ascii_letters + string.digits) for _ in range(64)) for _ in range(8)]
    texts = [f"a {k} b" for k in keys] + [syllables(pick, 3000) + " " + " ".join("counter" * 9 + str(pick.randrange(10)) for _ in range(30)) for _ in range(80)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    got = {r.doc_id: r.spans for r in secrets.digests(docs).collect()}
    assert sum(got[i] == "random:2:66" for i in range(8)) >= 4 and not any("random" in got[i] for i in range(8, 88))


def test_battery_tells_random_from_regular():
    pick = random.Random(1)
    far = [secrets.distance(x, secrets.encoding(x)) for x in ("abababababababab1212", "0123456789abcdefghij", "aaaaaaaaaaaaaaaaaaaaaaaa1", "counterrevolutionaries2")]
    near = [secrets.distance(x, secrets.encoding(x)) for x in
            ("".join(pick.choice(string.ascii_letters + string.digits) for _ in range(32)) for _ in range(200))]
    assert np.median(near) < 6 and min(far) > 1.5 * np.median(near)


def test_secret_query(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    for r in plans.op8_secret_scan(spark, SF).collect():
        assert r.base_sha256 == hashlib.sha256(base_spans(docs[r.doc_id])[0].encode()).hexdigest()
