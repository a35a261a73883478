import math

import numpy as np
import pyarrow as pa

from tallyloom.llm import plans, toxicity


def test_ftrl_equals_the_textbook_rule():
    """Per-coordinate updates written out one by one."""
    rows = [np.array(x, np.int64) for x in ([1, 2], [2, 3, 4], [1], [4], [], [2, 4])]
    labels = np.array([1.0, 0, 1, 0, 1, 1])
    z, n = np.zeros(6), np.zeros(6)
    toxicity.ftrl(rows, labels, z, n)
    zz, nn = [0.0] * 6, [0.0] * 6
    for x, y in zip(rows, labels, strict=True):
        def weight(i, l1=toxicity.L1):
            if abs(zz[i]) <= l1:
                return 0.0
            return -(zz[i] - math.copysign(l1, zz[i])) / ((toxicity.BETA + math.sqrt(nn[i])) / toxicity.ALPHA + toxicity.L2)
        w = {int(i): weight(int(i)) for i in x} | {5: weight(5, 0.0)}
        g = 1 / (1 + math.exp(-sum(w.values()))) - y
        for i, wi in w.items():
            sigma = (math.sqrt(nn[i] + g * g) - math.sqrt(nn[i])) / toxicity.ALPHA
            zz[i] += g - sigma * wi
            nn[i] += g * g
    assert np.allclose(z, zz) and np.allclose(n, nn)


def test_features_are_words_pairs_and_skips():
    flat, offsets = toxicity.features(pa.array(["a b c d", "A, b! c; d.", None, "", "a a a a", "d c b a"]))
    sets = [set(flat[a:b].tolist()) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
    assert [len(s) for s in sets] == [10, 10, 0, 0, 4, 10]  # 4 words, 3 pairs, 2 and 1 skips
    assert sets[0] == sets[1] and len(sets[0] & sets[5]) == 4


def test_learns_generalises_and_stays_sparse(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.fit_from(docs, labels)
    assert 0 < len(model[0]) < 5_000
    held = toxicity.score(docs, model).filter(toxicity.held_out()).join(labels, "doc_id").toPandas()
    found, bad = held.score >= toxicity.TOXIC, held.toxic == 1
    assert bad.sum() > 50 and (found & bad).sum() >= 0.85 * bad.sum() and (found & ~bad).sum() <= 0.02 * (~bad).sum()


def test_odd_rows(spark):
    rows = [(1, "idiot " * 30, 1, 0.5), (2, "nice day", 0, 0.1), (None, "null key", 1, 0.0), (4, None, 1, 0.0), (5, "", 0, 0.0), (6, "x " * 50_000, 0, 1.0)]
    docs = spark.createDataFrame(rows * 3, "doc_id long, text string, label int, score double")
    labels = spark.createDataFrame([(i, i % 2) for i in range(1, 7)] + [(None, 1), (1, None)], "doc_id long, toxic int")
    out = toxicity.score(docs, toxicity.fit_from(docs, labels))
    assert out.columns == ["doc_id", "text", "label", "score"] and out.count() == 18
    assert all(0 <= r.score <= 1 for r in out.collect())
    none = toxicity.fit_from(docs.limit(0), labels)
    assert len(none[0]) == 0 and {r.score for r in toxicity.score(docs, none).collect()} == {0.5}
    assert toxicity.score(docs.limit(0), none).count() == 0


def test_labels_of_held_out_rows_are_not_used(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    flipped = labels.withColumn("toxic", toxicity.F.when(toxicity.held_out(), 1 - toxicity.F.col("toxic")).otherwise(toxicity.F.col("toxic")))
    a, b = toxicity.fit_from(docs, labels), toxicity.fit_from(docs.repartition(3), flipped)
    assert (a[0] == b[0]).all() and (a[1] == b[1]).all() and a[2] == b[2]


def test_query(spark):
    import zlib

    got = plans.op9_toxicity(spark, "/root/testdata/sf0.001").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and r.predicted == int(r.score >= 0.3) for r in got)


def test_columns_of_any_name_and_a_key_with_several_texts(spark):
    rows = [(i % 7, "idiot " * 5 if i % 2 else "fine words", i, "a", "b") for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, at long, _text string, x string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(7)], "doc_id long, toxic int")
    model = toxicity.fit_from(docs, labels, sample=20)
    got = toxicity.score(docs, model)
    assert got.columns == [*docs.columns, "score"] and got.count() == 200
    assert set(got.drop("score").collect()) == set(docs.collect())


def test_the_sample_is_that_of_the_least_hashes(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    known = labels.filter(~toxicity.held_out()).select("doc_id", toxicity.order_of(toxicity.F.col("doc_id")).alias("h")).join(docs, "doc_id")
    least = known.orderBy("h").limit(50).select("doc_id")
    a, b = toxicity.fit_from(docs, labels, sample=50), toxicity.fit_from(docs.join(least, "doc_id"), labels)
    assert (a[0] == b[0]).all() and (a[1] == b[1]).all() and a[2] == b[2]
    c = toxicity.fit(docs.join(labels, "doc_id").join(least, "doc_id"), label="toxic", sample=50)
    assert (a[0] == c[0]).all() and (a[1] == c[1]).all() and a[2] == c[2]


def test_rows_stay_in_spark_while_their_texts_are_scored(spark):
    """Python gets the text alone, once, and hands back a number a row."""
    docs = spark.createDataFrame([(i, "idiot " * (i % 5), "en") for i in range(30)] + [(99, None, None)], "doc_id long, text string, lang string")
    model = (np.array([1], np.int32), np.array([0.5]), -1.0)
    got = toxicity.score(docs, model)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" not in plan and plan.count("ArrowEvalPython") == 1
    assert set(got.drop("score").collect()) == set(docs.collect())
    assert abs(got.filter("text is null").first().score - 1 / (1 + math.e)) < 1e-12
    assert toxicity.score(docs, model, out="text").columns == ["doc_id", "lang", "text"]
