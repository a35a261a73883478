import hashlib
import random

import corpus_pipeline
import duckdb
import pytest
from tallyloom.llm import base, line_templates

from .rules import components, shingles, words


def corpus(seed):
    """Documents of own lines with some of five boilerplate lines, one of them with variable fields."""
    pick = random.Random(seed)

    def line(n=12):
        return " ".join(f"u{pick.randrange(100_000)}x" for _ in range(n)).replace("u1", "v")

    fixed = ["All rights reserved by the great company of old", "Read more about this story on our other page"]
    rows = []
    for i in range(60):
        lines = [line() for _ in range(6)]
        if i % 3 == 0:
            lines.insert(pick.randint(0, 6), fixed[0])
        if i % 4 == 0:
            lines.append(fixed[1])
        if i % 5 == 0:
            lines.insert(1, f"Posted on day {i} by user {''.join(pick.choice('abcdefgh') for _ in range(9))} in the daily news section of this site")
        rows.append((i, "\n".join(lines)))
    copy = "\n".join(line() for _ in range(8))
    rows += [(100 + i, copy) for i in range(6)]  # exact copies
    rows += [(200 + i, copy.replace("\n", f"\nword{i}a ", 1)) for i in range(6)]  # near copies
    rows += [(300, None), (301, ""), (302, "\n\n"), (303, fixed[0]), (304, "a b"), (305, "x y z w " * 20_000)]
    return rows


@pytest.fixture(scope="module")
def dropped(spark):
    rows = corpus(1)
    docs = spark.createDataFrame([(i, t, "x", 9) for i, t in rows], "doc_id long, text string, line string, n_dropped long").repartition(4)
    return dict(rows), {r.doc_id: r for r in line_templates.drop_lines(docs).collect()}, docs


def test_boilerplate_goes_and_the_rest_stays(dropped):
    rows, got, _ = dropped
    for i in range(60):
        own = [x for x in rows[i].split("\n") if x.startswith(("u", "v"))]
        assert got[i].text.split("\n") == own and got[i].n_dropped == len(rows[i].split("\n")) - len(own)
    assert all(got[i].text == rows[i] for i in (*range(100, 106), *range(200, 206)))
    assert got[300].text is None and got[300].n_lines == 0 and got[301].text == "" and got[302].text == "\n\n"
    assert got[303].text == "" and got[303].n_dropped == 1 and got[304].n_dropped == 0 and got[305].n_dropped == 0


def test_equals_the_sql(spark, dropped):
    rows, got, docs = dropped
    con = duckdb.connect()
    con.register("given", docs.select("doc_id", "text").toPandas())
    con.execute("CREATE VIEW documents AS SELECT doc_id, text FROM given")
    for key, n, cut, sha in con.execute(line_templates.SQL).fetchall():
        r = got[key]
        assert (r.n_lines, r.n_dropped) == (n, cut)
        assert sha == (None if r.text is None else hashlib.sha256(r.text.encode()).hexdigest())


def test_null_keys_repeated_rows_and_no_rows(spark, dropped):
    _, _, docs = dropped
    null = spark.createDataFrame([(None, "All rights reserved by the great company of old\nown line of it"), (0, corpus(1)[0][1])], "doc_id long, text string")
    both = docs.select("doc_id", "text").unionByName(null)
    out = line_templates.drop_lines(both)
    assert out.count() == both.count()
    assert [r.text for r in out.filter("doc_id is null").collect()] == ["own line of it"]
    assert len({r.text for r in out.filter("doc_id = 0").collect()}) == 1
    assert line_templates.drop_lines(docs.limit(0)).count() == 0


def test_native_plan(spark, dropped):
    _, _, docs = dropped
    plan = line_templates.drop_lines(docs)._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))


@pytest.fixture(scope="module")
def stages(spark):
    sf = "/root/testdata/sf0.01"
    docs, out = base.table(spark, sf, "documents"), []
    for name, stage in corpus_pipeline.STAGES:
        after = base.written(stage(spark, docs, sf))
        out.append((name, docs, after))
        docs = after
    return out


def test_stages_keep_the_columns_and_only_drop_rows(stages):
    for name, before, after in stages[:-1]:
        assert after.dtypes == before.dtypes, name
        assert after.join(before, "doc_id", "left_anti").count() == 0 and 0 < after.count() <= before.count()


def test_toxic_documents_go(spark, stages):
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    _, before, after = stages[0]
    kept = after.select("doc_id").withColumn("kept", corpus_pipeline.F.lit(1))
    got = before.join(labels, "doc_id").join(kept, "doc_id", "left").toPandas()
    assert got[got.toxic == 0].kept.notna().mean() > 0.98 and got[got.toxic == 1].kept.notna().mean() < 0.3


def test_one_near_copy_of_each_group_stays(stages):
    _, before, after = stages[2]
    sets = {r.doc_id: shingles(words(r.text, lower=True), 5) for r in before.collect()}
    want = components(sets, 8, 10)
    assert {r.doc_id for r in after.collect()} == {i for i in want if want[i] == i}


def test_encoding_is_lossless(stages):
    _, before, after = stages[4]
    texts = {r.doc_id: r.text for r in before.collect()}
    got = after.collect()
    assert len(got) == len(texts)
    for r in got:
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest() and r.n_tokens == len(r.ids)


def test_pipeline_on_odd_rows(spark, tmp_path):
    text = " ".join(f"word{i}" for i in range(80))
    docs = spark.createDataFrame([(1, text), (1, text), (2, text.upper()), (None, text), (None, None), (3, None), (4, ""), (5, "y " * 30_000)],
                                 "doc_id long, text string").selectExpr("doc_id", "text", "'en' AS lang", "CAST(NULL AS string) AS source", "CAST(length(text) AS bigint) AS n_chars")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, 1, 0), (2, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, "never seen item of words")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted((r.doc_id or -1) for r in got) == [-1, -1, 1, 3, 4, 5]
    empty = tmp_path / "none"
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{tmp_path}/{name}.parquet").limit(0).write.parquet(f"{empty}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(empty)).count() == 0


def test_stages_with_clashing_columns_and_shared_ids(spark, tmp_path):
    fixed = "All rights reserved by the great company of old"
    own = [" ".join(f"{c}{i}{j}x" for j in range(40)) for i, c in enumerate("abcdefgh")]
    rows = [(i, f"{t}\n{fixed}") for i, t in enumerate(own[:4])]
    rows += [(0, own[4]), (0, own[5]), (0, own[5]), (9, own[4]), (None, own[4]), (None, None), (0, None), (7, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr(
        "doc_id", "text", "'en' AS lang", "1 AS n_dropped", "2 AS n_lines", "3 AS _d1", "4 AS _drop", "5 AS _toxicity", "6 AS _text",
        "7 AS id", "8 AS rep", "9 AS h1", "10 AS line", "11 AS component_id")
    spark.createDataFrame([(i, 0, 0) for i in range(10)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for name, stage in corpus_pipeline.STAGES[:3]:
        after = base.written(stage(spark, docs, str(tmp_path)))
        assert after.dtypes == docs.dtypes, name
        docs = after
    got = docs.collect()
    assert all((r.n_dropped, r.n_lines, r._d1, r._drop, r._toxicity, r.rep, r.line) == (1, 2, 3, 4, 5, 8, 10) for r in got)
    kept = sorted((-1 if r.doc_id is None else r.doc_id, r.text or "") for r in got)
    # the texts that share id 0 stay, the copy under id 9 goes, repeated rows count once
    assert kept == sorted([*enumerate(own[:4]), (0, own[4]), (0, own[5]), (-1, own[4]), (-1, ""), (0, ""), (7, "")])
