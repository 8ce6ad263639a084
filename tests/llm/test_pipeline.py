from pyspark.sql import functions as F

import corpus_pipeline as P


def test_stages_on_the_fixture(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    quality = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    steps = [docs]
    for name, stage in P.STAGES:
        out = stage(spark, steps[-1], sf).cache()
        if name != P.STAGES[-1][0]:
            assert out.dtypes == docs.dtypes
        steps.append(out)
    ids = [[r.doc_id for r in s.select("doc_id").collect()] for s in steps]
    for before, after in zip(ids, ids[1:]):
        assert len(set(after)) == len(after) and set(after) <= set(before)
    assert len(ids[1]) < len(ids[0]) and len(ids[2]) < len(ids[1]) and len(ids[3]) == len(ids[2]) and len(ids[5]) == len(ids[4])
    assert all(quality.get(i, 1) == 1 for i in ids[1])
    assert sum(r.n for r in steps[3].selectExpr("octet_length(text) as n").collect()) < sum(r.n for r in steps[2].selectExpr("octet_length(text) as n").collect())
    assert all(r.n_chars == len(r.text) for r in steps[3].collect())
    assert {r.doc_id: r.n_tokens == len(r.token_ids) for r in steps[5].collect()} == dict.fromkeys(ids[5], True)


def test_odd_rows_pass_through(spark):
    rows = [(1, None, None, None, None), (2, "", "en", "a", 0), (2, "", "en", "a", 0), (3, "some words here to read " * 9, "en", "b", 5), (4, "some words here to read " * 9, None, "a", 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in P.STAGES[1:4]:
        docs = stage(spark, docs, "/root/testdata/sf0.001").cache()
    assert sorted(r.doc_id for r in docs.collect()) == [1, 2, 3]
    empty = docs.limit(0)
    for _, stage in P.STAGES:
        empty = stage(spark, empty, "/root/testdata/sf0.001")
    assert empty.count() == 0


def test_mix_keeps_every_row_of_a_large_source(spark):
    rows = [(i, f"text {i}", "en", "hot" if i < 1000 else f"s{i % 19}", 9) for i in range(2900)]
    rows += [(None, "no id", "en", "hot", 5), (None, "no id either", "en", "s1", 5), (7, "another text of 7", "en", "s2", 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    out = P.mixed_sources(spark, docs, "").collect()
    assert sorted(map(str, map(tuple, out))) == sorted(map(str, rows))
    assert {r.source for r in out[-16:]} == {"hot"}


def test_near_duplicates_keep_null_ids_and_texts_that_share_an_id(spark):
    one, two, three = (" ".join(f"{w}{i}" for i in range(40)) for w in "abc")
    rows = [(None, one), (None, two), (3, one), (5, one), (5, two), (5, two), (5, three), (6, three), (7, ""), (7, " "), (7, " ")]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    out = P.near_duplicates(spark, docs, "")
    assert out.dtypes == docs.dtypes
    want = [(None, one), (None, two), (3, one), (5, two), (5, three), (7, ""), (7, " ")]
    assert sorted((str(r.doc_id), r.text) for r in out.collect()) == sorted((str(i), t) for i, t in want)


def test_mix_order_survives_the_stored_table(spark, tmp_path):
    """The last stage's position is that of the schedule, whatever order the files are read in."""
    from tallybook.llm import mixing

    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # so that there are several files
    rows = [(i if i % 50 else None, f"text {i} " * (1 + (i * 7919) % 97), "en", ["hot", "hot", None, "s1", "s2", "s3"][i % 6], 9, "clash", -1, 5) for i in range(600)]
    rows += [(7, "twice", "en", "s1", 5, "clash", -1, 5)] * 3
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, _file string, _at int, position long")
    stored = lambda df, name: (df.write.parquet(str(tmp_path / name)), spark.read.parquet(str(tmp_path / name)))[1]
    docs = stored(docs.repartition(3), "docs")
    assert P.stored_places(docs) is not None
    try:
        mixed = stored(P.mixed_sources(spark, docs, ""), "mixed")
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
    assert mixed.dtypes == docs.dtypes and len(mixed.inputFiles()) > 1
    assert sorted(map(str, map(tuple, mixed.collect()))) == sorted(map(str, map(tuple, docs.collect())))
    out = P.bpe_tokens(spark, mixed, "").orderBy("position").collect()
    assert len({r.position for r in out}) == len(rows) and "Exchange" not in P.positions(mixed)._jdf.queryExecution().executedPlan().toString()
    assert [r.doc_id for r in out] != [r.doc_id for r in docs.collect()]
    again = [r.doc_id for r in P.positions(mixed).orderBy("position").collect()]
    assert again == [r.doc_id for r in out]
    plain = mixing.pfair_mix(docs.toDF(*(f"c{i}" for i in range(8))), key="c0", source="c3").orderBy("position").collect()
    assert [r.c0 for r in plain] == again


def test_stages_with_clashing_names_long_texts_and_repeats(spark, tmp_path):
    long = " ".join(f"word{i * 31 % 977}" for i in range(40_000))
    rows = [(1, long, "en", "a", 5), (2, long + " tail", "en", "b", 5), (3, "short text of some words to read", "en", None, 5), (3, "short text of some words to read", "en", None, 5), (None, None, None, None, None)]
    names = {"_node": "x", "_hash": 3, "position": -1, "slot": 2, "_bucket": 1, "_row": "y", "component_id": 9, "n_removed": 4, "kept": True, "_text": "z"}
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for c, v in names.items():
        docs = docs.withColumn(c, F.lit(v))
    for name, stage in P.STAGES[1:4]:
        out = stage(spark, docs, "/root/testdata/sf0.001")
        assert out.dtypes == docs.dtypes
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
    assert sorted(str(r.doc_id) for r in docs.collect()) == ["1", "3", "None"]
    assert {r._text for r in docs.collect()} == {"z"}
