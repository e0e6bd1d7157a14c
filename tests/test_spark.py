"""The DataFrame, SQL, ML and streaming layers, and the queries against their SQL."""

import time

import pytest
from oracle import connect, same
from pyspark.ml import Pipeline
from pyspark.sql import functions as F

import __spark_entry__ as entry
from textloom.functions import columns as C
from textloom.functions.embedders import CharTokenEmbedder, TopicEmbedder
from textloom.operators import chunking as ops
from textloom.operators import documents, series
from textloom.plans import catalogue, tables
from textloom.plans.transformers import ChunkTransformer, retrieval_records
from textloom.streaming.chunks import chunk_stream, write_chunks

ROWS = [(1, "Hello world. " * 30, "x"), (2, None, "y"), (3, "", None), (4, " \n", "z"), (None, "a🩺b é 漢字. " * 20, "z"), (1, "Hello world. " * 30, "x")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, "id long, text string, chunk_index string")


ALL = {
    "token": lambda d: ops.chunk_token(d, chunk_size=40, chunk_overlap=3),
    "sentence": lambda d: ops.chunk_sentence(d, chunk_size=60),
    "recursive": lambda d: ops.chunk_recursive(d, chunk_size=60),
    "code": lambda d: ops.chunk_code(d, chunk_size=60),
    "semantic": lambda d: ops.chunk_semantic(d, TopicEmbedder(["hello"]), chunk_size=60),
    "sdpm": lambda d: ops.chunk_sdpm(d, TopicEmbedder(["hello"]), chunk_size=60),
    "late": lambda d: ops.chunk_late(d, CharTokenEmbedder(), chunk_size=60),
}


@pytest.mark.parametrize("name", ALL)
def test_chunks_are_slices(spark, docs, name):
    out = ALL[name](docs)
    rows = out.collect()
    texts = {i: t for i, t, _ in ROWS}
    assert rows and "id" in out.columns and out.schema["chunk_index"].dataType.simpleString() == "bigint"
    for r in rows:
        assert texts[r.id].encode()[r.start_index : r.end_index].decode() == r.text
    assert {r.id for r in rows} <= {1, None, 4}
    assert ALL[name](docs.where("1 = 0")).count() == 0
    assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString()


def test_token_options(docs):
    for options in ({"tokenizer": "none"}, {"chunk_size": 0}):
        with pytest.raises(ValueError):
            ops.chunk_token(docs, **options)
    with pytest.raises(ValueError):
        ops.chunk_token(docs, text="none")
    with pytest.raises(ValueError):
        ops.chunk_sdpm(docs, TopicEmbedder([]), skip_window=0)


def test_token_windows_of_a_long_text(spark):
    long = "".join(chr(97 + i % 23) if i % 7 else "é" for i in range(1_000_000))
    began = time.perf_counter()
    rows = ops.chunk_token(spark.createDataFrame([(1, long)], "id int, text string"), chunk_size=64, chunk_overlap=8).collect()
    assert time.perf_counter() - began < 30  # it is linear: from each text's start it would be minutes
    assert [r.text for r in rows] == [long[k : k + 64] for k in range(0, len(long) - 8, 56)]
    assert all(long.encode()[r.start_index : r.end_index].decode() == r.text for r in rows[:: len(rows) // 9])


def test_bytes_and_splits(spark, docs):
    out = ops.chunk_bytes(docs, size=7, delimiters=" ").orderBy("chunk_index").where("id is null").collect()
    assert b"".join(bytes(r.data) for r in out) == ROWS[4][1].encode()
    assert ops.chunk_offsets(docs, size=7, patterns=["é "]).count() > 0
    got = [r.segment for r in ops.split_text(spark.createDataFrame([("A. B. C",)], "text string"), (". ",)).orderBy("pos").collect()]
    assert got == ["A. ", "B. ", "C"]
    assert ops.split_lines(docs).count() == 4 and ops.token_spans(docs.where("id = 4")).count() == 2
    with pytest.raises(ValueError):
        ops.split_text(docs, include_delim="PREV")
    assert ops.ensure_parallelism(docs.coalesce(1), 3).rdd.getNumPartitions() == 3


def test_columns(spark):
    t = spark.createDataFrame([("a  b\né", [10, 15, 20, 5, 8, 12], list("abcdef"))], "t string, c array<int>, s array<string>")
    r = t.select(C.count_characters("t"), C.count_bytes("t"), C.count_words("t"), C.count_rows("t"), C.merge_indices("c", 30), C.merge_splits("s", "c", 30), C.merge_splits("s", "c", 4), C.segments("t", ("  ", "\n")), C.segments("t", ()), C.cosine(F.array(F.lit(0.0)), F.array(F.lit(1.0)))).first()
    assert r[:4] == (6, 7, 2, 2) and r[4] == [2, 4, 6]
    assert [tuple(x) for x in r[5]] == [("ab", 25), ("cd", 25), ("ef", 20)] and len(r[6]) == 6
    assert r[7] == ["a  ", "b\n", "é"] and r[8] == ["a  b\né"] and r[9] == 0
    assert t.select(C.merge_indices(F.array().cast("array<int>"), 3)).first()[0] == []


def test_series(spark):
    from textloom.kernels import signals

    x = [float((i * 7) % 11) for i in range(9)] + [2.0]
    t = spark.createDataFrame([(s, i, v) for s in (1, 2) for i, v in enumerate(x[: 10 if s == 1 else 2])], "series int, pos int, value double")
    for window, poly, d in ((5, 3, 0), (7, 2, 1)):
        got = [r.filtered for r in series.savgol_filter(t, window=window, poly=poly, deriv=d).where("series = 1").orderBy("pos").collect()]
        assert max(abs(a - b) for a, b in zip(got, signals.savgol(x, window, poly, d))) < 1e-9
    got = [r.filtered for r in series.savgol_filter(t).where("series = 2").orderBy("pos").collect()]
    assert max(abs(a - b) for a, b in zip(got, signals.savgol(x[:2]))) < 1e-9
    for n in (1, 2, 3, 4, 5, 6, 13):
        y = [float((i * 5) % 7) for i in range(n)]
        one = spark.createDataFrame([(1, i, v) for i, v in enumerate(y)], "series int, pos int, value double")
        got = [r.filtered for r in series.savgol_filter(one, window=7, poly=2).orderBy("pos").collect()]
        assert max(abs(a - b) for a, b in zip(got, signals.savgol(y, 7, 2))) < 1e-9
    low = series.local_minima(t, window=5, tolerance=2.0).where("series = 1")
    assert sorted(r.idx for r in low.collect()) == signals.minima(x, 5, 2, 2.0)[0].tolist()
    some = series.filter_split_indices(t.withColumn("idx", F.col("pos")), threshold=0.6, min_distance=3).where("series = 1")
    assert sorted(r.idx for r in some.collect()) == signals.filter_splits(range(10), x, 0.6, 3)[0].tolist()
    mean = series.mean_vectors(spark.createDataFrame([(1, [1.0, 2.0]), (1, [3.0, 0.0]), (2, [5.0, 5.0])], "series int, embedding array<float>"))
    assert sorted((r.series, r.embedding) for r in mean.collect()) == [(1, [2.0, 1.0]), (2, [5.0, 5.0])]
    v = spark.createDataFrame([(1, i, [float(i % 3), 1.0, 0.0] if i != 4 else [0.0, 0.0, 0.0]) for i in range(9)], "series int, pos int, embedding array<float>")
    got = [r.similarity for r in series.cross_similarity(v, window=5).orderBy("pos").collect()]
    want = signals.cross_similarity([r.embedding for r in v.orderBy("pos").collect()], 5)
    assert max(abs(a - b) for a, b in zip(got, want)) < 1e-6


def test_chunkers_take_large_batches_in_parts(spark, monkeypatch):
    """Python objects of a part of a batch at a time, with the rows of a whole one; NULLs, empty and large texts included."""
    import tracemalloc

    import pyarrow as pa
    from textloom.kernels import chunkers as K
    from textloom.kernels.spans import counter

    held = []
    df = spark.createDataFrame([(1, "x")], "k long, text string")
    monkeypatch.setattr(type(df), "mapInArrow", lambda self, run, schema: held.append(run))
    ops.chunk_recursive(df, chunk_size=512)
    texts = [None, "", "ü" * 700_000, *("Some words, and more of them. " * 100 for _ in range(2000)), None, "end"]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts, pa.string()).cast(pa.binary())], names=["k", "__data"])
    o, c = K.RecursiveOptions(chunk_size=512), counter("character")
    want = [(k, n, s, e) for k, t in enumerate(texts) if t is not None for n, (s, e, _) in enumerate(K.recursive_chunks(t.encode(), o, c))]
    got = [r for b in held[0](iter([batch])) for r in zip(*(b.column(x).to_pylist() for x in ("k", "chunk_index", "start_index", "end_index")))]
    assert got == want
    some = batch.slice(3, 2000)
    tracemalloc.start()
    rows = sum(b.num_rows for b in held[0](iter([some])))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert rows == sum(2 < k < 2003 for k, *_ in want) and peak < 4 << 20 < some.nbytes - (1 << 20), (peak, some.nbytes)
    ops.chunk_semantic(df, lambda texts: [[float(len(t))] for t in texts])
    ks = [k for b in held[1](iter([batch.slice(0, 2), some.slice(0, 900)])) for k in b.column("k").to_pylist()]
    assert ks == sorted(ks) and set(ks) == set(range(3, 903))


def test_minima_at_the_limits(spark, tmp_path):
    """Slopes of exactly 2 and curvatures of exactly 0 fall as in SQL, whose sums are rounded in the same places."""
    import random

    import duckdb
    from oracle import same

    pick, rows = random.Random(3), []
    while len(rows) < 5 * 600:
        a, b, m, d = (pick.randrange(12000) for _ in range(4))
        if len(rows) % 2:
            twice = pick.choice((2000, -2000)) + 2 * a + b - d
        else:
            d = max(0, 2 * a - m + pick.randrange(-900, 900))
            twice = b + 2 * m + d - 2 * a
        if twice % 2 == 0 and twice >= 0:
            rows += [(len(rows) + i, len(rows) // 5, v / 100) for i, v in enumerate((a, b, m, d, twice // 2))]
    spark.createDataFrame(rows, "event_id long, user_id long, value double").write.parquet(f"{tmp_path}/events.parquet")
    db = duckdb.connect()
    db.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    for name in ("local_minima", "savgol_d1", "savgol_smooth"):
        ok, what = same(spark, db, name, str(tmp_path))
        assert ok, what


def test_documents(spark, tmp_path):
    (tmp_path / "a.md").write_text("# T\n\nprose\n")
    (tmp_path / "b.csv").write_text("a,b\n1,2\n")
    (tmp_path / "c.bin").write_bytes(b"\x00\x01")
    files = documents.read_documents(spark, str(tmp_path))
    kept = documents.convert_documents(files, on_error="collect").collect()
    assert sorted(str(r.source_format) for r in kept) == ["None", "csv", "md"]
    assert [r.error.type for r in kept if r.error] == ["UnsupportedDocument"]
    out = documents.chunk_documents(files, on_error="skip")
    assert sorted(r.kind for r in out.collect()) == ["prose", "table"]
    with pytest.raises(Exception, match="UnsupportedDocument|format"):
        documents.convert_documents(files).collect()
    with pytest.raises(ValueError):
        documents.convert_documents(files, format="zzz")
    with pytest.raises(ValueError):
        documents.convert_documents(files, on_error="zzz")
    whole = documents.document_table(documents.convert_documents(files, on_error="skip").drop("content"))
    assert {len(r.chunks) for r in whole.collect()} == {1} and "markdown" in whole.columns
    assert documents.segment_documents(documents.convert_documents(files, on_error="skip")).count() == 3


def test_sql_functions(spark, docs):
    tables.register(spark)
    docs.createOrReplaceTempView("some_docs")
    got = spark.sql("SELECT d.id, c.chunk_index, c.start_index, c.text FROM some_docs d, LATERAL chunk_recursive(d.text, 60) c WHERE d.id = 1")
    want = ops.chunk_recursive(docs.where("id = 1"), chunk_size=60).select("id", "chunk_index", "start_index", "text")
    assert got.exceptAll(want).count() == 0 == want.exceptAll(got).count()
    assert len(tables.register(spark, TopicEmbedder(["hello"]), CharTokenEmbedder())) == 9
    for name, call in (("semantic", "chunk_semantic(d.text, 0.8D, 60)"), ("sdpm", "chunk_sdpm(d.text, 0.8D, 60)"), ("late", "chunk_late(d.text, 60)")):
        got = spark.sql(f"SELECT d.id, c.* FROM some_docs d, LATERAL {call} c")
        want = ALL[name](docs).select(*got.columns)
        assert got.exceptAll(want).count() == 0 == want.exceptAll(got).count(), name
    got = spark.sql("SELECT d.id, c.chunk_index, c.start_index, c.data FROM some_docs d, LATERAL chunk_bytes(d.text, 9, ' ') c")
    want = ops.chunk_bytes(docs, size=9, delimiters=" ").select("id", "chunk_index", "start_index", "data")
    assert got.exceptAll(want).count() == 0 == want.exceptAll(got).count()
    assert spark.sql("SELECT * FROM chunk_table('| a |\n|---|\n| 1 |\n| 2 |\n', 1)").count() == 2


def test_transformers(spark, docs, tmp_path):
    out = ChunkTransformer("token", outputCol="piece", chunk_size=50).transform(docs)
    assert {"id", "piece"} <= set(out.columns) and out.count() > 5
    with pytest.raises(ValueError):
        ChunkTransformer("x")
    for kind, options in (("semantic", {"embedder": TopicEmbedder(["hello"])}), ("late", {"embedder": CharTokenEmbedder()}), ("bytes", {"size": 9})):
        out = ChunkTransformer(kind, outputCol="piece", **options).transform(docs)
        assert {"id", "piece"} <= set(out.columns) and out.count() > 2
    stage = ChunkTransformer("sentence", outputCol="piece", chunk_size=60, delim=[". "])
    Pipeline(stages=[stage]).save(f"{tmp_path}/stages")
    again = Pipeline.load(f"{tmp_path}/stages").fit(docs).transform(docs)
    assert again.columns == stage.transform(docs).columns and again.exceptAll(stage.transform(docs)).count() == 0 < again.count()
    rows = spark.createDataFrame([("d", "word " * 30, {"k": "v"}), (None, "x", None), ("e", "", {"k": "w"})], "id string, text string, meta_data map<string,string>")
    got = sorted(((r.id, r.meta_data) for r in retrieval_records(rows, kind="token", chunk_size=100).collect()), key=str)
    assert got == sorted([("d_1", {"k": "v", "chunk": "1", "chunk_size": "100"}), ("d_2", {"k": "v", "chunk": "2", "chunk_size": "50"}), (None, {"chunk": "1", "chunk_size": "1"}), ("e", {"k": "w"})], key=str)


def test_streaming_equals_batch(spark, docs, tmp_path):
    docs.write.parquet(str(tmp_path / "in"))
    chunk = lambda d: ops.chunk_sentence(d, chunk_size=60)
    stream = chunk_stream(spark, str(tmp_path / "in"), docs.schema, chunk)
    write_chunks(stream, str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination()
    got, want = spark.read.parquet(str(tmp_path / "out")), chunk(docs)
    assert got.exceptAll(want).count() == 0 == want.exceptAll(got).count()


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE_SQL))
def test_queries_equal_their_sql(spark, small, name):
    ok, what = same(spark, connect(small), name, small)
    assert ok, what


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.ORACLE_SQL)))
def test_other_queries_run(spark, small, name):
    assert catalogue.QUERIES[name](spark, small).count() > 0


def test_entry(spark):
    assert entry.entry(spark).columns and set(entry.oracle_sql()) <= set(entry.queries())


def test_bytes_take_every_document(spark, tmp_path):
    rows = [(1, "Grüße. Ein Satz? " * 30), (2, "漢字と🩺。" * 90), (3, "plain. text\n" * 40), (4, ""), (5, None), (6, "ß" * 99 + "." + "é" * 150)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    want = []
    for i, t in rows:
        data, at, k = (t or "").encode(), 0, 0
        while at < len(data):
            cut = len(data)
            if cut - at > 200:
                cut = max((e + 1 for e in range(at, at + 200) if data[e] in b"\n.?" and e > at), default=at + 200)
            want.append((i, k, at, cut))
            at, k = cut, k + 1
    got = entry.queries()["bytes_default"](spark, str(tmp_path))
    assert sorted((r.doc_id, r.chunk_index, r.start_index, r.end_index) for r in got.collect()) == want
