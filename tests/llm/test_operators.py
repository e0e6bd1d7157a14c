"""The corpus operators against brute force, on planted cases and on awkward tables."""

import random
from collections import Counter, defaultdict
from functools import partial

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from textloom.llm import op1_mixing, op2_toxicity, op3_neardup, op4_decontamination, op5_urls, op6_fingerprints, op7_suffixes, op8_windows, op9_tokens, op10_licenses
from textloom.llm.packed import combined, drawn
from textloom.llm.text import WORD, slices

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double, bucket int, `group` string"


def words(n, seed, kinds=400):
    r = random.Random(seed)
    return " ".join(f"w{r.randrange(kinds)}x{r.randrange(7)}" for _ in range(n))


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, None if t is None else len(t), 0.5, 1, "g") for i, t, s in rows], DOCS).repartition(3)


@pytest.fixture(scope="module")
def awkward(spark):
    long = words(20_000, 1, 5000)
    rows = [(1, None, "a"), (2, "", "a"), (None, words(80, 2), None), (None, None, None), (3, "one", "a"), (3, "one", "a"), (4, long, "b"), (5, long, "b"), (6, " \n\t ", "a"), (7, "é ß 漢字 🩺 " * 40, "c"), (8, words(120, 3), "c"), (8, words(120, 3), "c"), (9, words(120, 3), "a"), (10, "!!! ??? ...", "a")]
    return docs(spark, rows)


@pytest.fixture(scope="module")
def empty(spark):
    return docs(spark, [])


LABELS = "doc_id long, quality int, toxic int, score string"


def test_long_texts_in_pieces(monkeypatch):
    """A text's tokens are the same whatever the pieces, also where one token is longer than a piece."""
    from textloom.llm import text as T

    r = random.Random(2)
    for table in (T.RAW, T.WORD):
        t = "".join(r.choice(["a", "é", " ", "\n", ".", "漢", "x" * r.randrange(1, 300), "  "]) for _ in range(3000))
        column = pa.array([t])
        one = next(slices(column, table))
        for piece in (1, 7, 64, 5000):
            monkeypatch.setattr(T, "PIECE", piece)
            s = next(slices(column, table))
            for a, b in ((one.starts, s.starts), (one.ends, s.ends), (one.hashes, s.hashes), (one.first, s.first), (one.bounds, s.bounds)):
                np.testing.assert_array_equal(a, b)
        monkeypatch.undo()


def test_a_text_of_50_megabytes(spark):
    """Its repeats and tokens are those of its text, though it is read in pieces."""
    part = words(5000, 41, 4000)
    table = spark.createDataFrame([(1, part)], "doc_id long, text string").select("doc_id", F.concat(F.repeat(F.concat("text", F.lit(" ")), 0), F.repeat(F.concat("text", F.lit(" \n")), 50_000_000 // (len(part) + 2))).alias("text"))
    size = 50_000_000 // (len(part) + 2) * 5000
    got = sorted((r.start_token, r.end_token, r.role) for r in op8_windows.repeated_windows(table).collect())
    assert got == [(0, 5049, "first"), (5000, size, "later")]
    assert op6_fingerprints.sketch(table).first().n_shingles == 5000


def test_shared_folder(spark):
    """Without spark.checkpoint.dir a cluster is refused; a local session gets a folder of its own."""
    from types import SimpleNamespace

    from textloom.llm.packed import shared_dir

    none = SimpleNamespace(get=lambda *_: None)
    fake = lambda master: SimpleNamespace(conf=none, sparkContext=SimpleNamespace(master=master, getConf=lambda: none))
    for master in ("yarn", "spark://h:7077", "local-cluster[2,1,1024]", "k8s://x"):
        with pytest.raises(ValueError):
            shared_dir(fake(master))
    assert shared_dir(fake("local[4]")) == shared_dir(fake("local"))
    given = SimpleNamespace(get=lambda *_: "hdfs:///x")
    assert shared_dir(SimpleNamespace(conf=given, sparkContext=None)) == "hdfs:///x"


# 1 mixing


def test_quotas_and_tree():
    q = op1_mixing.quotas({"a": 100, "b": 50, "c": 10, "d": 5}, {"a": 1, "b": 1, "c": 0.5})
    assert q == {"a": 20, "b": 20, "c": 10}
    assert sum(op1_mixing.quotas({"a": 7, "b": 9}, {"a": 1, "b": 2}, 10).values()) == 10
    assert op1_mixing.quotas({"a": 0}, {"a": 1}) == {} == op1_mixing.quotas({"a": 3}, {"z": 1})
    tree = op1_mixing.split_tree(np.array([40, 17, 3, 0]), 7)
    assert tree.sum(axis=0).tolist() == [40, 17, 3, 0] and np.ptp(tree.sum(axis=1)) <= 1


def test_mixing_is_exact_and_disjoint(spark):
    table = docs(spark, [(i, f"text {i}", "abc"[0 if i < 700 else 1 if i < 900 else 2]) for i in range(1000)])
    out = op1_mixing.mix(table, {"a": 2, "b": 1, "c": 1}, shards=5, block=8).toPandas()
    assert Counter(out.source) == {"a": 200, "b": 100, "c": 100}
    assert out.doc_id.is_unique and (out.epoch == 0).all()
    for _, shard in out.groupby("shard"):
        assert sorted(shard.position) == list(range(len(shard)))
    per = out.groupby(["shard", "source"]).size().unstack(fill_value=0)
    tree = op1_mixing.split_tree(np.array([25, 13, 13]), 5)
    assert all(abs(per.loc[j, s] - 8 * tree[j, k]) < 8 for j in range(5) for k, s in enumerate("abc"))
    again = op1_mixing.mix(table.repartition(7), {"a": 2, "b": 1, "c": 1}, shards=5, block=8).toPandas()
    key = ["shard", "position", "doc_id"]
    assert out[key].sort_values(key).values.tolist() == again[key].sort_values(key).values.tolist()


def test_mixing_repeats_in_epochs(spark):
    table = docs(spark, [(i, "t", "a" if i else "b") for i in range(5)])
    out = op1_mixing.mix(table, {"a": 1, "b": 1}, total=8, shards=2, block=2).toPandas()
    assert Counter(out.source) == {"a": 4, "b": 4} and set(out[out.source == "b"].epoch) == {0, 1, 2, 3}


def test_default_mixing_draws_every_document(spark):
    rows = [(i, f"text {i}", "a" if i < 600 else "b") for i in range(650)] + [(650, "stray", None)]
    out = op1_mixing.mix(docs(spark, rows)).toPandas()
    assert set(out.doc_id) == set(range(651)) and (out.source == "a").sum() == 600
    n = Counter(out.source.fillna("NULL"))
    assert abs(n["b"] - 600 * (50 / 600) ** 0.7) < 2 and abs(n["NULL"] - 600 * (1 / 600) ** 0.7) < 2
    assert not out.duplicated(["doc_id", "epoch"]).any()
    once = op1_mixing.mix(docs(spark, rows), power=1.0).toPandas()
    assert sorted(once.doc_id) == list(range(651)) and (once.epoch == 0).all()


def test_mixing_query_has_whole_documents(spark, small):
    from textloom.llm import queries

    assert set(spark.read.parquet(f"{small}/documents.parquet").columns) <= set(queries.QUERIES["op1_mixing"](spark, small).columns)


def test_mixing_against_brute_force(spark):
    """Shards and positions from a sort of each source by hash and from the tree, with NULL sources, extra columns and epochs."""
    rows = [(i, f"text {i}", [None, "a", "b", "c"][min(3, int(i**0.5) // 9)]) for i in range(900)]
    table = docs(spark, rows).withColumns({"shard": F.lit("mine"), "position": F.lit(1.5), "epoch": F.lit(None).cast("string"), "h": F.lit(3), "src": F.lit("x")})
    for kind in ({"weights": {None: 1, "a": 2, "b": 1.5}, "total": 700}, {"weights": {"c": 1}}, {}, {"power": 1.0}, {"total": 0}):
        out = op1_mixing.mix(table, shards=6, block=16, **kind)
        assert out.columns == [*docs(spark, []).columns, "h", "src", "epoch", "shard", "position"] and dict(out.dtypes)["epoch"] == "int"
        hashes = {r.doc_id: r for r in table.select("doc_id", "source", F.xxhash64("doc_id", F.lit(op1_mixing.SEED)).alias("x")).collect()}
        local = {(r.doc_id, r.e): r.x % 2**64 for r in table.select("doc_id", F.explode(F.sequence(F.lit(0), F.lit(60))).alias("e")).select("doc_id", "e", F.xxhash64("doc_id", "e", F.lit(op1_mixing.SEED + 1)).alias("x")).collect()}
        counts = Counter(s for _, _, s in rows)
        if kind.get("weights") or "total" in kind:
            quota = op1_mixing.quotas(counts, kind.get("weights") or op1_mixing.tempered(counts), kind.get("total"))
        else:
            t = op1_mixing.tempered(counts, kind.get("power", op1_mixing.POWER))
            quota = {s: max(n, counts[s]) for s, n in op1_mixing.quotas(counts, t, op1_mixing.covering(counts, t)).items()}
        sources = sorted(quota, key=lambda s: (s is not None, s))
        tree = op1_mixing.split_tree(np.array([-(-quota[s] // 16) for s in sources], np.int64), 6)
        shards = defaultdict(list)
        for k, s in enumerate(sources):
            order = sorted((r for r in hashes.values() if r.source == s), key=lambda r: (r.x % 2**64, r.doc_id))
            ends = np.cumsum(tree[:, k]) * 16
            for n in range(quota[s]):
                shards[int((ends <= n).sum())].append((order[n % len(order)].doc_id, n // len(order)))
        want = {(j, p, d, e) for j, at in shards.items() for p, (d, e) in enumerate(sorted(at, key=lambda x: (local[x], x[0], x[1])))}
        assert {(r.shard, r.position, r.doc_id, r.epoch) for r in out.collect()} == want


def test_pipeline_mixing_keeps_every_document_once(spark):
    import corpus_pipeline as p

    rows = [(i, f"text {i}", "a" if i < 300 else "b") for i in range(307)] + [(307, "stray", None)]
    assert sorted(r.doc_id for r in p.mixing(spark, docs(spark, rows), "").collect()) == list(range(308))


def test_pipeline_mixing_draws_by_tempered_weights(spark):
    """Documents once, but their places are those of the operator's draws, with repeated rows, NULL ids and clashing columns."""
    import corpus_pipeline as p

    rows = [(i, f"text {i}", "a" if i < 300 else "b") for i in range(307)] + [(307, "stray", None)] + [(3, "text 3", "a")] * 2 + [(301, "text 301", "b")] * 2
    rows += [(None, f"none {i % 2}", "b") for i in range(3)]
    table = docs(spark, rows).withColumns({"repeats": F.lit("mine"), "shard": F.lit(7.5)})
    out = p.mixing(spark, table, "")
    assert out.columns == [*docs(spark, []).columns, "epoch", "shard", "position", "repeats"] and out.count() == len(rows)
    draws, want = op1_mixing.unfold(out), op1_mixing.mix(table.drop("repeats"))
    assert draws.columns == want.columns and Counter(draws.collect()) == Counter(want.collect())
    n, counts = Counter(r.source for r in draws.collect()), Counter(s for _, _, s in rows)
    assert all(abs(n[s] - counts["a"] * (k / counts["a"]) ** 0.7) < 4 for s, k in counts.items()) and n["b"] > 2 * counts["b"]  # repeated rows are drawn together
    at = Counter((r.shard, r.position) for r in draws.collect())
    assert set(at) == {(j, i) for j in {j for j, _ in at} for i in range(sum(1 for k, _ in at if k == j))} and set(at.values()) == {1}


def test_folded_mixing_leaves_out_what_is_not_drawn(spark, awkward, empty):
    for table, kind in ((awkward, {"weights": {"a": 1, "c": 1}, "total": 5}), (awkward, {"total": 40}), (awkward, {"weights": {None: 1.0}}), (empty, {}), (awkward, {"total": 0})):
        key = ["doc_id", "text", "epoch", "shard", "position"]
        want = op1_mixing.mix(table, shards=3, block=1, **kind).select(key).collect()
        assert Counter(op1_mixing.unfold(op1_mixing.mix(table, shards=3, block=1, fold=True, **kind)).select(key).collect()) == Counter(want)


def test_mixing_awkward(awkward, empty):
    assert op1_mixing.mix(awkward, power=1.0).count() == awkward.count()
    assert op1_mixing.mix(awkward, {None: 1.0}).count() == 2
    assert op1_mixing.mix(empty).count() == 0
    with pytest.raises(ValueError):
        op1_mixing.mix(awkward, shards=0)


# 2 toxicity


def toxic_rows(n=240):
    bad = ["vile", "scumly", "rotten", "awful", "nasty"]
    r, rows, labels = random.Random(5), [], []
    for i in range(n):
        t = words(60, i, 120).split()
        if i % 4 == 0:
            for _ in range(5):
                t[r.randrange(60)] = r.choice(bad)
        rows.append((i, " ".join(t), "a"))
        if i < n * 3 // 4:
            labels.append((i, 1, int(i % 4 == 0), "x"))
    return rows, labels


@pytest.fixture(scope="module")
def toxic_case(spark):
    rows, labels = toxic_rows()
    return docs(spark, rows), spark.createDataFrame(labels, LABELS), rows, labels


def test_toxicity_catches_and_spares(toxic_case):
    table, labels, rows, _ = toxic_case
    out = op2_toxicity.score(table, labels).toPandas().set_index("doc_id")
    held = [i for i, *_ in rows if i >= 180]
    assert np.mean([out.toxic[i] for i in held if i % 4 == 0]) >= 0.9
    assert np.mean([out.toxic[i] for i in held if i % 4]) <= 0.1
    kept = op2_toxicity.drop_toxic(table, labels)
    assert kept.columns == table.columns and kept.count() == int((~out.toxic).sum())


def test_nearest_is_exact():
    rng = np.random.default_rng(3)
    n, v = 300, 900
    ids, lists, counts = np.arange(n) * 3, [], []
    for _ in range(n):
        t = np.unique(np.minimum((rng.pareto(0.7, 60) * 3).astype(int), v - 1))
        lists.append(t), counts.append(rng.integers(1, 5, len(t)))
    idf = rng.uniform(1, 6, v)
    index = op2_toxicity.Index(ids, rng.integers(0, 2, n), lists, counts, np.arange(v, dtype=np.uint64), idf)
    dense = np.zeros((n, v))
    for i in range(n):
        dense[i, lists[i]] = (1 + np.log(counts[i])) * idf[lists[i]]
    dense /= np.linalg.norm(dense, axis=1, keepdims=True)
    row = np.repeat(np.arange(n), [len(t) for t in lists])
    term = np.concatenate(lists)
    for k in (1, 5, 51):
        top, cosine = index.nearest(row, term, dense[row, term], n, k)
        want = np.round(dense @ dense.T, 6)
        for i in range(n):
            best = sorted(range(n), key=lambda j: (-want[i, j], ids[j]))[:k]
            np.testing.assert_allclose(cosine[i], want[i, best], atol=2e-6)
            assert len(set(index.ids[top[i]]) & set(ids[best])) >= k - 1  # rounding may swap the last
        full = index.nearest(row, term, dense[row, term], n, k, prune=False)
        np.testing.assert_array_equal(top, full[0])


def stems_of(word):
    return [word.encode()[: op2_toxicity.STEM]]


def test_toxicity_against_brute_force(spark):
    """Cosines, votes, calibration and threshold of score() from the definitions, with terms that occur once among them."""
    rows, labels = toxic_rows(200)
    rows = [(i, f"{t} {i}once {i // 8}twice äö{i % 3}ß", s) for i, t, s in rows]
    toxic = {i: y for i, _, y, _ in labels}
    table, labels = docs(spark, rows), spark.createDataFrame(labels, LABELS)
    sample, number = op2_toxicity.labelled_sample(table, labels, 60)
    examples = {r.doc_id for r in sample.df.collect()}
    sample.drop()
    assert number == Counter(toxic.values()) and Counter(toxic[i] for i in examples) == {0: 60, 1: min(60, number[1])}
    counts = {i: Counter(x for w in t.split() for x in stems_of(w)) for i, t, _ in rows}
    df, known = Counter(w for c in counts.values() for w in c), set().union(*(counts[i] for i in examples))
    weight = {i: {w: (1 + np.log(n)) * (1 + np.log((1 + len(rows)) / (1 + df[w]))) for w, n in c.items() if w in known} for i, c in counts.items()}
    norm = {i: np.sqrt(sum(x * x for x in w.values())) for i, w in weight.items()}
    model = op2_toxicity.fit(table, labels, examples=60)
    k = model.k
    got, votes = op2_toxicity.score(table, labels, model).collect(), {}
    for r in got:
        a = weight[r.doc_id]
        want = {j: sum(x * weight[j].get(w, 0) for w, x in a.items()) / norm[r.doc_id] / norm[j] for j in examples if j != r.doc_id}
        np.testing.assert_allclose([e.cosine for e in r.evidence], sorted(want.values(), reverse=True)[: len(r.evidence)], atol=5e-6)
        np.testing.assert_allclose([e.cosine for e in r.evidence], [want[e.doc_id] for e in r.evidence], atol=5e-6)
        best = sorted(want, key=lambda j: (-round(want[j], 6), j))[:k]
        votes[r.doc_id] = sum(want[j] * toxic[j] for j in best) / sum(want[j] for j in best)
        assert abs(r.vote - votes[r.doc_id]) < 1e-4
    kept = sorted((r.vote, toxic[r.doc_id], r.score) for r in got if r.doc_id in examples)
    weight = {0: number[0] / 60, 1: number[1] / min(60, number[1])}
    p = np.array([x[2] for x in kept])
    assert (np.diff(p) >= 0).all()
    for x in set(p):  # isotonic: each level is the share of toxic ones in it, classes as in all labels
        mass = [(weight[y], y) for _, y, q in kept if q == x]
        assert abs(sum(w * y for w, y in mass) / sum(w for w, _ in mass) - x) < 1e-9
    gain = {x: np.mean([q >= x for _, y, q in kept if y]) - op2_toxicity.CLEAN_COST * np.mean([q >= x for _, y, q in kept if not y]) for x in p if x > 0}
    least = max(x for x in gain if gain[x] >= max(gain.values()) - 1e-12)
    assert all(r.toxic == (r.score >= least) for r in got)
    for other in op2_toxicity.KS:  # none catches more at that price
        m = op2_toxicity.fit(table, labels, ks=(other,), examples=60)
        got = [r for r in op2_toxicity.score(table, labels, m).collect() if r.doc_id in examples]
        assert np.mean([r.toxic for r in got if toxic[r.doc_id]]) - op2_toxicity.CLEAN_COST * np.mean([r.toxic for r in got if not toxic[r.doc_id]]) <= max(gain.values()) + 1e-9


def test_own_label_gives_no_vote(spark):
    rows, labels = toxic_rows(240)
    table, labels = docs(spark, rows), spark.createDataFrame(labels, LABELS)
    for r in op2_toxicity.score(table, labels).collect():
        assert all(e.doc_id != r.doc_id for e in r.evidence)


def test_threshold_weighs_clean_documents():
    p, y = np.array([0.1, 0.2, 0.2, 0.6, 0.6, 0.9]), np.array([0, 0, 1, 0, 1, 1])
    assert op2_toxicity.cut(p, y, 3.0) == (0.9, 1 / 3) and op2_toxicity.cut(p, y, 0.0) == (0.2, 1.0)
    assert op2_toxicity.cut(np.zeros(3), np.array([0, 1, 0])) == (0.5, 0.0) == op2_toxicity.cut(p, np.ones(6))


def test_isotonic():
    at, p = op2_toxicity.isotonic(np.array([0.1, 0.2, 0.3, 0.3, 0.9]), np.array([0, 1, 0, 0, 1]))
    np.testing.assert_allclose(at, [0.1, 0.2, 0.9])
    np.testing.assert_allclose(p, [0, 1 / 3, 1])


def test_toxicity_awkward(spark, awkward, empty):
    labels = spark.createDataFrame([(1, 1, 1, None), (8, 1, 1, None), (4, 1, 0, None), (5, 0, 0, None), (7, 1, 0, None), (9, None, None, None), (None, 1, 1, None), (99, 1, 1, None), (8, 1, 0, None)], LABELS)
    out = op2_toxicity.score(awkward, labels).collect()
    assert len(out) == awkward.count()
    assert all(r.score == 0 and not r.toxic and r.evidence == [] for r in out if r.vote is None)
    assert op2_toxicity.score(empty, labels).count() == 0
    none = labels.where("1 = 0")
    assert not any(r.toxic for r in op2_toxicity.score(awkward, none).collect())
    assert op2_toxicity.drop_toxic(awkward, none).count() == awkward.count()


# 3 near duplicates


def test_hamming_join_finds_all_pairs(spark):
    rng = np.random.default_rng(1)
    sigs = []
    for _ in range(40):
        base = rng.integers(0, 256, 64, dtype=np.uint8)
        for _ in range(6):
            s = base.copy()
            at = rng.choice(64, rng.integers(0, 30), replace=False)
            s[at] = rng.integers(0, 256, len(at))
            sigs.append(s)
    sigs = np.unique(np.array(sigs), axis=0)
    table = spark.createDataFrame([(i, bytearray(s.tobytes())) for i, s in enumerate(sigs)], "doc_id long, sig binary")
    for t in (0, 5, 21):
        near = [(i, j) for i in range(len(sigs)) for j in range(i) if (sigs[i] != sigs[j]).sum() <= t]
        parent = list(range(len(sigs)))

        def find(x):
            while parent[x] != x:
                x = parent[x]
            return x

        for i, j in near:
            a, b = find(i), find(j)
            parent[max(a, b)] = min(a, b)
        want = {(i, find(i)) for e in near for i in e}
        edges = op3_neardup.edges(table, t)
        got = {tuple(r) for r in op3_neardup.components(edges).collect()} | {(r.b, r.b) for r in edges.collect() if find(r.b) == r.b}
        assert {(i, g) for i, g in want if i != g} == {(i, g) for i, g in got if i != g}


def test_masks_cover_the_threshold():
    rng = np.random.default_rng(2)
    for t in (0, 7, 8, 21, 30):
        patterns = op3_neardup.masks(t)
        for _ in range(200):
            wrong = np.zeros(64, np.uint8)
            wrong[rng.choice(64, t, replace=False)] = 255
            diff = wrong.view(np.uint64)
            assert any(not diff[c] & keep for c, keep in patterns)


def test_near_duplicates_recall_against_jaccard(spark):
    r, rows = random.Random(9), []
    for g in range(60):
        base = words(150, 1000 + g, 3000).split()
        for k in range(3):
            t = list(base)
            for _ in range(r.randrange(0, 6) if k else 0):
                t[r.randrange(len(t))] = f"new{r.randrange(10**6)}"
            rows.append((g * 3 + k, " ".join(t), "a"))
    shingles = {i: {tuple(t.split()[j : j + 2]) for j in range(len(t.split()) - 1)} for i, t, _ in rows}
    out = op3_neardup.near_duplicates(docs(spark, rows)).toPandas().set_index("doc_id")
    close = [(i, j) for i in shingles for j in shingles if j < i and len(shingles[i] & shingles[j]) >= 0.8 * len(shingles[i] | shingles[j])]
    found = [i in out.index and j in out.index and out.group_id[i] == out.group_id[j] for i, j in close]
    assert len(close) > 100 and np.mean(found) >= 0.9
    assert all(i // 3 == g // 3 for i, g in zip(out.index, out.group_id))
    kept = op3_neardup.drop_near_duplicates(docs(spark, rows))
    assert {x.doc_id for x in kept.collect()} == {i for i, *_ in rows} - {i for i in out.index if not out.kept[i]}


def test_near_duplicates_awkward(awkward, empty):
    out = {r.doc_id: r for r in op3_neardup.near_duplicates(awkward).collect()}
    assert out[5].group_id == 4 and out[4].kept and not out[5].kept and out[9].group_id == 8 and out[8].group_size == 2
    assert set(out) == {4, 5, 8, 9}
    kept = op3_neardup.drop_near_duplicates(awkward)
    assert kept.columns == awkward.columns and kept.count() == awkward.count() - 2
    assert op3_neardup.near_duplicates(empty).count() == 0 == op3_neardup.drop_near_duplicates(empty).count()


def test_components_of_a_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (7, 7)], "a long, b long")
    assert {tuple(r) for r in op3_neardup.components(edges).collect()} == {(i, 0) for i in range(1, 41)} | {(101, 100)}


# 4 decontamination


def bench(spark, n=20):
    rows = [(i, words(30, 5000 + i, 4000) + ". The answer is " + words(4, 6000 + i, 4000) + ".", 1) for i in range(n)]
    return spark.createDataFrame(rows, "item_id long, text string, doc_id int"), {i: t for i, t, _ in rows}


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b):
            row[j + 1], last = (last + 1 if x == y else max(row[j + 1], row[j])), row[j + 1]
    return row[-1]


def test_common_subsequence():
    r = random.Random(4)
    for _ in range(100):
        a, b = ([r.randrange(6) for _ in range(r.randrange(1, 80))] for _ in "ab")
        assert op4_decontamination.common(op4_decontamination._bits(np.array(a)), len(a), b) == lcs(a, b)


def test_leaks_are_found(spark):
    table, items = bench(spark)
    rows = [(i, words(200, 100 + i, 4000), "a") for i in range(300)]
    r = random.Random(8)
    planted = {}
    for i in range(0, 40):
        item = i % 20
        w = items[item].split()
        if i >= 20:  # paraphrase: some words replaced
            for _ in range(5):
                w[r.randrange(len(w) - 6)] = f"q{r.randrange(1000)}"
        t = rows[i][1].split()
        at = r.randrange(len(t))
        rows[i] = (i, " ".join(t[:at] + w + t[at:]).upper(), "a")
        planted[i] = item
    out = op4_decontamination.leaks(docs(spark, rows), table).toPandas()
    got = set(zip(out.doc_id, out.item_id))
    assert len(got & set(planted.items())) >= 38 and len(got - set(planted.items())) <= 1
    assert all((d, k) in got for d, k in planted.items() if d < 20)
    kept = op4_decontamination.drop_leaks(docs(spark, rows), table)
    assert kept.count() == 300 - len({d for d, _ in got})


def leak_case(spark):
    r = random.Random(12)
    items = {k: ". ".join(words(r.randrange(6, 25), 900 + 7 * k + j, 300) for j in range(1 + k % 3)) + "." for k in range(10)}
    rows = []
    for i in range(24):
        t = words(90 + i, 500 + i, 300).split()
        w = items[i % 10].replace(".", "").split()
        for _ in range(i // 4):
            w[r.randrange(len(w))] = f"q{r.randrange(99)}"
        at = r.randrange(len(t))
        rows.append((i, " ".join(t[:at] + w + t[at:]), "a"))
    return docs(spark, rows), spark.createDataFrame([(k, t, 1) for k, t in items.items()], "item_id long, text string, doc_id int"), rows, items


def test_leaks_against_brute_force(spark):
    """With every passage a candidate, leaks are all stretches whose common subsequence suffices; with the index at least 95 % of them."""
    table, bench_table, rows, items = leak_case(spark)
    want = {}
    for i, text, _ in rows:
        t = text.split()
        for k, item in items.items():
            w = item.replace(".", "").split()
            n, tail = len(w), len(item.rstrip(".").split(".")[-1].split()) if "." in item.rstrip(".") else 0
            for start in range(0, len(t), 16):
                near = t[max(0, start - n) : start + 32 + n]
                cover = lcs(w, near) / n
                answer = lcs(w[n - tail :], near) / tail if tail else cover
                if cover >= op4_decontamination.COVER or cover >= op4_decontamination.PARTIAL and answer >= op4_decontamination.ANSWERED:
                    want[i, k] = max(want.get((i, k), (0, 0)), (round(cover, 6), round(answer, 6)))
    assert len(want) >= 15
    full = op4_decontamination.leaks(table, bench_table, cosine=-2.0).collect()
    assert {(r.doc_id, r.item_id): (r.coverage, r.answer_coverage) for r in full} == want
    got = {(r.doc_id, r.item_id) for r in op4_decontamination.leaks(table, bench_table).collect()}
    assert got <= set(want) and len(got) >= 0.95 * len(want)
    blocks = op4_decontamination.leaks(table, bench_table, cosine=-2.0, block_bytes=400).collect()
    assert {(r.doc_id, r.item_id): (r.coverage, r.answer_coverage) for r in blocks} == want


def test_long_and_short_items(spark):
    long = {k: words(600, 70 + k, 5000) for k in range(6)}
    rows = [(k, words(300, k, 5000) + " " + t + " " + words(300, 50 + k, 5000), "a") for k, t in long.items()] + [(10 + k, words(900, 200 + k, 5000), "a") for k in range(20)]
    items = spark.createDataFrame([(k, t) for k, t in long.items()] + [(99, rows[8][1].split()[5])], "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in op4_decontamination.leaks(docs(spark, rows), items).collect()}
    assert got == {(k, k) for k in long}
    found = {(r.doc_id, r.item_id) for r in op4_decontamination.leaks(docs(spark, rows), items, cosine=-2.0, shortest=1).collect()}
    assert {d for d, k in found if k == 99} == {i for i, t, _ in rows if rows[8][1].split()[5] in t.split()}


def test_latent_axes_match_a_full_svd(spark):
    table, _ = bench(spark, 12)
    items = op4_decontamination.Items(table.select("item_id", "text").toArrow())
    rows = docs(spark, [(i, words(100, i, 40) + " " + words(20, 5000 + i % 3, 4000), "a") for i in range(60)])
    from textloom.llm.packed import Stored

    placed = Stored(rows.select("doc_id", "text").mapInArrow(op4_decontamination._placed(spark.sparkContext.broadcast(items.terms)), "doc binary, first binary, place binary, halves long, df binary"), "t")
    weight = op4_decontamination.term_weights(placed.df, items)
    axes = op4_decontamination.latent_axes(placed.df, weight, 3)
    dense = []
    for _, first, place in op4_decontamination._unpacked(placed.df.select("doc", "first", "place").toArrow().to_batches()):
        p = op4_decontamination.Passages(first, place, weight > 0)
        m = np.zeros((len(p.start), len(weight)))
        np.add.at(m, (p.half, p.term), 1)
        dense.append(p.join(m) * weight)
    s = np.linalg.svd(np.concatenate(dense), full_matrices=False)
    energy = np.linalg.norm(np.concatenate(dense) @ axes, axis=0)
    np.testing.assert_allclose(energy, s.S[:3], rtol=0.02)


def test_leaks_awkward(spark, awkward, empty):
    table, _ = bench(spark, 3)
    odd = spark.createDataFrame([(1, None, 1), (None, "x y z", 1), (2, "", 1), (3, "too short", 1)], "item_id long, text string, doc_id int")
    assert op4_decontamination.leaks(empty, table).count() == 0
    assert op4_decontamination.leaks(awkward, odd).count() == 0
    assert op4_decontamination.leaks(awkward, table.unionByName(odd).unionByName(table)).count() == 0
    assert op4_decontamination.drop_leaks(awkward, table).count() == awkward.count()
    own = spark.createDataFrame([(5, words(120, 3), 1), (5, words(120, 3), 1)], "item_id long, text string, doc_id int")
    assert {(r.doc_id, r.item_id) for r in op4_decontamination.leaks(awkward, own).collect()} == {(8, 5), (9, 5)}


# 5 URLs


def urls(n, seed):
    r, out = random.Random(seed), []
    for _ in range(n):
        bad = r.random() < 0.3
        host = ("-".join(r.choice(["win", "free", "buy", "best"]) for _ in range(3)) + str(r.randrange(99)) if bad else r.choice(["news", "shop", "docs"]) + r.choice("abc")) + r.choice([".example.com", ".example.org"])
        out.append((f"https://{host}/{r.randrange(10**6)}" + ("?a=1&b=2&c=3" if bad and r.random() < 0.7 else ""), int(bad)))
    return out


def test_url_trees_hold_out(spark):
    model = op5_urls.train(spark.createDataFrame(urls(1500, 1), "url string, label int"))
    held = urls(500, 2)
    p = model(pa.array([u for u, _ in held]))
    assert np.mean((p >= 0.5) == np.array([y for _, y in held])) >= 0.97


def test_training_on_few_distinct_urls(spark):
    """2,000,000 rows of 5 URLs: all 5 are drawn, and two classes make trees."""
    rows = spark.range(2_000_000).select(F.concat(F.lit("https://a"), (F.col("id") % 5).cast("string"), F.lit(".example.com/x")).alias("url"), (F.col("id") % 5 < 2).cast("int").alias("label"))
    model = op5_urls.train(rows)
    assert model.trees and abs(model.base - 0.4) < 1e-9
    one = drawn(spark.range(100_000).select(F.lit(7).cast("long").alias("o"), "id"), "o", 50)
    assert one.count() == 50


def test_url_scores_against_brute_force(spark):
    """The trees' scores by walking each tree for each URL, from features made one by one."""
    model = op5_urls.train(spark.createDataFrame(urls(400, 3), "url string, label int"))
    pages = spark.createDataFrame([(i, u) for i, (u, _) in enumerate(urls(60, 4))], "page_id long, url string")
    for r in op5_urls.score(pages, model).collect():
        x, one, two = op5_urls.features(pa.array([r.url]))
        x = [*x[0], model.rates[0].get(one[0], model.base), model.rates[1].get(two[0], model.base)]
        bins = [sum(e < v for e in edges) for edges, v in zip(model.edges, x)]
        margin = model.start
        for levels, value in model.trees:
            node = 0
            for where in levels:
                feature, cut = where[node]
                node = node * 2 + int(bins[feature] > cut)
            margin += value[node]
        assert abs(1 / (1 + np.exp(-margin)) - r.score) < 1e-9 and r.blocked == (r.score >= 0.5)


def test_urls_awkward(spark):
    pages = spark.createDataFrame([(1, None, "x"), (2, "", None), (None, "HTTP://A-b.C:80/p?q#f", "x"), (3, "no scheme", "x"), (3, "no scheme", "x"), (4, "http://" + "a" * 100_000, ""), (5, "http://ex.ämple/ü\nx#y\nz", "")], "page_id long, url string, score string")
    model = op5_urls.train(op5_urls.seeds(pages, ("a-b",)).union(spark.createDataFrame([(None, 1), ("x", None)], "url string, label int")))
    out = op5_urls.score(pages, model).collect()
    assert len(out) == 7 and sum(r.score is None for r in out) == 2 and not any(r.blocked for r in out if not r.url)
    flat = op5_urls.train(pages.select("url", F.lit(1).alias("label")))
    assert {r.score for r in op5_urls.score(pages, flat).collect()} == {None, 1.0}
    none = op5_urls.train(pages.select("url", F.lit(1).alias("label")).where("1 = 0"))
    assert op5_urls.score(pages.where("1 = 0"), none).count() == 0
    x, one, two = op5_urls.features(pa.array(["https://www.Ex-a.com:8080/a/b%20?q=1&r=2#frag"]))
    f = dict(zip(op5_urls.FEATURES, x[0]))
    assert (f["depth"], f["parameters"], f["hyphens"], f["secure"], f["escapes"], one[0], two[0]) == (2, 2, 1, 1, 1, "com", "ex-a.com")


# 6 fingerprints


def token_hashes(text):
    s = next(slices(pa.array([text]), WORD, lower=True))
    return s.hashes


def test_sketches_are_the_low_hashes(spark):
    a, b = words(3000, 1, 900), words(300, 2, 900)
    table = docs(spark, [(1, a, "a"), (2, b, "a"), (3, a + " " + b, "a"), (4, " ".join(a.split()[500:1100]), "a")])
    out = {r.doc_id: r for r in op6_fingerprints.sketch(table, scale=4).collect()}
    exact = {i: {tuple(t.split()[j : j + 5]) for j in range(len(t.split()) - 4)} for i, t in ((1, a), (2, b))}
    assert all(out[i].n_shingles == len(exact[i]) for i in (1, 2))
    assert set(out[4].sketch) <= set(out[1].sketch) and set(out[1].sketch) | set(out[2].sketch) <= set(out[3].sketch)
    full = {r.doc_id: set(r.sketch) for r in op6_fingerprints.sketch(table, scale=1).collect()}
    limit = (2**64 - 1) // 4
    assert set(out[1].sketch) == {h for h in full[1] if h % 2**64 <= limit}
    pairs = {(r.small_id, r.large_id): r.containment for r in op6_fingerprints.contained(op6_fingerprints.sketch(table, scale=4), op6_fingerprints.sketch(table, scale=4)).collect()}
    assert pairs[4, 1] == 1.0 and (1, 2) not in pairs
    made = op6_fingerprints.merge(op6_fingerprints.sketch(table.where("doc_id < 3"), scale=4).withColumn("k", F.lit(1)), "k").first()
    assert made.sketch == sorted(set(out[1].sketch) | set(out[2].sketch))


def test_sketches_awkward(awkward, empty):
    out = op6_fingerprints.sketch(awkward, scale=1).collect()
    assert len(out) == awkward.count()
    assert all(r.sketch == [] and r.n_shingles == 0 for r in out if r.doc_id in (1, 2, 6, 10))
    assert op6_fingerprints.sketch(empty).count() == 0
    c = awkward.sparkSession.createDataFrame([([], [1])], "a array<long>, b array<long>").select(op6_fingerprints.containment("a", "b")).first()[0]
    assert c is None


# 7 and 8: repeats


def brute_repeats(rows, size):
    where = defaultdict(set)
    for i, t in rows:
        w = (t or "").split()
        for p in range(len(w) - size + 1):
            where[tuple(w[p : p + size])].add((-(2**63) if i is None else i, p))
    times = Counter(tuple((t or "").split()[p : p + size]) for i, t in rows for p in range(len((t or "").split()) - size + 1))
    marks = defaultdict(set)
    for k, at in where.items():
        if times[k] > 1:
            for x in at:
                marks[x[0], "first" if x == min(at) else "later"].add(x[1])
    out = set()
    for (d, role), places in marks.items():
        start = last = None
        for p in sorted(places):
            if last is None or p - last > size:
                if last is not None:
                    out.add((d, start, last + size, role))
                start = p
            last = p
        out.add((d, start, last + size, role))
    return out


def repeat_rows(seed):
    r = random.Random(seed)
    shared = [words(r.randrange(5, 90), 70 + k, 50) for k in range(6)]
    rows = []
    for i in range(40):
        parts = [words(r.randrange(0, 40), 900 + i, 4000)]
        for _ in range(r.randrange(3)):
            parts += [r.choice(shared), words(r.randrange(0, 15), r.randrange(9999), 4000)]
        rows.append((i, " ".join(p for p in parts if p)))
    rows += [(100, "a b " * 60), (101, "a " * 90), (102, rows[3][1]), (103, rows[3][1] + " tail"), (7, rows[7][1]), (None, rows[5][1]), (104, None), (105, "")]
    return rows


@pytest.mark.parametrize("size", [6, 20])
def test_repeats_against_brute_force(spark, size):
    rows = repeat_rows(size)
    table = docs(spark, [(i, t, "a") for i, t in rows])
    want = brute_repeats(rows, size)
    for run in (op7_suffixes.repeats, partial(op7_suffixes.repeats, whole=True), op8_windows.repeated_windows):
        got = {(-(2**63) if r.doc_id is None else r.doc_id, r.start_token, r.end_token, r.role) for r in run(table, size).collect()}
        assert got == want, run


def test_one_window_in_very_many_documents(spark):
    """A passage in 60,000 documents: the count's bucket gets a row for each flush, not for each document."""
    passage = words(60, 11)
    table = spark.range(60_000).select(F.col("id").alias("doc_id"), F.concat(F.lit(passage + " u"), F.col("id").cast("string")).alias("text")).repartition(4)
    for run in (op8_windows.repeated_windows, op7_suffixes.repeats):
        got = run(table).groupBy("start_token", "end_token", "role").agg(F.count("*").alias("n"), F.min("doc_id").alias("d")).collect()
        assert sorted(map(tuple, got)) == [(0, 60, "first", 1, 0), (0, 60, "later", 59_999, 1)]
    key = np.zeros(5000, np.uint64)
    least, again, later = combined(key, np.arange(5000)[::-1].copy(), np.zeros(5000, np.int32))
    assert least.tolist() == [4999] and again.all() and len(later) == 4999


def test_neighbours_are_compared_by_words():
    words = np.array([5, 6, 7, 5, 6, 8, 5, 6, 7], np.uint64)
    assert op7_suffixes.alike(words, np.array([0, 6, 3]), 3).tolist() == [True, False]
    assert op7_suffixes.alike(words, np.array([0, 3, 6]), 2).tolist() == [True, True]


def test_combined_by_brute_force():
    r = np.random.default_rng(4)
    for n in (0, 1, 2, 400):
        key, doc, pos, mark = r.integers(0, 90, n).astype(np.uint64), r.integers(-3, 3, n), r.integers(0, 3, n), r.integers(0, 9, n) == 0
        least, again, later = combined(key, doc, pos, mark)
        groups = defaultdict(list)
        for i in range(n):
            groups[int(key[i])].append(i)
        want = {k: min((doc[i], pos[i]) for i in g) for k, g in groups.items()}
        assert {int(key[i]): (doc[i], pos[i]) for i in least} == want and len(least) == len(want)
        assert {int(key[i]): bool(a) for i, a in zip(least, again)} == {k: len(g) > 1 or bool(mark[g[0]]) for k, g in groups.items()}
        assert sorted(later) == [i for i in range(n) if (doc[i], pos[i]) != want[int(key[i])]]


def test_merged_order_is_a_suffix_array():
    r = random.Random(3)
    text = [r.randrange(3) for _ in range(200)]
    n = len(text)
    rank = {p: k for k, p in enumerate(sorted(range(n), key=lambda p: text[p:]))}
    name = np.array([rank[p] + 1 if p % 3 else 0 for p in range(n)] + [0, 0])
    t = np.array([*text, -1, -1])
    at = np.arange(n)
    order = op7_suffixes.merged_order(t[at], t[at + 1], name[at], name[at + 1], name[at + 2], at % 3)
    assert order.tolist() == sorted(range(n), key=lambda p: text[p:])


def test_anchors_are_shared_by_copies():
    rng = np.random.default_rng(4)
    for _ in range(50):
        h = rng.integers(0, 50, 60, dtype=np.uint64)
        got = set(op7_suffixes.anchors(h, np.array([0, 60]), 9).tolist())
        for s in range(52):
            assert s + int(np.argmin(h[s : s + 9])) in got
        assert len(got) < 60


def test_repeats_awkward(awkward, empty):
    for run in (op7_suffixes.repeats, op8_windows.repeated_windows):
        out = {(r.doc_id, r.start_token, r.end_token, r.role) for r in run(awkward).collect()}
        assert (5, 0, 20_000, "later") in out and (4, 0, 20_000, "first") in out and (8, 0, 120, "first") in out and (9, 0, 120, "later") in out
        assert run(empty).count() == 0


def test_cut_repeats(spark, awkward, empty):
    p = words(60, 77)
    table = docs(spark, [(1, "start one " + p + " end one", "a"), (2, "start two " + p + " last two", "a"), (3, p, "a"), (4, "", "a"), (5, None, "a"), (6, "é " + p, "a")])
    out = {r.doc_id: r for r in op7_suffixes.cut_repeats(table).collect()}
    assert out[1].text == "start one " + p + " end one" and out[2].text == "start two last two" and out[2].n_chars == 18
    assert 3 not in out and out[4].text == "" and out[5].text is None and out[6].text == "é"
    kept = op7_suffixes.cut_repeats(awkward)
    assert kept.columns == awkward.columns and {r.doc_id for r in kept.collect()} == {1, 2, 3, 4, 6, 7, 8, 10, None}
    assert op7_suffixes.cut_repeats(empty).count() == 0


# 9 token counts


def greedy(word, starting, continuing):
    n, at = 0, 0
    while at < len(word):
        known = starting if at == 0 else continuing
        z = next((z for z in range(len(word), at, -1) if word[at:z] in known), 0)
        if not z:
            return 1
        n, at = n + 1, z
    return n


def test_automaton_is_greedy_longest_match():
    r = random.Random(6)
    for _ in range(30):
        piece = lambda: bytes(r.choice(b"abc") for _ in range(r.randrange(1, 6)))
        start, more = {b" " + piece() for _ in range(12)} | {b" "}, {piece() for _ in range(12)}
        a = op9_tokens.Automaton(sorted(start), sorted(more))
        for _ in range(100):
            w = b" " + bytes(r.choice(b"abcd" if r.random() < 0.1 else b"abc") for _ in range(r.randrange(1, 14)))
            assert a.count(w) == greedy(w, start, more)


def test_token_counts(spark, awkward, empty):
    start, more = map(set, op9_tokens.pieces())
    table = {i: t for i, t in ((1, "Hello wörld, this is  a test\nof 漢字 counting"), (2, None), (3, " "))}
    out = {r.doc_id: (r.n_words, r.n_tokens) for r in op9_tokens.token_counts(docs(spark, [(i, t, "a") for i, t in table.items()])).collect()}
    assert out == {i: (len((t or "").split()), sum(greedy(b" " + w.encode(), start, more) for w in (t or "").split())) for i, t in table.items()}
    assert op9_tokens.token_counts(awkward).count() == awkward.count() and op9_tokens.token_counts(empty).count() == 0


# 10 licenses


def test_increasing_and_patience():
    r = random.Random(2)
    for _ in range(100):
        v = [r.randrange(30) for _ in range(r.randrange(0, 14))]
        got = [v[i] for i in op10_licenses.increasing(v)]
        ends = []
        for k, x in enumerate(v):
            ends.append(1 + max((ends[j] for j in range(k) if v[j] < x), default=0))
        best = max(ends, default=0)
        assert len(got) == best and all(a < b for a, b in zip(got, got[1:]))
    for _ in range(200):
        a, b = ([r.randrange(12) for _ in range(r.randrange(0, 30))] for _ in "ab")
        pairs = op10_licenses.patience(a, b)
        assert all(a[i] == b[j] for i, j in pairs) and all(x[0] < y[0] and x[1] < y[1] for x, y in zip(pairs, pairs[1:]))
        assert op10_licenses.patience(a, a) == [(i, i) for i in range(len(a))]


def test_license_scan(spark, awkward, empty):
    t = op10_licenses.TEMPLATES
    rows = [(1, words(50, 1) + "\n" + t["MIT"], "a"), (2, t["GPL-3.0"].upper() + words(9, 2) + "\n" + t["GPL-3.0"], "a"), (3, words(500, 3), "a"), (4, "# " + t["Apache-2.0 header"].replace("License.", "license\n#").replace("compliance", "accord") + " x", "a"), (5, t["MIT text"].replace("charge", "cost"), "a")]
    out = {(r.doc_id, r.license, r.n_aligned) for r in op10_licenses.scan(docs(spark, rows)).collect()}
    assert {(d, name) for d, name, _ in out} == {(1, "MIT"), (2, "GPL-3.0"), (4, "Apache-2.0 header"), (5, "MIT text")}
    assert len([1 for r in op10_licenses.scan(docs(spark, rows)).collect() if r.doc_id == 2]) == 2
    assert op10_licenses.scan(awkward).count() == 0 == op10_licenses.scan(empty).count()
    with pytest.raises(ValueError):
        op10_licenses.scan(empty, coverage=0)


def test_license_scan_finds_spread_words(spark):
    text = op10_licenses.TEMPLATES["MIT text"].split()
    table = docs(spark, [(1, " x1y ".join(text), "a"), (2, " z z z z z z ".join(text), "a"), (3, words(400, 3), "a")])
    out = op10_licenses.scan(table).collect()
    assert [(r.doc_id, r.license, r.coverage) for r in out] == [(1, "MIT text", 1.0)]
    assert {r.doc_id for r in op10_licenses.scan(table, spread=8.0).collect()} == {1, 2}


def longest(a, b):
    """Brute force: a longest common subsequence of two lists."""
    d = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            d[i + 1][j + 1] = d[i][j] + 1 if x == y else max(d[i][j + 1], d[i + 1][j])
    return d[-1][-1]


def test_license_scan_against_brute_force(spark):
    """Where a stretch's words hold a notice by a longest common subsequence, of words that are unique, the scan has it, and nothing else."""
    r = random.Random(6)
    notices = {f"n{k}": " ".join(f"k{k}w{j}" for j in range(4 + 3 * k)) for k in range(5)}
    rows = []
    for i in range(60):
        k = i % 5
        w = notices[f"n{k}"].split()
        for _ in range(r.randrange(0, 3)):
            w[r.randrange(len(w))] = "other"
        gap = r.randrange(0, 4)
        mixed = [x for y in w for x in [y, *["f"] * r.randrange(gap + 1)]]
        rows.append((i, " ".join([*words(40, i).split(), *mixed, *words(30, 99 + i).split()]), "a"))
    want = set()
    for i, text, _ in rows:
        t = text.split()
        for name, notice in notices.items():
            n = notice.split()
            wide = int(op10_licenses.SPREAD * len(n)) + 1
            if max(longest(n, t[a : a + wide]) for a in range(len(t))) >= op10_licenses.COVERAGE * len(n):
                want.add((i, name))
    got = {(x.doc_id, x.license) for x in op10_licenses.scan(docs(spark, rows), notices).collect()}
    assert got == want and len(want) > 20


def test_license_scan_finds_close_copies(spark):
    t = op10_licenses.TEMPLATES
    sparse = "Released xx under yy the MIT License. Released under the MIT License."
    rows = [(1, t["Proprietary"] + " " + t["Proprietary"], "a"), (2, " ".join([t["Proprietary"]] * 6), "a"), (3, t["MIT"] * 2, "a"), (4, sparse, "a"), (5, " ".join([t["GPL-3.0 header"]] * 3), "a"), (6, t["MIT"] + " a b " + t["Proprietary"] * 2 + t["MIT"], "a")]
    found = op10_licenses.scan(docs(spark, rows)).collect()
    spans = {i: sorted((r.start_token, r.end_token) for r in found if r.doc_id == i) for i, *_ in rows}
    assert spans[1] == [(0, 3), (3, 6)] and spans[2] == [(3 * k, 3 * k + 3) for k in range(6)]
    assert spans[3] == [(0, 5), (5, 10)] and spans[4] == [(0, 7), (7, 12)] and len(spans[5]) == 3
    assert spans[6] == [(0, 5), (7, 10), (10, 13), (13, 18)]


# the pipeline


def test_pipeline(spark, small, tmp_path):
    import corpus_pipeline as p

    assert [n for n, _ in p.STAGES] == ["toxicity", "near_duplicates", "repeated_passages", "decontamination", "mixing"]
    source = spark.read.parquet(f"{small}/documents.parquet")
    out = p.run(spark, small)
    assert set(source.columns) <= set(out.columns)
    ids = [r.doc_id for r in out.select("doc_id").collect()]
    assert len(ids) == len(set(ids)) > 0
    toxic = {r.doc_id for r in op2_toxicity.score(source, spark.read.parquet(f"{small}/labels.parquet")).where("toxic").collect()}
    assert not toxic & set(ids)


def cut_by_hand(rows, size):
    """Texts without the tokens of later occurrences, as lists of tokens."""
    gone = defaultdict(set)
    for i, a, z, role in brute_repeats([(i, t) for i, t in rows], size):
        if role == "later":
            gone[i] |= set(range(a, z))
    kept = {i: [w for k, w in enumerate(t.split()) if k not in gone[i]] for i, t in rows}
    return {i: w for i, w in kept.items() if w or not gone[i]}


def test_pipeline_stages_against_brute_force(spark, tmp_path):
    """Each stage on what the one before kept: ids and tokens by hand from labels' scores, all pairs of signatures, all windows, common subsequences."""
    import corpus_pipeline as p

    toxic, labels = toxic_rows(120)
    rows = [(i, t + " " + words(70, 1000 + i, 3000), "ab"[i % 2]) for i, t, _ in toxic]
    passage, items = words(70, 31, 3000), {k: words(30, 400 + k, 3000) + ". " + words(8, 800 + k, 3000) for k in range(4)}
    for i in range(121, 129):  # a shared passage; benchmark items; near copies
        rows.append((i, words(60, i, 3000) + " " + passage + " " + words(50, 50 + i, 3000), "c"))
        rows.append((i + 10, words(60, i + 10, 3000) + " " + items[i % 4] + " " + words(60, 90 + i, 3000), "c"))
        rows.append((i + 20, rows[i - 121][1] + " more", None))
    docs(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, LABELS).write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame(list(items.items()), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    source, sf = spark.read.parquet(f"{tmp_path}/documents.parquet"), str(tmp_path)
    now = {i: t for i, t, _ in rows}

    def step(k, df):
        out = p.STAGES[k][1](spark, df, sf)
        assert k == 4 or out.columns == source.columns
        out.write.parquet(f"{tmp_path}/stage{k}")
        out = spark.read.parquet(f"{tmp_path}/stage{k}")
        return out, {r.doc_id: r.text for r in out.collect()}

    bad = {r.doc_id for r in op2_toxicity.score(source, spark.read.parquet(f"{sf}/labels.parquet")).collect() if r.toxic}
    table, got = step(0, source)
    now = {i: t for i, t in now.items() if i not in bad}
    assert got == now and len(bad) > 15

    sig = {r.doc_id: np.frombuffer(r.sig, np.uint8) for r in op3_neardup.signatures(table).collect()}
    head = {i: i for i in sig}
    for i in sorted(sig):
        for j in sorted(sig):
            if i < j and (sig[i] != sig[j]).sum() <= op3_neardup.THRESHOLD and head[i] != head[j]:
                a, b = sorted((head[i], head[j]))
                head = {k: a if h == b else h for k, h in head.items()}
    table, got = step(1, table)
    now = {i: t for i, t in now.items() if head[i] == i}
    assert got == now and len(head) > len(now)

    want = cut_by_hand(sorted(now.items()), op7_suffixes.LENGTH)
    table, got = step(2, table)
    assert {i: t.split() for i, t in got.items()} == want and got != now
    now = got

    def covered(w, tail, t):
        for start in range(0, len(t), 16):
            near = t[max(0, start - len(w)) : start + 32 + len(w)]
            cover = longest(w, near) / len(w)
            if cover >= op4_decontamination.COVER or cover >= op4_decontamination.PARTIAL and longest(w[-tail:], near) / tail >= op4_decontamination.ANSWERED:
                return True
        return False

    leaked = {i for i, t in now.items() if any(len(set(w := x.replace(".", "").split()) & set(t.split())) > len(w) / 3 and covered(w, 8, t.split()) for x in items.values())}
    table, got = step(3, table)
    now = {i: t for i, t in now.items() if i not in leaked}
    assert got == now and len(leaked) >= 6

    table, got = step(4, table)
    assert got == now and table.count() == len(now)
    assert {r.doc_id: r.text for r in p.run(spark, sf).collect()} == now


def test_pipeline_of_awkward_tables(spark, awkward, empty, tmp_path):
    import corpus_pipeline as p

    for k, table in enumerate((awkward, empty)):
        d = f"{tmp_path}/{k}"
        table.write.parquet(f"{d}/documents.parquet")
        spark.createDataFrame([(8, 1, 0, "x")], LABELS).write.parquet(f"{d}/labels.parquet")
        bench(spark, 2)[0].write.parquet(f"{d}/benchmark.parquet")
        rows = p.run(spark, d).count()
        assert (rows > 0) == (k == 0)


def test_registered_queries_have_columns(spark, small):
    from textloom.llm import queries

    for name, q in queries.QUERIES.items():
        assert q(spark, small).columns, name
