"""The registered queries and the pipeline over the smallest tables, against brute force."""

import collections
import re
from pathlib import Path

import numpy as np
import pytest

from larkspur.llm import vectors
from larkspur.llm.registry import queries

from pyspark.sql import functions as F

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(DATA).exists(), reason="no test tables")


def test_every_operator_has_its_query():
    assert sorted(int(re.match(r"op(\d+)_", q)[1]) for q in queries()) == list(range(1, 14))


def brute_nearest(rows, k):
    own = {}
    for i, v in rows:
        if i is not None and v and None not in v and np.isfinite(v).all() and any(v) and len(v) == 8:
            own.setdefault(i, v)
    ids, x = np.array(list(own)), np.array(list(own.values()), dtype=np.float64)
    out = {}
    for n, i in enumerate(ids.tolist()):
        if i % 100 == 0:
            d = np.sqrt(((x - x[n]) ** 2).sum(axis=1))
            d[n] = np.inf
            out[i] = [(ids[j], d[j]) for j in np.lexsort((ids, d))[: min(k, len(ids) - 1)]]
    return out


@pytest.mark.parametrize("n", [3, 900])
def test_neighbours_and_odd_vectors(spark, n):
    rng = np.random.default_rng(7)
    centres = rng.normal(size=(12, 8)) * 3
    rows = [(i, [float(np.float32(x)) for x in centres[i % 12] + rng.normal(size=8)]) for i in range(n)]
    rows += [(i, rows[0][1]) for i in range(2000, 2030)] + [(100_000, None), (100_100, [0.0] * 8), (100_200, [float("nan")] * 8), (100_300, [None] * 8), (100_400, [1.0]), (None, [1.0] * 8), (100_500, [float("inf")] * 8), (100_600, []), rows[0], rows[0]]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumns({"id": F.lit(1), "v": F.lit(2), "rep": F.lit(3)})
    got = collections.defaultdict(list)
    for r in vectors.nearest_neighbours(df, F.col("vec_id") % 100 == 0).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    want = brute_nearest(rows, 10)
    assert set(got) == set(want)
    hits = [len({i for i, _ in got[q]} & {i for i, _ in want[q]}) / len(want[q]) for q in want]
    assert np.mean(hits) >= 0.9 and all(len(got[q]) == len(want[q]) for q in want)
    assert [i for i, _ in got[0]] == list(range(2000, 2010)) and all(s == 0 for _, s in got[0])
    distance = {i: v for i, v in rows if v and None not in v}
    for q in got:
        for i, s in got[q]:
            assert s == pytest.approx(float(np.linalg.norm(np.array(distance[q]) - np.array(distance[i]))), abs=1e-9)
    assert vectors.nearest_neighbours(df.limit(0), F.lit(True)).count() == 0


def test_graph_search_finds_the_nearest_centroids():
    rng = np.random.default_rng(1)
    centroids = rng.normal(size=(700, 16)).astype(np.float32)
    graph, x = vectors.CentroidGraph.of(centroids), rng.normal(size=(200, 16)).astype(np.float32)
    ids, far = graph.search(x, 10)
    want = np.argsort(((x[:, None] - centroids[None]) ** 2).sum(axis=2), axis=1)[:, :10]
    assert np.mean([len(set(a) & set(b)) / 10 for a, b in zip(ids.tolist(), want.tolist(), strict=True)]) > 0.95 and (np.diff(far) >= 0).all()


def test_pipeline_stages(spark):
    import corpus_pipeline as c

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    given = {r.doc_id: r.text for r in docs.collect()}
    kept = c.staged(c.toxicity(spark, docs, DATA), "a")
    assert kept.columns == docs.columns and set(r.doc_id for r in kept.collect()) <= set(given)
    alone = c.staged(c.ngram_jaccard_join(spark, kept, DATA), "b")
    ids = [r.doc_id for r in alone.collect()]
    assert alone.columns == docs.columns and len(ids) == len(set(ids))

    def grams(t):
        w = (t or "").encode().lower().split()
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} - {()}

    sets = {i: grams(given[i]) for i in (r.doc_id for r in kept.collect())}
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    order = sorted(sets)
    for n, a in enumerate(order):
        for b in order[:n]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 75 * len(sets[a] | sets[b]):
                parent[max(root(a), root(b))] = min(root(a), root(b))
    assert sorted(ids) == [i for i in order if root(i) == i]
    mixed = c.staged(c.mixing(spark, alone, DATA), "c")
    copies = collections.Counter(r.doc_id for r in mixed.collect())
    assert mixed.columns == docs.columns and set(copies) <= set(ids) and max(copies.values()) <= 2
    size = {i: len(re.findall(r"[^\x20\x09-\x0D]+", given[i] or "")) for i in ids}
    assert sum(size[i] * n for i, n in copies.items()) == pytest.approx(1.5 * sum(size.values()), rel=0.01)
    packed = c.packing(spark, mixed, DATA).collect()
    assert collections.Counter((r.doc_id) for r in packed if r.start == 0) == copies


def test_pipeline_tells_rows_apart(spark):
    import corpus_pipeline as c

    a, b, n = (" ".join(f"{x}{i}" for i in range(60)) for x in "abn")
    rows = [(1, a), (1, a), (2, b), (1, b), (None, n), (None, n), (None, n + " more"), (None, a), (3, "x y z"), (4, ""), (3, "another text here")]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    alone = c.staged(c.ngram_jaccard_join(spark, docs, DATA), "alone")
    got = sorted(((r.doc_id, r.text) for r in alone.collect()), key=str)
    assert len(got) == 6 and {(1, a), (1, b), (3, "x y z"), (3, "another text here"), (4, "")} < set(got)
    assert [i for i, t in got if t.startswith("n")] == [None]
    taken = c.mixing(spark, alone, DATA).count()
    want = c.mix_sources(alone.withColumn("doc_id", F.xxhash64("doc_id", "text"))).agg(F.sum("copies")).first()[0]
    assert abs(taken - want) <= 2


def test_null_ids_link_by_their_texts(spark):
    chain = [" ".join(f"w{i}" for i in range(s, s + 40)) for s in (0, 4, 8)]  # the ends link through the middle only
    df = spark.createDataFrame([(7, chain[0]), (None, chain[1]), (9, chain[2])], "doc_id long, text string")
    from larkspur.llm.ngramjoin import near_duplicates

    assert {r.component_id for r in near_duplicates(df).collect()} == {7}


def test_stages_on_odd_rows(spark):
    import corpus_pipeline as c

    rows = [(1, "a b c d e f", "en", None, 11), (1, "a b c d e f", "de", "s", 11), (None, None, None, None, None), (None, "", "en", "t", 0), (2, "w " * 30_000, "en", "s", 60_000), (3, "A b c d e f", "en", "s", 11)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs = docs.withColumns({"row": F.lit("x"), "predicted": F.lit(5), "copy": F.array(F.lit(1)), "times": F.create_map(F.lit("k"), F.lit(2)), "other_0": F.lit(0.5)})
    empty = docs.limit(0)
    for name, stage in c.STAGES:
        if name == "packing":
            assert stage(spark, empty, DATA).count() == 0 and {(r.doc_id, r.doc_tokens) for r in stage(spark, docs, DATA).collect()} >= {(None, 1)}
            continue
        assert stage(spark, empty, DATA).count() == 0
        got = stage(spark, docs, DATA)
        assert got.dtypes == docs.dtypes
        found = got.collect()
        assert all((r["row"], r.predicted, r.copy, r.times, r.other_0) == ("x", 5, [1], {"k": 2}, 0.5) for r in found)
        own = collections.Counter(tuple(r)[:5] for r in found)
        if name == "toxicity":
            assert own == collections.Counter(rows)
        if name == "ngram_jaccard_join":
            assert own == collections.Counter([rows[1], rows[2], rows[3], rows[4]])
        if name == "mixing":
            assert set(own) <= set(rows) and max(own.values()) <= 2


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_sql_twins(spark, sf):
    import duckdb

    from larkspur.llm.registry import oracle_sql

    folder = f"/root/testdata/{sf}"
    con = duckdb.connect()
    for t in ("documents", "pages", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    for name, sql in oracle_sql().items():
        want = con.execute(sql)
        columns = [c[0] for c in want.description]
        got = queries()[name](spark, folder).select(*columns)
        assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want.fetchall())), name


def test_recall_over_many_lists(spark):
    """A hundred lists or more, of which a query reads a part."""
    rng = np.random.default_rng(11)
    centres = rng.normal(size=(40, 8)) * 2
    rows = [(i, [float(np.float32(x)) for x in centres[i % 40] + rng.normal(size=8)]) for i in range(8_000)]
    assert len(rows) // vectors.LIST_ROWS > 100
    got = collections.defaultdict(list)
    for r in vectors.nearest_neighbours(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), F.col("vec_id") % 100 == 0).orderBy("query_id", "rank").collect():
        got[r.query_id].append(r.vec_id)
    want = brute_nearest(rows, 10)
    assert set(got) == set(want)
    assert np.mean([len(set(got[q]) & {i for i, _ in want[q]}) / 10 for q in want]) >= 0.9


def test_held_out_documents_are_told_apart(spark):
    """Labels that the fit didn't see, over the whole table."""
    folder = "/root/testdata/sf0.1"
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{folder}/labels.parquet").select("doc_id", "toxic").collect() if r.toxic is not None}
    scored = [r for r in queries()["op6_toxicity"](spark, folder).collect() if r.held_out and r.doc_id in labels]
    toxic, clean = ([r for r in scored if labels[r.doc_id] == y] for y in (1, 0))
    assert len(toxic) > 50 and len(clean) > 500
    assert sum(r.predicted for r in toxic) >= 0.85 * len(toxic)
    assert sum(r.predicted for r in clean) <= 0.01 * len(clean)
    assert all(0 <= r.score <= 1 for r in scored)
