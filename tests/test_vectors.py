"""Retrieval and thinning against brute force."""

import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from hearken.operators import embedding, ivf, retrieval, thinning
from hearken.operators.arrays import Best
from hearken.plans.corpus import index_documents
from hearken.session import scratch_path, settle
from hearken.sources.writers import write_vectors

SCHEMA = "vec_id long, embedding array<float>"


def frame(spark, vectors):
    return spark.createDataFrame(
        [(i, [float(x) for x in v]) for i, v in enumerate(vectors)], SCHEMA
    ).repartition(3)


def brute(queries, corpus, ks):
    q, c = np.float32(queries).astype(float), np.float32(corpus).astype(float)

    def unit(m):
        n = np.linalg.norm(m, axis=1, keepdims=True)
        return np.divide(m, n, out=np.zeros_like(m), where=n > 0)

    scores = np.round(unit(q) @ unit(c).T, 6)
    out = []
    for i, k in enumerate(ks):
        order = np.lexsort((np.arange(len(c)), -scores[i]))[:k]
        out += [(i, r + 1, int(d), float(scores[i, d])) for r, d in enumerate(order)]
    return out


@pytest.fixture(scope="module")
def clumped():
    """A third of the corpus is one vector, and there is a zero vector."""
    rng = np.random.default_rng(3)
    spread = rng.normal(size=(80, 8))
    return np.vstack([np.tile(spread[:1], (40, 1)), spread, np.zeros((1, 8))])


def answers(df):
    return [tuple(r) for r in df.orderBy("query_id", "rank").collect()]


def test_top_k_equals_brute_force_with_ties(spark, clumped):
    ks = [i % 7 + 1 for i in range(len(clumped))]
    queries = frame(spark, clumped).withColumn("k", (F.col("vec_id") % 7 + 1).cast("int"))
    got = retrieval.top_k(queries, frame(spark, clumped), "k", "vec_id", "vec_id")
    assert answers(got) == brute(clumped, clumped, ks)


def test_cells_give_the_same_hits(spark, clumped):
    cells = retrieval.build_cells(frame(spark, clumped), 5)
    assert cells.size.sum() == len(clumped)
    queries = frame(spark, clumped)
    got = retrieval.top_k_cells(
        queries, cells, 3, "vec_id", "vec_id", block_rows=7, query_rows=5
    )
    assert answers(got) == brute(clumped, clumped, [3] * len(clumped))
    # Too many queries for the broadcast way: top_k takes the cells by itself.
    large = retrieval.top_k(queries, queries, 3, "vec_id", "vec_id", small_query_set=10)
    assert answers(large) == brute(clumped, clumped, [3] * len(clumped))


def test_k_beyond_the_corpus_returns_all(spark):
    v = [[1, 0], [0, 1], [1, 1]]
    got = retrieval.top_k(frame(spark, v), frame(spark, v), 10, "vec_id", "vec_id")
    assert answers(got) == brute(v, v, [10] * 3)


def test_missing_answer_prints_as_empty_text(spark):
    hits = spark.createDataFrame(
        [(1, 1, 5, 0.9), (1, 2, 6, 0.8)], "query_id long, rank int, doc_id long, score double"
    )
    pairs = spark.createDataFrame([(5, "q5", None), (6, "q6", "a6")],
                                  "doc_id long, context string, response string")
    got = retrieval.format_context(retrieval.hits_with_sources(hits, pairs)).first()
    assert got.context == "Client: q5\nCounselor: \n\n---\n\nClient: q6\nCounselor: a6"


def members(spark, groups):
    data, i = [], 0
    for g, vectors in groups.items():
        for v in vectors:
            data.append((g, i, len(vectors), [float(x) for x in v]))
            i += 1
    return spark.createDataFrame(
        data, "group_id long, pair_id long, n long, embedding array<float>"
    ).repartition(3)


def test_thinning_same_by_group_and_by_slices(spark):
    rng = np.random.default_rng(5)
    centres = np.eye(6)[:4] * 5
    blobs = np.vstack([c + rng.normal(scale=0.1, size=(15, 6)) for c in centres])
    copies = np.tile(rng.normal(size=(1, 6)), (30, 1))
    small = rng.normal(size=(3, 6))
    table = members(spark, {1: blobs, 2: copies, 3: small})
    whole = sorted(map(tuple, thinning.pick_representatives(table, 4)
                       .fillna(-1).collect()))
    sliced = sorted(map(tuple, thinning.pick_representatives(table, 4, group_rows=10)
                        .fillna(-1).collect()))
    assert whole == sliced
    picks = {g: [p for h, _, p, _ in whole if h == g] for g in (1, 2, 3)}
    # One pick per blob; copies give the same row k times; a small group stays whole.
    assert sorted(p // 15 for p in picks[1]) == [0, 1, 2, 3]
    assert picks[2] == [60] * 4 and sorted(picks[3]) == [90, 91, 92]
    once = thinning.pick_representatives(table, 4, dedupe=True)
    assert once.where("group_id = 2").count() == 1


def test_nearest_to_centroid_searches_whole_group(spark):
    df = spark.createDataFrame(
        [(1, 0, 10, [1.0, 0.0]), (1, 0, 11, [0.0, 1.0]), (1, 1, 12, [1.0, 1.0])],
        "g long, c int, id long, embedding array<float>",
    )
    centres = thinning.centroids(df, "g", "c")
    got = thinning.nearest_to_centroids(df, centres, "g", "c", "id", rows_per_slice=1)
    # The mean of cluster 0 points along the member of cluster 1.
    assert sorted((r.c, r.id) for r in got.collect()) == [(0, 12), (1, 12)]


def test_embedding_is_unit_or_zero(spark):
    docs = spark.createDataFrame(
        [(1, "calm sea"), (2, "calm sky"), (3, "rough sea"), (4, " ")], "doc_id long, text string"
    )
    model = embedding.fit_embedder(docs)
    lengths = {r.doc_id: np.linalg.norm(r.embedding) for r in embedding.embed(model, docs).collect()}
    assert lengths == {1: pytest.approx(1), 2: pytest.approx(1), 3: pytest.approx(1), 4: 0}


def test_vectors_table_is_kept_unless_forced(spark, tmp_path):
    path = str(tmp_path / "v")
    one, two = frame(spark, [[1, 0]]), frame(spark, [[1, 0], [0, 1]])
    write_vectors(one, path)
    write_vectors(two, path)
    assert spark.read.parquet(path).count() == 1
    write_vectors(two.withColumn("cell", F.lit(3)), path, force_recreate=True)
    stored = spark.read.parquet(path)
    assert stored.count() == 2 and stored.where("cell = 3").count() == 2


def cloud(spark, n=600, width=10, seed=9):
    rng = np.random.default_rng(seed)
    middle = rng.normal(size=(6, width))
    points = middle[rng.integers(0, 6, n)] + 0.4 * rng.normal(size=(n, width))
    rows = [(i, p.tolist()) for i, p in enumerate(points)]
    rows += [(n, [0.0] * width), (n + 1, None), (n + 2, points[0].tolist())]
    return spark.createDataFrame(rows, "doc_id long, embedding array<double>").repartition(3)


def test_probed_lists_find_nearly_all(spark):
    vectors = cloud(spark)
    index = ivf.build_index(vectors)
    assert index.size.sum() == 602 and len(index.size) > 10
    assert index.lists.agg(F.max(F.length("code"))).first()[0] == 3  # ten numbers in parts of four
    exact = retrieval.top_k(vectors, vectors, 5, "doc_id", "doc_id")
    n_probe = ivf.probes_for(index, 0.95, 5)
    found = ivf.search_index(vectors, index, 5, "doc_id", n_probe=n_probe)
    assert ivf.recall(found, exact).first()["recall"] >= 0.9
    assert 0 < index.share_read(vectors, n_probe) < 1
    # all cells and many candidates: the exact search
    whole = ivf.search_index(vectors, index, 5, "doc_id", n_probe=len(index.size), refine=200)
    assert sorted(map(tuple, whole.collect())) == sorted(map(tuple, exact.collect()))


def test_probed_lists_in_slices(spark, monkeypatch):
    vectors = cloud(spark, 200)
    index = ivf.build_index(vectors, 3)
    want = sorted(map(tuple, ivf.search_index(vectors, index, 2, "doc_id", n_probe=4).collect()))
    monkeypatch.setattr(ivf, "LIST_ROWS", 7)
    monkeypatch.setattr(ivf, "QUERY_ROWS", 5)
    assert sorted(map(tuple, ivf.search_index(vectors, index, 2, "doc_id", n_probe=4).collect())) == want


def test_search_writes_neither_probes_nor_candidates(spark, monkeypatch):
    vectors = cloud(spark, 400)
    index, written = ivf.build_index(vectors), []

    def counted(df):
        written.append(df.count())
        return settle(df)

    monkeypatch.setattr(ivf, "settle", counted)
    found = ivf.search_index(vectors, index, 2, "doc_id", n_probe=len(index.size)).count()
    monkeypatch.setattr(ivf, "QUERY_ROWS", 150)
    assert ivf.search_index(vectors, index, 2, "doc_id", n_probe=len(index.size)).count() == found
    # in blocks: the queries and the hits, each once
    assert found == 2 * 402 and sum(written) <= 402 + found


def test_best_rows_of_offers_in_any_order(monkeypatch):
    rng = np.random.default_rng(5)
    scores = np.round(rng.normal(size=(7, 500)), 1)  # many ties
    scores[:, 100:300] = scores[:, :1]
    limits, ids = np.array([0, 1, 3, 40, 7, 600, 2]), rng.permutation(500)
    for held in (1 << 20, 50):
        monkeypatch.setattr(Best, "HELD", held)
        best = Best(limits, 6)
        for low in range(0, 500, 60):
            for some in (np.arange(4), np.arange(4, 7)):
                best.offer(some, ids[low : low + 60], scores[some, low : low + 60])
        best.sort()
        for q, k in enumerate(limits):
            own = np.lexsort((ids, -scores[q]))[:k]
            assert best.id[best.query == q].tolist() == ids[own].tolist()
            assert best.score[best.query == q].tolist() == scores[q, own].tolist()


def test_scores_in_floats_decide_nothing(spark, monkeypatch):
    rng = np.random.default_rng(11)
    near = rng.normal(size=(1, 16)) + 1e-5 * rng.normal(size=(300, 16))  # floats cannot order these
    vectors = np.vstack([near, rng.normal(size=(60, 16)), np.tile(near[:1], (30, 1))])
    want = brute(vectors.astype(np.float32), vectors.astype(np.float32), [4] * len(vectors))
    for many in (1 << 30, 16, 0):  # whole slices in doubles always, at times, never
        monkeypatch.setattr(retrieval, "MANY", many)
        asked = retrieval._prepared(frame(spark, vectors), "vec_id", "embedding", "query_id", F.lit(4).alias("k"))
        docs = retrieval._prepared(frame(spark, vectors), "vec_id", "embedding", "doc_id")
        scan = retrieval._scan_for(asked.toArrow())
        hits = [h for b in scan(iter(docs.toArrow().to_batches())) for h in b.to_pylist()]
        assert sorted((h["query_id"], h["doc_id"]) for h in hits) == sorted((q, d) for q, _, d, _ in want)


def test_probed_lists_of_few_vectors(spark):
    vectors = cloud(spark, 200)
    for part in (vectors.where("doc_id = 3"), vectors.where("doc_id = 200"), vectors.where("false")):
        index = ivf.build_index(part)
        n = part.count()
        found = ivf.search_index(vectors.where("doc_id < 5"), index, 3, "doc_id").collect()
        assert len(found) == 5 * n and all(r["rank"] == 1 for r in found)
        assert ivf.probes_for(index) == 1


def test_files_follow_cells_not_tasks(spark, tmp_path):
    vectors = spark.range(4000).selectExpr(
        "id AS doc_id", "array(double(id), 1.0) AS embedding", "int(id % 5) AS cell"
    ).repartition(16)
    write_vectors(vectors, str(tmp_path / "v"))
    files = list((tmp_path / "v").rglob("*.parquet"))
    assert len(files) == 5
    assert spark.read.parquet(str(tmp_path / "v")).where("cell = 3").count() == 800


def test_large_groups_shuffle_vectors_once(spark):
    rng = np.random.default_rng(3)
    rows = [(g, 1000 * g + i, 120, rng.normal(size=4).tolist()) for g in (1, 2) for i in range(120)]
    members = spark.createDataFrame(rows, "group_id long, pair_id long, n long, embedding array<double>")
    whole = sorted(map(tuple, thinning.pick_representatives(members).collect()))
    for rows_at_once, centres in ((30, 64 << 20), (7, 64)):  # the second takes groups one by one
        thinning.CENTRE_BYTES, before = centres, thinning.CENTRE_BYTES
        try:
            sliced = thinning.pick_representatives(members, group_rows=rows_at_once)
            plan = sliced._jdf.queryExecution().executedPlan().toString()
            got = sorted(map(tuple, sliced.collect()))
        finally:
            thinning.CENTRE_BYTES = before
        assert [r[:3] for r in got] == [r[:3] for r in whole]
        # what is left to run reads packed slices: no exchange stands below the pass over them
        assert "FlatMapGroupsInArrow" not in plan.split("MapInArrow")[-1]


def test_scores_come_in_bounded_slices(clumped):
    got = list(retrieval.score_slices(clumped, clumped[:50], held=175))
    assert [q for q, _ in got] == list(range(len(clumped)))
    assert np.allclose(np.stack([row for _, row in got]), np.round(clumped @ clumped[:50].T, 6))
    assert all(row.base.size <= 175 for _, row in got)
    assert list(retrieval.score_slices(clumped[:0], clumped)) == []


def test_probing_rows_come_in_bounded_batches(spark, monkeypatch, clumped):
    monkeypatch.setattr(ivf, "HELD_SCORES", 30)
    monkeypatch.setattr(retrieval, "HELD_SCORES", 64)
    index = ivf.build_index(frame(spark, clumped), n_cells=5, doc_id="vec_id")
    asked = retrieval._prepared(frame(spark, clumped), "vec_id", "embedding", "query_id", F.lit(2).alias("k"))
    assert dict(asked.dtypes)["vector"] == "array<float>"
    batches = list(ivf._probes(index, 3)(iter(asked.toArrow().to_batches())))
    assert max(b.num_rows for b in batches) <= 8
    take = min(3, int((index.size > 0).sum()))
    assert sum(b.num_rows for b in batches) == take * len(clumped)
    pairs = {(q, c) for b in batches for q, c in zip(b["query_id"].to_pylist(), b["cell"].to_pylist(), strict=True)}
    assert len(pairs) == take * len(clumped)


def test_short_slices_of_a_group_are_read_as_one():
    def packed(group, at, ids):
        x = np.array([[i, -i] for i in ids], float)
        return {"group_id": group, "slice": at, "width": 2, "ids": np.array(ids, np.int64).tobytes(),
                "vectors": x.tobytes(), "races": (x + 0.5).tobytes()}

    rows = [packed(7, 0, [1, 2]), packed(7, 1, [3]), packed(8, 0, [4]), packed(7, 2, [5])]
    batches = pa.Table.from_pylist(rows).to_batches(max_chunksize=1)
    got = [(g, ids.tolist(), x[:, 1].tolist(), race[:, 0].tolist()) for g, x, ids, race in thinning._unpacked(iter(batches))]
    assert got == [
        (7, [1, 2, 3], [-1, -2, -3], [1.5, 2.5, 3.5]), (8, [4], [-4], [4.5]), (7, [5], [-5], [5.5])
    ]
    full = [packed(7, 0, list(range(thinning.SLICE_ROWS))), packed(7, 1, [5000])]
    sizes = [len(x) for _, x, _, _ in thinning._unpacked(iter(pa.Table.from_pylist(full).to_batches()))]
    assert sizes == [thinning.SLICE_ROWS, 1]


def test_fit_and_embed_is_fit_then_embed(spark):
    texts = ["a b c", "b  C d", "", " \n", None, "e", "a a a"]
    docs = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    plain = embedding.embed(embedding.fit_embedder(docs), docs)
    once = embedding.fit_and_embed(docs)
    assert once.columns == plain.columns
    assert sorted(map(str, once.collect())) == sorted(map(str, plain.collect()))


def test_index_embeds_every_document_once(spark):
    seen = spark.sparkContext.accumulator(0)

    @F.udf("array<float>")
    def vector(i):
        seen.add(1)
        return [1.0, float(i % 7), float(i % 3)]

    docs = spark.range(40).select(F.col("id").alias("doc_id"), F.lit("c").alias("context"), F.lit("r").alias("response"))
    path = scratch_path(spark, "once")
    index_documents(docs, path, True, n_cells=2, embedder=lambda df: df.withColumn("embedding", vector("doc_id")))
    assert spark.read.parquet(path).count() == 40
    assert seen.value == 40


def test_group_is_clustered_without_copies_of_its_matrix():
    x = np.random.default_rng(3).normal(size=(20_000, 64))
    ids, centres = np.arange(len(x)), x[:5].copy()
    tracemalloc.start()
    near = thinning.squared_distances(x, centres)
    picked, _ = thinning.closest(x, ids, centres)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < x.nbytes / 2
    assert near.argmin(axis=0).tolist() == picked.tolist() == [0, 1, 2, 3, 4]
    assert (near == np.stack([((x - c) ** 2).sum(axis=1) for c in centres], axis=1)).all()
