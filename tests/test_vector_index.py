"""Pruned search against the full scan, and scoped search against its rule."""

from __future__ import annotations

import tempfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyframe.operators import documents, vector_index, vectors


def frame(spark, matrix, name="item_id", extra=None):
    rows = [(int(i), [float(x) for x in v], *(extra(i) if extra else ())) for i, v in enumerate(matrix)]
    return spark.createDataFrame(rows, f"{name} long, vector array<float>" + (", access_scope string, status string, is_current boolean, text string" if extra else ""))


def clustered(rng, groups, each, size=8):
    centres = rng.normal(0, 1, (groups, size))
    return np.concatenate([c + rng.normal(0, 0.03, (each, size)) for c in centres])


def path():
    return tempfile.mkdtemp() + "/store"


def listed(df):
    return sorted((r["query_id"], r["rank"], r["item_id"], round(r["score"], 12)) for r in df.collect())


def test_pruned_equals_scan_with_ties_zero_and_repeated_vectors(spark):
    rng = np.random.default_rng(1)
    items = clustered(rng, 12, 60)
    items[100:160] = items[100]  # one vector sixty times
    items[200:210] *= 7.0  # directions count, lengths do not
    items[300:305] = 0.0
    catalog = frame(spark, items).repartition(4)
    queries = np.concatenate([items[[0, 100, 205, 300, 700]], rng.normal(0, 1, (6, 8))])
    asked = frame(spark, queries, "query_id")
    store = vector_index.build(catalog, path(), size=8, block_rows=40)
    for k in (1, 5, 61):
        found, _ = vector_index.search(store, asked, k)
        assert listed(found) == listed(vectors.top_k(asked, catalog, k, size=8))
    limited, _ = vector_index.search(store, asked, 5, threshold=0.9)
    assert listed(limited) == listed(vectors.top_k(asked, catalog, 5, size=8, threshold=0.9))


def test_far_clusters_are_not_read(spark):
    rng = np.random.default_rng(2)
    items = clustered(rng, 30, 40)
    catalog, asked = frame(spark, items), frame(spark, items[[5, 45]], "query_id")
    store = vector_index.build(catalog, path(), size=8, block_rows=40)
    found, report = vector_index.search(store, asked, 5)
    assert listed(found) == listed(vectors.top_k(asked, catalog, 5, size=8))
    assert report.clusters >= 20 and 0 < report.share < 0.5
    every, whole = vector_index.search(store, asked, len(items))
    assert every.count() == 2 * len(items) and whole.share == 1.0


def test_radii_bound_their_members(spark):
    items = clustered(np.random.default_rng(3), 6, 50)
    store = vector_index.build(frame(spark, items), path(), size=8, block_rows=30)
    centres, radii = store.centres(), {r["block"]: (r["radius"], r["rows"]) for r in store.clusters().collect()}
    seen = {}
    for r in store.rows().collect():
        unit = np.array(r["vector"], dtype="float64")
        unit /= np.linalg.norm(unit)
        distance = np.linalg.norm(centres - unit, axis=1)
        assert abs(distance[r["block"]] - distance.min()) < 1e-6 and distance[r["block"]] <= radii[r["block"]][0] + 1e-9
        seen[r["block"]] = seen.get(r["block"], 0) + 1
    assert seen == {b: n for b, (_, n) in radii.items()}


def test_empty_and_refused(spark):
    nothing = frame(spark, np.ones((1, 3))).limit(0)
    asked = frame(spark, np.ones((2, 3)), "query_id")
    empty = vector_index.build(nothing, path(), size=3)
    assert vector_index.search(empty, asked, 3)[0].collect() == []
    store = vector_index.build(frame(spark, np.ones((4, 3))), path(), size=3)
    assert vector_index.search(store, asked.limit(0), 3)[0].collect() == []
    assert listed(vector_index.search(store, asked, 3)[0])[0][2] == 0
    with pytest.raises(ValueError):
        vector_index.search(store, asked, 3, max_bytes=8)
    with pytest.raises(Exception, match="vector must have length"):
        vector_index.build(frame(spark, np.ones((4, 2))), path(), size=3)


def test_scoped_search_filters_before_ranking(spark):
    rng = np.random.default_rng(4)
    items = clustered(rng, 6, 40)
    texts = ["alpha beta", "Beta\tgamma", "", "ALPHA gamma delta"]
    extra = lambda i: (f"s{i % 3}", "active" if i % 5 else "withdrawn", i % 7 != 0, texts[i % 4])
    chunks = frame(spark, items, extra=extra)
    store = documents.store_chunks(chunks, path(), size=8, block_rows=20)
    asked = frame(spark, items[[3, 90]], "query_id").withColumn("words", F.array(F.lit("alpha"), F.lit("gamma")))
    found = documents.scoped_search(store, asked, ["s0", "s2"], 4, candidates=12)
    seen = {i for i in range(len(items)) if i % 3 != 1 and i % 5 and i % 7}

    def rule(q):
        v = items[q].astype("float32").astype("float64")
        scores = []
        for i in sorted(seen):
            w = items[i].astype("float32").astype("float64")
            scores.append((-(v @ w) / np.linalg.norm(v) / np.linalg.norm(w), i))
        near = [(-s, i) for s, i in sorted(scores)[:12]]
        again = [(0.7 * s + 0.3 * len({"alpha", "gamma"} & set(texts[i % 4].lower().split())) / 2, i) for s, i in near]
        return [i for _, i in sorted(again, key=lambda x: (-x[0], x[1]))[:4]]

    for number, q in enumerate((3, 90)):
        assert [r["item_id"] for r in found.where(f"query_id = {number}").orderBy("rank").collect()] == rule(q)
    assert documents.scoped_search(store, asked, [], 4).collect() == []
    assert documents.scoped_search(store, asked, ["other"], 4).collect() == []


def test_scopes_are_pruned_as_folders(spark):
    items = clustered(np.random.default_rng(5), 2, 30)
    store = documents.store_chunks(frame(spark, items, extra=lambda i: (f"s{i % 3}", "active", True, "x")), path(), size=8, block_rows=20)
    plan = store.rows().where(documents.visible(["s1"]))._jdf.queryExecution().executedPlan().toString()
    filters = plan[plan.index("PartitionFilters"):plan.index("PushedFilters")]
    assert all(c in filters for c in documents.SCOPE_FOLDERS)
