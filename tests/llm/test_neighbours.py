"""NN-descent against brute force, and its defined edge cases."""

import numpy as np
import pytest


from docketloom.llm import neighbours, search

SCHEMA = "id long, embedding array<float>, created_at timestamp, cos double, u string"


def frame(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [float(x) for x in v], None, 1.0, "x") for i, v in rows], SCHEMA)


def brute(rows, k):
    ids = np.array([i for i, _ in rows])
    x = np.array([v for _, v in rows], np.float64)
    x /= np.linalg.norm(x, axis=1)[:, None]
    cos = np.round(x @ x.T, 9)
    out = {}
    for n, i in enumerate(ids):
        order = sorted((j for j in range(len(ids)) if j != n), key=lambda j: (-cos[n, j], ids[j]))[:k]
        out[int(i)] = [int(ids[j]) for j in order]
    return out


def lists(df):
    out = {}
    for r in df.orderBy("id", "rank").collect():
        out.setdefault(r["id"], []).append(r["neighbour"])
    return out


def test_equals_brute_force_on_many_cells(spark):
    rng = np.random.default_rng(0)
    centres = rng.normal(size=(12, 24))
    rows = [(i, np.round(centres[i % 12] + rng.normal(size=24) * 0.6, 3)) for i in range(900)]
    rows += [(2000 + i, rows[i][1]) for i in range(40)]  # equal vectors
    got, true = lists(neighbours.most_similar(spark, frame(spark, rows), "id", k=10, leaf=60)), brute([(i, np.float32(v)) for i, v in rows], 10)
    recall = np.mean([len(set(got[i]) & set(true[i])) / 10 for i in true])
    assert recall >= 0.98


def test_cells_beyond_the_cap_are_compared_whole(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "CELL_CAP", 40)
    rng = np.random.default_rng(3)
    rows = [(i, np.round(rng.normal(size=16), 3)) for i in range(300)]
    rows += [(1000 + i, rows[0][1]) for i in range(150)]  # one vector held by a third of the rows
    got, true = lists(neighbours.most_similar(spark, frame(spark, rows), "id", k=10)), brute([(i, np.float32(v)) for i, v in rows], 10)
    assert got == true


def test_edge_cases(spark):
    rows = [(1, [1, 0]), (2, [2, 0]), (3, [0, 1]), (4, [1, 1]), (5, None), (6, []), (7, [0, 0]), (8, [1, 2, 3]), (9, [float("nan"), 1]), (4, [1, 1])]
    got = lists(neighbours.most_similar(spark, frame(spark, rows), "id", k=2))
    assert got == {1: [2, 4], 2: [1, 4], 3: [4, 1], 4: [1, 2]}


def test_more_copies_than_neighbours(spark):
    got = lists(neighbours.most_similar(spark, frame(spark, [(i, [1, 0]) for i in range(1, 8)]), "id", k=3))
    assert got[7] == [1, 2, 3] and got[1] == [2, 3, 4]


def test_latest_delivery_counts(spark):
    df = spark.sql("select 1L id, array(1f, 0f) embedding, timestamp'2024-01-01' created_at union all select 1L, array(0f, 1f), timestamp'2024-01-02' union all select 2L, array(1f, 0f), timestamp'2024-01-01' union all select 3L, array(0f, 1f), timestamp'2024-01-01'")
    assert lists(neighbours.most_similar(spark, df, "id", order_col="created_at", k=1))[1] == [3]


def test_empty_and_single(spark):
    assert neighbours.most_similar(spark, frame(spark, []), "id").count() == 0
    assert neighbours.most_similar(spark, frame(spark, [(1, [1, 2])]), "id").count() == 0
    pairs = neighbours.similar_pairs(neighbours.most_similar(spark, frame(spark, [(1, [1, 2]), (2, [2, 1])]), "id"))
    assert [tuple(r) for r in pairs.collect()] == [(1, 2)]


@pytest.mark.parametrize("vector", [np.float32([1.5, -2.25, 0]), np.float32([0.1, 1e-8, 3e5])])
def test_packing_loses_nothing(vector):
    assert (neighbours.unpack([neighbours.pack(vector)])[0] == vector).all()


def test_greedy_search_recall(spark):
    rng = np.random.default_rng(1)
    rows = [(i, np.round(rng.normal(size=12), 3)) for i in range(400)]
    asked = [(1000 + i, np.round(rng.normal(size=12), 3)) for i in range(12)]
    got = search.greedy_search(spark, frame(spark, asked), frame(spark, rows), "id", k=5, beam=24)
    found = {}
    for r in got.collect():
        found.setdefault(r["query_id"], set()).add(r["id"])
    x = np.array([v for _, v in rows])
    x /= np.linalg.norm(x, axis=1)[:, None]
    hits = [len(found[i] & set(np.argsort(-(x @ v))[:5].tolist())) / 5 for i, v in asked]
    assert np.mean(hits) >= 0.9
    assert search.greedy_search(spark, frame(spark, []), frame(spark, rows), "id").count() == 0



def test_search_over_all_chunks(spark, data):
    from docketloom.llm.queries import queries

    rows = spark.read.parquet(f"{data}/judgment_embeddings.parquet").where("embedding is not null")
    last = {}
    for r in rows.select("chunk_id", "created_at", "embedding").collect():
        if r[0] not in last or r[1] > last[r[0]][0]:
            last[r[0]] = (r[1], np.float32(r[2]))
    found = {}
    for r in queries()["p1_search_chunks"](spark, data).collect():
        found.setdefault(r["query_id"], []).append(r["cosine"])
    ids = sorted(last)
    x = np.array([last[i][1] for i in ids], np.float64)
    x /= np.linalg.norm(x, axis=1)[:, None]
    first = {}
    for i, v in zip(ids, x, strict=True):
        first.setdefault(v.tobytes(), i)  # copies are found as their smallest id
    x = x[[n for n, i in enumerate(ids) if first[x[n].tobytes()] == i]]
    asked = [i for i in ids if i % 50 == 0]
    assert asked and set(found) == set(asked)
    hits = [np.mean(np.array(found[i]) >= np.sort(x @ (v := last[i][1].astype(np.float64)) / np.linalg.norm(v))[-10] - 1e-6) for i in asked]
    assert np.mean(hits) >= 0.9


def test_search_in_blocks(spark, monkeypatch):
    rng = np.random.default_rng(2)
    rows = [(i, np.round(rng.normal(size=8), 3)) for i in range(150)]
    asked = rows[::10]
    whole = search.greedy_search(spark, frame(spark, asked), frame(spark, rows), "id", k=4, beam=16)
    monkeypatch.setattr(search, "BLOCK", 4)
    parts = search.greedy_search(spark, frame(spark, asked), frame(spark, rows), "id", k=4, beam=16)
    assert sorted(map(tuple, whole.collect())) == sorted(map(tuple, parts.collect()))
