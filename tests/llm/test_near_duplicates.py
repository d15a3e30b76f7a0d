"""The LSH forest against brute force, and its defined edge cases."""

import random
import re

from docketloom.llm import near_duplicates


def similarity(a, b):
    s = [set(zip(w, w[1:], w[2:], strict=False)) for w in (re.findall("[a-z0-9]+", t.lower()) for t in (a, b))]
    return len(s[0] & s[1]) / max(1, len(s[0] | s[1]))


def run(spark, rows):
    df = spark.createDataFrame([(i, t, 1, 2) for i, t in rows], "id long, judgment_text string, u int, klass int")
    links, classes = near_duplicates.near_duplicates(spark, df)
    pairs = {tuple(r) for r in near_duplicates.all_pairs(links, classes).collect()}
    return pairs, {r["id"]: r for r in near_duplicates.groups(spark, links, classes).collect()}


def test_equals_brute_force(spark):
    rng = random.Random(4)
    words = [f"w{i}" for i in range(300)]
    texts = []
    for _ in range(25):
        base = [rng.choice(words) for _ in range(rng.randint(60, 300))]
        texts.append(base)
        for share in (0.02, 0.05, 0.1, 0.2):
            texts.append([rng.choice(words) if rng.random() < share else w for w in base])
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)]
    true = {(i, j) for i, a in rows for j, b in rows if i < j and similarity(a, b) >= 0.5}
    got, _ = run(spark, rows)
    assert got <= true and len(got & true) >= 0.98 * len(true)


def test_families_larger_than_the_reach(spark):
    rng = random.Random(8)
    base = [f"w{rng.randint(0, 999)}" for _ in range(120)]
    rows = [(i, " ".join([*base[:60], f"own{i}", *base[60:], f"end{i % 7}"])) for i in range(140)]
    got, groups = run(spark, rows)
    assert len(got) == 140 * 139 // 2 and groups[0]["links"] == 139


def test_edges(spark):
    long = " ".join(f"t{i % 9973} x{i % 31}" for i in range(60_000))
    rows = [(1, "one two three four five six"), (2, "One, two; THREE four five six!"), (3, "one two three four five seven"), (4, None), (5, ""), (6, "ab"), (7, "AB"), (8, "!!"), (9, "!!"), (10, "??"), (11, long), (12, long + " end of it"), (1, "one two three four five six"), (13, "other words entirely in here now")]
    got, groups = run(spark, rows)
    assert got == {(1, 2), (1, 3), (2, 3), (6, 7), (8, 9), (11, 12)}
    assert groups[3]["group_id"] == groups[1]["group_id"] == 1 and groups[2]["class_id"] == 1 and groups[1]["links"] == 1
    assert 4 not in groups and 5 not in groups and groups[13]["links"] == 0
    assert run(spark, []) == (set(), {})


def test_small_partitions_are_stitched(spark, monkeypatch):
    """As many partitions as rows almost: neighbours lie several partitions apart."""
    monkeypatch.setattr(near_duplicates, "spread", lambda spark: 40)
    words = [f"w{i}" for i in range(400)]
    texts = [(i, " ".join(words[:300] + words[300 + i : 330 + i])) for i in range(12)]
    df = spark.createDataFrame(texts, "id long, judgment_text string")
    links, classes = near_duplicates.near_duplicates(spark, df)
    assert near_duplicates.all_pairs(links, classes).count() == 66
