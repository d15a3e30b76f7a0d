"""Packing, mixing and quality on small corpora."""

import math
import random

import numpy as np
from pyspark.sql import functions as F

from docketloom.llm import mixing, packing, quality
from docketloom.llm.tokens import encode, with_token_count

WORDS = "court order appeal tenant refund market notice value prison letter harbour silver garden engine window bridge".split()


def corpus(spark, n=300, seed=6):
    rng = random.Random(seed)
    rows = [(i, " ".join(rng.choice(WORDS) for _ in range(rng.randint(3, 900))), rng.choice("aab"), "x") for i in range(n)]
    rows += [(1000, None, "a", "x"), (1001, "", "a", "x"), (1002, "word " * 30_000, "b", "x"), (0, rows[0][1], "a", "x"), (1003, "odd", None, "x"), (1004, "<|endoftext|>", "c", "x")]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, terms string"), rows


def test_packing(spark):
    df, rows = corpus(spark)
    got = packing.pack_texts(spark, df, shard_items=100).collect()
    whole = sum(len(encode(t)) for _, t, _, _ in rows if t)
    assert sum(r["n_tokens"] for r in got) == whole
    boxes = {}
    for r in got:
        boxes[r["container"]] = boxes.get(r["container"], 0) + r["n_tokens"]
    assert max(boxes.values()) <= 2048 and whole / (len(boxes) * 2048) > 0.97
    assert all(boxes[r["container"]] == r["fill"] for r in got)
    split = {r["doc_id"] for r in got if r["start_token"]}
    assert split == {1002}
    assert sorted(r["copy"] for r in got if r["doc_id"] == 0 and r["start_token"] == 0) == [1, 2]
    assert packing.pack_texts(spark, df.where("false")).count() == 0


def test_neighbours_share_a_container(spark):
    a, b = " ".join(f"ship{i} anchor" for i in range(150)), " ".join(f"wheat{i} field" for i in range(150))
    df = spark.createDataFrame([(i, a if i % 2 else b) for i in range(8)], "doc_id long, text string")
    boxes = {}
    for r in packing.pack_texts(spark, df).collect():
        boxes.setdefault(r["container"], set()).add(r["doc_id"] % 2)
    assert sum(len(v) == 1 for v in boxes.values()) >= len(boxes) - 1


def test_neighbours_are_sought_in_all_shards(spark):
    rng = random.Random(9)
    rows = []
    for topic in range(20):
        words = ["".join(rng.choice("bcdfghklm") + rng.choice("aeiou") for _ in range(3)) for _ in range(80)]
        for copy in range(2):
            text = " ".join(rng.sample(words, 80) * 9)
            rows.append((topic * 100 + copy, " ".join(text.split()[: 900 * 720 // len(encode(text))])))
    boxes = {}
    for r in packing.pack_texts(spark, spark.createDataFrame(rows, "doc_id long, text string"), shard_items=4).collect():
        boxes.setdefault(r["container"], set()).add(r["doc_id"])
    assert len(boxes) == 20 and all(len({i // 100 for i in x}) == 1 for x in boxes.values())


def test_cut_poisson():
    for cap in (1, 2, 4):
        for mean in (0.1, 0.7, cap * 0.9):
            rate = mixing.rate_for(mean, cap)
            assert abs(sum(1 - p for p in mixing.cut_poisson(rate, cap)) - mean) < 1e-6
    assert mixing.rate_for(2, 2) == math.inf and mixing.cut_poisson(math.inf, 2) == [0.0, 0.0] and mixing.rate_for(0, 3) == 0


def test_mixing(spark):
    df, _ = corpus(spark, 800)
    goal = spark.createDataFrame([("a", 0.4, 1), ("b", 0.6, 3), ("gone", 0.2, 1), (None, 0.1, 1), ("a", 0.4, 1)], "source string, target_share double, max_repeats int")
    mixed = mixing.mix(spark, df, goal)
    rows = mixed.collect()
    tokens = {s: sum(r["n_tokens"] for r in rows if r["source"] == s) for s in "ab"}
    assert abs(tokens["a"] / sum(tokens.values()) - 0.4) < 0.06 and {r["source"] for r in rows} == {"a", "b"}
    assert max(r["copy"] for r in rows if r["source"] == "a") == 1 and max(r["copy"] for r in rows) <= 3
    assert [r["mix_key"] for r in rows] == sorted(r["mix_key"] for r in rows)
    counted = with_token_count(df, "text").select("source", "n_tokens")
    told = {r["source"]: r for r in mixing.shares(mixed, counted, goal).collect()}
    assert told["gone"]["reached_share"] == 0 and told["b"]["repeats"] <= 3
    again = mixing.mix(spark, df.repartition(7), goal)
    assert [tuple(r) for r in again.select("doc_id", "copy").orderBy("mix_key", "doc_id", "copy").collect()] == [(r["doc_id"], r["copy"]) for r in sorted(rows, key=lambda r: (r["mix_key"], r["doc_id"], r["copy"]))]
    assert mixing.mix(spark, df.where("false"), goal).count() == 0 and mixing.mix(spark, df, goal.where("false")).count() == 0


COMMON = [(w, "en") for w in "the of and to in that a is was for it be as on by with".split()] + [("के", "hi"), ("का", "hi"), ("है", "hi")]
PROSE = "The tenant of the market was to pay for the use of it in a year. It is said that the notice was sent by post to the office of the court, and that it was on time. "
KINDS = {"list": "1. apples\n2. pears\n3. plums\n4. figs\n5. dates\n", "table": "12,5.1,77%\n13,6.2,45%\n14,7.3,12%\n", "junk": "<td>px;</td>var x1};{margin:0}&nbsp;"}


def test_distinct_words_of_the_whole_text():
    position = quality.STATISTICS.index("distinct_word_share")
    share = lambda words: quality.statistics(" ".join(words), ["en"], quality._Tokens({"en": frozenset(["the", "of"])}))[1][position]
    rng = random.Random(8)
    fresh = ["".join(rng.choice("bcdfghklm") + rng.choice("aeiou") for _ in range(4)) for _ in range(100)]
    for words in (fresh, fresh[:7] * 3, fresh + ["again"] * 300, ["again"] * 300 + fresh, [rng.choice(fresh) for _ in range(257)]):
        spans = [words[i : i + 100] for i in range(max(1, len(words) - 99))]
        assert abs(share(words) - sum(len(set(x)) / len(x) for x in spans) / len(spans)) < 1e-12
    assert share(fresh + ["again"] * 300) < 0.3


def test_quality(spark):
    rng = random.Random(7)
    rows, labels = [], []
    for i in range(400):
        kind = "prose" if i % 4 else ["list", "table", "junk"][i // 4 % 3]
        rows.append((i, (PROSE * rng.randint(1, 6)) if kind == "prose" else KINDS[kind] * rng.randint(2, 9), 1.0))
        if i % 2 == 0 or kind != "prose":
            labels.append((i, "prose" if i % 40 == 4 else kind))  # some labels are wrong
    rows += [(1000, None, 1.0), (1001, " \n ", 1.0), (1002, PROSE * 3_000, 1.0), (1003, "है के का " * 20, 1.0), (3, rows[3][1], 1.0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, distance double")
    words = spark.createDataFrame(COMMON, "word string, lang string")
    got = quality.quality(spark, docs, words, spark.createDataFrame(labels, "doc_id long, label string"))
    out = {r["doc_id"]: r for r in got.collect()}
    wrong = [i for i in range(400) if (out[i]["verdict"] == "prose") != bool(i % 4)]
    assert len(wrong) <= 4 and got.count() == len(rows)
    assert out[1000]["verdict"] == out[1001]["verdict"] == "empty" and out[1000]["distance"] is None
    assert out[1002]["verdict"] == "prose" and out[1003]["language"] == "hi"
    assert abs(sum(out[0]["contribution"].values()) - 1) < 1e-6
    assert not {1000, 1001} & {r["doc_id"] for r in quality.not_prose(got).collect()}
    plain = quality.quality(spark, docs, words)
    assert plain.where(F.col("verdict") == "junk").count() > 50
    assert quality.quality(spark, docs.where("false"), words).count() == 0


def test_neighbour_recall(spark, data):
    """Lists of the cells asked against BM25 of every seed with every item, at least 0.9 of the ten best."""
    docs = spark.read.parquet(f"{data}/../sf0.01/documents.parquet").select("doc_id", F.lit(1).cast("long").alias("copy"), "text").where("text <> ''")
    items = packing.items_of(docs).where("n < 2048").withColumn("iid", F.col("doc_id") * 1_000_000 + F.col("start")).cache()
    stats = packing.Statistics(items)
    near = packing._placed(items, stats, 40).cache()
    seeds = packing._largest(near, 150).select("iid", "n", (F.lit(2048) - F.col("n")).alias("room"), "steps", "tf", "near")
    got = {r["seed"]: [e["iid"] for e in r["list"]][:10] for r in packing.neighbour_lists(spark, seeds, near, stats, 40).collect()}
    rows = near.toArrow()
    counts, terms, tf = packing._unpacked(rows)
    n, iid = rows.column("n").to_numpy(), rows.column("iid").to_numpy()
    shard = packing.Shard(counts, terms, stats.weights(terms, tf, np.repeat(n, counts)))
    found = total = 0
    asked = seeds.toArrow()
    lengths, terms, _ = packing._unpacked(asked)
    words = np.split(terms, np.cumsum(lengths)[:-1])
    for s, words in zip(asked.select(["iid", "n", "room"]).to_pylist(), words, strict=True):
        score = shard.scores(np.array([len(words)]), words)[0]
        score[(n > s["room"]) | (n > s["n"]) | (n == s["n"]) & (iid <= s["iid"])] = 0
        best = iid[np.lexsort((iid, -score))][:10]
        found += len(set(best.tolist()) & set(got.get(s["iid"], [])))
        total += 10
    assert near.select(F.get("near", F.lit(0))).distinct().count() > 20 and found / total >= 0.9, found / total


def test_plan_of_gaps():
    rng = random.Random(3)
    for new in (False, True):
        rooms = {rng.randint(1, 60): rng.randint(1, 30) for _ in range(12)}
        sizes = {rng.randint(1, 60): rng.randint(1, 30) for _ in range(14)}
        plan = packing.plan_gaps(rooms, sizes, 64, new)
        used, boxes = {}, {}
        for room, lo, hi, fills in plan:
            for i in range(lo, hi):
                assert (room, i) not in boxes
                boxes[room, i] = sum(size * each for size, _, each in fills)
                assert boxes[room, i] <= (room if room > 0 else 64) and (room < 0 or i < rooms[room])
                for size, first, each in fills:
                    for k in range(each):
                        item = (size, first + (i - lo) * each + k)
                        assert item not in used and item[1] < sizes[size]
                        used[item] = 1
        if new:
            assert len(used) == sum(sizes.values())


def test_regions_settle_alike(spark, monkeypatch):
    df, rows = corpus(spark, 200)
    monkeypatch.setattr(packing, "_settle", lambda *a: SETTLE(*a, region=9))
    got = packing.pack_texts(spark, df, shard_items=30).collect()
    assert sum(r["n_tokens"] for r in got) == sum(len(encode(t)) for _, t, _, _ in rows if t)
    boxes = {}
    for r in got:
        boxes[r["container"]] = boxes.get(r["container"], 0) + r["n_tokens"]
    assert max(boxes.values()) <= 2048 and len({(r["doc_id"], r["copy"], r["start_token"]) for r in got}) == len(got)


SETTLE = packing._settle


def test_more_than_eight_languages():
    common = {f"l{k:02}": frozenset({f"word{chr(97 + k)}x", f"other{chr(97 + k)}y"}) for k in range(19)}
    tokens = quality._Tokens(common)
    for k, c in ((k, chr(97 + k)) for k in (0, 7, 8, 16, 18)):
        language, row = quality.statistics(f"Some word{c}x and other{c}y of it, word{c}x again.", list(common), tokens)
        assert language == f"l{k:02}" and row[quality.STATISTICS.index("common_share")] > 0.3


def test_items_of_a_batch_are_those_of_single_texts(spark, monkeypatch):
    monkeypatch.setattr(packing, "TEXTS_AT_ONCE", 7)
    df, _ = corpus(spark, 40)
    base = df.where("text is not null").withColumn("copy", F.lit(1).cast("long"))
    for row in packing.items_of(base, 64).join(base.select("doc_id", F.col("text")), "doc_id").where("doc_id > 0").collect():
        part = encode(row["text"])[row["start"] : row["start"] + 64]
        terms, tf = np.unique(part, return_counts=True) if len(part) < 64 else ([], [])
        assert row["n"] == len(part)
        assert np.cumsum(np.frombuffer(row["steps"], packing.STEP), dtype=np.int64).tolist() == list(terms) and np.frombuffer(row["tf"], np.uint16).tolist() == list(tf)
