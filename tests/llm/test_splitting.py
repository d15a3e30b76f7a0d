"""Boundaries and pieces by ranges: independent of the range size, exact round trip."""

import random

import pytest

from docketloom.llm import splitting

PARA = ["The first paragraph runs over lines that are\nlong enough to be wrapped, and ends\nhere.", "A second one follows it and is also wrapped\nat about the same width. It has two sentences\nin it."]


def texts():
    body = (PARA[0] + "\n\n" + PARA[1] + "\n\n") * 60
    return {"blank": body, "indent": ("    " + PARA[0] + "\n    " + PARA[1] + "\n") * 60, "long": (PARA[0].replace("\n", " ") * 3 + "\n" + PARA[1].replace("\n", " ") * 3 + "\n") * 20}


@pytest.mark.parametrize("layout", ["blank", "indent", "long"])
def test_every_paragraph_is_found(spark, layout):
    text = texts()[layout].rstrip()
    df = spark.createDataFrame([(1, text, "x", 5)], "id long, judgment_text string, item string, start_char int")
    got = {r["start_char"] for r in splitting.paragraph_starts(spark, [(df, "judgment", "id", "judgment_text", None)]).collect()}
    cut = "\n\n" if layout == "blank" else "\n"
    true, at = set(), 0
    for part in text.split(cut) if layout != "indent" else [p if i == 0 else "    " + p for i, p in enumerate(text.split("\n    "))]:
        true.add(at)
        at += len(part) + len(cut) if layout != "indent" else len(part) + 1
    assert got == true - {0}


def test_ranges_do_not_matter(spark):
    text = texts()["blank"]
    df = spark.createDataFrame([("judgment:1", text)], "item string, text string")
    one = {r["start_char"] for r in splitting.decide(splitting.scan_items(df, "text", 100_000)).collect()}
    many = {r["start_char"] for r in splitting.decide(splitting.scan_items(df, "text", 1_000, 400)).collect()}
    assert one == many and len(one) > 100


@pytest.mark.parametrize("limit", [400, 1_000])
def test_blocks_do_not_matter(spark, limit):
    rng = random.Random(6)
    words = " ".join(rng.choice(["alpha.", "Beta", "gamma", "x" * rng.randint(1, 900)]) for _ in range(600))
    df = spark.createDataFrame([(1, words, "facts"), (2, texts()["blank"], "facts"), (3, "y" * 7_001, None)], "id long, content string, section string")
    sources = [(df, "chunk", "id", "content", "section")]
    one = sorted(tuple(r) for r in splitting.pieces(spark, sources, limit, 50).collect())
    many = sorted(tuple(r) for r in splitting.pieces(spark, sources, limit, 50, block=1_000).collect())
    assert one == many and len(one) > 50


def test_ids_delivered_with_different_texts(spark):
    df = spark.createDataFrame([(1, "a" * 3_500, None), (1, "b" * 3_100, "facts"), (2, "c" * 3_500, None), (2, "c" * 3_500, None)], "id long, content string, section string")
    got = splitting.pieces(spark, [(df, "chunk", "id", "content", "section")]).collect()
    assert sorted((r["item_id"], r["piece"], r["content"][0]) for r in got) == [(1, 0, "b"), (1, 1, "b"), (2, 0, "c"), (2, 1, "c")]


def test_pieces_round_trip(spark):
    rng = random.Random(5)
    rows = [(1, texts()["blank"], "facts"), (2, "short", None), (3, None, "facts"), (4, "", "facts"), (5, "x" * 20_000, "ratio"), (6, " ".join(rng.choice(["alpha.", "Beta", "gamma"]) for _ in range(4_000)), "issues"), (2, "short", None), (7, "a. B", "facts")]
    df = spark.createDataFrame(rows, "id long, content string, section string")
    got = splitting.pieces(spark, [(df, "chunk", "id", "content", "section")]).orderBy("item_id", "piece").collect()
    source = {i: t for i, t, _ in rows}
    seen = {}
    for r in got:
        assert len(r["content"]) <= 3_000 and r["content"] == source[r["item_id"]][r["start_char"] : r["end_char"]]
        if r["piece"]:
            assert seen[r["item_id"]] - r["start_char"] == splitting.OVERLAP
        seen[r["item_id"]] = r["end_char"]
    assert seen == {i: len(t) for i, t in source.items() if t}
    assert {r["section"] for r in got if r["item_id"] == 1} == {"facts"} and {r["cut"] for r in got if r["item_id"] == 1} == {"paragraph", "end"}


def test_furniture_is_no_paragraph(spark):
    page = "A paragraph that goes on over the page and is\nwrapped as the others are until it\n- 12 -\n\nends here.\n\n"
    text = page * 40
    df = spark.createDataFrame([(1, text)], "id long, judgment_text string")
    got = {r["start_char"] for r in splitting.paragraph_starts(spark, [(df, "judgment", "id", "judgment_text", None)]).collect()}
    assert got == {i * len(page) for i in range(1, 40)}


def test_empty(spark):
    df = spark.createDataFrame([], "id long, judgment_text string")
    assert splitting.paragraph_starts(spark, [(df, "judgment", "id", "judgment_text", None)]).count() == 0
    assert splitting.pieces(spark, [(df, "judgment", "id", "judgment_text", None)]).count() == 0


def test_file_ranges(spark, tmp_path):
    text = ("Zeile mit Ümlauten – und हिन्दी.\n\n" * 3_000)[:-2]
    (tmp_path / "big.txt").write_text(text, encoding="utf-8")
    rows = splitting.file_ranges(spark, f"file://{tmp_path}/big.txt", 10_000, 400).orderBy("range").collect()
    assert "".join(r["part"][r["lo"] - r["start"] : r["hi"] - r["start"]] for r in rows) == text and len(rows) > 5


def test_file_pieces_equal_those_of_the_text(spark, tmp_path):
    files = {"a.txt": texts()["blank"] * 3, "b.txt": ("Ümlaut über Satz. Noch einer – हिन्दी में।  " * 900), "c.txt": "short", "d.txt": ""}
    for name, text in files.items():
        (tmp_path / name).write_text(text, encoding="utf-8")
    got = {}
    for r in splitting.file_pieces(spark, f"file://{tmp_path}", size=7_001, halo=4_000, block=5_000).collect():
        got.setdefault(r["item"].rsplit("/", 1)[1], []).append((r["piece"], r["start_char"], r["end_char"], r["cut"], r["content"]))
    df = spark.createDataFrame([(i, t) for i, t in enumerate(files.values())], "id long, text string")
    want = {}
    for r in splitting.pieces(spark, [(df, "file", "id", "text", None)]).collect():
        want.setdefault(list(files)[r["item_id"]], []).append((r["piece"], r["start_char"], r["end_char"], r["cut"], r["content"]))
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in want.items()}
