"""Traces of print and page, and repaired texts."""

import random

import numpy as np

from docketloom.llm import page_noise

CLEAN = "the tenant claimed the refund of the matter before the court and the statement was common to all parties of the appeal"
SCAN = "COURT OF A\nX\n   vs.\nY\n\nThe tcnant claimed the rnatter be-\nfore the court.\n- 3 -\nA  The staternent was c0mmon to all par­\nties of the co-\noperative appeal\nand the appeal."


def rows(spark):
    many = [(i, (CLEAN + " co-operative appeal before matter tenant\n") * 40) for i in range(1, 4)]
    return spark.createDataFrame([*[(i, t, "x", 1) for i, t in many], (9, SCAN, "x", 1), (10, None, "x", 1), (11, "", "x", 1), (9, SCAN, "x", 1)], "id long, judgment_text string, word string, n int")


def test_cases(spark):
    got = {tuple(r) for r in page_noise.traces(spark, rows(spark)).where("id = 9").collect()}
    assert got == {
        (9, 8, "running_line", ""), (9, 9, "margin_mark", ""), (9, 6, "split_word", "before"), (9, 9, "split_word", "parties"), (9, 10, "split_word", "co-operative"),
        (9, 6, "misread", "tenant"), (9, 6, "misread", "matter"), (9, 9, "misread", "statement"), (9, 9, "misread", "common"),
    }
    assert page_noise.traces(spark, rows(spark)).where("id < 9").count() == 0


def test_repaired_text(spark):
    text = {r["id"]: r["repaired_text"] for r in page_noise.repair_texts(spark, rows(spark)).collect()}
    assert text[9].split("\n")[-1] == "The tenant claimed the matter before the court. The statement was common to all parties of the co-operative appeal and the appeal."
    assert text[10] is None and text[11] == ""


def test_empty_and_long(spark):
    none = spark.createDataFrame([], "id long, judgment_text string")
    assert page_noise.traces(spark, none).count() == 0 and page_noise.repair_texts(spark, none).count() == 0
    long = spark.createDataFrame([(1, "word " * 200_000)], "id long, judgment_text string")
    assert page_noise.traces(spark, long).count() == 0


def test_paragraph_breaks():
    lines = ["The first line of a paragraph goes on here", "and it ends.", "Another one begins with a capital and goes", "on to its end."]
    assert page_noise.paragraph_breaks(lines, [False, False, True, False], [0] * 4) == [True, False, True, False]
    assert page_noise.paragraph_breaks([], [], []) == []


def test_long_paragraphs_stay_whole():
    lines = ["words of a sentence that goes on and on over the lines"] * 400
    assert page_noise.paragraph_breaks(lines, [False] * 400, [0] * 400) == [True] + [False] * 399
    rng = random.Random(4)
    some = [rng.choice(["The end of it.", "goes on here and there", "Another line that is longer than the others are"]) for _ in range(130)]
    assert page_noise.paragraph_breaks(some, [rng.random() < 0.1 for _ in some], [0] * 130) == brute_breaks(some, 4)


def brute_breaks(lines, seed):
    """The same search over all starts."""
    rng = random.Random(seed)
    [rng.choice(["The end of it.", "goes on here and there", "Another line that is longer than the others are"]) for _ in range(130)]
    gaps, n = [rng.random() < 0.1 for _ in lines], len(lines)
    width = int(np.percentile([len(x) for x in lines], 90))
    cost = [0.0] * n
    for i in range(1, n):
        before, now = lines[i - 1], lines[i]
        ended, begins, short = before.endswith("."), now[0].isupper(), len(before) < 48
        room = len(before) + 1 + len(now.split()[0]) <= width - 2
        cost[i] = 1.7 - (2.0 * gaps[i] + 1.5 * (room and ended) + 2.0 * (short and not ended and before[0].isupper() and begins and room)) + 3.0 * (not begins) + 1.5 * (not ended and not short)
    best, back = [0.0] * (n + 1), [0] * (n + 1)
    for i in range(1, n + 1):
        options = [(best[j] + cost[j] + 0.4 * (i - j == 1) + 0.02 * max(0, i - j - 40), -j) for j in range(i)]
        best[i], back[i] = min(options)[0], -min(options)[1]
    out, i = [False] * n, n
    while i:
        out[back[i]], i = True, back[i]
    return out


def test_split_merge_and_control_characters(spark):
    noisy = CLEAN + "\nthe refund ofthe tenant be fore the court and the state\nment was com mon\nab\x01cd\x01ef to all par-\n\x01ties of it"
    many = [(i, (CLEAN + " " + ("of the " * 60) + " refund before\n") * 40) for i in range(1, 4)]
    df = spark.createDataFrame([*many, (9, noisy)], "id long, judgment_text string")
    text = {r["id"]: r["repaired_text"] for r in page_noise.repair_texts(spark, df).collect()}[9]
    assert "refund of the tenant" in text and "the statement was common" in text, text
    got = {tuple(r) for r in page_noise.traces(spark, df).where("id = 9").collect()}
    assert (9, 2, "split_word", "statement") in got


def test_words_beyond_the_lexicon(spark, monkeypatch):
    monkeypatch.setattr(page_noise, "LEXICON", 12)
    got = {tuple(r) for r in page_noise.traces(spark, rows(spark)).where("id = 9").collect()}
    assert {(9, 6, "split_word", "before"), (9, 6, "misread", "tenant"), (9, 6, "misread", "matter"), (9, 9, "misread", "statement"), (9, 9, "misread", "common"), (9, 10, "split_word", "co-operative")} <= got
    assert page_noise.traces(spark, rows(spark)).where("id < 9").count() == 0


def test_long_tokens(spark):
    word = "l" * 60 + "ong" + "m" * 300
    df = spark.createDataFrame([(1, (word + " and ") * 50 + "\n" + word[:-1] + "rn and")], "id long, judgment_text string")
    assert [tuple(r) for r in page_noise.traces(spark, df).collect()] == [(1, 2, "misread", word)]


def test_lexicon_is_whole(spark, monkeypatch, tmp_path):
    noisy = SCAN + "\nthe tcnarnt of thestaternent be fore the court and the state\nment was com mon, the rnattcr of the tcnant\nand the tenantof the staternemt."
    many = [(i, ("of the appeal before " * 1300 if i == 1 else "") + (CLEAN + " co-operative appeal before matter tenant\n") * 500) for i in range(1, 4)]
    df = spark.createDataFrame([*many, (9, noisy)], "id long, judgment_text string")
    found = []
    for words in (200_000, 4, 1):
        monkeypatch.setattr(page_noise, "LEXICON", words)
        found.append(({tuple(r) for r in page_noise.traces(spark, df).collect()}, {tuple(r) for r in page_noise.repair_texts(spark, df).collect()}))
    assert found[0][0] and found[1] == found[0] and found[2] == found[0]

    words = sorted(((w, n) for n, w in enumerate({"aé", "b", "zz", "", "é", *(f"w{i}" for i in range(500))}, 3)), key=lambda x: x[0].encode())
    page_noise.WordFile.write(str(tmp_path / "words"), iter(words), len(words))
    file = page_noise.WordFile(str(tmp_path / "words"))
    assert all(file.get(w) == n for w, n in words) and not any(file.get(w) for w in ("a", "w500", "zzz", "ée"))
