"""Spellings of party names: the metric join against brute force, parsing, linking, edge cases."""

import random

import pytest

from docketloom.llm import metric_join, party_names

NICK = [("Beloo", "Beleshwin"), ("Beloo", "Belavath"), ("Jagu", "Jagundari"), ("Ushoo", "Ushinath")]


def test_distance():
    d = metric_join.distance
    assert [d("abc", "abc"), d("abc", "acb"), d("abc", "ab"), d("", "abc"), d("ca", "abc")] == [0, 1, 1, 3, 2]
    rng = random.Random(2)
    words = ["".join(rng.choice("abcd") for _ in range(rng.randint(1, 9))) for _ in range(300)]
    alphabet = metric_join.Alphabet()
    a, la = metric_join.codes(words, alphabet)
    b, lb = metric_join.codes(words[::-1], alphabet)
    assert metric_join.distances(a, la, b, lb).tolist() == [d(x, y) for x, y in zip(words, words[::-1], strict=True)]


def test_radius_join_is_complete(spark):
    rng = random.Random(3)
    words = sorted({"".join(rng.choice("abcde") for _ in range(rng.randint(4, 9))) for _ in range(400)})
    df = spark.createDataFrame([("k", w) for w in words], "kind string, head string")
    got = {(r["a"], r["b"], r["distance"]) for r in metric_join.radius_join(spark, df, 2).collect()}
    true = {(x, y, metric_join.distance(x, y)) for i, x in enumerate(words) for y in words[i + 1 :] if metric_join.distance(x, y) <= 2}
    assert got == true
    assert metric_join.radius_join(spark, df.where("false"), 2).count() == 0


def groups(spark, names, nick=NICK):
    df = spark.createDataFrame([(n, None, "x") for n in names], "petitioner string, respondent string, name string")
    table = spark.createDataFrame(nick, "nick string, given_name string") if nick else None
    named = {r["name"]: r["party"] for r in party_names.parties(spark, df, nicknames=table).collect()}
    return named


ONE = ["Ushinath S. Norelondat", "USHINATH S. NORELONDAT AND ANOTHER", "Norelondat, Ushinath S.", "U. S. Norelondat & Ors.", "Ushoo S. Norelondat.", "Mr. Uhshinath S. Norelondat (Dead) by LRs.", "Norelondat US", "Ushinath S. Noreloondat"]
TWO = ["Norelondat Tea and Sons", "NORELONDAT TEAS & SON'S", "M/s. Norelondat Tea n Sons", "Norelondat and Sons (Tea)"]
THREE = ["State of Malvarna", "THE STATE OF MALVARNA & ORS.", "Malvarna, State of", "Sate of Malvarna", "State of Mal.", "Malvarna State"]
OTHERS = ["Jagundari S. Norelondat", "Norelondat Salt and Sons", "State of Suryadesh", "Commissioner of Income Tax, Eravati", "Commissioner of Income Tax, Jorvani"]


def test_links(spark):
    named = groups(spark, ONE + TWO + THREE + OTHERS + [None, "", " ", "Unknown", "PETITIONER:", ONE[0], ONE[0]])
    for family in (ONE, TWO, THREE):
        assert len({named[n] for n in family}) == 1, family
    assert len({named[n] for n in [ONE[0], TWO[0], THREE[0], *OTHERS]}) == 3 + len(OTHERS)
    assert not {"", " ", "Unknown", "PETITIONER:"} & set(named)


def test_ambiguous_initials_stay_apart(spark):
    named = groups(spark, ["Belavath S. Tolarnat", "Beleshwin S. Tolarnat", "B. S. Tolarnat"])
    assert len(set(named.values())) == 3


def test_edges(spark):
    assert groups(spark, []) == {}
    named = groups(spark, ["x" * 50_000, "!!!", "12345", "A"], nick=None)
    assert len(named) <= 4
    df = spark.createDataFrame([("State of Malvarna", "Malvarna State")], "petitioner string, respondent string")
    pairs = party_names.spelling_pairs(party_names.parties(spark, df))
    assert [tuple(r) for r in pairs.collect()] == [("Malvarna State", "State of Malvarna")]


@pytest.mark.parametrize(("name", "kind", "head"), [("CIT Eravati", "office:tax", "eravati"), ("Abc Jute Pvt. Ltd.", "firm", "abc"), ("Vasi B.Unduratrat", "person", "unduratrat"), ("Municipal Corporation of Palivat", "office:municipal", "palivat")])
def test_parse(name, kind, head):
    found = party_names.parse(name, party_names.Snapper({"vasikesh": 1}), {})
    assert (found["kind"], found["head"]) == (kind, head)


def test_within():
    rng = random.Random(8)
    for _ in range(3_000):
        a = "".join(rng.choice("abक") for _ in range(rng.randint(0, 9)))
        b = list(a)
        for _ in range(rng.randint(0, 3)):
            i = rng.randint(0, len(b))
            b[i:i] = rng.choice("abक")
            if rng.random() < 0.5 and b:
                del b[rng.randrange(len(b))]
        b = "".join(b)
        d = metric_join.distance(a, b)
        assert metric_join.within(a, b, 2) == (d if d <= 2 else None), (a, b)


def test_long_strings_and_other_scripts(spark, monkeypatch):
    rng = random.Random(4)
    words = {"a" * 40 + "smith", "a" * 40 + "jones", "a" * 40 + "smiht", "राम", "रमा", "श्याम"}
    for _ in range(60):
        base = "".join(rng.choice("abcdeक") for _ in range(rng.randint(34, 90)))
        words |= {base, base[:5] + base[6:], base[:20] + base[21] + base[20] + base[22:], base + "xy", base[3:]}
    words = sorted(words)
    df = spark.createDataFrame([("k", w) for w in words], "kind string, head string")
    true = {(x, y, metric_join.distance(x, y)) for i, x in enumerate(words) for y in words[i + 1 :] if abs(len(x) - len(y)) <= 2 and metric_join.distance(x, y) <= 2}
    assert {(r["a"], r["b"], r["distance"]) for r in metric_join.radius_join(spark, df, 2).collect()} == true
    monkeypatch.setattr(metric_join, "CELL_CAP", 30)
    assert {(r["a"], r["b"], r["distance"]) for r in metric_join.radius_join(spark, df, 2).collect()} == true


def test_names_of_no_known_form(spark):
    named = groups(spark, ["राम कुमार", "राम  कुमार", "AB", "X Y", "A.B.", "AC", "M.C. Palivat", "Municipal Corporation of Palivat", "M.C. Tolarnat"])
    assert len(named) == 9 and named["राम कुमार"] == named["राम  कुमार"] and named["AB"] == named["A.B."] != named["AC"]
    assert named["M.C. Palivat"] == named["Municipal Corporation of Palivat"] != named["M.C. Tolarnat"]
