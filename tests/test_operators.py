"""Operators on small tables with known results, nulls and ties included."""

import random

import pytest
from pyspark.sql import functions as F

from docketloom.operators import chat, context, evaluation, graph, resolver, retrieval, tables
from docketloom.operators.components import connected_components
from docketloom.sources import files


@pytest.fixture(scope="module")
def three(spark):
    cases = spark.createDataFrame([(1, "Kesavananda Bharati v. State of Kerala", "Supreme Court", "1973-04-24"), (2, "Maneka Gandhi v. Union of India", "Supreme Court", "1978-01-25"), (3, "Minerva Mills v. Union of India", "Supreme Court", "1980-07-31")], "id long, label string, court string, date string")
    edges = spark.createDataFrame([(1, 2, 1, "followed", "Kesavananda Bharati case"), (2, 3, 1, "followed", "AIR 1973 SC 1461"), (3, 3, 2, "referred", "Maneka Gandhi judgment"), (4, 3, 3, "cited", "itself"), (5, 2, None, "cited", "nowhere"), (6, 2, 1, "overruled", "again")], "edge_id long, source_judgment_id long, target_judgment_id long, relationship_type string, cited_text string")
    return cases.withColumn("date", F.to_date("date")), edges


def test_graph_basics(spark, three):
    cases, edges = three
    assert {tuple(r) for r in graph.edge_set(edges).collect()} == {(2, 1), (3, 1), (3, 2)}
    best = {(r["source"], r["target"]): r["edge_id"] for r in graph.strongest_edges(edges).collect()}
    assert best == {(2, 1): 6, (3, 1): 2, (3, 2): 3}
    assert {r["id"]: (r["in_degree"], r["out_degree"]) for r in graph.degrees(cases, edges).collect()} == {1: (2, 0), 2: (1, 1), 3: (0, 2)}
    rank = {r["id"]: r["pagerank"] for r in graph.pagerank(spark, cases, edges).collect()}
    assert max(rank, key=rank.get) == 1 and abs(sum(rank.values()) - 1) < 1e-9
    nodes, kept = graph.subgraph(spark, edges, spark.createDataFrame([(1,)], "id long"))
    assert nodes.count() == 3 and kept.count() == 3
    assert graph.subgraph(spark, edges, spark.createDataFrame([(1,)], "id long"), most=2)[0].count() == 2


def test_paths(spark, three):
    cases, edges = three
    asked = spark.createDataFrame([(3, 1), (1, 3), (2, 2)], "start long, goal long")
    found = {(r["start"], r["goal"]): r["path"] for r in graph.shortest_paths(spark, edges, cases, asked).collect()}
    assert found == {(3, 1): [3, 1], (2, 2): [2]}


def test_neighbours_and_map(spark, three):
    cases, edges = three
    stats = spark.createDataFrame([(3, 0.5)], "id long, pagerank double")
    asked = spark.createDataFrame([(1, "cited_by")], "id long, direction string")
    ask = lambda **k: graph.neighbours(edges, cases, stats, asked, **k).collect()
    assert [r["other"] for r in ask()] == [3, 2] and ask()[0]["total"] == 2
    assert ask(contains="gandhi v. union")[0]["total"] == 1 and ask(contains="1973 sc")[0]["other"] == 3
    assert len(ask(court="supreme")) == 2 and ask(contains="nothing like this") == [] and ask(offset=5) == []
    tree = graph.mind_map(edges, cases, stats, spark.createDataFrame([(1,)], "id long"), branch=1).collect()
    assert sorted(r["kind"] for r in tree if r["parent"] is None) == ["case", "more"]
    summary = graph.precedent_summary(edges, cases).where("id = 1").collect()
    assert [r["other"] for r in sorted(summary, key=lambda r: r["rank"])] == [2, 3]


def test_components(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (4, 5), (6, 6), (None, 1), (9, 8), (8, 7)], "id_a long, id_b long")
    got = {r["id"]: r["component"] for r in connected_components(spark, edges).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 4, 5: 4, 7: 7, 8: 7, 9: 7}
    chain = spark.range(60).select(F.col("id").alias("id_a"), (F.col("id") + 1).alias("id_b"))
    assert {r["component"] for r in connected_components(spark, chain).collect()} == {0}
    assert connected_components(spark, edges.where("false")).count() == 0


RULINGS = [
    (1, "THE STATE OF BOMBAY AND ANOTHER", "F. N. BALSARA", "1951-05-25", "PETITIONER:\nTHE STATE OF BOMBAY\nCITATION:\n 1951 AIR 318   1951 SCR 682\n\nACT:"),
    (2, "HIS HOLINESS KESAVANANDA BHARATI SRIPADAGALVARU", "STATE OF KERALA AND ANR.", "1973-04-24", "CITATION:\n 1973 AIR 1461  1973 SCR  (4) 1 \n CITATOR INFO :"),
    (3, "N. V. SHANMUGHAM AND CO.", "COMMISSIONER OF INCOME-TAX, MADRAS", "1971-03-01", None),
    (4, "SUBHA LARA", "STATE OF PUNJAB(AND CONNECTED APPEALS)", "1960-01-01", None),
]


def test_resolver(spark):
    rulings = spark.createDataFrame(RULINGS, "id long, petitioner string, respondent string, date_of_judgment string, judgment_text string").withColumn("citations", F.lit(None).cast("string"))
    said = [
        ("[1951] S.C.R. 682", None, 1, "reporter"), ("A.I.R. 1973 S.C. 1461", None, 2, "reporter"), ("[1973] Supp. S.C.R. 1", None, None, "unresolved"),
        ("relied upon State of Bombay v. F. N. Balsara (1951) where", None, 1, "exact_name"), ("In State of Bombay v. Balsara the court", None, 1, "fuzzy"),
        ("Following Kesavananda Bharati v. State of Kerala, we hold", None, 2, "fuzzy"), ("Ltd. v. Commissioner of Income", None, None, "unresolved"),
        ("In Riha Subha v. State of Punjab", None, None, "unresolved"), ("A. K. Gopalan v. State of Madras", None, None, "unresolved"), ("1951 AIR 318", 1, None, "self"),
        ("", None, None, "unresolved"), (None, None, None, "unresolved"),
    ]
    mentions = spark.createDataFrame([(str(i), t, s) for i, (t, s, _, _) in enumerate(said)], "mention_id string, cited_text string, source_id long")
    years = rulings.select("id", F.substring("date_of_judgment", 1, 4).cast("int").alias("year"))
    got = {int(r["mention_id"]): (r["judgment_id"], r["method"]) for r in resolver.resolve(spark, mentions, resolver.alias_table(rulings), years).collect()}
    assert got == {i: (j, m) for i, (_, _, j, m) in enumerate(said)}


def test_resolver_keeps_names_out_of_the_driver(spark):
    rulings = spark.createDataFrame(RULINGS, "id long, petitioner string, respondent string, date_of_judgment string, judgment_text string").withColumn("citations", F.lit(None).cast("string"))
    mentions = spark.createDataFrame([("1", "1951 AIR 318", 1), ("2", "1951 AIR 318", 2), ("3", "State of Bombay v. F. N. Balsara", None)], "mention_id string, cited_text string, source_id long")
    years = rulings.select("id", F.substring("date_of_judgment", 1, 4).cast("int").alias("year"))
    found = resolver.resolve(spark, mentions, resolver.alias_table(rulings), years)
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()
    assert {tuple(r) for r in found.collect()} == {("1", None, "self", 100.0), ("2", 1, "reporter", 100.0), ("3", 1, "exact_name", 100.0)}


def _resolved(spark, rulings, said):
    """(judgment_id, method, score) per text, in the order of the texts."""
    cases = spark.createDataFrame(rulings, "id long, petitioner string, respondent string, date_of_judgment string").withColumn("judgment_text", F.lit(None).cast("string")).withColumn("citations", F.lit(None).cast("string"))
    mentions = spark.createDataFrame([(str(i), t, None) for i, t in enumerate(said)], "mention_id string, cited_text string, source_id long")
    years = cases.select("id", F.substring("date_of_judgment", 1, 4).cast("int").alias("year"))
    found = resolver.resolve(spark, mentions, resolver.alias_table(cases), years).collect()
    return [tuple(r)[1:] for r in sorted(found, key=lambda r: int(r["mention_id"]))]


def test_resolver_common_words(spark):
    crowd = [(100 + i, f"State of Zorabad Pilot{i}", f"Harivela Weaver{i} Salt Dyer{i}", "1950-01-01") for i in range(230)]
    aim = [(1, "State of Zorabad", "Harivela Mills Ltd.", "1961-01-01"), (2, "Harivela Mills", "Zorabad", "1961-01-01"), (3, "Zorabad", "Harivela Salt Timber", "1980-01-01"), (4, "Zorabad", "Harivela Salt Timber", "1985-01-01")]
    got = _resolved(spark, crowd + aim, ["Zorabad v. Harivela", "Zorabad v. Harivela (1985)", "Zorabad v. Harivela Salt", "Zorabad v. Harivela Salt (1984)", "Zorabad v. Harivela Salt (1985)", "Zorabad v. Harivela (1970)", "Salt v. Zorabad"])
    full, part = 100.0 * 2 / 3, 100.0 * 3 / 4
    assert got == [(1, "fuzzy", full), (4, "fuzzy", 50.0), (None, "ambiguous", part), (4, "fuzzy", part), (4, "fuzzy", part), (None, "unresolved", 0.0), (None, "unresolved", 0.0)]


def test_resolver_against_every_name(spark):
    rng = random.Random(5)
    words = ["arun", "bela", "chitra", "devi", "esha", "farid", "gopal", *(f"rare{x}" for x in "abcdefgh")]
    weights = [9] * 7 + [1] * 8
    side = lambda most: list(dict.fromkeys(rng.choices(words, weights, k=rng.randint(1, most))))
    names = [(i, side(5), side(5), rng.choice([None, *range(1960, 1966)])) for i in range(900)]
    asked = [(side(3), side(3), rng.choice([None, *range(1959, 1968)])) for _ in range(200)]
    whole = lambda a, b: " ".join([*a, "v", *b])
    want = []
    for cp, cr, year in asked:
        text, best, ids = f" {whole(cp, cr)} ", 0.0, {}
        inside = {whole(a, b) for _, a, b, _ in names if f" {whole(a, b)} " in text}
        for i, a, b, y in names:
            if inside:
                fits, score = whole(a, b) == max(inside, key=len), 100.0
            else:
                fits = len({*cp, *cr}) >= 2 and {*cp} <= {*a} and {*cr} <= {*b} and 3 * len(cp) >= len(a) and 3 * len(cr) >= len(b) and (None in (year, y) or abs(y - year) <= 1)
                score = 100.0 * len({*cp, *cr}) / len({*a, *b})
            if fits and score >= best:
                best, ids = score, {**(ids if score == best else {}), i: y}
        same = [i for i, y in ids.items() if year is not None and y == year]
        one = next(iter(ids)) if len(ids) == 1 else same[0] if len(same) == 1 else None
        want.append((one, "unresolved" if not ids else "ambiguous" if one is None else "exact_name" if inside else "fuzzy", best))
    rulings = [(i, " ".join(a).title(), " ".join(b).title(), None if y is None else f"{y}-01-01") for i, a, b, y in names]
    got = _resolved(spark, rulings, [f"{' '.join(cp).title()} v. {' '.join(cr).title()}" + (f" ({year})" if year else "") for cp, cr, year in asked])
    assert got == want
    assert {m for _, m, _ in want} == {"fuzzy", "exact_name", "ambiguous", "unresolved"}


def test_dense_topk_ties_and_empties(spark):
    vec = spark.createDataFrame([(1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, [0.0, 1.0]), (4, [0.0, 0.0]), (5, None)], "id long, v array<float>")
    got = retrieval.dense_topk(spark, vec.where("id = 1"), vec, 2, 0.2).orderBy("rank").collect()
    assert [(r["id"], r["similarity"]) for r in got] == [(1, 1.0), (2, 1.0)]
    assert retrieval.dense_topk(spark, vec.where("false"), vec).count() == 0


def test_fusion_order(spark):
    dense = spark.createDataFrame([(1, 10, 1, 0.9), (1, 11, 2, 0.8)], "query_id long, id long, rank int, similarity double")
    words = spark.createDataFrame([(1, 11, 1), (1, 12, 2)], "query_id long, id long, rank int")
    assert [r["id"] for r in retrieval.rrf_fuse(dense, words).orderBy("rank").collect()] == [11, 10, 12]
    exact = spark.createDataFrame([(1, 12)], "query_id long, id long")
    assert [r["id"] for r in retrieval.pin_exact(retrieval.rrf_fuse(dense, words), exact, 2).orderBy("rank").collect()] == [12, 11]


def test_tables(spark):
    rows = spark.createDataFrame([(1, "a"), (2, "a"), (3, None), (4, None), (5, "b")], "id long, t string")
    assert [r["id"] for r in tables.keepers(rows, "id", "t").orderBy("id").collect()] == [1, 3, 5]
    assert tuple(tables.duplicate_totals(tables.duplicate_groups(rows, "id", "t")).first()) == (2, 2)
    new = spark.createDataFrame([(9, "a"), (8, "c"), (7, "c")], "id long, t string")
    assert [r["id"] for r in tables.insert_ignore(rows, new, ["t"], [F.col("id")]).collect()] == [7]
    assert {(r["id"], r["t"]) for r in tables.upsert(rows.where("t is not null"), new, ["t"], [F.col("id")]).collect()} == {(9, "a"), (8, "c"), (5, "b")}
    keyed = tables.surrogate_keys(rows, ["id"], "k").orderBy("k").collect()
    assert [(r["k"], r["id"]) for r in keyed] == [(1, 1), (2, 2), (3, 3), (4, 4), (5, 5)]
    assert len(tables.schema_fingerprint(rows)) == 64
    assert tables.changed_rows(rows, rows.withColumn("t", F.coalesce("t", F.lit("x"))), "id", ["t"]).count() == 2


def messages(spark, n, words=1):
    rows = [("s", i, "user" if i % 2 == 0 else "assistant", f"message{i} " + "w " * (words - 1), None, None) for i in range(n)]
    return spark.createDataFrame(rows, "session string, pos int, role string, content string, prompt_text string, retrieval_query string")


def test_chat(spark):
    m = messages(spark, 12)
    assert chat.history_window(m, 10_000).count() == 12 and chat.history_window(m, 1).count() == 0
    part = chat.history_window(m, 28).orderBy("pos").collect()
    assert 0 < len(part) < 12 and part[0]["role"] == "user"
    split = chat.summary_split(messages(spark, 20, 50), 500).groupBy("keep").count().collect()
    assert len(split) == 2 and sum(r["count"] for r in split) == 20
    batches = chat.summary_batches(messages(spark, 6, 20), 60).groupBy("batch").count().collect()
    assert len(batches) > 1
    assert chat.previous_query(m).where("pos = 3").first()["previous_query"].startswith("message2")
    back = chat.import_json(chat.export_json(m)).first()
    assert back["valid"] and len(back["messages"]) == 12
    bad = spark.createDataFrame([('{"format":"x"}',), ("no json",), ('{"format":"legal-chat","version":1,"messages":[{"pos":1,"role":"robot","content":"a"}]}',)], "document string")
    assert [r["reason"] for r in chat.import_json(bad).collect()] == ["format", "format", "role"]


def test_metrics(spark):
    ranked = spark.createDataFrame([(1, "a", 1), (1, "b", 2), (1, "c", 3)], "query_id long, id string, rank int")
    asked = spark.createDataFrame([(1,), (2,)], "query_id long")
    value = lambda target: evaluation.metrics(evaluation.first_hits(ranked, spark.createDataFrame([(1, t) for t in target], "query_id long, id string"), asked.where("query_id = 1")), cuts=(1, 2)).first()
    b = value(["b"])
    assert (b["recall_at_1"], b["recall_at_2"], b["mrr"], round(b["ndcg_at_2"], 4)) == (0.0, 1.0, 0.5, 0.6309)
    assert value(["c", "b"])["mrr"] == 0.5 and value(["z"])["mrr"] == 0.0


def test_context():
    chunks = [{"text": "a b c", "case": "X v. Y", "court": "C", "year": 1950, "judgment_id": 101}, {"text": "d", "case": "Z", "court": "C", "year": 1951, "judgment_id": 202}, {"text": "e", "case": "X v. Y", "court": "C", "year": 1950, "judgment_id": 101}]
    block = context.context_block(chunks)
    assert block.index("[1]") < block.index("[3]") < block.index("[2]") and block.count("Case:") == 2
    assert context.context_block([]) == "" and context.context_block(chunks, 30) == ""
    assert context.clean_answer("Context: x\nAnswer: yes  it is\nQuestion: y") == "Answer: yes it is"
    assert context.estimate(context.shorten("w " * 500, 50)) <= 50


def test_files(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("hello")
    got = files.extracted_texts(files.binary_documents(spark, str(tmp_path / "in"), "*.txt"), files.plain_text).first()
    assert (got["text"], got["kind"], got["success"]) == ("hello", "txt", True)
    table = spark.range(3)
    files.replace_table(table, str(tmp_path / "t"))
    files.replace_table(table.where("id > 0"), str(tmp_path / "t"))
    assert spark.read.parquet(str(tmp_path / "t")).count() == 2
    page = spark.createDataFrame([(1, "<table><tr><td>1</td><td>b</td><td><b>c</b></td><td>d</td><td>e</td></tr><tr><td>x</td></tr></table>")], "page long, html string")
    assert files.case_rows(page).first()["cells"] == ["1", "b", "c", "d", "e"]
    assert [files.safe_source(x) for x in ("../../etc/passwd", "/etc/hosts", "notes.txt", "", None, "BNS.pdf")] == [False] * 5 + [True]
    assert files.record_run(spark, str(tmp_path / "runs"), "r", "k", {"a": 1.0})


def test_stream(spark, tmp_path):
    from docketloom.streaming import ingest

    docs = spark.sql("select cast(id as bigint) doc_id, 'x' text, 's' source, timestamp'2024-01-01' ingested_at from range(5)")
    docs.unionByName(docs.where("doc_id < 2")).write.parquet(str(tmp_path / "in"))
    stream = ingest.document_stream(spark, str(tmp_path / "in"), docs.schema)
    ingest.append_new(stream, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(60)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 5


def test_workspace_uses_the_session_folder(spark):
    from docketloom.workspace import Workspace

    work = Workspace(spark, "t")
    kept = work.save(spark.range(3), "a")
    assert kept.count() == 3
    setting = spark.conf.get("spark.checkpoint.dir", None)
    assert work.root.startswith(setting.rstrip("/") if setting else "file://")
    work.close()


def test_pipeline(spark, data, tmp_path):
    from docketloom import pipeline

    assert len(pipeline.build(spark, data, str(tmp_path))) == 4
    stats = spark.read.parquet(f"{tmp_path}/judgment_graph_stats.parquet")
    chunks = spark.read.parquet(f"{tmp_path}/judgment_chunks.parquet")
    total = stats.agg(F.sum("pagerank")).first()[0]  # a graph without links has no ranks
    assert abs(total - 1) < 1e-6 or total == 0
    assert chunks.select("chunk_id").distinct().count() == chunks.count() == chunks.agg(F.max("chunk_id")).first()[0]


def test_marks_and_sources(spark):
    said = spark.createDataFrame([(1, "held [2] and [3] and again [2] and [9]")], "answer_id long, answer string")
    got = spark.createDataFrame([(1, 1, 10), (1, 2, 20), (1, 3, 30)], "answer_id long, rank int, id long")
    assert [r["id"] for r in chat.cited_marks(said, got).orderBy("position").collect()] == [20, 30]
    rows = spark.createDataFrame([(1, 1, "judgment", "A v. B", "C", 1950, None), (1, 2, "statute", "Constitution of X", None, None, "21"), (1, 3, "judgment", "A v. B", "C", 1950, None)], "query_id long, rank int, doc_type string, case string, court string, year int, section_number string")
    assert [r["label"] for r in context.source_labels(rows).orderBy("position").collect()] == ["A v. B (C, 1950)", "Constitution of X, Art. 21"]


def test_names_are_searched_in_blocks(spark, monkeypatch):
    import random
    import re

    from docketloom.operators import similar

    monkeypatch.setattr(similar, "NAMES_A_BLOCK", 50)
    monkeypatch.setattr(similar, "LEAST_QUERIES", 10)
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abe") for _ in range(rng.randint(2, 5)))
    names = sorted({f"{word()} {word()} v {word()}" for _ in range(200)})
    asked = sorted({f"{word()} v {word()}" for _ in range(40)})
    pieces = lambda s: {f"  {w} "[i : i + 3] for w in re.findall("[a-z0-9]+", s) for i in range(len(w) + 1)}
    likeness = {(q, n): len(pieces(q) & pieces(n)) / len(pieces(q) | pieces(n)) for q in asked for n in names}
    frame = spark.createDataFrame([(n, i) for i, n in enumerate(names)], "alias_norm string, judgment_id long")
    queries = spark.createDataFrame([(q,) for q in asked], "norm string")
    found = {(r["norm"], r["alias_norm"]): r["shared"] / r["together"] for r in similar.near_names(queries, frame, 0.3, 10_000).collect()}
    assert found == {k: v for k, v in likeness.items() if v > 0.3}
    few = {(r["norm"], r["alias_norm"]) for r in similar.near_names(queries, frame, 0.3, 5).collect()}
    assert len(few) < len(found)
    rank = lambda q, some: sorted(some, key=lambda n: (-round(100 * likeness[q, n], 1), n))[:5]
    assert all(rank(q, [n for a, n in few if a == q]) == rank(q, [n for a, n in found if a == q]) for q in asked)
