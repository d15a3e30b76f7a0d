"""Citation graph operators over an edge table (source, target, relationship, edge_id)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docketloom.functions.text import relationship_rank
from docketloom.operators.retrieval import rank_by
from docketloom.workspace import Workspace

DAMPING = 0.85
LEAST_SIMILAR = 0.3


def valid_edges(edges: DataFrame, source: str = "source_judgment_id", target: str = "target_judgment_id") -> DataFrame:
    """Resolved edges that don't point at themselves, under the names source and target."""
    return edges.where(F.col(source).isNotNull() & F.col(target).isNotNull() & (F.col(source) != F.col(target))).withColumnsRenamed({source: "source", target: "target"})


def edge_set(edges: DataFrame) -> DataFrame:
    return valid_edges(edges).select("source", "target").distinct()


def strongest_edges(edges: DataFrame) -> DataFrame:
    """One edge per (source, target): the strongest treatment, then the lowest edge id."""
    e = valid_edges(edges).withColumn("rel_rank", relationship_rank("relationship_type"))
    best = e.groupBy("source", "target").agg(F.min_by(F.struct("edge_id", "relationship_type", "rel_rank", "cited_text"), F.struct("rel_rank", "edge_id")).alias("e"))
    return best.select("source", "target", "e.edge_id", "e.relationship_type", "e.rel_rank", "e.cited_text")


def degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, in_degree, out_degree) for all nodes, isolated ones included."""
    pairs = edge_set(edges)
    into, out = pairs.groupBy(F.col("target").alias("id")).agg(F.count("*").alias("in_degree")), pairs.groupBy(F.col("source").alias("id")).agg(F.count("*").alias("out_degree"))
    return nodes.select("id").join(into, "id", "left").join(out, "id", "left").fillna(0, ["in_degree", "out_degree"])


def pagerank(spark: SparkSession, nodes: DataFrame, edges: DataFrame, iterations: int | None = None, tolerance: float = 1e-6, most: int = 100) -> DataFrame:
    """(id, pagerank) by power iteration; without ``iterations`` until the L1 change is below N * tolerance.

    Nodes without links spread their rank evenly. State is written each round,
    hot targets pre-aggregate before the shuffle.
    """
    work = Workspace(spark, "pagerank")
    pairs = edge_set(edges)
    ids = nodes.select("id").distinct()
    pairs = pairs.join(ids.select(F.col("id").alias("source")), "source", "left_semi").join(ids.select(F.col("id").alias("target")), "target", "left_semi")
    out = work.save(pairs.groupBy("source").agg(F.count("*").alias("links")), "out")
    links = work.save(pairs.join(out, "source"), "links")
    total = ids.count()
    if not total or not links.limit(1).count():
        return ids.select("id", F.lit(0.0).alias("pagerank"))
    now = work.save(ids.join(out.select(F.col("source").alias("id"), F.lit(True).alias("linked")), "id", "left").select("id", F.coalesce("linked", F.lit(False)).alias("linked"), F.lit(1.0 / total).alias("pr")), "r0")
    for turn in range(1, (iterations or most) + 1):
        loose = now.where("not linked").agg(F.coalesce(F.sum("pr"), F.lit(0.0)).alias("d")).first()["d"]
        got = links.join(now.select(F.col("id").alias("source"), "pr"), "source").groupBy(F.col("target").alias("id")).agg(F.sum(F.col("pr") / F.col("links")).alias("got"))
        nxt = now.withColumnRenamed("pr", "old").join(got, "id", "left").select("id", "linked", (F.coalesce("got", F.lit(0.0)) * DAMPING + (DAMPING * loose + 1 - DAMPING) / total).alias("pr"), "old")
        nxt = work.save(nxt, f"r{turn}")
        moved = nxt.agg(F.sum(F.abs(F.col("pr") - F.col("old"))).alias("m")).first()["m"] if not iterations else 1.0
        work.drop(f"r{turn - 1}")
        now = nxt.drop("old")
        if not iterations and moved < total * tolerance:
            break
    return now.select("id", F.col("pr").alias("pagerank"))


def landmarks(stats: DataFrame, limit: int) -> DataFrame:
    """The top cases by rank, in-degree and id."""
    return stats.orderBy(F.desc("pagerank"), F.desc("in_degree"), "id").limit(limit)


def sides(edges: DataFrame) -> DataFrame:
    """(id, direction, other, …): every strongest edge seen from both ends."""
    best = strongest_edges(edges)
    keep = ["edge_id", "relationship_type", "rel_rank", "cited_text"]
    cites = best.select(F.col("source").alias("id"), F.lit("cites").alias("direction"), F.col("target").alias("other"), *keep)
    return cites.unionByName(best.select(F.col("target").alias("id"), F.lit("cited_by").alias("direction"), F.col("source").alias("other"), *keep))


def neighbours(edges: DataFrame, cases: DataFrame, stats: DataFrame, asked: DataFrame, limit: int = 20, offset: int = 0, relationship: str | None = None, contains: str | None = None, court: str | None = None) -> DataFrame:
    """A page of neighbours per asked (id, direction), with the number of all matches beside it.

    ``cases`` is (id, label, court); ``stats`` is (id, pagerank). The total counts all
    matches, also when the offset lies past their end.
    """
    rows = sides(edges).join(asked, ["id", "direction"]).join(cases.select(F.col("id").alias("other"), "label", "court"), "other")
    rows = rows.join(stats.select(F.col("id").alias("other"), "pagerank"), "other", "left").withColumn("pagerank", F.coalesce("pagerank", F.lit(0.0)))
    if relationship:
        rows = rows.where(F.col("relationship_type") == relationship)
    if contains:
        rows = rows.where(F.lower("label").contains(contains.lower()) | F.lower("cited_text").contains(contains.lower()))
    if court:
        rows = rows.where(F.lower("court").contains(court.lower()))
    rows = rows.withColumn("total", F.count("*").over(Window.partitionBy("id", "direction")))
    ranked = rank_by(rows, ["id", "direction"], [F.desc("pagerank"), F.col("rel_rank"), F.col("other")])
    return ranked.where((F.col("rank") > offset) & (F.col("rank") <= offset + limit))


def precedent_summary(edges: DataFrame, cases: DataFrame, top: int = 3) -> DataFrame:
    """Per case and side the number of neighbours and its strongest ``top`` by treatment, then id."""
    rows = sides(edges).withColumn("total", F.count("*").over(Window.partitionBy("id", "direction")))
    best = rank_by(rows, ["id", "direction"], [F.col("rel_rank"), F.col("other")], top)
    return best.join(cases.select(F.col("id").alias("other"), "label"), "other").select("id", "direction", "total", "rank", "other", "label", "relationship_type")


def subgraph(spark: SparkSession, edges: DataFrame, seeds: DataFrame, depth: int = 2, most: int = 100, score: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Undirected neighbourhoods of many seeds: nodes (seed, id, hop, found, exact, rank), edges (seed, source, target, …).

    Levels are added whole; a seed stops growing once a level takes it past
    ``most`` nodes. Then the nearest, best scored, smallest ids are kept, and the
    edges with both ends kept. ``exact`` tells whether ``found`` counts all nodes in reach.
    """
    work = Workspace(spark, "subgraph")
    pairs = edge_set(edges)
    both = work.save(pairs.unionByName(pairs.select(F.col("target").alias("source"), F.col("source").alias("target"))).distinct(), "both")
    seen = work.save(seeds.select(F.col("id").alias("seed"), "id", F.lit(0).alias("hop")).distinct(), "n0")
    for hop in range(1, depth + 1):
        size = seen.groupBy("seed").agg(F.count("*").alias("size")).where(F.col("size") < most)
        edge_of = seen.where(F.col("hop") == hop - 1).join(size, "seed", "left_semi")
        fresh = edge_of.join(both, F.col("id") == F.col("source")).select("seed", F.col("target").alias("id")).distinct().join(seen, ["seed", "id"], "left_anti").withColumn("hop", F.lit(hop))
        grown = work.save(seen.unionByName(fresh), f"n{hop}")
        work.drop(f"n{hop - 1}")
        seen = grown
    if score is None:
        seen = seen.withColumn("score", F.lit(0.0))
    else:
        seen = seen.join(score.select("id", F.col("pagerank").alias("score")), "id", "left").fillna(0.0, ["score"])
    w = Window.partitionBy("seed")
    ranked = rank_by(seen.withColumn("found", F.count("*").over(w)).withColumn("reach", F.max("hop").over(w)), "seed", [F.col("hop"), F.desc("score"), F.col("id")])
    nodes = ranked.where(F.col("rank") <= most).select("seed", "id", "hop", "found", ((F.col("found") < most) | (F.col("reach") >= depth)).alias("exact"), "rank")
    a, b = nodes.select("seed", F.col("id").alias("source")), nodes.select("seed", F.col("id").alias("target"))
    kept = strongest_edges(edges).join(a, "source").join(b, ["seed", "target"])
    return nodes, kept.select("seed", "source", "target", "relationship_type", "edge_id")


def shortest_paths(spark: SparkSession, edges: DataFrame, dates: DataFrame, pairs: DataFrame, most: int = 12) -> DataFrame:
    """(start, goal, hops, path): shortest directed paths of many pairs, or no row where there is none.

    A step is taken only to a case that isn't younger than the start nor older
    than the goal; cases without date pass. Among equally short paths each node
    keeps its smallest parent. ``dates`` is (id, date).
    """
    work = Workspace(spark, "paths")
    link = work.save(edge_set(edges), "links")
    asked = pairs.select("start", "goal").where("start is not null and goal is not null").distinct()
    bound = asked.join(dates.select(F.col("id").alias("start"), F.col("date").alias("newest")), "start", "left").join(dates.select(F.col("id").alias("goal"), F.col("date").alias("oldest")), "goal", "left")
    bound = work.save(bound, "bound")
    front = work.save(bound.select("start", "goal", F.col("start").alias("at"), F.array("start").alias("path")), "f0")
    seen = work.save(front.select("start", "goal", "at"), "s0")
    done = front.where("start = goal").select("start", "goal", F.lit(0).alias("hops"), "path")
    for hop in range(1, most + 1):
        step = front.where("at <> goal").join(link, F.col("at") == F.col("source")).join(dates.select(F.col("id").alias("target"), "date"), "target", "left").join(bound, ["start", "goal"])
        inside = F.col("date").isNull() | ((F.col("newest").isNull() | (F.col("date") <= F.col("newest"))) & (F.col("oldest").isNull() | (F.col("date") >= F.col("oldest"))))
        nxt = step.where(inside | (F.col("target") == F.col("goal"))).groupBy("start", "goal", F.col("target").alias("to")).agg(F.min_by("path", "at").alias("path"))
        nxt = nxt.join(seen.withColumnRenamed("at", "to"), ["start", "goal", "to"], "left_anti").select("start", "goal", F.col("to").alias("at"), F.concat("path", F.array("to")).alias("path"))
        nxt = work.save(nxt, f"f{hop}")
        hit = nxt.where("at = goal").select("start", "goal", F.lit(hop).alias("hops"), "path")
        done = done.unionByName(hit)
        reached = nxt.where("at = goal").select("start", "goal")
        front = nxt.join(reached, ["start", "goal"], "left_anti")
        seen = work.save(seen.unionByName(nxt.select("start", "goal", "at")), f"s{hop}")
        work.drop(f"s{hop - 1}")
        if not front.limit(1).count():
            break
    return done


def mind_map(edges: DataFrame, cases: DataFrame, stats: DataFrame, roots: DataFrame, branch: int = 12, child: int = 5) -> DataFrame:
    """Two-level trees as flat rows (root, direction, parent, kind, id, label, relationship_type, position, total).

    Each side lists up to ``branch`` neighbours and a row ``more`` with the number
    left out; each neighbour lists up to ``child`` of its own, the root excepted.
    """
    rows = sides(edges).join(stats.select(F.col("id").alias("other"), "pagerank"), "other", "left").fillna(0.0, ["pagerank"]).join(cases.select(F.col("id").alias("other"), "label"), "other")
    order = [F.desc("pagerank"), F.col("rel_rank"), F.col("other")]
    own = rows.join(roots.select("id").distinct(), "id", "left_semi").withColumn("total", F.count("*").over(Window.partitionBy("id", "direction")))
    first = rank_by(own, ["id", "direction"], order, branch)
    level = first.select(F.col("id").alias("root"), "direction", F.lit(None).cast("long").alias("parent"), F.lit("case").alias("kind"), F.col("other").alias("id"), "label", "relationship_type", F.col("rank").alias("position"), "total")
    more = own.select(F.col("id").alias("root"), "direction", "total").distinct().where(F.col("total") > branch).select("root", "direction", F.lit(None).cast("long").alias("parent"), F.lit("more").alias("kind"), F.lit(None).cast("long").alias("id"), F.concat(F.lit("+"), F.col("total") - branch, F.lit(" more")).alias("label"), F.lit(None).cast("string").alias("relationship_type"), F.lit(branch + 1).alias("position"), "total")
    down = level.select("root", "direction", F.col("id").alias("parent")).join(rows.withColumnRenamed("id", "parent"), ["parent", "direction"]).where(F.col("other") != F.col("root"))
    down = down.withColumn("total", F.count("*").over(Window.partitionBy("root", "direction", "parent")))
    second = rank_by(down, ["root", "direction", "parent"], order, child).select("root", "direction", "parent", F.lit("case").alias("kind"), F.col("other").alias("id"), "label", "relationship_type", F.col("rank").alias("position"), "total")
    return level.unionByName(more).unionByName(second)


def _containing(asked: DataFrame, names: DataFrame) -> DataFrame:
    """(query, norm, alias_norm): names that contain a query, met over its rarest run of three characters.

    Queries shorter than three characters are met over every run that begins with them.
    """
    runs = lambda c: F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(c) - 2, F.lit(1))), lambda i: F.col(c).substr(i, F.lit(3))))
    index = names.select("alias_norm", F.explode(runs("alias_norm")).alias("run"))
    df = index.groupBy("run").agg(F.count("*").alias("df"))
    mine = asked.where("length(norm) >= 3").select("query", "norm", F.explode(runs("norm")).alias("run")).join(df, "run")
    best = mine.groupBy("query", "norm").agg(F.min_by("run", F.struct("df", "run")).alias("run"), F.count("*").alias("n"), F.first(F.size(runs("norm"))).alias("wanted")).where("n = wanted")
    brief = asked.where("length(norm) < 3").join(df.select("run"), F.col("run").contains(F.col("norm"))).select("query", "norm", "run")
    met = best.select("query", "norm", "run").unionByName(brief).join(index, "run")
    return met.where(F.col("alias_norm").contains(F.col("norm"))).select("query", "norm", "alias_norm").distinct()


def search_cases(aliases: DataFrame, cases: DataFrame, asked: DataFrame, limit: int = 10) -> DataFrame:
    """(query, id, match_type, score, rank): cases by id, reporter citation or (part of) a name.

    ``aliases`` is (alias_norm, judgment_id, kind); ``cases`` (id, petitioner, respondent); ``asked`` (query).
    Digits search ids alone; a citation searches citations alone; raw columns are tried only where nothing matched.
    """
    from docketloom.functions.citations import with_reporter_keys
    from docketloom.functions.names import normal_case_name
    from docketloom.functions.text import trigram_similarity
    from docketloom.operators.similar import near_names

    work = Workspace(asked.sparkSession, "case-search")
    aliases = work.save(aliases, "aliases")
    q = with_reporter_keys(asked.select("query").distinct(), "query").select(F.trim("query").alias("query"), "reporters").where("query <> ''")
    q = work.save(q.withColumn("norm", normal_case_name("query")).withColumn("digits", F.col("query").rlike(r"^\d+$")), "queries")
    by_id = q.where("digits").join(cases.select("id"), F.expr("try_cast(query as bigint)") == F.col("id")).select("query", "id", F.lit("id").alias("match_type"), F.lit(100.0).alias("score"))
    keys = q.select("query", F.explode(F.flatten(F.transform("reporters", lambda r: F.array(r["key"], r["loose_key"])))).alias("alias_norm"))
    by_key = keys.join(aliases.where("kind = 'reporter'"), "alias_norm").select("query", F.col("judgment_id").alias("id"), F.lit("reporter").alias("match_type"), F.lit(100.0).alias("score"))
    named = q.where("not digits and size(reporters) = 0 and norm <> ''").select("query", "norm")
    names = aliases.where("kind = 'case_name'")
    score = lambda similarity: F.round(100 * similarity, 1)
    near = near_names(named, names, LEAST_SIMILAR, limit).select("norm", "alias_norm", score(F.col("shared") / F.col("together")).alias("score"))
    inside = _containing(named.select(F.col("norm").alias("query"), "norm").distinct(), names.select("alias_norm").distinct()).select("norm", "alias_norm", score(trigram_similarity(F.col("alias_norm"), F.col("norm"))).alias("score"))
    like = work.save(near.unionByName(inside).distinct(), "like").join(names, "alias_norm").join(named, "norm")
    exact = F.col("alias_norm") == F.col("norm")
    by_name = like.select("query", F.col("judgment_id").alias("id"), F.when(exact, "exact_name").otherwise("name").alias("match_type"), F.when(exact, 100.0).otherwise(F.col("score")).alias("score"))
    hits = work.save(by_id.unionByName(by_key).unionByName(by_name), "hits")
    left = named.join(hits.select("query").distinct(), "query", "left_anti")
    sides_ = cases.select("id", F.explode(F.array("petitioner", "respondent")).alias("side")).where("side is not null")
    texts = sides_.select(F.lower("side").alias("alias_norm")).distinct()
    raw = _containing(left.select("query", F.lower("query").alias("norm")), texts).join(sides_.withColumn("alias_norm", F.lower("side")), "alias_norm").select("query", "id").distinct()
    hits = hits.unionByName(raw.select("query", "id", F.lit("name").alias("match_type"), F.lit(50.0).alias("score")))
    best = hits.groupBy("query", "id").agg(F.max("score").alias("score"), F.max_by("match_type", F.struct("score", F.col("match_type") != "name")).alias("match_type"))
    return rank_by(best, "query", [F.desc("score"), F.col("id")], limit)


def reachable(spark: SparkSession, edges: DataFrame, seeds: DataFrame, a: str = "source", b: str = "target") -> DataFrame:
    """(seed, id): nodes connected with a seed inside a drawn network, whatever the direction."""
    from docketloom.operators.components import connected_components

    part = connected_components(spark, edges, a, b)
    mine = seeds.select(F.col("id").alias("seed")).join(part.withColumnRenamed("id", "seed"), "seed")
    return mine.join(part, "component").select("seed", "id")


def merge_graphs(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Several drawn graphs as one: the first node and the first edge of a pair win, centres stay flagged.

    ``nodes`` is (graph, id, centre, …), ``edges`` (graph, source, target, …).
    """
    w = Window.partitionBy("id")
    first = nodes.withColumn("_r", F.row_number().over(w.orderBy("graph"))).withColumn("centre", F.max("centre").over(w)).where("_r = 1").drop("_r", "graph")
    return first, edges.withColumn("_r", F.row_number().over(Window.partitionBy("source", "target").orderBy("graph"))).where("_r = 1").drop("_r", "graph")
