"""Citation graph queries over citation_edges and judgments."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docketloom.functions.text import case_label
from docketloom.operators import graph
from docketloom.operators.components import connected_components
from docketloom.sources.tables import table


def _edges(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "citation_edges")


def _cases(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "judgments").select("id", case_label("petitioner", "respondent").alias("label"), "court", F.col("date_of_judgment").alias("date"))


def _seeds(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "judgments").where("id % 50 = 0").select("id")


def _stats(spark: SparkSession, d: str) -> DataFrame:
    """A rank by in-degree share: cheap, and exact in SQL."""
    deg = graph.degrees(_cases(spark, d), _edges(spark, d))
    return deg.select("id", (F.col("in_degree") / F.lit(1000.0)).alias("pagerank"), "in_degree")


def edge_distinct(spark: SparkSession, d: str) -> DataFrame:
    return graph.edge_set(_edges(spark, d))


def edge_strongest(spark: SparkSession, d: str) -> DataFrame:
    return graph.strongest_edges(_edges(spark, d)).select("source", "target", "edge_id", "relationship_type", "rel_rank")


def degrees(spark: SparkSession, d: str) -> DataFrame:
    return graph.degrees(_cases(spark, d), _edges(spark, d))


def graph_summary(spark: SparkSession, d: str) -> DataFrame:
    deg = graph.degrees(_cases(spark, d), _edges(spark, d))
    return deg.agg(F.count("*").alias("nodes"), F.sum("out_degree").alias("edges"), F.sum(F.when(F.col("in_degree") > 0, 1).otherwise(0)).alias("cited"), F.max("in_degree").alias("max_in_degree"))


def pagerank_10iter(spark: SparkSession, d: str) -> DataFrame:
    return graph.pagerank(spark, _cases(spark, d), _edges(spark, d), iterations=10).select("id", F.round("pagerank", 9).alias("pagerank"))


def pagerank_converged(spark: SparkSession, d: str) -> DataFrame:
    return graph.pagerank(spark, _cases(spark, d), _edges(spark, d)).select("id", F.round("pagerank", 9).alias("pagerank"))


def landmark_cases(spark: SparkSession, d: str) -> DataFrame:
    return graph.landmarks(_stats(spark, d), 20).select("id", "in_degree")


def _asked(spark: SparkSession, d: str) -> DataFrame:
    return _seeds(spark, d).select("id", F.explode(F.array(F.lit("cites"), F.lit("cited_by"))).alias("direction"))


_PAGE = ("id", "direction", "rank", "other", "relationship_type", "total")


def neighbors_page(spark: SparkSession, d: str) -> DataFrame:
    return graph.neighbours(_edges(spark, d), _cases(spark, d), _stats(spark, d), _asked(spark, d)).select(*_PAGE)


def neighbors_second_page(spark: SparkSession, d: str) -> DataFrame:
    return graph.neighbours(_edges(spark, d), _cases(spark, d), _stats(spark, d), _asked(spark, d), limit=5, offset=5).select(*_PAGE)


def neighbors_filtered(spark: SparkSession, d: str) -> DataFrame:
    return graph.neighbours(_edges(spark, d), _cases(spark, d), _stats(spark, d), _asked(spark, d), relationship="followed", contains="state", court="bharvana").select(*_PAGE)


def precedent_summary(spark: SparkSession, d: str) -> DataFrame:
    return graph.precedent_summary(_edges(spark, d), _cases(spark, d)).select("id", "direction", "total", "rank", "other", "relationship_type")


def khop_nodes(spark: SparkSession, d: str) -> DataFrame:
    return graph.subgraph(spark, _edges(spark, d), _seeds(spark, d))[0].select("seed", "id", "hop", "found", "rank")


def khop_edges(spark: SparkSession, d: str) -> DataFrame:
    return graph.subgraph(spark, _edges(spark, d), _seeds(spark, d))[1]


def shortest_path(spark: SparkSession, d: str) -> DataFrame:
    """From every seed to the next seed by id, and back."""
    ids = _seeds(spark, d)
    last = ids.agg(F.max("id").alias("top"))
    pair = ids.join(F.broadcast(last)).select(F.col("id").alias("start"), F.when(F.col("id") < F.col("top"), F.col("id") + 50).otherwise(F.lit(50)).alias("goal"))
    both = pair.unionByName(pair.select(F.col("goal").alias("start"), F.col("start").alias("goal")))
    return graph.shortest_paths(spark, _edges(spark, d), _cases(spark, d), both)


def mind_map_flat(spark: SparkSession, d: str) -> DataFrame:
    return graph.mind_map(_edges(spark, d), _cases(spark, d), _stats(spark, d), _seeds(spark, d)).select("root", "direction", "parent", "kind", "id", "relationship_type", "position", "total")


def graph_components(spark: SparkSession, d: str) -> DataFrame:
    part = connected_components(spark, graph.edge_set(_edges(spark, d)), "source", "target")
    return part.groupBy("component").agg(F.count("*").alias("size"))


QUERIES = {f.__name__: f for f in (edge_distinct, edge_strongest, degrees, graph_summary, pagerank_10iter, pagerank_converged, landmark_cases, neighbors_page, neighbors_second_page, neighbors_filtered, precedent_summary, khop_nodes, khop_edges, shortest_path, mind_map_flat, graph_components)}

_RANK = "CASE relationship_type WHEN 'overruled' THEN 0 WHEN 'followed' THEN 1 WHEN 'distinguished' THEN 2 WHEN 'referred' THEN 3 WHEN 'cited' THEN 4 ELSE 5 END"
_VALID = f"valid AS (SELECT source_judgment_id AS source, target_judgment_id AS target, edge_id, relationship_type, cited_text, {_RANK} rel_rank FROM citation_edges WHERE target_judgment_id IS NOT NULL AND source_judgment_id <> target_judgment_id)"
_PAIRS = f"{_VALID}, pairs AS (SELECT DISTINCT source, target FROM valid)"
_BEST = f"{_VALID}, best AS (SELECT * FROM valid QUALIFY row_number() OVER (PARTITION BY source, target ORDER BY rel_rank, edge_id) = 1)"
_DEG = "deg AS (SELECT j.id, coalesce(i.n, 0) in_degree, coalesce(o.n, 0) out_degree FROM judgments j LEFT JOIN (SELECT target, count(*) n FROM pairs GROUP BY target) i ON i.target = j.id LEFT JOIN (SELECT source, count(*) n FROM pairs GROUP BY source) o ON o.source = j.id)"
_SIDES = f"{_BEST}, sides AS (SELECT source id, 'cites' direction, target other, edge_id, relationship_type, rel_rank, cited_text FROM best UNION ALL SELECT target, 'cited_by', source, edge_id, relationship_type, rel_rank, cited_text FROM best)"
_CASES = "cases AS (SELECT id, coalesce(nullif(petitioner, ''), 'Unknown') || ' v. ' || coalesce(nullif(respondent, ''), 'Unknown') label, court FROM judgments)"


def _page(where: str = "", low: int = 0, high: int = 20) -> str:
    return f"""WITH {_SIDES}, {_CASES}, pairs AS (SELECT DISTINCT source, target FROM valid), {_DEG},
    rows AS (SELECT s.id, direction, other, relationship_type, rel_rank, in_degree / 1000.0 pr, count(*) OVER (PARTITION BY s.id, direction) total FROM sides s JOIN cases c ON c.id = s.other LEFT JOIN deg ON deg.id = s.other WHERE s.id % 50 = 0 AND s.id IN (SELECT id FROM judgments) {where})
    SELECT id, direction, row_number() OVER (PARTITION BY id, direction ORDER BY pr DESC, rel_rank, other) AS rank, other, relationship_type, total FROM rows QUALIFY rank > {low} AND rank <= {high}"""


_KHOP = f"""{_PAIRS}, both_ AS (SELECT source, target FROM pairs UNION SELECT target, source FROM pairs),
    n0 AS (SELECT id seed, id, 0 hop FROM judgments WHERE id % 50 = 0),
    n1 AS (SELECT * FROM n0 UNION ALL SELECT DISTINCT seed, target, 1 FROM n0 JOIN both_ ON source = id WHERE target <> seed),
    small AS (SELECT seed FROM n1 GROUP BY seed HAVING count(*) < 100),
    n2 AS (SELECT * FROM n1 UNION ALL (SELECT DISTINCT seed, target id, 2 hop FROM n1 JOIN small USING (seed) JOIN both_ ON source = n1.id WHERE hop = 1 AND (seed, target) NOT IN (SELECT seed, id FROM n1))),
    nodes AS (SELECT seed, id, hop, count(*) OVER (PARTITION BY seed) found, row_number() OVER (PARTITION BY seed ORDER BY hop, id) AS rank FROM n2 QUALIFY rank <= 100)"""

SQL = {
    "edge_distinct": f"WITH {_PAIRS} SELECT * FROM pairs",
    "edge_strongest": f"WITH {_BEST} SELECT source, target, edge_id, relationship_type, rel_rank FROM best",
    "degrees": f"WITH {_PAIRS}, {_DEG} SELECT * FROM deg",
    "graph_summary": f"WITH {_PAIRS}, {_DEG} SELECT count(*) nodes, sum(out_degree)::BIGINT edges, sum(CASE WHEN in_degree > 0 THEN 1 ELSE 0 END)::BIGINT cited, max(in_degree) max_in_degree FROM deg",
    "pagerank_10iter": f"""WITH RECURSIVE {_PAIRS}, p AS (SELECT * FROM pairs WHERE source IN (SELECT id FROM judgments) AND target IN (SELECT id FROM judgments)), o AS (SELECT source, count(*) n FROM p GROUP BY source), l AS (SELECT p.source, target, n FROM p JOIN o USING (source)),
        nodes AS (SELECT j.id, o.n out_n, (SELECT count(*) FROM judgments) total FROM judgments j LEFT JOIN o ON o.source = j.id),
        r AS (SELECT 0 i, id, out_n, total, 1.0::DOUBLE / total pr FROM nodes UNION ALL
          SELECT i + 1, id, out_n, total, 0.85 * coalesce(got, 0) + (0.85 * loose + 0.15) / total FROM
            (SELECT r.i, r.id, r.out_n, r.total, sum(CASE WHEN r.out_n IS NULL THEN r.pr ELSE 0 END) OVER () loose, g.got FROM r LEFT JOIN (SELECT l.target, sum(r2.pr / l.n) got FROM r r2 JOIN l ON l.source = r2.id GROUP BY l.target) g ON g.target = r.id) WHERE i < 10)
        SELECT id, round(pr, 9) pagerank FROM r WHERE i = 10""",
    "landmark_cases": f"WITH {_PAIRS}, {_DEG} SELECT id, in_degree FROM deg ORDER BY in_degree DESC, id LIMIT 20",
    "neighbors_page": _page(),
    "neighbors_second_page": _page("", 5, 10),
    "neighbors_filtered": _page("AND relationship_type = 'followed' AND (contains(lower(label), 'state') OR contains(lower(cited_text), 'state')) AND contains(lower(court), 'bharvana')"),
    "precedent_summary": f"WITH {_SIDES}, t AS (SELECT *, count(*) OVER (PARTITION BY id, direction) total, row_number() OVER (PARTITION BY id, direction ORDER BY rel_rank, other) AS rank FROM sides) SELECT t.id, direction, total, rank, other, relationship_type FROM t JOIN judgments j ON j.id = other WHERE rank <= 3",
    "khop_nodes": f"WITH {_KHOP} SELECT seed, id, hop, found, rank FROM nodes",
    "khop_edges": f"WITH {_KHOP}, best AS (SELECT * FROM valid QUALIFY row_number() OVER (PARTITION BY source, target ORDER BY rel_rank, edge_id) = 1) SELECT a.seed, source, target, relationship_type, edge_id FROM best JOIN nodes a ON a.id = source JOIN nodes b ON b.id = target AND b.seed = a.seed",
    "mind_map_flat": f"""WITH {_SIDES}, pairs AS (SELECT DISTINCT source, target FROM valid), {_DEG},
        r AS (SELECT s.*, coalesce(in_degree, 0) / 1000.0 pr FROM sides s JOIN judgments j ON j.id = other LEFT JOIN deg ON deg.id = other),
        own AS (SELECT id root, direction, other, relationship_type, row_number() OVER (PARTITION BY id, direction ORDER BY pr DESC, rel_rank, other) AS position, count(*) OVER (PARTITION BY id, direction) total FROM r WHERE id % 50 = 0 AND id IN (SELECT id FROM judgments)),
        lvl AS (SELECT * FROM own WHERE position <= 12),
        down AS (SELECT root, l.direction, l.other parent, r.other, r.relationship_type, row_number() OVER (PARTITION BY root, l.direction, l.other ORDER BY pr DESC, rel_rank, r.other) AS position, count(*) OVER (PARTITION BY root, l.direction, l.other) total FROM lvl l JOIN r ON r.id = l.other AND r.direction = l.direction WHERE r.other <> root)
        SELECT root, direction, CAST(NULL AS BIGINT) parent, 'case' kind, other id, relationship_type, position, total FROM lvl
        UNION ALL SELECT DISTINCT root, direction, CAST(NULL AS BIGINT), 'more', CAST(NULL AS BIGINT), CAST(NULL AS VARCHAR), 13, total FROM own WHERE total > 12
        UNION ALL SELECT root, direction, parent, 'case', other, relationship_type, position, total FROM down WHERE position <= 5""",
    "graph_components": f"""WITH RECURSIVE {_PAIRS}, b AS (SELECT source u, target v FROM pairs UNION SELECT target, source FROM pairs), reach AS (SELECT DISTINCT u, u AS v FROM b UNION SELECT reach.u, b.v FROM reach JOIN b ON b.u = reach.v)
        SELECT component, count(*) size FROM (SELECT u, min(v) component FROM reach GROUP BY u) GROUP BY component""",
}
