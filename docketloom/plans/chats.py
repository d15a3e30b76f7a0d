"""Conversation queries. The event log stands for messages: a user's events are a session,
views, clicks and sign-ups what the user said, the rest what was answered."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docketloom.functions.text import carried_query
from docketloom.operators import chat
from docketloom.sources.tables import table

BUDGET = 120


def _messages(spark: SparkSession, d: str) -> DataFrame:
    role = F.when(F.col("event_type").isin("view", "click", "signup"), "user").otherwise("assistant")
    content = F.concat_ws(" ", "event_type", "props", F.col("event_id").cast("string"))
    none = F.lit(None).cast("string")
    return table(spark, d, "events").where("user_id is not null").select(F.col("user_id").alias("session"), F.col("event_id").alias("pos"), role.alias("role"), content.alias("content"), none.alias("prompt_text"), none.alias("retrieval_query"), "ts")


def history_window(spark: SparkSession, d: str) -> DataFrame:
    return chat.history_window(_messages(spark, d), BUDGET).select("session", "pos", "role", "used")


def summary_split(spark: SparkSession, d: str) -> DataFrame:
    return chat.summary_split(_messages(spark, d), BUDGET).groupBy("session", "keep").agg(F.count("*").alias("n"), F.min("pos").alias("first"))


def history_fits(spark: SparkSession, d: str) -> DataFrame:
    return chat.fits(_messages(spark, d), 600)


def summary_batches(spark: SparkSession, d: str) -> DataFrame:
    return chat.summary_batches(_messages(spark, d).drop("ts"), 60).select("session", "pos", "batch")


def last_user_query(spark: SparkSession, d: str) -> DataFrame:
    return chat.previous_query(_messages(spark, d)).select("session", "pos", "previous_query")


def follow_up_query(spark: SparkSession, d: str) -> DataFrame:
    rows = chat.previous_query(_messages(spark, d)).where("role = 'user'")
    return rows.select("session", "pos", carried_query("content", "previous_query").alias("query"))


def history_tail(spark: SparkSession, d: str) -> DataFrame:
    return chat.tail(_messages(spark, d), 6).select("session", "pos")


def session_list(spark: SparkSession, d: str) -> DataFrame:
    m = _messages(spark, d)
    sessions = m.groupBy("session").agg(F.max("ts").alias("last_active"))
    return chat.session_list(sessions, m).select("session", "last_active", "messages", "total")


def session_titles(spark: SparkSession, d: str) -> DataFrame:
    return chat.session_titles(_messages(spark, d))


def carried_documents(spark: SparkSession, d: str) -> DataFrame:
    """Answers cite the document their property names; the session's user number is what this turn retrieved."""
    key = F.get_json_object("props", "$.k").cast("long")
    cited = F.array(F.struct(F.lit("judgment").alias("doc_type"), key.alias("chunk_id")))
    rows = table(spark, d, "events").where("user_id is not null and event_type in ('purchase', 'error')").select(F.col("user_id").alias("session"), F.col("event_id").alias("pos"), F.lit("assistant").alias("role"), cited.alias("cited"))
    got = table(spark, d, "events").where("user_id is not null").select(F.col("user_id").alias("session"), F.lit("judgment").alias("doc_type"), (F.col("user_id") % 100).alias("chunk_id")).distinct()
    return chat.carried_documents(rows, got)


def rewrite_requests(spark: SparkSession, d: str) -> DataFrame:
    return chat.rewrite_request(_messages(spark, d))


def export_json(spark: SparkSession, d: str) -> DataFrame:
    return chat.export_json(_messages(spark, d))


def export_round_trip(spark: SparkSession, d: str) -> DataFrame:
    found = chat.import_json(chat.export_json(_messages(spark, d)))
    return found.select(F.col("session").cast("long").alias("session"), "valid", F.size("messages").alias("n"))


QUERIES = {f.__name__: f for f in (history_window, summary_split, history_fits, summary_batches, last_user_query, follow_up_query, history_tail, session_list, session_titles, carried_documents, rewrite_requests, export_json, export_round_trip)}

_M = "m AS (SELECT user_id AS session, event_id pos, CASE WHEN event_type IN ('view', 'click', 'signup') THEN 'user' ELSE 'assistant' END AS role, concat_ws(' ', event_type, props, event_id::VARCHAR) content, ts FROM events WHERE user_id IS NOT NULL), c AS (SELECT *, floor(len(list_filter(string_split(content, ' '), lambda x: x <> '')) * 1.3)::INT + 4 AS cost FROM m)"


def _window(budget: int) -> str:
    return f"{_M}, f AS (SELECT *, sum(cost) OVER (PARTITION BY session ORDER BY pos DESC) used FROM c QUALIFY used <= {budget}), h AS (SELECT * FROM f QUALIFY pos >= min(CASE WHEN role = 'user' THEN pos END) OVER (PARTITION BY session))"


_PREV = f"{_M}, p AS (SELECT *, last_value(CASE WHEN role = 'user' THEN content END IGNORE NULLS) OVER (PARTITION BY session ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) previous_query FROM m)"
SQL = {
    "history_window": f"WITH {_window(BUDGET)} SELECT session, pos, role, used::BIGINT used FROM h",
    "summary_split": f"WITH {_window(int(BUDGET * 0.6))} SELECT c.session, h.pos IS NOT NULL AS keep, count(*) n, min(c.pos) AS first FROM c LEFT JOIN h ON h.session = c.session AND h.pos = c.pos GROUP BY 1, 2",
    "history_fits": f"WITH {_M} SELECT session, sum(cost)::BIGINT used, sum(cost) <= 600 fits FROM c GROUP BY session",
    "last_user_query": f"WITH {_PREV} SELECT session, pos, previous_query FROM p",
    "history_tail": f"WITH {_M} SELECT session, pos FROM m QUALIFY row_number() OVER (PARTITION BY session ORDER BY pos DESC) <= 6",
    "session_list": f"WITH {_M}, s AS (SELECT session, max(ts) last_active, count(*) messages FROM m GROUP BY session) SELECT *, count(*) OVER () total FROM s ORDER BY last_active DESC, session LIMIT 50",
    "session_titles": f"WITH {_M} SELECT session, min_by(content, pos) title FROM m WHERE role = 'user' GROUP BY session",
    "carried_documents": """WITH a AS (SELECT user_id AS session, event_id pos, CAST(json_extract_string(props, '$.k') AS BIGINT) k FROM events WHERE user_id IS NOT NULL AND event_type IN ('purchase', 'error') QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) <= 3),
        b AS (SELECT session, k, max(pos) pos FROM a WHERE k IS NOT NULL AND k <> session % 100 GROUP BY session, k)
        SELECT session, row_number() OVER (PARTITION BY session ORDER BY pos DESC) AS position, 'judgment' doc_type, k chunk_id FROM b""",
    "export_round_trip": f"WITH {_M} SELECT session, true AS valid, count(*) n FROM m GROUP BY session",
    "export_json": f"WITH {_M} SELECT session, to_json(struct_pack(format := '{chat.EXPORT_FORMAT}', version := {chat.EXPORT_VERSION}, session_id := session, messages := list(struct_pack(pos := pos, role := role, content := content) ORDER BY pos)))::VARCHAR AS document FROM m GROUP BY session",
    "rewrite_requests": f"""WITH {_M}, t AS (SELECT * FROM m QUALIFY row_number() OVER (PARTITION BY session ORDER BY pos DESC) <= 6), r AS (SELECT * FROM t QUALIFY pos >= min(CASE WHEN role = 'user' THEN pos END) OVER (PARTITION BY session)),
        l AS (SELECT session, pos, CASE WHEN role = 'user' THEN 'User: ' || trim(content) ELSE 'Assistant: ' || trim(regexp_replace(content, '\\s+', ' ', 'g')) END line FROM r)
        SELECT session, 'Conversation so far:' || chr(10) || string_agg(line, chr(10) ORDER BY pos) conversation FROM l GROUP BY session""",
}
