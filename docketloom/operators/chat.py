"""Conversation operators over a message table (session, pos, role, content, prompt_text, retrieval_query)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docketloom.functions.text import title_from, token_estimate

OVERHEAD = 4
EXPORT_FORMAT, EXPORT_VERSION, EXPORT_LIMIT = "legal-chat", 1, 5_000


def message_cost(tokens: Column | None = None) -> Column:
    """Tokens of a message as the model sees it, with a few for its role."""
    text = F.coalesce(F.when(F.col("prompt_text") != "", F.col("prompt_text")), F.col("content"))
    return (tokens if tokens is not None else token_estimate(text)) + OVERHEAD


def _newest_first() -> Window:
    return Window.partitionBy("session").orderBy(F.desc("pos")).rowsBetween(Window.unboundedPreceding, 0)


def history_window(messages: DataFrame, budget: int, cost: Column | None = None) -> DataFrame:
    """The newest turns that fit the budget together, from the first of them a user said on."""
    c = message_cost() if cost is None else cost
    fit = messages.withColumn("cost", c).withColumn("used", F.sum("cost").over(_newest_first())).where(F.col("used") <= budget)
    first = F.min(F.when(F.col("role") == "user", F.col("pos"))).over(Window.partitionBy("session"))
    return fit.withColumn("_f", first).where(F.col("pos") >= F.col("_f")).drop("_f")


def summary_split(messages: DataFrame, budget: int, share: float = 0.6, cost: Column | None = None) -> DataFrame:
    """Messages with ``keep``: the newest within a share of the budget stay word for word from a user turn on."""
    kept = history_window(messages, int(budget * share), cost).select("session", "pos", F.lit(True).alias("keep"))
    return messages.join(kept, ["session", "pos"], "left").withColumn("keep", F.coalesce("keep", F.lit(False)))


def fits(messages: DataFrame, budget: int, cost: Column | None = None) -> DataFrame:
    """(session, used, fits) for whole conversations."""
    return messages.groupBy("session").agg(F.sum(message_cost() if cost is None else cost).alias("used")).withColumn("fits", F.col("used") <= budget)


def summary_batches(messages: DataFrame, most: int, cost: Column | None = None) -> DataFrame:
    """Messages with ``batch``: consecutive groups that stay within ``most`` tokens, a larger message alone.

    The running sum starts anew at every cut, so each conversation is walked in order;
    the walk is an aggregate over its costs, not its texts.
    """
    c = message_cost() if cost is None else cost
    lists = messages.groupBy("session").agg(F.array_sort(F.collect_list(F.struct("pos", c.cast("long").alias("cost")))).alias("m"))
    start = F.struct(F.lit(0).cast("long").alias("used"), F.lit(0).alias("batch"), F.array().cast("array<struct<pos:bigint,batch:int>>").alias("out"))

    def step(acc, x):
        cut = (acc["used"] > 0) & (acc["used"] + x["cost"] > most)
        batch = acc["batch"] + F.when(cut, 1).otherwise(0)
        used = F.when(cut, x["cost"]).otherwise(acc["used"] + x["cost"])
        return F.struct(used.alias("used"), batch.alias("batch"), F.concat(acc["out"], F.array(F.struct(x["pos"].cast("long").alias("pos"), batch.alias("batch")))).alias("out"))

    walked = lists.select("session", F.explode(F.aggregate("m", start, step, lambda acc: acc["out"])).alias("o"))
    return messages.join(walked.select("session", F.col("o.pos").alias("pos"), F.col("o.batch").alias("batch")), ["session", "pos"])


def previous_query(messages: DataFrame) -> DataFrame:
    """Messages with the search text of the user's latest turn before them."""
    said = F.when(F.col("role") == "user", F.coalesce(F.when(F.col("retrieval_query") != "", F.col("retrieval_query")), F.col("content")))
    before = Window.partitionBy("session").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    return messages.withColumn("previous_query", F.last(said, ignorenulls=True).over(before))


def tail(messages: DataFrame, most: int) -> DataFrame:
    """The last ``most`` messages of every conversation."""
    w = Window.partitionBy("session").orderBy(F.desc("pos"))
    return messages.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= most).drop("_r")


def session_list(sessions: DataFrame, messages: DataFrame, limit: int = 50, offset: int = 0) -> DataFrame:
    """A page of non-empty conversations, latest first, with message counts and the number of all."""
    n = messages.groupBy("session").agg(F.count("*").alias("messages"))
    rows = sessions.join(n, "session").withColumn("total", F.count("*").over(Window.partitionBy()))
    return rows.orderBy(F.desc("last_active"), "session").offset(offset).limit(limit)


def session_titles(messages: DataFrame) -> DataFrame:
    """(session, title) from what the user said first."""
    said = messages.where("role = 'user'")
    return said.groupBy("session").agg(F.min_by(title_from("content"), "pos").alias("title"))


def carried_documents(messages: DataFrame, retrieved: DataFrame, answers: int = 3, most: int = 6) -> DataFrame:
    """Documents that the latest answers cited and this turn didn't retrieve: (session, position, doc_type, chunk_id).

    ``messages`` has ``cited array<struct<doc_type,chunk_id>>``; ``retrieved`` is (session, doc_type, chunk_id).
    """
    said = messages.where("role = 'assistant'")
    recent = said.withColumn("age", F.row_number().over(Window.partitionBy("session").orderBy(F.desc("pos")))).where(F.col("age") <= answers)
    docs = recent.select("session", "age", F.posexplode("cited").alias("at", "d")).select("session", "age", "at", "d.doc_type", "d.chunk_id")
    docs = docs.join(retrieved, ["session", "doc_type", "chunk_id"], "left_anti")
    first = docs.withColumn("_r", F.row_number().over(Window.partitionBy("session", "doc_type", "chunk_id").orderBy("age", "at"))).where("_r = 1")
    ranked = first.withColumn("position", F.row_number().over(Window.partitionBy("session").orderBy("age", "at")))
    return ranked.where(F.col("position") <= most).select("session", "position", "doc_type", "chunk_id")


def cited_marks(answers: DataFrame, retrieved: DataFrame) -> DataFrame:
    """(answer_id, position, id): retrieved entries an answer cites as [n], in the order of first mention."""
    marks = answers.select("answer_id", F.posexplode(F.regexp_extract_all("answer", F.lit(r"\[(\d+)\]"), F.lit(1))).alias("at", "mark"))
    first = marks.groupBy("answer_id", F.expr("try_cast(mark as int)").alias("rank")).agg(F.min("at").alias("at"))
    return first.join(retrieved, ["answer_id", "rank"]).withColumn("position", F.row_number().over(Window.partitionBy("answer_id").orderBy("at"))).select("answer_id", "position", "id")


def rewrite_request(messages: DataFrame, turns: int = 3, cut: int = 500) -> DataFrame:
    """(session, conversation): the last turns as text for rewriting a follow-up, answers cut at a word."""
    w = Window.partitionBy("session")
    recent = tail(messages, 2 * turns).withColumn("_f", F.min(F.when(F.col("role") == "user", F.col("pos"))).over(w)).where("pos >= _f")
    flat = F.trim(F.regexp_replace(F.coalesce(F.when(F.col("prompt_text") != "", F.col("prompt_text")), F.col("content")), r"\s+", " "))
    short = F.when(F.length(flat) > cut, F.concat(F.regexp_replace(F.substring(flat, 1, cut), r" [^ ]*$", ""), F.lit(" …"))).otherwise(flat)
    line = F.when(F.col("role") == "user", F.concat(F.lit("User: "), F.trim("content"))).otherwise(F.concat(F.lit("Assistant: "), short))
    lists = recent.groupBy("session").agg(F.array_sort(F.collect_list(F.struct("pos", line.alias("line")))).alias("l"))
    return lists.select("session", F.concat(F.lit("Conversation so far:\n"), F.array_join(F.transform("l", lambda x: x["line"]), "\n")).alias("conversation"))


def export_json(messages: DataFrame) -> DataFrame:
    """(session, document): a conversation as one JSON text."""
    lists = messages.groupBy("session").agg(F.array_sort(F.collect_list(F.struct("pos", "role", "content"))).alias("messages"))
    return lists.select("session", F.to_json(F.struct(F.lit(EXPORT_FORMAT).alias("format"), F.lit(EXPORT_VERSION).alias("version"), F.col("session").alias("session_id"), "messages")).alias("document"))


def export_markdown(messages: DataFrame) -> DataFrame:
    head = F.when(F.col("role") == "user", "**You:** ").otherwise("**Assistant:** ")
    lists = messages.groupBy("session").agg(F.array_sort(F.collect_list(F.struct("pos", F.concat(head, F.col("content")).alias("line")))).alias("l"))
    return lists.select("session", F.array_join(F.transform("l", lambda x: x["line"]), "\n\n").alias("document"))


def import_json(documents: DataFrame, column: str = "document") -> DataFrame:
    """(session, valid, reason, messages): exported conversations, each checked rule by rule."""
    kind = "struct<format:string,version:int,session_id:string,covers:int,messages:array<struct<pos:bigint,role:string,content:string>>>"
    d = documents.select(F.from_json(column, kind).alias("d"))
    size = F.size("d.messages")
    roles = F.forall("d.messages", lambda m: m["role"].isin("user", "assistant") & m["content"].isNotNull())
    reason = (
        F.when(F.col("d").isNull() | ~F.col("d.format").eqNullSafe(EXPORT_FORMAT), "format").when(~F.col("d.version").eqNullSafe(EXPORT_VERSION), "version")
        .when(F.col("d.messages").isNull() | (size > EXPORT_LIMIT), "messages").when(~roles, "role")
        .when(F.coalesce(F.col("d.covers"), F.lit(0)).between(0, size) == F.lit(False), "covers")
    )
    return d.select(F.col("d.session_id").alias("session"), reason.isNull().alias("valid"), reason.alias("reason"), "d.messages")


def details(messages: DataFrame, column: str = "details") -> DataFrame:
    """Citations and confidence out of a JSON text, nulls where it has none."""
    return messages.select("*", F.from_json(F.get_json_object(column, "$.citations"), "array<string>").alias("citations"), F.get_json_object(column, "$.confidence").cast("double").alias("confidence"))
