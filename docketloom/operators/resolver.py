"""From citation texts to judgments: alias table, staged resolution, edge building."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docketloom.functions import citations, names
from docketloom.operators.tables import insert_ignore, unprocessed
from docketloom.workspace import Workspace, spread

MIN_SIDE_COVERAGE = 1 / 3
COMMON_WORD_DF = 200  # rarest words of more names than this are met together with the next rarest
NO_YEAR = -1


def alias_table(judgments: DataFrame) -> DataFrame:
    """(alias_norm, judgment_id, kind): case names, and reporter keys with and without their volume.

    ``judgments``: id, petitioner, respondent, judgment_text, citations (JSON text). Only
    the head of a text is read for its citation header.
    """
    named = judgments.select(names.case_alias("petitioner", "respondent").alias("alias_norm"), F.col("id").alias("judgment_id"), F.lit("case_name").alias("kind")).where("alias_norm is not null")
    head = citations.with_citation_header(judgments.select("id", F.substring("judgment_text", 1, citations.HEADER_CHARS).alias("head")), "head")
    stored = judgments.select("id", F.array_join(F.from_json(F.get_json_object("citations", "$.reporters"), "array<string>"), " ; ").alias("header")).where("header <> ''")
    keys = citations.with_reporter_keys(head.select("id", "header").where("header is not null").unionByName(stored), "header")
    flat = keys.select("id", F.explode("reporters").alias("r"))
    reporter = flat.select(F.explode(F.array("r.key", "r.loose_key")).alias("alias_norm"), F.col("id").alias("judgment_id"), F.lit("reporter").alias("kind"))
    return named.unionByName(reporter).distinct()


def resolve(spark: SparkSession, mentions: DataFrame, aliases: DataFrame, years: DataFrame) -> DataFrame:
    """(mention_id, judgment_id, method, score) for every mention.

    ``mentions`` is (mention_id, cited_text, source_id), ``years`` (id, year). The
    stages are reporter keys, whole case names inside the text, then names by
    their identifying words; a text that cites a reporter is never tried by name.
    Several equally good targets are ambiguous, never guessed. Equal texts are resolved once.
    """
    work = Workspace(spark, "resolve")
    aliases = work.save(aliases, "aliases")
    said = mentions.select("mention_id", "source_id", F.coalesce("cited_text", F.lit("")).alias("text"))
    texts = citations.with_reporter_keys(said.select("text").repartition(spread(spark), "text").distinct(), "text")
    texts = work.save(citations.with_titles(texts, "text"), "texts")

    # reporter keys: exact before loose, per citation; the first citation with one target decides
    cite = texts.select("text", F.posexplode("reporters").alias("pos", "r")).select("text", "pos", "r.key", "r.loose_key")
    keyed = work.save(aliases.where("kind = 'reporter'").groupBy(F.col("alias_norm").alias("key")).agg(F.collect_set("judgment_id").alias("ids")), "keyed")
    hit = _met(_met(cite, keyed, "key", "left"), keyed.select(F.col("key").alias("loose_key"), F.col("ids").alias("loose")), "loose_key", "left")
    hit = work.save(hit.select("text", "pos", F.coalesce("ids", "loose").alias("ids")).where("ids is not null"), "hit")
    sole = F.when(F.size("ids") == 1, F.struct("pos", F.get("ids", F.lit(0)).alias("jid")))
    reporter = _met(texts.where("size(reporters) > 0").select("text"), hit.groupBy("text").agg(F.min(sole).alias("sole"), F.lit(True).alias("hit")), "text", "left")
    own = hit.select("text", "pos", F.explode("ids").alias("source_id")).groupBy("text", "source_id").agg(F.min("pos").alias("own"))

    # whole names: word runs of the text that equal an alias
    by_name = texts.where("size(reporters) = 0").withColumn("norm", names.normal_case_name("text")).withColumn("cited_year", citations.cited_year("text"))
    by_name = work.save(by_name.where("concat(' ', norm, ' ') like '% v %'").select("text", "norm", "cited_year", "titles"), "named")
    dated = years.select(F.col("id").alias("jid"), F.col("year").alias("jyear"))
    known = work.save(_met(aliases.where("kind = 'case_name'").select("alias_norm", F.col("judgment_id").alias("jid")), dated, "jid", "left"), "known")
    size = F.size(F.split("alias_norm", " "))
    lengths = sorted(r["n"] for r in known.select(size.alias("n")).distinct().collect())  # one value per length of a name in words
    words = by_name.select("text", "cited_year", F.split("norm", " ").alias("w"))
    begun = words.select("text", "cited_year", "w", F.explode(F.sequence(F.lit(1), F.size("w"))).alias("at"))
    runs = begun.select("text", "cited_year", "w", "at", F.explode(F.array(*map(F.lit, lengths)) if lengths else F.array().cast("array<int>")).alias("n")).where("at + n - 1 <= size(w)")
    runs = runs.select("text", "cited_year", F.array_join(F.slice("w", F.col("at"), F.col("n")), " ").alias("alias_norm")).distinct()
    inside = _met(runs, known, "alias_norm")
    longest = Window.partitionBy("text").orderBy(F.desc(F.length("alias_norm")))
    inside = inside.withColumn("_r", F.rank().over(longest)).where("_r = 1").withColumn("score", F.lit(100.0))
    of_year = F.when(F.col("jyear") == F.col("cited_year"), F.col("jid"))
    exact = work.save(_pick(inside.select("text", "score", F.col("jid").alias("lo"), F.col("jid").alias("hi"), of_year.alias("year_lo"), of_year.alias("year_hi")), "exact_name"), "exact")

    # identifying words: all given words of a side belong to that side, a third of it at least
    rest = _met(by_name, exact.select("text"), "text", "left_anti")
    pair = rest.select("text", F.coalesce("cited_year", F.lit(NO_YEAR)).alias("y"), F.explode("titles").alias("t"))
    pair = pair.select("text", "y", F.array_sort(names.party_words(F.col("t.petitioner"))).alias("cp"), F.array_sort(names.party_words(F.col("t.respondent"))).alias("cr"))
    pair = work.save(pair.where(F.size(F.array_union("cp", "cr")) >= 2).distinct(), "pairs")
    none = F.array().cast("array<string>")
    sided = known.select("alias_norm").distinct().withColumn("s", names.party_sides("alias_norm"))
    sided = sided.select("alias_norm", F.array_sort(F.coalesce("s.left", none)).alias("left"), F.array_sort(F.coalesce("s.right", none)).alias("right")).where(F.size("left") + F.size("right") >= 2)
    # names of the same words are one; the lowest and the highest judgment of a year tell whether there is only one
    held = work.save(_met(known, sided, "alias_norm").groupBy("left", "right", "jyear").agg(F.min("jid").alias("lo"), F.max("jid").alias("hi")), "held")
    tokens = work.save(held.select("left", "right").distinct().withColumn("word", F.explode(_sided_words("left", "right"))), "tokens")
    met = _candidates(work, pair.select("cp", "cr").distinct(), tokens)
    whole = (F.size(F.array_except("cp", "left")) == 0) & (F.size(F.array_except("cr", "right")) == 0)
    given = ~((F.size("left") > 0) & (F.size("cp") == 0)) & ~((F.size("right") > 0) & (F.size("cr") == 0))
    cover = lambda c, t: F.when(F.size(t) > 0, F.size(c) / F.size(t)).otherwise(1.0)
    enough = (cover("cp", "left") >= MIN_SIDE_COVERAGE) & (cover("cr", "right") >= MIN_SIDE_COVERAGE)
    score = 100.0 * F.size(F.array_union("cp", "cr")) / F.size(F.array_union("left", "right"))
    scored = work.save(met.where(whole & given & enough).withColumn("score", score), "scored")
    ends = [F.min("lo").alias("lo"), F.max("hi").alias("hi")]
    aimed = work.save(_met(scored, held, ["left", "right"]).groupBy("cp", "cr", "score", "jyear").agg(*ends), "aimed")
    near = (F.col("y") == NO_YEAR) | F.col("jyear").isNull() | (F.abs(F.col("jyear") - F.col("y")) <= 1)
    same = (F.col("y") != NO_YEAR) & (F.col("jyear") == F.col("y"))
    within = _met(pair.select("cp", "cr", "y").distinct(), aimed, ["cp", "cr"]).where(near)
    within = within.groupBy("cp", "cr", "y", "score").agg(*ends, F.min(F.when(same, F.col("lo"))).alias("year_lo"), F.max(F.when(same, F.col("hi"))).alias("year_hi"))
    best = within.groupBy("cp", "cr", "y").agg(F.max(F.struct("score", "lo", "hi", "year_lo", "year_hi")).alias("b")).select("cp", "cr", "y", "b.*")
    top = _met(pair, best, ["cp", "cr", "y"]).withColumn("_r", F.rank().over(Window.partitionBy("text").orderBy(F.desc("score")))).where("_r = 1")
    told = work.save(exact.unionByName(_pick(top, "fuzzy")), "told")

    out = _met(_met(said, reporter.withColumn("cites", F.lit(True)).unionByName(told, True), "text", "left"), own, ["text", "source_id"], "left")
    mine = F.col("own").isNotNull() & (F.col("sole").isNull() | (F.col("own") <= F.col("sole.pos")))
    jid = F.when(F.col("cites"), F.when(mine, F.col("source_id")).otherwise(F.col("sole.jid"))).otherwise(F.col("judgment_id"))
    method = F.when(~F.coalesce("cites", F.lit(False)), F.col("method")).when(jid.isNotNull(), "reporter").when(F.col("hit"), "ambiguous")
    score = F.when(~F.coalesce("cites", F.lit(False)), F.col("score")).when(jid.isNotNull(), 100.0)
    out = out.select("mention_id", "source_id", jid.alias("judgment_id"), method.alias("method"), score.alias("score"))
    self_ = F.col("judgment_id").isNotNull() & F.col("judgment_id").eqNullSafe(F.col("source_id"))
    return out.select("mention_id", F.when(~self_, F.col("judgment_id")).alias("judgment_id"), F.when(self_, "self").otherwise(F.coalesce("method", F.lit("unresolved"))).alias("method"), F.coalesce("score", F.lit(0.0)).alias("score"))


def _met(left: DataFrame, right: DataFrame, on: str | list[str], how: str = "inner") -> DataFrame:
    """A sort-merge join: both sides grow with the corpus, and compressed tables look small enough to pass through the driver."""
    return left.join(right.hint("merge"), on, how)


def _sided_words(left: str, right: str) -> Column:
    """The words of both sides, each marked with its side."""
    mark = lambda c, side: F.transform(c, lambda w: F.concat(F.lit(side), w))
    return F.concat(mark(left, "left "), mark(right, "right "))


def _candidates(work: Workspace, asked: DataFrame, tokens: DataFrame) -> DataFrame:
    """(cp, cr, left, right): for every asked pair of sides all names that can hold its words.

    ``asked`` is (cp, cr), ``tokens`` (left, right, word) with marked words. A name that holds
    all words holds the rarest one, so it is met there; where even that is on many names, it
    holds the two rarest, and is met where both are.
    """
    df = tokens.groupBy("word").agg(F.count("*").alias("df"))
    rare = _met(asked.withColumn("word", F.explode(_sided_words("cp", "cr"))), df, "word", "left")
    rare = rare.groupBy("cp", "cr").agg(F.sort_array(F.collect_list(F.struct("df", "word"))).alias("w")).where(~F.exists("w", lambda x: x["df"].isNull()))
    rare = work.save(rare.select("cp", "cr", F.col("w")[0]["df"].alias("df"), F.col("w")[0]["word"].alias("word"), F.col("w")[1]["word"].alias("next")), "rare")
    alone = _met(rare.where(F.col("df") <= COMMON_WORD_DF).select("cp", "cr", "word"), tokens, "word")
    twos = rare.where(F.col("df") > COMMON_WORD_DF).select("cp", "cr", F.least("word", "next").alias("a"), F.greatest("word", "next").alias("b"))
    common = _met(tokens, twos.select(F.explode(F.array("a", "b")).alias("word")).distinct(), "word", "left_semi")
    common = common.groupBy("left", "right").agg(F.sort_array(F.collect_set("word")).alias("w"))
    common = common.select("left", "right", "w", F.posexplode("w").alias("at", "a")).select("left", "right", "a", F.explode(F.slice("w", F.col("at") + 2, F.size("w"))).alias("b"))
    return alone.drop("word").unionByName(_met(twos, common, ["a", "b"]).drop("a", "b"))


def _pick(options: DataFrame, method: str) -> DataFrame:
    """The only target, or the only one of the cited year; else ambiguous.

    ``options`` hold the lowest and highest target, of all and of the cited year.
    """
    lo, hi, year_lo, year_hi = (F.col(c) for c in ("lo", "hi", "year_lo", "year_hi"))
    one = options.groupBy("text").agg(F.min(lo).alias("lo"), F.max(hi).alias("hi"), F.min(year_lo).alias("year_lo"), F.max(year_hi).alias("year_hi"), F.max("score").alias("score"))
    target = F.when(lo == hi, lo).when(year_lo == year_hi, year_lo)
    return one.select("text", target.alias("judgment_id"), F.when(target.isNotNull(), method).otherwise("ambiguous").alias("method"), "score")


def build_edges(spark: SparkSession, judgments: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """New edges of judgments: extract, resolve, classify, and leave out what is there already.

    With ``existing`` only judgments without any edge are read. Citations of the
    judgment itself are skipped; the unique key folds unresolved targets together.
    """
    work = Workspace(spark, "edges")
    todo = judgments if existing is None else unprocessed(judgments, existing, "id", "source_judgment_id")
    said = citations.with_mentions(todo.select("id", "judgment_text"), "judgment_text").select("id", F.posexplode("mentions").alias("pos", "m"))
    said = work.save(said.select(F.concat_ws(":", "id", "pos").alias("mention_id"), F.col("id").alias("source_id"), "pos", "m.cited_text", "m.relationship_type"), "said")
    years = judgments.select("id", F.year("date_of_judgment").alias("year"))
    found = resolve(spark, said.select("mention_id", "cited_text", "source_id"), alias_table(judgments), years)
    rows = said.join(found, "mention_id").where("method <> 'self'")
    new = rows.select(F.col("source_id").alias("source_judgment_id"), F.col("judgment_id").alias("target_judgment_id"), "cited_text", "relationship_type", F.col("method").alias("resolution_method"), (F.col("score") / 100).cast("float").alias("resolution_score"), "pos")
    keys = ["source_judgment_id", "coalesce(target_judgment_id, -1)", "cited_text"]
    base = existing if existing is not None else spark.createDataFrame([], "source_judgment_id long, target_judgment_id long, cited_text string")
    return insert_ignore(base, new, keys, [F.col("pos")]).drop("pos")


def resolution_counts(edges: DataFrame) -> DataFrame:
    """(method, n, share): edges per resolution method; null methods count as unresolved."""
    n = edges.groupBy(F.coalesce("resolution_method", F.lit("unresolved")).alias("method")).agg(F.count("*").alias("n"))
    return n.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy()), 4))
