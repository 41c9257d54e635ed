"""Links found by likeness of texts: decisions by organisation and title, notices by buyer, title, amount and day.

Pairs come from keys, never from crossing two tables: organisations meet by a word that both labels have (as a search for
the label would find them), titles within a pair of organisations by a word of theirs. Equal (organisation, title) texts are
one row with a count beforehand, so a title that thousands of acts repeat costs one comparison. Titles of an organisation that have
a word meet as lists of bounded length; their pairs go through a bound by common subsequences, many at once, before the exact
search for matching blocks, and only like ones become rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marketlens.functions import likeness
from marketlens.lens import Lens
from marketlens.registry import query

# Least likeness of organisations and titles, and how sure such links are.
ORGANISATION, TITLE, SEARCH_SURE, TITLE_AMOUNT_SURE = 0.6, 0.5, 0.75, 0.65
TOLERANCE, DAYS = 0.15, 180


def _words(c: Column) -> Column:
    return F.array_distinct(F.filter(F.split(likeness.normal(c), r"[^\p{L}\p{N}]+"), lambda w: w != ""))


def organisations(a: DataFrame, b: DataFrame, least: float = ORGANISATION) -> DataFrame:
    """(left, right): distinct labels of two tables (column ``organisation``) that share a word and are as alike as asked."""
    x = a.select(F.col("organisation").alias("left")).distinct().withColumn("w", F.explode(_words(F.col("left"))))
    y = b.select(F.col("organisation").alias("right")).distinct().withColumn("w", F.explode(_words(F.col("right"))))
    return likeness.like_pairs(x.join(y, "w").select("left", "right").distinct(), [("left", "right", least)]).select("left", "right")


def by_search(acts: DataFrame, decisions: DataFrame) -> DataFrame:
    """(act_id, decision_id, organisation_likeness, title_likeness, confidence): the one decision that an act's organisation
    and title lead to. ``acts``: act_id, organisation, title; ``decisions``: decision_id, organisation, title.

    Both texts must be alike enough, and titles and organisations share a word each. Acts with several such decisions stay
    unlinked; null and empty texts lead nowhere. Likeness is that of the decision's text against the act's.
    """
    d = decisions.groupBy("organisation", "title").agg(F.count(F.lit(1)).alias("n"), F.min("decision_id").alias("decision_id"))
    q = acts.select("organisation", "title").where("organisation is not null and title is not null").distinct()
    pairs = organisations(decisions, acts)
    # titles of an organisation that have a word meet as lists, so that pairs are never rows
    parts = max(int(acts.sparkSession.conf.get("spark.sql.shuffle.partitions")), 4 * acts.sparkSession.sparkContext.defaultParallelism)

    def lists(df: DataFrame, side: str, name: str, *more: str) -> DataFrame:
        said = df.where("title <> '' and organisation is not null").withColumns({"text": likeness.normal(F.col("title")), "words": _words(F.col("title"))})
        each = said.withColumn("word", F.explode("words"))
        n = each.groupBy("organisation", "word").agg(F.ceil(F.count("*") / likeness.CHUNK).alias("lists"))
        each = each.join(n, ["organisation", "word"]).withColumn("part", F.pmod(F.xxhash64("title"), F.col("lists")))
        each = each.select(F.col("organisation").alias(side), "word", F.col("part").alias(f"part_{side}"), F.struct("text", "words", "title", *more).alias("m"))
        return each.groupBy(side, "word", f"part_{side}").agg(F.collect_list("m").alias(name))

    rows = lists(d, "left", "xs", "n", "decision_id").join(pairs, "left").join(lists(q, "right", "ys"), ["right", "word"])
    rows = rows.repartition(parts, "left", "right", "word", "part_left", "part_right").select(F.struct("left", "right").alias("key"), "word", "xs", "ys")
    like = likeness.like_lists(rows, TITLE, enough=2)  # two, and the act stays unlinked
    best = like.groupBy(F.col("key.right").alias("organisation"), F.col("y.title").alias("title")).agg(F.sum("x.n").alias("n"), F.min(F.struct("x.decision_id", "key.left", F.col("like").alias("title_likeness"))).alias("d")).where("n = 1")
    best = best.withColumn("organisation_likeness", likeness.similarity(F.col("d.left"), F.col("organisation")))
    out = acts.join(best, ["organisation", "title"])
    return out.select("act_id", F.col("d.decision_id").alias("decision_id"), "organisation_likeness", F.col("d.title_likeness").alias("title_likeness"), F.lit(SEARCH_SURE).alias("confidence"))


def by_title_amount(notices: DataFrame, acts: DataFrame, days: int = DAYS, tolerance: float = TOLERANCE) -> DataFrame:
    """(notice_id, process_id, confidence): the one process of the same buyer whose act has a like title, a day within
    ``days`` and, where both have one, an amount within ``tolerance`` of the notice's. For review.

    ``notices``: notice_id, buyer_id, title, amount, day; ``acts``: process_id, buyer_id, title, amount, day. Days meet in
    buckets, so a busy buyer's years aren't paired; several like acts of one process are one candidate.
    """
    bucket = lambda c: F.floor(F.unix_date(c) / days)
    n = notices.where("title <> '' and day is not null and buyer_id is not null").select("notice_id", "buyer_id", F.col("title").alias("u"), F.col("amount").alias("wanted"), F.col("day").alias("at"))
    n = n.withColumn("k", F.explode(F.array(*(bucket(F.col("at")) + i for i in (-1, 0, 1)))))
    a = acts.where("title <> '' and day is not null").select("process_id", "buyer_id", "title", "amount", "day").withColumn("k", bucket(F.col("day")))
    off = F.abs(F.datediff("day", "at")) <= days
    near = F.coalesce(F.abs(F.col("amount") - F.col("wanted")) <= F.col("wanted") * F.lit(str(tolerance)).cast("decimal(6,4)"), F.lit(True))
    pairs = n.join(a, ["buyer_id", "k"]).where(off & near).select("notice_id", "process_id", "title", "u").distinct()
    like = likeness.like_pairs(pairs, [("title", "u", TITLE)]).select("notice_id", "process_id").distinct()
    return likeness.single(like, "notice_id").select("notice_id", "process_id", F.lit(TITLE_AMOUNT_SURE).alias("confidence"))


@query("decision_search")
def decision_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Urgent open orders as acts, and a decision on every third of them, which writes its texts in another way. Organisations
    are digests of the buyer's nation and segment (their names are all alike), titles a digest of the order and its part."""
    lens = Lens(spark, sf_dir)
    c = lens.table("customer", "c_custkey", "c_mktsegment", "c_nationkey").join(lens.table("nation", "n_nationkey", "n_name"), F.col("c_nationkey") == F.col("n_nationkey"))
    a = lens.acts.where("status = 'O' and procedure_type = '1-URGENT'").select("act_id", "buyer_id").join(lens.primary, "act_id").join(c, F.col("buyer_id") == F.col("c_custkey"))
    digest = lambda name, n: F.left(F.md5(F.col(name).cast("string").cast("binary")), F.lit(n))
    a = a.select("act_id", F.concat_ws(" ", digest("n_name", 16), digest("c_mktsegment", 8)).alias("organisation"), F.concat_ws(" ", digest("act_id", 24), "title").alias("title"))
    d = a.where("act_id % 3 = 0").select((-F.col("act_id")).alias("decision_id"), F.concat(F.lit("the "), "organisation").alias("organisation"), F.concat("title", F.lit(" decision")).alias("title"))
    return by_search(a, d)


@query("notice_title_links")
def notice_title_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Urgent orders as notices, the buyer's other orders as processes; every third notice gives no amount."""
    lens = Lens(spark, sf_dir)
    a = lens.acts.select("act_id", "buyer_id", "amount_net", "event_date", "procedure_type").join(lens.primary.select("act_id", "title"), "act_id")
    urgent = F.col("procedure_type") == "1-URGENT"
    n = a.where(urgent).select(F.col("act_id").alias("notice_id"), "buyer_id", "title", F.when(F.col("act_id") % 3 != 0, F.col("amount_net")).alias("amount"), F.col("event_date").alias("day"))
    p = a.where(~urgent).select(F.col("act_id").alias("process_id"), "buyer_id", "title", F.col("amount_net").alias("amount"), F.col("event_date").alias("day"))
    return by_title_amount(n, p)
