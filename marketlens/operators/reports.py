"""Reports on processes for bidders, and links that hold only where one candidate is left."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marketlens.lens import ISSUE_DAYS, MONEY, Lens, sql
from marketlens.registry import query


def first_single(candidates: DataFrame) -> DataFrame:
    """(id, other, tier, confidence): of (id, other, tier, confidence) the candidate of each id's first tier that has
    exactly one. The same candidate found twice in a tier is one; ids whose tiers are all ambiguous have no link."""
    single = candidates.groupBy("id", "tier").agg(F.min("other").alias("lo"), F.max("other").alias("hi"), F.max("confidence").alias("confidence")).where("lo = hi")
    best = single.groupBy("id").agg(F.min(F.struct("tier", F.col("lo").alias("other"), "confidence")).alias("b"))
    return best.select("id", "b.other", "b.tier", "b.confidence")


# Days that a period may be missed by, share of an amount, and what links of each tier are worth.
SLACK_DAYS, AMOUNT_SHARE = 60, 0.15
BY_PERIOD, BY_MENTION, BY_AMOUNT = 0.85, 0.90, 0.60


@query("funding_tiers", sql("""select id, other, tier, confidence from (select id, tier, min(other) as other, confidence, row_number() over (partition by id order by tier) as rn from c group by id, tier, confidence having count(distinct other) = 1) where rn = 1""",
    """p as (select c_custkey as project, c_custkey // 2 as owner, date '1996-01-01' + cast(c_custkey % 1000 as int) as starts, date '1996-01-01' + cast(c_custkey % 1000 + 400 as int) as ends, cast(c_acctbal * 50 as decimal(20,2)) as amount from customer),
    c as (select act_id as id, project as other, 2 as tier, 0.85::double as confidence from acts join p on owner = buyer_id and event_date between starts - 60 and ends + 60
    union all select act_id, project, 3, 0.9::double from (select distinct cast(json_extract_string(props, '$.k') as bigint) as act_id, user_id as project from events where event_type = 'signup') join acts using (act_id) join p using (project)
    union all select act_id, project, 4, 0.6::double from acts join p on owner = buyer_id and amount > 0 and amount_net > 0 and abs(amount_net - amount) <= 0.15 * greatest(amount_net, amount))"""))  # fmt: skip
def funding_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Acts with the funded project of their buyer's period, of a mention, or of the amount (for review), in this order."""
    lens = Lens(spark, sf_dir)
    k = F.col("c_custkey")
    start = F.lit("1996-01-01").cast("date")
    p = lens.table("customer", "c_custkey", "c_acctbal").select(
        k.alias("project"), F.floor(k / 2).alias("owner"), F.date_add(start, (k % 1000).cast("int")).alias("starts"), F.date_add(start, (k % 1000 + 400).cast("int")).alias("ends"),
        (F.col("c_acctbal") * 50).cast(MONEY).alias("amount"),
    )
    # a buyer's projects are met once for both tiers
    met = lens.acts.select("act_id", "buyer_id", "event_date", "amount_net").join(p, F.col("buyer_id") == F.col("owner"))
    during = F.col("event_date").between(F.date_sub("starts", SLACK_DAYS), F.date_add("ends", SLACK_DAYS))
    near = (F.col("amount") > 0) & (F.col("amount_net") > 0) & (F.abs(F.col("amount_net") - F.col("amount")) <= F.lit(AMOUNT_SHARE).cast("decimal(3,2)") * F.greatest("amount_net", "amount"))
    tier = lambda t, c: F.struct(F.lit(t).alias("tier"), F.lit(c).alias("confidence"))
    tiers = F.array_compact(F.array(F.when(during, tier(2, BY_PERIOD)), F.when(near, tier(4, BY_AMOUNT))))
    owned = met.select(F.col("act_id").alias("id"), F.col("project").alias("other"), F.explode(tiers).alias("t")).select("id", "other", "t.tier", "t.confidence")
    said = lens.table("events", "user_id", "event_type", "props").where("event_type = 'signup'")
    said = said.select(F.get_json_object("props", "$.k").cast("long").alias("id"), F.col("user_id").alias("other")).distinct()
    said = said.join(lens.acts.select(F.col("act_id").alias("id")), "id", "left_semi").join(p.select(F.col("project").alias("other")), "other", "left_semi")
    return first_single(owned.unionByName(said.select("id", "other", F.lit(3).alias("tier"), F.lit(BY_MENTION).alias("confidence"))))


# Scores of processes that nothing is known of.
NO_SCORE, NO_CONFIDENCE = 50.0, 35.0


def bid_reports(acts: DataFrame, scores: DataFrame) -> DataFrame:
    """(process_id, act_id, notice, budget, deadline, acts, score, confidence): what a bidder reads first of each process.

    From ``acts`` (process_id, act_id, notice, published, amount, deadline) the representative one: notices before
    others, then the latest, of equals the least id; acts without a day come last. Scores (process_id, score, confidence)
    that are missing get the neutral values.
    """
    order = F.struct(F.coalesce("notice", F.lit(False)).alias("notice"), "published", (-F.col("act_id")).alias("neg"), "amount", "deadline")
    rep = acts.groupBy("process_id").agg(F.max(order).alias("r"), F.count("*").alias("acts"))
    rep = rep.select("process_id", (-F.col("r.neg")).alias("act_id"), "r.notice", F.col("r.amount").alias("budget"), "r.deadline", "acts")
    score, sure = F.coalesce("score", F.lit(NO_SCORE)).alias("score"), F.coalesce("confidence", F.lit(NO_CONFIDENCE)).alias("confidence")
    return rep.join(scores, "process_id", "left").select(*rep.columns, score, sure)


@query("bid_reports", sql("""select r.buyer_id as process_id, c_name as buyer_name, act_id, notice, amount_net as budget, deadline, acts, coalesce(score, 50) as score, coalesce(confidence, 35) as confidence, title, participants,
    coalesce(blockers, 0) as blockers from (select *, status = 'O' as notice, event_date + 30 as deadline, count(*) over (partition by buyer_id) as acts,
      row_number() over (partition by buyer_id order by status = 'O' desc, event_date desc, act_id) as rn from acts) r
  join customer on buyer_id = c_custkey left join prime using (act_id)
  left join (select act_id, string_agg(cast(supplier_id as varchar), ',' order by supplier_id) as participants from suppliers group by 1) using (act_id)
  left join (select act_id, count(*) as blockers from lines join acts using (act_id) where date_diff('day', ship_date, event_date) > 2000 group by 1) using (act_id)
  left join (select user_id as buyer_id, max(value) as score, min(value) as confidence from events where event_type = 'view' group by 1) s using (buyer_id) where rn = 1"""))  # fmt: skip
def bid_reports_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Buyers read as processes of many acts. Participants and blockers are fetched for the representative acts only."""
    lens = Lens(spark, sf_dir)
    acts = lens.acts.select(
        F.col("buyer_id").alias("process_id"), "act_id", (F.col("status") == "O").alias("notice"), F.col("event_date").alias("published"), F.col("amount_net").alias("amount"), F.date_add("event_date", 30).alias("deadline")
    )
    seen = lens.table("events", "user_id", "event_type", "value").where("event_type = 'view'")
    scores = seen.groupBy(F.col("user_id").alias("process_id")).agg(F.max("value").alias("score"), F.min("value").alias("confidence"))
    report = bid_reports(acts, scores)
    days = report.select("act_id", F.date_sub("deadline", 30).alias("day"))
    early = F.datediff("day", "ship_date") > ISSUE_DAYS
    own = lens.lines.select("act_id", "supplier_id", "ship_date").join(days, "act_id")
    parts = own.groupBy("act_id").agg(F.array_join(F.array_sort(F.collect_set("supplier_id")), ",").alias("participants"), F.count_if(early).alias("blockers"))
    buyers = lens.table("customer", F.col("c_custkey").alias("process_id"), F.col("c_name").alias("buyer_name"))
    out = report.join(buyers, "process_id").join(lens.primary.select("act_id", "title"), "act_id", "left").join(parts, "act_id", "left")
    return out.withColumn("blockers", F.coalesce("blockers", F.lit(0)))
