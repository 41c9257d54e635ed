"""Profiles, timelines, evidence, participation facts, funding, cross-border matches, exports and document comparison."""

from __future__ import annotations

from collections.abc import Iterator
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marketlens.lens import Lens, sql, today
from marketlens.operators import lifecycle, scoring
from marketlens.registry import query


@query("field_evidence", sql("""select act_id, 'amount_net' as field, sha256(cast(amount_net as varchar)) as value_sha256, 'PARSED' as method, cast(1.0 as double) as confidence from acts
  union all select act_id, 'event_date', sha256(cast(event_date as varchar)), 'PARSED', 1.0 from acts
  union all select act_id, 'title', sha256(title), 'DERIVED', 0.9 from prime"""))  # fmt: skip
def field_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lineage of fields: a row per act and field with the hash of its value. Fields are unpivoted in one pass."""
    lens = Lens(spark, sf_dir)
    h = lambda c: F.sha2(F.col(c).cast("string").cast("binary"), 256)
    row = lambda c, method, conf: F.struct(F.lit(c).alias("field"), h(c).alias("value_sha256"), F.lit(method).alias("method"), F.lit(conf).alias("confidence"))
    parsed = lens.acts.select("act_id", F.explode(F.array(row("amount_net", "PARSED", 1.0), row("event_date", "PARSED", 1.0))).alias("e"))
    derived = lens.primary.select("act_id", row("title", "DERIVED", 0.9).alias("e"))
    return parsed.unionByName(derived).select("act_id", "e.*")


@query("participation_facts", sql("""select distinct sha256(concat_ws('|', role, act_id, party)) as evidence_key, act_id, party, role, confidence from (
  select act_id, 'S' || supplier_id as party, 'WINNER' as role, cast(1.0 as double) as confidence from suppliers union all select act_id, 'S' || supplier_id, 'CONSORTIUM_MEMBER', 0.92 from suppliers where act_id in (select act_id from suppliers group by 1 having count(*) > 3))"""))  # fmt: skip
def participation_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Winners, and members of a consortium where a contract has more than three; one fact for each evidence key.

    Keys differ as acts, parties and roles do, so distinct parties of an act give distinct facts. All of it is done where an act's
    lines lie after one shuffle of two numbers a line."""
    s = Lens(spark, sf_dir).lines.select("act_id", "supplier_id").repartition("act_id").distinct()
    s = s.withColumn("n", F.count("*").over(Window.partitionBy("act_id"))).withColumn("party", F.concat(F.lit("S"), F.col("supplier_id").cast("string")))
    member = F.col("act_id").isNotNull() & (F.col("n") > 3)
    roles = F.array_compact(F.array(F.struct(F.lit("WINNER").alias("role"), F.lit(1.0).alias("confidence")), F.when(member, F.struct(F.lit("CONSORTIUM_MEMBER").alias("role"), F.lit(0.92).alias("confidence")))))
    out = s.select("act_id", "party", F.explode(roles).alias("r")).select("act_id", "party", "r.*")
    return out.withColumn("evidence_key", F.sha2(F.concat_ws("|", "role", "act_id", "party").cast("binary"), 256))


@query("process_timeline", sql("""select act_id as process_id, event_date as at, 'CONTRACT' as kind, cast(amount_net as decimal(30,4)) as amount from acts
  union all select act_id, ship_date, 'PAYMENT', cast(sum(value) as decimal(30,4)) from lines where line_status = 'F' group by 1, 2 union all select act_id, ship_date, 'AMENDMENT', cast(sum(value) as decimal(30,4)) from lines where return_flag = 'R' group by 1, 2"""))  # fmt: skip
def process_timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    lens = Lens(spark, sf_dir)
    day = lambda cond, kind: lens.lines.where(cond).groupBy(F.col("act_id").alias("process_id"), F.col("ship_date").alias("at")).agg(F.lit(kind).alias("kind"), F.sum("value").cast("decimal(30,4)").alias("amount"))
    first = lens.acts.select("process_id", F.col("event_date").alias("at"), F.lit("CONTRACT").alias("kind"), F.col("amount_net").cast("decimal(30,4)").alias("amount"))
    return first.unionByName(day("line_status = 'F'", "PAYMENT")).unionByName(day("return_flag = 'R'", "AMENDMENT"))


@query("supplier_profile", sql("""select supplier_id, count(distinct act_id) as contracts, count(distinct buyer_id) as buyers, count(distinct cpv_prefix) as markets, cast(sum(amount) as decimal(30,4)) as value, min(event_date) as first_seen, max(event_date) as last_seen,
  count(distinct case when end_date >= date '2001-08-01' then act_id end) as active from ends join suppliers using (act_id) join prime using (act_id) group by 1""", lifecycle.ENDS))  # fmt: skip
def supplier_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    lens = Lens(spark, sf_dir)
    f = lifecycle.ends(lens).join(lens.suppliers, "act_id").join(lens.primary.select("act_id", "cpv_prefix"), "act_id")
    return f.groupBy("supplier_id").agg(
        F.countDistinct("act_id").alias("contracts"), F.countDistinct("buyer_id").alias("buyers"), F.countDistinct("cpv_prefix").alias("markets"), F.sum("amount").cast("decimal(30,4)").alias("value"),
        F.min("event_date").alias("first_seen"), F.max("event_date").alias("last_seen"), F.countDistinct(F.when(F.col("end_date") >= today(), F.col("act_id"))).alias("active"),
    )


@query("buyer_profile", sql("""select buyer_id, count(*) as contracts, cast(sum(amount_net) as decimal(30,2)) as spend, round(avg(date_diff('day', event_date, end_date)), 4) as avg_duration_days, count(*) filter (status = 'O') as open_contracts, max(amount_net) as largest from ends group by 1""", lifecycle.ENDS))
def buyer_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = lifecycle.ends(Lens(spark, sf_dir))
    return e.groupBy("buyer_id").agg(F.count("*").alias("contracts"), F.sum("amount_net").cast("decimal(30,2)").alias("spend"), F.round(F.avg(F.datediff("end_date", "event_date")), 4).alias("avg_duration_days"), F.count(F.when(F.col("status") == "O", 1)).alias("open_contracts"), F.max("amount_net").alias("largest"))


@query("funding_projects", sql("""select region as project, count(distinct act_id) as linked_acts, count(distinct case when act_id in (select act_id from issues) then act_id end) as pending_reviews, cast(sum(amount_net) as decimal(30,2)) as contracted, cast(sum(paid) as decimal(30,4)) as paid
  from acts join locations using (act_id) left join (select act_id, sum(value) as paid from lines where line_status = 'F' group by 1) using (act_id) group by 1"""))  # fmt: skip
def funding_projects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A region's contracts read as a programme: linked, to be reviewed, contracted and paid."""
    lens = Lens(spark, sf_dir)
    paid = lifecycle.payments(lens).groupBy("act_id").agg(F.sum("value").alias("paid"))
    a = lens.acts.join(lens.locations.select("act_id", "region"), "act_id").join(paid, "act_id", "left").join(lens.issues.withColumn("bad", F.lit(True)), "act_id", "left")
    return a.groupBy(F.col("region").alias("project")).agg(F.countDistinct("act_id").alias("linked_acts"), F.countDistinct(F.when(F.col("bad"), F.col("act_id"))).alias("pending_reviews"), F.sum("amount_net").cast("decimal(30,2)").alias("contracted"), F.sum("paid").cast("decimal(30,4)").alias("paid"))


@query("region_activity", sql("select region, nuts_code, period_year, status, count(*) as acts, cast(sum(amount_net) as decimal(30,2)) as value from eligible join locations using (act_id) group by all"))
def region_activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    lens = Lens(spark, sf_dir)
    return lens.eligible.join(lens.locations, "act_id").groupBy("region", "nuts_code", "period_year", "status").agg(F.count("*").alias("acts"), F.sum("amount_net").cast("decimal(30,2)").alias("value"))


@query("cross_border_matches", sql("""select act_id, least(100.0, 50 * (case when starts_with(cpv_code, 'Brand#1') then 1 else 0 end) + 20 * (case when contains(lower(title), 'red') then 1 else 0 end) + case when end_date is null then 5 when end_date < date '2001-08-01' then 0 when date_diff('day', date '2001-08-01', end_date) <= 7 then 5 else 15 end
    + case when amount_net is null then 4 when amount_net between 50000 and 250000 then 10 else 0 end + 5.0) as score from ends join prime using (act_id) join locations using (act_id) where region <> 'EUROPE' order by score desc, act_id limit 50""", lifecycle.ENDS))  # fmt: skip
def cross_border_matches(spark: SparkSession, sf_dir: str, limit: int = 50) -> DataFrame:
    """Foreign notices for a profile: 50 code, 20 keyword, 15 deadline (5 if unknown or near), 10 value (4 if unknown), 5 parsed."""
    lens = Lens(spark, sf_dir)
    e = lifecycle.ends(lens).join(lens.primary, "act_id").join(lens.locations.where("region <> 'EUROPE'").select("act_id"), "act_id")
    left = F.datediff("end_date", today())
    deadline = F.when(left.isNull(), 5).when(left < 0, 0).when(left <= 7, 5).otherwise(15)
    value = F.when(F.col("amount_net").isNull(), 4).when(F.col("amount_net").between(50000, 250000), 10).otherwise(0)
    score = 50 * F.when(F.col("cpv_code").startswith("Brand#1"), 1).otherwise(0) + 20 * F.when(F.contains(F.lower("title"), F.lit("red")), 1).otherwise(0) + deadline + value + 5.0
    return e.select("act_id", F.least(F.lit(100.0), score).alias("score")).orderBy(F.desc("score"), "act_id").limit(limit)


@query("reference_sources", "select source, max(doc_id) as last_record, case when count(*) filter (length(text) = 0 or text is null) = 0 then 'AVAILABLE' else 'DEGRADED' end as status, count(*) as records from documents group by 1")
def reference_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = Lens(spark, sf_dir).table("documents", "doc_id", "source", "text")
    empty = F.count(F.when(F.col("text").isNull() | (F.char_length("text") == 0), 1))
    return d.groupBy("source").agg(F.max("doc_id").alias("last_record"), F.when(empty == 0, "AVAILABLE").otherwise("DEGRADED").alias("status"), F.count("*").alias("records"))


@query("queue_metrics", "select event_type, count(*) as jobs, count(*) filter (value > 90) as failed, round(avg(value), 4) as avg_cost, max(date_diff('day', cast(ts as date), date '2024-02-01')) as oldest_days from events group by 1")
def queue_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = Lens(spark, sf_dir).table("events", "event_type", "value", "ts")
    return e.groupBy("event_type").agg(F.count("*").alias("jobs"), F.count(F.when(F.col("value") > 90, 1)).alias("failed"), F.round(F.avg("value"), 4).alias("avg_cost"), F.max(F.datediff(F.lit("2024-02-01").cast("date"), F.col("ts").cast("date"))).alias("oldest_days"))


_AMOUNT = r"[0-9]{1,3}(?:[.,][0-9]{3})*(?:[.,][0-9]{1,2})? ?(?:€|EUR|USD|\$)"


@query("amount_values", rf"""select doc_id, raw, cast(regexp_replace(case when regexp_matches(n, '[.,][0-9]{{1,2}}$') then regexp_replace(n, '[.,]([0-9]{{1,2}})$', '') else n end, '[.,]', '', 'g') || case when regexp_matches(n, '[.,][0-9]{{1,2}}$') then '.' || regexp_extract(n, '[.,]([0-9]{{1,2}})$', 1) else '' end as decimal(20,2)) as amount
  from (select doc_id, raw, regexp_replace(raw, '[^0-9.,]', '', 'g') as n from (select doc_id, unnest(regexp_extract_all(text, '{_AMOUNT}')) as raw from documents))""")
def amount_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Amounts of texts as numbers: groups of three digits against one or two decimals, whatever the separators."""
    d = Lens(spark, sf_dir).table("documents", "doc_id", "text")
    n = F.regexp_replace("raw", "[^0-9.,]", "")
    tail = F.regexp_extract(n, "[.,]([0-9]{1,2})$", 1)
    whole = F.regexp_replace(F.when(tail != "", F.regexp_replace(n, "[.,][0-9]{1,2}$", "")).otherwise(n), "[.,]", "")
    amount = F.when(tail != "", F.concat(whole, F.lit("."), tail)).otherwise(whole)
    return d.select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(_AMOUNT), F.lit(0))).alias("raw")).withColumn("amount", amount.try_cast("decimal(20,2)"))


@query("export_pipeline", sql("select s.act_id, title, c_name as buyer, max(score) as score, string_agg(distinct 'S' || supplier_id, '; ' order by 'S' || supplier_id) as suppliers from scored s join ctx using (act_id) join customer on ctx.buyer_id = c_custkey left join suppliers p on p.act_id = s.act_id group by all", scoring._CTX, scoring._RULE_VALUES, scoring._SCORE_PARTS))
def export_pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of the pipeline export: scored acts with title, buyer and suppliers."""
    lens = Lens(spark, sf_dir)
    sup = lens.suppliers.groupBy("act_id").agg(F.array_join(F.array_sort(F.collect_set(F.concat(F.lit("S"), F.col("supplier_id").cast("string")))), "; ").alias("suppliers"))
    names = lens.table("customer", F.col("c_custkey").alias("buyer_id"), F.col("c_name").alias("buyer"))
    s = scoring.opportunity_scores(spark, sf_dir).select("act_id", "score").join(scoring.contexts(lens).select("act_id", "title", "buyer_id"), "act_id")
    return s.join(names, "buyer_id").join(sup, "act_id", "left").select("act_id", "title", "buyer", "score", "suppliers")


def compare_terms(pairs: DataFrame, removed: float = 0.52, changed: float = 0.985) -> DataFrame:
    """(a, b, kind, left, right): sentences of two texts (a, b, text_a, text_b), each matched with the most like one that is
    still free: REMOVED under ``removed``, CHANGED under ``changed``; what is left over on the right is ADDED. The match is
    greedy and depends on order, so a pair is compared in one task; pairs are spread over tasks."""

    def sentences(t: str | None) -> list[str]:
        return [s for s in (x.strip() for x in (t or "").replace("\n", ". ").split(". ")) if s]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for r in pdf.itertuples():
                free = sentences(r.text_b)
                for s in sentences(r.text_a):
                    if s in free:  # equal sentences need no search
                        free.remove(s)
                        continue
                    m = SequenceMatcher(None, s.casefold(), "", False)
                    best, at = 0.0, -1
                    for k, x in enumerate(free):
                        m.set_seq2(x.casefold())
                        if m.real_quick_ratio() > best and m.quick_ratio() > best and (q := m.ratio()) > best:
                            best, at = q, k
                    if best < removed:
                        out.append((r.a, r.b, "REMOVED", s, None))
                    else:
                        x = free.pop(at)
                        if best < changed:
                            out.append((r.a, r.b, "CHANGED", s, x))
                out += [(r.a, r.b, "ADDED", None, x) for x in free]
            yield pd.DataFrame(out, columns=["a", "b", "kind", "left", "right"])

    return pairs.select("a", "b", "text_a", "text_b").mapInPandas(run, "a long, b long, kind string, left string, right string")


@query("document_diff")
def document_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items with the one numbered before them, sentence by sentence."""
    b = Lens(spark, sf_dir).table("benchmark", "item_id", "text")
    before = b.select((F.col("item_id") + 1).alias("b"), F.col("item_id").alias("a"), F.col("text").alias("text_a"))
    return compare_terms(b.select(F.col("item_id").alias("b"), F.col("text").alias("text_b")).join(before, "b"))
