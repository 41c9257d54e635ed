"""Life of contracts: amendments, payments, cycle times, renewals, incumbents, edges and processes, and the nested 360 view."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marketlens.lens import MONEY, Lens, sql, today
from marketlens.registry import query



def ends(lens: Lens) -> DataFrame:
    """A contract ends when its last line ships; without lines it has no end."""
    return lens.eligible.join(lens.lines.groupBy("act_id").agg(F.max("ship_date").alias("end_date")), "act_id", "left")


ENDS = "ends as (select e.*, x.end_date from eligible e left join (select act_id, max(ship_date) as end_date from lines group by 1) x using (act_id))"


@query("incumbent_signals", sql("""select buyer_id, cpv_prefix, supplier_id as incumbent_supplier_id, act_id as most_recent_active_contract, end_date, cast(0.91 as double) as confidence from (
  select e.buyer_id, p.cpv_prefix, s.supplier_id, e.act_id, e.end_date, row_number() over (partition by e.buyer_id, p.cpv_prefix order by e.event_date desc, e.act_id desc, s.amount desc, s.supplier_id) as rn
  from ends e join prime p using (act_id) join suppliers s using (act_id) where e.status <> 'P' and (e.end_date is null or e.end_date >= date '2001-08-01')) where rn = 1""", ENDS))  # fmt: skip
def incumbent_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The supplier of the latest contract of a buyer and market that is still running and not cancelled."""
    lens = Lens(spark, sf_dir)
    running = ends(lens).where((F.col("status") != "P") & (F.col("end_date").isNull() | (F.col("end_date") >= today())))
    rows = running.join(lens.primary.select("act_id", "cpv_prefix"), "act_id").join(lens.suppliers, "act_id")
    w = Window.partitionBy("buyer_id", "cpv_prefix").orderBy(F.desc("event_date"), F.desc("act_id"), F.desc("amount"), "supplier_id")
    return rows.withColumn("rn", F.row_number().over(w)).where("rn = 1").select("buyer_id", "cpv_prefix", F.col("supplier_id").alias("incumbent_supplier_id"), F.col("act_id").alias("most_recent_active_contract"), "end_date", F.lit(0.91).alias("confidence"))


def modifications(lens: Lens) -> DataFrame:
    """Returned lines read as amendments that add their value to the contract's."""
    amend = lens.lines.where("return_flag = 'R'").groupBy("act_id").agg(F.count("*").alias("amendment_count"), F.sum("value").cast("decimal(30,4)").alias("added"))
    out = lens.eligible.select("act_id", "amount_net").join(amend, "act_id", "left")
    added = F.coalesce("added", F.lit(0).cast("decimal(30,4)"))
    return out.select("act_id", F.col("amount_net").alias("original_value"), (F.col("amount_net") + added).cast("decimal(30,4)").alias("current_value"), F.coalesce("amendment_count", F.lit(0)).alias("amendment_count"), F.round(added.cast("double") / F.nullif(F.col("amount_net").cast("double"), F.lit(0.0)), 6).alias("value_uplift_ratio"))


MODS = """mods as (
  select e.act_id, amount_net as original_value, cast(amount_net + coalesce(added, 0) as decimal(30,4)) as current_value, coalesce(n, 0) as amendment_count,
    round(cast(coalesce(added, 0) as double) / nullif(cast(amount_net as double), 0), 6) as value_uplift_ratio
  from eligible e left join (select act_id, count(*) as n, cast(sum(value) as decimal(30,4)) as added from lines where return_flag = 'R' group by 1) a using (act_id))"""


@query("contract_modification_stats", sql("select * from mods", MODS))
def contract_modification_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return modifications(Lens(spark, sf_dir))


@query("dashboard_modifications", sql("select count(*) as contracts, count(*) filter (amendment_count > 0) as modified, round(avg(value_uplift_ratio) filter (amendment_count > 0), 6) as avg_uplift, max(amendment_count) as most from mods", MODS))
def dashboard_modifications(spark: SparkSession, sf_dir: str) -> DataFrame:
    some = F.col("amendment_count") > 0
    return modifications(Lens(spark, sf_dir)).agg(F.count("*").alias("contracts"), F.count(F.when(some, 1)).alias("modified"), F.round(F.avg(F.when(some, F.col("value_uplift_ratio"))), 6).alias("avg_uplift"), F.max("amendment_count").alias("most"))


def payments(lens: Lens) -> DataFrame:
    """Finished lines read as payments: (act_id, line_no, supplier_id, paid_on, value)."""
    return lens.lines.where("line_status = 'F'").select("act_id", "line_no", "supplier_id", F.col("ship_date").alias("paid_on"), "value")


def cycle_times(lens: Lens) -> DataFrame:
    """Days from contract to first payment and to the last, and between them; payments before the contract count as they are."""
    p = payments(lens).groupBy("act_id").agg(F.min("paid_on").alias("first"), F.max("paid_on").alias("last"))
    return lens.eligible.select("act_id", "process_id", "buyer_id", "event_date").join(p, "act_id").select("act_id", "process_id", "buyer_id", F.datediff("first", "event_date").alias("contract_to_first_payment_days"), F.datediff("last", "first").alias("first_to_last_payment_days"))


CYCLE = "cycle as (select act_id, process_id, buyer_id, date_diff('day', event_date, first) as contract_to_first_payment_days, date_diff('day', first, last) as first_to_last_payment_days from eligible join (select act_id, min(ship_date) as first, max(ship_date) as last from lines where line_status = 'F' group by 1) using (act_id))"


@query("cycle_time", sql("select * from cycle", CYCLE))
def cycle_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cycle_times(Lens(spark, sf_dir))


@query("payment_execution", sql("""select act_id, amount_net as current_contract_value, cast(coalesce(paid, 0) as decimal(30,4)) as linked_payment_amount, round(cast(coalesce(paid, 0) as double) / nullif(cast(amount_net as double), 0), 6) as payment_execution_ratio,
  case when coalesce(n, 0) = 0 then 'UNKNOWN' when cast(paid as double) / nullif(cast(amount_net as double), 0) >= 0.9 then 'HIGH' when cast(paid as double) / nullif(cast(amount_net as double), 0) >= 0.3 then 'PARTIAL' else 'SPECIALIZED_SOURCE_ONLY' end as coverage_badge
  from eligible left join (select act_id, count(*) as n, sum(value) as paid from lines where line_status = 'F' group by 1) using (act_id)"""))  # fmt: skip
def payment_execution(spark: SparkSession, sf_dir: str) -> DataFrame:
    lens = Lens(spark, sf_dir)
    p = payments(lens).groupBy("act_id").agg(F.count("*").alias("n"), F.sum("value").cast("decimal(30,4)").alias("paid"))
    paid = F.coalesce("paid", F.lit(0).cast("decimal(30,4)"))
    ratio = paid.cast("double") / F.nullif(F.col("amount_net").cast("double"), F.lit(0.0))
    badge = F.when(F.coalesce("n", F.lit(0)) == 0, "UNKNOWN").when(ratio >= 0.9, "HIGH").when(ratio >= 0.3, "PARTIAL").otherwise("SPECIALIZED_SOURCE_ONLY")
    return lens.eligible.select("act_id", "amount_net").join(p, "act_id", "left").select("act_id", F.col("amount_net").alias("current_contract_value"), paid.alias("linked_payment_amount"), F.round(ratio, 6).alias("payment_execution_ratio"), badge.alias("coverage_badge"))


RENEWALS = """renewals as (
  select act_id, process_id, buyer_id, end_date, date_diff('day', date '2001-08-01', end_date) as days_to_end, round(lead, 4) as avg_lead_time_days,
    date_diff('day', date '2001-08-01', end_date) between 0 and coalesce(lead, 90) as renewal_watch_active
  from ends left join (select buyer_id, avg(contract_to_first_payment_days) as lead from cycle group by 1) using (buyer_id) where end_date is not null)"""


def renewals(lens: Lens) -> DataFrame:
    """Contracts that end within their buyer's usual lead time (90 days where none is known)."""
    lead = cycle_times(lens).groupBy("buyer_id").agg(F.avg("contract_to_first_payment_days").alias("lead"))
    left = F.datediff("end_date", today())
    return ends(lens).where("end_date is not null").join(lead, "buyer_id", "left").select("act_id", "process_id", "buyer_id", "end_date", left.alias("days_to_end"), F.round("lead", 4).alias("avg_lead_time_days"), left.between(F.lit(0), F.coalesce("lead", F.lit(90.0))).alias("renewal_watch_active"))


@query("renewal_signals", sql("select * from renewals", ENDS, CYCLE, RENEWALS))
def renewal_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return renewals(Lens(spark, sf_dir))


@query("renewal_watch", sql("select r.*, c_name as buyer_name from renewals r join customer on buyer_id = c_custkey where renewal_watch_active order by days_to_end, act_id limit 50", ENDS, CYCLE, RENEWALS))
def renewal_watch(spark: SparkSession, sf_dir: str, limit: int = 50) -> DataFrame:
    lens = Lens(spark, sf_dir)
    top = renewals(lens).where("renewal_watch_active").orderBy("days_to_end", "act_id").limit(limit)
    return top.join(lens.table("customer", F.col("c_custkey").alias("buyer_id"), F.col("c_name").alias("buyer_name")), "buyer_id")


EDGES = """edges as (
  select act_id as from_id, 'A' || act_id || '-' || line_no as to_id, 'AMENDS' as link_type, cast(1.0 as double) as confidence from lines where return_flag = 'R'
  union all select act_id, 'P' || act_id || '-' || line_no, 'PAYS', 1.0 from lines where line_status = 'F'
  union all select act_id, 'L' || act_id || '-' || line_no, 'RELATED_TO', 0.5 from lines where return_flag <> 'R' and line_status <> 'F')"""


def edges(lens: Lens) -> DataFrame:
    """Typed edges from a contract to what its lines are read as: one pass over the lines, an array of edges each."""
    to = lambda p: F.concat(F.lit(p), F.col("act_id").cast("string"), F.lit("-"), F.col("line_no").cast("string"))
    edge = lambda p, kind, c: F.struct(to(p).alias("to_id"), F.lit(kind).alias("link_type"), F.lit(c).alias("confidence"))
    r, f = F.col("return_flag") == "R", F.col("line_status") == "F"
    all_ = F.array(F.when(r, edge("A", "AMENDS", 1.0)), F.when(f, edge("P", "PAYS", 1.0)), F.when(~r & ~f, edge("L", "RELATED_TO", 0.5)))
    return lens.lines.select(F.col("act_id").alias("from_id"), F.explode(F.array_compact(all_)).alias("e")).select("from_id", "e.*")


@query("edge_generation", sql("select * from edges", EDGES))
def edge_generation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edges(Lens(spark, sf_dir))


@query("edge_counts", sql("select link_type, count(*) as edges, count(distinct from_id) as contracts from edges where confidence >= 0.95 group by 1", EDGES))
def edge_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edges(Lens(spark, sf_dir)).where("confidence >= 0.95").groupBy("link_type").agg(F.count("*").alias("edges"), F.countDistinct("from_id").alias("contracts"))


def process_360(lens: Lens) -> DataFrame:
    """One row per process with nested arrays. Each part is aggregated before it is joined; missing parts are empty arrays."""
    parts = [
        ("suppliers", lens.suppliers.groupBy("act_id").agg(F.array_sort(F.collect_list(F.struct("supplier_id", "amount"))).alias("suppliers"))),
        ("codes", lens.codes.groupBy("act_id").agg(F.array_sort(F.collect_set("cpv_code")).alias("codes"))),
        ("locations", lens.locations.groupBy("act_id").agg(F.array_sort(F.collect_set("nuts_code")).alias("locations"))),
        ("payments", payments(lens).groupBy("act_id").agg(F.array_sort(F.collect_list(F.struct("paid_on", "line_no", "supplier_id", "value"))).alias("payments"))),
    ]
    out = lens.acts.join(lens.primary.select("act_id", "title"), "act_id", "left").join(lens.issues.withColumn("has_issue", F.lit(True)), "act_id", "left")
    for _, df in parts:
        out = out.join(df, "act_id", "left")
    full = {name: F.coalesce(F.col(name), F.array().cast(df.schema[name].dataType)) for name, df in parts}
    return out.withColumns(full | {"has_issue": F.coalesce("has_issue", F.lit(False))})


@query("process_360_nested")
def process_360_nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    return process_360(Lens(spark, sf_dir))


@query("process_360_counts", sql("""select a.process_id, coalesce(s.n, 0) as suppliers, coalesce(c.n, 0) as codes, coalesce(p.n, 0) as payments, coalesce(cast(s.v as decimal(30,4)), 0) as supplier_value, i.act_id is not null as has_issue, coalesce(c.all_codes, '') as all_codes
  from acts a left join (select act_id, count(*) as n, sum(amount) as v from suppliers group by 1) s using (act_id) left join (select act_id, count(distinct cpv_code) as n, string_agg(distinct cpv_code, ',' order by cpv_code) as all_codes from codes group by 1) c using (act_id)
  left join (select act_id, count(*) as n from lines where line_status = 'F' group by 1) p using (act_id) left join issues i using (act_id)"""))  # fmt: skip
def process_360_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = process_360(Lens(spark, sf_dir))
    total = F.aggregate("suppliers", F.lit(0).cast("decimal(30,4)"), lambda a, x: (a + x["amount"]).cast("decimal(30,4)"))
    n = lambda c: F.size(c).cast("long").alias(c)
    return p.select("process_id", n("suppliers"), n("codes"), n("payments"), total.alias("supplier_value"), "has_issue", F.array_join("codes", ",").alias("all_codes"))


@query("process_summary", sql("""select process_id, title, case when status = 'F' then 'CONTRACTED' when status = 'O' then 'AWARDED' else 'TENDERING' end as stage, cast(amount_net as decimal(20,2)) as value from acts left join prime using (act_id)"""))
def process_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    lens = Lens(spark, sf_dir)
    stage = F.when(F.col("status") == "F", "CONTRACTED").when(F.col("status") == "O", "AWARDED").otherwise("TENDERING")
    return lens.acts.join(lens.primary.select("act_id", "title"), "act_id", "left").select("process_id", "title", stage.alias("stage"), F.col("amount_net").cast(MONEY).alias("value"))


@query("frameworks", sql("""select supplier_id, cpv_prefix, count(*) as call_offs, cast(sum(amount) as decimal(30,4)) as spend, max(end_date) as ends_on,
  case when max(end_date) < date '2001-08-01' then 'EXPIRED' when date_diff('day', date '2001-08-01', max(end_date)) <= 30 then 'REOPENING' when max(end_date) is null then 'UNKNOWN' else 'ACTIVE' end as status,
  round(100 * (0.65 * 1.0 + 0.2 * case when max(end_date) < date '2001-08-01' then 0 when date_diff('day', date '2001-08-01', max(end_date)) <= 30 then 1 else 0.7 end + 0.15 * least(1.0, cast(sum(amount) as double) / 5000000)), 2) as relevance
  from ends join suppliers using (act_id) join prime using (act_id) group by all""", ENDS))  # fmt: skip
def frameworks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A supplier's contracts in a market read as a framework with its call-offs: use, status and relevance."""
    lens = Lens(spark, sf_dir)
    g = ends(lens).join(lens.suppliers, "act_id").join(lens.primary.select("act_id", "cpv_prefix"), "act_id").groupBy("supplier_id", "cpv_prefix").agg(F.count("*").alias("call_offs"), F.sum("amount").cast("decimal(30,4)").alias("spend"), F.max("end_date").alias("ends_on"))
    left = F.datediff("ends_on", today())
    status = F.when(left < 0, "EXPIRED").when(left <= 30, "REOPENING").when(left.isNull(), "UNKNOWN").otherwise("ACTIVE")
    cycle = F.when(left < 0, 0.0).when(left <= 30, 1.0).otherwise(0.7)
    score = 100 * (0.65 * 1.0 + 0.2 * cycle + 0.15 * F.least(F.lit(1.0), F.col("spend").cast("double") / 5000000))
    return g.select("supplier_id", "cpv_prefix", "call_offs", "spend", "ends_on", status.alias("status"), F.round(score, 2).alias("relevance"))


@query("pre_tender_signals", sql("""select act_id, 'CONTRACT_ENDING' as kind, cast(0.76 as double) as confidence, greatest(date '2001-08-01', cast(end_date - interval 120 day as date)) as expected_on from ends where end_date >= date '2001-08-01' and date_diff('day', date '2001-08-01', end_date) <= 365
  union all select act_id, 'REQUEST_OPEN', cast(case when date_diff('day', event_date, date '2001-08-01') <= 180 then 0.9 else 0.82 end as double), cast(event_date + interval 90 day as date) from eligible where status = 'O' and date_diff('day', event_date, date '2001-08-01') between 0 and 730 and act_id not in (select act_id from lines where line_status = 'F')""", ENDS))  # fmt: skip
def pre_tender_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contracts that end within a year, and open requests of two years without any progress."""
    lens = Lens(spark, sf_dir)
    left = F.datediff("end_date", today())
    ending = ends(lens).where(left.between(0, 365)).select("act_id", F.lit("CONTRACT_ENDING").alias("kind"), F.lit(0.76).alias("confidence"), F.greatest(today(), F.date_sub("end_date", 120)).alias("expected_on"))
    age = F.datediff(today(), F.col("event_date"))
    open_ = lens.eligible.where((F.col("status") == "O") & age.between(0, 730)).join(payments(lens).select("act_id"), "act_id", "left_anti")
    return ending.unionByName(open_.select("act_id", F.lit("REQUEST_OPEN").alias("kind"), F.when(age <= 180, 0.9).otherwise(0.82).alias("confidence"), F.date_add("event_date", 90).alias("expected_on")))
