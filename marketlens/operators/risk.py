"""Screening indicators. Each gives (indicator, subject, value, benchmark, sample_size, confidence); none accuses anyone."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marketlens.functions.text import set_similarity, trigrams
from marketlens.lens import Lens, sql, today
from marketlens.operators import lifecycle, market
from marketlens.registry import query
from marketlens.session import cut

#: Procurement thresholds in EUR.
THRESHOLDS = (30000, 60000, 140000, 221000, 443000, 5382000)


def confidence(n: Column, high: int = 20, medium: int = 5) -> Column:
    return F.when(n >= high, "HIGH").when(n >= medium, "MEDIUM").otherwise("LOW")


def _row(df: DataFrame, indicator: str, subject: list[str], value: Column, benchmark: float, sample: Column, high: int = 20, medium: int = 5) -> DataFrame:
    name = F.concat_ws("/", *(F.col(c).cast("string") for c in subject))
    return df.select(F.lit(indicator).alias("indicator"), name.alias("subject"), F.round(value.cast("double"), 6).alias("value"), F.lit(float(benchmark)).alias("benchmark"), sample.cast("long").alias("sample_size"), confidence(sample, high, medium).alias("confidence"))


_CONF = "case when {n} >= {h} then 'HIGH' when {n} >= {m} then 'MEDIUM' else 'LOW' end"


def _sql(indicator: str, subject: str, value: str, benchmark: float, n: str, source: str, *ctes: str, h: int = 20, m: int = 5) -> str:
    return sql(f"select '{indicator}' as indicator, {subject} as subject, round(cast({value} as double), 6) as value, cast({benchmark} as double) as benchmark, cast({n} as bigint) as sample_size, {_CONF.format(n=n, h=h, m=m)} as confidence {source}", *ctes)


def high_buyer_concentration(lens: Lens, benchmark: float = 0.7, least: int = 5) -> DataFrame:
    """Buyers whose largest supplier has a share of ``benchmark`` or more, over ``least`` contracts."""
    pairs = market.buyer_supplier_values(lens)
    g = pairs.groupBy("buyer_id").agg(F.max("value").alias("top"), F.sum("value").alias("total"))
    n = lens.acts.groupBy("buyer_id").agg(F.countDistinct("act_id").alias("n"))
    share = F.col("top").cast("double") / F.nullif(F.col("total").cast("double"), F.lit(0.0))
    out = g.join(n, "buyer_id").withColumn("share", share).where((F.col("share") >= benchmark) & (F.col("n") >= least))
    return _row(out, "HIGH_BUYER_CONCENTRATION", ["buyer_id"], F.col("share"), benchmark, F.col("n"))


_R01 = _sql("HIGH_BUYER_CONCENTRATION", "cast(buyer_id as varchar)", "share", 0.12, "n", "from (select buyer_id, cast(max(value) as double) / nullif(cast(sum(value) as double), 0) as share from pairs group by 1) join (select buyer_id, count(distinct act_id) as n from acts group by 1) using (buyer_id) where share >= 0.12 and n >= 5", market.PAIRS)


def repeat_same_contractor(lens: Lens, benchmark: float = 0.8, least: int = 5) -> DataFrame:
    """Buyer and market where one supplier takes part in a share of ``benchmark`` of the contracts."""
    rows = lens.acts.select("act_id", "buyer_id").join(lens.primary.select("act_id", "cpv_prefix"), "act_id")
    n = rows.groupBy("buyer_id", "cpv_prefix").agg(F.countDistinct("act_id").alias("n"))
    by = rows.join(lens.suppliers, "act_id").groupBy("buyer_id", "cpv_prefix", "supplier_id").agg(F.countDistinct("act_id").alias("k"))
    top = by.groupBy("buyer_id", "cpv_prefix").agg(F.max(F.struct("k", (-F.col("supplier_id")).alias("s"))).alias("t"))
    out = n.join(top, ["buyer_id", "cpv_prefix"]).withColumn("supplier_id", -F.col("t.s")).withColumn("share", F.col("t.k") / F.col("n")).where((F.col("share") >= benchmark) & (F.col("n") >= least))
    return _row(out, "REPEAT_SAME_CONTRACTOR", ["buyer_id", "cpv_prefix", "supplier_id"], F.col("share"), benchmark, F.col("n"))


_R02 = _sql("REPEAT_SAME_CONTRACTOR", "concat_ws('/', buyer_id, cpv_prefix, supplier_id)", "k / n", 0.5, "n", """from (select buyer_id, cpv_prefix, supplier_id, k, row_number() over (partition by buyer_id, cpv_prefix order by k desc, supplier_id) as rn from (
    select buyer_id, cpv_prefix, supplier_id, count(distinct act_id) as k from acts join prime using (act_id) join suppliers using (act_id) group by all))
  join (select buyer_id, cpv_prefix, count(distinct act_id) as n from acts join prime using (act_id) group by all) using (buyer_id, cpv_prefix) where rn = 1 and k / n >= 0.5 and n >= 3""")  # fmt: skip


def few_distinct_suppliers(lens: Lens, most: int = 2, least: int = 5) -> DataFrame:
    out = market.market_values(lens).where((F.col("supplier_count") <= most) & (F.col("contract_count") >= least))
    return _row(out, "FEW_DISTINCT_SUPPLIERS", [*market.KEYS, "procedure_type"], F.col("supplier_count"), most, F.col("contract_count"))


_R03 = _sql("FEW_DISTINCT_SUPPLIERS", "concat_ws('/', cpv_prefix, nuts_code, period_year, procedure_type)", "supplier_count", 12, "contract_count", "from mvalues where supplier_count <= 12 and contract_count >= 5", market.DIMS, market.VALUES)


def repeated_modifications(lens: Lens, benchmark: int = 3) -> DataFrame:
    return _row(lifecycle.modifications(lens).where(F.col("amendment_count") >= benchmark), "REPEATED_MODIFICATIONS", ["act_id"], F.col("amendment_count"), benchmark, F.col("amendment_count"))


_R04 = _sql("REPEATED_MODIFICATIONS", "cast(act_id as varchar)", "amendment_count", 3, "amendment_count", "from mods where amendment_count >= 3", lifecycle.MODS)


def large_value_increase(lens: Lens, benchmark: float = 0.5) -> DataFrame:
    return _row(lifecycle.modifications(lens).where(F.col("value_uplift_ratio") >= benchmark), "LARGE_VALUE_INCREASE", ["act_id"], F.col("value_uplift_ratio"), benchmark, F.col("amendment_count"))


_R05 = _sql("LARGE_VALUE_INCREASE", "cast(act_id as varchar)", "value_uplift_ratio", 0.5, "amendment_count", "from mods where value_uplift_ratio >= 0.5", lifecycle.MODS)


def unusual_delay(lens: Lens, factor: float = 3, least: int = 20) -> DataFrame:
    """Delays of ``factor`` times the median of all positive ones, or more; none if there are fewer than ``least``."""
    c = lifecycle.cycle_times(lens).where("contract_to_first_payment_days > 0")
    one = c.agg(F.percentile("contract_to_first_payment_days", 0.5).alias("median"), F.count("*").alias("n"))
    out = c.crossJoin(F.broadcast(one)).where((F.col("n") >= least) & (F.col("contract_to_first_payment_days") >= factor * F.col("median")))
    return _row(out, "UNUSUAL_DELAY", ["act_id"], F.col("contract_to_first_payment_days") / F.col("median"), factor, F.col("n"))


_R06 = _sql("UNUSUAL_DELAY", "cast(act_id as varchar)", "contract_to_first_payment_days / median", 3, "n", "from (select act_id, contract_to_first_payment_days from cycle where contract_to_first_payment_days > 0), (select median(contract_to_first_payment_days) as median, count(*) as n from cycle where contract_to_first_payment_days > 0) where n >= 20 and contract_to_first_payment_days >= 3 * median", lifecycle.CYCLE)


def inactive_supplier(lens: Lens) -> DataFrame:
    """Running contracts whose supplier's balance is below zero (read as an inactive registry status)."""
    bad = lens.table("supplier", "s_suppkey", "s_acctbal").where("s_acctbal < 0")
    run = lifecycle.ends(lens).where(F.col("end_date") >= today()).join(lens.suppliers, "act_id").join(bad, F.col("supplier_id") == F.col("s_suppkey"))
    g = run.groupBy("supplier_id").agg(F.countDistinct("act_id").alias("n"))
    return _row(g, "COMPANY_INACTIVE", ["supplier_id"], F.col("n"), 1, F.col("n"))


_R07 = _sql("COMPANY_INACTIVE", "cast(supplier_id as varchar)", "n", 1, "n", "from (select supplier_id, count(distinct act_id) as n from ends join suppliers using (act_id) join supplier on s_suppkey = supplier_id where s_acctbal < 0 and end_date >= date '2001-08-01' group by 1)", lifecycle.ENDS)


def short_deadline(lens: Lens, days: int = 7) -> DataFrame:
    """First delivery within ``days`` days of the order: the time left to suppliers."""
    first = lens.lines.groupBy("act_id").agg(F.min("ship_date").alias("first"))
    gap = F.datediff("first", "event_date")
    out = lens.acts.select("act_id", "event_date").join(first, "act_id").withColumn("gap", gap).where(F.col("gap").between(0, days))
    return _row(out, "SHORT_SUBMISSION_DEADLINE", ["act_id"], F.col("gap"), days, F.lit(1))


_R08 = _sql("SHORT_SUBMISSION_DEADLINE", "cast(act_id as varchar)", "gap", 7, "1", "from (select act_id, date_diff('day', event_date, first) as gap from acts join (select act_id, min(ship_date) as first from lines group by 1) using (act_id)) where gap between 0 and 7")


def historical_deviation(lens: Lens, factor: float = 3, least: int = 8) -> DataFrame:
    """Contracts of ``factor`` times the median of the same buyer's and market's contracts of the three years before. An
    equi-join on buyer and market with the dates as a residual: history is small for each key."""
    a = lens.acts.select("act_id", "buyer_id", "event_date", F.col("amount_net").cast("double").alias("v")).join(lens.primary.select("act_id", "cpv_prefix"), "act_id")
    h = a.select(F.col("buyer_id").alias("b"), F.col("cpv_prefix").alias("c"), F.col("event_date").alias("d"), F.col("v").alias("hv"))
    on = (F.col("buyer_id") == F.col("b")) & (F.col("cpv_prefix") == F.col("c")) & (F.col("d") < F.col("event_date")) & (F.col("d") >= F.add_months("event_date", -36))
    g = a.join(h, on).groupBy("act_id", "v").agg(F.percentile("hv", 0.5).alias("median"), F.count("*").alias("n"))
    out = g.where((F.col("n") >= least) & (F.col("v") >= factor * F.col("median")))
    return _row(out, "HISTORICAL_DEVIATION", ["act_id"], F.col("v") / F.col("median"), factor, F.col("n"))


_R09 = _sql("HISTORICAL_DEVIATION", "cast(act_id as varchar)", "v / med", 2, "n", """from (select a.act_id, cast(a.amount_net as double) as v, quantile_cont(cast(h.amount_net as double), 0.5) as med, count(*) as n from dated a join dated h
  on a.buyer_id = h.buyer_id and a.cpv_prefix = h.cpv_prefix and h.event_date < a.event_date and h.event_date >= a.event_date - interval 3 year group by a.act_id, a.amount_net) where n >= 4 and v >= 2 * med""", "dated as (select act_id, buyer_id, cpv_prefix, event_date, amount_net from acts join prime using (act_id))")  # fmt: skip


def near_threshold(lens: Lens, margin: float = 0.02, least: int = 3) -> DataFrame:
    """Contracts just below the first threshold above them, repeated by buyer and year."""
    t = F.array_min(F.filter(F.array(*(F.lit(x) for x in THRESHOLDS)), lambda x: (F.col("amount_net") < x) & (F.col("amount_net") >= x * F.lit(1 - margin))))
    near = lens.acts.where("amount_net > 0").withColumn("threshold", t).where("threshold is not null")
    n = F.count("*").over(Window.partitionBy("buyer_id", "period_year", "threshold"))
    out = near.withColumn("n", n).where(F.col("n") >= least)
    return _row(out, "AWARDS_NEAR_THRESHOLD", ["act_id", "threshold"], F.col("amount_net"), margin, F.col("n"), 8, 4)


_R10 = _sql("AWARDS_NEAR_THRESHOLD", "concat_ws('/', act_id, threshold)", "amount_net", 0.02, "n", """from (select *, count(*) over (partition by buyer_id, period_year, threshold) as n from (
  select act_id, buyer_id, period_year, amount_net, min(threshold) as threshold from acts, (select unnest([30000, 60000, 140000, 221000, 443000, 5382000]) as threshold)
  where amount_net > 0 and amount_net < threshold and amount_net >= threshold * 0.98 group by all)) where n >= 2""", h=8, m=4)  # fmt: skip


def fragmentation(lens: Lens, days: int = 30, pieces: int = 3, similarity: float = 0.65) -> DataFrame:
    """Contracts of one buyer within a window of days, each below a threshold, related by market or title, that pass it
    together; one row for each buyer and set of contracts (the least threshold). The range join is cut into buckets of the
    window's length: a seed meets its own bucket and the next, so a buyer's whole history is never paired."""
    a = lens.acts.where("amount_net > 0").join(lens.primary, "act_id").select("act_id", "buyer_id", "event_date", F.col("amount_net").alias("v"), "cpv_prefix", "title", F.floor(F.unix_date("event_date") / days).alias("bucket"))
    # both sides are dealt out before titles become sets of trigrams, which are many times as long
    set_of = lambda df: df.withColumn("g", trigrams(F.col("title"))).drop("title")
    m = a.withColumn("b", F.explode(F.array(F.col("bucket"), F.col("bucket") - 1))).drop("bucket").withColumnRenamed("b", "bucket").repartition("buyer_id", "bucket")
    a, m = set_of(a.repartition("buyer_id", "bucket")), set_of(m)
    m = m.select(F.col("act_id").alias("m_id"), F.col("buyer_id").alias("m_buyer"), F.col("event_date").alias("m_date"), F.col("v").alias("m_v"), F.col("cpv_prefix").alias("m_prefix"), F.col("g").alias("m_g"), F.col("bucket").alias("m_bucket"))
    on = (F.col("buyer_id") == F.col("m_buyer")) & (F.col("bucket") == F.col("m_bucket")) & F.col("m_date").between(F.col("event_date"), F.date_add("event_date", days)) & ((F.col("cpv_prefix") == F.col("m_prefix")) | (set_similarity(F.col("g"), F.col("m_g")) >= similarity))
    pairs = a.join(m, on).select("act_id", "buyer_id", "v", "m_id", "m_v", F.explode(F.array(*(F.lit(t) for t in THRESHOLDS))).alias("threshold")).where("v < threshold and m_v < threshold")
    c = pairs.groupBy("act_id", "buyer_id", "threshold").agg(F.count("*").alias("n"), F.sum("m_v").alias("total"), F.array_join(F.array_sort(F.collect_set("m_id")).cast("array<string>"), ",").alias("ids")).where((F.col("n") >= pieces) & (F.col("total") >= F.col("threshold")))
    out = c.groupBy("buyer_id", "ids").agg(F.min(F.struct("threshold", (-F.col("total")).alias("minus"), "n")).alias("t"))
    out = out.select("buyer_id", "ids", F.col("t.threshold").alias("threshold"), (-F.col("t.minus")).alias("total"), F.col("t.n").alias("n"))
    return _row(out, "PROCUREMENT_FRAGMENTATION", ["buyer_id", "ids", "threshold"], F.col("total"), pieces, F.col("n"), 8, 4)


_R11 = _sql("PROCUREMENT_FRAGMENTATION", "concat_ws('/', buyer_id, ids, threshold)", "total", 3, "n", """from (select *, row_number() over (partition by buyer_id, ids order by threshold, total desc) as rn from (
  select s.act_id, s.buyer_id, threshold, count(distinct m.act_id) as n, sum(m.amount_net) as total, string_agg(distinct cast(m.act_id as varchar), ',' order by cast(m.act_id as varchar)) as ids_text, array_to_string(list_sort(list(distinct m.act_id)), ',') as ids
  from dated s, (select unnest([30000, 60000, 140000, 221000, 443000, 5382000]) as threshold), dated m
  where m.buyer_id = s.buyer_id and m.event_date between s.event_date and s.event_date + interval 30 day and s.amount_net < threshold and m.amount_net < threshold
    and (m.cpv_prefix = s.cpv_prefix or (len(list_intersect(s.g, m.g)) / nullif(len(list_distinct(list_concat(s.g, m.g))), 0)) >= 0.65)
  group by all having count(distinct m.act_id) >= 3 and sum(m.amount_net) >= threshold)) where rn = 1""", """dated as (select act_id, buyer_id, event_date, amount_net, cpv_prefix, list_distinct(flatten(list_transform(list_filter(string_split_regex(lower(title), '[^a-z0-9]+'), lambda w: w <> ''),
  lambda w: list_transform(range(1, length(w) + 2), lambda i: substr('  ' || w || ' ', i, 3))))) as g from acts join prime using (act_id) where amount_net > 0)""", h=8, m=4)  # fmt: skip


def missing_links(lens: Lens, grace: int = 14) -> DataFrame:
    """Processes older than the grace period with a later stage but without an earlier one."""
    pays = lifecycle.payments(lens).groupBy("act_id").agg(F.count("*").alias("payments"))
    sup = lens.suppliers.groupBy("act_id").agg(F.count("*").alias("awards"))
    p = lens.acts.join(pays, "act_id", "left").join(sup, "act_id", "left").na.fill(0, ["payments", "awards"])
    rules = F.array(F.when(F.col("awards") == 0, "AWARD"), F.when((F.col("status") == "F") & (F.col("payments") == 0), "PAYMENT"), F.when((F.col("payments") > 0) & (F.col("status") == "O"), "CONTRACT"))
    out = p.withColumn("missing", F.array_compact(rules)).where((F.size("missing") > 0) & (F.datediff(today(), F.col("event_date")) >= grace)).withColumn("what", F.array_join("missing", ","))
    return _row(out, "MISSING_EXPECTED_LINKED_ACTS", ["act_id", "what"], F.size("missing"), 0, F.col("payments") + F.col("awards"))


_R12 = _sql("MISSING_EXPECTED_LINKED_ACTS", "concat_ws('/', act_id, concat_ws(',', a, b, c))", "(a is not null)::int + (b is not null)::int + (c is not null)::int", 0, "payments + awards", """from (select act_id, event_date, coalesce(n, 0) as payments, coalesce(k, 0) as awards,
    case when coalesce(k, 0) = 0 then 'AWARD' end as a, case when status = 'F' and coalesce(n, 0) = 0 then 'PAYMENT' end as b, case when coalesce(n, 0) > 0 and status = 'O' then 'CONTRACT' end as c
  from acts left join (select act_id, count(*) as n from lines where line_status = 'F' group by 1) using (act_id) left join (select act_id, count(*) as k from suppliers group by 1) using (act_id))
  where (a is not null or b is not null or c is not null) and date_diff('day', event_date, date '2001-08-01') >= 14""")  # fmt: skip

INDICATORS = {
    "high_buyer_concentration": (high_buyer_concentration, _R01), "repeat_same_contractor": (repeat_same_contractor, _R02), "few_distinct_suppliers": (few_distinct_suppliers, _R03),
    "repeated_modifications": (repeated_modifications, _R04), "large_value_increase": (large_value_increase, _R05), "unusual_delay": (unusual_delay, _R06), "inactive_supplier": (inactive_supplier, _R07),
    "short_deadline": (short_deadline, _R08), "historical_deviation": (historical_deviation, _R09), "near_threshold": (near_threshold, _R10), "fragmentation": (fragmentation, _R11), "missing_links": (missing_links, _R12),
}

#: What the queries ask for where the defaults find nothing in the test tables, whose buyers spread their orders evenly.
LOOSER = {
    "high_buyer_concentration": {"benchmark": 0.12}, "repeat_same_contractor": {"benchmark": 0.5, "least": 3}, "few_distinct_suppliers": {"most": 12},
    "historical_deviation": {"factor": 2, "least": 4}, "near_threshold": {"least": 2},
}

for _name, (_f, _oracle) in INDICATORS.items():

    def _run(spark: SparkSession, sf_dir: str, f=_f, name=_name) -> DataFrame:
        return f(Lens(spark, sf_dir), **LOOSER.get(name, {}))

    query(f"risk_{_name}", _oracle)(_run)


@query("risk_all", " union all by name ".join(f"(select * from ({o}))" for _, o in INDICATORS.values()))
def all_indicators(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All indicators in one frame, in a fixed order of their union. They are worked out one after the other, so that the disks
    hold what one of them shuffles, and not what all do."""
    lens = Lens(spark, sf_dir)
    return reduce(DataFrame.unionByName, (cut(f(lens, **LOOSER.get(k, {}))) for k, (f, _) in INDICATORS.items()))
