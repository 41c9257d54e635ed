"""Market marts and the queries over them: values, shares, concentration, dependency, top lists, regions, dashboards."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marketlens.functions.joins import null_safe_join
from marketlens.lens import Lens, sql
from marketlens.registry import query
from marketlens.scope import Scope

KEYS = ["cpv_prefix", "nuts_code", "period_year"]
_ratio = lambda a, b: F.round(a.cast("double") / F.nullif(b.cast("double"), F.lit(0.0)), 6)


def contract_dimensions(lens: Lens) -> DataFrame:
    """Eligible contracts at the grain of a market: distinct by contract and place, so that no join fans values out."""
    place = lens.locations.select("act_id", "nuts_code").distinct()
    return lens.eligible.join(lens.primary.select("act_id", "cpv_prefix"), "act_id").join(place, "act_id", "left").select("act_id", "process_id", *KEYS, "procedure_type", "amount_net", "buyer_id").distinct()


DIMS = """dims as (
  select distinct act_id, process_id, cpv_prefix, nuts_code, period_year, procedure_type, amount_net, buyer_id
  from eligible join prime using (act_id) left join locations using (act_id))"""


def market_values(lens: Lens) -> DataFrame:
    """(prefix, place, year, procedure) to counts and values; supplier and buyer counts are joined null-safely."""
    dims = contract_dimensions(lens)
    keys = [*KEYS, "procedure_type"]
    totals = dims.groupBy(*keys).agg(
        F.countDistinct("process_id").alias("contract_count"), F.sum("amount_net").cast("decimal(30,2)").alias("total_value_net"),
        F.round(F.avg(F.col("amount_net").cast("double")), 4).alias("avg_value_net"), F.round(F.percentile(F.col("amount_net").cast("double"), 0.5), 4).alias("median_value_net"),
        F.countDistinct("buyer_id").alias("buyer_count"),
    )
    sup = dims.join(lens.suppliers, "act_id").groupBy(*keys).agg(F.countDistinct("supplier_id").alias("supplier_count"))
    joined = null_safe_join(totals, sup, keys, "left")
    return joined.select(*keys, "contract_count", "total_value_net", "avg_value_net", "median_value_net", F.coalesce("supplier_count", F.lit(0)).alias("supplier_count"), "buyer_count")


VALUES = """mvalues as (
  select t.*, coalesce(s.supplier_count, 0) as supplier_count from (
    select cpv_prefix, nuts_code, period_year, procedure_type, count(distinct process_id) as contract_count, cast(sum(amount_net) as decimal(30,2)) as total_value_net,
      round(avg(cast(amount_net as double)), 4) as avg_value_net, round(quantile_cont(cast(amount_net as double), 0.5), 4) as median_value_net, count(distinct buyer_id) as buyer_count
    from dims group by all) t
  left join (select cpv_prefix, nuts_code, period_year, procedure_type, count(distinct supplier_id) as supplier_count from dims join suppliers using (act_id) group by all) s
    on t.cpv_prefix = s.cpv_prefix and t.nuts_code is not distinct from s.nuts_code and t.period_year = s.period_year and t.procedure_type is not distinct from s.procedure_type)"""


def supplier_shares(lens: Lens) -> DataFrame:
    """A contract's net value is dealt to its suppliers in proportion to their amounts, evenly where these are 0; a contract
    without net value takes the amounts themselves. Buyers are counted apart, so they don't multiply values."""
    d = contract_dimensions(lens).join(lens.suppliers, "act_id")
    w = Window.partitionBy("act_id", "cpv_prefix", F.coalesce("nuts_code", F.lit("")), "period_year")
    total, n = F.sum(F.coalesce("amount", F.lit(0))).over(w), F.count("*").over(w)
    net, amount = F.col("amount_net").cast("double"), F.col("amount").cast("double")
    value = F.when(F.col("amount_net").isNull(), amount).when(total > 0, net * F.coalesce(amount, F.lit(0.0)) / total.cast("double")).otherwise(net / n)
    return d.withColumn("v", value).groupBy(*KEYS, "supplier_id").agg(
        F.round(F.sum("v"), 2).alias("supplier_value"), F.countDistinct("process_id").alias("supplier_contract_count"), F.countDistinct("buyer_id").alias("supplier_buyer_count")
    )


SHARES = """alloc as (
  select d.*, supplier_id, case when amount_net is null then cast(amount as double)
    when sum(coalesce(amount, 0)) over m > 0 then cast(amount_net as double) * coalesce(cast(amount as double), 0) / cast(sum(coalesce(amount, 0)) over m as double)
    else cast(amount_net as double) / count(*) over m end as v
  from dims d join suppliers using (act_id) window m as (partition by act_id, cpv_prefix, coalesce(nuts_code, ''), period_year)),
shares as (
  select cpv_prefix, nuts_code, period_year, supplier_id, round(sum(v), 2) as supplier_value, count(distinct process_id) as supplier_contract_count,
    count(distinct buyer_id) as supplier_buyer_count from alloc group by all)"""


def concentration_index(lens: Lens) -> DataFrame:
    """Herfindahl-Hirschman index: the sum of squared percentage shares of a market over all its procedures."""
    s = supplier_shares(lens)
    totals = s.groupBy(*KEYS).agg(F.sum("supplier_value").alias("total"), F.count("*").alias("supplier_count"))
    share = 100 * F.col("supplier_value") / F.nullif("total", F.lit(0.0))
    return null_safe_join(s, totals, KEYS).groupBy(*KEYS, "supplier_count").agg(F.round(F.sum(share * share), 2).alias("hhi"))


HHI = """hhi as (
  select cpv_prefix, nuts_code, period_year, count(*) as supplier_count, round(sum(power(100 * supplier_value / nullif(total, 0), 2)), 2) as hhi
  from (select *, sum(supplier_value) over (partition by cpv_prefix, nuts_code, period_year) as total from shares) group by all)"""


@query("market_value_metrics", sql("select * from mvalues", DIMS, VALUES))
def market_value_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return market_values(Lens(spark, sf_dir))


@query("supplier_market_share", sql("select * from shares", DIMS, SHARES))
def supplier_market_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    return supplier_shares(Lens(spark, sf_dir))


@query("market_hhi", sql("select * from hhi", DIMS, SHARES, HHI))
def market_hhi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return concentration_index(Lens(spark, sf_dir))


@query("market_hhi_as_joined", sql("""select s.cpv_prefix, s.nuts_code, s.period_year, t.procedure_type, round(sum(power(100 * supplier_value / nullif(cast(total_value_net as double), 0), 2)), 1) as hhi
  from shares s join mvalues t on s.cpv_prefix = t.cpv_prefix and s.nuts_code is not distinct from t.nuts_code and s.period_year = t.period_year group by all""", DIMS, VALUES, SHARES))  # fmt: skip
def market_hhi_as_joined(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The index against each procedure's total apart, as a join without the procedure gives it."""
    lens = Lens(spark, sf_dir)
    s, t = supplier_shares(lens), market_values(lens).select(*KEYS, "procedure_type", "total_value_net")
    share = 100 * F.col("supplier_value") / F.nullif(F.col("total_value_net").cast("double"), F.lit(0.0))
    return null_safe_join(s, t, KEYS).groupBy(*KEYS, "procedure_type").agg(F.round(F.sum(share * share), 1).alias("hhi"))


@query("market_metrics", sql("select m.*, h.hhi from mvalues m left join hhi h on m.cpv_prefix = h.cpv_prefix and m.nuts_code is not distinct from h.nuts_code and m.period_year = h.period_year order by total_value_net desc, m.cpv_prefix, m.nuts_code, m.period_year, procedure_type limit 100", DIMS, VALUES, SHARES, HHI))
def market_metrics(spark: SparkSession, sf_dir: str, limit: int = 100) -> DataFrame:
    lens = Lens(spark, sf_dir)
    m, h = market_values(lens), concentration_index(lens)
    out = null_safe_join(m, h.drop("supplier_count"), KEYS, "left")
    return out.orderBy(F.desc("total_value_net"), "cpv_prefix", "nuts_code", "period_year", "procedure_type").limit(limit)


def buyer_supplier_values(lens: Lens) -> DataFrame:
    return lens.eligible.select("act_id", "buyer_id").join(lens.suppliers, "act_id").groupBy("buyer_id", "supplier_id").agg(F.sum("amount").cast("decimal(30,4)").alias("value"), F.countDistinct("act_id").alias("contracts"))


PAIRS = "pairs as (select buyer_id, supplier_id, cast(sum(amount) as decimal(30,4)) as value, count(distinct act_id) as contracts from eligible join suppliers using (act_id) group by all)"


@query("buyer_concentration", sql("""select buyer_id, supplier_id as top_supplier_id, value as top_value, cast(total as decimal(30,4)) as total_value, round(cast(value as double) / nullif(cast(total as double), 0), 6) as top_supplier_share
  from (select *, sum(value) over (partition by buyer_id) as total, row_number() over (partition by buyer_id order by value desc, supplier_id) as rn from pairs) where rn = 1""", PAIRS))  # fmt: skip
def buyer_concentration(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each buyer's largest supplier; ties go to the lesser id. One aggregation, no window over a buyer's rows."""
    top = F.max(F.struct("value", (-F.col("supplier_id")).alias("minus")))
    out = buyer_supplier_values(Lens(spark, sf_dir)).groupBy("buyer_id").agg(top.alias("t"), F.sum("value").cast("decimal(30,4)").alias("total_value"))
    return out.select("buyer_id", (-F.col("t.minus")).alias("top_supplier_id"), F.col("t.value").alias("top_value"), "total_value", _ratio(F.col("t.value"), F.col("total_value")).alias("top_supplier_share"))


@query("supplier_dependency", sql("select supplier_id, buyer_id, value as value_from_buyer, cast(sum(value) over (partition by supplier_id) as decimal(30,4)) as total_recorded_value, round(cast(value as double) / nullif(cast(sum(value) over (partition by supplier_id) as double), 0), 6) as dependency_ratio from pairs", PAIRS))
def supplier_dependency(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = buyer_supplier_values(Lens(spark, sf_dir))
    total = F.sum("value").over(Window.partitionBy("supplier_id")).cast("decimal(30,4)")
    return pairs.withColumn("total_recorded_value", total).select("supplier_id", "buyer_id", F.col("value").alias("value_from_buyer"), "total_recorded_value", _ratio(F.col("value"), F.col("total_recorded_value")).alias("dependency_ratio"))


TOP = Scope(date_from="1996-01-01", date_to="1999-12-31")


def top_suppliers(lens: Lens, scope: Scope, limit: int = 20) -> DataFrame:
    """Suppliers by value within a scope: distinct (act, supplier, amount), so filters never fan values out."""
    acts = scope.apply(lens.eligible, lens).select("act_id")
    rows = acts.join(lens.suppliers, "act_id").select("act_id", "supplier_id", "amount").distinct()
    top = rows.groupBy("supplier_id").agg(F.sum("amount").cast("decimal(30,4)").alias("total_value"), F.count("*").alias("contract_count")).orderBy(F.desc_nulls_last("total_value"), "supplier_id").limit(limit)
    names = lens.table("supplier", "s_suppkey", "s_name")
    return top.join(names, F.col("supplier_id") == F.col("s_suppkey"), "left").select("supplier_id", F.col("s_name").alias("supplier_name"), "total_value", "contract_count")


_TOP_SQL = """select supplier_id, s_name as supplier_name, total_value, contract_count from (
  select supplier_id, cast(sum(amount) as decimal(30,4)) as total_value, count(*) as contract_count from eligible join suppliers using (act_id) where {} group by 1 order by total_value desc nulls last, supplier_id limit 20)
  left join supplier on supplier_id = s_suppkey"""
_DATES = "event_date between date '1996-01-01' and date '1999-12-31'"


@query("top_suppliers", sql(_TOP_SQL.format(_DATES)))
def _top_suppliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_suppliers(Lens(spark, sf_dir), TOP)


@query("prefix_any_semi", sql(_TOP_SQL.format("act_id in (select act_id from codes where cpv_code like 'Brand#1%' or cpv_code like 'Brand#2%')")))
def _prefix_any(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_suppliers(Lens(spark, sf_dir), Scope(code_prefixes=("Brand#1-0", "Brand#2", "Brand#1")))


_WORD = "act_id in (select act_id from prime where lower(title) like '%green%' or lower(title) like '%red%')"
_CODE = "act_id in (select act_id from codes where cpv_code like 'Brand#3%')"


@query("taxonomy_match_any", sql(_TOP_SQL.format(f"({_CODE} or {_WORD})")))
def _taxonomy_any(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_suppliers(Lens(spark, sf_dir), Scope(code_prefixes=("Brand#3",), keywords=("green", "RED")))


@query("taxonomy_match_all", sql(_TOP_SQL.format(f"({_CODE} and {_WORD})")))
def _taxonomy_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_suppliers(Lens(spark, sf_dir), Scope(code_prefixes=("Brand#3",), keywords=("green", "RED"), taxonomy_match="ALL"))


@query("taxonomy_keyword_required", sql(_TOP_SQL.format(_WORD)))
def _taxonomy_word(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_suppliers(Lens(spark, sf_dir), Scope(code_prefixes=("Brand#3",), keywords=("green", "RED"), taxonomy_match="KEYWORD_REQUIRED"))


@query("municipality_contains", sql(_TOP_SQL.format("act_id in (select act_id from locations where lower(region) like '%east%') and coalesce(amount_net, 0) >= 1000")))
def _region_contains(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_suppliers(Lens(spark, sf_dir), Scope(region="EAST", amount_min=1000))


@query("top_buyers", sql(f"""select b.buyer_id, c_name as buyer_name, total_value, contract_count, supplier_count from (
    select buyer_id, cast(sum(amount_net) as decimal(30,2)) as total_value, count(distinct act_id) as contract_count from eligible where {_DATES} group by 1 order by total_value desc nulls last, buyer_id limit 20) b
  join (select buyer_id, count(distinct supplier_id) as supplier_count from eligible join suppliers using (act_id) where {_DATES} group by 1) s using (buyer_id) left join customer on buyer_id = c_custkey"""))  # fmt: skip
def top_buyers(spark: SparkSession, sf_dir: str, scope: Scope = TOP, limit: int = 20) -> DataFrame:
    """Buyers by value, then, for those alone, their distinct suppliers and names."""
    lens = Lens(spark, sf_dir)
    acts = scope.apply(lens.eligible, lens)
    top = acts.groupBy("buyer_id").agg(F.sum("amount_net").cast("decimal(30,2)").alias("total_value"), F.countDistinct("act_id").alias("contract_count")).orderBy(F.desc_nulls_last("total_value"), "buyer_id").limit(limit)
    sup = acts.select("act_id", "buyer_id").join(top.select("buyer_id"), "buyer_id", "left_semi").join(lens.suppliers, "act_id").groupBy("buyer_id").agg(F.countDistinct("supplier_id").alias("supplier_count"))
    names = lens.table("customer", F.col("c_custkey").alias("buyer_id"), F.col("c_name").alias("buyer_name"))
    return top.join(sup, "buyer_id").join(names, "buyer_id", "left").select("buyer_id", "buyer_name", "total_value", "contract_count", "supplier_count")


@query("market_overview", sql("""select count(distinct act_id) as acts, count(distinct buyer_id) as buyers, (select count(distinct supplier_id) from eligible join suppliers using (act_id)) as suppliers,
  count(distinct act_id) filter (status = 'O') as open_acts, count(distinct act_id) filter (status = 'F') as closed_acts, cast(sum(amount_net) filter (status <> 'P') as decimal(30,2)) as settled_value,
  count(distinct act_id) filter (region = 'EUROPE') as european_acts, bool_or(amount_net > 400000) as has_large from eligible left join locations using (act_id)"""))  # fmt: skip
def market_overview(spark: SparkSession, sf_dir: str) -> DataFrame:
    lens = Lens(spark, sf_dir)
    a = lens.eligible.join(lens.locations.select("act_id", "region"), "act_id", "left")
    some = lambda c: F.countDistinct(F.when(c, F.col("act_id")))
    one = a.agg(
        F.countDistinct("act_id").alias("acts"), F.countDistinct("buyer_id").alias("buyers"), some(F.col("status") == "O").alias("open_acts"), some(F.col("status") == "F").alias("closed_acts"),
        F.sum(F.when(F.col("status") != "P", F.col("amount_net"))).cast("decimal(30,2)").alias("settled_value"), some(F.col("region") == "EUROPE").alias("european_acts"), F.bool_or(F.col("amount_net") > 400000).alias("has_large"),
    )
    sup = lens.eligible.select("act_id").join(lens.suppliers, "act_id").agg(F.countDistinct("supplier_id").alias("suppliers"))
    return one.crossJoin(F.broadcast(sup))  # one row each


@query("regions", sql("select left(nuts_code, 2) as nuts_group, region, count(distinct act_id) as acts, count(distinct case when status = 'F' then act_id end) as closed, cast(sum(amount_net) as decimal(30,2)) as value from eligible join (select distinct act_id, nuts_code, region from locations) using (act_id) group by all"))
def regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    lens = Lens(spark, sf_dir)
    a = lens.eligible.join(lens.locations.distinct(), "act_id")
    return a.groupBy(F.left("nuts_code", F.lit(2)).alias("nuts_group"), "region").agg(F.countDistinct("act_id").alias("acts"), F.countDistinct(F.when(F.col("status") == "F", F.col("act_id"))).alias("closed"), F.sum("amount_net").cast("decimal(30,2)").alias("value"))


@query("dashboard_summary", sql("select count(*) as contracts, cast(sum(amount_net) as decimal(30,2)) as total_value, round(avg(cast(amount_net as double)), 4) as avg_value, round(quantile_cont(cast(amount_net as double), 0.5), 4) as median_value, min(event_date) as first_date, max(event_date) as last_date from eligible where " + _DATES))
def dashboard_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    lens = Lens(spark, sf_dir)
    d = F.col("amount_net").cast("double")
    return TOP.apply(lens.eligible, lens).agg(F.count("*").alias("contracts"), F.sum("amount_net").cast("decimal(30,2)").alias("total_value"), F.round(F.avg(d), 4).alias("avg_value"), F.round(F.percentile(d, 0.5), 4).alias("median_value"), F.min("event_date").alias("first_date"), F.max("event_date").alias("last_date"))


@query("dashboard_procedure_mix", sql("select procedure_type, count(*) as contracts, cast(sum(amount_net) as decimal(30,2)) as value, round(100.0 * count(*) / sum(count(*)) over (), 4) as share from eligible group by 1"))
def dashboard_procedure_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    by = Lens(spark, sf_dir).eligible.groupBy("procedure_type").agg(F.count("*").alias("contracts"), F.sum("amount_net").cast("decimal(30,2)").alias("value"))
    total = by.agg(F.sum("contracts").alias("all"))
    return by.crossJoin(F.broadcast(total)).select("procedure_type", "contracts", "value", F.round(100.0 * F.col("contracts") / F.col("all"), 4).alias("share"))


@query("dashboard_supplier_trends", sql("select supplier_id, period_year, cast(sum(amount) as decimal(30,4)) as value, count(*) as contracts from eligible join suppliers using (act_id) group by all"))
def dashboard_supplier_trends(spark: SparkSession, sf_dir: str) -> DataFrame:
    lens = Lens(spark, sf_dir)
    return lens.eligible.select("act_id", "period_year").join(lens.suppliers, "act_id").groupBy("supplier_id", "period_year").agg(F.sum("amount").cast("decimal(30,4)").alias("value"), F.count("*").alias("contracts"))


@query("buyer_spend_trend", sql("select buyer_id, period_year, cast(sum(amount_net) as decimal(30,2)) as spend, count(*) as contracts from eligible group by all"))
def buyer_spend_trend(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Lens(spark, sf_dir).eligible.groupBy("buyer_id", "period_year").agg(F.sum("amount_net").cast("decimal(30,2)").alias("spend"), F.count("*").alias("contracts"))


@query("buyer_top_suppliers", sql("select buyer_id, supplier_id, value, contracts from (select *, row_number() over (partition by buyer_id order by value desc, supplier_id) as rn from pairs) where rn <= 3", PAIRS))
def buyer_top_suppliers(spark: SparkSession, sf_dir: str, k: int = 3) -> DataFrame:
    w = Window.partitionBy("buyer_id").orderBy(F.desc("value"), "supplier_id")
    return buyer_supplier_values(Lens(spark, sf_dir)).withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= k).drop("rn")


@query("scan_filter_project", "select o_orderkey, cast(o_totalprice as decimal(20,2)) as amount, o_orderstatus from orders where o_orderdate >= timestamp '1997-01-01' and o_orderdate < timestamp '1998-01-01' and coalesce(o_totalprice, 0) >= 100000")
def scan_filter_project(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    o = o.where((F.col("o_orderdate") >= F.lit("1997-01-01").cast("timestamp_ntz")) & (F.col("o_orderdate") < F.lit("1998-01-01").cast("timestamp_ntz")) & (F.coalesce("o_totalprice", F.lit(0.0)) >= 100000))
    return o.select("o_orderkey", F.col("o_totalprice").cast("decimal(20,2)").alias("amount"), "o_orderstatus")
