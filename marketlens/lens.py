"""The star-schema test tables read as the canonical procurement model.

An order is a process with one CONTRACT act; its customer is the buyer, its suppliers are parties with the value of their
lines, its parts carry taxonomy codes (brand) under a prefix (type), the buyer's nation is the place. ``SQL`` says the same
in DuckDB SQL, as common table expressions that oracle queries start from.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The day that stands for "today": the last order date of the tables. Never read from a clock.
AS_OF = "2001-08-01"
#: Days that a line must have shipped before its order to count as a blocking quality issue.
ISSUE_DAYS = 2000

MONEY = "decimal(20,2)"
PRECISE = "decimal(20,4)"


def today() -> Column:
    return F.lit(AS_OF).cast("date")


@dataclass(frozen=True)
class Lens:
    """Canonical DataFrames over one folder of test tables. Each scan reads the columns it needs."""

    spark: SparkSession
    sf_dir: str

    def table(self, name: str, *cols: str) -> DataFrame:
        df = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        return df.select(*cols) if cols else df

    @cached_property
    def acts(self) -> DataFrame:
        """One CONTRACT act per order: identity, amounts, dates, procedure, buyer."""
        o = self.table("orders")
        return o.select(
            F.col("o_orderkey").alias("act_id"), F.col("o_orderkey").alias("process_id"), F.lit("CONTRACT").alias("act_type"),
            F.col("o_totalprice").cast(MONEY).alias("amount_net"), F.col("o_orderdate").cast("date").alias("event_date"),
            F.year("o_orderdate").alias("period_year"), F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("procedure_type"), F.col("o_custkey").alias("buyer_id"),
        )

    @cached_property
    def lines(self) -> DataFrame:
        """Lines with their exact value and days."""
        li = self.table("lineitem")
        return li.select(
            F.col("l_orderkey").alias("act_id"), F.col("l_suppkey").alias("supplier_id"), F.col("l_partkey").alias("part_id"), F.col("l_linenumber").alias("line_no"),
            (F.col("l_extendedprice") * (1 - F.col("l_discount"))).cast(PRECISE).alias("value"), F.col("l_extendedprice"), F.col("l_quantity"),
            F.col("l_returnflag").alias("return_flag"), F.col("l_linestatus").alias("line_status"), F.col("l_shipdate").cast("date").alias("ship_date"),
        )

    @cached_property
    def suppliers(self) -> DataFrame:
        """SUPPLIER parties: (act_id, supplier_id, amount)."""
        return self.lines.groupBy("act_id", "supplier_id").agg(F.sum("value").cast(PRECISE).alias("amount"))

    @cached_property
    def codes(self) -> DataFrame:
        """Taxonomy codes of acts: (act_id, cpv_code, cpv_prefix), distinct."""
        part = self.table("part", "p_partkey", "p_brand", "p_type")
        return self.lines.select("act_id", "part_id").join(part, F.col("part_id") == F.col("p_partkey")).select("act_id", F.col("p_brand").alias("cpv_code"), F.col("p_type").alias("cpv_prefix")).distinct()

    @cached_property
    def primary(self) -> DataFrame:
        """The primary code and title of each act: those of its first line, ties broken in full."""
        first = F.min(F.struct("line_no", "part_id", "supplier_id", (-F.col("l_extendedprice")).alias("p"), "l_quantity"))["part_id"]
        part = self.table("part", "p_partkey", "p_brand", "p_type", "p_name")
        return self.lines.groupBy("act_id").agg(first.alias("part_id")).join(part, F.col("part_id") == F.col("p_partkey")).select("act_id", F.col("p_brand").alias("cpv_code"), F.col("p_type").alias("cpv_prefix"), F.col("p_name").alias("title"))

    @cached_property
    def locations(self) -> DataFrame:
        """(act_id, nuts_code, region): the place of an act is its buyer's nation."""
        n = self.table("nation").join(self.table("region"), F.col("n_regionkey") == F.col("r_regionkey"))
        place = self.table("customer", "c_custkey", "c_nationkey").join(n, F.col("c_nationkey") == F.col("n_nationkey"))
        place = place.select(F.col("c_custkey").alias("buyer_id"), F.format_string("N%02d", "n_nationkey").alias("nuts_code"), F.col("r_name").alias("region"))
        return self.acts.select("act_id", "buyer_id").join(place, "buyer_id").select("act_id", "nuts_code", "region")

    @cached_property
    def issues(self) -> DataFrame:
        """Acts with an open blocking issue."""
        early = self.lines.select("act_id", "ship_date").join(self.acts.select("act_id", "event_date"), "act_id")
        return early.where(F.datediff("event_date", "ship_date") > ISSUE_DAYS).select("act_id").distinct()

    @cached_property
    def eligible(self) -> DataFrame:
        """Acts that may enter analytics: current, dated, and without an open blocking issue."""
        return self.acts.where(F.col("event_date").isNotNull()).join(self.issues, "act_id", "left_anti")


SQL = f"""
acts as (
  select o_orderkey as act_id, o_orderkey as process_id, 'CONTRACT' as act_type, cast(o_totalprice as decimal(20,2)) as amount_net,
    cast(o_orderdate as date) as event_date, cast(year(o_orderdate) as int) as period_year, o_orderstatus as status,
    o_orderpriority as procedure_type, o_custkey as buyer_id from orders),
lines as (
  select l_orderkey as act_id, l_suppkey as supplier_id, l_partkey as part_id, l_linenumber as line_no,
    cast(l_extendedprice * (1 - l_discount) as decimal(20,4)) as value, l_extendedprice, l_quantity, l_returnflag as return_flag,
    l_linestatus as line_status, cast(l_shipdate as date) as ship_date from lineitem),
suppliers as (select act_id, supplier_id, cast(sum(value) as decimal(20,4)) as amount from lines group by all),
codes as (select distinct act_id, p_brand as cpv_code, p_type as cpv_prefix from lines join part on part_id = p_partkey),
prime as (
  select act_id, p_brand as cpv_code, p_type as cpv_prefix, p_name as title from (
    select *, row_number() over (partition by act_id order by line_no, part_id, supplier_id, l_extendedprice desc, l_quantity) as rn from lines)
  join part on part_id = p_partkey where rn = 1),
locations as (
  select act_id, 'N' || lpad(cast(n_nationkey as varchar), 2, '0') as nuts_code, r_name as region
  from acts join customer on buyer_id = c_custkey join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey),
issues as (
  select distinct act_id from lines join acts using (act_id) where date_diff('day', ship_date, event_date) > {ISSUE_DAYS}),
eligible as (select * from acts where event_date is not null and act_id not in (select act_id from issues))
"""


def sql(body: str, *ctes: str) -> str:
    """An oracle query: the lens, further common table expressions, and a body."""
    return "with " + ",\n".join([SQL.strip(), *(c.strip() for c in ctes)]) + "\n" + body
