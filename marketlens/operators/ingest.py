"""Queries on source records: payloads of several shapes as canonical acts and notices, and child rows by version.

The payloads are made from the tables, one for each order, in the shapes that sources use; what comes back is compared with
the tables themselves.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marketlens.lens import Lens
from marketlens.registry import query
from marketlens.session import shared_folder
from marketlens.sources import children, records


def _vat(key: str) -> Column:
    return F.lpad(F.col(key).cast("string"), 9, "0")


def payloads(lens: Lens) -> DataFrame:
    """(resource, payload): one record for each order. Urgent ones (priorities 1 and 2) are contracts with totals and winners;
    3 has its amounts in lines, its members within an object, {key, value} objects for codes; 4 is a payment with payees
    among its lines; 5 names a single winner and writes its keys in the other spelling."""
    line = F.struct(F.col("p_brand").alias("brand"), F.col("l_extendedprice").cast("decimal(20,2)").alias("cost"), _vat("l_suppkey").alias("vat"), F.col("p_name").alias("name"))
    parts = lens.table("part", "p_partkey", "p_brand", "p_name")
    lines = lens.table("lineitem", "l_orderkey", "l_partkey", "l_suppkey", "l_extendedprice").join(parts, F.col("l_partkey") == F.col("p_partkey"))
    lines = lines.groupBy("l_orderkey").agg(F.collect_list(line).alias("ls"))
    o = lens.table("orders").join(lens.table("customer", "c_custkey", "c_name", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"), "left")
    o = o.join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left").withColumn("ls", F.coalesce("ls", F.array().cast("array<struct<brand:string,cost:decimal(20,2),vat:string,name:string>>")))
    total, day = F.col("o_totalprice").cast("decimal(20,2)"), F.date_format("o_orderdate", "yyyy-MM-dd")
    nuts = F.format_string("EL%d", F.col("c_nationkey") + 100)
    winner = lambda x: F.struct(x["vat"].alias("vatNumber"), x["name"].alias("name"))
    member = lambda x: F.struct(x["vat"].alias("vatNo"), x["name"].alias("name"), x["cost"].alias("amount"))
    keyed = lambda x: F.struct(x.alias("key"), F.lit("n/a").alias("value"))
    ref = F.concat(F.lit(" 25symv"), F.lpad(F.col("o_orderkey").cast("string"), 9, "0")).alias("referenceNumber")
    shapes = {
        "1-URGENT": (ref, F.col("c_name").alias("organizationName"), _vat("o_custkey").alias("organizationVatNumber"), day.alias("submissionDate"), total.alias("totalCostWithoutVAT"),
                     (total * 2).alias("totalCostWithVAT"), F.transform("ls", winner).alias("awardees"), F.transform("ls", lambda x: x["brand"]).alias("cpvItems"), nuts.alias("nutsCode"),
                     F.lit("8Β2Ι465ΦΘΘ-ΛΜΝ").alias("decisionRelatedAda"), F.lit("OPEN").alias("procedureType")),
        "3-MEDIUM": (ref, F.struct(F.col("o_custkey").alias("key"), F.col("c_name").alias("value")).alias("organization"), F.concat(day, F.lit("T10:00:00+02:00")).alias("submissionDate"),
                     F.transform("ls", lambda x: F.struct(x["cost"].alias("costWithoutVAT"), F.array(keyed(x["brand"])).alias("cpvs"), F.lit(1).alias("quantity"))).alias("objectDetailsList"),
                     F.struct(F.transform("ls", member).alias("contractingMembersDataList")).alias("contractingDataDetails"), F.array(F.struct(keyed(nuts).alias("nutsCode"))).alias("nutsCodes"),
                     F.struct(F.lit("1").alias("key"), F.lit("OPEN").alias("value")).alias("typeOfProcedure")),
        "4-NOT SPECIFIED": (ref, F.col("c_name").alias("organizationName"), _vat("o_custkey").alias("organizationVatNumber"), day.alias("signedDate"), total.alias("contractValue"),
                            F.transform("ls", lambda x: F.struct(x["vat"].alias("vatNo"), x["name"].alias("companyName"), x["cost"].alias("costWithoutVAT"), x["brand"].alias("cpvs"))).alias("objectDetails")),
        "5-LOW": (ref, F.col("c_name").alias("organizationName"), F.concat(F.lit("EL "), _vat("o_custkey")).alias("organizationVatNumber"), day.alias("submissionDate"), F.lit(0).alias("totalCostWithoutVAT"),
                  total.alias("amountNet"), winner(F.get("ls", F.lit(0))).alias("contractors"), F.lit(None).cast("string").alias("cancellationADA"), F.lit("9γ3κ465φθθ-ξοπ").alias("contractRelatedADA"),
                  F.struct(F.lit("OPS-1").alias("publicFundingRefOps")).alias("fundingDetails")),
    }
    shape = F.when(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH"), F.lit("1-URGENT")).otherwise(F.col("o_orderpriority"))
    payload = F.lit(None).cast("string")
    for name, fields in shapes.items():
        payload = F.when(shape == name, F.to_json(F.struct(*fields))).otherwise(payload)
    resource = F.when(shape == "4-NOT SPECIFIED", "payment").otherwise("contract")
    return o.select("o_orderkey", resource.alias("resource"), payload.alias("payload"))


@query("canonical_acts", """with l as (select l_orderkey as k, sum(cast(l_extendedprice as decimal(20,2))) as cost, string_agg(distinct lpad(cast(l_suppkey as varchar), 9, '0') || ':' || p_name, ',' order by lpad(cast(l_suppkey as varchar), 9, '0') || ':' || p_name) as who,
    count(distinct p_brand) as codes from lineitem join part on l_partkey = p_partkey group by 1),
  o as (select *, left(o_orderpriority, 1) as s, cast(o_totalprice as decimal(20,2)) as t from orders left join customer on o_custkey = c_custkey left join l on o_orderkey = k)
select '25SYMV' || lpad(cast(o_orderkey as varchar), 9, '0') as adam, case s when '4' then 'PAYMENT' else 'CONTRACT' end as act_type,
  case when s = '3' or s = '4' then cost else t end as amount_net, case when s in ('1', '2') then t * 2 when s = '4' then t end as amount_gross,
  case when s in ('1', '2') then t when s = '4' then t - cost end as vat_amount, cast(o_orderdate as date) as submission_date, c_name as buyer,
  case when s <> '3' then lpad(cast(o_custkey as varchar), 9, '0') end as buyer_vat, case when s <> '5' then coalesce(who, '') end as contractors, cast(case when s = '5' then 0 else coalesce(codes, 0) end as int) as n_codes,
  case when s in ('1', '2', '3') then 'EL' || (c_nationkey + 100) else '' end as nuts_codes, case when s in ('1', '2') then '8Β2Ι465ΦΘΘ-ΛΜΝ' when s = '5' then '9Γ3Κ465ΦΘΘ-ΞΟΠ' else '' end as related_ada,
  case when s in ('1', '2', '3') then 'OPEN' end as procedure_type, case when s = '5' then 'OPS-1' end as funding from o""")  # fmt: skip
def canonical_acts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Acts of all payloads. Contractors as number:name, without repeats; those of the fifth shape (any one line's) left out."""
    source = records.parse(payloads(Lens(spark, sf_dir)), "payload")
    acts = [records.acts(source.where(F.col("resource") == r).select("record"), r) for r in ("contract", "payment")]
    a = acts[0].unionByName(acts[1])
    who = F.array_join(F.array_sort(F.array_distinct(F.transform("contractors", lambda p: F.concat(p["identifier"], F.lit(":"), p["name"])))), ",")
    single = F.col("public_funding_ref_ops").isNotNull()
    return a.select(
        "adam", "act_type", "amount_net", "amount_gross", "vat_amount", "submission_date", F.col("buyer.name").alias("buyer"), F.col("buyer.identifier").alias("buyer_vat"),
        F.when(~single, who).alias("contractors"), F.size("cpv_codes").alias("n_codes"), F.array_join("nuts_codes", ",").alias("nuts_codes"),
        F.array_join("related_ada", ",").alias("related_ada"), "procedure_type", F.col("public_funding_ref_ops").alias("funding"),
    )


@query("canonical_notices", """select 'N-' || o_orderkey as notice_id, p_name as title, c_name as buyer, 'GR' as buyer_country, lpad(cast(o_custkey as varchar), 9, '0') as buyer_vat, cast(o_totalprice as decimal(20,2)) as awarded_value,
  'EL' || (c_nationkey + 100) as nuts_codes, cast(o_orderdate as date) as publication_date, cast(cast(o_orderdate as date) + interval 30 day as timestamp) + interval 12 hour as submission_deadline,
  case when o_orderstatus = 'F' then 1.0 else 0.85 end as parse_confidence from orders join customer on o_custkey = c_custkey
  left join part on p_partkey = (select min(l_partkey) from lineitem where l_orderkey = o_orderkey)""")  # fmt: skip
def canonical_notices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """EU notices: localized titles and names, lists for single values, amounts as texts, deadlines by lot."""
    lens = Lens(spark, sf_dir)
    first = lens.table("lineitem", "l_orderkey", "l_partkey").groupBy("l_orderkey").agg(F.min("l_partkey").alias("p_partkey"))
    first = first.join(lens.table("part", "p_partkey", "p_name"), "p_partkey").select("l_orderkey", "p_name")
    o = lens.table("orders").join(lens.table("customer", "c_custkey", "c_name", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
    o = o.join(first, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    local = lambda c: F.create_map(F.lit("eng"), F.array(F.lit("x")), F.lit("ell"), F.array(c))
    day = F.to_date("o_orderdate")
    one = lambda c, name: F.array(c).alias(name)
    final = F.col("o_orderstatus") == "F"
    payload = F.to_json(F.struct(
        F.concat(F.lit("N-"), F.col("o_orderkey").cast("string")).alias("notice-identifier"), F.when(F.col("p_name").isNotNull(), local(F.col("p_name"))).alias("notice-title"),
        local(F.col("c_name")).alias("buyer-name"), one(F.concat(F.lit("EL"), _vat("o_custkey")), "buyer-identifier"), one(F.lit("grc"), "buyer-country"),
        one(F.regexp_replace(F.col("o_totalprice").cast("decimal(20,2)").cast("string"), r"\\.", ","), "result-value-notice"),
        one(F.format_string("el%d", F.col("c_nationkey") + 100), "place-of-performance"), F.concat(F.date_format(day, "yyyy-MM-dd"), F.lit("+02:00")).alias("publication-date"),
        F.array(*(F.date_format(F.date_add(day, n), "yyyy-MM-dd") for n in (40, 30))).alias("deadline-receipt-tender-date-lot"), F.array(F.lit("09:30:00"), F.lit("12:00:00")).alias("deadline-receipt-tender-time-lot"),
        F.when(final, F.lit("eforms-sdk-1.13")).alias("customization-id"),
    ))
    n = records.notices(records.parse(o.select(payload.alias("payload")), "payload").select("record"))
    return n.select(
        "notice_id", "title", F.col("buyer.name").alias("buyer"), F.col("buyer.country_code").alias("buyer_country"), F.col("buyer.vat").alias("buyer_vat"), "awarded_value",
        F.array_join("nuts_codes", ",").alias("nuts_codes"), "publication_date", F.col("submission_deadline").cast("timestamp_ntz").alias("submission_deadline"), "parse_confidence",
    )


@query("replaced_children", """with l as (select distinct l_orderkey as act_id, l_suppkey as item, 'SUPPLIER' as kind, l_linestatus as s from lineitem),
  v2 as (select o_orderkey as act_id from orders where o_orderstatus = 'F')
select distinct act_id, item, kind from l where act_id not in (select act_id from v2) or s = 'F'
union all select o_orderkey, o_custkey, 'PLACE' from orders where o_totalprice > 1000""")  # fmt: skip
def replaced_children(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers of acts in two versions: closed orders come again with their closed lines only, then the first batch once more
    (late, so it changes nothing). Places, which were found between, stay."""
    lens = Lens(spark, sf_dir)
    top = f"{shared_folder(spark)}/children-{uuid.uuid4().hex}"
    li = lens.table("lineitem", "l_orderkey", "l_suppkey", "l_linestatus")
    o = lens.table("orders", "o_orderkey", "o_orderstatus", "o_custkey", "o_totalprice")
    lines = lambda df, v: df.select(F.col("l_orderkey").alias("act_id"), F.lit(v).cast("long").alias("version"), F.col("l_suppkey").alias("item"), F.lit("SUPPLIER").alias("kind"))
    acts = lambda df, v: df.select(F.col("o_orderkey").alias("act_id"), F.lit(v).cast("long").alias("version"))
    places = o.where("o_totalprice > 1000").select(F.col("o_orderkey").alias("act_id"), F.lit(1).cast("long").alias("version"), F.col("o_custkey").alias("item"), F.lit("PLACE").alias("kind"))
    first = (acts(o, 1), lines(li, 1).unionByName(places))
    second = (acts(o.where("o_orderstatus = 'F'"), 2), lines(li.where("l_linestatus = 'F'"), 2))
    for parents, rows in (first, second, (acts(o.where("o_orderstatus = 'F'"), 1), lines(li, 1))):
        out = children.replace(spark, top, "act_children", parents, rows, "act_id", "version", kept=F.col("kind") == "PLACE")
    return out.select("act_id", "item", "kind")
