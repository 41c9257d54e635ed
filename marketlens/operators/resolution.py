"""Links by tier, representatives, entities by identifier, reversible merges, places, and orders of lists."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marketlens.functions import normalize as N
from marketlens.functions import text as T
from marketlens.lens import Lens, sql
from marketlens.operators.extractors import _VAT_OK, ADA, MIS, fields, notices
from marketlens.registry import query
from marketlens.session import checkpoint_folder


@query("decision_links", "select o_orderkey as id, o_orderkey as decision_id, cast(1.0 as double) as confidence from orders where o_orderkey % 3 = 0")
def decision_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Notices with the decision whose number they name, by equality of normalised numbers."""
    found = fields(notices(Lens(spark, sf_dir)), ADA).select("id", F.upper("value").alias("ada"))
    decisions = found.where("id % 3 = 0").select("ada", F.col("id").alias("decision_id"))
    return found.join(decisions, "ada").select("id", "decision_id", F.lit(1.0).alias("confidence"))


@query("funding_links", "select o_orderkey as id, o_custkey as programme_id, cast(0.95 as double) as confidence from orders join customer on o_custkey = c_custkey where c_acctbal > 0")
def funding_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Notices with the funded programme whose code of five to eight digits they name."""
    lens = Lens(spark, sf_dir)
    code = F.regexp_extract("value", "[0-9]{5,8}$", 0).cast("long")
    programmes = lens.table("customer", "c_custkey", "c_acctbal").where("c_acctbal > 0").select((F.col("c_custkey") + 5000000).alias("code"), F.col("c_custkey").alias("programme_id"))
    return fields(notices(lens), MIS).select("id", code.alias("code")).join(programmes, "code").select("id", "programme_id", F.lit(0.95).alias("confidence"))


def amount_band(c: Column, share: float) -> Column:
    """Bands so wide that amounts within ``share`` of each other are in the same or in neighbouring ones."""
    return F.floor(F.log(c.cast("double")) / math.log(1 / (1 - share)))


_GRAM = "list_distinct(flatten(list_transform(list_filter(string_split_regex(lower(title), '[^a-z0-9]+'), lambda w: w <> ''), lambda w: list_transform(range(1, length(w) + 2), lambda i: substr('  ' || w || ' ', i, 3)))))"


@query("link_title_amount", sql("""select act_id, min(other) as linked_id, cast(0.65 as double) as confidence from (select a.act_id, b.act_id as other from x a join x b on a.buyer_id = b.buyer_id and a.act_id <> b.act_id
    and a.amount_net > 0 and b.amount_net > 0 and abs(a.amount_net - b.amount_net) <= 0.15 * greatest(a.amount_net, b.amount_net) and 2 * len(list_intersect(a.g, b.g)) >= len(list_distinct(list_concat(a.g, b.g)))) group by 1 having count(*) = 1""",
  f"x as (select act_id, buyer_id, amount_net, {_GRAM} as g from eligible join prime using (act_id))"))
def link_title_amount(spark: SparkSession, sf_dir: str, share: float = 0.15) -> DataFrame:
    """Acts with exactly one other act of the same buyer, a like title and an amount within ``share``: for review. Amounts
    meet by bands, so a busy buyer's acts aren't all paired."""
    lens = Lens(spark, sf_dir)
    x = lens.eligible.where("amount_net > 0").join(lens.primary, "act_id").select("act_id", "buyer_id", "amount_net", T.trigrams(F.col("title")).alias("g"), amount_band(F.col("amount_net"), share).alias("band"))
    y = x.select(F.col("act_id").alias("other"), "buyer_id", F.col("amount_net").alias("amount"), F.col("g").alias("h"), F.explode(F.array(F.col("band") - 1, "band", F.col("band") + 1)).alias("band"))
    gap = F.abs(F.col("amount_net") - F.col("amount")) <= F.greatest("amount_net", "amount") * F.lit(share).cast("decimal(3,2)")
    near = x.join(y, ["buyer_id", "band"]).where((F.col("act_id") != F.col("other")) & gap & (T.set_similarity(F.col("g"), F.col("h")) >= 0.5))
    return near.groupBy("act_id").agg(F.min("other").alias("linked_id"), F.count("*").alias("n")).where("n = 1").select("act_id", "linked_id", F.lit(0.65).alias("confidence"))


@query("representative_acts", sql("select buyer_id, act_id from (select buyer_id, act_id, row_number() over (partition by buyer_id order by case status when 'F' then 1 when 'O' then 2 else 3 end, event_date, act_id) as rn from acts) where rn = 1"))
def representative_acts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The act that stands for each buyer: by priority of its state, then the earliest."""
    rank = F.when(F.col("status") == "F", 1).when(F.col("status") == "O", 2).otherwise(3)
    best = F.min(F.struct(rank.alias("rank"), "event_date", "act_id"))["act_id"]
    return Lens(spark, sf_dir).acts.groupBy("buyer_id").agg(best.alias("act_id"))


@query("fallback_candidates", sql("select buyer_id, count(*) as acts, max(struct_pack(d := event_date, a := act_id)).a as act_id from acts where act_id not in (select act_id from lines) group by 1"))
def fallback_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Buyers with acts that nothing is linked to, and the latest of these."""
    lens = Lens(spark, sf_dir)
    bare = lens.acts.join(lens.lines.select("act_id"), "act_id", "left_anti")
    return bare.groupBy("buyer_id").agg(F.count("*").alias("acts"), F.max(F.struct("event_date", "act_id"))["act_id"].alias("act_id"))


@query("entities_by_identifier", f"""with p as (select lpad(cast(o_custkey * 31 % 100000 as varchar), 9, '0') as v, o_orderkey from orders)
select v as identifier, count(*) as mentions, min(o_orderkey) as first_mention, case when {_VAT_OK} then 'FULL' else 'RESTRICTED' end as match_eligibility from p group by 1""")  # fmt: skip
def entities_by_identifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One entity for each normalised identifier; one with a wrong check sum is kept, but restricted in matching."""
    o = Lens(spark, sf_dir).table("orders", "o_orderkey", "o_custkey")
    raw = F.concat(F.lit(" el"), F.lpad((F.col("o_custkey") * 31 % 100000).cast("string"), 9, "0"))
    e = o.select(F.regexp_replace(F.upper(raw), "[^0-9]", "").alias("identifier"), "o_orderkey").groupBy("identifier").agg(F.count("*").alias("mentions"), F.min("o_orderkey").alias("first_mention"))
    return e.withColumn("match_eligibility", F.when(T.valid_vat(F.col("identifier")), "FULL").otherwise("RESTRICTED"))


def apply_merges(entities: DataFrame, merges: DataFrame) -> DataFrame:
    """(id, master): entities (id, identifier) after merges (id, into, reverted), one row each.

    A merge of two different identifiers is refused, a reverted one leaves the entity as it was. Of several live merges of an
    entity the one into the least id counts. Chains are followed to their end; entities that merge in a circle get the least
    id of the circle. Each turn doubles the length of the steps, so turns grow with the logarithm of the longest chain.
    """
    checkpoint_folder(entities.sparkSession)
    other = entities.select(F.col("id").alias("into"), F.col("identifier").alias("other"))
    live = merges.where("not reverted and id <> into").join(entities, "id").join(other, "into").where("identifier is null or other is null or identifier = other")
    one = live.groupBy("id").agg(F.min("into").alias("to"))
    step = entities.select("id").join(one, "id", "left").select("id", F.coalesce("to", "id").alias("to"), F.least("id", F.coalesce("to", "id")).alias("least"), F.col("to").isNull().alias("done")).checkpoint()
    most = step.where("not done").count()
    for _ in range(most.bit_length() + 1):
        if not step.where("not done").limit(1).count():
            return step.select("id", F.col("to").alias("master"))
        ahead = step.select(F.col("id").alias("to"), F.col("to").alias("far"), F.col("least").alias("low"), F.col("done").alias("there"))
        moved = step.where("not done").join(ahead, "to").select("id", F.col("far").alias("to"), F.least("least", "low").alias("least"), F.col("there").alias("done"))
        step = step.where("done").unionByName(moved).checkpoint()
    # what isn't done leads to a circle, and a step of this length has gone round it
    round_ = step.where("not done").select(F.col("id").alias("to"), F.col("least").alias("low"))
    return step.join(round_, "to", "left").select("id", F.when(F.col("done"), F.col("to")).otherwise(F.col("low")).alias("master"))


@query("merged_entities", "select c_custkey as id, case when c_custkey % 10 = 1 and c_custkey > 1 and c_custkey % 20 <> 1 and c_nationkey % 2 = 0 then c_custkey - 1 else c_custkey end as master from customer")
def merged_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every tenth customer merged into the one before; every second of these merges was undone."""
    c = Lens(spark, sf_dir).table("customer", "c_custkey", "c_nationkey")
    identifier = F.when((F.col("c_custkey") % 10 != 1) | (F.col("c_nationkey") % 2 == 1), F.concat(F.lit("X"), F.col("c_custkey").cast("string")))
    merges = c.where("c_custkey % 10 = 1 and c_custkey > 1").select(F.col("c_custkey").alias("id"), (F.col("c_custkey") - 1).alias("into"), (F.col("c_custkey") % 20 == 1).alias("reverted"))
    return apply_merges(c.select(F.col("c_custkey").alias("id"), identifier.alias("identifier")), merges)


@query("edges_touching", """with e as (select distinct user_id as a, 100000 + cast(json_extract(props, '$.k') as bigint) as b from events) select id, count(*) as edges from (select a as id, a, b from e union select b, a, b from e) group by 1""")
def edges_touching(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges that touch a node at either end: both ends exploded, in place of a join with OR."""
    k = (F.get_json_object("props", "$.k").cast("long") + 100000).alias("b")
    e = Lens(spark, sf_dir).table("events", "user_id", "props").select(F.col("user_id").alias("a"), k).distinct()
    return e.select(F.explode(F.array_distinct(F.array("a", "b"))).alias("id")).groupBy("id").agg(F.count("*").alias("edges"))


@query("predecessors", """select act_id, count(distinct before) as predecessors from (select case when event_type in ('view', 'click') then user_id else 100000 + cast(json_extract(props, '$.k') as bigint) end as act_id,
  case when event_type in ('view', 'click') then 100000 + cast(json_extract(props, '$.k') as bigint) else user_id end as before from events) group by 1""")  # fmt: skip
def predecessors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges whose kind says which end came before, brought to (act, predecessor) first."""
    k = F.get_json_object("props", "$.k").cast("long") + 100000
    down = F.col("event_type").isin("view", "click")
    e = Lens(spark, sf_dir).table("events", "user_id", "event_type", "props")
    edges = e.select(F.when(down, F.col("user_id")).otherwise(k).alias("act_id"), F.when(down, k).otherwise(F.col("user_id")).alias("before"))
    return edges.groupBy("act_id").agg(F.countDistinct("before").alias("predecessors"))


@query("ranked_identifiers", """select o_orderkey as id, o_orderpriority like '1%' as urgent, ['ADAM', 'ADA', 'OTHER'][cast(o_orderkey % 3 as int) + 1] as scheme from orders
  order by urgent desc, case scheme when 'ADAM' then 1 when 'ADA' then 2 else 3 end, id limit 50""")  # fmt: skip
def ranked_identifiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Top 50 by a flag first, then by the rank of the scheme."""
    o = Lens(spark, sf_dir).table("orders", "o_orderkey", "o_orderpriority")
    scheme = F.element_at(F.array(F.lit("ADAM"), F.lit("ADA"), F.lit("OTHER")), (F.col("o_orderkey") % 3).cast("int") + 1)
    x = o.select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").startswith("1").alias("urgent"), scheme.alias("scheme"))
    rank = F.when(F.col("scheme") == "ADAM", 1).when(F.col("scheme") == "ADA", 2).otherwise(3)
    return x.orderBy(F.desc("urgent"), rank, "id").limit(50)


def tenant_rows(df: DataFrame, tenant: int | None, column: str = "tenant_id") -> DataFrame:
    """Rows of one tenant. A tenant must be named: without one nothing may be read."""
    if tenant is None:
        raise PermissionError("a tenant must be named")
    return df.where(F.col(column) == F.lit(tenant))


@query("tenant_events", "select event_type, count(*) as n, sum(case when value > 50 then 1 else 0 end) as high from events where user_id % 3 = 1 group by 1")
def tenant_events(spark: SparkSession, sf_dir: str, tenant: int = 1) -> DataFrame:
    e = Lens(spark, sf_dir).table("events", "user_id", "event_type", "value").withColumn("tenant_id", F.col("user_id") % 3)
    return tenant_rows(e, tenant).groupBy("event_type").agg(F.count("*").alias("n"), F.sum(F.when(F.col("value") > 50, 1).otherwise(0)).alias("high"))


@query("geocoded_locations", sql("""select r_name as label, round(n_nationkey * 1.2345678::double, 5) as lat, round(n_nationkey * -0.7654321::double, 5) as lon, count(distinct act_id) as acts, sum(amount_net) as amount, min(0.5::double + n_nationkey % 5 * 0.1::double) as confidence
  from acts join customer on buyer_id = c_custkey join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey where 0.5 + n_nationkey % 5 * 0.1 >= 0.6 group by all"""))  # fmt: skip
def geocoded_locations(spark: SparkSession, sf_dir: str, least: float = 0.6) -> DataFrame:
    """Acts and amounts by rounded place, of places found with a least confidence."""
    lens = Lens(spark, sf_dir)
    k = F.col("n_nationkey")
    places = lens.table("nation").join(lens.table("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    places = places.select("n_nationkey", F.col("r_name").alias("label"), F.round(k * 1.2345678, 5).alias("lat"), F.round(k * -0.7654321, 5).alias("lon"), (0.5 + k % 5 * 0.1).alias("confidence")).where(F.col("confidence") >= least)
    at = lens.table("customer", "c_custkey", "c_nationkey").join(places, F.col("c_nationkey") == F.col("n_nationkey"))
    acts = lens.acts.select("act_id", "amount_net", "buyer_id").join(at, F.col("buyer_id") == F.col("c_custkey"))
    return acts.groupBy("label", "lat", "lon").agg(F.countDistinct("act_id").alias("acts"), F.sum("amount_net").alias("amount"), F.min("confidence").alias("confidence"))


def match_boundaries(candidates: DataFrame, units: DataFrame) -> DataFrame:
    """(id, unit, score, confidence): the best unit (unit, name) of each named place (id, name): 100 for the same name, 80
    for a name of five characters or more that is part of it. Names meet by equality, parts by the words of a name."""
    c = candidates.withColumn("place", N.place(F.col("name"))).select("id", "place")
    u = units.withColumn("unit_place", N.place(F.col("name"))).select("unit", "unit_place")
    same = c.join(u, F.col("place") == F.col("unit_place")).select("id", "unit", F.lit(100).alias("score"))
    word = F.split("unit_place", " ")[0]
    part = c.select("id", "place", F.explode(F.array_distinct(F.split("place", " "))).alias("w")).join(u.withColumn("w", word), "w")
    part = part.where((F.char_length("unit_place") >= 5) & F.contains(F.concat(F.lit(" "), "place", F.lit(" ")), F.concat(F.lit(" "), "unit_place", F.lit(" ")))).select("id", "unit", F.lit(80).alias("score"))
    best = same.unionByName(part).groupBy("id").agg(F.min(F.struct((-F.col("score")).alias("s"), "unit")).alias("b"))
    return best.select("id", "b.unit", (-F.col("b.s")).alias("score"), F.when(F.col("b.s") == -100, 0.98).otherwise(0.88).alias("confidence"))


@query("boundary_matches", """select c_custkey as id, n_nationkey as unit, cast(case when c_custkey % 2 = 0 then 100 else 80 end as int) as score, case when c_custkey % 2 = 0 then 0.98 else 0.88 end::double as confidence
  from customer join nation on c_nationkey = n_nationkey where c_custkey % 2 = 0 or length(n_name) >= 5""")  # fmt: skip
def boundary_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    lens = Lens(spark, sf_dir)
    n = lens.table("nation", "n_nationkey", "n_name")
    c = lens.table("customer", "c_custkey", "c_nationkey").join(n, F.col("c_nationkey") == F.col("n_nationkey"))
    name = F.when(F.col("c_custkey") % 2 == 0, F.lower("n_name")).otherwise(F.concat(F.lit("Municipality of "), "n_name", F.lit(" (north)")))
    return match_boundaries(c.select(F.col("c_custkey").alias("id"), name.alias("name")), n.select(F.col("n_nationkey").alias("unit"), F.col("n_name").alias("name")))


def market_score(codes: Column, prefixes: Column, keywords: Column, same_place: Column, awards: Column, buyers: Column) -> Column:
    """Likeness of a competitor's market, 20 to 100: codes, words, place, how many awards, shared buyers."""
    s = F.lit(20) + F.when(codes, 35).when(prefixes, 28).when(keywords, 18).otherwise(0) + F.when(same_place, 15).otherwise(7)
    return F.least(F.lit(100), s + F.least(F.lit(15), 7 + 2 * awards) + F.when(buyers > 0, 10).otherwise(0))


@query("competitor_similarity", sql("""select supplier_id, cast(least(100, 20 + case when codes then 35 when prefixes then 28 when words then 18 else 0 end + case when s_nationkey < 5 then 15 else 7 end + least(15, 7 + 2 * awards)
    + case when buyers > 0 then 10 else 0 end) as bigint) as score from s join supplier on supplier_id = s_suppkey""", """s as (select supplier_id, bool_or(cpv_code = 'Brand#11') as codes, bool_or(cpv_prefix like 'STANDARD%') as prefixes, bool_or(lower(title) like '%green%') as words, count(distinct act_id) as awards, count(distinct buyer_id) as buyers
    from suppliers join prime using (act_id) join acts using (act_id) group by 1)"""))  # fmt: skip
def competitor_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    lens = Lens(spark, sf_dir)
    x = lens.suppliers.join(lens.primary, "act_id").join(lens.acts.select("act_id", "buyer_id"), "act_id")
    s = x.groupBy("supplier_id").agg(
        F.bool_or(F.col("cpv_code") == "Brand#11").alias("codes"), F.bool_or(F.col("cpv_prefix").startswith("STANDARD")).alias("prefixes"), F.bool_or(F.contains(F.lower("title"), F.lit("green"))).alias("words"),
        F.countDistinct("act_id").alias("awards"), F.countDistinct("buyer_id").alias("buyers"),
    )
    s = s.join(lens.table("supplier", F.col("s_suppkey").alias("supplier_id"), "s_nationkey"), "supplier_id")
    score = market_score(F.col("codes"), F.col("prefixes"), F.col("words"), F.col("s_nationkey") < 5, F.col("awards"), F.col("buyers"))
    return s.select("supplier_id", score.cast("long").alias("score"))
