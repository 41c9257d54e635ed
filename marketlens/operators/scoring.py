"""Fit scores, rule matching, opportunity scores, similarity and recommendations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marketlens.functions.text import trigram_similarity
from marketlens.lens import Lens, sql, today
from marketlens.registry import query


#: Alert rules as rows: id, code prefix, place prefix, keyword, least and greatest amount (null amounts fail closed).
RULES = (
    (1, "Brand#1", None, None, 100000.0, None),
    (2, None, "N0", "red", None, 200000.0),
    (3, "Brand#4", "N1", None, None, None),
    (4, None, None, "green", 50000.0, 150000.0),
)
_RULE_VALUES = "rules(rule_id, code, nuts, word, lo, hi) as (values " + ", ".join("(" + ", ".join("null" if v is None else f"'{v}'" if isinstance(v, str) else str(v) for v in r) + ")" for r in RULES) + ")"


def contexts(lens: Lens) -> DataFrame:
    """What rules look at: one row per act with primary code, title, place, value, date."""
    place = lens.locations.groupBy("act_id").agg(F.min("nuts_code").alias("nuts_code"))
    return lens.eligible.join(lens.primary, "act_id").join(place, "act_id", "left")


_CTX = "ctx as (select e.*, cpv_code, cpv_prefix, title, nuts_code from eligible e join prime using (act_id) left join (select act_id, min(nuts_code) as nuts_code from locations group by 1) using (act_id))"
_HIT = "(code is null or starts_with(cpv_code, code)) and (nuts is null or starts_with(nuts_code, nuts)) and (word is null or contains(lower(title), word)) and (lo is null or amount_net >= lo) and (hi is null or amount_net <= hi)"


def rule_frame(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(RULES, "rule_id int, code string, nuts string, word string, lo double, hi double")


def matches(ctx: DataFrame, rules: DataFrame) -> DataFrame:
    """Acts times rules that fit. Rules are a tenant's few settings: their frame is broadcast, acts are streamed past it."""
    ok = lambda p, cond: F.col(p).isNull() | cond
    v = F.col("amount_net").cast("double")
    hit = ok("code", F.col("cpv_code").startswith(F.col("code"))) & ok("nuts", F.col("nuts_code").startswith(F.col("nuts"))) & ok("word", F.contains(F.lower("title"), F.col("word"))) & ok("lo", v >= F.col("lo")) & ok("hi", v <= F.col("hi"))
    return ctx.join(F.broadcast(rules), hit)


@query("rule_matches", sql(f"select act_id, rule_id from ctx, rules where {_HIT}", _CTX, _RULE_VALUES))
def rule_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matches(contexts(Lens(spark, sf_dir)), rule_frame(spark)).select("act_id", "rule_id")


@query("rule_preview", sql(f"select rule_id, count(*) as acts, cast(sum(amount_net) as decimal(30,2)) as value, max(event_date) as latest from ctx, rules where {_HIT} group by 1", _CTX, _RULE_VALUES))
def rule_preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matches(contexts(Lens(spark, sf_dir)), rule_frame(spark)).groupBy("rule_id").agg(F.count("*").alias("acts"), F.sum("amount_net").cast("decimal(30,2)").alias("value"), F.max("event_date").alias("latest"))


@query("opportunities_fit", sql("""select act_id, title, amount_net, least(100.0, 25.0 + case when act_id in (select act_id from codes where starts_with(cpv_code, 'Brand#2')) then 30 else 0 end + case when starts_with(nuts_code, 'N1') then 20 else 0 end
    + case when amount_net >= 150000 then 10 else 0 end + case when status = 'P' then 10 when status = 'O' then 5 else 0 end + case when event_date >= date '2001-07-01' then 5 else 0 end) as fit_score
  from ctx where status in ('O', 'P') order by fit_score desc, amount_net desc, act_id limit 50""", _CTX))  # fmt: skip
def opportunities_fit(spark: SparkSession, sf_dir: str, limit: int = 50) -> DataFrame:
    """Open notices and requests by quick fit: 25, +30 code, +20 place, +10 value, +10 notice or +5 request, +5 open deadline."""
    lens = Lens(spark, sf_dir)
    hit = lens.codes.where(F.col("cpv_code").startswith("Brand#2")).select("act_id").distinct().withColumn("code_hit", F.lit(True))
    c = contexts(lens).where(F.col("status").isin("O", "P")).join(hit, "act_id", "left")
    score = (
        F.lit(25.0) + F.when(F.col("code_hit"), 30).otherwise(0) + F.when(F.col("nuts_code").startswith("N1"), 20).otherwise(0) + F.when(F.col("amount_net") >= 150000, 10).otherwise(0)
        + F.when(F.col("status") == "P", 10).when(F.col("status") == "O", 5).otherwise(0) + F.when(F.col("event_date") >= F.lit("2001-07-01").cast("date"), 5).otherwise(0)
    )
    return c.select("act_id", "title", "amount_net", F.least(F.lit(100.0), score).alias("fit_score")).orderBy(F.desc("fit_score"), F.desc("amount_net"), "act_id").limit(limit)


_SCORE_PARTS = """parts as (
  select c.act_id, r.rule_id, case when r.code is null then 50.0 when starts_with(c.cpv_code, r.code) then 100.0 else 0.0 end as code_score,
    least(100.0, 20.0 * b.n) as buyer_score, case when age is null then 30 when age <= 7 then 100 when age <= 30 then 85 when age <= 90 then 65 else 40 end * 1.0 as timing_score,
    case when coalesce(k, 0) = 0 then 60 when k <= 2 then 90 when k <= 4 then 70 else 40 end * 1.0 as competition_score,
    case when c.amount_net is null then 35 when r.lo is null and r.hi is null then 60 when (r.lo is null or c.amount_net >= r.lo) and (r.hi is null or c.amount_net <= r.hi) then 100 else 20 end * 1.0 as value_score,
    (20 + 20 + 20 + case when nuts_code is not null then 20 else 0 end + case when c.amount_net is not null then 10 else 0 end + case when k is not null then 10 else 0 end) * 1.0 as confidence_score
  from (select *, date_diff('day', event_date, date '2001-08-01') as age from ctx where status in ('O', 'P')) c cross join rules r
  join (select buyer_id, count(*) as n from eligible group by 1) b using (buyer_id) left join (select act_id, count(*) as k from suppliers group by 1) s using (act_id)),
scored as (select *, round(0.25 * code_score + 0.2 * buyer_score + 0.15 * timing_score + 0.15 * competition_score + 0.15 * value_score + 0.1 * confidence_score, 2) as score from parts)"""


@query("opportunity_scores", sql("select act_id, rule_id, score from (select *, row_number() over (partition by act_id order by score desc, rule_id) as rn from scored) where rn = 1", _CTX, _RULE_VALUES, _SCORE_PARTS))
def opportunity_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weighted sub-scores of open acts under each rule; the best rule wins, the first of equals."""
    lens = Lens(spark, sf_dir)
    n = lens.eligible.groupBy("buyer_id").agg(F.count("*").alias("n"))
    k = lens.suppliers.groupBy("act_id").agg(F.count("*").alias("k"))
    c = contexts(lens).where(F.col("status").isin("O", "P")).join(n, "buyer_id").join(k, "act_id", "left").withColumn("age", F.datediff(today(), F.col("event_date")))
    c = c.crossJoin(F.broadcast(rule_frame(spark)))
    v = F.col("amount_net").cast("double")
    code = F.when(F.col("code").isNull(), 50.0).when(F.col("cpv_code").startswith(F.col("code")), 100.0).otherwise(0.0)
    buyer = F.least(F.lit(100.0), 20.0 * F.col("n"))
    timing = F.when(F.col("age").isNull(), 30.0).when(F.col("age") <= 7, 100.0).when(F.col("age") <= 30, 85.0).when(F.col("age") <= 90, 65.0).otherwise(40.0)
    competition = F.when(F.coalesce("k", F.lit(0)) == 0, 60.0).when(F.col("k") <= 2, 90.0).when(F.col("k") <= 4, 70.0).otherwise(40.0)
    inside = (F.col("lo").isNull() | (v >= F.col("lo"))) & (F.col("hi").isNull() | (v <= F.col("hi")))
    value = F.when(F.col("amount_net").isNull(), 35.0).when(F.col("lo").isNull() & F.col("hi").isNull(), 60.0).when(inside, 100.0).otherwise(20.0)
    sure = 60.0 + F.when(F.col("nuts_code").isNotNull(), 20.0).otherwise(0.0) + F.when(F.col("amount_net").isNotNull(), 10.0).otherwise(0.0) + F.when(F.col("k").isNotNull(), 10.0).otherwise(0.0)
    score = F.round(0.25 * code + 0.2 * buyer + 0.15 * timing + 0.15 * competition + 0.15 * value + 0.1 * sure, 2)
    best = F.max(F.struct(score.alias("score"), (-F.col("rule_id")).alias("r")))
    return c.groupBy("act_id").agg(best.alias("b")).select("act_id", (-F.col("b.r")).alias("rule_id"), F.col("b.score").alias("score"))


@query("similar_contracts", sql("""select other_id, round(sim, 4) as similarity from (
    select b.act_id as other_id, 0.45 * case when b.cpv_code = a.cpv_code then 1.0 else 0 end + 0.3 * case when b.buyer_id = a.buyer_id then 1 else 0 end + 0.15 * coalesce(len(list_intersect(a.g, b.g)) / nullif(len(list_distinct(list_concat(a.g, b.g))), 0), 0)
      + 0.1 * case when b.amount_net between a.amount_net * 0.6 and a.amount_net * 1.4 then 1 else 0 end as sim
    from g a, g b where a.act_id = (select min(act_id) from g) and b.act_id <> a.act_id and (b.cpv_code = a.cpv_code or b.buyer_id = a.buyer_id)) order by sim desc, other_id limit 25""", _CTX, """g as (select *, list_distinct(flatten(list_transform(list_filter(string_split_regex(lower(title), '[^a-z0-9]+'), lambda w: w <> ''),
  lambda w: list_transform(range(1, length(w) + 2), lambda i: substr('  ' || w || ' ', i, 3))))) as g from ctx)"""))  # fmt: skip
def similar_contracts(spark: SparkSession, sf_dir: str, limit: int = 25) -> DataFrame:
    """Contracts like the first one: same code, same buyer, like title, like value. The target is one row; candidates come by
    equal code or buyer, never by a join of all with all."""
    c = contexts(Lens(spark, sf_dir))
    first = c.agg(F.min(F.struct("act_id", "cpv_code", "buyer_id", "title", "amount_net")).alias("t")).select("t.*")
    t = first.select(*(F.col(x).alias(f"t_{x}") for x in first.columns))
    j = c.join(F.broadcast(t), ((F.col("cpv_code") == F.col("t_cpv_code")) | (F.col("buyer_id") == F.col("t_buyer_id"))) & (F.col("act_id") != F.col("t_act_id")))
    near = F.col("amount_net").between(F.col("t_amount_net") * F.lit(0.6).cast("decimal(2,1)"), F.col("t_amount_net") * F.lit(1.4).cast("decimal(2,1)"))
    one = lambda cond: F.when(cond, 1.0).otherwise(0.0)
    sim = 0.45 * one(F.col("cpv_code") == F.col("t_cpv_code")) + 0.3 * one(F.col("buyer_id") == F.col("t_buyer_id")) + 0.15 * trigram_similarity(F.col("title"), F.col("t_title")) + 0.1 * one(near)
    return j.select(F.col("act_id").alias("other_id"), sim.alias("s")).orderBy(F.desc("s"), "other_id").limit(limit).select("other_id", F.round("s", 4).alias("similarity"))


@query("bid_recommendation", sql("""select act_id, case when blockers > 0 or score < 35 then 'NO_BID' when score >= 60 and conf >= 55 then 'BID' else 'CONDITIONAL' end as recommendation, round(0.65 * score + 0.35 * conf, 2) as confidence
  from (select act_id, max(score) as score, max(confidence_score) as conf, max(case when act_id in (select act_id from issues) then 1 else 0 end) as blockers from scored group by 1)""", _CTX, _RULE_VALUES, _SCORE_PARTS))  # fmt: skip
def bid_recommendation(spark: SparkSession, sf_dir: str) -> DataFrame:
    lens = Lens(spark, sf_dir)
    k = lens.suppliers.groupBy("act_id").agg(F.count("*").alias("k"))
    c = contexts(lens).select("act_id", "nuts_code", "amount_net").join(k, "act_id", "left").join(lens.issues.withColumn("blocked", F.lit(True)), "act_id", "left")
    conf = 60.0 + F.when(F.col("nuts_code").isNotNull(), 20.0).otherwise(0.0) + F.when(F.col("amount_net").isNotNull(), 10.0).otherwise(0.0) + F.when(F.col("k").isNotNull(), 10.0).otherwise(0.0)
    s = opportunity_scores(spark, sf_dir).join(c, "act_id").withColumn("conf", conf)
    rec = F.when(F.coalesce("blocked", F.lit(False)) | (F.col("score") < 35), "NO_BID").when((F.col("score") >= 60) & (F.col("conf") >= 55), "BID").otherwise("CONDITIONAL")
    return s.select("act_id", rec.alias("recommendation"), F.round(0.65 * F.col("score") + 0.35 * F.col("conf"), 2).alias("confidence"))


# --- competitors and relationships ---


@query("consortium_partners", sql("select a.supplier_id, b.supplier_id as partner_id, count(*) as contracts, cast(sum(a.amount + b.amount) as decimal(30,4)) as value from suppliers a join suppliers b using (act_id) where a.supplier_id < b.supplier_id and act_id in (select act_id from eligible) group by all having count(*) >= 2"))
def consortium_partners(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers that share contracts: a self-join within a contract, whose parties are few."""
    lens = Lens(spark, sf_dir)
    s = lens.eligible.select("act_id").join(lens.suppliers, "act_id")
    t = s.select("act_id", F.col("supplier_id").alias("partner_id"), F.col("amount").alias("other"))
    g = s.join(t, "act_id").where("supplier_id < partner_id").groupBy("supplier_id", "partner_id")
    return g.agg(F.count("*").alias("contracts"), F.sum(F.col("amount") + F.col("other")).cast("decimal(30,4)").alias("value")).where("contracts >= 2")


@query("relationship_edges", sql("""select 'C' || buyer_id as source, 'S' || supplier_id as target, 'AWARDED_TO' as kind, cast(sum(amount) as decimal(30,4)) as value, max(event_date) as latest from eligible join suppliers using (act_id) group by all having sum(amount) >= 100000
  union all select 'C' || buyer_id, 'M' || cpv_prefix, 'PROCURES', cast(sum(amount_net) as decimal(30,4)), max(event_date) from eligible join prime using (act_id) group by buyer_id, cpv_prefix having sum(amount_net) >= 300000"""))  # fmt: skip
def relationship_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    lens = Lens(spark, sf_dir)
    node = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    sup = lens.eligible.join(lens.suppliers, "act_id").groupBy(node("C", "buyer_id").alias("source"), node("S", "supplier_id").alias("target")).agg(F.lit("AWARDED_TO").alias("kind"), F.sum("amount").cast("decimal(30,4)").alias("value"), F.max("event_date").alias("latest")).where("value >= 100000")
    mk = lens.eligible.join(lens.primary, "act_id").groupBy(node("C", "buyer_id").alias("source"), node("M", "cpv_prefix").alias("target")).agg(F.lit("PROCURES").alias("kind"), F.sum("amount_net").cast("decimal(30,4)").alias("value"), F.max("event_date").alias("latest")).where("value >= 300000")
    return sup.unionByName(mk)


_FACTS = "facts as (select distinct s.supplier_id, e.act_id, e.buyer_id, p.cpv_prefix, l.nuts_code, s.amount, e.event_date from eligible e join suppliers s using (act_id) join prime p using (act_id) left join locations l using (act_id))"


def facts(lens: Lens) -> DataFrame:
    return lens.eligible.select("act_id", "buyer_id", "event_date").join(lens.suppliers, "act_id").join(lens.primary.select("act_id", "cpv_prefix"), "act_id").join(lens.locations.select("act_id", "nuts_code"), "act_id", "left").distinct()


@query("competitor_discover", sql("""select f.supplier_id, count(distinct f.act_id) as awards, cast(sum(f.amount) as decimal(30,4)) as value, count(distinct f.buyer_id) filter (f.buyer_id in (select buyer_id from facts where supplier_id = 1)) as shared_buyers, count(distinct f.nuts_code) as places
  from facts f where f.supplier_id <> 1 and f.cpv_prefix in (select cpv_prefix from facts where supplier_id = 1) group by 1 order by shared_buyers desc, value desc, supplier_id limit 30""", _FACTS))  # fmt: skip
def competitor_discover(spark: SparkSession, sf_dir: str, company: int = 1, limit: int = 30) -> DataFrame:
    """Suppliers in a company's markets, by how many of its buyers they serve."""
    f = facts(Lens(spark, sf_dir))
    own = f.where(F.col("supplier_id") == company)
    shared = own.select("buyer_id").distinct().withColumn("own", F.lit(True))
    others = f.where(F.col("supplier_id") != company).join(own.select("cpv_prefix").distinct(), "cpv_prefix", "left_semi").join(shared, "buyer_id", "left")
    g = others.groupBy("supplier_id").agg(F.countDistinct("act_id").alias("awards"), F.sum("amount").cast("decimal(30,4)").alias("value"), F.countDistinct(F.when(F.col("own"), F.col("buyer_id"))).alias("shared_buyers"), F.countDistinct("nuts_code").alias("places"))
    return g.orderBy(F.desc("shared_buyers"), F.desc("value"), "supplier_id").limit(limit)


@query("competitor_activity_latest", sql("select supplier_id, act_id, event_date, amount from (select *, row_number() over (partition by supplier_id order by event_date desc, amount desc, act_id) as rn from facts) where rn = 1", _FACTS))
def competitor_activity_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("supplier_id").orderBy(F.desc("event_date"), F.desc("amount"), "act_id")
    return facts(Lens(spark, sf_dir)).withColumn("rn", F.row_number().over(w)).where("rn = 1").select("supplier_id", "act_id", "event_date", "amount")


@query("head_to_head", sql("select buyer_id, cpv_prefix from facts where supplier_id = 1 intersect select buyer_id, cpv_prefix from facts where supplier_id = 2", _FACTS))
def head_to_head(spark: SparkSession, sf_dir: str, a: int = 1, b: int = 2) -> DataFrame:
    f = facts(Lens(spark, sf_dir))
    of = lambda s: f.where(F.col("supplier_id") == s).select("buyer_id", "cpv_prefix")
    return of(a).intersect(of(b))


@query("likely_competitors", sql("""select supplier_id, bool_or(buyer_id = b) as same_buyer, bool_or(cpv_prefix = c) as same_market, cast(case when bool_or(buyer_id = b) then 0.72 else 0.56 end as double) as likelihood, count(distinct act_id) as contracts
  from facts, (select buyer_id as b, cpv_prefix as c, act_id as a from eligible join prime using (act_id) where act_id = (select min(act_id) from eligible join prime using (act_id))) where act_id <> a and (buyer_id = b or cpv_prefix = c) group by 1""", _FACTS))  # fmt: skip
def likely_competitors(spark: SparkSession, sf_dir: str) -> DataFrame:
    lens = Lens(spark, sf_dir)
    f = facts(lens)
    one = lens.eligible.join(lens.primary, "act_id").agg(F.min(F.struct("act_id", "buyer_id", "cpv_prefix")).alias("t")).select(F.col("t.act_id").alias("a"), F.col("t.buyer_id").alias("b"), F.col("t.cpv_prefix").alias("c"))
    j = f.join(F.broadcast(one), (F.col("act_id") != F.col("a")) & ((F.col("buyer_id") == F.col("b")) | (F.col("cpv_prefix") == F.col("c"))))
    same = F.bool_or(F.col("buyer_id") == F.col("b"))
    return j.groupBy("supplier_id").agg(same.alias("same_buyer"), F.bool_or(F.col("cpv_prefix") == F.col("c")).alias("same_market"), F.when(same, 0.72).otherwise(0.56).alias("likelihood"), F.countDistinct("act_id").alias("contracts"))


@query("eu_benchmarks", sql("""select nuts_code as country, cpv_prefix, count(distinct act_id) as notices, count(distinct case when amount_net is not null then act_id end) as valued, cast(sum(amount_net) as decimal(30,2)) as total, round(quantile_cont(cast(amount_net as double), 0.5), 4) as median,
  round(100.0 * count(distinct case when amount_net is not null then act_id end) / count(distinct act_id), 2) as coverage from (select distinct act_id, nuts_code, cpv_prefix, amount_net from eligible join codes using (act_id) join locations using (act_id)) group by all"""))  # fmt: skip
def eu_benchmarks(spark: SparkSession, sf_dir: str) -> DataFrame:
    lens = Lens(spark, sf_dir)
    d = lens.eligible.select("act_id", "amount_net").join(lens.codes.select("act_id", "cpv_prefix"), "act_id").join(lens.locations.select("act_id", "nuts_code"), "act_id").distinct()
    valued = F.countDistinct(F.when(F.col("amount_net").isNotNull(), F.col("act_id")))
    return d.groupBy(F.col("nuts_code").alias("country"), "cpv_prefix").agg(F.countDistinct("act_id").alias("notices"), valued.alias("valued"), F.sum("amount_net").cast("decimal(30,2)").alias("total"), F.round(F.percentile(F.col("amount_net").cast("double"), 0.5), 4).alias("median"), F.round(100.0 * valued / F.countDistinct("act_id"), 2).alias("coverage"))


@query("export_relationships", sql("select supplier_id, string_agg(distinct cpv_prefix, '; ' order by cpv_prefix) as markets, string_agg(distinct nuts_code, '; ' order by nuts_code) as places, cast(sum(amount) as decimal(30,4)) as value from facts group by 1", _FACTS))
def export_relationships(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = lambda c: F.array_join(F.array_sort(F.collect_set(c)), "; ")
    return facts(Lens(spark, sf_dir)).groupBy("supplier_id").agg(joined("cpv_prefix").alias("markets"), joined("nuts_code").alias("places"), F.sum("amount").cast("decimal(30,4)").alias("value"))
