"""What a new tenant sees first: quality of its profile, ranked first opportunities, its opportunity list, search catalogues."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marketlens.lens import Lens, sql
from marketlens.operators import scoring
from marketlens.registry import query

# Codes of findings.
SHORT, NO_CODE, NO_WORDS, FEW_FOUND = "DESCRIPTION_TOO_SHORT", "NO_CPV_CONFIRMED", "NO_KEYWORDS", "LOW_INITIAL_COVERAGE"


def quality(words: Column, codes: Column, terms: Column, found: Column) -> Column:
    """(score, findings) of a profile from its words of description, codes, terms and opportunities found; nulls count as 0."""
    words, codes, terms, found = (F.coalesce(c, F.lit(0)) for c in (words, codes, terms, found))
    described = F.when(words >= 12, 30).otherwise(0)
    coded = F.when(codes > 0, F.least(F.lit(35), 20 + 3 * codes)).otherwise(0)
    termed = F.when(terms > 0, F.least(F.lit(15), 5 + 2 * terms)).otherwise(0)
    covered = F.least(F.lit(20), 2 * F.greatest(found, F.lit(0)))
    score = F.least(F.lit(100.0), (described + coded + termed + covered).cast("double"))
    gaps = [(words < 12, SHORT), (codes <= 0, NO_CODE), (terms <= 0, NO_WORDS), (found < 3, FEW_FOUND)]
    findings = F.concat_ws(",", *(F.when(gap, F.lit(code)) for gap, code in gaps))
    return F.struct(score.alias("score"), findings.alias("findings"))


@query("profile_quality", sql("""select supplier_id,
    cast(least(100, case when w >= 12 then 30 else 0 end + least(35, 20 + 3 * c) + least(15, 5 + 2 * t) + least(20, 2 * f)) as double) as score,
    concat_ws(',', case when w < 12 then 'DESCRIPTION_TOO_SHORT' end, case when f < 3 then 'LOW_INITIAL_COVERAGE' end) as findings
  from (select supplier_id, max(len(string_split(title, ' '))) as w, count(distinct cpv_code) as c,
      count(distinct split_part(title, ' ', 1)) as t, count(distinct case when status = 'O' then act_id end) as f
    from suppliers join prime using (act_id) join acts using (act_id) group by 1)"""))
def profile_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers read as profiles: the longest title describes, codes and first words of titles are chosen, open acts are found."""
    lens = Lens(spark, sf_dir)
    f = lens.suppliers.join(lens.primary, "act_id").join(lens.acts.select("act_id", "status"), "act_id")
    words = F.split("title", " ")
    each = f.groupBy("supplier_id").agg(
        F.max(F.size(words)).alias("words"), F.countDistinct("cpv_code").alias("codes"), F.countDistinct(words[0]).alias("terms"),
        F.countDistinct(F.when(F.col("status") == "O", F.col("act_id"))).alias("found"),
    )
    return each.select("supplier_id", quality(F.col("words"), F.col("codes"), F.col("terms"), F.col("found")).alias("q")).select("supplier_id", "q.*")


def first_opportunities(found: DataFrame, limit: int = 10) -> DataFrame:
    """The best row of each process by (score, confidence, recency), nulls as 0, and of these the first ones; rows without a process go."""
    order = [F.coalesce(c, F.lit(0)).cast("double").alias(c) for c in ("score", "confidence", "recency")]
    best = found.where(F.col("process_id").isNotNull()).groupBy("process_id").agg(F.max(F.struct(*order)).alias("b")).select("process_id", "b.*")
    return best.orderBy(F.desc("score"), F.desc("confidence"), F.desc("recency"), "process_id").limit(limit)


@query("first_opportunities", sql("""select * from (select distinct on (act_id) act_id as process_id, cast(value as double) as score,
      cast(l_quantity as double) as confidence, cast(year(ship_date) as double) as recency
    from lines order by act_id, score desc, confidence desc, recency desc)
  order by score desc, confidence desc, recency desc, process_id limit 10"""))
def first_opportunities_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = Lens(spark, sf_dir).lines
    return first_opportunities(li.select(F.col("act_id").alias("process_id"), F.col("value").alias("score"), F.col("l_quantity").alias("confidence"), F.year("ship_date").alias("recency")))


@query("process_catalog", sql("""select process_id as id, 'procurement_process' as kind, title, status, amount_net as amount, c_name as name, codes, nuts_codes
  from eligible join prime using (act_id) join customer on buyer_id = c_custkey
  left join (select act_id, string_agg(distinct cpv_code, ',' order by cpv_code) as codes from codes group by 1) using (act_id)
  left join (select act_id, string_agg(distinct nuts_code, ',' order by nuts_code) as nuts_codes from locations group by 1) using (act_id)"""))
def process_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One search document for each process with an act that may enter analytics; its arrays are aggregated before the join."""
    lens = Lens(spark, sf_dir)
    listed = lambda df, c, name: df.groupBy("act_id").agg(F.array_join(F.array_sort(F.collect_set(c)), ",").alias(name))
    buyers = lens.table("customer", "c_custkey", "c_name").select(F.col("c_custkey").alias("buyer_id"), F.col("c_name").alias("name"))
    out = lens.eligible.join(lens.primary.select("act_id", "title"), "act_id").join(buyers, "buyer_id")
    out = out.join(listed(lens.codes, "cpv_code", "codes"), "act_id", "left").join(listed(lens.locations, "nuts_code", "nuts_codes"), "act_id", "left")
    kind = F.lit("procurement_process").alias("kind")
    return out.select(F.col("process_id").alias("id"), kind, "title", "status", F.col("amount_net").alias("amount"), "name", "codes", "nuts_codes")


@query("tenant_opportunities", sql("""select top.*, codes from (
    select process_id, max(amount_net) as amount, max(event_date) as last_event_date, max(score) as score from eligible e
    join (select act_id, max(score) as score from scored group by 1) s using (act_id)
    where status in ('O', 'P') and process_id not in (
      select cast(json_extract_string(props, '$.k') as bigint) from events where user_id = 1 and json_extract_string(props, '$.k') is not null)
    group by 1 order by score desc, last_event_date desc, process_id limit 50) top
  left join (select process_id, string_agg(distinct cpv_code, ',' order by cpv_code) as codes from eligible join codes using (act_id) group by 1) using (process_id)""",
    scoring._CTX, scoring._RULE_VALUES, scoring._SCORE_PARTS))
def tenant_opportunities(spark: SparkSession, sf_dir: str, tenant: int = 1, limit: int = 50) -> DataFrame:
    """Open processes by score without those the tenant called irrelevant (its events name them); codes are fetched for the list only."""
    lens = Lens(spark, sf_dir)
    scores = scoring.opportunity_scores(spark, sf_dir).select("act_id", "score")
    acts = lens.eligible.where(F.col("status").isin("O", "P")).join(scores, "act_id")
    each = acts.groupBy("process_id").agg(F.max("amount_net").alias("amount"), F.max("event_date").alias("last_event_date"), F.max("score").alias("score"))
    said = lens.table("events", "user_id", "props").where(F.col("user_id") == tenant)
    said = said.select(F.get_json_object("props", "$.k").cast("long").alias("process_id")).where(F.col("process_id").isNotNull()).distinct()
    top = each.join(said, "process_id", "left_anti").orderBy(F.desc("score"), F.desc("last_event_date"), "process_id").limit(limit)
    few = lens.eligible.select("act_id", "process_id").join(top.select("process_id"), "process_id", "left_semi").join(lens.codes, "act_id")
    codes = few.groupBy("process_id").agg(F.array_join(F.array_sort(F.collect_set("cpv_code")), ",").alias("codes"))
    return top.join(codes, "process_id", "left")
