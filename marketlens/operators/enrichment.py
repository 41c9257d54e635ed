"""Classifying business descriptions, places against a gazetteer, decision makers of buyers, and work that changes set off."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marketlens.functions import text as T
from marketlens.lens import Lens
from marketlens.registry import query


def keyword_terms(words: DataFrame, limit: int = 8) -> DataFrame:
    """(id, rank, term, confidence): the most frequent words of each text, of equals the one that stands first, from
    (id, words). Null and empty texts have none. Words are counted before they are shuffled, and not shuffled if ``words`` is dealt by id."""
    each = words.select("id", F.posexplode("words").alias("at", "term")).groupBy("id", "term").agg(F.count("*").alias("n"), F.min("at").alias("at"))
    top = each.withColumn("rank", F.row_number().over(Window.partitionBy("id").orderBy(F.desc("n"), "at"))).where(F.col("rank") <= limit)
    return top.select("id", "rank", "term", F.least(F.lit(0.88), 0.72 + F.col("n") * 0.04).alias("confidence"))


@query("keyword_terms", """with w as (select doc_id, regexp_extract_all(text, '[A-Za-z0-9]{2,}') as ws from documents),
  e as (select doc_id, lower(unnest(ws)) as term, unnest(range(len(ws))) as pos from w),
  n as (select doc_id, term, count(*) as n, min(pos) as pos from e group by all)
select doc_id as id, rank, term, least(0.88::double, 0.72::double + n * 0.04::double) as confidence
from (select *, cast(row_number() over (partition by doc_id order by n desc, pos) as int) as rank from n) where rank <= 8""")
def keyword_terms_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = F.regexp_extract_all("text", F.lit("[A-Za-z0-9]{2,}"), 0)
    # texts are less than their words one by one, and are dealt out by id once: counts and ranks are taken where they lie
    docs = Lens(spark, sf_dir).table("documents", F.col("doc_id").alias("id"), "text").repartition("id")
    return keyword_terms(docs.select("id", F.transform(found, lambda w: F.lower(w)).alias("words")))


#: Letters that stems of different length must share to count as the same word.
STEM_PREFIX = 6


def catalog_terms(descriptions: DataFrame, catalog: DataFrame, limit: int = 12, stem: Callable[[Column], Column] = T.stem) -> DataFrame:
    """(text, code, score): the best ``limit`` catalogue entries of each distinct description, from (text) and (code, label).

    Words match by equal stems, or if one stem of six letters or more begins the other. An entry needs a third of the
    description's words, two of them, or its whole label in the description. Each distinct description is scored once;
    words meet by equality of stems or of their first six letters, so that no description meets an entry it has no word of.
    """
    stems = lambda c: F.array_distinct(F.transform(F.filter(F.split(c, " "), lambda w: w != ""), stem))
    q = descriptions.select("text").where(F.col("text").isNotNull()).distinct().select("text", stems(F.col("text")).alias("qs"))
    c = catalog.select("code", "label", stems(F.col("label")).alias("ls")).where(F.size("ls") > 0)
    # a stem's key: its first letters if it is long enough to begin another, else itself; such stems never match longer ones
    key = lambda w: F.substring(w, 1, STEM_PREFIX)
    meets = q.select("text", F.size("qs").alias("nq"), F.explode("qs").alias("x")).withColumn("key", key(F.col("x")))
    meets = meets.join(c.select("code", "label", F.size("ls").alias("nl"), F.explode("ls").alias("y")).withColumn("key", key(F.col("y"))), "key")
    long = F.least(F.length("x"), F.length("y")) >= STEM_PREFIX
    meets = meets.where((F.col("x") == F.col("y")) | (long & (F.startswith("x", "y") | F.startswith("y", "x"))))
    hits = meets.groupBy("text", "code", "label", "nq", "nl").agg(F.countDistinct("x").alias("hq"), F.countDistinct("y").alias("hl"))
    coverage, precision = F.col("hq") / F.col("nq"), F.col("hl") / F.col("nl")
    depth = F.length(F.regexp_replace("code", "0+$", ""))
    special = F.least(F.lit(1.0), F.greatest(depth - 2, F.lit(0)) / 6)
    phrase = F.contains("text", "label")
    score = F.least(F.lit(0.96), 0.52 + 0.22 * coverage + 0.14 * precision + 0.08 * special + F.when(phrase, 0.12).otherwise(0.0))
    kept = hits.where((coverage >= 0.34) | (F.col("hq") >= 2) | phrase).select("text", "code", F.round(score, 6).alias("score"), depth.alias("depth"))
    kept = kept.groupBy("text", "code").agg(F.max("score").alias("score"), F.max("depth").alias("depth"))
    place = F.row_number().over(Window.partitionBy("text").orderBy(F.desc("score"), F.desc("depth"), "code"))
    return kept.withColumn("place", place).where(F.col("place") <= limit).select("text", "code", "score")


@query("catalog_terms", """with q as (select distinct lower(p_name || ' ' || p_type) as text from part),
  c as (select lpad(cast(min(p_partkey) as varchar), 5, '1') || '000' as code, lower(p_name) as label from part group by p_name),
  qw as (select text, len(list_distinct(string_split(text, ' '))) as nq, unnest(list_distinct(string_split(text, ' '))) as x from q),
  cw as (select code, label, len(list_distinct(string_split(label, ' '))) as nl, unnest(list_distinct(string_split(label, ' '))) as y from c),
  h as (select text, code, label, nq, nl, count(distinct x) as hq, count(distinct y) as hl from qw join cw
    on x = y or (least(length(x), length(y)) >= 6 and (starts_with(x, y) or starts_with(y, x))) group by all),
  s as (select text, code, length(rtrim(code, '0')) as depth, round(least(0.96::double, 0.52::double + 0.22::double * (hq / nq) + 0.14::double * (hl / nl)
      + 0.08::double * least(1.0::double, greatest(length(rtrim(code, '0')) - 2, 0) / 6) + case when contains(text, label) then 0.12::double else 0 end), 6) as score
    from h where hq / nq >= 0.34 or hq >= 2 or contains(text, label)),
  r as (select text, code, max(score) as score, row_number() over (partition by text order by max(score) desc, max(depth) desc, code) as place from s group by text, code)
select p_partkey as id, code, score from part join r on text = lower(p_name || ' ' || p_type) where place <= 12""")  # fmt: skip
def catalog_terms_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each part's name and kind against the catalogue of names."""
    part = Lens(spark, sf_dir).table("part", "p_partkey", "p_name", "p_type")
    described = part.select(F.col("p_partkey").alias("id"), F.lower(F.concat_ws(" ", "p_name", "p_type")).alias("text"))
    code = F.concat(F.lpad(F.min("p_partkey").cast("string"), 5, "1"), F.lit("000"))
    catalog = part.groupBy("p_name").agg(code.alias("code")).select("code", F.lower("p_name").alias("label"))
    return described.join(catalog_terms(described, catalog, stem=lambda w: w), "text").select("id", "code", "score")


# Hints that ask for an administrative unit, and codes of seats and units that count more.
UNIT_HINTS = ["MUNICIPALITY", "REGIONAL_UNIT", "REGION"]
SEATS = ["PPLC", "PPLA", "PPLA2", "ADM1", "ADM2", "ADM3"]


def gazetteer_matches(candidates: DataFrame, places: DataFrame) -> DataFrame:
    """(name, hint, place_id, score) of each distinct candidate (name, hint) that a place is found for.

    ``places`` has a row for each alias: (place_id, alias, kind, code, population). Equal names count 100 and come before
    names of five letters or more of which one begins the other at a word, 75; then administrative units where one is
    hinted at, seats, and the logarithm of the population. Of equals the least place_id stays.
    """
    c = candidates.select("name", "hint").distinct()
    first = lambda x: F.substring_index(x, " ", 1)
    met = c.withColumn("w", first(F.col("name"))).join(places.withColumn("w", first(F.col("alias"))), "w")
    begins = F.startswith("name", F.concat("alias", F.lit(" "))) | F.startswith("alias", F.concat("name", F.lit(" ")))
    same = F.col("name") == F.col("alias")
    met = met.where(same | ((F.length("name") >= 5) & (F.length("alias") >= 5) & begins))
    score = F.when(same, 100.0).otherwise(75.0) + F.when(F.col("hint").isin(UNIT_HINTS) & (F.col("kind") == "A"), 15).otherwise(0)
    score = score + F.when(F.col("code").isin(SEATS), 8).otherwise(0)
    score = score + F.least(F.lit(7.0), F.log10(F.greatest(F.coalesce("population", F.lit(1)), F.lit(1)).cast("double")))
    best = F.min(F.struct((~same).alias("part"), (-F.round(score, 6)).alias("s"), "place_id"))
    return met.groupBy("name", "hint").agg(best.alias("b")).select("name", "hint", "b.place_id", (-F.col("b.s")).alias("score"))


@query("gazetteer_matches", """with p as (select n_nationkey as place_id, lower(n_name) as alias, 'P' as kind, case when n_nationkey % 5 = 0 then 'PPLA' else 'PPL' end as code, n_nationkey * 1000 as population from nation
    union all select 100 + r_regionkey, lower(r_name), 'A', 'ADM1', 1000000 from region union all select 200 + n_nationkey, lower(n_name) || ' area', 'A', 'ADM3', 50 from nation),
  c as (select c_custkey as id, case c_custkey % 3 when 0 then lower(n_name) when 1 then lower(n_name) || ' area west' else lower(r_name) end as name, case when c_custkey % 2 = 0 then 'REGION' else 'NONE' end as hint
    from customer join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey),
  m as (select id, place_id, name = alias as same, round(case when name = alias then 100 else 75 end + case when hint = 'REGION' and kind = 'A' then 15 else 0 end + case when code in ('PPLA', 'ADM1', 'ADM3') then 8 else 0 end
    + least(7, log10(greatest(population, 1)::double)), 6) as score from c join p on name = alias or (length(name) >= 5 and length(alias) >= 5 and (starts_with(name, alias || ' ') or starts_with(alias, name || ' '))))
select distinct on (id) id, place_id, score from m order by id, same desc, score desc, place_id""")  # fmt: skip
def gazetteer_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    lens = Lens(spark, sf_dir)
    n, r = lens.table("nation"), lens.table("region")
    k, name = F.col("n_nationkey"), F.lower("n_name")
    rows = lambda df, *c: df.select(*(x.alias(a) for x, a in zip(c, ("place_id", "alias", "kind", "code", "population"))))
    places = rows(n, k.cast("long"), name, F.lit("P"), F.when(k % 5 == 0, "PPLA").otherwise("PPL"), (k * 1000).cast("long"))
    places = places.unionByName(rows(r, (100 + F.col("r_regionkey")).cast("long"), F.lower("r_name"), F.lit("A"), F.lit("ADM1"), F.lit(1_000_000).cast("long")))
    places = places.unionByName(rows(n, (200 + k).cast("long"), F.concat(name, F.lit(" area")), F.lit("A"), F.lit("ADM3"), F.lit(50).cast("long")))
    at = lens.table("customer", "c_custkey", "c_nationkey").join(n, F.col("c_nationkey") == k).join(r, F.col("n_regionkey") == F.col("r_regionkey"))
    said = F.when(F.col("c_custkey") % 3 == 0, name).when(F.col("c_custkey") % 3 == 1, F.concat(name, F.lit(" area west"))).otherwise(F.lower("r_name"))
    c = at.select(F.col("c_custkey").alias("id"), said.alias("name"), F.when(F.col("c_custkey") % 2 == 0, "REGION").otherwise("NONE").alias("hint"))
    return c.join(gazetteer_matches(c, places), ["name", "hint"]).select("id", "place_id", "score")


def buyers_of(orgs: DataFrame, identifiers: DataFrame, entities: DataFrame) -> DataFrame:
    """(org, buyer): the entity of an organisation (org, vat, label) by its valid tax number, of several the most trusted
    one, else by its exact upper-case name among entities that aren't merged into another. Without either it is left out."""
    digits = lambda c: F.regexp_replace(c, "[^0-9]", "")
    known = identifiers.where("valid").groupBy(F.col("vat").alias("digits")).agg(F.min(F.struct((-F.col("confidence")).alias("c"), "entity"))["entity"].alias("by_vat"))
    named = entities.where(F.col("merged_into").isNull()).groupBy(F.col("name").alias("upper")).agg(F.min("entity").alias("by_name"))
    out = orgs.select("org", digits(F.col("vat")).alias("digits"), F.upper(F.trim("label")).alias("upper")).join(known, "digits", "left").join(named, "upper", "left")
    return out.select("org", F.coalesce("by_vat", "by_name").alias("buyer")).where(F.col("buyer").isNotNull())


@query("decision_makers", """with o as (select n_nationkey as org, case when n_nationkey % 2 = 0 then 1000 + n_nationkey when n_nationkey % 7 <> 3 then 500 + n_nationkey end as buyer from nation)
select buyer, trim(s_name) as full_name, case when s_suppkey % 4 = 0 then 'DEPARTMENT_HEAD' when s_suppkey % 4 = 1 then 'FINANCE' else 'STAKEHOLDER' end as decision_role, s_suppkey as source_identifier, 0.95::double as confidence
from supplier join o on s_nationkey = org where buyer is not null and s_suppkey % 10 <> 9""")  # fmt: skip
def decision_makers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signers with a name, with the buyer of their organisation and the role their title tells."""
    lens = Lens(spark, sf_dir)
    n, k = lens.table("nation", "n_nationkey", "n_name"), F.col("n_nationkey")
    vat = F.format_string("EL %03d-%03d", k, k)
    orgs = n.select(k.alias("org"), vat.alias("vat"), F.concat(F.lit(" "), F.lower("n_name")).alias("label"))
    ids = n.select((1000 + k).alias("entity"), F.format_string("%03d%03d", k, k).alias("vat"), (k % 2 == 0).alias("valid"), F.lit(0.9).alias("confidence"))
    entities = n.select((500 + k).alias("entity"), F.upper("n_name").alias("name"), F.when(k % 7 == 3, 1).alias("merged_into"))
    s, key = lens.table("supplier", "s_suppkey", "s_name", "s_nationkey"), F.col("s_suppkey")
    title = F.when(key % 4 == 0, "Director").when(key % 4 == 1, "Accounting").otherwise("Clerk")
    signers = s.select("s_nationkey", key.alias("source_identifier"), F.when(key % 10 == 9, " ").otherwise(F.col("s_name")).alias("name"), title.alias("title"))
    signers = signers.select("s_nationkey", "source_identifier", F.trim("name").alias("full_name"), T.decision_role(F.col("title")).alias("decision_role")).where("full_name <> ''")
    out = signers.join(buyers_of(orgs, ids, entities), F.col("s_nationkey") == F.col("org"))
    return out.select("buyer", "full_name", "decision_role", "source_identifier", F.lit(0.95).alias("confidence"))


def change_queue(changes: DataFrame) -> DataFrame:
    """(act, record, available_at, requeued): one job for each version of an act, from changes (act, record, at, again).

    A first change queues a job; later ones of the act leave it, those of its documents (``again``) queue it anew. Changes
    may come in any order or twice. The aggregation is the same on a stream in update mode.
    """
    late = F.max(F.when(F.col("again"), F.col("at")))
    return changes.groupBy("act", "record").agg(F.coalesce(late, F.min("at")).alias("available_at"), F.countDistinct(F.when(F.col("again"), F.col("at"))).alias("requeued"))


@query("change_queue", """select cast(json_extract_string(props, '$.k') as bigint) as act, user_id as record, coalesce(max(case when event_type = 'error' then ts end), min(ts)) as available_at,
  count(distinct case when event_type = 'error' then ts end) as requeued from events where event_type in ('view', 'click', 'error') group by 1, 2""")  # fmt: skip
def change_queue_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = Lens(spark, sf_dir).table("events", "ts", "user_id", "event_type", "props").where(F.col("event_type").isin("view", "click", "error"))
    act = F.get_json_object("props", "$.k").cast("long").alias("act")
    return change_queue(e.select(act, F.col("user_id").alias("record"), F.col("ts").alias("at"), (F.col("event_type") == "error").alias("again")))
