"""Source values brought to one form: coded and localized fields, countries, deadlines, domains, places, contacts, query patterns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marketlens.functions import normalize as N
from marketlens.functions import text as T
from marketlens.lens import Lens
from marketlens.registry import query


@query("coded_values", "select event_type, count(*) as n from events group by 1")
def coded_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event types from three shapes of coded fields: {key, value}, nested, and plain."""
    e = Lens(spark, sf_dir).table("events", "event_id", "event_type")
    k = F.col("event_id") % 3
    raw = F.when(k == 0, F.concat(F.lit('{"key":"7","value":"'), "event_type", F.lit('"}'))).when(k == 1, F.concat(F.lit('{"value":{"key":"'), "event_type", F.lit('"}}'))).otherwise(F.col("event_type"))
    # a nested object without the preferred part gives its other part
    return e.select(N.unwrap(raw).alias("event_type")).groupBy("event_type").agg(F.count("*").alias("n"))


@query("localized_titles", "select p_partkey as id, case when p_partkey % 2 = 0 then p_brand else p_name end as title, [p_brand, p_type] as codes from part")
def localized_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles in the first language that has one, and lists of codes flattened, each once."""
    p = Lens(spark, sf_dir).table("part", "p_partkey", "p_name", "p_brand", "p_type")
    both = F.create_map(F.lit("eng"), F.array("p_name"), F.lit("ell"), F.array("p_brand"))
    texts = F.when(F.col("p_partkey") % 2 == 0, both).otherwise(F.create_map(F.lit("eng"), F.array("p_name")))
    codes = N.flat_list(F.array("p_brand", F.lit(" ")), F.array("p_type", "p_brand"))
    return p.select(F.col("p_partkey").alias("id"), N.localized(texts).alias("title"), codes.alias("codes"))


@query("country_codes", "select ['EL', 'FR', 'SE'][cast(c_custkey % 3 as int) + 1] as country, count(*) as n from customer group by 1")
def country_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = Lens(spark, sf_dir).table("customer", "c_custkey")
    long = F.element_at(F.array(F.lit("grc"), F.lit("FRA"), F.lit("SWE")), (F.col("c_custkey") % 3).cast("int") + 1)
    return c.select(N.country(long).alias("country")).groupBy("country").agg(F.count("*").alias("n"))


@query("submission_deadlines", """select o_orderkey as id, case when o_orderkey % 2 = 0 then cast(cast(o_orderdate as date) as timestamp) + interval '86399 seconds'
  else cast(cast(o_orderdate as date) as timestamp) + interval '10 hours' end as deadline from orders""")  # fmt: skip
def submission_deadlines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The earliest of two deadlines: on the day (without a time for every second order) and on the day after."""
    o = Lens(spark, sf_dir).table("orders", "o_orderkey", "o_orderdate")
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    after = F.date_format(F.date_add(F.col("o_orderdate").cast("date"), 1), "yyyy-MM-dd")
    time = F.when(F.col("o_orderkey") % 2 == 1, "10:00:00")
    return o.select(F.col("o_orderkey").alias("id"), N.earliest_deadline(F.array(after, day), F.array(F.lit("09:00:00"), time)).alias("deadline"))


@query("page_domains", r"select regexp_extract(lower(trim(url)), '^(?:[a-z][a-z0-9+.-]*://)?(?:www\.)?([^/:?#\s]+)', 1) as domain, count(*) as n from pages group by 1")
def page_domains(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Lens(spark, sf_dir).table("pages", "url").select(N.domain(F.col("url")).alias("domain")).groupBy("domain").agg(F.count("*").alias("n"))


#: Labels of company states and the codes they stand for.
STATES = {"ΕΝΕΡΓΗ": "ACTIVE", "ΛΥΜΕΝΗ": "DISSOLVED"}


@query("place_codes", """select case c_custkey % 3 when 2 then null else 'EL' || cast(c_custkey % 100 as varchar) end as nuts, ['ACTIVE', 'DISSOLVED', 'Άγνωστη'][cast(c_custkey % 3 as int) + 1] as state,
  ['ΑΓΙΟΙ ΑΝΑΡΓΥΡΟΙ', 'SAO PAULO'][cast(c_custkey % 2 as int) + 1] as place, count(*) as n from customer group by all""")  # fmt: skip
def place_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions of Greece under one prefix, states by lexicon, and names of places for comparing."""
    c, k = Lens(spark, sf_dir).table("customer", "c_custkey"), F.col("c_custkey")
    pick = lambda names, i: F.element_at(F.array(*map(F.lit, names)), i.cast("int") + 1)
    nuts = N.greek_nuts(F.concat(pick(("EL", "gr", "DE"), k % 3), (k % 100).cast("string")))
    state = N.lexicon(pick(("Ενεργή", "ΛΥΜΈΝΗ", "Άγνωστη"), k % 3), STATES)
    place = N.place(pick(("Άγιοι  Ανάργυροι!", "são-paulo"), k % 2))
    return c.select(nuts.alias("nuts"), state.alias("state"), place.alias("place")).groupBy("nuts", "state", "place").agg(F.count("*").alias("n"))


@query("document_excerpts", """select doc_id, substr(text, greatest(coalesce(least(nullif(strpos(lower(text), 'estion'), 0), nullif(strpos(lower(text), 'licen'), 0)), 1) - 210, 1), 420) as excerpt from documents""")
def document_excerpts(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = Lens(spark, sf_dir).table("documents", "doc_id", "text")
    return d.select("doc_id", N.excerpt(F.col("text"), ["estion", "licen"]).alias("excerpt"))


@query("contact_checks", """select c_custkey % 3 <> 0 as email_valid, c_custkey % 2 = 0 as phone_valid, count(*) as n from customer group by all""")
def contact_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, k = Lens(spark, sf_dir).table("customer", "c_custkey"), F.col("c_custkey")
    email = F.when(k % 3 == 0, F.concat(F.lit("c"), k.cast("string"), F.lit("@nowhere"))).otherwise(F.concat(F.lit("c."), k.cast("string"), F.lit("@mail.example.org")))
    phone = F.when(k % 2 == 0, F.concat(F.lit("+30 210 "), F.lpad(k.cast("string"), 7, "0"))).otherwise(F.concat(F.lit("ext "), k.cast("string")))
    return c.select(N.valid_email(email).alias("email_valid"), N.valid_phone(phone).alias("phone_valid")).groupBy("email_valid", "phone_valid").agg(F.count("*").alias("n"))


@query("official_links", """select o_orderkey as id, case o_orderkey % 3 when 0 then 'https://example.org/act/' || cast(o_orderkey as varchar) when 1 then 'https://example.org/decision/' || cast(o_orderkey as varchar) end as link from orders""")
def official_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, k = Lens(spark, sf_dir).table("orders", "o_orderkey"), F.col("o_orderkey")
    scheme = F.when(k % 3 == 0, "ADAM").when(k % 3 == 1, "ADA").otherwise("LOCAL")
    return o.select(k.alias("id"), N.official_link(scheme, k.cast("string")).alias("link"))


@query("lexical_search", r"""with n as (select doc_id, regexp_replace(lower(text), '[^a-z0-9α-ω]+', ' ', 'g') as t from documents)
select doc_id from n where regexp_matches(t, '\bla\b') and regexp_matches(t, '\belle[a-z0-9α-ω]*\b')""")
def lexical_search(spark: SparkSession, sf_dir: str, text: str = "elle la") -> DataFrame:
    """Documents that hold every token of a question: a cheap search for its longest stem first, then one pattern."""
    prefilter, pattern = N.concept(spark, text)
    d = Lens(spark, sf_dir).table("documents", "doc_id", "text").select("doc_id", T.normalize_lexical(F.col("text")).alias("t"))
    return d.where(F.contains("t", F.lit(prefilter)) & F.col("t").rlike(f"^{pattern}")).select("doc_id")
