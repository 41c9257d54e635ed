"""Ranked search, paging, BM25, phrase monitors, extractors of fields from texts, intents of questions."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marketlens.functions import text as T
from marketlens.lens import Lens, sql
from marketlens.registry import query
from marketlens.session import checkpoint_folder

QUERY = ("the", "estion")


@query("search_ranked", sql("""select act_id, max(rank) as rank, max(event_date) as event_date from (
    select act_id, 100 as rank, event_date from acts where cast(act_id as varchar) = '42' union all select act_id, 80, event_date from acts join prime using (act_id) where lower(title) like '%green%'
    union all select act_id, 70, event_date from acts join prime using (act_id) where lower(title) like '%red%' or lower(title) like '%small%') group by 1 order by rank desc, event_date desc, act_id limit 20"""))  # fmt: skip
def search_ranked(spark: SparkSession, sf_dir: str, limit: int = 20, offset: int = 0) -> DataFrame:
    """Branches of rising rank (id, phrase, terms), the best for each act; ties by date and id."""
    lens = Lens(spark, sf_dir)
    a = lens.acts.select("act_id", "event_date")
    t = a.join(lens.primary.select("act_id", F.lower("title").alias("t")), "act_id")
    ranked = [(a.where(F.col("act_id").cast("string") == "42"), 100), (t.where(F.contains("t", F.lit("green"))), 80), (t.where(F.contains("t", F.lit("red")) | F.contains("t", F.lit("small"))), 70)]
    all_ = reduce(DataFrame.unionByName, (d.select("act_id", F.lit(r).alias("rank"), "event_date") for d, r in ranked))
    out = all_.groupBy("act_id").agg(F.max("rank").alias("rank"), F.max("event_date").alias("event_date")).orderBy(F.desc("rank"), F.desc("event_date"), "act_id")
    return (out.offset(offset) if offset else out).limit(limit)


@query("search_page_2", sql("""select act_id, max(rank) as rank, max(event_date) as event_date from (
    select act_id, 100 as rank, event_date from acts where cast(act_id as varchar) = '42' union all select act_id, 80, event_date from acts join prime using (act_id) where lower(title) like '%green%'
    union all select act_id, 70, event_date from acts join prime using (act_id) where lower(title) like '%red%' or lower(title) like '%small%') group by 1 order by rank desc, event_date desc, act_id limit 20 offset 20"""))  # fmt: skip
def search_page_2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search_ranked(spark, sf_dir, 20, 20)


@query("keyset_page", sql("select act_id, amount_net from acts where act_id > 500 order by act_id limit 101"))
def keyset_page(spark: SparkSession, sf_dir: str, last: int = 500, n: int = 100) -> DataFrame:
    """The page after a key, with one row more to tell whether there are others."""
    return Lens(spark, sf_dir).acts.where(F.col("act_id") > last).select("act_id", "amount_net").orderBy("act_id").limit(n + 1)


def postings(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Inverted index: (doc_id, n, token, tf); n is the document's length in tokens."""
    t = docs.select(doc_id, T.tokens(F.col(text)).alias("ts")).select(doc_id, F.size("ts").alias("n"), F.explode("ts").alias("token"))
    return t.groupBy(doc_id, "n", "token").agg(F.count("*").alias("tf"))


def bm25(docs: DataFrame, terms: tuple[str, ...], k1: float = 1.2, b: float = 0.75, limit: int = 20) -> DataFrame:
    """Best documents for some terms. Each text is read once, into its number of words and the counts of the terms; words are
    counted by the spaces between them, without a list of them. These few numbers a text are stored, as they are read twice."""
    s = F.trim(T.normalize_lexical(F.col("text")))
    n = F.when(s == "", 0).otherwise(F.octet_length(s) - F.octet_length(F.replace(s, F.lit(" "))) + 1)
    apart = F.concat(F.lit(" "), F.replace(s, F.lit(" "), F.lit("  ")), F.lit(" "))  # each word between blanks of its own
    known = [w for w in dict.fromkeys(terms) if re.fullmatch("[a-z0-9α-ω]+", w)]  # nothing else is a word of a text
    found = F.array(*(F.struct(F.lit(w).alias("token"), ((F.octet_length("apart") - F.octet_length(F.replace("apart", F.lit(f" {w} ")))) / (len(w.encode()) + 2)).cast("long").alias("k")) for w in known)).cast("array<struct<token:string,k:bigint>>")
    checkpoint_folder(docs.sparkSession)
    t = docs.select("doc_id", n.alias("n"), apart.alias("apart")).select("doc_id", "n", F.filter(found, lambda x: x["k"] > 0).alias("hits")).checkpoint()
    stats = t.agg(F.count("*").alias("docs"), F.avg("n").alias("mean"))
    tf = t.select("doc_id", "n", F.inline("hits")).groupBy("doc_id", "n", "token").agg(F.sum("k").alias("tf"))
    df = tf.groupBy("token").agg(F.count("*").alias("df"))  # a row for each term
    s = tf.join(F.broadcast(df), "token").crossJoin(F.broadcast(stats))
    idf = F.log(1 + (F.col("docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("n") / F.col("mean")))
    return s.groupBy("doc_id").agg(F.round(F.sum(part), 6).alias("score")).orderBy(F.desc("score"), "doc_id").limit(limit)


_TOK = "tok as (select doc_id, list_filter(string_split_regex(trim(regexp_replace(translate(lower(text), 'άέήίόύώϊΐϋΰς', 'αεηιουωιιυυσ'), '[^a-z0-9α-ω]+', ' ', 'g')), ' '), lambda x: x <> '') as ts from documents)"


@query("bm25_search", f"""with {_TOK}, tf as (select doc_id, len(ts) as n, token, count(*) as tf from (select doc_id, ts, unnest(ts) as token from tok) where token in ('the', 'estion') group by all)
  select doc_id, round(sum(ln(1 + (docs - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * n / mean))), 6) as score from tf join (select token, count(*) as df from tf group by 1) using (token), (select count(*) as docs, avg(len(ts)) as mean from tok) group by 1 order by score desc, doc_id limit 20""")
def bm25_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bm25(Lens(spark, sf_dir).table("documents", "doc_id", "text"), QUERY)


@query("fts_and_terms", f"with {_TOK} select doc_id, len(ts) as n_tokens from tok where list_contains(ts, 'of') and list_contains(ts, 'the') and list_contains(ts, 'was')")
def fts_and_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold every term."""
    t = Lens(spark, sf_dir).table("documents", "doc_id", "text").select("doc_id", T.tokens(F.col("text")).alias("ts"))
    return t.where(reduce(lambda a, b: a & b, (F.array_contains("ts", w) for w in ("of", "the", "was")))).select("doc_id", F.size("ts").cast("long").alias("n_tokens"))


@query("stem_tokens", f"""with {_TOK}, t as (select unnest(ts) as token from tok) select token, regexp_replace(token, '^(.{{4,}}?)({"|".join(sorted(T.SUFFIXES, key=len, reverse=True))})$', '\\1') as stem, count(*) as n from t where regexp_matches(token, '[α-ω]') group by all""")
def stem_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stems of Greek tokens and how often they occur."""
    t = Lens(spark, sf_dir).table("documents", "text").select(F.explode(T.tokens(F.col("text"))).alias("token")).where(F.col("token").rlike("[α-ω]"))
    return t.groupBy("token").agg(F.count("*").alias("n")).select("token", T.stem(F.col("token")).alias("stem"), "n")


@query("lexical_normalize", "select doc_id, sha256(regexp_replace(translate(lower(text), 'άέήίόύώϊΐϋΰς', 'αεηιουωιιυυσ'), '[^a-z0-9α-ω]+', ' ', 'g')) as normalized_sha256 from documents")
def lexical_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Lens(spark, sf_dir).table("documents", "doc_id", "text").select("doc_id", F.sha2(T.normalize_lexical(F.col("text")).cast("binary"), 256).alias("normalized_sha256"))


_SIMILAR = """with g as (select c_custkey as id, c_name || ' ' || c_mktsegment as name, list_distinct(flatten(list_transform(list_filter(string_split_regex(lower(c_name || ' ' || c_mktsegment), '[^a-z0-9]+'), lambda w: w <> ''), lambda w: list_transform(range(1, length(w) + 2), lambda i: substr('  ' || w || ' ', i, 3))))) as g from customer),
q as (select list_distinct(flatten(list_transform(['building', 'customer'], lambda w: list_transform(range(1, length(w) + 2), lambda i: substr('  ' || w || ' ', i, 3))))) as h)
select id, round(coalesce(len(list_intersect(g, h)) / nullif(len(list_distinct(list_concat(g, h))), 0), 0), 6) as similarity from g, q"""


@query("trigram_similarity", _SIMILAR)
def trigram_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = Lens(spark, sf_dir).table("customer", "c_custkey", "c_name", "c_mktsegment")
    return c.select(F.col("c_custkey").alias("id"), F.round(T.trigram_similarity(F.concat_ws(" ", "c_name", "c_mktsegment"), F.lit("building customer")), 6).alias("similarity"))


@query("vat_checksum", """with t as (select doc_id, unnest(regexp_extract_all(text, '[0-9]{9}')) as vat from documents), d as (select doc_id, vat, list_transform(range(1, 10), lambda i: cast(substr(vat, i, 1) as int)) as x from t)
  select doc_id, vat, (list_sum(list_transform(range(1, 9), lambda i: x[i] * cast(power(2, 9 - i) as int))) % 11) % 10 = x[9] as valid from d""")
def vat_checksum(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nine-digit runs of texts and whether they are valid VAT numbers."""
    d = Lens(spark, sf_dir).table("documents", "doc_id", "text")
    return d.select("doc_id", F.explode(F.regexp_extract_all("text", F.lit("[0-9]{9}"), F.lit(0))).alias("vat")).withColumn("valid", T.valid_vat(F.col("vat")))


def extract(docs: DataFrame, kind: str, pattern: str) -> DataFrame:
    """(doc_id, kind, nth, value): all matches of a pattern, in order."""
    found = F.regexp_extract_all(F.col("text"), F.lit(pattern), F.lit(0))
    return docs.select("doc_id", F.lit(kind).alias("kind"), F.posexplode(found).alias("nth", "value"))


PATTERNS = {
    "emails": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}",
    "amounts": r"[0-9]{1,3}(?:[.,][0-9]{3})*(?:[.,][0-9]{1,2})? ?(?:€|EUR|USD|\$)",
    "dates": r"\b[0-9]{1,2}[/.-][0-9]{1,2}[/.-][0-9]{4}\b|\b[0-9]{4}-[0-9]{2}-[0-9]{2}\b",
    "numbers": r"\b[0-9]{6,}\b",
    "registry": r"\b[0-9]{2}(?:REQ|PROC|AWRD|SYMV|PAY)[0-9]{6,10}\b",
    "urls": r"https?://[A-Za-z0-9./_-]+",
}
for _kind, _pattern in PATTERNS.items():
    _oracle = f"select doc_id, '{_kind}' as kind, cast(nth - 1 as int) as nth, v[nth] as value from (select doc_id, v, unnest(range(1, len(v) + 1)) as nth from (select doc_id, regexp_extract_all(text, '{_pattern}') as v from documents))"

    def _run(spark: SparkSession, sf_dir: str, kind=_kind, pattern=_pattern) -> DataFrame:
        return extract(Lens(spark, sf_dir).table("documents", "doc_id", "text"), kind, pattern)

    query(f"extract_{_kind}", _oracle)(_run)


@query("sentences_requirements", "with s as (select doc_id, unnest(string_split(replace(text, chr(10), ' '), '. ')) as s from documents) select doc_id, count(*) as candidates, max(length(trim(s))) as longest from s where length(trim(s)) between 30 and 900 and (contains(lower(s), 'und') or contains(lower(s), 'the')) group by 1")
def sentences_requirements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences of a fitting length with a word of demand, by document."""
    d = Lens(spark, sf_dir).table("documents", "doc_id", "text")
    s = d.select("doc_id", F.explode(F.split(F.replace("text", F.lit("\n"), F.lit(" ")), r"\. ")).alias("s")).withColumn("n", F.char_length(F.trim("s")))
    return s.where(F.col("n").between(30, 900) & (F.contains(F.lower("s"), F.lit("und")) | F.contains(F.lower("s"), F.lit("the")))).groupBy("doc_id").agg(F.count("*").alias("candidates"), F.max("n").alias("longest"))


def phrase_hits(docs: DataFrame, phrases: DataFrame) -> DataFrame:
    """(doc_id, item_id) where a text holds a phrase. The longest word inside a phrase, which has other characters on both
    sides there, is a whole word of every text that holds the phrase: an equi-join on it finds the candidates, so that no
    text is crossed with all phrases. Phrases without such a word are looked for by the words that hold theirs."""
    words = lambda c: F.split(F.lower(c), "[^\\p{L}]+")
    inner = F.filter(F.slice(words(F.col("phrase")), 2, F.greatest(F.size(words(F.col("phrase"))) - 2, F.lit(0))), lambda w: w != "")
    longest = F.array_max(F.transform(inner, lambda w: F.struct(F.char_length(w).alias("n"), w.alias("w"))))["w"]
    p = phrases.where("phrase <> ''").select("item_id", "phrase", longest.alias("w"))
    d = docs.select("doc_id", F.explode(F.array_distinct(words(F.col("text")))).alias("w"))
    keep = d.join(p.where("w is not null").select("item_id", "w"), "w").select("doc_id", "item_id")
    short = p.where("w is null").select("item_id", "phrase")
    hits = keep.join(docs, "doc_id").join(phrases, "item_id").where(F.contains("text", F.col("phrase"))).select("doc_id", "item_id")
    return hits.unionByName(docs.join(short, F.contains("text", F.col("phrase"))).select("doc_id", "item_id"))


@query("phrase_monitor", "select distinct doc_id, item_id from documents d, benchmark b where b.text <> '' and contains(d.text, b.text)")
def phrase_monitor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole benchmark items as watched phrases."""
    lens = Lens(spark, sf_dir)
    p = lens.table("benchmark", "item_id", F.col("text").alias("phrase"))
    return phrase_hits(lens.table("documents", "doc_id", "text"), p).distinct()


#: Intents of questions by keyword, the first that fits.
INTENTS = (("geography", "where|region"), ("top_suppliers", "who|supplier"), ("modifications", "change|amend"), ("payments", "pay|paid"), ("renewals", "renew|end"), ("funding", "fund|eu "))


def intent(c: Column) -> Column:
    out = F.when(F.lit(False), F.lit(""))
    for name, pattern in INTENTS:
        out = out.when(F.lower(c).rlike(pattern), name)
    return out.otherwise("hhi")


@query("intent_router", "select conv_id, turn, case " + " ".join(f"when regexp_matches(lower(text), '{p}') then '{n}'" for n, p in INTENTS) + " else 'hhi' end as intent from conversations where role = 'user'")
def intent_router(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = Lens(spark, sf_dir).table("conversations", "conv_id", "turn", "role", "text").where("role = 'user'")
    return c.select("conv_id", "turn", intent(F.col("text")).alias("intent"))


@query("page_links", r"""select page_id, count(*) as links, count(distinct l) as distinct_links from (select page_id, unnest(regexp_extract_all(html, 'href="([^"]+)"', 1)) as l from pages) group by 1""")
def page_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = Lens(spark, sf_dir).table("pages", "page_id", "html")
    return p.select("page_id", F.explode(F.regexp_extract_all("html", F.lit('href="([^"]+)"'), F.lit(1))).alias("l")).groupBy("page_id").agg(F.count("*").alias("links"), F.countDistinct("l").alias("distinct_links"))


@query("reusable_content", "with w as (select distinct item_id, unnest(list_filter(string_split_regex(lower(text), '[^a-zà-ÿ]+'), lambda x: length(x) > 3)) as w from benchmark) select a.item_id, b.item_id as other_id, round(count(*) * 1.0 / max(n), 6) as overlap from w a join w b on a.w = b.w and a.item_id <> b.item_id join (select item_id, count(*) as n from w group by 1) c on a.item_id = c.item_id group by a.item_id, b.item_id having count(*) * 1.0 / max(n) >= 0.15")
def reusable_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts whose words cover much of another's."""
    w = Lens(spark, sf_dir).table("benchmark", "item_id", "text").select("item_id", F.explode(F.array_distinct(F.filter(F.split(F.lower("text"), "[^a-zà-ÿ]+"), lambda x: F.char_length(x) > 3))).alias("w"))
    n = w.groupBy("item_id").agg(F.count("*").alias("n"))
    g = w.join(w.select(F.col("item_id").alias("other_id"), "w"), "w").where("item_id <> other_id").groupBy("item_id", "other_id").agg(F.count("*").alias("k")).join(n, "item_id")
    return g.select("item_id", "other_id", F.round(F.col("k") / F.col("n"), 6).alias("overlap")).where(F.col("k") / F.col("n") >= 0.15)
