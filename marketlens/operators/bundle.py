"""Publication bundles: the official records of a process, a summary in sentences that only state what is recorded, excerpts of
its documents, and the sentences that speak for a group of texts."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marketlens.lens import MONEY, Lens, sql
from marketlens.operators.chain import typed_acts
from marketlens.registry import query
from marketlens.session import checkpoint_folder, shared_folder

# Kinds of act in order of what best stands for a process, and what a summary calls them.
LABELS = {
    "NOTICE": "προκήρυξη", "REQUEST": "αίτημα", "APPROVED_REQUEST": "εγκεκριμένο αίτημα", "TED_NOTICE": "ευρωπαϊκή προκήρυξη", "AWARD": "απόφαση ανάθεσης",
    "CONTRACT": "σύμβαση", "AMENDMENT": "τροποποίηση", "DIAVGEIA_DECISION": "απόφαση Διαύγειας", "PAYMENT": "πληρωμή",
}
OTHER_LABEL, NO_TITLE, LAST = "πράξη", "χωρίς καταγεγραμμένο τίτλο", 99
BUYER, SENTENCE = "Η αναθέτουσα αρχή", "{} δημοσίευσε {} με αντικείμενο «{}»."
VALUE_SENTENCE, DEADLINE_SENTENCE = "Η καταγεγραμμένη αξία είναι {}.", "Η προθεσμία υποβολής προσφορών είναι {}."
POINTS = {"value": "Καταγεγραμμένη αξία", "deadline": "Προθεσμία προσφορών", "procedure": "Διαδικασία", "codes": "CPV", "places": "Τόπος εκτέλεσης"}
TITLE_CHARS, PAGE_CHARS, EXCERPT_CHARS, PAGES, CODES, PLACES = 700, 1200, 900, 2, 6, 4


def clean(c: Column, limit: int = TITLE_CHARS) -> Column:
    """One line of at most ``limit`` characters, the last one dots where it is cut; null where nothing is left."""
    flat = F.trim(F.regexp_replace(c, r"[\s\p{Z}]+", " "))
    return F.when(F.char_length(flat) > limit, F.concat(F.rtrim(F.substring(flat, 1, limit - 1)), F.lit("…"))).when(flat != "", flat)


def money(amount: Column, currency: Column) -> Column:
    """1.234,50 EUR"""
    return F.concat(F.translate(F.format_number(amount, 2), ",.", ".,"), F.lit(" "), F.coalesce(currency, F.lit("EUR")))


def _fill(template: str, *values: Column) -> Column:
    pieces = template.split("{}")
    return F.concat(F.lit(pieces[0]), *(x for v, p in zip(values, pieces[1:]) for x in (v, F.lit(p))))


def bundles(acts: DataFrame, documents: DataFrame, pages: DataFrame, codes: DataFrame, places: DataFrame) -> DataFrame:
    """(process_id, primary_act_id, summary, key_points, records, documents, document_excerpt), a row for each process with an act.

    ``acts``: act_id, process_id, act_type, title, buyer_name, amount, currency, deadline (date), procedure_type, day; ``documents``:
    document_id, act_id, title; ``pages``: document_id, page_number, text; ``codes``: act_id, code, is_primary; ``places``: act_id,
    place. Records come by kind, then latest first, undated last, ties by act; the first is the primary one and gives the
    summary. What isn't recorded is left out of sentences and points. A document is listed once for each process; its excerpt is
    cut from its first two pages, and only those characters are shuffled. Rows of acts that don't exist count nowhere."""
    rank = F.coalesce(*(F.when(F.col("act_type") == k, n) for n, k in enumerate(LABELS)), F.lit(LAST))
    label = F.coalesce(*(F.when(F.col("act_type") == k, v) for k, v in LABELS.items()), F.lit(OTHER_LABEL))
    late = -F.coalesce(F.datediff("day", F.lit("0001-01-01").cast("date")), F.lit(-1))
    fields = ("act_id", "act_type", "title", "buyer_name", "amount", "currency", "deadline", "procedure_type", "day")
    record = F.struct(rank.alias("rank"), late.alias("late"), *fields, label.alias("label"))
    out = acts.where("process_id is not null").groupBy("process_id").agg(F.array_sort(F.collect_set(record)).alias("records")).withColumn("p", F.get("records", F.lit(0)))

    cut = pages.where(F.col("page_number") <= PAGES).select("document_id", F.struct("page_number", F.substring("text", 1, PAGE_CHARS).alias("text")).alias("page"))
    cut = cut.groupBy("document_id").agg(F.array_sort(F.collect_list("page")).alias("pages"))
    home = acts.where("process_id is not null").select("act_id", "process_id").distinct()
    d = documents.join(home, "act_id").groupBy("process_id", "document_id").agg(F.min(F.struct("act_id", "title")).alias("d")).join(cut, "document_id", "left")
    text = clean(F.array_join(F.transform("pages", lambda x: x["text"]), " "), EXCERPT_CHARS)
    d = d.groupBy("process_id").agg(F.array_sort(F.collect_list(F.struct("document_id", "d.act_id", "d.title", text.alias("excerpt")))).alias("documents"))
    out = out.join(d, "process_id", "left").withColumn("documents", F.coalesce("documents", F.array().cast(d.schema["documents"].dataType)))

    firsts = codes.groupBy("act_id").agg(F.transform(F.array_sort(F.collect_set(F.struct((~F.coalesce("is_primary", F.lit(False))).alias("o"), "code"))), lambda x: x["code"]).alias("codes"))
    where = places.join(home, "act_id").groupBy("process_id").agg(F.array_sort(F.collect_set("place")).alias("places"))
    out = out.withColumn("act_id", F.col("p.act_id")).join(firsts, "act_id", "left").join(where, "process_id", "left")

    title = F.coalesce(clean(F.col("p.title")), F.lit(NO_TITLE))
    who = F.concat_ws(" ", F.lit(BUYER), "p.buyer_name")
    value, deadline = money(F.col("p.amount"), F.col("p.currency")), F.date_format("p.deadline", "dd/MM/yyyy")
    first = lambda c, n: F.array_join(F.slice(F.array_distinct(c), 1, n), ", ")
    values = {"value": value, "deadline": deadline, "procedure": F.col("p.procedure_type"), "codes": first("codes", CODES), "places": first("places", PLACES)}
    points = F.array_compact(F.array(*(F.when(F.coalesce(v, F.lit("")) != "", F.struct(F.lit(POINTS[k]).alias("label"), v.alias("value"))) for k, v in values.items())))
    summary = F.concat_ws(" ", _fill(SENTENCE, who, F.col("p.label"), title), _fill(VALUE_SENTENCE, value), _fill(DEADLINE_SENTENCE, deadline))
    excerpts = F.filter(F.transform("documents", lambda x: x["excerpt"]), lambda x: x.isNotNull())
    return out.select(
        "process_id", F.col("act_id").alias("primary_act_id"), summary.alias("summary"), points.alias("key_points"),
        F.transform("records", lambda r: F.struct(*(r[f].alias(f) for f in fields))).alias("records"), "documents", F.get(excerpts, F.lit(0)).alias("document_excerpt"),
    )


def key_sentences(texts: DataFrame, group: str, doc: str, text: str = "text", k: int = 3, shortest: int = 30, longest: int = 400) -> DataFrame:
    """(group, rank, doc, place, score, sentence): the ``k`` sentences that best speak for all texts of a group. A sentence ends at
    ``.``, ``;``, ``!`` or ``?`` before a blank, or with its line; those of fitting length are candidates. Its score is the mean,
    over its distinct words of four letters and more, of the share of the group's candidates that hold the word. Ties go to the
    first by document and place; sentences without such a word, null and empty texts give nothing.

    Words are counted by (group, word), so a large group is spread over its words; sentences themselves don't travel with them.
    Texts are cut once, into the words of their sentences, which are stored as they are read three times; only the documents of
    the best are cut again."""
    pieces = F.transform(F.split(F.regexp_replace(text, r"([.;!?])\s+", "$1\n"), "\n"), lambda s: F.trim(s))
    fits = lambda x: F.char_length(x["s"]).between(shortest, longest)
    cut = lambda df: df.select(F.col(group).alias("g"), F.col(doc).alias("d"), F.inline(F.filter(F.transform(pieces, lambda s, i: F.struct(i.alias("place"), s.alias("s"))), fits)))
    ws = F.array_distinct(F.filter(F.split(F.lower("s"), r"[^\p{L}\p{N}]+"), lambda w: F.char_length(w) >= 4))
    stored = f"{shared_folder(texts.sparkSession)}/sentences-{uuid.uuid4().hex}"
    cut(texts).select("g", "d", "place", ws.alias("ws")).where(F.size("ws") > 0).write.parquet(stored)
    s = texts.sparkSession.read.parquet(stored)
    each = s.select("g", "d", "place", F.explode("ws").alias("w"), F.size("ws").alias("m"))
    held = each.groupBy("g", "w").agg(F.count("*").alias("held"))
    n = s.groupBy("g").agg(F.count("*").alias("n"))
    total = each.join(held, ["g", "w"]).groupBy("g", "d", "place").agg((F.sum("held") / F.max("m")).alias("weight"))
    w = Window.partitionBy("g").orderBy(F.desc("weight"), "d", "place")
    best = total.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).join(n, "g")
    checkpoint_folder(texts.sparkSession)
    best = best.checkpoint()  # a few rows a group
    few = texts.join(best.select(F.col("d").alias(doc)).distinct(), doc, "left_semi")
    best = best.join(cut(few), ["g", "d", "place"])
    return best.select(F.col("g").alias(group), "rank", F.col("d").alias(doc), "place", (F.col("weight") / F.col("n")).alias("score"), F.col("s").alias("sentence"))


@query("tender_bundles", sql(r"""select process_id, 'C-' || process_id as primary_act_id, 'Η αναθέτουσα αρχή' || coalesce(' ' || c_name, '') || ' δημοσίευσε σύμβαση με αντικείμενο «' || coalesce(title, 'χωρίς καταγεγραμμένο τίτλο') || '». Η καταγεγραμμένη αξία είναι ' || translate(format('{:,.2f}', cast(amount_net as double)), ',.', '.,') || ' EUR. Η προθεσμία υποβολής προσφορών είναι ' || strftime(event_date, '%d/%m/%Y') || '.' as summary,
  coalesce(n, 0) + 1 as records, coalesce(codes, '') as codes, coalesce(places, '') as places, ex as document_excerpt
  from acts left join customer on buyer_id = c_custkey left join prime using (act_id) left join (select l_orderkey as process_id, count(*) as n from (select distinct l_orderkey, l_linenumber, l_partkey, cast(l_shipdate as date), l_discount < 0.08 from lineitem where l_linestatus = 'F') group by 1) using (process_id)
  left join (select act_id, array_to_string(list_sort(list(distinct cpv_code))[1:6], ', ') as codes from codes group by 1) using (act_id) left join (select act_id, nuts_code as places from locations) using (act_id)
  left join (select doc_id as process_id, nullif(case when length(f) > 900 then rtrim(substr(f, 1, 899)) || '…' else f end, '') as ex from (select doc_id, trim(regexp_replace(substr(text, 1, 1200), '[\s\p{Z}]+', ' ', 'g')) as f from documents)) using (process_id)"""))  # fmt: skip
def tender_bundles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bundles of all orders: contracts and payments as acts, documents of the same number, codes and places."""
    lens = Lens(spark, sf_dir)
    no = lambda d, *cols: d.select(F.concat(F.lit("C-"), F.col("act_id").cast("string")).alias("act_id"), *cols)
    buyer = lens.table("customer", F.col("c_custkey").alias("buyer_id"), F.col("c_name").alias("buyer_name"))
    c = no(lens.acts.join(buyer, "buyer_id", "left").join(lens.primary.select("act_id", "title"), "act_id", "left"), "process_id", "act_type", "title", "buyer_name", F.col("amount_net").alias("amount"), F.lit("EUR").alias("currency"), F.col("event_date").alias("deadline"), "procedure_type", F.col("event_date").alias("day"))
    none = lambda t: F.lit(None).cast(t)
    paid = typed_acts(lens, paid_only=True)
    # a payment without a title, a buyer or an amount of its own; lines with the same key are told apart by day and eligibility
    paid = paid.select(F.concat_ws("-", "act_id", F.col("decision_date").cast("string"), F.col("eligible").cast("string")).alias("act_id"), "process_id", "act_type", none("string").alias("title"), none("string").alias("buyer_name"), none(MONEY).alias("amount"), none("string").alias("currency"), none("date").alias("deadline"), none("string").alias("procedure_type"), F.col("decision_date").alias("day"))
    docs = lens.table("documents", F.col("doc_id").alias("document_id"), F.concat(F.lit("C-"), F.col("doc_id").cast("string")).alias("act_id"), F.col("source").alias("title"))
    pages = lens.table("documents", F.col("doc_id").alias("document_id"), F.lit(1).alias("page_number"), "text")
    b = bundles(c.unionByName(paid), docs, pages, no(lens.codes, F.col("cpv_code").alias("code"), F.lit(False).alias("is_primary")), no(lens.locations, F.col("nuts_code").alias("place")))
    point = lambda k: F.coalesce(F.get(F.filter("key_points", lambda x: x["label"] == POINTS[k]), F.lit(0))["value"], F.lit("")).alias(k)
    return b.select("process_id", "primary_act_id", "summary", F.size("records").cast("long").alias("records"), point("codes"), point("places"), "document_excerpt")


@query("key_sentences", r"""with p as (select source, doc_id, i - 1 as place, trim(ss[i]) as s from (select source, doc_id, ss, unnest(range(1, len(ss) + 1)) as i from (select source, doc_id, string_split(regexp_replace(text, '([.;!?])\s+', '\1' || chr(10), 'g'), chr(10)) as ss from documents))),
s as (select * from (select *, list_distinct(list_filter(string_split_regex(lower(s), '[^\p{L}\p{N}]+'), lambda w: length(w) >= 4)) as ws from p where length(s) between 30 and 400) where len(ws) > 0),
e as (select source, doc_id, place, unnest(ws) as w, len(ws) as m from s), t as (select source, doc_id, place, sum(held) / max(m) as weight from e join (select source, w, count(*) as held from e group by all) using (source, w) group by all)
select source, rank, doc_id, place, round(weight / n, 6) as score, s as sentence from (select *, row_number() over (partition by source order by weight desc, doc_id, place) as rank from t) join (select source, count(*) as n from s group by 1) using (source) join s using (source, doc_id, place) where rank <= 3""")  # fmt: skip
def key_sentences_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three sentences that best speak for each source."""
    d = Lens(spark, sf_dir).table("documents", "doc_id", "source", "text")
    return key_sentences(d, "source", "doc_id").withColumn("score", F.round("score", 6))
