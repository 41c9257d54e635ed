"""Ranked retrieval: pages by the density of what is wanted, and records by boosted fields of an index.

What is wanted comes as a structure (groups of phrases, phrases that may not occur), never as a text to be parsed.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marketlens.lens import Lens, sql
from marketlens.registry import query

#: The weight of an unlabelled word in a cover, the width of an excerpt and the part of it before the hit.
COVER_WEIGHT, WIDTH, LEAD = 0.1, 420, 140
#: Saturation and length norm of BM25, and the shortest and longest beginnings that are indexed.
K1, B, SHORTEST, LONGEST = 1.2, 0.75, 2, 20
#: Parts that the postings of a field are dealt to by their token, and parts by document within each, for frequent tokens.
SLOTS, SPREAD = 64, 8


def words(c: Column) -> Column:
    """Words in lower case, in order; a null text has none."""
    return F.filter(F.split(F.lower(F.coalesce(c, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def word_list(text: str) -> tuple[str, ...]:
    return tuple(re.findall(r"[^\W_]+", text.lower()))


@dataclass(frozen=True)
class Wanted:
    """A text fits if it holds one phrase of each group of ``every`` and none of ``none``."""

    every: tuple[tuple[str, ...], ...]
    none: tuple[str, ...] = ()

    def __post_init__(self):
        if not self.every or not all(any(word_list(p) for p in g) for g in self.every):
            raise ValueError("each group needs a phrase with a word")

    @property
    def groups(self) -> list[list[tuple[str, ...]]]:
        return [[word_list(p) for p in g if word_list(p)] for g in self.every]

    @property
    def vocabulary(self) -> list[str]:
        return sorted({w for g in self.groups for p in g for w in p})


def _let(value: Column, body) -> Column:
    """``body`` of a value that is worked out once, however often it is named there."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _most(cols: list[Column]) -> Column:
    return F.greatest(*cols) if len(cols) > 1 else cols[0]


def _ends_here(ts: Column, i: Column, phrase: tuple[str, ...]) -> Column:
    """The place where the phrase begins, if it ends at word ``i``."""
    first = i - (len(phrase) - 1)
    return F.when(reduce(Column.__and__, (F.get(ts, first + j) == w for j, w in enumerate(phrase))), first)


def _holds(ts: Column, phrase: tuple[str, ...]) -> Column:
    return F.exists(F.transform(ts, lambda w, i: _ends_here(ts, i, phrase)), lambda s: s.isNotNull())


def _may_hold(text: Column, wanted: Wanted) -> Column:
    """Cheap and never wrong about a text that fits: its words are pieces of the text."""
    low = F.lower(text)
    has = lambda p: reduce(Column.__and__, (F.contains(low, F.lit(w)) for w in p))
    return reduce(Column.__and__, (reduce(Column.__or__, (has(p) for p in g)) for g in wanted.groups))


def cover_density(ts: Column, wanted: Wanted) -> Column:
    """(rank, covers) of an array of words. A cover is a stretch that holds all groups and no shorter one that does; it counts
    0.1 over one more than its words that the query doesn't name. One walk over the named words, with a state of fixed size."""
    groups = wanted.groups
    names = [f"g{n}" for n in range(len(groups))]
    place = lambda i: F.struct(i.alias("i"), *(_most([_ends_here(ts, i, p) for p in g]).alias(n) for n, g in zip(names, groups)))
    named = F.filter(F.transform(ts, lambda w, i: F.when(w.isin(wanted.vocabulary), place(i))), lambda x: x.isNotNull())
    hits = F.filter(F.transform(named, lambda x, k: F.struct(x.alias("x"), k.alias("k"))), lambda h: F.coalesce(*(h["x"][n] for n in names)).isNotNull())
    last = "struct<p:int,k:int>"
    start = F.struct(*(F.lit(None).cast(last).alias(n) for n in names), F.lit(-1).alias("begun"), F.lit(0.0).alias("rank"), F.lit(0).alias("covers"))

    def walk(a: Column, h: Column) -> Column:
        x, k = h["x"], h["k"]
        now = F.struct(*(F.when(x[n].isNotNull(), F.struct(x[n].alias("p"), (k - (x["i"] - x[n])).alias("k"))).otherwise(a[n]).alias(n) for n in names))
        full = lambda s: reduce(Column.__and__, (s[n].isNotNull() for n in names))
        first = lambda s: F.when(full(s), F.least(*(s[n] for n in names)) if len(names) > 1 else s[names[0]])

        def step(v: Column) -> Column:
            first, cover = v["first"], F.coalesce(v["first"]["p"] > a["begun"], F.lit(False))
            value = COVER_WEIGHT / (1 + (x["i"] - first["p"]) - (k - first["k"]))
            return F.struct(
                *(v["now"][n].alias(n) for n in names), F.when(cover, first["p"]).otherwise(a["begun"]).alias("begun"),
                (a["rank"] + F.when(cover, value).otherwise(0.0)).alias("rank"), (a["covers"] + cover.cast("int")).alias("covers"),
            )

        return _let(now, lambda s: _let(F.struct(s.alias("now"), first(s).alias("first")), step))

    return F.aggregate(hits, start, walk, lambda a: F.struct(a["rank"].alias("rank"), a["covers"].alias("covers")))


def rank_pages(pages: DataFrame, wanted: Wanted, text: str = "text", literal: str | None = None) -> DataFrame:
    """Pages that fit, with ``rank`` and ``covers``; with ``literal``, also those that hold this text as it stands (in any
    case), at rank 0. Null and empty texts don't fit. Columns of these
    names that pages have already are replaced. Nothing is shuffled; texts without the words are never split."""
    found = F.lit(False) if literal is None else F.contains(F.lower(F.col(text)), F.lit(literal.strip().lower()))
    maybe = _may_hold(F.col(text), wanted)
    barred = lambda ts: reduce(Column.__or__, (_holds(ts, word_list(p)) for p in wanted.none if word_list(p)), F.lit(False))
    nothing = F.struct(F.lit(0.0).alias("rank"), F.lit(0).alias("covers"))
    ranked = F.when(maybe, _let(words(F.col(text)), lambda ts: F.when(barred(ts), nothing).otherwise(cover_density(ts, wanted)))).otherwise(nothing)
    # a generator works the rank out once; a column would be copied into the filter
    out = pages.drop("rank", "covers").where(maybe | found).select("*", F.inline(F.array(ranked)))
    return out.where((F.col("covers") > 0) | found)


def excerpt(text: Column, terms: list[str]) -> Column:
    """One line of up to 420 characters around the first of the terms (those of more than two letters), with dots where it is cut."""
    flat = F.trim(F.regexp_replace(text, r"[\s\p{Z}]+", " "))
    places = [F.nullif(F.instr(F.lower(flat), t), F.lit(0)) - 1 for t in terms if len(t) > 2]
    centre = F.coalesce(F.array_min(F.array(*places)), F.lit(0)) if places else F.lit(0)
    begin, n = F.greatest(F.lit(0), centre - LEAD), F.char_length(flat)
    cut = F.trim(F.substring(flat, begin + 1, F.lit(WIDTH)))
    dots = lambda c: F.when(c, "…").otherwise("")
    return F.when(n <= WIDTH, flat).otherwise(F.concat(dots(begin > 0), cut, dots(begin + WIDTH < n)))


def retrieve(pages: DataFrame, wanted: Wanted, scope: DataFrame | None = None, literal: str | None = None, limit: int = 12) -> DataFrame:
    """The best pages of ``pages`` (document_id, page_number, text and more) with rank and excerpt. ``scope`` (document_id) holds
    the documents that may be searched, such as those of one process. Excerpts are cut from the pages that are returned only."""
    if scope is not None:
        pages = pages.join(scope.select("document_id").distinct(), "document_id", "left_semi")
    best = rank_pages(pages, wanted, literal=literal).orderBy(F.desc("rank"), "page_number", "document_id").limit(limit)
    terms = wanted.vocabulary if literal is None else sorted(set(wanted.vocabulary) | set(word_list(literal)))
    return best.withColumn("excerpt", excerpt(F.col("text"), terms)).drop("text")


SAMPLE = Wanted((("the",), ("by the", "with")), none=("erre",))
_RANKS = r"""ts as (select doc_id, lang, source, text, list_filter(string_split_regex(lower(text), '[^\p{L}\p{N}]+'), lambda w: w <> '') as ws from documents),
t as (select doc_id, w, i, lag(w) over (partition by doc_id order by i) as before from (select doc_id, unnest(ws) as w, unnest(range(0, len(ws))) as i from ts where not list_contains(ws, 'erre'))),
h as (select *, row_number() over (partition by doc_id order by i) as k, case when w = 'the' then i end as s0, case when w = 'with' then i when w = 'the' and before = 'by' then i - 1 end as s1 from t where w in ('the', 'by', 'with')),
c as (select doc_id, i, k, last_value(s0 ignore nulls) over d as p0, last_value(case when s0 is not null then k end ignore nulls) over d as k0,
  last_value(s1 ignore nulls) over d as p1, last_value(case when s1 is not null then k - (i - s1) end ignore nulls) over d as k1 from h where s0 is not null or s1 is not null window d as (partition by doc_id order by i)),
v as (select doc_id, i, k, least(p0, p1) as p, case when p0 <= p1 then k0 else k1 end as kp, max(least(p0, p1)) over (partition by doc_id order by i rows between unbounded preceding and 1 preceding) as begun from c where p0 is not null and p1 is not null),
ranks as (select doc_id, sum(0.1 / (1 + (i - p) - (k - kp))) as rank, count(*) as covers from v where begun is null or p > begun group by 1)"""  # fmt: skip


def _pages(lens: Lens) -> DataFrame:
    """Documents as one-page documents; their source stands for the process."""
    return lens.table("documents", F.col("doc_id").alias("document_id"), F.lit(1).alias("page_number"), "source", "text")


@query("page_ranks", f"with {_RANKS} select doc_id, round(rank, 6) as rank, covers from ranks")
def page_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document that fits, with its rank."""
    r = rank_pages(_pages(Lens(spark, sf_dir)), SAMPLE)
    return r.select(F.col("document_id").alias("doc_id"), F.round("rank", 6).alias("rank"), F.col("covers").cast("long").alias("covers"))


@query("page_retrieval", rf"""with {_RANKS}, f as (select doc_id, trim(regexp_replace(text, '[\s\p{{Z}}]+', ' ', 'g')) as f from documents),
a as (select doc_id, f, greatest(0, coalesce(least(nullif(strpos(lower(f), 'the'), 0), nullif(strpos(lower(f), 'with'), 0)) - 1, 0) - 140) as b from f)
select doc_id, round(rank, 6) as rank, case when length(f) <= 420 then f else case when b > 0 then '…' else '' end || trim(substr(f, b + 1, 420)) || case when b + 420 < length(f) then '…' else '' end end as excerpt
from ranks join a using (doc_id) where doc_id in (select doc_id from documents where source in (select min(source) from documents)) order by ranks.rank desc, doc_id limit 12""")  # fmt: skip
def page_retrieval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The twelve best pages of the first source, each with its excerpt."""
    pages = _pages(Lens(spark, sf_dir))
    scope = pages.join(F.broadcast(pages.agg(F.min("source").alias("source"))), "source").select("document_id")
    r = retrieve(pages, SAMPLE, scope)
    return r.select(F.col("document_id").alias("doc_id"), F.round("rank", 6).alias("rank"), "excerpt")


@dataclass(frozen=True)
class Index:
    """``postings``: (field, token, doc_id, tf, n), n the length of the field there; ``stats``: (field, docs, mean)."""

    postings: DataFrame
    stats: DataFrame
    stored: bool = False


def _starts(ws: Column) -> Column:
    return F.flatten(F.transform(ws, lambda w: F.when(F.char_length(w) >= SHORTEST, F.transform(F.sequence(F.lit(SHORTEST), F.least(F.char_length(w), F.lit(LONGEST))), lambda n: F.substring(w, F.lit(1), n))).otherwise(F.array().cast("array<string>"))))


def build(docs: DataFrame, doc_id: str, texts: tuple[str, ...] = (), codes: tuple[str, ...] = (), starts: tuple[str, ...] = ()) -> Index:
    """Index of text fields (their words), fields of codes (strings or lists of strings, as they stand) and beginnings of words of
    the fields ``starts`` (named ``field.start``). Fields without a token have no postings and don't count in a mean."""
    lists = {f: words(F.col(f)) for f in texts} | {f"{f}.start": _starts(words(F.col(f))) for f in starts}
    for f in codes:
        c = F.col(f) if docs.schema[f].dataType.typeName() == "array" else F.array(f)
        lists[f] = F.array_distinct(F.filter(c.cast("array<string>"), lambda x: x.isNotNull() & (x != "")))
    names = list(lists)
    cut = docs.select(F.col(doc_id).alias("doc_id"), *(F.coalesce(c, F.array().cast("array<string>")).alias(f"c{n}") for n, c in enumerate(lists.values())))
    token = lambda n, f: F.transform(f"c{n}", lambda t: F.struct(F.lit(f).alias("field"), t.alias("token"), F.size(f"c{n}").alias("n")))
    all_ = cut.select("doc_id", F.inline(F.concat(*(token(n, f) for n, f in enumerate(names)))))
    postings = all_.groupBy("field", "token", "doc_id", "n").agg(F.count("*").alias("tf")).select("field", "token", "doc_id", "tf", "n")
    some = lambda n: F.when(F.size(f"c{n}") > 0, F.size(f"c{n}"))
    one = cut.agg(*(F.struct(F.lit(f).alias("field"), F.count(some(n)).alias("docs"), F.avg(some(n)).alias("mean")).alias(f"c{n}") for n, f in enumerate(names)))
    return Index(postings, one.select(F.inline(F.array(*(f"c{n}" for n in range(len(names)))))))


def _slot(token: Column) -> Column:
    return F.pmod(F.xxhash64(token), F.lit(SLOTS)).cast("int")


def store(index: Index, folder: str) -> Index:
    """Writes the index by field and slot of the token, sorted by token: a search opens the slots of its words only. Postings of
    one frequent token are written by up to ``SPREAD`` tasks."""
    p = index.postings.withColumn("slot", _slot(F.col("token")))
    spread = F.pmod(F.xxhash64("doc_id"), F.lit(SPREAD))
    p.repartition("field", "slot", spread).sortWithinPartitions("field", "slot", "token", "doc_id").write.partitionBy("field", "slot").parquet(f"{folder}/postings")
    index.stats.coalesce(1).write.parquet(f"{folder}/stats")
    return load(index.postings.sparkSession, folder)


def load(spark: SparkSession, folder: str) -> Index:
    return Index(spark.read.parquet(f"{folder}/postings"), spark.read.parquet(f"{folder}/stats"), stored=True)


def _postings(index: Index, fields: list[str], tokens: list[str]) -> DataFrame:
    p = index.postings.where(F.col("field").isin(fields) & F.col("token").isin(tokens))
    if index.stored:  # the slots of constants fold into a filter of partitions
        p = p.where(reduce(Column.__or__, (F.col("slot") == _slot(F.lit(t)) for t in tokens)))
    return p.select("field", "token", "doc_id", "tf", "n")


def search(index: Index, text: str, boosts: dict[str, float], code_boosts: dict[str, float] | None = None) -> DataFrame:
    """(doc_id, score, field): records with a text field that holds all words of ``text``, by the best boosted BM25 of such fields
    (``field`` names it, the first by name of equals). ``code_boosts``: fields of codes that are compared with the text as it
    stands; their best score, which doesn't count lengths, is added, and a record may have it alone. One shuffle, by record."""
    tokens, codes = sorted(set(word_list(text))), code_boosts or {}
    whole = text.strip()
    if not tokens and not whole:
        raise ValueError("an empty text finds nothing")
    parts = [_postings(index, list(boosts), tokens)] if tokens and boosts else []
    parts += [_postings(index, list(codes), [whole])] if codes and whole else []
    hits = reduce(DataFrame.unionByName, parts)
    df = hits.groupBy("field", "token").agg(F.count("*").alias("df"))  # a row a field and word of the text
    stats = index.stats.where(F.col("field").isin([*boosts, *codes]))  # a row a field
    s = hits.join(F.broadcast(df), ["field", "token"]).join(F.broadcast(stats), "field")
    idf = F.log(1 + (F.col("docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    length = F.when(F.col("field").isin(list(codes)), 1.0).otherwise(1 - B + B * F.col("n") / F.col("mean"))
    s = s.withColumn("part", idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * length))
    f = lambda name: F.col("field") == name
    sums = [F.when(F.count(F.when(f(n), 1)) == len(tokens), F.struct((F.sum(F.when(f(n), F.col("part"))) * b).alias("score"), F.lit(-k).alias("k"))) for k, (n, b) in enumerate(sorted(boosts.items()))]
    exact = [F.struct((F.sum(F.when(f(n), F.col("part"))) * b).alias("score"), F.lit(-len(boosts) - k).alias("k")) for k, (n, b) in enumerate(sorted(codes.items()))]
    exact = [F.when(e["score"].isNotNull(), e) for e in exact]
    none = F.lit(None).cast("struct<score:double,k:int>")
    g = s.groupBy("doc_id").agg((_most(sums) if sums else none).alias("t"), (_most(exact) if exact else none).alias("c")).where("t is not null or c is not null")
    names = F.array(*map(F.lit, [*sorted(boosts), *sorted(codes)]))
    best = F.get(names, -F.coalesce("t.k", "c.k"))
    return g.select("doc_id", (F.coalesce("t.score", F.lit(0.0)) + F.coalesce("c.score", F.lit(0.0))).alias("score"), best.alias("field"))


def having(index: Index, hits: DataFrame, field: str, code: str, prefix: bool = False) -> DataFrame:
    """Hits whose record has a code, or one that begins so. Statistics are those of the whole index, filtered or not."""
    p = index.postings.where((F.col("field") == field) & (F.startswith(F.col("token"), F.lit(code)) if prefix else F.col("token") == code))
    if index.stored and not prefix:
        p = p.where(F.col("slot") == _slot(F.lit(code)))
    return hits.join(p.select("doc_id"), "doc_id", "left_semi")


def page(hits: DataFrame, offset: int = 0, limit: int = 20) -> DataFrame:
    """A page by falling score, ties by record, with the number of all hits in ``total``."""
    best = hits.orderBy(F.desc("score"), "doc_id")
    best = (best.offset(offset) if offset else best).limit(limit)
    return best.crossJoin(F.broadcast(hits.agg(F.count("*").alias("total"))))


ACT_BOOSTS = {"title": 3.0, "buyer_name": 2.0, "supplier_names": 1.0}


def act_records(lens: Lens) -> DataFrame:
    """Acts as records of the index: title, names of buyer and suppliers, codes, places."""
    s = lens.table("supplier", F.col("s_suppkey").alias("supplier_id"), F.col("s_name"))
    names = lens.suppliers.select("act_id", "supplier_id").join(s, "supplier_id").groupBy("act_id").agg(F.array_join(F.array_sort(F.collect_list("s_name")), " ").alias("supplier_names"))
    codes = lens.codes.groupBy("act_id").agg(F.collect_set("cpv_code").alias("cpv_codes"))
    c = lens.table("customer", F.col("c_custkey").alias("buyer_id"), F.col("c_name").alias("buyer_name"))
    a = lens.acts.select("act_id", "buyer_id").join(c, "buyer_id", "left").join(lens.primary.select("act_id", "title"), "act_id", "left")
    return a.join(names, "act_id", "left").join(codes, "act_id", "left").join(lens.locations.select("act_id", "nuts_code"), "act_id", "left").drop("buyer_id")


_FIELDS = """rec as (select act_id, title, c_name as buyer_name, names as supplier_names from acts left join prime using (act_id) left join customer on buyer_id = c_custkey
  left join (select act_id, string_agg(s_name, ' ') as names from suppliers join supplier on supplier_id = s_suppkey group by 1) using (act_id)),
fld as (select act_id, 'title' as field, 3.0 as boost, title as x from rec union all select act_id, 'buyer_name', 2.0, buyer_name from rec union all select act_id, 'supplier_names', 1.0, supplier_names from rec),
tok as (select act_id, field, boost, list_filter(string_split_regex(lower(coalesce(x, '')), '[^a-z0-9]+'), lambda w: w <> '') as ws from fld),
st as (select field, count(*) as docs, avg(len(ws)) as mean from tok where len(ws) > 0 group by 1),
tf as (select act_id, field, boost, len(ws) as n, q, len(list_filter(ws, lambda w: w = q)) as tf from tok, (select unnest({words}) as q) where list_contains(ws, q)),
sc as (select act_id, field, boost * sum(ln(1 + (docs - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * n / mean))) as score from tf join st using (field) join (select field, q, count(*) as df from tf group by all) using (field, q)
  group by act_id, field, boost having count(*) = len({words})),
hits as (select act_id, max(score) as score, arg_max(field, score) as field from sc group by 1)"""  # fmt: skip


def _act_index(lens: Lens) -> Index:
    return build(act_records(lens), "act_id", texts=tuple(ACT_BOOSTS), codes=("cpv_codes", "nuts_code"))


@query("act_search", sql("select act_id, round(score, 6) as score, field from hits where act_id in (select act_id from codes where starts_with(cpv_code, 'Brand#1')) and act_id in (select act_id from locations where nuts_code = 'N07')", _FIELDS.format(words="['red', 'widget']")))
def act_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All acts with both words in one field, in one place, with a code of one beginning."""
    ix = _act_index(Lens(spark, sf_dir))
    hits = having(ix, having(ix, search(ix, "red widget", ACT_BOOSTS), "cpv_codes", "Brand#1", prefix=True), "nuts_code", "N07")
    return hits.select(F.col("doc_id").alias("act_id"), F.round("score", 6).alias("score"), "field")


@query("act_search_page", sql("select act_id, round(score, 6) as score, field, (select count(*) from hits) as total from hits order by hits.score desc, act_id limit 20", _FIELDS.format(words="['supplier', '000000003']")))
def act_search_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first page of acts of a named supplier."""
    ix = _act_index(Lens(spark, sf_dir))
    return page(search(ix, "Supplier#000000003", ACT_BOOSTS)).select(F.col("doc_id").alias("act_id"), F.round("score", 6).alias("score"), "field", "total")


@query("company_search", """with c as (select 'C' || c_custkey as id, c_name as name, lpad(cast(c_custkey as varchar), 9, '0') as code from customer union all select 'S' || s_suppkey, s_name, lpad(cast(s_suppkey as varchar), 9, '0') from supplier),
g as (select id, code, flatten(list_transform(list_filter(string_split_regex(lower(name), '[^a-z0-9]+'), lambda w: length(w) > 1), lambda w: list_transform(range(2, least(length(w), 20) + 1), lambda n: substr(w, 1, n)))) as gs from c),
x as (select id, len(gs) as n, len(list_filter(gs, lambda w: w = '000000007')) as tf from g where list_contains(gs, '000000007')), m as (select count(*) as docs, avg(len(gs)) as mean from g where len(gs) > 0),
t as (select id, 5 * ln(1 + (docs - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * n / mean)) as score from x, m, (select count(*) as df from x)),
k as (select id, 8 * ln(1 + (docs - df + 0.5) / (df + 0.5)) as score from c, (select count(*) as docs, count(*) filter (code = '000000007') as df from c) where code = '000000007')
select id, round(coalesce(t.score, 0) + coalesce(k.score, 0), 6) as score, case when t.id is null then 'identifier' else 'name.start' end as field from t full join k using (id)""")  # fmt: skip
def company_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Companies by the beginnings of their names' words, and by identifier."""
    lens = Lens(spark, sf_dir)
    company = lambda t, p, kind: lens.table(t, F.concat(F.lit(kind), F.col(f"{p}key").cast("string")).alias("id"), F.col(f"{p[0]}_name").alias("name"), F.lpad(F.col(f"{p}key").cast("string"), 9, "0").alias("identifier"))
    both = company("customer", "c_cust", "C").unionByName(company("supplier", "s_supp", "S"))
    ix = build(both, "id", codes=("identifier",), starts=("name",))
    return search(ix, "000000007", {"name.start": 5.0}, {"identifier": 8.0}).select(F.col("doc_id").alias("id"), F.round("score", 6).alias("score"), "field")
