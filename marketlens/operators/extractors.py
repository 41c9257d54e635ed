"""Typed fields of texts with their places, precedence and check sums, over notices derived from the order tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marketlens.functions import spans
from marketlens.functions import text as T
from marketlens.lens import Lens
from marketlens.operators import dossier
from marketlens.registry import query

#: Genitive month names, in order.
MONTHS = (
    "Ιανουαρίου", "Φεβρουαρίου", "Μαρτίου", "Απριλίου", "Μαΐου", "Ιουνίου", "Ιουλίου", "Αυγούστου",
    "Σεπτεμβρίου", "Οκτωβρίου", "Νοεμβρίου", "Δεκεμβρίου",
)

#: Kinds of act by the type token of a registry number (fixed values).
CATEGORIES = {"REQ": "REQUEST", "PROC": "NOTICE", "AWRD": "AWARD", "SYMV": "CONTRACT", "PAY": "PAYMENT"}
_TYPES = tuple(CATEGORIES)

_NOTICES = """notices as (select o_orderkey as id, 'ΑΔΑ: ' || lpad(cast(o_orderkey as varchar), 7, '0') || 'ΩΨ-' || substr('ΑΒΓΔΕΖΗ', cast(o_orderkey % 5 as int) + 1, 3)
  || ' ΑΔΑΜ ' || lpad(cast(o_orderkey % 30 as varchar), 2, '0') || ['REQ', 'PROC', 'AWRD', 'SYMV', 'PAY'][cast(o_orderkey % 5 as int) + 1] || lpad(cast(o_orderkey as varchar), 9, '0')
  || ' ΑΦΜ ' || lpad(cast(o_custkey * 7919 as varchar), 9, '0') || ' κωδικός ' || lpad(cast(o_custkey as varchar), 9, '0')
  || ' CPV ' || lpad(cast(o_orderkey * 13 as varchar), 8, '0') || ' και ' || lpad(cast(o_custkey * 17 as varchar), 8, '0') || '-' || cast(o_custkey % 10 as varchar)
  || ' ΟΠΣ ' || cast(5000000 + o_custkey as varchar) || ' αρ. πρωτ. ' || cast(o_orderkey as varchar) || '/' || cast(year(o_orderdate) as varchar)
  || ' διάρκεια ' || cast(o_orderkey % 36 + 1 as varchar) || ' μήνες, ' || cast(o_orderkey % 4 + 1 as varchar) || ' τμήματα, έως '
  || cast(o_orderkey % 40 as varchar) || ' ' || ['Ιανουαρίου', 'Μαρτίου', 'Μαΐου', 'Αυγούστου', 'Δεκεμβρίου'][cast(o_custkey % 5 as int) + 1] || ' ' || cast(year(o_orderdate) as varchar)
  || ', ' || cast(o_custkey % 1000 as varchar) || '.' || lpad(cast(o_orderkey % 1000 as varchar), 3, '0') || ',50 € ' || case when o_orderkey % 2 = 0 then 'χωρίς ΦΠΑ' else 'με ΦΠΑ' end as text from orders)"""


def notices(lens: Lens) -> DataFrame:
    """(id, text): one notice for each order, with the fields that notices name."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    s = lambda x: x.cast("string")
    pad = lambda x, n: F.when(F.length(s(x)) >= n, F.substring(s(x), 1, n)).otherwise(F.lpad(s(x), n, "0"))
    pick = lambda names, i: F.element_at(F.array(*map(F.lit, names)), i.cast("int") + 1)
    year = s(F.year("o_orderdate"))
    months = tuple(MONTHS[i] for i in (0, 2, 4, 7, 11))
    parts = [
        "ΑΔΑ: ", pad(k, 7), "ΩΨ-", F.substring(F.lit("ΑΒΓΔΕΖΗ"), (k % 5).cast("int") + 1, F.lit(3)), " ΑΔΑΜ ", pad(k % 30, 2), pick(_TYPES, k % 5), pad(k, 9),
        " ΑΦΜ ", pad(c * 7919, 9), " κωδικός ", pad(c, 9), " CPV ", pad(k * 13, 8), " και ", pad(c * 17, 8), "-", s(c % 10), " ΟΠΣ ", s(c + 5000000),
        " αρ. πρωτ. ", s(k), "/", year, " διάρκεια ", s(k % 36 + 1), " μήνες, ", s(k % 4 + 1), " τμήματα, έως ", s(k % 40), " ", pick(months, c % 5), " ", year,
        ", ", s(c % 1000), ".", pad(k % 1000, 3), ",50 € ", F.when(k % 2 == 0, "χωρίς ΦΠΑ").otherwise("με ΦΠΑ"),
    ]
    return lens.table("orders", "o_orderkey", "o_custkey", "o_orderdate").select(k.alias("id"), F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts)).alias("text"))


def matches(text: Column, pattern: str) -> Column:
    """All matches of a pattern as (value, start, end), places counted from 0: one walk over the pieces between matches carries
    the place along."""
    values, between = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    none = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("starts"))
    turns = F.when(F.size(values) > 0, F.sequence(F.lit(0), F.size(values) - 1)).otherwise(F.array().cast("array<int>"))

    def walk(a: Column, i: Column) -> Column:
        start = a["at"] + F.char_length(F.get(between, i))
        return F.struct((start + F.char_length(F.get(values, i))).alias("at"), F.array_append(a["starts"], start).alias("starts"))

    starts = F.aggregate(turns, none, walk, lambda a: a["starts"])
    both = F.transform(F.arrays_zip(values.alias("value"), starts.alias("start")), lambda x: F.struct(x["value"].alias("value"), x["start"].alias("start"), (x["start"] + F.char_length(x["value"])).alias("end")))
    return both


def fields(docs: DataFrame, pattern: str) -> DataFrame:
    """(id, value, start, end) of all matches in (id, text)."""
    return docs.select("id", F.explode(matches(F.col("text"), pattern)).alias("m")).select("id", "m.*")


#: No letter or digit before, and none behind.
_FREE, _END = "(?<![\\p{L}0-9_])", "(?![\\p{L}0-9_])"
# Formats of numbers; the SQL of the queries, whose texts have blanks around them, needs no borders.
_ADA, _ADAM = "[0-9Α-Ω]{6,10}-[Α-Ω]{3,4}", "[0-9]{2}(?:REQ|PROC|AWRD|SYMV|PAY)[0-9]{6,10}"
ADA, ADAM = _FREE + _ADA + _END, _FREE + _ADAM + _END
MIS = "(?:ΟΠΣ|MIS) [0-9]{5,8}"
PROTOCOL = "αρ\\. πρωτ\\. [0-9]+/[0-9]{4}"
DURATION = "[0-9]+ (?:ημέρες|μήνες|έτη)"
LOTS = "[0-9]+ τμήματα"


def _spans(pattern: str, value: str) -> str:
    return f"with {_NOTICES} select id, m as value, cast(strpos(text, m) - 1 as int) as start, cast(strpos(text, m) - 1 + length(m) as int) as \"end\"{value} from (select id, text, unnest(regexp_extract_all(text, '{pattern}')) as m from notices)"


@query("field_ada", _spans(_ADA, ""))
def field_ada(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decision numbers."""
    return fields(notices(Lens(spark, sf_dir)), ADA)


@query("field_adam", _spans(_ADAM, ", case regexp_extract(m, '[A-Z]+') " + " ".join(f"when '{k}' then '{v}'" for k, v in CATEGORIES.items()) + " end as category"))
def field_adam(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Registry numbers with the kind of act they name."""
    kind = F.regexp_extract("value", "[A-Z]+", 0)
    category = F.lit(None).cast("string")
    for k, v in CATEGORIES.items():
        category = F.when(kind == k, v).otherwise(category)
    return fields(notices(Lens(spark, sf_dir)), ADAM).withColumn("category", category)


_VAT_OK = "(list_sum(list_transform(range(1, 9), lambda i: cast(substr(v, i, 1) as int) * cast(pow(2, 9 - i) as int))) % 11) % 10 = cast(substr(v, 9, 1) as int)"


def vat_numbers(docs: DataFrame) -> DataFrame:
    """(id, value, labelled, valid): labelled numbers always, bare ones only if their check sum is right; a number that a
    label has claimed isn't reported again as a bare one."""
    labelled = fields(docs, f"(?iu)(?:ΑΦΜ|Α\\.Φ\\.Μ\\.?|VAT)\\s*[:.]?\\s*[0-9]{{9}}{_END}").select("id", F.expr("right(value, 9)").alias("value"), (F.col("end") - 9).alias("start"), F.lit(True).alias("labelled"))
    bare = fields(docs, f"{_FREE}[0-9]{{9}}{_END}").select("id", "value", "start", F.lit(False).alias("labelled"))
    both = labelled.unionByName(bare).groupBy("id", "start", "value").agg(F.max("labelled").alias("labelled")).withColumn("valid", T.valid_vat(F.col("value")))
    return both.where("labelled or valid").select("id", "value", "labelled", "valid")


@query("field_vat", f"""with {_NOTICES}, l as (select id, regexp_extract(text, 'ΑΦΜ ([0-9]{{9}})', 1) as v, true as labelled from notices union all select id, regexp_extract(text, 'κωδικός ([0-9]{{9}})', 1), false from notices)
select id, v as value, labelled, {_VAT_OK} as valid from l where labelled or {_VAT_OK}""")  # fmt: skip
def field_vat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vat_numbers(notices(Lens(spark, sf_dir)))


def cpv_codes(docs: DataFrame) -> DataFrame:
    """(id, value, checked): codes with their check digit, and labelled ones of eight digits without."""
    full = fields(docs, "\\b[0-9]{8}-[0-9]\\b").select("id", "value", F.lit(True).alias("checked"))
    label = fields(docs, "CPV:? [0-9]{8}(?![0-9-])").select("id", F.expr("right(value, 8)").alias("value"), F.lit(False).alias("checked"))
    return full.unionByName(label)


@query("field_cpv", f"""with {_NOTICES} select id, unnest(regexp_extract_all(text, '[0-9]{{8}}-[0-9]')) as value, true as checked from notices
union all select id, regexp_extract(text, 'CPV ([0-9]{{8}}) ', 1), false from notices where regexp_matches(text, 'CPV [0-9]{{8}} ')""")  # fmt: skip
def field_cpv(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cpv_codes(notices(Lens(spark, sf_dir)))


for _name, _pattern, _doc in (("mis", MIS, "Funding codes, only where labelled."), ("protocol", PROTOCOL, "Protocol numbers with their year."), ("duration", DURATION, "Durations."), ("lots", LOTS, "Numbers of lots.")):

    def _run(spark: SparkSession, sf_dir: str, pattern=_pattern) -> DataFrame:
        return fields(notices(Lens(spark, sf_dir)), pattern)

    _run.__doc__ = _doc
    query(f"field_{_name}", _spans(_pattern, ""))(_run)


def text_dates(docs: DataFrame) -> DataFrame:
    """(id, value, day): days written with the name of a month, only those that the calendar has."""
    found = fields(docs, "[0-9]{1,2} (?:" + "|".join(MONTHS) + ") [0-9]{4}")
    part = F.split("value", " ")
    month = F.array_position(F.array(*map(F.lit, MONTHS)), part[1])
    day = F.try_to_timestamp(F.concat_ws("-", part[2], F.lpad(month.cast("string"), 2, "0"), F.lpad(part[0], 2, "0")), F.lit("yyyy-MM-dd")).cast("date")
    return found.select("id", "value", day.alias("day")).where("day is not null")


@query("field_dates", f"""with {_NOTICES}, m as (select id, regexp_extract(text, '([0-9]+ [Α-Ωα-ωΐίύό]+ [0-9]{{4}}), ', 1) as value from notices),
  d as (select id, value, try_cast(split_part(value, ' ', 3) || '-' || case split_part(value, ' ', 2) when 'Ιανουαρίου' then '01' when 'Μαρτίου' then '03' when 'Μαΐου' then '05' when 'Αυγούστου' then '08' else '12' end
    || '-' || lpad(split_part(value, ' ', 1), 2, '0') as date) as day from m)
select id, value, day from d where day is not null""")  # fmt: skip
def field_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text_dates(notices(Lens(spark, sf_dir)))


def amounts(docs: DataFrame) -> DataFrame:
    """(id, value, amount, vat): amounts next to a currency in all their shapes, with the nearest word on tax."""
    pages = docs.select(F.col("id").alias("document_id"), F.lit(0).alias("page_number"), F.lit(1.0).alias("scale"), "text")
    found = dossier.amounts(spans.find(pages, "text", {**{k: (v, None, dossier.NEEDED[k]) for k, v in dossier.AMOUNTS.items()}, **{f"tax_{k}": v for k, v in dossier.TAX.items()}}))
    return found.select(F.col("document_id").alias("id"), "value", "amount", F.regexp_replace("tax", "_VAT$", "").alias("vat"))


@query("field_amounts", f"""with {_NOTICES} select id, value, cast(replace(regexp_replace(value, '[^0-9,]', '', 'g'), ',', '.') as decimal(20,2)) as amount, case when contains(text, 'χωρίς ΦΠΑ') then 'WITHOUT' else 'WITH' end as vat
from (select id, text, regexp_extract(text, '[0-9]{{1,3}}\\.[0-9]{{3}},[0-9]{{2}} €') as value from notices)""")  # fmt: skip
def field_amounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return amounts(notices(Lens(spark, sf_dir)))
