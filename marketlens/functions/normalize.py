"""Normalising of source values as Column expressions: lists, coded and localized fields, countries, places, domains, contacts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from marketlens.functions.text import GREEK_FROM, GREEK_TO, stem, tokens

#: Three-letter country codes whose two-letter code isn't their beginning.
ISO3 = {"GRC": "EL", "AUT": "AT", "DNK": "DK", "EST": "EE", "IRL": "IE", "MLT": "MT", "POL": "PL", "PRT": "PT", "SVK": "SK", "SVN": "SI", "SWE": "SE"}


def unwrap(c: Column, prefer: str = "value") -> Column:
    """Text of a coded JSON field {key, value}: the preferred part, else the other, one level of nesting deep; else as it is."""
    other = "key" if prefer == "value" else "value"
    inner = [F.get_json_object(c, f"$.{p}") for p in (f"{prefer}.{prefer}", f"{prefer}.{other}", prefer, other)]
    plain = F.when(F.trim(c).startswith("{"), None).otherwise(c)
    return F.nullif(F.trim(F.coalesce(*inner, plain)), F.lit(""))


def flat_list(*lists: Column) -> Column:
    """The values of some lists (arrays or single texts made arrays) in order, each once, without nulls and blanks."""
    all_ = F.flatten(F.array(*(F.coalesce(x, F.array().cast("array<string>")) for x in lists)))
    return F.array_distinct(F.filter(F.transform(all_, lambda x: F.trim(x)), lambda x: x.isNotNull() & (x != "")))


def localized(texts: Column, languages: tuple[str, ...] = ("ell", "eng")) -> Column:
    """First text of the first language that has one, else of any (a map from language to texts)."""
    first = [F.get(F.element_at(texts, F.lit(k)), 0) for k in languages]
    return F.coalesce(*first, F.get(F.flatten(F.map_values(texts)), 0))


def country(c: Column) -> Column:
    """Two-letter code of a country: by table, else the first two letters."""
    u = F.upper(F.trim(c))
    out = F.when(F.lit(False), F.lit(""))
    for long, short in ISO3.items():
        out = out.when(u == long, short)
    return F.nullif(out.otherwise(F.substring(u, 1, 2)), F.lit(""))


def earliest_deadline(dates: Column, times: Column) -> Column:
    """The earliest of some days with times of day; a day without time ends at 23:59:59."""
    both = F.arrays_zip(dates.alias("d"), times.alias("t"))
    at = F.transform(both, lambda x: F.when(x["d"].isNotNull(), F.concat(x["d"], F.lit(" "), F.coalesce(x["t"], F.lit("23:59:59")))))
    return F.array_min(F.transform(at, lambda x: F.try_to_timestamp(x, F.lit("yyyy-MM-dd HH:mm:ss"))))


def lexicon(c: Column, entries: dict[str, str]) -> Column:
    """What a label stands for, found without accents and case; the label itself where the lexicon has none."""
    key = F.upper(F.translate(F.lower(F.trim(c)), GREEK_FROM, GREEK_TO))
    out = F.when(F.lit(False), F.lit(""))
    for label, code in entries.items():
        out = out.when(key == label, code)
    return out.otherwise(F.trim(c))


def domain(c: Column) -> Column:
    """Host of an address without scheme, www., port and path."""
    return F.nullif(F.regexp_extract(F.lower(F.trim(c)), r"^(?:[a-z][a-z0-9+.-]*://)?(?:www\.)?([^/:?#\s]+)", 1), F.lit(""))


def unaccented(c: Column) -> Column:
    return F.translate(F.lower(c), GREEK_FROM + "àáâãäåçèéêëìíîïñòóôõöùúûüýÿ", GREEK_TO + "aaaaaaceeeeiiiinooooouuuuyy")


def place(c: Column) -> Column:
    """Name of a place for comparing: without accents, upper case, other characters as one blank."""
    return F.trim(F.regexp_replace(F.upper(unaccented(c)), r"[^\p{L}\p{N}]+", " "))


def greek_nuts(c: Column) -> Column:
    """NUTS code of a Greek region under EL, whichever prefix it came with; null for others."""
    rest = F.regexp_extract(F.upper(F.trim(c)), r"^(?:EL|GR)([0-9A-Z]{0,3})$", 1)
    return F.when(F.upper(F.trim(c)).rlike(r"^(?:EL|GR)[0-9A-Z]{0,3}$"), F.concat(F.lit("EL"), rest))


def excerpt(c: Column, terms: list[str], width: int = 420) -> Column:
    """``width`` characters around the first hit of any term (in any case); the beginning where there is none."""
    hits = F.array(*(F.nullif(F.instr(F.lower(c), t.lower()), F.lit(0)) for t in terms))
    at = F.coalesce(F.array_min(hits), F.lit(1))
    return F.substring(c, F.greatest(at - width // 2, F.lit(1)), F.lit(width))


# Formats of public contacts.
EMAIL, PHONE = r"^[^@\s]+@[^@\s]+\.[^@\s]+$", r"^[+()\d\s./-]{7,30}$"


def valid_email(c: Column) -> Column:
    return F.coalesce(F.trim(c).rlike(EMAIL), F.lit(False))


def valid_phone(c: Column) -> Column:
    return F.coalesce(F.trim(c).rlike(PHONE), F.lit(False))


def official_link(scheme: Column, identifier: Column, base: str = "https://example.org") -> Column:
    """Address of the official page of an identifier by its scheme; null for schemes without one."""
    path = F.when(scheme == "ADA", "decision").when(scheme == "ADAM", "act").when(scheme == "NOTICE", "notice").when(scheme == "REGISTRY", "company")
    return F.concat(F.lit(f"{base}/"), path, F.lit("/"), identifier)


def token_pattern(token: str, stemmed: str) -> str:
    """Word pattern of one query token: short ones as they are, others by their stem with any ending."""
    return rf"\b{token}\b" if len(token) <= 3 else rf"\b{stemmed}[a-z0-9α-ω]*\b"


def concept(spark, value: str, limit: int = 8) -> tuple[str, str]:
    """(prefilter, pattern) of a query: its longest stem, and one pattern that asks for all its tokens in any order."""
    row = spark.range(1).select(tokens(F.lit(value)).alias("t"), F.transform(tokens(F.lit(value)), lambda x: stem(x)).alias("s")).first()
    some = list(dict.fromkeys(zip(row.t, row.s, strict=True)))[:limit]
    return max((s for _, s in some), key=len, default=""), "".join(f"(?=.*{token_pattern(t, s)})" for t, s in some) + ".*"
