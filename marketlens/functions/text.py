"""Text functions as Column expressions: normalising, stemming, trigrams, check sums, field patterns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Accented Greek letters and what they become.
GREEK_FROM, GREEK_TO = "άέήίόύώϊΐϋΰς", "αεηιουωιιυυσ"

#: Suffixes of the light stemmer, in the order in which they are tried.
SUFFIXES = (
    "οποιησεων", "οποιηση", "ησεων", "ησησ", "ηση", "ησεισ", "ησης", "ησεις",
    "ικουσ", "ικους", "ικων", "ικεσ", "ικες", "ικησ", "ικης", "ικοι",
    "ικη", "ικο", "σεων", "σησ", "σεισ", "σης", "σεις", "ουσ", "ους", "ων",
    "εσ", "ες", "οσ", "ος", "ησ", "ης", "ιου", "ου", "ια", "ιο", "ασ",
    "ας", "α", "η", "ο",
)
STEM_LEAST = 4


def normalize_lexical(c: Column) -> Column:
    """Lower case, without Greek accents, runs of other characters as one space."""
    return F.regexp_replace(F.translate(F.lower(c), GREEK_FROM, GREEK_TO), "[^a-z0-9α-ω]+", " ")


def tokens(c: Column) -> Column:
    return F.filter(F.split(F.trim(normalize_lexical(c)), " "), lambda t: t != "")


def stem(c: Column, suffixes: tuple[str, ...] = SUFFIXES, least: int = STEM_LEAST) -> Column:
    """Cuts the first suffix of the list that fits and leaves ``least`` characters."""
    out = F.when(F.lit(False), c)
    for s in suffixes:
        out = out.when(c.endswith(s) & (F.char_length(c) - len(s) >= least), F.substring(c, F.lit(1), F.char_length(c) - len(s)))
    return out.otherwise(c)


def trigrams(c: Column) -> Column:
    """Distinct trigrams of the words of ``c``, each padded by two blanks before and one behind."""
    padded = F.transform(F.filter(F.split(F.lower(c), "[^\\p{L}\\p{N}]+"), lambda w: w != ""), lambda w: F.concat(F.lit("  "), w, F.lit(" ")))
    return F.array_distinct(F.flatten(F.transform(padded, lambda w: F.transform(F.sequence(F.lit(1), F.char_length(w) - 2), lambda i: F.substring(w, i, F.lit(3))))))


def trigram_similarity(a: Column, b: Column) -> Column:
    """Shared trigrams over all trigrams; 0 where there are none."""
    return set_similarity(trigrams(a), trigrams(b))


def set_similarity(a: Column, b: Column) -> Column:
    both = F.size(F.array_intersect(a, b)).cast("double")
    return F.coalesce(both / F.nullif(F.size(F.array_union(a, b)).cast("double"), F.lit(0.0)), F.lit(0.0))


def valid_vat(c: Column) -> Column:
    """Greek VAT number: nine digits, the last one the weighted sum (powers of two) of the others modulo 11, modulo 10."""
    digit = lambda i: F.substring(c, i + 1, F.lit(1)).cast("int")
    total = F.aggregate(F.sequence(F.lit(0), F.lit(7)), F.lit(0), lambda a, i: a + digit(i) * F.element_at(F.array(*(F.lit(2 ** (8 - k)) for k in range(8))), i + 1))
    return F.when(c.rlike("^[0-9]{9}$"), (total % 11) % 10 == digit(F.lit(8))).otherwise(False)


def valid_iban(c: Column) -> Column:
    """Remainder 1 modulo 97, digit by digit, after the first four characters went to the end and letters became numbers."""
    moved = F.concat(F.substring(c, 5, 64), F.substring(c, 1, 4))
    value = lambda x: F.when(x.rlike("[0-9]"), x.cast("int")).otherwise(F.ascii(x) - 55)
    rest = F.aggregate(F.split(moved, ""), F.lit(0), lambda a, x: F.when(x == "", a).otherwise((a * F.when(value(x) > 9, 100).otherwise(10) + value(x)) % 97))
    return F.when(c.rlike("^[A-Z]{2}[0-9]{2}[A-Z0-9]{10,30}$"), rest == 1).otherwise(False)


def identifier_class(c: Column) -> Column:
    """Kind of an identifier: registry number by its type token, decision number, VAT number, or OTHER."""
    u = F.upper(F.trim(c))
    return F.when(u.rlike(r"^\d{2}(REQ|PROC|AWRD|SYMV|PAY)\d{6,10}$"), "ADAM").when(u.rlike("^[0-9Α-Ω]{6,10}-[0-9Α-Ω]{3,4}$"), "ADA").when(u.rlike("^[0-9]{9}$"), "VAT").otherwise("OTHER")


# Roles with the beginnings of words that tell them, in order of precedence.
ROLES = (
    ("PROCUREMENT", "προμηθει|συμβασ|διαγωνισ|procurement|contracting"),
    ("FINANCE", "οικονομ|δημοσιονομ|λογιστηρ|finance|accounting"),
    ("TECHNICAL", "τεχνικ|μηχανικ|πληροφορικ|technical|engineer|digital"),
    ("DEPARTMENT_HEAD", "διευθυν|προϊσταμ|head of|director|manager"),
    ("SIGNATORY", "υπογραφ|δήμαρχ|περιφερειάρχ|γενικ γραμματ|signatory"),
)


def decision_role(title: Column, department: Column | None = None) -> Column:
    """Role of a person by job title and department: the first group of terms that fits; STAKEHOLDER where none does."""
    said = F.concat_ws(" ", title, department) if department is not None else F.coalesce(title, F.lit(""))
    t = F.translate(F.lower(said), "ς", "σ")
    out = F.when(F.lit(False), F.lit(""))
    for role, pattern in ROLES:
        out = out.when(t.rlike(pattern), role)
    return out.otherwise("STAKEHOLDER")
