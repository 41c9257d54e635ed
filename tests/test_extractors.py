"""Numbers with their borders, labels of every spelling, and places in one walk."""

from __future__ import annotations

import re
from decimal import Decimal

from marketlens.operators import extractors as X


def docs(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "id int, text string")


def test_numbers_have_borders(spark):
    df = docs(spark, "123456789012-345 6Ω0Ζ465ΦΘΘ-ΔΕΖ", "1234REQ00000012345678901 25SYMV012345678.", "x25PAY123456", None, "7Α1Η465ΦΘΘ-ΘΙΚ,8Α1Η465ΦΘΘ-ΘΙΚΛ")
    assert sorted((r.id, r.value, r.start, r.end) for r in X.fields(df, X.ADA).collect()) == [(0, "6Ω0Ζ465ΦΘΘ-ΔΕΖ", 17, 31), (4, "7Α1Η465ΦΘΘ-ΘΙΚ", 0, 14), (4, "8Α1Η465ΦΘΘ-ΘΙΚΛ", 15, 30)]
    assert [(r.id, r.value) for r in X.fields(df, X.ADAM).collect()] == [(1, "25SYMV012345678")]


def test_vat_labels(spark):
    df = docs(spark, "Α.Φ.Μ. 094014201", "vat:123456789 και 123456789", "ΑΦΜ 090000045, 090000045, 1090000045")
    got = sorted((r.id, r.value, r.labelled, r.valid) for r in X.vat_numbers(df).collect())
    assert got == [(0, "094014201", True, True), (1, "123456789", True, False), (2, "090000045", False, True), (2, "090000045", True, True)]


def test_amounts(spark):
    df = docs(spark, "1234,50 €", "1,234.56 € με ΦΠΑ", "15.000 € πλέον ΦΠΑ")
    assert sorted((r.id, r.value, r.amount, r.vat) for r in X.amounts(df).collect()) == [(0, "1234,50 €", Decimal("1234.50"), "UNKNOWN"), (1, "1,234.56 €", Decimal("1234.56"), "WITH"), (2, "15.000 €", Decimal("15000.00"), "WITHOUT")]


def test_places_of_many_matches(spark):
    text = " ".join(f"a{'x' * (k % 7)} {k}" for k in range(3_000))
    got = X.fields(docs(spark, text, "", "none"), "[0-9]+").collect()
    assert sorted((r.start, r.end, r.value) for r in got) == [(m.start(), m.end(), m.group()) for m in re.finditer("[0-9]+", text)]
