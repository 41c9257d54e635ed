"""Small tables made by hand: odd texts, ties, and precedence of the enrichment operators."""

from __future__ import annotations

import datetime

from marketlens.operators import enrichment as E


def test_keyword_terms_ties_and_empty_texts(spark):
    words = spark.createDataFrame([(1, ["b", "a", "b", "c", "a"]), (2, []), (3, None)], "id long, words array<string>")
    got = sorted((r.id, r["rank"], r.term, round(r.confidence, 2)) for r in E.keyword_terms(words, 2).collect())
    assert got == [(1, 1, "b", 0.8), (1, 2, "a", 0.8)]


def test_catalog_terms_stems_phrases_and_nulls(spark):
    texts = spark.createDataFrame([("painting of walls",), ("painting of walls",), ("",), (None,), ("painters union of all kinds here",)], "text string")
    catalog = spark.createDataFrame([("45440000", "painting of walls"), ("45400000", "paint"), ("90000000", "sewage"), ("10000000", "")], "code string, label string")
    got = {(r.text, r.code): r.score for r in E.catalog_terms(texts, catalog, stem=lambda w: w).collect()}
    # "paint" has five letters, so it begins no longer word
    assert got == {("painting of walls", "45440000"): 0.96}


def test_gazetteer_takes_equal_names_first(spark):
    places = spark.createDataFrame([(1, "athens", "P", "PPL", None), (2, "athens centre", "A", "ADM1", 10_000_000), (3, "volos", "P", "PPL", 0), (4, "volos", "P", "PPL", 1)], "place_id long, alias string, kind string, code string, population long")
    names = spark.createDataFrame([("athens", "REGION"), ("volos", None), ("athens centre north", "REGION"), ("vol", None), (None, None)], "name string, hint string")
    got = {r.name: (r.place_id, r.score) for r in E.gazetteer_matches(names, places).collect()}
    assert got == {"athens": (1, 100.0), "volos": (3, 100.0), "athens centre north": (2, 105.0)}


def test_buyers_by_number_before_name(spark):
    orgs = spark.createDataFrame([(1, "EL 12-3", "x"), (2, None, " town hall "), (3, "99", "gone"), (4, "88", "Town Hall")], "org long, vat string, label string")
    ids = spark.createDataFrame([(7, "123", True, 0.5), (8, "123", True, 0.9), (9, "88", False, 1.0)], "entity long, vat string, valid boolean, confidence double")
    entities = spark.createDataFrame([(5, "TOWN HALL", None), (6, "GONE", 5)], "entity long, name string, merged_into long")
    assert {tuple(r) for r in E.buyers_of(orgs, ids, entities).collect()} == {(1, 8), (2, 5), (4, 5)}


def test_change_queue_repeats_and_order(spark):
    at = lambda h: datetime.datetime(2024, 1, 1, h)
    rows = [(1, 1, at(5), False), (1, 1, at(2), False), (1, 2, at(3), False), (1, 2, at(9), True), (1, 2, at(9), True), (2, 1, at(4), True)]
    got = {(r.act, r.record): (r.available_at, r.requeued) for r in E.change_queue(spark.createDataFrame(rows, "act long, record long, at timestamp, again boolean")).collect()}
    assert got == {(1, 1): (at(2), 0), (1, 2): (at(9), 1), (2, 1): (at(4), 1)}
