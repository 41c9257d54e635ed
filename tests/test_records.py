"""Source records of every shape, and child rows by version, on hand-made payloads."""

from __future__ import annotations

import datetime as dt
import json
import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from marketlens.sources import children, records

CONTRACT = {
    "referenceNumber": " 25symv000000001 ", "title": "Cleaning", "submissionDate": "2025-01-10T09:00:00+02:00", "organizationVatNumber": "094259216", "organizationName": "CITY",
    "cpvItems": ["90911200", " 90911200", "", {"key": "90910000", "value": "x"}], "nutsCode": {"key": "EL301", "value": "Athens"}, "nutsCodes": [{"nutsCode": {"key": "EL3", "value": "Attica"}}, "EL301"],
    "decisionRelatedAda": "6ω0ζ465φθθ-δεζ", "contractRelatedADA": ["7Α1Η465ΦΘΘ-ΘΙΚ", "6Ω0Ζ465ΦΘΘ-ΔΕΖ"], "cancellationADA": None, "totalCostWithoutVAT": 100000.0, "totalCostWithVAT": "124000.00",
    "awardees": [{"vatNumber": "090000045", "name": "ALPHA"}, {"vatNumber": "090000045", "name": "ALPHA", "amount": 5}, {"name": "nobody"}],
    "contractingDataDetails": {"contractingMembersDataList": [{"vatNo": "EL 12345", "name": "BETA", "amount": 7}]}, "procedureType": {"key": "1", "value": "OPEN"}, "aaht": "9", "extra": {"a": [1, {"b": 2}]},
}
LINES = {
    "referenceNumber": 17, "objectDetailsList": [{"costWithoutVAT": 10.5, "cpvs": [{"key": "331", "value": "v"}], "city": "Patra", "vatNo": "090000045"}, {"costWithoutVAT": "4.25", "cpvs": {"key": "332"}}, "odd", {"costWithoutVAT": "x"}],
    "totalCostWithoutVAT": 0, "organization": {"key": 55, "value": "ORG"}, "contractors": {"id": 9, "companyName": "SOLO"}, "fundingDetails": {"publicFundingRefOps": "OPS-9"}, "currency": "", "typeOfProcedure": {"wrapped": {"key": "2"}},
    "endDate": "10/01/2025",
}


def normal(spark, *payloads, resource="contract"):
    df = spark.createDataFrame([(i, p if isinstance(p, str) else json.dumps(p)) for i, p in enumerate(payloads)], "n int, p string")
    return records.acts(records.parse(df, "p").drop("p"), resource).orderBy("n").collect()


def test_shapes_of_a_contract(spark):
    a, b, bad, bare = normal(spark, CONTRACT, LINES, "{not json", {})
    assert (a.adam, a.source_native_id, a.act_type, a.submission_date, a.currency) == ("25SYMV000000001", " 25symv000000001 ", "CONTRACT", dt.date(2025, 1, 10), "EUR")
    assert (a.amount_net, a.amount_gross, a.vat_amount) == (Decimal("100000.00"), Decimal("124000.00"), Decimal("24000.00"))
    assert a.cpv_codes == ["90911200", "90910000"] and a.nuts_codes == ["EL301", "EL3"] and a.related_ada == ["6Ω0Ζ465ΦΘΘ-ΔΕΖ", "7Α1Η465ΦΘΘ-ΘΙΚ"]
    assert a.procedure_type == "OPEN" and a.aaht == "9" and a.buyer.identifier_valid and a.buyer.amount is None
    assert [(p.identifier, p.identifier_valid, p.name, p.amount) for p in a.contractors] == [("090000045", True, "ALPHA", Decimal("124000.00")), ("12345", False, "BETA", Decimal("7.00"))]
    assert (b.source_native_id, b.amount_net, b.amount_gross, b.cpv_codes, b.currency) == ("17", Decimal("14.75"), None, ["331", "332"], "EUR")
    assert b.buyer.source_native_id == "55" and b.buyer.name == "ORG" and b.buyer.identifier is None and b.public_funding_ref_ops == "OPS-9" and b.procedure_type == "2" and b.end_date is None
    assert [(p.identifier, p.source_native_id, p.name, p.amount) for p in b.contractors] == [(None, "9", "SOLO", Decimal("14.75")), ("090000045", None, None, Decimal("14.75"))]
    assert [x.cost_without_vat for x in b.details.lines] == [Decimal("10.50"), Decimal("4.25"), None] and b.details.city == "Patra"
    assert bad.problem == "not JSON" and bare.problem == "no reference number" and bare.contractors == [] and a.problem is None


def test_payment_and_unknown_resource(spark):
    pay = {"referenceNumber": "25PAY1", "paymentDate": "2025-02-01", "submissionDate": "2024-01-01", "paymentAmountWithVAT": 9672.0, "vatAmount": 1872, "objectDetails": [{"afm": "090000045", "name": "P"}]}
    (p,) = normal(spark, pay, resource="payment")
    assert (p.submission_date, p.amount_net, p.amount_gross, p.vat_amount) == (dt.date(2025, 2, 1), None, Decimal("9672.00"), Decimal("1872.00"))
    assert [(x.name, x.amount) for x in p.contractors] == [("P", Decimal("9672.00"))]
    with pytest.raises(ValueError):
        normal(spark, pay, resource="letter")


def test_pages_apart_from_bad_ones(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"data": [CONTRACT, LINES], "isLastPage": True}))
    (tmp_path / "b.json").write_text("{broken")
    (tmp_path / "c.json").write_text(json.dumps(CONTRACT))
    (tmp_path / "d.json").write_text("[1]")
    good, bad = records.read_pages(spark, str(tmp_path))
    assert records.acts(good, "contract").count() == 3
    assert sorted((r.page[-6:], r.problem) for r in bad.collect()) == [("b.json", "not JSON"), ("d.json", "no records")]


NOTICE = {
    "notice-identifier": "2025-T", "publication-number": "12-2025", "notice-title": {"deu": ["D"], "eng": ["E"], "ell": ["G"]}, "notice-type": ["29"], "buyer-name": {"deu": ["B"]}, "buyer-identifier": ["EL094259216"],
    "buyer-country": ["GRC"], "winner-identifier": ["DE12"], "winner-country": ["deu"], "classification-cpv": ["1", "1", "2"], "estimated-value-proc": [None, "1 000,50"], "result-value-notice": {"eur": ["x", 7]},
    "place-of-performance": ["el301", "GRC", "nowhere"], "publication-date": "2025-01-15+02:00", "deadline-receipt-tender-date-lot": ["2025-03-02", "2025-03-01"], "deadline-receipt-tender-time-lot": ["10:00:00"],
    "deadline-receipt-request": ["bad", "2025-03-01T23:00:00Z"], "previous-notice-id-proc": ["a", "b"], "relatedNoticeIds": ["b", "c"],
}


def test_notices(spark):
    legacy = {"publicationNumber": "9", "formType": "legacy", "title": "T", "buyer": {"officialName": "O", "vat": "1"}, "contractor": {"name": ""}, "country": "GR", "cpv": "5"}
    forms = {"notice-identifier": 3, "customization-id": "urn:eForms-SDK-1.13"}
    df = spark.createDataFrame([(i, json.dumps(x)) for i, x in enumerate((NOTICE, legacy, forms, {}))], "n int, p string")
    a, b, c, d = records.notices(records.parse(df, "p").drop("p")).orderBy("n").collect()
    assert (a.notice_id, a.title, a.notice_type, a.parse_confidence, a.country_code) == ("2025-T", "G", "29", 0.85, "GR")
    assert tuple(a.buyer) == ("B", "094259216", "GR") and tuple(a.supplier) == (None, "DE12", "DE")
    assert a.cpv_codes == ["1", "2"] and a.nuts_codes == ["EL301", "GRC"] and a.estimated_value == Decimal("1000.50") and a.awarded_value == Decimal("7.00")
    assert a.publication_date == dt.date(2025, 1, 15) and a.submission_deadline == dt.datetime(2025, 3, 1, 23, 0) and a.related_notice_ids == ["a", "b", "c"]
    assert (b.notice_id, b.title, b.parse_confidence, b.country_code, b.cpv_codes) == ("9", "T", 1.0, "GR", ["5"]) and tuple(b.buyer) == ("O", "1", None) and b.supplier is None
    assert (c.notice_id, c.eforms_version, c.parse_confidence) == ("3", "1.13", 1.0) and d.problem == "no notice number" and d.parse_confidence == 0.3


ROWS = "act int, version int, item string, kind string"


def frames(spark, parents, rows):
    return spark.createDataFrame(parents, "act int, version int"), spark.createDataFrame(rows, ROWS)


def test_children_equal_a_loop(spark, tmp_path):
    rng = random.Random(4)
    state: dict[int, tuple[int, list]] = {}
    for _ in range(4):
        parents = {a: rng.randint(1, 5) for a in rng.sample(range(8), 5)}
        rows = [(a, v, rng.choice("xyz"), rng.choice(["CODE", "PLACE"])) for a, v in parents.items() for _ in range(rng.randint(0, 4))]
        out = children.replace(spark, str(tmp_path), "c", *frames(spark, list(parents.items()), rows), "act", "version", kept=F.col("kind") == "PLACE")
        for a, v in parents.items():
            if a not in state or v >= state[a][0]:
                stay = [r for r in state[a][1] if r[3] == "PLACE"] if a in state else []
                state[a] = v, stay + sorted({r for r in rows if r[0] == a})
        assert sorted(tuple(r) for r in out.collect()) == sorted(r for _, rs in state.values() for r in rs)


def test_children_odd_batches(spark, tmp_path):
    top = str(tmp_path)
    assert children.read(spark, top, "c") is None
    rows = [(1, 1, "a", "CODE"), (1, 1, "a", "CODE"), (None, 1, "b", "CODE"), (2, 9, "c", "CODE")]
    first = frames(spark, [(1, 1), (None, 1), (1, 0)], rows)
    assert [tuple(r) for r in children.replace(spark, top, "c", *first, "act", "version").collect()] == [(1, 1, "a", "CODE")]
    again = children.replace(spark, top, "c", *first, "act", "version")
    assert again.count() == 1
    bad = spark.createDataFrame([(1, 2, "b", "CODE")], ROWS).withColumn("item", F.raise_error(F.lit("lost")))
    with pytest.raises(Exception, match="lost"):
        children.replace(spark, top, "c", spark.createDataFrame([(1, 2)], "act int, version int"), bad, "act", "version")
    assert [r.item for r in children.read(spark, top, "c").collect()] == ["a"]  # readers still see the state before
    gone = children.replace(spark, top, "c", *frames(spark, [(1, 2)], []), "act", "version")
    assert gone.count() == 0 and children.read(spark, top, "c").count() == 0
    late = children.replace(spark, top, "c", *first, "act", "version")
    assert late.count() == 0


def test_differences_and_primary(spark):
    a = spark.createDataFrame([(1, "x"), (1, "y"), (2, "z")], "act int, item string")
    b = spark.createDataFrame([(1, "y"), (1, "w"), (2, "z"), (2, "z")], "act int, item string")
    assert [tuple(r) for r in children.differences(a, b, "act", "item").collect()] == [(1, ["w"], ["x"])]
    assert {(r.act, r.item) for r in children.primary(a, "act", "item").where("is_primary").collect()} == {(1, "x"), (2, "z")}
