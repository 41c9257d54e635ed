"""Links by likeness of texts against all pairs, merges, and checks on contacts."""

from __future__ import annotations

import datetime as dt
import random
import re
from difflib import SequenceMatcher

from pyspark.sql import functions as F

from marketlens.functions import likeness
from marketlens.functions import normalize as N
from marketlens.operators import decisions, resolution


def ratio(a, b):
    return SequenceMatcher(None, a.strip().upper(), b.strip().upper()).ratio() if a and b else 0.0


def words(rng, k):
    return " ".join(rng.choice(["supply", "cleaning", "of", "public", "roads", "works", "Οδός", "έργα", "office", "x" * 210]) for _ in range(k))


def test_likeness_and_bounds(spark):
    rng = random.Random(1)
    texts = [words(rng, rng.randint(1, 6)) for _ in range(30)] + ["", None, " a ", "A", "ß", "😀😀 b"]
    pairs = spark.createDataFrame([(a, b) for a in texts for b in texts], "a string, b string")
    got = pairs.select("a", "b", likeness.similarity(F.col("a"), F.col("b")).alias("s")).collect()
    assert all(r.s == ratio(r.a, r.b) for r in got)
    for least in (0.5, 0.6, 0.85):
        kept = likeness.like_pairs(pairs, [("a", "b", least)])
        assert kept.count() == sum(ratio(r.a, r.b) >= least for r in got)  # the bounds lose nothing


def shared(a, b):
    cut = lambda t: {w for w in re.split(r"[^\w]+", (t or "").strip().upper()) if w}
    return bool(cut(a) & cut(b))


def test_search_equals_all_pairs(spark):
    rng = random.Random(2)
    orgs = ["City of Patras", "the city of Patras", "CITY OF ATHENS", "Ministry of Works", "Ministry", None, ""]
    acts = [(i, rng.choice(orgs), rng.choice([words(rng, 3), None, "roads"])) for i in range(60)]
    found = [(i, rng.choice(orgs), words(rng, 3)) for i in range(25)]
    want = set()
    for i, org, title in acts:
        hits = [d for d in found if shared(d[1], org) and shared(d[2], title) and ratio(d[1], org) >= 0.6 and ratio(d[2], title) >= 0.5]
        if len(hits) == 1:
            want.add((i, hits[0][0], ratio(hits[0][1], org), ratio(hits[0][2], title), 0.75))
    got = decisions.by_search(spark.createDataFrame(acts, "act_id int, organisation string, title string"), spark.createDataFrame(found, "decision_id int, organisation string, title string"))
    assert {tuple(r) for r in got.collect()} == want and len(want) >= 3


def test_title_amount_equals_all_pairs(spark):
    rng, day = random.Random(3), dt.date(2024, 1, 1)
    make = lambda n: [(i, rng.choice([1, 1, 2, None]), rng.choice([words(rng, 3), "roads works", None]), rng.choice([100, 110, 115, 116, 400, None]), day + dt.timedelta(rng.randint(0, 900))) for i in range(n)]
    notices, acts = make(80), [(i // 2, *r) for i, (_, *r) in enumerate(make(60))]
    want = set()
    for i, buyer, title, amount, at in notices:
        hits = {a[0] for a in acts if buyer and a[1] == buyer and ratio(a[2], title) >= 0.5 and abs((a[4] - at).days) <= 180 and (amount is None or a[3] is None or abs(a[3] - amount) * 100 <= amount * 15)}
        if len(hits) == 1:
            want.add((i, hits.pop(), 0.65))
    kind = "{} int, buyer_id int, title string, amount decimal(20,2), day date"
    cast = lambda rows, c: spark.createDataFrame(rows, kind.format(c).replace("decimal(20,2)", "int")).withColumn("amount", F.col("amount").cast("decimal(20,2)"))
    got = decisions.by_title_amount(cast(notices, "notice_id"), cast(acts, "process_id"))
    assert {tuple(r) for r in got.collect()} == want and len(want) >= 3


def test_merges_follow_chains(spark):
    e = spark.createDataFrame([(i, None) for i in range(1, 19)] + [(30, "A"), (31, "B"), (32, "A")], "id int, identifier string")
    live = [(1, 2), (1, 3), (2, 3), (3, 4), (4, 5), (6, 7), (7, 8), (8, 6), (9, 6), (10, 9), (11, 12), (12, 11), (13, 13), (30, 31), (30, 32), (16, 17), (17, 18), (18, 17), (5, 99)]
    m = spark.createDataFrame([(a, b, False) for a, b in live] + [(14, 15, True)], "id int, into int, reverted boolean")
    got = {r.id: r.master for r in resolution.apply_merges(e, m).collect()}
    want = {i: i for i in [*range(1, 19), 30, 31, 32]} | dict.fromkeys((1, 2, 3, 4), 5) | dict.fromkeys((6, 7, 8, 9, 10), 6) | {12: 11, 30: 32, 16: 17, 18: 17}
    assert got == want
    assert resolution.apply_merges(e.limit(0), m).count() == 0 and resolution.apply_merges(e, m.limit(0)).where("id <> master").count() == 0


def test_contacts(spark):
    rows = [("a@b.c", True), (" a@b.c ", True), ("a@b", False), ("a b@c.d", False), ("a@@b.c", False), (None, False)]
    df = spark.createDataFrame(rows, "c string, want boolean")
    assert all(r.want == r.got for r in df.select("want", N.valid_email(F.col("c")).alias("got")).collect())
    rows = [("210 1234567", True), ("+30(210)123-45.67", True), ("123456", False), ("ext 5551234", False), ("1" * 31, False), (None, False)]
    df = spark.createDataFrame(rows, "c string, want boolean")
    assert all(r.want == r.got for r in df.select("want", N.valid_phone(F.col("c")).alias("got")).collect())


def test_bound_by_common_subsequences_loses_no_like_pair(spark):
    from difflib import SequenceMatcher
    from random import Random

    from marketlens.functions import likeness

    rnd = Random(7)
    text = lambda: "".join(rnd.choice("AB Σ1") for _ in range(rnd.randint(0, 14)))
    rows = [(i, text(), text()) for i in range(600)] + [(900, None, "A"), (901, "ab", "AB ")]
    got = {r.i: r.like_0 for r in likeness.like_pairs(spark.createDataFrame(rows, "i int, a string, b string"), [("a", "b", 0.5)]).collect()}
    norm = lambda s: (s or "").strip(" ").upper()
    want = {i: r for i, a, b in rows if a and b and norm(a) and (r := SequenceMatcher(None, norm(a), norm(b)).ratio()) >= 0.5}
    assert got == want
    y = "HARBOUR"
    masks = {c: sum(1 << i for i, d in enumerate(y) if c == d) for c in y}
    assert likeness._common("ARBOR", masks, (1 << len(y)) - 1) == 5 and likeness._common("RUOBRAH", masks, (1 << len(y)) - 1) == 3
