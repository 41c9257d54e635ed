"""Publication bundles by hand, key sentences against a loop."""

import datetime
import random
import re
from collections import Counter, defaultdict

from marketlens.operators import bundle as B

ACTS = "act_id string, process_id int, act_type string, title string, buyer_name string, amount decimal(20,2), currency string, deadline date, procedure_type string, day date"


def make(spark, acts, documents=(), pages=(), codes=(), places=()):
    df = lambda rows, schema: spark.createDataFrame(list(rows), schema)
    out = B.bundles(
        df(acts, ACTS), df(documents, "document_id int, act_id string, title string"), df(pages, "document_id int, page_number int, text string"),
        df(codes, "act_id string, code string, is_primary boolean"), df(places, "act_id string, place string"),
    )
    return {r["process_id"]: r for r in out.collect()}


def test_bundle_of_records_points_and_excerpts(spark):
    from decimal import Decimal

    d = datetime.date
    acts = [
        ("c", 1, "CONTRACT", "Σύμβαση", "Δήμος", Decimal("5"), None, None, None, d(2024, 9, 1)), ("n1", 1, "NOTICE", "παλιά", "Δήμος", Decimal("1"), "EUR", None, None, d(2024, 1, 1)),
        ("n2", 1, "NOTICE", "  Προμήθεια \n πετρελαίου ", "Δήμος Α", Decimal("1234567.5"), None, d(2024, 3, 9), "OPEN", d(2024, 2, 1)), ("n3", 1, "NOTICE", "χωρίς ημέρα", None, None, None, None, None, None),
        ("x", 2, "SOMETHING", None, None, None, None, None, "", None), ("lost", None, "NOTICE", "t", None, None, None, None, None, None), ("n2", 1, "NOTICE", "  Προμήθεια \n πετρελαίου ", "Δήμος Α", Decimal("1234567.5"), None, d(2024, 3, 9), "OPEN", d(2024, 2, 1)),
    ]
    documents = [(7, "n2", "b"), (7, "c", "a"), (8, "n1", None), (9, "gone", "z"), (5, "c", "blank")]
    pages = [(7, 2, "two"), (7, 1, "one  "), (7, 3, "three"), (8, 1, "y" * 5000), (5, 1, " \n "), (5, 2, None)]
    got = make(spark, acts, documents, pages, [("n2", "33", False), ("n2", "09", True), ("n2", "15", None), ("c", "77", True)], [("c", "EL30"), ("n1", "EL30"), ("n2", "EL1")])
    one, two = got[1], got[2]
    assert set(got) == {1, 2} and one["primary_act_id"] == "n2" and [r["act_id"] for r in one["records"]] == ["n2", "n1", "n3", "c"]
    assert one["summary"] == "Η αναθέτουσα αρχή Δήμος Α δημοσίευσε προκήρυξη με αντικείμενο «Προμήθεια πετρελαίου». Η καταγεγραμμένη αξία είναι 1.234.567,50 EUR. Η προθεσμία υποβολής προσφορών είναι 09/03/2024."
    assert [tuple(p) for p in one["key_points"]] == [("Καταγεγραμμένη αξία", "1.234.567,50 EUR"), ("Προθεσμία προσφορών", "09/03/2024"), ("Διαδικασία", "OPEN"), ("CPV", "09, 15, 33"), ("Τόπος εκτέλεσης", "EL1, EL30")]
    assert [(x["document_id"], x["act_id"], x["title"]) for x in one["documents"]] == [(5, "c", "blank"), (7, "c", "a"), (8, "n1", None)]
    assert [x["excerpt"] and (x["excerpt"][:8], len(x["excerpt"])) for x in one["documents"]] == [None, ("one two", 7), ("y" * 8, 900)] and one["document_excerpt"] == "one two"
    assert two["summary"] == "Η αναθέτουσα αρχή δημοσίευσε πράξη με αντικείμενο «χωρίς καταγεγραμμένο τίτλο»." and two["key_points"] == [] and two["documents"] == [] and two["document_excerpt"] is None
    assert make(spark, []) == {}


def brute(texts, k, shortest, longest):
    groups = defaultdict(list)
    for g, d, t in texts:
        for i, s in enumerate(re.sub(r"([.;!?])\s+", "\\1\n", t or "").split("\n")):
            s = s.strip(" ")
            ws = {w for w in re.findall(r"[^\W_]+", s.lower()) if len(w) >= 4}
            if shortest <= len(s) <= longest and ws:
                groups[g].append((d, i, s, ws))
    out = []
    for g, ss in groups.items():
        held = Counter(w for *_, ws in ss for w in ws)
        scored = sorted(((-sum(held[w] for w in ws) / len(ws), d, i, s) for d, i, s, ws in ss), key=lambda x: x[:3])
        out += [(g, n, d, i, round(-x / len(ss), 9), s) for n, (x, d, i, s) in enumerate(scored[:k], 1)]
    return sorted(out)


def test_key_sentences_are_those_of_a_loop(spark):
    rng = random.Random(11)
    words = "heating supply oil contract notice of in works municipal award".split()
    sentence = lambda: " ".join(rng.choice(words) for _ in range(rng.randint(1, 12))).capitalize() + rng.choice([". ", "! ", "?\n", "; ", ".", "\n\n"])
    texts = [(rng.choice("aab"), d, "".join(sentence() for _ in range(rng.randint(0, 9)))) for d in range(60)]
    texts += [("c", 90, None), ("c", 91, ""), ("d", 92, "of in of in of in of in of in of in of."), ("e", 93, "Same words here again. Same words here again. " * 2)]
    df = spark.createDataFrame(texts, "g string, d int, text string")
    for k, shortest, longest in ((3, 15, 60), (1, 1, 400), (100, 20, 40)):
        got = sorted((r["g"], r["rank"], r["d"], r["place"], round(r["score"], 9), r["sentence"]) for r in B.key_sentences(df, "g", "d", k=k, shortest=shortest, longest=longest).collect())
        assert got == brute(texts, k, shortest, longest)
    assert B.key_sentences(df.limit(0), "g", "d").count() == 0
