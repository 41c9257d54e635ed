"""Sources, sinks, text functions, streams and identity on small hand-written inputs."""

from __future__ import annotations

import datetime as dt
import json
import zipfile

from pyspark.sql import functions as F

from marketlens.functions import text as T
from marketlens.operators import linkage, quality
from marketlens.plans import refresh
from marketlens.scope import Scope, trim_codes
from marketlens.sources import files
from marketlens.streaming import events

SF = "/root/testdata/sf0.001"


def one(spark, column):
    return spark.range(1).select(column).first()[0]


def test_raw_store_takes_a_payload_once(spark, tmp_path):
    df = spark.createDataFrame([("a", "r", "2024-01-01", "x"), ("a", "r", "2024-01-02", "x"), ("a", "r", "2024-01-02", "y")], "source string, resource string, ingestion_date string, payload string")
    files.put_raw(df, str(tmp_path / "raw"))
    files.put_raw(df, str(tmp_path / "raw"))
    assert spark.read.parquet(str(tmp_path / "raw")).count() == 2


def test_chain_and_edges(spark):
    chain = {"requests": ["23req1"], "approvedRequests": ["23REQ2"], "notices": ["23PROC1", "23PROC1B*"], "auctions": ["23AWRD1"], "contracts": ["23SYMV1", "23SYMV2**"], "payments": ["23PAY1"]}
    entries = files.read_chain(spark.createDataFrame([(1, json.dumps(chain))], "chain int, value string")).drop("value")
    assert {(r.identifier, r.change) for r in entries.where("change is not null").collect()} == {("23PROC1B", "MODIFICATION"), ("23SYMV2", "CANCELLATION")}
    got = {(r.from_id, r.to_id, r.link_type) for r in files.chain_edges(entries, "chain").collect()}
    assert got == {
        ("23REQ2", "23REQ1", "APPROVES"), ("23REQ1", "23PROC1", "ANNOUNCES"), ("23AWRD1", "23PROC1", "AWARDS"), ("23AWRD1", "23SYMV1", "EXECUTES"), ("23PAY1", "23SYMV1", "PAYS"),
        ("23PROC1B", "23PROC1", "AMENDS"), ("23SYMV2", "23SYMV1", "CANCELS"),
    }


def test_csv_with_other_headers(spark, tmp_path):
    (tmp_path / "a.csv").write_text("Municipality_Code,POP,name\n1,10,x\n,5,y\n3,zz,w\n")
    got = files.read_csv(spark, str(tmp_path / "a.csv"), {"code": (("code", "municipality_code"), "string"), "population": (("population", "pop"), "long")}, required=("code", "population")).collect()
    assert [tuple(r) for r in got] == [("1", 10)]


def test_geojson_xml_zip_and_envelope(spark, tmp_path):
    square = [[[0, 0], [0, 2], [2, 2], [2, 0]]]
    geo = {"type": "FeatureCollection", "features": [{"properties": {"id": "a"}, "geometry": {"type": "Polygon", "coordinates": square}}, {"properties": {"id": "b"}, "geometry": {"type": "MultiPolygon", "coordinates": [square, square]}}, {"properties": {"id": "c"}, "geometry": {"type": "Point", "coordinates": [1, 2]}}]}
    (tmp_path / "g.json").write_text(json.dumps(geo))
    got = {r.properties["id"]: r for r in files.read_geojson(spark, str(tmp_path / "g.json")).collect()}
    assert (got["a"].n_points, got["a"].lon, got["b"].n_points) == (4, 1.0, 8) and got["c"].problem
    (tmp_path / "x.xml").write_text("<r><n id='1'><t>a</t></n><n id='2'><t>b</t></n></r>")
    assert [tuple(r) for r in files.read_xml(spark, str(tmp_path / "x.xml"), "n", "_id int, t string").orderBy("_id").collect()] == [(1, "a"), (2, "b")]
    with zipfile.ZipFile(tmp_path / "z.zip", "w") as z:
        z.writestr("p.txt", "\t".join(["1", "Athína", "x", "Athens,Αθήνα", "37.9", "23.7", "P", "PPLC"] + ["0"] * 6 + ["664046"] + ["0"] * 4) + "\nbad\n")
    assert [(r.name, r.population) for r in files.gazetteer(files.read_zipped_lines(spark, str(tmp_path / "z.zip"))).collect()] == [("Athína", 664046)]
    (tmp_path / "e.json").write_text('{"data": [{"a": 1}, {"a": 2}], "isLastPage": true}')
    assert sorted(r.a for r in files.read_envelope(spark, str(tmp_path / "e.json"), "struct<a: int>").collect()) == [1, 2]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "=x"), (2, "y")], "k int, v string")
    files.write_csv(df, str(tmp_path / "csv"))
    assert sorted(r.v for r in spark.read.option("header", True).csv(str(tmp_path / "csv")).collect()) == ["'=x", "y"]
    files.publish(df, str(tmp_path), "t")
    files.publish(df.limit(1), str(tmp_path), "t")
    assert files.published(spark, str(tmp_path), "t").count() == 1
    new = spark.createDataFrame([(1, "z")], "k int, v string").withColumn("at", F.lit(2))
    assert {(r.k, r.v) for r in files.upsert(df.withColumn("at", F.lit(2)), new, ["k"], "at").collect()} == {(1, "z"), (2, "y")}
    assert one(spark, files.sniff(F.lit(b"%PDF-1.7"))) == "application/pdf" and one(spark, files.sniff(F.lit(b' {"a"'))) == "application/json"


def test_marts_refresh_in_order_and_skip_dependants(spark, tmp_path):
    bad = {"a": lambda s, d: s.range(3), "b": lambda s, d: s.sql("select 1 / 0 as x"), "c": lambda s, d: s.range(1)}
    got = refresh.refresh(spark, SF, str(tmp_path), {"a": (), "b": (), "c": ("b",)}, bad)
    assert [s.status for s in got] == ["REFRESHED", "FAILED", "SKIPPED"]


def test_text_functions(spark):
    assert one(spark, T.normalize_lexical(F.lit("Προμήθεια ΥΛΙΚΏΝ!"))) == "προμηθεια υλικων "
    assert one(spark, T.stem(F.lit("υλικων"))) == "υλικ" and one(spark, T.stem(F.lit("ερων"))) == "ερων"
    assert round(one(spark, T.trigram_similarity(F.lit("word"), F.lit("two words"))), 4) == 0.3636
    assert one(spark, T.trigram_similarity(F.lit(""), F.lit(""))) == 0
    vat = lambda v: one(spark, T.valid_vat(F.lit(v)))
    brute = lambda v: sum(int(c) * 2 ** (8 - i) for i, c in enumerate(v[:8])) % 11 % 10 == int(v[8])
    assert all(vat(v) == brute(v) for v in ("094014201", "123456789", "000000000", "094014202")) and not vat("12")
    assert one(spark, T.valid_iban(F.lit("GB82WEST12345698765432"))) and not one(spark, T.valid_iban(F.lit("GB82WEST12345698765433")))
    assert [one(spark, T.identifier_class(F.lit(x))) for x in ("23SYMV012345678", "094014201", "?")] == ["ADAM", "VAT", "OTHER"]
    role = lambda title, *unit: one(spark, T.decision_role(F.lit(title).cast("string"), *(F.lit(u) for u in unit)))
    assert role("Finance Director") == "FINANCE" and role("Director of works") == "DEPARTMENT_HEAD" and role("Προϊστάμενος") == "STAKEHOLDER"
    assert role(None) == "STAKEHOLDER" and role("Clerk", "Procurement unit") == "PROCUREMENT" and role("Chief financial officer") == "STAKEHOLDER"


def test_scope_choices():
    assert trim_codes(["4500-1", "45", "4500", "", "45"]) == ["4500", "45"]
    assert Scope(code_prefixes=("1",), keywords=("a",), taxonomy_match="KEYWORD_REQUIRED").taxonomy() == ([], ["a"], False)
    assert Scope(code_prefixes=("1",), keywords=("a",), taxonomy_match="ALL").taxonomy() == (["1"], ["a"], True)


def test_history_and_components(spark):
    rows = [("e", 1, "A"), ("e", 2, "A"), ("e", 3, "B"), ("e", 4, None), ("e", 5, None)]
    h = linkage.scd2(spark.createDataFrame(rows, "k string, at int, s string").withColumn("tie", F.col("at")), "k", "at", "tie", ["s"]).orderBy("valid_from").collect()
    assert [(r.valid_from, r.valid_to, r.is_current) for r in h] == [(1, 3, False), (3, 4, False), (4, None, True)]
    edges = [(i, i + 1) for i in range(30)] + [(100, 101), (None, 5)]
    got = {r.id: r.process_id for r in linkage.process_groups(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()}
    assert got == {i: 0 for i in range(31)} | {100: 100, 101: 100}


def test_issue_states(spark):
    f = spark.createDataFrame([(1, "A"), (2, "A")], "act_id int, code string")
    o = spark.createDataFrame([(2, "A"), (3, "A")], "act_id int, code string")
    assert {(r.act_id, r.state) for r in quality.reconcile(f, o).collect()} == {(1, "NEW"), (2, "OPEN"), (3, "RESOLVED")}


def test_cursor_windows():
    d = dt.date
    assert events.next_window(None, d(2024, 1, 31), d(2024, 1, 1)) == (d(2024, 1, 1), d(2024, 1, 7))
    assert events.next_window(d(2024, 1, 7), d(2024, 1, 10), d(2024, 1, 1)) == (d(2024, 1, 8), d(2024, 1, 10))
    assert events.next_window(d(2024, 1, 10), d(2024, 1, 10), d(2024, 1, 1)) == (d(2024, 1, 8), d(2024, 1, 10))


def test_stream_is_exactly_once(spark, tmp_path):
    out, ckpt = str(tmp_path / "out"), str(tmp_path / "ckpt")
    for _ in range(2):  # the second run finds nothing new
        events.run_once(events.distinct_alerts(events.stream(spark, SF)), events.append_to(out), ckpt)
    e = spark.read.parquet(f"{SF}/events.parquet")
    assert spark.read.parquet(out).count() == e.select("user_id", "event_type", F.floor("value")).distinct().count()


def test_late_events_are_left_out(spark, tmp_path):
    src = str(tmp_path / "src")
    schema = "event_id long, ts timestamp_ntz, event_type string"
    put = lambda rows: spark.createDataFrame([(i, dt.datetime(2024, 1, 1, h), "v") for i, h in rows], schema).coalesce(1).write.mode("append").parquet(src)
    go = lambda: events.run_once(events.hourly_counts(spark.readStream.schema(schema).parquet(src)), events.append_to(str(tmp_path / "out")), str(tmp_path / "ckpt"))
    put([(1, 1), (2, 9)])
    go()
    put([(3, 1), (4, 23)])  # the first is eight hours late
    go()
    put([(5, 23)])
    go()
    got = {r.w.start.hour: r.n for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got[1] == 1
