"""Operators 1, 7 and 8 against brute force, the library, and SQL."""

from __future__ import annotations

import hashlib
import random
import re

import pytest

from marketlens.llm import chat_format, license_scan, q_text, sentencepiece_codec
from marketlens.llm.license_rules import rules
from tests.compare import same

SF = "/root/testdata/sf0.001"
ODD = [None, "", " ", "  ", "▁a", "a▁b  c ", "\n\na\tb", "a\x00b", "﻿abc", "é é ﬁ １ 😀", "<s> </s> <unk> <0x41>", "x" * 30_000, "word " * 5_000, "日本語のテキスト" * 50]


def sha(s: str) -> str:
    return hashlib.sha256(s.encode()).hexdigest()


def frame(spark, texts):
    return spark.createDataFrame([(i, t, 7) for i, t in enumerate(texts)], "doc_id long, text string, ids int")


def test_codec_equals_library(spark):
    import sentencepiece

    path = str(q_text.tokenizer_path())
    m = sentencepiece.SentencePieceProcessor(model_file=path)
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    texts = {r.doc_id: r.text for r in docs.collect()} | {-i - 1: t for i, t in enumerate(ODD)}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    for r in q_text.op7_digest(df, path).collect():
        ids = m.encode(texts[r.doc_id] or "")
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), sha(",".join(map(str, ids))), sha(m.decode(ids))), repr(texts[r.doc_id])[:80]


def test_codec_keeps_other_columns_and_empty_tables(spark):
    df = frame(spark, ["a b", None, "a b"])
    out = sentencepiece_codec.encode(df, str(q_text.tokenizer_path()), ids="ids")
    assert out.columns == ["doc_id", "text", "ids"] and out.count() == 3
    assert q_text.op7_digest(frame(spark, []), str(q_text.tokenizer_path())).count() == 0
    small = sentencepiece_codec.ChunkTable(str(q_text.tokenizer_path()), 1)
    assert small.encode(["a b c"]) == small.encode(["a b c"])


WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def lowered(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


def brute_base(t):
    w = WORD.findall(lowered(t))
    hits = [(i, label) for phrase, label in license_scan.BASE.items() for i in range(len(w)) if w[i : i + len(phrase.split())] == phrase.split()]
    return len(w), len(hits), min((i for i, _ in hits), default=None), max((i for i, _ in hits), default=None), ",".join(sorted({x for _, x in hits}))


def brute_labels(t):
    w = WORD.findall(lowered(t))
    s = " ".join(w)
    spans = []
    for rank, r in enumerate(rules()):
        for m in re.finditer(f"(?<![^ ])(?:{r.pattern})(?![^ ])", s):
            start = s[: m.start()].count(" ")
            spans.append((start, start + m[0].count(" "), r.priority, rank, r.label))
    inside = lambda a, b: b[0] <= a[0] and a[1] <= b[1] and b[2] <= a[2] and (b[:2] != a[:2] or (b[2], b[3]) < (a[2], a[3]))
    return sorted({a[4] for a in spans if not any(inside(a, b) for b in spans if b is not a)})


LICENSED = [
    "Licensed under the Apache License, Version 2.0. See http://www.apache.org/licenses/LICENSE-2.0",
    "SPDX-License-Identifier: MIT\nCopyright (c) 2019 A. All rights reserved.",
    "cc by cc by CC-BY-NC 4.0 xcc by cc byx", "This work is licensed under the GNU General Public License, version 3. GENERAL PUBLIC LICENSE",
    "all rights reserved" * 3, "all rights reserved " * 2_000, "Creative Commons Attribution-ShareAlike 4.0 International License", "Ünder the MIT licence é general public license",
]


def test_license_scan_equals_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    texts = {r.doc_id: r.text for r in docs.collect()} | {-i - 1: t for i, t in enumerate(ODD + LICENSED)}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    for r in q_text.op1_digest(df).collect():
        t = texts[r.doc_id]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == brute_base(t), repr(t)[:80]
        assert r.labels == ",".join(sorted(set(brute_labels(t)) | {x for x in r.base_labels.split(",") if x})), repr(t)[:200]
        assert 0 <= r.score <= 1


def test_license_scan_of_many_hits(spark):
    """More spans than a group of runs holds, with containers in the same run, an earlier one and an earlier group."""
    r = random.Random(5)
    parts = ["licensed under the apache license version 2 0", "all rights reserved", "copyright 2020", "spdx license identifier mit", "x"]
    t = " ".join(r.choice(parts) for _ in range(4_000))
    assert len(t) > 60_000
    (got,) = license_scan.scan(spark.createDataFrame([(1, t)], "doc_id long, text string")).collect()
    w, spans = " ".join(WORD.findall(t)), []
    for rank, rule in enumerate(rules()):
        for m in re.finditer(f"(?<![^ ])(?:{rule.pattern})(?![^ ])", w):
            start = w[: m.start()].count(" ")
            spans.append((start, -start - m[0].count(" "), rule.priority, rank, rule.label, rule.name))
    spans.sort()
    assert len(spans) > license_scan.RUN**2
    farthest, want = {p: -1 for p in license_scan.WEIGHT}, []
    for start, end, priority, _, label, name in spans:
        if max(e for p, e in farthest.items() if p <= priority) < -end:
            want.append((label, name, priority, start, -end))
        farthest[priority] = max(farthest[priority], -end)
    assert [tuple(d) for d in got.detections] == want and 0 < len(want) < len(spans)
    # a container that lies a group before what it holds
    long = license_scan.Rule("whole", "whole", "begin", 1, "begin .* end")
    (got,) = license_scan.scan(spark.createDataFrame([(1, "begin " + "copyright 2020 x " * 4_500 + "end copyright 2021")], "doc_id long, text string"), signatures=(long, *rules())).collect()
    assert [(d.label, d.start) for d in got.detections] == [("whole", 0), (next(x.label for x in rules() if x.name == "copyright-line"), 13_502)]


def test_license_rules_are_gated_by_their_keywords():
    assert len(rules()) > 300 and len({r.name for r in rules()}) == len(rules())
    for r in rules():
        literal = re.sub(r"\(\?:[^()]*\)\?|licen\[cs\]e", "", r.pattern)
        assert r.keyword in r.pattern.replace("licen[cs]e", "license") or r.keyword in literal or all(k in r.pattern for k in r.keyword.split()), r


def test_license_scan_of_odd_tables(spark):
    df = spark.createDataFrame([(None, None, "x"), (1, "MIT License", "y"), (1, "MIT License", "y")], "doc_id long, text string, labels string").drop("labels")
    assert [r.labels for r in q_text.op1_digest(df).collect()] == ["", "mit", "mit"]
    assert q_text.op1_digest(df.limit(0)).count() == 0


def test_chat_query_equals_sql(spark):
    same(q_text.op8_chat_format(spark, SF), q_text.ORACLES["op8_chat_format"], SF)


def test_chat_round_trip_of_odd_texts(spark):
    texts = [None, "", "\\", "<|", "<\\|im_end|>", "<|im_end|><|im_start|>x", "a<", "|b", "\\\\<|\\", "x" * 5_000, "é\n😀" * 700, "$1 \\1"]
    rows = [(c, i, role, t) for c, t in enumerate(texts) for i, role in enumerate(["user", "assistant", "assistant", None, "<|im_sep|>"])] + [(None, None, None, None)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    out = {r.conv_id: r for r in chat_format.parse(chat_format.render(chat_format.fold(q_text.conversation_log(df)))).collect()}
    for c, t in enumerate(texts):
        assert [(x.role, x.text) for x in out[c].turns] == [(r or "", t or "") for r in ["user", "assistant", "assistant", None, "<|im_sep|>"]]
        assert out[c].loss_text == (t or "") * 2
    assert len(out[None].turns) == 1


@pytest.mark.parametrize(
    ("log", "want"),
    [
        ([(1, 1, "message", "user", "hi"), (2, 2, "message", "assistant", ""), (3, 2, "delta", None, "a"), (4, 2, "delta", None, "b")], [("user", "hi"), ("assistant", "ab")]),
        ([(1, 1, "message", "user", "hi"), (2, 2, "message", "assistant", "x"), (3, 2, "regenerate", None, None), (4, 2, "delta", None, "y")], [("user", "hi"), ("assistant", "y")]),
        ([(1, 1, "message", "user", "hi"), (2, 2, "message", "assistant", "x"), (3, 1, "edit", None, "ho")], [("user", "ho")]),
        ([(1, 1, "message", "user", "hi"), (2, 2, "message", "assistant", "x"), (3, 1, "edit", None, "ho"), (4, 2, "message", "assistant", "z")], [("user", "ho"), ("assistant", "z")]),
        ([(1, 1, "message", "user", "hi"), (2, 1, "delete", None, None)], []),
        ([(5, 1, "delta", "user", "b"), (3, 1, "delta", "user", "a")], [("user", "ab")]),
    ],
)
def test_chat_fold(spark, log, want):
    df = spark.createDataFrame([(1, *e) for e in log], "conv_id long, seq long, turn long, kind string, role string, text string")
    assert [(r.role, r.text) for r in chat_format.fold(df).orderBy("turn").collect()] == want


def test_license_scan_of_clashing_names(spark):
    df = spark.createDataFrame([(1, "MIT License", 5, "mine", "cut"), (2, "cc by", 6, "too", None)], "doc_id long, text string, _words int, Labels string, _cuts string")
    out = license_scan.scan(df)
    assert sorted(c.lower() for c in out.columns) == sorted({"doc_id", "text", "_words", "_cuts", *license_scan.RESULT})
    got = {r["doc_id"]: r for r in out.collect()}
    assert (got[1]["_words"], got[1]["_cuts"], got[2]["_words"], got[2]["_cuts"]) == (5, "cut", 6, None)
    assert got[1]["labels"] == ["mit"] and got[2]["base_counts"]["cc-by"] == 1 and got[2]["n_words"] == 2
