r"""Licence scan by ordered signature rules, with DataFrame functions only and no shuffle.

A text is lower-cased and reduced to its words, ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+``, with one space between them.
Several hundred regex rules (``license_rules``) apply to it, each only where its keyword occurs. A match is a span of
words. Suppression: a span inside one of a better priority, or inside a longer one of the same priority, is dropped
(of equal spans the rule that comes first in order stays). Kept spans give labels; the score is the best kept rule's
weight.

Base phrases (``BASE``) are counted apart: every place where their words stand consecutively.

Empty and null texts have no words, no labels and score 0. Rows are never joined, so repeated or null ids do no harm.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketlens.llm.common import fresh_names
from marketlens.llm.license_rules import Rule, rules

#: Base phrases and their labels.
BASE: dict[str, str] = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
#: Score of a kept detection by its rule's priority.
WEIGHT: dict[int, float] = {1: 1.0, 2: 0.95, 3: 0.85, 4: 0.7, 5: 0.5}
#: Signs around a match; no word holds them.
OPEN, CLOSE = "\x01", "\x02"
#: Spans of one run, and runs of one group.
RUN = 64
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: The gate of most rules: what any match of them holds, beside their keyword.
COMMON = "licen"


def words_text(text: Column) -> Column:
    """The words of ``text``, lower-cased, with one space between them. Letters beyond A-Z are lower-cased too: no letter
    of a phrase or rule comes of one (the Kelvin sign alone turns into an ASCII letter, k), and words stay words."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), NOT_WORD, " "))


def gate(rule: Rule) -> str:
    """A substring that any match of the rule holds and that few texts do: ``COMMON`` if it stands outside all groups."""
    plain, shorter = "", rule.pattern
    while plain != shorter:
        plain, shorter = shorter, re.sub(r"\(\?:[^()]*\)[?*]?", "", shorter)
    return COMMON if COMMON in plain else rule.keyword


def _count_words(c: Column) -> Column:
    """Words of a text with single spaces and none at its ends."""
    return F.when(c == "", F.lit(0)).otherwise(F.char_length(c) - F.char_length(F.replace(c, F.lit(" "), F.lit(""))) + 1)


def _spaces(c: Column) -> Column:
    return F.char_length(c) - F.char_length(F.replace(c, F.lit(" "), F.lit("")))


def _times(hits: str, phrase: str) -> Column:
    """How often a base phrase was hit."""
    return F.when(F.col(hits).isNull(), 0).otherwise(F.size(F.filter(hits, lambda h: h == phrase))).cast("long")


def _bounded(pattern: str) -> str:
    return f"(?<![^ ])(?:{pattern})(?![^ ])"


def _spans(words: Column, rule: Column, pattern: Column) -> Column:
    """The word spans of all matches, in time linear in text and matches: signs that no word holds are put around each match,
    and the words that bear them tell the places."""
    marked = F.regexp_replace(words, pattern, F.lit(f"{OPEN}$0{CLOSE}"))

    def spans(tokens: Column) -> Column:
        places = F.sequence(F.lit(0), F.size(tokens) - 1)
        first = F.filter(places, lambda i: F.startswith(F.get(tokens, i), F.lit(OPEN)))
        last = F.filter(places, lambda i: F.endswith(F.get(tokens, i), F.lit(CLOSE)))
        named = {"priority": rule["priority"], "rank": rule["rank"], "label": rule["label"], "rule": rule["name"]}
        return F.zip_with(first, last, lambda i, j: F.struct(i.alias("start"), (-j).alias("minus_end"), *(c.alias(n) for n, c in named.items())))

    # outer lambdas bind what the inner ones would work out again for each place; most rules that are tried match nowhere
    hit = F.filter(F.array(marked), lambda m: m != words)
    return F.flatten(F.transform(F.transform(hit, lambda m: F.split(m, " ")), spans))


def _bind(value: Column, f: Callable[[Column], Column]) -> Column:
    """f(value), with the value worked out once."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def _runs(items: Column) -> Column:
    """The items in runs of RUN; one empty run if there are none."""
    return F.transform(F.sequence(F.lit(0), F.greatest(F.size(items) - 1, F.lit(0)), F.lit(RUN)), lambda i: F.slice(items, i + 1, F.lit(RUN)))


def _farthest(ends: Column, start: Column) -> Column:
    """For each priority the farthest of several ends."""
    return F.aggregate(ends, start, lambda a, b: F.zip_with(a, b, lambda x, y: F.greatest(x, y)))


def _kept(found: Column) -> Column:
    """Containment suppression. Spans come sorted by start, then longest, then best rule, so whatever contains a span stands
    before it: a span is dropped if one of its own or a better priority before it ends no sooner.

    An accumulator that gathers spans would be copied at each of them. So spans are cut into runs, and runs into groups: the
    farthest ends of earlier groups and of earlier runs of the group stand for what is before a run, and inside a run spans
    are compared with those before them."""
    none = F.array(*(F.lit(-1) for _ in WEIGHT))

    def ends(run: Column) -> Column:
        each = lambda p: F.transform(F.filter(run, lambda y: y["priority"] <= p), lambda y: -y["minus_end"])
        return F.transform(F.array(*(F.lit(p) for p in WEIGHT)), lambda p: F.coalesce(F.array_max(each(p)), F.lit(-1)))

    def left(run: Column, before: Column) -> Column:
        inside = lambda x, j: F.exists(F.slice(run, 1, j), lambda y: (y["priority"] <= x["priority"]) & (y["minus_end"] <= x["minus_end"]))
        return F.filter(run, lambda x, j: (F.get(before, x["priority"] - 1) < -x["minus_end"]) & ~inside(x, j))

    def over(runs: Column, by_run: Column) -> Column:
        whole = F.transform(_runs(by_run), lambda g: _farthest(g, none))
        earlier = _bind(whole, lambda gs: F.transform(gs, lambda _, g: _farthest(F.slice(gs, 1, g), none)))
        first = lambda k: k - k % RUN
        reached = lambda gs, k: _farthest(F.slice(by_run, first(k) + 1, k % RUN), F.get(gs, F.floor(k / RUN).cast("int")))
        return _bind(earlier, lambda gs: F.flatten(F.transform(runs, lambda run, k: _bind(reached(gs, k), lambda before: left(run, before)))))

    return _bind(_runs_sorted(found), lambda runs: _bind(F.transform(runs, ends), lambda by_run: over(runs, by_run)))


def _runs_sorted(found: Column) -> Column:
    return _bind(F.array_sort(found), _runs)


#: The columns that ``scan`` adds.
RESULT = ("n_words", "base_counts", "base_first", "base_last", "detections", "labels", "score")


def scan(df: DataFrame, text: str = "text", signatures: tuple[Rule, ...] | None = None) -> DataFrame:
    """``df`` with n_words, base_counts (map), base_first, base_last, detections (array of label, rule, priority,
    start, end: kept spans of words, end included), labels (sorted, distinct) and score. Columns of these names that ``df`` has
    already, in any case of letters, are replaced; all others come through."""
    signatures = rules() if signatures is None else signatures
    fields = lambda i, r: F.struct(F.lit(r.keyword).alias("keyword"), F.lit(r.priority).alias("priority"), F.lit(i).alias("rank"), F.lit(r.label).alias("label"), F.lit(r.name).alias("name"), F.lit(_bounded(r.pattern)).alias("pattern"))
    by_gate: dict[str, list[Column]] = {}
    for i, r in enumerate(signatures):
        by_gate.setdefault(gate(r), []).append(fields(i, r))
    # a text is searched for each gate once; only behind a gate that it holds are the rules' own keywords looked for
    tables = F.array(*(F.struct(F.lit(g).alias("gate"), F.array(*rs).alias("rules")) for g, rs in by_gate.items()))
    words, cuts, hits, kept = fresh_names(df, "words", "cuts", "hits", "kept")
    out = df.withColumn(words, words_text(F.col(text)))
    w = F.col(words)
    base = _bounded("|".join(BASE))
    has_base = F.greatest(*(F.contains(w, F.lit(p)).cast("int") for p in BASE)) == 1
    out = out.withColumn(cuts, F.when(has_base, F.split(w, base, -1)))
    out = out.withColumn(hits, F.when(has_base, F.regexp_extract_all(w, F.lit(base), F.lit(0))))
    n_base = F.when(F.col(hits).isNull(), 0).otherwise(F.size(hits))
    all_before = F.char_length(w) - F.char_length(F.element_at(cuts, -1)) - F.char_length(F.element_at(hits, -1))
    opened = F.flatten(F.transform(F.filter(tables, lambda t: F.contains(w, t["gate"])), lambda t: t["rules"]))
    tried = F.filter(opened, lambda r: F.contains(w, r["keyword"]))
    found = F.flatten(F.transform(tried, lambda r: _spans(w, r, r["pattern"])))
    out = out.withColumn(kept, _kept(found))
    return out.select(
        *(c for c in df.columns if c.lower() not in RESULT),
        _count_words(w).cast("long").alias("n_words"),
        F.map_from_arrays(F.array(*(F.lit(v) for v in BASE.values())), F.array(*(_times(hits, p) for p in BASE))).alias("base_counts"),
        F.when(n_base > 0, _spaces(F.element_at(cuts, 1))).cast("long").alias("base_first"),
        F.when(n_base > 0, _spaces(F.substring(w, F.lit(1), all_before))).cast("long").alias("base_last"),
        F.transform(kept, lambda x: F.struct(x["label"].alias("label"), x["rule"].alias("rule"), x["priority"].alias("priority"), x["start"].alias("start"), (-x["minus_end"]).alias("end"))).alias("detections"),
        F.array_sort(F.array_distinct(F.transform(kept, lambda x: x["label"]))).alias("labels"),
        F.coalesce(F.array_max(F.transform(kept, lambda x: F.element_at(F.create_map(*(v for p, s in WEIGHT.items() for v in (F.lit(p), F.lit(s)))), x["priority"]))), F.lit(0.0)).alias("score"),
    )
