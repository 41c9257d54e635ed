"""From banded signatures to classes, without pairs of texts that are known to be of one class.

A bucket holds the texts that share a band. Texts are compared in two turns, and what the first one links counts as one
class in the second:

1. Each member of a bucket is compared with the bucket's representative, the text that occurs most often (the text that
   the others are copies of, where there is one). A bucket of thousands of near copies costs one comparison a member.
2. In buckets whose members still stand in different classes, members of different classes are compared: all of them in
   buckets of up to ``WHOLE`` members. So are those of larger ones, each pair as one comparison of two short sketches within
   the join (``linked``), which puts out only what passes it: links, or (``sure`` not set) pairs that are verified.

No pair that shares a band is left out but those of one class and those that can't be linked, whatever a bucket's size: two
alike texts are missed only if they share no band. Members of a large bucket that are all just beyond the threshold cost work with the square of their number, but no rows or memory.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marketlens.llm.common import cut
from marketlens.llm.components import components

#: Members up to which a bucket is compared whole.
WHOLE = 32
_SLACK = 1e-9


class Texts(NamedTuple):
    """The texts that share a bucket, so that what is compared is fetched once."""

    #: (id, mark): something short that tells many pairs apart.
    marks: DataFrame
    #: Whether texts of these two marks may be linked.
    may: Callable[[Column, Column], Column]
    #: (id, size and more) for ids (id): the number of distinct tokens, and what ``linked`` compares.
    tokens: Callable[[DataFrame], DataFrame]
    #: The share of the tokens of either that linked texts have in common.
    least: float
    #: Takes distinct pairs (a, b) and returns those that are linked.
    verify: Callable[[DataFrame], DataFrame]
    #: Whether texts with these two rows of ``tokens`` (structs without the id) are linked, or may be.
    linked: Callable[[Column, Column], Column]
    #: Whether ``linked`` decides; else what passes is verified.
    sure: bool
    #: Takes distinct pairs (a, b) and leaves out those whose marks rule a link out.
    screen: Callable[[DataFrame], DataFrame] = lambda pairs: pairs


def classes(facts: DataFrame, prepare: Callable[[DataFrame], Texts]) -> DataFrame:
    """(id, component) of all ids that are linked to another, from facts (id, times, keys): one row for each distinct text
    with how often it occurs and the keys of its bands. ``prepare`` takes the ids (id) that share a bucket."""
    keyed = facts.select("id", "times", F.explode("keys").alias("key"))
    inside = Window.partitionBy("key").orderBy(F.desc("times"), "id")
    rep = F.first("id").over(inside.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    shared = keyed.select("key", "id", rep.alias("rep"), F.lead("id").over(inside).alias("after"))
    live = cut(shared.where("id <> rep or after is not null").select("key", "id", "rep"))
    texts = prepare(live.select("id").distinct())
    done = cut(live.where("id <> rep").select(F.least("id", "rep").alias("a"), F.greatest("id", "rep").alias("b")).distinct())
    linked = cut(texts.verify(texts.screen(done))).select("a", "b")
    named = live.join(components(linked), "id", "left").select("key", "id", F.coalesce("component", "id").alias("c"))
    mixed = named.groupBy("key").agg(F.min("c").alias("lo"), F.max("c").alias("hi"), F.count("*").alias("n")).where("lo < hi").select("key", "n")
    rest = cut(named.join(mixed, "key").join(texts.marks, "id").select("key", "n", "id", "c", "mark"))
    small = rest.where(F.col("n") <= WHOLE).withColumn("size", F.lit(1)).select("key", "id", "c", "mark", "size")
    large = rest.where(F.col("n") > WHOLE).drop("mark")
    shared = large.groupBy("id").agg(F.collect_set("key").alias("keys"))
    sets = cut(texts.tokens(shared.select("id")))
    sets = sets.select("id", "size", F.struct(*sets.columns[1:]).alias("mark")).join(shared, "id")
    apart = _apart(small, texts, texts.may)
    passed = _apart(large.join(sets, "id").select("key", "id", "c", "mark", "size", "keys"), texts, texts.linked)
    if texts.sure:
        linked = linked.unionByName(cut(passed.distinct()))
    else:
        apart = apart.union(passed)
    more = texts.verify(cut(apart.distinct().join(done, ["a", "b"], "left_anti")))
    return components(linked.select("a", "b").unionByName(more.select("a", "b")))


def _apart(df: DataFrame, texts: Texts, test: Callable[[Column, Column], Column]) -> DataFrame:
    """(a, b): pairs of one key and of different classes whose marks stand the test; with ``keys``, the keys of each id, a pair
    is put out at the least key that it shares only."""
    a, b = (df.select(*(F.col(c).alias(f"{c}_{x}") for c in df.columns)) for x in ("a", "b"))
    near = (F.col("size_a") >= texts.least * F.col("size_b") - _SLACK) & (F.col("size_b") >= texts.least * F.col("size_a") - _SLACK)
    on = (F.col("key_a") == F.col("key_b")) & (F.col("id_a") < F.col("id_b")) & (F.col("c_a") != F.col("c_b")) & near & test(F.col("mark_a"), F.col("mark_b"))
    if "keys" in df.columns:
        on = on & (F.array_min(F.array_intersect("keys_a", "keys_b")) == F.col("key_a"))
    return a.join(b, on).select(F.col("id_a").alias("a"), F.col("id_b").alias("b"))
