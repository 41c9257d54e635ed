"""Toxicity by gradient-boosted trees over dense features, with isotonic calibration.

``fit`` learns from labelled rows in three folds, dealt by a hash of doc_id: the first gives a lexicon (words and word
beginnings that stand in far more toxic than clean texts), the second the trees, the third the calibration. It takes
``max_rows`` labelled rows at most, by hash, which bounds what it gathers; the lexicon has ``LEXICON`` entries at most.
Texts of the same words count once in the lexicon, as a text of many copies would make its words look telling; all others
count each.

Features of a text (``FEATURES``): densities and weights of lexicon words, how many of them stand near a word of the
second person, shares of capitals, marks and obfuscated spellings, and its length. Labels, language, source and doc_id are
never features. Whole texts are read.

Null and empty texts have features of 0 (and a score like any other). Repeated labels of a doc_id count as toxic if one
is; rows without label or id are left out. Without rows of both classes the score is the share of toxic labels, else 0.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression, IsotonicRegressionModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marketlens.llm.common import cut, short_batches

FEATURES = (
    "hit_density", "hit_weight", "hit_max", "hit_log", "second_person", "hits_near_you", "capitals", "shouted", "exclaims",
    "questions", "repeated_marks", "obfuscated", "obfuscated_hits", "log_words", "word_length",
)
LEXICON = 2_000
#: Lengths of the word beginnings that may be lexicon entries, beside whole words.
STEMS = (4, 5)
#: Words of the second person (English, French, German, Spanish, Italian, Portuguese).
YOU = frozenset("you your yours yourself u ur tu te toi ton ta tes vous votre vos du dich dir dein deine deinen ihr euch euer sie usted ustedes tú ti tus su vosotros você vocês seu sua voi vostro".split())
#: Letters for the signs that stand for them in obfuscated spellings.
SIGNS = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s", "!": "i", "*": "", "+": "t"})
_MARKS = ".,;:!?()[]{}\"'«»¿¡„“”‘’…-–—"
_MIXED = re.compile(r"[^\W\d_][0-9@$*!+]+[^\W\d_]")
_SHOUT, _REPEAT = re.compile(r"\b[A-Z]{3,}\b"), re.compile(r"[!?]{2,}")
_CAPITALS = bytes(range(65, 91))
NEAR = 5


def split_words(text: str) -> list[str]:
    return [w for w in (x.strip(_MARKS) for x in text.lower().split()) if w]


def entries(word: str) -> list[str]:
    """The lexicon entries that a word may fall under: itself, and its beginnings marked by a tilde."""
    return [word, *(f"{word[:n]}~" for n in STEMS if len(word) >= n)]


class Reader:
    """Features of texts; what is known of a word is kept, up to a bound."""

    def __init__(self, lexicon: dict[str, float], keep: int = 300_000):
        self.lexicon, self.keep, self.known = lexicon, keep, {}

    def _word(self, w: str) -> tuple[float, bool, bool, float] | None:
        """Lexicon weight, second person, obfuscated, weight once the signs are read as letters; None if there is nothing to say."""
        weight = max((self.lexicon.get(e, 0.0) for e in entries(w)), default=0.0)
        mixed = bool(_MIXED.search(w))
        read = max((self.lexicon.get(e, 0.0) for e in entries(w.translate(SIGNS))), default=0.0) if mixed else 0.0
        return (weight, w in YOU, mixed, read) if weight or mixed or w in YOU else None

    def features(self, text: str) -> list[float]:
        words = split_words(text)
        known = self.known
        if len(known) > self.keep:
            known.clear()
        said = []
        for i, w in enumerate(words):
            try:
                x = known[w]
            except KeyError:
                x = known[w] = self._word(w)
            if x is not None:
                said.append((i, x))
        n, raw = max(1, len(words)), text.encode()
        chars = max(1, len(raw))
        hits = [(i, max(x[0], x[3])) for i, x in said if x[0] or x[3]]
        you = [i for i, x in said if x[1]]
        near = 0
        if you and hits:
            y = np.asarray(you)
            h = np.asarray([i for i, _ in hits])
            k = np.searchsorted(y, h)
            gap = np.minimum(np.abs(h - y[np.minimum(k, len(y) - 1)]), np.abs(h - y[np.maximum(k - 1, 0)]))
            near = int((gap <= NEAR).sum())
        weight = sum(v for _, v in hits)
        return [
            len(hits) / n, weight / math.sqrt(n), max((v for _, v in hits), default=0.0), math.log1p(len(hits)), len(you) / n, near / max(1, len(hits)),
            (chars - len(raw.translate(None, _CAPITALS))) / chars if raw else 0.0, len(_SHOUT.findall(text)) / n, 100 * text.count("!") / chars,
            100 * text.count("?") / chars, len(_REPEAT.findall(text)) / n, sum(x[2] for _, x in said) / n, float(sum(x[3] > 0 for _, x in said)), math.log1p(len(words)), sum(map(len, words)) / n,
        ]


@dataclass
class Model:
    lexicon: dict[str, float]
    trees: GBTClassificationModel | None
    steps: IsotonicRegressionModel | None
    prior: float


def with_features(df: DataFrame, lexicon: dict[str, float], text: str = "text", keep_text: bool = True) -> DataFrame:
    """``df`` with column ``tox_features``; without ``text`` if it isn't wanted any more."""
    names = [c for c in df.columns if c != "tox_features" and (keep_text or c != text)]
    schema = T.StructType([*df.select(*names).schema.fields, T.StructField("tox_features", T.ArrayType(T.DoubleType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(lexicon)
        for b in batches:
            at = b.schema.names.index
            got = pa.array([reader.features(x or "") for x in b.column(at(text)).to_pylist()], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([*(b.column(at(c)) for c in names), got], names=[*names, "tox_features"])

    return short_batches(df).mapInArrow(run, schema)


def _fold(doc_id: str = "doc_id") -> Column:
    """0 for the lexicon, 1 for the trees, 2 for the calibration."""
    x = F.pmod(F.xxhash64(F.col(doc_id), F.lit(17)), F.lit(20))
    return F.when(x < 10, 0).when(x < 17, 1).otherwise(2)


def learn_lexicon(rows: DataFrame, most: int = LEXICON, odds: float = 2.5, sure: float = 3.5) -> dict[str, float]:
    """Entry to log-odds, from rows (text, toxic). Rows with the same set of words (copies) count once."""
    schema = "said long, toxic int, words array<string>"

    def distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            words = [sorted(set(split_words(x or ""))) for x in b.column(0).to_pylist()]
            said = [int.from_bytes(_short_hash(" ".join(ws)), "little", signed=True) for ws in words]
            yield pa.RecordBatch.from_arrays([pa.array(said, pa.int64()), b.column(1), pa.array(words, pa.list_(pa.string()))], names=["said", "toxic", "words"])

    docs = short_batches(rows).select("text", F.col("toxic").cast("int")).mapInArrow(distinct, schema)
    one = docs.groupBy("said", "toxic").agg(F.min("words").alias("words")).withColumn("words", F.coalesce("words", F.array().cast("array<string>")))
    one = cut(one)
    total = {r.toxic: r.n for r in one.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    bad, good = total.get(1, 0), total.get(0, 0)
    if not bad or not good:
        return {}
    keys = F.array_distinct(F.concat("words", *(_beginnings(n) for n in STEMS)))
    counts = one.select("toxic", F.explode(keys).alias("key")).groupBy("key").agg(F.sum("toxic").alias("bad"), F.sum(1 - F.col("toxic")).alias("good"))
    b, g = F.col("bad") + 0.5, F.col("good") + 0.5
    lo = F.log(b / F.lit(bad + 1.0)) - F.log(g / F.lit(good + 1.0))
    found = counts.where("bad >= 3").select("key", lo.alias("odds"), (lo / F.sqrt(1 / b + 1 / g)).alias("z")).where((F.col("odds") >= odds) & (F.col("z") >= sure))
    return {r.key: float(r.odds) for r in found.orderBy(F.desc("z"), "key").limit(most).collect()}


def _short_hash(w: str) -> bytes:
    import xxhash

    return xxhash.xxh64_digest(w.encode())


def _longer(n: int) -> Column:
    return F.filter("words", lambda w: F.char_length(w) >= n)


def _beginnings(n: int) -> Column:
    return F.transform(_longer(n), lambda w: F.concat(F.substring(w, 1, n), F.lit("~")))


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = 12_000, seed: int = 7) -> Model:
    """Learns from ``docs`` (doc_id, text) and ``labels`` (doc_id, toxic)."""
    marks = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    stats = marks.agg(F.count("*").alias("n"), F.avg("toxic").alias("share")).first()
    prior = float(stats.share or 0.0)
    if not stats.n:
        return Model({}, None, None, prior)
    part = min(1.0, max_rows / stats.n)
    # the sample's size is bounded, so it may be broadcast to the scan of the documents
    sample = marks.where(F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(1 << 30)) < int(part * (1 << 30))).withColumn("fold", _fold())
    rows = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id")
    lexicon = learn_lexicon(rows.where("fold = 0").select("text", "toxic"))
    data = cut(with_features(rows.where("fold > 0"), lexicon, keep_text=False)).select("fold", F.col("toxic").cast("double").alias("label"), array_to_vector("tox_features").alias("features"))
    seen = {(r.fold, r.label) for r in data.select("fold", "label").distinct().collect()}
    if not {(1, 0.0), (1, 1.0)} <= seen:
        return Model(lexicon, None, None, prior)
    data = data.coalesce(4)
    trees = GBTClassifier(labelCol="label", featuresCol="features", maxIter=20, maxDepth=3, stepSize=0.3, seed=seed).fit(data.where("fold = 1"))
    steps = None
    if {(2, 0.0), (2, 1.0)} <= seen:
        held = trees.transform(data.where("fold = 2")).select("label", vector_to_array("probability")[1].alias("p"))
        steps = IsotonicRegression(featuresCol="p", labelCol="label").fit(held)
    return Model(lexicon, trees, steps, prior)


def score(df: DataFrame, model: Model, text: str = "text", keep_text: bool = True) -> DataFrame:
    """``df`` with toxicity (0 to 1, null for no row)."""
    names = [c for c in df.columns if c != "toxicity" and (keep_text or c != text)]
    if model.trees is None:
        return df.select(*names, F.lit(model.prior).alias("toxicity"))
    out = with_features(df, model.lexicon, text, keep_text).withColumn("tox_features", array_to_vector("tox_features"))
    trees = model.trees.copy().setFeaturesCol("tox_features").setRawPredictionCol("tox_raw").setProbabilityCol("tox_p").setPredictionCol("tox_class")
    out = trees.transform(out).withColumn("tox_p", vector_to_array("tox_p")[1])
    if model.steps is not None:
        out = model.steps.copy().setFeaturesCol("tox_p").setPredictionCol("tox_step").transform(out)
    p = F.col("tox_step") if model.steps is not None else F.col("tox_p")
    return out.select(*names, F.greatest(F.lit(0.0), F.least(F.lit(1.0), p)).alias("toxicity"))
