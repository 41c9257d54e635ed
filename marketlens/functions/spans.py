"""Places of many patterns in texts by one pass: each text goes to a task's Python once, whatever the number of patterns.

Only the search itself runs there (named groups and places in characters have no DataFrame form); what the hits mean, which
of them overlap and which marker stands nearest is worked out by Spark on the rows that come back.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Mapping

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Texts that a batch may hold, and their bytes, as they can be long.
BATCH_ROWS, BATCH_BYTES = 4096, 4 << 20
#: Setting that holds the number of rows that a step with longer rows has set for its batches.
SHORT = "spark.marketlens.shortBatches"
_HIT = "field string, start int, end int, value string, parts map<string,string>"


def find(df: DataFrame, text: str, patterns: Mapping[str, str | tuple], kind: str | None = None) -> DataFrame:
    """A row for each match: the columns of ``df`` without ``text``, then field, start, end (characters from 0), value and parts.

    ``patterns``: field to pattern, or to (pattern, value of ``kind`` in which it is looked for, strings one of which each match
    holds, strings one of which it holds after ``casefold()``, if known: texts without them are not searched). A group named ``v`` is the value and place of a hit (else
    the whole match is); ``parts`` holds the other named groups. Null texts have no hits.
    """
    keep = [c for c in df.columns if c != text]
    schema = T.StructType([*(df.schema[c] for c in keep), *T._parse_datatype_string(_HIT).fields])
    known = [(f, *((*p, (), ())[:4] if isinstance(p, tuple) else (p, None, (), ()))) for f, p in patterns.items()]
    hit = pa.schema([("field", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("value", pa.string()), ("parts", pa.map_(pa.string(), pa.string()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = [(field, p := re.compile(pattern), only, needed, folded, "v" if "v" in p.groupindex else 0) for field, pattern, only, needed, folded in known]
        for b in batches:
            at = b.schema.get_field_index
            kinds = b.column(at(kind)).to_pylist() if kind else [None] * b.num_rows
            rows, hits = [], []
            for i, (t, k) in enumerate(zip(b.column(at(text)).to_pylist(), kinds, strict=True)):
                low = None
                for field, pattern, only, needed, folded, group in found if t else ():
                    if only is not None and only != k or needed and not _any(needed, t):
                        continue
                    if folded:
                        if low is None:  # patterns take the dotless i for an i, casefold() doesn't
                            low = t.casefold() if "ı" not in t and "İ" not in t else ""
                        if low and not _any(folded, low):
                            continue
                    for m in pattern.finditer(t):
                        rows.append(i)
                        others = [(n, x) for n, x in m.groupdict().items() if n != "v" and x is not None]
                        hits.append((field, m.start(group), m.end(group), m.group(group), others))
            taken = b.select(keep).take(pa.array(rows, pa.int64()))
            made = [pa.array([h[j] for h in hits], f.type) for j, f in enumerate(hit)]
            yield pa.RecordBatch.from_arrays([*taken.columns, *made], names=[*keep, *hit.names])

    return bounded(df).mapInArrow(run, schema)


def _any(some: tuple[str, ...], t: str) -> bool:
    for n in some:
        if n in t:
            return True
    return False


def bounded(df: DataFrame) -> DataFrame:
    """Bounds the session's Arrow batches by rows and bytes. What the session itself asks for is kept if it is less; what another
    step of this package has set (``SHORT``) is not asked for."""
    conf = df.sparkSession.conf
    for key, most in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        now = conf.get(f"spark.sql.execution.arrow.{key}")
        if not 0 < int(now.removesuffix("b")) <= most or key == "maxRecordsPerBatch" and now == conf.get(SHORT, None):
            conf.set(f"spark.sql.execution.arrow.{key}", str(most))
    return df


def nearest(found: DataFrame, hit: Column, marker: Column, keys: list[str], within: int, rank: Column) -> DataFrame:
    """Rows of ``found`` that are a ``hit``, one for each place, with ``marker``: the field of the nearest row that is a
    ``marker`` (same keys) at most ``within`` characters away, null where there is none. Equal distances go to the lower
    ``rank``, then to the earlier one.

    Both meet in stretches of text, so a long text with many of both isn't paired with itself. Rows are shuffled once, by
    ``keys``: stretches and places lie within them.
    """
    size = max(2 * within, 64)
    place = lambda c: F.floor(c / size).cast("int")
    rest = [c for c in found.columns if c not in (*keys, "start", "end")]
    off = F.when(hit, 0).otherwise(within)
    both = found.where(hit | marker).withColumns({"_hit": hit, "_rank": rank}).repartition(*keys)
    each = both.withColumn("_at", F.explode(F.sequence(place(F.col("start") - off), place(F.col("end") + off))))
    h = F.when(F.col("_hit"), F.struct("start", "end", *rest))
    m = F.when(~F.col("_hit"), F.struct("_rank", F.col("start").alias("_s"), F.col("end").alias("_e"), F.col("field").alias("_f")))
    met = each.groupBy(*keys, "_at").agg(F.collect_list(h).alias("_h"), F.collect_list(m).alias("_m")).select(*keys, F.explode("_h").alias("_h"), "_m")
    far = lambda x: F.greatest(F.col("_h.start") - x["_e"], x["_s"] - F.col("_h.end"), F.lit(0))
    best = F.array_min(F.filter(F.transform("_m", lambda x: F.struct(far(x).alias("_off"), x["_rank"], x["_s"], x["_f"])), lambda x: x["_off"] <= within))
    out = met.select(*keys, F.col("_h.start").alias("start"), F.col("_h.end").alias("end"), F.struct(*(F.col(f"_h.{c}").alias(c) for c in rest)).alias("_rest"), best.alias("_best"))
    one = out.groupBy(*keys, "start", "end").agg(F.min("_best").alias("_best"), F.first("_rest").alias("_rest"))
    return one.select(*keys, "_rest.*", "start", "end", F.col("_best._f").alias("marker"))


def sentences(text: Column) -> Column:
    """Sentences of a text: cut behind a stop and at line ends, blanks as one, bullets cut off, 12 to 1,500 characters."""
    cut = F.split(text, r"(?<=[.;:!?])\s+|\n+")
    compact = F.transform(cut, lambda s: F.regexp_replace(F.regexp_replace(s, r"\s+", " "), r"^[ \-•]+|[ \-•]+$", ""))
    return F.filter(compact, lambda s: F.char_length(s).between(12, 1500))
