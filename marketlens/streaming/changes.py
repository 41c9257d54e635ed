"""Typed events from observed versions of objects, in a batch and as a stream with keyed state.

An observation says what an object's fields were at a version, and when it arrived. In order of arrival, an observation is
taken if its version is higher than all that came before; late and repeated ones change nothing. The first one taken makes
the object known, and each later one is held against the one before it: fields that differ are an event, whose type follows
from the kind of object.

The batch form is one window per object, whose rows are sorted on disk where they don't fit. The stream keeps, for each
object, only the highest version and the fields taken last, so state grows with the objects and not with their versions.
As both go by order of arrival, a stream gives the same events however it is cut into batches.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from marketlens.registry import query
from marketlens.session import shared_folder
from marketlens.streaming import events

# Type of event by kind of object, when it is new and when its fields changed; kinds that aren't named give none.
EVENT_TYPES = {
    "REQUEST": ("opportunity.created", "opportunity.updated"), "NOTICE": ("opportunity.created", "opportunity.updated"),
    "CONTRACT": ("contract.created", "contract.modified"), "PAYMENT": ("payment.detected", "payment.detected"),
}
#: Companies give one event only: another status, where both are known.
COMPANY, STATUS, STATUS_CHANGED = "COMPANY", "status", "company.status_changed"
CREATED = "created"
#: object_id, kind, arrival, version, fields: what a source saw. Equal arrivals of an object go by version.
OBSERVED = "object_id long, kind string, arrival long, version timestamp_ntz, fields map<string,string>"
EVENT = "object_id long, kind string, arrival long, event_type string, change string, event_id string"
_COLUMNS = [c.split()[0] for c in EVENT.split(", ")]


def batch_events(observed: DataFrame) -> DataFrame:
    """(object_id, kind, arrival, event_type, change, event_id) of OBSERVED rows. ``change`` names each field that differs as
    field=old>new, in order of names (null for one that isn't there); ``event_id`` is the digest that sinks compare."""
    w = Window.partitionBy("object_id").orderBy("arrival", "version")
    seen = F.max("version").over(w.rowsBetween(Window.unboundedPreceding, -1))
    taken = observed.where("object_id is not null and version is not null").withColumn("_seen", seen).where("_seen is null or version > _seen")
    x = taken.withColumns({"_old": F.lag("fields").over(w), "_n": F.row_number().over(w), "fields": F.coalesce("fields", F.create_map().cast("map<string,string>"))})
    old = F.coalesce("_old", F.create_map().cast("map<string,string>"))
    names = F.array_sort(F.array_distinct(F.concat(F.map_keys(old), F.map_keys("fields"))))
    value = lambda m, k: F.try_element_at(m, k)
    differ = F.filter(names, lambda k: ~value(old, k).eqNullSafe(value(F.col("fields"), k)))
    said = F.array_join(F.transform(differ, lambda k: F.concat(k, F.lit("="), F.coalesce(value(old, k), F.lit("null")), F.lit(">"), F.coalesce(value(F.col("fields"), k), F.lit("null")))), ";")
    new, status = F.col("_n") == 1, F.lit(STATUS)
    kind = F.when(F.col("kind") == COMPANY, F.when(~new & value(old, status).isNotNull() & value(F.col("fields"), status).isNotNull() & (value(old, status) != value(F.col("fields"), status)), STATUS_CHANGED))
    for k, (created, changed) in EVENT_TYPES.items():
        kind = kind.when(F.col("kind") == k, F.when(new, created).when(F.size(differ) > 0, changed))
    own = F.when(F.col("kind") == COMPANY, F.concat(status, F.lit("="), value(old, status), F.lit(">"), value(F.col("fields"), status))).when(new, CREATED).otherwise(said)
    out = x.select("object_id", "kind", "arrival", kind.alias("event_type"), own.alias("change"), "version").where("event_type is not null")
    digest = F.sha2(F.concat_ws("|", F.col("object_id").cast("string"), "event_type", "change", F.date_format("version", "yyyy-MM-dd HH:mm:ss.SSSSSS")).cast("binary"), 256)
    return out.withColumn("event_id", digest).drop("version")


def _event_type(kind: str | None, new: bool, old: dict, fields: dict, differ: list[str]) -> str | None:
    if kind == COMPANY:
        a, b = old.get(STATUS), fields.get(STATUS)
        return STATUS_CHANGED if not new and a is not None and b is not None and a != b else None
    created, changed = EVENT_TYPES.get(kind or "", (None, None))
    return created if new else changed if differ else None


def _step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Takes an object's new observations in order of arrival; state holds (highest version, fields taken last as JSON)."""
    version, fields = state.get if state.exists else (None, None)
    old = json.loads(fields) if fields else {}
    rows = pd.concat(list(batches)).sort_values(["arrival", "version"], kind="stable")
    out = []
    for r in rows.itertuples():
        at = pd.Timestamp(r.version)
        if version is not None and at.value // 1000 <= version:
            continue
        new, now = version is None, json.loads(r.fields or "{}")
        version = at.value // 1000
        differ = sorted(k for k in {*old, *now} if old.get(k) != now.get(k))
        kind = _event_type(r.kind, new, old, now, differ)
        text = lambda m, k: "null" if m.get(k) is None else m[k]
        if kind:
            said = [STATUS] if r.kind == COMPANY else differ
            change = CREATED if new and r.kind != COMPANY else ";".join(f"{k}={text(old, k)}>{text(now, k)}" for k in said)
            digest = hashlib.sha256("|".join((str(r.object_id), kind, change, at.strftime("%Y-%m-%d %H:%M:%S.%f"))).encode()).hexdigest()
            out.append((int(r.object_id), r.kind, int(r.arrival), kind, change, digest))
        old = now
    if version is not None:
        state.update((version, json.dumps(old)))
    yield pd.DataFrame(out, columns=_COLUMNS)


def stream_events(observed: DataFrame) -> DataFrame:
    """The same events of a stream of OBSERVED rows."""
    flat = observed.where("object_id is not null and version is not null").withColumn("fields", F.to_json("fields"))
    return flat.groupBy("object_id").applyInPandasWithState(_step, EVENT, "version long, fields string", "append", GroupStateTimeout.NoTimeout)


def expiring(contracts: DataFrame, as_of: str, days: int = 30) -> DataFrame:
    """(object_id, event_type, change, event_id) of contracts (object_id, end_date) that end within ``days`` from ``as_of``: one
    event a contract and day, as the day is part of what sinks compare."""
    day = F.lit(as_of).cast("date")
    due = contracts.where(F.col("end_date").between(day, F.date_add(day, days)))
    change = F.concat(F.lit("end_date="), F.col("end_date").cast("string"), F.lit(f";as_of={as_of}"))
    out = due.select("object_id", F.lit("contract.expiring").alias("event_type"), change.alias("change"))
    return out.withColumn("event_id", F.sha2(F.concat_ws("|", F.col("object_id").cast("string"), "event_type", "change").cast("binary"), 256))


def observations(source: DataFrame) -> DataFrame:
    """Events of the tables as observations of users: type and key are fields, the kind follows from the user."""
    kinds = F.array(*(F.lit(k) for k in (*EVENT_TYPES, COMPANY)))
    fields = F.create_map(F.lit(STATUS), F.col("event_type"), F.lit("key"), (F.get_json_object("props", "$.k").cast("long") % 3).cast("string"))
    return source.select(F.col("user_id").alias("object_id"), F.get(kinds, (F.col("user_id") % 5).cast("int")).alias("kind"), F.col("event_id").alias("arrival"), F.col("ts").cast("timestamp_ntz").alias("version"), fields.alias("fields"))


_CHANGES_SQL = """with o as (select user_id as object_id, ['REQUEST', 'NOTICE', 'CONTRACT', 'PAYMENT', 'COMPANY'][cast(user_id % 5 as int) + 1] as kind, event_id as arrival, ts, event_type as s,
    cast(cast(json_extract(props, '$.k') as bigint) % 3 as varchar) as k from events),
  t as (select *, max(ts) over (partition by object_id order by arrival rows between unbounded preceding and 1 preceding) as seen from o),
  x as (select *, lag(s) over w as ps, lag(k) over w as pk, row_number() over w as n from t where seen is null or ts > seen window w as (partition by object_id order by arrival))
select object_id, kind, arrival, case kind when 'COMPANY' then 'company.status_changed' when 'CONTRACT' then case n when 1 then 'contract.created' else 'contract.modified' end when 'PAYMENT' then 'payment.detected'
    else case n when 1 then 'opportunity.created' else 'opportunity.updated' end end as event_type,
  case when kind = 'COMPANY' then 'status=' || ps || '>' || s when n = 1 then 'created' else concat_ws(';', case when k <> pk then 'key=' || pk || '>' || k end, case when s <> ps then 'status=' || ps || '>' || s end) end as change
from x where case when kind = 'COMPANY' then n > 1 and s <> ps else n = 1 or s <> ps or k <> pk end"""


@query("act_changes", _CHANGES_SQL)
def act_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Typed events of all observations, as a batch."""
    return batch_events(observations(spark.read.parquet(f"{sf_dir}/events.parquet"))).drop("event_id")


@query("stream_act_changes", _CHANGES_SQL)
def stream_act_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same by a stream that runs over what is there and stops."""
    at = f"{shared_folder(spark)}/act-changes-{uuid.uuid4().hex}"
    events.run_once(stream_events(observations(events.stream(spark, sf_dir))), events.append_to(f"{at}/out"), f"{at}/ckpt")
    return spark.read.schema(EVENT).parquet(f"{at}/out").select("object_id", "kind", "arrival", "event_type", "change")
