"""Alert payloads, grouping, inhibition and repeat suppression."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mlwatch.functions.columns import quoted
from mlwatch.operators.frames import settled
from mlwatch.operators.order import DEPTH, equi_depth

# The labels that make up an alert group, the repeat interval, and how long an alert fires.
GROUP_BY = ("alertname", "job", "severity")
INHIBIT_EQUAL = ("alertname", "job")
REPEAT_SECONDS = 3600
HOLD_SECONDS = 300

PAYLOAD = (
    "struct<status: string, alerts: array<struct<status: string, labels: map<string,string>, "
    "annotations: map<string,string>>>>"
)


def flatten_alerts(df: DataFrame, json: str, keep: Sequence[str] = ()) -> DataFrame:
    """One row per alert of each webhook payload; what an alert does not say is taken from its envelope."""
    body = F.from_json(F.col(quoted(json)), PAYLOAD)
    rows = df.select(*keep, body.alias("b")).select(
        *keep, F.col("b.status").alias("_envelope"), F.explode("b.alerts").alias("a")
    )

    def label(name: str):
        return F.coalesce(F.col("a.labels")[name], F.lit("unknown"))

    def note(name: str):
        return F.coalesce(F.col("a.annotations")[name], F.lit(""))

    return rows.select(
        *keep,
        label("alertname").alias("alertname"),
        label("severity").alias("severity"),
        note("summary").alias("summary"),
        note("description").alias("description"),
        F.coalesce(F.col("a.status"), F.col("_envelope"), F.lit("unknown")).alias("status"),
    )


def group_alerts(alerts: DataFrame, ts: str = "ts", by: Sequence[str] = GROUP_BY) -> DataFrame:
    """Alerts per group with the times of the first and the latest."""
    return alerts.groupBy(*by).agg(
        F.count("*").alias("alerts"), F.min(ts).alias("first_at"), F.max(ts).alias("last_at")
    )


def _labels(names: Sequence[str]) -> Column:
    """Labels as one value; absent ones are equal."""
    return F.struct(*[F.coalesce(F.col(quoted(c)).cast("string"), F.lit("")).alias(f"l{i}") for i, c in enumerate(names)])


def _micros(ts: str) -> Column:
    return F.unix_micros(F.col(quoted(ts)).cast("timestamp"))


def inhibit(alerts: DataFrame, ts: str = "ts", equal: Sequence[str] = INHIBIT_EQUAL, hold_seconds: int = HOLD_SECONDS) -> DataFrame:
    """Alerts without the warnings that a critical alert with the same labels covers while it fires.

    A critical alert fires from its time until ``hold_seconds`` later; absent labels are equal. Time is cut into stretches
    as long as that: within one, the criticals of the stretch before cover its start up to the latest one's end, and its
    own ones everything from the earliest on. So two times per label set and stretch decide, and alerts meet them by
    equality only.
    """
    span = hold_seconds * 1_000_000
    piece = F.floor(F.col("_us") / span)
    marked = alerts.withColumns({"_same": _labels(equal), "_us": _micros(ts)}).withColumn("_piece", piece)
    critical = marked.where(F.col("severity") == "critical").groupBy("_same", "_piece")
    critical = critical.agg(F.min("_us").alias("_from"), F.max("_us").alias("_last"))
    after = critical.select("_same", (F.col("_piece") + 1).alias("_piece"), (F.col("_last") + span).alias("_until"), F.lit(None).cast("bigint").alias("_from"))
    own = critical.select("_same", "_piece", F.lit(None).cast("bigint").alias("_until"), "_from")
    cover = after.unionByName(own).groupBy("_same", "_piece").agg(F.max("_until").alias("_until"), F.max("_from").alias("_from"))
    out = marked.join(cover, ["_same", "_piece"], "left")
    covered = (F.col("_us") < F.col("_until")) | (F.col("_us") >= F.col("_from"))
    silent = (F.col("severity") == "warning") & F.coalesce(covered, F.lit(False))
    return out.where(~F.coalesce(silent, F.lit(False))).select(*alerts.columns)


def _exits(times: np.ndarray, interval: int) -> tuple[np.ndarray, np.ndarray]:
    """What a stretch of sorted times does to the time of the last alert sent, as steps (upto, exit).

    The first time an interval after that one is sent, and from there all is settled: ``exit`` is the last one sent
    if that first time lies at or before ``upto`` and after the step before. Each time points to the next one that would be sent; the
    pointers are followed in doubling strides. Only times up to an interval after the first can come first.
    """
    n = len(times)
    ahead = np.append(np.searchsorted(times, times + interval), n)
    last = np.arange(n + 1)
    while (ahead[:n] < n).any():
        last = np.where(ahead < n, last[np.minimum(ahead, n - 1)], last)
        ahead = np.where(ahead < n, ahead[np.minimum(ahead, n - 1)], n)
    some = min(n, int(np.searchsorted(times, times[0] + interval)) + 1)
    exits, upto = times[last[:some]], times[:some]
    keep = np.append(exits[1:] != exits[:-1], True)
    return upto[keep], exits[keep]


def _sent(times: np.ndarray, before: int | None, interval: int) -> np.ndarray:
    """The sorted times that are sent after an alert at ``before``."""
    out = []
    at = 0 if before is None else int(np.searchsorted(times, before + interval))
    while at < len(times):
        out.append(times[at])
        at = int(np.searchsorted(times, times[at] + interval))
    return np.array(out, np.int64)


def _entries(listed: DataFrame, kind: str, interval: int) -> DataFrame:
    """(_grp, _piece, _before): the last alert sent before each piece of a group that has several.

    Pieces become functions of that time side by side; only their steps are then passed through, piece by piece.
    """

    def functions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            steps = [_exits(np.asarray(t, np.int64), interval) for t in b.column("_us").to_pylist()]
            lists = [pa.array([s[k] for s in steps], pa.list_(pa.int64())) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays([b.column("_grp"), b.column("_piece"), *lists], ["_grp", "_piece", "_upto", "_exit"])

    def composed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, before = None, None
        for b in batches:
            out = []
            for i, own in enumerate(b.column("_grp").to_pylist()):
                before = before if own == group else None
                group = own
                out.append(before)
                upto, exits = (b.column(c)[i].values.to_numpy() for c in ("_upto", "_exit"))
                at = 0 if before is None else int(np.searchsorted(upto, before + interval))
                before = int(exits[at]) if at < len(exits) else before
            yield pa.RecordBatch.from_arrays([b.column("_grp"), b.column("_piece"), pa.array(out, pa.int64())], ["_grp", "_piece", "_before"])

    steps = listed.mapInArrow(functions, f"_grp {kind}, _piece long, _upto array<long>, _exit array<long>")
    dealt = steps.repartition("_grp").sortWithinPartitions("_grp", "_piece")
    return dealt.mapInArrow(composed, f"_grp {kind}, _piece long, _before long")


def dedup_repeat(
    alerts: DataFrame,
    ts: str = "ts",
    tie: str = "event_id",
    by: Sequence[str] = GROUP_BY,
    seconds: int = REPEAT_SECONDS,
    depth: int = DEPTH,
) -> DataFrame:
    """Alerts as they are sent on: the first of a group, and then the first at or after the repeat interval since the
    last one that was sent. Of alerts at one time the first by ``tie`` is sent. Alerts without a time are not.

    A group's times are looked through in order, in pieces of ``depth`` at most. A piece of a longer group is first
    turned into a function from the time of the last alert sent before it to that of the last one sent in it; composing the functions
    tells every piece where to start, so that pieces are searched side by side.
    """
    interval = seconds * 1_000_000
    keyed = alerts.withColumns({"_grp": _labels_null_safe(by), "_us": _micros(ts)})
    moments = keyed.where("_us IS NOT NULL").groupBy("_grp", "_us").agg(F.min(tie).alias("_tie"))
    kind = moments.schema["_grp"].dataType.simpleString()
    moments = settled(moments)
    pieced = equi_depth(moments, ["_grp"], ["_us"], "_piece", depth)
    if pieced is None:
        entered = moments.groupBy("_grp").agg(F.array_sort(F.collect_list("_us")).alias("_us")).withColumn("_before", F.lit(None).cast("bigint"))
    else:
        listed = settled(pieced.groupBy("_grp", "_piece").agg(F.array_sort(F.collect_list("_us")).alias("_us")))
        entries = _entries(listed.select("_grp", "_piece", "_us"), kind, interval)
        entered = listed.join(entries, ["_grp", "_piece"]).select("_grp", "_us", "_before")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            befores = b.column("_before").to_pylist()
            sent = [_sent(b.column("_us")[i].values.to_numpy(), befores[i], interval) for i in range(b.num_rows)]
            rows = np.repeat(np.arange(b.num_rows), [len(s) for s in sent])
            times = np.concatenate([*sent, np.empty(0, np.int64)])
            yield pa.RecordBatch.from_arrays([b.column("_grp").take(pa.array(rows)), pa.array(times, pa.int64())], ["_grp", "_us"])

    sent = entered.mapInArrow(search, f"_grp {kind}, _us long")
    first = moments.join(sent, ["_grp", "_us"]).select("_grp", "_us", F.col("_tie").alias("_sent"))
    out = keyed.join(first, ["_grp", "_us"]).where(F.col(quoted(tie)) == F.col("_sent"))
    return out.select(*alerts.columns)


def _labels_null_safe(names: Sequence[str]) -> Column:
    """Labels as one value; structs compare null-safely in joins."""
    return F.struct(*[F.col(quoted(c)).alias(f"l{i}") for i, c in enumerate(names)])
