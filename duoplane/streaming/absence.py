"""The discovered plane kept by a stream: what collectors see and miss, run by run, in keyed state.

The stream's rows are sightings and closings of runs. State is kept by (tenant, bucket of the key's hash) as a map from key to what is
known of it; a closing goes to every bucket, where an entitled one marks what its collector owns and did not see. A sighting costs
one entry of one bucket, and only a closing goes through a bucket: no run rewrites what it did not touch. Rows that come again or late change
nothing that a later run has settled, so a replayed delivery gives the same state. Where a batch is read, of each key's sightings the last is kept, and
what is left goes to the buckets many rows at a time: state functions get rows one by one, which costs more than all that is done with them.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from ..model import KEY

SEEN, CLOSED = "seen", "closed"
#: What a stream's rows have: a sighting its key and, where a run sees a key more than once, when (or null) and at which position, of which the last
#: counts; a closing whether it may tell absence, and when it ended. Runs of a tenant are numbered in the order in which they count.
OBSERVATION = "tenant_id string, collector string, run long, event string, kind string, scope string, name string, provider_id string, position long, entitled boolean, at timestamp"
_KEPT = [c for c in KEY if c != "tenant_id"]
_ENTRY = T.StructType([T.StructField("run", T.LongType()), T.StructField("moment", T.LongType()), T.StructField("position", T.LongType()), T.StructField("collector", T.StringType()), T.StructField("provider_id", T.StringType()), T.StructField("absent_since", T.TimestampType())])
CHANGE = T.StructType([*[T.StructField(c, T.StringType()) for c in (*KEY, "provider_id")], T.StructField("last_seen_run", T.LongType()), T.StructField("collector", T.StringType()), T.StructField("is_absent", T.BooleanType()), T.StructField("absent_since", T.TimestampType())])
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
SHUFFLED = "spark.sql.shuffle.partitions"
STATE = "plane"
#: Sightings of a bucket that a task holds at a time, and changed rows that it hands over at a time.
HELD, _ROWS = 200_000, 10_000
_SIGHTING = [*_KEPT, "run", "moment", "position", "collector", "provider_id"]
#: Observations of a bucket in one value: a stream in Arrow's format.
PACKED = "tenant_id string, bucket int, observations binary"
_OBSERVED = pa.schema([("collector", pa.string()), ("run", pa.int64()), ("event", pa.string()), *[(c, pa.string()) for c in (*_KEPT, "provider_id")], ("position", pa.int64()), ("entitled", pa.bool_()), ("at", pa.timestamp("us"))])
#: Observations that a task holds at a time to pack them.
_GATHERED = 100_000


def _timed(rows: pd.DataFrame) -> pd.DataFrame:
    return rows.assign(moment=rows["at"].astype("datetime64[us]").astype("int64").where(rows["at"].notna(), -1))


def _last(seen: pd.DataFrame, by: list[str] = _KEPT) -> pd.DataFrame:
    """The sighting of each key that counts: of the last run in it, the last one."""
    return seen.astype({"position": "int64"}, copy=False).sort_values(["run", "moment", "position"], kind="stable").drop_duplicates(by, keep="last")


def packed(pieces: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """PACKED of bucketed observations: closings, and the last sighting of each key among those that are held together."""

    def emitted(rows: pd.DataFrame) -> pd.DataFrame:
        out = []
        for (tenant_id, bucket), some in rows.reindex(columns=["tenant_id", "bucket", *_OBSERVED.names]).groupby(["tenant_id", "bucket"], sort=False, dropna=False):
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, _OBSERVED) as stream:
                stream.write_batch(pa.RecordBatch.from_pandas(some, _OBSERVED, preserve_index=False))
            out.append((tenant_id, bucket, sink.getvalue().to_pybytes()))
        return pd.DataFrame(out, columns=["tenant_id", "bucket", "observations"])

    held: list[pd.DataFrame] = []
    waiting = 0
    for piece in pieces:
        closed = piece["event"] == CLOSED
        if closed.any():
            yield emitted(piece[closed])
            if closed.all():
                continue
        held.append(_last(_timed(piece[piece["event"] == SEEN].drop(columns="entitled")), ["tenant_id", *_KEPT]))
        waiting += len(held[-1])
        if waiting >= _GATHERED:
            held = [_last(pd.concat(held, ignore_index=True), ["tenant_id", *_KEPT])]
            waiting = len(held[0])
            if 2 * waiting > _GATHERED:  # mostly different keys
                yield emitted(held.pop())
                waiting = 0
    if held:
        yield emitted(_last(pd.concat(held, ignore_index=True), ["tenant_id", *_KEPT]))


def unpacked(observations: bytes) -> pd.DataFrame:
    return pa.ipc.open_stream(observations).read_pandas()


class Plane(StatefulProcessor):
    """One bucket: entries by (kind, scope, name); absent_since is null for what is there."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.entries = handle.getMapState(STATE, T.StructType([T.StructField(c, T.StringType()) for c in _KEPT]), _ENTRY)

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        """Sightings come in pieces, of which each key's last one is kept, up to ``HELD`` of them; then the runs' closings, in order. A sighting of a later run
        than a closing's undoes what that does to its key, so that all sightings may go first."""
        tenant_id, changed = key[0], {}
        self.known, self.whole = None, False
        closings: list[pd.DataFrame] = []
        pieces: list[pd.DataFrame] = []
        waiting = 0
        for piece in rows:
            piece = _timed(piece)
            if (ends := piece["event"] == CLOSED).any():
                closings.append(piece[ends].drop_duplicates(["run", "collector"]))
                if ends.all():  # without sightings its positions are no integers
                    continue
            pieces.append(_last(piece.loc[piece["event"] == SEEN, _SIGHTING]))
            waiting += len(pieces[-1])
            if waiting >= HELD:
                pieces = [_last(pd.concat(pieces, ignore_index=True))]
                waiting = len(pieces[0])
                if 2 * waiting > HELD:  # mostly different keys: the state takes them
                    self._saw_all(pieces.pop(), changed)
                    waiting = 0
        if pieces:
            self._saw_all(_last(pd.concat(pieces, ignore_index=True)), changed)
        if closings:
            self.known = self.known or {}
            ended = pd.concat(closings, ignore_index=True).drop_duplicates(["run", "collector"]).sort_values("run", kind="stable")
            for r in ended.itertuples():
                if r.entitled:
                    self._missed(int(r.run), r.collector, r.at.to_pydatetime(), changed)
        out = [(k[0], tenant_id, k[1], k[2], e[4], e[0], e[3], e[5] is not None, e[5]) for k, e in changed.items()]
        for i in range(0, len(out), _ROWS):
            yield pd.DataFrame(out[i : i + _ROWS], columns=CHANGE.names)

    def _look(self, most: int) -> None:
        """Go through the bucket's entries, which come many at a time, up to ``most`` of them: to ask for each takes far longer."""
        self.known = {}
        for name, entry in self.entries.iterator():
            if len(self.known) == most:
                return
            self.known[tuple(name)] = tuple(entry)
        self.whole = True

    def _set(self, name: tuple, entry: tuple, changed: dict[tuple, tuple]) -> None:
        self.entries.updateValue(name, entry)
        self.known[name] = changed[name] = entry

    def _saw_all(self, seen: pd.DataFrame, changed: dict[tuple, tuple]) -> None:
        if self.known is None:
            self._look(4 * len(seen))
        for kind, scope, name, run, moment, position, collector, provider_id in zip(*(seen[c].tolist() for c in _SIGHTING), strict=True):
            self._saw((kind, scope, name), (int(run), int(moment), int(position), collector, None if pd.isna(provider_id) else provider_id, None), changed)

    def _saw(self, name: tuple, entry: tuple, changed: dict[tuple, tuple]) -> None:
        old = self.known.get(name) or (None if self.whole else self.entries.getValue(name))
        if old is None or tuple(old[:3]) < entry[:3]:
            self._set(name, entry, changed)

    def _missed(self, run: int, collector: str, at: Any, changed: dict[tuple, tuple]) -> None:
        entries = self.known.items() if self.whole else self.entries.iterator()
        gone = [(tuple(k), tuple(e)) for k, e in entries if e[3] == collector and e[0] < run and e[5] is None]
        for name, e in gone:
            self._set(name, (*e[:5], at), changed)


class PackedPlane(Plane):
    """The same over PACKED rows."""

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        yield from super().handleInputRows(key, (unpacked(x) for piece in rows for x in piece["observations"]), timerValues)


def bucketed(observations: DataFrame, buckets: int) -> DataFrame:
    """Each sighting with its bucket, each closing in every one."""
    one = F.array(F.pmod(F.xxhash64(*_KEPT), F.lit(buckets)).cast("int"))
    every = F.sequence(F.lit(0), F.lit(buckets - 1))
    return observations.withColumn("bucket", F.explode(F.when(F.col("event") == CLOSED, every).otherwise(one)))


def observe_plane(observations: DataFrame, checkpoint: str, buckets: int, sink: object, interval: str | None = None, tasks: int | None = None) -> StreamingQuery:
    """Keep the plane of a stream of OBSERVATION rows; ``sink(changes, batch)`` gets each batch's changed rows (CHANGE). With an ``interval``
    for good, else over what is there. ``buckets`` is part of the checkpoint: one for every 100,000 keys at least, and several for each of the ``tasks`` that
    keep the state (as many as a shuffle's partitions, or fewer, as each opens and writes a store in every batch)."""
    spark = observations.sparkSession
    had, shuffled = spark.conf.get(PROVIDER), spark.conf.get(SHUFFLED)
    spark.conf.set(PROVIDER, ROCKS)  # a query keeps the settings that it is started with
    spark.conf.set(SHUFFLED, min(int(shuffled), tasks or int(shuffled)))
    try:
        by_bucket = bucketed(observations, buckets).mapInPandas(packed, PACKED).groupBy("tenant_id", "bucket")
        changes = by_bucket.transformWithStateInPandas(PackedPlane(), CHANGE, "Update", "None")
        writer = changes.writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(sink)
        return (writer.trigger(processingTime=interval) if interval else writer.trigger(availableNow=True)).start()
    finally:
        spark.conf.set(PROVIDER, had)
        spark.conf.set(SHUFFLED, shuffled)


def plane_of(spark: SparkSession, checkpoint: str) -> DataFrame:
    """The plane as the stream's state has it after its last batch (CHANGE), read in parallel from the state store."""
    had = spark.conf.get(PROVIDER)
    spark.conf.set(PROVIDER, ROCKS)
    try:
        held = spark.read.format("statestore").option("path", checkpoint).option("stateVarName", STATE).load()
        k, e = "user_map_key", "user_map_value"
        return held.select(F.col(f"{k}.kind").alias("kind"), F.col("key.tenant_id").alias("tenant_id"), F.col(f"{k}.scope").alias("scope"), F.col(f"{k}.name").alias("name"), f"{e}.provider_id", F.col(f"{e}.run").alias("last_seen_run"), f"{e}.collector", F.col(f"{e}.absent_since").isNotNull().alias("is_absent"), f"{e}.absent_since")
    finally:
        spark.conf.set(PROVIDER, had)
