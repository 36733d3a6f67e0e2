"""Structured Streaming pieces: capture folders as a stream, and warm-started training (M3).

The reference is batch-only; its one incremental piece is training the network row slice by row
slice (``fit_mode != full``).  Here the same idea runs per micro-batch: ``foreachBatch`` fits on
the batch starting from the previous weights, and the only state kept between batches is the
weight vector (a few hundred doubles).  The capture stream reuses the batch parse / project code
and keeps the latest observation per post in the state store.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from postcred.operators.classify import Network, mlp_fit
from postcred.schemas import CAPTURE_SCHEMA, FEATURES, KEY
from postcred.sources.captures import CAPTURE_PATH_MARK, ORDER, dedup_posts, filter_originals, project_original


def capture_stream(spark: SparkSession, folder: str, path_contains: str = CAPTURE_PATH_MARK,
                   max_files_per_trigger: int | None = None) -> DataFrame:
    """Streaming S1-S4: new capture files under ``folder`` -> projected original posts."""
    reader = (spark.readStream.schema(CAPTURE_SCHEMA).option("recursiveFileLookup", "true")
              .option("mode", "PERMISSIVE"))
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", str(max_files_per_trigger))
    raw = reader.json(folder)
    parsed = (raw.select(F.struct(*[F.col(c) for c in CAPTURE_SCHEMA.fieldNames()]).alias("tweet"),
                         F.col("_metadata.file_path").alias("file"))
              .where(F.col("file").contains(path_contains)))
    return project_original(filter_originals(parsed))


def latest_posts(stream: DataFrame, watermark: str = "7 days", key: Sequence[str] = KEY) -> DataFrame:
    """Streaming S5: latest observation per post key.

    The state holds one row per post seen; the watermark is not part of the grouping key, so Spark
    does not evict posts from it.
    """
    return dedup_posts(stream.withWatermark("observed_at", watermark), key)


#: State store that timers and expiring state need.
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class LatestPost(StatefulProcessor):
    """Keeps a post's latest observation and forgets it ``ttl_seconds`` of event time after that observation.

    A row is emitted when an observation replaces the kept one, in the order of ``dedup_posts`` (time, retweets, text, the other columns).
    """

    def __init__(self, columns: Sequence[str], state_type: T.StructType, ttl_seconds: int):
        self.columns, self.state_type, self.ttl = list(columns), state_type, ttl_seconds

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.latest = handle.getValueState("latest", self.state_type)

    def _rank(self, row) -> tuple:
        rest = [c for c in self.columns if c not in ORDER]
        # Times from the state have a zone and those of rows have none: both are compared as seconds.
        plain = {c: row[c].timestamp() if isinstance(row[c], datetime) else row[c] for c in (*ORDER, *rest)}
        return tuple((v is not None, 0 if v is None else v) for v in plain.values())

    def handleInputRows(self, key, rows, timerValues):
        kept = self.latest.get() if self.latest.exists() else None
        best = None if kept is None else dict(zip(self.columns, kept))
        changed = False
        for r in rows:
            new = {c: r[c] for c in self.columns}
            if best is None or self._rank(new) > self._rank(best):
                best, changed = new, True
        if changed:
            self.latest.update(tuple(best[c] for c in self.columns))
            for old in list(self.handle.listTimers()):
                self.handle.deleteTimer(old)
            self.handle.registerTimer(int(best["observed_at"].timestamp() * 1000) + self.ttl * 1000)
            yield Row(**dict(zip(KEY, key)), **best)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        self.latest.clear()
        return iter(())

    def close(self) -> None:
        pass


def expiring_posts(stream: DataFrame, keep: str = "7 days", late: str = "1 hour", key: Sequence[str] = KEY) -> DataFrame:
    """Streaming S5 with bounded state: the latest observation per post; a post not seen for ``keep`` of event time leaves the state.

    Observations more than ``late`` behind the newest one are dropped, and so are those without a time.  A post that comes back
    after it left is emitted as a new one.  The session needs the RocksDB state store (``ROCKSDB``).
    """
    spark = stream.sparkSession
    if spark.conf.get("spark.sql.streaming.stateStore.providerClass", "") != ROCKSDB:
        raise RuntimeError(f"set spark.sql.streaming.stateStore.providerClass to {ROCKSDB}")
    seconds = int(spark.sql(f"select cast(interval '{keep}' as interval day to second) i").selectExpr("cast(extract(day from i) as long) * 86400 + "
                  "extract(hour from i) * 3600 + extract(minute from i) * 60 + cast(extract(second from i) as long) s").first()["s"])
    columns = [c for c in stream.columns if c not in key]
    state = T.StructType([T.StructField(c, stream.schema[c].dataType) for c in columns])
    out = T.StructType([*[stream.schema[c] for c in key], *state.fields])
    timed = stream.where(F.col("observed_at").isNotNull()).withWatermark("observed_at", late)
    return timed.groupBy(*key).transformWithState(LatestPost(columns, state, seconds), out, "Update", "EventTime")


class IncrementalTrainer:
    """``foreachBatch`` callback for M3: each micro-batch continues training from the last weights.

    With ``state_dir`` (a folder beside the stream's checkpoint) the model of every batch is saved under its
    epoch.  A batch always starts from the newest model of an *earlier* epoch, so a restarted trainer goes
    on where the last one ended and a replayed batch gives the same model again instead of training twice.
    """

    def __init__(self, n_classes: int, cols: Sequence[str] = FEATURES, label: str = "label",
                 max_iter_per_batch: int = 20, seed: int = 21, state_dir: str | None = None):
        self.n_classes = n_classes
        self.cols = list(cols)
        self.label = label
        self.max_iter = max_iter_per_batch
        self.seed = seed
        self.state_dir = state_dir
        self.model = None
        self.batches = 0

    def _path(self, epoch_id: int) -> str:
        return f"{self.state_dir.rstrip('/')}/epoch-{epoch_id}"

    def load(self, spark: SparkSession, before: int | None = None):
        """The newest saved model (of an epoch under ``before``), or None; also kept as ``model``."""
        path = spark._jvm.org.apache.hadoop.fs.Path(self.state_dir)
        fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
        epochs = []
        if fs.exists(path):
            for status in fs.listStatus(path):
                # a model counts once its write is complete
                if fs.exists(spark._jvm.org.apache.hadoop.fs.Path(status.getPath(), "_SUCCESS")):
                    epochs.append(int(status.getPath().getName().removeprefix("epoch-")))
        epochs = [e for e in epochs if before is None or e < before]
        self.model = Network.from_json(spark.read.text(self._path(max(epochs))).first()["value"]) if epochs else None
        return self.model

    def __call__(self, batch: DataFrame, epoch_id: int) -> None:
        if batch.isEmpty():
            return
        if self.state_dir is not None:
            self.load(batch.sparkSession, epoch_id)
        self.model = mlp_fit(batch, self.n_classes, self.cols, self.label, max_iter=self.max_iter, seed=self.seed, initial=self.model)
        if self.state_dir is not None:
            saved = batch.sparkSession.createDataFrame([(self.model.to_json(),)], "value string")
            saved.coalesce(1).write.mode("overwrite").text(self._path(epoch_id))
        self.batches += 1


def train_on_stream(stream: DataFrame, trainer: IncrementalTrainer, checkpoint_location: str,
                    available_now: bool = True):
    """Run ``trainer`` over every micro-batch of ``stream``.

    The checkpoint holds the offsets; weights are saved per epoch if the trainer has a ``state_dir``, else they
    live in ``trainer`` only.
    """
    writer = stream.writeStream.foreachBatch(trainer).option("checkpointLocation", checkpoint_location)
    writer = writer.trigger(availableNow=True) if available_now else writer
    q = writer.start()
    if available_now:
        q.awaitTermination()
    return q
