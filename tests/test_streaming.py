"""Streaming ingest over a capture folder and warm-started training per micro-batch (M3)."""

import json
import os
import tempfile

from pyspark.sql import functions as F

from postcred.streaming.incremental import IncrementalTrainer, capture_stream, latest_posts, train_on_stream


def _line(name, rt, seen):
    return json.dumps({"retweeted_status": {"user": {"screen_name": name, "followers_count": 3},
                                            "created_at": "c", "retweet_count": rt, "text": "some words here"},
                       "created_at": seen})


def test_capture_stream_latest_wins(spark):
    root = tempfile.mkdtemp(prefix="postcred-stream-")
    os.makedirs(f"{root}/Flume1")
    with open(f"{root}/Flume1/a.json", "w") as fh:
        fh.write(_line("ann", 1, "Mon Jan 01 10:00:00 +0000 2018") + "\n")
        fh.write(_line("ann", 4, "Mon Jan 01 12:00:00 +0000 2018") + "\n")
        fh.write(_line("bo", 2, "Mon Jan 01 10:00:00 +0000 2018") + "\n")
    out = latest_posts(capture_stream(spark, root))
    ck = tempfile.mkdtemp(prefix="postcred-stream-ck-")
    q = (out.writeStream.outputMode("update").format("memory").queryName("latest_posts_t")
         .option("checkpointLocation", ck).trigger(availableNow=True).start())
    q.awaitTermination()
    got = {r["screen_name"]: r["retweet_count"] for r in spark.sql("select * from latest_posts_t").collect()}
    assert got == {"ann": 4, "bo": 2}


def test_incremental_training_over_micro_batches(spark):
    src = tempfile.mkdtemp(prefix="postcred-feat-")
    df = spark.range(90).select((F.col("id") % 3).cast("double").alias("a"), (F.col("id") % 7).cast("double").alias("b"),
                                (F.col("id") % 3).cast("int").alias("label"))
    df.repartition(3).write.mode("overwrite").parquet(src)
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(src)
    trainer = IncrementalTrainer(3, cols=["a", "b"], max_iter_per_batch=10)
    train_on_stream(stream, trainer, tempfile.mkdtemp(prefix="postcred-train-ck-"))
    assert trainer.batches == 3 and trainer.model is not None


def test_trainer_goes_on_after_restart_and_replays_alike(spark):
    df = spark.range(90).select((F.col("id") % 3).cast("double").alias("a"), (F.col("id") % 7).cast("double").alias("b"),
                                (F.col("id") % 3).cast("int").alias("label"))
    state = tempfile.mkdtemp(prefix="postcred-train-state-")

    def new():
        return IncrementalTrainer(3, cols=["a", "b"], max_iter_per_batch=5, state_dir=state)
    first = new()
    first(df, 0)
    zero = list(first.model.flat())
    first(df, 1)
    one = list(first.model.flat())
    assert one != zero
    again = new()  # the stream replays epoch 1 after a restart: it starts from epoch 0, as before
    again(df, 1)
    assert list(again.model.flat()) == one
    assert list(new().load(spark).flat()) == one
    assert list(new().load(spark, before=1).flat()) == zero
    assert new().load(spark, before=0) is None


def test_posts_leave_the_state(spark, tmp_path):
    """Late rows are dropped, a post not seen for two days is forgotten, and one that comes back counts as new."""
    from postcred.streaming.incremental import ROCKSDB, expiring_posts
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    src, seen, sizes = tmp_path / "in" / "Flume", [], []
    src.mkdir(parents=True)

    def feed(name, *lines):
        (src / f"{name}.json").write_text("\n".join(lines) + "\n")
        out = expiring_posts(capture_stream(spark, str(tmp_path / "in")), keep="2 days", late="1 hour")
        got = []
        q = (out.writeStream.outputMode("update").option("checkpointLocation", str(tmp_path / "ck"))
             .foreachBatch(lambda df, _: got.extend((r["screen_name"], r["retweet_count"]) for r in df.collect())).trigger(availableNow=True).start())
        q.awaitTermination()
        sizes.append(q.lastProgress["stateOperators"][0]["numRowsTotal"])
        seen.append(sorted(got))
    try:
        feed("a", _line("ann", 1, "Mon Jan 01 10:00:00 +0000 2018"), _line("ann", 4, "Mon Jan 01 12:00:00 +0000 2018"), _line("bo", 2, "Mon Jan 01 10:30:00 +0000 2018"))
        feed("b", _line("bo", 1, "Mon Jan 01 09:00:00 +0000 2018"), _line("ann", 5, "Mon Jan 01 13:00:00 +0000 2018"))
        feed("c", _line("cy", 1, "Wed Jan 10 10:00:00 +0000 2018"))
        feed("d", _line("ann", 9, "Mon Jan 01 14:00:00 +0000 2018"), _line("dee", 3, "Wed Jan 10 11:00:00 +0000 2018"))
        feed("e", _line("ann", 2, "Wed Jan 10 12:00:00 +0000 2018"))
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
    assert seen[0] == [("ann", 4), ("bo", 2)] and seen[1] == [("ann", 5)] and seen[2] == [("cy", 1)]
    assert seen[3] == [("dee", 3)]  # the row of January 1st is behind the watermark
    assert seen[4] == [("ann", 2)]  # forgotten, so fewer retweets than before are news again
    assert sizes[3] < sizes[1] + 4  # ann and bo have gone
