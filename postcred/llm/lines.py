"""Line dedup: levelled sorted runs of line hashes.

Documents come in batches of descending id.  A batch's line keys are merge-anti-joined with the
runs written so far: unseen keys enter the batch's own run together with their keeper (the largest
document that holds them), seen ones only add to the count.  Runs are sorted by key; ``fanout`` runs
of one level are compacted into one run of the next.  The final run says how many documents hold a
key and which one keeps it.  Keys are 128-bit hashes of the stripped, A-Z-lowered line.

Defined results: a null or empty text is one empty line; repeated rows of one id count as one document
and all lose or keep the same lines; rows without an id count as one document, never the keeper.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postcred.llm.common import ascii_lower, packed, stored, unpacked

H = ["h1", "h2"]
BLANKS = " \t\n\x0b\x0c\r"


def line_pairs(docs: DataFrame, min_chars: int) -> DataFrame:
    """(id, rk, line number, 128-bit key) of the lines that are long enough."""
    lines = docs.select("id", "rk", F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"))
    key = ascii_lower(F.btrim("line", F.lit(BLANKS)))
    return (lines.select("id", "rk", "pos", key.alias("key")).where(F.length("key") >= min_chars)
            .select("id", "rk", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(7), "key").alias("h2")))


def _compact(runs: list[DataFrame], name: str) -> DataFrame:
    merged = runs[0]
    for r in runs[1:]:
        merged = merged.unionByName(r)
    merged = merged.groupBy(*H).agg(F.sum("n_docs").alias("n_docs"), F.max("keeper").alias("keeper"))
    return stored(merged.sortWithinPartitions(*H), name)


def key_index(pairs: DataFrame, batches: int = 3, fanout: int = 2) -> DataFrame:
    """(h1, h2, n_docs, keeper) over all documents, built batch by batch from levelled runs."""
    held = stored(pairs.select("id", *H).distinct(), "line-keys")
    shares = [1 - i / batches for i in range(1, batches)]
    cuts = (held.agg(F.percentile_approx("id", shares, 1000)).first()[0] if shares else None) or []
    bounds = [None, *sorted({int(c) for c in cuts}, reverse=True), None]
    levels: list[list[DataFrame]] = [[]]
    for top, low in zip(bounds, bounds[1:]):
        batch = held
        if top is not None:
            batch = batch.where((F.col("id") < top) | F.col("id").isNull())
        if low is not None:
            batch = batch.where(F.col("id") >= low)
        own = batch.groupBy(*H).agg(F.count(F.lit(1)).alias("n_docs"), F.max("id").alias("keeper"))
        seen = [r.select(*H) for level in levels for r in level]
        if seen:
            known = seen[0]
            for r in seen[1:]:
                known = known.unionByName(r)
            fresh = own.join(known, H, "left_anti")
            again = own.join(known, H, "left_semi").withColumn("keeper", F.lit(None).cast("long"))
            own = fresh.unionByName(again)
        levels[0].append(stored(own.sortWithinPartitions(*H), "line-run"))
        for i, level in enumerate(levels):
            if len(level) >= fanout:
                if i + 1 == len(levels):
                    levels.append([])
                levels[i + 1].append(_compact(level, f"line-level{i + 1}"))
                levels[i] = []
    return _compact([r for level in levels for r in level], "line-index")


def drop_repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 40,
                        min_docs: int = 5, batches: int = 3, fanout: int = 2) -> DataFrame:
    """``docs`` with the repeated lines gone from ``text_col``, plus ``n_lines`` and ``n_dropped``."""
    base = packed(docs, id_col, text_col).withColumn("id", F.col("id").cast("long"))
    pairs = stored(line_pairs(base, min_chars), "line-pairs")
    index = stored(key_index(pairs, batches, fanout).where(F.col("n_docs") >= min_docs), "line-drops")
    # Both sides are shuffled on the key, so adaptive execution can split a line that a third of the documents hold.
    gone = (pairs.join(index, H).where(~F.col("id").eqNullSafe(F.col("keeper")))
            .groupBy("id", "rk").agg(F.collect_set("pos").alias("gone")))
    # Written, so that its size is known: the texts are only moved to meet it where it is too large to be sent to them.
    gone = stored(gone.select(F.col("id").alias("g_id"), F.col("rk").alias("g_rk"), "gone"), "line-gone")
    n_gone = gone.agg(F.coalesce(F.sum(F.size("gone") + 2), F.lit(0))).first()[0]
    cut = base.join(F.broadcast(gone) if n_gone <= 2_000_000 else gone, F.col("id").eqNullSafe(F.col("g_id")) & (F.col("rk") == F.col("g_rk")), "left")
    cut = cut.withColumn("lines", F.split("text", "\n", -1))
    left = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.col("gone"))
    kept = cut.withColumn("left", left).withColumn(
        "kept", F.when(F.col("gone").isNull(), F.col("text")).otherwise(
            F.array_join(F.transform("left", lambda i: F.get(F.col("lines"), i)), "\n")))
    n = F.size("lines").cast("long")
    return unpacked(kept, docs.columns, **{
        text_col: F.col("kept"), "n_lines": n,
        "n_dropped": F.when(F.col("gone").isNull(), F.lit(0)).otherwise(F.size("gone")).cast("long")})


def op5_line_dedup(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = drop_repeated_lines(docs)
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


OP5_SQL = r"""
WITH lines AS (
  SELECT doc_id, i, parts[i] AS line,
         translate(trim(parts[i], chr(32)||chr(9)||chr(10)||chr(11)||chr(12)||chr(13)),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM (SELECT doc_id, parts, unnest(range(1, len(parts) + 1)) AS i
        FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents))),
keys AS (SELECT key, max(doc_id) AS keeper FROM lines WHERE length(key) >= 40
         GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
marked AS (SELECT l.doc_id, l.i, l.line, (k.key IS NOT NULL AND l.doc_id <> k.keeper) AS gone
           FROM lines l LEFT JOIN keys k ON l.key = k.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
