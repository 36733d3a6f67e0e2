"""Helpers shared by the training-data operators.

Conventions of the whole subpackage: a null text counts as an empty one; rows are identified by
(id, 64-bit hash of the text), so repeated rows and repeated or null ids never multiply or lose
rows; caller columns travel inside one struct, so their names cannot clash with helper columns.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from postcred.session import scratch_dir

ROW = "__row"


def stored(df: DataFrame, name: str, partition_by: str | None = None, compression: str | None = None) -> DataFrame:
    """Write a table to the shared checkpoint folder and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = scratch_dir(spark, f"llm-{name}")
    (df.write.partitionBy(partition_by) if partition_by else df.write).parquet(path, compression=compression)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Delete the folder of a ``stored`` table that nothing refers to any more."""
    spark = df.sparkSession
    for folder in {name.rsplit("/", 1)[0] for name in df.inputFiles()}:
        if "/postcred-llm-" in folder:
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def packed(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(__row struct of every caller column, id, text, rk): ``rk`` tells rows of one id apart."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias(ROW), F.col(id_col).alias("id"),
                     text.alias("text"), F.xxhash64(text).alias("rk"))


def unpacked(df: DataFrame, columns: list[str], **new: Column) -> DataFrame:
    """Caller columns back in their order, some replaced or added."""
    keep = [new[c].alias(c) if c in new else F.col(f"{ROW}.`{c}`").alias(c) for c in columns]
    return df.select(*keep, *[v.alias(k) for k, v in new.items() if k not in columns])


def ascii_lower(col: Column) -> Column:
    """A-Z to a-z only, as the contracts ask."""
    return F.translate(col, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and row offsets of an Arrow string column (nulls as empty), without making Python strings."""
    column = column.cast(pa.large_string()).fill_null("")
    offs = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return data, offs


def row_blocks(offs: np.ndarray, max_bytes: int = 1 << 20):
    """Row ranges of at most ``max_bytes`` of text each (a longer text is a block of its own)."""
    lo, n = 0, len(offs) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offs, offs[lo] + max_bytes, side="right")) - 1)
        yield lo, hi
        lo = hi


def mix64(x: np.ndarray) -> np.ndarray:
    """splitmix64 finaliser on uint64 arrays."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BASE = 0x9E3779B97F4A7C15
_POWERS: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS[0]) < n + 1:
        size = max(n + 1, 1 << 16)
        for i, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            _POWERS[i] = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(size, base, np.uint64)]))
    return _POWERS[0], _POWERS[1]


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit rolling hashes of byte spans: one prefix sum over the block, then two look-ups per span."""
    up, down = _powers(len(data))
    prefix = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:len(data)], out=prefix[1:])
    return mix64((prefix[ends] - prefix[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def runs(flags: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of true flags; no run crosses a position in ``cuts``."""
    if not len(flags):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    before = np.empty(len(flags), bool)
    before[0], before[1:] = False, flags[:-1]
    before[cuts[cuts < len(flags)]] = False
    after = np.empty(len(flags), bool)
    after[-1], after[:-1] = False, flags[1:]
    inner = cuts[(cuts > 0) & (cuts <= len(flags))]
    after[inner - 1] = False
    return np.flatnonzero(flags & ~before), np.flatnonzero(flags & ~after) + 1


SPACE = np.zeros(256, bool)
SPACE[[0x20, 9, 10, 11, 12, 13]] = True


def count_rows(df: DataFrame) -> int:
    return df.agg(F.count(F.lit(1))).first()[0]


def sent(df: DataFrame, max_rows: int = 1_000_000) -> DataFrame:
    """A written table of keys, marked for broadcast if it has at most ``max_rows`` rows; a larger one is joined by shuffles."""
    return F.broadcast(df) if count_rows(df) <= max_rows else df


def text_bytes(df: DataFrame, col: str = "text") -> int:
    return df.agg(F.sum(F.octet_length(col))).first()[0] or 0


def session_of(df: DataFrame) -> SparkSession:
    return df.sparkSession
