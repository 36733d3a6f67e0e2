"""SimHash near-dedup by segment popcounts and a grid range join.

A fingerprint is embedded as the vector of its 2-bit segments' bit counts.  The Manhattan distance of two
such vectors never exceeds the Hamming distance, so it is a lower bound for filtering.  The vector is
cut into two halves: if all segments together differ by at most 3, one half differs by at most 1.
Each half is a grid of unit cells; a fingerprint enters its own cell, and, if the half has an even bit
count, also the cells one step away (counts one step apart have different parity, so one of the two always
visits the other).  Rows that meet in a cell are verified by their exact bit distance.

Only distinct fingerprints enter the grid.  Inside a cell a breadth-first search over verified links emits
a spanning forest, never all pairs; cells above ``max_cell`` fingerprints are cut into chunks and each pair of
chunks is one bounded group, so no link is lost and no group is unbounded.

Defined results: a text without words has fingerprint zero; a null id takes part but never names a
component unless no id of the component is set.
"""

from __future__ import annotations

from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postcred.llm.common import packed, sent, stored, unpacked, utf8
from postcred.llm.components import connected_components

SEED = 42
_M1 = np.uint64(0x5555555555555555)


def fingerprint(text: bytes, shingle: int = 3) -> int:
    """64-bit SimHash of a text's word shingles (A-Z lowered, repeats counted)."""
    words = text.lower().split()
    n = len(words)
    if not n:
        return 0
    joined = b" ".join(words)
    if n < shingle:
        return xxhash.xxh64_intdigest(joined, SEED)
    starts = [0, *accumulate(len(w) + 1 for w in words)]
    count, total = n - shingle + 1, np.zeros(64, np.int64)
    digest = xxhash.xxh64_intdigest
    for lo in range(0, count, 1 << 16):
        hi = min(count, lo + (1 << 16))
        h = np.fromiter((digest(joined[s:e - 1], SEED) for s, e in zip(starts[lo:hi], starts[lo + shingle:hi + shingle])),
                        np.uint64, hi - lo)
        total += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
    return int(np.packbits(total * 2 > count, bitorder="little").view("<u8")[0])


def fingerprints(base: DataFrame, shingle: int) -> DataFrame:
    """(id, rk, fp) of the rows of a ``packed`` table; fp is the unsigned fingerprint's bits in a long."""
    def run(batches):
        for b in batches:
            data, offs = utf8(b.column(2))
            fp = np.fromiter((fingerprint(data[lo:hi].tobytes(), shingle) for lo, hi in zip(offs[:-1], offs[1:])), np.uint64, len(offs) - 1)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(fp.view(np.int64))], ["id", "rk", "fp"])
    return base.select("id", "rk", "text").mapInArrow(run, "id long, rk long, fp long")


def _cells(max_bits: int):
    """Rows of the grid for each fingerprint: (cell, fp)."""
    radius = max_bits // 2  # per half

    def run(batches):
        for b in batches:
            fp = b.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            vec = fp - ((fp >> np.uint64(1)) & _M1)  # 2-bit fields, each the bit count of its segment
            cells, fps = [], []
            for half in range(2):
                own = (vec >> np.uint64(32 * half)) & np.uint64(0xFFFFFFFF)
                tag = np.uint64(half << 32)
                cells.append(own | tag)
                fps.append(fp)
                bits = np.bitwise_count((fp >> np.uint64(32 * half)) & np.uint64(0xFFFFFFFF))
                even = np.ones(len(fp), bool) if radius > 1 else (bits % 2 == 0)
                front = [(own[even], fp[even], 0)] if radius else []
                for _ in range(radius):
                    step = []
                    for c, f, first in front:
                        for i in range(first, 16):
                            shift, field = np.uint64(2 * i), (c >> np.uint64(2 * i)) & np.uint64(3)
                            for ok, delta in ((field < 2, 1), (field > 0, -1)):
                                moved = c[ok] + np.uint64(1 << (2 * i)) if delta > 0 else c[ok] - (np.uint64(1) << shift)
                                step.append((moved, f[ok], i))
                                cells.append(moved | tag)
                                fps.append(f[ok])
                    front = step
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate(cells).view(np.int64)), pa.array(np.concatenate(fps).view(np.int64))], ["cell", "fp"])
    return run


def _forest(fps: np.ndarray, max_bits: int, out: list) -> None:
    """Spanning forest of the links within ``max_bits`` among distinct fingerprints."""
    rest = fps
    while len(rest) > 1:
        queue, rest = [rest[0]], rest[1:]
        while queue and len(rest):
            x = queue.pop()
            near = np.bitwise_count(rest ^ x) <= max_bits
            if near.any():
                hit, rest = rest[near], rest[~near]
                out.append((np.full(len(hit), x), hit))
                queue.extend(hit)


def _links(max_bits: int):
    """Edges from rows sorted by group (cell, i, j); groups may run over batch borders."""
    def solve(key: np.ndarray, fp: np.ndarray):
        out: list = []
        cut = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]).any(axis=1)]))
        size = np.diff(np.append(cut, len(fp)))
        two = cut[size == 2]
        if len(two):
            a, b = fp[two], fp[two + 1]
            near = (np.bitwise_count(a ^ b) <= max_bits) & (a != b)
            out.append((a[near], b[near]))
        for at, n in zip(cut[size > 2], size[size > 2]):
            _forest(np.unique(fp[at:at + n]), max_bits, out)
        a = np.concatenate([x for x, _ in out]) if out else np.empty(0, np.uint64)
        b = np.concatenate([x for _, x in out]) if out else np.empty(0, np.uint64)
        return pa.RecordBatch.from_arrays([pa.array(a.astype(np.uint64).view(np.int64)), pa.array(b.astype(np.uint64).view(np.int64))], ["a", "b"])

    def run(batches):
        key, fp = np.empty((0, 3), np.int64), np.empty(0, np.uint64)
        for batch in batches:
            k = np.stack([batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(3)], axis=1)
            key = np.concatenate([key, k])
            fp = np.concatenate([fp, batch.column(3).to_numpy(zero_copy_only=False).view(np.uint64)])
            if not len(key):
                continue
            last = np.flatnonzero((key != key[-1]).any(axis=1))
            done = last[-1] + 1 if len(last) else 0
            if done:
                yield solve(key[:done], fp[:done])
                key, fp = key[done:], fp[done:]
        if len(key):
            yield solve(key, fp)
    return run


def fingerprint_links(fps: DataFrame, max_bits: int = 3, max_cell: int = 4096) -> DataFrame:
    """Spanning links (a, b) between distinct fingerprints at most ``max_bits`` bits apart (column fp)."""
    spark = fps.sparkSession
    cells = fps.mapInArrow(_cells(max_bits), "cell long, fp long")
    cells = stored(cells, "simhash-cells")
    hot = stored(cells.groupBy("cell").count().where(F.col("count") > max_cell), "simhash-hot")
    n_hot = hot.count()
    groups = cells.select("cell", F.lit(0).alias("i"), F.lit(0).alias("j"), "fp")
    if n_hot:
        big = hot.select(F.col("cell").alias("c"), F.ceil(F.col("count") * 1.5 / max_cell).cast("int").alias("n"))
        dealt = cells.join(big, F.col("cell") == F.col("c"), "left")
        own = F.pmod(F.xxhash64("fp"), F.col("n")).cast("int")
        dealt = dealt.withColumn("own", own).withColumn(
            "other", F.explode(F.when(F.col("n").isNull(), F.array(F.lit(None).cast("int"))).otherwise(
                F.sequence(F.lit(0), F.col("n") - 1))))
        groups = dealt.select("cell", F.coalesce(F.least("own", "other"), F.lit(0)).alias("i"),
                              F.coalesce(F.greatest("own", "other"), F.lit(0)).alias("j"), "fp")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = groups.repartition(parts, "cell", "i", "j").sortWithinPartitions("cell", "i", "j", "fp")
    return dealt.mapInArrow(_links(max_bits), "a long, b long")


def fingerprint_classes(rows: DataFrame, max_bits: int = 3, max_cell: int = 4096) -> DataFrame:
    """(fp, component_id) for each distinct fingerprint of a stored (id, rk, fp) table."""
    known = stored(rows.groupBy("fp").agg(F.min("id").alias("first_id")), "simhash-distinct")
    links = fingerprint_links(known.select("fp"), max_bits, max_cell)
    roots = stored(connected_components(links), "simhash-roots")
    named = stored(known.join(roots, F.col("fp") == F.col("node"), "left")
                   .select("fp", "first_id", F.coalesce("root", "fp").alias("root")), "simhash-named")
    first = stored(named.groupBy("root").agg(F.min("first_id").alias("component_id")), "simhash-first")
    return stored(named.join(first, "root").select("fp", "component_id"), "simhash-classes")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3,
                    max_bits: int = 3, max_cell: int = 4096) -> DataFrame:
    """(id_col, rk, fingerprint, component_id): one row per input row."""
    base = packed(docs, id_col, text_col).withColumn("id", F.col("id").cast("long"))
    rows = stored(fingerprints(base, shingle), "simhash-rows")
    classes = fingerprint_classes(rows, max_bits, max_cell)
    return rows.join(classes, "fp").select(
        F.col("id").alias(id_col), "rk", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_one_per_group(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` with one row per group of near duplicates: smallest id first, then smallest text hash.

    The rows that go are found without their texts and left out by their keys, so the texts that stay need not be moved.
    """
    found = stored(near_duplicates(docs, id_col, text_col, **options), "simhash-found")
    found = found.select(F.col(id_col).alias("id"), "rk", "component_id", F.when(F.col("component_id").isNull(), F.col("fingerprint")).alias("g"))
    rank = F.struct(F.col("id").isNull().alias("n"), "id", "rk")
    best = found.groupBy("component_id", "g").agg(F.min(rank).alias("best"), F.count(F.lit(1)).alias("rows")).where("rows > 1")
    best = best.select(F.col("component_id").alias("b_component"), F.col("g").alias("b_g"), F.col("best.id").alias("b_id"), F.col("best.rk").alias("b_rk"))
    in_group = found.join(best, F.col("component_id").eqNullSafe(F.col("b_component")) & F.col("g").eqNullSafe(F.col("b_g")))
    is_best = F.col("id").eqNullSafe(F.col("b_id")) & (F.col("rk") == F.col("b_rk"))
    names = stored(in_group.groupBy(F.col("id").alias("x_id"), F.col("rk").alias("x_rk")).agg(
        F.max(is_best).alias("stays"), F.count(F.lit(1)).alias("rows")), "simhash-names")
    gone = sent(names.where("not stays").select("x_id", "x_rk"))
    again = sent(names.where("stays and rows > 1").select("x_id", "x_rk"))  # repeated rows: one of each stays
    base = packed(docs, id_col, text_col).withColumn("id", F.col("id").cast("long"))
    same = F.col("id").eqNullSafe(F.col("x_id")) & (F.col("rk") == F.col("x_rk"))
    kept = base.join(gone, same, "left_anti")
    if again.head(1):
        kept = kept.join(again, same, "left_anti").unionByName(base.join(again, same, "left_semi").dropDuplicates(["id", "rk"]))
    return unpacked(kept, docs.columns)


def op2_simhash_near_dedup(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return near_duplicates(docs).select("doc_id", "fingerprint", "component_id")
