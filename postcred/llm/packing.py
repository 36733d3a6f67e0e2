"""Packing by cutting-stock column generation.

Every document becomes its token ids plus an end id and is cut into full pieces and one rest.  What is left to
decide is a histogram: how many pieces there are of each length (at most ``capacity`` numbers, however large
the corpus).  On that histogram the driver solves the cutting-stock linear program: columns are
patterns of lengths that fit one sequence, an unbounded-knapsack dynamic program prices new ones, and
the solution is rounded down.  The pieces that rounding leaves over are cut: laid end to end, they first fill what
the patterns leave open, then sequences of their own (patterns with the most open room are given up until the
pieces left over suffice).  So only the last sequence may need padding; where two powers of two make up its ids, it ends
as two sequences of such lengths, which take none.

Patterns are dealt to the documents on Spark: the pieces of a length are ranked by salted
(id, text hash) groups, and rank r takes the r-th slot the patterns hold for its length; the ranks beyond them have their place on
the line of left-over pieces by formula.  Only documents with a piece that is cut are tokenized a second time, for the cuts' checksums.

Defined results: a null text has only its end id; repeated rows are packed each; rows without an id keep a null
id; ids are whole numbers (text ids must be numeric).  The result's pieces cover each id once.
"""

from __future__ import annotations

import base64
import os
import re
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from tokenizers import Tokenizer

from postcred.llm.common import packed, row_blocks, stored

CAPACITY, END_ID = 1024, 0
GROUP_PIECES = 200_000


class TokenBytes:
    """Token ids of a text as little-endian uint32 bytes.

    ``ranks_path`` holds the same vocabulary as merge ranks with its word pattern; it gives the same ids in a third of the
    time.  Texts with a special token's string always go to the tokenizer itself, and so do texts with a very long run of blanks or
    of anything else: the ranks' word pattern recurs on such runs.
    """

    LONG_RUN = re.compile(r"\s{1000}|\S{20000}")

    def __init__(self, path: str, ranks_path: str | None = None, word_pattern: str | None = None):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.tokenizer, self.fast = Tokenizer.from_file(path), None
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        if ranks_path is not None:
            with open(ranks_path, "rb") as f:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            self.fast = tiktoken.Encoding("ranks", pat_str=word_pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    def __call__(self, text: str) -> bytes:
        if self.fast is None or any(s in text for s in self.special) or (len(text) >= 1000 and self.LONG_RUN.search(text)):
            ids = self.tokenizer.encode(text, add_special_tokens=False).ids
        else:
            ids = self.fast(text)
        return np.asarray(ids, "<u4").tobytes()


def pieces_of(base: DataFrame, tokenizer_path: str, ranks_path: str | None, word_pattern: str | None, capacity: int,
              end_id: int) -> DataFrame:
    """(id, rk, start, length, ids_crc32, doc_tokens): full pieces first, then the rest."""
    end = np.asarray([end_id], "<u4").tobytes()

    def run(batches):
        ids_of = TokenBytes(tokenizer_path, ranks_path, word_pattern)
        for b in batches:
            size = np.cumsum([0, *pc.binary_length(b.column(2)).fill_null(0).to_pylist()])
            for lo, hi in row_blocks(size, 1 << 20):
                cols: list[list] = [[] for _ in range(6)]
                part = b.slice(lo, hi - lo)
                texts = [t or "" for t in part.column(2).to_pylist()]
                for i, rk, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), texts):
                    ids = ids_of(text) + end
                    n = len(ids) // 4
                    for start in range(0, n, capacity):
                        cut = ids[4 * start:4 * (start + capacity)]
                        for c, v in zip(cols, (i, rk, start, len(cut) // 4, zlib.crc32(cut), n)):
                            c.append(v)
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols],
                                                 ["id", "rk", "start", "length", "ids_crc32", "doc_tokens"])
    return base.select(F.col("id").cast("long").alias("id"), "rk", "text").mapInArrow(
        run, "id long, rk long, start long, length long, ids_crc32 long, doc_tokens long")


# ------------------------------------------------------------------------------- the linear program
def knapsack(value: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Unbounded knapsack: best value of each fill 0..capacity, and the length taken last (0: none).  value[l] is length l's worth."""
    best, took = np.zeros(capacity + 1), np.zeros(capacity + 1, np.int64)
    for c in range(1, capacity + 1):
        v = best[c - 1::-1][:c] + value[1:c + 1]
        k = int(np.argmax(v))
        if v[k] > best[c - 1] + 1e-12:
            best[c], took[c] = v[k], k + 1
        else:
            best[c] = best[c - 1]
    return best, took


def pattern_of(took: np.ndarray, capacity: int) -> dict[int, int]:
    out: dict[int, int] = {}
    c = capacity
    while c > 0:
        if took[c]:
            out[int(took[c])] = out.get(int(took[c]), 0) + 1
            c -= int(took[c])
        else:
            c -= 1
    return out


def solve(demand: np.ndarray, capacity: int = CAPACITY, gap: float = 0.002,
          per_round: int = 40, max_rounds: int = 200) -> list[tuple[dict[int, int], int]]:
    """Patterns and how often to cut each, rounded down: they cover at most ``demand[l]`` pieces of each length l.

    Revised simplex on the lengths with a demand, starting from one pattern per length.  It stops when the dual bound
    (the prices scaled by the best pattern's worth) is within ``gap`` of the linear program's value.
    """
    lengths = np.flatnonzero(demand[:capacity + 1])
    lengths = lengths[lengths > 0]
    m = len(lengths)
    if not m:
        return []
    need = demand[lengths].astype(float)
    row = {int(x): i for i, x in enumerate(lengths)}
    patterns = [{int(x): int(capacity // x)} for x in lengths]
    for x in lengths[lengths < capacity / 2]:  # a length and its complement fill a sequence: pair them as far as both go
        x, y = int(x), int(capacity - x)
        if demand[y]:
            patterns[row[y] if demand[x] >= demand[y] else row[x]] = {x: 1, y: 1}
    # Each column is one length, or a length and its complement whose own column is a single length: the inverse is written down.
    # (No threaded library call here: it may never return in a process that has forked since.)
    inverse = np.zeros((m, m))
    for i, p in enumerate(patterns):
        own = int(lengths[i])
        inverse[i, i] = 1 / p[own]
        for x in p:
            if x != own:
                inverse[row[x], i] = -1 / (p[own] * patterns[row[x]][x])
    basis = list(range(m))
    amount = (inverse * need).sum(axis=1)
    bound = 0.0
    for _ in range(max_rounds):
        price = inverse.sum(axis=0)
        worth = np.full(capacity + 1, -1.0)
        worth[lengths] = np.maximum(price, -1.0)
        best, took = knapsack(worth, capacity)
        bound = max(bound, (price * need).sum() / max(1.0, best[capacity]))
        if best[capacity] <= 1 + 1e-9 or bound >= amount.sum() * (1 - gap):
            break
        # One pricing offers many columns: the best pattern around each length, best first.
        around = worth[lengths] + best[capacity - lengths]
        for x in lengths[np.argsort(-around)[:per_round]]:
            p = pattern_of(took, capacity - int(x))
            p[int(x)] = p.get(int(x), 0) + 1
            if sum(price[row[y]] * k for y, k in p.items()) <= 1 + 1e-7:
                continue
            step = sum(inverse[:, row[y]] * k for y, k in p.items())
            up = step > 1e-9
            if not up.any():
                continue
            ratio = np.full(m, np.inf)
            ratio[up] = amount[up] / step[up]
            out = int(np.argmin(ratio))
            theta = ratio[out]
            amount -= theta * step
            amount[out] = theta
            pivot = inverse[out] / step[out]
            inverse -= step[:, None] * pivot
            inverse[out] = pivot
            price = price - (step.sum() - 1) * pivot
            basis[out] = len(patterns)
            patterns.append(p)
        np.maximum(amount, 0, out=amount)
    plan, left = [], demand.astype(np.int64).copy()
    order = np.argsort(-amount)
    for i in order:
        p = patterns[basis[i]]
        times = min([int(amount[i] + 1e-9), *(int(left[x]) // k for x, k in p.items())])
        if times > 0:
            plan.append((p, times))
            for x, k in p.items():
                left[x] -= k * times
    return plan


def open_up(plan: list[tuple[dict[int, int], int]], demand: np.ndarray, capacity: int) -> tuple[list[tuple[dict[int, int], int]], np.ndarray]:
    """The plan without as many of its least-filled sequences as it takes for the pieces left over to fill the others' open room, and those pieces by length."""
    left = demand.astype(np.int64).copy()
    left[0] = 0
    for p, times in plan:
        for x, k in p.items():
            left[x] -= k * times
    size = np.arange(len(left))
    kept = []
    spare = int((left * size).sum()) - sum((capacity - sum(x * k for x, k in p.items())) * t for p, t in plan)
    for p, times in sorted(plan, key=lambda pt: sum(x * k for x, k in pt[0].items())):
        undo = min(times, -(-max(0, -spare) // capacity))  # one sequence less: its ids are left over and its room is gone
        spare += undo * capacity
        for x, k in p.items():
            left[x] += k * undo
        if times > undo:
            kept.append((p, times - undo))
    return kept, left


def gaps(plan: list[tuple[dict[int, int], int]], left: np.ndarray, capacity: int) -> list[tuple]:
    """(first place, end place, room, first sequence, offset): where the line of left-over pieces goes."""
    out, at, sequence = [], 0, 0
    total = int((left * np.arange(len(left))).sum())
    for p, times in plan:
        fill = sum(x * k for x, k in p.items())
        if fill < capacity:
            room = capacity - fill
            out.append((at, at + room * times, room, sequence, fill))
            at += room * times
        sequence += times
    whole = (total - at) // capacity
    if whole:
        out.append((at, at + whole * capacity, capacity, sequence, 0))
        at, sequence = at + whole * capacity, sequence + whole
    rest = total - at
    ends = [1 << i for i in range(capacity.bit_length(), -1, -1) if rest >> i & 1]
    for n in ends if len(ends) <= 2 else [rest]:
        out.append((at, at + n, n, sequence, 0))
        at, sequence = at + n, sequence + 1
    return out


def slots(plan: list[tuple[dict[int, int], int]]) -> list[tuple]:
    """(length, first rank, end rank, per sequence, first sequence, offset): where the ranks of a length go."""
    out, used, sequence = [], {}, 0
    for p, times in plan:
        offset = 0
        for x in sorted(p, reverse=True):
            lo = used.get(x, 0)
            used[x] = lo + p[x] * times
            out.append((x, lo, used[x], p[x], sequence, offset))
            offset += x * p[x]
        sequence += times
    return out


def pack(docs: DataFrame, tokenizer_path: str, ranks_path: str | None = None, word_pattern: str | None = None,
         id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """One row per piece: id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    spark = docs.sparkSession
    base_rows = packed(docs, id_col, text_col)
    pieces = stored(pieces_of(base_rows, tokenizer_path, ranks_path, word_pattern, capacity, end_id), "pack-pieces")
    counts = pieces.groupBy("length").count().collect()  # at most ``capacity`` rows
    demand = np.zeros(capacity + 1, np.int64)
    for r in counts:
        demand[r["length"]] = r["count"]
    plan, left = open_up(solve(demand, capacity), demand, capacity)
    table = _table(spark, slots(plan), "s_length long, lo long, hi long, per long, first_sequence long, first_offset long")
    line = np.concatenate([[0], np.cumsum(left * np.arange(len(left)))])
    rests = [(x, int(demand[x] - left[x]), int(line[x])) for x in np.flatnonzero(left)]
    rest_table = _table(spark, rests, "s_length long, lo long, place long")
    gap_table = _table(spark, gaps(plan, left, capacity), "g_lo long, g_hi long, room long, first_sequence long, first_offset long")
    # Rank of a piece among those of its length, in two levels: a hot length is spread over groups of bounded size.
    salts = max(64, int(spark.conf.get("spark.sql.shuffle.partitions")), -(-int(demand.max()) // GROUP_PIECES))
    salted = pieces.withColumn("salt", F.pmod(F.xxhash64("id", "rk", "start"), F.lit(salts)))
    before = W.partitionBy("length").orderBy("salt").rowsBetween(W.unboundedPreceding, -1)
    base = salted.groupBy("length", "salt").count().select(
        F.col("length").alias("b_length"), F.col("salt").alias("b_salt"), F.coalesce(F.sum("count").over(before), F.lit(0)).alias("base"))
    inside = W.partitionBy("length", "salt").orderBy("id", "rk", "start")
    ranked = salted.withColumn("r", F.row_number().over(inside) - 1)
    ranked = ranked.join(base, (F.col("length") == F.col("b_length")) & (F.col("salt") == F.col("b_salt")))
    ranked = ranked.withColumn("rank", F.col("r") + F.col("base"))
    ranked = stored(ranked.select("id", "rk", "start", "length", "ids_crc32", "doc_tokens", "rank"), "pack-ranked")
    # The three tables have at most about capacity * 10 rows, whatever the corpus.
    placed = ranked.join(F.broadcast(table), (F.col("length") == F.col("s_length")) & (F.col("rank") >= F.col("lo")) & (F.col("rank") < F.col("hi")))
    at = F.col("rank") - F.col("lo")
    copy = F.floor(at / F.col("per"))
    whole = placed.select(
        "id", "start", "length", "ids_crc32", "doc_tokens", (F.col("first_sequence") + copy).cast("long").alias("sequence_id"),
        (F.col("first_offset") + (at - copy * F.col("per")) * F.col("length")).cast("long").alias("offset"))
    over = ranked.join(F.broadcast(rest_table), (F.col("length") == F.col("s_length")) & (F.col("rank") >= F.col("lo")))
    over = over.select("id", "rk", "start", "length", "ids_crc32", "doc_tokens", (F.col("place") + (F.col("rank") - F.col("lo")) * F.col("length")).alias("p"))
    cut = over.join(F.broadcast(gap_table), (F.col("p") < F.col("g_hi")) & (F.col("p") + F.col("length") > F.col("g_lo")))
    first = F.expr("(greatest(p, g_lo) - g_lo) div room")
    last = F.expr("(least(p + length, g_hi) - 1 - g_lo) div room")
    cut = cut.withColumn("slot", F.explode(F.sequence(first, last)))
    cut = cut.withColumn("from", F.expr("greatest(p, g_lo + slot * room)")).withColumn("to", F.expr("least(p + length, g_lo + (slot + 1) * room)"))
    cut = stored(cut.select("id", "rk", (F.col("start") + F.col("from") - F.col("p")).alias("start"), (F.col("to") - F.col("from")).alias("length"),
                            F.when(F.col("to") - F.col("from") == F.col("length"), F.col("ids_crc32")).alias("ids_crc32"), "doc_tokens",
                            (F.col("first_sequence") + F.col("slot")).alias("sequence_id"),
                            F.expr("first_offset + from - g_lo - slot * room").alias("offset")), "pack-cuts")
    sums = cut_checksums(cut.where("ids_crc32 is null").select("id", "rk", "start", "length").distinct(), base_rows, tokenizer_path, ranks_path, word_pattern, end_id)
    same = F.col("id").eqNullSafe(F.col("k_id")) & (F.col("rk") == F.col("k_rk")) & (F.col("start") == F.col("k_start")) & (F.col("length") == F.col("k_length"))
    cut = cut.join(sums, same, "left").select("id", "start", "length", F.coalesce("ids_crc32", "k_crc32").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
    return whole.unionByName(cut).withColumnRenamed("id", id_col)


def _table(spark, rows: list[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame([tuple(map(int, r)) for r in rows], schema)


def cut_checksums(cuts: DataFrame, base: DataFrame, tokenizer_path: str, ranks_path: str | None, word_pattern: str | None, end_id: int) -> DataFrame:
    """(k_id, k_rk, k_start, k_length, k_crc32) of distinct cuts (id, rk, start, length): their documents are tokenized again."""
    end = np.asarray([end_id], "<u4").tobytes()
    by_doc = cuts.groupBy("id", "rk").agg(F.sort_array(F.collect_list(F.struct("start", "length"))).alias("cuts"))  # ranges of one text, few
    by_doc = by_doc.select(F.col("id").alias("c_id"), F.col("rk").alias("c_rk"), "cuts")
    docs = base.select(F.col("id").cast("long").alias("id"), "rk", "text")
    # Repeated rows share their ranges: one of them is enough.
    todo = docs.join(by_doc, F.col("id").eqNullSafe(F.col("c_id")) & (F.col("rk") == F.col("c_rk"))).dropDuplicates(["id", "rk"]).select("id", "rk", "text", "cuts")

    def run(batches):
        ids_of = TokenBytes(tokenizer_path, ranks_path, word_pattern)
        for b in batches:
            out: list[tuple] = []
            for i in range(b.num_rows):
                ids = ids_of(b.column(2)[i].as_py() or "") + end
                for c in b.column(3)[i].as_py():
                    part = ids[4 * c["start"]:4 * (c["start"] + c["length"])]
                    out.append((b.column(0)[i].as_py(), b.column(1)[i].as_py(), c["start"], c["length"], zlib.crc32(part)))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], pa.int64()) for k in range(5)], ["k_id", "k_rk", "k_start", "k_length", "k_crc32"])
    return stored(todo.mapInArrow(run, "k_id long, k_rk long, k_start long, k_length long, k_crc32 long"), "pack-sums")


def public_tokenizer() -> tuple[str, str, str]:
    """Vocabulary file, the same vocabulary as ranks, and its word pattern."""
    import public_tokenizers as p
    return p.path("byte_bpe_50k.json"), p.path("byte_bpe_50k.tiktoken"), p.PATTERN


def op9_packing(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return pack(docs, *public_tokenizer())
