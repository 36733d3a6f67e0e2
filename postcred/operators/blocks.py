"""Words looked up in tables of any size, block by block.

Joining every word of every post to a large table moves (and sorts) one row with the post's key per word.  Here the posts are dealt into
blocks of a bounded size instead: only the distinct tokens of each block meet the table, and the values found go back to the block, where
every token is looked up in Arrow.  Before anything moves, each post's tokens become the numbers that they have among the distinct tokens of
their chunk (the posts of a block in one batch of a task); the most frequent ones have the shortest numbers.  So what moves is these numbers once and one row per
chunk and token, never a text, whatever the size of the table; nothing of either passes the driver, which sees the summed length of the texts only.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from postcred.session import scratch_dir

#: Bytes of words in a block (about); a post is never cut.  The larger a block, the fewer times a token is sent and joined in all.
BLOCK_BYTES = 32 << 20


def written(df: DataFrame, name: str) -> DataFrame:
    """The frame as a table in the shared scratch folder: computed once, short lineage."""
    path = scratch_dir(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@dataclass
class Found:
    """The tokens of a block: the group (post) and the place of each, and the table's values (0 where it has none)."""
    groups: int
    group: np.ndarray
    place: np.ndarray
    values: dict[str, np.ndarray]
    repeated: bool  # some posts have more than one row

    def per_group(self, name: str) -> np.ndarray:
        return sums(self.values[name], self.group, self.groups)


def sums(values: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    """Sum of the values by place; whole numbers stay exact."""
    out = np.zeros(n, values.dtype)
    np.add.at(out, at, values)
    return out


def block_of(key: Sequence[str], parts: int, blocks: int) -> Column:
    """Block of a post.  Posts of one bucket of ``parts`` (see ``plans.pipeline.land_posts``) share their blocks, so a task that reads a
    bucket has all of a block's tokens and sends each of them once."""
    coarse = F.pmod(F.hash(*key), F.lit(parts)).cast("long")
    each = math.ceil(blocks / parts)
    return coarse % F.lit(max(1, blocks)) if each <= 1 else coarse * F.lit(each) + F.pmod(F.xxhash64(*key), F.lit(each))


def _cut(column: pa.ChunkedArray | pa.Array) -> tuple[pa.Array, np.ndarray]:
    """(tokens, how many each row has): the elements of lists, or what is left of a text cut at white space."""
    text = not (pa.types.is_list(column.type) or pa.types.is_large_list(column.type))
    lists = pc.utf8_split_whitespace(column) if text else column  # the same characters as functions.text.WHITESPACE_CHARS
    lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
    sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    words = lists.flatten()
    if text:
        real = pc.not_equal(words, "")
        mask = real.to_numpy(zero_copy_only=False)
        if not mask.all():
            words, sizes = words.filter(real), _between(mask, sizes)
    return words, sizes


def _between(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Sums of the whole numbers of each row, whose values follow each other."""
    ends = np.concatenate([[0], np.cumsum(sizes)])
    return np.diff(np.concatenate([[0], np.cumsum(values, dtype=np.int64)])[ends])


def _distinct(batches):
    """(_at, _word): the distinct tokens of every block in a batch."""
    for b in batches:
        blocks = b.column(0).to_numpy()
        for at in np.unique(blocks):
            words = pc.drop_null(pc.unique(_cut(b.column(1).filter(pa.array(blocks == at)))[0]))
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(words), at), pa.int64()), words], ["_at", "_word"])


def distinct_tokens(df: DataFrame, words: Column) -> DataFrame:
    """``_word``: the distinct tokens of texts or token arrays, cut and made distinct in Arrow before any of them moves."""
    return df.select(F.lit(0).cast("long").alias("_at"), words.alias("_words")).mapInArrow(_distinct, "_at long, _word string").select("_word").distinct()


def _distinct_of_each(batches):
    """(_word, _in): the distinct tokens of a batch's columns, bit i of ``_in`` set if column i has the token."""
    for b in batches:
        columns = [pc.drop_null(pc.unique(_cut(c)[0])) for c in b.columns]
        words = pc.unique(pa.concat_arrays(columns))
        held = np.zeros(len(words), np.int32)
        for i, c in enumerate(columns):
            held |= pc.is_in(words, value_set=c).to_numpy(zero_copy_only=False).astype(np.int32) << i
        yield pa.RecordBatch.from_arrays([words, pa.array(held)], ["_word", "_in"])


def distinct_tokens_of_each(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``(_word, _in)``: the distinct tokens of several columns in one pass; bit i of ``_in`` is set if column i has the token."""
    return df.select(*columns).mapInArrow(_distinct_of_each, "_word string, _in int").groupBy("_word").agg(F.bit_or("_in").alias("_in"))


def packed(numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, bytes of each) of numbers of 0 to 2^28 - 1: seven bits a byte, lowest first; all but a number's last byte have the top bit."""
    x = numbers.astype(np.uint32, copy=False)
    size = np.ones(len(x), np.uint8)
    for k in range(1, 4):
        size += x >= 1 << (7 * k)
    start = np.cumsum(size, dtype=np.int64) - size
    data = np.empty(int(start[-1]) + int(size[-1]) if len(x) else 0, np.uint8)
    for k in range(4):
        more = slice(None) if k == 0 else np.flatnonzero(size > k)
        data[start[more] + k] = (x[more] >> np.uint32(7 * k)) & np.uint32(127) | (size[more] > k + 1).astype(np.uint32) << np.uint32(7)
    return data, size


def unpacked(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(numbers, end of each) of bytes from ``packed``."""
    end = np.flatnonzero(data < 128) + 1
    start = np.concatenate([[0], end[:-1]]).astype(np.int64) if len(end) else end
    out = np.zeros(len(end), np.int64)
    for k in range(4):
        more = np.flatnonzero(end - start > k)
        out[more] |= (data[start[more] + k].astype(np.int64) & 127) << (7 * k)
    return out, end


#: Columns beside the group's in the rows of posts and tokens.
_OWN = {"_at": pa.int64(), "_chunk": pa.int64(), "_row": pa.int32(), "_size": pa.int64(), "_codes": pa.binary(), "_code": pa.int32(), "_word": pa.string()}
_OWN_TYPES = "_at long, _chunk long, _row int, _size long, _codes binary, _code int, _word string"


def _coded_chunk(names: Sequence[str], part: pa.RecordBatch, at: int, chunk: int, whole: bool):
    """Rows of the chunk's posts and of its tokens: a post has its place in the chunk, its tokens' numbers and their bytes, a token its number
    and itself.  If the chunk is a ``whole`` block, its first post has the numbers of all, compressed.  Null tokens have the number behind the last one."""
    words, lengths = _cut(part.column(part.schema.get_field_index("_words")))
    coded = words.dictionary_encode()
    n, rows = len(coded.dictionary), part.num_rows
    codes = pc.fill_null(coded.indices, n).to_numpy(zero_copy_only=False)
    often = np.argsort(-np.bincount(codes, minlength=n)[:n], kind="stable")
    number = np.full(n + 1, n, np.uint32)
    number[often] = np.arange(n, dtype=np.uint32)
    data, size = packed(number[codes])
    sizes = _between(size, lengths)
    if whole:
        numbers = pa.array([pa.compress(data.tobytes(), "zstd", asbytes=True)] + [None] * (rows - 1), pa.binary())
    else:
        offsets = np.concatenate([[0], np.cumsum(sizes)])
        numbers = pa.Array.from_buffers(pa.large_binary(), rows, [None, pa.py_buffer(offsets), pa.py_buffer(data)]).cast(pa.binary())
    of = lambda k: {"_at": pa.array(np.full(k, at), pa.int64()), "_chunk": pa.array(np.full(k, chunk), pa.int64())}
    yield _row_batch(names, rows, part, {**of(rows), "_row": pa.array(np.arange(rows, dtype=np.int32)), "_size": pa.array(sizes), "_codes": numbers})
    yield _row_batch(names, n, part, {**of(n), "_code": pa.array(np.arange(n, dtype=np.int32)), "_word": coded.dictionary.take(pa.array(often)).cast(pa.string())}, nulls=True)


def _coded(names: Sequence[str]):
    """Rows of posts and tokens (see ``_coded_chunk``); a chunk is what a batch has of a block."""
    def run(batches):
        chunk = TaskContext.get().partitionId() << 32
        for b in batches:
            blocks = b.column(b.schema.get_field_index("_at")).to_numpy()
            for at in np.unique(blocks):
                yield from _coded_chunk(names, b.filter(pa.array(blocks == at)), int(at), chunk, False)
                chunk += 1
    return run


def _coded_whole(names: Sequence[str], block_bytes: int):
    """Rows of posts and tokens (see ``_coded_chunk``); a chunk is a block: the next posts of a task, of about ``block_bytes`` in all."""
    def run(batches):
        chunk = TaskContext.get().partitionId() << 32
        held, size = [], 0
        for b in batches:
            column = b.column(b.schema.get_field_index("_words"))
            text = not (pa.types.is_list(column.type) or pa.types.is_large_list(column.type))
            sizes = pc.fill_null(pc.binary_length(column) if text else pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            ends, lo = np.cumsum(sizes if text else sizes * 8), 0
            while lo < b.num_rows:
                before = int(ends[lo - 1]) if lo else 0
                hi = int(np.searchsorted(ends, before + block_bytes - size, side="right"))
                hi = hi if held else max(lo + 1, hi)
                if hi > lo:
                    held.append(b.slice(lo, hi - lo))
                    size += int(ends[hi - 1]) - before
                    lo = hi
                if lo < b.num_rows:
                    yield from _coded_chunk(names, _one(held), chunk, chunk, True)
                    held, size, chunk = [], 0, chunk + 1
        if held:
            yield from _coded_chunk(names, _one(held), chunk, chunk, True)
    return run


def _one(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
    return pa.Table.from_batches(batches).combine_chunks().to_batches()[0]


def _row_batch(names: Sequence[str], n: int, part: pa.RecordBatch, own: dict, nulls: bool = False) -> pa.RecordBatch:
    columns = [pa.nulls(n, part.schema.field(c).type) if nulls else part.column(part.schema.get_field_index(c)) for c in names]
    return pa.RecordBatch.from_arrays([*columns, *[own[c] if c in own else pa.nulls(n, t) for c, t in _OWN.items()]], [*names, *_OWN])


def _block(group: Sequence[str], values: Sequence[str], compute: Callable[[Found], dict], whole: bool):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        names: dict[tuple, int] = {}
        rows = np.array([names.setdefault(k, len(names)) for k in zip(*[left.column(c).to_pylist() for c in group])], np.int64)
        first = np.unique(rows, return_index=True)[1]
        of, nth, size_of, numbers = left.column("_chunk").to_numpy(), left.column("_row").to_numpy(), left.column("_size").to_numpy(), left.column("_codes")
        by = np.argsort(right.column("_chunk").to_numpy(), kind="stable")
        there, code = right.column("_chunk").to_numpy()[by], right.column("_code").to_numpy()[by]
        table = {v: right.column(v).to_numpy()[by] for v in values}
        groups, places, held = [], [], {v: [] for v in values}
        for chunk in np.unique(of):
            at = np.flatnonzero(of == chunk)
            at = at[np.argsort(nth[at])]
            ends = np.cumsum(size_of[at])
            mine = numbers.take(pa.array(at[:1] if whole else at)).to_pylist()
            data = b"".join(mine) if not whole else pa.decompress(mine[0], int(ends[-1]), "zstd", asbytes=True) if ends[-1] else b""
            codes, end = unpacked(np.frombuffer(data, np.uint8))
            size = np.diff(np.searchsorted(end, ends, side="right"), prepend=0)
            lo, hi = np.searchsorted(there, [chunk, chunk + 1])
            for v in values:
                found = np.zeros(1 + max(int(codes.max(initial=0)), int(code[lo:hi].max(initial=0))), table[v].dtype)
                found[code[lo:hi]] = table[v][lo:hi]
                held[v].append(found[codes])
            groups.append(np.repeat(rows[at], size))
            places.append(np.arange(len(codes)) - np.repeat(np.cumsum(size) - size, size))
        out = compute(Found(len(names), _joined(groups, np.int64), _joined(places, np.int64),
                            {v: _joined(x, table[v].dtype) for v, x in held.items()}, len(names) < len(rows)))
        return pa.table({**{c: left.column(c).take(pa.array(first)) for c in group}, **{c: pa.array(v) for c, v in out.items()}})
    return run


def _joined(parts: list[np.ndarray], kind) -> np.ndarray:
    return np.concatenate(parts) if parts else np.empty(0, kind)


def look_up(posts: DataFrame, group: Sequence[str], key: Sequence[str], words: Column, table: Callable[[DataFrame], DataFrame],
            compute: Callable[[Found], dict], out: str, landed: bool = False, unique: bool = False) -> DataFrame:
    """``(group..., out...)``: one row per distinct ``group``, computed from its tokens and the values of each.

    ``words`` is text, cut at white space, or an array of tokens.  ``table`` makes of the distinct tokens (``_word``) the ones that have values:
    ``_word``, each once, and numbers without nulls (words that no post has do no harm); what it costs grows with the distinct tokens only.
    ``group`` begins with ``key``.
    The posts are read twice; they are written first unless they are ``landed`` (a table, and ``words`` a column of it).
    ``unique``: no two posts have the same ``group``.  Then any posts can share a block: they are read once, and a block is what follows each
    other in a task, so it sends each of its tokens once however many blocks there are.
    """
    rows = posts.select(*group, words.alias("_words"))
    kept = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in group)
    if unique:
        dealt, run = rows, _coded_whole(tuple(group), BLOCK_BYTES)
    else:
        rows = rows if landed else written(rows, "lookup-rows")
        size = F.octet_length("_words") if isinstance(rows.schema["_words"].dataType, T.StringType) else F.size("_words") * F.lit(8)
        n_bytes = rows.agg(F.coalesce(F.sum(size.cast("long")), F.lit(0))).first()[0]
        parts = int(posts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        dealt, run = rows.withColumn("_at", block_of(key, parts, max(1, math.ceil(n_bytes / BLOCK_BYTES)))), _coded(tuple(group))
    coded = written(dealt.mapInArrow(run, f"{kept}, {_OWN_TYPES}"), "lookup-terms")
    terms = coded.where(F.col("_code").isNotNull() & F.col("_word").isNotNull()).select(*([] if unique else ["_at"]), "_chunk", "_code", "_word")
    values = table(terms.select("_word").distinct())
    names = [c for c in values.columns if c != "_word"]
    found = terms.join(values, "_word").drop("_word")
    numbered = coded.where(F.col("_row").isNotNull()).select(*group, F.col("_at").alias("_block"), F.col("_chunk").alias("_chunk"), "_row", "_size", "_codes")
    at = "_chunk" if unique else "_at"
    return numbered.groupBy("_block").cogroup(found.groupBy(at)).applyInArrow(_block(tuple(group), names, compute, unique), f"{kept}, {out}")
