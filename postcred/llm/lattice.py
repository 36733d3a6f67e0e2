"""Language-model scores: marginal likelihood over all segmentations of a subword lattice.

The vocabulary is an existing one: its pieces, and its scores as the prior weights (a piece of rank r weighs
1 / (r + 2)).  The training texts' word counts re-weight the pieces by expected counts over all segmentations
(one forward-backward pass over the distinct words), smoothed by the prior.  A word's probability is the sum over
every way to write it with pieces, by a forward recursion in log space; pieces never cross words, so a
text's probability is the product over its words and one end.  Any character can also be written in
byte pieces, so no text has probability zero.

Work is done once per distinct word, then looked up per text: texts are dealt into chunks of bounded size, each chunk
asks for its distinct words, and the answers come back to the chunk.  A word in every text thus costs one row per
chunk, not one per occurrence.

Defined results: a null text has only its end; rows without an id are training rows; without training rows
the prior alone scores and every count is zero.  Repeated rows count and are scored each.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postcred.llm.common import ascii_lower, stored

MARK = "▁"
CHUNK_BYTES = 16 << 20
_NONE = object()


class Pieces:
    """Log weights of pieces, with every prefix of a piece as a key, so that a search can stop early."""

    def __init__(self, names: list[str], byte_at: dict[int, int], log_p: np.ndarray):
        self.names, self.byte_at, self.log_p = names, byte_at, log_p
        self.find: dict[str, int | None] = {}
        single = set(byte_at.values())
        self.raw: dict[str, tuple[tuple, float]] = {}
        self.long = max([1, *(len(x) for i, x in enumerate(names) if i and i not in single)])
        by_size: dict[int, list[int]] = {}
        for i, name in enumerate(names):
            if i in single or i == 0:
                continue
            by_size.setdefault(len(name), []).append(i)
            for k in range(1, len(name)):
                self.find.setdefault(name[:k], None)
            self.find[name] = i
        hashes = np.concatenate([_from_start(_codes([names[i] for i in at]))[:, -1] for at in by_size.values()])
        order = np.argsort(hashes)
        self.hash, self.number = hashes[order], np.concatenate([np.asarray(at) for at in by_size.values()])[order]

    def as_bytes(self, char: str) -> tuple[tuple, float]:
        """Byte pieces of a character and their log weight."""
        if char not in self.raw:
            raw = tuple(self.byte_at[b] for b in char.encode())
            self.raw[char] = raw, float(sum(self.log_p[b] for b in raw))
        return self.raw[char]

    def arcs(self, word: str) -> list[list[tuple[int, tuple, float]]]:
        """For each position, the (end, piece numbers, log weight) that start there."""
        s, find, lp = MARK + word, self.find, self.log_p
        n, out = len(s), []
        for i in range(n):
            here = []
            for j in range(i + 1, n + 1):
                at = find.get(s[i:j], _NONE)
                if at is _NONE:
                    break
                if at is not None:
                    here.append((j, (at,), lp[at]))
            here.append((i + 1, *self.as_bytes(s[i])))
            out.append(here)
        return out

    def forward(self, arcs) -> list[float]:
        exp, log1p = math.exp, math.log1p
        a = [-math.inf] * (len(arcs) + 1)
        a[0] = 0.0
        for i, here in enumerate(arcs):
            base = a[i]
            for j, _, w in here:
                x, y = base + w, a[j]
                if y == -math.inf:
                    a[j] = x
                elif x > y:
                    a[j] = x + log1p(exp(y - x))
                else:
                    a[j] = y + log1p(exp(x - y))
        return a

    def log_marginal(self, word: str) -> float:
        return self.forward(self.arcs(word))[-1]

    def expect(self, word: str, count: float, into: list[float]) -> None:
        """Adds ``count`` times the expected uses of each piece."""
        arcs = self.arcs(word)
        a, n = self.forward(arcs), len(arcs)
        b, total, exp = [0.0] * (n + 1), a[n], math.exp
        b[n] = 1.0  # of the paths through a position, relative to the marginal
        for i in range(n - 1, -1, -1):
            share, base = 0.0, a[i]
            for j, used, w in arcs[i]:
                p = b[j] * exp(base + w - a[j])
                share += p
                for at in used:
                    into[at] += count * p
            b[i] = share


    # ---- many words of one length at once
    def _tables(self, words: list[str]):
        """Piece number (or -1) of every span, log weight of every character in bytes, and the characters."""
        codes = _codes([MARK + w for w in words])
        n, at = codes.shape[1], {}
        for i in range(n):
            h = _from_start(codes[:, i:i + self.long])
            for j in range(i + 1, min(n, i + self.long) + 1):
                k = h[:, j - i - 1]
                pos = np.minimum(np.searchsorted(self.hash, k), len(self.hash) - 1)
                hit = np.flatnonzero(self.hash[pos] == k)
                if len(hit):
                    at[i, j] = hit, self.number[pos[hit]]
        chars, inverse = np.unique(codes, return_inverse=True)
        raw = [self.as_bytes(chr(c)) for c in chars]
        return at, np.array([r[1] for r in raw])[inverse.reshape(codes.shape)], raw, inverse.reshape(codes.shape)

    def _forward(self, at, in_bytes) -> np.ndarray:
        m, n = in_bytes.shape
        a = np.full((m, n + 1), -np.inf)
        a[:, 0] = 0
        lp = np.asarray(self.log_p)
        for i in range(n):
            for j in range(i + 1, min(n, i + self.long) + 1):
                if (i, j) in at:
                    hit, number = at[i, j]
                    a[hit, j] = np.logaddexp(a[hit, j], a[hit, i] + lp[number])
            a[:, i + 1] = np.logaddexp(a[:, i + 1], a[:, i] + in_bytes[:, i])
        return a

    def log_marginals(self, words: list[str]) -> np.ndarray:
        out = np.empty(len(words))
        for rows, part in _by_length(words):
            if part is None:
                out[rows] = [self.log_marginal(words[r]) for r in rows]
            else:
                at, in_bytes, _, _ = self._tables(part)
                out[rows] = self._forward(at, in_bytes)[:, -1]
        return out

    def expect_all(self, words: list[str], counts: np.ndarray, into: np.ndarray) -> None:
        """``expect`` for many words."""
        for rows, part in _by_length(words):
            if part is None:
                for r in rows:
                    self.expect(words[r], float(counts[r]), into)
                continue
            at, in_bytes, raw, char = self._tables(part)
            a, lp = self._forward(at, in_bytes), np.asarray(self.log_p)
            m, n = in_bytes.shape
            weight, total = np.log(counts[rows].astype(float)), a[:, -1]
            b = np.full((m, n + 1), -np.inf)
            b[:, n] = 0
            for i in range(n - 1, -1, -1):
                b[:, i] = in_bytes[:, i] + b[:, i + 1]
                used = np.exp(a[:, i] + b[:, i] - total + weight)
                for c, u in zip(*(lambda x: (x[0], np.bincount(x[1], weights=used)))(np.unique(char[:, i], return_inverse=True))):
                    for piece in raw[c][0]:
                        into[piece] += u
                for j in range(i + 1, min(n, i + self.long) + 1):
                    if (i, j) in at:
                        hit, number = at[i, j]
                        step = lp[number] + b[hit, j]
                        np.add.at(into, number, np.exp(a[hit, i] + step - total[hit] + weight[hit]))
                        b[hit, i] = np.logaddexp(b[hit, i], step)


def _codes(words: list[str]) -> np.ndarray:
    """Code points of words of one length, a row each."""
    return np.frombuffer("".join(words).encode("utf-32-le"), "<u4").reshape(len(words), -1).astype(np.uint64)


_STEP = np.uint64(0x9E3779B97F4A7C15)


def _from_start(codes: np.ndarray) -> np.ndarray:
    """[word, length - 1]: hash of every span from the first character, by Horner's rule."""
    out = np.empty(codes.shape, np.uint64)
    h = np.zeros(len(codes), np.uint64)
    for k in range(codes.shape[1]):
        h = (h ^ (h >> np.uint64(29))) * _STEP + codes[:, k] + np.uint64(1)
        out[:, k] = h
    return out


def _by_length(words: list[str], least: int = 24, longest: int = 48):
    """(row numbers, words of one length), or None for words that are long or few of their length."""
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    for n in np.unique(lengths):
        rows = np.flatnonzero(lengths == n)
        if len(rows) < least or n > longest:
            yield rows, None
        else:
            for lo in range(0, len(rows), 2048):
                part = rows[lo:lo + 2048]
                yield part, [words[r] for r in part]


def prior(model_path: str) -> Pieces:
    """Pieces and prior log weights of a sentencepiece vocabulary; number 0 is the end of a text."""
    from sentencepiece import SentencePieceProcessor
    m = SentencePieceProcessor(model_file=model_path)
    names, rank, byte_at = ["</s>"], [0.0], {}
    size = m.get_piece_size()
    for i in range(size):
        name, score = m.id_to_piece(i), m.get_score(i)
        if m.is_byte(i):
            byte_at[int(name[1:-1], 16)] = len(names)
            names.append(name)
            rank.append(float(size))
        elif not (m.is_control(i) or m.is_unknown(i) or m.is_unused(i)) and score > -1e8:
            names.append(name)
            rank.append(-score)
    weight = 1.0 / (np.asarray(rank) + 2.0)
    return Pieces(names, byte_at, np.log(weight / weight.sum()))


def words_of(text: Column) -> Column:
    """A-Z lowered runs of characters other than blank and control white space."""
    return F.array_remove(F.split(ascii_lower(text), r"[\x20\x09-\x0D]+"), "")


def word_counts(rows: DataFrame) -> DataFrame:
    """(word, c): training occurrences of each distinct word of ``rows`` (text, held_out); 0 if only held out."""
    words = rows.select("held_out", F.explode(words_of(F.col("text"))).alias("word"))
    return words.groupBy("word").agg(F.sum(F.when(F.col("held_out"), 0).otherwise(1)).cast("long").alias("c"))


def refit(pieces: Pieces, counts: DataFrame, n_ends: int, prior_mass: float) -> Pieces:
    """One expectation-maximisation step on the word counts; what is gathered is one number per piece and task."""
    spark = counts.sparkSession
    shared = spark.sparkContext.broadcast((pieces.names, pieces.byte_at, pieces.log_p))

    def run(batches):
        p = Pieces(*shared.value[:2], shared.value[2].tolist())
        got = np.zeros(len(p.names))
        for b in batches:
            p.expect_all(b.column(0).to_pylist(), b.column(1).to_numpy(), got)
        at = np.flatnonzero(got)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(got[at])], ["piece", "uses"])
    uses = counts.where("c > 0").select("word", "c").mapInArrow(run, "piece long, uses double")
    total = np.exp(pieces.log_p) * prior_mass
    for r in uses.groupBy("piece").agg(F.sum("uses").alias("uses")).collect():  # as many rows as the vocabulary has pieces
        total[r["piece"]] += r["uses"]
    total[0] += n_ends
    return Pieces(pieces.names, pieces.byte_at, np.log(total / total.sum()))


def word_scores(pieces: Pieces, counts: DataFrame) -> DataFrame:
    """(word, c, log10 marginal)."""
    shared = counts.sparkSession.sparkContext.broadcast((pieces.names, pieces.byte_at, pieces.log_p))

    def run(batches):
        p = Pieces(*shared.value[:2], shared.value[2].tolist())
        for b in batches:
            s = p.log_marginals(b.column(0).to_pylist()) / math.log(10)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(s)], ["word", "c", "score"])
    return counts.select("word", "c").mapInArrow(run, "word string, c long, score double")


def _tokens(text) -> list[bytes]:
    return (text.as_py() or "").encode().lower().split()


def score_texts(docs: DataFrame, model_path: str, held_out: Column, id_col: str = "doc_id", text_col: str = "text",
                prior_mass: float = 32_000.0, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """One row per row: id, held_out, n_tokens, n_known, train_tokens, base_score, score (log10)."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(held_out, F.lit(False)).alias("held_out"),
                       F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    counts = stored(word_counts(rows), "lm-counts")
    size = rows.agg(F.sum(F.octet_length("text")).alias("bytes"), F.sum(F.when(F.col("held_out"), 0).otherwise(1)).alias("ends")).first()
    seen = counts.where("c > 0").agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("v")).first()
    n_ends = size["ends"] or 0
    n, v = (seen["n"] or 0) + n_ends, seen["v"] + (n_ends > 0)
    pieces = refit(prior(model_path), counts, n_ends, prior_mass)
    scores = stored(word_scores(pieces, counts), "lm-words")
    end_score, floor, end_base = pieces.log_p[0] / math.log(10), math.log10(n + v + 1), math.log10(n_ends + 1)

    chunks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-(size["bytes"] or 0) // chunk_bytes))
    dealt = rows.withColumn("chunk", F.pmod(F.xxhash64("id", "text"), F.lit(chunks))).repartition(chunks, "chunk")

    def distinct_words(batches):
        found: dict[int, set] = {}
        for b in batches:
            for c, t in zip(b.column(3).to_pylist(), b.column(2)):
                found.setdefault(c, set()).update(_tokens(t))
        for c, words in found.items():
            words = list(words)
            for lo in range(0, len(words), 50_000):
                part = pa.array(words[lo:lo + 50_000], pa.binary()).cast(pa.string())
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part), c, np.int64)), part], ["chunk", "word"])
    asked = dealt.mapInArrow(distinct_words, "chunk long, word string").join(scores, "word").select("chunk", "word", "c", "score")

    def per_text(texts: pa.Table, words: pa.Table) -> pa.Table:
        c = np.append(words.column("c").to_numpy(), 0)
        values = np.stack([np.log10(c + 1.0), c > 0, np.append(words.column("score").to_numpy(), 0.0)], axis=1)
        at = {w: i for i, w in enumerate(words.column("word").cast(pa.binary()).to_pylist())}
        out = []
        for t in texts.column("text"):
            tokens = _tokens(t)
            got = values[np.fromiter(map(at.__getitem__, tokens), np.int64, len(tokens))].sum(axis=0)
            out.append((len(tokens) + 1, int(got[1]) + (n_ends > 0), got[0] + end_base - (len(tokens) + 1) * floor, got[2] + end_score))
        cols = list(zip(*out)) if out else [[]] * 4
        return pa.table({"id": texts.column("id"), "held_out": texts.column("held_out"), "n_tokens": pa.array(cols[0], pa.int64()),
                         "n_known": pa.array(cols[1], pa.int64()), "train_tokens": pa.array([n] * texts.num_rows, pa.int64()),
                         "base_score": pa.array(cols[2], pa.float64()), "score": pa.array(cols[3], pa.float64())})
    out = dealt.groupBy("chunk").cogroup(asked.groupBy("chunk")).applyInArrow(
        per_text, "id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
    return out.withColumnRenamed("id", id_col)


def public_vocabulary() -> str:
    import public_tokenizers as p
    return p.path("piece_bpe_32k.model")


def op8_lm_scoring(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    held_out = F.crc32(F.col("doc_id").cast("string")) % 7 == 2
    return score_texts(docs, public_vocabulary(), held_out)
