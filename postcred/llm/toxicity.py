"""Toxicity: a convolutional text classifier trained in numpy.

Words (runs of letters and digits, A-Z lowered) are hashed into an embedding table, whole and by their first bytes;
the embeddings of a word's hashes are summed, so inflected forms share a part.  Filters of several widths slide over
the text, each keeps its largest response anywhere in the whole text, and a logistic layer scores the
responses.  Training (Adam, full gradients through the max) runs on the driver over a bounded sample of labelled rows:
the ``per_class`` rows of each class with the smallest hash among texts of at most ``max_words`` words.  One
embedding dimension starts from the smoothed class log-odds of its bucket in that sample.  A held-back quarter
of the sample calibrates the score (logistic scaling).  One threshold per language decides ``flagged``: the best F1 over the scores of
all labels that may be learned from (the sample's among them), counted on Spark by language, hundredth of the score and class.  A
language without both classes among them has the default.

Scoring reads whole texts on the executors, in blocks of rows: look-ups, one product with all filters and one maximum
per filter.  The score depends on the text alone; ``lang`` only chooses the
threshold of ``flagged``.

Defined results: null and wordless texts get the score of an empty text; rows without an id are never training rows;
labels that are null are skipped; without both classes among the training labels the score is their smoothed rate.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postcred.llm.common import row_blocks, runs, span_hashes, stored, utf8

BUCKETS, DIM, WIDTHS, FILTERS, PREFIXES = 1 << 16, 8, (1, 2, 3), 8, (4, 6)
THRESHOLD = 0.3
_WORD = np.zeros(256, bool)
_WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def word_buckets(data: np.ndarray, offs: np.ndarray, buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray]:
    """[word, hash] buckets of a block of texts (1 .. buckets; 0 is padding), and the first word of each text."""
    cuts, data = offs - offs[0], _LOWER[data[offs[0]:offs[-1]]]
    s, e = runs(_WORD[data], cuts)
    ids = np.empty((len(s), 1 + len(PREFIXES)), np.int32)
    for k, n in enumerate((None, *PREFIXES)):
        h = span_hashes(data, s, e if n is None else np.minimum(e, s + n))
        ids[:, k] = ((h + np.uint64(k)) % np.uint64(buckets)).astype(np.int32) + 1
    return ids, np.searchsorted(s, cuts)


class TextCnn:
    """Parameters and the forward pass."""

    def __init__(self, emb, filters, bias, out, out_bias, scale=(1.0, 0.0)):
        self.emb, self.filters, self.bias, self.out, self.out_bias, self.scale = emb, filters, bias, out, out_bias, scale
        self.all = np.concatenate([f[k] for f in filters for k in range(len(f))], axis=1)  # every filter column by word offset

    def pooled(self, ids: np.ndarray, first: np.ndarray) -> np.ndarray:
        """[text, filter]: largest response of each filter; every text is padded, so none is empty."""
        pad, n, size = len(self.filters), len(first) - 1, np.diff(first)
        if not n:
            return np.empty((0, len(self.out)), np.float32)
        rows = np.zeros((len(ids) + pad * (n + 1), self.all.shape[1]), np.float32)
        rows[np.arange(len(ids)) + np.repeat(pad * np.arange(n), size)] = sum(self.emb[ids[:, k]] for k in range(ids.shape[1])) @ self.all
        # Windows begin at a text's own words (at its padding if it has none), so none reaches into the next text.
        at, cols, c = first[:-1] + pad * np.arange(n), [], 0
        borders = np.stack([at, at + np.maximum(size, 1)], axis=1).ravel()
        for f, b in zip(self.filters, self.bias):
            w, wide = len(f), f.shape[2]
            m = len(rows) - w + 1
            r = sum(rows[k:k + m, c + k * wide:c + (k + 1) * wide] for k in range(w))
            c += w * wide
            cols.append(np.maximum(np.maximum.reduceat(r, borders, axis=0)[::2] + b, 0))
        return np.concatenate(cols, axis=1)

    def logits(self, ids, first) -> np.ndarray:
        return self.pooled(ids, first) @ self.out + self.out_bias

    def scores(self, ids, first) -> np.ndarray:
        return sigmoid(self.scale[0] * self.logits(ids, first).astype(float) + self.scale[1])


def sigmoid(z):
    return 0.5 * (1 + np.tanh(z / 2))


def train(texts: list[np.ndarray], labels: np.ndarray, epochs: int = 12, batch: int = 64, rate: float = 0.01, decay: float = 1e-4,
          seed: int = 7, buckets: int = BUCKETS) -> TextCnn:
    """Fit on bucket arrays of whole texts."""
    rng = np.random.default_rng(seed)
    seen = np.zeros((2, buckets + 1))
    for t, y in zip(texts, labels):
        seen[int(y), np.unique(t)] += 1
    n = np.bincount(labels.astype(int), minlength=2)
    odds = np.log((seen[1] + 0.5) / (n[1] + 1)) - np.log((seen[0] + 0.5) / (n[0] + 1))
    odds *= seen.sum(axis=0) / (seen.sum(axis=0) + 4)  # a bucket of few texts says little
    emb = rng.normal(0, 0.02, (buckets + 1, DIM)).astype(np.float32)
    emb[:, 0] = odds / 3
    emb[0] = 0
    filters = [rng.normal(0, 0.2, (w, DIM, FILTERS)).astype(np.float32) for w in WIDTHS]
    for f in filters:
        f[:, 0, :] = np.abs(f[:, 0, :]) + 0.3
    p = {"emb": emb, "bias": np.full((len(WIDTHS), FILTERS), -0.5, np.float32), "out": rng.normal(0, 0.1, len(WIDTHS) * FILTERS).astype(np.float32) + 0.1,
         "out_bias": np.zeros(1, np.float32), **{f"f{i}": f for i, f in enumerate(filters)}}
    mean, var = {k: np.zeros_like(v) for k, v in p.items()}, {k: np.zeros_like(v) for k, v in p.items()}
    step = 0
    for _ in range(epochs):
        order = rng.permutation(len(texts))
        for lo in range(0, len(order), batch):
            rows = order[lo:lo + batch]
            pad = len(WIDTHS)
            gap = np.zeros((pad, 1 + len(PREFIXES)), np.int32)
            ids = np.concatenate([np.concatenate([texts[r], gap]) for r in rows] + [gap])
            at = np.concatenate([[0], np.cumsum([len(texts[r]) + pad for r in rows])[:-1]])
            ends = at + np.array([max(1, len(texts[r])) for r in rows])
            grad = {k: np.zeros_like(v) for k, v in p.items()}
            pools, where = [], []
            for i, w in enumerate(WIDTHS):
                m = len(ids) - w + 1
                x = sum(p["emb"][ids[:, k]] for k in range(ids.shape[1]))
                r = sum(x[k:k + m] @ p[f"f{i}"][k] for k in range(w)) + p["bias"][i]
                best = np.stack([a + r[a:b].argmax(axis=0) for a, b in zip(at, ends)])
                where.append(best)
                pools.append(np.maximum(np.take_along_axis(r, best, axis=0), 0))
            h = np.concatenate(pools, axis=1)
            y = labels[rows].astype(np.float32)
            delta = (sigmoid(h @ p["out"] + p["out_bias"][0]) - y) / len(rows)
            grad["out"] = h.T @ delta + decay * p["out"]
            grad["out_bias"] = np.array([delta.sum()], np.float32)
            for i, w in enumerate(WIDTHS):
                out = p["out"][i * FILTERS:(i + 1) * FILTERS]
                d = delta[:, None] * out * (pools[i] > 0)
                grad["bias"][i] = d.sum(axis=0)
                for k in range(w):
                    x = p["emb"][ids[where[i] + k]].sum(axis=2)
                    grad[f"f{i}"][k] = np.einsum("bf,bfd->df", d, x) + decay * p[f"f{i}"][k]
                    part = d[:, :, None] * p[f"f{i}"][k].T[None]
                    for j in range(ids.shape[1]):
                        np.add.at(grad["emb"], ids[where[i] + k, j], part)
            grad["emb"][0] = 0
            step += 1
            for k in p:
                mean[k] += 0.1 * (grad[k] - mean[k])
                var[k] += 0.001 * (grad[k] ** 2 - var[k])
                p[k] -= rate * (mean[k] / (1 - 0.9 ** step)) / (np.sqrt(var[k] / (1 - 0.999 ** step)) + 1e-8)
    return TextCnn(p["emb"], [p[f"f{i}"] for i in range(len(WIDTHS))], list(p["bias"]), p["out"], float(p["out_bias"][0]))


def calibrate(logits: np.ndarray, labels: np.ndarray, weights: np.ndarray, steps: int = 200) -> tuple[float, float]:
    """Logistic scaling (slope, shift) by Newton steps, drawn a little towards slope 1."""
    a, b = 1.0, 0.0
    for _ in range(steps):
        q = sigmoid(a * logits + b)
        g = np.array([(weights * (q - labels) * logits).sum() + 0.1 * (a - 1), (weights * (q - labels)).sum() + 0.01 * b])
        w = weights * q * (1 - q)
        hess = np.array([[(w * logits ** 2).sum() + 0.1, (w * logits).sum()], [(w * logits).sum(), w.sum() + 0.01]])
        move = np.linalg.solve(hess, g)
        a, b = a - np.clip(move[0], -1, 1), b - np.clip(move[1], -1, 1)
        if np.abs(move).max() < 1e-6:
            break
    return float(max(a, 0.05)), float(b)


def language_thresholds(counts, default: float = THRESHOLD) -> dict[str, int]:
    """The best-F1 threshold, in hundredths, of each language with both classes among (lang, hundredth, toxic, n) rows."""
    table: dict[str, np.ndarray] = {}
    for lang, step, y, n in counts:
        table.setdefault(lang, np.zeros((2, 101), np.int64))[int(y), step] += n
    out = {}
    for lang, bins in table.items():
        if not bins.sum(axis=1).all():
            continue
        above = bins[:, ::-1].cumsum(axis=1)[:, ::-1]  # rows of each class at or over a threshold
        f1 = 2 * above[1] / (above.sum(axis=0) + bins[1].sum())
        start = round(100 * default)
        out[lang] = max(range(101), key=lambda k: (f1[k], -abs(k - start), k))  # among equals the one nearest to the default
    return out


def allowed_labels(labels: DataFrame, trains: Column) -> DataFrame:
    """(l_id, toxic): one row per document whose label may be learned from."""
    marked = labels.where(F.col("toxic").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    return marked.where(F.col("doc_id").isNotNull() & trains).withColumnRenamed("doc_id", "l_id")


def training_sample(docs: DataFrame, labels: DataFrame, trains: Column, per_class: int, max_words: int) -> list:
    """(bucket array, label, class size) of the sample; at most 2 * per_class rows of at most max_words words."""
    marked = allowed_labels(labels, trains)
    n = {r["toxic"]: r["count"] for r in marked.groupBy("toxic").count().collect()}
    marked = marked.withColumn("key", F.xxhash64("l_id"))
    fit = (F.length(F.coalesce("text", F.lit(""))) <= 16 * max_words)
    docs = docs.where(fit)
    allowed = docs.select("doc_id").join(marked, F.col("doc_id") == F.col("l_id")).select("l_id", "key", "toxic")
    rows = []
    for y in sorted(n):
        # The rows are chosen without their texts, so no join moves the texts.
        chosen = {(r["l_id"], r["key"]) for r in allowed.where(F.col("toxic") == y).orderBy("key").limit(per_class).collect()}
        if not chosen:
            continue
        chosen = docs.sparkSession.createDataFrame(sorted(chosen), marked.select("l_id", "key").schema)  # at most per_class rows
        some = docs.join(F.broadcast(chosen), F.col("doc_id") == F.col("l_id")).select("key", "text").orderBy("key").limit(per_class).collect()
        for r in some:
            data, offs = utf8(pa.array([r["text"]], pa.string()))
            ids, _ = word_buckets(data, offs)
            if len(ids) <= max_words:
                rows.append((ids, int(y), n[y]))
    return rows


def fit(rows: list) -> TextCnn | float:
    """Model from sample rows; a constant if one class is missing."""
    y = np.array([r[1] for r in rows], int)
    if len(set(y.tolist())) < 2:
        return (float(y.sum()) + 0.5) / (len(y) + 1)
    held = np.zeros(len(y), bool)
    for c in (0, 1):
        held[np.flatnonzero(y == c)[::4]] = (y == c).sum() >= 8
    model = train([r[0] for r, h in zip(rows, held) if not h], y[~held])
    check = np.flatnonzero(held) if held.any() else np.arange(len(y))
    ids = np.concatenate([rows[i][0] for i in check])
    first = np.concatenate([[0], np.cumsum([len(rows[i][0]) for i in check])])
    logits = model.logits(ids, first).astype(float)
    weights = np.array([rows[i][2] / max(1, (y[check] == y[i]).sum()) for i in check])
    weights *= len(check) / weights.sum()
    model.scale = calibrate(logits, y[check], weights)
    return model


def score_toxicity(docs: DataFrame, labels: DataFrame, trains: Column, per_class: int = 1500, max_words: int = 4096) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text, lang): doc_id, score, flagged.

    ``labels`` has doc_id and toxic (0 or 1); ``trains`` says, over doc_id, which labels may be learned from.
    """
    spark = docs.sparkSession
    model = fit(training_sample(docs, labels, trains, per_class, max_words))
    shared = spark.sparkContext.broadcast(model)  # the table has a fixed size

    def run(batches):
        m = shared.value
        for b in batches:
            data, offs = utf8(b.column(2))
            for lo, hi in row_blocks(offs):
                if not isinstance(m, TextCnn):
                    s = np.full(hi - lo, m)
                else:
                    s = m.scores(*word_buckets(data, offs[lo:hi + 1]))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), b.column(1).slice(lo, hi - lo), pa.array(s, pa.float64())],
                                                 ["doc_id", "lang", "score"])
    # Stored, so each text is scored once: for the thresholds and for the result.
    scored = stored(docs.select("doc_id", "lang", "text").mapInArrow(run, "doc_id long, lang string, score double"), "toxicity-scores")
    step = F.floor(F.col("score") * 100).cast("int")
    known = scored.where(F.col("lang").isNotNull()).join(allowed_labels(labels, trains), F.col("doc_id") == F.col("l_id"))
    limits = language_thresholds(known.groupBy("lang", step, "toxic").count().collect())  # at most 202 rows per language
    limit = F.lit(round(100 * THRESHOLD))
    for lang, t in limits.items():
        limit = F.when(F.col("lang") == lang, t).otherwise(limit)
    return scored.select("doc_id", "score", (step >= limit).alias("flagged"))


def op10_toxicity(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    fold = F.crc32(F.col("doc_id").cast("string")) % 4
    out = score_toxicity(docs, labels, fold != 2)
    return out.select("doc_id", F.coalesce(fold == 2, F.lit(False)).alias("held_out"), "score",
                      F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).cast("int").alias("predicted"), "flagged")
