"""Secret scans with an incremental blob ledger.

Every text version is content-addressed by SHA-256.  The ledger says which rules, in which version,
have scanned which blob and what they found; each span carries the version that found it.  A run scans only the (blob, rule version)
pairs the ledger lacks, one text per blob, appends what it found, and joins the findings back to every path (document) of the
blob.  A new rule version or a new text thus costs only its own scan, spans of a version that is no longer current do not count, and
those of one that comes back count again without a scan.

One row stands for each blob.  Rows are chosen by id and blob alone; the texts of the chosen ones are reached by leaving out the others
where those are fewer, so a first run over mostly different texts moves no text.

Spans are in code points, end exclusive.  Defined results: a null text is an empty one without findings;
repeated rows, also with equal or null ids, give repeated result rows; an empty table gives no rows.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postcred.llm.common import count_rows, sent, stored
from postcred.session import scratch_dir

#: Base rules: (kind, version, pattern, group whose length counts, least length, texts it can match in contain one of).
ASSIGN = r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
BASE = ("assign", "access", "hex")
RULES = (
    ("assign", 1, re.compile(ASSIGN, re.A | re.I), 1, 8, ("passw", "secret", "token", "api")),
    ("access", 1, re.compile(r"AKIA[A-Z0-9]+"), 0, 16, ("AKIA",)),
    ("hex", 1, re.compile(r"[0-9a-f]{32,}"), 0, 32, ()),
    ("private_key", 1, re.compile(r"-----BEGIN [A-Z ]*PRIVATE KEY-----"), 0, 0, ("PRIVATE KEY",)),
    ("web_token", 1, re.compile(r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"), 0, 0, ("eyJ",)),
    ("forge_token", 1, re.compile(r"gh[pousr]_[A-Za-z0-9]{36,}"), 0, 0, ("gh",)),
    ("chat_token", 1, re.compile(r"xox[abprs]-[A-Za-z0-9-]{10,}"), 0, 0, ("xox",)),
    ("url_login", 1, re.compile(r"[a-z][a-z0-9+.-]{1,20}://[^\s/:@]{1,64}:[^\s/@]{3,64}@"), 0, 0, ("://",)),
)
SPANS = "array<struct<kind:string,start:long,end:long>>"
LEDGER = "blob string, rules array<string>, spans array<struct<kind:string,version:int,start:long,end:long>>"


def scan(text: str, todo, rules=RULES) -> list[tuple[str, int, int]]:
    """Spans of the rules whose kind is in ``todo``, by start, then kind as listed."""
    low, out = text.lower(), []
    for k, (kind, _, pattern, group, least, marks) in enumerate(rules):
        if kind not in todo or (marks and not any(m in (low if m.islower() else text) for m in marks)):
            continue
        for m in pattern.finditer(text):
            if m.end(group) - m.start(group) >= least:
                out.append((m.start(), k, m.end()))
    return [(rules[k][0], s, e) for s, k, e in sorted(out)]


def rule_names(rules=RULES) -> list[str]:
    return [f"{r[0]}@{r[1]}" for r in rules]


def unseen(rows: DataFrame, ledger: DataFrame | None, rules: list[str]) -> DataFrame:
    """(blob, text, todo): one text of each blob that some rule version has not scanned, with those rules; ``rows`` is (id, blob, text)."""
    every = F.array(*[F.lit(r) for r in rules])
    # A row's name: its id and blob; rows that share both are equal.
    names = rows.groupBy("id", "blob").agg(F.count(F.lit(1)).alias("n"))
    first = names.groupBy("blob").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id")).alias("first"), F.max("n").alias("most"),
                                      F.count(F.lit(1)).alias("n_names"))
    if ledger is None:
        first = first.withColumn("todo", every)
    else:
        done = ledger.groupBy(F.col("blob").alias("l_blob")).agg(F.array_distinct(F.flatten(F.collect_list("rules"))).alias("done"))
        first = first.join(done, F.col("blob") == F.col("l_blob"), "left").withColumn(
            "todo", F.array_except(every, F.coalesce("done", F.array().cast("array<string>"))))
    first = stored(first.select("blob", F.col("first.id").alias("id"), "most", "n_names", "todo"), "secret-blobs")
    plain = (F.size("todo") == len(rules)) & (F.col("most") == 1) & (F.col("n_names") == 1)  # one row, nothing scanned yet
    rest = stored(first.where(~plain).select(F.col("blob").alias("r_blob"), F.col("id").alias("r_id"), "todo"), "secret-shared")
    n_plain, n_rest = count_rows(first.where(plain)), count_rows(rest)
    if n_plain >= n_rest:
        alone = rows.join(sent(rest.select("r_blob")), F.col("blob") == F.col("r_blob"), "left_anti").select("blob", "text", every.alias("todo"))
    else:
        alone = rows.join(sent(first.where(plain).select(F.col("blob").alias("p_blob"))), F.col("blob") == F.col("p_blob"), "left_semi").select("blob", "text", every.alias("todo"))
    chosen = sent(rest.where(F.size("todo") > 0))
    shared = (rows.join(chosen, (F.col("blob") == F.col("r_blob")) & F.col("id").eqNullSafe(F.col("r_id")))
              .groupBy("blob").agg(F.first("text").alias("text"), F.first("todo").alias("todo")))
    return alone.unionByName(shared)


def scan_blobs(todo: DataFrame, rules=RULES) -> DataFrame:
    """Ledger rows (blob, rules, spans) of the pairs in ``todo``."""
    span = pa.list_(pa.struct([("kind", pa.string()), ("version", pa.int32()), ("start", pa.int64()), ("end", pa.int64())]))
    version = {r[0]: r[1] for r in rules}

    def run(batches):
        for b in batches:
            wanted = b.column(2).to_pylist()
            spans = [[{"kind": k, "version": version[k], "start": s, "end": e} for k, s, e in scan(t.as_py() or "", {r.split("@")[0] for r in rs}, rules)]
                     for t, rs in zip(b.column(1), wanted)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(spans, span)], ["blob", "rules", "spans"])
    return todo.select("blob", "text", "todo").mapInArrow(run, LEDGER)


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", ledger_path: str | None = None,
                 rules=RULES) -> DataFrame:
    """(id_col, blob, spans) for each row, spans as ``array<struct<kind,start,end>>`` in order.

    ``ledger_path`` names a ledger to use and extend; without it a new one is made in the shared folder.
    """
    spark = docs.sparkSession
    names = rule_names(rules)
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), F.sha2(text.cast("binary"), 256).alias("blob"), text.alias("text"))
    old = None
    if ledger_path is not None:
        fs_path = spark._jvm.org.apache.hadoop.fs.Path(ledger_path)
        if fs_path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(fs_path):
            old = spark.read.schema(LEDGER).parquet(ledger_path)
    path = ledger_path or scratch_dir(spark, "llm-ledger")
    scan_blobs(unseen(rows, old, names), rules).write.mode("append").parquet(path)
    ledger = spark.read.schema(LEDGER).parquet(path)
    found = ledger.where(F.size("spans") > 0).select("blob", F.explode("spans").alias("s"))
    found = found.where(F.concat("s.kind", F.lit("@"), "s.version").isin(names)).select("blob", "s").distinct()
    rank = F.array_position(F.array(*[F.lit(r[0]) for r in rules]), F.col("s.kind"))
    found = found.groupBy("blob").agg(F.sort_array(F.collect_list(F.struct(F.col("s.start").alias("start"), rank.alias("r"),
                                                                           F.col("s.kind").alias("kind"), F.col("s.end").alias("end")))).alias("spans"))
    found = stored(found.select(F.col("blob").alias("f_blob"), F.transform("spans", lambda s: F.struct(
        s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"))).alias("spans")), "secret-findings")
    out = rows.select("id", "blob").join(found, F.col("blob") == F.col("f_blob"), "left")
    return out.select(F.col("id").alias(id_col), "blob", F.coalesce("spans", F.array().cast(SPANS)).alias("spans"))


def span_text(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def _count(kind: str) -> Column:
    return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")


def op7_secret_scans(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = find_secrets(docs)
    base = F.filter("spans", lambda s: s["kind"].isin(*BASE))
    counts = [_count(k).alias(f"n_{k}") for k in BASE]
    return found.select("doc_id", *counts, F.sha2(span_text(base).cast("binary"), 256).alias("base_sha256"),
                        span_text(F.col("spans")).alias("spans"))
