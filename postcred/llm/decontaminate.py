"""Benchmark decontamination: size-partitioned MinHash containment search, DataFrame functions only.

An item with n distinct shingles is contained at share t when at least ``need = ceil(t n)`` of them are in the
document.  Then at least one of its ``n - need + 1`` smallest shingle hashes is in it, so this bottom-k MinHash
sketch, whose size follows from the item's size class, finds every contained item: the search loses none.
Items are partitioned by shingle count; an item only meets documents with at least ``need``
shingles.  Each candidate pair is then verified on the shingle strings.

Words are runs of letters, marks and digits, lower-cased; five of them are a shingle.  An item of fewer words
is one shingle of that length; an item without words matches nothing.  Null texts are empty.  Repeated rows
of a document are judged each; repeated items give equal rows only once per id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from postcred.llm.common import packed, stored, unpacked

WORDS, SIMILARITY = 5, 0.8


def words_of(col: Column) -> Column:
    return F.array_remove(F.split(F.lower(col), r"[^\p{L}\p{M}\p{N}]+"), "")


def _positions(n: Column, size: Column | int) -> Column:
    """0 .. n - size, empty if there are fewer words."""
    return F.when(n >= size, F.sequence(F.lit(0), n - size)).otherwise(F.array().cast("array<int>"))


def _grams(words: str, size: int, hashed: bool) -> Column:
    """Shingles of ``size`` words, as 64-bit hashes or as strings; ``words`` must be a column, not an expression."""
    def at(i, k):
        return F.get(F.col(words), i + k)

    def one(i):
        parts = [at(i, k) for k in range(size)]
        return F.xxhash64(*parts) if hashed else F.concat_ws(" ", *parts)
    return F.transform(_positions(F.size(words), size), one)


def item_shingles(items: DataFrame, id_col: str, text_col: str, words: int) -> DataFrame:
    """(item_id, size, grams, n): distinct shingle strings of each item, stored."""
    base = items.select(F.col(id_col).alias("item_id"), words_of(F.coalesce(F.col(text_col), F.lit(""))).alias("w"))
    base = base.where(F.size("w") > 0).withColumn("size", F.least(F.size("w"), F.lit(words)))
    made = F.lit(None).cast("array<string>")
    for size in range(1, words + 1):
        made = F.when(F.col("size") == size, F.array_distinct(_grams("w", size, False))).otherwise(made)
    return stored(base.select("item_id", "size", made.alias("grams")).distinct().withColumn("n", F.size("grams")), "decon-items")


def contained_items(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    item_id_col: str = "item_id", item_text_col: str = "text", words: int = WORDS,
                    similarity: float = SIMILARITY) -> DataFrame:
    """(id, rk, item_id, n_shared, n_item, containment) of every pair at or above ``similarity``."""
    sets = item_shingles(items, item_id_col, item_text_col, words)
    need = F.ceil(F.col("n") * similarity - 1e-9).cast("int")
    ranked = (sets.withColumn("need", need).withColumn("size_class", F.floor(F.log2("n")).cast("int"))
              .select("item_id", "size", "size_class", "n", "need", "grams", F.posexplode("grams").alias("p", "g")))
    hashed = F.lit(None).cast("long")
    parts = F.split("g", " ")
    for size in range(1, words + 1):
        hashed = F.when(F.col("size") == size, F.xxhash64(*[F.get(F.col("gw"), F.lit(k)) for k in range(size)])).otherwise(hashed)
    ranked = ranked.withColumn("gw", parts).withColumn("h", hashed)
    order = W.partitionBy("item_id", "grams").orderBy("h", "p")
    probes = ranked.withColumn("r", F.row_number().over(order)).where(F.col("r") <= F.col("n") - F.col("need") + 1)
    probes = stored(probes.select("h", "size", "size_class", "item_id", "need"), "decon-probes")
    sizes = sorted(r[0] for r in probes.select("size").distinct().collect())  # at most ``words`` values

    base = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    base = base.select("id", F.xxhash64("text").alias("rk"), "text")
    split = base.select("id", "rk", words_of(F.col("text")).alias("w"))
    found = None
    for size in sizes:
        mine = probes.where(F.col("size") == size)
        rows = split.select("id", "rk", (F.size("w") - (size - 1)).alias("n_doc"), F.explode(_grams("w", size, True)).alias("h"))
        hits = rows.join(mine, "h").where(F.col("n_doc") >= F.col("need")).select("id", "rk", "item_id", "size")
        found = hits if found is None else found.unionByName(hits)
    if found is None:
        found = split.select("id", "rk", F.lit(None).cast(sets.schema["item_id"].dataType).alias("item_id"), F.lit(0).alias("size")).limit(0)
    found = stored(found.distinct(), "decon-candidates")

    who = found.select("id", "rk", "size").distinct().select(F.col("id").alias("c_id"), F.col("rk").alias("c_rk"), "size")
    texts = base.join(who, F.col("id").eqNullSafe(F.col("c_id")) & (F.col("rk") == F.col("c_rk")))
    texts = texts.select("id", "rk", "size", words_of(F.col("text")).alias("w")).dropDuplicates(["id", "rk", "size"])
    grams = F.lit(None).cast("array<string>")
    for size in sizes:
        grams = F.when(F.col("size") == size, F.array_distinct(_grams("w", size, False))).otherwise(grams)
    texts = stored(texts.select("id", "rk", "size", grams.alias("doc_grams")), "decon-texts")
    pairs = found.select(F.col("id").alias("c_id"), F.col("rk").alias("c_rk"), "item_id", F.col("size").alias("c_size"))
    pairs = pairs.join(texts, F.col("id").eqNullSafe(F.col("c_id")) & (F.col("rk") == F.col("c_rk")) & (F.col("size") == F.col("c_size")))
    pairs = pairs.select("id", "rk", "item_id", "doc_grams").join(sets.drop("size"), "item_id")
    shared = pairs.select("id", "rk", "item_id", F.size(F.array_intersect("grams", "doc_grams")).cast("long").alias("n_shared"),
                          F.col("n").cast("long").alias("n_item"))
    return (shared.where(F.col("n_shared") >= F.col("n_item") * similarity - 1e-9).distinct()
            .withColumn("containment", F.col("n_shared") / F.col("n_item")))


def drop_contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` without the rows that hold an item."""
    hit = contained_items(docs, items, id_col, text_col, **options).select(F.col("id").alias("h_id"), F.col("rk").alias("h_rk")).distinct()
    base = packed(docs, id_col, text_col)
    kept = base.join(hit, F.col("id").eqNullSafe(F.col("h_id")) & (F.col("rk") == F.col("h_rk")), "left_anti")
    return unpacked(kept, docs.columns)


def op4_decontaminate(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text")
    return contained_items(docs, items).select(F.col("id").alias("doc_id"), "item_id", "n_shared", "n_item", "containment")


OP4_SQL = r"""
WITH w AS (
  SELECT 'd' AS side, doc_id AS id, list_filter(string_split_regex(lower(coalesce(text, '')), '[^\p{L}\p{M}\p{N}]+'), lambda x: x <> '') AS w FROM documents
  UNION ALL
  SELECT 'i', item_id, list_filter(string_split_regex(lower(coalesce(text, '')), '[^\p{L}\p{M}\p{N}]+'), lambda x: x <> '') FROM benchmark),
items AS (SELECT id, w, least(len(w), 5) AS size FROM w WHERE side = 'i' AND len(w) > 0),
sizes AS (SELECT DISTINCT size FROM items),
ig AS (SELECT DISTINCT id AS item_id, size, array_to_string(w[i:i + size - 1], ' ') AS g
       FROM (SELECT id, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM items)),
dg AS (SELECT DISTINCT id AS doc_id, size, array_to_string(w[i:i + size - 1], ' ') AS g
       FROM (SELECT id, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM w, sizes WHERE side = 'd' AND len(w) >= size)),
n AS (SELECT item_id, count(*) AS n_item FROM ig GROUP BY item_id)
SELECT doc_id, item_id, count(*) AS n_shared, any_value(n_item) AS n_item, count(*) / any_value(n_item) AS containment
FROM ig JOIN dg USING (size, g) JOIN n USING (item_id)
GROUP BY doc_id, item_id HAVING count(*) >= 0.8 * any_value(n_item) - 1e-9
"""
