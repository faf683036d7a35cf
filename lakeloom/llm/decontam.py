"""Benchmark decontamination: size-partitioned MinHash containment search.

An item's signature is the bottom of its MinHash order: with n distinct
shingles of which ``need`` must be found, the n - need + 1 shingles of least
hash.  A document that holds ``need`` of them misses at most n - need, so it
holds one of the signature: the search loses no pair, however long the
document.  Items are partitioned by size (powers of two).  Each partition has
its own hash bound, the largest hash of its signatures, and its own least
``need``.  A document is searched only in the partitions whose least need its
shingles can meet, so its shingles above the bounds of all of these are never
looked up, and no candidate comes from the others.  One table serves all
lookups, as a hash is in few signatures.  Candidates are verified by exact
containment of the shingles' words.

DataFrame operations only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakeloom.llm import common

#: Bytes up to which signatures, items or candidates' names are broadcast; beyond, Spark shuffles.
BROADCAST_BYTES = 64 << 20


def _words(text: str) -> Column:
    return F.filter(F.split(F.lower(F.coalesce(F.col(text), F.lit(""))), "[ \\t-\\r]+"), lambda w: w != "")


def _starts(k: int) -> Column:
    return F.when(F.size("w") >= k, F.sequence(F.lit(1), F.size("w") - (k - 1))).otherwise(F.expr("cast(array() as array<int>)"))


def _hashes(k: int) -> Column:
    return F.transform(_starts(k), lambda i: F.xxhash64(*[F.element_at("w", i + j) for j in range(k)]))


def _shingles(k: int) -> Column:
    return F.array_distinct(F.transform(_starts(k), lambda i: F.array_join(F.slice("w", i, k), " ")))


def _sized(df: DataFrame, size: int) -> DataFrame:
    return F.broadcast(df) if size <= BROADCAST_BYTES else df


def contained(docs: DataFrame, items: DataFrame, shingle: int = 5, threshold: float = 0.8, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", by_text: bool = False) -> DataFrame:
    """doc_id, item_id, n_shared, n_shingles: the pairs of which a document holds at least the share ``threshold`` of an item's distinct shingles.

    Words are runs without ASCII white space, lower-cased.  Items of fewer
    words than a shingle have no shingles and are never found; neither are
    null texts.  Documents of any length are searched whole.  Repeated
    documents give one row per id and item; where rows of one id, or of one
    item, have several texts, the pair with the largest share counts.  A null
    doc_id is an id like any other; a null item_id too.  With ``by_text`` rows
    are told apart by id and text, and ``copy`` is the text's hash.  An empty
    table of either kind gives an empty result.
    """
    one = items.select(F.col(f"`{item_col}`").alias("item_id"), _words(f"`{item_text}`").alias("w")).select("item_id", _shingles(shingle).alias("s"), F.array_distinct(_hashes(shingle)).alias("h")).filter(F.size("s") > 0).distinct()
    one = common.written(one.withColumn("n", F.size("s")).withColumn("need", F.ceil(F.round(F.col("n") * threshold, 6)).cast("int")).withColumn("part", F.floor(F.log2("n")).cast("int")).withColumn("item", F.xxhash64("item_id", "s")), "items")
    signature = one.select("item", "part", "need", F.explode(F.slice(F.array_sort("h"), 1, F.col("n") - F.col("need") + 1)).alias("hash"))
    parts = signature.groupBy("part").agg(F.max("hash").alias("bound"), F.min("need").alias("least"), F.count("*").alias("n")).collect()  # one row per power of two
    size = (one.agg(F.sum(F.octet_length(F.array_join("s", " ")) + 100).alias("b")).first()["b"] or 0) if parts else 0
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text")).withColumn("copy", F.xxhash64("text"))
    own = [F.when(F.col("k") >= r["least"], F.lit(r["bound"]).cast("bigint")) for r in parts]  # of each partition, for documents that may hold its items
    bound = F.greatest(*own, F.lit(None).cast("bigint"), F.lit(None).cast("bigint"))
    sized = rows.select("doc_id", "copy", _words("text").alias("w")).withColumn("k", F.size("w") - shingle + 1).withColumn("bound", bound)
    probes = sized.select("doc_id", "copy", "k", F.explode(F.filter(_hashes(shingle), lambda h: h <= F.col("bound"))).alias("hash"))
    least = signature.join(_sized(signature.groupBy("part").agg(F.min("need").alias("least")), 16 * len(parts)), "part").select("item", "least", "hash")
    found = common.written(probes.join(_sized(least, 32 * sum(r["n"] for r in parts)), "hash").filter("k >= least").select("doc_id", "copy", "item").distinct(), "candidates")
    names = found.select(F.col("doc_id").alias("d"), F.col("copy").alias("c")).distinct()
    sized = _sized(names, 40 * names.count())
    texts = rows.join(sized, rows["doc_id"].eqNullSafe(F.col("d")) & (rows["copy"] == F.col("c")), "left_semi")
    texts = texts.select("doc_id", "copy", _words("text").alias("w")).select(F.col("doc_id").alias("d"), F.col("copy").alias("c"), _shingles(shingle).alias("t"))
    pairs = found.join(texts, found["doc_id"].eqNullSafe(F.col("d")) & (found["copy"] == F.col("c"))).join(_sized(one.select("item", "item_id", "s", "n", "need"), size), "item")
    checked = pairs.select("doc_id", "copy", "item_id", F.size(F.array_intersect("s", "t")).alias("n_shared"), F.col("n").alias("n_shingles"), "need").filter("n_shared >= need")
    key = ["doc_id", "copy", "item_id"] if by_text else ["doc_id", "item_id"]
    best = checked.groupBy(*key).agg(F.max(F.struct((F.col("n_shared") / F.col("n_shingles")).alias("share"), "n_shared", "n_shingles")).alias("b"))
    return best.select(*key, "b.n_shared", "b.n_shingles")


def op6_decontamination(spark, sf_dir: str) -> DataFrame:
    return contained(common.reading(spark, sf_dir, "documents"), common.reading(spark, sf_dir, "benchmark"))


ORACLE = r"""
WITH d AS (SELECT DISTINCT doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[ \t-\r]+'), lambda x: x <> '') AS w FROM documents),
b AS (SELECT DISTINCT item_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[ \t-\r]+'), lambda x: x <> '') AS w FROM benchmark),
ds AS (SELECT DISTINCT doc_id, array_to_string(w[i : i + 4], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM d WHERE len(w) >= 5)),
bs AS (SELECT DISTINCT item_id, array_to_string(w[i : i + 4], ' ') AS s FROM (SELECT item_id, w, unnest(range(1, len(w) - 3)) AS i FROM b WHERE len(w) >= 5)),
n AS (SELECT item_id, count(*) AS n FROM bs GROUP BY item_id)
SELECT doc_id, item_id, CAST(count(*) AS INTEGER) AS n_shared, CAST(any_value(n) AS INTEGER) AS n_shingles
FROM ds JOIN bs USING (s) JOIN n USING (item_id)
GROUP BY doc_id, item_id HAVING 10 * count(*) >= 8 * any_value(n)
"""
