"""Token counts by a separator scan over flat, unindexed token files.

A token file is nothing but identifiers of fixed width; an end-of-document
identifier closes each document.  Files are read by byte ranges, block by
block.  Blocks are searched one by one, vectorised and without knowing where
documents begin; a two-level prefix scan over block summaries (inside runs of
64 blocks, then over the runs) then tells each block which document it opens
in and how many of its tokens came before.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lakeloom.llm import bpe, common

#: Tokens of a block, blocks of a run, blocks that one range reads, and tasks that ranges are dealt to at most.
BLOCK, RUN, RANGE, TASKS = 1 << 15, 64, 64, 50_000


def _uri(file: str) -> str:
    """A path of Spark's as pyarrow spells it."""
    return "file:///" + file[5:].lstrip("/") if file.startswith("file:") else f"file://{file}" if file.startswith("/") else file.replace("s3a://", "s3://", 1)


def _by_range(path: str) -> bool:
    from pyarrow import fs

    try:
        fs.FileSystem.from_uri(_uri(path))
        return True
    except (pa.ArrowException, OSError, ValueError):  # no such scheme there, or no library for it
        return False


def read_token_files(spark: SparkSession, path: str, dtype: str = "<u2") -> DataFrame:
    """Flat binary token files below a path (or a glob), as blocks: file, block, body.

    Each task reads ranges of RANGE blocks, so a file may have any size.  An
    empty file is one empty block.  Ranges are read through pyarrow's file
    systems (local, hdfs, s3, gs); a path that those do not know is read by
    Spark instead, file by file, and there a file must be under 2 GB.
    """
    width = np.dtype(dtype).itemsize
    step, span = BLOCK * width, BLOCK * width * RANGE
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    if not _by_range(path):
        starts = F.when(F.col("length") > 0, F.expr(f"sequence(0L, length - 1, {step}L)")).otherwise(F.expr("array(0L)"))
        whole = listed.select(F.col("path").alias("file"), "content", F.posexplode(starts).alias("block", "start"))
        return whole.select("file", F.col("block").cast("bigint"), F.expr(f"substring(content, cast(start + 1 as int), {step})").alias("body"))
    starts = F.when(F.col("length") > 0, F.expr(f"sequence(0L, length - 1, {span}L)")).otherwise(F.expr("array(0L)"))
    ranges = listed.select(F.col("path").alias("file"), "length", F.explode(starts).alias("start"))  # names and lengths only: no content is read

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        for batch in batches:
            for file, length, start in zip(*(batch.column(c).to_pylist() for c in ("file", "length", "start")), strict=True):
                store, name = fs.FileSystem.from_uri(_uri(file))
                with store.open_input_file(name) as f:
                    for at in range(start, max(start + 1, min(length, start + span)), step):
                        body = f.read_at(min(step, length - at), at) if length else b""
                        yield pa.RecordBatch.from_arrays([pa.array([file]), pa.array([at // step], pa.int64()), pa.array([body], pa.binary())], names=["file", "block", "body"])

    # A number of tasks, so that adaptive execution does not take the few names for little work.
    return ranges.repartition(max(1, min(TASKS, ranges.count())), "file", "start").mapInArrow(run, "file string, block bigint, body binary")


def count_tokens(blocks: DataFrame, separator: int, dtype: str = "<u2") -> DataFrame:
    """file, ordinal (0, 1, ... within the file), n_tokens, closed: one row per document.

    n_tokens leaves the separator out.  Tokens after a file's last separator
    are a last document with closed = false; a file that ends with a
    separator has none.  Two separators in a row hold an empty document.
    Null bodies and empty files have no documents.  A body that is not whole
    identifiers fails.
    """
    summary = "file string, block bigint, n bigint, n_ends bigint, last_end bigint, ends array<int>"

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, n = [], []
            for body in batch.column("body").to_pylist():
                ids = np.frombuffer(body or b"", dtype)
                n.append(len(ids))
                found.append(np.flatnonzero(ids == separator).astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [batch.column("file").cast(pa.string()), batch.column("block").cast(pa.int64()), pa.array(n, pa.int64()), pa.array([len(e) for e in found], pa.int64()), pa.array([int(e[-1]) if len(e) else None for e in found], pa.int64()), pa.array(found, pa.list_(pa.int32()))],
                names=["file", "block", "n", "n_ends", "last_end", "ends"],
            )

    found = blocks.select("file", "block", "body").mapInArrow(scan, summary).withColumn("run", F.expr(f"block div {RUN}"))
    inside = Window.partitionBy("file", "run").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    placed = found.withColumn("start", F.coalesce(F.sum("n").over(inside), F.lit(0))).withColumn("before", F.coalesce(F.sum("n_ends").over(inside), F.lit(0)))
    placed = placed.withColumn("prior", F.max(F.col("start") + F.col("last_end")).over(inside))
    runs = placed.groupBy("file", "run").agg(F.sum("n").alias("r_n"), F.sum("n_ends").alias("r_ends"), F.max(F.col("start") + F.col("last_end")).alias("r_last"))
    over = Window.partitionBy("file").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.withColumn("r_start", F.coalesce(F.sum("r_n").over(over), F.lit(0))).withColumn("r_before", F.coalesce(F.sum("r_ends").over(over), F.lit(0)))
    runs = runs.withColumn("r_prior", F.max(F.col("r_start") + F.col("r_last")).over(over))
    whole = Window.partitionBy("file")
    runs = runs.withColumn("f_n", F.sum("r_n").over(whole)).withColumn("f_ends", F.sum("r_ends").over(whole)).withColumn("f_last", F.max(F.col("r_start") + F.col("r_last")).over(whole)).withColumn("first", F.min("run").over(whole))
    joined = placed.join(runs, ["file", "run"])
    opened = F.coalesce(F.col("r_start") + F.col("prior"), F.col("r_prior"), F.lit(-1)) - F.col("r_start") - F.col("start")  # where the open document's separator would be, from this block's first token
    each = joined.select("file", (F.col("r_before") + F.col("before")).alias("base"), opened.alias("opened"), "ends", F.posexplode("ends").alias("k", "end"))
    closed = each.select(
        "file",
        (F.col("base") + F.col("k")).alias("ordinal"),
        (F.col("end") - F.when(F.col("k") == 0, F.col("opened")).otherwise(F.expr("try_element_at(ends, k)")) - 1).alias("n_tokens"),
        F.lit(True).alias("closed"),
    )
    rest = runs.filter((F.col("run") == F.col("first")) & (F.col("f_n") - 1 > F.coalesce("f_last", F.lit(-1)))).select("file", F.col("f_ends").alias("ordinal"), (F.col("f_n") - 1 - F.coalesce("f_last", F.lit(-1))).alias("n_tokens"), F.lit(False).alias("closed"))
    return closed.unionByName(rest)


def write_token_files(docs: DataFrame, path: str, vocabulary: str | None = None, separator: int = bpe.SPECIAL_ID, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encodes texts into flat files of 16-bit identifiers below path, one for each partition; returns shard, ordinal, doc_id of every document.

    A file is its documents' identifiers, each document closed by the
    separator, and nothing else.  shard is the number in a file's name, ordinal
    a document's place in it.  docs must give the same partitions each time it
    is read, as a table does.  Null and empty texts are empty documents.
    """
    rows, codec_path = common.prepared(docs, id_col, text_col), vocabulary or bpe.default_vocabulary()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = bpe.codec(codec_path, False)
        for batch in batches:
            ids = [c.encode(t).astype("<u2").tobytes() for t in batch.column("text").cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.binary())], names=["ids"])
        c.forget()

    # A line of text is any bytes, and the line separator the identifier's two: the writer adds nothing else.
    lines = rows.mapInArrow(run, "ids binary").select(F.col("ids").cast("string").alias("value"))
    end = int(separator).to_bytes(2, "little").decode("latin-1")
    lines.write.option("maxRecordsPerFile", 0).option("lineSep", end).option("encoding", "ISO-8859-1").option("compression", "none").text(path)
    placed = rows.select("doc_id", F.monotonically_increasing_id().alias("place"))
    return placed.select(F.shiftright("place", 33).cast("int").alias("shard"), F.expr("place & 8589934591").alias("ordinal"), "doc_id")


def op1_token_counts(spark, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens of every document, counted in token files written from the table."""
    where = f"{common.shared_folder(spark)}/tokens-{uuid.uuid4().hex}"
    names = write_token_files(common.reading(spark, sf_dir, "documents"), where)
    counts = count_tokens(read_token_files(spark, where), bpe.SPECIAL_ID).withColumn("shard", F.regexp_extract("file", "/part-([0-9]+)-[^/]*$", 1).cast("int"))
    return names.join(counts, ["shard", "ordinal"]).select("doc_id", "n_tokens")
