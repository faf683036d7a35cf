"""Plumbing shared by the training-data operators.

``Exchange`` is the one distributed pattern that the corpus-wide operators
use.  Documents are dealt into small hash batches; a batch sends one compact
binary message to each hash bucket of some key space (words, grams, ...) for
which it has a key, and a bucket answers each of its batches.  A key that a
third of the corpus shares is one entry per batch, so no bucket gets rows per
occurrence, and nothing is collected or broadcast.  The number of buckets
stays the same up to 2 GB of text, so messages grow with the input; beyond,
buckets grow in number and messages get smaller, but there is never more than
one for each key of a batch.  The exchange of the documents is one shuffle
that all rounds of a plan reuse.
"""

from __future__ import annotations

import ctypes
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text in a batch, bytes of text to a bucket of the key space, and the fewest buckets.
BATCH_BYTES, BUCKET_BYTES, BUCKETS = 4 << 20, 32 << 20, 64
#: Rows of an Arrow batch of texts.
ARROW_ROWS = 512


def prepared(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: list[str] | None = None) -> DataFrame:
    """doc_id, text (null: empty) and, if asked for, other columns packed as ``carry``; so extra columns never clash.

    Whole texts go to Python in Arrow batches; a few hundred rows a batch keep workers small.
    """
    docs.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    cols = [F.col(f"`{id_col}`").cast("bigint").alias("doc_id"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text")]
    if carry:
        cols.append(F.struct(*[F.col(f"`{c}`") for c in carry]).alias("carry"))
    return docs.select(*cols)


def remainder(n: int, id_col: str = "doc_id") -> Column:
    """crc32 of the id's text, modulo n (null id: of the empty text)."""
    return F.pmod(F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")), F.lit(n))


def text_bytes(docs: DataFrame, text_col: str = "text") -> int:
    """UTF-8 bytes of all texts: one scan of one column; sizes batches and buckets."""
    return int(docs.agg(F.sum(F.octet_length(F.col(f"`{text_col}`"))).alias("b")).first()["b"] or 0)


def sizes(total: int) -> tuple[int, int]:
    """Number of batches and of buckets for so many bytes of text; both grow with the input."""
    return max(24, math.ceil(total / BATCH_BYTES)), max(BUCKETS, math.ceil(total / BUCKET_BYTES))


def reading(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def texts_of(table: pa.Table, column: str = "text") -> list[bytes]:
    return table.column(column).cast(pa.binary()).to_pylist()


def concatenated(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """All bytes as one array, and the offsets at which the texts begin and end."""
    offsets = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) for t in texts], out=offsets[1:])
    return np.frombuffer(b"".join(texts), np.uint8), offsets


def packed(*arrays: np.ndarray) -> bytes:
    """Arrays one after the other, their lengths in bytes first; compressed, as messages are most of what is shuffled."""
    head = np.array([len(arrays), *[a.nbytes for a in arrays]], np.int64)
    return zstandard.compress(b"".join([head.tobytes(), *[np.ascontiguousarray(a).tobytes() for a in arrays]]), 1)


def unpacked(body: bytes, *kinds) -> list[np.ndarray]:
    body = zstandard.decompress(body)
    n = int(np.frombuffer(body, np.int64, 1)[0])
    lengths, at, out = np.frombuffer(body, np.int64, n, 8), 8 * (n + 1), []
    for length, kind in zip(lengths, kinds, strict=True):
        kind = np.dtype(kind)
        out.append(np.frombuffer(body, kind, int(length) // kind.itemsize, at))
        at += int(length)
    return out


def _trimmer():
    try:
        return ctypes.CDLL("libc.so.6").malloc_trim
    except (OSError, AttributeError):  # another C library: nothing to trim
        return lambda pad: 0


def release() -> None:
    """Gives freed memory back to the system: workers live on through stages and share their executor's limit."""
    pa.default_memory_pool().release_unused()
    _trimmer()(0)


MESSAGE = "bucket int, batch int, body binary"
REPLY = "batch int, bucket int, round int, body binary"
#: As a bucket: what a batch keeps for its own later rounds.  As a batch: what a bucket says of itself.
STATE = SUMMARY = -1


def split_by(bucket: np.ndarray, buckets: int) -> Iterator[tuple[int, np.ndarray]]:
    """Each bucket that has rows, and which; rows keep their order."""
    order = np.argsort(bucket, kind="stable")
    ends = np.searchsorted(bucket[order], np.arange(buckets + 1))
    for b in np.flatnonzero(ends[1:] > ends[:-1]).tolist():
        yield b, order[ends[b] : ends[b + 1]]


def _ordered(table: pa.Table) -> pa.Table:
    """Equal order whenever a batch is read: by id, then text."""
    return table.sort_by([("doc_id", "ascending"), ("text", "ascending")]).combine_chunks()


def _by_round(table: pa.Table) -> dict[int, dict[int, bytes]]:
    out: dict[int, dict[int, bytes]] = {}
    for b, r, body in zip(table["bucket"].to_pylist(), table["round"].to_pylist(), table["body"].to_pylist(), strict=True):
        out.setdefault(r, {})[b] = body
    return out


class Exchange:
    """Rounds of messages between batches of documents (from ``prepared``) and buckets of a key space.

    Repeated rows of one id and text are dealt by the partition they come
    from, so no batch holds more of them than one input partition.
    """

    def __init__(self, docs: DataFrame, batches: int):
        self.keyed = docs.withColumn("batch", F.pmod(F.xxhash64("doc_id", "text", F.spark_partition_id()), F.lit(batches)).cast("int"))

    def round(self, number: int, emit: Callable, answer: Callable, replies: DataFrame | None = None) -> DataFrame:
        """REPLY rows of a round.

        emit(table, replies) -> {bucket: bytes}, where replies[r][bucket] are
        those of earlier rounds; it must depend on nothing but its arguments.
        What it gives for STATE comes back as replies[number][STATE].
        answer(batch ids, bodies) -> bodies, in the same order, and perhaps
        one more: the row of SUMMARY.
        """
        said = pa.schema([("bucket", pa.int32()), ("batch", pa.int32()), ("body", pa.binary())])
        told = pa.schema([("batch", pa.int32()), ("bucket", pa.int32()), ("round", pa.int32()), ("body", pa.binary())])

        def message(table: pa.Table, got: dict) -> pa.Table:
            batch, out = table["batch"][0].as_py(), emit(_ordered(table), got)
            release()
            return pa.table([[b if b != STATE else -1 - batch for b in out], [batch] * len(out), list(out.values())], schema=said)

        def first(table):
            return message(table, {})

        def later(table, got):
            return message(table, _by_round(got)) if table.num_rows else said.empty_table()

        def answered(table):
            ids, bucket, bodies = table["batch"].to_pylist(), table["bucket"][0].as_py(), table["body"].to_pylist()
            if bucket >= 0:
                bodies = answer(ids, bodies)
                release()
            n = len(bodies)
            return pa.table([(ids + [SUMMARY])[:n], [max(bucket, STATE)] * n, [number] * n, bodies], schema=told)

        sent = self.keyed.groupBy("batch").applyInArrow(first, MESSAGE) if replies is None else self.keyed.groupBy("batch").cogroup(replies.groupBy("batch")).applyInArrow(later, MESSAGE)
        return sent.groupBy("bucket").applyInArrow(answered, REPLY)

    def finish(self, finish: Callable, schema, replies: DataFrame) -> DataFrame:
        """finish(table, replies) -> pa.Table of ``schema``, for every batch."""
        from pyspark.sql.pandas.types import to_arrow_schema
        from pyspark.sql.types import StructType, _parse_datatype_string

        kind = schema if isinstance(schema, StructType) else _parse_datatype_string(schema)
        target = to_arrow_schema(kind)

        def last(table, got):
            if not table.num_rows:
                return target.empty_table()
            out = finish(_ordered(table), _by_round(got)).cast(target)
            release()
            return out

        return self.keyed.groupBy("batch").cogroup(replies.groupBy("batch")).applyInArrow(last, kind)


def msd_groups(digits: list[np.ndarray]) -> np.ndarray:
    """Labels: two rows have one label if and only if all their digits agree.

    A most-significant-digit pass per array; after each pass only rows that
    still share a group are sorted further, so unequal rows leave early.
    """
    n = len(digits[0])
    label = np.zeros(n, np.int64)
    alive, used = np.arange(n), 1
    for digit in digits:
        if len(alive) < 2:
            break
        value, group = digit[alive], label[alive]
        order = np.lexsort((value, group))
        value, group = value[order], group[order]
        new = np.empty(len(order), bool)
        new[0] = True
        np.not_equal(value[1:], value[:-1], out=new[1:])
        new[1:] |= group[1:] != group[:-1]
        mine = np.cumsum(new) - 1
        label[alive[order]] = mine + used
        used += int(mine[-1]) + 1
        size = np.bincount(mine)
        alive = alive[order[size[mine] > 1]]
    return label


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir; set here only where it is unset, as in tests."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        import tempfile

        if not _OWN:
            _OWN.append("file://" + tempfile.mkdtemp(prefix="lakeloom-"))
        folder = _OWN[0]
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


_OWN: list[str] = []


_WRITTEN: list[str] = []


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder: cuts its lineage, and survives lost executors."""
    import uuid

    where = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(where)
    _WRITTEN.append(where)
    return df.sparkSession.read.schema(df.schema).parquet(where)


def kept_only(spark: SparkSession, since: int, result: DataFrame | None = None) -> int:
    """Deletes what ``written`` left since there were ``since`` tables, but the newest if it holds ``result``; how many there are now.

    Only for when nothing is to be read from the others any more.
    """
    keep = _WRITTEN[-1:] if result is not None else []
    for where in _WRITTEN[since : len(_WRITTEN) - len(keep)]:
        path = spark._jvm.org.apache.hadoop.fs.Path(where)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    _WRITTEN[since:] = keep
    return len(_WRITTEN)


#: Links of a part of a graph.
PART_ROWS = 100_000


def components(links: DataFrame, rounds: int = 40) -> DataFrame:
    """node, root: the least node that links (a, b: bigint) reach, for every node that has a link.

    Alternating large and small stars; a hub's links are dealt by a join that
    Spark can split, never gathered.  Each round is checkpointed, in parts of
    about PART_ROWS links, so few links are few files.
    """
    shared_folder(links.sparkSession)
    parted = lambda df, n: df.coalesce(n // PART_ROWS + 1)
    edges = links.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct().checkpoint()

    def mark(df):
        return df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()

    before = mark(edges)
    for _ in range(rounds):
        edges = parted(edges, before[0])
        both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        big = both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = big.groupBy("u").agg(F.min("v").alias("m"))
        small = big.join(low, "u")
        edges = small.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(low.select("u", F.col("m").alias("v"))).distinct().checkpoint()
        after = mark(edges)
        if after == before:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionAll(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        before = after
    raise RuntimeError("components did not settle")


def word_codes(texts: list[bytes], lower: bool = False) -> tuple[np.ndarray, pa.BinaryArray, np.ndarray]:
    """Words (runs without ASCII white space) of all texts as codes, the distinct words by code, and words per text."""
    data, off = concatenated([b"".join(texts).lower()] if lower else texts)
    if lower:  # of bytes: A-Z alone
        off = np.concatenate([[0], np.cumsum([len(t) for t in texts], dtype=np.int64)])
    word = (data != 32) & (data - np.uint8(9) > 4)
    begins, closes = word.copy(), word.copy()
    begins[1:] &= ~word[:-1]
    closes[:-1] &= ~word[1:]
    some = np.diff(off) > 0  # no word crosses texts
    begins[off[:-1][some]], closes[off[1:][some] - 1] = word[off[:-1][some]], word[off[1:][some] - 1]
    at = np.flatnonzero(begins)
    ends = np.concatenate([[0], np.cumsum(np.flatnonzero(closes) + 1 - at)]).astype(np.int32)
    words = pa.BinaryArray.from_buffers(pa.binary(), len(at), [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(data[word].tobytes())]).dictionary_encode()
    return words.indices.to_numpy().astype(np.int64), words.dictionary, np.diff(np.searchsorted(at, off))


def listed(words: pa.BinaryArray) -> list[bytes]:
    """The values of an array without nulls, as ``to_pylist`` gives them."""
    if not len(words):
        return []
    _, ends, body = words.buffers()
    ends, body = np.frombuffer(ends, np.int32, len(words) + 1, 4 * words.offset).tolist(), body.to_pybytes()
    return [body[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]
