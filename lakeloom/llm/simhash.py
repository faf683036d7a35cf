"""SimHash near-duplicates by anchor-point covering.

Anchors are the pairs of codewords of the binary Golay code [23, 12] over bits
0-22 and 23-45 of a fingerprint.  The code is perfect with covering radius 3:
each block of a fingerprint has one codeword within 3 bits.  A fingerprint
stands as a centre at its own anchor and is replicated to every anchor within
covering radius plus threshold: where the bits beyond 3 in both blocks add up
to no more than the threshold.  If two fingerprints differ in so few bits, one
has a replica at the other's anchor, so comparing replicas with centres per
anchor finds every link; at threshold 2 that is about 61 replicas among 2^24
anchors.  Only distinct fingerprints are replicated, never their copies.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeloom.llm import common, near_copies

#: Generator polynomial of the binary Golay code, its length and covering radius.
POLY, N, RADIUS = 0b101011100011, 23, 3


def _syndromes(words: np.ndarray) -> np.ndarray:
    x = words.astype(np.int64)
    for bit in range(N - 1, 10, -1):
        x = np.where(x >> bit & 1, x ^ (POLY << (bit - 11)), x)
    return x


@functools.cache
def _cosets(most: int) -> list[np.ndarray]:
    """For each class k (k = 0: weight up to the radius, else weight radius + k): patterns by syndrome, padded with -1."""
    out = []
    for k in range(most + 1):
        weights = range(RADIUS + 1) if k == 0 else [RADIUS + k]
        patterns = np.array([sum(1 << b for b in bits) for w in weights for bits in combinations(range(N), w)], np.int64)
        s = _syndromes(patterns)
        order = np.argsort(s, kind="stable")
        s, patterns = s[order], patterns[order]
        counts = np.bincount(s, minlength=2048)
        table = np.full((2048, counts.max()), -1, np.int64)
        table[s, np.arange(len(s)) - np.repeat(np.cumsum(counts) - counts, counts)] = patterns
        out.append(table)
    return out


def replicas(prints: np.ndarray, threshold: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Index of a fingerprint, anchor, and whether the fingerprint stands there as a centre."""
    x = prints.view(np.uint64)
    a, b = (x & np.uint64(0x7FFFFF)).astype(np.int64), (x >> np.uint64(N) & np.uint64(0x7FFFFF)).astype(np.int64)
    sa, sb, tables = _syndromes(a), _syndromes(b), _cosets(threshold)
    index, anchor, centre = [], [], []
    for k in range(threshold + 1):
        for m in range(threshold + 1 - k):
            ea, eb = tables[k][sa][:, :, None], tables[m][sb][:, None, :]
            i, p, q = np.nonzero((ea >= 0) & (eb >= 0))
            ca, cb = a[i] ^ tables[k][sa[i], p], b[i] ^ tables[m][sb[i], q]
            index.append(i)
            anchor.append(ca | cb << N)
            centre.append(np.full(len(i), k == m == 0))
    return tuple(np.concatenate(z) for z in (index, anchor, centre))


def fingerprint(text: bytes, shingle: int = 3) -> int:
    """Bit set if set in over half of the XXH64 hashes (seed 42) of the shingles; zero for no words."""
    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    n = max(1, len(words) - shingle + 1)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])[:n].tolist()
    stops = ends[min(shingle, len(words)) - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    h = np.array([digest(joined[s:e], 42) for s, e in zip(starts, stops, strict=True)], np.uint64)
    total = np.zeros(64, np.int64)
    for k in range(0, n, 4096):
        total += np.unpackbits(h[k : k + 4096].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(total * 2 > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, shingle: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fp (bigint with the fingerprint's bits) of every row; null texts have no words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = np.array([fingerprint(t, shingle) for t in batch.column("text").cast(pa.binary()).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(fp.view(np.int64))], names=["doc_id", "fp"])
        common.release()

    return common.prepared(docs, id_col, text_col).mapInArrow(run, "doc_id bigint, fp bigint")


def _placed(prints: DataFrame, threshold: int) -> DataFrame:
    """anchor, fp, centre: the anchors of each fingerprint (column fp), and whether it stands there as a centre.

    Spark takes these rows, 61 for each fingerprint at threshold 2, for as
    many as there are fingerprints, so it would broadcast far more than its
    limit through the driver: joins of them ask for a sort-merge join.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = batch.column("fp").to_numpy()
            for k in range(0, len(fp), 2048):
                part = fp[k : k + 2048]
                i, anchor, centre = replicas(part, threshold)
                yield pa.RecordBatch.from_arrays([pa.array(anchor), pa.array(part[i]), pa.array(centre)], names=["anchor", "fp", "centre"])

    return prints.select("fp").mapInArrow(run, "anchor bigint, fp bigint, centre boolean")


def links(prints: DataFrame, threshold: int = 2) -> DataFrame:
    """a, b: the pairs of distinct fingerprints (column fp) that differ in at most ``threshold`` bits."""
    placed = _placed(prints, threshold)
    centres = placed.filter("centre").select("anchor", F.col("fp").alias("a"))
    others = placed.select("anchor", F.col("fp").alias("b"))
    near = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= threshold
    return centres.join(others.hint("merge"), "anchor").filter(near & (F.col("a") != F.col("b"))).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def stars(prints: DataFrame, threshold: int = 2) -> DataFrame:
    """a, b: for a fingerprint b the least other one a that is the least centre of an anchor of b and differs in at most ``threshold`` bits: one link at most for each, however many lie close."""
    placed = _placed(prints, threshold)
    least = placed.filter("centre").groupBy("anchor").agg(F.min("fp").alias("a"))
    near = (F.bit_count(F.col("a").bitwiseXOR(F.col("fp"))) <= threshold) & (F.col("a") != F.col("fp"))
    return placed.join(least.hint("merge"), "anchor").filter(near).groupBy(F.col("fp").alias("b")).agg(F.min("a").alias("a")).select("a", "b")


def near_duplicates(docs: DataFrame, shingle: int = 3, threshold: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fp, component_id of every row: the smallest doc_id that links reach, itself included.

    Texts are lower-cased (A-Z), words are runs without ASCII white space, and
    shingles are of ``shingle`` words with repeats (fewer words: one shingle
    of all).  Texts without words, and null ones, have fingerprint zero and
    link like any other.  Repeated rows get equal results.  Null ids take part
    but are never a component's id, unless it has no other: then it is null.
    """
    prints = common.written(fingerprints(docs, shingle, id_col, text_col), "prints")
    groups = prints.groupBy("fp").agg(F.min("doc_id").alias("least"))
    roots = common.components(links(groups, threshold))
    rooted = groups.join(roots, groups["fp"] == roots["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    rooted = common.written(rooted, "roots")
    named = rooted.join(rooted.groupBy("root").agg(F.min("least").alias("component_id")), "root").select("fp", "component_id")
    return prints.join(named, "fp", "left").select("doc_id", "fp", "component_id")  # each has one; so prints are never what is broadcast


def similar_groups(docs: DataFrame, threshold: int = 2, shingle: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, copy (hash of the text), root of every row: rows of one root are linked by a Jaccard similarity of 0.8 or more of their distinct shingles.

    Anchors link each fingerprint (of the distinct shingles) with one that
    differs in ``threshold`` bits or fewer, and each link is verified by the
    shingles themselves.  At similarity 0.8 fingerprints differ in about ten
    bits, so what they cannot show is found by ``near_copies.links``, for
    texts that are not in one component yet.  Texts are lower-cased (A-Z), words are
    runs without ASCII white space; fewer words than a shingle are one
    shingle.  Texts without words, and null ones, are copies of each other
    and of nothing else.  An empty table gives an empty result.
    """
    found = common.written(near_copies.prefixes(docs, shingle, id_col, text_col), "prefixes")
    texts = common.written(found.filter("prefix is not null").groupBy("key").agg(*[F.first(c).alias(c) for c in ("n", "fp", "prefix", "shingles")]), "texts")
    groups = common.written(texts.groupBy("fp").agg(F.min("key").alias("least")), "prints")
    same = texts.join(groups, "fp").filter("key <> least").select(F.col("key").alias("a"), F.col("least").alias("b"))
    ends = lambda c: groups.select(F.col("fp").alias(c), F.col("least").alias(f"key_{c}"))
    close = stars(groups, threshold).join(ends("a"), "a").join(ends("b"), "b").select(F.col("key_a").alias("a"), F.col("key_b").alias("b"))
    by_anchor = near_copies.verified(same.unionByName(close), texts)
    roots = common.components(near_copies.links(texts, by_anchor))
    return found.join(roots, found["key"] == roots["node"], "left").select("doc_id", "copy", F.coalesce("root", "key").alias("root"))


def op9_simhash(spark, sf_dir: str) -> DataFrame:
    found = near_duplicates(common.reading(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
