"""Shingle similarity for near copies: pairs of texts whose Jaccard similarity is 0.8 or more, none lost.

``simhash.similar_groups`` links texts by their fingerprints first; this
module verifies its links, and finds those that 64 bits cannot show.

All shingles of the corpus are put in one order: those in few texts first,
then by hash.  Two texts of similarity t share at least t n of either's n
shingles, so the first n - ceil(t n) + 1 shingles of both have one in common
(prefix filter).  A shingle that only one text holds takes a place but is
never looked up, so most texts that are nobody's copy have no postings at
all.  What two prefixes share also bounds what the texts share: all that they
have in common up to the end of the prefix that ends first is in both, and of
the other text's rest no more than ceil(t n) - 1 can follow.  So prefixes must
share several shingles, and a pair is looked for only at places that leave
room for as many.  Frequencies travel by ``common.Exchange``; a frequency that collides
only moves a shingle in the order, alike for all texts.

Pairs are verified by their whole shingle sets (64-bit hashes).  A large group
of copies is not compared pair by pair: first each posting's texts of about one
size have one of them drawn, and each text is compared with that drawn text
with which it shares most postings; then only pairs that are not yet in one
component.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeloom.llm import common

#: Similarity, as a fraction of whole numbers.
NUM, DEN = 4, 5
#: Bytes of text whose shingles are hashed at once.
SLICE_BYTES = 1 << 19
#: Rounds of comparing each text with one that is drawn before all pairs that are left.
PIVOTS = 1
FOUND = "doc_id bigint, copy bigint, key bigint, n int, fp bigint, prefix binary, shingles binary"
_PRIME = np.uint64(0x9E3779B185EBCA87)


def shingle_sets(texts: list[bytes], shingle: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each text, one text after the other, and where each begins; fewer words than a shingle: one of all words."""
    out, size, k = [np.zeros(0, np.uint64)], [np.zeros(1, np.int64)], 0
    while k < len(texts):  # a slice at a time, so that working arrays stay small
        first, used = k, 0
        while k < len(texts) and (k == first or used + len(texts[k]) <= SLICE_BYTES):
            used, k = used + len(texts[k]), k + 1
        h, begin = _sliced(texts[first:k], shingle)
        out.append(h)
        size.append(np.diff(begin))
    return np.concatenate(out), np.cumsum(np.concatenate(size))


def _sliced(texts: list[bytes], shingle: int = 5) -> tuple[np.ndarray, np.ndarray]:
    codes, words, n = common.word_codes(texts, True)
    h = np.array([xxhash.xxh64_intdigest(w, 7) for w in words.to_pylist()], np.uint64)[codes] if len(words) else np.zeros(0, np.uint64)
    begin = np.cumsum(n) - n
    size = np.where(n > 0, np.maximum(1, n - shingle + 1), 0)
    doc = np.repeat(np.arange(len(n)), size)
    at = np.arange(len(doc)) - np.repeat(np.cumsum(size) - size, size) + begin[doc]
    out = np.full(len(doc), 1, np.uint64)
    stop = (begin + n)[doc]
    for j in range(shingle):
        inside = at + j < stop
        mixed = (out ^ h[np.where(inside, at + j, 0)]) * _PRIME if len(h) else out
        out = np.where(inside, mixed ^ (mixed >> np.uint64(29)), out)
    order = np.lexsort((out, doc))
    out, doc = out[order], doc[order]
    new = np.ones(len(out), bool)
    new[1:] = (out[1:] != out[:-1]) | (doc[1:] != doc[:-1])
    return out[new], np.searchsorted(doc[new], np.arange(len(n) + 1))


def printed(h: np.ndarray) -> int:
    """SimHash of shingle hashes: bits that over half of them have set, as a signed integer."""
    total = np.zeros(64, np.int64)
    for k in range(0, len(h), 4096):
        total += np.unpackbits(h[k : k + 4096].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(total * 2 > len(h), bitorder="little").view(np.int64)[0])


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return DEN * both >= NUM * (len(a) + len(b) - both)


def prefixes(docs: DataFrame, shingle: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """FOUND of every row: copy: hash of the text; key: that of its words; fp: fingerprint, prefix: places and hashes to look up, and shingles: null for a text that cannot have a near copy."""
    rows = common.prepared(docs.withColumn("__copy", F.xxhash64(F.col(f"`{text_col}`"))), id_col, text_col, carry=["__copy"])
    batches, buckets = common.sizes(common.text_bytes(rows))

    def dealt(h: np.ndarray) -> np.ndarray:
        """Where each bucket's hashes begin; h is sorted."""
        return np.searchsorted((h >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32), np.arange(buckets + 1, dtype=np.uint64))

    def emit(table, _):
        h, count = np.unique(shingle_sets(common.texts_of(table), shingle)[0], return_counts=True)
        ends = dealt(h)
        low, few = h.astype(np.uint32), np.minimum(count, 255).astype(np.uint8)
        return {b: common.packed(low[ends[b] : ends[b + 1]], few[ends[b] : ends[b + 1]]) for b in np.flatnonzero(np.diff(ends)).tolist()}

    def answer(_ids, bodies):
        got = [common.unpacked(b, np.uint32, np.uint8) for b in bodies]
        _, code = np.unique(np.concatenate([k for k, _ in got]), return_inverse=True)
        total = np.bincount(code, np.concatenate([c for _, c in got]))
        rank = np.minimum(255, np.ceil(8 * np.log2(np.maximum(total, 1)))).astype(np.uint8)[code]  # 0: in one text
        ends = np.cumsum([0, *[len(k) for k, _ in got]])
        return [common.packed(rank[ends[i] : ends[i + 1]]) for i in range(len(got))]

    def finish(table, replies):
        texts = common.texts_of(table)
        h, begin = shingle_sets(texts, shingle)
        all_h = np.unique(h)
        got = replies.get(0, {})
        rank = np.concatenate([np.zeros(0, np.uint8), *[common.unpacked(got[b], np.uint8)[0] for b in sorted(got)]])[np.searchsorted(all_h, h)]
        n = np.diff(begin)
        most = n + -NUM * n // DEN + 1  # n - ceil(t n) + 1
        alone = np.concatenate([[0], np.cumsum(rank == 0)])
        alone = alone[begin[1:]] - alone[begin[:-1]]
        prefix, sets, prints = [], [], []
        for i in range(len(texts)):
            if alone[i] >= most[i] or not n[i]:
                prefix.append(None)
                sets.append(None)
                prints.append(None)
                continue
            mine, r = h[begin[i] : begin[i + 1]], rank[begin[i] : begin[i + 1]]
            first = np.lexsort((mine, r))[: most[i]]
            place = np.flatnonzero(r[first] > 0)
            prefix.append(common.packed(place.astype(np.int32), mine[first[place]]))
            sets.append(common.packed(mine))
            prints.append(printed(mine))
        key = np.array([xxhash.xxh3_64_intdigest(b" ".join(t.lower().split())) for t in texts], np.uint64).view(np.int64)
        return pa.table({"doc_id": table["doc_id"], "copy": table["carry"].combine_chunks().field("__copy"), "key": key, "n": n, "fp": pa.array(prints, pa.int64()), "prefix": pa.array(prefix, pa.binary()), "shingles": pa.array(sets, pa.binary())})

    exchange = common.Exchange(rows, batches)
    return exchange.finish(finish, FOUND, exchange.round(0, emit, answer))


def _postings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        got = [common.unpacked(b, np.int32, np.uint64) for b in batch.column("prefix").to_pylist()]
        each = [len(p) for p, _ in got]
        place = np.concatenate([np.zeros(0, np.int32), *[p for p, _ in got]])
        nth = np.concatenate([np.zeros(0, np.int32), *[np.arange(n, dtype=np.int32) for n in each]])
        h = np.concatenate([np.zeros(0, np.uint64), *[x for _, x in got]]).view(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(h), pa.array(np.repeat(batch.column("key").to_numpy(), each)), pa.array(np.repeat(batch.column("n").to_numpy(), each)), pa.array(place), pa.array(nth), pa.array(np.repeat(np.array(each, np.int32), each))], names=["h", "key", "n", "place", "nth", "of"])
    common.release()


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        x, y = ([common.unpacked(b, np.uint64)[0] for b in batch.column(c).to_pylist()] for c in ("x", "y"))
        keep = pa.array([similar(p, q) for p, q in zip(x, y, strict=True)], pa.bool_())
        yield pa.RecordBatch.from_arrays([batch.column("a").filter(keep), batch.column("b").filter(keep)], names=["a", "b"])
    common.release()


def verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b: keys) of similarity 0.8 or more."""
    one, two = texts.select(F.col("key").alias("a"), F.col("shingles").alias("x")), texts.select(F.col("key").alias("b"), F.col("shingles").alias("y"))
    return common.written(pairs.join(one, "a").join(two, "b").select("a", "b", "x", "y").mapInArrow(_verified, "a bigint, b bigint"), "links")


def links(texts: DataFrame, known: DataFrame) -> DataFrame:
    """a, b: pairs of keys of similarity 0.8 or more that, with the known ones, join all such pairs into their components.  texts: key, n, prefix, shingles, one row per key."""
    # Postings are small as files and several times that as rows, which Spark does not see: their joins ask not to be broadcast.
    postings = common.written(texts.select("key", "n", "prefix").mapInArrow(_postings, "h bigint, key bigint, n int, place int, nth int, of int"), "postings")

    def floor(a: str, b: str) -> str:
        """How many shingles prefixes must share at least: those that the texts share at least, less what can follow a prefix."""
        return f"(({NUM} * ({a} + {b}) + {NUM + DEN - 1}) div {NUM + DEN} - ({NUM} * greatest({a}, {b}) + {DEN - 1}) div {DEN} + 1)"

    # Of a shingle that a pair shares: what is left from there on in both texts must hold what they share at least, if it is
    # the first; and what comes before and after it in both prefixes must hold what those share at least.
    left = f"least(x.n - x.place, y.n - y.place) * {NUM + DEN} >= {NUM} * (x.n + y.n)"
    may = F.expr(f"(least(x.nth, y.nth) > 0 OR {left}) AND least(x.nth, y.nth) + least(x.of - x.nth, y.of - y.nth) >= {floor('x.n', 'y.n')}")
    done = known
    for number in range(PIVOTS + 1):
        roots = common.components(done)
        rooted = common.written(postings.join(roots, postings["key"] == roots["node"], "left").select("h", "key", "n", "place", "nth", "of", F.coalesce("root", "key").alias("root")), "rooted")
        same = (F.col("x.h") == F.col("y.h")) & may
        if number < PIVOTS:
            group = rooted.withColumn("class", F.floor(F.log(F.col("n")) / F.log(F.lit(DEN / NUM)) + F.lit(number / 2)))  # bounds move, so near sizes meet
            # The same text for many postings: at first one with the most of them, as it has the least of its own; then any.
            draw = F.struct((-F.col("of") if number == 0 else F.lit(0)).alias("own"), F.xxhash64("key", F.lit(number)).alias("draw"), "key", "n", "place", "nth", "of", "root")
            pivot = group.groupBy("h", "class").agg(F.min(draw).alias("p"), F.count("*").alias("c")).filter("c > 1").select("h", "class", "p.*")
            met = group.alias("x").join(pivot.hint("merge").alias("y"), same & (F.col("x.class") == F.col("y.class")) & (F.col("x.root") != F.col("y.root")))
            shared = met.groupBy(F.col("x.key").alias("a"), F.col("y.key").alias("b")).agg(F.count("*").alias("shared"))
            found = shared.groupBy("a").agg(F.max(F.struct("shared", "b")).alias("most")).select("a", "most.b")
        else:
            # Prefixes that share c shingles share one among all but the last c - 1 of each: a row for these is enough to find the pair.
            early = F.expr(f"greatest(x.nth - x.of, y.nth - y.of) + {floor('x.n', 'y.n')} <= 0")
            met = rooted.alias("x").join(rooted.hint("merge").alias("y"), same & early & (F.col("x.root") < F.col("y.root")))
            found = met.select(F.col("x.key").alias("a"), F.col("y.key").alias("b")).distinct()
        done = done.unionByName(verified(found, texts))
    return done
