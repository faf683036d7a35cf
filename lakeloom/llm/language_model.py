"""Language-model scoring with a causal self-attention model over subword ids.

A text is a sequence of words and one end.  The model mixes two distributions
of the next word.  One is the word's share of all training tokens, counted
over the whole corpus.  The other spells the word in subword ids: one layer
of causal self-attention with learned distance biases reads the ids before,
and a two-level softmax (cluster, then member) gives the next id.  Ids that
open a word have clusters of their own, so the chance that a word is over is
a sum of cluster probabilities, and spelled words are a proper distribution.

Scoring cuts a document into windows of 48 ids that overlap by 16: each id is
scored once, in the window where at least 16 ids before it (or all) are seen.

Word counts travel by ``common.Exchange``; no table of words is collected or
broadcast.  Subword ids are counted where the corpus's distinct words meet.
The attention weights start from a fit on a small sample; then every task
fits on from there over its share of all training documents, whole texts, and
the mean of their weights is the model.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeloom.llm import bpe, common

END = bpe.SPECIAL_ID
#: Ids scored in a window and overlap before them; query and hidden widths; clusters of words' first ids and of others; members.
SCORED, OVERLAP, QUERY, HIDDEN, CLUSTERS, MEMBERS = 32, 16, 8, 16, (16, 16), 32
WINDOW = SCORED + OVERLAP
#: Weight of the corpus-wide word share; ids of the sample that weights start from (at most START_DOC of a document), and passes over it.
SHARE, START_DOCS, START_DOC, START_IDS, EPOCHS, SEED = 0.2, 1200, 4096, 400_000, 3, 3
#: Windows of a step and its size; groups in which tasks' weights are averaged.
STEP, RATE, GROUPS = 256, 0.003, 32
#: Windows whose attention is worked on at once, so that it stays in a core's cache; how far each place of a window is behind each scored one.
TOGETHER = 32
DISTANCE = (OVERLAP + np.arange(SCORED))[:, None] - np.arange(WINDOW)


class Vocabulary:
    """Subword ids by cluster and member.  The last member of a cluster kind's last cluster stands for all rarer ids of the kind."""

    def __init__(self, ids: np.ndarray, opens: np.ndarray, count: np.ndarray | None = None):
        """ids: of training text, or count: of every id; opens: for every id, whether it opens a word."""
        n = len(opens)
        if count is None:
            count = np.bincount(ids, minlength=n)
        self.opens = opens
        self.cluster, self.member = np.zeros(n, np.uint8), np.zeros(n, np.uint8)
        self.log_rare = np.zeros(n, np.float32)
        self.input = np.full(n, 0, np.int64)
        self.valid = np.zeros((sum(CLUSTERS), MEMBERS), bool)
        base = 0
        for kind, clusters in zip((True, False), CLUSTERS, strict=True):
            mine = np.flatnonzero(opens == kind)
            mine = mine[np.argsort(-count[mine], kind="stable")]
            room = clusters * MEMBERS - 1
            common_, rare = mine[: min(room, int((count[mine] > 0).sum()))], mine[min(room, int((count[mine] > 0).sum())) :]
            place = np.arange(len(common_))
            self.cluster[common_], self.member[common_] = base + place % clusters, place // clusters
            self.cluster[rare], self.member[rare] = base + clusters - 1, MEMBERS - 1
            self.log_rare[rare] = np.log((count[rare] + 1) / (count[rare].sum() + len(rare)))
            self.valid[self.cluster[common_], self.member[common_]] = True
            if len(rare):
                self.valid[base + clusters - 1, MEMBERS - 1] = True
            base += clusters
        self.live = self.valid.any(1)
        self.input = self.cluster.astype(np.int64) * MEMBERS + self.member
        self.size = sum(CLUSTERS) * MEMBERS
        self.first = self.size  # what stands before the first id


def spelled(words: list[bytes], codec: bpe.Codec, opens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all words, each as if after a space, and where each word's ids begin."""
    ids = codec._plain(b"".join(b" " + w for w in words)).astype(np.int64) if words else np.zeros(0, np.int64)
    at = np.flatnonzero(opens[ids])
    if len(at) != len(words):
        raise AssertionError("words and openings differ")
    return ids, np.append(at, len(ids))


def opening_ids(codec: bpe.Codec) -> np.ndarray:
    opens = np.array([t[:1] == b" " for t in codec.table])
    opens[END] = True
    return opens


def ragged(begin: np.ndarray, pick: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Indices of the runs ``pick`` one after the other, and where each begins."""
    n = begin[pick + 1] - begin[pick]
    at = np.concatenate([[0], np.cumsum(n)])
    return np.arange(at[-1]) - np.repeat(at[:-1] - begin[pick], n), at


def windows(begin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For streams that begin at these places: places of each window's ids (-1: before the stream or after it), and its stream."""
    size = np.diff(begin)
    count = -(-size // SCORED)
    stream = np.repeat(np.arange(len(size)), count)
    k = np.arange(len(stream)) - np.repeat(np.cumsum(count) - count, count)
    place = (k * SCORED - OVERLAP)[:, None] + np.arange(WINDOW)
    at = np.where((place >= 0) & (place < size[stream][:, None]), place + begin[stream][:, None], -1)
    return at, stream


class Model:
    def __init__(self, vocabulary: Vocabulary, seed: int = SEED):
        r = np.random.default_rng(seed)
        v, n, c = vocabulary, vocabulary.size + 1, sum(CLUSTERS)
        self.v = v
        p = {"a": r.normal(0, 0.3, (n, HIDDEN)), "q": r.normal(0, 0.3, (n, QUERY)), "k": r.normal(0, 0.3, (n, QUERY)), "x": r.normal(0, 0.3, (n, HIDDEN)), "d": -0.1 * np.arange(WINDOW), "w": r.normal(0, HIDDEN**-0.5, (HIDDEN, HIDDEN)), "c": r.normal(0, 0.1, (HIDDEN, c)), "cb": np.zeros(c), "m": r.normal(0, 0.1, (c, HIDDEN, MEMBERS)), "mb": np.zeros((c, MEMBERS))}
        self.p = {k: x.astype(np.float32) for k, x in p.items()}

    def _tables(self) -> tuple:
        """What places read by input: ``a``; ``q``; ``k``; ``x`` through ``w``, and a one, whose sum is that of the weights.  And the biases by distance.

        The last row is what does not exist: it has no one, so nothing is seen of it.
        """
        p = self.p
        a, q, k, x = (np.zeros((self.v.first + 2, wide), p["w"].dtype) for wide in (HIDDEN, QUERY, QUERY, HIDDEN + 1))
        a[:-1], q[:-1], k[:-1], x[:-1, :HIDDEN], x[:-1, HIDDEN] = p["a"], p["q"], p["k"], p["x"] @ p["w"], 1
        return a, q, k, x, np.where(DISTANCE >= 0, p["d"][np.maximum(DISTANCE, 0)], -1e9).astype(p["d"].dtype)

    def _attended(self, tables: tuple, inputs: np.ndarray) -> tuple:
        """inputs: (window, WINDOW) ids before each place.  Hidden states of the scored places, and what they are made of."""
        a, q, k, x, bias = tables
        late = inputs[:, OVERLAP:]
        q, k, x = q.take(late, 0), k.take(inputs, 0), x.take(inputs, 0)
        s = q @ k.transpose(0, 2, 1)
        s += bias
        if s.max(initial=0) > 30:  # else nothing overflows, and rows need no shift
            s -= s.max(2, keepdims=True)
        np.exp(s, out=s)
        seen = s @ x
        each = 1 / (seen[:, :, HIDDEN:] + s.dtype.type(1e-30))
        seen *= each
        h = a.take(late, 0)
        h += seen[:, :, :HIDDEN]
        np.tanh(h, out=h)
        return q, k, x, s, each, seen, h

    def _ends(self) -> tuple[np.ndarray, np.ndarray]:
        """Weights of clusters and of members, their biases as one more row: a cluster or member that does not occur has no share."""
        v, p = self.v, self.p
        cb, mb = np.where(v.live, p["cb"], -1e9).astype(p["cb"].dtype), np.where(v.valid, p["mb"], -1e9).astype(p["mb"].dtype)
        return np.concatenate([p["c"], cb[None]]), np.concatenate([p["m"], mb[:, None]], 1)

    def _chosen(self, h: np.ndarray, target: np.ndarray, weights: tuple[np.ndarray, np.ndarray]) -> tuple:
        """For hidden states (and a one each) in the order of their targets' clusters: exponentials of clusters' and members' logits, their sums, the targets' places in them and members' own logits, and where clusters end."""
        v = self.v
        cluster, member, each = v.cluster[target], v.member[target], np.arange(len(target)) * MEMBERS
        ends = np.concatenate([[0], np.cumsum(np.bincount(cluster, minlength=sum(CLUSTERS)))]).tolist()
        y, z = h @ weights[0], np.empty((len(h), MEMBERS), h.dtype)
        for c, (a, b) in enumerate(zip(ends[:-1], ends[1:], strict=True)):
            if a < b:
                np.matmul(h[a:b], weights[1][c], out=z[a:b])
        for x in (y, z):
            if x.max(initial=0) > 30:
                x -= x.max(1, keepdims=True)
        mine = each + member
        own = z.take(mine)
        np.exp(y, out=y)
        np.exp(z, out=z)
        return y, z, y @ np.ones(sum(CLUSTERS), y.dtype), z @ np.ones(MEMBERS, z.dtype), np.arange(len(target)) * sum(CLUSTERS) + cluster, mine, own, ends

    def _prepared(self, ids: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Inputs (the last row of ``_tables`` where none exists), and which scored places have an id, of windows."""
        v = self.v
        there = at >= 0
        inputs = np.where(there, v.input[ids[np.maximum(at - 1, 0)]], v.first + 1)
        first = there.copy()  # a stream's first id has nothing before it
        first[:, 1:] &= ~there[:, :-1]
        first[:, 0] = False  # a window that begins with an id is never a stream's first
        inputs[first] = v.first
        return inputs, there[:, OVERLAP:]

    def log_p(self, ids: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For every id of the streams: its log probability, and that of any opening id in its place."""
        v, p = self.v, self.p
        at, _ = windows(begin)
        logp, opened = np.zeros(len(ids), np.float32), np.zeros(len(ids), np.float32)
        tables, weights = self._tables(), self._ends()
        low = (np.arange(sum(CLUSTERS)) < CLUSTERS[0]).astype(np.float32)
        hidden = np.ones((512 * SCORED, HIDDEN + 1), np.float32)
        for k in range(0, len(at), 512):
            part = at[k : k + 512]
            inputs, scored = self._prepared(ids, part)
            for i in range(0, len(part), TOGETHER):
                h = self._attended(tables, inputs[i : i + TOGETHER])[-1].reshape(-1, HIDDEN)
                hidden[i * SCORED : i * SCORED + len(h), :HIDDEN] = h
            rows = np.flatnonzero(scored)
            places = part[:, OVERLAP:].reshape(-1)[rows]
            order = np.argsort(v.cluster[ids[places]], kind="stable")
            rows, places = rows[order], places[order]
            y, _, total, sums, mine, _, own, _ = self._chosen(hidden.take(rows, 0), ids[places], weights)
            opened[places] = np.log(y @ low / total + 1e-30)
            logp[places] = np.log(y.take(mine) / total + 1e-30) + own - np.log(sums) + v.log_rare[ids[places]]
        return logp, opened

    def gradients(self, ids: np.ndarray, at: np.ndarray) -> tuple[dict, float]:
        """Of the mean negative log probability of the scored ids (rare ids as their class)."""
        v, p = self.v, self.p
        inputs, scored = self._prepared(ids, at)
        tables, weights, kind = self._tables(), self._ends(), p["w"].dtype
        spans = [slice(i, i + TOGETHER) for i in range(0, len(at), TOGETHER)]
        hidden = np.ones((len(at), SCORED, HIDDEN + 1), kind)
        parts = [self._attended(tables, inputs[i]) for i in spans]
        for i, part in zip(spans, parts, strict=True):
            hidden[i, :, :HIDDEN] = part[-1]
        rows = np.flatnonzero(scored)
        target = ids[at[:, OVERLAP:].reshape(-1)[rows]]
        order = np.argsort(v.cluster[target], kind="stable")
        rows, target, n = rows[order], target[order], len(target)
        hs = hidden.reshape(-1, HIDDEN + 1).take(rows, 0)
        y, z, total, sums, at_y, at_z, own, ends = self._chosen(hs, target, weights)
        loss = -(np.log(y.take(at_y) / total + 1e-30) + own - np.log(sums)).sum()
        y *= (1 / (n * total))[:, None]
        z *= (1 / (n * sums))[:, None]
        y.reshape(-1)[at_y] -= 1 / n
        z.reshape(-1)[at_z] -= 1 / n
        by_cluster, by_member = hs.T @ y, np.zeros(weights[1].shape, kind)
        dh, more = y @ p["c"].T, np.empty((n, HIDDEN), kind)
        for c, (a, b) in enumerate(zip(ends[:-1], ends[1:], strict=True)):
            if a < b:
                np.matmul(hs[a:b].T, z[a:b], out=by_member[c])
                np.matmul(z[a:b], p["m"][c].T, out=more[a:b])
        dh += more
        grad = {"c": by_cluster[:-1], "cb": by_cluster[-1], "m": by_member[:, :-1], "mb": by_member[:, -1]}
        full = np.zeros((len(at), SCORED, HIDDEN), kind)
        full.reshape(-1, HIDDEN)[rows] = dh
        da, dq, dk, dx = (np.empty((wide, len(at) * size)) for size, wide in ((SCORED, HIDDEN), (SCORED, QUERY), (WINDOW, QUERY), (WINDOW, HIDDEN + 1)))
        per, f, ones = np.zeros((SCORED, WINDOW), kind), np.empty((TOGETHER, SCORED, HIDDEN + 1), kind), np.ones(HIDDEN, kind)
        for i, (q, k, x, s, each, seen, h) in zip(spans, parts, strict=True):
            mine, h = f[: len(s)], np.multiply(h, h, out=h)
            full[i] *= np.subtract(1, h, out=h)
            np.multiply(full[i], each, out=mine[:, :, :HIDDEN])
            mine[:, :, HIDDEN] = -((seen[:, :, :HIDDEN] * mine[:, :, :HIDDEN]) @ ones)  # through the softmax, whose rows' sums meet x's one
            a, b = slice(i.start * SCORED, i.stop * SCORED), slice(i.start * WINDOW, i.stop * WINDOW)
            da[:, a], dx[:, b] = full[i].reshape(-1, HIDDEN).T, (s.transpose(0, 2, 1) @ mine).reshape(-1, HIDDEN + 1).T
            s *= mine @ x.transpose(0, 2, 1)
            per += s.sum(0)
            dq[:, a], dk[:, b] = (s @ k).reshape(-1, QUERY).T, (s.transpose(0, 2, 1) @ q).reshape(-1, QUERY).T
        grad["d"] = np.bincount(np.maximum(DISTANCE, 0)[DISTANCE >= 0], per[DISTANCE >= 0], WINDOW).astype(kind)
        late, every = inputs[:, OVERLAP:].reshape(-1), inputs.reshape(-1)
        for name, where, g in (("a", late, da), ("q", late, dq), ("k", every, dk), ("x", every, dx)):
            grad[name] = np.stack([np.bincount(where, x, v.first + 2) for x in g[: p[name].shape[1]]], 1)[:-1].astype(kind)
        grad["w"], grad["x"] = p["x"].T @ grad["x"], grad["x"] @ p["w"].T
        return grad, float(loss / n)

    def fit(self, ids: np.ndarray, begin: np.ndarray, epochs: int = EPOCHS, seed: int = SEED) -> Model:
        """From random weights; biases start from the counts in ids."""
        v = self.v
        count = np.bincount(v.cluster[ids], minlength=sum(CLUSTERS))
        self.p["cb"] = np.log((count + 1) / (count.sum() + len(count))).astype(np.float32)
        both = np.bincount(v.cluster[ids].astype(np.int64) * MEMBERS + v.member[ids], minlength=v.size).reshape(-1, MEMBERS)
        self.p["mb"] = np.log((both + 1) / (both.sum(1, keepdims=True) + MEMBERS)).astype(np.float32)
        at, _ = windows(begin)
        steps, r, steady = epochs * -(-len(at) // 64), np.random.default_rng(seed), Adam(self)
        for epoch in range(epochs):
            order = r.permutation(len(at))
            for k in range(0, len(at), 64):
                steady.step(self.gradients(ids, at[order[k : k + 64]])[0], 0.012 * (1 - steady.taken / steps) + 0.0005)
        return self


class Adam:
    def __init__(self, model: Model):
        self.model, self.taken = model, 0
        self.m, self.s = ({k: np.zeros_like(x) for k, x in model.p.items()} for _ in range(2))

    def step(self, grad: dict, rate: float) -> None:
        self.taken += 1
        rate, shrink = rate / (1 - 0.9**self.taken), (1 - 0.99**self.taken) ** -0.5
        for n, g in grad.items():
            m, s = self.m[n], self.s[n]
            m += 0.1 * (g - m)
            s += 0.01 * (g * g - s)
            below = np.sqrt(s)
            below *= shrink
            below += 1e-8
            np.divide(m, below, out=below)
            below *= rate
            self.model.p[n] = (self.model.p[n] - below).astype(np.float32)


def laid_out(codes: np.ndarray, n: np.ndarray, ids: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """From words' codes, words per text, and distinct words' ids: ids of the texts (their words, then the end), where each text begins, where each word begins, and words' codes (ends count as words)."""
    last = len(begin) - 1
    ids, begin = np.append(ids, END), np.append(begin, len(ids) + 1)
    closed = np.insert(codes, np.cumsum(n), last)  # the end is one more word, after each text's own
    at, word_at = ragged(begin, closed)
    text_word = np.concatenate([[0], np.cumsum(n + 1)])
    return ids[at], word_at[text_word], word_at, closed


def streams(texts: list[bytes], codec: bpe.Codec, opens: np.ndarray) -> tuple:
    """``laid_out`` of texts, their distinct words, and words per text."""
    codes, words, n = common.word_codes(texts, True)
    return *laid_out(codes, n, *spelled(common.listed(words), codec, opens)), words, n


def held_out(doc_id: int | None) -> bool:
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % 7 == 2


def started(rows: DataFrame, path: str, count: np.ndarray) -> Model:
    """A model fitted on the first ids of documents that are drawn by the hash of id and text: about START_IDS in all."""
    n = rows.count()
    draw = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1_000_000)) < int(min(1.0, START_DOCS / max(1, n)) * 1_000_000)
    codec = bpe.codec(path, False)
    opens = opening_ids(codec)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, begin, *_ = streams(batch.column("text").cast(pa.binary()).to_pylist(), bpe.codec(path, False), opens)
            heads = [ids[a : min(b, a + START_DOC)].astype(np.int32).tobytes() for a, b in zip(begin[:-1], begin[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(heads, pa.binary())], names=["ids"])

    got = [np.frombuffer(r["ids"], np.int32).astype(np.int64) for r in rows.filter(draw).mapInArrow(run, "ids binary").orderBy(F.xxhash64("ids"), "ids").limit(2 * START_DOCS).collect()]
    kept = [x for x, end in zip(got, np.cumsum([len(x) for x in got]), strict=True) if end <= START_IDS] or [np.array([END])]
    return Model(Vocabulary(np.zeros(0, np.int64), opens, count)).fit(np.concatenate(kept), np.cumsum([0, *map(len, kept)]))


def gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[list[bytes]]:
    """Texts of as many batches as make BATCH_BYTES, so words that they share are spelled once."""
    texts, size = [], 0
    for batch in batches:
        texts += common.texts_of(batch)
        size += batch.nbytes
        if size >= common.BATCH_BYTES:
            yield texts
            texts, size = [], 0
    if texts:
        yield texts


def continued(model: Model, rows: DataFrame, path: str, draw: int = 1) -> Model:
    """The mean of what tasks make of the model, by windows seen; each fits on the whole texts of its documents, all of them (``draw``: of one in so many, by the hash of id and text).

    A task's weights are one row of fixed size; rows meet in GROUPS sums, and only those come to the driver.
    """
    names = sorted(model.p)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        mine, codec, seen = Model(model.v), bpe.codec(path, False), 0
        mine.p = {k: x.copy() for k, x in model.p.items()}
        steady = Adam(mine)
        for texts in gathered(batches):
            ids, begin, *_ = streams(texts, codec, mine.v.opens)
            at = windows(begin)[0]
            for k in range(0, len(at), STEP):
                steady.step(mine.gradients(ids, at[k : k + STEP])[0], RATE)
            seen += len(at)
        if seen:
            body = np.concatenate([mine.p[k].ravel() for k in names]) * np.float32(seen)
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId() % GROUPS], pa.int32()), pa.array([seen], pa.int64()), pa.array([body.tobytes()], pa.binary())], names=["part", "n", "body"])
        common.release()

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, np.zeros(sum(x.size for x in model.p.values()), np.float64)
        for batch in batches:
            n += sum(batch.column("n").to_pylist())
            for body in batch.column("body").to_pylist():
                total += np.frombuffer(body, np.float32)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([(total / n).astype(np.float32).tobytes()], pa.binary())], names=["n", "body"])

    drawn = rows.filter(F.pmod(F.xxhash64("doc_id", "text"), F.lit(draw)) == 0)
    made = drawn.mapInArrow(run, "part int, n bigint, body binary").repartition(GROUPS, "part").mapInArrow(summed, "n bigint, body binary")
    got = sorted((r["n"], bytes(r["body"])) for r in made.collect())
    if got:
        mean, at = sum(np.frombuffer(b, np.float32).astype(np.float64) * n for n, b in got) / sum(n for n, _ in got), 0
        for k in names:
            model.p[k] = mean[at : at + model.p[k].size].reshape(model.p[k].shape).astype(np.float32)
            at += model.p[k].size
    return model


def word_counts(exchange: common.Exchange, buckets: int, path: str) -> DataFrame:
    """A round of ``exchange``: for each batch, how often its words (``b""``: the end) occur in training documents, and their subword ids.  A bucket's summary: id -1 and its tokens, -2 and its distinct words, and subword ids with their counts."""

    def emit(table, _):
        codes, words, n = common.word_codes(common.texts_of(table), True)
        train = np.array([not held_out(i) for i in table["doc_id"].to_pylist()])
        count = np.append(np.bincount(codes[np.repeat(train, n)], minlength=len(words)), train.sum()).astype(np.int64)
        words = [*common.listed(words), b""]  # no word is empty: that is the end
        return {b: common.packed(np.frombuffer(b"\n".join([words[i] for i in idx.tolist()]), np.uint8), count[idx]) for b, idx in common.split_by(dealt(words, buckets), buckets)}

    def answer(_ids, bodies):
        got = [common.unpacked(b, np.uint8, np.int64) for b in bodies]
        words = pa.array([w for text, _ in got for w in text.tobytes().split(b"\n")], pa.binary()).dictionary_encode()
        codes, kinds = words.indices.to_numpy(), words.dictionary.to_pylist()
        total = np.bincount(codes, np.concatenate([c for _, c in got]).astype(np.float64), minlength=len(kinds)).astype(np.int64)
        codec = bpe.codec(path, False)
        own = np.array([bool(w) for w in kinds])
        ids, begin = spelled([w for w in kinds if w], codec, opening_ids(codec))
        size = np.zeros(len(kinds), np.int64)
        size[own] = np.diff(begin)
        begin = np.concatenate([[0], np.cumsum(size)])  # the end has no ids here
        at, out = 0, []
        for _, count in got:
            mine = codes[at : at + len(count)]
            out.append(common.packed(total[mine], size[mine].astype(np.uint32), ids[ragged(begin, mine)[0]].astype(np.uint16)))
            at += len(count)
        times = np.bincount(ids, np.repeat(total, size).astype(np.float64), END + 1)
        times[END] += total[~own].sum()
        some = np.flatnonzero(times)
        out.append(common.packed(np.append([-1, -2], some), np.append([total.sum(), (total > 0).sum()], times[some]).astype(np.int64)))
        return out

    return exchange.round(0, emit, answer)


def summed_up(replies: DataFrame) -> dict[int, int]:
    """What buckets say of themselves, added up by id: as many rows as ids come to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for body in batch.column("body").to_pylist():
                ids, n = common.unpacked(body, np.int64, np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(n)], names=["id", "n"])

    found = replies.filter(F.col("batch") == common.SUMMARY).select("body").mapInArrow(run, "id bigint, n bigint")
    return {r["id"]: r["n"] for r in found.groupBy("id").agg(F.sum("n").alias("n")).collect()}


def dealt(words: list[bytes], buckets: int) -> np.ndarray:
    return (np.array([xxhash.xxh64_intdigest(w, 1) for w in words], np.uint64) % np.uint64(buckets)).astype(np.int64)


def trained(docs: DataFrame, counted: dict[int, int], path: str) -> Model:
    """The attention model of the training documents; counted: from ``summed_up``."""
    rows = docs.filter(common.remainder(7) != 2)
    count = np.zeros(len(bpe.codec(path, False).table), np.int64)
    for i, n in counted.items():
        if i >= 0:
            count[i] = n
    return continued(started(rows, path, count), rows, path)


def scored(docs: DataFrame, vocabulary: str | None = None, share: float = SHARE) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score: one row per input row.

    Texts are lower-cased (A-Z); tokens are words, runs without ASCII white
    space, and one end; a null text is only the end.  Documents whose
    remainder is 2 are scored but never learned from (a null id has that of
    the empty text).  base_score: log10 probability of the text by add-one
    shares of all training tokens.  score: that of the model.  Repeated rows
    count once each in training and get equal results.  An empty table gives
    an empty result.
    """
    path = vocabulary or bpe.default_vocabulary()
    rows = common.prepared(docs)
    batches, buckets = common.sizes(common.text_bytes(rows))
    exchange = common.Exchange(rows, batches)
    replies = common.written(word_counts(exchange, buckets, path), "words")
    counted = summed_up(replies)
    tokens, kinds = counted.get(-1, 0), counted.get(-2, 0)
    model = trained(rows, counted, path)

    def finish(table, replies):
        doc_ids = table["doc_id"].to_pylist()
        codes, words, n = common.word_codes(common.texts_of(table), True)
        count, size, told = np.zeros(len(words) + 1, np.int64), np.zeros(len(words) + 1, np.int64), []
        for b, idx in common.split_by(dealt([*common.listed(words), b""], buckets), buckets):
            count[idx], size[idx], ids = common.unpacked(replies[0][b], np.int64, np.uint32, np.uint16)
            told.append((idx, ids))
        begin = np.concatenate([[0], np.cumsum(size)])
        spelt = np.zeros(begin[-1], np.int64)
        for idx, ids in told:
            spelt[ragged(begin, idx)[0]] = ids
        ids, begin, word_at, codes = laid_out(codes, n, spelt, begin[:-1])
        seen = count[codes]
        share_of = np.log((seen + 1) / (tokens + kinds + 1))
        logp, opened = model.log_p(ids, begin)
        total = np.concatenate([[0], np.cumsum(logp, dtype=np.float64)])
        word = total[word_at[1:]] - total[word_at[:-1]] - opened[word_at[:-1]]
        last = np.cumsum(n + 1) - 1
        after = np.append(opened[word_at[1:-1]], 0).astype(np.float64)
        after[last] = 0  # nothing follows the end
        mixed = np.logaddexp(np.log(share) + share_of, np.log1p(-share) + word + after)
        sums = lambda x: (lambda t: t[last + 1] - t[last - n])(np.concatenate([[0], np.cumsum(x, dtype=np.float64)]))
        log10 = np.log(10)
        return pa.table(
            {
                "doc_id": table["doc_id"], "held_out": pa.array([held_out(i) for i in doc_ids], pa.bool_()), "n_tokens": n + 1, "n_known": np.round(sums(seen > 0)).astype(np.int64),
                "train_tokens": np.full(len(n), tokens, np.int64), "base_score": sums(share_of) / log10, "score": np.round(sums(mixed) / log10, 3),
            }
        )

    return exchange.finish(finish, "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double", replies.filter("batch >= 0"))


def op2_lm_score(spark, sf_dir: str) -> DataFrame:
    return scored(common.reading(spark, sf_dir, "documents"))
