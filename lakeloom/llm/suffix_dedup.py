"""Suffix-array de-duplication by a depth-limited radix sort.

Two suffixes matter only as far as their first ``width`` bytes: sorted to that
depth, the equal groups are exactly the repeated windows.  The sort is
most-significant digit first.  Its first digit deals the work out: every
window of ``width`` bytes holds a minimiser (the 24-byte gram of least hash),
at a place that its own bytes decide, so equal windows share gram and place.
Round 1 finds the grams that two different texts share; only windows around
those go on.  Round 2 sorts them, eight bytes a pass, in the bucket of their
gram.  Grams in very many texts send single windows instead, dealt by their
own bytes, so that no bucket grows with the number of copies.  Minimisers are
found once: a batch keeps their places, and what it sent, from round to round.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeloom.llm import common

#: Bytes of a gram, and in so many texts it counts as hot.
GRAM, HOT = 24, 4096
_M1, _M2, _B = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53), np.uint64(0x9E3779B97F4A7C15)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * _M1
    x = (x ^ (x >> np.uint64(33))) * _M2
    return x ^ (x >> np.uint64(33))


def _gram_hashes(data: np.ndarray) -> np.ndarray:
    """Hash of the 24 bytes at each place (short ones at the end are garbage)."""
    h = data.astype(np.uint64) + np.uint64(1)
    power, span = _B, 1
    kept = {}
    for _ in range(4):  # 2, 4, 8, 16 bytes
        g = h.copy()
        g[: len(h) - span] = h[: len(h) - span] * power + h[span:]
        h, power, span = g, power * power, span * 2
        if span == 8:
            kept[8] = (h, power)
    eight, p8 = kept[8]
    out = h.copy()
    if len(h) > 16:
        out[:-16] = h[:-16] * p8 + eight[16:]
    return _mixed(out)


def _slid(x: np.ndarray, n: int, best) -> np.ndarray:
    """best over x[i : i + n]; the last n - 1 places are of fewer."""
    out, have = x.copy(), 1
    while have < n:
        step = min(have, n - have)
        out[: len(out) - step] = best(out[: len(out) - step], out[step:])
        have += step
    return out


def anchors(data: np.ndarray, offsets: np.ndarray, width: int) -> np.ndarray:
    """Places of the minimisers of all windows of ``width`` bytes within a text, in order."""
    slack, found = width - GRAM + 1, []
    k = 0
    while k < len(offsets) - 1:  # about a megabyte at a time
        e = max(k + 1, int(np.searchsorted(offsets, offsets[k] + (1 << 20), "right")) - 1)
        part, off = data[offsets[k] : offsets[e]], offsets[k : e + 1] - offsets[k]
        if len(part) >= width:
            left = np.repeat(off[1:], np.diff(off)) - np.arange(len(part))  # bytes from here to the text's end
            with np.errstate(over="ignore"):
                h = _gram_hashes(part)
            h[h == 0] = 1
            least = _slid(h, slack, np.minimum)
            least[left < width] = 0  # no window begins here
            top = _slid(least[::-1], slack, np.maximum)[::-1]
            at = np.flatnonzero((top == h) & (left >= GRAM))
            found.append(at + offsets[k])
        k = e
    return np.concatenate([np.zeros(0, np.int64), *found])


def _as_digits(rows: np.ndarray) -> list[np.ndarray]:
    """Rows of bytes as columns of eight bytes each."""
    n, w = rows.shape
    wide = np.zeros((n, -(-w // 8) * 8), np.uint8)
    wide[:, :w] = rows
    return list(wide.view(np.uint64).T)


def _digest(digits: list[np.ndarray]) -> np.ndarray:
    """A hash of rows of bytes."""
    h = np.zeros(len(digits[0]), np.uint64)
    with np.errstate(over="ignore"):
        for digit in digits:
            h = _mixed(h * _B + digit)
    return h


def _least(values: np.ndarray, of: np.ndarray, n: int) -> np.ndarray:
    out = np.full(n, 2**63 - 1, np.int64)
    np.minimum.at(out, of, values)
    return out


class _Batch:
    """The texts of a batch, each distinct one once; equal whenever it is read."""

    def __init__(self, table: pa.Table, width: int, buckets: int):
        self.width, self.buckets, self.reach = width, buckets, width - GRAM
        self.texts = common.texts_of(table)
        self.ids = [2**63 - 1 if i is None else i for i in table["doc_id"].to_pylist()]
        first: dict[bytes, int] = {}
        self.of = []
        for row, text in enumerate(self.texts):  # in order of doc_id: the first is the smallest
            self.of.append(first.setdefault(text, row))
        self.reps = list(first.values())
        self.data, self.offsets = common.concatenated([self.texts[r] for r in self.reps])
        self.rep_ids = np.array([self.ids[r] for r in self.reps], np.int64)

    def rep_of(self, at: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.offsets, at, "right") - 1

    def place(self, at: np.ndarray) -> None:
        """Minimisers stand at these places; their grams, each once, by hash."""
        self.at, self.rep = at, self.rep_of(at)
        padded = np.concatenate([self.data, np.zeros(GRAM, np.uint8)])
        self.hash = _digest(_as_digits(np.lib.stride_tricks.sliding_window_view(padded, GRAM)[at])) if len(at) else np.zeros(0, np.uint64)
        self.grams, self.gram = np.unique(self.hash, return_inverse=True)
        self.bucket = (self.grams % np.uint64(self.buckets)).astype(np.int64)

    def gram_messages(self) -> dict[int, bytes]:
        self.place(anchors(self.data, self.offsets, self.width))
        order = np.lexsort((self.rep, self.gram))
        g, r = self.gram[order], self.rep[order]
        fresh = np.ones(len(g), bool)
        fresh[1:] = (g[1:] != g[:-1]) | (r[1:] != r[:-1])
        many = np.minimum(np.bincount(g[fresh], minlength=len(self.grams)), 255).astype(np.uint8)
        five = np.ascontiguousarray((self.grams // np.uint64(self.buckets))[:, None].view(np.uint8).reshape(-1, 8)[:, :5])
        out = {b: common.packed(five[idx], many[idx]) for b, idx in common.split_by(self.bucket, self.buckets)}
        gaps = np.diff(self.at, prepend=0)
        far = np.flatnonzero(gaps > 254)
        out[common.STATE] = common.packed(np.where(gaps > 254, 255, gaps).astype(np.uint8), gaps[far])
        return out

    def heard(self, replies: dict[int, bytes]) -> None:
        """Round 1's answers: 0 for grams of one text, 1 for repeated ones, 2 for hot ones."""
        short, far = common.unpacked(replies[common.STATE], np.uint8, np.int64)
        gaps = short.astype(np.int64)
        gaps[short == 255] = far
        self.place(np.cumsum(gaps))
        state = np.zeros(len(self.grams), np.uint8)
        for b, idx in common.split_by(self.bucket, self.buckets):
            state[idx] = np.frombuffer(replies[b], np.uint8)
        mine = state[self.gram]
        lo, hi = self.limits(self.at, self.rep)
        padded = np.concatenate([np.zeros(self.reach, np.uint8), self.data, np.zeros(self.width, np.uint8)])
        views = np.lib.stride_tricks.sliding_window_view(padded, self.reach + self.width)
        # contexts: all that a window around the gram can hold
        sel = np.flatnonzero(mine == 1)
        ctx = views[self.at[sel]].copy()
        place = np.arange(ctx.shape[1])
        ctx[(place < (self.reach - hi[sel])[:, None]) | (place >= (self.reach - lo[sel] + self.width)[:, None])] = 0
        limits = (lo[sel] | (hi[sel] << 8)).astype(np.uint16)
        label = common.msd_groups([self.hash[sel], limits.astype(np.uint64), *_as_digits(ctx)]) if len(sel) else np.zeros(0, np.int64)
        _, pick, c_of = np.unique(label, return_index=True, return_inverse=True)
        self.ctx = (limits[pick], ctx[pick], _least(self.rep_ids[self.rep[sel]], c_of, len(pick)))
        self.c_at, self.c_of, self.c_bucket = self.at[sel], c_of, (self.hash[sel][pick] % np.uint64(self.buckets)).astype(np.int64)
        # single windows of hot grams
        hot = np.flatnonzero(mine == 2)
        each = hi[hot] - lo[hot] + 1
        occ = np.repeat(hot, each)
        back = np.arange(len(occ)) - np.repeat(np.cumsum(each) - each, each) + lo[occ]
        self.w_start = np.unique(self.at[occ] - back)
        rows = views[self.w_start + self.reach][:, : self.width]
        digits = _as_digits(rows)
        label = common.msd_groups(digits) if len(rows) else np.zeros(0, np.int64)
        _, pick, self.w_of = np.unique(label, return_index=True, return_inverse=True)
        self.win = (rows[pick], _least(self.rep_ids[self.rep_of(self.w_start)], self.w_of, len(pick)))
        self.w_bucket = (_digest([d[pick] for d in digits]) % np.uint64(self.buckets)).astype(np.int64)

    def limits(self, at: np.ndarray, rep: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """How far before a gram a window that holds it may begin: at least, at most."""
        return np.maximum(0, at + self.width - self.offsets[rep + 1]), np.minimum(self.reach, at - self.offsets[rep])

    def window_messages(self) -> dict[int, bytes]:
        ctxs, wins = dict(common.split_by(self.c_bucket, self.buckets)), dict(common.split_by(self.w_bucket, self.buckets))
        none = np.zeros(0, np.int64)
        out = {b: common.packed(*[x[ctxs.get(b, none)] for x in self.ctx], *[x[wins.get(b, none)] for x in self.win]) for b in sorted({*ctxs, *wins})}
        if out:
            small = [x.astype(np.int32) for x in (np.diff(self.c_at, prepend=0), self.c_of, self.c_bucket, np.diff(self.w_start, prepend=0), self.w_of, self.w_bucket)]
            out[common.STATE] = common.packed(*small)
        return out

    def removed(self, replies: dict[int, bytes]) -> np.ndarray:
        """Starts of the windows that also start in a smaller document."""
        if not replies:
            return np.zeros(0, np.int64)
        gaps, c_of, c_bucket, w_gaps, w_of, w_bucket = (x.astype(np.int64) for x in common.unpacked(replies[common.STATE], *[np.int32] * 6))
        c_at, w_start = np.cumsum(gaps), np.cumsum(w_gaps)
        base, least = (np.full(len(x), 2**63 - 1, np.int64) for x in (c_bucket, w_bucket))
        odd: list[tuple] = []
        ctxs, wins, none = dict(common.split_by(c_bucket, self.buckets)), dict(common.split_by(w_bucket, self.buckets)), np.zeros(0, np.int64)
        for b in sorted({*ctxs, *wins}):
            mins, which, back, to, low = common.unpacked(replies[b], np.int64, np.int32, np.uint8, np.int64, np.int64)
            idx = ctxs.get(b, none)
            base[idx] = mins
            odd.append((idx[which], back, to))
            least[wins.get(b, none)] = low
        rep = self.rep_of(c_at)
        doc = self.rep_ids[rep]
        c_lo, c_hi = self.limits(c_at, rep)
        starts = []
        full = np.flatnonzero(base[c_of] < doc)
        for j in range(self.reach + 1):
            ok = full[(c_lo[full] <= j) & (j <= c_hi[full])]
            starts.append(c_at[ok] - j)
        o_ctx, o_back, o_to = (np.concatenate(x) for x in zip(*odd, strict=True))
        if len(o_ctx):
            order = np.argsort(o_ctx, kind="stable")
            o_ctx, o_back, o_to = o_ctx[order], o_back[order], o_to[order]
            lo, hi = np.searchsorted(o_ctx, c_of), np.searchsorted(o_ctx, c_of, "right")
            some = np.flatnonzero(hi > lo)
            n = (hi - lo)[some]
            occ = np.repeat(some, n)
            e = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo[some], n)
            ok = o_to[e] < doc[occ]
            starts.append(c_at[occ[ok]] - o_back[e[ok]].astype(np.int64))
        starts.append(w_start[least[w_of] < self.rep_ids[self.rep_of(w_start)]])
        return np.unique(np.concatenate(starts))


def _repeated(_ids: list[int], bodies: list[bytes]) -> list[bytes]:
    """Answers round 1: how many texts hold each gram, over all batches."""
    got = [common.unpacked(b, np.uint8, np.uint8) for b in bodies]
    values = np.concatenate([x[0] for x in got]).reshape(-1, 5)
    wide = np.zeros((len(values), 8), np.uint8)
    wide[:, :5] = values
    _, inverse = np.unique(wide.view(np.uint64).ravel(), return_inverse=True)
    total = np.bincount(inverse, np.concatenate([x[1] for x in got]).astype(float))
    state = np.where(total < 2, 0, np.where(total < HOT, 1, 2)).astype(np.uint8)[inverse]
    ends = np.cumsum([0, *[len(x[1]) for x in got]])
    return [state[ends[i] : ends[i + 1]].tobytes() for i in range(len(got))]


def _sorted_windows(width: int):
    reach = width - GRAM
    span = reach + width

    def answer(_ids: list[int], bodies: list[bytes]) -> list[bytes]:
        got = [common.unpacked(b, np.uint16, np.uint8, np.int64, np.uint8, np.int64) for b in bodies]
        limits, ctx, doc, rows, low = (np.concatenate(x) for x in zip(*got, strict=True))
        ctx, rows = ctx.reshape(-1, span), rows.reshape(-1, width)
        h = _digest(_as_digits(ctx[:, reach : reach + GRAM]))  # of the gram, which stands in the middle
        mins = np.full(len(h), 2**63 - 1, np.int64)
        odd_which, odd_back, odd_to = [np.zeros(0, np.int64)], [np.zeros(0, np.uint8)], [np.zeros(0, np.int64)]
        if len(h):
            same = common.msd_groups([h, limits.astype(np.uint64), *_as_digits(ctx)])
            _, pick, of = np.unique(same, return_index=True, return_inverse=True)
            least = _least(doc, of, len(pick))
            mins = least[of]
            # grams with different contexts: sort their windows to the full depth
            _, gram, n = np.unique(h[pick], return_inverse=True, return_counts=True)
            mixed = np.flatnonzero(n[gram] > 1)
            for part in _by_gram(mixed, gram):
                lo, hi = (limits[pick[part]] & 255).astype(np.int64), (limits[pick[part]] >> 8).astype(np.int64)
                each = np.maximum(hi - lo + 1, 0)
                c = np.repeat(np.arange(len(part)), each)
                back = np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each) + lo[c]
                if not len(c):
                    continue
                windows = np.lib.stride_tricks.sliding_window_view(ctx[pick[part]], width, axis=1)[c, reach - back]
                label = common.msd_groups([(gram[part[c]] << 8 | back).astype(np.uint64), *_as_digits(windows)])
                _, of_w = np.unique(label, return_inverse=True)
                w_least = _least(least[part[c]], of_w, of_w.max() + 1)
                better = np.flatnonzero(w_least[of_w] < least[part[c]])
                odd_which.append(part[c[better]])
                odd_back.append(back[better].astype(np.uint8))
                odd_to.append(w_least[of_w[better]])
            odd = np.concatenate(odd_which)
            order = np.argsort(odd, kind="stable")
            odd, backs, tos = odd[order], np.concatenate(odd_back)[order], np.concatenate(odd_to)[order]
        if len(low):
            label = common.msd_groups(_as_digits(rows))
            _, of_w = np.unique(label, return_inverse=True)
            low = _least(low, of_w, of_w.max() + 1)[of_w]
        out, at, at_w = [], 0, 0
        for x in got:
            n, w = len(x[0]), len(x[4])
            which, back, to = np.zeros(0, np.int32), np.zeros(0, np.uint8), np.zeros(0, np.int64)
            if n:
                mine = of[at : at + n]
                a, b = np.searchsorted(odd, mine), np.searchsorted(odd, mine, "right")
                c = b - a
                which = np.repeat(np.arange(n), c).astype(np.int32)
                e = np.arange(c.sum()) - np.repeat(np.cumsum(c) - c, c) + np.repeat(a, c)
                back, to = backs[e], tos[e]
            out.append(common.packed(mins[at : at + n], which, back, to, low[at_w : at_w + w]))
            at, at_w = at + n, at_w + w
        return out

    return answer


def _by_gram(rows: np.ndarray, gram: np.ndarray):
    """Rows in parts of about 20,000 that keep a gram together."""
    rows = rows[np.argsort(gram[rows], kind="stable")]
    g = gram[rows]
    start = 0
    while start < len(rows):
        end = min(len(rows), start + 20_000)
        end = int(np.searchsorted(g, g[end - 1], "right"))
        yield rows[start:end]
        start = end


def spans_of(starts: np.ndarray, width: int) -> np.ndarray:
    """Maximal runs [begin, end) that sorted window starts cover; runs that touch are one."""
    if not len(starts):
        return np.zeros((0, 2), np.int64)
    new = np.ones(len(starts), bool)
    new[1:] = starts[1:] > starts[:-1] + width
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(starts)) - 1
    return np.stack([starts[first], starts[last] + width], 1)


def repeated_spans(docs: DataFrame, width: int = 50, id_col: str = "doc_id", text_col: str = "text", carry: list[str] | None = None, as_text: bool = False) -> DataFrame:
    """Cuts every byte covered by a ``width``-byte string that also starts in a document of smaller id.

    Texts are UTF-8 bytes; null is the empty text; matches never cross
    documents; overlaps count; strings are judged on the input.  Returns a row
    per input row: doc_id, n_bytes, n_removed, spans (array of begin and end,
    in bytes), kept (binary; with ``as_text`` a string, without the rest of
    characters that a cut broke) and, if asked for, the struct ``carry`` of
    other columns.  Rows of one id are all judged by that id, so repeated rows do
    not cut each other; a null id counts as larger than any other.  Texts
    shorter than ``width`` stay.  An empty table gives an empty result.
    """
    if not GRAM < width <= 255:
        raise ValueError(f"width must be above {GRAM} and at most 255")
    rows = common.prepared(docs, id_col, text_col, carry)
    batches, buckets = common.sizes(common.text_bytes(rows))
    schema = "doc_id bigint, n_bytes bigint, n_removed bigint, spans array<struct<begin: bigint, end: bigint>>, kept " + ("string" if as_text else "binary")
    from pyspark.sql.types import StructType, _parse_datatype_string

    kind = StructType([*_parse_datatype_string(schema).fields, *([rows.schema["carry"]] if carry else [])])

    def emit_grams(table, _):
        return _Batch(table, width, buckets).gram_messages()

    def emit_windows(table, replies):
        batch = _Batch(table, width, buckets)
        batch.heard(replies[0])
        return batch.window_messages()

    def finish(table, replies):
        batch = _Batch(table, width, buckets)
        starts = batch.removed(replies.get(1, {}))
        ends = np.searchsorted(batch.rep_of(starts), np.arange(len(batch.reps) + 1))
        place = {r: k for k, r in enumerate(batch.reps)}
        spans, kept, gone = [], [], []
        for row, text in enumerate(batch.texts):
            r = batch.of[row]
            k = place[r]
            if batch.ids[row] > batch.ids[r]:  # a copy of a smaller document's whole text
                cut = np.array([[0, len(text)]]) if len(text) >= width else np.zeros((0, 2), np.int64)
            else:
                cut = spans_of(starts[ends[k] : ends[k + 1]] - batch.offsets[k], width)
            at, parts = 0, []
            for b, e in cut.tolist():
                parts.append(text[at:b])
                at = e
            parts.append(text[at:])
            kept.append(b"".join(parts))
            spans.append([{"begin": b, "end": e} for b, e in cut.tolist()])
            gone.append(int((cut[:, 1] - cut[:, 0]).sum()))
        out = [table["doc_id"], pa.array([len(t) for t in batch.texts], pa.int64()), pa.array(gone, pa.int64()), pa.array(spans, pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))), pa.array([k.decode("utf-8", "ignore") for k in kept], pa.string()) if as_text else pa.array(kept, pa.binary())]
        names = ["doc_id", "n_bytes", "n_removed", "spans", "kept"]
        return pa.table(out + ([table["carry"]] if carry else []), names=names + (["carry"] if carry else []))

    exchange = common.Exchange(rows, batches)
    grams = exchange.round(0, emit_grams, _repeated)
    return exchange.finish(finish, kind, exchange.round(1, emit_windows, _sorted_windows(width), grams))


def op10_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    cut = repeated_spans(common.reading(spark, sf_dir, "documents"))
    return cut.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("bigint").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
