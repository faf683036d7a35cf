"""Byte-level BPE with content-defined chunk reuse.

A rolling hash over 16 bytes cuts a text into chunks; the cuts depend on the
bytes around them alone, so a passage that documents share gives the same
chunks wherever it stands, and each is encoded once a task.  What chunks say
of the bytes at their joins need not hold, so each join is repaired: the last
piece of one chunk and the first of the next (from one place between a
printable character and a white space to the next, where the pre-tokenizer
begins anew) are encoded again together with what lies between, and stand only
if the identifiers at both ends are exactly those that the chunks have there.
If they are not, the join grows by another piece on either side, and by whole
chunks where a chunk has no pieces left.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeloom.llm import common

SPECIAL, SPECIAL_ID = "<|endoftext|>", 50256
#: One cut in about so many places; the most bytes of a chunk; bytes of text that a task keeps encoded.
CHUNK, LONGEST, KEPT = 256, 4096, 24 << 20


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _ranks(path: str) -> dict[bytes, int]:
    """Token bytes to ids, from a tokenizers file of byte-level BPE or a file of ranks."""
    if path.endswith(".tiktoken"):
        with open(path, "rb") as f:
            return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    import json

    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that stand for themselves
    byte_of = {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in set(plain))}
    with open(path, encoding="utf-8") as f:
        model = json.load(f)
    special = {t["content"] for t in model.get("added_tokens", [])}
    return {bytes(byte_of[c] for c in token): i for token, i in model["model"]["vocab"].items() if token not in special}


class Codec:
    """Encodes and decodes as the tokenizers library does with the same file."""

    def __init__(self, path: str, special: bool = True):
        import tiktoken
        from public_tokenizers import PATTERN

        ranks = _ranks(path)
        self.plain = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.table: list[bytes] = [b""] * (max([*ranks.values(), SPECIAL_ID]) + 1)
        for token, i in ranks.items():
            self.table[i] = token
        self.table[SPECIAL_ID] = SPECIAL.encode()
        self.special = special
        self.middles: dict[bytes, tuple] = {}
        self.joins: dict[bytes, np.ndarray] = {}
        self.held = 0
        self.hits = self.misses = 0

    def forget(self) -> None:
        """Drops what a task kept."""
        self.middles.clear()
        self.joins.clear()
        self.held = 0
        common.release()

    def _plain(self, data: bytes) -> np.ndarray:
        return np.array(self.plain.encode_ordinary(data.decode("utf-8", "replace")), np.uint32)

    def _keep(self, size: int) -> None:
        self.held += size
        if self.held > KEPT:
            self.middles.clear()
            self.joins.clear()
            self.held = size

    def _chunk(self, data: bytes) -> tuple[bytes, list[bytes], list[np.ndarray], bytes]:
        """Bytes before the first piece, pieces at the front and the back, the identifiers of them and of all between, and bytes after the last piece.

        A chunk of few pieces has none in the middle: it is all join.
        """
        if (got := self.middles.get(data)) is not None:
            self.hits += 1
            return got
        self.misses += 1
        x = np.frombuffer(data, np.uint8)
        space = (x[1:] == 32) | ((x[1:] >= 9) & (x[1:] <= 13))
        points = np.flatnonzero(space & (x[:-1] > 32) & (x[:-1] < 127)) + 1
        if len(points) >= 3:
            a, b, y, z = (int(points[k]) for k in (0, 1, -2, -1))
            pieces = [data[a:b], data[y:z]]
            got = (data[:a], pieces, [self._join(pieces[0]), self._plain(data[b:y]) if y > b else np.zeros(0, np.uint32), self._join(pieces[1])], data[z:]) if y >= b else (data, [], [], b"")
        else:
            got = (data, [], [], b"")
        self._keep(2 * len(data) + 200)
        self.middles[data] = got
        return got

    def _join(self, data: bytes) -> np.ndarray:
        if (got := self.joins.get(data)) is None:
            got = self._plain(data)
            self._keep(2 * len(data) + 200)
            self.joins[data] = got
        return got

    def _repaired(self, left: tuple[bytes, np.ndarray] | None, between: bytes, right: tuple[bytes, np.ndarray] | None) -> np.ndarray | None:
        """Identifiers of what lies between two pieces, if encoding it with them gives exactly the pieces' own at the ends; else None."""
        ids = self._join((left[0] if left else b"") + between + (right[0] if right else b""))
        n, m = len(left[1]) if left else 0, len(right[1]) if right else 0
        if n + m > len(ids) or (n and not np.array_equal(ids[:n], left[1])) or (m and not np.array_equal(ids[len(ids) - m :], right[1])):
            return None
        return ids[n : len(ids) - m]

    def cuts(self, data: np.ndarray) -> np.ndarray:
        """Places where chunks end, by the hash of the 16 bytes before them; never inside a character."""
        h = data.astype(np.uint32) + np.uint32(1)
        power = 0x9E3779B1
        for span in (1, 2, 4, 8):
            g = h.copy()
            g[span:] = h[:-span] * np.uint32(power) + h[span:]
            h, power = g, power * power & 0xFFFFFFFF
        h ^= h >> np.uint32(15)
        at = np.flatnonzero((h * np.uint32(0x85EBCA6B)) >> np.uint32(16) < 65536 // CHUNK) + 1
        at = at[at < len(data)]
        return at[(data[at] & 0xC0) != 0x80]

    def _section(self, data: bytes) -> list[np.ndarray]:
        """Identifiers, chunk by chunk; ``open_`` is what follows the last piece, ``left``."""
        if not data:
            return []
        at, parts, open_, left = 0, [], b"", None
        for end in [*self.cuts(np.frombuffer(data, np.uint8)).tolist(), len(data)]:
            while at < end:
                stop = min(end, at + LONGEST)
                while stop < end and (data[stop] & 0xC0) == 0x80:
                    stop += 1
                chunk, at = data[at:stop], stop
                head, pieces, ids, tail = self._chunk(chunk)
                between = self._repaired(left, open_ + head, (pieces[0], ids[0])) if pieces else None
                if between is not None:
                    parts += [between, *ids]
                    left, open_ = (pieces[1], ids[2]), tail
                    continue
                if pieces and left:  # no agreement: the piece before is part of the join
                    parts.pop()
                    left, open_ = None, left[0] + open_
                open_ += chunk  # the join grows by this chunk
        last = self._repaired(left, open_, None)
        if last is None:
            parts.pop()
            last = self._join(left[0] + open_)
        return [*parts, last]

    def encode(self, data: bytes) -> np.ndarray:
        if self.special and SPECIAL.encode() in data:
            parts = []
            for k, section in enumerate(data.split(SPECIAL.encode())):
                parts += [np.array([SPECIAL_ID], np.uint32)] * bool(k) + self._section(section)
        else:
            parts = self._section(data)
        return np.concatenate(parts) if parts else np.zeros(0, np.uint32)

    def decode(self, ids: np.ndarray) -> bytes:
        """UTF-8 of the text; bytes that are none become the replacement character."""
        table = self.table
        data = b"".join([table[i] for i in ids.tolist()])
        return data.decode("utf-8", "replace").encode()


_CODECS: dict[tuple, Codec] = {}


def codec(path: str, special: bool = True) -> Codec:
    """One codec for each worker process and file."""
    if (path, special) not in _CODECS:
        _CODECS[path, special] = Codec(path, special)
    return _CODECS[path, special]


def encode(docs: DataFrame, vocabulary: str | None = None, special: bool = True, id_col: str = "doc_id", text_col: str = "text", carry: list[str] | None = None) -> DataFrame:
    """Token ids of whole texts: doc_id, n_tokens, ids (binary, little-endian unsigned 32-bit) and the struct ``carry``.

    A null text is the empty text and has no tokens; rows are independent, so
    repeated rows give repeated results.  With ``special``, the end-of-text
    string in a text becomes its own id, as the tokenizers library does by
    default; without, it is ordinary text.
    """
    rows, path = common.prepared(docs, id_col, text_col, carry), vocabulary or default_vocabulary()
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType, _parse_datatype_string

    kind = StructType([*_parse_datatype_string("doc_id bigint, n_tokens bigint, ids binary").fields, *([rows.schema["carry"]] if carry else [])])
    target = to_arrow_schema(kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path, special)
        for batch in batches:
            for start in range(0, batch.num_rows, 1024):
                part = batch.slice(start, 1024)
                ids = [c.encode(t) for t in part.column("text").cast(pa.binary()).to_pylist()]
                cols = [part.column("doc_id"), pa.array([len(i) for i in ids], pa.int64()), pa.array([i.astype("<u4").tobytes() for i in ids], pa.binary())]
                cols += [part.column("carry")] if carry else []
                yield pa.RecordBatch.from_arrays([a.cast(f.type) for a, f in zip(cols, target, strict=True)], schema=target)
        c.forget()

    return rows.mapInArrow(run, kind)


def decode(encoded: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """Adds ``decoded``, the text of ``ids``; null ids are no tokens."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StringType, StructType

    path = vocabulary or default_vocabulary()
    kind = StructType([*encoded.schema.fields]).add("decoded", StringType())
    target = to_arrow_schema(kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for batch in batches:
            texts = [c.decode(np.frombuffer(i or b"", "<u4")) for i in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([*[a.cast(f.type) for a, f in zip(batch.columns, target, strict=False)], pa.array(texts, pa.binary()).cast(target[-1].type)], schema=target)

    return encoded.mapInArrow(run, kind)


def op3_bpe(spark, sf_dir: str) -> DataFrame:
    coded = decode(encode(common.reading(spark, sf_dir, "documents")))
    return coded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))
