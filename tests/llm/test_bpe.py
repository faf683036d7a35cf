"""Chunked encoding against the tokenizers library, and token counts against brute force."""

import random

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from lakeloom.llm import bpe, token_counts


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    t.no_truncation()
    t.no_padding()
    return t


TEXTS = ["", None, " ", "\n\n  x", "a" * 9000, " " * 5000, "é" * 3000, "日本語の文章です。" * 300, "x y  z" * 200, "I'm here, they'll go" * 300, "end<|endoftext|> of<|endoftext|><|endoftext|>", "tab\tnew\r\nline  two   three\n\n\n" * 100, "\x85\x1c a\x1fb" * 300, "😀👍🏽 ok" * 200, "no-break" * 1000, "12345678901234567890 " * 100]


def random_texts(seed):
    r = random.Random(seed)
    bits = ["the ", "of", " ", "\n", "  ", "é", "ß", "日", "'s", "'ll", "!", "###", "12", "3", "word", "Longer", "\t", ". ", " ", "<|endoftext|>", "<|endof"]
    shared = "".join(r.choice(bits) for _ in range(2000))
    return ["".join(r.choice(bits) for _ in range(r.randint(0, 3000))) + shared[r.randint(0, 400):] for _ in range(30)]


def test_codec_equals_the_library(library):
    c = bpe.Codec(bpe.default_vocabulary())
    for t in [*(x or "" for x in TEXTS), *random_texts(1)]:
        ids = c.encode(t.encode())
        assert ids.tolist() == library.encode(t, add_special_tokens=False).ids
        assert c.decode(ids).decode() == library.decode(ids.tolist(), skip_special_tokens=False) == t
    assert c.hits > 50


def test_cache_may_overflow(monkeypatch, library):
    monkeypatch.setattr(bpe, "KEPT", 2000)
    c = bpe.Codec(bpe.default_vocabulary())
    for t in random_texts(2):
        assert c.encode(t.encode()).tolist() == library.encode(t, add_special_tokens=False).ids


def test_joins_grow_until_identifiers_agree(library, monkeypatch):
    """Where chunks give wrong identifiers at their ends, joins do not stand on them."""
    c = bpe.Codec(bpe.default_vocabulary())
    text = "".join(random_texts(3)).encode()
    want = c.encode(text).tolist()
    assert want == library.encode(text.decode(), add_special_tokens=False).ids
    honest, wrong = bpe.Codec._chunk, []

    def spoiled(self, data):
        head, pieces, ids, tail = honest(self, data)
        if pieces and len(data) % 3 == 0:
            wrong.append(data)
            ids = [ids[0] + np.uint32(1), ids[1], ids[2]]  # as if the first piece were something else
        return head, pieces, ids, tail

    monkeypatch.setattr(bpe.Codec, "_chunk", spoiled)
    assert bpe.Codec(bpe.default_vocabulary()).encode(text).tolist() == want and len(wrong) > 20


def test_decode_of_broken_utf8(library):
    c = bpe.codec(bpe.default_vocabulary())
    ids = library.encode("é", add_special_tokens=False).ids + library.encode("日本").ids[:1]
    assert c.decode(np.array(ids, np.uint32)).decode() == library.decode(ids, skip_special_tokens=False)


def test_query(spark, sf, library):
    import hashlib

    got = {r.doc_id: r for r in __import__("lakeloom.llm.queries", fromlist=["QUERIES"]).QUERIES["op3_bpe"](spark, sf).collect()}
    for r in spark.read.parquet(f"{sf}/documents.parquet").collect():
        ids = library.encode(r.text or "", add_special_tokens=False).ids
        g = got[r.doc_id]
        assert g.n_tokens == len(ids) and g.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert g.decoded_sha256 == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_rows_of_all_kinds(spark):
    df = spark.createDataFrame([(k, t, "x", 3) for k, t in enumerate(TEXTS)] + [(None, "a b", None, None), (1, None, "y", 4)], "doc_id bigint, text string, ids string, n_tokens int")
    got = bpe.decode(bpe.encode(df, carry=["ids", "n_tokens"])).collect()
    assert len(got) == len(TEXTS) + 2
    for r in got:
        assert r.decoded == ("a b" if r.doc_id is None else TEXTS[r.doc_id] or "")
    assert bpe.decode(bpe.encode(df.limit(0))).count() == 0


def brute(stream, sep):
    out, n = [], 0
    for x in stream:
        if x == sep:
            out.append((n, True))
            n = 0
        else:
            n += 1
    return out + ([(n, False)] if n else [])


@pytest.mark.parametrize("size", [1, 3, 7, 1000])
def test_token_counts_in_blocks(spark, size, monkeypatch):
    monkeypatch.setattr(token_counts, "RUN", 4)
    r = random.Random(size)
    files = {f"f{k}": [r.choice([9, 9, 1, 2, 3]) if k % 2 else r.choice([9] + [1] * 20) for _ in range(r.randint(0, 120))] for k in range(8)} | {"none": [], "ends": [9, 9], "open": [1, 2]}
    rows = [(f, b, bytes(np.array(s[b * size : (b + 1) * size], "<u2").tobytes())) for f, s in files.items() for b in range(max(1, -(-len(s) // size)))] + [("null", 0, None)]
    df = spark.createDataFrame(rows, "file string, block bigint, body binary")
    got = {}
    for x in sorted(token_counts.count_tokens(df, 9).collect()):
        got.setdefault(x.file, []).append((x.n_tokens, x.closed))
    assert got == {f: b for f, s in files.items() if (b := brute(s, 9))}


def test_flat_files(spark, tmp_path):
    r = random.Random(5)
    streams = {f"{k}.bin": [r.choice([7] + [1, 2, 3] * 3000) for _ in range(n)] for k, n in enumerate((0, 5, 100_000))}
    for name, s in streams.items():
        (tmp_path / name).write_bytes(np.array(s, "<u4").tobytes())
    got = {}
    for x in sorted(token_counts.count_tokens(token_counts.read_token_files(spark, f"file://{tmp_path}", "<u4"), 7, "<u4").collect()):
        got.setdefault(x.file.rsplit("/", 1)[1], []).append((x.n_tokens, x.closed))
    assert got == {f: b for f, s in streams.items() if (b := brute(s, 7))}


def test_files_of_many_ranges_and_runs(spark, tmp_path, monkeypatch):
    """Blocks of 8 ids, ranges of 4 blocks, runs of 64: both levels of the scan are at work, and documents cross all of them."""
    monkeypatch.setattr(token_counts, "BLOCK", 8)
    monkeypatch.setattr(token_counts, "RANGE", 4)
    r = random.Random(8)
    streams = {f"{k}.bin": [r.choice([7] + [1, 2, 3] * w) for _ in range(6000)] for k, w in enumerate((1, 10, 900))}
    for name, s in streams.items():
        (tmp_path / name).write_bytes(np.array(s, "<u2").tobytes())
    blocks = token_counts.read_token_files(spark, f"file://{tmp_path}")
    assert blocks.count() == 3 * 750 and 750 > 2 * token_counts.RUN
    monkeypatch.setattr(token_counts, "_by_range", lambda path: False)  # a store that only Spark reads
    whole = token_counts.read_token_files(spark, str(tmp_path))
    assert sorted(map(str, whole.collect())) == sorted(map(str, blocks.collect()))
    got = {}
    for x in sorted(token_counts.count_tokens(blocks, 7).collect()):
        got.setdefault(x.file.rsplit("/", 1)[1], []).append((x.n_tokens, x.closed))
    assert got == {f: b for f, s in streams.items() if (b := brute(s, 7))}


def test_written_files_are_flat_and_hold_all_kinds_of_texts(spark, tmp_path, library):
    texts = [None, "", "a b", "é" * 40_000, "x\ny\r\n\0z", "a b", "<|endoftext|>", "日本 \u2028 end"]
    df = spark.createDataFrame([(k // 2, t, 1, "s") for k, t in enumerate(texts)] + [(None, "n", 1, "s")], "doc_id bigint, text string, ids int, value string").repartition(3)
    df = spark.createDataFrame(df.collect(), df.schema)
    names = token_counts.write_token_files(df, str(tmp_path / "tokens"))
    library.encode_special_tokens = True
    want = [library.encode(r.text or "", add_special_tokens=False).ids for r in df.collect()]
    library.encode_special_tokens = False
    whole = b"".join(p.read_bytes() for p in sorted((tmp_path / "tokens").glob("part-*")))
    assert sorted("".join(map(str, [*w, bpe.SPECIAL_ID])) for w in want) == sorted("".join(map(str, x)) for x in cut(np.frombuffer(whole, "<u2").tolist()))
    assert names.count() == len(want) and sorted(str(r.doc_id) for r in names.collect()) == sorted(str(r.doc_id) for r in df.collect())
    none = df.limit(0)
    assert token_counts.write_token_files(none, str(tmp_path / "none")).count() == 0


def cut(stream):
    out, one = [], []
    for x in stream:
        one.append(x)
        if x == bpe.SPECIAL_ID:
            out.append(one)
            one = []
    return out


def test_token_count_query(spark, sf, library):
    library.encode_special_tokens = True
    got = {r.doc_id: r.n_tokens for r in token_counts.op1_token_counts(spark, sf).collect()}
    want = {r.doc_id: len(library.encode(r.text or "", add_special_tokens=False).ids) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    library.encode_special_tokens = False
    assert got == want
