"""Tokens: op3, op6 and op8 against the libraries themselves on awkward texts."""

import base64
import hashlib
import random
import struct
import zlib

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from tokenizers import Tokenizer

from stavelake.llm import binary_records, duck_bpe, token_count
from stavelake.llm.common import work_dir

random.seed(7)
ALPHABET = ["a", "the", " ", "  ", "\n", "\t", "\r\n", "é", "é", "ß", "Σ", "ΑΣ", "İ", "'s", "'LL", "12", "³", "，", "<|endoftext|>", "<|start", "\x1c", "\x85", " ", " ", "👩‍👩‍👧", "�", "word-", "x" * 30, "aaaa", "\x00", "́", "Ǆ", "﻿", "क़", "ǰ", "J̌", "각", "ﬁ", "ſ"]
ODD = [None, "", " ", "\n\n", "<|endoftext|>", "a" * 3000, " " * 2500, "0" * 1500, "ab" * 900 + "c", *("".join(random.choices(ALPHABET, k=random.randint(1, 60))) for _ in range(300))]
ODD += ["".join(random.choices("abcdeghinorst", k=1400)), ODD[20], ODD[20]]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i if i != 7 else None, t, "clash", 1) for i, t in enumerate(ODD)], "doc_id long, text string, ids string, n_tokens int").repartition(3)


def key(i):
    return i if i != 7 else None


def test_records_round_trip(spark, docs):
    tok = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    got = {r.doc_id: r for r in binary_records.record_round_trip(spark, docs, P.path("word_bpe_49k.json")).collect()}
    start = 0
    for i in sorted(range(len(ODD)), key=lambda i: (key(i) is not None, i)):
        ids = [*tok.encode(ODD[i] or "", add_special_tokens=False).ids, 2]
        r = got[key(i)]
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())), repr(ODD[i])
        start += len(ids)


def test_records_damage_and_shuffled_reads(spark, docs, tmp_path):
    manifest = binary_records.write_records(docs.filter("doc_id < 20"), P.path("word_bpe_49k.json"), str(tmp_path), 2)
    row = max((r.asDict() for r in manifest.collect()), key=lambda r: r["records"])
    straight = list(binary_records.read_shard(row))
    back = list(binary_records.read_shard(row, list(range(row["records"]))[::-1]))[::-1]
    assert [(a, b, list(c)) for a, b, c in straight] == [(a, b, list(c)) for a, b, c in back]
    data = bytearray(open(row["file"], "rb").read())
    data[30] ^= 1
    open(row["file"], "wb").write(data)
    with pytest.raises(ValueError, match="damaged"):
        list(binary_records.read_shard(row))
    assert binary_records.masked(b"") == 0xA282EAD8 and struct.calcsize("<qQQ") == 24


def test_duck_bpe_is_tiktoken(docs):
    path = P.path("byte_bpe_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = {r.doc_id: r for r in duck_bpe.encode_documents(docs, path, P.PATTERN).collect()}
    for i, t in enumerate(ODD):
        ids = enc.encode_ordinary(t or "")
        r = got[key(i)]
        assert r.ids == " ".join(map(str, ids)) and r.n_tokens == len(ids), repr(t)
        assert bytes(r.decoded) == (t or "").encode() and r.decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest()


@pytest.mark.parametrize("chunk,overlap", [(1 << 16, 512), (64, 24), (200, 8), (40, 39)])
def test_counts_resynchronise(chunk, overlap):
    tok = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    counter = token_count.counter(P.path("byte_bpe_50k.json"))
    texts = [t or "" for t in ODD] + ["".join(random.choices(ALPHABET, k=2000)) for _ in range(20)]
    assert counter.count(texts, chunk, overlap) == [len(tok.encode(t, add_special_tokens=False).ids) for t in texts]


def test_counts_frame_and_sentencepiece(spark, docs):
    import sentencepiece

    tok = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    got = {r.doc_id: (r.n_bytes, r.n_tokens) for r in token_count.count_tokens(docs, P.path("byte_bpe_50k.json")).collect()}
    assert got == {key(i): (len((t or "").encode()), len(tok.encode(t or "").ids)) for i, t in enumerate(ODD)}
    sp = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    assert token_count.counter(P.path("piece_bpe_32k.model")).count(["", "a b  c"]) == [len(sp.encode(x)) for x in ("", "a b  c")]


def test_empty_tables(spark, docs):
    none = docs.limit(0)
    assert binary_records.record_round_trip(spark, none, P.path("word_bpe_49k.json")).count() == 0
    assert duck_bpe.encode_documents(none, P.path("byte_bpe_50k.tiktoken"), P.PATTERN).count() == 0
    assert token_count.count_tokens(none, P.path("byte_bpe_50k.json")).count() == 0
    assert work_dir(spark, "x").startswith(spark.conf.get("spark.checkpoint.dir"))
