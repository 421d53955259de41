"""Very long texts, long words and white space through every document operator."""

import hashlib
import random

import public_tokenizers as P
import pytest
from tokenizers import Tokenizer

from stavelake.llm import binary_records, decontam, duck_bpe, fingerprint, ngram_join, suffix_dedup, token_count, toxicity

random.seed(99)
SYLLABLES = ["tho", "ra", "ne", "mi", "lo", "ve", "ß", "é"]


@pytest.fixture(scope="module")
def texts():
    prose = " ".join("".join(random.choices(SYLLABLES, k=random.randint(1, 5))) for _ in range(60_000))
    return {1: prose, 2: prose[:200_000] + " x", 3: "a" * 30_000, 4: " " * 20_000 + "\n" * 20_000, 5: "ab" * 9_000, 6: "".join(random.choices("ACGT", k=2_000))}


@pytest.fixture(scope="module")
def docs(spark, texts):
    return spark.createDataFrame(list(texts.items()), "doc_id long, text string")


def test_tokens(docs, texts):
    gpt, word = Tokenizer.from_file(P.path("byte_bpe_50k.json")), Tokenizer.from_file(P.path("word_bpe_49k.json"))
    n = {i: len(gpt.encode(t, add_special_tokens=False).ids) for i, t in texts.items()}
    assert {r.doc_id: r.n_tokens for r in token_count.count_tokens(docs, P.path("byte_bpe_50k.json")).collect()} == n
    got = {r.doc_id: r for r in duck_bpe.encode_documents(docs, P.path("byte_bpe_50k.tiktoken"), P.PATTERN, with_ids=False).collect()}
    assert {i: r.n_tokens for i, r in got.items()} == n
    assert all(got[i].decoded_sha256 == hashlib.sha256(t.encode()).hexdigest() for i, t in texts.items())
    records = {r.doc_id: r.n_tokens for r in binary_records.record_round_trip(docs.sparkSession, docs, P.path("word_bpe_49k.json")).collect()}
    assert records == {i: len(word.encode(t, add_special_tokens=False).ids) + 1 for i, t in texts.items()}


def test_documents(spark, docs, texts):
    removed = {r.doc_id: (r.n_bytes, r.n_removed) for r in suffix_dedup.dedup_report(docs).collect()}
    size = {i: len(t.encode()) for i, t in texts.items()}
    assert all(removed[i][0] == size[i] for i in size)
    # white space runs repeat but for the windows over their border, which are unlike one another
    assert removed[3][1] == size[3] and removed[5][1] == size[5] and removed[4][1] == size[4] and removed[6][1] == 0
    assert removed[2][1] >= len(texts[2][:-2].encode()) and 0 < removed[1][1] < size[1]
    groups = {r.doc_id: r.group_id for r in ngram_join.jaccard_groups(docs).collect()}
    assert groups == {i: i for i in texts}
    prints = {r.doc_id: r for r in fingerprint.fingerprint_documents(docs).collect()}
    assert prints[2].near_next > 0.95 and all(r.n_chars == len(texts[i]) for i, r in prints.items())
    machine = toxicity.train(docs, spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, toxic int"))
    assert docs.select(toxicity.score_column(machine)).count() == len(texts)
    bench = spark.createDataFrame([(1, texts[1][100_000:100_400])], "item_id long, text string")
    assert {r.doc_id for r in decontam.leaks(docs, bench).collect()} == {1, 2}
