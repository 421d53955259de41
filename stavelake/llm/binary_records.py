"""Token-ID output: length-delimited binary records with masked checksums and a separate offset index.

A shard ``part-NNNNN.rec`` starts with 16 bytes (magic ``SLTREC01``, id width 2 or 4 as u32, zero u32).  Each record is

    u64 length | u32 masked checksum of the length | payload | u32 masked checksum of the payload

little-endian; the payload is the document's ids at the given width.  The index ``part-NNNNN.idx`` has one entry of 28
bytes for each record: i64 doc_id (smallest i64: null), u64 offset of the record, u64 first token within the shard,
u32 checksum of the first 24 bytes.  A reader can thus seek to any document, and shuffle without a scan.

Defined results: null and empty texts give the end id alone; rows that repeat a doc_id are all written, in the order
of the hashes of their texts, so that they may spread over shards; a null doc_id sorts first; very long texts are encoded
whole; an empty table gives no shard.
"""

from __future__ import annotations

import os
import struct
import uuid
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stavelake.llm.common import lean, resident, settled, storage, stored, work_dir

MAGIC = b"SLTREC01"
NULL_ID = -(1 << 63)
#: Distinct words that a worker remembers: the last so many, and as many before them.
CACHE_WORDS = 600_000
STOPS = ".,;:!?"
#: Bytes of input to a shard, and shards at most (an estimate without files can be any number).
SHARD_BYTES, MOST_SHARDS = 128 << 20, 1_000_000


def masked(data: bytes) -> int:
    """CRC-32 turned right by 15 bits plus a constant, so that a checksum of checksums differs."""
    c = zlib.crc32(data)
    return ((c >> 15 | c << 17) + 0xA282EAD8) & 0xFFFFFFFF


class WordEncoder:
    """Ids of whole texts by the tokenizers library, one call for each distinct word.

    Valid only for tokenizers whose pre-tokenizer drops white space and never joins across it, and whose normalizer
    works on each character or on composed marks, which spaces and line feeds never take part in.  ``splits_words``
    checks that on the file's own description; others are encoded text by text.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import json

        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        said = json.loads(self.tok.to_str())
        self.by_word = splits_words(said)
        self.folds = "Lowercase" in json.dumps(said.get("normalizer"))
        self.dtype = np.dtype("<u2" if self.tok.get_vocab_size(with_added_tokens=True) <= 1 << 16 else "<u4")
        self.known: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.suffix = said["model"].get("end_of_word_suffix")
        if self.suffix:
            vocabulary = self.tok.get_vocab(with_added_tokens=True)
            self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
            self.ends[[i for t, i in vocabulary.items() if t.endswith(self.suffix)]] = True

    def _ids(self, texts: list[str]) -> list[bytes]:
        code = {2: "H", 4: "I"}[self.dtype.itemsize]
        return [array(code, e.ids).tobytes() for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)]

    def _letters(self, words: list[str]) -> list[bytes]:
        """Words of letters in one text: each is one pre-token, which ends with its only token that has the end mark."""
        e = np.array(self.tok.encode_batch_fast([" ".join(words)], add_special_tokens=False)[0].ids, self.dtype)
        cuts = np.flatnonzero(self.ends[e]) + 1
        if len(cuts) != len(words):  # a letter that the normalizer takes apart
            return self._ids(words)
        data, cuts = e.tobytes(), (cuts * self.dtype.itemsize).tolist()
        return [data[a:b] for a, b in zip([0, *cuts], cuts, strict=False)]

    def encode(self, texts: list[str]) -> list[bytes]:
        if not self.by_word:
            return self._ids(texts)
        split = [t.replace("\n", " ").split(" ") for t in texts]
        if not self.known or len(self.known) > CACHE_WORDS:
            self.old, self.known = self.known, {"": b"", **dict(zip(STOPS, self._ids(list(STOPS)), strict=True))}
        known = self.known
        self._learn(set().union(*split).difference(known))
        return [b"".join([known[w] for w in words]) for words in split]

    def _learn(self, new: set[str]) -> None:
        """A stop after a letter is a pre-token of its own, and letters of ASCII words fold as the normalizer folds them."""
        known, old, derived = self.known, self.old, []
        again = new & old.keys()
        known.update({w: old[w] for w in again})
        new -= again
        plain = {w for w in new if w.islower() and w.isalpha()}
        need = set(plain)
        for w in new - plain:
            word, stop = (w[:-1], w[-1]) if w[-1] in STOPS and w[-2:-1].isalpha() else (w, "")
            if self.folds and not word.islower() and word.isascii() and "<" not in word:
                word = word.lower()
            if word is not w:
                derived.append((w, word, stop))
            if word not in known:
                if word in old:
                    known[word] = old[word]
                else:
                    need.add(word)
        letters = [w for w in need if w in plain or w.isalpha()] if self.suffix else []
        for words, step, ids in ((letters, 1000, self._letters), (list(need.difference(letters)), 20_000, self._ids)):
            for k in range(0, len(words), step):
                known.update(zip(words[k : k + step], ids(words[k : k + step]), strict=True))
        for w, word, stop in derived:
            known[w] = known[word] + known[stop]


def splits_words(said: dict) -> bool:
    pre, norm = said.get("pre_tokenizer") or {}, said.get("normalizer") or {}
    first = (pre.get("pretokenizers") or [pre])[0]
    drops = first.get("type") == "Split" and first.get("invert") and first.get("behavior") == "Removed"
    pattern = (first.get("pattern") or {}).get("Regex", "")
    steps = norm.get("normalizers") or ([norm] if norm else [])
    plain = all(x["type"] in ("NFC", "Lowercase") or x["type"] == "Replace" and x["content"] == " " and x["pattern"] == {"Regex": "\\s+"} for x in steps)
    added = all(not (a["lstrip"] or a["rstrip"] or a["single_word"]) and not set(a["content"]) & {" ", "\n"} for a in said.get("added_tokens", []))
    parts = pattern.replace("[^\\s\\p{L}\\p{N}]", "P").replace("[\\p{L}]", "L").replace("[\\p{N}]", "N")
    spaceless = bool(pattern) and "\\s" not in parts and " " not in parts and "." not in parts
    return bool(drops and plain and added and spaceless)


def encoder(path: str) -> WordEncoder:
    return resident(("words", path), lambda: WordEncoder(path))


def _groups(batches: Iterator[pa.RecordBatch], limit: int = 4 << 20) -> Iterator[tuple[list, list[str]]]:
    ids, texts, size = [], [], 0
    for batch in batches:
        col = batch.column(1)
        for i, key in enumerate(batch.column(0).to_pylist()):
            text = col[i].as_py() or ""
            ids.append(key)
            texts.append(text)
            size += len(text)
            if size >= limit:
                yield ids, texts
                ids, texts, size = [], [], 0
    if ids:
        yield ids, texts


def write_records(docs: DataFrame, tokenizer: str, folder: str, end_id: int) -> DataFrame:
    """Writes (doc_id, text) in ascending doc_id order, a shard for each range of ids; returns the manifest.

    Manifest: shard (its rank in doc_id order), file, index, records, tokens.  Each attempt of a task writes under names
    of its own and only the manifest names files, so a lost executor leaves nothing that is read.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        store, base = storage(folder)
        shard = TaskContext.get().partitionId()
        end = np.array([end_id], enc.dtype).tobytes()
        out = None
        offset, tokens, records = 16, 0, 0
        name = f"part-{shard:05d}-{uuid.uuid4().hex}"
        for keys, texts in _groups(batches):
            if out is None:
                store.create_dir(base, recursive=True)
                out, index = store.open_output_stream(f"{base}/{name}.rec"), store.open_output_stream(f"{base}/{name}.idx")
                out.write(MAGIC + struct.pack("<II", enc.dtype.itemsize, 0))
            frames, entries = [], []
            for key, ids in zip(keys, enc.encode(texts), strict=True):
                payload = ids + end
                length = struct.pack("<Q", len(payload))
                entry = struct.pack("<qQQ", NULL_ID if key is None else key, offset, tokens)
                entries += [entry, struct.pack("<I", zlib.crc32(entry))]
                frames += [length, struct.pack("<I", masked(length)), payload, struct.pack("<I", masked(payload))]
                offset += 16 + len(payload)
                tokens += len(payload) // enc.dtype.itemsize
                records += 1
            out.write(b"".join(frames))
            index.write(b"".join(entries))
        if out is not None:
            out.close()
            index.close()
            yield pa.RecordBatch.from_pydict(
                {"shard": pa.array([shard], pa.int32()), "file": [f"{folder}/{name}.rec"], "index": [f"{folder}/{name}.idx"], "records": [records], "tokens": [tokens]}
            )

    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", text.alias("text"), F.xxhash64(text).alias("hash_"))
    ordered = rows.repartitionByRange(shards_for(docs), "doc_id", "hash_").sortWithinPartitions("doc_id", "hash_").select("doc_id", "text")
    return stored(ordered.mapInArrow(lean(write, keep=True), "shard int, file string, index string, records long, tokens long"), "rec-manifest")


def shards_for(docs: DataFrame, size: int = SHARD_BYTES) -> int:
    """Shards of about ``size`` bytes by the size of the files that are read, at least as many as shuffles have partitions."""
    files = float(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    least = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    return int(min(max(least, files // size), MOST_SHARDS))


def read_shard(manifest_row: dict, at: list[int] | None = None) -> Iterator[tuple[int | None, int, np.ndarray]]:
    """(doc_id, first token within the shard, ids) of a shard; of the records numbered in ``at``, in that order, if given."""
    store, path = storage(manifest_row["index"])
    with store.open_input_stream(path) as f:
        index = f.read()
    if len(index) % 28:
        raise ValueError(f"{manifest_row['index']}: cut index")
    store, path = storage(manifest_row["file"])
    with store.open_input_file(path) as f:
        head = f.read(16)
        if head[:8] != MAGIC:
            raise ValueError(f"{manifest_row['file']}: not a record shard")
        dtype = np.dtype({2: "<u2", 4: "<u4"}[struct.unpack("<I", head[8:12])[0]])
        place = 16
        for k in range(len(index) // 28) if at is None else at:
            entry = index[28 * k : 28 * k + 24]
            key, offset, first = struct.unpack("<qQQ", entry)
            if zlib.crc32(entry) != struct.unpack("<I", index[28 * k + 24 : 28 * k + 28])[0]:
                raise ValueError(f"{manifest_row['index']}: entry {k} is damaged")
            if offset != place:
                f.seek(offset)
            frame = f.read(12)
            length, check = struct.unpack("<QI", frame)
            if masked(frame[:8]) != check:
                raise ValueError(f"{manifest_row['file']}: length at {offset} is damaged")
            payload = f.read(length + 4)
            if masked(payload[:-4]) != struct.unpack("<I", payload[-4:])[0]:
                raise ValueError(f"{manifest_row['file']}: record at {offset} is damaged")
            place = offset + 16 + length
            yield None if key == NULL_ID else key, first, np.frombuffer(payload[:-4], dtype)


def read_records(manifest: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every record, checksums verified.  Shard starts are sums over the manifest."""
    shards = sorted((r.asDict() for r in manifest.collect()), key=lambda r: r["shard"])  # a row for each file
    starts, total = {}, 0
    for r in shards:
        starts[r["file"]] = total
        total += r["tokens"]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "start", "n_tokens", "ids_crc32"]
        for batch in batches:
            for row in batch.to_pylist():
                rows = []
                for key, first, ids in read_shard(row):
                    rows.append((key, row["start"] + first, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                    if len(rows) == 50_000:
                        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names)
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names)

    spark = manifest.sparkSession
    schema = "file string, index string, start long"
    files = spark.createDataFrame([(r["file"], r["index"], starts[r["file"]]) for r in shards], schema)
    return files.repartition(max(1, len(shards))).mapInArrow(lean(read, keep=True), "doc_id long, start long, n_tokens long, ids_crc32 long")


def record_round_trip(spark: SparkSession, docs: DataFrame, tokenizer: str, end_id: int = 2) -> DataFrame:
    """Documents written as records and read back; the records are deleted in the end."""
    folder = work_dir(spark, "records")
    manifest = write_records(docs, tokenizer, folder, end_id)
    return settled(read_records(manifest), "records-read", folder, manifest)
