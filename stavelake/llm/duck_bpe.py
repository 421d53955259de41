"""Byte-level BPE in DuckDB: encoding by recursive queries, decoding by ordered aggregation.

A text is cut by the tokenizer's pattern.  Words that a worker has not met go, as rows (word, position, token) of single
bytes, into a recursive query: each round joins neighbouring tokens with the merge table and contracts, in each word,
the leftmost pair of least rank; a word leaves the recursion when no pair of it is in the table.  A word that is itself
in the vocabulary is that token.  Ids turn back into bytes by an aggregation ordered by position.  Each worker has one
in-memory database with one thread, fixed memory and no temporary folder.

Rounds of a word keep all their rows, n²/2 for n bytes, so words of over ``LONG`` bytes run round by round in a table
that holds only the last state; there a round contracts all places of the least pair where that provably gives the same
as one at a time.

Defined results: null and empty texts have no tokens and decode to nothing; rows that repeat are encoded each; special
strings are ordinary text; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import duckdb
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from stavelake.llm.common import lean, resident

LONG = 512
#: Characters of texts that are encoded together.
GROUP = 3 << 19
#: Words in a recursive query, and words that a worker remembers (the older half goes when it is full).
BATCH, CACHE = 40_000, 1_400_000

ENCODE = """
with recursive state as (
  select 0 as round, word, pos, tok, lead(tok) over w as after, lead(pos) over w as next
  from start window w as (partition by word order by pos)
  union all
  select round, word, pos, tok, lead(tok) over w as after, lead(pos) over w as next from (
    with paired as (
      select s.word, m.id::bigint * 1048576 + s.pos * 1024 + s.next as pick
      from state s join merges m on m.pair = s.tok::bigint * 1048576 + s.after
    ), best as (
      select word, min(pick) as pick from paired group by word
    )
    select s.round + 1 as round, s.word, s.pos,
      case when s.pos = (b.pick // 1024) % 1024 then (b.pick // 1048576)::int else s.tok end as tok
    from state s join best b using (word) where s.pos <> b.pick % 1024
  ) window w as (partition by word order by pos)
), last as (
  select word, max(round) as round from state group by word
)
select word, tok from state join last using (word, round) order by word, pos
"""

DECODE = """
select word, unhex(string_agg(v.hex, '' order by pos)) as piece from ids join vocab v using (tok) group by word
"""

ROUND = """
select n, pos, tok, id from (
  select row_number() over (order by pos) as n, pos, tok, lead(tok) over (order by pos) as after from long_state
) s join merges m on m.pair = s.tok::bigint * 1048576 + s.after
"""


class DuckBpe:
    def __init__(self, path: str, pattern: str, cache: int = CACHE, batch: int = BATCH):
        self.cache, self.batch = cache, batch
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        pairs = {}
        for piece, i in self.ranks.items():
            for k in range(1, len(piece)):
                l, r = self.ranks.get(piece[:k]), self.ranks.get(piece[k:])
                if l is not None and r is not None:
                    pairs[l << 20 | r] = i
        self.pattern = regex.compile(pattern)
        self.byte = np.array([self.ranks[bytes([b])] for b in range(256)], np.int32)
        self.con = duckdb.connect(":memory:", config={"threads": 1, "memory_limit": "300MB", "temp_directory": ""})
        self._table("merges", pair=pa.array(pairs, pa.int64()), id=pa.array(pairs.values(), pa.int32()))
        self._table("vocab", tok=pa.array(self.ranks.values(), pa.int32()), hex=[p.hex() for p in self.ranks])
        self.pairs = pairs
        self.new: dict[str, tuple[str, bytes]] = {}
        self.old: dict[str, tuple[str, bytes]] = {}

    def _table(self, name: str, **columns) -> None:
        given = pa.table(columns)
        self.con.register("given", given)
        self.con.execute(f"create or replace table {name} as select * from given")
        self.con.unregister("given")

    def _rows(self, pieces: list[bytes]) -> pa.Table:
        sizes = np.array([len(p) for p in pieces])
        joined = np.frombuffer(b"".join(pieces), np.uint8)
        words = np.repeat(np.arange(len(pieces), dtype=np.int32), sizes)
        pos = (np.arange(len(joined)) - np.repeat(np.cumsum(sizes) - sizes, sizes)).astype(np.int32)
        return pa.table({"word": words, "pos": pos, "tok": self.byte[joined]})

    def _short(self, pieces: list[bytes]) -> list[list[int]]:
        self.con.register("start", self._rows(pieces))
        out = self.con.sql(ENCODE).to_arrow_table()
        ends = np.searchsorted(out["word"].to_numpy(), np.arange(1, len(pieces)))
        return [x.tolist() for x in np.split(out["tok"].to_numpy(), ends)]

    def _long(self, piece: bytes) -> list[int]:
        rows = self._rows([piece])
        pos, tok = rows["pos"].to_numpy(), rows["tok"].to_numpy()
        while True:
            self.con.register("long_state", pa.table({"pos": pos, "tok": tok}))
            hits = self.con.execute(f"with h as ({ROUND}) select n - 1 as n, id from h where id = (select min(id) from h) order by n").fetchnumpy()
            at = np.asarray(hits["n"], np.int64)
            if not len(at):
                return tok.tolist()
            rank = int(hits["id"][0])
            # of overlapping places, every second from the left
            run = np.cumsum(np.r_[0, np.diff(at) != 1])
            at = at[(np.arange(len(at)) - np.searchsorted(run, run)) % 2 == 0]
            for chosen in (at, at[:1]):
                new = tok.copy()
                new[chosen] = rank
                keep = np.ones(len(tok), bool)
                keep[chosen + 1] = False
                left = int(tok[chosen[0]])
                state = new[keep]
                if len(chosen) == 1:
                    break
                places = np.flatnonzero(state == rank)
                near = {(int(state[p - 1]), rank) for p in places if p} | {(rank, int(state[p + 1])) for p in places if p + 1 < len(state)} | {(rank, left)}
                if all(self.pairs.get(a << 20 | b, rank + 1) > rank for a, b in near):
                    break
            pos, tok = pos[keep], state

    def encode_words(self, pieces: list[bytes]) -> list[list[int]]:
        """Ids of distinct words."""
        out: list = [[self.ranks[p]] if p in self.ranks else None for p in pieces]
        short = [i for i, p in enumerate(pieces) if out[i] is None and len(p) <= LONG]
        begin = total = 0
        for k, i in enumerate([*short, None]):
            total += len(pieces[i]) ** 2 if i is not None else 0
            if k > begin and (i is None or k - begin == self.batch or total > 75 * self.batch):
                for j, ids in zip(short[begin:k], self._short([pieces[j] for j in short[begin:k]]), strict=True):
                    out[j] = ids
                begin, total = k, len(pieces[i]) ** 2 if i is not None else 0
        for i, ids in enumerate(out):
            if ids is None:
                out[i] = self._long(pieces[i])
        return out

    def decode_words(self, ids: list[list[int]]) -> list[bytes]:
        sizes = np.array([len(x) for x in ids])
        words = np.repeat(np.arange(len(ids), dtype=np.int32), sizes)
        flat = np.fromiter((t for x in ids for t in x), np.int32, int(sizes.sum()))
        self.con.register("ids", pa.table({"word": words, "pos": np.arange(len(flat)), "tok": flat}))
        out = self.con.sql(DECODE).to_arrow_table()
        got = dict(zip(out["word"].to_pylist(), out["piece"].to_pylist(), strict=True))
        return [got.get(i, b"") for i in range(len(ids))]

    def known(self, texts: list[list[str]]) -> dict[str, tuple[str, bytes]]:
        """For each distinct word: its ids in decimal, and what they decode to."""
        words = set().union(*texts) if texts else set()
        found = {w: x for w in words if (x := self.new.get(w) or self.old.get(w))}
        missing = [w for w in words if w not in found]
        for k in range(0, len(missing), self.batch):
            part = missing[k : k + self.batch]
            ids = self.encode_words([w.encode() for w in part])
            found.update({w: (" ".join(map(str, x)), piece) for w, x, piece in zip(part, ids, self.decode_words(ids), strict=True)})
        if len(self.new) > self.cache // 2:
            self.old, self.new = self.new, {}
        self.new.update(found)
        return found

    def split(self, text: str) -> list[str]:
        return self.pattern.findall(text)


def bpe(path: str, pattern: str, cache: int = CACHE, batch: int = BATCH) -> DuckBpe:
    return resident(("bpe", path, pattern, cache, batch), lambda: DuckBpe(path, pattern, cache, batch))


def encode_documents(docs: DataFrame, ranks: str, pattern: str, with_ids: bool = True, cache: int = CACHE, batch: int = BATCH, with_decoded: bool | None = None, group: int = GROUP, lasting: bool = True) -> DataFrame:
    """(doc_id, n_tokens, ids, ids_sha256, decoded, decoded_sha256); ``ids`` (decimal, by spaces) and ``decoded`` are null
    without ``with_ids`` and ``with_decoded`` (as ``with_ids`` unless given).  No shuffle; a worker's memory is bounded by its
    cache and one group of texts, and outlives its task only if ``lasting``."""
    with_decoded = with_ids if with_decoded is None else with_decoded

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = bpe(ranks, pattern, cache, batch) if lasting else DuckBpe(ranks, pattern, cache, batch)
        names = ["doc_id", "n_tokens", "ids", "ids_sha256", "decoded", "decoded_sha256"]
        types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.binary(), pa.string()]

        def flush(keys: list, texts: list[str]) -> pa.RecordBatch:
            split = [coder.split(t) for t in texts]
            known = coder.known(split)
            rows = []
            for key, words in zip(keys, split, strict=True):
                found = [known[w] for w in words]
                ids = " ".join([x[0] for x in found])
                data = b"".join([x[1] for x in found])
                rows.append((key, ids.count(" ") + bool(ids), ids if with_ids else None, hashlib.sha256(ids.encode()).hexdigest(), data if with_decoded else None, hashlib.sha256(data).hexdigest()))
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)

        keys, texts, size = [], [], 0
        for rows_in in batches:
            for key, text in zip(rows_in.column(0).to_pylist(), rows_in.column(1), strict=True):
                text = text.as_py() or ""
                keys.append(key)
                texts.append(text)
                size += len(text)
                if size > group:
                    yield flush(keys, texts)
                    keys, texts, size = [], [], 0
        if keys:
            yield flush(keys, texts)

    schema = "doc_id long, n_tokens long, ids string, ids_sha256 string, decoded binary, decoded_sha256 string"
    return docs.select("doc_id", "text").mapInArrow(lean(run, keep=lasting), schema)
