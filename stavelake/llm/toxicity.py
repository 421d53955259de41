"""Toxicity: a factorization machine over hashed terms.

Terms of a text are its distinct words (lower case, letters and digits) and the 4- to 6-letter beginnings of longer
words, hashed to ``BUCKETS``.  Of these the machine keeps at most ``FEATURES`` whose presence goes with the label, for toxic
or for clean, by the likelihood ratio G²: over all texts, or over the texts that hold one of the ``ANCHORS`` terms that are
first over all (the ``BESIDE`` best for each), so that terms that are harmless alone are kept for what they say beside another.  G² must be beyond what
chance gives the best of as many terms, or of as many pairs; terms over three times as frequent in toxic texts need three of
them only.  The score is

    sigmoid(w0 + sum_i w_i + sum_{i<j} <v_i, v_j>)      over the kept terms i, j present in the whole text,

so that pairs of terms (an insult with a group mention) count beyond their own weights.  Learning uses a bounded
sample, at most ``SAMPLE`` labelled rows by hash of their id; selection and scores cover whole texts, and every text is
scored.  Weights are the maximum a posteriori estimate under a normal prior, found by a fixed number of steps from a
fixed start, so that a model depends on the rows alone.

Defined results: null and empty texts have no terms and score sigmoid(w0); without labels of both kinds every score is
the (smoothed) share of toxic labels; a doc_id labelled twice is toxic if any label says so; a null label is none; rows
that repeat a text repeat its score; other columns pass.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stavelake.llm.common import discard, lean, release, stored, trim

BUCKETS, SAMPLE, FEATURES, FACTORS = 1 << 20, 16_384, 4096, 8
#: Terms beside which all others are weighed again, and how many each brings at most.
ANCHORS, BESIDE = 32, 16
#: Steps, and the strength of the priors of weights and of factors, which were chosen on a part of the rows not held out.
STEPS, PRIOR, PAIR_PRIOR = 300, 0.02, 2.0
SLICE = 1 << 18
WORD = re.compile(r"[^\W_]+")
#: Words without kept terms that a worker remembers.
CLEAN = 250_000


def terms(word: str) -> list[int]:
    """Buckets of a white-space delimited word."""
    out = []
    for w in WORD.findall(word.lower()):
        out.append(zlib.crc32(w.encode()) % BUCKETS)
        out += [zlib.crc32(b"^" + w[:n].encode()) % BUCKETS for n in (4, 5, 6) if len(w) > n]
    return out


@dataclass
class Machine:
    features: np.ndarray  # buckets, ascending
    bias: float
    weights: np.ndarray
    factors: np.ndarray

    def score(self, active: np.ndarray) -> float:
        """``active``: distinct positions in ``features``."""
        v = self.factors[active]
        pairs = 0.5 * float((v.sum(0) ** 2 - (v**2).sum(0)).sum()) if len(active) > 1 else 0.0
        return float(1 / (1 + np.exp(-np.clip(self.bias + self.weights[active].sum() + pairs, -500, 500))))


class Scorer:
    def __init__(self, machine: Machine):
        self.machine = machine
        self.place = {int(b): i for i, b in enumerate(machine.features)}
        self.clean: set[str] = set()
        self.hits: dict[str, tuple[int, ...]] = {}
        self.nothing = machine.score(np.empty(0, int))

    def active(self, text: str) -> set[int]:
        if len(self.clean) > CLEAN:
            self.clean = set()
        found: set[int] = set()
        for w in set(text.split()) - self.clean:
            got = self.hits.get(w)
            if got is None:
                got = tuple({self.place[b] for b in terms(w) if b in self.place})
                if got:
                    if len(self.hits) > CLEAN // 10:
                        self.hits = {}
                    self.hits[w] = got
                else:
                    self.clean.add(w)
            found.update(got)
        return found

    def __call__(self, text: str | None) -> float:
        found = self.active(text) if text else None
        return self.machine.score(np.fromiter(sorted(found), int)) if found else self.nothing


def fit(indptr: np.ndarray, indices: np.ndarray, label: np.ndarray, weight: np.ndarray, n_features: int, features: np.ndarray) -> Machine:
    """MAP estimate by Adam on all rows (bounded by ``SAMPLE``)."""
    rng = np.random.default_rng(17)
    share = (float((label * weight).sum()) + 0.5) / (float(weight.sum()) + 1)
    bias, w, v = np.log(share / (1 - share)), np.zeros(n_features), rng.normal(0, 0.05, (n_features, FACTORS))
    if not n_features or share * weight.sum() < 1 or (1 - share) * weight.sum() < 1:
        return Machine(features, float(bias), w, v * 0)
    # a row's terms, and a term's rows, in a stretch each; sums over stretches go in slices that bound the memory
    rows = np.repeat(np.arange(len(label)), np.diff(indptr))
    by_term = np.argsort(indices, kind="stable")
    places = np.r_[0, np.cumsum(np.bincount(indices, minlength=n_features))]
    state = [np.zeros(1), np.zeros(1), np.zeros_like(w), np.zeros_like(w), np.zeros_like(v), np.zeros_like(v)]

    def summed(x: np.ndarray, at: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """For each stretch of ``at`` the sum of those rows of ``x``."""
        out = np.zeros((len(bounds) - 1, x.shape[1]))
        begin = 0
        while begin < len(out):
            end = max(begin + 1, int(np.searchsorted(bounds, bounds[begin] + SLICE, side="right")) - 1)
            full = begin + np.flatnonzero(np.diff(bounds[begin : end + 1]))
            if len(full):
                out[full] = np.add.reduceat(x[at[bounds[begin] : bounds[end]]], bounds[full] - bounds[begin])
            begin = end
        return out

    row_bounds, rows_of_terms = np.asarray(indptr, np.int64), rows[by_term]
    for step in range(1, STEPS + 1):
        sums = summed(np.c_[v, (v**2).sum(1), w], indices, row_bounds)
        total = sums[:, :FACTORS]
        z = bias + sums[:, FACTORS + 1] + 0.5 * ((total**2).sum(1) - sums[:, FACTORS])
        error = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - label) * weight
        back = summed(np.c_[error[:, None] * total, error], rows_of_terms, places)
        e = back[:, FACTORS]
        slopes = [np.array([error.sum()]), e + PRIOR * w, back[:, :FACTORS] - e[:, None] * v + PAIR_PRIOR * v]
        rate = 0.1 * min(1.0, 2 * (1 - step / (STEPS + 1)))
        moved = []
        for k, (value, slope) in enumerate(zip((np.array([bias]), w, v), slopes, strict=True)):
            state[2 * k] = 0.9 * state[2 * k] + 0.1 * slope
            state[2 * k + 1] = 0.99 * state[2 * k + 1] + 0.01 * slope**2
            moved.append(value - rate * (state[2 * k] / (1 - 0.9**step)) / (np.sqrt(state[2 * k + 1] / (1 - 0.99**step)) + 1e-8))
        bias, w, v = float(moved[0][0]), moved[1], moved[2]
    return Machine(features, bias, w, v)


def _evidence(a: str, n: str, toxic: Column, clean: Column) -> Column:
    """Half of G² of a term in ``a`` of ``toxic`` texts and ``n - a`` of ``clean`` ones, smoothed."""
    a, b = F.col(a).cast("double"), (F.col(n) - F.col(a)).cast("double")
    p, q = (a + 0.5) / (toxic + 1), (b + 0.5) / (clean + 1)
    r = (a + b + 1) / (toxic + clean + 2)
    log = lambda x, k, y: k * F.log(x / y)
    return log(p, a, r) + log(1 - p, toxic - a, 1 - r) + log(q, b, r) + log(1 - q, clean - b, 1 - r)


def train(docs: DataFrame, labels: DataFrame, learnable: Column | None = None, sample: int = SAMPLE) -> Machine:
    """Learns from at most ``sample`` rows of ``labels`` (doc_id, toxic) for which ``learnable`` holds."""
    known = labels.filter("doc_id is not null and toxic is not null")
    if learnable is not None:
        known = known.filter(learnable)
    known = known.groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("label_"))
    known = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    texts = docs.select("doc_id", "text").join(F.broadcast(known), "doc_id").select("text", "label_")  # bounded by sample

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: dict[str, list[int]] = {}
        for batch in batches:
            out = []
            for text in batch.column(0):
                found: set[int] = set()
                for w in set((text.as_py() or "").split()):
                    got = cache.get(w)
                    if got is None:
                        got = cache[w] = terms(w)
                        if len(cache) > CLEAN // 5:
                            cache = {}
                    found.update(got)
                out.append(sorted(found))
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.list_(pa.int32())), batch.column(1)], ["terms", "label"])

    # rows that repeat a text count once
    rows = stored(texts.mapInArrow(lean(features), "terms array<int>, label int").groupBy(F.xxhash64("terms"), "label").agg(F.first("terms").alias("terms")).select("terms", "label"), "toxic-terms")
    totals = rows.agg(F.sum("label").alias("t"), F.count("label").alias("n")).first()
    toxic, clean = float(totals["t"] or 0), float(totals["n"] - (totals["t"] or 0))
    if not toxic or not clean:
        share = (toxic + 0.5) / (toxic + clean + 1)
        return Machine(np.empty(0, np.int64), float(np.log(share / (1 - share))), np.zeros(0), np.zeros((0, FACTORS)))
    counts = rows.select(F.explode("terms").alias("term"), "label").groupBy("term").agg(F.sum("label").alias("a"), F.count("label").alias("n"))
    a, b = F.col("a").cast("double"), (F.col("n") - F.col("a")).cast("double")
    lifted = (a >= 3) & ((a + 0.5) / (toxic + 1) > 3 * (b + 0.5) / (clean + 1))
    own = stored(counts.select("term", "a", "n", lifted.alias("lifted"), _evidence("a", "n", F.lit(toxic), F.lit(clean)).alias("g2")), "toxic-counts")
    chance = float(np.log(max(own.count(), 1)))  # of G² halved, as _evidence has it
    anchors = {int(r["term"]): (float(r["a"]), float(r["n"] - r["a"])) for r in own.orderBy(F.col("g2").desc(), "term").limit(ANCHORS).collect()}

    def beside(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(anchor, term, a, n) over the texts that hold both."""
        for batch in batches:
            listed, label = batch.column(0), np.asarray(batch.column(1).to_numpy(zero_copy_only=False), np.int64)
            flat = listed.flatten().to_numpy().astype(np.int64)
            row = np.repeat(np.arange(len(label)), np.diff(listed.offsets.to_numpy()))
            coded = flat * 2 + label[row]
            for k in anchors:
                held = np.zeros(len(label), bool)
                held[row[flat == k]] = True
                found, n = np.unique(coded[held[row]], return_counts=True)
                if len(found):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(found), k, np.int32)), pa.array((found >> 1).astype(np.int32)), pa.array(n * (found & 1)), pa.array(n)], ["anchor", "term", "a", "n"]
                    )

    pairs = rows.mapInArrow(lean(beside), "anchor int, term int, a long, n long").groupBy("anchor", "term").agg(F.sum("a").alias("a"), F.sum("n").alias("n"))
    known = F.broadcast(rows.sparkSession.createDataFrame([(k, t, c) for k, (t, c) in anchors.items()], "anchor int, toxic double, clean double"))
    both = pairs.join(known, "anchor").select("anchor", "term", _evidence("a", "n", F.col("toxic"), F.col("clean")).alias("g2"))
    both = both.filter(F.col("g2") >= chance + float(np.log(ANCHORS)))  # few rows
    both = both.withColumn("rank", F.row_number().over(Window.partitionBy("anchor").orderBy(F.col("g2").desc(), "term"))).filter(F.col("rank") <= BESIDE)
    best = own.filter(F.col("lifted") | (F.col("g2") >= chance)).select("term", "g2").unionByName(both.select("term", "g2")).groupBy("term").agg(F.max("g2").alias("g2"))
    kept = best.orderBy(F.col("g2").desc(), "term").limit(FEATURES).select("term").collect()  # at most FEATURES rows
    discard(own)
    chosen = np.array(sorted(x["term"] for x in kept), np.int64)
    position = {int(t): i for i, t in enumerate(chosen)}

    def active(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [sorted(position[t] for t in x if t in position) for x in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.list_(pa.int32())), batch.column(1)], ["active", "label"])

    cases = rows.mapInArrow(lean(active), "active array<int>, label int").groupBy("active", "label").agg(F.count("label").alias("n"))
    got = sorted(((r["active"], r["label"], r["n"]) for r in cases.collect()), key=lambda x: (x[1], x[0]))  # at most sample rows
    discard(rows)
    indptr = np.cumsum([0, *(len(x[0]) for x in got)])
    indices = np.array([i for x in got for i in x[0]], np.int64)
    return fit(indptr, indices, np.array([x[1] for x in got], float), np.array([x[2] for x in got], float), len(chosen), chosen)


def score_column(machine: Machine, text: Column | str = "text") -> Column:
    """The score of each whole text; no shuffle."""

    @F.pandas_udf("double")
    def score(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        release()
        scorer = Scorer(machine)
        try:
            for part in parts:
                yield pd.Series([scorer(t if isinstance(t, str) else None) for t in part], dtype="float64")
        finally:
            del scorer
            trim()

    return score(text)


def held_out(doc_id: str = "doc_id") -> Column:
    """Rows kept from learning: crc32 of the id as text, modulo 3, is 1.  A null id is not held out."""
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(3)) == 1, F.lit(False))
