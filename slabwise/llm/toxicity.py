"""Toxicity by maximum-scoring segments.

Token log-odds between toxic and clean training documents, with an informative Dirichlet prior, give each term that
has evidence enough a score, positive or negative; tokens without have a small negative one. A linear-time scan finds
every maximal segment of a document, an extreme-value (Karlin-Altschul) law turns segment scores into significances,
and a calibration of the significant segments gives the document's score.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slabwise.llm.common import bounded_batches, labelled_sample, logistic, words_of

#: Labelled rows that the model is fitted on, at most.
TRAIN_ROWS = 20_000
#: Score of a token without evidence, at most, the least that one with evidence against it gets, and the mean score of
#: clean tokens, at most: an extreme-value law needs a negative one.
GAP, LEAST, MEAN = -0.5, -2.0, -0.25
#: A token is scored by itself and by its beginnings of these byte lengths; the best counts.
PREFIXES = range(4, 11)
_MEMO = 300_000


def keys_of(word: bytes) -> list[bytes]:
    """The lexicon keys of a word: itself, and its beginnings marked with a caret."""
    return [word, *(b"^" + word[:k] for k in PREFIXES if k < len(word))]


class TermScores(dict):
    """Scores of words by the lexicon, filled as words are met and emptied when large; absent words score None. The
    best positive key counts; without one, the word's own evidence against it does."""

    def __init__(self, terms: dict[bytes, float]) -> None:
        super().__init__()
        self.terms = terms

    def __missing__(self, word: bytes) -> float | None:
        if len(self) > _MEMO:
            self.clear()
        best = max((s for k in keys_of(word) if (s := self.terms.get(k, 0.0)) > 0), default=None)
        found = self[word] = best if best is not None else self.terms.get(word)
        return found

    def __reduce__(self):
        return TermScores, (self.terms,)


@dataclass
class ToxicModel:
    terms: TermScores
    gap: float  # score of a token without evidence
    decay: float  # lambda of the extreme-value law
    log_k: float
    weights: np.ndarray  # calibration; the last is the intercept


def maximal_segments(scores: list[tuple[int, float]], gap: float = GAP) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (start, end, score) of a token sequence, in linear time.

    ``scores`` has (position, score) of scored tokens in order; every other token scores ``gap`` < 0.
    """
    kept: list[tuple[int, int, float, float]] = []  # start, end, sum before it, sum at its end
    back: list[int] = []  # for each, the nearest earlier one that starts lower
    total, last = 0.0, -1
    for at, s in scores:
        total += gap * (at - last - 1)
        last = at
        if s <= 0:
            total += s
            continue
        a, low, high = at, total, total + s
        total = high
        while True:
            j = len(kept) - 1
            while j >= 0 and kept[j][2] >= low:
                j = back[j]
            if j < 0 or kept[j][3] >= high:
                kept.append((a, at + 1, low, high))
                back.append(j)
                break
            a, low = kept[j][0], kept[j][2]
            del kept[j:], back[j:]
    return [(a, b, high - low) for a, b, low, high in kept]


def segments(raw: bytes | None, model: ToxicModel) -> tuple[int, list[tuple[int, int, float, float]]]:
    """(number of tokens, segments as (start, end, score, log of the expected number by chance))."""
    words = words_of(raw)
    hits = [(i, s) for i, s in enumerate(map(model.terms.__getitem__, words)) if s is not None]
    base = model.log_k + math.log(max(1, len(words)))
    return len(words), [(a, b, s, base - model.decay * s) for a, b, s in maximal_segments(hits, model.gap)] if hits else []


def _features(segs: list[tuple[int, int, float, float]]) -> list[float]:
    sure = sorted((max(0.0, -e) for *_, e in segs), reverse=True)
    best = max((s for _, _, s, _ in segs), default=0.0)
    return [min(60.0, sure[0]) if sure else 0.0, math.log1p(sum(sure)), math.log1p(len(segs)), math.log1p(best), float(bool(segs))]


def _decay(scores: np.ndarray, share: np.ndarray) -> float:
    """Positive root of sum(share * exp(x * score)) = 1; scores must have a negative mean. Without positive ones there
    is none, and the largest tried is taken."""
    lo, hi = 0.0, 1.0
    f = lambda x: float((share * np.exp(np.clip(x * scores, -700, 700))).sum()) - 1
    while f(hi) < 0 and hi < 64:
        lo, hi = hi, 2 * hi
    for _ in range(60):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if f(mid) < 0 else (lo, mid)
    return max(hi, 1e-3)


def fit(docs: DataFrame, labels: DataFrame, train: Column, *, rows: int = TRAIN_ROWS, prior: float = 100.0, min_docs: int = 3, min_evidence: float = 12.0) -> ToxicModel:
    """Fit on at most ``rows`` labelled rows for which ``train`` (on column id) holds; equal texts count once, as toxic
    if any of them is."""
    spark = docs.sparkSession
    bounded_batches(spark)
    sample = labelled_sample(docs, labels, "toxic", train, rows).groupBy("text").agg(F.max("y").alias("y")).cache()

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            seen: tuple[Counter, Counter] = (Counter(), Counter())
            n = [0, 0]
            for raw, y in zip(b.column(0), b.column(1).to_pylist(), strict=True):
                seen[y].update({k for w in set(words_of(raw.as_py())) for k in keys_of(w)})
                n[y] += 1
            words = list(seen[0].keys() | seen[1].keys())
            yield pa.RecordBatch.from_arrays([pa.array([b"", *words], pa.binary()), pa.array([n[0], *(seen[0][w] for w in words)], pa.int64()), pa.array([n[1], *(seen[1][w] for w in words)], pa.int64())], names=["w", "n0", "n1"])

    table = sample.mapInArrow(counts, "w binary, n0 long, n1 long").groupBy("w").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1")).cache()
    total = table.where(F.length("w") == 0).first()
    t0, t1 = (float(total.n0), float(total.n1)) if total else (0.0, 0.0)
    terms: dict[bytes, float] = {}
    if t0 and t1:
        a = prior * (F.col("n0") + F.col("n1")) / (t0 + t1) + 0.01  # the prior follows how usual a word is
        odds = lambda n, t: F.log((F.col(n) + a) / (F.lit(t + prior) - F.col(n) - a + 1))
        delta = odds("n1", t1) - odds("n0", t0)
        n, rate = F.col("n0") + F.col("n1"), t1 / (t0 + t1)
        part = lambda k, r: F.when(F.col(k) > 0, F.col(k) * F.log(F.col(k) / n / r)).otherwise(0.0)
        evidence = part("n1", rate) + part("n0", 1 - rate)  # nats against the word being as usual in clean documents
        scored = table.where((F.length("w") > 0) & (n >= min_docs)).select("w", "n1", delta.alias("d"), evidence.alias("e"))
        whole = F.substring("w", 1, 1) != F.lit(b"^")  # a beginning is no evidence against a word
        sure = scored.where((F.col("e") >= min_evidence) & F.when(F.col("d") > 0, F.col("n1") >= min_docs).otherwise(whole))
        terms = {bytes(r.w): min(12.0, max(LEAST, float(r.d))) for r in sure.collect()}  # of the sample, so bounded by it
    model = ToxicModel(TermScores(terms), GAP, 1.0, 0.0, np.zeros(6))

    def tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            seen = Counter(s for raw in b.column(0) for s in map(model.terms.__getitem__, words_of(raw.as_py())))
            yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.float64()), pa.array(list(seen.values()), pa.int64())], names=["s", "c"])

    usual = sample.where("y = 0").select("text").mapInArrow(tokens, "s double, c long").groupBy("s").agg(F.sum("c").alias("c")).collect() if terms else []
    scored, blank = [(r.s, r.c) for r in usual if r.s is not None], sum(r.c for r in usual if r.s is None)
    if usual:
        n = blank + sum(c for _, c in scored)
        model.gap = min(GAP, (MEAN * n - sum(s * c for s, c in scored)) / max(1, blank))
        model.decay = _decay(np.array([model.gap, *(s for s, _ in scored)]), np.array([blank, *(c for _, c in scored)]) / n)

    def hits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            done = [segments(raw.as_py(), model) for raw in b.column(0)]
            top = [max((s for _, _, s, _ in segs), default=0.0) for _, segs in done]
            yield pa.RecordBatch.from_arrays([b.column(1), pa.array([n for n, _ in done], pa.int64()), pa.array(top, pa.float64()), pa.array([[[float(x) for x in s] for s in segs] for _, segs in done], pa.list_(pa.list_(pa.float64())))], names=["y", "n", "top", "segs"])

    got = sample.mapInArrow(hits, "y int, n long, top double, segs array<array<double>>").collect()
    table.unpersist()
    sample.unpersist()
    y = np.array([r.y for r in got], float)
    if not terms or not 0 < y.sum() < len(y):
        rate = (y.sum() + 1) / (len(y) + 2)
        model.weights = np.array([0.0] * 5 + [math.log(rate / (1 - rate))])
        return model
    found = sum(len(r.segs) for r in got if r.y == 0)
    model.log_k = math.log(max(1, found) / max(1, sum(r.n for r in got if r.y == 0)))  # places a token where a segment can begin
    x = np.array([_features([(int(a), int(b), s, model.log_k + math.log(max(1, r.n)) - model.decay * s) for a, b, s, _ in r.segs]) for r in got])
    model.weights = logistic(x, y)
    return model


def score_documents(docs: DataFrame, model: ToxicModel, *, id_col: str = "doc_id", text_col: str = "text", significant: float = 0.05) -> DataFrame:
    """(id, score, segments): one row per input row; segments are the passages (start, end in words, score, p) whose
    chance is at most ``significant``. Null and empty texts have no tokens and get the score of a text without
    segments. Other columns are not read; repeated rows repeat."""
    spark = docs.sparkSession
    bounded_batches(spark)
    shared = spark.sparkContext.broadcast(model)
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64()), ("p", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            done = [segments(raw.as_py(), m) for raw in b.column(1)]
            x = np.array([_features(segs) for _, segs in done]).reshape(-1, 5)
            score = 1 / (1 + np.exp(-np.clip(x @ m.weights[:-1] + m.weights[-1], -35, 35)))
            passages = [[{"start": s, "end": e, "score": v, "p": p} for s, e, v, c in segs if (p := -math.expm1(-math.exp(min(c, 50)))) <= significant] for _, segs in done]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(score), pa.array(passages, kind)], names=["id", "score", "segments"])

    own = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text"))
    return own.mapInArrow(run, f"id {own.schema['id'].dataType.simpleString()}, score double, segments array<struct<start:int,end:int,score:double,p:double>>").withColumnRenamed("id", id_col)
