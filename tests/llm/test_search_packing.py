"""Top-k search, packing and the pipeline against brute force."""

import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from slabwise.llm import packing, topk_search


def brute_top(rows, k):
    fine = {(i, tuple(x)) for i, x in rows if i is not None and x and all(c is not None and math.isfinite(c) for c in x)}
    v = [(i, x, [math.floor(64 * float(np.float32(c))) for c in x]) for i, x in fine]
    out = []
    for q, own, e in v:
        if q % 5 == 0:
            scored = sorted((-sum(a * b for a, b in zip(e, f, strict=True)), c) for c, other, f in v if (c, other) != (q, own) and len(f) == len(e))[:k]
            out += [(q, r, c, -s) for r, (s, c) in enumerate(scored, 1)]
    return sorted(out)


@pytest.mark.parametrize("shard,tree", [(8192, 32768), (40, 25), (100_000, 50)])
def test_top_k_is_brute_force(spark, monkeypatch, shard, tree):
    monkeypatch.setattr(topk_search, "SHARD", shard)
    monkeypatch.setattr(topk_search, "TREE", tree)
    r = np.random.default_rng(2)
    rows = [(i, r.normal(size=6).tolist()) for i in range(400)]
    rows += [(1000 + i, [1.0] * 6) for i in range(90)]  # ties beyond k
    rows += [(2000, None), (2001, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (2002, [float("nan")] * 6), (2003, [float("inf")] * 6), (2004, []), (2005, [0.5, 0.5]), (2010, [0.1, -0.5]), (None, [1.0] * 6), (2015, [0.0] * 6), (5, rows[5][1])]
    rows += [(10, rows[11][1]), (10, [1.5] * 6), (0, [1.0] * 6)]  # ids that repeat with other vectors
    d = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("score", F.lit(1)).withColumn("v", F.lit("clash"))
    got = topk_search.top_k(d, F.col("id") % 5 == 0, 20).collect()
    assert sorted((x.query_id, x.rank, x.vec_id, x.score) for x in got) == brute_top(rows, 20)


@pytest.mark.parametrize("k", [3, 20])
def test_top_k_of_an_id_with_two_vectors(spark, k):
    rows = [(0, [1.0, 0.0]), (0, [0.0, 1.0]), *((i, [i / 10, 1 - i / 10]) for i in range(1, 5))]
    got = topk_search.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), F.col("id") == 0, k).collect()
    assert sorted((x.query_id, x.rank, x.vec_id, x.score) for x in got) == brute_top(rows, k)


def test_top_k_of_few_and_no_rows(spark):
    d = spark.createDataFrame([(0, [1.0]), (1, [2.0])], "vec_id long, embedding array<float>")
    assert [tuple(x) for x in topk_search.top_k(d, F.col("id") % 5 == 0).collect()] == [(0, 1, 1, 64 * 128)]
    assert topk_search.top_k(d.limit(0), F.col("id") % 5 == 0).count() == 0
    with pytest.raises(ValueError, match="64 bits"):
        topk_search.top_k(spark.createDataFrame([(0, [1e15]), (1, [1.0])], "vec_id long, embedding array<double>"), F.col("id") == 0)


def test_m_tree_avoids_computations():
    r = np.random.default_rng(1)
    centres = r.integers(-300, 300, (40, 8))
    x = (centres[r.integers(0, 40, 8000)] + r.integers(-5, 5, (8000, 8))).astype(np.int64)
    tree = topk_search.MTree(x)
    who, rows, scores = tree.search(x[:20], 10)
    for i, q in enumerate(x[:20]):
        least = np.sort(x @ q)[-10]
        assert sorted(rows[who == i].tolist()) == np.flatnonzero(x @ q >= least).tolist() and ((x @ q)[rows[who == i]] == scores[who == i]).all()
    assert tree.computed < 20 * len(x) / 2


def padding(lengths, bounds):
    return sum(min(b for b in bounds if b >= n) - n for n in lengths)


@pytest.mark.parametrize("seed", range(8))
def test_buckets_have_the_least_padding(seed):
    r = random.Random(seed)
    lengths = [r.choice([r.randint(0, 20), r.randint(50, 60), r.randint(0, 200)]) for _ in range(r.randint(1, 40))]
    sizes = sorted(set(lengths))
    cells = [(n, lengths.count(n), n * lengths.count(n)) for n in sizes]
    for k in (1, 2, 3):
        bounds = packing.optimal_buckets(cells, k)
        best = min(padding(lengths, [*c, sizes[-1]]) for j in range(min(k, len(sizes))) for c in itertools.combinations(sizes[:-1], j))
        assert len(bounds) <= k and bounds == sorted(set(bounds)) and padding(lengths, bounds) == best


@pytest.mark.parametrize("parts", ["1", "7"])
def test_batches_fill_in_order_of_slots(spark, parts):
    r = random.Random(3)
    rows = [(i, " ".join(["w"] * r.choice([1, 5, 5, 5, 40, 400, 5000 + i, 9000 + i]))) for i in range(1000)] + [(None, None), (None, ""), (5, ""), (7, "a b"), (7, "a b"), (8, "z " * 90_000)]
    d = spark.createDataFrame(rows, "doc_id long, text string").withColumn("bucket", F.lit(1)).withColumn("n", F.lit(2))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    got = packing.pack(d, packing.word_count(d.text), buckets=6, budget=1000).collect()
    spark.conf.set("spark.sql.shuffle.partitions", before)
    lengths = sorted((i is not None, i or 0, len((t or "").split())) for i, t in rows)
    assert sorted((x.doc_id is not None, x.doc_id or 0, x.n_tokens) for x in got) == lengths
    groups = {}
    for x in got:
        assert x.n_tokens <= x.bucket_len
        groups.setdefault((x.bucket_id, x.bucket_len), []).append((x.doc_id is not None, x.doc_id or 0, x.n_tokens, x.batch_no, x.slot))
    for (_, size), places in groups.items():
        room = max(1, 1000 // max(1, size))
        assert [p[3:] for p in sorted(places)] == [(i // room, i % room) for i in range(len(places))]
    sizes = sorted({n for *_, n in lengths})
    cells = [(n, c := sum(m == n for *_, m in lengths), n * c) for n in sizes]
    least = plain_buckets(cells, 6)
    assert sum(x.bucket_len - x.n_tokens for x in got) == least and max(sizes) > 4096 and len(sizes) > 200
    assert packing.pack(d.limit(0), packing.word_count(d.text)).count() == 0


def plain_buckets(cells, k):
    """The least padding by the plain quadratic programme."""
    n = len(cells)
    best = [0] + [math.inf] * n
    for _ in range(k):
        best = [0] + [min(best[i] + sum(c * cells[j - 1][0] - s for _, c, s in cells[i:j]) for i in range(j)) for j in range(1, n + 1)] if n < 60 else _quick(cells, best)
    return best[n]


def _quick(cells, best):
    x = np.array([c[0] for c in cells], np.float64)
    count, total = (np.concatenate(([0], np.cumsum([c[i] for c in cells]))).astype(np.float64) for i in (1, 2))
    return [0] + [float((np.array(best[:j]) + x[j - 1] * (count[j] - count[:j]) - (total[j] - total[:j])).min()) for j in range(1, len(cells) + 1)]
