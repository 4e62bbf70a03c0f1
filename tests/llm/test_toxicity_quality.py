import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from slabwise.llm import quality, toxicity
from slabwise.llm.common import held_out, logistic


def brute_segments(hits, n, gap=toxicity.GAP):
    """Maximal scoring segments by their definition: take the best segment, then the parts left and right of it."""
    score = [gap] * n
    for i, s in hits:
        score[i] = s
    out = []

    def split(a, b):
        best = None
        for i in range(a, b):
            total = 0.0
            for j in range(i, b):
                total += score[j]
                if total > 1e-9 and (best is None or total > best[2] + 1e-9):
                    best = (i, j + 1, total)
        if best:
            split(a, best[0])
            out.append(best)
            split(best[1], b)

    split(0, n)
    return out


@pytest.mark.parametrize("seed", range(40))
def test_maximal_segments_are_all_of_them(seed):
    r = random.Random(seed)
    n = r.randint(1, 40)
    hits = [(i, r.choice([0.3, 0.7, 1.1, 2.3, 4.9]) + i * 1e-4) for i in range(n) if r.random() < 0.3]
    got, want = toxicity.maximal_segments(hits), brute_segments(hits, n)
    assert [x[:2] for x in got] == [x[:2] for x in want]
    assert np.allclose([x[2] for x in got], [x[2] for x in want])


def corpus(spark, n=400):
    r = random.Random(1)
    words = [f"w{i}" for i in range(60)]
    docs, labels = [], []
    for i in range(n):
        toxic, good = i % 5 == 0, i % 4 != 0
        text = [r.choice(words) for _ in range(40)]
        if toxic:
            text[10:10] = r.sample(["vile", "nasty", "foul"], 2)
        docs.append((i, " ".join(text) if good else " ".join(t.upper() + "!!" for t in text), "clash", 1.0))
        labels.append((i, int(good), int(toxic)))
    return spark.createDataFrame(docs, "doc_id long, text string, segments string, score double"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_held_out_accuracy(spark):
    docs, labels = corpus(spark)
    for module, parts, part, target, at in ((toxicity, 4, 2, "toxic", 0.3), (quality, 3, 1, "quality", 0.5)):
        model = module.fit(docs, labels, ~held_out("id", parts, part))
        scored = module.score_documents(docs, model).withColumn("held", held_out("doc_id", parts, part)).join(labels, "doc_id").where("held").collect()
        assert len(scored) > 60
        assert all(0 <= r.score <= 1 for r in scored)
        assert sum((r.score >= at) == (r[target] == 1) for r in scored) >= 0.97 * len(scored)


def plain_model(docs):
    """Lexicon, gap, decay, log K and calibration by their definitions; docs has (text, y) without repeats."""
    seen = [({k for w in text.split() for k in [w, *("^" + w[:n] for n in range(4, 11) if n < len(w))]}, y) for text, y in docs]
    t1 = sum(y for _, y in docs)
    t0 = len(docs) - t1
    terms = {}
    for k in sorted({k for keys, _ in seen for k in keys}):
        n1 = sum(y for keys, y in seen if k in keys)
        n0 = sum(k in keys for keys, _ in seen) - n1
        a = 100.0 * (n0 + n1) / (t0 + t1) + 0.01
        d = math.log((n1 + a) / (t1 + 100.0 - n1 - a + 1)) - math.log((n0 + a) / (t0 + 100.0 - n0 - a + 1))
        rate, n = t1 / (t0 + t1), n0 + n1
        e = sum(x * math.log(x / n / r) for x, r in ((n1, rate), (n0, 1 - rate)) if x)
        if e >= 12 and n >= 3 and (n1 >= 3 if d > 0 else not k.startswith("^")):
            terms[k] = min(12.0, max(-2.0, d))

    def score(w):
        keys = [w, *("^" + w[:n] for n in range(4, 11) if n < len(w))]
        best = max((terms.get(k, 0.0) for k in keys), default=0.0)
        return best if best > 0 else terms.get(w)

    clean = [score(w) for text, y in docs if not y for w in text.split()]
    blank, known = clean.count(None), [x for x in clean if x is not None]
    gap = min(-0.5, (-0.25 * len(clean) - sum(known)) / max(1, blank))
    return terms, score, gap, [gap] * blank + known


def test_model_and_score_are_brute_force(spark):
    r = random.Random(7)
    words = [f"word{chr(97 + i)}{chr(97 + j)}" for i in range(6) for j in range(6)]
    docs = []
    for i in range(300):
        text = r.choices(words, k=30)
        if i % 4 == 0:
            text[5:5] = r.sample(["vilest", "nasty", "foul"], 2)
            text = [w for w in text if w != "wordaa"]  # evidence against
        elif i % 40 == 1:
            text[9:9] = ["nasty"]
        docs.append((" ".join(text + ["wordaa"] * (i % 4 != 0)), int(i % 4 == 0)))
    d = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(docs)] + [(1000, docs[1][0])], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, (_, y) in enumerate(docs)] + [(1000, 0)], "doc_id long, toxic int")
    model = toxicity.fit(d, labels, F.lit(True))
    terms, score, gap, tokens = plain_model(docs)
    got = {k.decode(): v for k, v in model.terms.terms.items()}
    assert got.keys() == terms.keys() and all(abs(got[k] - terms[k]) < 1e-9 for k in terms) and min(terms.values()) < 0
    assert abs(model.gap - gap) < 1e-9
    assert abs(np.mean(np.exp(model.decay * np.array(tokens))) - 1) < 1e-6 and model.decay > 0
    found = {t: brute_segments([(i, s) for i, w in enumerate(t.split()) if (s := score(w)) is not None], len(t.split()), gap) for t, _ in docs}
    starts = sum(len(found[t]) for t, y in docs if not y)
    log_k = math.log(max(1, starts) / len(tokens))
    assert abs(model.log_k - log_k) < 1e-9

    def shape(t):
        sure = sorted((max(0.0, model.decay * s - log_k - math.log(len(t.split()))) for *_, s in found[t]), reverse=True)
        best = max((s for *_, s in found[t]), default=0.0)
        return [min(60.0, sure[0]) if sure else 0.0, math.log1p(sum(sure)), math.log1p(len(sure)), math.log1p(best), float(bool(sure))]

    x = np.array([shape(t) for t, _ in docs])
    w = logistic(x, np.array([y for _, y in docs], float))
    want = 1 / (1 + np.exp(-(x @ w[:-1] + w[-1])))
    done = {row.doc_id: row.score for row in toxicity.score_documents(d, model).collect()}
    assert all(abs(done[i] - want[i]) < 1e-6 for i in range(len(docs)))


def test_equal_texts_with_both_labels_count_as_toxic(spark):
    docs, labels = corpus(spark)
    again = docs.withColumn("doc_id", F.col("doc_id") + 1000)
    other = labels.select(F.col("doc_id") + 1000, "quality", F.lit(0).alias("toxic"))
    a = toxicity.fit(docs, labels, F.lit(True))
    b = toxicity.fit(docs.unionByName(again), labels.union(other), F.lit(True))
    assert a.terms.terms == b.terms.terms and np.allclose(a.weights, b.weights)


def test_quality_of_text_ids_and_of_mostly_bad_labels(spark):
    docs, labels = corpus(spark)
    text = docs.withColumn("doc_id", F.concat(F.lit("d"), F.col("doc_id")))
    named = labels.withColumn("doc_id", F.concat(F.lit("d"), F.col("doc_id")))
    assert quality.score_documents(text, quality.fit(text, named, F.lit(True))).count() == 400
    bad = labels.where("quality = 0 OR doc_id % 20 = 1")  # five in six are bad
    model = quality.fit(docs, bad, F.lit(True))
    got = quality.score_documents(docs, model).join(labels, "doc_id").collect()
    assert sum((x.score >= 0.5) == (x.quality == 1) for x in got) >= 0.99 * len(got)


def test_odd_rows(spark):
    docs, labels = corpus(spark)
    odd = spark.createDataFrame([(None, None), (1, ""), (1, ""), (2, "vile " * 50_000), (3, None)], "doc_id long, text string")
    t = toxicity.score_documents(odd, toxicity.fit(docs, labels, F.lit(True))).collect()
    q = quality.score_documents(odd, quality.fit(docs, labels, F.lit(True))).collect()
    assert len(t) == len(q) == 5 and all(0 <= r.score <= 1 for r in t + q)
    assert t[0].score == t[1].score == t[2].score < 0.3 < t[3].score and t[3].segments
    assert q[0].score == q[1].score == q[4].score


def test_empty_tables_and_one_sided_labels(spark):
    docs, labels = corpus(spark, 20)
    none = labels.limit(0)
    for module in (toxicity, quality):
        assert module.score_documents(docs.limit(0), module.fit(docs, labels, F.lit(True))).count() == 0
        assert module.score_documents(docs, module.fit(docs, none, F.lit(True))).count() == 20
        assert module.score_documents(docs, module.fit(docs.limit(0), labels, F.lit(True))).count() == 20
    only = labels.withColumn("quality", F.lit(1))
    assert all(r.score >= 0.5 for r in quality.score_documents(docs, quality.fit(docs, only, F.lit(True))).collect())


def test_good_documents_keeps_columns(spark):
    docs, labels = corpus(spark)
    kept = quality.good_documents(docs, quality.fit(docs, labels, F.lit(True)))
    assert kept.columns == docs.columns and {r.doc_id % 4 != 0 for r in kept.collect()} == {True}


def test_logistic_recovers_a_boundary():
    x = np.random.default_rng(0).normal(size=(2000, 2))
    w = logistic(x, (x[:, 0] - x[:, 1] > 0).astype(float))
    assert w[0] > 1 and w[1] < -1 and abs(w[2]) < 0.5
