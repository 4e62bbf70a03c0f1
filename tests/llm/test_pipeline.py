"""The pipeline's stages against brute force, on rows of every odd kind."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from slabwise.llm import quality, simhash_dedup
from slabwise.llm.common import held_out

SF = "/root/testdata/sf0.001"
STAGES = dict(corpus_pipeline.STAGES)
#: Columns whose names the operators use inside.
EXTRA = ["n_lines", "n_dropped", "id", "ver", "row", "body", "spans", "keep", "pos", "v1", "stays", "score", "bucket", "n", "u", "part", "item"]


def words(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def shingles(t):
    w = (t or "").encode().lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


@pytest.fixture(scope="module")
def docs(spark):
    """Documents of the smallest table with copies, lines and passages planted, nulls, repeats and a long text."""
    r = random.Random(4)
    raw = [tuple(x) for x in spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").collect()]
    items = [x.text for x in spark.read.parquet(f"{SF}/benchmark.parquet").collect() if x.text]
    out = []
    for i, text, lang, source, _ in raw:
        t = text or ""
        if i % 3 == 0:
            t += "\n  All Rights reserved by nobody at all \n" + t[:40]
        if i % 7 == 0:
            t = f"{t} {r.choice(items)} {t}"
        if i % 11 == 0:
            w = t.split(" ")
            out.append((1000 + i, " ".join(w[:-1] + ["changed"]), lang, source, 5))
        out.append((i, t, lang, source, len(t)))
    out += [(5000, None, None, None, None), (5001, "", "xx", "s", 0), (None, "no id here at all", "en", None, 3), (None, None, None, "s", None)]
    out += [out[5], out[5], (out[6][0], "another text under an id that is there", "en", "s", 1), (6000, "long words here " * 60_000, "en", "s", 1)]
    rows = [(*x, *range(len(EXTRA))) for x in out]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` int" for c in EXTRA)).cache()


def rows_of(df):
    return sorted((tuple(x) for x in df.collect()), key=str)


def test_quality_keeps_what_the_model_keeps(spark, docs):
    got = STAGES["quality"](spark, docs, SF)
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    model = quality.fit(docs, labels, ~held_out("id", 3, 1))
    score = lambda t: float(model.score(np.array([quality.features(t.encode() if t is not None else None)]))[0])
    want = [tuple(x) for x in docs.collect() if score(x.text) >= 0.5]
    assert got.columns == docs.columns and rows_of(got) == sorted(want, key=str) and 0 < len(want) < docs.count()


def test_line_dedup_keeps_the_first_of_each_frequent_line(spark, docs):
    got = STAGES["line_dedup"](spark, docs, SF)
    key = lambda x: re.sub("[A-Z]", lambda m: m[0].lower(), x.strip(" \t\n\x0b\x0c\r"))
    where, all_rows = {}, docs.collect()
    for x in all_rows:
        for p, line in enumerate((x.text or "").split("\n")):
            if key(line):
                where.setdefault(key(line), []).append((x.doc_id if x.doc_id is not None else -(2**63), p))
    often = {k: min(v) for k, v in where.items() if len({i for i, _ in v}) >= 10}
    want = []
    for x in all_rows:
        i = x.doc_id if x.doc_id is not None else -(2**63)
        t = "\n".join(line for p, line in enumerate((x.text or "").split("\n")) if key(line) not in often or often[key(line)] == (i, p))
        want.append((x.doc_id, t, x.lang, x.source, len(t), *x[5:]))
    assert got.columns == docs.columns and rows_of(got) == sorted(want, key=str) and often


def test_near_dedup_keeps_the_smallest_id_of_each_component(spark, docs):
    got = STAGES["near_dedup"](spark, docs, SF)
    texts = sorted({(x.doc_id is None, x.doc_id or 0, x.text is not None, x.text or "") for x in docs.collect()})
    sets = [shingles(t) for *_, t in texts]
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            union = len(sets[i] | sets[j])
            if (len(sets[i] & sets[j]) >= 0.8 * union) if union else True:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    want = {texts[i][:2] for i in range(len(texts)) if find(i) == i}
    kept = [(x.doc_id is None, x.doc_id or 0) for x in got.collect()]
    assert got.columns == docs.columns and set(kept) == want and len(kept) == sum(find(i) == i for i in range(len(texts)))
    assert set(rows_of(got)) <= set(rows_of(docs)) and len(kept) < docs.count()


def test_near_dedup_goes_through_fingerprints_and_their_tree(spark, docs, monkeypatch):
    """Without the minima, what the vantage-point tree links at 3 bits and the shingles confirm still goes."""
    monkeypatch.setattr(simhash_dedup, "DEALS", 0)
    got = STAGES["near_dedup"](spark, docs, SF)
    texts = sorted({(x.doc_id is None, x.doc_id or 0, x.text is not None, x.text or "") for x in docs.collect()})
    sets = [shingles(t) for *_, t in texts]
    fps = np.array([simhash_dedup.simhash(np.unique(simhash_dedup.shingle_hashes(t.encode(), 5))) for *_, t in texts], np.uint64)
    root, near = list(range(len(texts))), 0

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(texts)):
        for j in np.flatnonzero(np.bitwise_count(fps[:i] ^ fps[i]) <= 3).tolist():
            union = len(sets[i] | sets[j])
            if (len(sets[i] & sets[j]) >= 0.8 * union) if union else True:
                a, b = find(i), find(j)
                root[max(a, b)], near = min(a, b), near + (fps[i] != fps[j])
    assert sorted((x.doc_id is None, x.doc_id or 0) for x in got.collect()) == sorted(texts[i][:2] for i in range(len(texts)) if find(i) == i) and near


def test_decontamination_cuts_passages(spark, docs):
    got = STAGES["decontamination"](spark, docs, SF)
    grams = set()
    for x in spark.read.parquet(f"{SF}/benchmark.parquet").collect():
        w = words(x.text)
        grams |= {tuple(w[i : i + 8]) for i in range(len(w) - 7)}
    short = {tuple(words(x.text)) for x in spark.read.parquet(f"{SF}/benchmark.parquet").collect() if 0 < len(words(x.text)) < 8}
    want, cuts = [], 0
    for x in docs.collect():
        t = x.text or ""
        at = [m.span() for m in re.finditer(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", t)]
        w = words(t)
        hit = np.zeros(len(w) + 2, bool)
        for n, known in ((8, grams), *((len(g), {g}) for g in short)):
            for i in range(len(w) - n + 1):
                if tuple(w[i : i + n]) in known:
                    hit[i + 1 : i + 1 + n] = True
        edge = np.flatnonzero(np.diff(hit.astype(int)))
        spans = [(a, z) for a, z in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True) if z - a >= 8]
        covered = sum(z - a for a, z in spans)
        if covered and covered >= 0.2 * len(w):
            continue
        out, done = "", 0
        for a, z in spans:
            if z - a >= 13:
                out, done, cuts = out + t[done : at[a][0]], at[z - 1][1], cuts + 1
        t = None if x.text is None else out + t[done:]
        want.append((x.doc_id, t, x.lang, x.source, None if t is None else len(t), *x[5:]))
    assert got.columns == docs.columns and rows_of(got) == sorted(want, key=str) and cuts


def test_packing_numbers_every_row(spark, docs):
    got = STAGES["packing"](spark, docs, SF).collect()
    sizes = sorted((x.doc_id is not None, x.doc_id or 0, len(re.findall(r"[^\x20\x09-\x0D]+", x.text or ""))) for x in docs.collect())
    assert sorted((x.doc_id is not None, x.doc_id or 0, x.n_tokens) for x in got) == sizes
    for b in {x.bucket_id for x in got}:
        own = sorted((x.doc_id is not None, x.doc_id or 0, x.n_tokens, x.batch_no, x.slot, x.bucket_len) for x in got if x.bucket_id == b)
        room = max(1, 16_384 // max(1, own[0][5]))
        assert [o[3:5] for o in own] == [(i // room, i % room) for i in range(len(own))] and max(o[2] for o in own) == own[0][5]


@pytest.mark.parametrize("name", list(STAGES))
def test_stages_of_no_rows_and_of_nulls(spark, docs, name):
    out = STAGES[name](spark, docs.limit(0), SF)
    assert out.count() == 0 and (name == "packing" or out.columns == docs.columns)
    nulls = docs.where("doc_id IS NULL").select(*(F.lit(None).cast(f.dataType).alias(f.name) for f in docs.schema))
    assert STAGES[name](spark, nulls, SF).count() in (0, 1, 2)


def test_run_is_the_stages_in_order(spark):
    raw = spark.read.parquet(f"{SF}/documents.parquet")
    step, sizes = raw, []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        step = stage(spark, step, SF).cache()
        assert step.columns == raw.columns, name
        sizes.append(step.count())
    assert raw.count() > sizes[0] == sizes[1] > sizes[2] >= sizes[3] > 0
    want = corpus_pipeline.STAGES[-1][1](spark, step, SF)
    assert rows_of(corpus_pipeline.run(spark, SF)) == rows_of(want)
