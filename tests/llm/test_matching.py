"""Decontamination, suffix dedup, line dedup and near-dedup against brute force."""

import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from slabwise.llm import decontaminate, line_dedup, simhash_dedup, suffix_dedup
from slabwise.llm.components import components
from slabwise.llm.runindex import RunLengthIndex


def frame(spark, rows):
    """Documents with columns whose names clash with the operators' own."""
    return spark.createDataFrame([(i, t, "x", 1, [1]) for i, t in rows], "doc_id long, text string, id string, pos int, spans array<int>")


ODD = [(None, None), (None, "a b c"), (7, ""), (7, ""), (8, "one"), (9, " \n\n\t"), (10, "é" * 300)]


def words(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def brute_hits(text, items, n=8):
    w, hit, names = words(text), set(), set()
    for name, body in items:
        v = words(body)
        k = min(n, len(v))
        grams = {tuple(v[i : i + k]) for i in range(len(v) - k + 1)} if k else set()
        for i in range(len(w) - k + 1) if k else ():
            if tuple(w[i : i + k]) in grams:
                hit |= set(range(i, i + k))
                if name is not None:
                    names.add(str(name))
    return len(w), len(hit), sorted(names)


@pytest.mark.parametrize("block_words", [10**6, 25])
def test_decontamination_is_brute_force(spark, block_words):
    r = random.Random(5)
    make = lambda n: " ".join(r.choice("Ab c D ef g") + r.choice("xyz") for _ in range(n))
    items = [(i, make(r.choice([1, 2, 3, 9, 12, 20]))) for i in range(12)] + [(None, make(9)), (5, make(9)), (99, None), (98, "--")]
    docs = [(i, f"{make(r.randint(0, 60))} {r.choice(items[:12])[1] if i % 3 == 0 else ''} {make(3)}" if i % 9 else None) for i in range(60)] + ODD
    b = spark.createDataFrame([(i, t, "clash") for i, t in items], "item_id long, text string, spans string")
    got = decontaminate.digest(decontaminate.find_contamination(frame(spark, docs), b, block_words=block_words)).collect()
    want = []
    for i, t in docs:
        n, h, names = brute_hits(t, items)
        want.append((i, n, h, len(names), hashlib.sha256(",".join(names).encode()).hexdigest(), len(names) >= 2))
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))


def test_decontamination_of_empty_sides(spark):
    docs, items = frame(spark, ODD), spark.createDataFrame([], "item_id long, text string")
    assert {r.n_items for r in decontaminate.digest(decontaminate.find_contamination(docs, items)).collect()} == {0}
    assert decontaminate.find_contamination(docs.limit(0), items).count() == 0


def test_many_blocks_of_items_meet_only_texts_that_share_a_window(spark, monkeypatch):
    """Three Python stages over texts whatever the number of blocks; hot blocks are copied; long items are cut."""
    monkeypatch.setattr(decontaminate, "BLOCK_TEXTS", 3)
    r = random.Random(9)
    make = lambda n: " ".join(f"w{r.randint(0, 3000)}" for _ in range(n))
    items = [(i, make(r.choice([3, 8, 30]))) for i in range(300)] + [(1000, make(500))]
    docs = [(i, f"{make(30)} {(items[i % 40][1] if i % 2 else items[-1][1][200:700])} {make(5)}") for i in range(80)] + ODD + [(200, "x " * 200_000 + items[7][1])]
    got = decontaminate.find_contamination(frame(spark, docs), spark.createDataFrame(items, "item_id long, text string"), block_words=100)
    plan = got._jdf.queryExecution().toString()
    assert plan.count("MapInArrow") < 20 and "CartesianProduct" not in plan
    want = [(i, *brute_hits(t, items)) for i, t in docs]
    done = [(x.doc_id, x.n_words, sum(s.end - s.start for s in x.spans), list(x["items"])) for x in got.collect()]
    assert sorted(map(str, done)) == sorted(map(str, want)) and any(x[2] for x in done)


def test_passages_are_cut_out_and_covered_documents_dropped(spark):
    q = [f"q{i}" for i in range(30)]
    item = " ".join(q)
    texts = {
        1: "x " * 50 + "(Q3, " + ", ".join(q[4:20]) + ") y" + " y" * 60,  # 17 of 128 words
        2: "é " * 50 + " ".join(q[:12]) + " ü" * 50,  # too short to be cut, too little to be dropped
        3: "x " * 20 + item,
        4: "é-" * 100 + item + " ü" * 100 + " " + " ".join(q[10:25]),  # 45 of 245 words in two spans
        5: "x " * 30 + " ".join(q[:9]),  # 9 of 39 words
        6: "x " * 50,
        7: None,
    }
    items = spark.createDataFrame([(0, item), (1, "short")], "item_id long, text string")
    docs = frame(spark, list(texts.items()))
    left = decontaminate.without_passages(docs, items)
    got = {r.doc_id: r.text for r in left.collect()}
    assert left.columns == docs.columns
    assert got == {1: "x " * 50 + "() y" + " y" * 60, 2: texts[2], 4: "é-" * 100 + " ü" * 100 + " ", 6: texts[6], 7: None}


def brute_bytes(rows, length):
    seen, out = set(), {}
    for i, raw in rows:
        cover = bytearray(len(raw))
        for p in range(len(raw) - length + 1):
            k = raw[p : p + length]
            if k in seen:
                cover[p : p + length] = b"\1" * length
            else:
                seen.add(k)
        out[i] = (len(raw), sum(cover), len(re.findall(b"\1+", bytes(cover))), bytes(x for x, c in zip(raw, cover, strict=True) if not c))
    return out


@pytest.mark.parametrize("cut,crowd", [(1 << 20, 16), (37, 16), (1 << 20, 1)])
def test_suffix_dedup_is_brute_force(spark, monkeypatch, cut, crowd):
    monkeypatch.setattr(suffix_dedup, "SLICE", cut)
    monkeypatch.setattr(suffix_dedup, "CROWD", crowd)
    r = random.Random(11)
    text = lambda n: "".join(r.choice("abcdé ") for _ in range(n))
    shared = [text(n) for n in (99, 100, 101, 150, 400)]
    docs = [(i, text(r.randint(0, 300)) + r.choice(shared) + text(r.randint(0, 50)) + r.choice(shared)[: r.randint(50, 400)] + text(20)) for i in range(40)]
    docs += [(50, "ab" * 400), (51, "ab" * 60), (52, "z" * 1000), (53, None), (54, ""), (55, docs[3][1]), (56, docs[3][1] + "!"), (57, "x" * 99), (58, "x" * 99)]
    got = {x.doc_id: (x.n_bytes, x.n_removed, x.n_spans, bytes(x.kept)) for x in suffix_dedup.dedup_bytes(frame(spark, docs)).collect()}
    assert got == brute_bytes(sorted((i, (t or "").encode()) for i, t in docs), 100)


def test_suffix_dedup_of_odd_rows(spark):
    rows = [*ODD, (20, "k" * 150), (20, "k" * 150)]
    got = suffix_dedup.dedup_bytes(frame(spark, rows)).collect()
    assert len(got) == len(rows) and len({(x.n_removed, bytes(x.kept)) for x in got if x.doc_id == 20}) == 1
    assert suffix_dedup.dedup_bytes(frame(spark, rows).limit(0)).count() == 0


def test_matching_statistics_are_brute_force():
    r = random.Random(3)
    for _ in range(60):
        letters = r.choice([b"ab", b"abc", b"\0\xffa", bytes(range(256))])
        make = lambda n, letters=letters: bytes(r.choice(letters) for _ in range(n))
        held = [make(r.randint(0, 60)) for _ in range(r.randint(1, 6))]
        asked = [make(r.randint(0, 20)) + held[0][r.randint(0, 5) :] + make(3) for _ in range(5)] + [b"", b"z" * 5]
        stops = np.cumsum([len(q) for q in asked])
        starts = stops - [len(q) for q in asked]
        got = RunLengthIndex(held).matching(np.frombuffer(b"".join(asked), np.uint8), starts, stops)
        for q, a in zip(asked, starts.tolist(), strict=True):
            for i in range(len(q)):
                assert got[a + i] == max(n for n in range(len(q) - i + 1) if any(q[i : i + n] in x for x in held))
    assert not RunLengthIndex([]).matching(np.zeros(3, np.uint8), np.array([0]), np.array([3])).any()


def test_run_length_index_is_small_on_repetitive_strings():
    texts = [b"abracadabra" * 12 + bytes([i]) for i in range(50)]
    x = RunLengthIndex(texts)
    assert len(x.run_start) < x.rows / 8 and len(x.first_place) == len(x.last_place) == len(x.run_start)
    rows = np.arange(len(texts))  # the end marks' suffixes come first
    for back in range(1, 120):
        run = np.searchsorted(x.run_start, rows, "right") - 1
        assert [h - 1 for h in x.run_head[run].tolist()] == [t[-back] for t in texts]
        rows = x.step(rows)


def test_suffix_dedup_of_a_passage_with_many_neighbours(spark, monkeypatch):
    """One anchor holds a distinct segment of every document: it is cut finer, and no task gets the whole group."""
    most = []
    r = random.Random(8)
    passage = "".join(r.choice("abcdefgh ") for _ in range(120))
    docs = [(i, f"{r.getrandbits(400):x} {passage} {r.getrandbits(400):x}") for i in range(3000)]
    got = {x.doc_id: (x.n_bytes, x.n_removed, x.n_spans, bytes(x.kept)) for x in suffix_dedup.dedup_bytes(frame(spark, docs)).collect()}
    assert got == brute_bytes([(i, t.encode()) for i, t in docs], 100)
    grouped = suffix_dedup._grouped
    monkeypatch.setattr(suffix_dedup, "_grouped", lambda c: most.append(grouped(c)) or most[-1])
    suffix_dedup.repeated_spans(frame(spark, docs).limit(400))
    assert len(most) == 1 + len(suffix_dedup.WIDTHS)


@pytest.mark.parametrize("block", [1, 3000])
def test_rounds_of_the_index_are_brute_force(monkeypatch, block):
    """Segments of groups of all sizes, repeated rows too, in batches that cut groups."""
    monkeypatch.setattr(suffix_dedup, "BLOCK", block)
    r = random.Random(block)
    rows, want = [], set()
    for h in range(12):
        core, seen = bytes(r.choice(b"xyz") for _ in range(100)), {}
        for d in range(r.choice([1, 2, 3, 9])):
            left, right = (bytes(r.choice(b"pq") for _ in range(r.randint(0, 40))) for _ in range(2))
            piece = left + core + right if r.random() < 0.8 else bytes(r.choice(b"mn") for _ in range(120))
            rows += [(h, d, 0, 5, piece)] * r.choice([1, 1, 2])
            for p in range(len(piece) - 99):
                if seen.setdefault(piece[p : p + 100], d) != d:
                    want |= {(h, d, 5 + x) for x in range(p, p + 100)}
    table = pa.table(dict(zip(["h", "id", "ver", "lo", "piece"], map(list, zip(*[(h, 100 * h + d, v, lo, x) for h, d, v, lo, x in rows], strict=True)), strict=True)))
    table = table.set_column(3, "lo", table.column("lo").cast(pa.int32())).set_column(4, "piece", table.column("piece").cast(pa.binary()))
    got = set()
    for b in suffix_dedup._indexed(iter(table.to_batches(max_chunksize=7)), 100):
        for x in b.to_pylist():
            got |= {(x["id"] // 100, x["id"] % 100, p) for p in range(x["start"], x["end"])}
    assert got == want


def test_line_dedup_is_brute_force(spark):
    r = random.Random(2)
    lines = ["Alpha", " alpha\t", "BETA é", "beta é", "", "  ", "gamma", "É", "é"] + [f"rare {i}" for i in range(30)]
    docs = [(i, "\n".join(r.choice(lines) for _ in range(r.randint(1, 12)))) for i in range(60)] + ODD
    strip = lambda s: re.sub("[A-Z]", lambda m: m[0].lower(), s.strip(" \t\n\x0b\x0c\r"))
    where = {}
    for i, t in docs:
        for x in (t or "").split("\n"):
            where.setdefault(strip(x), set()).add(i)
    hot = {k for k, d in where.items() if k and len(d) >= 10}
    want = []
    for i, t in docs:
        own = (t or "").split("\n")
        left = [x for x in own if strip(x) not in hot]
        want.append((i, len(own), len(own) - len(left), "\n".join(left)))
    got = line_dedup.dedup_lines(frame(spark, docs).withColumnRenamed("pos", "n_lines")).collect()
    assert sorted((str(x.doc_id), x.n_lines, x.n_dropped, x.text) for x in got) == sorted((str(a), *b) for a, *b in want)


@pytest.mark.parametrize("min_docs,partitions", [(1, 4), (3, 4), (1, 40), (3, 40)])
def test_line_dedup_keeps_the_first(spark, min_docs, partitions):
    r = random.Random(9)
    docs = [(i, "\n".join(r.choice(["hot", "warm", "w2", *(f"c{k}" for k in range(40))]) for _ in range(8))) for i in range(80)]
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    got = {x.doc_id: x.text for x in line_dedup.dedup_lines(frame(spark, docs), min_docs, keep_first=True).collect()}
    spark.conf.set("spark.sql.shuffle.partitions", 4)
    where = {}
    for i, t in docs:
        for x in t.split("\n"):
            where.setdefault(x, set()).add(i)
    seen = set()
    for i, t in docs:
        left = []
        for x in t.split("\n"):
            if len(where[x]) < min_docs or x not in seen:
                left.append(x)
            seen.add(x)
        assert got[i] == "\n".join(left)


def test_line_dedup_of_an_empty_table(spark):
    assert line_dedup.dedup_lines(frame(spark, ODD).limit(0)).count() == 0


def brute_fingerprint(t, k=3):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    sh = [" ".join(w[i : i + k]) for i in range(len(w) - k + 1)] or ([" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(ids, near):
    root = list(range(len(ids)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(ids)):
        for j in range(i):
            if near(i, j):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    groups = {}
    for i in range(len(ids)):
        groups.setdefault(find(i), []).append(i)
    return {i: min((ids[k] for k in g if ids[k] is not None), default=None) for g in groups.values() for i in g}


def test_simhash_is_brute_force(spark, monkeypatch):
    monkeypatch.setattr(simhash_dedup, "SHARD", 8)
    r = random.Random(4)
    base = [[f"Wörd{r.randint(0, 500)}" for _ in range(200)] for _ in range(20)]
    docs = []
    for i in range(150):
        w = list(r.choice(base))
        for _ in range(r.randint(0, 3)):
            w[r.randrange(len(w))] = "changed"
        docs.append((i * 3, r.choice([" ", "\t", "\n "]).join(w)))
    docs += ODD + [(200, "two words"), (201, "TWO Words"), (202, "three small words")]
    got = simhash_dedup.digest(simhash_dedup.near_duplicates(frame(spark, docs))).collect()
    fps = [brute_fingerprint(t) for _, t in docs]
    want = brute_components([i for i, _ in docs], lambda i, j: bin(fps[i] ^ fps[j]).count("1") <= 3)
    assert sorted(map(str, map(tuple, got))) == sorted(str((i, f"{f:016x}", want[k])) for k, ((i, _), f) in enumerate(zip(docs, fps, strict=True)))
    assert simhash_dedup.near_duplicates(frame(spark, docs).limit(0)).count() == 0


@pytest.mark.parametrize("most", [2_000_000, 100])
def test_dense_and_sparse_fingerprints_lose_no_link(spark, monkeypatch, most):
    monkeypatch.setattr(simhash_dedup, "MOST", most)
    r = np.random.default_rng(8)
    centre = r.integers(0, 1 << 63, 3, dtype=np.uint64)
    near = [int(c) ^ (1 << int(a)) ^ (1 << int(b)) for c in centre for a, b in r.integers(0, 64, (400, 2))]
    x = np.unique(np.array(near + r.integers(0, 1 << 63, 2000).tolist(), np.uint64))
    got = dict(tuple(v) for v in simhash_dedup.link_components(spark.createDataFrame([(int(v),) for v in x.view(np.int64)], "fp long")).collect())
    s = np.sort(x.view(np.int64)).tolist()
    u = np.array(s, np.int64).view(np.uint64)
    parent = {}
    for i in range(len(u)):
        for j in np.flatnonzero(np.bitwise_count(u[:i] ^ u[i]) <= 3):
            a, b = i, int(j)
            while parent.get(a, a) != a:
                a = parent[a]
            while parent.get(b, b) != b:
                b = parent[b]
            parent[max(a, b)] = min(a, b)

    def top(i):
        while parent.get(i, i) != i:
            i = parent[i]
        return i

    assert all(got.get(s[i], s[i]) == s[top(i)] for i in range(len(u)))


def test_similar_documents_at_eight_tenths(spark):
    r = random.Random(6)
    docs = []
    for g in range(30):
        w = [f"t{r.randint(0, 5000)}" for _ in range(300)]
        docs.append((g * 10, " ".join(w)))
        v = list(w)
        for at in range(0, 300, 100):  # 3 of 300 words: nine tenths in common
            v[at + 7] = "new"
        docs += [(g * 10 + 1, " ".join(v)), (g * 10 + 2, " ".join(w))]
        docs.append((g * 10 + 3, " ".join(w[:150] + [f"u{r.randint(0, 5000)}" for _ in range(150)])))
    docs += [(1000, None), (1001, ""), (1002, "hello"), (1003, "hello there")]
    got = {x.doc_id: x.component for x in simhash_dedup.similar_documents(frame(spark, docs)).collect()}
    for g in range(30):
        assert [got[g * 10 + k] for k in range(4)] == [g * 10, g * 10, g * 10, g * 10 + 3]
    assert (got[1001], got[1002], got[1003]) == (1000, 1002, 1003)
    left = simhash_dedup.one_of_each(frame(spark, docs + [(1002, "hello")]))
    assert sorted(x.doc_id for x in left.collect()) == sorted([g * 10 + k for g in range(30) for k in (0, 3)] + [1000, 1002, 1003])


def shared(a, b):
    s, t = ({tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in (a.split(), b.split()))
    return len(s & t) / len(s | t)


@pytest.mark.parametrize("block", [1000, 20])
def test_similar_documents_are_confirmed_exactly(spark, monkeypatch, block):
    monkeypatch.setattr(simhash_dedup, "GROUP_BLOCK", block)
    monkeypatch.setattr(simhash_dedup, "SET_BLOCK", 300 * block)
    r = random.Random(21)
    docs = []
    for g in range(60):
        w = [f"g{g}w{i}" for i in range(300)]
        docs.append((g * 10, " ".join(w)))
        for k in range(1, 3):  # a run of new words: between 0.7 and 0.85 in common with the first
            v, n = list(w), r.randint(21, 47)
            at = r.randrange(0, 250)
            v[at : at + n] = [f"g{g}k{k}u{i}" for i in range(n)]
            docs.append((g * 10 + k, " ".join(v)))
    docs += [(1000 + i, " ".join(f"h{x}" if x != i else "new" for x in range(100))) for i in range(60)]
    got = {x.doc_id: x.component for x in simhash_dedup.similar_documents(frame(spark, docs)).collect()}
    want = {}
    for g in [docs[i : i + 3] for i in range(0, 180, 3)] + [docs[180:]]:
        near = brute_components([i for i, _ in g], lambda a, b, g=g: shared(g[a][1], g[b][1]) >= 0.8)
        want |= {g[k][0]: c for k, c in near.items()}
    assert got == want and 10 < sum(i != c for i, c in want.items() if i < 1000) < 110


@pytest.mark.parametrize("block", [1000, 25])
def test_one_common_passage_makes_no_group_of_all(spark, monkeypatch, block):
    """Every text holds one passage, so many share minima; pairs of copies are found and nothing else is linked."""
    monkeypatch.setattr(simhash_dedup, "GROUP_BLOCK", block)
    passage = " ".join(f"p{i}" for i in range(60))
    docs = []
    for g in range(150):
        w = [f"{g}w{i}" for i in range(80)]
        docs += [(2 * g, f"{passage} {' '.join(w)}"), (2 * g + 1, f"{passage} {' '.join(w[:30] + ['new'] * (g % 2) + w[31:])}")]
    got = {x.doc_id: x.component for x in simhash_dedup.similar_documents(frame(spark, docs)).collect()}
    assert got == {i: i - i % 2 for i, _ in docs}


def test_a_large_cluster_of_copies_is_not_copied_to_all_parts(spark, monkeypatch):
    """1,200 variants of one text and a chain beside them, in parts of 40: rows that meet grow with the cluster."""
    monkeypatch.setattr(simhash_dedup, "GROUP_BLOCK", 40)
    sent, written = [], simhash_dedup.written
    monkeypatch.setattr(simhash_dedup, "written", lambda df, name: sent.append(name) or written(df, name))
    w = [f"c{i}" for i in range(400)]
    docs = [(i, " ".join(w[:k] + [f"v{i}"] + w[k + 1 :])) for i, k in enumerate(random.Random(2).choices(range(400), k=1200))]
    chain = list(w)
    for i in range(12):  # each step has over four fifths in common with the one before; the ends have nothing
        chain = chain[:]
        chain[i * 33 : i * 33 + 33] = [f"s{i}x{j}" for j in range(33)]
        docs.append((2000 + i, " ".join(chain)))
    got = {x.doc_id: x.component for x in simhash_dedup.similar_documents(frame(spark, docs)).collect()}
    assert set(got.values()) == {0}
    assert sent.count("links") in (3, 4)


def test_one_of_each_of_odd_rows(spark):
    """Ids that repeat with other texts, null ids, rows that repeat, text ids, and columns with the names used inside."""
    a, b = " ".join(f"a{i}" for i in range(50)), " ".join(f"b{i}" for i in range(50))
    rows = [(3, a), (5, a), (5, b), (None, b), (None, "alone here"), (7, b + " x"), (9, ""), (8, None), (9, ""), (3, a)]
    names = ["id", "text", "row", "v1", "v2", "node", "root", "s", "__id", "__stays"]
    for kind in ("long", "string"):
        d = spark.createDataFrame([(i if i is None or kind == "long" else str(i), t, *range(8)) for i, t in rows], f"id {kind}, text string, " + ", ".join(f"`{n}` int" for n in names[2:]))
        left = simhash_dedup.one_of_each(d, id_col="id")
        assert left.columns == names
        got = sorted((str(x.id), x.text or "") for x in left.collect())
        assert got == sorted([("3", a), ("5", b), ("None", "alone here"), ("8", "")])
        assert simhash_dedup.one_of_each(d.limit(0), id_col="id").count() == 0
        comp = sorted((str(x.id), str(x.component)) for x in simhash_dedup.similar_documents(d, id_col="id").collect())
        assert comp == sorted([("3", "3"), ("5", "3"), ("5", "5"), ("None", "5"), ("None", "None"), ("7", "5"), ("9", "8"), ("8", "8"), ("9", "8"), ("3", "3")])


def test_no_pair_at_eight_tenths_is_lost(spark):
    docs = []
    for g in range(1500):  # 80 of 100 shingles in common
        w = [f"{g}w{i}" for i in range(94)]
        docs += [(2 * g, " ".join(w)), (2 * g + 1, " ".join(w[:40] + [f"{g}u{i}" for i in range(6)] + w[46:]))]
    assert shared(docs[0][1], docs[1][1]) == 0.8
    got = {x.doc_id: x.component for x in simhash_dedup.similar_documents(frame(spark, docs)).collect()}
    assert [i for i in got if got[i] != i - i % 2] == []


def test_links_of_the_tree_are_confirmed_exactly(spark, monkeypatch):
    """A reach of all bits makes every pair a candidate, without minima; only those at 0.8 are linked."""
    monkeypatch.setattr(simhash_dedup, "DEALS", 0)
    docs = []
    for g in range(20):  # 100 - 2 k of 100 + 2 k shingles in common, about
        w = [f"{g}w{i}" for i in range(104)]
        docs += [(2 * g, " ".join(w)), (2 * g + 1, " ".join(w[:40] + [f"{g}u{i}" for i in range(g)] + w[40 + g :]))]
    want = brute_components([i for i, _ in docs], lambda a, b: shared(docs[a][1], docs[b][1]) >= 0.8)
    got = {x.doc_id: x.component for x in simhash_dedup.similar_documents(frame(spark, docs), reach=64).collect()}
    assert got == want and 20 < len(set(got.values())) < 40


def test_minima_whose_texts_are_linked_make_no_group(spark):
    rows = [(1, 1, bytes(256), [7, 8]), (2, 1, bytes(256), [7, 9]), (3, 3, bytes(256), [5, 9]), (4, 4, bytes(256), [6, 6])]
    met, hot, large = simhash_dedup._dealt(spark.createDataFrame(rows, "node long, known long, sig binary, deal array<long>"))
    assert sorted(x.node for x in met.collect()) == [2, 3] and hot.count() == 0 and not large


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, k) for k in range(101, 160)] + [(5, 5)]
    got = {x.node: x.root for x in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {**{i: 0 for i in range(1, 61)}, **{k: 100 for k in range(101, 160)}}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0
