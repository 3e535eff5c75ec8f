import collections
import math
import zlib

import numpy as np

from shardloom.llm.components import components
from shardloom.llm.embedding_dedup import near_duplicates
from shardloom.llm.jaccard_join import PrefixTree, jaccard_groups, needed
from shardloom.llm.lm_scoring import LogBilinear, Settings, learned, lm_scores

from .helpers import TEXTS, frame, lowered


def shingles(text, n):
    w = lowered(text)
    return frozenset(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)] if w else [])


def labels(nodes, links):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_components(spark):
    pairs = [(1, 2), (2, 3), (5, 6), (9, 9), (3, 10), (None, 4), (6, 5)] + [(k, k + 1) for k in range(20, 50)]
    got = {r.node: r.component for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    links = [p for p in pairs if p[0]]
    assert got == labels({x for p in links for x in p}, links)


def test_prefix_tree():
    rng = np.random.default_rng(4)
    base = np.unique(rng.integers(0, 10**6, 80)).astype(np.uint64)
    sets = [np.unique(np.concatenate([base[rng.random(len(base)) > 0.06], rng.integers(0, 10**6, 4).astype(np.uint64)])) for _ in range(60)] + [base, base[:1], base]
    tree = PrefixTree(sets)
    for probe in sets[::7]:
        want = sorted((m, len(np.intersect1d(probe, s))) for m, s in enumerate(sets) if len(np.intersect1d(probe, s)) >= needed(len(probe), len(s), 80))
        assert sorted(tree.links(probe, 80)) == want


def test_jaccard_join(spark):
    rng = np.random.default_rng(5)
    words = [f"w{k}" for k in rng.integers(0, 5000, 120)]
    copies = []
    for i in range(40):  # chains of small edits around one text
        w = list(words)
        for k in rng.integers(0, len(w), i % 4):
            w[k] = f"new{i}_{k}"
        copies.append((100 + i, " ".join(w)))
    texts = [t for t in TEXTS if t[0] != 9] + copies
    ids = {d for d, _ in texts if d is not None}
    known = [(d, shingles(t, 3)) for d, t in texts if d is not None]
    links = [(a, b) for i, (a, x) in enumerate(known) for b, y in known[:i] if x and y and 100 * len(x & y) >= 90 * len(x | y)]
    want = labels(ids, links)
    for small, wide in ((64, 512), (3, 512), (3, 0)):
        got = jaccard_groups(frame(spark, texts), small=small, wide=wide).collect()
        assert len(got) == len(texts)
        assert all(r.component_id == want[r.doc_id] for r in got if r.doc_id is not None)
        assert [r.component_id for r in got if r.doc_id is None] == [None]
    assert collections.Counter(r.n_shingles for r in got) == collections.Counter(len(shingles(t, 3)) for _, t in texts)


def test_crowded_shingles_of_classes_that_dont_link(spark, monkeypatch):
    """Short texts that all hold the same frequent passages: groups of one component, of a few, and of unlinked classes, split into parts."""
    from shardloom.llm import jaccard_join

    monkeypatch.setattr(jaccard_join, "PART", 7)
    rng = np.random.default_rng(12)
    lines = [" ".join(f"p{k}w{i}" for i in range(9)) for k in range(6)]
    texts = []
    for i in range(160):
        picked = rng.choice(6, rng.integers(2, 5), replace=False)
        texts.append((i, " ".join(lines[k] for k in sorted(picked)) + (f" own{i % 40}" if i % 3 else "")))
    known = [(d, shingles(t, 3)) for d, t in texts]
    links = [(a, b) for i, (a, x) in enumerate(known) for b, y in known[:i] if 100 * len(x & y) >= 90 * len(x | y)]
    want = labels([d for d, _ in texts], links)
    assert 10 < len(set(want.values())) < 150
    for small, wide in ((4, 512), (4, 3)):
        got = jaccard_groups(frame(spark, texts), small=small, wide=wide).collect()
        assert {r.doc_id: r.component_id for r in got} == want


def test_rows_that_share_an_id_are_one_node(spark):
    a, b = " ".join(f"a{k}" for k in range(30)), " ".join(f"b{k}" for k in range(30))
    got = {(r.doc_id, r.component_id) for r in jaccard_groups(frame(spark, [(1, a), (5, a), (5, b), (9, b)])).collect()}
    assert got == {(1, 1), (5, 1), (9, 1)}
    assert jaccard_groups(frame(spark, [])).count() == 0


def test_embeddings(spark):
    rng = np.random.default_rng(6)
    base = rng.standard_normal((30, 16))
    vectors = [(i, (v + rng.standard_normal(16) * s).tolist()) for i, (v, s) in enumerate((base[k % 30], 0.05 if k < 200 else 0.6) for k in range(260))]
    odd = [(900, None), (901, [0.0] * 16), (902, [float("nan")] * 16), (903, [None] + [1.0] * 15), (904, [1.0] * 3), (None, vectors[0][1]), (905, vectors[3][1]), (906, vectors[3][1])]
    df = spark.createDataFrame([(i, v, 1, "x") for i, v in vectors + odd], "vec_id long, embedding array<double>, id int, unit string")
    got = {r.vec_id: r for r in near_duplicates(df).collect()}
    good = vectors + odd[-2:]
    x = np.array([v for _, v in good])
    x /= np.linalg.norm(x, axis=1)[:, None]
    link = x @ x.T >= 0.9
    np.fill_diagonal(link, False)
    ids = [i for i, _ in good]
    found = sum(got[i].n_links for i in ids)
    assert found >= 0.9 * link.sum() and all(got[i].n_links <= n for i, n in zip(ids, link.sum(1), strict=True))
    want = labels(ids, [(ids[a], ids[b]) for a, b in zip(*np.nonzero(link), strict=True)])
    assert np.mean([got[i].component_id == want[i] for i in ids]) > 0.9
    for i in (900, 901, 902, 903, 904):
        assert (got[i].n_links, got[i].component_id, got[i].kept) == (0, i, True)
    assert len(got) == len(vectors) + len(odd)


def test_no_embeddings(spark):
    assert near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_base_scores_and_model(spark):
    texts = TEXTS + [(200 + i, "the cat sat on the mat and the dog ran to the cat . " * 5) for i in range(60)]
    s = Settings(own=24, spelled=8, dim=8, noise=16)
    got = lm_scores(frame(spark, texts), s).collect()
    counts, docs = collections.Counter(), {}
    for d, t in texts:
        w = [*lowered(t), "\n"]
        docs.setdefault(d, []).append(w)
        if d is None or zlib.crc32(str(d).encode()) % 5 != 1:
            counts.update(w)
    total, v = sum(counts.values()), len(counts)
    assert len(got) == len(texts)
    for r in got:
        w = docs[r.doc_id][0]
        base = sum(math.log10((counts[x] + 0.5) / (total + 0.5 * (v + 1))) for x in w)
        assert math.isclose(r.base_score, base, rel_tol=1e-9)
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(w), sum(x in counts for x in w), total)
    test = [r for r in got if r.held_out and (r.doc_id or 0) >= 200]
    assert sum(r.score for r in test) > sum(r.base_score for r in test)
    assert lm_scores(frame(spark, []), s).count() == 0


def test_probabilities_sum_to_one():
    m = LogBilinear(np.full(6, 1 / 6), 4, 3)
    total = sum(math.exp(m.log_probs([np.array([2, 3, c], "<u2")])[2]) for c in range(6))
    assert math.isclose(total, 1, rel_tol=1e-5)
    m.out *= 1000  # past what single precision holds without care
    assert math.isclose(sum(math.exp(m.log_probs([np.array([2, 3, c], "<u2")])[2]) for c in range(6)), 1, rel_tol=1e-4)


def test_scores_equal_a_sum_over_classes(spark):
    """score by loops over tokens and classes, and probabilities over the whole vocabulary and one unseen token."""
    texts = TEXTS[:8] + TEXTS[10:] + [(200 + i, f"the cat sat on the mat and dog{i} ran to a bird{i % 7} . " * 4) for i in range(40)]
    d = frame(spark, texts).selectExpr("doc_id", "text")
    s = Settings(own=16, spelled=4, order=3, dim=4, noise=16, head=64)
    counts, head, _, m = learned(d, s)
    counts = {r.word: r.c for r in counts.collect()}
    top = sorted(counts, key=lambda w: (-counts[w], w))[: s.own]
    tails = collections.defaultdict(lambda: 0.5)
    for w, c in counts.items():
        if w not in top:
            tails[zlib.crc32(w.encode()[-3:]) % s.spelled] += c + 0.5
    of = lambda w: top.index(w) if w in top else s.own + zlib.crc32(w.encode()[-3:]) % s.spelled

    def token(w, before):
        q = sum(m.context[of(before[-1 - j]) if j < len(before) else m.k].astype(float) * m.place[j] for j in range(s.order))
        e = [math.exp(float(q @ m.out[k]) + float(m.bias[k])) for k in range(m.k)]
        p = e[of(w)] / sum(e)
        return p if w in top else p * (counts.get(w, 0) + 0.5) / tails[of(w) - s.own]

    every = sum(token(w, ["the", "cat"]) for w in counts)
    unseen = {w for k in range(200) if (w := f"zz{k}") not in counts}
    one_of_each = {of(w): w for w in unseen}
    every += sum(token(w, ["the", "cat"]) for w in one_of_each.values())
    assert len(one_of_each) == s.spelled and math.isclose(every, 1, rel_tol=1e-4)
    got = lm_scores(frame(spark, texts), s).collect()
    want = collections.defaultdict(list)
    for i, t in texts:
        w = [*lowered(t), "\n"]
        want[i].append(sum(math.log10(token(x, w[:k])) for k, x in enumerate(w)))
    assert all(any(math.isclose(r.score, x, rel_tol=1e-4, abs_tol=1e-3) for x in want[r.doc_id]) for r in got)


def test_gain_on_held_out_texts(spark):
    got = lm_scores(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).where("held_out").selectExpr("sum(score - base_score) / sum(n_tokens) AS gain").first()
    assert got.gain > 0.15


def _exact(rows, threshold=0.9):
    x = np.array([v for _, v in rows])
    x /= np.linalg.norm(x, axis=1)[:, None]
    link = x @ x.T >= threshold
    np.fill_diagonal(link, False)
    ids = [i for i, _ in rows]
    return dict(zip(ids, link.sum(1).tolist(), strict=True)), labels(ids, [(ids[a], ids[b]) for a, b in zip(*np.nonzero(link), strict=True)])


def _vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>")


def test_links_between_groups_that_fill_each_list(spark):
    rng = np.random.default_rng(8)
    a = np.eye(32)[0]
    b = 0.93 * a + math.sqrt(1 - 0.93**2) * np.eye(32)[1]  # groups of 40 with 0.99 inside and 0.92 across
    rows = [(i, ((a if i < 40 else b) + rng.standard_normal(32) * 0.015).tolist()) for i in range(80)] + [(100 + i, rng.standard_normal(32).tolist()) for i in range(300)]
    counts, want = _exact(rows)
    assert want[79] == 0 and counts[0] > 60
    got = {r.vec_id: r for r in near_duplicates(_vectors(spark, rows), searches=1, recall=0.0).collect()}
    assert {i: got[i].n_links for i in counts} == counts and {i: got[i].component_id for i in want} == want


def test_a_long_chain_and_clashing_columns(spark):
    """One component whose ends are far apart: blocks of near vectors, of which most pairs needn't meet."""
    from shardloom.llm import embedding_dedup

    angle = np.arange(1500) * 0.004  # each links with those up to 112 places away
    rows = [(i, [math.cos(x), math.sin(x), 0.0]) for i, x in enumerate(angle.tolist())]
    counts, want = _exact(rows)
    df = spark.createDataFrame([(i, v, "d", 1, 2, 3, 4) for i, v in rows], "vec_id long, embedding array<double>, digest string, name int, weight int, component int, unit int")
    got = {r.vec_id: r for r in near_duplicates(df).collect()}
    assert {i: got[i].n_links for i in counts} == counts and {i: got[i].component_id for i in want} == want
    units = embedding_dedup.normalised(df, "vec_id", "embedding").selectExpr("vec_id id", "0L component", "1L weight", "unit")
    blocks = embedding_dedup._packed(units)
    n = blocks.count()
    assert embedding_dedup._block_pairs(blocks, 0.9).count() < 0.7 * n * (n + 1) / 2


def test_audit_counts_each_class_and_ends_exact(spark, monkeypatch):
    from shardloom.llm import embedding_dedup

    rng = np.random.default_rng(9)
    big = rng.standard_normal(32)
    small = rng.standard_normal((60, 32))
    rows = [(i, (big + rng.standard_normal(32) * 0.05).tolist()) for i in range(300)]
    rows += [(1000 + 2 * i + c, (v + rng.standard_normal(32) * 0.05).tolist()) for i, v in enumerate(small) for c in (0, 1)]
    counts, want = _exact(rows)
    units = embedding_dedup.normalised(_vectors(spark, rows), "vec_id", "embedding").selectExpr("vec_id id", "1L weight", "unit")
    only_big = spark.createDataFrame([(i, n) for i, n in counts.items() if n > 10], "id long, classes long")
    assert embedding_dedup.audited_recall(units, only_big, len(rows), 0.9, 400) == 0.0  # found / true links is over 0.99
    every = spark.createDataFrame(list(counts.items()), "id long, classes long")
    assert embedding_dedup.audited_recall(units, every, len(rows), 0.9, 400) == 1.0
    # a search that finds nothing is never taken for complete
    monkeypatch.setattr(embedding_dedup, "neighbour_graph", lambda units, *a, **k: units.selectExpr("id", "id other", "1d cos").where("false"))
    got = {r.vec_id: r for r in near_duplicates(_vectors(spark, rows), searches=1).collect()}
    assert {i: got[i].n_links for i in counts} == counts and {i: got[i].component_id for i in want} == want
