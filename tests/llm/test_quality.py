import collections
import math
import re
import unicodedata
import zlib

import numpy as np

from shardloom.llm import quality_rules as qr
from shardloom.llm.quality_classifier import AdditiveModel, quality_scores

from .helpers import TEXTS, WORD, frame


def brute(text):
    words = WORD.findall(text)
    windows = collections.Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    covered = {k for i in range(len(words) - 4) if windows[tuple(words[i : i + 5])] > 1 for k in range(i, i + 5)}
    lines = [s for s in text.split("\n") if WORD.search(s)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)


def test_measures_and_base(spark):
    got = sorted(qr.quality_rules(frame(spark)).collect(), key=lambda r: (r.doc_id is None, r.doc_id or 0))
    want = sorted(TEXTS, key=lambda r: (r[0] is None, r[0] or 0))
    for r, (_, text) in zip(got, want, strict=True):
        n, chars, symbols, dup, repeat = brute(text or "")
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (n, chars, symbols, dup, repeat)
        assert r.base_failed == (n < 10 or 100 * repeat > 20 * n)
        assert not (r.base_failed and r.kept)
    assert qr.quality_rules(frame(spark, [])).count() == 0


def test_rules_reject_junk_and_keep_the_rest(spark):
    rng = np.random.default_rng(1)
    clean = [(i, " ".join("".join(rng.choice(list("abcdefgh"), 6)) for _ in range(80)) + ".") for i in range(90)]
    junk = [(100 + i, " ".join("".join(rng.choice(list("abcdefgh"), 6)) + "$$$" for _ in range(80))) for i in range(10)]
    kept = {r.doc_id for r in qr.quality_rules(frame(spark, clean + junk)).where("kept").collect()}
    assert kept == set(range(90))


def test_estimate_without_documents():
    share, rates = qr.estimate([])
    assert 0 < share < 1 and rates.shape == (2, len(qr.RULES), 3)


def brute_votes(text):
    """The rules once more, in plain Python."""
    n, chars, symbols, dup, repeat = brute(text)
    words = WORD.findall(text)
    lines = sum(1 for s in text.split("\n") if WORD.search(s))
    letters = sum(unicodedata.category(c)[0] == "L" for c in text)
    bare = sum(not any(unicodedata.category(c)[0] in "LN" for c in w) for w in words)
    ends = sum(bool(re.search(r"""[.!?。]["')\]]*$""", w)) for w in words)
    capitals, exclaimed, distinct = sum(unicodedata.category(c) == "Lu" for c in text), text.count("!"), len(set(words))
    bad = [n < 10, chars < 2.5 * n or chars > 12 * n, symbols > 0.1 * n, letters < 0.85 * chars, bare > 0.1 * n, ends < 0.02 * n or ends > 0.4 * n, dup > 0.3 * lines, repeat > 0.15 * n, distinct < 0.05 * n, capitals > 0.4 * chars, exclaimed > 0.1 * n]
    good = [n >= 40, 3 * n <= chars <= 10 * n, symbols <= 0.02 * n, letters >= 0.93 * chars, bare <= 0.02 * n, 0.04 * n <= ends <= 0.25 * n, dup == 0, repeat <= 0.02 * n, distinct >= 0.2 * n, capitals <= 0.15 * chars, exclaimed <= 0.03 * n]
    return [-1 if b else int(g) for b, g in zip(bad, good, strict=True)]


def brute_quality(votes):
    """Expectation-maximisation document by document, without patterns."""
    good = [(0.95, 0.4, 0.02)[min(2, v.count(-1))] for v in votes]
    held = qr.ANCHOR * len(votes) + 2
    for _ in range(500):
        logs = []
        for weights, expected in (([1 - g for g in good], (0.3, 0.1, 0.6)), (good, (0.01, 0.04, 0.95))):
            seen = [[held * expected[k + 1] + sum(w for w, v in zip(weights, votes, strict=True) if v[r] == k) for k in (-1, 0, 1)] for r in range(len(qr.RULES))]
            logs.append([[math.log(x / sum(row)) for x in row] for row in seen])
        share = (sum(good) + 1) / (len(good) + 2)
        odds = [math.log(share / (1 - share)) + sum(logs[1][r][k + 1] - logs[0][r][k + 1] for r, k in enumerate(v)) for v in votes]
        was, good = good, [1 / (1 + math.exp(-max(-500, min(500, o)))) for o in odds]
        if max(abs(a - b) for a, b in zip(was, good, strict=True)) < 1e-10:
            break
    return good


def test_quality_equals_an_estimate_by_document(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    votes = {d: brute_votes(t) for d, t in texts.items()}
    want = dict(zip(votes, brute_quality(list(votes.values())), strict=True))
    got = qr.quality_rules(docs).collect()
    assert all(abs(r.quality - want[r.doc_id]) < 1e-6 for r in got)
    assert all(r.kept == (not r.base_failed and want[r.doc_id] >= 0.5) for r in got)
    bad = {d: v.count(-1) for d, v in votes.items()}
    assert any(r.kept and bad[r.doc_id] for r in got)  # one bad vote is outweighed
    assert any(r.quality < 0.5 and bad[r.doc_id] == 1 for r in got) and len({r.kept for r in got if bad[r.doc_id] == 1 and not r.base_failed}) == 2


def test_clean_documents_stay_where_hardly_any_is_bad(spark):
    """After a classifier there is no junk to learn from: the estimate must not make a class of its own of lists or short texts."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    first = qr.quality_rules(docs).where("quality >= 0.5").select("doc_id")
    again = qr.quality_rules(docs.join(first, "doc_id", "left_semi")).where("NOT base_failed").selectExpr("avg(int(kept)) AS kept").first()
    assert again.kept > 0.995


def test_classes_are_told_apart_where_most_documents_are_bad():
    some = [((-1,) * len(qr.RULES), 90), ((1,) * len(qr.RULES), 10)]
    share, rates = qr.estimate(some)
    assert share < 0.2 and rates[1, 0, 2] > 0.8 and rates[0, 0, 0] > 0.8


def test_classifier_held_out_accuracy(spark):
    rng = np.random.default_rng(2)
    texts, labels = [], []
    for i in range(600):
        words = ["".join(rng.choice(list("abcdefgh"), 6)) for _ in range(60)]
        good = i % 3 > 0
        texts.append((i, " ".join(words if good else [w.upper() + "!!" for w in words])))
        labels.append((i, int(good), 0))
    docs = frame(spark, texts + TEXTS[3:6] + [(None, "a b")])
    lab = spark.createDataFrame(labels + [(None, 1, 0), (700, None, None), (5, 1, 0)], "doc_id long, quality int, toxic int")
    got = quality_scores(docs, lab).collect()
    assert len(got) == 604 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got if r.doc_id is not None)
    # ids 2 to 4 stand for other texts, too
    test = [r for r in got if r.held_out and r.doc_id is not None and 4 < r.doc_id < 600]
    assert np.mean([r.predicted == int(r.doc_id % 3 > 0) for r in test]) > 0.97
    assert quality_scores(frame(spark, []), lab).count() == 0
    none = spark.createDataFrame([], lab.schema)
    assert {round(r.score, 3) for r in quality_scores(frame(spark, texts[:3]), none).collect()} == {0.5}


def test_model_finds_an_interaction():
    rng = np.random.default_rng(3)
    x = rng.random((4000, 3))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    m = AdditiveModel().fit(x[:3000], y[:3000])
    assert ((m.score(x[3000:]) >= 0.5) == y[3000:]).mean() > 0.9


def test_sample_of_any_number_of_rows():
    from shardloom.llm.quality_classifier import HASHES, sample_below

    for rows in (50_000, 10**10, 10**12, 10**14):
        assert 0.96 < sample_below(rows, 40_000) / HASHES * rows / 40_000 <= 0.97


def test_sample_isnt_filled_by_one_id_and_labels_may_have_columns_of_the_same_names(spark):
    from shardloom.llm import quality_classifier as qc

    docs = frame(spark, [(7, f"row{k} of one id " * (k + 1)) for k in range(300)] + [(7, "again and again")] * 300)
    lab = spark.createDataFrame([(7, 1, 0.0, 5, "x", 1), (3, 0, 0.0, 6, "y", 2)], "doc_id long, quality int, log_words double, _label int, text_hash string, held_out int")
    taken = []
    real = qc.AdditiveModel.fit
    try:
        qc.AdditiveModel.fit = lambda self, x, y: (taken.append(len(y)), real(self, x, y))[1]
        assert qc.quality_scores(docs, lab, sample_rows=100).count() == 600
    finally:
        qc.AdditiveModel.fit = real
    assert zlib.crc32(b"7") % 3 != 1 and 50 <= taken[0] <= 130
