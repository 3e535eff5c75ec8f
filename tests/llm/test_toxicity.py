import zlib

import numpy as np

from shardloom.llm import toxicity
from shardloom.llm.toxicity import FactorizationMachine, terms_of, toxicity_scores

from .helpers import TEXTS, frame

LABELS = "doc_id long, toxic int, quality int, _label int, text string, held_out int, score double"


def labelled(spark, values):
    return spark.createDataFrame([(d, t, 0, 1, "x", 0, 0.0) for d, t in values], LABELS)


def corpus(n=900, seed=4):
    rng = np.random.default_rng(seed)
    words = ["".join(rng.choice(list("abcdefghij"), 5)) for _ in range(400)]
    texts, toxic = [], []
    for i in range(n):
        own = list(rng.choice(words, 60))
        if i % 4 == 0:
            own[int(rng.integers(60))] = str(rng.choice(["vileworm", "scumfoo", "dreckbar"]))
        texts.append((i, " ".join(own)))
        toxic.append((i, int(i % 4 == 0)))
    return texts, toxic


def test_held_out_accuracy_and_odd_rows(spark):
    texts, toxic = corpus()
    odd = [(5000 + k, t) for k, (_, t) in enumerate(TEXTS)] + [(None, "no id"), (None, "vileworm no id")]
    got = toxicity_scores(frame(spark, texts + odd), labelled(spark, toxic + [(None, 1), (6000, None), (3, 0)])).collect()
    assert len(got) == len(texts) + len(odd)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    held = [r for r in got if r.held_out and r.doc_id < 900]
    assert len(held) > 150 and np.mean([r.predicted == int(r.doc_id % 4 == 0) for r in held]) > 0.98
    alike = [r.score for r in got if r.doc_id in (5001, 5002)]
    assert alike[0] == alike[1]
    none, empty = (next(r.score for r in got if r.doc_id == d) for d in (5004, 5005))
    assert none == empty


def test_empty_tables_and_labels_of_one_class(spark):
    texts, toxic = corpus(40)
    docs = frame(spark, texts)
    assert toxicity_scores(frame(spark, []), labelled(spark, toxic)).count() == 0
    assert {round(r.score, 9) for r in toxicity_scores(docs, labelled(spark, [])).collect()} == {0.0}
    assert {round(r.score, 9) for r in toxicity_scores(docs, labelled(spark, [(d, 1) for d, _ in texts])).collect()} == {1.0}


def test_pairs_that_weights_alone_miss():
    """Two insults and two groups: an insult is toxic with its own group and harmless with the other, which no sum of weights can say."""
    rng = np.random.default_rng(6)
    texts, y = [], []
    for _ in range(4000):
        insult, group = [("snake", "north"), ("snake", "south"), ("donkey", "north"), ("donkey", "south")][int(rng.choice(4, p=[0.4, 0.2, 0.2, 0.2]))]
        texts.append(" ".join([*rng.choice([f"w{k}" for k in range(300)], 12), insult, group]))
        y.append(float((insult, group) in (("snake", "north"), ("donkey", "south"))))
    buckets, starts = terms_of(texts)
    y, cut = np.array(y), 3000
    right = {}
    for factors in (0, 8):
        m = FactorizationMachine(factors=factors).fit(buckets[: starts[cut]], starts[: cut + 1], y[:cut])
        p = m.score(buckets[starts[cut] :], starts[cut:] - starts[cut])
        right[factors] = ((p >= 0.5) == y[cut:]).mean()
    assert right[8] > 0.97 and right[8] > right[0] + 0.15


def brute_terms(text):
    """Terms by words, one after another, with the same hashes."""
    base, two = int(toxicity._BASE), 1 << 64
    found, word = set(), b""
    for c in [*(text or "").lower().encode(), 32]:
        if toxicity._LETTERS[c]:
            word += bytes([c])
        elif word:
            for salt, part in [(0, word), *((n, word[:n]) for n in toxicity.PREFIXES if len(word) >= n)]:
                h = (sum((b + 1) * pow(base, i, two) for i, b in enumerate(part)) + salt * base) % two
                h = (h ^ h >> 30) * 0xBF58476D1CE4E5B9 % two
                h = (h ^ h >> 27) * 0x94D049BB133111EB % two
                found.add((h ^ h >> 31) % toxicity.BUCKETS)
            word = b""
    return sorted(found)


def test_terms_by_blocks_equal_terms_by_words(monkeypatch):
    texts = [t for _, t in TEXTS] + ["tail", "ünïcödé words, ÀNDMORE " * 50, "y" * 900 + " z"]
    texts[11] = texts[11][:3000]
    want = [brute_terms(t) for t in texts]
    for size in (1 << 20, 200, 7):
        monkeypatch.setattr(toxicity, "BLOCK_BYTES", size)
        toxicity._held_powers.clear()
        buckets, starts = terms_of(texts)
        assert [buckets[a:b].tolist() for a, b in zip(starts, starts[1:])] == want
    toxicity._held_powers.clear()


def test_sample_is_bounded_and_repeated_rows_count_once(spark):
    texts, toxic = corpus(600)
    taken = []
    real = FactorizationMachine.train
    try:
        FactorizationMachine.train = lambda self, b, s, y: (taken.append(len(y)), real(self, b, s, y))[1]
        again = [texts[0]] * 500
        docs = frame(spark, texts + again)
        toxicity.fit(docs.select("doc_id", "text"), labelled(spark, toxic), sample_rows=200)
        toxicity.fit(docs.select("doc_id", "text"), labelled(spark, toxic), sample_bytes=10_000)
        toxicity.fit(docs.select("doc_id", "text"), labelled(spark, toxic))
    finally:
        FactorizationMachine.train = real
    own = sum(zlib.crc32(str(d).encode()) % 4 != 2 for d, _ in texts)
    assert 60 < taken[0] < 200 and 5 < taken[1] < 60 and taken[2] == own


def test_planted_texts_of_the_smallest_tables(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    got = toxicity_scores(docs, labels).join(labels, "doc_id").collect()
    held = [r for r in got if r.held_out]
    assert np.mean([r.predicted == r.toxic for r in held]) > 0.92  # labels of rare languages and of junk that hides its words are beyond so small a sample
    assert sum(r.predicted for r in held if r.toxic == 0) <= 2
