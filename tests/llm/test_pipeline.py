"""Each stage of the pipeline against a brute-force version, on small tables with repeated and missing ids."""

import collections
import hashlib
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from shardloom.llm.packing import Lengths, pack
from shardloom.llm.quality_classifier import FEATURES, AdditiveModel, features_of, quality_scores
from shardloom.llm.secret_scan import ALLOWED, CLASSES

from .helpers import TEXTS, frame, library
from .test_near import labels, shingles
from .test_quality import brute, brute_quality, brute_votes
from .test_rest import SECRETS, spans

TABLES = "/root/testdata/sf0.001"
CLASH = ["_hash", "_id", "_node", "component_id", "kept", "text_hash", "size", "bin", "score"]


def rows_of(df):
    return sorted(((r.doc_id, r.text) for r in df.collect()), key=repr)


@pytest.fixture(scope="module")
def docs(spark):
    """Documents of the smallest table, odd rows, different texts under one id, and rows without an id."""
    some = spark.read.parquet(f"{TABLES}/documents.parquet").select("doc_id", "text")
    good, junk = "The plain words of a short document go on for a while, and end. Others follow them here, in a new sentence that says what came before it. ", "$$$ ### | " * 30
    odd = [*TEXTS[:9], *TEXTS[10:], *SECRETS, (9000, good + "a"), (9000, junk), (None, good + "b"), (None, junk), (None, None)]
    odd = spark.createDataFrame(odd, "doc_id long, text string")
    return some.unionByName(odd).withColumns({c: F.lit(k) for k, c in enumerate(CLASH)}).withColumn("n_chars", F.char_length("text")).cache()


def test_classify(spark, docs):
    table = [(r.doc_id, r.text) for r in docs.collect()]
    votes = collections.defaultdict(list)
    for r in spark.read.parquet(f"{TABLES}/labels.parquet").collect():
        if r.quality is not None:
            votes[r.doc_id].append(r.quality)
    label = {d: int(np.mean(v) >= 0.5) for d, v in votes.items()}
    train = sorted({(d, *features_of(t), label[d]) for d, t in table if d in label and zlib.crc32(str(d).encode()) % 3 != 1})
    x, y = np.array([r[1:-1] for r in train]), np.array([r[-1] for r in train], float)
    score = AdditiveModel().fit(x, y).score(np.array([features_of(t) for _, t in table]).reshape(-1, len(FEATURES)))
    out = corpus_pipeline.classify(spark, docs, TABLES)
    assert out.columns == docs.columns
    assert rows_of(out) == sorted((r for r, s in zip(table, score, strict=True) if s >= 0.5), key=repr)
    assert 0 < len(train) and (score < 0.5).any()


def test_rules(spark, docs):
    table = [(r.doc_id, r.text) for r in docs.collect()]
    quality = brute_quality([brute_votes(t or "") for _, t in table])

    def kept(t, q):
        n, _, _, _, repeat = brute(t or "")
        return n >= 10 and 100 * repeat <= 20 * n and q >= 0.5

    out = corpus_pipeline.rules(spark, docs, TABLES)
    assert out.columns == docs.columns
    got = rows_of(out)
    assert got == sorted((r for r, q in zip(table, quality, strict=True) if kept(r[1], q)), key=repr)
    assert sum(d == 9000 for d, _ in got) == 1 and any(d is None for d, _ in got) and all("$$$" not in t for d, t in got if d is None)


def test_one_of_each(spark, docs):
    more = docs.where("text IS NOT NULL").withColumn("doc_id", F.lit(None).cast("long")).limit(5)  # copies without an id
    docs = docs.unionByName(more).unionByName(docs.where("doc_id = 9000"))
    table = sorted({(r.doc_id, r.text) for r in docs.collect()}, key=repr)
    sets = [shingles(t, 5) for _, t in table]
    links = [(a, b) for a, x in enumerate(sets) for b, y in enumerate(sets[:a]) if x and y and 100 * len(x & y) >= 80 * len(x | y)]
    group = labels(range(len(table)), links)
    members = collections.defaultdict(list)
    for k, (d, _) in enumerate(table):
        members[group[k]].append((d is None, d or 0))
    out = corpus_pipeline.one_of_each(spark, docs, TABLES)
    assert out.columns == docs.columns
    got = rows_of(out)
    wordless = [r for r in got if not shingles(r[1], 5)]
    assert sorted(wordless, key=repr) == sorted(((r.doc_id, r.text) for r in docs.collect() if not shingles(r.text, 5)), key=repr)
    place = {r: k for k, r in enumerate(table)}
    kept = [(group[place[r]], (r[0] is None, r[0] or 0)) for r in got if shingles(r[1], 5)]
    assert sorted(kept) == sorted((g, min(m)) for g, m in members.items() if sets[g])
    assert sum(d == 9000 for d, _ in got) == 2  # different texts of one id


def entropy(w):
    p = np.array(list(collections.Counter(w).values())) / len(w)
    return float(-(p * np.log2(p)).sum())


def brute_mask(text):
    found = [(s[0], s[3]) for s in spans(text)]
    for c in CLASSES:
        new = []
        for m in re.finditer(c.run, text):
            v = m[0]
            hot = [i for i in range(len(v) - c.width + 1) if entropy(v[i : i + c.width]) >= c.bits - 1e-9]
            if hot and not any(re.search(p, v) for p in ALLOWED):
                span = (m.start() + hot[0], m.start() + hot[-1] + c.width)
                if not any(a <= span[0] and span[1] <= b for a, b in found):
                    new.append(span)
        found += new
    out, at = "", 0
    for a, b in sorted(found):
        if a >= at:
            out += text[at:a] + "[secret]"
        at = max(at, b)
    return out + text[at:]


def test_mask(spark, docs):
    out = corpus_pipeline.mask(spark, docs, TABLES)
    assert out.columns == docs.columns
    got = rows_of(out)
    assert got == sorted(((r.doc_id, None if r.text is None else brute_mask(r.text)) for r in docs.collect()), key=repr)
    assert sum("[secret]" in (t or "") for _, t in got) > 3
    assert all(r.n_chars == (None if r.text is None else len(r.text)) for r in out.collect())


def brute_pack(sizes, lengths):
    """Best fit once more: every open bin is looked at for each size, and the cost of each length is taken from all sizes still to come."""
    used, capacity, places = [], [], []
    for i, s in enumerate(sizes):
        rooms = [(c - u, b) for b, (u, c) in enumerate(zip(used, capacity, strict=True)) if c - u >= s]
        if rooms:
            b = min(rooms)[1]
        else:
            costs = []
            for length in lengths.permitted:
                if length >= s:
                    room = length - s
                    bound = max((p for p in lengths.permitted if p <= room), default=0)
                    filled = min(room, sum(x for x in sizes[i + 1 :] if x <= bound))
                    costs.append((lengths.cost(length) / (s + filled), length))
            b = len(used)
            used.append(0)
            capacity.append(min(costs, key=lambda c: c[0])[1])
        places.append((b, used[b]))
        used[b] += s
    return [(b, o, min(p for p in lengths.permitted if p >= used[b])) for b, o in places]


def test_pack(spark, docs):
    lib = library("word_bpe_49k.json")
    pieces = []
    for r in docs.collect():
        n = len(lib.encode(r.text or "", add_special_tokens=False).ids)
        pieces += [(-min(8192, n - k * 8192), r.doc_id is None, r.doc_id or 0, hashlib.md5(r.text.encode()).hexdigest(), k) for k in range(-(-n // 8192))]
    pieces.sort()
    places = brute_pack([-p[0] for p in pieces], Lengths())
    want = [(-n, None if none else d, t, k, b, o, made) for (n, none, d, t, k), (b, o, made) in zip(pieces, places, strict=True)]
    got = [(r.n_tokens, r.doc_id, r.text_key, r.piece, r.bin, r.bin_offset, r.bin_length) for r in corpus_pipeline.pack(spark, docs, TABLES).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)


def test_packer_equals_brute_force():
    rng = np.random.default_rng(12)
    for lengths in (Lengths(), Lengths((8, 16, 32), overhead=4), Lengths((10,), overhead=0)):
        for _ in range(30):
            sizes = sorted((int(x) for x in rng.integers(1, lengths.permitted[-1] + 1, rng.integers(1, 60)) ** rng.choice([1.0, 0.7])), reverse=True)
            bins, offsets, made = pack(sizes, lengths)
            assert [(b, o, made[b]) for b, o in zip(bins, offsets, strict=True)] == brute_pack(sizes, lengths)


def test_sequences_of_repeated_and_missing_ids(spark):
    """Different texts and copies under one id, and rows without one: every token comes back where it was placed."""
    from shardloom.llm.packing import Lengths, best_fit_tokens, sequences

    from .helpers import spec

    texts = [(1, "one two"), (1, "three"), (None, "four five six"), (None, "four five six"), (1, "one two"), (2, "seven " * 40), (3, None), (4, "")]
    docs, lib, lengths = frame(spark, texts), library("word_bpe_49k.json"), Lengths((8, 16))
    placed = best_fit_tokens(docs, spec("word_bpe_49k.json"), lengths)
    made = {r.bin: (r.bin_length, r.ids) for r in sequences(placed, docs, spec("word_bpe_49k.json"), longest=16).collect()}
    ids = {hashlib.md5((t or "").encode()).hexdigest(): lib.encode(t or "", add_special_tokens=False).ids for _, t in texts}
    want = collections.defaultdict(list)
    for r in sorted(placed.collect(), key=lambda r: (r.bin, r.bin_offset)):
        want[r.bin] += ids[r.text_key][r.piece * 16 : r.piece * 16 + 16]
    assert {b: i for b, (_, i) in made.items()} == dict(want)
    assert sum(len(i) for _, i in made.values()) == sum(len(lib.encode(t or "", add_special_tokens=False).ids) for _, t in texts)
    assert all(len(i) <= n for n, i in made.values())


def test_empty_tables(spark, tmp_path):
    empty = frame(spark, []).select("doc_id", "text", "lang", "source", "n_chars")
    empty.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_run_is_its_stages(spark):
    docs = spark.read.parquet(f"{TABLES}/documents.parquet")
    left = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        left = stage(spark, left, TABLES)
        assert left.columns == docs.columns
    packed = corpus_pipeline.pack(spark, left, TABLES)
    key = lambda df: sorted((r.doc_id, r.piece, r.n_tokens) for r in df.collect())
    assert key(corpus_pipeline.run(spark, TABLES)) == key(packed)


def test_classify_shuffles_no_text(spark, docs):
    """Verdicts beside the model are those of quality_scores(), and the plan that reads the texts has no join or exchange."""
    out = corpus_pipeline.classify(spark, docs, TABLES)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan
    judged = quality_scores(docs, spark.read.parquet(f"{TABLES}/labels.parquet")).where("predicted = 1")
    assert sorted(map(str, (r.doc_id for r in out.collect()))) == sorted(map(str, (r.doc_id for r in judged.collect())))
