import hashlib
import re

import pytest

from shardloom.llm.fill_in_middle import Markers, digests, fill_in_middle, restore, restored

from .helpers import TEXTS, frame, rows

MARKED = [(40, "has <P> inside"), (41, "and <M>"), (42, "<S>"), (43, "almost <P >< S> <<M"), (44, " lead and trail  \n"), (45, "<"), (46, "S> x <"), (47, "日本語 の テキスト 😀 と 単語")] + [(k, f"text {k} " * (k % 40)) for k in range(50, 250)]


def brute(doc_id, text):
    """The contract once more, by characters."""
    text = text or ""
    space = lambda c: c in " \t\n\v\f\r"
    units, i = [], 0
    while i < len(text):
        j = i
        while j < len(text) and space(text[j]):
            j += 1
        while j < len(text) and not space(text[j]):
            j += 1
        units.append(text[i:j])
        i = j
    n = len(units)
    h = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[k : k + 8], 16) for k in (0, 8, 16, 24))
    if not text or re.search("<[PSM]>", text) or h3 % 100 >= 50:
        return n, "plain", None, None, text
    a, b = min(h1 % (n + 1), h2 % (n + 1)), max(h1 % (n + 1), h2 % (n + 1))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    return (n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}") if h4 % 100 < 80 else (n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}")


def test_equals_brute_force_and_comes_back(spark):
    texts = TEXTS + MARKED
    made = fill_in_middle(frame(spark, texts))
    assert rows(made) == sorted([(d, *brute(d, t)) for d, t in texts], key=repr)
    assert rows(restored(made).select("doc_id", "restored")) == sorted([(d, t or "") for d, t in texts], key=repr)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    got = digests(made)
    assert got.columns == ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256"]
    want = [(d, n, form, p, m, sha(out), sha(t or "")) for d, t in texts for n, form, p, m, out in [brute(d, t)]]
    assert rows(got) == sorted(want, key=repr)
    assert {r.form for r in got.collect()} == {"plain", "spm", "psm"}
    assert fill_in_middle(frame(spark, [])).count() == 0


def test_shares_seed_and_markers(spark):
    docs = frame(spark, MARKED)
    assert {r.form for r in fill_in_middle(docs, percent=0).collect()} == {"plain"}
    marks = Markers("[pre]", "[suf]", "[mid]")
    all_ = fill_in_middle(docs, seed=7, percent=100, spm_percent=50, markers=marks)
    forms = [r.form for r in all_.collect()]
    assert forms.count("plain") <= 10 and 60 < forms.count("spm") < 140  # the ten or so empty ones stay plain
    assert rows(restored(all_, marks).select("doc_id", "restored")) == sorted([(d, t) for d, t in MARKED], key=repr)
    assert rows(all_) != rows(fill_in_middle(docs, seed=8, percent=100, spm_percent=50, markers=marks))
    for wrong in (("", "<S>", "<M>"), ("<P>", "[S]", "<M>"), ("<P<", "<S>", "<M>"), ("<P>", "<P>x", "<M>")):
        with pytest.raises(ValueError):
            Markers(*wrong)
    assert restore("<S>c<P>a <M>b ", "spm") == "a b c"
