"""Scopes and containment against a brute-force version by documents, and a very long document."""

import math
import random
import re
import time

from pyspark.sql import functions as F

from shardloom.operators import structure as st

W = st.Weights()
PRIORITY = {n: len(st.RULES) - k for k, n in enumerate(st.NAMES)}


def score_of_steps(values, short):
    if len(values) < 2:
        return short
    return sum(1.0 if b == a + 1 else 0.5 if b == 1 else 0.0 for a, b in zip(values, values[1:])) / (len(values) - 1)


def by_type(rows):
    out = {}
    for r in rows:
        out.setdefault(r["type"], []).append(r)
    return out


def inferred(rows, length):
    """Level of each type: how much it holds, how often inner ones start anew, its numbers, order and gaps."""
    groups = by_type(rows)
    gap = {t: sum(b["start"] - a["start"] for a, b in zip(g, g[1:])) / (len(g) - 1) if len(g) > 1 else length for t, g in groups.items()}
    scores = {}
    for t, g in groups.items():
        if len(g) < 2:
            continue
        parts, starts, any_inner = [], 0, False
        for u, h in groups.items():
            if u == t or not gap[t] > gap[u] * W.outer_gap:
                continue
            any_inner, held = True, 0
            for a, b in zip(g, [*g[1:], {"start": length + 1}]):
                inside = [r for r in h if a["start"] <= r["start"] < b["start"]]
                held += len(inside)
                starts += next((r["value"] for r in inside if r["value"] is not None), None) == 1
            if held / len(g) >= 1:
                parts.append(min(1.0, held / len(g) / 4))
        contain = sum(parts) / len(parts) if parts else 0.0
        reset = starts / len(g) if any_inner else 0.0
        steps = score_of_steps([r["value"] for r in g if r["value"] is not None], 0.5)
        scores[t] = contain * 4 + reset * 3 + steps + PRIORITY[t] / 13 * 1.5 + min(gap[t] / max(length, 1) * 10, 2)
    order = sorted(scores, key=lambda t: (-scores[t], groups[t][0]["start"]))
    return {t: min(4, order.index(t) + 1 if t in scores else st.HINTS[t]) for t in groups}


def raw_inside(text, kind):
    """Whether lines of an inner enumeration follow each other in a section's text."""
    values = {}
    for line in text.split("\n"):
        line = line.lstrip()
        for name, pattern in (("numeric_dot", r"^(\d{1,2})[.)．](?!\d)"), ("numeric_paren", r"^[（(](\d+)[)）]")):
            if m := re.match(pattern, line):
                if name != kind and st.HINTS[name] > st.HINTS[kind]:
                    values.setdefault(name, []).append(int(m[1]))
                break
    return any(score_of_steps(v, 0.0) > 0 for v in values.values())


def scopes(rows, lo, hi, level, preferred, out):
    if not rows or level > 4:
        return
    groups, scores = by_type(rows), {}
    for t, g in groups.items():
        head = g[0]["start"] <= lo + max(hi - lo, 1) * W.head_zone
        if len(g) == 1:
            spans = [(g[0], hi, 1.0)] if head else []
        else:
            spans = [(a, b["start"], 1.0) for a, b in zip(g, g[1:])] + [(g[-1], hi, W.open_tail)]
        hits = total = 0.0
        for a, b, weight in spans:
            strength = 0.0
            for u, h in groups.items():
                inside = [r["value"] for r in h if a["start"] < r["start"] < b and r["value"] is not None] if u != t else []
                if any(y == x + 1 for x, y in zip(inside, inside[1:])):
                    strength = 1.0
            strength = strength or (W.raw_items if a["raw"] else 0.0)
            if weight >= 1 or strength > 0:
                hits, total = hits + weight * strength, total + weight
        cover = (g[-1]["start"] - g[0]["start"]) / max(hi - lo, 1) if len(g) > 1 else 1.0 if head else 0.3
        scores[t] = (
            (hits / total if total else 0.0) * W.containment
            + score_of_steps([r["value"] for r in g if r["value"] is not None], 0.0) * W.sequence
            + cover * W.coverage
            + math.log(1 + len(g)) / math.log(max(len(rows), 2)) * W.frequency
            + PRIORITY[t] / 13 * W.priority
            + (W.preferred if t == preferred else 0.0)
        )
    best = min(scores, key=lambda t: (-scores[t], groups[t][0]["start"]))
    chosen = {t for t in scores if st.HINTS[t] == st.HINTS[best]}
    inner = [t for t in scores if t not in chosen and st.HINTS[t] > st.HINTS[best]]
    following = min(inner, key=lambda t: (-scores[t], groups[t][0]["start"])) if inner else None
    marks = [r for r in rows if r["type"] in chosen]
    for k, r in enumerate(marks):
        out[r["start"]] = level
        end = marks[k + 1]["start"] if k + 1 < len(marks) else hi
        scopes([x for x in rows if x["type"] not in chosen and r["start"] < x["start"] < end], r["start"], end, level + 1, following, out)


def document(seed):
    """Random rules: some articles hold items, some sentences, some items too long to be headings."""
    rng = random.Random(seed)
    lines, art = ["規程", ""], 0
    for chapter in range(1, rng.randint(2, 6)):
        if rng.random() < 0.8:
            lines += [f"第{chapter}章 総則", ""]
        for _ in range(rng.randint(1, 4)):
            art += 1
            lines.append(f"第{art}条（目的）" if rng.random() < 0.9 else f"第{art}項 適用")
            kind = rng.random()
            for i in range(1, rng.randint(2, 5)):
                tail = "定める" * rng.randint(1, 3)
                if kind < 0.4:
                    lines.append(f"{i}. {tail}")
                elif kind < 0.7:
                    lines.append(f"({i}) " + "とても長い項目であるから見出しにはならない。" * 5)
                else:
                    lines.append(f"{tail}である。")
            lines.append("")
    return "\n".join([*lines, "附則", "施行する。"])


def test_scopes_equal_brute_force(spark):
    texts = {k: document(k) for k in range(40)}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    found = st.candidates(docs).collect()
    got = {True: {}, False: {}}
    for raw in got:
        for r in st.scope_levels(st.candidates(docs), docs=docs if raw else None).collect():
            got[raw].setdefault(r.doc_id, {})[r.start_char] = r.level
    changed = 0
    for d, text in texts.items():
        rows = sorted(({"start": r.start_char, "type": r.marker_type, "value": r.value, "raw": False} for r in found if r.doc_id == d), key=lambda r: r["start"])
        want = {}
        scopes(rows, 0, len(text), 1, None, want)
        assert got[False].get(d, {}) == want, d
        levels = inferred(rows, len(text))
        for k, r in enumerate(rows):
            end = next((x["start"] for x in rows[k + 1 :] if levels[x["type"]] <= levels[r["type"]]), len(text))
            r["raw"] = st.HINTS[r["type"]] < 4 and raw_inside(text[r["start"] : end], r["type"])
        with_raw = {}
        scopes(rows, 0, len(text), 1, None, with_raw)
        assert got[True].get(d, {}) == with_raw, d
        changed += want != with_raw
    assert changed  # some scopes are decided by raw lines


def test_a_very_long_document(spark):
    n = 25_000
    text = "\n".join(f"第{k}章 編\n第{k}条（目的）\n1. 定める\n2. 従う" for k in range(1, n + 1))
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    cands = st.candidates(docs).cache()
    assert cands.count() == 4 * n
    began = time.time()
    stats = st.group_stats(cands)
    held = {r.marker_type: (r.containment, r.reset) for r in st.containment(cands, stats).collect()}
    took = time.time() - began
    assert held["japanese_chapter"][1] >= 1.0 and took < 20
    began = time.time()
    scored = st._scope_scores(cands.withColumns({"scope_start": F.lit(0), "scope_end": F.col("text_length"), "preferred": F.lit(None).cast("string"), "raw": F.lit(False)}), W, True)
    assert scored.count() == 3 and time.time() - began < 20
    cands.unpersist()


def test_the_third_chunker_has_two_levels(spark):
    from shardloom.plans import registry

    text = "規程\n\n第1章 総則\n\n前置きの文である。\n\n第1条（目的）\n1. 目的を定める。\n2. 適用を定める。\n\n第2条（定義）\nことばを定める。\n社員とは雇われた者である。\n\n第2章 服務\n\n第3条（服務）\n1. 守るものとする。\n2. 努めるものとする。\n\n第4条（休暇）\n休むことができる。\n届けるものとする。\n\n附則\nこの規程は施行する。"
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    rows = registry.chunker("logic_03")(docs).orderBy("chunk_index").collect()
    one, two = "### 第1条（目的）\n#### 1. 目的を定める。\n#### 2. 適用を定める。", "### 第2条（定義）\nことばを定める。\n社員とは雇われた者である。"
    three, four = "### 第3条（服務）\n#### 1. 守るものとする。\n#### 2. 努めるものとする。", "### 第4条（休暇）\n休むことができる。\n届けるものとする。"
    want = [("parent", f"## 第1章 総則\n前置きの文である。\n{one}\n{two}"), ("child", one), ("child", two), ("parent", f"## 第2章 服務\n{three}\n{four}"), ("child", three), ("child", four), ("parent", "## 附則\nこの規程は施行する。")]
    assert [(r.role, r.chunk_text) for r in rows] == want
    assert {r.parent_chunk_id or r.child_chunk_id or r.grandchild_chunk_id for r in rows} == {None}
    fourth = registry.chunker("logic_04")(docs).collect()
    assert {r.role for r in fourth} == {"parent", "child", "grandchild"} and all(r.chunk_text.startswith("# 規程\n## ") for r in fourth)
