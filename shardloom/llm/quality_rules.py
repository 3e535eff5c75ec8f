"""Quality rules by weak supervision (operator 3), in DataFrame functions only.

Each rule votes good, votes bad or abstains. How often each of these happens among good and among
bad documents is estimated by expectation-maximisation over the counts of vote patterns (at most
three to the number of rules, 177,147, whatever the input); the posterior probability that a
document is good, by its votes, decides instead of a filter that all rules must pass. Rules look at
junk from several sides, so that bad documents mostly have several bad votes; one bad vote of a rule
that often errs is outweighed by the others' good ones.

Rows: null or empty text has no words and fails the base; a null id is kept; repeated rows each
give a row; an empty table gives an empty table; extra columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACES, id_and_text, staged

WINDOW = 5


@dataclass(frozen=True)
class Rule:
    """``bad`` and ``good`` are SQL conditions over measure()'s columns; neither holds: the rule abstains."""

    name: str
    bad: str
    good: str


RULES = (
    Rule("length", "n_words < 10", "n_words >= 40"),
    Rule("word_length", "word_chars < 2.5 * n_words OR word_chars > 12 * n_words", "word_chars BETWEEN 3 * n_words AND 10 * n_words"),
    Rule("symbols", "n_symbols > 0.10 * n_words", "n_symbols <= 0.02 * n_words"),
    Rule("letters", "n_letters < 0.85 * word_chars", "n_letters >= 0.93 * word_chars"),
    Rule("bare_marks", "n_bare > 0.1 * n_words", "n_bare <= 0.02 * n_words"),
    Rule("sentence_ends", "n_ends < 0.02 * n_words OR n_ends > 0.4 * n_words", "n_ends BETWEEN 0.04 * n_words AND 0.25 * n_words"),
    Rule("repeated_lines", "n_dup_lines > 0.3 * n_lines", "n_dup_lines = 0"),
    Rule("repeated_words", "n_repeat_words > 0.15 * n_words", "n_repeat_words <= 0.02 * n_words"),
    Rule("distinct_words", "n_distinct < 0.05 * n_words", "n_distinct >= 0.2 * n_words"),
    Rule("capitals", "n_capitals > 0.4 * word_chars", "n_capitals <= 0.15 * word_chars"),
    Rule("exclamations", "n_exclamations > 0.1 * n_words", "n_exclamations <= 0.03 * n_words"),
)


def measure(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text_hash and counts of each whole text: n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words, n_capitals, n_exclamations,
    n_letters, n_bare (words without letter or digit), n_ends (words that end a sentence) and n_distinct (words).

    Windows of five words are compared by 64-bit hashes of their words' hashes. Only a text in which
    some window recurs has its windows sorted; the words under recurring windows are then counted
    once each by the gaps between window starts.
    """
    d = id_and_text(docs, id_col, text_col).withColumn("text_hash", F.xxhash64("text")).withColumn("text", F.coalesce("text", F.lit("")))
    d = d.select("doc_id", "text", "text_hash", F.filter(F.split("text", f"{SPACES}+"), lambda w: w != "").alias("words"), F.filter(F.split("text", "\n"), lambda s: s.rlike(r"[^\x20\x09-\x0D]")).alias("lines"))
    d = d.select(
        "doc_id",
        "text_hash",
        F.size("words").cast("long").alias("n_words"),
        F.char_length(F.array_join("words", "")).cast("long").alias("word_chars"),
        F.regexp_count("text", F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.regexp_count("text", F.lit(r"\p{Lu}")).cast("long").alias("n_capitals"),
        F.regexp_count("text", F.lit("!")).cast("long").alias("n_exclamations"),
        F.char_length(F.regexp_replace("text", r"\P{L}+", "")).cast("long").alias("n_letters"),
        F.regexp_count("text", F.lit(r"(?<![^\x20\x09-\x0D])[^\p{L}\p{N}\x20\x09-\x0D]+(?![^\x20\x09-\x0D])")).cast("long").alias("n_bare"),
        F.regexp_count("text", F.lit(r"""[.!?。]["')\]]*(?![^\x20\x09-\x0D])""")).cast("long").alias("n_ends"),
        F.transform("words", lambda w: F.xxhash64(w)).alias("hashes"),
    )
    d = d.withColumn("n_distinct", F.size(F.array_distinct("hashes")).cast("long"))
    plain = [c for c in d.columns if c != "hashes"]
    windows = F.transform(F.sequence(F.lit(0), (F.col("n_words") - WINDOW).cast("int")), lambda i: F.xxhash64(*[F.get("hashes", i + k) for k in range(WINDOW)]))
    d = d.select(*plain, F.when(F.col("n_words") > WINDOW, windows).alias("windows"))
    places = F.sort_array(F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    d = d.select(*plain, F.when(F.size(F.array_distinct("windows")) < F.size("windows"), places).alias("places"))
    same = lambda e, k: (F.get("places", k)["h"] == e["h"])
    again = F.transform("places", lambda e, k: F.when(((k > 0) & F.coalesce(same(e, F.greatest(k - 1, F.lit(0))), F.lit(False))) | F.coalesce(same(e, k + 1), F.lit(False)), e["i"]))
    d = d.select(*plain, F.sort_array(F.filter(again, lambda i: i.isNotNull())).alias("starts"))
    covered = F.aggregate(F.transform("starts", lambda v, k: F.least(F.lit(WINDOW), F.coalesce(F.get("starts", k + 1) - v, F.lit(WINDOW)))), F.lit(0), lambda a, x: a + x)
    return d.select(*plain, F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"))


def vote(rule: Rule) -> Column:
    return F.expr(f"CASE WHEN {rule.bad} THEN -1 WHEN {rule.good} THEN 1 ELSE 0 END")


def base_failed() -> Column:
    return F.expr("n_words < 10 OR 100 * n_repeat_words > 20 * n_words")


#: Anchors: each class has this share of all documents more (and two), whose votes are bad, abstaining and good in these shares. They say which
#: class is which and hold the bad one where hardly any document is bad; what documents say outweighs them, and no rate is bounded.
ANCHOR = 0.05
EXPECTED = ((0.3, 0.1, 0.6), (0.01, 0.04, 0.95))  # of the bad class, of the good class
#: First guess of a document's quality by the number of its bad votes (the last for that many and more).
START = (0.95, 0.4, 0.02)


def estimate(patterns: list[tuple[tuple[int, ...], int]], rounds: int = 500) -> tuple[float, np.ndarray]:
    """Share of good documents, and [class, rule, outcome] rates: class 1 is good, outcomes are bad, abstain, good.

    ``patterns``: votes and how many documents have them. ANCHOR keeps the classes apart. No documents
    give the rates that are expected.
    """
    votes = np.array([v for v, _ in patterns], np.int64).reshape(-1, len(RULES)) + 1
    counts = np.array([c for _, c in patterns], np.float64)
    n = counts.sum()
    good = np.array(START)[np.minimum((votes == 0).sum(1), len(START) - 1)]
    held = ANCHOR * n + 2
    rates = np.repeat(np.array(EXPECTED)[:, None, :], len(RULES), axis=1)
    share = 0.5
    for _ in range(rounds if n else 0):
        share = (good @ counts + 1) / (n + 2)
        for k, weight in enumerate(((1 - good) * counts, good * counts)):
            for r in range(len(RULES)):
                seen = np.bincount(votes[:, r], weight, 3) + held * np.array(EXPECTED[k])
                rates[k, r] = seen / seen.sum()
        before, good = good, 1 / (1 + np.exp(-log_odds(share, rates, votes - 1)))
        if np.abs(good - before).max() < 1e-10:
            break
    return float(share), rates


def log_odds(share: float, rates: np.ndarray, votes: np.ndarray) -> np.ndarray:
    """Of being good, for each row of ``votes``."""
    weight = np.log(rates[1] / rates[0])
    return np.clip(np.log(share / (1 - share)) + sum(weight[r, votes[:, r] + 1] for r in range(len(RULES))), -500, 500)


def quality_rules(docs: DataFrame, threshold: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """measure()'s columns with base_failed, quality (posterior probability) and kept for each row of ``docs``.

    The texts are read once; the counts, a few numbers a row, are written to the shared folder for
    the estimate and the verdict.
    """
    votes = F.array(*[vote(r) for r in RULES])
    counted = staged(measure(docs, id_col, text_col).withColumn("votes", votes), "quality-rules")
    patterns = [(tuple(r.votes), r["count"]) for r in counted.groupBy("votes").count().collect()]  # at most 3 ** len(RULES) rows
    share, rates = estimate(sorted(patterns))
    weights = np.log(rates[1] / rates[0]).tolist()
    odds = F.lit(float(np.log(share / (1 - share))))
    for k, of in enumerate(weights):
        odds = odds + F.get(F.array(*map(F.lit, of)), F.get("votes", F.lit(k)) + 1)
    judged = counted.withColumn("quality", 1 / (1 + F.exp(-odds))).withColumn("base_failed", base_failed())
    return judged.withColumn("kept", ~F.col("base_failed") & (F.col("quality") >= threshold)).drop("votes")
