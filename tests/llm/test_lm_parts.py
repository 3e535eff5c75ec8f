"""The language model's readers and sums against plain versions of them."""

import random

import numpy as np
import pyarrow as pa

from shardloom.llm import lm_scoring
from shardloom.llm.common import lower_words_of

from .helpers import TEXTS


def test_words_of_a_batch():
    rng = random.Random(5)
    odd = ["".join(chr(rng.choice([*range(300), 0x85, 0x2028, 0x3000, 0x1F600])) for _ in range(rng.randrange(60))) for _ in range(500)]
    for texts in ([], [None], ["", ""], [t for _, t in TEXTS] + odd):
        words, n = lm_scoring.words_of_batch(pa.array(texts, pa.string()))
        want = [lower_words_of(t) for t in texts]
        assert n.tolist() == [len(x) for x in want]
        assert words.cast(pa.binary()).to_pylist() == [w for x in want for w in x]


def test_sums_by_row_and_scores():
    """Against sums row by row, and log probabilities worked out in double precision, small and large."""
    rng = np.random.default_rng(3)
    rows, values = rng.integers(0, 7, 50), rng.standard_normal((50, 4))
    got = lm_scoring.sum_rows(lm_scoring.cells_of(9, 4), rows, values)
    assert np.allclose(got, [values[rows == k].sum(0) for k in range(9)])
    share = rng.random(30) ** 6 + 1e-9
    for wide in (1, 40):
        m = lm_scoring.LogBilinear(share / share.sum(), 4, 3)
        m.out *= wide
        m.context *= wide
        text = rng.integers(0, 30, 700).astype("<u2")
        out, context, place, bias = (getattr(m, p).astype(float) for p in m._PARTS)
        want = []
        for i, c in enumerate(text):
            q = sum(context[text[i - j - 1] if i > j else 30] * place[j] for j in range(3))
            s = out @ q + bias
            want.append(s[c] - s.max() - np.log(np.exp(s - s.max()).sum()))
        assert np.allclose(m.log_probs([text]), want, rtol=1e-4, atol=1e-3)
