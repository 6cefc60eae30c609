"""The byte-level network against plain loops and finite differences."""

import json
import math
import os
import subprocess
import sys
from pathlib import Path

import numpy as np
import pytest

from chunkframe.llm.byte_cnn import BLOCK, CHUNK, OVERLAP, TAPS, ByteCNN, chunks

TEXTS = [b"", b"x", b"some words, then others; " * 150, bytes(range(256)) * 7, b"q" * CHUNK, b"q" * (CHUNK + 1)]


def plain_score(model, text):
    """One filter position after the other."""
    p, e, f = model.p, model.embed, model.filters
    step = CHUNK - OVERLAP
    starts = [0] + [s for s in range(step, len(text) - OVERLAP, step)]
    pooled = []
    for s in starts:
        piece = (text[s : s + CHUNK] + bytes(CHUNK))[:CHUNK]
        best = np.full(f, -np.inf)
        for at in range(0, CHUNK - BLOCK * TAPS + 1, BLOCK):
            r = np.zeros(f)
            for t in range(TAPS):
                for b in range(BLOCK):
                    vector = p["table"][piece[at + BLOCK * t + b]].astype(float)
                    r += vector @ p["conv"][b * e : (b + 1) * e, t * f : (t + 1) * f].astype(float)
            best = np.maximum(best, r)
        pooled.append(np.maximum(best + p["bias"], 0))
    z = float(np.concatenate((np.max(pooled, 0), np.mean(pooled, 0))) @ p["head"] + p["out"][0])
    return 1 / (1 + math.exp(-z))


def test_scores_equal_plain_loops():
    model = ByteCNN(embed=3, filters=5, seed=3)
    model.p["bias"] += np.linspace(-0.5, 0.5, 5, dtype=np.float32)
    model.p["out"] += np.float32(0.3)
    assert np.allclose(model.scores(TEXTS), [plain_score(model, t) for t in TEXTS], atol=1e-5)


def test_gradients_equal_finite_differences():
    model = ByteCNN(embed=3, filters=4, seed=1)
    model.p = {k: v.astype(np.float64) for k, v in model.p.items()}
    texts, y, weight = TEXTS[1:4], np.array([1.0, 0.0, 1.0]), np.array([0.7, 1.3, 1.0])

    def loss():
        s = model.scores(texts)
        return float((-weight * (y * np.log(s) + (1 - y) * np.log(1 - s))).mean())

    grads = model._gradients([chunks(t) for t in texts], y, weight)
    for name, g in grads.items():
        flat, param = g.reshape(-1), model.p[name].reshape(-1)
        for at in np.argsort(-abs(flat))[:6]:
            if not flat[at]:
                continue
            old = param[at]
            ends = []
            for step in (1e-5, -1e-5):
                param[at] = old + step
                ends.append(loss())
            param[at] = old
            assert math.isclose((ends[0] - ends[1]) / 2e-5, flat[at], rel_tol=2e-3, abs_tol=1e-6), (name, at)


COMPANY = """
import json
import numpy as np
from chunkframe.llm.byte_cnn import ByteCNN

rng = np.random.default_rng(0)
docs = [b"", b""] + [rng.integers(32, 127, n).astype(np.uint8).tobytes() for n in rng.integers(0, 9000, 30).tolist()]
differ = 0
for model in (ByteCNN(), ByteCNN().fit(docs, [i % 2 for i in range(len(docs))], epochs=3)):
    alone = [model.scores([d])[0] for d in docs]
    differ += int(alone[0] != alone[1])
    for _ in range(40):
        order = rng.permutation(len(docs))[: rng.integers(2, len(docs))]
        differ += int((model.scores([docs[i] for i in order]) != [alone[i] for i in order]).sum())
print(json.dumps([differ, ByteCNN().scores(docs).tolist()]))
"""


@pytest.fixture(scope="module")
def kernels():
    """Rows whose score depends on their company, and scores, by the matrix kernels of some processors."""
    def run(kind):
        env = {**os.environ, "OPENBLAS_CORETYPE": kind, "PYTHONPATH": os.pathsep.join([str(Path(__file__).resolve().parents[2]), *sys.path])}
        return json.loads(subprocess.run([sys.executable, "-c", COMPANY], env=env, check=True, capture_output=True, timeout=300).stdout)

    return {kind: run(kind) for kind in ("Haswell", "Sandybridge")}


def test_scores_do_not_depend_on_the_rows_beside(kernels):
    assert [differ for differ, _ in kernels.values()] == [0, 0]


def test_matrix_kernels_score_alike(kernels):
    (_, a), (_, b) = kernels.values()
    assert np.allclose(a, b, rtol=1e-15, atol=0)
