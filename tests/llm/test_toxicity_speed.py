"""What the toxicity model finds quickly is what plain patterns and loops find."""

import random
import re
import time
from collections import Counter

import pytest

from chunkframe.llm import toxicity
from chunkframe.llm.toxicity import DENSE, Toxicity, suspicious

LEET = r"0-9@$!|+("
LEETED = re.compile(rf"[a-z]*[{LEET}][a-z{LEET}]*")
RUN_WORD = re.compile(r"[a-z]*([a-z])\1\1[a-z]*")
SPACED = re.compile(rf"(?<!\w)[a-z{LEET}](?:[ ._*-]{{1,2}}[a-z{LEET}]){{2,}}(?!\w)")
ALPHABET = "aaabbcdiouz 0123456789@$!|+(  ..__**--,;\n\xdf\xe9\xb2\xbc\u0663\u4e2d\u20ac\u0300'\x85\xa0\x1c"


def plain_suspicious(text):
    found = []
    for m in LEETED.finditer(text):
        whole, s = m.group(), m.group().rstrip("@$!|+(")
        if any("a" <= c <= "z" for c in s):
            found += [s] * (not s.isalpha()) + [whole] * (0 < len(whole) - len(s) <= 2)
    return found + [m.group() for p in (RUN_WORD, SPACED) for m in p.finditer(text)]


def test_spans_and_words_equal_plain_patterns():
    rng = random.Random(1)
    for k in range(40_000):
        text = "".join(rng.choices(ALPHABET, k=rng.randrange(24)))
        text = text if k % 3 else text.encode("latin-1", "ignore").decode("latin-1")
        assert suspicious(text) == plain_suspicious(text), text
        assert toxicity.words_of(text) == re.findall(r"[^\W\d_]+", text), text


def plain_features(words):
    stems = Counter()
    for w, n in words.items():
        for k in (4, 5, 6, 7):
            if len(w) > k:
                stems["^" + w[:k]] += n
    return {*words} | {s for s, n in stems.items() if n * DENSE >= sum(words.values())}


@pytest.mark.parametrize("total", [0, 1, DENSE - 1, DENSE, DENSE + 1, 2 * DENSE, 2 * DENSE + 1, 20 * DENSE])
def test_features_and_scores_equal_plain_loops(total):
    rng = random.Random(total)
    made = ["".join(rng.choices("abc", k=rng.randrange(1, 10))) for _ in range(400)]
    words = Counter(rng.choices(made, k=total))
    features = plain_features(words)
    assert Toxicity.features(words) == features
    model = Toxicity()
    model.cost = toxicity.CharModel({}).cost
    for w in [*features][::3] + ["^abca", "^aaaa", "^bcabc"]:
        model.weights[w] = rng.uniform(-0.1, 0.1)
    text = " ".join(words.elements())
    with_stems = plain_features(model.restored([text])[0])
    z = 0.3 + sum(model.weights[w] for w in sorted(with_stems & model.weights.keys()))
    model.bias = 0.3
    model.weighted([*model.weights], toxicity.np.array([0.3, *model.weights.values()]))
    assert model.scores([text, text]) == pytest.approx([1 / (1 + toxicity.math.exp(-z))] * 2, rel=1e-12)


@pytest.mark.parametrize("text", ["ab" * 100_000, "ab" * 100_000 + " aaa", "ab" * 100_000 + " 1dea"])
def test_long_words_are_scanned_once(text):
    began = time.process_time()
    assert suspicious(text) == text.split()[1:]
    assert time.process_time() - began < 2
