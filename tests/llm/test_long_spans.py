"""Spans of several hundred characters are decoded whole."""

from collections import Counter

import pytest

from chunkframe.llm import toxicity
from chunkframe.llm.toxicity import CharModel, Toxicity, suspicious, viterbi


def test_a_long_spelled_out_sentence_is_restored():
    words = "you are a worthless idiot and everybody knows that pathetic loser".split()
    cost = CharModel(Counter({w: 50 for w in words})).cost
    sentence = "".join(words * 8)
    for text in (" ".join(sentence), ".".join(sentence)):
        assert len(text) > 600
        assert sentence in [x.replace(" ", "") for x in viterbi(suspicious(text), cost)]
    leet = "w0rthl3ss" * 40
    assert [x.replace(" ", "") for x in viterbi(suspicious(leet), cost)] == ["worthless" * 40]


def plain_viterbi(span, cost):
    """Position by position over dicts of (cost, spelling)."""
    best = {26: (0.0, None)}
    for options in toxicity.lattice(span):
        new = {}
        for x, c in options:
            for a, (k, path) in best.items():
                b = a if x == 27 else x
                total = k + c + (0.0 if x == 27 else float(cost[a, x]))
                if b not in new or total < new[b][0] - 1e-9:
                    new[b] = (total, path if x == 27 else (path, x))
        best = new
    _, path = min(((k + float(cost[a, 26]), path) for a, (k, path) in best.items()), key=lambda x: x[0])
    out = []
    while path is not None:
        path, x = path
        out.append(" " if x == 26 else chr(97 + x))
    return "".join(out[::-1])


@pytest.mark.parametrize("length", [63, 64, 65, 200, 20_000])
def test_any_length_and_windows(length, monkeypatch):
    words = "you are a worthless idiot and everybody knows that pathetic loser".split()
    cost = CharModel(Counter({w: 50 for w in words})).cost
    source = ("y0u ar3 4 w0rthl3sss iidiooot" * (length // 20 + 1)).replace(" ", "")
    for span in (source[:length], ".".join(source)[:length]):
        whole = viterbi([span], cost)
        monkeypatch.setattr(toxicity, "BLOCK", 37)
        assert viterbi([span], cost) == whole
        monkeypatch.undo()
        if length <= 200:
            assert whole == [plain_viterbi(span, cost)]


def test_spelled_out_words_are_scored():
    bad = "you are such a stupid idiot and we all know that"
    good = "the people are fine today and the sun is out for us"
    model = Toxicity().fit([f"{bad} {i}" for i in range(40)] + [f"{good} {i}" for i in range(40)], [1] * 40 + [0] * 40)
    plain, spaced, wide, clean = model.scores([bad, " ".join(bad.replace(" ", "")), "  ".join(" ".join(w) for w in bad.split()), good])
    assert plain > 0.9 and spaced > 0.9 and wide > 0.9 and clean < 0.1
