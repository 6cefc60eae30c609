"""Toxicity by noisy-channel deobfuscation.

Suspicious spans of a text become character lattices: a leetspeak character may stand
for letters or for nothing, a long run of one letter for one or two of it, a separator
between single letters for nothing or for a word boundary, two separators for a boundary.
Viterbi decoding under a character bigram model picks the restored spelling; all
lattices of a batch are decoded together, a span of more than ``BLOCK`` positions in
windows.  Letters spelled out without a boundary are cut into words by a second Viterbi
pass under the word frequencies.  The restored text is scored by a logistic model over its
words.  A span without alternatives has one path only and needs no decoding.

Every labelled row that may be learnt from counts: ``toxicity_fit.fit`` takes letter pairs, word
frequencies, the documents of each feature and the logistic model from a whole table, in
tasks; ``Toxicity.fit`` gets the same model from lists.  All counts are whole numbers and the
penalised loss has one optimum, so neither order nor partitions matter.

Defined results: null and empty texts have no words and get the score of the model's
intercept; texts and spans of any length are read whole, with at most ``BLOCK`` lattice
positions decoded at once; repeated rows get the same score; empty
tables give empty tables; with only one label among the rows the score leans to it.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable, Iterable, Iterator, Mapping
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from ._common import in_parts, without

BLOCK = 1 << 18  # lattice positions that are decoded together
# Letters that a character may stand for.
LEET = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "bg", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "li", "+": "t", "(": "c"}
_LEET_CLASS = r"0-9@$!|+("
# Less the letters before them; with these in front, long words would be scanned from each letter.
_LEETED = re.compile(rf"[{_LEET_CLASS}][a-z{_LEET_CLASS}]*")
_RUN_WORD = re.compile(r"([a-z])\1\1[a-z]*")
_SPACED = re.compile(rf"(?<!\w)[a-z{_LEET_CLASS}](?:[ ._*-]{{1,2}}[a-z{_LEET_CLASS}]){{2,}}(?!\w)")
# The second and third character of every ``_SPACED`` span.
_SPACED_WITHIN = re.compile(rf"[ ._*-][a-z{_LEET_CLASS}][ ._*-]{{1,2}}[a-z{_LEET_CLASS}](?![a-z])")
_WORD = re.compile(r"[^\W\d_]+")
_LETTERS = bytes(i if _WORD.fullmatch(chr(i)) else 32 for i in range(256))
_EDGE = 26  # the state at word boundaries
_SKIP = 27
# Costs of the channel in nats.
COST_LEET, COST_DROP_SYMBOL, COST_DROP_REPEAT, COST_DROP_DOUBLE, COST_KEEP_REPEAT, COST_DROP_SEPARATOR, COST_BOUNDARY = 0.5, 7.0, 0.3, 4.0, 1.0, 0.2, 3.0


def lattice(span: str) -> list[list[tuple[int, float]]]:
    """Per position: (letter 0..25, boundary or skip; cost)."""
    spaced = bool(_SPACED.fullmatch(span))
    out = []
    for i, c in enumerate(span):
        again = i > 0 and span[i - 1] == c
        long = any(len({*span[k : k + 3]}) == 1 and len(span[k : k + 3]) == 3 for k in range(max(0, i - 2), i + 1))
        out.append(_options(c, spaced, again, long))
    return out


def _options(c: str, spaced: bool, again: bool, long: bool) -> list[tuple[int, float]]:
    """What one character may stand for: ``again``, the one before is the same; ``long``,
    it is part of three or more of the same."""
    if "a" <= c <= "z":
        first = [(ord(c) - 97, 0.0)]
    elif c in LEET:
        first = [(ord(x) - 97, COST_LEET) for x in LEET[c]] + [(_SKIP, COST_DROP_SYMBOL)]
    elif spaced:
        return [(_EDGE, 0.0)] if again else [(_SKIP, COST_DROP_SEPARATOR), (_EDGE, COST_BOUNDARY)]
    else:
        return [(_EDGE, 0.0)]
    if not again:
        return first
    written = [(x, cost) for x, cost in first if x < _EDGE]
    if long:
        return [(x, cost + COST_KEEP_REPEAT) for x, cost in written] + [(_SKIP, COST_DROP_REPEAT)]
    return [*written, (_SKIP, COST_DROP_DOUBLE)]


_ARCS = max(map(len, LEET.values())) + 1
_PAD = 127  # a code that no span holds: nothing is written


def _option_table() -> tuple[np.ndarray, np.ndarray]:
    """Letters and costs by (spaced, 0 first / 1 double / 2 long, code, arc)."""
    letter = np.full((2, 3, 128, _ARCS), -1, np.int8)
    price = np.zeros((2, 3, 128, _ARCS), np.float32)
    for spaced in (0, 1):
        for state in range(3):
            for code in range(127):
                for k, (x, c) in enumerate(_options(chr(code), bool(spaced), state > 0, state == 2)):
                    letter[spaced, state, code, k], price[spaced, state, code, k] = x, c
            letter[spaced, state, _PAD, 0] = _SKIP
    return letter, price


_LETTER, _PRICE = _option_table()


def _states(codes: np.ndarray) -> np.ndarray:
    """0, 1 or 2 for each position of the rows: first of its run, in a double, in a long run."""
    same = np.zeros(codes.shape, bool)
    same[:, 1:] = codes[:, 1:] == codes[:, :-1]
    three = np.zeros(codes.shape, bool)
    three[:, 2:] = same[:, 2:] & same[:, 1:-1]
    long = three.copy()
    long[:, :-1] |= three[:, 1:]
    long[:, :-2] |= three[:, 2:]
    return np.where(same, np.where(long, 2, 1), 0)


class CharModel:
    """Bigram costs (-log p) over 26 letters and the word edge."""

    UNIT = 1 << 20  # parts of a count: whole numbers add up alike in any order

    def __init__(self, words: Mapping[str, int]):
        self.cost = self.costs(self.pairs(words.items()))

    @classmethod
    def pairs(cls, counted: Iterable[tuple[str, int]]) -> np.ndarray:
        """Sums for ``costs`` of some of the words; those of all words are their sum."""
        n = [0] * 27 * 27
        for word, count in counted:
            if word.isascii():
                path = [_EDGE, *(ord(c) - 97 for c in word), _EDGE]
                parts = round(math.log1p(count) * cls.UNIT)
                for a, b in zip(path, path[1:]):
                    n[27 * a + b] += parts
        return np.array(n, np.int64)

    @classmethod
    def costs(cls, pairs: np.ndarray) -> np.ndarray:
        n = 0.2 + pairs.reshape(27, 27) / cls.UNIT
        return (-np.log(n / n.sum(1, keepdims=True))).astype(np.float32)


def viterbi(spans: list[str], cost: np.ndarray) -> list[str]:
    """The best spelling of each span; word boundaries become spaces."""
    out = [""] * len(spans)
    by_length: dict[int, list[int]] = {}
    for i, s in enumerate(spans):
        by_length.setdefault(-(-len(s) // 8) * 8, []).append(i)
    for length, members in by_length.items():
        step = max(1, min(4096, BLOCK // max(length, 1)))
        for at in range(0, len(members), step):
            rows = members[at : at + step]
            for i, text in zip(rows, _decode([spans[i] for i in rows], length, cost)):
                out[i] = text
    return out


def _decode(spans: list[str], length: int, cost: np.ndarray) -> list[str]:
    """Back pointers are kept for ``BLOCK`` positions at a time: a longer span is passed once
    for the states at the cuts, and its windows once more from the end."""
    n = len(spans)
    codes = np.full((n, length), _PAD, np.uint8)
    for i, s in enumerate(spans):
        codes[i, : len(s)] = np.frombuffer(s.encode("ascii"), np.uint8)
    state = _states(codes)
    spaced = np.array([bool(_SPACED.fullmatch(s)) for s in spans]).astype(int)
    rows = np.arange(n)

    def steps(best, lo, hi, came=None):
        for t in range(lo, hi):
            letter, price = _LETTER[spaced, state[:, t], codes[:, t]], _PRICE[spaced, state[:, t], codes[:, t]]
            new = np.full((n, 27), np.inf, np.float32)
            from_ = np.zeros((n, 27), np.int8)  # state before; _SKIP: the same, nothing written
            for k in range(_ARCS):
                x = letter[:, k]
                skip = np.flatnonzero(x == _SKIP)
                if len(skip):
                    cand = best[skip] + price[skip, k][:, None]
                    better = cand < new[skip]
                    new[skip] = np.where(better, cand, new[skip])
                    from_[skip] = np.where(better, _SKIP, from_[skip])
                write = np.flatnonzero((x >= 0) & (x < _SKIP))
                if len(write):
                    to = x[write].astype(np.int64)
                    cand = best[write] + cost.T[to]
                    prev = cand.argmin(1)
                    total = cand[np.arange(len(write)), prev] + price[write, k]
                    better = total < new[write, to]
                    new[write[better], to[better]] = total[better]
                    from_[write[better], to[better]] = prev[better]
            best = new - new.min(1, keepdims=True)  # long spans must not run out of digits
            if came is not None:
                came[t - lo] = from_
        return best

    best = np.full((n, 27), np.inf, np.float32)
    best[:, _EDGE] = 0
    window = max(1, min(length, BLOCK // max(n, 1)))
    starts, entering = list(range(0, length, window)), []
    for lo in starts:
        entering.append(best)
        best = steps(best, lo, min(lo + window, length)) if len(starts) > 1 else best
    chars = np.full((n, length), 32, np.uint8)
    put = np.zeros((n, length), bool)
    at = None
    for lo, first in zip(reversed(starts), reversed(entering)):
        hi = min(lo + window, length)
        came = np.zeros((hi - lo, n, 27), np.int8)
        last = steps(first, lo, hi, came)
        at = (last + cost[:, _EDGE]).argmin(1) if at is None else at
        for t in range(hi - 1, lo - 1, -1):
            before = came[t - lo, rows, at]
            wrote = before != _SKIP
            put[:, t] = wrote
            chars[:, t] = np.where(at < _EDGE, at + 97, 32)
            at = np.where(wrote, before, at)
    return [chars[i][put[i]].tobytes().decode() for i in range(n)]


class WordModel:
    """Costs (-log p) of the most frequent words, to cut letters without boundaries."""

    MOST, LONGEST, UNKNOWN = 20_000, 24, 14.0

    def __init__(self, words: Mapping[str, int], total: int = 0):
        """``total``: of all words, where ``words`` holds the most frequent ones only."""
        total = total or sum(words.values()) or 1
        most = sorted(words.items(), key=lambda x: (-x[1], x[0]))[: self.MOST]
        self.cost = {w: -math.log(n / total) for w, n in most if len(w) <= self.LONGEST}

    def cut(self, letters: str) -> list[str]:
        """The words of the cheapest cut; a letter of no word costs ``UNKNOWN``."""
        cost, best, back = self.cost, [0.0], [0]
        for end in range(1, len(letters) + 1):
            top, start = best[end - 1] + self.UNKNOWN, end - 1
            for k in range(max(0, end - self.LONGEST), end):
                c = cost.get(letters[k:end])
                if c is not None and best[k] + c < top:
                    top, start = best[k] + c, k
            best.append(top)
            back.append(start)
        out, end = [], len(letters)
        while end:
            out.append(letters[back[end] : end])
            end = back[end]
        return out[::-1]


def words_of(text: str) -> list[str]:
    """The matches of ``_WORD``; most texts are Latin-1, where a table of bytes finds them."""
    try:
        return text.encode("latin-1").translate(_LETTERS).decode("latin-1").split()
    except UnicodeEncodeError:
        return _WORD.findall(text)


def _with_letters_before(pattern: re.Pattern, text: str) -> Iterator[str]:
    for m in pattern.finditer(text):
        start, end = m.span()
        while start and "a" <= text[start - 1] <= "z":
            start -= 1
        yield text[start:end]


def suspicious(text: str) -> list[str]:
    """The spans of lower-cased ``text`` that have alternatives."""
    found = []
    for whole in _with_letters_before(_LEETED, text):
        s = whole.rstrip("@$!|+(")
        if not s.islower():  # no letters
            continue
        if not s.isalpha():
            found.append(s)
        if 0 < len(whole) - len(s) <= 2:  # letters, or the marks of a sentence
            found.append(whole)
    found += _with_letters_before(_RUN_WORD, text)
    within = _SPACED_WITHIN.search(text)
    if within:  # a span starts two characters before it, or later
        found += [m.group() for m in _SPACED.finditer(text, max(0, within.start() - 2))]
    return found


DENSE = 250


@lru_cache(1 << 16)  # the memo of a worker stays bounded
def _stems(word: str) -> list[str]:
    return [f"^{word[:k]}" for k in (4, 5, 6, 7) if len(word) > k]


class _Hits(dict):
    """Of words met: the word, its weight and its weighted stems; None where there are none."""

    MOST = 500_000  # the memo of a worker stays bounded

    def __init__(self, weights: Mapping[str, float]):
        self.weights, self.heads = weights, {s[1:5] for s in weights if s[0] == "^"}

    def __missing__(self, word: str) -> tuple[str, float, list[str]] | None:
        if len(self) >= self.MOST:
            self.clear()
        stems = [s for s in _stems(word) if s in self.weights] if word[:4] in self.heads else []
        hit = self[word] = (word, self.weights.get(word, 0.0), stems) if stems or word in self.weights else None
        return hit


LEAST_DOCS, MOST_FEATURES, LEAST_CHI2, PENALTY = 4, 500, 30.0, 2e-4


def chi_square(a, b, n: np.ndarray) -> np.ndarray:
    """Of the presence of features in the two labels, negative where it speaks for label 0:
    ``a`` and ``b`` are their documents of label 0 and 1, ``n`` all documents of the labels."""
    a, b, n = np.asarray(a, float), np.asarray(b, float), np.asarray(n, float)
    gap = b * (n[0] - a) - a * (n[1] - b)
    return n.sum() * gap * abs(gap) / (n[0] * n[1] * (a + b) * (n.sum() - a - b + 0.5))


def loss_sums(x: np.ndarray, docs: np.ndarray, n: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Loss, gradient and second derivatives, one after the other, of the logistic model ``w``
    (bias first) over rows ``x`` (1 first) that stand for ``docs`` documents of label 0 and 1;
    both labels weigh the same.  The sums of all rows are the sum over their parts."""
    z, each = x @ w, docs * (0.5 / n)
    total = each.sum(1)
    p = np.exp(-np.logaddexp(0, -z))
    loss = total @ np.logaddexp(0, z) - each[:, 1] @ z
    second = x.T @ ((total * p * (1 - p))[:, None] * x)
    return np.concatenate([[loss], x.T @ (total * p - each[:, 1]), second.ravel()])


def least_loss(sums: Callable[[np.ndarray], np.ndarray], size: int, penalty: float, rounds: int = 100) -> np.ndarray:
    """The weights of least penalised loss, by Newton steps that are halved until the loss
    falls.  A slight penalty on the bias bounds it where there is one label only."""
    ridge = np.array([1e-6] + [penalty] * (size - 1))

    def at(w):
        s = sums(w)
        return s[0] + ridge @ (w * w) / 2, s[1 : size + 1] + ridge * w, s[size + 1 :].reshape(size, size) + np.diag(ridge)

    w = np.zeros(size)
    loss, gradient, second = at(w)
    for _ in range(rounds):
        step = np.linalg.solve(second, gradient)
        while abs(step).max() > 1e-6:
            ahead = at(w - step)
            if ahead[0] <= loss - 1e-4 * (gradient @ step) + 1e-13:
                break
            step = step / 2
        else:
            w = w - step
            break
        w, (loss, gradient, second) = w - step, ahead
    return np.round(w, 6)  # what the order of the sums may change is less


class Toxicity:
    def __init__(self):
        self.cost, self.weights, self.bias = None, {}, 0.0
        self.words = WordModel(Counter())
        self._known = _Hits(self.weights)

    def restored(self, texts: list[str]) -> list[Counter]:
        """Per text how often the words stand in it, with those that decoding restores."""
        spans = [suspicious(t) for t in texts]
        distinct = sorted({s for found in spans for s in found})
        spelt = dict(zip(distinct, (x.split() for x in viterbi(distinct, self.cost))))
        for s in distinct:
            if _SPACED.fullmatch(s):  # what was spelled out may be several words
                spelt[s] = spelt[s] + [w for x in spelt[s] if len(x) > 3 and len(cut := self.words.cut(x)) > 1 for w in cut if len(w) > 1]
        out = []
        for text, found in zip(texts, spans):
            words = Counter(words_of(text))
            for s in found:
                words.update(spelt[s])
            out.append(words)
        return out

    @staticmethod
    def features(words: Counter) -> set[str]:
        """Words that occur, and dense beginnings of words (marked by ^): stems with many
        endings that make up at least one word in ``DENSE``."""
        total = sum(words.values())
        if total <= DENSE:
            return words.keys() | set(chain.from_iterable(map(_stems, words)))
        long = [w for w in words.elements() if len(w) > 4]
        heads = Counter([w[:4] for w in long])  # longer stems are no denser than their heads
        dense = {s for s, n in heads.items() if n * DENSE >= total}
        stems = Counter(chain.from_iterable(map(_stems, [w for w in long if w[:4] in dense])))
        return words.keys() | {s for s, n in stems.items() if n * DENSE >= total}

    def fit(self, texts: list[str], labels: list[int], least_docs: int = LEAST_DOCS, most: int = MOST_FEATURES, least_chi2: float = LEAST_CHI2, penalty: float = PENALTY) -> Toxicity:
        texts = [t.lower() for t in texts]
        counted = Counter(w for t in texts for w in words_of(t))
        self.cost, self.words = CharModel(counted).cost, WordModel(counted)
        if not texts:
            return self
        docs, y = [self.features(d) for d in self.restored(texts)], np.array(labels, int)
        n = np.clip([(y == k).sum() for k in (0, 1)], 1, None)
        seen = [Counter(w for d, k in zip(docs, labels) if k == j for w in d) for j in (0, 1)]
        # words are ranked by the chi-square of their presence in the two labels
        often = [w for w in seen[0] | seen[1] if seen[0][w] + seen[1][w] >= least_docs]
        sign = dict(zip(often, abs(chi_square([seen[0][w] for w in often], [seen[1][w] for w in often], n))))
        kept = [w for w in sorted(sign, key=lambda w: (-sign[w], w))[:most] if sign[w] >= least_chi2]
        at = {w: j for j, w in enumerate(kept, 1)}
        x = np.zeros((len(docs), len(kept) + 1))
        x[:, 0] = 1
        for i, d in enumerate(docs):
            for w in at.keys() & d:
                x[i, at[w]] = 1
        return self.weighted(kept, least_loss(lambda w: loss_sums(x, np.eye(2)[y], n, w), len(kept) + 1, penalty))

    def weighted(self, kept: list[str], w: np.ndarray) -> Toxicity:
        self.weights, self.bias = dict(zip(kept, w[1:].tolist())), float(w[0])
        self._known = _Hits(self.weights)
        return self

    def scores(self, texts: list[str]) -> np.ndarray:
        z, known, weights = [], self._known, self.weights
        for words in self.restored([t.lower() for t in texts]):
            total, stems = self.bias, Counter()
            for w, weight, found in filter(None, map(known.__getitem__, words)):
                total += weight
                for s in found:
                    stems[s] += words[w]
            if stems:
                least = sum(words.values()) / DENSE
                total += sum(weights[s] for s in sorted(stems) if stems[s] >= least)
            z.append(total)
        return 1 / (1 + np.exp(-np.clip(np.array(z, float), -30, 30)))


def in_slices(texts: list[str | None], slice_chars: int = 2_000_000) -> Iterator[list[str]]:
    """Texts (null: empty) that are decoded together: about ``slice_chars``, one text at least."""
    at = 0
    while at < len(texts):
        end, size = at, 0
        while end < len(texts) and (end == at or size + len(texts[end] or "") <= slice_chars):
            size += len(texts[end] or "")
            end += 1
        yield [t or "" for t in texts[at:end]]
        at = end


def score(df: DataFrame, model: Toxicity, text_col: str = "text", output: str = "score", slice_chars: int = 2_000_000) -> DataFrame:
    """``df`` with the probability ``output`` that its label is 1 (in place of an input
    column of that name)."""
    df = without(df, output, keep=(text_col,))

    def run(batches):
        for batch in in_parts(batches):
            out = [np.empty(0), *map(model.scores, in_slices(batch.column(text_col).to_pylist(), slice_chars))]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.concatenate(out), pa.float64())], [*batch.schema.names, output])

    return df.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField(output, T.DoubleType())]))
