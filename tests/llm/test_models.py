"""The learned operators' scores against the same formulas in plain Python, one text at a time."""

import math
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyframe.llm import language, language_model, quality, toxicity
from tallyframe.llm.text import BYTE_CODE, LOWER, run_hashes

from . import brute

TEXTS = "doc_id long, text string"
ODD = [(1, None), (2, ""), (3, "Ab"), (4, "One two. Three!\nfour"), (5, "ça va? " * 150), (6, "x" * 700), (6, "1 2 3.")]


def sigmoid(x):
    return 1 / (1 + math.exp(-x))


def quality_of(text, net):
    """Chunk by chunk and place by place."""
    raw = brute.raw(text)
    starts = range(0, max(len(raw) - quality.CHUNK, 0) + quality.STRIDE, quality.STRIDE)
    starts = [s for s in starts if s == 0 or s - quality.STRIDE + quality.CHUNK < len(raw)]
    total = 0.0
    for s in starts:
        chunk = raw[s : s + quality.CHUNK].ljust(quality.CHUNK, bytes([quality.PAD]))
        for f in range(quality.FILTERS):
            best = max(
                sum(float(net.filters[k][chunk[at + k]][f]) for k in range(quality.WIDTH))
                for at in range(quality.CHUNK - quality.WIDTH + 1)
            )
            total += math.tanh(best + float(net.offset[f])) * float(net.out[f])
    return sigmoid(total / len(starts) + net.bias)


def test_quality_equals_plain_python(spark, rows):
    rng = np.random.default_rng(2)
    net = quality.Convolution(
        rng.normal(0, 0.3, (quality.WIDTH, 256, quality.FILTERS)).astype(np.float32),
        rng.normal(0, 0.3, quality.FILTERS).astype(np.float32),
        rng.normal(0, 0.5, quality.FILTERS).astype(np.float32),
        0.2,
    )
    found = quality.score_documents(rows(TEXTS, *ODD), net).collect()
    want = sorted((i, quality_of(t, net)) for i, t in ODD)
    got = sorted((r.doc_id, r.score) for r in found)
    assert [i for i, _ in got] == [i for i, _ in want]
    assert [s for _, s in got] == pytest.approx([s for _, s in want], abs=1e-5)


def toxicity_of(text, model):
    """A text is toxic unless each of its sentences is clean."""

    def weight(word, mark=0):
        data = np.frombuffer(word, np.uint8)
        code = run_hashes(BYTE_CODE[LOWER[data]], np.array([0]), np.array([len(word)]))[0] ^ np.uint64(mark)
        return model.weights[int(code >> np.uint64(64 - toxicity.FEATURE_BITS))]

    clean = 1.0
    for sentence in re.split(rb"[.!?\n]", brute.raw(text)):
        words = re.findall(rb"[A-Za-z\x80-\xff]+", sentence)
        if words:
            z = model.start + sum(weight(w) for w in words)
            z += sum(weight(w[:n], n) for w in words for n in toxicity.PREFIXES if len(w) >= n)
            clean *= 1 - sigmoid(z)
    return 1 - clean


def test_toxicity_equals_plain_python(spark, rows):
    rng = np.random.default_rng(4)
    model = toxicity.NoisyOr(rng.normal(0, 0.6, 1 << toxicity.FEATURE_BITS), -3.0)
    got = sorted((r.doc_id, r.score) for r in toxicity.score_documents(rows(TEXTS, *ODD), model).collect())
    want = sorted((i, toxicity_of(t, model)) for i, t in ODD)
    assert [i for i, _ in got] == [i for i, _ in want]
    assert [s for _, s in got] == pytest.approx([s for _, s in want], abs=1e-9)
    assert dict(got)[1] == dict(got)[2] == 0


def states(raw, table, state):
    """The gated recurrent unit, one byte and one hidden unit after another."""
    h = language.HIDDEN
    now, out = [0.0] * h, []
    for b in raw:
        a = [sum(now[i] * state[i][j] for i in range(h)) for j in range(3 * h)]
        r = [sigmoid(table[b][j] + a[j]) for j in range(h)]
        z = [sigmoid(table[b][h + j] + a[h + j]) for j in range(h)]
        n = [math.tanh(table[b][2 * h + j] + r[j] * a[2 * h + j]) for j in range(h)]
        now = [n[j] + z[j] * (now[j] - n[j]) for j in range(h)]
        out.append(now)
    return out


def test_language_equals_plain_python(spark, rows):
    net = language._new(["de", "en", "fr"], np.random.default_rng(6))
    tables, grids = [t.tolist() for t in net.inputs], [s.tolist() for s in net.states]
    given = [(1, "ab, c"), (2, "Zu"), (3, "q" * (language.SEGMENT + 3))]
    found = {r.doc_id: r for r in language.predict(rows(TEXTS, *given), net).collect()}
    for i, text in given:
        raw, pooled, letters = text.encode(), [0.0] * 3, 0
        for s in range(0, len(raw), language.SEGMENT):
            own = raw[s : s + language.SEGMENT]
            padded = own.ljust(language.SEGMENT, bytes([language.BLANK]))
            ahead = states(padded, tables[0], grids[0])
            back = states(padded[::-1], tables[1], grids[1])[::-1]
            for at, b in enumerate(own):
                if chr(b).isalpha():
                    both = ahead[at] + back[at]
                    z = [sum(x * float(net.out[j][k]) for j, x in enumerate(both)) + float(net.bias[k]) for k in range(3)]
                    e = [math.exp(x) for x in z]
                    pooled = [p + x / sum(e) for p, x in zip(pooled, e, strict=True)]
                    letters += 1
        assert found[i].lang_pred == net.labels[int(np.argmax(pooled))]
        assert found[i].score == pytest.approx(max(pooled) / letters, abs=1e-4)


class Interpolated:
    """Deleted interpolation over dictionaries."""

    def __init__(self, texts, weighed):
        words, pairs = self.count([*texts, *weighed])
        own_words, own_pairs = self.count(weighed)
        self.words, self.pairs = words, pairs
        self.n, self.v = sum(words.values()), len(words)
        left = self.n - sum(own_words.values())
        seen = defaultdict(Counter)
        for text in weighed:
            for before, word in self.steps(text):
                context = words[before] - own_words[before]
                pair = pairs[before, word] - own_pairs[before, word]
                p = ((words[word] - own_words[word]) / left, pair / context if context else 0)
                seen[self.bucket(context)][tuple(map(self.rounded, p))] += 1
        start = lambda k: [0.2, 0.8, 0.0] if k == 0 else [0.1, 0.45, 0.45]
        self.weights = {}
        for k in range(language_model.BUCKETS):
            w = start(k)
            for _ in range(language_model.EM_ROUNDS if seen[k] else 0):
                total = [0.0, 0.0, 0.0]
                for (p1, p2), c in seen[k].items():
                    share = [w[0] / (self.v + 1), w[1] * p1, w[2] * p2]
                    total = [t + c * s / sum(share) for t, s in zip(total, share, strict=True)]
                w = [t / sum(total) for t in total]
            w[0] = max(w[0], 1e-6)
            self.weights[k] = [x / sum(w) for x in w]

    @staticmethod
    def steps(text):
        # The end of a text stands before its first word, so it is a context as often as it occurs.
        words = [*brute.raw(text).translate(brute.LOWER).split(), None]
        return list(zip([None, *words[:-1]], words, strict=True))

    def count(self, texts):
        every = [step for text in texts for step in self.steps(text)]
        return Counter(word for _, word in every), Counter(every)

    @staticmethod
    def bucket(context):
        return min(math.ceil(math.log2(context + 1)), language_model.BUCKETS - 1)

    @staticmethod
    def rounded(p):
        """A probability in steps of half a bit, as the held-out counts keep it."""
        steps = language_model.STEPS
        return 2.0 ** (-min(max(round(-steps * math.log2(p)), 0), language_model.LARGEST - 1) / steps) if p else 0.0

    def probability(self, before, word):
        context = self.words[before]
        w = self.weights[self.bucket(context)]
        pair = self.pairs[before, word] / context if context else 0
        return w[0] / (self.v + 1) + w[1] * self.words[word] / self.n + w[2] * pair

    def score(self, text):
        return sum(math.log10(self.probability(*step)) for step in self.steps(text))


def test_language_model_equals_plain_python(spark, rows):
    rng = np.random.default_rng(8)
    word = lambda: "abcdefghij"[min(int(rng.exponential(2)), 9)]
    counted = [" ".join(word() for _ in range(rng.integers(0, 40))) for _ in range(60)]
    weighed = [" ".join(word() for _ in range(rng.integers(0, 40))) for _ in range(12)]
    scored = ["A b\tc", "unseen a unseen", "", None, "a " * 300]
    model = Interpolated(counted, weighed)
    given = [(t, p) for p, own in enumerate((counted, weighed, scored)) for t in own]
    df = rows(TEXTS + ", part int", *[(i, t, p) for i, (t, p) in enumerate(given)])
    want = pytest.approx({i: model.score(t) for i, (t, _) in enumerate(given)}, rel=1e-9)
    assert sum(len(model.steps(t)) for t, _ in given) > 1 << 2 * language_model.FAN_BITS
    # One block of each use; then a block for nearly each text, in a tree of two levels, and in one of three, for ranges of one token.
    for sizes in ({}, {"block_bytes": 1}, {"block_bytes": 1, "partition_tokens": 1}):
        found = {r.doc_id: r.score for r in language_model.interpolated_scores(df, F.col("part"), **sizes).collect()}
        assert found == want
    # After each context that was counted, the known words and the unknown one have all of the probability.
    for before in model.words:
        own = [model.probability(before, w) for w in model.words]
        assert sum(own) + model.probability(before, "never seen") == pytest.approx(1)
