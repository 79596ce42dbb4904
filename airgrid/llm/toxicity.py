"""Toxicity: a bidirectional gated recurrent network with attention pooling over windows of words, trained in numpy.

Each word enters as characters (mean embedding and log-odds of its character 4-grams, the first one marked) and as a word
(hashed embedding and log-odds).  A window starts at every word that has enough words after it (a shorter text is one window); a
text scores as its worst window.  Labels are for texts, so training is multiple-instance: each round picks the worst of the
windows that overlap by half and fits them.
"""

from __future__ import annotations


from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textbytes as tb

U = np.uint64
#: Log-odds of fewer standard errors than this count as 0; bytes of the longer beginning of a word.  Chosen by four folds of the
#: labelled rows that aren't held out.
LEAST_Z, BEGIN = 1.0, 6


@dataclass(frozen=True)
class Settings:
    """``max_toxic``, ``max_clean`` and ``max_chars`` bound the labelled sample that the driver trains on; longer texts are left
    out of training only."""

    max_toxic: int = 800
    max_clean: int = 1600
    max_chars: int = 6000
    window: int = 16
    hidden: int = 8
    buckets: int = 4096
    rounds: int = 10
    seed: int = 11


def _mark(h: np.ndarray) -> np.ndarray:
    return tb.mix(h ^ U(0xA5A5A5A5))


@dataclass
class Features:
    """Log-odds of words and of character 4-grams (sorted hashes and values)."""

    words: np.ndarray
    word_odds: np.ndarray
    grams: np.ndarray
    gram_odds: np.ndarray

    @staticmethod
    def look(keys: np.ndarray, values: np.ndarray, h: np.ndarray) -> np.ndarray:
        if not len(keys):
            return np.zeros(len(h))
        at = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
        return np.where(keys[at] == h, values[at], 0.0)


def _odds(doc: np.ndarray, h: np.ndarray, toxic: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Shrunk log-odds of presence in toxic texts, for hashes that at least three texts hold and whose odds stand out."""
    keys = np.unique(h)
    pairs = np.searchsorted(keys, h) * len(toxic) + doc
    pairs.sort()
    pairs = pairs[np.r_[True, pairs[1:] != pairs[:-1]]]
    count = np.bincount(pairs // len(toxic), minlength=len(keys))
    bad = np.bincount(pairs // len(toxic), toxic[pairs % len(toxic)], len(keys))
    n_bad, n_good = max(1.0, toxic.sum()), max(1.0, (1 - toxic).sum())
    share = n_bad / (n_bad + n_good)
    value = np.log((bad + 8 * share) / n_bad) - np.log((count - bad + 8 * (1 - share)) / n_good)
    spread = np.sqrt(1 / (bad + 8 * share) + 1 / (count - bad + 8 * (1 - share)))
    keep = np.flatnonzero((count >= 3) & (np.abs(value) >= LEAST_Z * spread))
    return keys[keep], value[keep]


def _word_grams(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(word, hash) of each 4-byte gram of each word; words of less are one gram; the first is marked as such.  Behind it, words of
    more have their first ``BEGIN`` bytes, marked again."""
    more = end - start > 4
    n = np.maximum(1, end - start - 3) + more
    word = np.repeat(np.arange(len(start)), n)
    place = np.arange(n.sum()) - np.repeat((np.cumsum(n) - n), n)
    begin = (place == 1) & more[word]
    offset = np.where(begin, 0, place - ((place > 1) & more[word]))
    lo = start[word] + offset
    h = tb.hashes(data, lo, np.minimum(lo + np.where(begin, BEGIN, 4), end[word]), seed=3)
    return word, np.where(begin, _mark(_mark(h)), np.where(place == 0, _mark(h), h))


@dataclass
class Text:
    """Words of a run of texts: for each its distinct word, and the distinct words' hashes and grams."""

    word: np.ndarray
    first: np.ndarray
    hashes: np.ndarray
    gram_word: np.ndarray
    grams: np.ndarray


def read(data: np.ndarray, offsets: np.ndarray) -> Text:
    data = tb.LOWER[data]
    w = tb.words(data, offsets, tb.ALNUM)
    distinct, place, word = np.unique(tb.hashes(data, w.start, w.end, seed=2), return_index=True, return_inverse=True)
    gram_word, grams = _word_grams(data, w.start[place], w.end[place])
    return Text(word, w.first, distinct, gram_word, grams)


def joined(parts: list[Text]) -> Text:
    """Runs of texts as one; equal to reading them at once, without arrays of the size of all their bytes."""
    hashes, at = np.unique(np.concatenate([p.hashes for p in parts]), return_index=True)
    word = np.concatenate([np.searchsorted(hashes, p.hashes)[p.word] for p in parts])
    before = np.r_[0, np.cumsum([len(p.word) for p in parts])]
    first = np.concatenate([[0], *(p.first[1:] + b for p, b in zip(parts, before))])
    grams = np.concatenate([p.grams for p in parts])
    n = np.concatenate([np.bincount(p.gram_word, minlength=len(p.hashes)) for p in parts])
    start, n = (np.cumsum(n) - n)[at], n[at]
    pick = np.repeat(start - (np.cumsum(n) - n), n) + np.arange(n.sum())
    return Text(word, first, hashes, np.repeat(np.arange(len(hashes)), n), grams[pick])


def windows(first: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, first word, end) of windows that overlap by half and reach the end of each text."""
    n = np.diff(first)
    half = size // 2
    count = np.where(n > 0, np.maximum(1, -(-(n - half) // half)), 0)
    text = np.repeat(np.arange(len(n)), count)
    k = np.arange(count.sum()) - np.repeat((np.cumsum(count) - count), count)
    lo = first[text] + k * half
    return text, lo, np.minimum(lo + size, first[text + 1])


CHAR, WORD = 6, 4
INPUTS = CHAR + WORD + 4


@dataclass
class Net:
    settings: Settings
    features: Features
    p: dict[str, np.ndarray] = field(default_factory=dict)
    scale: tuple[float, float] = (1.0, 0.0)

    def __post_init__(self):
        if not self.p:
            rng, h = np.random.default_rng(self.settings.seed), self.settings.hidden
            self.p = {"char": rng.normal(0, 0.1, (self.settings.buckets, CHAR)), "word": rng.normal(0, 0.1, (self.settings.buckets, WORD))}
            for d in "fb":
                self.p |= {f"x{d}": rng.normal(0, 0.3, (INPUTS, 3 * h)), f"u{d}": rng.normal(0, 0.3, (h, 3 * h)), f"c{d}": np.zeros(3 * h)}
            self.p |= {"v": rng.normal(0, 0.3, 2 * h), "w": rng.normal(0, 0.3, 2 * h), "o": np.zeros(1)}

    def inputs(self, t: Text) -> np.ndarray:
        """Input vectors of the distinct words."""
        n = len(t.hashes)
        bucket = (t.grams % U(self.settings.buckets)).astype(np.int64)
        count = np.maximum(1, np.bincount(t.gram_word, minlength=n))[:, None]
        chars = np.stack([np.bincount(t.gram_word, self.p["char"][bucket, j], n) for j in range(CHAR)], 1) / count
        odds = self.features.look(self.features.grams, self.features.gram_odds, t.grams)
        best = np.zeros(n)
        np.maximum.at(best, t.gram_word, odds)
        start = odds[np.searchsorted(t.gram_word, np.arange(n))] if n else best
        own = self.features.look(self.features.words, self.features.word_odds, t.hashes)
        words = self.p["word"][(t.hashes % U(self.settings.buckets)).astype(np.int64)]
        mean = np.bincount(t.gram_word, odds, n) / count[:, 0]
        return np.concatenate([chars, words, own[:, None], best[:, None], start[:, None], mean[:, None]], 1)

    def run(self, x: dict[str, np.ndarray], lo: np.ndarray, end: np.ndarray, word: np.ndarray, keep: bool = False):
        """Logits of windows; ``x`` holds the distinct words' gate inputs for both directions."""
        size, h, n = self.settings.window, self.settings.hidden, len(lo)
        at = lo[:, None] + np.arange(size)
        valid = at < end[:, None]
        ids = word[np.minimum(at, len(word) - 1)]
        kind = x["f"].dtype
        out = np.zeros((size, n, 2 * h), kind)
        steps = []
        for d, order in (("f", range(size)), ("b", range(size - 1, -1, -1))):
            state, u = np.zeros((n, h), kind), self.p[f"u{d}"].astype(kind)
            for t in order:
                g, s = x[d][ids[:, t]], state @ u
                zr = 0.5 * np.tanh(0.5 * (g[:, : 2 * h] + s[:, : 2 * h])) + 0.5
                z, r = zr[:, :h], zr[:, h:]
                c = np.tanh(g[:, 2 * h :] + r * s[:, 2 * h :])
                new = np.where(valid[:, t, None], c + z * (state - c), state)
                if keep:
                    steps.append((d, t, state, z, r, c, s[:, 2 * h :]))
                state = new
                out[t, :, (0 if d == "f" else h) : (h if d == "f" else 2 * h)] = state
        e = np.where(valid.T, out @ self.p["v"].astype(kind), -1e9)
        a = np.exp(e - e.max(0))
        a /= a.sum(0)
        pooled = (a[:, :, None] * out).sum(0)
        logit = pooled @ self.p["w"].astype(kind) + kind.type(self.p["o"][0])
        return (logit, (ids, valid, out, a, pooled, steps)) if keep else logit

    def gates(self, vectors: np.ndarray, kind=np.float32) -> dict[str, np.ndarray]:
        return {d: (vectors @ self.p[f"x{d}"] + self.p[f"c{d}"]).astype(kind) for d in "fb"}

    def window_logits(self, t: Text, block: int = 4096) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        text, lo, end = windows(t.first, self.settings.window)
        if not len(lo):
            return text, lo, end, np.zeros(0, np.float32)
        x = self.gates(self.inputs(t))
        parts = [self.run(x, lo[a : a + block], end[a : a + block], t.word) for a in range(0, len(lo), block)]
        return text, lo, end, np.concatenate(parts) if parts else np.zeros(0, np.float32)

    def gradients(self, t: Text, lo: np.ndarray, end: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        """Of the mean logistic loss over windows with labels ``y``."""
        h, n = self.settings.hidden, len(lo)
        vectors = self.inputs(t)
        logit, (ids, valid, out, a, pooled, steps) = self.run(self.gates(vectors, np.float64), lo, end, t.word, True)
        d = (1 / (1 + np.exp(-logit)) - y) / n
        g = {k: np.zeros_like(v) for k, v in self.p.items()}
        g["w"], g["o"] = d @ pooled, np.array([d.sum()])
        dp = d[:, None] * self.p["w"]
        da = (out * dp).sum(2)
        de = a * (da - (a * da).sum(0))
        g["v"] = np.einsum("tn,tnh->h", de, out)
        dout = a[:, :, None] * dp + de[:, :, None] * self.p["v"]
        dvec = np.zeros_like(vectors)
        for way in "fb":
            part = slice(0, h) if way == "f" else slice(h, 2 * h)
            u, x = self.p[f"u{way}"], self.p[f"x{way}"]
            carry = np.zeros((n, h))
            for _, t_, state, z, r, c, s in reversed([q for q in steps if q[0] == way]):
                ds = carry + dout[t_, :, part]
                live = np.where(valid[:, t_, None], ds, 0)
                dz, dc, back = live * (state - c) * z * (1 - z), live * (1 - z) * (1 - c * c), live * z
                dr = dc * s * r * (1 - r)
                dg = np.concatenate([dz, dr, dc], 1)
                dh = np.concatenate([dz, dr, dc * r], 1)
                g[f"u{way}"] += state.T @ dh
                g[f"c{way}"] += dg.sum(0)
                g[f"x{way}"] += vectors[ids[:, t_]].T @ dg
                np.add.at(dvec, ids[:, t_], dg @ x.T)
                carry = np.where(valid[:, t_, None], back + dh @ u.T, ds)
        count = np.maximum(1, np.bincount(t.gram_word, minlength=len(t.hashes)))
        np.add.at(g["char"], (t.grams % U(self.settings.buckets)).astype(np.int64), (dvec[:, :CHAR] / count[:, None])[t.gram_word])
        np.add.at(g["word"], (t.hashes % U(self.settings.buckets)).astype(np.int64), dvec[:, CHAR : CHAR + WORD])
        return g

    def first_states(self, x: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
        """States of the distinct words as the first of a window, in both directions."""
        h = self.settings.hidden
        return {f"first {d}": (0.5 - 0.5 * np.tanh(0.5 * x[d][:, :h])) * np.tanh(x[d][:, 2 * h :]) for d in "fb"}

    def every_start(self, x: dict[str, np.ndarray], word: np.ndarray) -> np.ndarray:
        """Logits of the full windows at each start in one run of words.

        Windows that start next to each other read the same words one step apart, so a step's gate inputs are a slice; of
        each state only its attention score and its share of the logit are kept.  A window's first state is that of its first
        word, found once for each distinct word.  Gates are found by exp, which takes half the time of tanh."""
        size, h = self.settings.window, self.settings.hidden
        n = len(word) - size + 1
        scores, shares = np.zeros((size, n), np.float32), np.zeros((size, n), np.float32)
        sign = np.r_[np.full(2 * h, -1), np.full(h, -2)].astype(np.float32)[:, None]  # 1 / (1 + exp(-a)), 2 / (1 + exp(-2 a)) - 1
        for way, order, part in (("f", range(size), slice(0, h)), ("b", range(size - 1, -1, -1), slice(h, 2 * h))):
            gates = np.ascontiguousarray(x[way][word].T) * sign
            u = np.concatenate([self.p[f"u{way}"].T * sign, self.p["v"][None, part], self.p["w"][None, part]]).astype(np.float32)
            before = order[0]
            state = np.ascontiguousarray(x[f"first {way}"][word[before : before + n]].T)
            with np.errstate(over="ignore"):
                for t in order[1:]:
                    s = u @ state
                    scores[before] += s[3 * h]
                    shares[before] += s[3 * h + 1]
                    g = gates[:, t : t + n]
                    zr = s[: 2 * h]
                    zr += g[: 2 * h]
                    np.exp(zr, out=zr)
                    zr += 1
                    np.reciprocal(zr, out=zr)
                    c = s[2 * h : 3 * h]
                    c *= zr[h:]
                    c += g[2 * h :]
                    np.exp(c, out=c)
                    c += 1
                    np.divide(2, c, out=c)
                    c -= 1
                    state -= c
                    state *= zr[:h]
                    state += c
                    before = t
            s = u[3 * h :] @ state
            scores[before] += s[0]
            shares[before] += s[1]
        scores -= scores.max(0)
        np.exp(scores, out=scores)
        return (scores * shares).sum(0) / scores.sum(0) + np.float32(self.p["o"][0])

    def worst(self, t: Text, block: int = 4096) -> np.ndarray:
        """Of each text, the highest logit of its windows at all starts, -12 at least."""
        size, n = self.settings.window, np.diff(t.first)
        worst = np.full(len(n), -12.0)
        if not len(t.word):
            return worst
        x = self.gates(self.inputs(t))
        short = np.flatnonzero((n > 0) & (n < size))
        if len(short):
            worst[short] = np.maximum(-12.0, self.run(x, t.first[short], t.first[short + 1], t.word))
        if len(t.word) < size:
            return worst
        x |= self.first_states(x)
        starts = len(t.word) - size + 1
        logit = np.concatenate([self.every_start(x, t.word[a : min(a + block, starts) + size - 1]) for a in range(0, starts, block)])
        text = np.repeat(np.arange(len(n)), n)
        inside = np.flatnonzero(text[:starts] == text[size - 1 :])  # windows that end in the text they start in
        if len(inside):
            run = np.flatnonzero(np.r_[True, np.diff(text[inside]) > 0])
            worst[text[inside][run]] = np.maximum(-12.0, np.maximum.reduceat(logit[inside], run))
        return worst

    def score(self, t: Text) -> np.ndarray:
        """Of each text, the calibrated probability of its worst window; texts without words get that of a very clean one."""
        worst = self.worst(t)
        a, b = self.scale
        return 1 / (1 + np.exp(-(a * worst + b)))


def train(texts: list[str], toxic: list[int], natural: float, settings: Settings = Settings()) -> Net:
    """Fit the network to labelled texts.  ``natural`` is the share of toxic texts to calibrate for."""
    arr = pa.array(texts or [""], pa.large_string())
    y = np.array(toxic or [0], float)
    t = joined([read(data, offsets) for _, _, data, offsets in tb.chunks(arr)])
    if not len(t.word):
        none = np.zeros(0, U), np.zeros(0)
        return Net(settings, Features(*none, *none))
    doc = np.repeat(np.arange(len(y)), np.diff(t.first))
    by_word = np.argsort(t.gram_word, kind="stable")
    cut = np.searchsorted(t.gram_word[by_word], np.arange(len(t.hashes) + 1))
    held = np.unique(doc * max(1, len(t.hashes)) + t.word)  # each distinct word of each text once
    doc, word = held // max(1, len(t.hashes)), held % max(1, len(t.hashes))
    n = np.diff(cut)[word]
    pick = np.repeat(cut[word] - (np.cumsum(n) - n), n) + np.arange(n.sum())
    words = _odds(doc, t.hashes[word], y)
    grams = _odds(np.repeat(doc, n), t.grams[by_word][pick], y)
    net = Net(settings, Features(*words, *grams))
    text, lo, end = windows(t.first, settings.window)
    del held, doc, word, pick, by_word
    if not len(lo) or y.min() == y.max():
        return net
    rng = np.random.default_rng(settings.seed)
    vectors = net.inputs(t)
    per_word = vectors[t.word, CHAR + WORD] + vectors[t.word, CHAR + WORD + 1] + vectors[t.word, CHAR + WORD + 2]
    logit = np.full(len(lo), -9.0)
    for step in range(settings.window):  # the highest word of each window
        at = lo + step
        logit = np.maximum(logit, np.where(at < end, per_word[np.minimum(at, len(per_word) - 1)], -9))
    m = {k: np.zeros_like(v) for k, v in net.p.items()}
    v2 = {k: np.zeros_like(v) for k, v in net.p.items()}
    step = 0
    for turn in range(settings.rounds):
        order = np.lexsort((-logit, text))
        top = order[np.r_[True, text[order][1:] != text[order][:-1]]]
        other = rng.choice(len(lo), min(len(lo), len(top)), replace=False)
        chosen = np.unique(np.r_[top, other[y[text[other]] == 0]])
        for _ in range(2):
            mixed = rng.permutation(chosen)
            for a in range(0, len(mixed), 256):
                b = mixed[a : a + 256]
                g = net.gradients(*_part(t, lo[b], end[b], settings.window), y[text[b]])
                step += 1
                for k in net.p:
                    m[k] = 0.9 * m[k] + 0.1 * g[k]
                    v2[k] = 0.99 * v2[k] + 0.01 * g[k] ** 2
                    net.p[k] = net.p[k] - 0.02 * (m[k] / (1 - 0.9**step)) / (np.sqrt(v2[k] / (1 - 0.99**step)) + 1e-6) - (1e-4 * net.p[k] if turn else 0)
        logit = net.window_logits(t)[3]
    worst = net.worst(t)
    # calibrate on the texts, weighted to the natural share
    share = min(max(natural, 1e-3), 0.999)
    weight = np.where(y == 1, share / max(1, y.sum()), (1 - share) / max(1, (1 - y).sum()))
    a, b = 1.0, 0.0
    for _ in range(200):
        q = 1 / (1 + np.exp(-(a * worst + b)))
        r, s = weight * (q - y), weight * q * (1 - q) + 1e-9
        grad = np.array([(r * worst).sum() + 1e-3 * (a - 1), r.sum()])
        hess = np.array([[(s * worst**2).sum() + 1e-3, (s * worst).sum()], [(s * worst).sum(), s.sum() + 1e-6]])
        move = np.linalg.solve(hess, grad)
        a, b = a - np.clip(move[0], -0.5, 0.5), b - np.clip(move[1], -0.5, 0.5)
    net.scale = (max(0.05, float(a)), float(b))
    return net


def _part(t: Text, lo: np.ndarray, end: np.ndarray, size: int) -> tuple[Text, np.ndarray, np.ndarray]:
    """The words of some windows as a text of its own, with only their distinct words."""
    at = np.minimum(lo[:, None] + np.arange(size), len(t.word) - 1)
    used, word = np.unique(t.word[at], return_inverse=True)
    cut = np.searchsorted(t.gram_word, np.r_[used, len(t.hashes)])
    n = np.searchsorted(t.gram_word, used, side="right") - cut[:-1]
    pick = np.repeat(cut[:-1] - (np.cumsum(n) - n), n) + np.arange(n.sum())
    first = np.arange(len(lo)) * size
    small = Text(word.ravel(), np.r_[first, len(lo) * size], t.hashes[used], np.repeat(np.arange(len(used)), n), t.grams[pick])
    return small, first, first + (end - lo)


def held_out(doc_id):
    """Rows whose labels are never learnt: crc32 of the id as text, modulo 4, is 2."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> Net:
    """Train on a bounded sample of labelled rows that are not held out, chosen by a hash of the id.  Repeated labels of an id
    count once (toxic if any is), of several texts of an id the least is learnt; null labels are skipped.  Without labels the network stays untrained and its scores low."""
    known = labels.filter(labels.toxic.isNotNull() & labels.doc_id.isNotNull() & ~held_out(labels.doc_id)).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    rate = known.agg(F.avg("toxic")).first()[0] or 0.05
    order = F.xxhash64("doc_id")
    sample = known.filter("toxic = 1").orderBy(order).limit(settings.max_toxic).union(known.filter("toxic = 0").orderBy(order).limit(settings.max_clean))
    rows = docs.select("doc_id", "text").filter(F.length("text").between(1, settings.max_chars)).join(F.broadcast(sample), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.first("toxic").alias("toxic"))
    got = rows.orderBy(order).limit(settings.max_toxic + settings.max_clean).toPandas()
    net = train(got["text"].tolist(), got["toxic"].tolist(), rate, settings)
    if not len(got):
        net.scale = (0.05, -4.0)
    return net


def score_toxicity(docs: DataFrame, net: Net, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score, predicted for each row of ``docs``; no shuffle.

    Null and empty texts, and texts without words, get the score of a very clean window.  A null id is never held out.
    Equal texts score alike.  Only doc_id and text are read, the id not for scoring.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offsets in tb.chunks(tb.column(batch, "text")):
                score = net.score(read(data, offsets))
                cols = [batch.column("doc_id")[lo:hi], batch.column("held_out")[lo:hi], pa.array(score), pa.array((score >= threshold).astype(np.int32))]
                yield pa.RecordBatch.from_arrays(cols, ["doc_id", "held_out", "score", "predicted"])

    rows = docs.select("doc_id", held_out(docs.doc_id).alias("held_out"), "text")
    return rows.mapInArrow(tb.released(run), f"doc_id {kind}, held_out boolean, score double, predicted int")


def clean_only(docs: DataFrame, net: Net, threshold: float = 0.3) -> DataFrame:
    """Rows of ``docs`` that score under the threshold, with their columns."""
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = np.concatenate([np.zeros(0), *(net.score(read(data, offsets)) for _, _, data, offsets in tb.chunks(tb.column(batch, "text")))])
            yield batch.filter(pa.array(score < threshold))

    assert "text" in names
    return docs.mapInArrow(tb.released(run), docs.schema)
