"""Toxicity: gradient-boosted trees over dense features, with isotonic calibration (operator 7).

Contract.  ``fit(docs, labels)`` learns from at most ``bound`` labelled rows outside the held-out
fold; ``score(docs, model)`` returns ``doc_id``, ``held_out``, ``score`` (0 to 1) and ``predicted``
for every row, and ``remove_toxic`` keeps the rows that are not predicted toxic, with all columns.

Features of a whole text: densities of a fixed lexicon and of lexicons learned from the labels
(words, and word beginnings of 4 to 6 bytes, whose log odds and support are high enough), the
fixed lexicon after undoing look-alike characters, second-person words near lexicon words, capital
letters, punctuation marks and obfuscated words.  Lexicons used for training features are learned
from the other half of the rows, so the trees see them as they will be on unseen texts.  Scores are
calibrated by isotonic regression on out-of-fold predictions.

Labels, language, source and doc_id are never features.  Edge cases: null and empty texts have the
features of an empty text and are scored like any other; with no labelled rows, or one class only,
the score is the share of toxic rows (0 if none); repeated rows get equal scores; extra columns are
ignored here and kept by ``remove_toxic``; an empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import labels as lab, scratch
from .words import IS_WORD, LOWER, Words, chunks, hash_spans, runs, words

#: Most labelled rows used, folds and the held-out one.
BOUND, PARTS, HELD = 8000, 5, 0
#: Least documents and log odds of a learned lexicon entry; bytes of word beginnings.
SUPPORT, ODDS, BEGINNINGS = 3, 3.0, (4, 5, 6)

# Insulting words, second-person words, look-alike characters.
INSULTS = """idiot idiots moron morons loser losers scum trash clown pathetic worthless disgusting stupid dumb
garbage imbecile cretin filth vermin bastard bitch asshole retard ugly hate kill die idiota imbecil estupido
estúpido basura asqueroso connard idiote imbécile ordure salaud crétin dummkopf idiotin arschloch abschaum
trottel dreckig""".split()
SECOND_PERSON = "you your yours yourself u ur tu te toi vous votre du dich dir dein deine ihr euch tú ti usted ustedes tus".split()
LOOK_ALIKE = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i"}

_FOLD = LOWER.copy()
for _a, _b in LOOK_ALIKE.items():
    _FOLD[ord(_a)] = ord(_b)
_FOLDED_WORD = IS_WORD.copy()
for _a in "@$!":
    _FOLDED_WORD[ord(_a)] = True


def _hashes(terms: list[str]) -> np.ndarray:
    return np.unique(words(pa.array(terms, pa.large_string())).hashes)


def _member(values: np.ndarray, table: np.ndarray) -> np.ndarray:
    """The slot of each value in a sorted table, or -1."""
    if not len(table) or not len(values):
        return np.full(len(values), -1)
    slot = np.minimum(np.searchsorted(table, values), len(table) - 1)
    return np.where(table[slot] == values, slot, -1)


def terms(w: Words) -> list[np.ndarray]:
    """Hashes of the words and of their beginnings, each as long as w.hashes."""
    data = LOWER[w.data]
    # a beginning is told from a word of the same letters by its length's salt
    out = [w.hashes]
    for m in BEGINNINGS:
        h = hash_spans(data, w.starts, np.minimum(w.starts + m, w.ends)) ^ np.uint64(m * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
        out.append(np.where(w.ends - w.starts > m, h, np.uint64(0)))
    return out


@dataclass
class Lexicon:
    """Sorted hashes and log odds of learned terms, by kind of term."""

    table: list[np.ndarray]
    odds: list[np.ndarray]


def term_counts(w: Words, kinds: list[np.ndarray], label: np.ndarray, half: np.ndarray) -> tuple[np.ndarray, ...]:
    """(kind, term, n0, t0, n1, t1): documents of each half with a term, others and toxic ones."""
    row = np.repeat(np.arange(len(label)), np.diff(w.lo))
    out = []
    for kind, h in enumerate(kinds):
        keep = h != 0
        order = np.lexsort((row[keep], h[keep]))
        hh, rr = h[keep][order], row[keep][order]
        new = np.append(True, (hh[1:] != hh[:-1]) | (rr[1:] != rr[:-1])) if len(hh) else np.zeros(0, bool)
        value, slot = np.unique(hh[new], return_inverse=True)
        cell = np.bincount(slot * 4 + half[rr[new]] * 2 + label[rr[new]], minlength=len(value) * 4).reshape(-1, 4)
        out.append((np.full(len(value), kind), value.astype(np.int64), cell))
    cell = np.concatenate([x[2] for x in out])
    return np.concatenate([x[0] for x in out]), np.concatenate([x[1] for x in out]), *cell.T


def _odds(t, n, pos, neg):
    return np.log((t + 0.5) / (pos + 1)) - np.log((n + 0.5) / (neg + 1))


def lexicon(kind, term, t, n, pos: int, neg: int) -> Lexicon:
    """The terms whose support and log odds are high enough."""
    term, o = term.astype(np.uint64), _odds(t, n, pos, neg)
    good = (t >= SUPPORT) & (o >= ODDS)
    table, odds = [], []
    for k in range(1 + len(BEGINNINGS)):
        own = np.flatnonzero(good & (kind == k))
        own = own[np.argsort(term[own])]
        table.append(term[own])
        odds.append(o[own])
    return Lexicon(table, odds)


_INSULT, _SECOND = _hashes(INSULTS), _hashes(SECOND_PERSON)
N_FEATURES = 19


def features(w: Words, learned: Lexicon, kinds: list[np.ndarray] | None = None) -> np.ndarray:
    """The dense features of every row."""
    n = len(w.lo) - 1
    kinds = terms(w) if kinds is None else kinds
    count = np.diff(w.lo).astype(float)
    row = np.repeat(np.arange(n), np.diff(w.lo))
    per = np.maximum(count, 1)
    total = lambda x, at=row: np.bincount(at, weights=x, minlength=n)[:n]
    out = []
    insult = _member(w.hashes, _INSULT) >= 0
    hits = insult.copy()
    out += [total(insult) / per, np.log1p(total(insult))]
    for h, table, odds in zip(kinds, learned.table, learned.odds):
        slot = _member(h, table)
        hit = slot >= 0
        hits |= hit
        worth = np.where(hit, odds[slot] if len(odds) else 0.0, 0.0)
        out += [total(worth) / per, np.log1p(total(hit))]
    bound = np.cumsum(np.append(0, _member(w.hashes, _SECOND) >= 0))
    at = np.flatnonzero(hits)
    near = bound[np.minimum(at + 6, w.lo[row[at] + 1])] - bound[np.maximum(at - 5, w.lo[row[at]])] > 0 if len(at) else np.zeros(0, bool)
    out += [total(near.astype(float), row[at]) / np.maximum(total(hits), 1), total(np.diff(bound)) / per]
    size = np.maximum(np.diff(w.offsets), 1).astype(float)
    sums = lambda mask: np.diff(np.append(0, np.cumsum(mask))[w.offsets])
    upper = (w.data >= 0x41) & (w.data <= 0x5A)
    lower = (w.data >= 0x61) & (w.data <= 0x7A)
    out += [sums(upper) / np.maximum(sums(upper | lower), 1), sums(w.data == 0x21) / size, sums(~IS_WORD[w.data] & (w.data > 0x20)) / size]
    folded = _FOLD[w.data]
    s, e = runs(_FOLDED_WORD[w.data], w.offsets)
    frow = np.searchsorted(w.offsets, s, "right") - 1
    changed = np.append(0, np.cumsum(folded != LOWER[w.data]))
    odd = changed[e] > changed[s]
    s, e, frow = s[odd], e[odd], frow[odd]
    letters = np.append(0, np.cumsum(upper | lower))
    masked = letters[e] > letters[s]
    shown = _member(hash_spans(folded, s, e), _INSULT) >= 0 if len(s) else np.zeros(0, bool)
    out += [total(masked.astype(float), frow) / per, total(shown.astype(float), frow) / per]
    out += [np.log1p(count), sums(w.data >= 0x80) / size]
    return np.stack(out, 1)


# ---------------------------------------------------------------- boosted trees


@dataclass
class Trees:
    """Complete binary trees of one depth: features, thresholds and leaf values."""

    feature: np.ndarray
    threshold: np.ndarray
    leaf: np.ndarray
    base: float

    def raw(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        depth = int(np.log2(self.leaf.shape[1])) if len(self.leaf) else 0
        for f, t, leaf in zip(self.feature, self.threshold, self.leaf):
            node = np.zeros(len(x), np.int64)
            for _ in range(depth):
                node = 2 * node + 1 + (x[np.arange(len(x)), f[node]] > t[node])
            out += leaf[node - (len(leaf) - 1)]
        return out


def boost(x: np.ndarray, y: np.ndarray, rounds: int = 50, depth: int = 3, rate: float = 0.2, bins: int = 32, ridge: float = 2.0) -> Trees:
    """Second-order boosting of the logistic loss on binned features."""
    cuts = [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1])) for c in x.T]
    binned = np.stack([np.searchsorted(c, v, "left") for c, v in zip(cuts, x.T)], 1)
    mean = np.clip(y.mean(), 1e-4, 1 - 1e-4)
    base = float(np.log(mean / (1 - mean)))
    raw, nodes = np.full(len(y), base), 2**depth - 1
    feature, threshold, leaf = [], [], []
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-raw))
        g, h = y - p, p * (1 - p)
        f, t, node = np.zeros(nodes, np.int64), np.full(nodes, np.inf), np.zeros(len(y), np.int64)
        for level in range(depth):
            first = 2**level - 1
            best, n = np.zeros(2**level), 2**level
            split = np.full(n, -1)
            for j, c in enumerate(cuts):
                if not len(c):
                    continue
                cell = (node - first) * (bins + 1) + binned[:, j]
                gg = np.cumsum(np.bincount(cell, g, n * (bins + 1)).reshape(n, -1), 1)
                hh = np.cumsum(np.bincount(cell, h, n * (bins + 1)).reshape(n, -1), 1)
                gain = gg**2 / (hh + ridge) + (gg[:, -1:] - gg) ** 2 / (hh[:, -1:] - hh + ridge) - gg[:, -1:] ** 2 / (hh[:, -1:] + ridge)
                gain = gain[:, : len(c)]
                k = gain.argmax(1)
                better = gain[np.arange(n), k] > best + 1e-9
                best = np.where(better, gain[np.arange(n), k], best)
                for i in np.flatnonzero(better):
                    f[first + i], t[first + i], split[i] = j, c[k[i]], k[i]
            node = 2 * node + 1 + (x[np.arange(len(x)), f[node]] > t[node])
        at = node - nodes
        value = rate * np.bincount(at, g, nodes + 1) / (np.bincount(at, h, nodes + 1) + ridge)
        raw += value[at]
        feature.append(f), threshold.append(t), leaf.append(value)
    return Trees(np.array(feature), np.array(threshold), np.array(leaf), base)


def isotonic(score: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators; points (score, calibrated) for linear interpolation."""
    order = np.argsort(score, kind="stable")
    xs, first = np.unique(score[order], return_index=True)
    sums = np.add.reduceat(y[order].astype(float), first)
    count = np.diff(np.append(first, len(y))).astype(float)
    pool: list[list[float]] = []
    for x, s, c in zip(xs, sums, count):
        pool.append([s, c, x, x])
        while len(pool) > 1 and pool[-2][0] / pool[-2][1] >= pool[-1][0] / pool[-1][1]:
            s2, c2, _, hi = pool.pop()
            pool[-1][0] += s2
            pool[-1][1] += c2
            pool[-1][3] = hi
    at, value = [], []
    for s, c, lo, hi in pool:
        for p in dict.fromkeys((lo, hi)):
            at.append(p)
            value.append((s + 0.5 * y.mean()) / (c + 0.5))
    return np.array(at), np.maximum.accumulate(np.array(value))


@dataclass
class Model:
    """What scoring needs; a few hundred kilobytes at most."""

    lexicon: Lexicon
    trees: Trees | None
    at: np.ndarray
    value: np.ndarray
    share: float

    def score(self, w: Words) -> np.ndarray:
        n = len(w.lo) - 1
        if self.trees is None:
            return np.full(n, self.share)
        raw = self.trees.raw(features(w, self.lexicon))
        # a slope of a millionth keeps the order within the steps of the calibration
        return np.clip(np.interp(raw, self.at, self.value) * (1 - 2e-6) + 1e-6 + 1e-6 * np.tanh(raw / 8), 0, 1)


def fit(docs: DataFrame, label_rows: DataFrame, bound: int = BOUND) -> Model:
    """Train from a bounded sample of labelled rows outside the held-out fold.

    Terms are counted and features made on the executors; the driver gets the terms that may enter
    a lexicon and one row of features for each sampled document.
    """
    spark = docs.sparkSession
    rows = lab.sampled_docs(docs, lab.sample(label_rows, "toxic", PARTS, HELD, bound), bound)
    rows = rows.select("text", (F.col("label") == 1).cast("int").alias("label"), F.pmod(F.xxhash64("doc_id"), F.lit(2)).cast("int").alias("half"), F.xxhash64("doc_id", F.lit(3)).alias("key"))
    rows = scratch.keep(rows, "labelled")
    size = np.zeros((2, 2), np.int64)
    for r in rows.groupBy("half", "label").count().collect():
        size[r["half"], r["label"]] = r["count"]
    total, toxic = int(size.sum()), int(size[:, 1].sum())
    if size.min() < 2:
        return Model(Lexicon([], []), None, np.zeros(1), np.zeros(1), toxic / total if total else 0.0)

    def count(batches):
        for b in chunks(batches):
            w = words(b.column(0))
            found = term_counts(w, terms(w), *(b.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in (1, 2)))
            yield pa.RecordBatch.from_arrays([pa.array(x.astype(np.int64)) for x in found], names=["kind", "term", "n0", "t0", "n1", "t1"])

    counts = rows.mapInArrow(count, "kind long, term long, n0 long, t0 long, n1 long, t1 long").groupBy("kind", "term").agg(*(F.sum(c).alias(c) for c in ("n0", "t0", "n1", "t1")))

    def may(t, n, pos, neg):
        return (F.expr(t) >= SUPPORT) & (F.log((F.expr(t) + 0.5) / (int(pos) + 1)) - F.log((F.expr(n) + 0.5) / (int(neg) + 1)) >= ODDS - 1e-6)

    counts = counts.where(may("t0", "n0", *size[0][::-1]) | may("t1", "n1", *size[1][::-1]) | may("t0 + t1", "n0 + n1", toxic, total - toxic))
    got = np.array([tuple(r) for r in counts.collect()], np.int64).reshape(-1, 6)
    kind, term, n0, t0, n1, t1 = got.T
    halves = [lexicon(kind, term, t0, n0, size[0, 1], size[0, 0]), lexicon(kind, term, t1, n1, size[1, 1], size[1, 0])]
    shared = spark.sparkContext.broadcast(halves)

    def describe(batches):
        for b in chunks(batches):
            w, half = words(b.column(0)), b.column(2).to_numpy(zero_copy_only=False)
            kinds = terms(w)
            x = np.where((half == 0)[:, None], features(w, shared.value[1], kinds), features(w, shared.value[0], kinds))
            yield pa.RecordBatch.from_arrays([b.column(3), b.column(1), pa.array([r.tobytes() for r in x], pa.binary())], names=["key", "label", "x"])

    sample = sorted(tuple(r) for r in rows.mapInArrow(describe, "key long, label int, x binary").collect())
    x, y = np.array([np.frombuffer(r[2]) for r in sample]), np.array([r[1] for r in sample])
    third = np.arange(len(y)) % 3
    out = np.empty(len(y))
    for k in range(3):
        out[third == k] = boost(x[third != k], y[third != k].astype(float)).raw(x[third == k])
    at, value = isotonic(out, y)
    return Model(lexicon(kind, term, t0 + t1, n0 + n1, toxic, total - toxic), boost(x, y.astype(float)), at, value, toxic / total)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """See the module's docstring."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for b in chunks(batches):
            s = shared.value.score(words(b.column(1)))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(s), pa.array((s >= 0.5).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    df = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.coalesce(lab.fold("doc_id", PARTS) == HELD, F.lit(False)).alias("held_out"))
    return df.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def remove_toxic(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of docs, with all their columns, that are not predicted toxic.

    Null and empty texts are judged by the model like any other (they are kept unless most of the
    labelled texts without words are toxic); repeated rows are all kept or all removed.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for b in chunks(batches):
            bad = shared.value.score(words(b.column(b.schema.get_field_index("text")))) >= 0.5
            yield b.filter(pa.array(~bad))

    return docs.mapInArrow(run, docs.schema)
