"""Toxicity: gradient-boosted trees over dense features, with isotonic calibration.

A bounded sample of labelled documents (``SAMPLE`` of each class) teaches a
lexicon of words and word stems, the trees and the calibration; every document
is then scored in one pass that moves no text.

The lexicon starts from ``SEED`` and adds terms (whole words, and stems of 4
to 7 bytes) that are frequent in toxic and rare in other labelled documents,
chosen greedily: a term must cover enough toxic documents that no better term
covers.

Defined results: a null or blank text has all features 0 and is never toxic.
A missing label, or one that isn't 0 or 1, isn't used; of several labels of a
doc_id the highest counts.  If a class has no labelled document, nothing can
be fitted and ``p_toxic`` is the share of toxic labels (0 without labels).
Repeated rows get equal scores.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docloom.llm import textkit as tk
from docloom.llm.common import materialize

#: Most labelled documents of each class that training reads.
SAMPLE = 5000
SEED = ["idiot", "idiots", "moron", "morons", "stupid", "loser", "losers", "scum", "trash", "worthless", "pathetic", "disgusting", "clown", "imbecile", "dumb", "hate", "filth", "vermin", "freak", "jerk"]
SECOND = ["you", "your", "yours", "yourself", "u", "ur", "du", "dich", "dir", "dein", "deine", "ihr", "euch", "tu", "toi", "te", "ton", "ta", "tes", "vous", "votre", "vos", "usted", "ustedes", "ti", "tus", "vosotros"]
NEAR, STEMS = 5, (4, 5, 6, 7)
FEATURES = ["log_words", "seed_density", "word_density", "stem_density", "any_density", "any_hits", "second_density", "second_near", "obfuscated_hits", "obfuscated_rate", "caps_rate", "caps_words", "exclamations", "questions", "symbols", "repeats"]
_LEET = np.arange(256)
for a, c in zip(b"0134578@$!|+", b"oieastbasilt"):
    _LEET[a] = c
_LOWER = np.arange(256)
_LOWER[65:91] += 32
_LEET = _LOWER[_LEET]
_INSIDE = np.zeros(256, bool)
_INSIDE[[*b"0134578@$!|+*"]] = True


@dataclass
class Lexicon:
    words: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))
    stems: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))


def _member(values: np.ndarray, ordered: np.ndarray) -> np.ndarray:
    if not len(ordered):
        return np.zeros(len(values), bool)
    i = np.minimum(np.searchsorted(ordered, values), len(ordered) - 1)
    return ordered[i] == values


_SEED, _SECOND = np.sort(tk.hash_words(SEED)), np.sort(tk.hash_words(SECOND))
STEM_SALT = np.uint64(0x5851F42D4C957F2D)


def _terms(b: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[np.ndarray], np.ndarray, tk.Hasher]:
    mask = tk.word_mask(b) if len(b) else np.zeros(0, bool)
    start, end, doc = tk.runs(mask, off)
    h = tk.Hasher(b)
    stems = [np.where(end - start > k, h.of(start, np.minimum(start + k, end)) ^ STEM_SALT, 0).astype(np.uint64) for k in STEMS]
    return start, end, doc, stems, h.of(start, end), h


def features(texts: pa.Array, lexicon: Lexicon) -> np.ndarray:
    """A row of FEATURES for each text; rates are per word or per byte."""
    rows = []
    raw = tk.slices(texts)
    for lo, hi, b, off in tk.slices(texts, lower=True):
        _, _, rb, roff = next(raw)
        n = hi - lo
        start, end, doc, stems, word, _ = _terms(b, off)
        words = np.maximum(tk.count_by_doc(doc, n), 1)
        size = np.maximum(np.diff(roff), 1)
        seed, learned = _member(word, _SEED), _member(word, lexicon.words)
        stem = np.zeros(len(word), bool)
        for s in stems:
            stem |= _member(s, lexicon.stems)
        hit = seed | learned | stem
        second = _member(word, _SECOND)
        # a hit with a second-person word among its neighbours in the same document
        at = np.flatnonzero(second)
        near = np.zeros(len(word), bool)
        if len(at) and hit.any():
            i = np.flatnonzero(hit)
            j = np.searchsorted(at, i)
            for side in (np.maximum(j - 1, 0), np.minimum(j, len(at) - 1)):
                near[i] |= (np.abs(at[side] - i) <= NEAR) & (doc[at[side]] == doc[i])
        # words broken by digits or symbols, read again with these as letters
        inside = _INSIDE[b]
        wide = (tk.WORD[b] | inside) if len(b) else inside
        ws, we, wdoc = tk.runs(wide, off)
        odd, alpha = tk.running(inside), tk.running((b >= 97) & (b <= 122))
        if len(b):  # digits and symbols at the end are no part of the word
            solid = np.maximum.accumulate(np.where(wide & ~inside, np.arange(len(b), dtype=np.int32), np.int32(-1)))
            we = np.maximum(solid[we - 1] + 1, ws)
        broken = (odd[we] > odd[ws]) & (alpha[we] - alpha[ws] >= 2) & (odd[we] - odd[ws] <= alpha[we] - alpha[ws])
        bs, be, bdoc = ws[broken], we[broken], wdoc[broken]
        bh = tk.Hasher(b, tk.BYTE[_LEET]).of(bs, be)
        obfuscated = _member(bh, _SEED) | _member(bh, lexicon.words)
        up = tk.UPPER[rb]
        letters = np.maximum(tk.sum_mask(up | ((rb >= 97) & (rb <= 122)) | (rb >= 128), roff), 1)
        us, ue, udoc = tk.runs(up, roff)
        same = np.zeros(len(b), bool)
        if len(b) > 2:
            same[2:] = (b[2:] == b[1:-1]) & (b[1:-1] == b[:-2]) & (b[2:] >= 97) & (b[2:] <= 122)
        symbol = (rb > 32) & (rb < 127) & ~tk.WORD[rb] & ~np.isin(rb, list(b".,;:'\"-()!?"))
        hits = tk.count_by_doc(doc, n, hit)
        rows.append(np.stack([
            np.log1p(tk.count_by_doc(doc, n)), tk.count_by_doc(doc, n, seed) / words, tk.count_by_doc(doc, n, learned) / words,
            tk.count_by_doc(doc, n, stem) / words, hits / words, hits, tk.count_by_doc(doc, n, second) / words, tk.count_by_doc(doc, n, near) / words,
            tk.count_by_doc(bdoc, n, obfuscated), tk.count_by_doc(bdoc, n) / words, tk.sum_mask(up, roff) / letters,
            tk.count_by_doc(udoc, n, ue - us >= 3) / words, tk.sum_mask(rb == 33, roff) / words, tk.sum_mask(rb == 63, roff) / words,
            tk.sum_mask(symbol, roff) / size, tk.sum_mask(same, off) / words,
        ], 1))
    return np.concatenate(rows) if rows else np.zeros((0, len(FEATURES)))


# --- lexicon -----------------------------------------------------------------


def _doc_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(term, stem?, toxic documents, other documents) counted within a slice."""
    for batch in batches:
        toxic = batch["toxic"].to_numpy(zero_copy_only=False).astype(bool)
        for lo, hi, b, off in tk.slices(batch["text"], lower=True):
            start, end, doc, stems, word, _ = _terms(b, off)
            for kind, values in [(False, word), *((True, s) for s in stems)]:
                ok = values != 0
                pair = np.unique(np.stack([values[ok], doc[ok].astype(np.uint64)], 1), axis=0) if ok.any() else np.zeros((0, 2), np.uint64)
                term, inverse = np.unique(pair[:, 0], return_inverse=True)
                bad = toxic[lo + pair[:, 1].astype(np.int64)]
                t, c = np.bincount(inverse, bad, len(term)), np.bincount(inverse, ~bad, len(term))
                yield pa.RecordBatch.from_arrays([pa.array(term.view(np.int64)), pa.array(np.full(len(term), kind)), pa.array(t.astype(np.int64)), pa.array(c.astype(np.int64))], ["term", "stem", "t", "c"])


def _covered(terms: np.ndarray):
    """Pairs (document, term) of the toxic documents that hold a candidate term."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch["key"].to_numpy()
            for lo, hi, b, off in tk.slices(batch["text"], lower=True):
                start, end, doc, stems, word, _ = _terms(b, off)
                for values in (word, *stems):
                    ok = _member(values, terms)
                    pair = np.unique(np.stack([values[ok], doc[ok].astype(np.uint64)], 1), axis=0)
                    yield pa.RecordBatch.from_arrays([pa.array(ids[lo + pair[:, 1].astype(np.int64)]), pa.array(pair[:, 0].view(np.int64))], ["key", "term"])

    return run


def learn_lexicon(sample: DataFrame) -> Lexicon:
    """Terms for ``sample`` (key, text, toxic); all candidates are of these labelled documents, whose number is bounded."""
    totals = dict(sample.groupBy("toxic").count().collect())
    nt, nc = totals.get(1, 0), totals.get(0, 0)
    if not nt or not nc:
        return Lexicon()
    least = max(3, 0.004 * nt)
    counts = sample.mapInArrow(_doc_terms, "term bigint, stem boolean, t bigint, c bigint").groupBy("term", "stem").agg(F.sum("t").alias("t"), F.sum("c").alias("c"))
    odds = ((F.col("t") + 0.5) / (nt + 1)) / ((F.col("c") + 0.5) / (nc + 1))
    found = counts.where((F.col("t") >= least) & (odds >= 20)).collect()
    if not found:
        return Lexicon()
    stem = {r.term & 0xFFFFFFFFFFFFFFFF: r.stem for r in found}
    bad = {r.term & 0xFFFFFFFFFFFFFFFF: r.c for r in found}
    terms = np.sort(np.array(list(stem), np.uint64))
    pairs = sample.where("toxic = 1").select("key", "text").mapInArrow(_covered(terms), "key bigint, term bigint").toPandas()
    doc = np.unique(pairs["key"].to_numpy(), return_inverse=True)[1]
    which = np.searchsorted(terms, pairs["term"].to_numpy().view(np.uint64))
    penalty = np.array([bad[int(t)] * nt / nc for t in terms])
    open_, chosen = np.ones(doc.max(initial=-1) + 1, bool), []
    while True:
        live = open_[doc]
        gain = np.bincount(which[live], minlength=len(terms)) - penalty
        best = int(np.argmax(gain))  # ties: the lowest hash
        if gain[best] < least:
            break
        chosen.append(int(terms[best]))
        open_[doc[live & (which == best)]] = False
    # words found in very many toxic documents stay too, though other terms cover these
    seen = np.bincount(which, minlength=len(terms))
    chosen = sorted({*chosen, *(int(t) for t, k in zip(terms, seen) if not stem[int(t)] and k >= 0.05 * nt)})
    return Lexicon(np.array([t for t in chosen if not stem[t]], np.uint64), np.array([t for t in chosen if stem[t]], np.uint64))


# --- trees and calibration ---------------------------------------------------


@dataclass
class Forest:
    """Gradient-boosted trees of fixed depth, stored as arrays of splits."""

    base: float
    split_feature: np.ndarray  # trees x inner nodes
    split_value: np.ndarray
    leaf: np.ndarray  # trees x leaves
    knots: tuple[np.ndarray, np.ndarray] = (np.zeros(0), np.zeros(0))

    def margin(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        rows = np.arange(len(x))
        depth = int(np.log2(self.leaf.shape[1]))
        for f, v, leaf in zip(self.split_feature, self.split_value, self.leaf):
            node = np.zeros(len(x), np.int64)
            for _ in range(depth):
                node = 2 * node + 1 + (x[rows, f[node]] > v[node])
            out += leaf[node - len(f)]
        return out

    def probability(self, x: np.ndarray) -> np.ndarray:
        return np.interp(self.margin(x), *self.knots)


def boost(x: np.ndarray, y: np.ndarray, trees: int = 60, depth: int = 3, rate: float = 0.15, bins: int = 64, ridge: float = 1.0) -> Forest:
    """Second-order boosting of the logistic loss over quantile histograms."""
    n, m = x.shape
    edges = [np.unique(np.quantile(np.unique(x[:, j]), np.linspace(0, 1, bins)[1:-1])) for j in range(m)]
    code = np.stack([np.searchsorted(e, x[:, j], "left") for j, e in enumerate(edges)], 1)  # code <= i iff x <= edge i
    p0 = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    base = float(np.log(p0 / (1 - p0)))
    margin = np.full(n, base)
    inner = 2**depth - 1
    sf, sv, leaves = np.zeros((trees, inner), np.int64), np.full((trees, inner), np.inf), np.zeros((trees, inner + 1))
    for t in range(trees):
        p = 1 / (1 + np.exp(-margin))
        g, h = p - y, p * (1 - p)
        node = np.zeros(n, np.int64)
        for level in range(depth):
            first, width = 2**level - 1, 2**level
            best = np.full(width, 1e-9)
            for j in range(m):
                if not len(edges[j]):
                    continue
                key = (node - first) * bins + code[:, j]
                gs = np.bincount(key, g, width * bins).reshape(width, bins).cumsum(1)
                hs = np.bincount(key, h, width * bins).reshape(width, bins).cumsum(1)
                gt, ht = gs[:, -1:], hs[:, -1:]
                gain = gs**2 / (hs + ridge) + (gt - gs) ** 2 / (ht - hs + ridge) - gt**2 / (ht + ridge)
                gain = np.where((hs > 1e-3) & (ht - hs > 1e-3), gain, 0)[:, : len(edges[j])]
                k = gain.argmax(1)
                better = gain[np.arange(width), k] > best
                best = np.where(better, gain[np.arange(width), k], best)
                sf[t, first : first + width][better] = j
                sv[t, first : first + width][better] = edges[j][k[better]]
            node = 2 * node + 1 + (x[np.arange(n), sf[t, node]] > sv[t, node])
        at = node - inner
        leaves[t] = -rate * np.bincount(at, g, inner + 1) / (np.bincount(at, h, inner + 1) + ridge)
        margin += leaves[t, at]
    return Forest(base, sf, sv, leaves)


def isotonic(score: np.ndarray, y: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots of the non-decreasing weighted least-squares fit (pool adjacent violators)."""
    value, inverse = np.unique(score, return_inverse=True)
    weight, total = np.bincount(inverse, weights), np.bincount(inverse, y * weights)
    blocks: list[list[float]] = []  # weight, sum, first index, last index
    for i in range(len(value)):
        blocks.append([weight[i], total[i], i, i])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][0] >= blocks[-1][1] * blocks[-2][0]:
            w, s, _, last = blocks.pop()
            blocks[-1] = [blocks[-1][0] + w, blocks[-1][1] + s, blocks[-1][2], last]
    xs, ys = [], []
    for w, s, first, last in blocks:
        xs += [value[first], value[last]]
        ys += [s / w, s / w]
    return np.array(xs), np.array(ys)


@dataclass
class Model:
    lexicon: Lexicon
    forest: Forest | None
    prior: float

    def probability(self, texts: pa.Array) -> np.ndarray:
        x = features(texts, self.lexicon)
        p = self.forest.probability(x) if self.forest else np.full(len(x), self.prior)
        return np.where(x[:, 0] > 0, p, 0.0)


def _feature_rows(lexicon: Lexicon):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = features(batch["text"], lexicon)
            flat = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), pa.array(x.ravel()))
            yield pa.RecordBatch.from_arrays([batch["key"], batch["toxic"], flat], ["key", "toxic", "x"])

    return run


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """Fit on at most ``sample`` labelled documents of each class, those of lowest hashed doc_id."""
    labelled = labels.select(F.col("doc_id").cast("bigint").alias("key"), F.col("toxic").cast("int").alias("toxic")).where("toxic in (0, 1) and key is not null").groupBy("key").agg(F.max("toxic").alias("toxic"))
    shares = dict(labelled.groupBy("toxic").count().collect())
    chosen = None
    for y in (0, 1):
        part = labelled.where(F.col("toxic") == y).orderBy(F.xxhash64("key"), "key").limit(sample)
        chosen = part if chosen is None else chosen.union(part)
    own = docs.select(F.col("doc_id").cast("bigint").alias("key"), F.col("text").cast("string").alias("text"))
    # 2 * sample rows at most, of two integers: bounded whatever the tables' size
    once = Window.partitionBy(F.xxhash64("text")).orderBy("key")
    rows = own.where("text is not null").join(F.broadcast(chosen), "key").withColumn("n", F.row_number().over(once)).where("n = 1").drop("n")
    rows = materialize(rows, "toxicity-sample")
    counts = dict(rows.groupBy("toxic").count().collect())
    if len(counts) < 2:
        return Model(Lexicon(), None, float(bool(counts.get(1))))
    fit, hold = rows.where(F.pmod(F.xxhash64("key", F.lit(3)), F.lit(4)) > 0), rows.where(F.pmod(F.xxhash64("key", F.lit(3)), F.lit(4)) == 0)
    lexicon = learn_lexicon(fit)
    schema = "key bigint, toxic int, x array<double>"
    data = rows.select("key", "toxic", "text").mapInArrow(_feature_rows(lexicon), schema).toPandas().sort_values("key", kind="stable")
    held = set(hold.select("key").toPandas()["key"])
    x, y = np.stack(data["x"].to_numpy()), data["toxic"].to_numpy().astype(float)
    out = data["key"].isin(held).to_numpy()
    if not 0 < y[~out].sum() < (~out).sum():
        out = np.zeros(len(y), bool)
    forest = boost(x[~out], y[~out])
    check = out if 0 < y[out].sum() < out.sum() else ~out
    # the classes are sampled to equal bounds: weigh them back to their shares among the labels
    share = np.array([shares.get(0, 0) / max(1, (y == 0).sum()), shares.get(1, 0) / max(1, (y == 1).sum())])
    forest.knots = isotonic(forest.margin(x[check]), y[check], share[y[check].astype(int)])
    return Model(lexicon, forest, float(y.mean()))


def _scores(model: Model, threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = model.probability(batch["text"])
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(p), pa.array(p >= threshold)], ["doc_id", "p_toxic", "is_toxic"])

    return run


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, sample: int = SAMPLE) -> DataFrame:
    """(doc_id, p_toxic, is_toxic) of every row of ``docs``."""
    model = train(docs, labels, sample)
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_scores(model, threshold), "doc_id bigint, p_toxic double, is_toxic boolean")


def keep_clean(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, sample: int = SAMPLE) -> DataFrame:
    """``docs`` without its toxic rows; columns as they are, nothing shuffled."""
    model = train(docs, labels, sample)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = model.probability(batch["text"].cast(pa.string())) < threshold
            yield batch.filter(pa.array(keep))

    return docs.mapInArrow(run, docs.schema)
