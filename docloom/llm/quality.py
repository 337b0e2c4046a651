"""Quality by positive-unlabelled learning with the non-negative risk estimator.

Trusted positives are documents labelled quality 1; every document, labelled
or not, is unlabelled web text.  A small network over dense text statistics
minimises ``prior * R+(f) + max(0, Ru-(f) - prior * R+-(f))``, the non-negative
unbiased risk; where the second part is negative the step ascends it.

The class prior is a corpus statistic: the score histograms of the trusted
positives held out, one in ``HELD`` by hash whatever their number, and of all
documents give the largest share of positives that no score threshold
contradicts (best-bin estimation).  Gradient steps read none of those held out.

Small steps over bounded samples, ``SAMPLE`` positives and as many unlabelled
documents, give each network its start.  Then ``PASSES`` steps follow whose
unlabelled risk is summed over all documents, and the weights of least risk
over all documents stay.

Defined results: a null or blank text scores 0 and isn't kept.  Missing and
other labels than 1 aren't used.  Without trusted positives, or with fewer than
two that aren't held out, everything with a word is kept (score 1), as there is
nothing to reject it by.  Repeated rows
get equal scores.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docloom.llm import textkit as tk
from docloom.llm.common import materialize

#: Most trusted positives that gradient steps read, and most unlabelled documents that a network starts from.
SAMPLE = 8000
#: Steps over all documents after that.
PASSES = 15
#: One trusted positive in so many is held out for the prior.
HELD = 4
CELLS = 400
FEATURES = ["caps", "caps_words", "symbols", "marks", "digits", "bars", "spaces", "breaks", "word_length", "long_words", "repeats", "distinct", "same_lines", "marked_words", "ends", "high"]
_MARK = np.zeros(256, bool)
_MARK[list(b".,;:!?")] = True
_END = np.zeros(256, bool)
_END[list(b".!?")] = True
_PLAIN = np.zeros(256, bool)
_PLAIN[list(b".,;:'\"-()!?")] = True


def _distinct(doc: np.ndarray, h: np.ndarray, n: int) -> np.ndarray:
    """Distinct hashes of each of n documents, by their upper 40 bits; one sort of plain integers."""
    key = np.sort((doc.astype(np.uint64) << np.uint64(40)) | (h >> np.uint64(24)))
    new = np.ones(len(key), bool)
    new[1:] = key[1:] != key[:-1]
    return tk.count_by_doc((key[new] >> np.uint64(40)).astype(np.int64), n)


def features(texts: pa.Array) -> np.ndarray:
    """A row of FEATURES for each text, and before them its number of words."""
    rows = []
    for lo, hi, b, off in tk.slices(texts):
        n, size = hi - lo, np.maximum(np.diff(off), 1)
        mask = tk.word_mask(b) if len(b) else np.zeros(0, bool)
        start, end, doc = tk.runs(mask, off)
        words = tk.count_by_doc(doc, n)
        per = np.maximum(words, 1)
        up = tk.UPPER[b]
        low = (b >= 97) & (b <= 122)
        letters = np.maximum(tk.sum_mask(up | low, off), 1)
        us, ue, udoc = tk.runs(up, off)
        symbol = (b > 32) & (b < 127) & ~tk.WORD[b] & ~_PLAIN[b]
        h = tk.Hasher(b)
        word = h.of(start, end)
        repeat = np.zeros(len(word), bool)
        repeat[1:] = (word[1:] == word[:-1]) & (doc[1:] == doc[:-1])
        # distinct words of a text fall with its length: compare with its square root
        distinct = _distinct(doc, word, n) / np.sqrt(per)
        ls, le, ldoc = tk.runs(b != 10, off)
        lines = np.maximum(tk.count_by_doc(ldoc, n), 1)
        ts, te, tdoc = tk.runs(~tk.SPACE[b], off)
        c = tk.running(symbol | (b == 33))
        tokens = np.maximum(tk.count_by_doc(tdoc, n), 1)
        rows.append(np.stack([
            words, tk.sum_mask(up, off) / letters, tk.count_by_doc(udoc, n, ue - us >= 3) / per, tk.sum_mask(symbol, off) / size,
            tk.sum_mask(_MARK[b], off) / per, tk.sum_mask((b >= 48) & (b < 58), off) / size, tk.sum_mask(b == 124, off) / tokens,
            tk.sum_mask(tk.SPACE[b], off) / size, tk.sum_mask(b == 10, off) / size, tk.count_by_doc(doc, n, end - start) / per / 10,
            tk.count_by_doc(doc, n, end - start > 20) / per, tk.count_by_doc(doc, n, repeat) / per, np.minimum(distinct, 20) / 10,
            1 - _distinct(ldoc, h.of(ls, le), n) / lines, tk.count_by_doc(tdoc, n, (c[te] - c[ts]) >= 2) / tokens,
            tk.sum_mask(_END[b], off) / per, tk.sum_mask(b >= 128, off) / size,
        ], 1))
    return np.concatenate(rows) if rows else np.zeros((0, len(FEATURES) + 1))


@dataclass
class Net:
    """One hidden layer over standardised, clipped features."""

    mean: np.ndarray
    scale: np.ndarray
    w: list[np.ndarray]

    def inputs(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale, -8, 8)

    def score(self, x: np.ndarray) -> np.ndarray:
        a, b, c, d = self.w
        return np.tanh(self.inputs(x) @ a + b) @ c + d[0]


def fit(positive: np.ndarray, unlabelled: np.ndarray, prior: float, hidden: int = 12, steps: int = 600, rate: float = 0.01, size: int = 1024, decay: float = 1e-3) -> Net:
    """Non-negative PU learning with the sigmoid loss and Adam."""
    rng = np.random.default_rng(7)
    m = positive.shape[1]
    w = [rng.normal(0, m**-0.5, (m, hidden)), np.zeros(hidden), rng.normal(0, hidden**-0.5, hidden), np.zeros(1)]
    both = np.concatenate([positive, unlabelled])
    net = Net(both.mean(0), both.std(0) + 1e-3, w)
    p, u = net.inputs(positive), net.inputs(unlabelled)
    first, second = [np.zeros_like(v) for v in w], [np.zeros_like(v) for v in w]
    sigmoid = lambda z: 1 / (1 + np.exp(-np.clip(z, -40, 40)))
    for step in range(1, steps + 1):
        x = np.concatenate([p[rng.integers(0, len(p), size)], u[rng.integers(0, len(u), size)]])
        a = np.tanh(x @ w[0] + w[1])
        s = sigmoid(a @ w[2] + w[3][0])  # loss of a positive: 1 - s; of a negative: s
        slope = s * (1 - s) / size
        risk_n = s[size:].mean() - prior * s[:size].mean()
        to_p = np.concatenate([-prior * slope[:size], np.zeros(size)])
        to_n = np.concatenate([-prior * slope[:size], slope[size:]])
        dz = to_p + to_n if risk_n >= 0 else -to_n
        da = dz[:, None] * w[2] * (1 - a**2)
        grads = [x.T @ da + decay * w[0], da.sum(0), a.T @ dz + decay * w[2], np.array([dz.sum()])]
        for i, g in enumerate(grads):
            first[i] = 0.9 * first[i] + 0.1 * g
            second[i] = 0.999 * second[i] + 0.001 * g * g
            w[i] -= rate * (first[i] / (1 - 0.9**step)) / (np.sqrt(second[i] / (1 - 0.999**step)) + 1e-8)
    return net


def _sums(net: Net):
    """For each task the count, loss and gradients of its documents as unlabelled ones, summed: one row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(2 + sum(v.size for v in net.w))
        for batch in batches:
            x = np.asarray(batch["x"].flatten(), float).reshape(batch.num_rows, -1)
            total += loss_sums(net, x[:, 1:])
        yield pa.RecordBatch.from_arrays([pa.array([total.tolist()], pa.list_(pa.float64()))], ["sums"])

    return run


def _total(rows: DataFrame, net: Net) -> np.ndarray:
    """``_sums`` over all tasks: added up in Spark, as decimals, so that their order doesn't matter and the driver gets one row a number."""
    parts = rows.select("x").mapInArrow(_sums(net), "sums array<double>").select(F.posexplode("sums").alias("i", "v"))
    found = parts.groupBy("i").agg(F.sum(F.col("v").cast("decimal(38,15)")).cast("double").alias("v")).collect()
    out = np.zeros(2 + sum(v.size for v in net.w))
    for r in found:
        out[r.i] = r.v
    return out


def loss_sums(net: Net, x: np.ndarray) -> np.ndarray:
    """Count, summed loss as negatives, and its summed gradients by weight."""
    x = net.inputs(x)
    a = np.tanh(x @ net.w[0] + net.w[1])
    s = 1 / (1 + np.exp(-np.clip(a @ net.w[2] + net.w[3][0], -40, 40)))
    dz = s * (1 - s)
    da = dz[:, None] * net.w[2] * (1 - a**2)
    return np.concatenate([[len(x), s.sum()], (x.T @ da).ravel(), da.sum(0), a.T @ dz, [dz.sum()]])


def refine(net: Net, positive: np.ndarray, rows: DataFrame, prior: float, passes: int = PASSES, rate: float = 0.01, decay: float = 1e-3) -> tuple[Net, list[float]]:
    """``net`` after steps on the risk over all ``rows`` (x), and the risk before each step and after the last."""
    first, second, risks, best = 0.0, 0.0, [], net
    for step in range(1, passes + 2):
        total, p = _total(rows, net), loss_sums(net, positive)
        u, p = total[1:] / max(1.0, total[0]), p[1:] / max(1, len(positive))
        flat = np.concatenate([v.ravel() for v in net.w])
        shrunk = np.concatenate([np.full(v.size, float(i in (0, 2))) for i, v in enumerate(net.w)]) * flat
        risk_n = u[0] - prior * p[0]
        risks.append(float(prior * (1 - p[0]) + max(0.0, risk_n) + decay / 2 * (shrunk @ flat)))
        if risks[-1] == min(risks):
            best = net
        g = (u[1:] - 2 * prior * p[1:] if risk_n >= 0 else prior * p[1:] - u[1:]) + decay * shrunk
        first, second = 0.9 * first + 0.1 * g, 0.999 * second + 0.001 * g * g
        flat = flat - rate * (1 - (step - 1) / (passes + 1)) * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
        cuts = np.cumsum([v.size for v in net.w])[:-1]
        net = Net(net.mean, net.scale, [v.reshape(old.shape) for v, old in zip(np.split(flat, cuts), net.w)])
    return best, risks


def best_bin_prior(positive: np.ndarray, unlabelled: np.ndarray, delta: float = 0.1, gamma: float = 0.01) -> float:
    """Largest share of positives that every upper tail of the two score histograms allows.

    For each threshold, (share of unlabelled above) / (share of positives above)
    bounds the prior; the threshold with the least upper confidence bound is used.
    """
    n, m = max(1.0, positive.sum()), max(1.0, unlabelled.sum())
    p, u = positive[::-1].cumsum() / n, unlabelled[::-1].cumsum() / m
    wide = np.sqrt(np.log(4 / delta) / (2 * n)) + np.sqrt(np.log(4 / delta) / (2 * m))
    ok = p > gamma
    if not ok.any():
        return 0.5
    bound = (u[ok] + (1 + gamma) * wide) / p[ok]
    k = int(bound.argmin())
    return float(np.clip(u[ok][k] / p[ok][k], 0.01, 0.99))


def _featured(docs: DataFrame, text_col: str = "text", drop_text: bool = False) -> tuple[DataFrame, str]:
    """``docs`` (without its text, if told so) with features in a column of a name that they don't have, written once: training and scoring read these."""
    name = "x"
    while name in docs.columns:
        name = f"_{name}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = features(batch[text_col].cast(pa.string())).astype(np.float32)
            flat = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), pa.array(x.ravel()))
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in kept.names), flat], [*kept.names, name])

    kept = T.StructType([f for f in docs.schema if not (drop_text and f.name == text_col)])
    return materialize(docs.mapInArrow(run, T.StructType([*kept, T.StructField(name, T.ArrayType(T.FloatType()))])), "quality-features"), name


def _cells(net: Net):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.asarray(batch["x"].flatten(), float).reshape(batch.num_rows, -1)
            s = 1 / (1 + np.exp(-np.clip(net.score(x[:, 1:]), -40, 40)))
            cell = np.minimum((s * CELLS).astype(np.int64), CELLS - 1)
            held = batch["held"].to_numpy(zero_copy_only=False).astype(bool)
            u, p = np.bincount(cell, x[:, 0] > 0, CELLS), np.bincount(cell, held, CELLS)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(CELLS)), pa.array(u.astype(np.int64)), pa.array(p.astype(np.int64))], ["cell", "u", "p"])

    return run


@dataclass
class Model:
    net: Net | None
    prior: float
    #: Scores above this are kept.
    cut: float = 0.5

    def score(self, x: np.ndarray) -> np.ndarray:
        """Scores of rows of ``features``."""
        if self.net is None:
            return (x[:, 0] > 0).astype(float)
        s = 1 / (1 + np.exp(-np.clip(self.net.score(x[:, 1:]), -40, 40)))
        return np.where(x[:, 0] > 0, s, 0.0)

    def score_lists(self, x: pa.Array) -> np.ndarray:
        return self.score(np.asarray(x.flatten(), float).reshape(len(x), len(FEATURES) + 1))


def _matrix(df: DataFrame) -> np.ndarray:
    found = df.select("x").toPandas()["x"]
    return np.stack(found.to_numpy()).astype(float)[:, 1:] if len(found) else np.zeros((0, len(FEATURES)))


def train(featured: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """Fit ``featured`` (key, x) on at most ``sample`` positives and all documents, from a start on ``sample`` of these; the prior is of all documents."""
    table = featured.where("x[0] > 0")
    good = labels.where(F.col("quality").cast("int") == 1).select(F.col("doc_id").cast("bigint").alias("key")).where("key is not null").distinct().withColumn("held", F.lit(1))
    marked = table.join(good, "key", "left").select("key", "x", F.coalesce("held", F.lit(0)).alias("held"), F.xxhash64("key").alias("h"))
    marked = materialize(marked, "quality-marked")
    fresh = (F.col("held") == 1) & (F.pmod(F.xxhash64("h", F.lit("prior")), F.lit(HELD)) == 0)
    p = _matrix(marked.where((F.col("held") == 1) & ~fresh).orderBy("h", "key").limit(sample))
    u = _matrix(marked.orderBy(F.xxhash64("h"), "key").limit(sample))
    if len(p) < 2 or len(u) < 2:
        return Model(None, 1.0)
    prior, net = 0.5, None
    for _ in range(2):  # the first network ranks well enough to estimate the prior; the second uses it
        net, _ = refine(fit(p, u, prior), p, marked, prior)
        cells = marked.select("x", fresh.alias("held")).mapInArrow(_cells(net), "cell bigint, u bigint, p bigint").groupBy("cell").agg(F.sum("u").alias("u"), F.sum("p").alias("p")).toPandas()
        hist = np.zeros((2, CELLS))
        hist[0, cells["cell"]], hist[1, cells["cell"]] = cells["p"], cells["u"]
        prior = best_bin_prior(hist[0], hist[1])
    net, _ = refine(fit(p, u, prior), p, marked, prior)
    return Model(net, prior)


def classify(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """(doc_id, quality, keep) of every row of ``docs``."""
    rows = docs.select(F.col("doc_id").cast("bigint").alias("key"), F.col("text").cast("string").alias("text"))
    table, _ = _featured(rows, drop_text=True)
    model = train(table, labels, sample)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = model.score_lists(batch["x"])
            yield pa.RecordBatch.from_arrays([batch["key"], pa.array(s), pa.array(s > model.cut)], ["doc_id", "quality", "keep"])

    return table.mapInArrow(run, "doc_id bigint, quality double, keep boolean")


def keep_good(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """The rows of ``docs`` that the classifier keeps; columns as they are."""
    table, x = _featured(docs)
    model = train(table.select(F.col("doc_id").cast("bigint").alias("key"), F.col(x).alias("x")), labels, sample)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = batch.filter(pa.array(model.score_lists(batch[x]) > model.cut))
            yield pa.RecordBatch.from_arrays(kept.columns[:-1], kept.schema.names[:-1])

    return table.mapInArrow(run, docs.schema)
