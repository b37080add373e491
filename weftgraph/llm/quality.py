"""Quality scores by Bradley-Terry pairwise ranking.

Every document has a latent strength w.x. A pair (good, bad) of labelled documents is won by the good one
with probability 1 / (1 + exp(-(w.x_good - w.x_bad))); w maximises that likelihood over preference pairs,
that is, it minimises the logistic loss on feature differences, with a small ridge. A quantile of the
training strengths is the threshold: the level, among 1000, that separates the training labels best (the
middle one of equals). Scores map the threshold to exactly ``CUT`` by a logistic curve, so
``score >= CUT`` and ``strength >= quantile`` are one test.

Features come from the whole text alone. The model is fitted on at most about ``SAMPLE`` labelled rows
(a hash sample) and ``PAIRS`` pairs; everything else covers all rows.

Defined results: null counts as empty, which has a score like any text; a document without a label, or
with a null one, teaches nothing; several labels of one doc_id count by their mean; without both classes
every score is the share of label 1 (0.5 if there are no labels); repeated rows are scored each and ties in score
stay ties; a very long text is scored whole; an empty table gives an empty result; other columns, whatever their
names, are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fold, named, sampled, text_slices

SAMPLE = 20_000
PAIRS = 200_000
CUT = 0.7
SYMBOLS = "#$%&*@^~=_<>{}[]\\"


def features(text: str | None) -> list[float]:
    """Of one whole text; ratios are per word and by square root, so that small shares of junk count."""
    import operator
    import zlib
    from math import log1p, sqrt

    text = text or ""
    words = text.split()
    n = len(words)
    if not n:
        return [0.0] * 16 + [1.0]
    raw = text.encode("utf-8", "replace")
    lines = [x for x in text.split("\n") if x.strip()]
    sentences = [x for x in text.split(". ") if x.strip()]
    per = lambda k: sqrt(k / n)
    mean = len(text) / n
    return [
        log1p(n),
        mean,
        sqrt(max(0.0, mean - 12.0)),
        per(len(set(words))),
        per(sum(map(operator.eq, words, words[1:]))),
        per(text.count("|")),
        per(text.count("!")),
        per(sum(map(text.count, SYMBOLS))),
        per(sum(map(str.isupper, words))),
        per(sum(map(str.istitle, words))),
        per(text.count(".")),
        per(text.count(",")),
        len(zlib.compress(raw, 1)) / (len(raw) + 40),
        1 - len(set(lines)) / len(lines),
        1 - len(set(sentences)) / len(sentences),
        per(len(lines)),
        0.0,
    ]


@dataclass
class Ranker:
    """w over standardised features, and the curve from strength to score."""

    mean: list[float] = field(default_factory=list)
    scale: list[float] = field(default_factory=list)
    weights: list[float] = field(default_factory=list)
    threshold: float = 0.0
    slope: float = 0.0
    base: float = 0.5

    def score(self, rows):
        import numpy as np

        if not self.weights or not len(rows):
            return np.full(len(rows), self.base)
        z = np.clip((np.asarray(rows, float).reshape(len(rows), -1) - self.mean) / self.scale, -8, 8)
        s = (z * np.asarray(self.weights)).sum(1) - self.threshold
        out = 1 / (1 + np.exp(-np.clip(self.slope * s + np.log(CUT / (1 - CUT)), -30, 30)))
        return np.where(s >= 0, np.maximum(out, CUT), np.minimum(out, np.nextafter(CUT, 0)))


def fit(rows, labels, pairs: int = PAIRS, ridge: float = 1e-3, seed: int = 7) -> Ranker:
    """Newton's method on the pairwise loss."""
    import numpy as np

    if not len(labels):
        return Ranker()
    x, y = np.asarray(rows, float).reshape(len(labels), -1), np.asarray(labels, int)
    base = float(y.mean())
    good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    if not len(good) or not len(bad):
        return Ranker(base=base)
    mean, scale = x.mean(0), x.std(0)
    scale[scale < 1e-9] = 1.0
    z = np.clip((x - mean) / scale, -8, 8)
    draw = np.random.default_rng(seed)
    d = z[draw.choice(good, pairs)] - z[draw.choice(bad, pairs)]
    w = np.zeros(d.shape[1])
    for _ in range(25):
        p = 1 / (1 + np.exp(np.clip(d @ w, -30, 30)))  # that the pair is ranked wrongly
        step = np.linalg.solve((d * (p * (1 - p))[:, None]).T @ d / pairs + ridge * np.eye(len(w)), d.T @ p / pairs - ridge * w)
        w = w + step
        if np.abs(step).max() < 1e-6:
            break
    s = (z * w).sum(1)
    cuts = np.quantile(s, np.linspace(0, 1, 1001))
    kept = lambda t, of: (s[of] >= t).mean()
    gain = np.array([kept(t, good) - kept(t, bad) for t in cuts])
    best = np.flatnonzero(gain >= gain.max() - 1e-12)
    threshold = float(cuts[best[len(best) // 2]])
    spread = float(np.median(s[good])) - threshold
    slope = (np.log(0.98 / 0.02) - np.log(CUT / (1 - CUT))) / spread if spread > 1e-9 else 1.0
    return Ranker(mean.tolist(), scale.tolist(), w.tolist(), threshold, float(slope), base)


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = SAMPLE) -> Ranker:
    """Fit on a hash sample of the labelled rows that are not held out."""
    known = labels.filter(named(label_col).isNotNull() & (fold(named(id_col), 4) != 2)).select(named(id_col).alias("__id"), named(label_col).alias("__label"))
    share = min(1.0, sample / max(1, known.count()))
    known = known.filter(sampled(F.col("__id"), share, 11)).groupBy("__id").agg((F.avg("__label") >= 0.5).cast("int").alias("__label"))

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for part in text_slices(batch, "text"):
                yield pa.RecordBatch.from_arrays([part.column("__id"), part.column("__label"), pa.array([features(t) for t in part.column("text").to_pylist()], pa.list_(pa.float64()))], ["id", "label", "x"])

    # The sample is bounded by its parameter, so it may be broadcast.
    picked = docs.select(named(id_col).alias("doc_id"), named(text_col).alias("text")).join(F.broadcast(known), F.col("doc_id") == F.col("__id"))
    rows = sorted((r.id, r.label, r.x) for r in picked.select("__id", "__label", "text").mapInArrow(run, "id long, label int, x array<double>").collect())
    return fit([x for _, _, x in rows], [y for _, y, _ in rows])


def _scored(model: Ranker, text_col: str) -> Callable[[Iterator], Iterator]:
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for part in text_slices(batch, text_col):
                scores = model.score([features(t) for t in part.column(text_col).to_pylist()])
                yield part, pa.array(scores, pa.float64())

    return run


def score_report(docs: DataFrame, model: Ranker, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score, predicted for every row."""
    scored = _scored(model, "text")

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for part, scores in scored(batches):
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), scores], ["doc_id", "score"])

    out = docs.select(named(id_col).cast("long").alias("doc_id"), named(text_col).alias("text")).mapInArrow(run, "doc_id long, score double")
    return out.withColumn("predicted", (F.col("score") >= CUT).cast("int"))


def keep_good(docs: DataFrame, model: Ranker, text_col: str = "text") -> DataFrame:
    """The rows of docs that are predicted good, all columns."""
    plain = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])  # names may hold any signs
    scored = _scored(model, f"c{docs.columns.index(text_col)}")

    def run(batches: Iterator) -> Iterator:
        import pyarrow.compute as pc

        for part, scores in scored(batches):
            yield part.filter(pc.greater_equal(scores, CUT))

    return plain.mapInArrow(run, plain.schema).toDF(*docs.columns)
