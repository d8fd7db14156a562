"""Operator 7: quality by regularised quadratic discriminant analysis of document statistics."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import giving_back, over_rows, stored
from .langid import held_out

NAMES = ["length", "words", "word_length", "long_words", "upper", "digits", "marks", "stops", "exclaim", "lines", "variety", "top_word", "repeated_lines", "capital_words", "joined"]
D = len(NAMES)
#: Parts of one in which statistics are counted for the fit.
UNIT = 1 << 16
_ARRAY = f"doc_id bigint, x array<double>"


def statistics(text: str | None) -> list[float]:
    """Transformed statistics of a whole text: logarithms of sizes, and square roots of shares."""
    t = text or ""
    words = t.split()
    n, w = len(t), len(words)
    b = np.bincount(np.frombuffer(t.encode("utf-8", "replace"), np.uint8), minlength=256)
    upper, lower, wide = b[65:91].sum(), b[97:123].sum(), b[194:].sum()
    digits, stops, exclaim = b[48:58].sum(), b[[44, 46, 59, 58]].sum(), b[[33, 63]].sum()
    space = b[[9, 10, 11, 12, 13, 32]].sum()
    marks = b[33:127].sum() - upper - lower - digits - stops - exclaim
    lines = [x for x in t.split("\n") if x.strip()]
    seen = set(words)
    lengths = np.fromiter(map(len, words), float, w) if w else np.zeros(1)
    most = 0
    if w:
        counts: dict[str, int] = {}
        for x in words:
            counts[x] = counts.get(x, 0) + 1
        most = max(counts.values())
    share = lambda a, of: float(np.sqrt(a / of)) if of else 0.0
    return [
        float(np.log1p(n)), float(np.log1p(w)), float(np.log1p(lengths.mean())), share((lengths > 14).sum(), w), share(upper, upper + lower + wide), share(digits, n), share(marks, n - space),
        share(stops, w), share(exclaim, n), share(len(lines), w), float(np.log1p(len(seen)) / np.log1p(w)) if w else 0.0, share(most, w), share(len(lines) - len(set(lines)), len(lines)),
        share(sum(map(str.isupper, words)), w), share(sum(not x[-1].isalnum() and x[-1] not in ",." for x in words), w),
    ]


def features(docs: DataFrame) -> DataFrame:
    def make():
        return lambda doc_id, text: {"doc_id": doc_id, "x": [statistics(t) for t in text]}

    return over_rows(docs, ["doc_id", "text"], _ARRAY, make)


class Discriminant:
    """Class means and Cholesky factors of shrunk covariances, kept for scoring."""

    def __init__(self, sums: dict[int, tuple[float, np.ndarray, np.ndarray]]):
        self.classes = {}
        total = sum(s[0] for s in sums.values())
        pooled_n, pooled_x, pooled_xx = (sum(s[i] for s in sums.values()) for i in range(3)) if sums else (0, 0, 0)
        if len(sums) < 2:
            self.prior = 1.0 if 1 in sums else 0.0 if 0 in sums else 0.5
            return
        self.scale = np.sqrt(np.maximum(np.diag(pooled_xx) / pooled_n - (pooled_x / pooled_n) ** 2, 1e-8))
        for k, (n, x, xx) in sums.items():
            mean = x / n
            s = (xx / n - np.outer(mean, mean)) / np.outer(self.scale, self.scale)
            mu, s2 = np.trace(s) / D, (s * s).sum()
            gap = (n + 1 - 2 / D) * (s2 - D * mu * mu)  # oracle approximating shrinkage
            rho = 1.0 if gap <= 0 else min(1.0, ((1 - 2 / D) * s2 + (D * mu) ** 2) / gap)
            factor = np.linalg.cholesky((1 - rho) * s + (rho * max(mu, 0) + 1e-3) * np.eye(D))
            self.classes[k] = (mean, np.linalg.inv(factor), 2 * np.log(np.diag(factor)).sum(), np.log(n / total))

    def score(self, x: np.ndarray) -> np.ndarray:
        if not self.classes:
            return np.full(len(x), self.prior)
        density = {}
        for k, (mean, inverse, logdet, prior) in self.classes.items():
            z = ((x - mean) / self.scale) @ inverse.T
            density[k] = prior - 0.5 * (logdet + (z * z).sum(1))
        gap = np.clip(density[1] - density[0], -30, 30)
        return 1 / (1 + np.exp(-gap))


def fit(labelled: DataFrame) -> Discriminant:
    """From (x, quality): counts, sums and cross products over all labelled rows, added up by Spark on each side of
    a shuffle; a row a class comes to the driver. Statistics count in units of 1 / UNIT, so the sums are of whole numbers
    and don't depend on the order of tasks. Null labels and labels other than 0 and 1 are left out. With one class only
    its label is returned for every text, with none 0.5."""
    from decimal import Decimal

    import pyarrow as pa

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                x = np.array(batch.column(0).to_pylist(), float)
                x = np.rint(np.hstack([np.ones((len(x), 1)), x]) * UNIT).astype(np.int64)
                q = np.array(batch.column(1).to_pylist())
                for k in (0, 1):
                    if (q == k).any():
                        s = x[q == k].T @ x[q == k]
                        yield pa.RecordBatch.from_arrays([pa.array([k] * s.size, pa.int32()), pa.array(np.arange(s.size), pa.int32()), pa.array(map(Decimal, s.ravel().tolist()), pa.decimal128(38, 0))], names=["k", "i", "v"])

    rows = labelled.where("quality in (0, 1)").select("x", F.col("quality").cast("int")).mapInArrow(giving_back(run), "k int, i int, v decimal(38,0)")
    parts: dict[int, np.ndarray] = {}
    for r in rows.groupBy("k", "i").agg(F.sum("v").alias("v")).collect():
        parts.setdefault(r.k, np.zeros((D + 1) ** 2))[r.i] = int(r.v) / UNIT**2
    return Discriminant({k: (m[0, 0], m[0, 1:], m[1:, 1:]) for k, v in parts.items() for m in [v.reshape(D + 1, D + 1)]})


def score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every whole text; null texts are scored as empty.

    The statistics are computed once and stored without the texts; labels meet these short rows in a join by doc_id.
    A label given twice for a document counts twice. Repeated rows each get a row, and rows without doc_id too, which
    aren't held out and meet no label; an empty table gives an empty result; other columns are ignored.
    """
    x = stored(features(docs), "quality")
    gold = labels.where("quality is not null").select("doc_id", "quality")
    model = fit(x.where(~held_out()).join(gold, "doc_id"))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        return lambda doc_id, x: {"doc_id": doc_id, "score": shared.value.score(np.array(x, float).reshape(-1, D))}

    out = over_rows(x, ["doc_id", "x"], "doc_id bigint, score double", make)
    return out.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
