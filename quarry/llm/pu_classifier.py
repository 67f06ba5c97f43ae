"""Quality classifier by positive-unlabelled learning (non-negative unbiased risk, Kiryo et al. 2017).

Trusted positives are labelled good; the unlabelled sample is any text of the corpus. With class prior p, the
risk is p * L+(positives) + max(0, L-(unlabelled) - p * L-(positives)); where the bracket is negative, the
step goes up its gradient instead. The model is one hidden layer over measurements of the whole text and its
words and word pairs hashed into BUCKETS.

No negative label is used. The prior is estimated from positives and unlabelled texts alone by the best bin (Garg et al.
2021): half of both train a classifier of positives against unlabelled; on the other half, the prior is the least
ratio of the shares of unlabelled and of positives that score above a threshold, where the bound on its error is least.

Fit on bounded samples: at most POSITIVES and UNLABELLED documents, those with the least hashes of
their id. Scoring covers every document and needs no shuffle. Ids, sources, languages and labels are not
inputs of a score.

Defined results: a null text is an empty text; both get the score of an empty text. Repeated rows get equal
scores. Without any positive to learn from every score is 0.5. Null ids are never held out and never labelled. An empty
table gives no row; extra columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ship

POSITIVES = 8000
UNLABELLED = 16000
BUCKETS = 512
HIDDEN = 24
STEPS = 300
RATE = 0.03
DECAY = 1e-3
SEED = 11
#: Measurements that come before the hashed words.
MEASURES = 14
#: Entries of a worker's word memory; later words are hashed anew each time.
MEMORY = 500_000


def held_out(id_col: Column) -> Column:
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 3 == 1, F.lit(False))


_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123), *range(0xC3, 0xCC)]] = True  # ASCII letters, and first bytes of Latin ones beyond
_BUCKET: dict[str, int] = {}


def bucket(word: str) -> int:
    got = _BUCKET.get(word)
    if got is None:
        got = zlib.crc32(word.encode("utf-8", "surrogatepass")) % BUCKETS
        if len(_BUCKET) < MEMORY:
            _BUCKET[word] = got
    return got


def features(text: str | None) -> np.ndarray:
    """MEASURES measurements of the whole text, then the shares of its words and word pairs by bucket, as roots."""
    out = np.zeros(MEASURES + BUCKETS)
    ws = (text or "").split()
    n = len(ws)
    if not n:
        return out
    raw = np.bincount(np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8), minlength=256)
    at = lambda chars: int(raw[[ord(c) for c in chars]].sum())
    size = np.fromiter(map(len, ws), np.int64, n)
    chars, letters = int(size.sum()), max(1, int(raw[_LETTER].sum()))
    lines = [x for x in text.split("\n") if x and not x.isspace()]
    low = text.lower().split()
    out[:MEASURES] = (
        np.log1p(n), at("#*$%&<>") / n, at("|") / n, at("!") / n, int(raw[65:91].sum()) / letters, chars / n, 1 - len(set(lines)) / len(lines),
        len(set(low)) / len(low), sum(a == b for a, b in zip(ws, ws[1:])) / n, int(raw[48:58].sum()) / chars, at(".,;:?()'\"-") / chars,
        int((size == 1).sum()) / n, int((size > 15).sum()) / n, np.log1p(len(lines)),
    )
    b = np.fromiter(map(bucket, low), np.int64, len(low))
    pairs = (b[:-1] * 31 + b[1:] * 17 + 7) % BUCKETS
    counts = np.bincount(b, minlength=BUCKETS) + np.bincount(pairs, minlength=BUCKETS)
    out[MEASURES:] = np.sqrt(counts / counts.sum())
    return out


class Model:
    """Standardised inputs, one tanh layer, a logistic output."""

    def __init__(self, dims: int, seed: int = SEED):
        g = np.random.default_rng(seed)
        self.mean, self.std = np.zeros(dims), np.ones(dims)
        self.par = [g.normal(0, dims**-0.5, (dims, HIDDEN)), np.zeros(HIDDEN), g.normal(0, HIDDEN**-0.5, HIDDEN), np.zeros(1)]

    def scaled(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.std, -8, 8)

    def margin(self, x: np.ndarray) -> np.ndarray:
        a, b, c, d = self.par
        return np.tanh(self.scaled(x) @ a + b) @ c + d[0]

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(x), -30, 30)))

    def grad(self, z: np.ndarray, h: np.ndarray, dm: np.ndarray) -> list[np.ndarray]:
        """Of sum(dm * margin) by the parameters; z scaled inputs, h hidden values."""
        back = (dm[:, None] * self.par[2]) * (1 - h * h)
        return [z.T @ back, back.sum(0), h.T @ dm, np.array([dm.sum()])]


def fit(pos: np.ndarray, unl: np.ndarray, prior: float, steps: int = STEPS, clip: bool = True) -> Model:
    """Minimise the non-negative risk with the sigmoid loss by Adam over whole samples.

    Without ``clip`` the unlabelled count as negatives: the classifier of positives against unlabelled.
    """
    m = Model(pos.shape[1])
    m.mean, m.std = unl.mean(0), unl.std(0) + 1e-3
    # Hashed words weigh as one measurement together, so that they add to the others and do not drown them.
    m.std[MEASURES:] *= BUCKETS**0.5 / 4
    zp, zu = m.scaled(pos).astype(np.float32), m.scaled(unl).astype(np.float32)
    m.par = [p.astype(np.float32) for p in m.par]
    first, second = [np.zeros_like(p) for p in m.par], [np.zeros_like(p) for p in m.par]
    sig = lambda v: 1 / (1 + np.exp(-np.clip(v, -30, 30)))
    for step in range(1, steps + 1):
        hp, hu = (np.tanh(z @ m.par[0] + m.par[1]) for z in (zp, zu))
        sp, su = sig(hp @ m.par[2] + m.par[3][0]), sig(hu @ m.par[2] + m.par[3][0])
        # Sigmoid loss: a positive costs 1 - s, a negative s; its slope by the margin is -/+ s(1 - s).
        bracket = su.mean() - prior * sp.mean()
        dp, du = sp * (1 - sp) / len(sp), su * (1 - su) / len(su)
        if not clip:
            g = [a + b for a, b in zip(m.grad(zp, hp, -prior * dp), m.grad(zu, hu, (1 - prior) * du))]
        elif bracket >= 0:
            g = [a + b for a, b in zip(m.grad(zp, hp, -2 * prior * dp), m.grad(zu, hu, du))]
        else:
            g = [a + b for a, b in zip(m.grad(zp, hp, prior * dp), m.grad(zu, hu, -du))]
        for k, v in enumerate(g):
            v = v + DECAY * m.par[k]
            first[k] = 0.9 * first[k] + 0.1 * v
            second[k] = 0.999 * second[k] + 0.001 * v * v
            m.par[k] = m.par[k] - RATE * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
    return m


def best_bin(pos: np.ndarray, unl: np.ndarray, delta: float = 0.1, gamma: float = 0.01) -> float:
    """The share of positives among the unlabelled, from the scores of both by a classifier that saw neither."""
    cuts = np.unique(np.concatenate([pos, unl]))
    above = lambda x: 1 - np.searchsorted(np.sort(x), cuts, "left") / len(x)
    qp, qu = above(pos), above(unl)
    ok = qp > 0
    slack = np.sqrt(np.log(4 / delta) / 2) * (len(unl) ** -0.5 + len(pos) ** -0.5)
    bound = (qu[ok] + (1 + gamma) * slack) / qp[ok]
    k = int(bound.argmin())
    return float(np.clip(qu[ok][k] / qp[ok][k], 0.02, 0.98))


def estimated_prior(pos: np.ndarray, unl: np.ndarray) -> float:
    """By halves: a classifier of positives against unlabelled (equal weights) from one, the best bin on the other."""
    if len(pos) < 4 or len(unl) < 4:
        return 0.5
    m = fit(pos[::2], unl[::2], 0.5, clip=False)
    return best_bin(m.margin(pos[1::2]), m.margin(unl[1::2]))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[Model | None, float]:
    """The model and the estimated prior."""
    may = labels.where(F.col(id_col).isNotNull() & ~held_out(F.col(id_col)))
    good = may.groupBy(id_col).agg(F.min("quality").alias("quality")).where("quality = 1")
    good = good.orderBy(F.xxhash64(id_col), id_col).limit(POSITIVES).select(id_col, F.lit(1).alias("part"))
    ids = docs.select(id_col).where(F.col(id_col).isNotNull())
    other = ids.orderBy(F.xxhash64(id_col, F.lit(7)), id_col).limit(UNLABELLED).distinct().select(id_col, F.lit(0).alias("part"))
    # At most POSITIVES + UNLABELLED ids, so the broadcast is bounded; a repeated id yields one row.
    pick = good.union(other).groupBy(id_col).agg(F.max(F.col("part")).alias("p"), F.min("part").alias("u"))
    rows = measured(docs.select(id_col, text_col).join(F.broadcast(pick), id_col), text_col)
    got = rows.groupBy(id_col).agg(F.max("p").alias("p"), F.min("u").alias("u"), F.min("x").alias("x")).orderBy(F.xxhash64(id_col, F.lit(3)), id_col).toPandas()
    x = np.stack([np.frombuffer(v, np.float32) for v in got["x"]]).astype(np.float64) if len(got) else np.empty((0, MEASURES + BUCKETS))
    pos, unl = x[got["p"].to_numpy() == 1], x[got["u"].to_numpy() == 0]
    if not len(pos) or not len(unl):
        return None, 0.5
    prior = estimated_prior(pos, unl)
    return fit(pos, unl, prior), prior


def measured(docs: DataFrame, text_col: str = "text", out: str = "x") -> DataFrame:
    """``docs`` with ``out``, the features as 32-bit floats in bytes; for the bounded samples."""
    ship(docs.sparkSession)

    @F.pandas_udf("binary")
    def f(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: features(t).astype(np.float32).tobytes())

    return docs.withColumn(out, f(F.coalesce(F.col(text_col), F.lit(""))))


def score(docs: DataFrame, model: Model | None, prior: float, text_col: str = "text", out: str = "score") -> DataFrame:
    if model is None:
        return docs.withColumn(out, F.lit(float(prior)))
    ship(docs.sparkSession)

    @F.pandas_udf("double")
    def s(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in parts:
            got = [model.score(np.stack([features(t) for t in texts[k : k + 512]]).astype(np.float32).astype(np.float64)) for k in range(0, len(texts), 512)]
            yield pd.Series(np.concatenate(got) if got else [], dtype="float64")

    return docs.withColumn(out, s(F.coalesce(F.col(text_col), F.lit(""))))


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, held_out, score, predicted per row of ``docs``."""
    model, prior = train(docs, labels, id_col, text_col)
    return score(docs.select(id_col, text_col), model, prior, text_col).select(
        id_col, held_out(F.col(id_col)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )
