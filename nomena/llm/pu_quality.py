"""Quality classifier from positive and unlabelled texts: non-negative unbiased risk (nnPU), in numpy.

Trusted positives P (label 1) stand against unlabelled texts U, in which a share `prior` is positive. With the logistic loss l
and a score g the risk is prior * E_P[l(g)] + max(0, E_U[l(-g)] - prior * E_P[l(-g)]); when the second part of a mini-batch
turns negative, the step goes the other way, so that the model doesn't learn the positives by heart. The prior comes from the
training labels. Labels 0 are never used as such: their texts are among the unlabelled ones.

Cases: null and empty texts get the score of their (empty) features; rows with several labels count as positive if any is 1; without labels or
texts to learn from every score is 0.5; every document row gives an output row; extra columns are ignored.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WORD, Batches, materialize, table

#: Most rows that training sees of each kind: positives, and unlabelled texts. Chosen by digest of the id.
MOST_ROWS = 6000
HIDDEN, EPOCHS, BATCH, RATE, DECAY = 24, 60, 256, 0.01, 1e-4
LEAST_SCORE = 0.7

_WORD = re.compile(WORD)
_VOWELS = re.compile(r"[aeiouyáéíóúàèùâêîôûäöüAEIOUY]")
_END = re.compile(r"[.!?]")
SHAPES = 19


def features(text: str | None) -> np.ndarray:
    """Shares and logarithms of counts of a whole text, none of which depends on the language's vocabulary."""
    text = text or ""
    words = _WORD.findall(text)
    n, c = len(words), len(text)
    if not n:
        return np.zeros(SHAPES)
    lines = [x for x in text.split("\n") if x.strip()]
    bare = [w.strip(".,;:!?\"'()") for w in words]
    letters = sum(map(str.isalpha, text))
    upper = sum(1 for w in bare if len(w) > 1 and w.isupper())
    alone = sum(1 for w in words if not any(map(str.isalnum, w)))
    same = sum(a == b for a, b in zip(words, words[1:], strict=False))
    kinds = len(set(words))
    threes = n - 2
    return np.array(
        [
            math.log1p(n),
            math.log1p(len(lines)),
            letters / c,
            sum(map(str.isdigit, text)) / c,
            sum(text.count(x) for x in "#*$%&|<>@{}[]\\^~_=+") / c,
            sum(text.count(x) for x in ".,;:'\"-") / c,
            text.count("!") / n,
            len(_END.findall(text)) / n,
            text.count(",") / n,
            upper / n,
            sum(1 for w in bare if w[:1].isupper() and not w.isupper()) / n,
            alone / n,
            same / n,
            kinds / n,
            kinds / math.sqrt(n),
            len(set(zip(words, words[1:], words[2:], strict=False))) / threes if threes > 0 else 1.0,
            sum(map(len, bare)) / n / 10,
            len(_VOWELS.findall(text)) / max(1, letters),
            1 - len(set(lines)) / len(lines),
        ]
    )


@dataclass
class PUModel:
    """A perceptron with one hidden layer over standardised features."""

    mean: np.ndarray
    scale: np.ndarray
    weights: list[np.ndarray]

    def raw(self, x: np.ndarray) -> np.ndarray:
        w1, b1, w2, b2 = self.weights
        return np.tanh(np.clip((x - self.mean) / self.scale, -6, 6) @ w1 + b1) @ w2 + b2

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.raw(x), -30, 30)))


def fit(positive: np.ndarray, unlabelled: np.ndarray, prior: float, seed: int = 7, beta: float = 0.0) -> PUModel:
    """Minimises the non-negative risk by Adam. Same rows, same model."""
    everything = np.vstack([positive, unlabelled])
    mean, scale = everything.mean(0), everything.std(0) + 1e-6
    model = PUModel(mean, scale, [])
    rng = np.random.default_rng(seed)
    d = everything.shape[1]
    model.weights = [rng.normal(0, 1 / math.sqrt(d), (d, HIDDEN)), np.zeros(HIDDEN), rng.normal(0, 1 / math.sqrt(HIDDEN), HIDDEN), np.zeros(1)]
    z = [np.clip((x - mean) / scale, -6, 6) for x in (positive, unlabelled)]
    first, second, step = [np.zeros_like(w) for w in model.weights], [np.zeros_like(w) for w in model.weights], 0
    sigmoid = lambda v: 1 / (1 + np.exp(-np.clip(v, -30, 30)))
    for _ in range(EPOCHS):
        order = [rng.permutation(len(x)) for x in z]
        rounds = max(1, math.ceil(len(z[1]) / BATCH))
        for p, u in zip(np.array_split(order[0], rounds), np.array_split(order[1], rounds), strict=True):
            if not len(p) or not len(u):
                continue
            x = np.vstack([z[0][p], z[1][u]])
            w1, b1, w2, b2 = model.weights
            h = np.tanh(x @ w1 + b1)
            g = h @ w2 + b2
            gp, gu = g[: len(p)], g[len(p) :]
            negative = np.logaddexp(0, gu).mean() - prior * np.logaddexp(0, gp).mean()
            # derivatives of l(g) = log(1 + exp(-g)) and l(-g) = log(1 + exp(g))
            if negative >= -beta:
                dp = prior * ((sigmoid(gp) - 1) - sigmoid(gp)) / len(p)
                du = sigmoid(gu) / len(u)
            else:
                dp, du = prior * sigmoid(gp) / len(p), -sigmoid(gu) / len(u)
            dg = np.r_[dp, du]
            dh = np.outer(dg, w2) * (1 - h * h)
            grads = [x.T @ dh + DECAY * w1, dh.sum(0), h.T @ dg + DECAY * w2, np.array([dg.sum()])]
            step += 1
            for i, d_ in enumerate(grads):
                first[i] = 0.9 * first[i] + 0.1 * d_
                second[i] = 0.999 * second[i] + 0.001 * d_ * d_
                model.weights[i] = model.weights[i] - RATE * (first[i] / (1 - 0.9**step)) / (np.sqrt(second[i] / (1 - 0.999**step)) + 1e-8)
    return model


def held_out(doc_id) -> F.Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, text: str = "text", most: int = MOST_ROWS) -> tuple[PUModel | None, float]:
    """The model and the prior, from labels of rows that are not held out.

    Positives: labelled 1. Unlabelled: any documents not held out, whatever their label. Of each kind at most `most` rows, those
    with the smallest digests, go to the driver (their features only).
    """
    known = labels.filter(~held_out(F.col("doc_id")) & F.col("quality").isNotNull()).groupBy("doc_id").agg(F.max("quality").alias("quality"))
    prior = known.agg(F.avg(F.col("quality").cast("double"))).first()[0]
    if prior is None:
        return None, 0.5
    digest = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    rows = docs.filter(~held_out(F.col("doc_id"))).select("doc_id", digest.alias("digest"))
    sample = rows.select("doc_id", "digest", F.lit(0).alias("p")).orderBy("digest").limit(most)
    good = rows.join(known.filter("quality = 1"), "doc_id")
    sample = sample.unionByName(good.select("doc_id", "digest", F.lit(1).alias("p")).orderBy("digest").limit(most))
    wanted = materialize(sample.groupBy("doc_id").agg(F.max("p").alias("p"), F.min("p").alias("u")))  # 2 * most rows
    picked = docs.select("doc_id", text).join(F.broadcast(wanted), "doc_id")
    shape = F.pandas_udf(lambda t: pd.Series([features(x).tolist() for x in t]), "array<double>")
    got = picked.select("p", "u", "doc_id", shape(F.col(text)).alias("x")).dropDuplicates(["doc_id"]).orderBy("doc_id").toPandas()  # 2 * most rows of numbers
    p, u = got[got["p"] == 1], got[got["u"] == 0]
    if not len(p) or not len(u):
        return None, prior
    return fit(np.vstack(p["x"].to_list()), np.vstack(u["x"].to_list()), float(prior)), float(prior)


def score_docs(docs: DataFrame, model: PUModel | None, text: str = "text", out: str = "score") -> DataFrame:
    """docs with a score in 0 to 1; whole texts, map side only."""
    Batches.small(docs.sparkSession)

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        if model is None or not len(texts):
            return pd.Series(np.full(len(texts), 0.5))
        return pd.Series(model.score(np.vstack([features(t) for t in texts])))

    return docs.withColumn(out, score(F.col(text)))


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels").select("doc_id", "quality")
    model, _ = train(docs, labels)
    d = score_docs(docs, model)
    return d.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= LEAST_SCORE).cast("int").alias("predicted"))
