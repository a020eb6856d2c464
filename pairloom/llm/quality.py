"""Quality of lyrics by multiple-instance learning: passages, gated attention, one score for the whole text."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairloom.llm.storage import bounded_batches, stored

#: labelled tracks used at most, chosen by hash, and passages of each in training, spread over the text
MAX_LABELLED, MAX_PASSAGES = 8000, 128
#: words of a passage, units of the encoder and of the attention, training rounds, step, weight decay, threshold
PASSAGE, UNITS, GATES, ROUNDS, STEP, DECAY, THRESHOLD = 64, 16, 8, 400, 0.02, 1e-4, 0.3
SIGNS = (b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b".,;:", b"!?", b"#$%&*@^~+=", b"|<>{}[]\\/_", b"\"'()-", b"\n")
N_FEATURES = len(SIGNS) + 11
_NOT_ASCII = bytes(range(128, 256))


def passage_features(text: bytes | None) -> np.ndarray:
    """(passages x features) of a text in passages of ``PASSAGE`` words; a text without words is one passage of zeros.

    Shares of kinds of characters, lengths, variety and repetition within the passage and against the passages before.
    """
    text = text or b""
    words = text.split()
    if not words:
        return np.zeros((1, N_FEATURES), np.float32)
    out, seen, at = [], set(), 0
    for k in range(0, len(words), PASSAGE):
        part = words[k : k + PASSAGE]
        n = len(part)
        end = at
        for word in part:  # the passage with its own white space
            end = text.index(word, end) + len(word)
        raw, at = text[at:end], end
        size = len(raw)
        shares = [(size - len(raw.translate(None, signs))) / size for signs in SIGNS]
        lowered = [w.lower() for w in part]
        counted = Counter(lowered)
        tails = Counter(w[-2:] for w in part if not w[-1:].isalnum() and w[-1] < 128)
        seen_before = sum(w in seen for w in lowered) / n
        seen.update(counted)
        out.append((
            *shares, (size - len(raw.translate(None, _NOT_ASCII))) / size, np.log1p(n), size / n / 8, len(counted) / n,
            max(counted.values()) / n, len(set(zip(lowered, lowered[1:]))) / max(1, n - 1), sum(tails.values()) / n,
            sum(w.isalpha() or w[-1] > 127 for w in part) / n, sum(len(w) == 1 for w in part) / n, seen_before, float(k > 0),
        ))
    return np.array(out, np.float32)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


@dataclass
class AttentionModel:
    """h = tanh(x E + e); a = softmax over a text's passages of (tanh(h V) * sigmoid(h U)) w; score = sigmoid(sum a h . c + b)."""

    mean: np.ndarray
    scale: np.ndarray
    weights: list[np.ndarray]  # E, e, V, U, w, c, b

    def forward(self, x: np.ndarray, starts: np.ndarray) -> dict[str, np.ndarray]:
        """``starts``: the first row of every text; every text has a row."""
        E, e, V, U, w, c, b = self.weights
        x = (x - self.mean) / self.scale
        h = np.tanh(x @ E + e)
        t, s = np.tanh(h @ V), _sigmoid(h @ U)
        logit = (t * s) @ w
        of = np.repeat(np.arange(len(starts)), np.diff(np.r_[starts, len(x)]))
        a = np.exp(logit - np.maximum.reduceat(logit, starts)[of])
        a /= np.add.reduceat(a, starts)[of]
        z = np.add.reduceat(a[:, None] * h, starts, axis=0)
        return {"x": x, "h": h, "t": t, "s": s, "a": a, "of": of, "z": z, "p": _sigmoid(z @ c + b[0])}

    def gradients(self, x: np.ndarray, starts: np.ndarray, y: np.ndarray) -> list[np.ndarray]:
        """Of the mean log loss and the weight decay."""
        E, e, V, U, w, c, b = self.weights
        f = self.forward(x, starts)
        g = (f["p"] - y) / len(y)
        gz = g[:, None] * c
        ga = (gz[f["of"]] * f["h"]).sum(1)
        gl = f["a"] * (ga - np.add.reduceat(f["a"] * ga, starts)[f["of"]])
        gt, gs = gl[:, None] * w * f["s"] * (1 - f["t"] ** 2), gl[:, None] * w * f["t"] * f["s"] * (1 - f["s"])
        gh = f["a"][:, None] * gz[f["of"]] + gt @ V.T + gs @ U.T
        gu = gh * (1 - f["h"] ** 2)
        raw = [f["x"].T @ gu, gu.sum(0), f["h"].T @ gt, f["h"].T @ gs, (f["t"] * f["s"]).T @ gl, f["z"].T @ g, g.sum(keepdims=True)]
        return [r + DECAY * v for r, v in zip(raw, self.weights)]

    @classmethod
    def fit(cls, x: np.ndarray, starts: np.ndarray, y: np.ndarray, rounds: int = ROUNDS) -> AttentionModel:
        """Full-batch descent with running moments (Adam) from fixed random weights."""
        rnd = np.random.default_rng(12)
        x = x.astype(np.float64)
        shapes = ((x.shape[1], UNITS), (UNITS,), (UNITS, GATES), (UNITS, GATES), (GATES,), (UNITS,), (1,))
        weights = [rnd.normal(0, 1 / np.sqrt(s[0]), s) if len(s) > 1 or k in (4, 5) else np.zeros(s) for k, s in enumerate(shapes)]
        weights[6][:] = np.log(y.mean() / (1 - y.mean()))
        model = cls(x.mean(0), x.std(0) + 1e-3, weights)
        first, second = ([np.zeros_like(v) for v in weights] for _ in "12")
        for k in range(1, rounds + 1):
            for v, g, m, s in zip(weights, model.gradients(x, starts, y), first, second):
                m += 0.1 * (g - m)
                s += 0.001 * (g * g - s)
                v -= STEP * (m / (1 - 0.9**k)) / (np.sqrt(s / (1 - 0.999**k)) + 1e-8)
        return model

    def scores(self, texts: list[np.ndarray]) -> np.ndarray:
        if not texts:
            return np.empty(0)
        starts = np.cumsum([0, *(len(t) for t in texts[:-1])])
        return self.forward(np.concatenate(texts).astype(np.float64), starts)["p"]


def _encoded(most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for text in batch.column(0):
                x = passage_features(text.as_py())
                found.append(x[np.linspace(0, len(x) - 1, min(most, len(x))).astype(int)].tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(found, pa.binary())], ["quality", "x"])

    return run


def fitted_model(
    tracks: DataFrame, labels: DataFrame, text: str = "lyrics", max_labelled: int = MAX_LABELLED, max_passages: int = MAX_PASSAGES,
) -> AttentionModel | float:
    """The model of the labelled ``tracks``, or the score of all texts if the labels are of one kind or none.

    ``labels`` (track_id, quality 0/1) are sampled by hash to about ``max_labelled`` tracks, equal texts count once,
    and of each at most ``max_passages`` passages teach, spread evenly: the driver gets no more than these features.
    """
    rows = tracks.select(F.col("track_id").cast("long"), F.col(text).cast("binary").alias("text"))
    bounded_batches(tracks.sparkSession)
    known = labels.where(F.col("track_id").isNotNull() & F.col("quality").isNotNull()).groupBy(F.col("track_id").cast("long").alias("track_id")).agg(F.max("quality").cast("int").alias("quality"))
    share = F.lit((1 << 30) * max_labelled // max(known.count(), 1))
    chosen = known.where(F.pmod(F.xxhash64("track_id"), F.lit(1 << 30)) < share)
    # about max_labelled rows of 12 bytes: small enough to send to every task
    sample = rows.join(F.broadcast(chosen), "track_id").groupBy(F.xxhash64("text").alias("h")).agg(F.first("text").alias("text"), F.max("quality").alias("quality"))
    encoded = stored(sample.select("h", "text", "quality")).orderBy("h").select("text", "quality").mapInArrow(_encoded(max_passages), "quality int, x binary")
    table = encoded.toArrow()
    y = table.column("quality").to_numpy().astype(float)
    if not 0 < y.sum() < len(y):
        return float(len(y) > 0 and y[0] > 0)
    texts = [np.frombuffer(x.as_py(), np.float32).reshape(-1, N_FEATURES) for x in table.column("x")]
    return AttentionModel.fit(np.concatenate(texts), np.cumsum([0, *(len(t) for t in texts[:-1])]), y)


def quality_scorer(tracks: DataFrame, labels: DataFrame, text: str = "lyrics", **bounds: int) -> Callable[[Column], Column]:
    """A function from a text column to its score in 0..1, learned by ``fitted_model``."""
    model = fitted_model(tracks, labels, text, **bounds)
    if isinstance(model, float):
        return lambda column: F.lit(model)

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        return pd.Series(model.scores([passage_features(t) for t in texts]))

    return lambda column: score(column.cast("binary"))


def quality_scores(
    tracks: DataFrame, labels: DataFrame, text: str = "lyrics", threshold: float = THRESHOLD, **bounds: int,
) -> DataFrame:
    """(track_id, score, predicted) of every whole text; predicted is 1 from ``threshold`` on.

    A text is a bag of passages of which only the whole has a label. Every passage is encoded, a gated attention
    weighs the passages of a text, and the weighted sum of their codes is scored. All tracks are scored in one pass without a shuffle.
    Null texts are empty and are scored as one blank passage; rows without track_id and repeated rows are kept; labels
    of tracks that are not there, and null ones, teach nothing; labels of one kind give that kind's score (0 or 1), no labels give 0.
    Extra columns are ignored.
    """
    scorer = quality_scorer(tracks, labels, text, **bounds)
    scored = tracks.select(F.col("track_id").cast("long"), scorer(F.col(text)).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
