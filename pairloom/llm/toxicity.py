"""Toxicity of lyrics by weak supervision: voters, a generative label model, a linear classifier."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairloom.llm.storage import bounded_batches, stored

#: labelled tracks used at most, chosen by hash; terms of all lexicons, tiers per kind of term, terms of the first
MAX_LABELLED, MAX_TERMS, LEXICONS, FIRST_TIER = 20_000, 2048, 6, 16
#: occurrences and signal a term needs, a term's smallest log ratio, score from which a text is toxic
MIN_TOXIC, MIN_Z, MIN_RATIO, THRESHOLD = 3, 2.3, 1.5, 0.3
#: lengths in bytes of the word beginnings that serve as terms next to whole words
BEGINNINGS = (5, 6, 7, 8)
PATTERNS = ("shouting", "insistent", "repetitive", "brief", "numeric")
_WORDS = bytes(c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))


def _words(text: bytes | None) -> list[bytes]:
    return (text or b"").lower().translate(_WORDS).split()


def _terms(words: set[bytes]) -> set[tuple[int, bytes]]:
    """Kind 0: the word; kind n: its first n bytes, if it is longer."""
    return {(0, w) for w in words} | {(n, w[:n]) for n in BEGINNINGS for w in words if len(w) > n}


def _term_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    toxic, clean = Counter(), Counter()

    def taken() -> pa.RecordBatch:
        keys = list(toxic.keys() | clean.keys())
        columns = [[k for k, _ in keys], [t for _, t in keys], [toxic[k] for k in keys], [clean[k] for k in keys]]
        toxic.clear(), clean.clear()
        kinds = (pa.int32(), pa.binary(), pa.int64(), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["kind", "term", "toxic", "clean"])

    for batch in batches:
        for text, label in zip(batch.column(0), batch.column(1)):
            (toxic if label.as_py() else clean).update(_terms(set(_words(text.as_py()))))
            if len(toxic) + len(clean) > 400_000:
                yield taken()
    yield taken()


def mined_lexicons(sample: DataFrame, n_toxic: int, n_clean: int) -> list[dict[bytes, tuple[int, int]]]:
    """Per kind of term a map from the terms that mark toxic texts to their lexicon.

    Terms are ranked by the z-value of their log ratio of shares. Half of the lexicons of a kind are tiers of
    doubling size, so that the few terms that hardly ever mark a clean text vote by themselves; the other half are
    dealt in turn, so that a text with many terms is found by several of them.
    """
    counts = sample.select("text", "toxic").mapInArrow(_term_counts, "kind int, term binary, toxic long, clean long")
    counts = counts.groupBy("kind", "term").agg(F.sum("toxic").alias("t"), F.sum("clean").alias("c"))
    ratio = F.log(((F.col("t") + 0.5) / (n_toxic + 1)) / ((F.col("c") + 0.5) / (n_clean + 1)))
    z = ratio / F.sqrt(1 / (F.col("t") + 0.5) + 1 / (F.col("c") + 0.5))
    ranked = counts.where(F.col("t") >= MIN_TOXIC).withColumns({"ratio": ratio, "z": z})
    ranked = ranked.where((F.col("z") >= MIN_Z) & (F.col("ratio") >= MIN_RATIO)).orderBy(F.desc("z"), "kind", "term").limit(MAX_TERMS)
    lexicons: dict[int, dict[bytes, tuple[int, int]]] = {k: {} for k in (0, *BEGINNINGS)}
    for row in ranked.collect():
        of_kind = lexicons[row["kind"]]
        rank = len(of_kind)
        tier = min(LEXICONS - 1, (rank // FIRST_TIER + 1).bit_length() - 1)
        of_kind[bytes(row["term"])] = (tier, LEXICONS + rank % LEXICONS)
    return list(lexicons.values())


def votes(text: bytes | None, lexicons: list[dict[bytes, tuple[int, int]]], gate: set[bytes]) -> np.ndarray:
    """Hits of every lexicon, different words that hit per kind, the pattern voters (0/1), log of the word count."""
    words = _words(text)
    tail = len(lexicons) * 2 * LEXICONS
    hits = np.zeros(tail + len(lexicons) + len(PATTERNS) + 1)
    counted, whole = Counter(words), lexicons[0]
    for word, n in counted.items():
        for at in whole.get(word, ()):
            hits[at] += n
        if word in whole:
            hits[tail] += 1
        if word[: BEGINNINGS[0]] in gate:
            for k, (size, of_kind) in enumerate(zip(BEGINNINGS, lexicons[1:]), 1):
                if len(word) > size and (both := of_kind.get(word[:size])):
                    for at in both:
                        hits[k * 2 * LEXICONS + at] += n
                    hits[tail + k] += 1
    raw, n = text or b"", len(words)
    upper = len(raw) - len(raw.translate(None, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"))
    digits = len(raw) - len(raw.translate(None, b"0123456789"))
    hits[-len(PATTERNS) - 1 : -1] = (
        upper > 0.3 * len(raw), raw.count(b"!") > 0.05 * n + 2, len(counted) < 0.3 * n, n < 20, digits > 0.05 * len(raw) + 4,
    )
    hits[-1] = np.log1p(n)
    return hits


def _gate(lexicons: list[dict[bytes, tuple[int, int]]]) -> set[bytes]:
    return {term[: BEGINNINGS[0]] for of_kind in lexicons[1:] for term in of_kind}


@dataclass
class LabelModel:
    """Voters that fire with a rate of their own in either class, discounted where they repeat each other."""

    log_prior: float
    fires: np.ndarray  # class x voter
    weights: np.ndarray
    missed: float  # share of given labels that are wrong

    @classmethod
    def fit(cls, fired: np.ndarray, gold: np.ndarray, counts: np.ndarray, rounds: int = 25) -> LabelModel:
        """Expectation maximisation from the given labels, which stay one voter with an error rate.

        Correlations are those of the votes' residuals within the classes; a voter's weight is one over
        one plus its positive correlations with all others.
        """
        post = np.where(gold > 0, 0.95, 0.05)
        weights, missed = np.ones(fired.shape[1]), 0.05
        for _ in range(rounds):
            mass = np.stack([(1 - post) * counts, post * counts])
            fires = (mass @ fired + 0.5 * fired.mean(0) + 1e-3) / (mass.sum(1, keepdims=True) + 1.0)
            fires = fires.clip(1e-4, 1 - 1e-4)
            residual = fired - (post[:, None] * fires[1] + (1 - post)[:, None] * fires[0])
            spread = (residual * counts[:, None]).T @ residual
            scale = np.sqrt(np.diag(spread)).clip(1e-9)
            weights = 1 / np.maximum(1, (spread / scale / scale[:, None]).clip(0, 1).sum(0))
            model = cls(float(np.log(mass[1].sum() / mass[0].sum())), fires, weights, missed)
            post = model.posterior(fired, gold)
            wrong = (np.where(gold > 0, 1 - post, post) * counts).sum() / counts.sum()
            missed = float(np.clip(wrong, 0.005, 0.1))
        return model

    def posterior(self, fired: np.ndarray, gold: np.ndarray) -> np.ndarray:
        """P(toxic) of texts by their votes and their given labels."""
        odds = self.log_odds(fired) + np.where(gold > 0, 1, -1) * np.log((1 - self.missed) / self.missed)
        return 1 / (1 + np.exp(-odds.clip(-30, 30)))

    def log_odds(self, fired: np.ndarray) -> np.ndarray:
        on = np.log(self.fires[1] / self.fires[0])
        off = np.log((1 - self.fires[1]) / (1 - self.fires[0]))
        return self.log_prior + (fired * on + (1 - fired) * off) @ self.weights


def _inputs(hits: np.ndarray) -> np.ndarray:
    """Inputs of the linear classifier: logged hits, shares of hits among the words, patterns, word count."""
    n, n_kinds = len(PATTERNS) + 1, len(BEGINNINGS) + 1
    counts, different, rest = hits[..., : -n - n_kinds], hits[..., -n - n_kinds : -n], hits[..., -n:]
    kinds = counts.reshape(*counts.shape[:-1], n_kinds, 2 * LEXICONS)
    found = np.concatenate([kinds[..., :LEXICONS].sum(-1), (kinds[..., LEXICONS:] > 0).sum(-1), different], -1)
    share = found / np.exp(rest[..., -1:]).clip(1) * 50
    return np.concatenate([np.log1p(counts), np.log1p(found), np.log1p(share), rest], -1)


def toxicity_scorer(
    tracks: DataFrame, labels: DataFrame, text: str = "lyrics", max_labelled: int = MAX_LABELLED
) -> Callable[[Column], Column]:
    """Learns from the labelled ``tracks``; gives a function from a text column to its score in 0..1.

    ``labels`` (track_id, toxic 0/1) is sampled by hash to about ``max_labelled`` tracks, equal texts
    count once. From the sample come the lexicons, whose voters and the pattern voters a generative model weighs;
    its posterior labels train a logistic regression. Labels of one kind only give that kind's score
    (0 or 1) to all, no labels give 0. Null labels are left out.
    """
    rows = tracks.select(F.col("track_id").cast("long"), F.col(text).cast("binary").alias("text"))
    bounded_batches(tracks.sparkSession)
    known = labels.where(F.col("track_id").isNotNull() & F.col("toxic").isNotNull()).groupBy("track_id").agg(F.max("toxic").cast("int").alias("toxic"))
    share = F.lit((1 << 30) * max_labelled // max(known.count(), 1))
    chosen = known.where(F.pmod(F.xxhash64("track_id"), F.lit(1 << 30)) < share)
    # about max_labelled rows of 12 bytes: small enough to send to every task
    sample = rows.join(F.broadcast(chosen), "track_id").groupBy(F.xxhash64("text").alias("h")).agg(F.first("text").alias("text"), F.max("toxic").alias("toxic"))
    sample = stored(sample)
    sizes = {r["toxic"]: r["n"] for r in sample.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    n_toxic, n_clean = sizes.get(1, 0), sizes.get(0, 0)
    if not n_toxic or not n_clean:
        return lambda column: F.lit(1.0 if n_toxic else 0.0)
    lexicons = mined_lexicons(sample, n_toxic, n_clean)
    gate = _gate(lexicons)

    def cast_votes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hits = [votes(t.as_py(), lexicons, gate) for t in batch.column(0)]
            fired = pa.array([(h[:-1] > 0).tobytes() for h in hits], pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array([h.tolist() for h in hits], pa.list_(pa.float64())), fired, batch.column(1)], ["hits", "fired", "toxic"])

    voted = stored(sample.select("text", "toxic").mapInArrow(cast_votes, "hits array<double>, fired binary, toxic int"))
    patterns = voted.groupBy("fired", "toxic").agg(F.count(F.lit(1)).alias("n")).collect()  # no more than max_labelled
    fired = np.array([np.frombuffer(r["fired"], bool) for r in patterns], float)
    model = LabelModel.fit(fired, np.array([r["toxic"] for r in patterns]), np.array([r["n"] for r in patterns], float))

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Every text twice, as toxic and as clean, weighted by its posterior label."""
        for batch in batches:
            if not batch.num_rows:
                continue
            hits = np.array(batch.column(0).to_pylist())
            toxic = model.posterior((hits[:, :-1] > 0).astype(float), batch.column(2).to_numpy())
            inputs = pa.array(_inputs(hits).tolist(), pa.list_(pa.float64()))
            for y, w in ((1.0, toxic), (0.0, 1 - toxic)):
                yield pa.RecordBatch.from_arrays([inputs, pa.array([y] * len(w)), pa.array(w)], ["x", "y", "w"])

    training = stored(voted.mapInArrow(weigh, "x array<double>, y double, w double"))
    linear = LogisticRegression(labelCol="y", weightCol="w", regParam=0.001 + 2.0 / (n_toxic + n_clean), maxIter=60)
    fitted = linear.fit(training.select(array_to_vector("x").alias("features"), "y", "w"))
    weights, base = fitted.coefficients.toArray(), float(fitted.intercept)

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        found = np.array([votes(t, lexicons, gate) for t in texts]).reshape(len(texts), -1)
        odds = _inputs(found) @ weights + base if len(texts) else np.empty(0)
        return pd.Series(1 / (1 + np.exp(-odds.clip(-30, 30))))

    return lambda column: score(column.cast("binary"))


def toxicity_scores(
    tracks: DataFrame, labels: DataFrame, text: str = "lyrics", max_labelled: int = MAX_LABELLED, threshold: float = THRESHOLD,
) -> DataFrame:
    """(track_id, score, predicted) of every whole text; predicted is 1 from ``threshold`` on.

    All tracks are scored in one pass without a shuffle by ``toxicity_scorer``. Null texts are empty and
    are scored; rows without track_id and repeated rows are kept. Extra columns are ignored.
    """
    scorer = toxicity_scorer(tracks, labels, text, max_labelled)
    scored = tracks.select(F.col("track_id").cast("long"), scorer(F.col(text)).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
