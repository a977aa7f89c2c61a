"""Toxicity scores: subword-bag embeddings averaged into a linear softmax."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tastemill.llm.frames import in_share, map_text
from tastemill.llm.ngrams import chunks, join, subwords

#: Labelled rows that the model is fitted on (chosen by a hash of the id); every fifth of them only calibrates.
SAMPLE, CALIBRATE = 12_000, 5
#: Bits of a subword bucket, length of its vector, n-gram lengths, passes and step.
BITS, WIDTH, GRAMS, PASSES, STEP = 17, 8, (3, 4, 5), 5, 1.0
#: Texts of the sample that a subword must occur in: at least this many, or this share of a small sample.
LEAST, LEAST_SHARE = 20, 0.005
#: Deviations by which a subword's count in one class must differ from its share of all texts.
TELLING = 4.0


def bag(text: bytes) -> np.ndarray:
    """The distinct buckets of a whole text's subwords and words."""
    found = np.zeros(1 << BITS, bool)
    for _, parts in chunks([text]):
        data, _ = join(parts)
        for _, buckets in subwords(data, GRAMS, BITS):
            found[buckets] = True
    return np.flatnonzero(found).astype(np.int32)


def _telling(bags: list[np.ndarray], labels: np.ndarray) -> np.ndarray:
    """Buckets that are in enough texts and more or less often in toxic ones than chance has it (else all in enough)."""
    spread = np.bincount(np.concatenate(bags), minlength=1 << BITS)
    toxic = np.bincount(np.concatenate([b for b, y in zip(bags, labels) if y]), minlength=1 << BITS)
    share = labels.mean()
    odd = np.abs(toxic - spread * share) >= TELLING * np.sqrt(spread * share * (1 - share))
    often = spread >= min(LEAST, max(1, LEAST_SHARE * len(bags)))
    return often & odd if (often & odd).any() else often


class Model:
    """Vectors of subword buckets and a two-way softmax over their average, fitted together.

    Only buckets that tell the classes apart have vectors: all others would learn the sample by heart.
    """

    def __init__(self):
        self.scores = np.zeros(1 << BITS)
        self.known = np.zeros(1 << BITS, bool)
        self.bias = 0.0
        self.slope, self.offset = 1.0, 0.0

    def fit(self, bags: list[np.ndarray], labels: np.ndarray, seed: int = 11) -> Model:
        """Steps with per-bucket step sizes, one text at a time; both classes weigh alike."""
        if not len(labels) or labels.min() == labels.max():
            # One class only: its label is the best guess for every text.
            self.bias = float(4 * (2 * labels[0] - 1)) if len(labels) else 0.0
            return self
        rng = np.random.default_rng(seed)
        spare = np.arange(len(bags)) % CALIBRATE == 0
        train = np.flatnonzero(~spare)
        if len(set(labels[train])) < 2 or len(set(labels[spare])) < 2:
            train, spare = np.arange(len(bags)), np.ones(len(bags), bool)
        self.known = _telling([bags[i] for i in train], labels[train])
        bags = [b[self.known[b]] for b in bags]

        vectors = rng.normal(0, 0.1, (1 << BITS, WIDTH))
        softmax, bias = rng.normal(0, 0.5, (WIDTH, 2)), np.zeros(2)
        weight = 0.5 / np.array([np.mean(labels[train] == c) for c in (0, 1)])
        spent, spent_softmax, spent_bias = np.full(1 << BITS, 1e-6), np.full((WIDTH, 2), 1e-2), np.full(2, 1e-2)
        for turn in range(PASSES):
            step = STEP * (1 - turn / PASSES)
            for i in rng.permutation(train):
                at = bags[i]
                if not len(at):
                    continue
                own = vectors[at]
                mean = own.mean(axis=0)
                logits = mean @ softmax + bias
                slope = np.exp(logits - logits.max())
                slope /= slope.sum()
                slope[labels[i]] -= 1
                slope *= weight[labels[i]]
                back = softmax @ slope / len(at)
                spent[at] += back @ back
                vectors[at] = own - step * back / np.sqrt(spent[at])[:, None]
                outer = np.outer(mean, slope)
                spent_softmax += outer**2
                softmax -= 0.2 * step * outer / np.sqrt(spent_softmax)
                spent_bias += slope**2
                bias -= 0.2 * step * slope / np.sqrt(spent_bias)
        # The average is linear, so each bucket's part of the score is one number.
        self.scores = vectors @ (softmax[:, 1] - softmax[:, 0])
        self.bias = float(bias[1] - bias[0])
        self._calibrate(np.array([self._logit(bags[i]) for i in np.flatnonzero(spare)]), labels[spare])
        return self

    def _calibrate(self, logits: np.ndarray, labels: np.ndarray) -> None:
        """A logistic curve over the logits of texts that were not trained on; both classes weigh alike."""
        weight = np.where(labels == 1, 0.5 / labels.mean(), 0.5 / (1 - labels.mean()))
        found = np.array([1.0, 0.0])
        design = np.stack([logits, np.ones(len(logits))], axis=1)
        for _ in range(100):
            chance = 1 / (1 + np.exp(-np.clip(design @ found, -30, 30)))
            pull = design.T @ (weight * (chance - labels)) + 1e-3 * (found - [1.0, 0.0])
            curve = (design * (weight * chance * (1 - chance))[:, None]).T @ design + 1e-3 * np.eye(2)
            found = found - np.clip(np.linalg.solve(curve, pull), -1, 1)
        if found[0] > 0:
            self.slope, self.offset = float(found[0]), float(found[1])

    def _logit(self, at: np.ndarray) -> float:
        return (float(self.scores[at].mean()) if len(at) else 0.0) + self.bias

    def predict(self, texts: list[bytes]) -> np.ndarray:
        found = [bag(t) for t in texts]
        logits = np.array([self._logit(b[self.known[b]]) for b in found])
        return 1 / (1 + np.exp(-np.clip(self.slope * logits + self.offset, -500, 500)))


def fit(labelled: DataFrame, text: str = "text", label: str = "toxic", id: str = "doc_id", sample: int = SAMPLE) -> Model:
    """Fit on about `sample` labelled rows, chosen by a hash of the id (all rows if there are fewer).

    Tasks turn texts into bags of at most 2^BITS buckets; the driver holds the bags of the sample only. Rows with a
    null label, id or text are left out, and so are labels other than 0 and 1.
    """
    known = labelled.filter(F.col(label).isin(0, 1) & F.col(text).isNotNull() & F.col(id).isNotNull())
    n = known.count()
    share = min(1.0, sample / n) if n else 1.0
    chosen = known.filter(in_share(id, F.lit(share)))

    def work(_, raw):
        return {"at": pa.array([bag(t).tobytes() for t in raw], pa.binary())}

    source = chosen.select(
        F.col(id).cast("string").alias("id"), F.col(label).cast("int").alias("label"), F.xxhash64(text).alias("key"),
        F.col(text).alias("text"),
    )
    made = map_text(source, "text", ["id", "label", "key"], "at binary", work)
    rows = made.toArrow().sort_by([("id", "ascending"), ("key", "ascending"), ("label", "ascending")])
    bags = [np.frombuffer(a.as_py(), np.int32) for a in rows["at"]]
    return Model().fit(bags, np.array(rows["label"].to_pylist(), int))


def score(df: DataFrame, model: Model, text: str = "text", keep: list[str] | None = None, at: float = 0.7) -> DataFrame:
    """The columns `keep` (all by default) with score (0 to 1) and predicted (1 if score >= `at`).

    A text without letters, and a null text, scores what the bias says. Without labelled rows every score is 0.5.
    A column of `df` with the name of an output column is replaced.
    """

    def work(_, raw):
        found = model.predict(raw)
        return {"score": pa.array(found, pa.float64()), "predicted": pa.array((found >= at).astype(np.int32))}

    return map_text(df, text, keep or df.columns, "score double, predicted int", work)
