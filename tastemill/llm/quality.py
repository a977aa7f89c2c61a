"""Quality scores: a regularised quadratic discriminant over statistics of whole documents."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import product
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tastemill.llm.frames import map_text
from tastemill.session import stored

#: One in so many labelled rows (by a hash of the id) is left out of the covariances: shrinkage and slope are chosen on them.
SPARE = 5
#: Choices of how far a class covariance moves to the common one, and that to a multiple of the identity.
TO_COMMON, TO_ROUND = (0.0, 0.1, 0.3, 0.6, 0.9), (0.001, 0.01, 0.1)
#: Bins of a density difference, after asinh, on each side of zero.
BINS, REACH = 2048, 16.0
#: Weight of the start in the fit of the slope.
HOLD = 0.01
#: Bytes read at once, and the words of a window in which repeats are looked for.
PIECE, WINDOW = 1 << 20, 512

#: Kinds of bytes. Stops are the marks of plain prose.
STOPS = b".,;:?!'\"-"
KINDS = ("capital", "small", "digit", "stop", "cry", "sign", "blank", "line", "high")
_KIND = np.array(
    [
        KINDS.index(
            "high" if c > 127 else "capital" if 65 <= c <= 90 else "small" if 97 <= c <= 122 else "digit" if 48 <= c <= 57
            else "cry" if c == 33 else "stop" if c in STOPS else "line" if c == 10 else "blank" if c <= 32 else "sign"
        )
        for c in range(256)
    ]
)

NAMES = (
    "words", "word_size", "word_spread", "line_words", "capitals", "digits", "stops", "cries", "signs", "blanks",
    "high", "short", "again", "distinct", "same_lines", "tails",
)


# -- statistics of a document -------------------------------------------------------------------------------------


def pieces(text: bytes) -> Iterator[bytes]:
    """A long text in pieces that end at white space, if there is any."""
    start = 0
    while len(text) - start > PIECE:
        at = max(text.rfind(b" ", start + 1, start + PIECE), text.rfind(b"\n", start + 1, start + PIECE))
        end = at if at > start else start + PIECE
        yield text[start:end]
        start = end
    yield text[start:]


def statistics(text: bytes) -> np.ndarray:
    """The transformed statistics NAMES of a whole text: logarithms of sizes, arcsine roots of shares.

    Repeats are counted in windows of WINDOW words, so a statistic means the same for short and long texts. A share
    of nothing is 0.
    """
    kinds = np.zeros(256, np.int64)
    words = letters = squares = short = again = distinct = windows = lines = same = tails = 0
    for piece in pieces(text):
        kinds += np.bincount(np.frombuffer(piece, np.uint8), minlength=256)
        found = piece.split()
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        words += len(found)
        letters += int(sizes.sum())
        squares += int((sizes * sizes).sum())
        short += int((sizes == 1).sum())
        again += sum(map(eq, found, found[1:]))
        for at in range(0, len(found), WINDOW):
            window = found[at : at + WINDOW]
            distinct += len(set(window))
            tails += len({w[-3:] for w in window})
            windows += len(window)
        rows = [r for r in piece.split(b"\n") if r]
        lines += len(rows)
        same += len(rows) - len(set(rows))
    n = dict(zip(KINDS, np.bincount(_KIND, kinds, len(KINDS)).tolist()))
    size = sum(n.values())
    mean = letters / words if words else 0.0
    spread = max(squares / words - mean * mean, 0.0) if words else 0.0

    def share(part, whole):
        return np.arcsin(np.sqrt(min(part / whole, 1.0))) if whole else 0.0

    return np.array([
        np.log1p(words), np.log1p(mean), np.log1p(np.sqrt(spread)), np.log1p(words / max(lines, 1)),
        share(n["capital"], n["capital"] + n["small"] + n["high"]), share(n["digit"], size), share(n["stop"], size),
        share(n["cry"], size), share(n["sign"], size), share(n["blank"] + n["line"], size), share(n["high"], size),
        share(short, words), share(again, words), share(distinct, windows), share(same, lines), share(tails, windows),
    ])


def describe(df: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The columns `keep` (all by default) and `stats`, the statistics of each text (null: empty); stored.

    The one pass over the texts: fitting and scoring read the statistics. A column of `df` named stats is replaced.
    """
    empty = statistics(b"")

    def work(_, raw):
        flat = np.concatenate([statistics(t) if t else empty for t in raw])
        at = pa.array(np.arange(len(raw) + 1, dtype=np.int32) * len(NAMES))
        return {"stats": pa.ListArray.from_arrays(at, pa.array(flat))}

    return stored(map_text(df, text, keep or df.columns, "stats array<double>", work))


# -- the model ----------------------------------------------------------------------------------------------------


class Gaussian:
    """A class: its mean and the Cholesky factor of its covariance, worked out once."""

    def __init__(self, mean: np.ndarray, covariance: np.ndarray):
        self.mean = mean
        self.factor = np.linalg.inv(np.linalg.cholesky(covariance))
        self.log_size = -2.0 * np.log(np.diag(self.factor)).sum()

    def log_density(self, rows: np.ndarray) -> np.ndarray:
        """Up to a constant: minus half of the squared Mahalanobis distance and of the log determinant."""
        apart = (rows - self.mean) @ self.factor.T
        return -0.5 * (np.einsum("ij,ij->i", apart, apart) + self.log_size)


class Moments:
    """Number, sum and sum of products of a class's rows."""

    def __init__(self, width: int):
        self.n, self.sum, self.products = 0.0, np.zeros(width), np.zeros((width, width))

    @property
    def mean(self) -> np.ndarray:
        return self.sum / self.n

    @property
    def scatter(self) -> np.ndarray:
        return self.products - self.n * np.outer(self.mean, self.mean)


class Model:
    """Two Gaussian classes over scaled statistics; the score is a logistic curve over their density difference."""

    def __init__(self, share: float = 0.5):
        self.classes: list[Gaussian] | None = None
        self.center, self.scale = np.zeros(len(NAMES)), np.ones(len(NAMES))
        self.slope, self.offset = 0.0, float(np.log(share / (1 - share)))

    @classmethod
    def of(cls, moments: list[Moments], to_common: float, to_round: float) -> Model:
        """Covariances shrunk to the common one and to a multiple of the identity. `moments` are of classes 0 and 1."""
        model = cls()
        common = sum(m.scatter for m in moments) / sum(m.n for m in moments)
        model.center = sum(m.sum for m in moments) / sum(m.n for m in moments)
        model.scale = np.sqrt(np.maximum(np.diag(common), 1e-8))
        model.classes = []
        for m in moments:
            mixed = (1 - to_common) * m.scatter / m.n + to_common * common
            mixed = mixed / np.outer(model.scale, model.scale)
            level = np.trace(mixed) / len(mixed)
            mixed = (1 - to_round) * mixed + to_round * max(level, 1e-6) * np.eye(len(mixed))
            model.classes.append(Gaussian((m.mean - model.center) / model.scale, mixed))
        return model

    def difference(self, rows: np.ndarray) -> np.ndarray:
        """Log density of class 1 less that of class 0, drawn in by asinh: far from both classes it grows with the square."""
        if self.classes is None:
            return np.zeros(len(rows))
        rows = (rows - self.center) / self.scale
        return np.arcsinh(self.classes[1].log_density(rows) - self.classes[0].log_density(rows))

    def predict(self, rows: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * self.difference(rows) + self.offset, -500, 500)))


def logistic(at: np.ndarray, counts: np.ndarray) -> tuple[float, float, float]:
    """(slope, offset, mean loss) of the logistic curve over values `at` that class 0 and 1 have counts[0] and counts[1] times."""
    design = np.stack([at, np.ones(len(at))], axis=1)
    both, start = counts.sum(axis=0), np.array([0.5, 0.0])

    def loss(known):
        logits = design @ known
        return (counts[0] * np.logaddexp(0, logits) + counts[1] * np.logaddexp(0, -logits)).sum()

    def total(known):
        # A slope without bound would fit classes that do not overlap.
        return loss(known) + 0.5 * HOLD * ((known - start) ** 2).sum()

    known = start
    for _ in range(100):
        chance = 1 / (1 + np.exp(-np.clip(design @ known, -500, 500)))
        pull = design.T @ (both * chance - counts[1]) + HOLD * (known - start)
        curve = (design * (both * chance * (1 - chance))[:, None]).T @ design + HOLD * np.eye(2)
        step, now = np.linalg.solve(curve, pull), total(known)
        while total(known - step) > now and np.abs(step).max() > 1e-12:
            step = step / 2
        known = known - step
        if np.abs(step).max() < 1e-9:
            break
    return float(known[0]), float(known[1]), float(loss(known) / both.sum())


# -- Spark jobs ---------------------------------------------------------------------------------------------------


def _rows(batch: pa.RecordBatch) -> np.ndarray:
    stats = batch.column("stats")
    return stats.flatten().to_numpy(zero_copy_only=False).reshape(len(stats), -1)


def class_moments(stats: DataFrame) -> list[Moments]:
    """Moments of both classes over all rows (label, stats): each task sends one row a class."""
    width = len(NAMES)

    def add(batches):
        held = np.zeros((2, 1 + width + width * width))
        for batch in batches:
            labels, rows = batch.column("label").to_numpy(zero_copy_only=False), _rows(batch)
            for c in (0, 1):
                own = rows[labels == c]
                held[c] += np.concatenate([[len(own)], own.sum(axis=0), (own.T @ own).ravel()])
        places = np.tile(np.arange(held.shape[1]), 2)
        made = [pa.array(np.repeat([0, 1], held.shape[1])), pa.array(places), pa.array(held.ravel())]
        yield pa.RecordBatch.from_arrays(made, names=["label", "place", "value"])

    sums = stats.select("label", "stats").mapInArrow(add, "label bigint, place bigint, value double")
    out = [Moments(width), Moments(width)]
    flat = np.zeros((2, 1 + width + width * width))
    for r in sums.groupBy("label", "place").agg(F.sum("value").alias("value")).collect():
        flat[r.label, r.place] = r.value
    for m, row in zip(out, flat):
        m.n, m.sum, m.products = row[0], row[1 : 1 + width], row[1 + width :].reshape(width, width)
    return out


def histograms(stats: DataFrame, models: list[Model]) -> np.ndarray:
    """How often a class has a density difference, by model, class and bin, over all rows (label, stats)."""
    shared = stats.sparkSession.sparkContext.broadcast(models)

    def count(batches):
        held = np.zeros((len(models), 2, 2 * BINS), np.int64)
        for batch in batches:
            labels, rows = batch.column("label").to_numpy(zero_copy_only=False), _rows(batch)
            for k, model in enumerate(shared.value):
                bins = np.clip(model.difference(rows) * (BINS / REACH) + BINS, 0, 2 * BINS - 1).astype(int)
                np.add.at(held[k], (labels, bins), 1)
        at = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(held.ravel()[at])], names=["place", "n"])

    out = np.zeros((len(models), 2, 2 * BINS))
    found = stats.select("label", "stats").mapInArrow(count, "place bigint, n bigint")
    for r in found.groupBy("place").agg(F.sum("n").alias("n")).collect():
        out.ravel()[r.place] = r.n
    return out


def fit(labelled: DataFrame, label: str = "quality", id: str = "doc_id") -> Model:
    """Fit on all labelled rows of `describe`; the driver gets sums of a fixed size only.

    Rows with a null id or a label other than 0 and 1 are left out; a null text counts as an empty one. One row in
    SPARE is kept back: the shrinkage with the least loss on them and the slope of the score are chosen by their
    histograms. If a class has no rows to learn from or none among the spare ones, the score is the smoothed share of
    label 1.
    """
    known = labelled.filter(F.col(label).isin(0, 1) & F.col(id).isNotNull())
    spare = F.pmod(F.xxhash64(id, F.lit("spare")), F.lit(SPARE)) == 0
    stats = stored(known.select(F.col(label).cast("bigint").alias("label"), spare.alias("spare"), "stats"))
    moments = class_moments(stats.filter("not spare"))
    rows = [m.n for m in moments]
    share = Model((rows[1] + 1) / (sum(rows) + 2))
    if min(rows) < 2:
        return share
    models = [Model.of(moments, *choice) for choice in product(TO_COMMON, TO_ROUND)]
    counts = histograms(stats.filter("spare"), models)
    if not counts[0].sum(axis=1).all():
        return share
    at = (np.arange(2 * BINS) + 0.5 - BINS) * (REACH / BINS)
    found = [logistic(at, c) for c in counts]
    best = min(range(len(models)), key=lambda k: found[k][2])
    models[best].slope, models[best].offset = found[best][:2]
    return models[best]


def score(described: DataFrame, model: Model, at: float = 0.5) -> DataFrame:
    """The columns of `describe` but `stats`, with score (0 to 1) and predicted (1 if score >= `at`); one row per row.

    Null and empty texts have the statistics of an empty text and a score like any other. Rows alike in text score
    alike. A column with the name of an output column is replaced. An empty table gives no rows.
    """
    keep = [c for c in described.columns if c not in ("stats", "score", "predicted")]

    def run(batches):
        for batch in batches:
            found = model.predict(_rows(batch)) if batch.num_rows else np.zeros(0)
            made = [pa.array(found, pa.float64()), pa.array((found >= at).astype(np.int32))]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keep), *made], names=[*keep, "score", "predicted"])

    kinds = {f.name: f.dataType.simpleString() for f in described.select(*keep).schema.fields}
    schema = ", ".join([*(f"`{k}` {v}" for k, v in kinds.items()), "score double", "predicted int"])
    return described.select(*keep, "stats").mapInArrow(run, schema)
