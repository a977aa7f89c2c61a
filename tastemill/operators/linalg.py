"""Principal components, singular values and explicit ALS of a tall vector table.

The table has many rows and few columns: whoever calls this decides that a d x d matrix fits on
the driver. One pass over it gives number, sum and Gram matrix together: each task makes one row of its own,
and the rows are added in a tree, so no task and not the driver gets one for every partition. The eigenproblem
of the small matrix runs on the driver, and a second pass maps the rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: How many partial sums one task adds up.
FAN = 32


@dataclass(frozen=True)
class Moments:
    """Number of rows, their mean, and the Gram matrices about the origin and about the mean."""

    n: int
    mean: np.ndarray
    gram: np.ndarray
    scatter: np.ndarray

    @property
    def width(self) -> int:
        return len(self.mean)


def _partial_rows(batches: Iterator[pa.RecordBatch], col: str, shift: np.ndarray | None) -> tuple[int, int, np.ndarray]:
    """(least width, greatest width, flat sums of 1, x - shift and its products) of a task's rows."""
    low, high, sums = 0, 0, np.zeros(0)
    for batch in batches:
        lists = batch.column(col).drop_null()
        if not len(lists):
            continue
        sizes = np.diff(lists.offsets.to_numpy())
        low = int(sizes.min()) if not len(sums) else min(low, int(sizes.min()))
        high = max(high, int(sizes.max()))
        if low != high:
            return low, high, np.zeros(1)
        a = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(lists), -1) - (0.0 if shift is None else shift)
        found = np.concatenate([[len(a)], a.sum(axis=0), (a.T @ a).ravel()])
        sums = found if not len(sums) else sums + found
    return low, high, sums


def moments(df: DataFrame, col: str = "embedding") -> Moments:
    """One pass over the table. Products are taken about one of its rows, so means far from 0 cost no digits."""
    first = df.filter(F.col(col).isNotNull()).select(col).first()
    if first is None:
        raise ValueError("no vectors")
    shift = np.array(first[0], np.float64)

    def partial(batches):
        low, high, sums = _partial_rows(batches, col, shift)
        if len(sums):
            part = TaskContext.get().partitionId()
            yield pa.RecordBatch.from_arrays([pa.array([v]) for v in (part, low, high)] + [pa.array([sums.tobytes()])], names=names)

    def add(key, rows):
        low, high = min(rows["low"].to_pylist()), max(rows["high"].to_pylist())
        flat = np.zeros(1)
        if low == high:
            flat = np.zeros(1 + low + low * low)
            for sums in rows.sort_by("part")["sums"]:
                flat = flat + np.frombuffer(sums.as_py())
        part = key[0].as_py() if isinstance(key, tuple) else key.as_py()
        return pa.table([pa.array([v], pa.int64()) for v in (part, low, high)] + [pa.array([flat.tobytes()], pa.binary())], names=names)

    names, schema = ["part", "low", "high", "sums"], "part bigint, low bigint, high bigint, sums binary"
    rows = df.select(col).mapInArrow(partial, schema)
    # Three levels of FAN serve 32,768 partitions with at most FAN rows a task; more partitions only widen the last one.
    for step in (FAN, FAN, FAN):
        rows = rows.groupBy(F.floor(F.col("part") / step).alias("group")).applyInArrow(add, schema)
    total = add((pa.scalar(0),), pa.Table.from_pylist([r.asDict() for r in rows.collect()], pa.schema([(n, t) for n, t in zip(names, (pa.int64(), pa.int64(), pa.int64(), pa.binary()))])))
    low, high = total["low"][0].as_py(), total["high"][0].as_py()
    if low != high:
        raise ValueError("vectors differ in length")
    flat = np.frombuffer(total["sums"][0].as_py())
    n, sums, products = flat[0], flat[1 : 1 + low], flat[1 + low :].reshape(low, low)
    apart = sums / n
    scatter = products - n * np.outer(apart, apart)
    mean = shift + apart
    gram = scatter + n * np.outer(mean, mean)
    return Moments(int(n), mean, (gram + gram.T) / 2, (scatter + scatter.T) / 2)


def column_means(df: DataFrame, col: str = "embedding") -> DataFrame:
    """(pos, mean): one row per column."""
    mean = moments(df, col).mean
    return df.sparkSession.createDataFrame([(n, float(m)) for n, m in enumerate(mean)], "pos int, mean double")


def scatter(df: DataFrame, col: str = "embedding", center: bool = True) -> DataFrame:
    """(i, j, value) of (A - m)'(A - m), not divided by n; without `center` it is A'A."""
    found = moments(df, col)
    cells = found.scatter if center else found.gram
    rows = [(i, j, float(cells[i, j])) for i in range(found.width) for j in range(found.width)]
    return df.sparkSession.createDataFrame(rows, "i int, j int, value double")


@dataclass(frozen=True)
class Factors:
    """A = U S V' + mean; U is a table, the rest is small. Columns by falling singular value."""

    scores: DataFrame  # key, u
    s: np.ndarray
    v: np.ndarray
    mean: np.ndarray
    eigenvalues: np.ndarray  # all of them, rising


def _decompose(df: DataFrame, k: int, col: str, key: str, center: bool) -> Factors:
    found = moments(df, col)
    if not 0 <= k <= found.width:
        raise ValueError("k must lie between 0 and the number of columns")
    mean = found.mean if center else np.zeros(found.width)
    values, vectors = np.linalg.eigh(found.scatter if center else found.gram)
    values = np.maximum(values, 0.0)
    top = np.argsort(values)[::-1][:k]
    v = vectors[:, top]
    # Fix the sign, so the largest entry of each column is positive.
    v = v * np.where(v[np.abs(v).argmax(axis=0), range(k)] < 0, -1.0, 1.0) if k else v
    s = np.sqrt(values[top])
    inverse = np.divide(1.0, s, out=np.zeros_like(s), where=s > 0)

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                a = np.stack(batch[col].to_numpy()).astype(np.float64) - mean
                yield pd.DataFrame({key: batch[key], "u": list(a @ v * inverse)})

    kind = dict(df.dtypes)[key]
    scores = df.select(key, col).mapInPandas(rows, f"{key} {kind}, u array<double>")
    return Factors(scores, s, v, mean, values)


def pca(df: DataFrame, k: int, col: str = "embedding", key: str = "vec_id") -> Factors:
    return _decompose(df, k, col, key, center=True)


def svd(df: DataFrame, k: int, col: str = "embedding", key: str = "vec_id") -> Factors:
    return _decompose(df, k, col, key, center=False)


def recover(factors: Factors, key: str = "vec_id", col: str = "recovered") -> DataFrame:
    """U S V' + mean, row by row."""
    back = (factors.v * factors.s).T
    mean = factors.mean

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                u = np.stack(batch["u"].to_numpy())
                yield pd.DataFrame({key: batch[key], col: list(u @ back + mean)})

    kind = dict(factors.scores.dtypes)[key]
    return factors.scores.mapInPandas(rows, f"{key} {kind}, {col} array<double>")


def reconstruction_error(
    df: DataFrame, recovered: DataFrame, col: str = "embedding", key: str = "vec_id"
) -> DataFrame:
    """Squared Frobenius distance between the table and its reconstruction."""
    gap = F.zip_with(col, "recovered", lambda a, b: (a - b) * (a - b))
    total = F.aggregate(gap, F.lit(0.0), lambda acc, x: acc + x)
    return df.select(key, col).join(recovered, key).agg(F.sum(total).alias("error"))


def error_by_rank(df: DataFrame, col: str = "embedding", center: bool = True) -> DataFrame:
    """(k, error) for every rank k: the sum of the eigenvalues that rank k drops."""
    found = moments(df, col)
    values = np.sort(np.maximum(np.linalg.eigvalsh(found.scatter if center else found.gram), 0.0))
    errors = [(k, float(values[: found.width - k].sum())) for k in range(found.width + 1)]
    return df.sparkSession.createDataFrame(errors, "k int, error double")


def project(df: DataFrame, k: int = 2, col: str = "embedding", key: str = "vec_id") -> DataFrame:
    """Low-dimensional coordinates (key, c1..ck): the scaled principal components."""
    found = pca(df, k, col, key)
    coords = [(F.col("u")[n] * F.lit(float(found.s[n]))).alias(f"c{n + 1}") for n in range(k)]
    return found.scores.select(key, *coords)


def als_trace(
    df: DataFrame, k: int = 2, lam: float = 1e-4, steps: int = 20, col: str = "embedding", seed: int = 0
) -> DataFrame:
    """Squared error after each half step of explicit alternating ridge regression.

    With X = A M for a d x k matrix M, both X'X = M'GM and A'X = GM depend on the table only
    through G = A'A. One pass over the table therefore serves every step.
    """
    gram = moments(df, col).gram
    y = np.random.default_rng(seed).standard_normal((len(gram), k))
    ridge = lam * np.eye(k)
    trace = []

    def error(m: np.ndarray, y: np.ndarray) -> float:
        cross = np.trace(y.T @ gram @ m)
        return float(np.trace(gram) - 2 * cross + np.trace((m.T @ gram @ m) @ (y.T @ y)))

    for step in range(1, steps + 1):
        m = y @ np.linalg.inv(y.T @ y + ridge)
        trace.append((step, "x", error(m, y)))
        y = gram @ m @ np.linalg.inv(m.T @ gram @ m + ridge)
        trace.append((step, "y", error(m, y)))
    return df.sparkSession.createDataFrame(trace, "step int, side string, error double")
