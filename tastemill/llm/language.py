"""Language ID with error-correcting output codes."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tastemill.llm.frames import in_share, map_text, small
from tastemill.llm.ngrams import chunks, join, spread
from tastemill.session import stored

#: Labelled rows that a model is fitted on (chosen by a hash of the id), those of a rare language at least, and bits of
#: an n-gram bucket.
SAMPLE = 20_000
FEW = 500
BITS = 13
#: How sharply margins become scores, and the lead under which a row is flagged as ambiguous.
SHARPNESS = 3.0
LEAD = 0.2
#: Codewords of more languages than this are drawn at random instead of listed in full.
FULL_CODE = 7
UNKNOWN = "und"

_ASCII_LETTER = re.compile(rb"[A-Za-z]")


def has_letter(text: bytes) -> bool:
    if _ASCII_LETTER.search(text):
        return True
    return any(map(str.isalpha, text.decode("utf-8", "replace")))


def frequencies(texts: list[bytes]) -> np.ndarray:
    """Shares of hashed byte n-grams (1 to 3, blanks included) in each text; a row of zeros without letters."""
    width = 1 << BITS
    out = np.zeros((len(texts), width))
    for at, parts in chunks(texts):
        data, starts = join(parts)
        wide = data.astype(np.uint32) + np.uint32(1)
        two = wide[:-1] * np.uint32(0x01000193) + wide[1:]
        three = two[:-1] * np.uint32(0x01000193) + wide[2:]
        kinds = [spread(x ^ np.uint32(n * 0x1F123BB5 & 0xFFFFFFFF), BITS) for n, x in ((1, wide), (2, two), (3, three))]
        for i, start, end in zip(at, starts, [*starts[1:], len(data)]):
            for n, kind in enumerate(kinds):
                own = kind[start : end - n]
                if len(own):
                    out[i] += np.bincount(own, minlength=width)
    total = out.sum(axis=1, keepdims=True)
    return out / np.maximum(total, 1)


def codewords(n: int, seed: int = 7) -> np.ndarray:
    """n rows of +1 and -1: every way to split few languages in two, else the best of random codes."""
    if n <= FULL_CODE:
        splits = np.arange(1, 1 << (n - 1)) if n > 1 else np.zeros(1, int)
        bits = splits[None, :] >> np.arange(n - 1)[:, None] & 1 if n > 1 else np.zeros((0, 1), int)
        return np.vstack([np.ones((1, len(splits)), int), 1 - 2 * bits])
    rng = np.random.default_rng(seed)
    length = max(32, 12 * int(np.ceil(np.log2(n))))
    best, distance = None, -1
    for _ in range(50):
        code = rng.choice([-1, 1], (n, length))
        code[:, np.abs(code.sum(axis=0)) == n] *= np.where(np.arange(n) % 2, 1, -1)[:, None]
        apart = (length - code @ code.T) // 2
        least = apart[~np.eye(n, dtype=bool)].min()
        if least > distance:
            best, distance = code, least
    return best


class Model:
    """One linear n-gram classifier per bit of the codewords."""

    def __init__(self, languages: list[str], means: np.ndarray):
        self.languages = languages
        self.code = codewords(len(languages)) if languages else np.zeros((0, 1), int)
        smooth = 1e-5
        sides = []
        for bit in self.code.T:
            if len(languages) > 1:
                plus, minus = means[bit > 0].mean(axis=0), means[bit < 0].mean(axis=0)
                sides.append(np.log(plus + smooth) - np.log(minus + smooth))
            else:
                sides.append(np.zeros(1 << BITS))
        self.weights = np.array(sides).T
        margins = means @ self.weights if languages else np.zeros((0, self.code.shape[1]))
        self.centre = np.zeros(self.code.shape[1])
        self.scale = np.ones(self.code.shape[1])
        for b, bit in enumerate(self.code.T):
            if len(languages) > 1:
                high, low = margins[bit > 0, b].min(), margins[bit < 0, b].max()
                self.centre[b] = (high + low) / 2
                self.scale[b] = max((high - low) / 2, 1e-3)
        # A bit whose sides lie further apart counts more.
        self.trust = self.scale / self.scale.mean()

    def predict(self, texts: list[bytes]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """(language, score, ambiguous) of each text: the codeword with the least weighted logistic loss."""
        lettered = np.array([bool(t) and has_letter(t) for t in texts], bool)
        if not self.languages:
            return [UNKNOWN] * len(texts), np.zeros(len(texts)), np.ones(len(texts), bool)
        margin = (frequencies(texts) @ self.weights - self.centre) / self.scale
        agree = self.code[None, :, :] * margin[:, None, :]
        loss = (np.logaddexp(0, -SHARPNESS * agree) * self.trust).mean(axis=2)
        chance = np.exp(-SHARPNESS * (loss - loss.min(axis=1, keepdims=True)))
        chance /= chance.sum(axis=1, keepdims=True)
        best = chance.argmax(axis=1)
        ordered = np.sort(chance, axis=1)
        lead = ordered[:, -1] - ordered[:, -2] if len(self.languages) > 1 else ordered[:, -1]
        named = [self.languages[b] if ok else UNKNOWN for b, ok in zip(best, lettered)]
        score = np.where(lettered, ordered[:, -1], 0.0)
        return named, score, ~lettered | (lead < LEAD)


def fit(labelled: DataFrame, text: str = "text", lang: str = "lang", id: str = "doc_id", sample: int = SAMPLE) -> Model:
    """Fit on about `sample` rows with a language, chosen by a hash of the id (all rows if there are fewer).

    A language whose part of the sample is under FEW rows gives about FEW, or all that it has. Each row counts alike whatever its length. Tasks send one row per language and n-gram bucket, so what reaches the
    driver is bounded by languages x buckets.
    """
    known = labelled.filter(F.col(lang).isNotNull() & F.col(text).isNotNull())
    known = known.select(F.col(lang).cast("string").alias("lang"), F.col(text).alias("text"), F.col(id).alias("id"))
    sizes = stored(known.groupBy("lang").agg(F.count("*").alias("n")))
    n = sizes.agg(F.sum("n")).first()[0] or 1
    share = F.least(F.lit(1.0), F.greatest(F.lit(sample / n), F.lit(float(FEW)) / F.col("n")))
    chosen = known.join(small(sizes.select("lang", share.alias("share"))), "lang").filter(in_share("id", F.col("share")))

    def count(batches):
        for batch in batches:
            names = batch.column("lang").to_pylist()
            texts = batch.column("text").cast(pa.binary()).to_pylist()
            for at in range(0, len(texts), 256):
                shares = frequencies(texts[at : at + 256])
                own = np.array(names[at : at + 256], object)
                for name in sorted(set(own)):
                    total = shares[own == name].sum(axis=0)
                    bucket = np.flatnonzero(total)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([name] * len(bucket), pa.string()), pa.array(bucket), pa.array(total[bucket])],
                        names=["lang", "bucket", "share"],
                    )

    shares = chosen.select("lang", "text").mapInArrow(count, "lang string, bucket bigint, share double")
    # Sums of doubles depend on their order: whole numbers of 2^-40 do not.
    grid = F.round(F.col("share") * 2.0**40).cast("decimal(38,0)")
    rows = shares.groupBy("lang", "bucket").agg((F.sum(grid).cast("double") / 2.0**40).alias("share")).toPandas()
    languages = sorted(rows["lang"].unique().tolist())
    means = np.zeros((len(languages), 1 << BITS))
    for i, name in enumerate(languages):
        own = rows[rows["lang"] == name]
        means[i, own["bucket"]] = own["share"]
    means /= np.maximum(means.sum(axis=1, keepdims=True), 1e-12)
    return Model(languages, means)


def identify(
    df: DataFrame, model: Model, text: str = "text", keep: list[str] | None = None, prefix: str = ""
) -> DataFrame:
    """The columns `keep` (all by default) with lang_pred, score and ambiguous, named after `prefix`.

    A null text and a text without a letter get `und`, score 0, ambiguous; so does every row if no language was
    learned. With one language learned all other rows get it. Ties go to the language that sorts first. A column of `df` with the name of
    an output column is replaced.
    """

    def work(_, raw):
        made = [model.predict(raw[at : at + 256]) for at in range(0, len(raw), 256)]
        return {
            prefix + "lang_pred": pa.array([x for m in made for x in m[0]], pa.string()),
            prefix + "score": pa.array(np.concatenate([m[1] for m in made]) if made else [], pa.float64()),
            prefix + "ambiguous": pa.array(np.concatenate([m[2] for m in made]) if made else [], pa.bool_()),
        }

    schema = f"{prefix}lang_pred string, {prefix}score double, {prefix}ambiguous boolean"
    return map_text(df, text, keep or df.columns, schema, work)


def lettered(df: DataFrame, name: str, text: str = "text") -> DataFrame:
    """All columns, and under `name` whether the text has a letter (false for a null text)."""
    work = lambda _, raw: {name: pa.array([has_letter(t) for t in raw], pa.bool_())}
    return map_text(df, text, df.columns, f"{name} boolean", work)
