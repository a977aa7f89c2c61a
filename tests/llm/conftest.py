import random

import pytest

SCHEMA = (
    "doc_id bigint, text string, lang string, source string, n_chars bigint, "
    # Names that operators use inside.
    "id bigint, size string, text_key string, doc string, h int, first string, label int, component_id string, score int"
)


def sentence(rng, n=12):
    parts = ["tor", "mel", "ana", "vi", "sko", "ru", "ben", "ti", "lo", "ga", "zu", "pre", "ch", "ist", "oma"]
    return " ".join("".join(rng.choices(parts, k=rng.randint(1, 3))) for _ in range(n))


def texts():
    """(doc_id, text, lang, source) with nulls, empty and long texts, copies, repeated rows and clashing ids."""
    rng = random.Random(5)
    base = [sentence(rng, 60) for _ in range(12)]
    long = " ".join(sentence(rng, 40) for _ in range(300))
    rows = [(i, t, "xx" if i % 2 else "yy", f"s{i % 4}") for i, t in enumerate(base)]
    rows += [(20 + i, base[0], "xx", "s0") for i in range(4)]  # exact copies
    rows += [(30, base[1] + " End.", None, "s1"), (31, "Start " + base[1], "yy", None)]  # near copies
    rows += [(40, None, "xx", "s2"), (41, "", None, None), (42, " \n\t ", "yy", "s2"), (43, "123 ... !!", "xx", "s3")]
    rows += [(50, long, "xx", "s0"), (51, long[5000:9000] + base[2], "yy", "s1"), (52, "é" * 500 + " ça Été", "yy", "é")]
    rows += [(60, base[3], "xx", "s3"), (60, base[3], "xx", "s3"), (60, base[4], "yy", "s0")]  # repeated rows, same id
    rows += [(None, base[5], "xx", "s1"), (None, None, None, None), (70, "a", "xx", ""), (71, "ab ab ab ab ab", "xx", "s1")]
    return rows


@pytest.fixture(scope="session")
def documents(spark):
    rows = [(i, t, g, s, None, 7, "x", "k", "d", 1, "f", 0, "c", 3) for i, t, g, s in texts()]
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)
