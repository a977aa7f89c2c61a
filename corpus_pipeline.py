"""The corpus pipeline: documents in, token files out. Each stage works on all that the one before it kept."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tastemill.llm import decontaminate, language, mixing, simhash, token_files
from tastemill.llm.frames import table, text_key
from tastemill.session import stored

#: Names of helper columns, which the stages drop again.
KEY, ROW, MADE = "_text_key", "_row", "_made_"


def _with_key(docs: DataFrame) -> DataFrame:
    return docs.withColumn(KEY, text_key("text"))


def _marked(marks: DataFrame, *more: str) -> DataFrame:
    """Distinct (id, text_key) under names that documents do not have."""
    return marks.select(F.col("id").alias("_marked_id"), F.col("text_key").alias("_marked_key"), *more).distinct()


def _same_row():
    return F.col("doc_id").eqNullSafe(F.col("_marked_id")) & (F.col(KEY) == F.col("_marked_key"))


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a letter; those without any, and null texts, go.

    No document goes for the language it is given or for an ambiguous one. If no language could be learned, letters alone decide.
    """
    model = language.fit(docs)
    if not model.languages:
        return language.lettered(docs, MADE + "lettered").filter(MADE + "lettered").select(*docs.columns)
    found = language.identify(docs, model, prefix=MADE)
    return found.filter(F.col(MADE + "lang_pred") != language.UNKNOWN).select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (the smallest doc_id), and one row of those alike in id and text.

    Near copies have SimHash fingerprints of three-word shingles that differ in at most three bits, or are linked by such.
    """
    groups = simhash.simhash_groups(docs, width=3, radius=3)
    kept = _with_key(docs).join(_marked(groups.filter("first")), _same_row(), "left_semi")
    once = F.row_number().over(Window.partitionBy("doc_id", KEY).orderBy("doc_id"))
    return kept.withColumn(ROW, once).filter(F.col(ROW) == 1).select(*docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any window of a benchmark item."""
    found = decontaminate.contamination(docs, table(spark, sf_dir, "benchmark"))
    bad = stored(_marked(found.filter("contaminated")))
    return _with_key(docs).join(bad, _same_row(), "left_anti").select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: a document stands in it as often as the mix takes it, not at all or up to three times."""
    keyed = _with_key(docs)
    sized = stored(keyed.select("doc_id", "source", KEY, mixing.word_count(F.col("text")).alias("size")))
    mixed = mixing.mix(sized).filter("mix_copies > 0")
    taken = mixed.select(F.col("doc_id").alias("id"), F.col(KEY).alias("text_key"), "mix_copies")
    met = keyed.join(_marked(taken, "mix_copies"), _same_row())
    copies = F.explode(F.sequence(F.lit(1), F.col("mix_copies").cast("int"))).alias(ROW)
    return met.select(*docs.columns, copies).select(*docs.columns)


def write_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of each document of the mix, from the token files."""
    path = public_tokenizers.path("byte_bpe_50k.json")
    files = token_files.tokenize_to_files(docs, path, 2)
    found = token_files.file_digests(spark, files)
    return found.select(F.col("id").alias("doc_id"), "start", "n_tokens", "ids_crc32")


STAGES = [
    ("language", identify_language),
    ("near_copies", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("mixing", mix_sources),
    ("token_files", write_tokens),
]

#: The learned stage and the tokenizer have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`; what each returns is written and read again for the next one."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
