"""Benchmark decontamination with a distributed positional inverted index. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tastemill.llm.frames import small, text_key
from tastemill.session import stored

#: Words of a window (an item of fewer words is one window).
WIDTH = 10

#: Fixed value: what separates words (letters of either case, digits and all beyond ASCII make words).
BETWEEN = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _split(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), BETWEEN)


def _lead(parts: str = "parts") -> Column:
    """1 if the first part is empty, as the text starts between words."""
    return F.when(F.col(parts)[0] == "", 1).otherwise(0)


def _size(parts: str = "parts") -> Column:
    """Number of words: only the first and the last part can be empty."""
    return F.greatest(F.size(parts) - _lead(parts) - F.when(F.element_at(parts, -1) == "", 1).otherwise(0), F.lit(0))


def with_words(df: DataFrame, text: Column, *keep: str) -> DataFrame:
    """The columns `keep` and `words`: the words of a text as they stand, an empty array for null."""
    parts = df.select(*keep, _split(text).alias("parts"))
    return parts.select(*keep, F.slice("parts", _lead() + 1, _size()).alias("words"))


def _term(word: Column) -> Column:
    """What a word is looked up by: 64 bits of its letters folded to lower case in full."""
    return F.xxhash64(word)


def _folded(text: Column) -> Column:
    """Lower case, letter by letter: the one letter whose lower case depends on its place is replaced before."""
    return F.lower(F.replace(text, F.lit("\u03a3"), F.lit("\u03c3")))


def windows_of(benchmark: DataFrame, id: str, text: str, width: int) -> DataFrame:
    """(item, phrase, length): the distinct windows of each item, words joined by blanks."""
    named = benchmark.select(F.col(id).alias("item"), F.translate(text, UPPER, LOWER).alias("text"))
    items = with_words(named, F.col("text"), "item").filter(F.size("words") > 0)
    length = F.least(F.size("words"), F.lit(width))
    start = F.explode(F.sequence(F.lit(1), F.size("words") - length + 1))
    cut = items.select("item", "words", length.alias("length"), start.alias("start"))
    cut = cut.select("item", "length", F.slice("words", F.col("start"), F.col("length")).alias("phrase"))
    return cut.select("item", "length", F.array_join("phrase", " ").alias("phrase")).distinct()


def tokens(docs: DataFrame, text: str) -> DataFrame:
    """(doc, pos, term): every word of every document, to be looked up."""
    parts = docs.select("doc", _split(_folded(F.col(text))).alias("parts"))
    spread = parts.select("doc", _lead().alias("lead"), F.posexplode("parts").alias("at", "word"))
    return spread.select("doc", (F.col("at") - F.col("lead")).alias("pos"), _term(F.col("word")).alias("term"))


def rarest_terms(docs: DataFrame, windows: DataFrame, text: str) -> DataFrame:
    """(phrase, term, offset, second, second_offset): each phrase's two rarest terms by their count in all documents."""
    spelled = windows.select("phrase").distinct()
    spelled = stored(
        spelled.select("phrase", F.posexplode(F.split("phrase", " ")).alias("offset", "word")).select(
            "phrase", "offset", _term(_folded(F.col("word"))).alias("term")
        )
    )
    vocabulary = stored(spelled.select("term").distinct())
    counts = tokens(docs, text).join(small(vocabulary), "term").groupBy("term").count()
    rated = spelled.join(stored(counts), "term", "left")
    order = Window.partitionBy("phrase").orderBy(F.coalesce("count", F.lit(0)), "term", "offset")
    ranked = rated.withColumn("rank", F.row_number().over(order)).filter("rank <= 2")
    return ranked.groupBy("phrase").agg(
        F.max_by("term", F.when(F.col("rank") == 1, 1)).alias("term"),
        F.max_by("offset", F.when(F.col("rank") == 1, 1)).alias("offset"),
        F.max_by("term", F.when(F.col("rank") == 2, 1)).alias("second"),
        F.max_by("offset", F.when(F.col("rank") == 2, 1)).alias("second_offset"),
        F.min(F.coalesce("count", F.lit(0))).alias("count"),
    )


def postings(docs: DataFrame, terms: DataFrame, text: str) -> DataFrame:
    """(term, doc, pos) of the terms that are looked up."""
    return stored(tokens(docs, text).join(small(terms), "term").select("term", "doc", "pos"))


def candidates(docs: DataFrame, windows: DataFrame, text: str, slack: int = 0) -> DataFrame:
    """(doc, phrase_id, start): where the lists of a phrase's two rarest terms meet after taking off their offsets.

    With `slack`, the second term may stand that many words off its place.
    """
    rare = stored(
        rarest_terms(docs, windows, text).filter("count > 0").withColumn("phrase_id", F.xxhash64("phrase"))
    )
    first = rare.select("phrase_id", "term", "offset")
    second = rare.filter("second is not null").select("phrase_id", F.col("second").alias("term"), F.col("second_offset").alias("offset"))
    index = postings(docs, stored(first.union(second).select("term").distinct()), text)
    begin = (F.col("pos") - F.col("offset")).alias("start")
    lead = index.join(small(stored(first)), "term").select("doc", "phrase_id", begin).filter("start >= 0")
    rest = index.join(small(stored(second)), "term").select("doc", "phrase_id", begin)
    if slack:
        near = F.explode(F.sequence(F.col("start") - slack, F.col("start") + slack)).alias("start")
        rest = rest.select("doc", "phrase_id", near).distinct()
    lone = rare.filter("second is null").select("phrase_id")
    lone = lead.join(small(stored(lone)), "phrase_id", "left_semi")
    return lead.join(rest, ["doc", "phrase_id", "start"], "left_semi").union(lone.select("doc", "phrase_id", "start"))


def keyed_documents(docs: DataFrame, id: str, text: str) -> DataFrame:
    """(id, text_key, doc, text): doc stands for an id and a text together, so rows alike in both share it."""
    key = text_key(text)
    doc = F.struct(F.xxhash64(id).alias("a"), F.xxhash64(F.coalesce(F.col(id).cast("string"), F.lit("\0null")), key).alias("b"))
    return docs.select(F.col(id).alias("id"), key.alias("text_key"), doc.alias("doc"), F.col(text).alias("text"))


def phrase_matches(
    docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text", width: int = WIDTH
) -> tuple[DataFrame, DataFrame]:
    """((doc, phrase_id, start, length) of every exact occurrence of a window, (phrase_id, item)).

    `docs` is keyed_documents. Candidates come from the index; those that remain are compared word by word.
    """
    windows = stored(windows_of(benchmark, item, item_text, width))
    found = candidates(docs, windows, "text").groupBy("doc").agg(
        F.collect_set(F.struct("phrase_id", "start")).alias("places")
    )
    found = stored(found)
    phrases = stored(
        windows.select(F.xxhash64("phrase").alias("phrase_id"), "phrase", "length").distinct()
    )
    # Always by a shuffle of the texts, whose size is in proportion to the input.
    texts = docs.select("doc", "text").join(found.hint("merge"), "doc")
    worded = with_words(texts, F.col("text"), "doc", "places")
    spans = worded.select("doc", "words", F.explode("places").alias("place")).select(
        "doc",
        "place.phrase_id",
        "place.start",
        F.array_join(F.slice("words", F.col("place.start") + 1, width), " ").alias("span"),
    )
    spans = spans.withColumn("span", F.translate("span", UPPER, LOWER))
    met = spans.join(small(phrases), "phrase_id")
    same = F.when(F.col("length") == width, F.col("span") == F.col("phrase")).otherwise(
        F.concat("span", F.lit(" ")).startswith(F.concat("phrase", F.lit(" ")))
    )
    hits = stored(met.filter(same).select("doc", "phrase_id", "start", "length").distinct())
    return hits, windows.select(F.xxhash64("phrase").alias("phrase_id"), "item").distinct()


def proximity_matches(
    docs: DataFrame, benchmark: DataFrame, slack: int = 3, id: str = "doc_id", text: str = "text",
    item: str = "item_id", item_text: str = "text", width: int = WIDTH,
) -> DataFrame:
    """(id, item): documents in which a window's two rarest terms stand at most `slack` words off their distance."""
    keyed = keyed_documents(docs, id, text)
    windows = stored(windows_of(benchmark, item, item_text, width))
    near = candidates(keyed, windows, "text", slack).select("doc", "phrase_id").distinct()
    items = stored(windows.select(F.xxhash64("phrase").alias("phrase_id"), "item").distinct())
    pairs = stored(near.join(small(items), "phrase_id").select("doc", "item").distinct())
    return keyed.select("id", "doc").join(pairs, "doc").select("id", "item").distinct()


def contamination(
    docs: DataFrame, benchmark: DataFrame, id: str = "doc_id", text: str = "text",
    item: str = "item_id", item_text: str = "text", width: int = WIDTH,
) -> DataFrame:
    """(id, text_key, n_words, n_hit, n_items, items_sha256, contaminated): one row per row of `docs`.

    A word is hit if it lies in any occurrence of a window; items are those with a window that occurs. Null and
    empty texts have no words and are clean; null and empty items have no window. Items with the same id are one.
    Rows alike in id and text get the same result.
    """
    keyed = keyed_documents(docs, id, text)
    hits, items = phrase_matches(keyed, benchmark, text, item, item_text, width)
    spans = hits.groupBy("doc", "start").agg(F.max("length").alias("length"))
    order = Window.partitionBy("doc").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    end = F.col("start") + F.col("length")
    spans = spans.withColumn("before", F.coalesce(F.max(end).over(order), F.lit(0)))
    words = spans.groupBy("doc").agg(F.sum(F.greatest(end - F.greatest("start", "before"), F.lit(0))).alias("n_hit"))
    found = hits.select("doc", "phrase_id").distinct().join(small(stored(items)), "phrase_id")
    named = F.array_sort(F.collect_set(F.col("item").cast("string")))
    found = found.groupBy("doc").agg(named.alias("items"))
    marks = stored(words.join(found, "doc"))
    sized = keyed.select("id", "text_key", "doc", _split(F.col("text")).alias("parts"))
    sized = sized.select("id", "text_key", "doc", _size().cast("bigint").alias("n_words"))
    joined = sized.join(marks, "doc", "left")
    none = F.array().cast("array<string>")
    return joined.select(
        "id",
        "text_key",
        "n_words",
        F.coalesce("n_hit", F.lit(0)).cast("bigint").alias("n_hit"),
        F.size(F.coalesce("items", none)).cast("bigint").alias("n_items"),
        F.sha2(F.array_join(F.coalesce("items", none), ","), 256).alias("items_sha256"),
        (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"),
    )
