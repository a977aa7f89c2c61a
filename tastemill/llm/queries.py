"""The registered queries and their SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from tastemill.llm import (
    alignment,
    chunks,
    decontaminate,
    language,
    lines,
    mixing,
    quality,
    simhash,
    spelling,
    suffixes,
    token_files,
    toxicity,
    vectors,
)
from tastemill.llm.frames import table
from tastemill.session import stored


def op1_line_dedup(spark, folder):
    found = lines.line_dedup(table(spark, folder, "pages"))
    return found.select(
        F.col("id").alias("page_id"),
        "host",
        F.size("lines").cast("bigint").alias("n_lines"),
        (F.size("lines") - F.size("kept")).cast("bigint").alias("n_dropped"),
        F.md5(F.array_join("kept", "\n")).alias("kept_md5"),
    )


OP1_SQL = rf"""
WITH cut AS (
  SELECT page_id, url, regexp_replace(regexp_replace(regexp_replace(coalesce(html, ''), '{lines.HIDDEN}', chr(10), 'g'),
    '{lines.BLOCK}', chr(10), 'g'), '{lines.TAG}', '', 'g') AS t FROM pages),
squeezed AS (
  SELECT page_id, nullif(lower(regexp_extract(url, '{lines.HOST}', 2)), '') AS host,
    trim(regexp_replace(regexp_replace(regexp_replace(t, '[\x20\x09\x0D]+', ' ', 'g'),
      '[\x20]?[\x0A][\x0A\x20]*', chr(10), 'g'), '^[\x0A\x20]+|[\x0A\x20]+$', '', 'g'), ' ') AS t FROM cut),
split AS (
  SELECT page_id, host, CASE WHEN t = '' THEN CAST([] AS VARCHAR[]) ELSE string_split(t, chr(10)) END AS lines FROM squeezed),
totals AS (SELECT host, count(*) AS pages FROM split WHERE host IS NOT NULL GROUP BY host),
counts AS (
  SELECT host, line, count(*) AS n
  FROM (SELECT host, unnest(list_distinct(lines)) AS line FROM split WHERE host IS NOT NULL) GROUP BY host, line),
boiler AS (
  SELECT c.host, list(line) AS gone FROM counts c JOIN totals t ON c.host = t.host
  WHERE n >= {lines.LEAST_PAGES} AND n > CAST({lines.RATIO} AS DOUBLE) * pages GROUP BY c.host),
kept AS (
  SELECT page_id, s.host, lines, list_filter(lines, lambda x: NOT coalesce(list_contains(gone, x), false)) AS kept
  FROM split s LEFT JOIN boiler b ON s.host = b.host)
SELECT page_id, host, len(lines)::BIGINT AS n_lines, (len(lines) - len(kept))::BIGINT AS n_dropped,
  md5(array_to_string(kept, chr(10))) AS kept_md5
FROM kept
"""


def op2_suffix_dedup(spark, folder):
    return suffixes.suffix_dedup(table(spark, folder, "documents")).withColumnRenamed("id", "doc_id")


def op3_chunk_dedup(spark, folder):
    return chunks.chunk_dedup(table(spark, folder, "documents")).withColumnRenamed("id", "doc_id")


def op4_mix(spark, folder):
    docs = table(spark, folder, "documents")
    sized = stored(docs.select("doc_id", "source", mixing.word_count(F.col("text")).alias("size")))
    mixed = mixing.mix(sized)
    return mixed.select(
        "doc_id",
        "size",
        F.col("mix_source_size").alias("source_size"),
        F.col("mix_target").alias("target"),
        (F.col("size") * F.col("mix_copies")).alias("taken"),
    )


OP4_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS size,
    substr(md5(coalesce(CAST(doc_id AS VARCHAR), chr(0) || 'null')), 1, 10) AS h
  FROM documents),
sources AS (
  SELECT source, sum(size)::BIGINT AS s, row_number() OVER (ORDER BY source IS NULL, encode(source)) AS turn
  FROM sized GROUP BY source),
weighted AS (
  SELECT source, s, [5.0::DOUBLE, 2.0, 1.0][((turn - 1) % 3 + 1)::INT] AS w FROM sources),
steps AS (
  SELECT *, row_number() OVER (ORDER BY 3 * s / w, source NULLS LAST) AS k, (sum(s) OVER () - coalesce(sum(3 * s) OVER before, 0))::DOUBLE
    / (sum(w) OVER () - coalesce(sum(w) OVER before, 0)) AS level
  FROM weighted
  WINDOW before AS (ORDER BY 3 * s / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
chosen AS (SELECT coalesce(arg_min(level, k) FILTER (level * w < 3 * s), 0) AS level FROM steps),
targets AS (
  SELECT source, s, least(3.0::DOUBLE * s, w * level) AS target,
    CASE WHEN s > 0 THEN floor(least(3.0::DOUBLE * s, w * level) / s) ELSE 0 END::BIGINT AS whole
  FROM weighted, chosen),
buckets AS (
  SELECT b.source, h, sz, sum(sz) OVER (PARTITION BY b.source ORDER BY h) AS upto, target - whole * s AS rest
  FROM (SELECT source, h, sum(size)::BIGINT AS sz FROM sized GROUP BY source, h) b
  JOIN targets t ON b.source IS NOT DISTINCT FROM t.source),
edges AS (
  SELECT source, h AS edge, 2 * (rest - (upto - sz)) >= sz AS closes
  FROM buckets WHERE upto > rest AND upto - sz <= rest)
SELECT doc_id, size::BIGINT AS size, s AS source_size, target,
  (size * (whole + CASE WHEN h < edge OR (h = edge AND closes) THEN 1 ELSE 0 END))::BIGINT AS taken
FROM sized d JOIN targets t ON d.source IS NOT DISTINCT FROM t.source
LEFT JOIN edges e ON d.source IS NOT DISTINCT FROM e.source
"""


def held_out(parts: int, which: int):
    """Whether crc32 of the id as text leaves `which`; false for a null id."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % parts == which, F.lit(False))


def op5_language(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", "text", "lang", held_out(5, 0).alias("held_out"))
    model = language.fit(docs.filter(~F.col("held_out")))
    return language.identify(docs, model, keep=["doc_id", "held_out"])


def op6_decontaminate(spark, folder):
    found = decontaminate.contamination(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
    return found.drop("text_key").withColumnRenamed("id", "doc_id")


OP6_SQL = r"""
WITH words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
items AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
windows AS (
  SELECT DISTINCT item_id, least(10, len(w)) AS n,
    array_to_string(w[s : s + least(10, len(w)) - 1], ' ') AS phrase
  FROM items, LATERAL (SELECT unnest(range(1, len(w) - least(10, len(w)) + 2)) AS s) WHERE len(w) > 0),
sizes AS (SELECT DISTINCT n FROM windows),
places AS (
  SELECT doc_id, n, s, array_to_string(w[s : s + n - 1], ' ') AS phrase
  FROM words, sizes, LATERAL (SELECT unnest(range(1, len(w) - n + 2)) AS s) WHERE len(w) >= n),
hits AS (SELECT doc_id, s, p.n, item_id FROM places p JOIN windows v ON p.phrase = v.phrase AND p.n = v.n),
marked AS (
  SELECT doc_id, count(DISTINCT place) AS n_hit
  FROM (SELECT doc_id, unnest(range(s, s + n)) AS place FROM hits) GROUP BY doc_id),
named AS (
  SELECT doc_id, count(DISTINCT item_id) AS n_items,
    array_to_string(list_sort(list(DISTINCT CAST(item_id AS VARCHAR))), ',') AS ids
  FROM hits GROUP BY doc_id)
SELECT w.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM words w LEFT JOIN marked m ON w.doc_id = m.doc_id LEFT JOIN named k ON w.doc_id = k.doc_id
"""


def op7_simhash(spark, folder):
    groups = simhash.simhash_groups(table(spark, folder, "documents"))
    return groups.select(
        F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def op8_toxicity(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", "text", held_out(3, 1).alias("held_out"))
    labels = table(spark, folder, "labels").filter("toxic is not null").select("doc_id", "toxic")
    model = toxicity.fit(docs.filter(~F.col("held_out")).join(labels, "doc_id"))
    return toxicity.score(docs, model, keep=["doc_id", "held_out"])


def op9_token_files(spark, folder):
    path = public_tokenizers.path("byte_bpe_50k.json")
    files = token_files.tokenize_to_files(table(spark, folder, "documents"), path, 2)
    found = token_files.file_digests(spark, files)
    return found.select(F.col("id").alias("doc_id"), "start", "n_tokens", "ids_crc32")


def op10_vector_groups(spark, folder):
    groups = vectors.vector_groups(table(spark, folder, "embeddings"))
    return groups.withColumnRenamed("id", "vec_id")


def op11_quality(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", "text", held_out(3, 1).alias("held_out"))
    labels = table(spark, folder, "labels").filter("quality is not null").select("doc_id", "quality")
    described = quality.describe(docs, keep=["doc_id", "held_out"])
    model = quality.fit(described.filter(~F.col("held_out")).join(labels, "doc_id"))
    return quality.score(described, model)


def op12_alignment(spark, folder):
    found = alignment.align_tokenizers(
        table(spark, folder, "documents"),
        public_tokenizers.path("byte_bpe_50k.json"),
        public_tokenizers.path("piece_bpe_32k.model"),
        public_tokenizers.PATTERN,
    )
    return found.withColumnRenamed("id", "doc_id")


def op13_spelling(spark, folder):
    return spelling.spelling_variants(table(spark, folder, "documents"))


OP13_SQL = r"""
WITH RECURSIVE runs AS (
  SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS d, unnest(regexp_extract_all(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-z\x{C0}-\x{FF}]+')) AS run FROM documents),
counted AS (SELECT d, run, count(*) AS n FROM runs WHERE length(run) >= 6 GROUP BY d, run),
steps AS (
  SELECT list_transform(range(256), lambda x: list_reduce(list_prepend(x, range(8)),
    lambda c, i: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END)) AS tab),
spelled AS (SELECT run, n, hex(encode(d || ':' || run)) AS x, octet_length(encode(d || ':' || run)) AS long FROM counted),
hashed AS (
  SELECT run, n, xor(list_reduce(list_prepend(4294967295::BIGINT,
      list_transform(range(1, long + 1), lambda i: ('0x' || substr(x, 2 * i - 1, 2))::BIGINT)),
    lambda c, b: xor(c // 256, tab[xor(c % 256, b) + 1])), 4294967295::BIGINT) AS h
  FROM spelled, steps),
lost AS (
  SELECT CASE WHEN h % 199 = 0 THEN left(run, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, n
  FROM hashed),
words AS (SELECT word, sum(n)::BIGINT AS n FROM lost WHERE length(word) >= 6 GROUP BY word HAVING sum(n) >= 5),
holes AS (
  SELECT word, n, i, left(word, i) AS a, substr(word, i + 2) AS b
  FROM words, LATERAL (SELECT unnest(range(length(word))) AS i)),
pairs AS (
  SELECT x.word, y.word AS near, y.n AS near_n FROM holes x JOIN holes y ON x.i = y.i AND x.a = y.a AND x.b = y.b AND x.word <> y.word
  UNION SELECT x.word, y.word, y.n FROM holes x JOIN words y ON x.a || x.b = y.word
  UNION SELECT y.word, x.word, x.n FROM holes x JOIN words y ON x.a || x.b = y.word),
best AS (SELECT word, count(*) AS n_near, max(near_n) AS top FROM pairs GROUP BY word),
firsts AS (
  SELECT p.word, min(encode(near)) AS near FROM pairs p JOIN best b ON p.word = b.word AND p.near_n = b.top GROUP BY p.word),
formed AS (
  SELECT w.word, w.n, coalesce(n_near, 0)::BIGINT AS n_near, CASE WHEN top >= 5 * w.n THEN decode(f.near) END AS form,
    CASE WHEN top >= 5 * w.n THEN top END AS form_n
  FROM words w LEFT JOIN best b ON w.word = b.word LEFT JOIN firsts f ON w.word = f.word),
chain AS (
  SELECT word, word AS root FROM formed
  UNION ALL SELECT c.word, f.form FROM chain c JOIN formed f ON c.root = f.word WHERE f.form IS NOT NULL),
ends AS (SELECT c.word, c.root FROM chain c JOIN formed f ON c.root = f.word WHERE f.form IS NULL)
SELECT f.word, form, root, n, n_near, form_n FROM formed f JOIN ends e ON f.word = e.word
"""


QUERIES = {
    "op1_line_dedup": op1_line_dedup,
    "op2_suffix_dedup": op2_suffix_dedup,
    "op3_chunk_dedup": op3_chunk_dedup,
    "op4_mix": op4_mix,
    "op5_language": op5_language,
    "op6_decontaminate": op6_decontaminate,
    "op7_simhash": op7_simhash,
    "op8_toxicity": op8_toxicity,
    "op9_token_files": op9_token_files,
    "op10_vector_groups": op10_vector_groups,
    "op11_quality": op11_quality,
    "op12_alignment": op12_alignment,
    "op13_spelling": op13_spelling,
}
ORACLES = {"op1_line_dedup": OP1_SQL, "op4_mix": OP4_SQL, "op6_decontaminate": OP6_SQL, "op13_spelling": OP13_SQL}
