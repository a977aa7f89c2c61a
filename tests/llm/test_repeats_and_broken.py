"""Many rows alike, broken pages, strings of special tokens, and plain versions of what has no SQL."""

import hashlib
import random
import time
import zlib

import numpy as np
import pytest
from conftest import sentence
from pyspark.sql import functions as F

from tastemill.llm import chunks, language, lines, suffixes, token_files, toxicity

P = pytest.importorskip("public_tokenizers")


# -- repeated rows -----------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def alike(spark):
    """2,000 rows alike in id and text, and one other row that shares a passage with them."""
    rng = random.Random(8)
    text = sentence(rng, 1600)
    other = sentence(rng, 50) + text[3000:4000] + sentence(rng, 50)
    df = spark.range(2000).select(F.lit(5).cast("bigint").alias("doc_id"), F.lit(text).alias("text"))
    return text, other, df.union(spark.createDataFrame([(9, other)], df.schema)).repartition(8)


def test_suffix_dedup_of_rows_alike(alike):
    text, other, df = alike
    start = time.time()
    found = suffixes.suffix_dedup(df).groupBy("id", "n_bytes", "n_removed", "n_spans").count().collect()
    assert time.time() - start < 60
    by_id = {r.id: r for r in found}
    assert len(found) == 2 and by_id[5]["count"] == 2000 and by_id[5].n_removed == len(text.encode())
    assert by_id[9].n_removed >= 1000 and by_id[9].n_spans == 1


def test_chunk_dedup_of_rows_alike(alike):
    text, other, df = alike
    start = time.time()
    found = chunks.chunk_dedup(df).groupBy("id", "n_removed", "n_shared").count().collect()
    assert time.time() - start < 60
    by_id = {r.id: r for r in found}
    assert len(found) == 2 and by_id[5]["count"] == 2000 and by_id[9].n_removed > 800
    # The rows are one text, whose chunks come first there; all of them are shared.
    assert by_id[5].n_shared == len(chunks.chunk_ends(text.encode()))


def chunks_by_force(rows):
    """One row per row: a chunk stays where (id, nulls last, then text hash, then place) is least."""
    texts, at = {}, {}
    for id, key, text in rows:
        texts.setdefault((id is None, id or 0, key), [text or "", 0])[1] += 1
    where = {}
    for doc in sorted(texts):
        raw = texts[doc][0].encode()
        ends = chunks.chunk_ends(raw)
        at[doc] = [(a, b, raw[a:b]) for a, b in zip([0, *ends[:-1]], ends)]
        for a, _, part in at[doc]:
            where.setdefault(part, []).extend([(doc, a)] * texts[doc][1])
    out = []
    for doc, (text, copies) in texts.items():
        kept, shared = b"", 0
        for a, _, part in at[doc]:
            twice = len(where[part]) > 1
            shared += twice
            if not twice or where[part][0] == (doc, a):
                kept += part
        n = len(text.encode())
        row = (None if doc[0] else doc[1], n, n - len(kept), hashlib.sha256(kept).hexdigest(), shared)
        out += [row] * copies
    return out


def test_chunk_dedup_by_force(documents):
    key = F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("\0null")), F.xxhash64(F.coalesce("text", F.lit("\0null"))))
    rows = [tuple(r) for r in documents.select("doc_id", key, "text").collect()]
    found = chunks.chunk_dedup(documents).select("id", "n_bytes", "n_removed", "kept_sha256", "n_shared").collect()
    assert sorted(map(tuple, found), key=str) == sorted(chunks_by_force(rows), key=str)


# -- broken pages ------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("piece", ["<!--x", "<", "<script", "<script>x", "<style ", "<p ", "</", "<a <", "<!---", "  \n "])
def test_a_megabyte_of_openings(spark, piece):
    page = "Head line<br>" + piece * (1_000_000 // len(piece))
    df = spark.createDataFrame([(1, "http://a.b/", page), (2, "http://a.b/", "<p>x</p>")], "page_id bigint, url string, html string")
    start = time.time()
    found = {r.id: r.lines for r in lines.line_dedup(df).collect()}
    assert time.time() - start < 20
    assert found[1][0].startswith("Head line") and found[2] == ["x"]


def test_openings_without_an_end(spark):
    pages = {
        1: "a<br>b <!-- c<p>d",
        2: "a<script>if (x < 1) b()</script>c<STYLE>p",
        3: "1 < 2 and <b>3</b> > 2<br>a <b",
        4: "<!-- one --> x <!-- two --> y",
        5: "a <b <p>c",
    }
    df = spark.createDataFrame([(k, "u", v) for k, v in pages.items()], "page_id bigint, url string, html string")
    found = {r.id: r.lines for r in lines.line_dedup(df).collect()}
    assert found == {1: ["a", "b"], 2: ["a", "c"], 3: ["1 < 2 and 3 > 2", "a <b"], 4: ["x", "y"], 5: ["a <b", "c"]}


def test_one_large_host(spark):
    rows = [(i, f"http://big.org/{i}", f"<p>menu</p><p>own {i}</p>" + "<p>foot</p>" * (i % 2)) for i in range(400)]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    assert {tuple(r.kept) for r in lines.line_dedup(df).collect()} == {(f"own {i}",) for i in range(400)}


# -- special tokens ----------------------------------------------------------------------------------------------


def test_strings_of_special_tokens_are_encoded_as_the_library_does(spark):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    texts = ["x <|endoftext|> y", "<|endoftext|>", "a<|endoftext|>b c\nd", "plain text, only."]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    found = {r.id: r for r in token_files.file_digests(spark, token_files.tokenize_to_files(df, P.path("byte_bpe_50k.json"), 2)).collect()}
    start = 0
    for i, text in enumerate(texts):
        ids = plain.encode(text, add_special_tokens=False).ids + [2]
        assert (50256 in ids) == ("<|endoftext|>" in text)
        assert tuple(found[i])[2:] == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)


# -- classifiers in plain form -----------------------------------------------------------------------------------


def test_decoder_by_force():
    """The codeword with the least trust-weighted mean logistic loss over the bits, one text and language at a time."""
    rng = np.random.default_rng(3)
    texts = ["".join(rng.choice(list(s), 300)).encode() for s in ("abc de", "uvx yz", "mno pq", "abxyz ") for _ in range(5)]
    means = np.stack([language.frequencies(texts[5 * i : 5 * i + 5]).mean(axis=0) for i in range(4)])
    model = language.Model(["aa", "bb", "cc", "dd"], means)
    mixed = texts + [texts[0][:100] + texts[6][:120], b"qqq", b"   ", b""]
    names, scores, unsure = model.predict(mixed)
    for text, name, score, flag in zip(mixed, names, scores, unsure):
        if not text.strip():
            assert (name, score, flag) == ("und", 0.0, True)
            continue
        counts = language.frequencies([text])[0]
        losses = []
        for word in model.code:
            loss = 0.0
            for bit, side in enumerate(word):
                margin = sum(counts[k] * model.weights[k, bit] for k in np.flatnonzero(counts))
                margin = (margin - model.centre[bit]) / model.scale[bit]
                loss += model.trust[bit] * np.log1p(np.exp(-language.SHARPNESS * side * margin))
            losses.append(loss / len(word))
        chance = np.exp(-language.SHARPNESS * np.array(losses))
        chance /= chance.sum()
        order = np.argsort(-chance)
        assert name == model.languages[order[0]] and score == pytest.approx(chance[order[0]])
        assert flag == (chance[order[0]] - chance[order[1]] < language.LEAD)


def test_toxicity_forward_pass_by_force():
    """A text's score from its subword vectors: averaged, through the softmax, then the curve; bags from plain loops."""
    rng = random.Random(2)
    texts = [(sentence(rng, 30) + (" idiot fool" if i % 3 == 0 else "")).encode() for i in range(240)]
    labels = np.array([int(i % 3 == 0) for i in range(240)])
    model = toxicity.Model().fit([toxicity.bag(t) for t in texts], labels)
    for text, found in zip(texts[:40], model.predict(texts[:40])):
        known = [b for b in toxicity.bag(text).tolist() if model.known[b]]
        total = 0.0
        for bucket in known:
            total += model.scores[bucket]
        logit = (total / len(known) if known else 0.0) + model.bias
        assert found == pytest.approx(1 / (1 + np.exp(-(model.slope * logit + model.offset))))
    toxic = model.predict([b"what an idiott is this", b"such a foool here"])
    assert (toxic > model.predict([b"what an anavi is this"])[0]).all()
