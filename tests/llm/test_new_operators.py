"""Quality scores, tokenizer alignment and spelling variants against brute force and held-out rows."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from conftest import sentence
from pyspark.sql import functions as F

from tastemill.llm import alignment, quality, spelling

P = pytest.importorskip("public_tokenizers")
PATHS = (P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model"))


# -- quality ---------------------------------------------------------------------------------------------------------


def labelled(rng, n=400):
    for i in range(n):
        text = ". ".join(sentence(rng, rng.randint(5, 12)).capitalize() for _ in range(rng.randint(2, 8))) + "."
        bad = i % 4 == 0
        if bad:
            text = " | ".join(text.split()) if i % 8 else " ".join(w + "%%%" for w in text.upper().split())
        yield i, text, int(not bad)


def test_quality_of_rows_kept_back(spark):
    rows = list(labelled(random.Random(1)))
    schema = "doc_id bigint, text string, quality int"
    learn, rest = (spark.createDataFrame([r for r in rows if bool(r[0] % 3) == x], schema) for x in (True, False))
    model = quality.fit(quality.describe(learn))
    found = quality.score(quality.describe(rest), model).collect()
    assert all(r.predicted == r.quality and 0 <= r.score <= 1 for r in found)
    again = quality.fit(quality.describe(learn.repartition(5)))
    assert np.allclose([r.score for r in found], again.predict(np.stack([quality.statistics(r.text.encode()) for r in found])))


def test_density_is_that_of_a_gaussian():
    rng = np.random.default_rng(2)
    moments = []
    rows = [rng.normal(size=(200, len(quality.NAMES))) @ rng.normal(size=(len(quality.NAMES),) * 2) for _ in range(2)]
    for own in rows:
        m = quality.Moments(len(quality.NAMES))
        m.n, m.sum, m.products = len(own), own.sum(axis=0), own.T @ own
        moments.append(m)
    model = quality.Model.of(moments, 0.3, 0.1)
    common = sum(np.cov(r.T, bias=True) * len(r) for r in rows) / 400
    scale = np.sqrt(np.diag(common))
    center = np.concatenate(rows).mean(axis=0)
    wanted = []
    for own in rows:
        mixed = (0.7 * np.cov(own.T, bias=True) + 0.3 * common) / np.outer(scale, scale)
        mixed = 0.9 * mixed + 0.1 * np.trace(mixed) / len(mixed) * np.eye(len(mixed))
        apart = (rows[0] - own.mean(axis=0)) / scale
        distance = np.einsum("ij,jk,ik->i", apart, np.linalg.inv(mixed), apart)
        wanted.append(-0.5 * (distance + np.linalg.slogdet(mixed)[1]))
    assert np.allclose(model.center, center)
    assert np.allclose(np.sinh(model.difference(rows[0])), wanted[1] - wanted[0])


def test_statistics_by_hand():
    got = dict(zip(quality.NAMES, quality.statistics(b"AB ab\nab a!\nAB ab\n")))
    root = lambda p: np.arcsin(np.sqrt(p))
    assert got["words"] == pytest.approx(np.log1p(6)) and got["word_size"] == pytest.approx(np.log1p(2))
    assert got["capitals"] == pytest.approx(root(4 / 11)) and got["cries"] == pytest.approx(root(1 / 18))
    assert got["again"] == pytest.approx(root(1 / 6)) and got["distinct"] == pytest.approx(root(3 / 6))
    assert got["same_lines"] == pytest.approx(root(1 / 3)) and got["line_words"] == pytest.approx(np.log1p(2))
    assert not quality.statistics(b"")[1:].any()
    long = b"word and more. " * 200_000  # 3 MB: pieces add up
    assert dict(zip(quality.NAMES, quality.statistics(long)))["words"] == pytest.approx(np.log1p(600_000))


def test_quality_of_odd_rows(spark, documents, nothing):
    model = quality.fit(quality.describe(spark.createDataFrame(list(labelled(random.Random(3))), "doc_id bigint, text string, quality int")))
    clash = documents.withColumns({"stats": F.lit("x"), "predicted": F.lit("y")})
    found = quality.score(quality.describe(clash), model)
    assert found.count() == documents.count() and found.filter("score is null or score < 0 or score > 1").count() == 0
    same = found.filter("text is null or text = ''").select("score").distinct().count()
    assert same == 1 and dict(found.dtypes)["score"] == "double" and "h" in found.columns and "stats" not in found.columns
    assert quality.score(quality.describe(nothing), model).count() == 0
    none = quality.fit(quality.describe(nothing.withColumn("quality", F.lit(1))))
    assert {r.score for r in quality.score(quality.describe(documents), none).collect()} == {0.5}
    ones = quality.fit(quality.describe(documents.withColumn("quality", F.lit(1))))
    assert {r.predicted for r in quality.score(quality.describe(documents), ones).collect()} == {1}


# -- alignment -------------------------------------------------------------------------------------------------------


def align_by_force(texts):
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    a, b = Tokenizer.from_file(PATHS[0]), SentencePieceProcessor(model_file=PATHS[1])
    a.encode_special_tokens = True
    signs = alignment.byte_of()
    per, counts = [], Counter()
    for text in texts:
        whole = (" " + (text or "")).encode()
        sides = []
        if text:
            ids = a.encode(" " + text, add_special_tokens=False).ids
            sides.append([(i, bytes(signs[c] for c in a.id_to_token(i))) for i in ids])
            named = [(i, b.id_to_piece(i)) for i in b.encode(text)]
            sides.append([(i, bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode()) for i, p in named])
        if not text or any(b"".join(x for _, x in side) != whole for side in sides):
            per.append(None)
            continue
        spans = []
        for side in sides:
            at, out = 0, []
            for i, x in side:
                out.append((i, at, at + len(x)))
                at += len(x)
            spans.append(out)
        links = [(i, j) for i, s, e in spans[0] for j, t, f in spans[1] if s < f and t < e]
        both = sorted({e for _, _, e in spans[0]} & {e for _, _, e in spans[1]})
        groups, low = [], 0
        for end in both:
            groups.append("|".join(",".join(str(i) for i, s, e in side if low <= s and e <= end) for side in spans))
            low = end
        counts.update(links)
        per.append((len(spans[0]), len(spans[1]), groups, links))
    top = defaultdict(int)
    for (_, j), n in counts.items():
        top[j] = max(top[j], n)
    out = []
    for p in per:
        if p is None:
            out.append((0, 0, 0, 0, 0, 0, ""))
        else:
            n_best = sum(counts[x] == top[x[1]] for x in p[3])
            digest = hashlib.sha256(";".join(p[2]).encode()).hexdigest()
            out.append((p[0], p[1], len(p[2]), len(p[3]), n_best, sum(counts[x] for x in p[3]), digest))
    return out


def test_alignment_by_force(spark, documents, nothing, monkeypatch):
    odd = [
        "  two  blanks ", "tab\tand\nlines\n\n", "emoji 🎉🎉 and 漢字 かな", "a▁b", "<|endoftext|> <s> <unk> <0x41>", "é ﬁ ½ ǅ ʰ ԯ",
        "don't they'll I'VE", "\x00\x01 x", "　wide blank", " ", "x" * 3000, "naïve ÇA Été " * 30, "don't they'll I'VE",
    ]
    rows = [(r.doc_id, r.text if r.text is None else r.text[:900]) for r in documents.collect()]
    rows += [(100 + i, t) for i, t in enumerate(odd)]
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id bigint, text string, block int, pair string")
    found = alignment.align_tokenizers(df, *PATHS, P.PATTERN).collect()
    wanted = Counter(zip((i for i, _ in rows), align_by_force([t for _, t in rows])))
    names = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
    assert Counter((r.id, tuple(r[n] for n in names)) for r in found) == wanted
    plain = alignment.align_tokenizers(df.repartition(5), *PATHS).collect()  # without the fast path
    assert Counter(map(tuple, plain)) == Counter(map(tuple, found))
    assert alignment.align_tokenizers(nothing, *PATHS, P.PATTERN).count() == 0
    bare = alignment.align_tokenizers(df.filter("text is null or text = ''"), *PATHS, P.PATTERN).collect()
    assert bare and all(tuple(r)[1:] == (0, 0, 0, 0, 0, 0, "") for r in bare)


def test_parts_and_blocks_change_nothing(monkeypatch):
    rng = random.Random(4)
    texts = [sentence(rng, 300) + "  a \n b\t" + sentence(rng, 200), "z" * 5000 + " end", "", sentence(rng, 900), "bad▁ one " + sentence(rng, 300)]
    made = alignment.Aligner.of(*PATHS, P.PATTERN)
    whole = list(made.documents(texts))
    monkeypatch.setattr(alignment, "PART", 200)
    monkeypatch.setattr(alignment, "BATCH", 700)
    assert all(len(alignment.cut_parts(t)) > 1 for t in (texts[0], texts[3]))
    for one, other in zip(whole, made.documents(texts)):
        assert one[:5] == other[:5] and all((x == y).all() for x, y in zip(one[5:], other[5:]))
    assert whole[2][:5] == whole[4][:5] == (0, 0, 0, 0, "")


# -- spelling --------------------------------------------------------------------------------------------------------


def variants_by_force(rows):
    counts = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            word = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{word}".encode())
            if h % 199 == 0:
                word = word[: h % len(word)] + word[h % len(word) + 1 :]
            counts[word] += 1
    n = {w: c for w, c in counts.items() if c >= 5 and len(w) >= 6}

    def near(a, b):
        if a == b or abs(len(a) - len(b)) > 1:
            return False
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b)) == 1
        a, b = sorted((a, b), key=len)
        return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))

    forms, out = {}, {}
    for w in n:
        close = [x for x in n if near(w, x)]
        best = min(close, key=lambda x: (-n[x], x), default=None)
        forms[w] = best if best and n[best] >= 5 * n[w] else None
        out[w] = len(close)
    rows = set()
    for w in n:
        root = w
        while forms[root]:
            root = forms[root]
        rows.add((w, forms[w], root, n[w], out[w], n[forms[w]] if forms[w] else None))
    return rows


def spelled(rng):
    """Words with misspellings of misspellings, dealt over documents."""
    words = ["".join(rng.choices("aeinrstéçÿ÷", k=rng.randint(6, 9))) for _ in range(60)]
    pool = [w for w in words for _ in range(rng.choice([5, 40, 200]))]
    for w in words[:40]:
        at = rng.randrange(len(w))
        worse = rng.choice([w[:at] + w[at + 1 :], w[:at] + "x" + w[at:], w[:at] + "é" + w[at + 1 :]])
        pool += [worse] * rng.choice([5, 8, 40]) + [worse + "s"] * rng.choice([1, 5, 7]) + [worse[:-1] + "q"] * 6
    pool += ["rootword"] * 400 + ["rootwords"] * 60 + ["rootwordsz"] * 8
    rng.shuffle(pool)
    rows = [(i // 20, " ".join(pool[i : i + 20]).upper() if i % 3 else "-".join(pool[i : i + 20])) for i in range(0, len(pool), 20)]
    return rows + [rows[0], rows[0], (None, None), (None, rows[1][1]), (7, ""), (8, "a" * 70_000 + " " + "b" * 70_000)]


@pytest.mark.parametrize("tile, leaf, piece, held", [(20_000, 12, 1 << 20, 500_000), (7, 1, 50, 30)])
def test_variants_by_force(spark, monkeypatch, tile, leaf, piece, held):
    for name, value in (("TILE", tile), ("LEAF", leaf), ("PIECE", piece), ("HELD", held)):
        monkeypatch.setattr(spelling, name, value)
    rows = spelled(random.Random(5))
    df = spark.createDataFrame([(*r, 3, "n") for r in rows], "doc_id bigint, text string, n int, key string").repartition(4)
    found = spelling.spelling_variants(df).collect()
    wanted = variants_by_force(rows)
    assert set(map(tuple, found)) == wanted and len(found) == len(wanted)
    assert any(r.form and r.root != r.form for r in found)


def test_the_trie_finds_each_pair():
    rng = random.Random(6)
    words = list({"".join(rng.choices("aetzé🙂", k=rng.randint(3, 7))) for _ in range(900)})
    wanted = {(i, j) for i, x in enumerate(words) for j, y in enumerate(words) if spelling.one_apart(x, y)}
    found = [(int(i), int(j)) for a, b in spelling.search(words, words) for i, j in zip(a, b)]
    assert len(found) == len(set(found)) and set(found) == wanted and len(wanted) > 100


def test_variants_of_odd_rows(documents, nothing):
    rows = [(r.doc_id, r.text) for r in documents.select("doc_id", "text").collect()]
    assert set(map(tuple, spelling.spelling_variants(documents).collect())) == variants_by_force(rows)
    assert spelling.spelling_variants(nothing).count() == 0
