"""Each operator against a brute-force version, on rows with nulls, copies, ties and clashing names."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tastemill.llm import (
    chunks,
    decontaminate,
    language,
    lines,
    mixing,
    ngrams,
    simhash,
    suffixes,
    token_files,
    toxicity,
    vectors,
)
from tastemill.llm.components import connected_components
from tastemill.session import stored


def rows(df):
    return [tuple(r) for r in df.collect()]


def raw(df):
    return [(r.doc_id, (r.text or "").encode()) for r in df.collect()]


def components(n, linked):
    label = list(range(n))
    changed = True
    while changed:
        changed = False
        for i, j in linked:
            low = min(label[i], label[j])
            if label[i] != low or label[j] != low:
                label[i] = label[j] = low
                changed = True
    return label


# -- components ------------------------------------------------------------------------------------------------


def test_components_of_chains_and_stars(spark):
    rng = random.Random(1)
    pairs = [(i, i + 1) for i in range(40)] + [(100, 101 + i) for i in range(60)] + [(300 - i, 299) for i in range(20)]
    pairs += [(rng.randint(400, 440), rng.randint(400, 440)) for _ in range(25)] + [(7, 7), (None, 3)]
    found = dict(rows(connected_components(spark.createDataFrame(pairs, "a bigint, b bigint"))))
    clean = [(a, b) for a, b in pairs if a is not None and a != b]
    nodes = sorted({x for p in clean for x in p})
    at = {x: k for k, x in enumerate(nodes)}
    label = components(len(nodes), [(at[a], at[b]) for a, b in clean])
    assert found == {x: nodes[label[at[x]]] for x in nodes}


# -- line dedup ------------------------------------------------------------------------------------------------


def page(*lines):
    return "<html><head><style>x</style></head><body>" + "".join(f"<p>{x}</p>" for x in lines) + "</body></html>"


def test_lines_above_the_ratio_go(spark):
    data = [(i, "http://u@A.com:80/x", page("menu", f"own {i}", "half" if i % 2 else "rest")) for i in range(10)]
    data += [(20 + i, f"https://single{i}.org/", page("menu", "menu")) for i in range(5)]
    data += [(30, None, page("menu")), (31, "nonsense", page("menu")), (32, "http://a.com", None), (None, "http://a.com", "")]
    data += [(5, "http://u@A.com:80/x", page("menu", "own 5", "half"))]
    df = spark.createDataFrame(data, "page_id bigint, url string, html string").withColumn("host", F.lit("clash"))
    found = {(r.id, r.host): (r.lines, r.kept) for r in lines.line_dedup(df).collect()}
    # 13 pages of a.com: "menu" on 11, "half" on 6, "rest" on 5.
    assert found[0, "a.com"] == (["menu", "own 0", "rest"], ["own 0"])
    assert found[5, "a.com"][1] == ["own 5"]
    assert found[20, "single0.org"][1] == ["menu", "menu"]
    assert found[30, None][1] == ["menu"] and found[31, None][1] == ["menu"]
    assert found[32, "a.com"] == ([], []) and found[None, "a.com"] == ([], [])
    assert lines.line_dedup(df.limit(0)).count() == 0


# -- suffix and chunk dedup ------------------------------------------------------------------------------------


def test_suffix_array_by_linear_grouping():
    rng = random.Random(2)
    for _ in range(400):
        text = [rng.randint(1, rng.choice([1, 2, 4])) for _ in range(rng.randint(0, 30))] + [0]
        assert suffixes.suffix_array(text) == sorted(range(len(text)), key=lambda i: text[i:])


def removed_by_force(texts, length):
    seen = Counter(t[i : i + length] for _, t in texts for i in range(len(t) - length + 1))
    for doc, t in texts:
        gone = np.zeros(len(t), bool)
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                gone[i : i + length] = True
        kept = np.frombuffer(t, np.uint8)[~gone].tobytes()
        runs = int((np.diff(np.concatenate([[False], gone]).astype(int)) == 1).sum())
        yield doc, len(t), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest()


@pytest.mark.parametrize("hot", [4096, 3])
def test_suffix_dedup(spark, documents, nothing, monkeypatch, hot):
    monkeypatch.setattr(suffixes, "HOT", hot)
    rng = random.Random(3)
    shared = [bytes(rng.choices(b"abcd ", k=260)).decode() for _ in range(3)]
    extra = []
    for i in range(60):
        pick = rng.choice(shared)
        start, end = rng.randint(0, 60), rng.randint(200, 260)
        extra.append((1000 + i, bytes(rng.choices(b"xyz", k=rng.randint(0, 30))).decode() + pick[start:end] + "q" * rng.randint(0, 9)))
    extra += [(2000, "a" * 450), (2001, "ab" * 150), (2002, shared[0][:199]), (2003, shared[0][:200])]
    df = documents.select("doc_id", "text").union(spark.createDataFrame(extra, "doc_id bigint, text string"))
    found = sorted(rows(suffixes.suffix_dedup(df)), key=str)
    assert found == sorted(removed_by_force(raw(df), 200), key=str)
    assert suffixes.suffix_dedup(nothing).count() == 0


def test_chunks_do_not_cut_characters_and_survive_insertions():
    rng = random.Random(4)
    text = "".join(rng.choices("abcé ïzö\n", k=8000)).encode()
    ends = chunks.chunk_ends(text)
    parts = [text[a:b] for a, b in zip([0, *ends[:-1]], ends)]
    assert b"".join(parts) == text and all(p.decode() for p in parts)
    assert max(map(len, parts)) <= chunks.MOST and min(map(len, parts[:-1])) >= chunks.LEAST - 1
    moved = text[:3000].decode("utf-8", "ignore").encode() + b"inserted" + text[3001:].decode("utf-8", "ignore").encode()
    ends = chunks.chunk_ends(moved)
    again = {moved[a:b] for a, b in zip([0, *ends[:-1]], ends)}
    assert sum(p not in again for p in parts) <= 4
    assert chunks.chunk_ends(b"") == [] and chunks.chunk_ends(b"a" * 5000)[0] <= chunks.MOST


def test_chunk_dedup(documents, nothing):
    texts = raw(documents)
    cut = {t: [t[a:b] for e in [chunks.chunk_ends(t)] for a, b in zip([0, *e[:-1]], e)] for _, t in texts}
    count = Counter(c for _, t in texts for c in cut[t])
    found = {}
    for r in chunks.chunk_dedup(documents, keep_text=True).collect():
        found.setdefault(r.id, []).append(r)
    # One copy of each chunk stays; rows alike in id and text (60) are one text.
    seen = Counter()
    for own in found.values():
        for r in {(r.kept_sha256, bytes(r.kept)) for r in own}:
            seen.update([r[1]])
    for doc, t in texts:
        mine = [r for r in found[doc] if r.n_bytes == len(t)]
        assert mine and all(r.n_bytes - r.n_removed == len(r.kept) for r in mine)
        assert any(r.n_shared == sum(count[c] > 1 for c in cut[t]) for r in mine)
    assert found[0][0].n_removed == 0 and all(found[20 + i][0].n_removed == found[0][0].n_bytes for i in range(4))
    assert chunks.chunk_dedup(nothing).count() == 0


# -- mixing ----------------------------------------------------------------------------------------------------


def test_mix_comes_near_its_targets(spark, nothing):
    rng = random.Random(6)
    data = [(i, rng.choice(["a", "b", "b", "b", "c", "é", None]), rng.randint(0, 40)) for i in range(3000)]
    data += [(1, "a", None), (None, "b", 5), (7, "b", 3), (7, "b", 3), (8, "zero", 0)]
    df = stored(spark.createDataFrame(data, "doc_id bigint, source string, size bigint").withColumn("target", F.lit("clash")))
    found = mixing.mix(df).collect()
    assert len(found) == len(data)
    sizes = Counter()
    for _, s, n in data:
        sizes[s] += n or 0
    order = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None]
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    capped, total = set(), sum(sizes.values())
    while True:
        free = [s for s in order if s not in capped]
        level = (total - sum(3 * sizes[s] for s in capped)) / sum(weight[s] for s in free)
        new = {s for s in free if 3 * sizes[s] <= weight[s] * level}
        if not new:
            break
        capped |= new
    taken = Counter()
    for r in found:
        target = 3.0 * sizes[r.source] if r.source in capped else weight[r.source] * level
        assert r.mix_target == pytest.approx(target) and r.mix_source_size == sizes[r.source]
        assert 0 <= r.mix_copies <= 3 and r.target == "clash"
        taken[r.source] += (r.size or 0) * r.mix_copies
    for s in order:
        target = 3.0 * sizes[s] if s in capped else weight[s] * level
        assert abs(taken[s] - target) <= 45
    assert sorted(rows(mixing.mix(df)), key=str) == sorted(map(tuple, found), key=str)
    empty = stored(nothing.select("doc_id", "source", F.lit(1).alias("size")))
    assert mixing.mix(empty).count() == 0


def test_larger_budgets_keep_what_smaller_ones_took(spark):
    data = [(i, "ab"[i % 3 == 0], 10) for i in range(2000)]
    df = stored(spark.createDataFrame(data, "doc_id bigint, source string, size bigint"))
    kept = []
    for w in (1.0, 2.0, 3.0):
        weights = spark.createDataFrame([("a", w), ("b", 3.0)], "source string, weight double")
        kept.append({r.doc_id for r in mixing.mix(df, weights=weights).filter("source = 'a' and mix_copies > 0").collect()})
    assert kept[0] < kept[1] <= kept[2]


# -- classifiers -----------------------------------------------------------------------------------------------


def test_codewords_lie_apart():
    for n in (2, 3, 4, 7, 12):
        code = language.codewords(n)
        apart = [(a != b).sum() for i, a in enumerate(code) for b in code[:i]]
        assert min(apart) >= (1 if n == 2 else 2) and set(np.unique(code)) <= {-1, 1}


def test_language(spark, documents, nothing):
    rng = random.Random(7)
    styles = {"aa": ["bor", "ust", "emi"], "bb": ["zyx", "qwo", "vlj"], "cc": ["éta", "çou", "ïne"]}
    data = [
        (i, " ".join("".join(rng.choices(styles[g], k=2)) for _ in range(40)), g)
        for i, g in enumerate(rng.choices(list(styles), k=300))
    ]
    df = spark.createDataFrame(data, "doc_id bigint, text string, lang string")
    model = language.fit(df.filter("doc_id < 200"))
    assert model.languages == ["aa", "bb", "cc"]
    found = language.identify(df.filter("doc_id >= 200"), model).collect()
    assert np.mean([r.lang == r.lang_pred for r in found]) > 0.98
    odd = {(r.doc_id, r.text): r for r in language.identify(documents, model).collect()}
    assert len(odd) == documents.distinct().count()
    for key in [(40, None), (41, ""), (42, " \n\t "), (43, "123 ... !!"), (None, None)]:
        assert (odd[key].lang_pred, odd[key].score, odd[key].ambiguous) == ("und", 0.0, True)
    assert all(0 <= r.score <= 1 for r in odd.values())
    assert language.identify(nothing, model).count() == 0
    blank = language.fit(nothing)
    assert {r.lang_pred for r in language.identify(documents, blank).collect()} == {"und"}
    single = language.fit(df.filter("lang = 'aa'"))
    assert {r.lang_pred for r in language.identify(df, single).collect()} == {"aa"}


def test_subwords_are_the_same_in_long_and_short_runs(monkeypatch):
    rng = random.Random(8)
    text = " ".join("".join(rng.choices("abcdeé", k=rng.randint(1, 9))) for _ in range(400)).encode()
    whole = toxicity.bag(text)
    monkeypatch.setattr(ngrams, "CHUNK", 300)
    assert (toxicity.bag(text) == whole).all() and len(toxicity.bag(b"")) == 0


def test_toxicity(spark, documents, nothing):
    rng = random.Random(9)
    words = ["".join(rng.choices(["ta", "lo", "mi", "su", "re", "pa"], k=rng.randint(1, 3))) for _ in range(400)]
    data = []
    for i in range(700):
        own, bad = rng.choices(words, k=60), i % 4 == 0
        if bad:
            for _ in range(4):
                own[rng.randrange(60)] = rng.choice(["grunkwit", "grunkwitt", "vexhole", "vexholes"])
        data.append((i, " ".join(own), int(bad)))
    df = spark.createDataFrame(data, "doc_id bigint, text string, toxic int")
    model = toxicity.fit(df.filter("doc_id < 500"))
    found = toxicity.score(df.filter("doc_id >= 500"), model).collect()
    assert np.mean([r.predicted == r.toxic for r in found]) > 0.95
    unseen = spark.createDataFrame([(1, " ".join(words[:50] + ["grunkwitz", "vexholed", "grunkwits"]))], "doc_id bigint, text string")
    clean = spark.createDataFrame([(1, " ".join(words[:50]))], "doc_id bigint, text string")
    assert toxicity.score(unseen, model).first().score > toxicity.score(clean, model).first().score
    odd = toxicity.score(documents.drop("score"), model).collect()
    assert len(odd) == documents.count() and all(0 <= r.score <= 1 for r in odd)
    assert toxicity.score(nothing.drop("score"), model).count() == 0
    none = toxicity.fit(df.limit(0))
    assert {r.score for r in toxicity.score(df, none).collect()} == {0.5}
    assert {r.predicted for r in toxicity.score(df, toxicity.fit(df.filter("toxic = 0"))).collect()} == {0}


# -- decontamination -------------------------------------------------------------------------------------------


def contaminated_by_force(texts, items, width=10):
    words = lambda t: re.findall(r"[0-9a-z\x80-\U0010ffff]+", "".join(c.lower() if c.isascii() else c for c in t or ""))
    phrases = defaultdict(set)
    for item, t in items:
        w = words(t)
        for i in range(max(0, len(w) - width) + 1 if w else 0):
            phrases[tuple(w[i : i + width])].add(item)
    for doc, t in texts:
        w, hit, own = words(t), set(), set()
        for p, items_of in phrases.items():
            for i in range(len(w) - len(p) + 1):
                if tuple(w[i : i + len(p)]) == p:
                    hit |= set(range(i, i + len(p)))
                    own |= items_of
        ids = ",".join(sorted(str(i) for i in own if i is not None))
        yield doc, len(w), len(hit), len({i for i in own if i is not None}), hashlib.sha256(ids.encode()).hexdigest(), bool(hit)


def test_contamination(spark, documents, nothing):
    texts = [(r.doc_id, r.text) for r in documents.collect()]
    base = dict(texts)
    words = base[0].split()
    items = [(1, " ".join(words[5:30])), (2, "AB, ab?"), (3, None), (4, "..."), (5, "123"), (10, base[6].upper())]
    items += [(1, " ".join(words[30:44])), (6, "ÇA été"), (7, "ça Été"), (8, " ".join(base[7].split()[:10]))]
    more = [(500, base[7] + " ab-AB " + base[6][:200]), (501, "-".join(words[10:21])), (502, " ".join(words[10:19]))]
    df = documents.select("doc_id", "text").union(spark.createDataFrame(more, "doc_id bigint, text string"))
    df = df.withColumn("words", F.lit(1)).withColumn("term", F.lit(2)).withColumn("parts", F.lit(3))
    bench = spark.createDataFrame(items, "item_id bigint, text string").withColumn("phrase", F.lit("clash"))
    found = [tuple(r)[:1] + tuple(r)[2:] for r in decontaminate.contamination(df, bench).collect()]
    assert sorted(found, key=str) == sorted(contaminated_by_force(texts + more, items), key=str)
    assert not any(r.contaminated for r in decontaminate.contamination(df, bench.limit(0)).collect())
    assert decontaminate.contamination(nothing, bench).count() == 0


def test_proximity(spark):
    item = "one two rarely three four five six seldom eight nine"
    docs = [(1, item), (2, item.replace("three four", "three and four")), (3, "rarely then much later " + "x " * 30 + "seldom"), (4, None)]
    docs += [(10 + i, "one two three four five six eight nine") for i in range(5)]
    df = spark.createDataFrame(docs, "doc_id bigint, text string")
    bench = spark.createDataFrame([(9, item)], "item_id bigint, text string")
    assert sorted(rows(decontaminate.proximity_matches(df, bench))) == [(1, 9), (2, 9)]


# -- near copies -----------------------------------------------------------------------------------------------


def fingerprint_by_force(text):
    words = text.lower().split()
    n = min(3, len(words))
    hashes = [xxhash.xxh64_intdigest(b" ".join(words[i : i + n]), 42) for i in range(len(words) - n + 1)] if words else []
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_bit_sliced_comparison():
    rng = np.random.default_rng(10)
    base = rng.integers(0, 1 << 63, 30, dtype=np.uint64)
    made = np.concatenate([base] + [base ^ np.uint64(1 << int(b)) ^ np.uint64(1 << int(c)) for b, c in rng.integers(0, 63, (6, 2))])
    for radius in (0, 1, 2, 3, 5):
        expected = [[bin(int(a) ^ int(b)).count("1") <= radius for b in made] for a in made]
        assert (simhash.near(made, radius) == np.array(expected)).all()


@pytest.mark.parametrize("block", [1024, 8])
def test_simhash_groups(spark, documents, nothing, monkeypatch, block):
    monkeypatch.setattr(simhash, "BLOCK", block)
    data = [(r.doc_id, r.text) for r in documents.collect()]
    rng = random.Random(11)
    words = (documents.filter("doc_id = 50").first().text).split()[:4000]
    for i in range(40):  # a large group of near copies
        own = list(words)
        own[rng.randrange(len(own))] = f"w{i}"
        data.append((3000 + i, " ".join(own)))
    df = spark.createDataFrame(data, "doc_id bigint, text string")
    prints = [fingerprint_by_force((t or "").encode()) for _, t in data]
    linked = [(i, j) for i in range(len(data)) for j in range(i) if bin(prints[i] ^ prints[j]).count("1") <= 3]
    label = components(len(data), linked)
    low = {g: min((data[i][0] for i in range(len(data)) if label[i] == g and data[i][0] is not None), default=None) for g in set(label)}
    found = simhash.simhash_groups(df).collect()
    expected = sorted(((d, p, low[g]) for (d, _), p, g in zip(data, prints, label)), key=str)
    assert sorted(((r.id, r.fp % (1 << 64), r.component_id) for r in found), key=str) == expected
    stay = {(r.id, r.text_key) for r in found if r.first}
    assert len(stay) == len(low)
    assert simhash.simhash_groups(nothing).count() == 0


# -- token files -----------------------------------------------------------------------------------------------


def test_coding_round_trip():
    rng = np.random.default_rng(12)
    for n in (0, 1, 3, 4, 5, 1000):
        values = (rng.integers(0, 1 << 32, n, dtype=np.uint64) >> rng.integers(0, 32, n).astype(np.uint64)).astype("<u4")
        control, data = token_files.pack(values)
        assert len(control) == -(-n // 4) and (token_files.unpack(control, data, n) == values).all()


def test_token_files(spark, documents, nothing):
    path = public_tokenizers.path("byte_bpe_50k.json")
    made = Tokenizer.from_file(path)
    odd = ["  a  b", "\n\nx", "a \n b,", "x\t y", " a", "a ", "\n", "é.  ü\x85 x", "a\x1cb c", "1.,2 3.\n.", "<|endoftext|> it's"]
    more = spark.createDataFrame([(900 + i, t) for i, t in enumerate(odd)], "doc_id bigint, text string")
    df = documents.select("doc_id", "text").union(more)
    found = token_files.file_digests(spark, token_files.tokenize_to_files(df, path, 2)).orderBy("start").collect()
    texts = {(r.doc_id, r.text_key): r.text for r in df.withColumn("text_key", F.xxhash64("text")).collect()}
    assert len(found) == df.count()
    start, last = 0, -1
    for r in found:
        ids = made.encode(texts[r.id, r.text_key] or "", add_special_tokens=False).ids + [2]
        assert (r.start, r.n_tokens) == (start, len(ids)) and (r.id is None or r.id >= last)
        assert r.ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes())
        start, last = start + len(ids), -1 if r.id is None else r.id
    assert token_files.file_digests(spark, token_files.tokenize_to_files(nothing, path, 2)).count() == 0


# -- vectors ---------------------------------------------------------------------------------------------------


def test_groups_of_vectors_take_turns(spark, monkeypatch):
    """The links of a round are written, so its shuffle is gone; all of it used to lie on the disks at a time."""
    rng = np.random.default_rng(17)
    near = rng.normal(size=(60, 12)).repeat(3, axis=0) + rng.normal(size=(180, 12)) * rng.uniform(0.05, 0.4, (180, 1))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(near)], "vec_id bigint, embedding array<double>")
    unit = near / np.linalg.norm(near, axis=1, keepdims=True)
    links = (unit @ unit.T >= 0.9).sum(axis=1) - 1
    for name, value in (("PART", 8), ("COPIES", 1)):
        monkeypatch.setattr(vectors, name, value, raising=False)
    rows = vectors.unit_vectors(df).withColumn("copies", F.lit(1).cast("bigint"))
    plan = vectors.link_vectors(stored(rows), 0.9)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan parquet") > 1 and "Exchange" not in plan
    found = {r.id: r.n_links for r in vectors.vector_groups(df, "vec_id", "embedding", 0.9).collect()}
    assert found == dict(enumerate(links.tolist())) and sum(found.values())


def test_vector_groups(spark):
    rng = np.random.default_rng(13)
    base = rng.normal(size=(40, 12))
    near = base[:25].repeat(4, axis=0) + rng.normal(size=(100, 12)) * rng.uniform(0.05, 0.4, (100, 1))
    data = [(i, v.tolist()) for i, v in enumerate(np.concatenate([base, near, base[:3] * 7.5]))]
    data += [(500, None), (501, []), (502, [0.0] * 12), (503, [1.0, None] + [0.0] * 10), (504, [float("nan")] * 12)]
    data += [(505, [float("inf")] + [1.0] * 11), (506, [1.0, 0.0]), (507, [2.0, 0.1]), (508, [5.0]), (None, (base[0] * 2).tolist())]
    data += [(509, (base[1] * 1e300).tolist()), (510, (base[1] * 1e-300).tolist()), (506, [1.0, 0.0])]
    df = spark.createDataFrame(data, "vec_id bigint, embedding array<double>").withColumn("key", F.lit("clash"))
    units = []
    for _, v in data:
        ok = v and all(x is not None and np.isfinite(x) for x in v) and any(v)
        units.append(np.array(v) / np.abs(v).max() if ok else None)
    links = [
        (i, j)
        for i, a in enumerate(units)
        for j, b in enumerate(units)
        if i != j and a is not None and b is not None and len(a) == len(b) and a @ b / np.sqrt((a @ a) * (b @ b)) >= 0.9
    ]
    label = components(len(data), links)
    ids = [d[0] for d in data]
    low = {g: min((x for x, k in zip(ids, label) if k == g and x is not None), default=None) for g in set(label)}
    count = Counter(i for i, _ in links)
    expected = [(x, count[i], low[label[i]], x == low[label[i]]) for i, x in enumerate(ids)]
    assert sorted(rows(vectors.vector_groups(df)), key=str) == sorted(expected, key=str)
    assert vectors.vector_groups(df.limit(0)).count() == 0
