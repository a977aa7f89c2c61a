"""The whole pipeline in plain Python, for small tables."""

from __future__ import annotations

import hashlib
import re
import zlib

import numpy as np
import public_tokenizers
import xxhash
from tokenizers import Tokenizer


def fingerprint(text: bytes) -> int:
    words = text.lower().split()
    n = min(3, len(words))
    hashes = [xxhash.xxh64_intdigest(b" ".join(words[i : i + n]), 42) for i in range(len(words) - n + 1)] if words else []
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(n: int, linked: list[tuple[int, int]]) -> list[int]:
    label, changed = list(range(n)), True
    while changed:
        changed = False
        for i, j in linked:
            low = min(label[i], label[j])
            if label[i] != low or label[j] != low:
                label[i] = label[j] = low
                changed = True
    return label


def one_of_each_group(rows: list[dict]) -> list[dict]:
    prints = [fingerprint(r["text"].encode()) for r in rows]
    linked = [(i, j) for i in range(len(rows)) for j in range(i) if bin(prints[i] ^ prints[j]).count("1") <= 3]
    best: dict[int, dict] = {}
    for row, group in zip(rows, components(len(rows), linked)):
        if group not in best or row["doc_id"] < best[group]["doc_id"]:
            best[group] = row
    return list(best.values())


def words_of(text: str | None) -> list[str]:
    lower = "".join(c.lower() if c.isascii() else c for c in text or "")
    return re.findall(r"[0-9a-z\x80-\U0010ffff]+", lower)


def without_benchmark(rows: list[dict], items: list[str | None], width: int = 10) -> list[dict]:
    windows: dict[int, set] = {}
    for item in items:
        w = words_of(item)
        n = min(width, len(w))
        for i in range(len(w) - n + 1 if w else 0):
            windows.setdefault(n, set()).add(tuple(w[i : i + n]))

    def clean(text):
        w = words_of(text)
        return not any(tuple(w[i : i + n]) in found for n, found in windows.items() for i in range(len(w) - n + 1))

    return [r for r in rows if clean(r["text"])]


def mixed(rows: list[dict]) -> list[dict]:
    """Rows as often as the mix takes them: a threshold on ten hex digits of the id's MD5 in each source."""
    size = lambda r: len(re.findall(r"[^\x20\x09-\x0D]+", r["text"]))
    key = lambda r: hashlib.md5(str(r["doc_id"]).encode()).hexdigest()[:10]
    sources = sorted({r["source"] for r in rows}, key=lambda s: (s is None, (s or "").encode()))
    sizes = {s: sum(size(r) for r in rows if r["source"] == s) for s in sources}
    weight = {s: (5.0, 2.0, 1.0)[i % 3] for i, s in enumerate(sources)}
    capped: set = set()
    while True:
        free = [s for s in sources if s not in capped]
        level = (sum(sizes.values()) - sum(3 * sizes[s] for s in capped)) / sum(weight[s] for s in free)
        new = {s for s in free if 3 * sizes[s] <= weight[s] * level}
        if not new:
            break
        capped |= new
    out = []
    for s in sources:
        own = [r for r in rows if r["source"] == s]
        target = min(3.0 * sizes[s], weight[s] * level)
        whole = int(target // sizes[s]) if sizes[s] else 0
        rest, taken, upto = target - whole * sizes[s], set(), 0
        for k in sorted({key(r) for r in own}):
            part = sum(size(r) for r in own if key(r) == k)
            if upto + part > rest:
                if 2 * (rest - upto) >= part:
                    taken.add(k)
                break
            taken.add(k)
            upto += part
        for r in own:
            out += [r] * (whole + (key(r) in taken))
    return out


def token_rows(rows: list[dict]) -> list[tuple]:
    made = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    out, start = [], 0
    for r in sorted(rows, key=lambda r: r["doc_id"]):
        ids = made.encode(r["text"], add_special_tokens=False).ids + [2]
        out.append((r["doc_id"], start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def pipeline(rows: list[dict], items: list[str | None]) -> list[tuple]:
    rows = [r for r in rows if r["text"] is not None and any(map(str.isalpha, r["text"]))]
    return token_rows(mixed(without_benchmark(one_of_each_group(rows), items)))
