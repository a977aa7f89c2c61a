"""How much of a short passage that two texts share is found."""

import random

from conftest import sentence

from tastemill.llm import chunks


def test_short_passages_are_found():
    rng = random.Random(16)
    share = missed = 0
    for _ in range(300):
        passage = sentence(rng, 60).encode()
        texts = [sentence(rng, 40 + rng.randrange(40)).encode() + b" " + passage + b" " + sentence(rng, 40).encode() for _ in range(2)]
        cuts = [list(zip([0, *e[:-1]], e)) for e in map(chunks.chunk_ends, texts)]
        own = {texts[0][a:b] for a, b in cuts[0]}
        at = texts[1].index(passage)
        got = sum(max(0, min(b, at + len(passage)) - max(a, at)) for a, b in cuts[1] if texts[1][a:b] in own)
        share += got / len(passage) / 300
        missed += not got
    assert share > 0.69 and missed <= 5, (share, missed)
