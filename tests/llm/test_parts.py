"""The shared parts: components and the filter."""

import random

import numpy as np

from quern.llm import bloom
from quern.llm.common import Scratch
from quern.llm.components import components


def test_components(spark):
    r = random.Random(9)
    edges = [(r.randrange(200), r.randrange(200)) for _ in range(110)]
    edges += [(1000 + i, 1001 + i) for i in range(60)]
    chain = list(range(3000, 3060))
    r.shuffle(chain)
    edges += list(zip(chain, chain[1:], strict=False)) + [(5000, 5000 + i) for i in range(1, 40)] + [(7, 7)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    got = {x.node: x.component for x in components(spark.createDataFrame(edges, "a bigint, b bigint"), Scratch(spark, "t")).collect()}
    assert got == {x: find(x) for e in edges for x in e if e[0] != e[1]}
    assert components(spark.createDataFrame([], "a bigint, b bigint"), Scratch(spark, "t")).count() == 0


def test_filter(spark):
    r = np.random.default_rng(2)
    inside, outside = r.integers(-(2**63), 2**63, 3000), r.integers(-(2**63), 2**63, 30_000)
    b = bloom.build(spark.createDataFrame([(int(x),) for x in inside], "h bigint"), "h")
    assert b.has(inside.view(np.uint64)).all() and b.has(outside.view(np.uint64)).mean() < 0.05
    assert not bloom.build(spark.createDataFrame([], "h bigint"), "h").has(inside.view(np.uint64)).any()


def test_words_of_one_form_differ():
    """Thue and Morse's word and its complement have equal sums under any polynomial modulo 2**64."""
    import numpy as np

    from quern.llm.common import Words

    word = "a"
    while len(word) < 4096:
        word += word.translate(str.maketrans("ab", "ba"))
    other = word.translate(str.maketrans("ab", "ba"))
    texts = [word, other, word, word[:64] + other[64:], "ab", "ba"]
    raw = np.frombuffer(" ".join(texts).encode(), np.uint8)
    h = Words(raw, np.array([0, len(raw)])).hash.tolist()
    assert h[0] == h[2] and len(set(h)) == 5
