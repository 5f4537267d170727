import random
import re
from collections import Counter

import pytest

from graphquarry.llm import divergence
from graphquarry.llm.divergence import RadixTrie, source_divergence

TERM = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")


def plain(rows):
    docs = [(lang or "", source or "", [t.translate({c: c + 32 for c in range(65, 91)}) for t in TERM.findall(text or "")]) for lang, source, text in rows]
    out, groups = [], sorted({d[:2] for d in docs})
    scaled = lambda c, n, v: 1 + 10**9 * (c + 1) // (n + v)
    for lang in sorted({g[0] for g in groups}):
        held = Counter(t for a, _, ts in docs if a == lang for t in set(ts))
        kept = sorted((t for t, n in held.items() if n >= 3), key=str.encode)
        count = {s: Counter(t for d in docs if d[:2] == (lang, s) for t in d[2]) for a, s in groups if a == lang}
        of = lambda c: [scaled(c[t], sum(c[k] for k in kept), len(kept)) for t in kept]
        p, q = {s: of(c) for s, c in count.items()}, of(sum(count.values(), Counter()))
        f = lambda x, y: (x - y) ** 2 // y
        for s in count:
            pairs = [(o, sum(map(f, p[s], p[o]))) for o in count if o != s]
            terms = [(t, f(x, y)) for t, x, y in zip(kept, p[s], q, strict=True) if count[s][t] and x > y]
            for part, items, most in (("pair", pairs, None), ("term", terms, 200)):
                items = sorted(items, key=lambda x: (-x[1], x[0].encode()))[:most]
                out += [(lang, s, part, item, value, i + 1) for i, (item, value) in enumerate(items)]
    return sorted(out)


def odd_rows():
    rng = random.Random(8)
    stems = ["an", "ant", "anté", "straße", "Élan", "élan", "中文", "ÄB", "z" * 300, "\U0001f600x"]
    vocabulary = stems + [rng.choice(stems) + rng.choice("abcé") * rng.randint(1, 3) for _ in range(400)]
    rows = [(rng.choice(["en", "fr", None]), rng.choice(["a", "b", "c", None, "é"]), rng.choice([" ", "-", "\x00", "1"]).join(rng.choice(vocabulary[: rng.choice([8, 400])]) for _ in range(rng.randint(1, 60)))) for _ in range(200)]
    rows += [("en", "none", None), ("en", "empty", ""), ("de", "only", "rare words"), ("de", "other", "12 34"), ("xx", "alone", "a b")]
    return rows + [("en", "long", "An ANT " * 30_000)] + rows[:4]


@pytest.mark.parametrize("held,cells", [(10 << 20, 2_000_000), (400, 8)])
def test_divergence(spark, held, cells):
    """Also with tries that are written again and again, and pairs in stripes."""
    rows = odd_rows()
    docs = spark.createDataFrame([(i, *r, 1, "x") for i, r in enumerate(rows)], "doc_id long, lang string, source string, text string, term int, groups string").repartition(5)
    assert sorted(map(tuple, source_divergence(docs, held, cells).collect())) == plain(rows)


def test_empty_table(spark):
    assert source_divergence(spark.createDataFrame([], "lang string, source string, text string")).count() == 0


def test_scaled_is_exact_for_large_counts():
    import numpy as np

    for a, m in ((1, 3), (10**13 + 7, 10**14 + 9), (4 * 10**15, 9 * 10**15), (5, 5)):
        assert divergence._scaled(np.array([a], np.int64), np.int64(m))[0] == 1 + 10**9 * a // m


def test_radix_trie_walks_in_byte_order():
    rng, trie = random.Random(1), RadixTrie()
    terms = {bytes(rng.choice(b"ab\xc3\xa9") for _ in range(rng.randint(0, 6))) for _ in range(300)}
    for t in terms:
        trie.put(t, t)
    assert list(trie.walk()) == sorted(terms)
