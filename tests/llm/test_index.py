import numpy as np

from graphquarry.llm.toxicity import NEAREST, Index, Numbers, terms_of, words_of


def test_block_max_search_is_exact():
    rng = np.random.default_rng(3)
    terms = [b"t%d" % i for i in range(12)]
    rows = [(i, {int(t): int(rng.integers(1, 4)) for t in rng.choice(12, rng.integers(1, 3), replace=False)}) for i in range(500)]
    df = np.array([sum(t in r for _, r in rows) for t in range(12)], float)
    index = Index(terms, df, 500, rows, rng.integers(0, 2, 500).astype(float), 0.1)
    vectors = [index.weigh(r) for _, r in rows]
    for _ in range(40):
        q = index.weigh({int(t): int(rng.integers(1, 4)) for t in rng.choice(12, rng.integers(1, 4), replace=False)})
        full = sorted((-round(sum(w * v.get(t, 0.0) for t, w in q.items()), 12), i) for i, v in enumerate(vectors))
        want = [(i, -s) for s, i in full if s < 0][:NEAREST]
        got = index.nearest(q)
        assert [a for _, a in got] == [i for i, _ in want]
        assert np.allclose([s for s, _ in got], [s for _, s in want])


def test_search_with_common_and_rare_terms_is_exact():
    """Lists and table together, several queries at once."""
    rng = np.random.default_rng(4)
    rows = [(i, {int(t): int(rng.integers(1, 4)) for t in {*rng.choice(5, 2), *rng.choice(np.arange(5, 300), 3)}}) for i in range(700)]
    df = np.array([sum(t in r for _, r in rows) for t in range(300)], float)
    index = Index([b"t%d" % i for i in range(300)], df, 700, rows, rng.integers(0, 2, 700).astype(float), 0.1)
    vectors = [index.weigh(r) for _, r in rows]
    queries = [index.weigh(r) for _, r in rows[:60]] + [index.weigh({7: 1}), index.weigh({0: 1})]
    for q, got in zip(queries, index.search([(np.array(list(q)), np.array(list(q.values()))) for q in queries]), strict=True):
        full = sorted((-round(sum(w * v.get(t, 0.0) for t, w in q.items()), 12), i) for i, v in enumerate(vectors))
        want = [(i, -s) for s, i in full if s < 0][:NEAREST]
        assert [a for _, a in got] == [i for i, _ in want] and np.allclose([s for s, _ in got], [s for _, s in want])


def test_search_over_clusters_is_exact():
    """Examples of several vocabularies, more than a cluster's bound: blocks of other clusters may stay shut, none that counts does."""
    rng = np.random.default_rng(5)
    rows = [(i, {int(t): int(rng.integers(1, 4)) for t in {*rng.choice(8, 2), *(100 * (i % 4) + 8 + rng.choice(90, 12))}}) for i in range(900)]
    df = np.array([sum(t in r for _, r in rows) for t in range(420)], float)
    index = Index([b"t%d" % i for i in range(420)], df, 900, rows, rng.integers(0, 2, 900).astype(float), 0.5)
    assert len(set(index.cluster.tolist())) > 1
    vectors = [index.weigh(r) for _, r in rows]
    queries = [index.weigh(r) for _, r in rows[:150]] + [index.weigh({1: 1}), index.weigh({8: 1, 108: 2})]
    for q, got in zip(queries, index.search([(np.array(list(q)), np.array(list(q.values()))) for q in queries]), strict=True):
        full = sorted((-round(sum(w * v.get(t, 0.0) for t, w in q.items()), 12), i) for i, v in enumerate(vectors))
        want = [(i, -s) for s, i in full if s < 0][:NEAREST]
        assert [a for _, a in got] == [i for i, _ in want] and np.allclose([s for s, _ in got], [s for _, s in want])


def test_votes_are_calibrated():
    """Where neighbours tell, votes of held-out texts near 0 and 1 are as often toxic as they say."""
    rng = np.random.default_rng(6)
    make = lambda i: {int(t): 1 for t in {*rng.choice(50, 6), *([50 + rng.integers(3)] if i % 3 == 0 else [])}}
    rows = [(i, make(i)) for i in range(400)]
    label = np.array([float(i % 3 == 0) for i in range(400)])
    df = np.array([sum(t in r for _, r in rows) for t in range(53)], float)
    index = Index([b"t%d" % i for i in range(53)], df, 400, rows, label, float(label.mean()))
    index.calibrate()
    assert index.scale and index.scale[0] > 0


def test_terms_of_a_batch_are_looked_up_once():
    texts = ["Große Häuser, große; STRASSEN strassenbahn " * 40, None, "", "\n 12 !", "großer strassen été\x00été naïveté \ud800x", "zz " * 500 + "straßen"]
    terms = sorted({t for x in texts[::2] for t in terms_of(words_of(x))})
    numbers, asked = Numbers({t: i for i, t in enumerate(terms)}), []
    own = numbers.word
    numbers.word = lambda *a: asked.append(a[0]) or own(*a)
    got = numbers.counts(texts)
    for x, (at, n) in zip(texts, got, strict=True):
        want = sorted((terms.index(t), k) for t, k in terms_of(words_of(x)).items() if t in terms)
        assert list(zip(at.tolist(), n.tolist(), strict=True)) == want
    assert len(asked) == len(set(asked)) and numbers.counts([]) == []
