"""Each operator against a brute-force version, and on nulls, empty, long and repeated rows, empty tables and clashing names."""

import base64
import hashlib
import random
import struct
import zlib
from functools import lru_cache

import numpy as np
import public_tokenizers as P
import pytest

from graphquarry.llm import bpe, language_id, mixing, quality_rules, site_quality, suffix_dedup, token_files, toxicity
from graphquarry.llm.common import connected_components
from graphquarry.llm.embedding_dedup import near_duplicate_vectors
from graphquarry.llm.near_dedup import near_duplicates
from graphquarry.llm.suffix_dedup import Family, repeated_spans

BASE = "doc_id long, text string, bands int, component_id int, h long, spans string"
RNG = random.Random(5)
WORDS = ["".join(RNG.choice("abcdefgh") for _ in range(RNG.randint(2, 7))) for _ in range(80)]


def prose(n, rng=RNG):
    return " ".join(rng.choice(WORDS) for _ in range(n))


@lru_cache(maxsize=1)  # the same texts at every call
def odd_docs():
    a, b = prose(60), prose(200)
    near = b.split()
    near[100] = "other"
    rows = [(1, a), (2, a), (3, None), (4, ""), (5, b), (6, " ".join(near)), (7, "one two"), (8, "ONE  two"), (9, " \n"), (None, a), (10, "é ñ 中文 " + a), (11, a + "\n" + b), (12, "ab" * 400), (13, prose(6000)), (14, b.upper()), (5, b)]
    return [(i, t, 1, 2, 3, "x") for i, t in rows]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(odd_docs(), BASE).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], BASE)


def shingles(text, k):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()


def groups(rows, k, percent):
    """id: smallest id reachable; rows of one id are one node."""
    sets, root = [(i, shingles(t, k)) for i, t in rows if i is not None], {i: i for i, _ in rows if i is not None}
    for a, s in sets:
        for b, t in sets:
            if a != b and s and t and 100 * len(s & t) >= percent * len(s | t):
                lo, hi = sorted((root[a], root[b]))
                root = {x: lo if y == hi else y for x, y in root.items()}
    return root


def test_near_duplicates(docs, none):
    out = near_duplicates(docs, k=4).collect()
    want = groups([(r[0], r[1]) for r in odd_docs()], 4, 80)
    assert len(out) == len(odd_docs())
    assert all(r["component_id"] == (want[r["doc_id"]] if r["doc_id"] is not None else None) for r in out)
    assert sorted((r["doc_id"] or 0, r["n_shingles"]) for r in out) == sorted((i or 0, len(shingles(t, 4))) for i, t, *_ in odd_docs())
    assert near_duplicates(none).count() == 0


def test_near_duplicates_of_one_template(spark):
    """Copies of one text at up to a fifth of its shingles: most are linked to it, some only to each other."""
    rng = random.Random(9)
    base, rows = prose(120, rng).split(), []
    for i in range(120):
        w = list(base)
        for _ in range(rng.randint(0, 7)):
            w[rng.randrange(len(w))] = rng.choice(WORDS) + "x"
        rows.append((i + 1, " ".join(w)))
    out = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), k=4).collect()
    want = groups(rows, 4, 80)
    assert sum(r["component_id"] != want[r["doc_id"]] for r in out) == 0


def test_near_duplicates_of_a_repeated_id(spark):
    """Doc 5 has a copy of doc 1's text and another text, which doc 7 nearly has and doc 8 has."""
    a, b = prose(60, random.Random(21)), prose(200, random.Random(22)).split()
    near = [*b[:100], "other", *b[101:]]
    rows = [(1, a), (5, a), (5, " ".join(b)), (7, " ".join(near)), (8, " ".join(b)), (9, prose(90, random.Random(23)))]
    out = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), k=4).collect()
    want = groups(rows, 4, 80)
    assert len(out) == len(rows) and {r["doc_id"]: r["component_id"] for r in out} == want == {1: 1, 5: 1, 7: 1, 8: 1, 9: 9}


def test_components(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(1, 40)] + [(50, 60), (60, 50), (70, 70)], "a long, b long")
    nodes = spark.createDataFrame([(i,) for i in [*range(1, 41), 50, 60, 70, 80]], "id long")
    got = dict(map(tuple, connected_components(nodes, edges).collect()))
    assert got == {**dict.fromkeys(range(1, 41), 1), 50: 50, 60: 50, 70: 70, 80: 80}


def brute_spans(rows, least):
    seen, out = set(), []
    for i, b in rows:
        cover = bytearray(len(b))
        own = []
        for p in range(len(b) - least + 1):
            w = b[p : p + least]
            if w in seen:
                cover[p : p + least] = b"\1" * least
            else:
                own.append(w)
                seen.add(w)
        out.append((i, bytes(x for x, c in zip(b, cover, strict=True) if not c)))
    return out


@pytest.mark.parametrize("hot", [50_000, 1])
def test_spans(docs, none, hot):
    got = sorted((r["doc_id"], bytes(r["kept"])) for r in repeated_spans(docs, 100, hot).collect() if r["doc_id"] is not None)
    rows = {(i, (t or "").encode()) for i, t, *_ in odd_docs() if i is not None}
    want = dict(brute_spans(sorted(rows), 100))
    assert all(want[i] == k for i, k in got) and len(got) == len(odd_docs()) - 1
    whole = next(r for r in repeated_spans(docs, 100).collect() if r["doc_id"] is None)
    assert whole["spans"] == [] and len(whole["kept"]) == whole["n_bytes"]
    assert repeated_spans(none).count() == 0


def test_spans_carry_and_cut_characters(spark):
    a = "é" * 80
    d = spark.createDataFrame([(1, a, "x"), (2, "z" + a + "w", "y")], "doc_id long, text string, lang string")
    out = {r["doc_id"]: r for r in repeated_spans(d, 100, carry=("lang",), texts=True).collect()}
    assert out[2]["carried"]["lang"] == "y" and out[2]["kept_text"] == "zw"


def test_family_keeps_geometric_levels(monkeypatch):
    """Suffixes in order, matches found by bytes, levels that at least halve; stretches of every level are crossed."""
    monkeypatch.setattr(suffix_dedup, "STEP", 16)
    rng, f, seen = np.random.default_rng(1), Family(6), set()
    for _ in range(40):
        text = rng.integers(97, 100, 200).astype(np.uint8)
        text[rng.integers(0, 200, 9)] = 0
        at = np.flatnonzero(rng.random(195) < 0.8)
        want = []
        for k in (text[i : i + 6].tobytes() for i in at):
            want.append(k in seen)
            seen.add(k)
        assert f.add(text, at).tolist() == want
        sizes = [len(x) for x in f.levels]
        assert all(a > b for a, b in zip(sizes, sizes[1:])) and sum(sizes) == len(seen)
        for x in f.levels:
            own = [x.text[i : i + 6].tobytes() for i in x.at]
            assert own == sorted(own)


def test_segments_are_the_same_in_any_pieces(monkeypatch):
    raw = [prose(400, random.Random(i)).encode() for i in range(3)] + [b"", b"ab" * 300]
    whole = sorted(zip(*(x.tolist() for x in suffix_dedup.segments(raw, 100)), strict=True))
    starts = lambda s: sorted((t, a + i, h) for t, a, n, h, _ in s for i in range(n))
    monkeypatch.setattr(suffix_dedup, "PIECE", 300)
    assert starts(zip(*(x.tolist() for x in suffix_dedup.segments(raw, 100)), strict=True)) == starts(whole)


def test_spans_across_pieces_and_batches(spark, monkeypatch):
    """Texts over every bound: pieces scanned at once, index batches, stretches of a merge, texts remembered."""
    for name, n in {"PIECE": 700, "BATCH": 3000, "STEP": 50, "FAMILY": 4000, "REMEMBERED": 3}.items():
        monkeypatch.setattr(suffix_dedup, name, n)
    rng = random.Random(31)
    base = [prose(300, rng) for _ in range(4)]
    rows = []
    for i in range(60):
        w = (base[i % 4] + " " + prose(60, rng)).split()
        for _ in range(i % 9):
            w[rng.randrange(len(w))] = prose(1, rng) + "q"
        rows.append((i, " ".join(w[rng.randrange(20) :])))
    got = {r["doc_id"]: bytes(r["kept"]) for r in repeated_spans(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == dict(brute_spans([(i, t.encode()) for i, t in rows], 100))


ODD = ["", "a", " a  b\n\n c\t", "it's he'll 12,3.4..., !!", "中文　é​x", "a" * 3000, "\0\1\2\3 x, y", "<|endoftext|> x", "x ,y .z", "\x1c\x85y", "a\n b", "a \nb", "été\nÉté,x.y z\nab"]


def test_bpe_equals_tiktoken(spark, docs, none):
    import tiktoken

    path = P.path("byte_bpe_50k.tiktoken")
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    own = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    _, text = bpe.load(path, P.PATTERN)
    rng = random.Random(2)
    texts = ODD + ["".join(rng.choice("ab 's.,\n\té中1!") for _ in range(rng.randint(0, 40))) for _ in range(3000)]
    for t, got in zip(texts, text.encode(texts), strict=True):
        assert list(np.frombuffer(got, "<u4")) == own.encode_ordinary(t)
        assert bpe.decode_ids(got, path, P.PATTERN) == t.encode()
    out = bpe.encode_documents(docs, path, P.PATTERN, decode=True).collect()
    assert len(out) == len(odd_docs()) and all(len(r["ids"]) == 4 * len(own.encode_ordinary(t or "")) for r, (_, t, *_) in zip(out, odd_docs(), strict=True))
    assert bpe.encode_documents(none, path, P.PATTERN).count() == 0


def test_token_files(spark, docs, none):
    from tokenizers import Tokenizer

    path = P.path("byte_bpe_50k.json")
    t = Tokenizer.from_file(path)
    assert t.encode(ODD[7], add_special_tokens=False).ids[0] == 50256
    more = spark.createDataFrame([(100 + i, x, 1, 2, 3, "x") for i, x in enumerate(ODD)], BASE)
    folder = token_files.write_tokens(docs.union(more), path, partitions=3)
    got = sorted(((r["doc_id"] is not None, r["doc_id"] or 0, r["start"]), bytes(r["ids"])) for r in token_files.read_tokens(spark, folder).collect())
    rows = sorted(((i is not None, i or 0, x or "") for i, x, *_ in odd_docs() + [(100 + i, x) for i, x in enumerate(ODD)]))
    at = 0
    for (key, ids), (known, i, x) in zip(got, rows, strict=True):
        want = t.encode(x, add_special_tokens=False).ids + [0]
        assert key == (known, i, at) and zlib.crc32(ids) == zlib.crc32(struct.pack(f"<{len(want)}I", *want))
        at += len(want)
    found = token_files.lookup(spark, folder, spark.createDataFrame([(7,), (999,), (13,)], "doc_id long")).collect()
    assert sorted(r["doc_id"] for r in found) == [7, 13]
    assert token_files.read_tokens(spark, token_files.write_tokens(none, path)).count() == 0


def test_minimal_perfect_hash():
    keys = np.unique(np.random.default_rng(4).integers(-(1 << 60), 1 << 60, 5000))
    index = token_files.build_index(keys)
    assert len(index[1]) == len(keys) and (token_files.find(keys, *index) == np.arange(len(keys))).all()
    assert (token_files.find(keys + 1, *index) >= 0).mean() < 0.01


def test_minimal_perfect_hash_tries_many_seeds_at_once(monkeypatch):
    calls, own = [], token_files._hash
    monkeypatch.setattr(token_files, "_hash", lambda k, seed: calls.append(1) or own(k, seed))
    keys = np.arange(720)
    index = token_files.build_index(keys)
    assert len(calls) < 2 * len(keys)  # a seed at a time needs tens of thousands
    assert (token_files.find(keys, *index) == keys).all()


def test_quality_rules_equal_sql(spark, docs, none):
    import duckdb

    documents = docs.select("doc_id", "text").toPandas()
    documents["doc_id"] = documents["doc_id"].fillna(-1).astype("int64")
    got = quality_rules.quality_rules(docs).toPandas().fillna({"doc_id": -1})
    want = duckdb.sql(quality_rules.oracle_sql()).df()[got.columns.tolist()]
    text = lambda d: sorted(tuple(map(str, map(int, r))) for r in d.itertuples(index=False))
    assert text(got) == text(want)
    assert quality_rules.quality_rules(none).count() == 0
    assert documents is not None


def test_vectors(spark):
    rng = np.random.default_rng(6)
    x = rng.standard_normal((60, 16))
    x[1], x[2], x[3] = x[0], 3 * x[0], x[0] + 0.02 * rng.standard_normal(16)
    x[10:40] = x[10] + 0.05 * rng.standard_normal((30, 16))
    rows = [(i, [float(v) for v in r], int(i % 5 == 4)) for i, r in enumerate(x)]
    rows += [(100, None, 0), (101, [], 0), (102, [0.0] * 16, 0), (103, [None] + [1.0] * 15, 0), (104, [float("nan")] * 16, 0), (105, [float(v) for v in x[0]], None), (106, [1.0] * 8, 0), (None, [float(v) for v in x[0]], 0), (107, [float(v) * 1e-200 for v in x[0]], 0)]
    out = {r["vec_id"]: r for r in near_duplicate_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()}
    good = {i: (np.array(v), y) for i, v, y in rows if i is not None and (i < 100 or i == 107)}
    good[107] = (x[0], 0)
    root = {i: i for i in good}
    for i, (a, y) in good.items():
        n = 0
        for j, (b, z) in good.items():
            if i != j and y == z and a @ b / np.sqrt((a @ a) * (b @ b)) >= 0.98:
                n += 1
                lo, hi = sorted((root[i], root[j]))
                root = {p: lo if q == hi else q for p, q in root.items()}
        assert out[i]["n_links"] == n
    assert all(out[i]["component_id"] == root[i] for i in good) and all(out[i]["n_links"] == 0 for i in range(100, 107)) and out[None]["kept"]
    assert near_duplicate_vectors(spark.createDataFrame([], "vec_id long, embedding array<double>, label int")).count() == 0


def test_mixing_meets_targets(spark, none):
    en = "the cat of the house is on that and for this be at by "
    fr = "le chat de la maison est dans une qui pour sur et les des "
    rows = [(i, (en if i % 4 else fr) * (1 + i % 7), "en" if i % 4 else "fr") for i in range(400)] + [(900, None, "en"), (901, "", None)]
    d = spark.createDataFrame(rows, "doc_id long, text string, domain string")
    out = mixing.mix_to_targets(d, d.select("doc_id", "domain"), {"en": 0.5, "fr": 0.5})
    r = out.toPandas()
    p = np.stack(r["p"]) * (r["n_tokens"] * r["rate"]).to_numpy()[:, None]
    assert np.allclose(p.sum(0) / p.sum(), 0.5, atol=0.01) and (r["rate"] >= 0).all() and len(r) == len(rows) and (r["copies"] >= 1).all()
    assert mixing.mix_to_targets(none, none.select("doc_id", none["text"].alias("domain"))).count() == 0


def test_languages(spark, none):
    rng = random.Random(8)
    word = {"x": lambda: "".join(rng.choice("aeiou") + rng.choice("kmn") for _ in range(3)), "y": lambda: "".join(rng.choice("äöü") + rng.choice("szt") for _ in range(3))}
    text = lambda lang, n: " ".join(word[lang]() for _ in range(n))
    train = spark.createDataFrame([(lang, text(lang, 50)) for lang in "xy" for _ in range(30)] + [(None, "q"), ("x", None)], "lang string, text string")
    langs, log_p = language_id.learn(train)
    rows = [(1, text("x", 30)), (2, text("y", 30)), (3, None), (4, "12 !?"), (5, text("x", 60) + " " + text("y", 200)), (6, ""), (7, "Ä")]
    out = {r["doc_id"]: r for r in language_id.identify(spark.createDataFrame(rows, "doc_id long, text string"), langs, log_p).collect()}
    assert [out[i]["lang_pred"] for i in (1, 2, 3, 4, 5, 6)] == ["x", "y", "und", "und", "y", "und"]
    assert out[5]["languages"] == ["x", "y"] and 0.6 < out[5]["score"] < 0.9 and out[1]["languages"] == ["x"] and out[7]["lang_pred"] in ("x", "y")
    langs, log_p = language_id.learn(train.where("false"))
    assert langs == [] and {r["lang_pred"] for r in language_id.identify(spark.createDataFrame(rows, "doc_id long, text string"), langs, log_p).collect()} == {"und"}


def test_toxicity(spark, none):
    rng = random.Random(3)
    rows = [(i, prose(40, rng) + (" vile" + rng.choice(["ness", "r", ""]) if i % 4 == 0 else ""), int(i % 4 == 0)) for i in range(400)] + [(500, None, 0), (501, "vile", None)]
    d = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    index = toxicity.learn(d, d)
    out = {r["doc_id"]: r for r in toxicity.score(d.select("doc_id", "text"), index).collect()}
    assert all(out[i]["predicted"] == int(i % 4 == 0) for i in range(400)) and 0 <= out[500]["score"] < 0.7 and out[501]["predicted"] == 1 and out[0]["evidence"]
    empty = toxicity.learn(d, d.where("false"))
    assert {r["score"] for r in toxicity.score(d.select("doc_id", "text"), empty).collect()} == {0.0}
    assert toxicity.score(none.select("doc_id", "text"), index).count() == 0
    clash = toxicity.score(d.select("doc_id", "text", d["toxic"].alias("score"), d["toxic"].alias("_w")), index)
    assert clash.columns == ["doc_id", "_w", "score", "predicted", "evidence"] and clash.select("score").first()["score"] > 0


def test_toxicity_of_rare_words(spark):
    """Toxic words that are each in five rows only still decide, clean rows vote, and every text is searched."""
    rng = random.Random(12)
    rows = [(i, prose(30, rng) + (f" zz{'abcdefghij'[i % 10]}yq" if i < 50 else ""), int(i < 50)) for i in range(500)]
    docs = spark.createDataFrame([(1000 + k, f"{prose(12, rng)} zz{'abcdefghij'[k]}yq", None) for k in range(10)] + [(2000 + k, prose(30, rng), None) for k in range(10)], "doc_id long, text string, toxic int")
    labelled = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    index = toxicity.learn(labelled.union(docs), labelled)
    out = {r["doc_id"]: r for r in toxicity.score(docs.select("doc_id", "text"), index).collect()}
    assert all(out[1000 + k]["predicted"] == 1 and out[2000 + k]["predicted"] == 0 for k in range(10))
    assert all(r["evidence"] for r in out.values()) and len(index.ids) == 500
    at = index.number[b"zzayq"]
    assert index.idf[at] > 0 and len(index.number) > len(WORDS)


def test_toxicity_keeps_label_shares(spark, monkeypatch):
    """Above the bound the examples are as often toxic as the labelled rows, so votes mean the same at every size."""
    monkeypatch.setattr(toxicity, "EXAMPLES", 50)
    rng = random.Random(13)
    rows = [(i, prose(20, rng), int(i % 10 == 0)) for i in range(600)]
    d = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    index = toxicity.learn(d, d)
    assert len(index.ids) == 100 and index.label.mean() < 0.25 and index.base == index.label.mean()


def test_site_quality(spark, none):
    good, bad = "the of and to is that " * 5, "x%% y$$ z** !! " * 8
    rows = [(i, (bad if i % 3 == 0 else good) + str(i), f"h{i % 4}" if i % 5 else None, "p") for i in range(240)] + [(900, None, "h0", None)]
    d = spark.createDataFrame(rows, "doc_id long, text string, host string, path string")
    labels = spark.createDataFrame([(i, int(i % 3 != 0)) for i in range(0, 240, 2)] + [(2, None)], "doc_id long, quality int")
    out = {r["doc_id"]: r for r in site_quality.site_quality(d, labels).collect()}
    assert len(out) == len(rows) and all(out[i]["kept"] == (i % 3 != 0) for i in range(240))
    assert {r["score"] for r in site_quality.site_quality(d, labels.where("false")).collect()} == {0.5}


def test_digest_columns(spark):
    from graphquarry.llm.queries import op10_byte_bpe

    r = op10_byte_bpe(spark, "/root/testdata/sf0.001").first()
    assert len(r["ids_sha256"]) == len(hashlib.sha256().hexdigest()) and r["n_tokens"] > 0


def test_empty_tables(spark, none):
    """An empty table gives an empty result of the usual columns."""
    texts = none.select("doc_id", "text")
    assert language_id.identify(texts, ["x"], np.zeros((1, language_id.BUCKETS))).count() == 0
    sites = none.select("doc_id", "text", none["spans"].alias("host"), none["spans"].alias("path"))
    out = site_quality.site_quality(sites, none.select("doc_id", none["bands"].alias("quality")))
    assert out.count() == 0 and "score" in out.columns
    assert toxicity.score(texts, toxicity.learn(texts, none.select("doc_id", none["bands"].alias("toxic")))).count() == 0
    assert bpe.encode_documents(none, P.path("byte_bpe_50k.tiktoken"), P.PATTERN, decode=True).count() == 0


def test_clashing_names(spark):
    """Columns named like a result are replaced, others stay, whatever they are called."""
    d = spark.createDataFrame([(1, "the cat " * 30, "a", "b", "c", "d", "e", 5)], "doc_id long, text string, ids string, Decoded string, score string, _t string, _w string, N_WORDS int")
    out = bpe.encode_documents(d, P.path("byte_bpe_50k.tiktoken"), P.PATTERN, decode=True)
    assert out.columns == ["doc_id", "score", "_t", "_w", "N_WORDS", "ids", "decoded"] and bytes(out.select("decoded").first()[0]) == b"the cat " * 30
    found = language_id.identify(d, ["x"], np.zeros((1, language_id.BUCKETS)))
    assert found.select("score", "_w", "ids").first() == (1.0, "e", "a")
    m = quality_rules.measure(d).first().asDict()
    assert m["n_words"] == 60 and m["_t"] == "d" and m["_w"] == "e" and m["ids"] == "a" and "N_WORDS" not in m
    assert near_duplicates(d).columns == ["doc_id", "n_shingles", "component_id", "kept"]
    assert mixing.mix_to_targets(d, d.select("doc_id", d["score"].alias("domain"))).first()["n_tokens"] == 60


def test_very_long_texts(spark):
    """Texts over every bound of what is handled at once give what shorter ones do."""
    long = " ".join(prose(2000, random.Random(k)) for k in range(130))  # over a megabyte
    assert len(long) > 1 << 20
    d = spark.createDataFrame([(1, long), (2, long + " more"), (3, "a b c d e f")], "doc_id long, text string")
    out = {r["doc_id"]: r for r in near_duplicates(d, k=4).collect()}
    assert out[2]["component_id"] == 1 and out[1]["n_shingles"] == len(shingles(long, 4))
    ids = {r["doc_id"]: bytes(r["decoded"]) for r in bpe.encode_documents(d, P.path("byte_bpe_50k.tiktoken"), P.PATTERN, decode=True).collect()}
    assert ids[1] == long.encode() and ids[2].endswith(b" more")
    folder = token_files.write_tokens(d, P.path("byte_bpe_50k.json"))
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    got = {r["doc_id"]: r["n_tokens"] for r in token_files.read_tokens(spark, folder).collect()}
    assert got[1] == len(t.encode(long, add_special_tokens=False).ids) + 1
    spans = {r["doc_id"]: bytes(r["kept"]) for r in repeated_spans(d, 100).collect()}
    assert spans == dict(brute_spans([(1, long.encode()), (2, (long + " more").encode()), (3, b"a b c d e f")], 100))


def test_mixing_learns_any_domains(spark):
    """Invented domains that no list of words knows."""
    rng = random.Random(17)
    words = {k: ["".join(rng.choice(k) for _ in range(4)) for _ in range(15)] for k in ("abcd", "efgh", "ijkl")}
    rows = [(i, " ".join(rng.choice(words[k]) for _ in range(30)), k) for i in range(300) for k in [("abcd", "efgh", "ijkl")[min(2, i % 5)]]]
    d = spark.createDataFrame(rows, "doc_id long, text string, domain string")
    want = {"abcd": 0.2, "efgh": 0.5, "ijkl": 0.3}
    r = mixing.mix_to_targets(d, d.select("doc_id", "domain").where("doc_id % 2 = 0"), want).toPandas().sort_values("doc_id")
    p = np.stack(r["p"])
    assert [r["domains"].iloc[0][i] for i in p.argmax(1)] == [k for _, _, k in rows]
    total = (p * (r["n_tokens"] * r["rate"]).to_numpy()[:, None]).sum(0)
    assert np.allclose(total / total.sum(), [want[k] for k in r["domains"].iloc[0]], atol=0.01)
