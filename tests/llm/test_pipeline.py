"""The stages against brute force on a small fixture."""

import random

import pytest

pipeline = pytest.importorskip("corpus_pipeline")


def test_stages(spark, tmp_path):
    rng = random.Random(4)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(300)] + ["the", "of", "and"] * 20
    prose = lambda n: " ".join(rng.choice(words) for _ in range(n))
    passage = prose(60)
    rows = [(i, prose(80), "en" if i % 3 else "fr", "s", 1) for i in range(40)]
    rows += [(50, rows[3][1], "en", "s", 1), (51, "too short", "en", "s", 1), (52, "bad% " * 50, "en", "s", 1), (53, None, None, None, None)]
    rows += [(60 + i, f"{prose(70)} {passage} {prose(70)}", "fr", "s", 1) for i in range(3)] + [(None, prose(90), None, "s", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    out = {}
    for name, stage in pipeline.STAGES:
        docs = stage(spark, docs, str(tmp_path))
        docs.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        out[name] = docs
        if name != "byte-level BPE":
            assert docs.columns == pipeline.COLUMNS
    ids = lambda k: [r["doc_id"] for r in out[k].select("doc_id").collect()]
    kept = {*range(40), 50, 60, 61, 62, None}
    assert set(ids("quality rules")) == kept and len(ids("quality rules")) == len(kept)
    assert set(ids("near-dedup")) == kept - {50}
    texts = {r["doc_id"]: r["text"] for r in out["suffix dedup"].collect()}
    assert passage in texts[60] and passage[110:-110] not in texts[61] and texts[5] == rows[5][1]
    assert set(ids("mixing")) == kept - {50} and len(ids("mixing")) >= len(kept) - 1
    last = out["byte-level BPE"].collect()
    assert len(last) == len(ids("mixing")) and all(r["exact"] and len(r["ids"]) == 4 * r["n_tokens"] for r in last)


def test_near_dedup_keeps_texts_of_a_repeated_id(spark, tmp_path):
    rng = random.Random(6)
    a, b, c = (" ".join(str(rng.randrange(1000)) for _ in range(60)) for _ in range(3))
    rows = [(1, a, "en", "s", 1), (1, b, "en", "s", 1), (1, b, "de", "s", 1), (2, a, "en", "s", 1), (3, c, "en", "s", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    out = pipeline.near_dedup(spark, docs, str(tmp_path)).collect()
    assert sorted((r["doc_id"], r["text"], r["lang"]) for r in out) == sorted([(1, a, "en"), (1, b, "de"), (3, c, "en")])
