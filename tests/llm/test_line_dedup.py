import random
from collections import Counter

import pytest

from graphquarry.llm.line_dedup import LineIndex, dedup_lines

UPPER = {c: c + 32 for c in range(65, 91)}
SPACE = " \t\n\x0b\x0c\r"


def plain(texts, least):
    lines = [(t or "").split("\n") for t in texts]
    key = lambda x: x.strip(SPACE).translate(UPPER)
    seen = Counter(k for ls in lines for k in {key(x) for x in ls} if k)
    out = []
    for ls in lines:
        kept = [x for x in ls if not key(x) or seen[key(x)] < least]
        out.append((len(ls), len(ls) - len(kept), "\n".join(kept)))
    return out


def odd_texts():
    rng = random.Random(3)
    common = ["Home | About", "  home | ABOUT\t", "É a", "é a", "x", " ", "", "a\x0bb", "中文 line"]
    rows = ["\n".join(rng.choice(common) if rng.random() < 0.6 else f"own {rng.random()}" for _ in range(rng.randint(1, 9))) for _ in range(90)]
    rows += [None, "", "\n", "\n\n", " \r\n x ", "x", "x\nx\nX", "\n".join(["x", "only here"] * 20_000), "É a\n", " x"]
    return rows + rows[:5]


@pytest.mark.parametrize("least,batches", [(10, 8), (1, 3), (2, 1), (40, 2)])
def test_line_dedup(spark, least, batches):
    texts = odd_texts()
    docs = spark.createDataFrame([(i if i % 11 else None, t, "a", 1) for i, t in enumerate(texts)], "doc_id long, text string, line string, places int")
    got = dedup_lines(docs, least, batches).collect()
    want = [(i if i % 11 else None, *r) for i, r in enumerate(plain(texts, least))]
    order = lambda r: (r[0] is None, r[0] or 0, *r[1:])
    assert sorted(map(tuple, got), key=order) == sorted(want, key=order)


def test_empty_table_and_equal_rows(spark):
    assert dedup_lines(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    same = spark.createDataFrame([(7, "a\nb")] * 10, "doc_id long, text string")
    assert {tuple(r) for r in dedup_lines(same, 10, 4).collect()} == {(7, 2, 2, "")} and dedup_lines(same, 11, 4).where("n_dropped > 0").count() == 0


def test_runs_are_merged_by_level_without_a_shuffle(spark):
    index = LineIndex(spark, 3)
    for b in range(7):
        index.add(spark.range(20).selectExpr("id % (3 + id % 5) AS h", "id AS g").where(f"id % 7 >= {b}"))
    assert [r[0] for r in index.runs] == [2, 1, 0]
    a, b = (spark.table(t) for _, t, _ in index.runs[:2])
    plan = a.join(b.hint("merge"), ["h", "g"], "full_outer")._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Exchange" not in plan
    assert {r["g"] for r in index.frequent().collect()} == {g for g in range(20) if g % 7 >= 2}
    index.close()
    assert not index.runs
