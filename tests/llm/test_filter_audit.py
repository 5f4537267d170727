import random
from itertools import permutations

from graphquarry.llm.filter_audit import COUNTS, audit, failures, lattice_edges

SPACE = " \t\n\x0b\x0c\r"


def words(text):
    for c in SPACE[1:]:
        text = text.replace(c, " ")
    return [w for w in text.split(" ") if w]


def failed(text, doc_id, rows):
    w = words(text)
    upper = sum("A" <= c <= "Z" for c in text)
    e = doc_id is not None and any(i is not None and i < doc_id and (t or "") == text for i, t, _ in rows)
    tests = (len(w) < 50, 100 * len(set(w)) < 65 * len(w), 100 * upper > 5 * len(text), any(c in "#$%&*|" for c in text), e)
    return "".join(c for c, x in zip("ABCDE", tests, strict=True) if x)


def odd_rows():
    rng = random.Random(4)
    vocabulary = ["w%d" % i for i in range(400)]
    rows = [(None, None, "a"), (1, "", None), (2, None, "a"), (3, "", ""), (3, "", ""), (None, "x y", "a"), (4, "x y", "b"), (5, "x y Z", "b"), (6, "É" * 60, "b"), (7, "A" * 5 + "b" * 95, "b"), (8, "#", "c")]
    for i in range(9, 70):
        t = rng.choice([" ", "\t", "\x0b\n"]).join(rng.choice(vocabulary[: rng.choice([20, 400])]) + rng.choice(["", "", "", "A", "|"] if i % 4 == 0 else [""]) for _ in range(rng.choice([49, 50, 51, 120])))
        rows += [(i, t, f"s{i % 3}")] + [(100 + 10 * i + k, t, "s0") for k in range(rng.choice([0, 0, 3]))]
    rows.append((9000, "Word other " * 40_000, "long"))
    return rows


def test_audit(spark):
    rows = odd_rows()
    docs = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, source string, part int, mask int").repartition(5)
    labels = [(i, i % 2, (i // 2) % 2) for i in range(0, 800, 3)] + [(12, None, 1), (12, 1, 0), (None, 1, 1), (15, None, None)]
    assert len(lattice_edges()) == 80
    fails = [failed(t or "", i, rows) for i, t, _ in rows]
    got = sorted((r["source"], "".join(c for k, c in enumerate("ABCDE") if r["mask"] >> k & 1)) for r in failures(docs).collect())
    assert got == sorted((s or "", f) for (_, _, s), f in zip(rows, fails, strict=True))
    good, toxic = ({i for i, *x in labels if x[k] == 1 and i is not None} for k in (0, 1))
    want = {}
    for part in {s or "" for _, _, s in rows}:
        own = [(i, f) for (i, _, s), f in zip(rows, fails, strict=True) if (s or "") == part]
        for order in map("".join, permutations("ABCDE")):
            for step, c in enumerate(order, 1):
                hit = [i for i, f in own if c in f and not set(f) & set(order[: step - 1])]
                want[part, order, step] = [
                    sum(not set(f) & set(order[:step]) for _, f in own), len(hit), sum(c in f for _, f in own) - len(hit), sum(f == c for _, f in own), sum(i in good for i in hit), sum(i in toxic for i in hit)
                ]
    out = audit(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    assert len(out) == len(want) and {(r["part"], r["filter_order"], r["step"]): [r[c] for c in COUNTS] for r in out} == want
    for r in out:
        assert r["shapley"] == sum(v[1] for (p, o, s), v in want.items() if p == r["part"] and o[s - 1] == r["filter_order"][r["step"] - 1])


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, source string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert audit(docs, labels).count() == 0
    one = audit(spark.createDataFrame([(1, "x", "s")], docs.schema), labels)
    assert one.count() == 600 and one.where("good_lost + toxic_lost > 0").count() == 0
