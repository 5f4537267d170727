"""Quality rules: a threshold table compiled into one projection of built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACE = r"[\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"
WINDOW = 8

#: Frequent function words of English, French, German and Spanish.
STOP_WORDS = (
    "the of and to in is that for with on as by at from this be it are was or an not have has "
    "le la les de des du et en un une que qui dans par pour sur au aux est ne se ce pas "
    "der die das und zu den mit von ist im für auf ein eine dem nicht sich auch es "
    "el los las del y por con para al su lo como más pero"
).split()

#: (rule, numerator, denominator, least, most), in hundredths of the denominator; None: no bound.
RULES: list[tuple[str, str, str, int | None, int | None]] = [
    ("word length", "word_chars", "n_words", 200, 1500),
    ("symbols a word", "n_symbols", "n_words", None, 10),
    ("exclamation marks a word", "n_exclaims", "n_words", None, 30),
    ("repeated lines", "n_dup_lines", "n_lines", None, 40),
    ("different stop words", "n_stop_words", "one", 100, None),
]
MIN_WORDS, MAX_REPEAT = 20, 30


def _count(text: str, chars: str) -> Column:
    return (F.length(text) - F.length(F.translate(text, chars, ""))).cast("long")


def passes(rules=tuple(RULES)) -> Column:
    """All rules over the measured columns, in whole numbers."""
    out = F.lit(True)
    for _, above, below, least, most in rules:
        n, d = F.col(above) * 100, F.lit(1) if below == "one" else F.col(below)
        out = out & (n >= d * least if least is not None else F.lit(True)) & (n <= d * most if most is not None else F.lit(True))
    return out


def _once(value: Column) -> Column:
    """value, evaluated once a row: the optimizer copies no expression that names its partition into filters or lambdas above."""
    return F.when(F.spark_partition_id() >= 0, value)


def measure(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs' columns and n_words, word_chars, n_symbols, n_exclaims, n_lines, n_dup_lines, n_stop_words, n_repeat_words.

    A null text counts as empty; texts are read whole. Columns of docs that are named like a measure are replaced, in any case
    of letters; all others stay, whatever their names. Rows that repeat are measured alike; an empty table gives none.
    """
    keep = [F.col(f"`{c}`") for c in docs.columns]
    mark = "_"
    while any(c.lower().startswith(mark) for c in docs.columns):
        mark += "_"
    _t, _w, _l, _g, _s, _p = (f"{mark}{x}" for x in "twlgsp")
    words = F.filter(F.split(F.col(_t), SPACE), lambda w: w != "")
    lines = F.filter(F.split(F.col(_t), "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    d = docs.select(*keep, F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias(_t)).withColumns({_w: _once(words), _l: _once(lines)})
    # a number for each window of words; equal windows have equal numbers
    grams = F.when(F.size(_w) > WINDOW, F.transform(F.sequence(F.lit(1), F.size(_w) - (WINDOW - 1)), lambda i: F.xxhash64(F.slice(_w, i, WINDOW)))).otherwise(F.array().cast("array<bigint>"))
    d = d.withColumn(_g, _once(grams))
    twice = F.size(F.array_distinct(_g)) < F.size(_g)
    sorted_ = F.when(twice, F.array_sort(F.transform(_g, lambda h, i: F.struct(h.alias("h"), i.alias("i")))))
    d = d.withColumn(_s, _once(sorted_))
    found = F.filter(_s, lambda x, i: (F.get(_s, i - 1)["h"] == x["h"]) | (F.get(_s, i + 1)["h"] == x["h"]))
    d = d.withColumn(_p, _once(F.array_sort(F.transform(found, lambda x: x["i"]))))
    steps = F.transform(_p, lambda x, j: F.least(F.lit(WINDOW), F.coalesce(F.get(_p, j + 1) - x, F.lit(WINDOW))))
    values = {
        "n_words": F.size(_w).cast("long"),
        "word_chars": F.length(F.translate(_t, " \t\n\x0b\x0c\r", "")).cast("long"),
        "n_symbols": _count(_t, SYMBOLS),
        "n_exclaims": _count(_t, "!"),
        "n_lines": F.size(_l).cast("long"),
        "n_dup_lines": (F.size(_l) - F.size(F.array_distinct(_l))).cast("long"),
        "n_stop_words": F.size(F.array_intersect(_w, F.array(*map(F.lit, STOP_WORDS)))).cast("long"),
        "n_repeat_words": F.coalesce(F.aggregate(steps, F.lit(0), lambda a, x: a + x), F.lit(0)).cast("long"),
    }
    return d.select(*[c for c, n in zip(keep, docs.columns, strict=True) if n.lower() not in values], *[(_once(v) if n in ("n_stop_words", "n_repeat_words") else v).alias(n) for n, v in values.items()])


def quality_rules(docs: DataFrame) -> DataFrame:
    """doc_id, the measured columns, base_failed and kept for every row of docs (doc_id, text).

    base_failed: under 20 words, or over 30 % of words in windows of eight words that occur twice or more. kept: not
    base_failed, and all of RULES hold. A null or empty text has no words, fails the base and goes; rows that repeat are
    judged alike; an empty table gives an empty result.
    """
    m = measure(docs.select("doc_id", "text").select("doc_id", F.col("text")))
    failed = (F.col("n_words") < MIN_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * MAX_REPEAT)
    return m.drop("text").withColumn("base_failed", failed).withColumn("kept", ~failed & passes())


def oracle_sql() -> str:
    """The same in DuckDB SQL over documents."""
    stop = "[" + ", ".join(f"'{w}'" for w in STOP_WORDS) + "]"
    rules = " AND ".join(f"{a} * 100 {op} {'1' if b == 'one' else b} * {x}" for _, a, b, lo, hi in RULES for op, x in ((">=", lo), ("<=", hi)) if x is not None)
    return f"""
WITH t AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS x FROM documents),
w AS (SELECT r, doc_id, x, list_filter(regexp_split_to_array(x, '{SPACE}'), lambda a: a <> '') AS ws,
             list_filter(string_split(x, chr(10)), lambda a: regexp_matches(a, '[^\\x20\\x09-\\x0D]')) AS ls FROM t),
g AS (SELECT r, i, array_to_string(ws[i:i + 7], ' ') AS gram FROM w, unnest(range(1, len(ws) - 6)) AS u(i) WHERE len(ws) >= 8),
d AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, gram) AS c FROM g) WHERE c > 1),
s AS (SELECT r, CAST(sum(least(8, coalesce(nxt - i, 8))) AS BIGINT) AS n FROM (SELECT r, i, lead(i) OVER (PARTITION BY r ORDER BY i) AS nxt FROM d) GROUP BY r),
m AS (SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(regexp_replace(x, '{SPACE}', '', 'g')) AS BIGINT) AS word_chars,
             CAST(length(x) - length(regexp_replace(x, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
             CAST(length(x) - length(replace(x, '!', '')) AS BIGINT) AS n_exclaims, CAST(len(ls) AS BIGINT) AS n_lines,
             CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines, CAST(len(list_distinct(list_filter(ws, lambda a: list_contains({stop}, a)))) AS BIGINT) AS n_stop_words,
             coalesce(s.n, 0) AS n_repeat_words FROM w LEFT JOIN s USING (r)),
b AS (SELECT *, n_words < {MIN_WORDS} OR n_repeat_words * 100 > n_words * {MAX_REPEAT} AS base_failed FROM m)
SELECT *, NOT base_failed AND {rules} AS kept FROM b"""
