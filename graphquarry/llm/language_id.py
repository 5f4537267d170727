"""Language ID: proportions of a mixture of languages by expectation-maximisation over byte trigram likelihoods."""

from __future__ import annotations

import numpy as np
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .common import map_texts, text_slices

#: Buckets of hashed trigrams; words that share one language in the mixture; steps of expectation-maximisation.
BUCKETS, UNIT, STEPS = 1 << 14, 4, 12
_FOLD = np.full(256, 0x20, np.uint8)  # ASCII but letters becomes space
_FOLD[97:123] = np.arange(97, 123)
_FOLD[128:] = np.arange(128, 256)
_LETTER = regex.compile(r"\p{L}")


def _trigrams(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the joined lower-case texts: bucket of the trigram around each byte, whether it counts, where each text starts."""
    raw = [(t.lower() if t else "").encode("utf-8", "replace") for t in texts]
    b = _FOLD[np.frombuffer(b"".join(x + b" " for x in raw) or b" ", np.uint8)]
    x = b.astype(np.uint32)
    key = (np.concatenate(([32], x[:-1])) << 16 | x << 8 | np.concatenate((x[1:], [32]))).astype(np.uint32)
    return (key * np.uint32(2654435761)) >> np.uint32(18), b != 32, np.cumsum([0, *(len(r) + 1 for r in raw)])


def learn(labelled: DataFrame) -> tuple[list[str], np.ndarray]:
    """(languages, their trigram log-probabilities) from all rows (text, lang) with a lang; sums over tasks are grouped in Spark.

    What comes to the driver is a number for each language and bucket. Without labelled rows there are no languages.
    """
    rows = labelled.where("text IS NOT NULL AND lang IS NOT NULL").select("lang", "text")
    schema = T._parse_datatype_string("lang string, bucket int, n long")
    arrow = to_arrow_schema(schema)

    def run(batches):
        import pyarrow as pa

        total: dict[str, np.ndarray] = {}
        for batch in batches:
            for a, size in text_slices(batch.column("text"), 1 << 20):
                part = batch.slice(a, size)
                key, ok, at = _trigrams(part.column("text").to_pylist())
                for lang, i, j in zip(part.column("lang").to_pylist(), at[:-1], at[1:], strict=True):
                    if lang not in total:
                        total[lang] = np.zeros(BUCKETS, np.int64)
                    total[lang] += np.bincount(key[i:j][ok[i:j]], minlength=BUCKETS)
        for lang, n in total.items():
            k = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(k), pa.string()), pa.array(k, pa.int32()), pa.array(n[k])], schema=arrow)

    found = rows.mapInArrow(run, schema).groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    langs = sorted(found["lang"].unique())
    n = np.full((len(langs), BUCKETS), 0.5)
    n[np.searchsorted(langs, found["lang"]), found["bucket"]] += found["n"]
    return langs, np.log(n / n.sum(1, keepdims=True))


def _units(ok: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start of each unit of UNIT words and its text; units never cross texts."""
    start = np.flatnonzero(ok & ~np.concatenate(([False], ok[:-1])))
    doc = np.searchsorted(at, start, "right") - 1
    rank = np.arange(len(start)) - np.searchsorted(doc, doc)
    first = rank % UNIT == 0
    return start[first], doc[first]


def infer(texts: list[str | None], log_p: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(language number or -1, its share, shares of all) of each text.

    Each unit of words is drawn from one language; EM gives the shares. Languages are then taken by falling share for as
    long as the likelihood gained outweighs half the logarithm of the units for each, and shares outside that set are 0.
    """
    k, n = len(log_p), len(texts)
    best, share, full = np.full(n, -1), np.zeros(n), np.zeros((n, k))
    key, ok, at = _trigrams(texts)
    start, doc = _units(ok, at)
    if not k or not len(start):
        return best, share, full
    ll = np.stack([np.add.reduceat(np.where(ok, row[key], 0.0), start) for row in log_p], 1)
    ll -= ll.max(1, keepdims=True)
    like = np.exp(np.maximum(ll, -50.0))
    first = np.flatnonzero(np.concatenate(([True], doc[1:] != doc[:-1])))
    row = np.repeat(np.arange(len(first)), np.diff(np.concatenate((first, [len(doc)]))))
    units = np.bincount(row).astype(float)
    theta = np.full((len(first), k), 1.0 / k)
    for _ in range(STEPS):
        r = like * theta[row]
        r /= r.sum(1, keepdims=True)
        theta = np.add.reduceat(r, first) / units[:, None]
    order = np.argsort(-theta, 1, kind="stable")
    chosen = np.zeros_like(theta)
    top = np.full(len(first), -np.inf)
    for size in range(1, k + 1):
        part = np.zeros_like(theta)
        np.put_along_axis(part, order[:, :size], np.take_along_axis(theta, order[:, :size], 1) + 1e-12, 1)
        part /= part.sum(1, keepdims=True)
        value = np.add.reduceat(np.log((like * part[row]).sum(1)), first) - 0.5 * size * np.log(units + 1)
        better = value > top
        top[better], chosen[better] = value[better], part[better]
    d = doc[first]
    full[d], best[d] = chosen, chosen.argmax(1)
    share[d] = np.minimum(1.0, theta[np.arange(len(d)), best[d]])
    return best, share, full


def identify(docs: DataFrame, langs: list[str], log_p: np.ndarray, threshold: float = 0.05) -> DataFrame:
    """docs' columns but text, then lang_pred, score (its share of the mixture, 0 to 1) and languages (those of the chosen set).

    lang_pred is `und`, score 0 and languages empty where the text is null, has no letter, or no language was learned.
    Equal likelihoods go to the first language by name. Rows that repeat are judged alike, texts are read whole however long,
    columns named like a result are replaced, and an empty table gives none.
    """

    def body():
        def work(texts: list[str | None]):
            best, share, full = infer(texts, log_p)
            known = [b >= 0 and bool(t and _LETTER.search(t)) for b, t in zip(best, texts, strict=True)]
            pred = [langs[b] if ok else "und" for b, ok in zip(best, known, strict=True)]
            sets = [[langs[i] for i in np.flatnonzero(f >= threshold)] if ok else [] for f, ok in zip(full, known, strict=True)]
            return pred, [float(s) if ok else 0.0 for s, ok in zip(share, known, strict=True)], sets

        return work

    return map_texts(docs, body, "lang_pred string, score double, languages array<string>", 1 << 20)
