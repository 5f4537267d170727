"""Source divergence audit: terms counted in radix tries, merged by prefix range, compared between the sources of a language."""

from __future__ import annotations

from collections import defaultdict

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, text_slices

SCALE, PSEUDO, LEAST_DOCS, TOP = 1_000_000_000, 1, 3, 200
#: Bytes of text that a task counts before it writes its tries and begins new ones (or one text).
HELD = 10 << 20
#: Numbers in a matrix of terms by groups, or of pairs of groups, that a task holds.
CELLS = 2_000_000
_LETTER = set(range(65, 91)) | set(range(97, 123)) | set(range(128, 256))
#: A byte of a term stays, A-Z in lower case; every other becomes a space.
_TERMS = np.array([c + 32 if 65 <= c <= 90 else c if c in _LETTER else 32 for c in range(256)], np.uint8)


class RadixTrie:
    """Byte strings with a value at each leaf. A node is [label, children by first byte, value]; children and value may be None."""

    def __init__(self):
        self.root = [b"", None, None]

    def put(self, term: bytes, value) -> None:
        node, at = self.root, 0
        while at < len(term):
            if node[1] is None:
                node[1] = {}
            child = node[1].get(term[at])
            if child is None:
                node[1][term[at]] = [term[at:], None, value]
                return
            if not term.startswith(child[0], at):
                label, k = child[0], 1
                while k < len(label) and at + k < len(term) and label[k] == term[at + k]:
                    k += 1
                child[0] = label[k:]
                child = node[1][term[at]] = [label[:k], {label[k]: child}, None]
            node, at = child, at + len(child[0])
        node[2] = value

    def walk(self):
        """The values in the order of their strings' bytes."""
        todo = [self.root]
        while todo:
            _, children, value = todo.pop()
            if value is not None:
                yield value
            if children:
                todo.extend([children[b] for b in sorted(children, reverse=True)] if len(children) > 1 else children.values())


def _words(texts):
    """(words, the text of each): an Arrow array of the terms of an Arrow array of texts, none of which is cut or joined with another's."""
    import pyarrow as pa

    texts = texts.cast(pa.large_binary())
    ends = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]]
    ends = ends - ends[0]
    letters = _TERMS[raw]
    solid = letters != 32
    first = solid.copy()
    first[1:] &= ~solid[:-1]
    begins = ends[:-1][ends[:-1] < len(raw)]
    first[begins] = solid[begins]
    starts = np.flatnonzero(first)
    offsets = np.zeros(len(starts) + 1, np.int64)
    if len(starts):
        np.cumsum(np.add.reduceat(solid, starts, dtype=np.int64), out=offsets[1:])
    words = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(letters[solid])])
    return words, np.searchsorted(ends[1:], starts, "right")


def _count(batches, number: dict, most: int):
    """Leaves (lang, term, docs, groups, counts) of this task's tries, a trie a language, in traversal order.

    A leaf's value is the place of its counters: of documents, and of occurrences by group.
    """
    import pyarrow as pa

    schema = pa.schema([("lang", pa.string()), ("term", pa.binary()), ("docs", pa.int64()), ("groups", pa.list_(pa.int32())), ("counts", pa.list_(pa.int64()))])
    langs = sorted({k[0] for k in number})
    tongue = np.zeros(max(number.values(), default=0) + 1, np.int64)
    for (lang, _), i in number.items():
        tongue[i] = langs.index(lang)
    g = len(tongue)

    for batch in batches:
        for a, n in text_slices(batch.column(2), most, batch.num_rows):
            part = batch.slice(a, n)
            group = np.array([number[k] for k in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True)], np.int64)
            words, doc = _words(part.column(2))
            if not len(words):
                continue
            coded = words.dictionary_encode()
            code, d = coded.indices.to_numpy().astype(np.int64), len(coded.dictionary)
            once = np.unique(doc * d + code)
            of = group[doc]
            del words, doc
            pairs, times = np.unique((tongue[of] * d + code) * g + of, return_counts=True)
            del of, code
            keys, docs = np.unique(tongue[group[once // d]] * d + once % d, return_counts=True)
            at = np.searchsorted(pairs // g, np.append(keys, keys[-1] + 1))
            terms = coded.dictionary.take(pa.array(keys % d)).cast(pa.binary())
            ends = np.searchsorted(keys // d, np.arange(len(langs) + 1))
            for i, lang in enumerate(langs):
                trie, lo, hi = RadixTrie(), ends[i], ends[i + 1]
                for k, term in enumerate(terms.slice(lo, hi - lo).to_pylist()):
                    trie.put(term, k)
                order = lo + np.fromiter(trie.walk(), np.int64)
                for b in range(0, len(order), 65_536):
                    o = order[b : b + 65_536]
                    sizes = at[o + 1] - at[o]
                    lists = np.append(0, np.cumsum(sizes))
                    flat = np.repeat(at[o] - lists[:-1], sizes) + np.arange(lists[-1])
                    counters = [pa.ListArray.from_arrays(pa.array(lists.astype(np.int32)), pa.array(x)) for x in ((pairs[flat] % g).astype(np.int32), times[flat])]
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(o), pa.string()), terms.take(pa.array(o)), pa.array(docs[o]), *counters], schema=schema)


def _merge(batches):
    """Sums of the leaves of equal (lang, term), which follow each other; those in too few documents go."""
    import pyarrow as pa
    import pyarrow.compute as pc

    def summed(t: pa.Table, last: bool):
        """(whole terms, the last one, which may go on)"""
        lang, term = (t.column(i).combine_chunks() for i in (0, 1))
        other = pc.or_(pc.not_equal(lang[1:], lang[:-1]), pc.not_equal(term[1:], term[:-1])).to_numpy(zero_copy_only=False)
        first = np.flatnonzero(np.concatenate([[True], other]))
        run = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(t))))
        groups, counts = t.column(3).combine_chunks(), t.column(4).combine_chunks().flatten().to_numpy()
        run, groups = np.repeat(run, pc.list_value_length(groups).to_numpy()), groups.flatten().to_numpy()
        order = np.lexsort((groups, run))
        run, groups, counts = run[order], groups[order], counts[order]
        new = np.flatnonzero(np.concatenate([[True], (run[1:] != run[:-1]) | (groups[1:] != groups[:-1])]))
        ends = np.searchsorted(run[new], np.arange(len(first) + 1)).astype(np.int32)
        lists = [pa.ListArray.from_arrays(pa.array(ends), pa.array(x)) for x in (groups[new].astype(np.int32), np.add.reduceat(counts, new))]
        out = pa.table([lang.take(first), term.take(first), pa.array(np.add.reduceat(t.column(2).to_numpy(), first)), *lists], names=t.column_names)
        return (out, out.slice(0, 0)) if last else (out.slice(0, len(out) - 1), out.slice(len(out) - 1))

    def many(t: pa.Table):
        return t.filter(pc.greater_equal(t.column(2), LEAST_DOCS)).to_batches()

    rest = None
    for batch in batches:
        if batch.num_rows:
            t = pa.Table.from_batches([batch])
            t, rest = summed(t if rest is None else pa.concat_tables([rest.cast(t.schema), t]), False)
            yield from many(t)
    if rest is not None:
        yield from many(summed(rest, True)[0])


def _scaled(a: np.ndarray, m) -> np.ndarray:
    """1 + floor(SCALE * a / m), by long division: exact up to counts of 9e15."""
    out, rest = a // m, a % m
    for _ in range(3):
        out, rest = out * 1000 + rest * 1000 // m, rest * 1000 % m
    return out + 1


def _f(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // q


def _compare(batches, langs: dict, stripe: int, cells: int):
    """Of this task's terms: sums of f for each pair of groups whose first is in the stripe; in stripe 0 each group's best terms.

    langs: lang -> (numbers of its groups, their N, V). Equal rows of counters are compared once.
    """
    import pyarrow as pa

    schema = pa.schema([("group", pa.int32()), ("other", pa.int32()), ("term", pa.binary()), ("value", pa.int64())])
    sums, best = {}, defaultdict(list)
    for batch in batches:
        names = np.array(batch.column(0).to_pylist(), object)
        for lang in set(names):
            numbers, n, v = langs[lang]
            width = max(1, cells // len(numbers))
            mine = batch.take(pa.array(np.flatnonzero(names == lang)))
            for a in range(0, mine.num_rows, width):
                part = mine.slice(a, width)
                terms, groups = part.column(1), part.column(3)
                row = np.repeat(np.arange(part.num_rows), np.array([len(x) for x in groups.to_pylist()], int))
                own, count = np.searchsorted(numbers, groups.flatten().to_numpy()), part.column(4).flatten().to_numpy()
                counts = np.zeros((part.num_rows, len(numbers)), np.int64)
                counts[row, own] = count
                alike, times = np.unique(counts, axis=0, return_counts=True)
                p = _scaled(alike + 1, n + v)
                firsts = range(stripe * width, min((stripe + 1) * width, len(numbers)))
                if lang not in sums:
                    sums[lang] = np.zeros((len(firsts), len(numbers)), np.int64)
                for i, g in enumerate(firsts):
                    sums[lang][i] += (_f(p[:, g : g + 1], p) * times[:, None]).sum(0)
                if stripe == 0:
                    q = _scaled(counts.sum(1) + 1, n.sum() + v)[row]
                    p = _scaled(count + 1, (n + v)[own])
                    keep = np.flatnonzero(p > q)
                    value, words = _f(p[keep], q[keep]), terms.to_pylist()
                    for g in np.unique(own[keep]):
                        at = keep[own[keep] == g]
                        new = zip((-value[own[keep] == g]).tolist(), (words[r] for r in row[at]), strict=True)
                        held = best[int(numbers[g])]
                        last = held[-1] if len(held) == TOP else None
                        held.extend(x for x in new if last is None or x < last)
                        held.sort()
                        del held[TOP:]
    rows = [(g, None, term, -value) for g, held in best.items() for value, term in held]
    for lang, s in sums.items():
        numbers = langs[lang][0]
        first = stripe * max(1, cells // len(numbers))
        rows += [(int(numbers[first + i]), int(o), None, int(x)) for i, line in enumerate(s) for o, x in zip(numbers, line, strict=True) if numbers[first + i] != o]
    for a in range(0, len(rows), 65_536):
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows[a : a + 65_536], strict=True), schema, strict=True)], schema=schema)


def source_divergence(docs: DataFrame, held: int = HELD, cells: int = CELLS) -> DataFrame:
    """lang, source, part, item, value, rank: how the terms of each source of a language differ from its other sources' and the language's.

    Terms are runs of ASCII letters and of characters beyond ASCII, A-Z in lower case. A language keeps those in at least 3 of
    its documents. With a group's count c of a term, N the sum of c over kept terms and V their number,
    p = 1 + floor(1e9 * (c + 1) / (N + V)), q likewise of what it is held against, f = floor((p - q)^2 / q), all in whole
    numbers. Part `pair` has for each other source of the language the sum of f over all kept terms; part `term` the 200 kept
    terms of the group with the largest f against the language whose count is over 0 and p over q. Ties go by item in the
    order of UTF-8 bytes.

    Null text, lang and source count as ''. A document is a row: rows that repeat count each. A group without terms has pairs,
    0 where its language keeps none; an empty table gives an empty result. Whole texts are read; other columns are not,
    whatever their names.

    A task counts into tries and writes their leaves after each `held` bytes of text; leaves are dealt by ranges of (lang, term), so that a frequent prefix is
    split, and merged in order. The result has a row for each two sources of a language, so a row for each source is small
    beside it: those (name, N, V) come to the driver and go to all tasks. A task's matrices have at most `cells` numbers; where
    a language's pairs are more, they are taken in stripes.
    """
    spark = docs.sparkSession
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    d = docs.select(text("lang"), text("source"), text("text").cast("binary").alias("text"))
    pairs = sorted((r["lang"], r["source"]) for r in d.select("lang", "source").distinct().collect())
    number = {k: i for i, k in enumerate(pairs)}
    groups = spark.createDataFrame([(i, *k) for i, k in enumerate(pairs)], "group int, lang string, source string")
    leaf = "lang string, term binary, docs long, groups array<int>, counts array<long>"
    leaves = materialize(d.mapInArrow(lambda b: _count(b, number, held), leaf), "leaves")
    ways = int(spark.conf.get("spark.sql.shuffle.partitions"))
    kept = materialize(leaves.repartitionByRange(ways, "lang", "term").sortWithinPartitions("lang", "term").mapInArrow(_merge, leaf), "terms")
    size = {r["lang"]: r["v"] for r in kept.groupBy("lang").agg(F.count(F.lit(1)).alias("v")).collect()}
    total = {r["group"]: r["n"] for r in kept.select(F.inline(F.arrays_zip(F.col("groups").alias("group"), F.col("counts").alias("n")))).groupBy("group").agg(F.sum("n").alias("n")).collect()}
    langs = {x: [i for i, k in enumerate(pairs) if k[0] == x] for x in size}
    langs = {x: (np.array(g), np.array([total.get(i, 0) for i in g], np.int64), size[x]) for x, g in langs.items()}
    most = max((len(g) for g, _, _ in langs.values()), default=1)
    found = None
    for stripe in range(-(-most // max(1, cells // most))):
        part = kept.mapInArrow(lambda b, s=stripe: _compare(b, langs, s, cells), "group int, other int, term binary, value long")
        found = part if found is None else found.unionByName(part)
    found = materialize(found, "found")
    sums = found.where("other IS NOT NULL").groupBy("group", "other").agg(F.sum("value").alias("value"))
    two = groups.join(groups.select("lang", F.col("group").alias("other"), F.col("source").alias("item")), "lang").where(F.col("group") != F.col("other"))
    pair = two.join(sums, ["group", "other"], "left").select("lang", "source", F.lit("pair").alias("part"), "item", F.coalesce("value", F.lit(0)).cast("long").alias("value"))
    term = found.where("other IS NULL").join(groups, "group").select("lang", "source", F.lit("term").alias("part"), F.col("term").cast("string").alias("item"), "value")
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    return pair.withColumn("rank", rank).unionByName(term.withColumn("rank", rank).where(F.col("rank") <= TOP))


def oracle_sql() -> str:
    """The same in DuckDB SQL over documents."""
    p = lambda c, n: f"1 + {SCALE}::HUGEINT * ({c} + 1) // ({n} + {PSEUDO} * v)"
    f = lambda a, b: f"(({a}) - ({b})) * (({a}) - ({b})) // ({b})"
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS x FROM documents),
w AS (SELECT r, lang, source, unnest(regexp_extract_all(translate(x, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM d),
k AS (SELECT lang, term, count(*) AS all_n FROM w GROUP BY ALL HAVING count(DISTINCT r) >= {LEAST_DOCS}),
v AS (SELECT lang, count(*) AS v, sum(all_n) AS all_total FROM k GROUP BY ALL),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT lang, source, term, count(*) AS c FROM w GROUP BY ALL),
e AS (SELECT g.lang, g.source, k.term, coalesce(c.c, 0) AS c, all_n, all_total, v, sum(coalesce(c.c, 0)) OVER (PARTITION BY g.lang, g.source) AS n
      FROM g JOIN k USING (lang) JOIN v USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
p AS (SELECT lang, source, term, c, {p("c", "n")} AS p, {p("all_n", "all_total")} AS q FROM e),
s AS (SELECT a.lang, a.source, b.source AS item, sum({f("a.p", "b.p")}) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
u AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(s.value, 0)::BIGINT AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
        LEFT JOIN s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
      UNION ALL SELECT lang, source, 'term', term, ({f("p", "q")})::BIGINT FROM p WHERE c > 0 AND p > q)
SELECT lang, source, part, item, value, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INT AS rank FROM u QUALIFY part = 'pair' OR rank <= {TOP}"""
