"""Mixing sources to target weights: soft domain membership and projected-gradient rates, in built-in expressions only."""

from __future__ import annotations

from math import log

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize
from .quality_rules import SPACE

#: Labelled documents that words and letters are learned from, at most, those of smallest hash; words and letters learned for each domain.
EXAMPLES, WORDS, LETTERS = 4000, 24, 6
#: Steps of projected gradient at most; pull of rates towards 1; largest value of a feature.
STEPS, RIDGE, TOP = 40, 1e-3, 12
#: Steps after which rates are written, so that a row repeats no more of them.
KEPT = 10


def _once(value: Column) -> Column:
    """value, evaluated once a row: the optimizer copies no expression that names its partition."""
    return F.when(F.spark_partition_id() >= 0, value)


def _words() -> Column:
    return F.array_remove(F.split("t", SPACE), "")


def telling(docs: DataFrame, labelled: DataFrame) -> tuple[list[list[str]], list[list[str]]]:
    """For each domain the words, and the letters beyond ASCII, whose share of its documents is most above that of others.

    Learned from at most EXAMPLES labelled documents, whose ids alone are broadcast; WORDS and LETTERS rows a domain come here.
    """
    few = labelled.where("domain IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.min(F.col("domain").cast("string")).alias("domain")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(EXAMPLES)
    texts = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("t")).join(F.broadcast(few), "doc_id")
    piece = lambda kind, x: F.transform(F.array_distinct(x), lambda w: F.struct(F.lit(kind).alias("kind"), w.alias("w")))
    letters = F.filter(F.split(F.lower("t"), ""), lambda c: F.octet_length(c) > 1)
    pieces = F.concat(piece("word", _words()), piece("letter", letters), F.array(F.struct(F.lit("all").alias("kind"), F.lit("").alias("w"))))
    seen = materialize(texts.select("domain", F.explode(pieces).alias("x")).groupBy("domain", "x.kind", "x.w").agg(F.count(F.lit(1)).alias("n")), "pieces")
    size = seen.where("kind = 'all'").select("domain", F.col("n").alias("size"))
    every = seen.groupBy("kind", "w").agg(F.sum("n").alias("all"))
    total = size.agg(F.sum("size").alias("total"))
    d = seen.where("kind <> 'all' AND n > 1").join(F.broadcast(size), "domain").join(every, ["kind", "w"]).crossJoin(F.broadcast(total))  # a row a domain; one row
    gain = F.col("n") / F.col("size") - (F.col("all") - F.col("n")) / F.greatest(F.lit(1), F.col("total") - F.col("size"))
    ranked = F.array_sort(F.collect_list(F.struct((-F.col("gain")).alias("neg"), "w")))
    best = d.withColumn("gain", gain).where("gain > 0").groupBy("domain", "kind").agg(F.slice(ranked, 1, max(WORDS, LETTERS)).alias("best")).orderBy("domain").collect()
    pick = lambda kind, most: [[x["w"] for x in r["best"][:most]] for r in best if r["kind"] == kind]
    return pick("word", WORDS), pick("letter", LETTERS)


def features(docs: DataFrame, words: list[list[str]], letters: list[list[str]]) -> DataFrame:
    """doc_id, n_tokens (words) and f, small whole numbers: how many different words of each list, and by the 64 characters letters of each list and wide ones."""
    d = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("t")).withColumn("w", _once(_words()))
    share = lambda n: F.least(F.lit(TOP), F.ceil(64.0 * n / F.greatest(F.length("t"), F.lit(1)))).cast("int")
    # one pass over a text's words: each list looks at what is in any
    d = d.withColumn("h", _once(F.array_intersect("w", F.array(*map(F.lit, sorted({x for v in words for x in v}))).cast("array<string>"))))
    own = [F.least(F.lit(TOP), F.size(F.array_intersect("h", F.array(*map(F.lit, v))))) for v in words]
    # bytes that go with a letter, over its own: no pass over characters
    often = lambda c: (F.octet_length("t") - F.octet_length(F.replace("t", F.lit(c), F.lit("")))) / len(c.encode())
    own += [share(sum(map(often, v), F.lit(0.0))) for v in letters]
    return d.select("doc_id", F.size("w").cast("long").alias("n_tokens"), F.array(*own, share(F.octet_length("t") - F.length("t"))).alias("f"))


def posteriors(feats: DataFrame, labelled: DataFrame) -> tuple[list[str], DataFrame]:
    """(domains, feats with p: array of their probabilities), by a naive Bayes classifier counted from labelled (doc_id, domain).

    What comes to the driver is a number for each domain, feature and value. Where nothing is labelled there is one domain of
    weight 1.
    """
    rows = feats.join(labelled.where("domain IS NOT NULL").select("doc_id", F.col("domain").cast("string").alias("domain")).distinct(), "doc_id")
    cells = rows.select("domain", F.posexplode(F.array_append("f", F.lit(-1))).alias("k", "v"))
    n = {(r["domain"], r["k"], r["v"]): r["n"] for r in cells.groupBy("domain", "k", "v").agg(F.count(F.lit(1)).alias("n")).collect()}
    size = {d: c for (d, k, v), c in n.items() if v == -1}
    count = max((k for (_, k, v) in n if v == -1), default=0)
    domains = sorted(size) or ["all"]

    def table(d: str, k: int) -> Column:
        return F.get(F.array(*[F.lit(log((n.get((d, k, v), 0) + 0.1) / (size.get(d, 0) + 0.1 * (TOP + 1)))) for v in range(TOP + 1)]), F.get("f", F.lit(k)))

    total = sum(size.values()) or 1
    logs = F.array(*[sum((table(d, k) for k in range(count)), F.lit(log((size.get(d, 0) + 1) / (total + len(domains))))) for d in domains])
    d = feats.withColumn("_l", logs).withColumn("_m", F.array_max("_l"))
    d = d.withColumn("_e", F.transform("_l", lambda x: F.exp(x - F.col("_m")))).withColumn("_s", F.aggregate("_e", F.lit(0.0), lambda a, x: a + x))
    return domains, d.select("doc_id", "n_tokens", F.transform("_e", lambda x: x / F.col("_s")).alias("p"))


def _rate(residuals: list[list[float]]) -> Column:
    """A document's rate after as many more steps as there are residuals; it never falls below 0."""
    r = F.col("rate")
    if not residuals:
        return r
    moves = F.array(*[F.array(*map(F.lit, e)) for e in residuals])
    pull = lambda e: F.aggregate(F.zip_with("p", e, lambda p, x: p * x), F.lit(0.0), lambda a, x: a + x)
    return F.aggregate(moves, r, lambda a, e: F.greatest(F.lit(0.0), a - (pull(e) + F.lit(RIDGE) * (a - 1))))


def fit_rates(soft: DataFrame, domains: list[str], targets: dict[str, float] | None, total: float | None = None) -> DataFrame:
    """soft with rate: how often each document is wanted, so that expected domain totals of tokens are `total` times the target weights.

    Least squares over nonnegative rates with a small pull to 1, by projected gradient in the metric of the documents'
    tokens. Rates are an expression of the residuals since they were last written, every KEPT steps; a step is one grouped
    sum over soft, of which a number a domain comes back. Without targets the weights are the domains' shares to the power 0.7.
    Without a total, it is the least at which no domain shrinks, and 0.2 % more. A target without a document counts as 0.
    """
    soft = materialize(soft.withColumn("rate", F.lit(1.0)), "soft")
    sums = lambda rate: [float(x or 0.0) for x in soft.agg(*[F.sum(F.col("n_tokens") * F.get("p", F.lit(i)) * rate) for i in range(len(domains))]).first()]
    have = sums(F.lit(1.0))
    all_ = sum(have)
    if not all_:
        return soft
    want = [(targets or {}).get(d, 0.0) for d in domains] if targets else [(h / all_) ** 0.7 for h in have]
    want = [w if h > 0 else 0.0 for w, h in zip(want, have, strict=True)]
    weight = [w / (sum(want) or 1) for w in want]
    total = total or 1.002 * max(h / w for h, w in zip(have, weight, strict=True) if w > 0)
    # domains are the coordinates: residuals as shares of what each has now
    residuals: list[list[float]] = []
    for _ in range(STEPS):
        if len(residuals) == KEPT:
            soft, residuals = materialize(soft.withColumn("rate", _rate(residuals)), "soft"), []
        now = sums(_rate(residuals))
        e = [(x - total * w) / h if h > 0 else 0.0 for x, w, h in zip(now, weight, have, strict=True)]
        if max(map(abs, e)) < 1e-4:
            break
        residuals.append(e)
    return soft.withColumn("rate", _rate(residuals))


def mix_to_targets(docs: DataFrame, labelled: DataFrame, targets: dict[str, float] | None = None, total: float | None = None) -> DataFrame:
    """doc_id, n_tokens, domains (array), p (their posteriors), rate and copies for every row of docs (doc_id, text).

    copies is the whole part of rate, and one more if a hash of doc_id falls below the rest: its sum follows the rates. A null
    or empty text has no tokens and the evidence of such texts; rows that repeat a doc_id have equal copies; an empty table gives
    none. Texts are read whole; other columns are not read, whatever their names. Any labels may be domains: the words that
    tell them apart are learned.
    """
    domains, soft = posteriors(materialize(features(docs, *telling(docs, labelled)), "features"), labelled)
    out = fit_rates(soft, domains, targets, total)
    u = F.pmod(F.xxhash64(F.lit(11), "doc_id"), F.lit(1 << 20)) / float(1 << 20)
    whole = F.floor("rate")
    return out.select("doc_id", "n_tokens", F.array(*map(F.lit, domains)).alias("domains"), "p", "rate", (whole + (u < F.col("rate") - whole).cast("long")).cast("int").alias("copies"))
