"""Mixing to target weights with soft memberships.

The labels table names three domains: clean, low (quality 0) and toxic. A naive Bayes classifier over
binned document features (shares of symbols, loud words, repeated words and repeated line characters,
words of lexicons, length) is counted from the labelled documents by grouped aggregation; its posteriors
are soft memberships. Nonnegative document rates are then fitted by projected gradient descent on the
squared gaps between expected domain token totals and targets. Each step is one distributed aggregate of
three sums; a document's rate is a function of its posteriors and the gradients so far, so nothing but
those sums reaches the driver. All of it is DataFrame and SQL code.

Targets: the weights, scaled so that the first domain keeps all its expected tokens. Rates are 0 or more and have no
upper bound. Rates that come within ``SLACK`` of 1 are held at 1, so most documents stay as they are, and
the rates of all others are fitted again to what the held ones leave of the targets. Rates are rounded
up or down to copies by a hash of doc_id and text, so copies meet the targets but for that rounding. A domain without
documents that can be repeated misses its target; ``mixing_totals`` shows what is reached.

Defined cases: a null text has no words, 0 tokens and is judged by its features like any text; labels
with nulls are ignored, repeated labels count once each; without labels the posteriors are uniform; an
empty table gives an empty result; repeated rows get equal rates; extra columns pass through ``mix``.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quadrat.llm.shared import staged

DOMAINS = ("clean", "low", "toxic")
WEIGHTS = (0.98, 0.02, 0.0)
#: Labelled documents from which lexicons are chosen, words in each lexicon, and a word's least likelihood ratio.
LEXICON_DOCS, LEXICON_WORDS, LEAST_RATIO = 8000, 64, 25
#: Share of a lexicon word's documents that are of its domain, at least.
PURITY = 0.9
#: Steps of each fit, share of all tokens that a gap may keep, distance from 1 that is held at 1, damping of the inverse Gram matrix.
STEPS, TOLERANCE, SLACK, DAMP = 24, 1e-4, 0.1, 1e-6
#: What a step must bring the squared gaps down to, and the share of a step below which no smaller one is tried.
GAIN, LEAST_SCALE = 0.99, 0.1
BINS = 12


def words(text: Column) -> Column:
    """Lower-case words; punctuation at words is no part of them."""
    plain = F.translate(F.lower(F.coalesce(text, F.lit(""))), "\t\n\x0b\x0c\r" + ".,;:!?\"()", "     ")
    return F.array_remove(F.split(plain, " "), "")


def domain(quality: Column, toxic: Column) -> Column:
    return F.when(toxic == 1, 2).when((toxic == 0) & (quality == 0), 1).when((toxic == 0) & (quality == 1), 0)


def labelled_ids(labels: DataFrame) -> DataFrame:
    rows = labels.select(F.col("doc_id").alias("_l"), domain(F.col("quality"), F.col("toxic")).alias("_domain"))
    return rows.where("_l is not null and _domain is not null")


def lexicons(docs: DataFrame, labels: DataFrame) -> list[list[int]]:
    """Hashes of the words that mark each domain but the first, from a bounded sample of labelled documents."""
    sample = labelled_ids(labels).orderBy(F.xxhash64("_l"), "_l").limit(LEXICON_DOCS)
    # at most LEXICON_DOCS ids are broadcast
    texts = docs.select("doc_id", "text").join(F.broadcast(sample), F.col("doc_id") == F.col("_l"))
    seen = texts.select("_domain", F.explode(F.array_distinct(words(F.col("text")))).alias("w"))
    counts = seen.groupBy("w").agg(*[F.count_if(F.col("_domain") == d).alias(f"c{d}") for d in range(len(DOMAINS))], F.count("*").alias("n")).where("n >= 5")
    counts, sizes = staged(counts, "lexicon"), {r[0]: r[1] for r in sample.groupBy("_domain").count().collect()}
    out, total = [], sum(sizes.values())
    for d in range(1, len(DOMAINS)):
        mine = sizes.get(d, 0)
        if not mine or mine == total:
            out.append([])
            continue
        hits, share = F.col(f"c{d}"), mine / total
        rest = F.col("n") - hits
        # the likelihood ratio of a word's documents against their share in the sample
        g2 = 2 * (hits * F.ln((hits + 1e-9) / (F.col("n") * share)) + rest * F.ln((rest + 1e-9) / (F.col("n") * (1 - share))))
        best = counts.where((hits >= F.col("n") * F.greatest(F.lit(share), F.lit(PURITY))) & (g2 > LEAST_RATIO)).orderBy(g2.desc(), "w").limit(LEXICON_WORDS)
        out.append([r[0] for r in best.select(F.xxhash64("w")).collect()])
    return out


def feature_bins(docs: DataFrame, lex: list[list[int]]) -> DataFrame:
    """doc_id, _k, tokens, bins (one small number a feature)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    base = docs.select("doc_id", F.xxhash64("text").alias("_k"), text.alias("_t"), F.transform(words(F.col("text")), lambda w: F.xxhash64(w)).alias("_w"))
    base = base.withColumn("_u", F.array_distinct("_w")).withColumn("_n", F.size("_w"))
    n = F.greatest(F.lit(1), F.col("_n"))
    gone = lambda chars: F.length("_t") - F.length(F.translate("_t", chars, ""))
    share = lambda x, top: F.least(F.lit(BINS - 1), F.ceil(x / n * top)).cast("int")
    lines = F.split("_t", "\n", -1)
    chars = lambda a: F.aggregate(a, F.lit(0), lambda s, x: s + F.length(x))
    repeated = (chars(lines) - chars(F.array_distinct(lines))) / F.greatest(F.lit(1), F.length("_t"))
    bins = [
        share(gone("#*$%&|<>"), 20),
        share(gone("!?"), 20),
        F.least(F.lit(BINS - 1), F.floor(F.col("_n") / (F.size("_u") + 1))).cast("int"),
        F.least(F.lit(BINS - 1), F.ceil(repeated * 10)).cast("int"),
        F.least(F.lit(BINS - 1), F.floor(F.log2(n + F.lit(0.0)))).cast("int"),
    ]
    for hashes in lex:
        hits = F.size(F.array_intersect("_u", F.array(*map(F.lit, hashes)))) if hashes else F.lit(0)
        bins.append(F.least(F.lit(BINS - 1), hits).cast("int"))
    return base.select("doc_id", "_k", F.col("_n").cast("long").alias("tokens"), F.array(*bins).alias("bins"))


def posterior(rows: DataFrame, labels: DataFrame) -> Column:
    """Array of posteriors, from counts of (domain, feature, bin): a table of bounded size."""
    known = rows.join(labelled_ids(labels), F.col("doc_id") == F.col("_l")).select("_domain", F.posexplode("bins").alias("f", "b"))
    counts: dict[tuple[int, int, int], int] = {(r[0], r[1], r[2]): r[3] for r in known.groupBy("_domain", "f", "b").count().collect()}
    d_n = len(DOMAINS)
    size = [sum(c for (d, f, _), c in counts.items() if d == k and f == 0) for k in range(d_n)]
    if not sum(size):
        return F.array(*[F.lit(1 / d_n)] * d_n)
    features = 1 + max(f for _, f, _ in counts)
    scores = []
    for d in range(d_n):
        s = F.lit(math.log((size[d] + 0.5) / (sum(size) + 0.5 * d_n)))
        for f in range(features):
            table = [math.log((counts.get((d, f, b), 0) + 0.05) / (size[d] + 0.05 * BINS)) for b in range(BINS)]
            s = s + F.get(F.array(*map(F.lit, table)), F.get("bins", f))
        scores.append(s)
    top = F.greatest(*scores)
    terms = F.array(*[F.exp(s - top) for s in scores])
    return F.transform(terms, lambda x: x / F.aggregate(terms, F.lit(0.0), lambda a, b: a + b))


def memberships(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, _k, tokens, p (posteriors in the order of DOMAINS), staged."""
    rows = staged(feature_bins(docs, lexicons(docs, labels)), "bins")
    return staged(rows.select("doc_id", "_k", "tokens", posterior(rows, labels).alias("p")), "memberships")


Steps = list[list[float]]


def replay(p: Column, start: Column, steps: Steps) -> Column:
    """The rate after these projected steps."""
    if not steps:
        return start
    all_ = F.array(*[F.array(*map(F.lit, g)) for g in steps])
    return F.aggregate(all_, start, lambda r, g: F.greatest(F.lit(0.0), r - sum((F.get(g, d) * F.get(p, d) for d in range(len(DOMAINS))), F.lit(0.0))))


def rate(p: Column, fits: tuple[Steps, Steps]) -> Column:
    """Rates of the first fit; those near 1 are 1, the others go on with the second."""
    first = replay(p, F.lit(1.0), fits[0])
    return F.when(F.abs(first - 1) <= SLACK, 1.0).otherwise(replay(p, first, fits[1]))


def totals(members: DataFrame, r: Column, d_n: int) -> list[float]:
    """Expected tokens of each domain at these rates."""
    row = members.agg(*[F.sum(F.col("tokens") * F.get("p", d) * r).alias(f"s{d}") for d in range(d_n)]).first()
    return [row[f"s{d}"] or 0.0 for d in range(d_n)]


def descend(members: DataFrame, start: Column, target: list[float], held: list[float]) -> Steps:
    """Projected steps from ``start`` that bring totals plus ``held`` to ``target``.

    One pass a step sums the totals and the Gram matrix of the memberships of documents whose rate is not 0; gaps are
    weighted by its damped inverse, and a step that does not shrink the gaps is halved.
    """
    d_n = len(target)
    pairs = [(a, b) for a in range(d_n) for b in range(a, d_n)]
    m = lambda d: F.get("p", d)

    def look(steps: Steps) -> tuple[np.ndarray, np.ndarray]:
        now = members.select("p", "tokens", replay(F.col("p"), start, steps).alias("r"))
        live = F.when(F.col("r") > 0, F.col("tokens")).otherwise(0)
        row = now.agg(*[F.sum(F.col("tokens") * m(d) * F.col("r")) for d in range(d_n)], *[F.sum(live * m(a) * m(b)) for a, b in pairs]).first()
        gram = np.zeros((d_n, d_n))
        for (a, b), x in zip(pairs, row[d_n:]):
            gram[a, b] = gram[b, a] = x or 0.0
        return np.array([x or 0.0 for x in row[:d_n]]) + held - target, gram

    steps: Steps = []
    (gap, gram), scale = look(steps), 1.0
    for _ in range(STEPS):
        if np.abs(gap).max() <= TOLERANCE * sum(target) or not np.trace(gram) or scale < LEAST_SCALE:
            break
        trial = [*steps, [float(x) for x in scale * np.linalg.solve(gram + DAMP * np.trace(gram) * np.eye(d_n), gap)]]
        after, gram_after = look(trial)
        if after @ after < GAIN * (gap @ gap):
            steps, gap, gram, scale = trial, after, gram_after, 1.0
        else:
            scale /= 2
    return steps


def fit_rates(members: DataFrame, weights: tuple[float, ...] = WEIGHTS) -> tuple[Steps, Steps]:
    """The scaled gradients of both descents; ``rate`` replays them.

    A rate follows from the posteriors alone, so documents with equal ones are summed first and all steps run over these sums.
    """
    d_n = len(weights)
    members = staged(members.groupBy("p").agg(F.sum("tokens").alias("tokens")), "membership-sums")
    s = totals(members, F.lit(1.0), d_n)
    if not sum(s) or not weights[0]:
        return [], []
    target = [s[0] / weights[0] * w for w in weights]
    first = descend(members, F.lit(1.0), target, [0.0] * d_n)
    now = replay(F.col("p"), F.lit(1.0), first)
    near = F.abs(now - 1) <= SLACK
    return first, descend(members.where(~near), now, target, totals(members.where(near), F.lit(1.0), d_n))


def copies(r: Column, doc_id: Column, key: Column) -> Column:
    u = F.pmod(F.xxhash64(doc_id, key, F.lit("mix")), F.lit(1 << 30)) / (1 << 30)
    return F.floor(r + u).cast("int")


def mixing_totals(docs: DataFrame, labels: DataFrame, weights: tuple[float, ...] = WEIGHTS) -> DataFrame:
    """domain, target, expected (at the rates) and copied (after rounding) tokens."""
    members = memberships(docs, labels)
    r = rate(F.col("p"), fit_rates(members, weights))
    s, e, c = totals(members, F.lit(1.0), len(weights)), totals(members, r, len(weights)), totals(members, copies(r, F.col("doc_id"), F.col("_k")), len(weights))
    rows = [(DOMAINS[d], s[0] / weights[0] * w, e[d], c[d]) for d, w in enumerate(weights)]
    return docs.sparkSession.createDataFrame(rows, "domain string, target double, expected double, copied double")


def mixing_report(docs: DataFrame, labels: DataFrame, weights: tuple[float, ...] = WEIGHTS) -> DataFrame:
    """Per row: doc_id, tokens, one posterior a domain, rate, copies."""
    members = memberships(docs, labels)
    rated = members.select("*", rate(F.col("p"), fit_rates(members, weights)).alias("rate"))
    return rated.select("doc_id", "tokens", *[F.get("p", d).alias(f"p_{name}") for d, name in enumerate(DOMAINS)], "rate", copies(F.col("rate"), F.col("doc_id"), F.col("_k")).alias("copies"))


def mix(docs: DataFrame, labels: DataFrame, weights: tuple[float, ...] = WEIGHTS) -> DataFrame:
    """``docs`` with every row as often as its rate says; all columns as they were."""
    members = memberships(docs, labels)
    r = rate(F.col("p"), fit_rates(members, weights))
    # rows that stay as they are need no decision, so only the others are matched
    odd = members.select(F.col("doc_id").alias("_qd"), F.col("_k").alias("_qk"), copies(r, F.col("doc_id"), F.col("_k")).alias("_qc")).where("_qc != 1").distinct()
    joined = docs.join(odd, docs.doc_id.eqNullSafe(odd._qd) & (F.xxhash64(docs.text) == odd._qk), "left")
    times = F.coalesce(odd._qc, F.lit(1))
    more = joined.where(times > 0)
    # the row travels whole, so that no column of its own can clash
    return more.select(F.struct(*[docs[c] for c in docs.columns]).alias("_row"), F.explode(F.array_repeat(F.lit(0), times))).select("_row.*")
