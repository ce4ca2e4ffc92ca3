"""Mixing to target weights by soft membership.

A naive Bayes classifier, learnt from the labelled table, gives every text's posteriors over domains. Its evidence is
which word stems of a lexicon a text holds - those that mark a domain most surely by their log likelihood ratio; their log
odds are summed for each domain and binned - and a few binned shares (signs, capitals, bars, repeated words, length).

Distributed projected gradient then fits a nonnegative rate for each document, so that the expected tokens of each domain,
sum(rate * tokens * posterior), match the target weights: least squares over the residuals T_c(r) - t_c with r >= 0, from
r = 1. A step follows the gradient as it is, or scaled by the inverse of the domains' second moments over documents with a
positive rate, a matrix as small as the domains are few; one pass sums all steps tried and the best is taken. Rates are a
function of posteriors and of the steps so far, so nothing is kept between steps but sums. The fit ends when no residual
is over TOLERANCE of all tokens, or when steps no longer help: targets that no nonnegative rates can meet end at the
nearest found. What was reached is given out beside what was wanted. All work is DataFrame functions.

Null texts count as empty: no tokens, never copied more or less than their posterior says. Repeated rows are documents
each. Extra columns are ignored. Without labels all domains are equally likely. A target for a domain without any mass
cannot be met and is left out. An empty table gives an empty result.
"""

from __future__ import annotations

import math

import numpy as np
import pyspark.sql.functions as F
from pyspark.sql import Column, DataFrame

from .common import drop, keeps_columns, materialize

DOMAINS = ("clean", "low", "toxic")
TARGETS = {"clean": 0.90, "low": 0.05, "toxic": 0.05}
#: Labelled texts that are learnt from, at most; words in the lexicon; weight of binned shares; steps at most; error that ends them.
SAMPLE, LEXICON, EVIDENCE, STEPS, TOLERANCE = 20_000, 256, 1.0, 40, 1e-4
#: Least log likelihood ratio of a word in the lexicon, and its least log odds for a domain.
SURE, ODDS = 30.0, 1.5
#: Share of the error that a step must take away.
HELPS = 0.01
#: Lengths that are tried for a step.
LENGTHS, PLAIN_LENGTHS = (2.0, 1.0, 0.5, 0.25, 0.125), (64.0, 16.0, 4.0, 1.0)
#: Letters of a word that count.
STEM = 5
_BINS, _FEATURES = 8, 8
#: What stands between words.
_SIGNS = r"\s.,!?;:|\"()\[\]{}#$%&*+=@^~`<>/\\"


def domain_labels(labels: DataFrame) -> DataFrame:
    """(doc_id, domain number): toxic before low before clean; rows without a label don't count, repeated ones once."""
    domain = F.when(F.col("toxic") == 1, 2).when(F.col("quality") == 0, 1).when(F.col("quality") == 1, 0)
    rows = labels.select(F.col("doc_id").cast("long").alias("doc_id"), domain.alias("domain")).filter("doc_id is not null and domain is not null")
    return rows.groupBy("doc_id").agg(F.max("domain").alias("domain"))


def _stems(text: Column) -> Column:
    """The first letters of each word, so that inflected words count as one."""
    return F.regexp_extract_all(F.lower(text), F.lit(rf"([^{_SIGNS}]{{1,{STEM}}})[^{_SIGNS}]*"), 1)


def _log_bin(share: Column) -> Column:
    """0 for nothing, then halvings of the share: 7 for over a half."""
    return F.when(share <= 0, 0).otherwise(F.greatest(F.lit(1), F.lit(8) + F.floor(F.log2(share)))).cast("int")


def _log_odds_bin(odds: Column) -> Column:
    """0 for none in favour, 1 to 8 by doubling from 2 on."""
    return F.when(odds <= 0, 0).otherwise(F.greatest(F.lit(1), F.least(F.lit(_BINS), F.floor(F.log2(odds)) + 1))).cast("int")


def features(docs: DataFrame, lexicon: dict[str, list[float]]) -> DataFrame:
    """(doc_id, uid, tokens, bins): the text's words, and its evidence as bins: shares, and what the lexicon says for each domain."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("doc_id", text).alias("uid"), text.alias("text"))
    rows = rows.withColumn("words", _stems(F.col("text"))).withColumn("n", F.greatest(F.length("text"), F.lit(1)))
    share = lambda signs: F.regexp_count("text", F.lit(signs)) / F.col("n")
    listed = F.array(*(F.lit(w) for w in lexicon)).cast("array<string>")
    weights = F.array(*(F.array(*(F.lit(float(x)) for x in row)) for row in lexicon.values())).cast("array<array<double>>")
    held = F.transform(F.array_intersect("stems", listed), lambda w: F.element_at(weights, F.array_position(listed, w).cast("int")))
    none = F.array(*(F.lit(0.0) for _ in DOMAINS))
    said = F.aggregate(held, none, lambda a, x: F.array(*(a[i] + x[i] for i in range(len(DOMAINS))))) if lexicon else none
    bins = F.array(
        _log_bin(share("!")),
        _log_bin(share("[#$%&*]")),
        _log_bin(share("[|]")),
        _log_bin(share("[A-Z]")),
        _log_bin(F.size("stems") / F.greatest(F.size("words"), F.lit(1))),
        F.least(F.floor(F.log2(F.size("words") + 1) / 2), F.lit(_BINS - 1)).cast("int"),
        *(_log_odds_bin(F.element_at("said", d + 1) - F.element_at("said", 1)) for d in (1, 2)),
    )
    return rows.withColumn("stems", F.array_distinct("words")).withColumn("said", said).select("doc_id", "uid", F.size("words").cast("long").alias("tokens"), bins.alias("bins"))


def learn(docs: DataFrame, labels: DataFrame) -> tuple[dict[str, list[float]], DataFrame]:
    """The lexicon: words with their log odds against all texts for each domain; and a bounded sample (doc_id, domain) of the labelled rows."""
    known = domain_labels(labels).orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE)
    text = F.coalesce(F.col("text"), F.lit(""))
    held = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text")).join(F.broadcast(known), "doc_id")
    n = {r.domain: r["count"] for r in held.groupBy("domain").count().collect()}
    words = held.select("domain", F.explode(F.array_distinct(_stems(F.col("text")))).alias("word"))
    counts = words.groupBy("word").agg(F.count("*").alias("all"), *(F.count(F.when(F.col("domain") == d, 1)).alias(f"n{d}") for d in range(len(DOMAINS))))
    total = sum(n.values())
    pooled = F.log((F.col("all") + 0.5) / (total + 1.0))
    odds = [F.log((F.col(f"n{d}") + 0.5) / (n.get(d, 0) + 1.0)) - pooled for d in range(len(DOMAINS))]

    def ratio(d: int) -> Column:
        """The log likelihood ratio for a word that a domain's texts hold more often than others; 0 else."""
        part = lambda seen, hoped: F.when(seen > 0, seen * F.log(seen / hoped)).otherwise(0.0)
        a, m = F.col(f"n{d}").cast("double"), n.get(d, 0)
        b, c, rest = F.col("all") - a, m - a, total - m - F.col("all") + a
        share = F.col("all") / total
        hoped = [m * share, (total - m) * share, m * (1 - share), (total - m) * (1 - share)]
        g = sum((part(x, h) for x, h in zip((a, b, c, rest), hoped, strict=True)), F.lit(0.0))
        return F.when(odds[d] > ODDS, 2 * g).otherwise(0.0)

    marked = counts.filter("all >= 3").withColumn("sure", F.greatest(*(ratio(d) for d in range(len(DOMAINS))))).filter(F.col("sure") > SURE)
    top = marked.orderBy(F.desc("sure"), "word").limit(LEXICON).select("word", *(o.alias(f"o{d}") for d, o in enumerate(odds)))
    return {r.word: [r[f"o{d}"] for d in range(len(DOMAINS))] for r in top.collect()}, known


def posteriors(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, uid, tokens, p): p holds a posterior for each of DOMAINS."""
    lexicon, known = learn(docs, labels)
    rows = materialize(features(docs, lexicon), "features")
    counts = rows.join(F.broadcast(known), "doc_id").select("domain", F.posexplode("bins").alias("feature", "bin")).groupBy("domain", "feature", "bin").count().collect()
    total = {d: sum(r["count"] for r in counts if r.domain == d and r.feature == 0) for d in range(len(DOMAINS))}
    seen = sum(total.values())
    table = {(r.domain, r.feature, r.bin): r["count"] for r in counts}
    width = 9
    logs = []
    for d in range(len(DOMAINS)):
        score = F.lit(math.log((total[d] + 1) / (seen + len(DOMAINS))))
        for f in range(_FEATURES):
            row = F.array(*(F.lit(math.log((table.get((d, f, b), 0) + 0.5) / (total[d] + 0.5 * width))) for b in range(width)))
            score = score + (EVIDENCE if f < _FEATURES - 2 else 1.0) * F.element_at(row, F.element_at("bins", f + 1) + 1)
        logs.append(score)
    rows = rows.withColumn("logs", F.array(*logs)).withColumn("logs", F.transform("logs", lambda x: F.exp(x - F.array_max("logs"))))
    whole = F.aggregate("logs", F.lit(0.0), lambda a, x: a + x)
    return rows.select("doc_id", "uid", "tokens", F.transform("logs", lambda x: x / whole).alias("p"))


def _rate(steps: list[list[float]]) -> Column:
    """r = 1, then for each step r = max(0, r - p . step)."""
    if not steps:
        return F.lit(1.0)
    moves = F.array(*(F.array(*(F.lit(float(x)) for x in s)) for s in steps))
    dot = lambda g: sum((F.element_at("p", c + 1) * F.element_at(g, c + 1) for c in range(len(DOMAINS))), F.lit(0.0))
    return F.aggregate(moves, F.lit(1.0), lambda r, g: F.greatest(F.lit(0.0), r - dot(g)))


def fit_rates(rows: DataFrame, targets: dict[str, float], thin: bool = False) -> tuple[DataFrame, dict]:
    """rows with rate, and what was reached: expected tokens by domain, the wanted ones, the steps, and whether the targets are met.

    thin: targets of all domains but the first are upper bounds; none is raised above its present share, and the first
    domain's tokens stay as they are: the others are thinned out to their share of the whole."""
    rows = materialize(rows, "posteriors")
    d = len(DOMAINS)
    p = [F.element_at("p", c + 1) for c in range(d)]

    def sums(steps: list[list[float]], tried: list[list[float]]) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each step tried after steps: expected tokens by domain, and the domains' second moments over documents with a positive rate."""
        after = lambda step: F.greatest(F.lit(0.0), F.col("r") - sum((F.lit(x) * y for x, y in zip(step, p, strict=True)), F.lit(0.0)))
        live = rows.withColumn("r", _rate(steps)).select("tokens", "p", *(after(step).alias(f"r{i}") for i, step in enumerate(tried)))
        wanted = []
        for i in range(len(tried)):
            r = F.col(f"r{i}")
            wanted += [F.sum(r * F.col("tokens") * x) for x in p] + [F.sum(F.when(r > 0, F.col("tokens") * p[a] * p[b]).otherwise(0)) for a in range(d) for b in range(d)]
        got = np.array([x or 0.0 for x in live.agg(*wanted).first()]).reshape(len(tried), d + d * d)
        return [(x[:d], x[d:].reshape(d, d)) for x in got]

    ((mass, every),) = sums([], [[0.0] * d])
    reached, moments = mass, every
    total = mass.sum()
    weight = np.array([targets.get(x, 0.0) if m > 0 else 0.0 for x, m in zip(DOMAINS, mass, strict=True)])
    wanted = np.zeros(d)
    if total > 0 and weight.sum() > 0:
        weight = weight / weight.sum()
        if thin and mass[0] > 0 and weight[0] > 0:
            wanted = np.minimum(mass, mass[0] / weight[0] * weight)
            wanted[0] = mass[0]
        else:
            wanted = weight * total
    steps: list[list[float]] = []
    while total and len(steps) < STEPS and np.abs(reached - wanted).max() > TOLERANCE * total:
        # the gradient in the metric of the active documents, and as it is: the first is fast, the second surely helps
        left = reached - wanted
        fast, plain = np.linalg.pinv(moments, rcond=1e-9, hermitian=True) @ left, left / max(np.linalg.norm(every, 2), 1e-300)
        tries = [(step * x).tolist() for step, lengths in ((fast, LENGTHS), (plain, PLAIN_LENGTHS)) for x in lengths]
        tried = sums(steps, tries)
        error = [float(np.linalg.norm(got - wanted)) for got, _ in tried]
        i = int(np.argmin(error))
        if error[i] > (1 - HELPS) * float(np.linalg.norm(left)):
            break
        steps.append(tries[i])
        reached, moments = tried[i]
    met = not total or bool(np.abs(reached - wanted).max() <= TOLERANCE * total)
    said = {"reached": dict(zip(DOMAINS, reached.tolist(), strict=True)), "wanted": dict(zip(DOMAINS, wanted.tolist(), strict=True)), "steps": steps, "met": met}
    return rows.withColumn("rate", _rate(steps)), said


def copies(rates: DataFrame) -> DataFrame:
    """rates with copies: the rate's whole part, and one more with the rest's probability by a hash of the row."""
    u = F.pmod(F.xxhash64(F.lit("mixing"), "doc_id", "uid"), F.lit(1_000_000)) / 1_000_000
    return rates.withColumn("copies", (F.floor("rate") + F.when(u < F.col("rate") - F.floor("rate"), 1).otherwise(0)).cast("int"))


def mixed(docs: DataFrame, labels: DataFrame, targets: dict[str, float] | None = None, thin: bool = False) -> tuple[DataFrame, dict]:
    """(doc_id, uid, tokens, p, rate, copies) for every row of docs, and what the fit reached."""
    rates, said = fit_rates(posteriors(docs, labels), targets or TARGETS, thin)
    return copies(rates), said


@keeps_columns
def repeat_by_rate(docs: DataFrame, labels: DataFrame, targets: dict[str, float] | None = None, thin: bool = False) -> DataFrame:
    """docs with each row as often as its rate says; columns stay."""
    rows = materialize(mixed(docs, labels, targets, thin)[0].select("doc_id", F.col("uid").alias("_uid"), F.col("copies").alias("_copies")).dropDuplicates(["doc_id", "_uid"]), "copies")
    # most rows stay once: only the others need the join
    own = docs.withColumn("_uid", F.xxhash64("doc_id", F.coalesce(F.col("text"), F.lit(""))))
    joined = own.join(rows.filter("_copies <> 1"), (own["doc_id"].eqNullSafe(rows["doc_id"])) & (own["_uid"] == rows["_uid"]), "left").drop(rows["doc_id"]).drop(rows["_uid"])
    times = F.coalesce("_copies", F.lit(1))
    return joined.filter(times > 0).withColumn("_turn", F.explode(F.sequence(F.lit(1), times))).select(*docs.columns)
