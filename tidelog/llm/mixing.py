"""Document rates that bring expected domain token totals to given targets.

A classifier learned from the labelled table gives every document posterior
probabilities of its domains. Rates r >= 0 then minimise

    d' M^-1 d  with  d[k] = sum over i of p[i,k] * t[i] * r[i] - target[k]

over documents i with t[i] tokens, where M[k,l] = sum of p[i,k] * p[i,l] * t[i],
from r = 1 by projected gradient steps in the inner product weighted with
tokens, so that a rate does not depend on a document's length. M makes the
steps' best length 1 and one step enough while no rate meets 0. A step needs
one vector of residuals, one number a domain; a document's rate is a fold over
those vectors, and documents with equal posteriors are summed before the first
step. Everything is DataFrame
operations; what reaches the driver is a number for each domain, feature and
bin.
"""

from __future__ import annotations

import math
import warnings
from collections.abc import Mapping

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelog.llm import shared

#: Shares of all tokens that each domain gets by default.
TARGETS = {"good": 0.95, "poor": 0.05}
#: Bins of each feature of the classifier.
BINS = 24
ROUNDS = 40
#: Steps end when no domain's total is further from its target than this share of all tokens.
CLOSE = 1e-5
MOST_DOMAINS = 64


def tokens(text: Column) -> Column:
    """Runs of anything but white space; none for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"\S+")), F.lit(0)).cast("long")


def _bin(share: Column) -> Column:
    return F.least(F.floor(F.log1p(1000.0 * share) * 3.0), F.lit(BINS - 1)).cast("int")


def features(text: Column) -> list[Column]:
    """Bins of the shares of kinds of characters, of white space, and of the length."""
    length = F.greatest(F.coalesce(F.length(text), F.lit(0)), F.lit(1)).cast("double")

    def share(pattern: str) -> Column:
        return F.coalesce(F.regexp_count(text, F.lit(pattern)), F.lit(0)) / length

    return [_bin(share("[#$%&*|!<>=@^~_]")), _bin(share("[A-Z]")), _bin(share("[0-9]")), _bin(share("\n")), F.least(F.floor(F.log2(length)), F.lit(BINS - 1)).cast("int")]


def domains(labels: DataFrame) -> DataFrame:
    """``(label_id, domain)``: ``poor`` or ``good`` by quality, ``poor`` if repeated labels differ; rows without an id or a label are left out."""
    kind = F.when(F.col("quality") == 0, "poor").when(F.col("quality") == 1, "good")
    rows = labels.select(F.col("doc_id").cast("long").alias("label_id"), kind.alias("domain")).where("label_id is not null and domain is not null")
    return rows.groupBy("label_id").agg(F.max("domain").alias("domain"))


class Rates:
    """Posteriors and rates as columns over a column of texts."""

    def __init__(self, names: list[str], prior: list[float], likelihood: list[list[list[float]]]):
        self.names, self.prior, self.likelihood = names, prior, likelihood
        self.steps: list[list[float]] = []
        #: Tokens of each domain at rate 1, wanted, and reached, and whether all are close enough.
        self.start: list[float] = []
        self.wanted: list[float] = []
        self.reached: list[float] = []
        self.met = True

    def posterior(self, bins: list[Column]) -> Column:
        """An array with the probability of each domain, rounded to 6 places so that equal ones meet."""
        logs = []
        for k in range(len(self.names)):
            log = F.lit(self.prior[k])
            for f, b in enumerate(bins):
                log = log + F.element_at(F.lit(self.likelihood[k][f]), b + 1)
            logs.append(log)
        top = F.greatest(*logs) if len(logs) > 1 else logs[0]
        odds = F.transform(F.array(*logs), lambda x: F.exp(x - top))
        total = F.aggregate(odds, F.lit(0.0), lambda acc, x: acc + x)
        return F.transform(odds, lambda x: F.round(x / total, 6))

    def rate(self, posterior: Column) -> Column:
        """The rate after all steps so far."""
        if not self.steps:
            return F.lit(1.0)

        def step(r: Column, g: Column) -> Column:
            dot = F.aggregate(F.zip_with(posterior, g, lambda p, x: p * x), F.lit(0.0), lambda acc, x: acc + x)
            return F.greatest(F.lit(0.0), r - dot)

        return F.aggregate(F.array(*(F.lit(g) for g in self.steps)), F.lit(1.0), step)


def _once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """A column that is computed once a row, however often what follows refers to it.

    The optimizer would put the expression in place of each reference.
    """
    return df.select("*", F.explode(F.array(value)).alias(name))


def fit(docs: DataFrame, labels: DataFrame, targets: Mapping[str, float] = TARGETS, rounds: int = ROUNDS) -> tuple[Rates, DataFrame]:
    """Rates for ``docs``, and a table ``(doc_id, tokens, posterior)`` with a row for each of them.

    The classifier is naive Bayes on binned shares of characters, from all
    labelled rows with a text. Domains without a target keep their tokens.
    Documents with null or empty texts have no tokens and the rate of their
    posterior. With no labelled row there is one domain, ``all``, and every
    rate tends to its target's share. Targets that no rates can meet end after
    ``rounds`` steps with the closest totals; the rates then say so in ``met``,
    and a warning names the domains.
    """
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), tokens(F.col("text")).alias("tokens"), F.array(*features(F.col("text"))).alias("bins"))
    table = shared.table(source, "features")
    known = table.select("doc_id", "bins").where("doc_id is not null").join(domains(labels), F.col("doc_id") == F.col("label_id"))
    counts = known.select("domain", F.posexplode("bins").alias("feature", "bin")).groupBy("domain", "feature", "bin").count().collect()
    names = sorted({r["domain"] for r in counts}) or ["all"]
    if len(names) > MOST_DOMAINS:
        raise ValueError(f"{len(names)} domains; at most {MOST_DOMAINS} are fitted")
    width = len(features(F.col("text")))
    tally = [[[0] * BINS for _ in range(width)] for _ in names]
    for r in counts:
        tally[names.index(r["domain"])][r["feature"]][r["bin"]] += r["count"]
    sizes = [sum(t[0]) for t in tally]
    prior = [math.log((n + 1) / (sum(sizes) + len(names))) for n in sizes]
    likelihood = [[[math.log((x + 0.5) / (sizes[k] + 0.5 * BINS)) for x in row] for row in tally[k]] for k in range(len(names))]
    rates = Rates(names, prior, likelihood)
    bins = [F.col("bins")[f] for f in range(width)]
    scored = _once(table.select("doc_id", "tokens", "bins"), "posterior", rates.posterior(bins)).drop("bins")
    # documents with equal posteriors move together
    groups = shared.table(scored.groupBy("posterior").agg(F.sum("tokens").cast("double").alias("tokens")), "posteriors")

    size = len(names)
    pairs = groups.agg(*(F.sum(F.col("posterior")[k] * F.col("posterior")[j] * F.col("tokens")).alias(f"m{k}_{j}") for k in range(size) for j in range(size))).first()
    m = np.array([x or 0.0 for x in pairs]).reshape(size, size)
    m += np.eye(size) * (1e-9 * np.trace(m) + 1e-12)

    def totals() -> list[float]:
        each = [F.sum(F.col("posterior")[k] * F.col("tokens") * F.col("rate")).alias(f"k{k}") for k in range(len(names))]
        return [x or 0.0 for x in groups.withColumn("rate", rates.rate(F.col("posterior"))).agg(*each).first()]

    start = totals()
    whole = sum(start)
    wanted = [targets[n] * whole if n in targets else start[k] for k, n in enumerate(names)]
    now = start
    for _ in range(rounds if whole else 0):
        if max(abs(a - b) for a, b in zip(now, wanted, strict=True)) <= CLOSE * whole:
            break
        rates.steps.append([float(x) for x in np.linalg.solve(m, np.subtract(now, wanted))])
        now = totals()
    rates.start, rates.wanted, rates.reached = start, wanted, now
    far = [n for n, a, b in zip(names, now, wanted, strict=True) if abs(a - b) > CLOSE * whole]
    rates.met = not far
    if far:
        warnings.warn(f"totals of {', '.join(far)} are not at their targets after {len(rates.steps)} steps", stacklevel=2)
    return rates, scored


def totals(docs: DataFrame, labels: DataFrame, targets: Mapping[str, float] = TARGETS) -> DataFrame:
    """``(domain, tokens, target, reached, met)``: expected tokens at rate 1, wanted, and at the fitted rates."""
    rates, _ = fit(docs, labels, targets)
    whole = sum(rates.start)
    rows = [(n, a, b, c, abs(b - c) <= CLOSE * whole) for n, a, b, c in zip(rates.names, rates.start, rates.wanted, rates.reached, strict=True)]
    return docs.sparkSession.createDataFrame(rows, "domain string, tokens double, target double, reached double, met boolean")


def _copies(rate: Column, doc_id: Column) -> Column:
    """The rate rounded up or down by the document's hash, in proportion."""
    u = F.pmod(F.xxhash64(doc_id, F.lit("copies")), F.lit(1 << 20)) / float(1 << 20)
    return F.floor(rate + u).cast("long")


def report(docs: DataFrame, labels: DataFrame, targets: Mapping[str, float] = TARGETS) -> DataFrame:
    """``(doc_id, tokens, p_<domain>..., rate, copies)`` for each row of ``docs``."""
    rates, scored = fit(docs, labels, targets)
    out = scored.withColumn("rate", F.round(rates.rate(F.col("posterior")), 6))
    each = [F.col("posterior")[k].alias(f"p_{n}") for k, n in enumerate(rates.names)]
    return out.select("doc_id", "tokens", *each, "rate", _copies(F.col("rate"), F.col("doc_id")).alias("copies"))


def mix(docs: DataFrame, labels: DataFrame, targets: Mapping[str, float] = TARGETS) -> DataFrame:
    """The rows of ``docs`` with a rate above 0, with columns ``rate`` and ``copies`` added or replaced."""
    rates, _ = fit(docs, labels, targets)
    columns = [c for c in docs.columns if c.lower() not in ("rate", "copies")]
    bins, posterior, rate = (shared.unused(docs, name) for name in ("bins", "posterior", "fitted"))
    out = _once(docs.select(*columns), bins, F.array(*features(F.col("text"))))
    out = _once(out, posterior, rates.posterior([F.col(bins)[k] for k in range(len(features(F.col("text"))))]))
    out = _once(out, rate, F.round(rates.rate(F.col(posterior)), 6))
    return out.select(*columns, F.col(rate).alias("rate"), _copies(F.col(rate), F.col("doc_id")).alias("copies")).where("rate > 0")
