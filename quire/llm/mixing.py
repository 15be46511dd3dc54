"""Mixing to target weights by soft domain membership."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm.common import Scratch, unused

#: Passes over the posteriors at most, and the distance from the targets, as a share of all tokens, that ends them.
PASSES, TOLERANCE = 40, 1e-7
_SPACE = r"[\x20\x09-\x0D]+"


def _tokens(text: Column) -> Column:
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), _SPACE), lambda t: t != "")


@dataclass
class DomainModel:
    """A softmax regression on which of at most `n_features` words a text has: a few kB, whatever the input."""

    domains: list[str]
    base: list[float]
    weights: dict[str, list[float]]

    def posterior(self, tokens: Column) -> Column:
        """The probabilities of the domains given a text's words, as array<double>."""
        if len(self.domains) == 1:
            return F.array(F.lit(1.0))
        if not self.weights:
            return F.array(*(F.lit(math.exp(b) / sum(map(math.exp, self.base))) for b in self.base))
        known = sorted(self.weights)
        present = F.array_intersect(tokens, F.array(*map(F.lit, known)))

        table = F.create_map(*(x for token in known for x in (F.lit(token), F.array(*map(F.lit, self.weights[token])))))
        base = F.array(*map(F.lit, self.base))
        logits = F.aggregate(present, base, lambda total, token: F.zip_with(total, F.element_at(table, token), lambda a, b: a + b))
        # each step is bound once by a lambda, as columns that are named twice are computed twice
        odds = _bound(logits, lambda x: F.transform(x, lambda y: F.exp(y - F.array_max(x))))
        return _bound(odds, lambda x: F.transform(x, lambda y: y / F.aggregate(x, F.lit(0.0), lambda a, z: a + z)))


def _bound(value: Column, body: Callable[[Column], Column]) -> Column:
    return F.element_at(F.transform(F.array(value), body), 1)


def fit_domains(docs: DataFrame, labels: DataFrame, scratch: Scratch, max_labelled: int = 8_000, n_features: int = 256, seed: int = 8) -> DomainModel:
    """Learns domains from `labels` (doc_id, domain): at most `max_labelled` labelled documents, those of smallest hash, so every
    domain has its share. The words kept are those whose document counts depart most (chi-square) from the same in each domain;
    counting and choosing them is a distributed sum. The driver gets which of them each of the sampled documents has, and fits the weights.
    Without a labelled document there is no domain."""
    once = labels.where("domain IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("domain").alias("domain"))
    once = once.join(docs.select("doc_id").distinct(), "doc_id", "left_semi")
    sample = F.broadcast(once.orderBy(F.xxhash64(F.lit(seed), "doc_id")).limit(max_labelled))
    chosen = docs.select("doc_id", "text").join(sample, "doc_id").groupBy("doc_id", "domain").agg(F.min("text").alias("text"))  # one row a key
    words = scratch.save(chosen.select("doc_id", "domain", F.array_distinct(_tokens(F.col("text"))).alias("words")), "sample")
    totals = {r["domain"]: r["n"] for r in words.groupBy("domain").agg(F.count("*").alias("n")).collect()}
    domains = sorted(totals)
    if not domains:
        return DomainModel([], [], {})
    n = np.array([totals[d] for d in domains], dtype=float)
    each = [F.sum((F.col("domain") == d).cast("int")).alias(f"n{i}") for i, d in enumerate(domains)]
    counts = words.select("domain", F.explode("words").alias("word")).groupBy("word").agg(F.count("*").alias("n"), *each).where("n >= 10")
    chi = sum(F.pow(F.col(f"n{i}") - F.col("n") * n[i] / n.sum(), F.lit(2)) / (F.col("n") * n[i] / n.sum()) for i in range(len(domains)))
    best = counts.withColumn("chi", chi).orderBy(F.desc("chi"), "word").limit(n_features).collect() if len(domains) > 1 else []
    known = sorted(r["word"] for r in best)
    if not known:
        return DomainModel(domains, [float(x) for x in np.log(n / n.sum())], {})
    seen = words.select("domain", F.array_intersect("words", F.array(*map(F.lit, known))).alias("words")).collect()
    scratch.drop("sample")
    place = {w: k for k, w in enumerate(known)}
    x = np.zeros((len(seen), len(known) + 1))
    x[:, -1] = 1.0
    for i, r in enumerate(seen):
        x[i, [place[w] for w in r["words"]]] = 1.0
    fitted = _softmax(x, np.array([domains.index(r["domain"]) for r in seen]), len(domains))
    return DomainModel(domains, fitted[-1].tolist(), {w: fitted[k].tolist() for w, k in place.items()})


def _softmax(x: np.ndarray, y: np.ndarray, d: int, penalty: float = 2e-4, rounds: int = 400) -> np.ndarray:
    """Weights (features, domains) of a softmax regression, by accelerated gradient steps; the last feature is constant."""
    target = np.eye(d)[y]
    step = 1 / (0.5 * float(np.linalg.eigvalsh(x.T @ x / len(x))[-1]) + penalty)
    w = v = np.zeros((x.shape[1], d))
    for k in range(rounds):
        z = x @ v
        p = np.exp(z - z.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        new = v - step * (x.T @ (p - target) / len(x) + penalty * v)
        v, w = new + k / (k + 3) * (new - w), new
    return w


def with_posterior(docs: DataFrame, model: DomainModel, text: str = "text", n_tokens: str = "n_tokens", prefix: str = "p") -> DataFrame:
    """`docs` with the number of words and the posterior's columns, `prefix` with 0, 1, ..."""
    words, odds = unused(docs, "_words", "_odds")
    rows = docs.withColumn(words, _tokens(F.col(text)))
    rows = rows.withColumn(n_tokens, F.size(words).cast("long"))
    if model.domains:
        rows = rows.withColumn(odds, model.posterior(F.col(words)))
    for d in range(len(model.domains)):
        rows = rows.withColumn(f"{prefix}{d}", F.col(odds)[d])
    return rows.drop(words, odds)


def rate(moved: list[float], prefix: str = "p") -> Column:
    """A document's rate: the projection on the nonnegative numbers of 1 less its posterior times what the gradient steps add up to."""
    now = F.lit(1.0)
    for d, x in enumerate(moved):
        now = now - F.col(f"{prefix}{d}") * F.lit(float(x))
    return F.greatest(F.lit(0.0), now)


def fit_rates(rows: DataFrame, domains: list[str], weights: dict[str, float], anchor: str | None = None, n_tokens: str = "n_tokens", prefix: str = "p", passes: int = PASSES) -> list[float]:
    """The sum of the projected gradient steps that bring expected domain token totals to their targets.

    `rows` has n_tokens (t) and p0, p1, ... (p); least squares minimises half the square of e = sum(rate t p) - target over nonnegative
    rates, starting from 1 for every document. Distances between rates are weighed by tokens, so a document's gradient is p . e.
    Projected gradient in its lazy form adds up the steps and projects the sum: after steps v1, v2, ..., each a scaled e, a rate is
    max(0, 1 - p . (v1 + v2 + ...)). So rates need not be stored, as they follow from a document's p and the D numbers of the sum, and of
    all rates that meet the targets they tend to those nearest to 1: they have the form that this optimum has, the sum being its multipliers.
    A pass is one distributed sum of e and of the D x D Gram matrix G = sum(t p p') of the documents with positive
    rates. A step is scaled by the inverse of G, which ends the error at once if no rate begins or ceases to be cut; while that doesn't
    bring the totals nearer it is halved, three times, and then scaled by the largest eigenvalue that G had at first. A lost executor costs one sum.

    Domains without a weight get 0; weights of domains that were not learnt are left out and the others scaled up. The targets
    add up to the tokens there are, or to as many as leave the `anchor` domain its own total. For targets that no
    nonnegative rates meet, the nearest of `passes` passes is taken.
    """
    d = len(domains)
    share = np.array([max(0.0, weights.get(x, 0.0)) for x in domains])
    share = share / share.sum() if share.sum() > 0 else np.full(d, 1 / max(d, 1))

    def sums(moved: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        r, t, p = F.col("r"), F.col(n_tokens).cast("double"), [F.col(f"{prefix}{i}") for i in range(d)]
        totals = [F.sum(r * t * x) for x in p]
        gram = [F.sum(F.when(r > 0, t * p[i] * p[j]).otherwise(0.0)) for i in range(d) for j in range(i + 1)]
        rated = rows.select(n_tokens, *p, rate(moved.tolist(), prefix).alias("r"))
        got = np.array([x or 0.0 for x in rated.agg(*(c.alias(f"c{k}") for k, c in enumerate([*totals, *gram]))).first()])
        matrix = np.zeros((d, d))
        matrix[np.tril_indices(d)] = got[d:]
        return got[:d], np.tril(matrix) + np.tril(matrix, -1).T

    moved = best = np.zeros(d)
    if not d:
        return []
    now, gram = sums(moved)
    natural = now.sum()
    if not natural:
        return best.tolist()
    target = share * natural
    if anchor in domains and share[domains.index(anchor)] > 0:
        target = share * now[domains.index(anchor)] / share[domains.index(anchor)]
    error, spent, steepest = float(np.linalg.norm(now - target)), 1, float(np.linalg.eigvalsh(gram)[-1])
    least = error
    while spent < passes and least > TOLERANCE * natural:
        values, vectors = np.linalg.eigh(gram)
        keep = values > 1e-9 * values[-1]
        if not keep.any():  # every rate is 0
            break
        scaled = (vectors[:, keep] / values[keep]) @ (vectors[:, keep].T @ (now - target))
        for v in (scaled, scaled / 2, scaled / 4, scaled / 8, (now - target) / steepest):
            totals, matrix = sums(moved + v)
            spent += 1
            off = float(np.linalg.norm(totals - target))
            if off < 0.999 * error or spent >= passes:
                break
        moved, now, gram, error = moved + v, totals, matrix, off
        if error < least:
            best, least = moved, error
    return best.tolist()


def copies(seed: int, key: Column, n_tokens: Column, rated: Column) -> Column:
    """How often a document is taken: its rate rounded up or down by a seeded hash, so that the expectation is the rate."""
    chance = F.pmod(F.xxhash64(F.lit(seed), key, n_tokens), F.lit(1 << 30)) / float(1 << 30)
    return (F.floor(rated) + (chance < rated - F.floor(rated)).cast("long")).cast("int")


def mix(docs: DataFrame, labels: DataFrame, weights: dict[str, float], scratch: Scratch, key: str = "doc_id", anchor: str | None = None, seed: int = 8) -> tuple[DataFrame, DomainModel, list[float]]:
    """((key, n_tokens, p0.., rate, copies) a row, the model, the sum of the gradient steps).

    Each text is read once, wholly: its word count and posterior are written to the shared folder, and the
    rates are fitted on those few numbers. Null and empty texts have no tokens and the prior as posterior; null keys and
    repeated rows each have their row; further columns are ignored, whatever their names; an empty table gives no rows. Where no document is labelled
    there are no domains: no p columns, and every rate is 1.
    """
    model = fit_domains(docs, labels, scratch)
    rows = scratch.save(with_posterior(docs.select(key, "text"), model).drop("text"), "posteriors")
    moved = fit_rates(rows, model.domains, weights, anchor)
    rated = rows.withColumn("rate", rate(moved))
    return rated.withColumn("copies", copies(seed, F.col(key), F.col("n_tokens"), F.col("rate"))), model, moved


def by_quality_and_toxicity(labels: DataFrame) -> DataFrame:
    """The label table's domains: toxic, else low, else good."""
    domain = F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 0, "low").when(F.col("quality") == 1, "good")
    return labels.select("doc_id", domain.alias("domain"))


def take(docs: DataFrame, labels: DataFrame, weights: dict[str, float], scratch: Scratch, key: str = "doc_id", anchor: str | None = None, seed: int = 8) -> DataFrame:
    """`docs` resampled to the weights: each row as many times as its copies, with its columns as they are.

    Each text is scored once: the rows are written with their posteriors, of which the fit reads just those. Rates are rounded to hundredths, so
    that a document the mixture leaves alone is taken once. An empty table, or one without a labelled document, is returned as it is.
    """
    model = fit_domains(docs, labels, scratch)
    if not model.domains:
        return docs
    n_tokens, rated, copy, texts = unused(docs, "_n_tokens", "_rate", "_copy", "_text")
    prefix = "_p"
    while any(c.lower().startswith(prefix) for c in docs.columns):
        prefix = "_" + prefix
    rows = scratch.save(with_posterior(docs.withColumnRenamed("text", texts), model, texts, n_tokens, prefix), "rows")
    moved = fit_rates(rows, model.domains, weights, anchor, n_tokens, prefix)
    rows = rows.withColumn(rated, F.round(rate(moved, prefix), 2))
    rows = rows.withColumn(copy, copies(seed, F.col(key), F.col(n_tokens), F.col(rated))).where(F.col(copy) > 0)
    taken = rows.withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(copy))))
    return taken.withColumnRenamed(texts, "text").select(*docs.columns)
