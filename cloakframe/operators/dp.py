"""(epsilon, delta)-differential privacy by random sampling and k-anonymity."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cloakframe.definition import Definition
from cloakframe.functions.hashing import order_hash, uniform
from cloakframe.operators import lattice as L
from cloakframe.operators.anonymize import publish
from cloakframe.operators.privacy import KAnonymity


def sampling_rate(epsilon: float) -> float:
    return 1.0 - math.exp(-epsilon)


def _tail(n: int, gamma: float, beta: float) -> float:
    """P(X > gamma n) for X ~ Binomial(n, beta)."""
    j = math.floor(gamma * n) + 1
    if j > n:
        return 0.0
    term = math.exp(
        math.lgamma(n + 1) - math.lgamma(j + 1) - math.lgamma(n - j + 1)
        + j * math.log(beta) + (n - j) * math.log1p(-beta))
    total = 0.0
    # Above the mean terms fall at least geometrically; what no longer changes the sum is left out.
    while j <= n and total + term != total:
        total += term
        term *= (n - j) / (j + 1) * beta / (1 - beta)
        j += 1
    return total


def class_size_for(epsilon: float, delta: float) -> int:
    """Smallest k whose worst tail beyond ceil(k/gamma - 1) stays within delta.

    The tail for n is at most exp(-n D(gamma || beta)), so that the last n with a larger one is
    looked for downwards from log(1 / delta) / D.
    """
    beta = sampling_rate(epsilon)
    gamma = (math.exp(epsilon) - 1.0 + beta) / math.exp(epsilon)
    divergence = gamma * math.log(gamma / beta) + (1 - gamma) * math.log((1 - gamma) / (1 - beta))
    last = math.ceil(-math.log(delta) / divergence)
    bad = next((n for n in range(last, 0, -1) if _tail(n, gamma, beta) > delta), 0)
    k = max(1, math.floor(gamma * bad))
    while max(1, math.ceil(k / gamma - 1)) <= bad:
        k += 1
    return k


def medium_node(definition: Definition, degree: float = 0.5) -> dict[str, int]:
    """A generalization fixed before looking at the data."""
    return {q: math.floor(h * degree + 0.5) for q, h in zip(definition.qid, definition.heights)}


def bernoulli(df: DataFrame, rate: float, ids: Sequence[str], seed: int) -> DataFrame:
    """Each row with its own chance; the seed must stay secret in earnest use."""
    return df.filter(uniform(order_hash(seed, ids)) < F.lit(rate))


def publish_dp(df: DataFrame, definition: Definition, node: dict[str, int], epsilon: float, delta: float, ids: Sequence[str], seed: int) -> DataFrame:
    """Sample, generalize to a fixed node, suppress small classes."""
    sample = bernoulli(df, sampling_rate(epsilon), ids, seed)
    return publish(sample, definition, node, [KAnonymity(class_size_for(epsilon, delta))])


def choose_node(df: DataFrame, definition: Definition, epsilon: float, delta: float, budget: float, ids: Sequence[str], seed: int) -> DataFrame:
    """Exponential mechanism over all nodes in one plan.

    The score of a node is the number of sampled rows it can show times the share of
    information they keep; one row more or less changes it by at most k rows.
    """
    k = class_size_for(epsilon - budget, delta)
    sample = bernoulli(df, sampling_rate(epsilon - budget), ids, seed)
    scored = L.scores(sample, definition, [KAnonymity(k)], L.Quality("loss", 0.5), 1.0)
    utility = (F.lit(1.0) - F.col("loss")) * F.col("rows")
    u = F.greatest(uniform(order_hash(f"{seed}|node", ["node"])), F.lit(1e-12))
    gumbel = -F.log(-F.log(u))
    noisy = scored.withColumn("noisy", F.lit(budget / (2.0 * k)) * utility + gumbel)
    best = F.max_by(F.struct(*noisy.columns), F.struct(F.col("noisy"), F.col("node")))
    return noisy.agg(best.alias("b")).select("b.*")
