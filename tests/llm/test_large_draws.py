"""``op9_shard``'s draws beyond the bound of numpy's sampler, against the exact law."""

import math
from fractions import Fraction

import numpy as np
import pytest

from auditloom.llm.sharding import _hypergeometric, communication_matrix


def law(good, bad, draws):
    """Probabilities of 0..min(good, draws) in whole numbers, for a small ``good``."""
    def falling(n, k):
        return math.prod(range(n - k + 1, n + 1))

    # Which of the good ones are drawn, among all places of the total.
    return [float(Fraction(math.comb(good, x) * falling(draws, x) * falling(good + bad - draws, good - x), falling(good + bad, good))) for x in range(good + 1)]


@pytest.mark.parametrize("good, bad, draws", [(10, 2_000_000_000, 200_000_000), (3, 1_000_000_000, 700_000_000), (12, 5_000_000_000, 4_900_000_000)])
def test_draws_follow_the_exact_law(good, bad, draws):
    rng, n = np.random.default_rng(11), 4000
    found = np.bincount([_hypergeometric(rng, good, bad, draws) for _ in range(n)], minlength=good + 1)
    want = np.array(law(good, bad, draws)) * n
    assert want.sum() == pytest.approx(n)
    large = want >= 5
    chi = ((found - want)[large] ** 2 / want[large]).sum()
    assert chi < large.sum() + 5 * math.sqrt(2 * large.sum())


def test_moments_and_support_of_wide_draws():
    good, bad, draws = 900_000_000, 2_100_000_000, 262_144
    rng, n = np.random.default_rng(3), 3000
    x = np.array([_hypergeometric(rng, good, bad, draws) for _ in range(n)])
    p, total = good / (good + bad), good + bad
    spread = math.sqrt(draws * p * (1 - p) * (total - draws) / (total - 1))
    assert abs(x.mean() - draws * p) < 5 * spread / math.sqrt(n) and abs(x.std() / spread - 1) < 0.07
    for g, b, d in ((1_000_000_000, 1, 1_000_000_000), (1, 1_000_000_000, 1), (999_999_999, 5, 1_000_000_003)):
        x = _hypergeometric(rng, g, b, d)
        assert max(0, d - b) <= x <= min(g, d)


def test_sums_of_a_large_matrix():
    counts, room = [700_000_000, 500_000_003, 1, 0], [400_000_001] * 3
    room[0] += sum(counts) - sum(room)
    m = communication_matrix(counts, room, 7)
    assert (m.sum(1) == counts).all() and (m.sum(0) == room).all() and (m >= 0).all()
