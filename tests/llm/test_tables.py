"""Numbers of tables of a dish against their exact distribution, and against customers who move one by one."""

import random

import numpy as np
import pytest

from codelens.llm import pitman_yor, tables


@pytest.mark.parametrize("discount", [0.1, 0.5, 0.95])
def test_stirling_numbers(discount):
    want = tables.recursion(1500, discount)
    for c in (600, 1500):
        t = np.arange(1, c)
        off = np.abs(tables.log_stirling(np.full(c - 1, float(c)), t.astype(float), discount) - want[c, 1:c])
        assert off[: c * 9 // 10].max() < 1e-4 and off.max() < 3e-3


@pytest.mark.parametrize("customers, weight", [(9, 0.5), (300, 40.0), (1500, 0.2), (1500, 300.0), (1500, 9000.0)])
def test_tables_have_their_exact_distribution(customers, weight):
    discount, n = 0.5, 3000
    x = tables.recursion(customers, discount)[customers, 1:] + np.log(weight) * np.arange(1, customers + 1)
    p = np.exp(x - x.max()) / np.exp(x - x.max()).sum()
    mean = (p * np.arange(1, customers + 1)).sum()
    spread = np.sqrt((p * (np.arange(1, customers + 1) - mean) ** 2).sum())
    got = pitman_yor.drawn(np.full(n, customers), np.full(n, weight), discount, np.random.default_rng(3))
    assert abs(got.mean() - mean) < 5 * spread / np.sqrt(n)
    assert got.std() == pytest.approx(spread, rel=0.1)


def test_tables_as_customers_move_one_by_one():
    rng, discount, weight, customers = random.Random(4), 0.5, 20.0, 100
    sizes, seen = [customers], []
    for sweep in range(1500):
        for _ in range(customers):
            at = rng.choices(range(len(sizes)), sizes)[0]
            sizes[at] -= 1
            if not sizes[at]:
                sizes.pop(at)
            at = rng.choices(range(len(sizes) + 1), [n - discount for n in sizes] + [weight])[0]
            if at == len(sizes):
                sizes.append(0)
            sizes[at] += 1
        if sweep >= 50:
            seen.append(len(sizes))
    got = pitman_yor.drawn(np.full(4000, customers), np.full(4000, weight), discount, np.random.default_rng(5))
    assert got.mean() == pytest.approx(np.mean(seen), abs=0.4)
    assert got.std() == pytest.approx(np.std(seen), rel=0.15)
