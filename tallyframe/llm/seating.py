"""Tables in the restaurants of a Pitman-Yor process, drawn by Gibbs steps, many dishes at once."""

from __future__ import annotations

import numpy as np

#: dishes of at most this many customers are drawn from the exact conditional distribution of their tables
SMALL = 64
#: larger dishes are seated in groups of this share of those who sit already, by so many parties of which one stays
GROUP, PARTIES = 0.02, 8


def stirling(discount: float, most: int = SMALL) -> np.ndarray:
    """Logs of the generalised Stirling numbers: ways to seat c customers at t tables."""
    out = np.full((most + 1, most + 1), -np.inf)
    out[0, 0] = 0.0
    with np.errstate(divide="ignore", invalid="ignore"):
        for c in range(most):
            t = np.arange(1, most + 1)
            out[c + 1, 1:] = np.logaddexp(out[c, :-1], out[c, 1:] + np.log(np.maximum(c - discount * t, 0)))
    return out


def draw_tables(customers: np.ndarray, others: np.ndarray, parent: np.ndarray, strength: float, discount: float,
                ways: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """New numbers of tables of dishes, given their customers, the restaurant's other tables and the parent's probability.

    One step of a blocked Gibbs sampler: t tables weigh the ways to seat the customers at them, times what
    opening them costs in the restaurant, times the parent's probability of the dish for each.
    """
    tables = np.minimum(customers, 1)
    size = np.where(customers <= SMALL, customers, 0).astype(np.uint8)
    by_size = np.argsort(size, kind="stable")
    edges = np.searchsorted(size[by_size], np.arange(SMALL + 2))
    for c in range(2, SMALL + 1):
        rows = by_size[edges[c]:edges[c + 1]]
        if not len(rows):
            continue
        opened = np.log(strength + discount * (others[rows, None] + np.arange(c)))
        weight = ways[c, 1:c + 1] + np.cumsum(opened + np.log(parent[rows])[:, None], axis=1)
        chance = np.cumsum(np.exp(weight - weight.max(axis=1, keepdims=True)), axis=1)
        tables[rows] = 1 + (chance < (rng.random(len(rows)) * chance[:, -1])[:, None]).sum(axis=1)
    large = np.flatnonzero(customers > SMALL)
    if len(large):
        tables[large] = _seat_groups(customers[large], strength + discount * others[large], parent[large], discount, rng)
    return tables


def _seat_groups(customers: np.ndarray, opening: np.ndarray, parent: np.ndarray, discount: float, rng: np.random.Generator) -> np.ndarray:
    """Tables after customers came in groups; of several parties one is kept by the weight of its seating."""
    tables, weight = np.ones((len(customers), PARTIES), dtype=np.int64), np.zeros((len(customers), PARTIES))
    goal, seated, going = customers, np.ones_like(customers), np.arange(len(customers))
    now, log = tables.copy(), weight.copy()
    while len(going):
        group = np.minimum(goal - seated, np.maximum(1, (seated * GROUP).astype(np.int64)))[:, None]
        new = (opening[:, None] + discount * now) * parent[:, None]
        all_ = new + np.maximum(seated[:, None] + group / 2 - discount * now, 1e-9)
        log += group * np.log(all_)
        now += rng.binomial(group, np.minimum(new / all_, 1.0))
        seated = seated + group[:, 0]
        open_ = seated < goal
        if not open_.all():  # dishes whose customers all sit leave
            tables[going[~open_]], weight[going[~open_]] = now[~open_], log[~open_]
            goal, seated, going, now, log, opening, parent = (x[open_] for x in (goal, seated, going, now, log, opening, parent))
    chance = np.cumsum(np.exp(weight - weight.max(axis=1, keepdims=True)), axis=1)
    chosen = (chance < (rng.random(len(customers)) * chance[:, -1])[:, None]).sum(axis=1)
    return tables[np.arange(len(customers)), np.minimum(chosen, PARTIES - 1)]


def discount_of(once: int, twice: int) -> float:
    """The discount at which so many dishes would have one and two customers."""
    return min(0.95, max(0.1, once / (once + 2 * twice))) if once else 0.5


def strength_parts(strength: float, discount: float, customers: np.ndarray, tables: np.ndarray, rng: np.random.Generator) -> tuple[float, float]:
    """What restaurants say of the strength they share: expected tables it opened, and minus the logs of their auxiliary variables."""
    used = customers > 1
    customers, tables = customers[used].astype(float), tables[used].astype(float)
    # how many tables the strength rather than the discount opened: a sum of chances, taken as its integral
    opened = strength / discount * np.log((strength + discount * tables) / (strength + discount))
    spread = -np.log(np.maximum(rng.beta(strength + 1, customers - 1), 1e-300))
    return float(np.maximum(opened, 0).sum()), float(spread.sum())


def draw_strength(strength: float, discount: float, customers: np.ndarray, tables: np.ndarray, rng: np.random.Generator,
                  more: tuple[float, float] = (0.0, 0.0)) -> float:
    """A new strength of restaurants that share it, by auxiliary variables, under a Gamma(1, 1) prior; ``more``: parts of further ones."""
    if not (customers > 1).any() and not any(more):
        return strength
    opened, spread = (a + b for a, b in zip(strength_parts(strength, discount, customers, tables, rng), more))
    return max(1e-3, float(rng.gamma(1 + rng.poisson(opened), 1 / (1 + spread))))
