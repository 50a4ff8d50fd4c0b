"""A sampler that seats customers one by one, to test against."""

from __future__ import annotations

import numpy as np


class Seating:
    """Tables of many independent (restaurant, dish) pairs, flat, customer by customer: what ``hpylm.draw_tables`` is tested against."""

    def __init__(self, customers: np.ndarray, tables: np.ndarray | None = None, sizes: np.ndarray | None = None) -> None:
        self.customers = customers.astype(np.int64)
        self.tables = np.ones(len(customers), np.int64) if tables is None else tables.astype(np.int64)
        self.sizes = self.customers.copy() if sizes is None else sizes.astype(np.int64)

    def starts(self) -> np.ndarray:
        return np.cumsum(self.tables) - self.tables

    def _pick(self, who: np.ndarray, weights: np.ndarray, total: np.ndarray, rng: np.random.Generator) -> np.ndarray:
        """A table of each pair in ``who``, by weight; ``total`` is the weight of all its tables."""
        start = self.starts()[who]
        before = np.concatenate([[0.0], np.cumsum(weights)])
        at = np.searchsorted(before, before[start] + rng.random(len(who)) * total, "right") - 1
        return np.clip(at, start, start + self.tables[who] - 1)

    def leave(self, who: np.ndarray, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
        """One random customer of each pair in ``who`` gets up: its table, and whether that is empty now."""
        at = self._pick(who, self.sizes.astype(float), self.customers[who], rng)
        self.sizes[at] -= 1
        self.customers[who] -= 1
        return at, self.sizes[at] == 0

    def sit(self, who: np.ndarray, new_weight: np.ndarray, discount: float, rng: np.random.Generator, empty: np.ndarray) -> None:
        """One customer of each pair in ``who`` sits down: at a table by size less discount, or at a new one.
        ``empty`` counts the pair's tables without customers; they go."""
        seated = np.maximum(self.customers[who] - discount * (self.tables[who] - empty), 0.0)
        new = rng.random(len(who)) * (new_weight + seated) < new_weight
        new |= self.customers[who] == 0
        old = who[~new]
        weights = np.where(self.sizes > 0, self.sizes - discount, 0.0)
        at = self._pick(old, weights, seated[~new], rng)
        self.sizes[at] += 1  # (if rounding hits an empty table, the customer opens it again)
        self.customers[who] += 1
        fresh = who[new]
        ends = (self.starts() + self.tables)[fresh]
        sizes = np.insert(self.sizes, ends, 1)
        owner = np.insert(np.repeat(np.arange(len(self.tables)), self.tables), ends, fresh)
        kept = sizes > 0
        self.sizes = sizes[kept]
        self.tables = np.bincount(owner[kept], minlength=len(self.tables))

    def reseat(self, who: np.ndarray, new_weight: np.ndarray, discount: float, rng: np.random.Generator) -> None:
        _, emptied = self.leave(who, rng)
        self.sit(who, new_weight, discount, rng, emptied.astype(np.int64))

    def take(self, who: np.ndarray) -> Seating:
        """The pairs in ``who`` as a seating of their own."""
        mine = np.zeros(len(self.tables), bool)
        mine[who] = True
        return Seating(self.customers[who], self.tables[who], self.sizes[np.repeat(mine, self.tables)])

    def put(self, who: np.ndarray, other: Seating) -> None:
        """Back into the (ascending) places that ``take`` took them from."""
        mine = np.zeros(len(self.tables), bool)
        mine[who] = True
        others = self.sizes[~np.repeat(mine, self.tables)]
        self.customers[who], self.tables[who] = other.customers, other.tables
        at = np.repeat(mine, self.tables)
        self.sizes = np.empty(len(at), np.int64)
        self.sizes[at], self.sizes[~at] = other.sizes, others

    def resize(self, customers: np.ndarray, new_weight: np.ndarray, discount: float, rng: np.random.Generator) -> None:
        """Random customers leave, or new ones come, until each pair has the given number. The pairs still at it
        are worked on apart as they become few, so a frequent word costs its own changes only."""
        now, outer = self, []
        while len(who := np.flatnonzero(now.customers != customers)):
            if 2 * len(who) < len(customers):
                outer.append((now, who))
                now, customers, new_weight = now.take(who), customers[who], new_weight[who]
                who = np.arange(len(who))
            leaving, coming = who[now.customers[who] > customers[who]], who[now.customers[who] < customers[who]]
            if len(leaving):
                now.leave(leaving, rng)
                owner, kept = np.repeat(np.arange(len(now.tables)), now.tables), now.sizes > 0
                now.sizes, now.tables = now.sizes[kept], np.bincount(owner[kept], minlength=len(now.tables))
            if len(coming):
                now.sit(coming, new_weight[coming], discount, rng, np.zeros(len(coming), np.int64))
        for whole, who in reversed(outer):
            whole.put(who, now)
            now = whole
