"""Many margin machines trained in shared passes.

Machines that differ in cost, fold or class but not in kernel form a group: they read the same
features. A pass lifts each block of rows once per group, takes all margins of the group by one
matrix product, and adds up the weighted normal equations of all its machines by another (the
machines' weights times the products of all feature pairs). Groups are packed into jobs whose
sums have a bounded number of cells; partial sums meet in a tree, and the driver solves the
small systems together. Machines that have settled drop out of the next pass.

The steps of each machine are those of ``kernel.fit_machines`` for the hinge loss.
"""

from __future__ import annotations

import warnings
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from .kernel import PAYLOAD_NUMBERS, ROUGH_TOL, ROUNDINGS, LandmarkMap, _identity, _pull
from .network import _summed

#: Cells of the products of feature pairs that a task holds at a time.
PRODUCT_CELLS = 2_000_000


@dataclass(frozen=True)
class Machine:
    """One class against the rest at one cost, trained on all rows but those of a fold (-1: none)."""

    cost: float
    positive: int
    fold: int = -1


class MachineGroup:
    """Machines on the same features, their current weights and the steps being tried."""

    def __init__(self, lift: LandmarkMap | None, features: int, machines: Sequence[Machine], limits: Sequence[int] = ()) -> None:
        self.lift = lift or _identity
        self.size = (features if lift is None else lift.whiten.shape[1]) + 1
        self.machines = list(machines)
        count = len(self.machines)
        self.cost = np.array([m.cost for m in machines])
        self.positive = np.array([m.positive for m in machines])
        self.fold = np.array([m.fold for m in machines])
        self.beta, self.step = np.zeros((count, self.size)), np.zeros((count, self.size))
        self.share, self.best = np.ones(count), np.full(count, np.inf)
        self.level, self.done = np.zeros(count, int), np.zeros(count, bool)
        self.limits = sorted(l for l in limits if l > 0)
        self.rounds = 0
        #: Weights of every machine after so many rounds; a settled machine does not change.
        self.after: dict[int, np.ndarray] = {}
        ridge = np.eye(self.size)
        ridge[-1, -1] = 1e-9
        self.ridge = ridge
        self.lower = np.tril_indices(self.size)

    @property
    def width(self) -> int:
        return 1 + len(self.lower[0]) + self.size

    def waiting(self) -> np.ndarray:
        return np.flatnonzero(~self.done)

    def candidates(self, which: np.ndarray) -> np.ndarray:
        return self.beta[which] + self.share[which, None] * self.step[which]

    def judge(self, which: np.ndarray, sums: np.ndarray, tol: float) -> None:
        """Take the candidates that lower their objective, else try half the step."""
        tried = self.candidates(which)
        value = 0.5 * (tried[:, :-1] ** 2).sum(axis=1) + self.cost[which] * sums[:, 0]
        better = value < self.best[which]
        gain = np.where(better, self.best[which] - value, np.inf)
        took = which[better]
        if len(took):
            self.beta[took], self.best[took], self.share[took] = tried[better], value[better], 1.0
            pairs = len(self.lower[0])
            gram = np.zeros((len(took), self.size, self.size))
            gram[:, self.lower[0], self.lower[1]] = sums[better, 1 : 1 + pairs]
            gram[:, self.lower[1], self.lower[0]] = sums[better, 1 : 1 + pairs]
            moment = sums[better, 1 + pairs :]
            self.step[took] = np.linalg.solve(gram + self.ridge, moment[:, :, None])[:, :, 0] - tried[better]
        self.share[which[~better]] /= 2
        last = self.level[which] == len(ROUNDINGS) - 1
        small = gain <= np.where(last, tol, ROUGH_TOL) * np.maximum(1.0, np.abs(value))
        settled = np.where(better, small, self.share[which] < 1e-3)
        onward = which[settled & ~last]
        self.level[onward] += 1
        self.best[onward], self.share[onward], self.step[onward] = np.inf, 1.0, 0.0
        self.done[which[settled & last]] = True

    def ended_round(self) -> None:
        self.rounds += 1
        if self.rounds in self.limits:
            self.after[self.rounds] = self.beta.copy()

    def weights(self, limit: int = -1) -> np.ndarray:
        """Weights of all machines as a run of at most ``limit`` rounds would leave them."""
        return self.after.get(limit, self.beta)


def group_sums(group: MachineGroup, which: np.ndarray, tried: np.ndarray, soft: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Losses, normal equations (lower half) and moments of some machines over rows (features, y, w, fold)."""
    total = np.zeros((len(which), group.width))
    pairs = len(group.lower[0])
    step = max(16, PRODUCT_CELLS // pairs)
    for at in range(0, len(rows), step):
        block = rows[at : at + step]
        x, y, w, fold = block[:, :-3], block[:, -3], block[:, -2], block[:, -1]
        phi = np.column_stack([group.lift(x), np.ones(len(x))])
        goal = np.where(y[:, None] == group.positive[which], 1.0, -1.0)
        used = w[:, None] * (fold[:, None] != group.fold[which])
        weight, target, losses = _pull("hinge", goal, phi @ tried.T, 0.0, soft)
        total[:, 0] += (used * losses).sum(axis=0)
        weight = weight * used * group.cost[which]
        total[:, 1 : 1 + pairs] += weight.T @ (phi[:, group.lower[0]] * phi[:, group.lower[1]])
        total[:, 1 + pairs :] += (weight * target).T @ phi
    return total


def packed(groups: Sequence[MachineGroup]) -> list[list[tuple[int, np.ndarray]]]:
    """Waiting machines of all groups in jobs of at most PAYLOAD_NUMBERS cells (one machine at least)."""
    jobs: list[list[tuple[int, np.ndarray]]] = [[]]
    room = PAYLOAD_NUMBERS
    for g, group in enumerate(groups):
        left = group.waiting()
        while len(left):
            take = min(len(left), max(room, 0) // group.width)
            if not take and jobs[-1]:
                jobs.append([])
                room = PAYLOAD_NUMBERS
                continue
            take = max(take, 1)
            jobs[-1].append((g, left[:take]))
            room -= take * group.width
            left = left[take:]
    return [job for job in jobs if job]


def train_groups(data: DataFrame, groups: Sequence[MachineGroup], tol: float = 1e-4, limit: int = -1) -> int:
    """Train all machines on ``data`` (features, y, w, fold); returns the number of jobs.

    ``limit`` of -1 goes on until every machine has settled.
    """
    jobs = 0
    while limit == -1 or groups[0].rounds < limit:
        rounds = packed(groups)
        if not rounds:
            break
        for job in rounds:
            parts = [(groups[g], which, groups[g].candidates(which), ROUNDINGS_AT[groups[g].level[which]]) for g, which in job]

            def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
                from pyspark import TaskContext

                totals = None
                for pdf in batches:
                    rows = pdf.to_numpy(dtype=float)
                    if len(rows):
                        found = [group_sums(*part, rows) for part in parts]
                        totals = found if totals is None else [a + b for a, b in zip(totals, found)]
                if totals is not None:
                    payload = np.concatenate([t.ravel() for t in totals])
                    yield pd.DataFrame({"part": [TaskContext.get().partitionId()], "payload": [payload]})

            sums = _summed(data.mapInPandas(work, "part int, payload array<double>"))
            jobs += 1
            at = 0
            for g, which in job:
                cells = len(which) * groups[g].width
                groups[g].judge(which, sums[at : at + cells].reshape(len(which), -1), tol)
                at += cells
        for group in groups:
            group.ended_round()
    if unsettled := sum(len(group.waiting()) for group in groups):
        warnings.warn(f"{unsettled} machines are not settled after {limit} rounds", RuntimeWarning, stacklevel=2)
    return jobs


ROUNDINGS_AT = np.array(ROUNDINGS)
