"""Patrols: coverage, where units stand, how a deployment scores, and a day of dispatches.

Greedy choice, swaps and dispatches depend on what came before; they run for one scenario in one task (a few
hundred cells), a group of `applyInPandas` each, so that many scenarios spread out.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

import wardline.sources.scratch  # noqa: F401  (functions travel whole)
from wardline.functions import travel
from wardline.functions.scalars import clamp01, grade, haversine_km
from wardline.operators.relational import nearest_rank as rank_of

#: Budgets of seconds that coverage is kept for.
BUDGETS = (180, 300, 420, 600, 900)
SWAPS = 300


def durations(cells: DataFrame, km_per_hour: float = 30.0) -> DataFrame:
    """(origin, dest, seconds) between all cells (cell, lat, lon) of one scenario: distance over speed stands in for a road network."""
    a = cells.select(F.col("scenario"), F.col("cell").alias("origin"), F.col("lat").alias("lat1"), F.col("lon").alias("lon1"))
    b = cells.select("scenario", F.col("cell").alias("dest"), F.col("lat").alias("lat2"), F.col("lon").alias("lon2"))
    km = haversine_km(F.col("lat1"), F.col("lon1"), F.col("lat2"), F.col("lon2"))
    return a.join(b, "scenario").select("scenario", "origin", "dest", (km / km_per_hour * 3600).alias("seconds"))


def coverage(times: DataFrame) -> DataFrame:
    """(scenario, budget, origin, dest): what is reached within each budget."""
    budgets = times.select("*", F.explode(F.array(*map(F.lit, BUDGETS))).alias("budget"))
    return budgets.filter("seconds <= budget").select("scenario", "budget", "origin", "dest")


def gini(values: np.ndarray) -> float:
    values = np.sort(values)
    n, total = len(values), values.sum()
    return 0.0 if n == 0 or total == 0 else float(2 * (np.arange(1, n + 1) * values).sum() / (n * total) - (n + 1) / n)


class Scenario:
    """Demand cells with beats, and which cells each reaches within a budget."""

    def __init__(self, demand: pd.DataFrame, reach: pd.DataFrame):
        self.cells = np.array(sorted(demand["cell"].unique()))
        place = {c: i for i, c in enumerate(self.cells)}
        self.demand = np.zeros(len(self.cells))
        np.add.at(self.demand, demand["cell"].map(place), demand["demand"])
        beats = {b: i for i, b in enumerate(sorted(demand["beat"].unique()))}
        self.beats = np.zeros((len(beats), len(self.cells)))
        np.add.at(self.beats, (demand["beat"].map(beats), demand["cell"].map(place)), demand["demand"])
        self.reach = np.zeros((len(self.cells), len(self.cells)), bool)
        self.reach[reach["origin"].map(place), reach["dest"].map(place)] = True

    def measure(self, positions: list[int]) -> tuple[float, float]:
        """The demand that is covered, and the equity of beats."""
        covered = self.reach[positions].any(axis=0) if positions else np.zeros(len(self.cells), bool)
        return float(self.demand[covered].sum()), 1 - gini(self.beats[:, covered].sum(axis=1) / self.beats.sum(axis=1))

    def objective(self, positions: list[int]) -> float:
        hit, equity = self.measure(positions)
        total = self.demand.sum()
        return 400 * (hit / total if total > 0 else 0) + 150 * equity


def optimise(scene: Scenario, active: int) -> list[int]:
    """Greedy choice of cells, the lowest of equals; fixed swaps that improve; a repair of low equity."""
    positions: list[int] = []
    for _ in range(active):
        positions.append(max(range(len(scene.cells)), key=lambda c: (scene.objective([*positions, c]), -c)))
    best = scene.objective(positions)
    for k in range(SWAPS):
        trial = [*positions]
        trial[k % len(positions)] = (k * 37 + 11) % len(scene.cells)
        value = scene.objective(trial)
        if value > best:
            positions, best = trial, value
    if scene.measure(positions)[1] < 0.55:
        covered = scene.reach[positions].any(axis=0)
        left = [c for c in range(len(scene.cells)) if not covered[c]]
        if left:
            trial = [min(left, key=lambda c: (-scene.demand[c], c)), *positions[1:]]
            if scene.measure(trial)[1] > scene.measure(positions)[1]:
                positions = trial
    return positions


def deployments(demand: DataFrame, reach: DataFrame, active: int) -> DataFrame:
    """scenario, unit, cell, covered, ratio, equity: demand (scenario, cell, beat, demand), reach of one budget (scenario, origin, dest)."""

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if left.empty:
            return pd.DataFrame({"scenario": [], "unit": [], "cell": [], "covered": [], "ratio": [], "equity": []})
        scene = Scenario(left, right)
        positions = optimise(scene, max(1, active))
        hit, equity = scene.measure(positions)
        total = scene.demand.sum()
        return pd.DataFrame({"scenario": left["scenario"].iloc[0], "unit": range(len(positions)), "cell": [scene.cells[p] for p in positions], "covered": hit, "ratio": hit / total if total else 0.0, "equity": equity})

    reach = reach.select(*[F.col(c).alias(c) for c in reach.columns])  # both may come from one table
    return demand.groupBy("scenario").cogroup(reach.groupBy("scenario")).applyInPandas(run, "scenario string, unit long, cell string, covered double, ratio double, equity double")


def nearest_rank(values: list[float], f: float) -> float:
    return sorted(values)[min(len(values) - 1, math.floor(f * len(values)))] if values else 0.0


def score(coverage_ratio: float, equity: float, responses: list[float], target: float, reserve: int, wanted: int, km: float) -> dict[str, float]:
    """Points of a deployment: coverage 400, response 150 and 100, equity 150, reserve 100, efficiency 100."""
    clamp = lambda x: max(0.0, min(1.0, x))
    p50, p90 = nearest_rank(responses, 0.5), nearest_rank(responses, 0.9)
    response = 150 * (1 - clamp(p50 / target)) + 100 * (1 - clamp(p90 / (1.75 * target)))
    kept = clamp(reserve / wanted) if wanted > 0 else 1.0
    total = 400 * coverage_ratio + response + 150 * equity + 100 * kept + 100 * (1 - clamp(km / 80))
    return {"total": math.floor(total + 0.5), "p50": p50, "p90": p90, "response": response}


def simulate(events: list[tuple[int, float, str]], posts: dict[str, str], seconds: Callable[[str, str], float], factor: float = 1.0) -> list[tuple[str | None, float | None, str]]:
    """(unit, response minutes, result) of each (minute, service minutes, cell): the nearest free unit goes, the first name of equals; none within 20 minutes is a miss."""
    free: dict[str, float] = {}
    out: list[tuple[str | None, float | None, str]] = []
    for minute, service, cell in events:
        found = sorted((seconds(post, cell) * factor / 60, unit) for unit, post in posts.items() if free.get(unit, 0) <= minute)
        if not found or not math.isfinite(found[0][0]) or found[0][0] > 20:
            out.append((None, None, "missed"))
            continue
        response, unit = found[0]
        travel = math.ceil(response)
        free[unit] = minute + travel + service + travel
        out.append((unit, response, "dispatched"))
    return out


def dispatches(events: DataFrame, posts: DataFrame, times: DataFrame) -> DataFrame:
    """scenario, event, unit, response, result: events (scenario, event, minute, service, cell), posts (scenario, unit, cell). Travel times ride along with each event and post."""
    e = events.withColumnRenamed("cell", "dest").join(posts.withColumnRenamed("cell", "origin"), "scenario")
    e = e.join(times, ["scenario", "origin", "dest"], "left").groupBy("scenario", "event", "minute", "service", "dest").agg(F.collect_list(F.struct("unit", "seconds")).alias("units"))

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["minute", "event"])
        far = {(u["unit"], d): u["seconds"] for units, d in zip(group["units"], group["dest"]) for u in units if u["seconds"] is not None}
        names = sorted({u["unit"] for units in group["units"] for u in units})
        found = simulate(list(zip(group["minute"], group["service"], group["dest"])), {str(u): u for u in names}, lambda u, d: far.get((u, d), math.inf))
        return pd.DataFrame({"scenario": group["scenario"], "event": group["event"], "unit": [u for u, _, _ in found], "response": [r for _, r, _ in found], "result": [x for _, _, x in found]})

    return e.groupBy("scenario").applyInPandas(run, "scenario string, event long, unit string, response double, result string")


#: Fixed value: km that a second of travel stands for.
KM_A_SECOND = 0.00667


def scores(demand: DataFrame, times: DataFrame, posts: DataFrame, events: DataFrame, target: float, wanted: int, start_hour: int, rain: bool = False, closure: bool = False) -> DataFrame:
    """A row for each scenario: points of its deployment, and what they are made of.

    demand (scenario, cell, beat, demand), times (scenario, origin, dest, seconds), posts (scenario, unit, start,
    cell; no cell: in reserve), events (scenario, cell, minute). target: minutes to reach a cell; wanted: units in reserve.
    An event that no unit reaches takes three times the target. Congestion is that of each event's hour.
    """
    active = posts.filter("cell IS NOT NULL").select("scenario", "unit", F.col("cell").alias("origin"), "start")
    near = times.join(active.select("scenario", "origin").distinct(), ["scenario", "origin"]).groupBy("scenario", F.col("dest").alias("cell")).agg(F.min("seconds").alias("seconds"))
    covered = F.coalesce(F.col("seconds") <= target * 60, F.lit(False))
    hit = demand.join(near, ["scenario", "cell"], "left").withColumn("hit", F.when(covered, F.col("demand")).otherwise(0.0))
    beats = hit.groupBy("scenario", "beat").agg(F.sum("hit").alias("hit"), F.sum("demand").alias("all"))
    # A scenario's beats are few.
    shares = F.array_sort(F.collect_list(F.coalesce(F.try_divide("hit", "all"), F.lit(0.0))))
    by = beats.groupBy("scenario").agg(F.try_divide(F.sum("hit"), F.sum("all")).alias("coverage"), shares.alias("shares"))
    n, total = F.size("shares"), F.aggregate("shares", F.lit(0.0), lambda a, v: a + v)
    weighted = F.aggregate(F.transform("shares", lambda v, i: (i + 1) * v), F.lit(0.0), lambda a, v: a + v)
    by = by.withColumn("coverage", F.coalesce("coverage", F.lit(0.0))).withColumn("equity", 1 - F.when(total == 0, 0.0).otherwise(2 * weighted / (n * total) - (n + 1) / n)).drop("shares")
    factor = (travel.RAIN if rain else 1.0) * (travel.CLOSURE if closure else 1.0)
    minutes = F.col("seconds") * factor * travel.multiplier(travel.clock_hour(F.lit(start_hour), F.col("minute"))) / 60
    responses = events.join(near, ["scenario", "cell"], "left").select("scenario", F.coalesce(minutes, F.lit(3.0 * target)).alias("response"))
    there = active.join(times.withColumnRenamed("origin", "start").withColumnRenamed("dest", "origin"), ["scenario", "start", "origin"], "left")
    km = there.groupBy("scenario").agg(F.sum(F.coalesce(F.col("seconds") * KM_A_SECOND, F.lit(0.0))).alias("km"))
    reserve = posts.groupBy("scenario").agg(F.count_if(F.col("cell").isNull()).alias("reserve"))
    for more in (rank_of(responses, ["scenario"], "response", 0.5, "p50"), rank_of(responses, ["scenario"], "response", 0.9, "p90"), km, reserve):
        by = by.join(more, "scenario", "left")
    by = by.fillna(0, ["p50", "p90", "km", "reserve"])
    kept = clamp01(F.col("reserve") / wanted) if wanted > 0 else F.lit(1.0)
    response = 150 * (1 - clamp01(F.col("p50") / target)) + 100 * (1 - clamp01(F.col("p90") / (1.75 * target)))
    points = 400 * F.col("coverage") + response + 150 * F.col("equity") + 100 * kept + 100 * (1 - clamp01(F.col("km") / 80))
    by = by.withColumn("total", F.floor(points + 0.5).cast("long"))
    return by.select("scenario", "total", grade(F.col("total")).alias("grade"), "coverage", "p50", "p90", "equity", "reserve", "km")
