"""Constrained parameter search: propose, gate, score, rank."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from pathlib import Path

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import stats
from ..operators.ordered import beside, running

Space = dict[str, tuple[float, float]]


@dataclass
class Trial:
    id: int
    params: dict[str, float]
    scores: dict[str, float] | None = None
    feasible: bool = True
    reason: str = ""


@dataclass(frozen=True)
class RandomSearch:
    n: int
    seed: int = 0

    def propose(self, space: Space, history: list[Trial], turn: int) -> list[dict[str, float]]:
        """Uniform points; the generator moves on with each turn."""
        rng = np.random.default_rng((self.seed, turn))
        return [{k: float(rng.uniform(*b)) for k, b in sorted(space.items())} for _ in range(self.n)]


@dataclass(frozen=True)
class HaltonSearch:
    """Low-discrepancy points with a seeded shift."""

    n: int
    seed: int = 0

    def propose(self, space: Space, history: list[Trial], turn: int) -> list[dict[str, float]]:
        shift = np.random.default_rng(self.seed).random(len(space))
        primes = [p for p in range(2, 60) if all(p % q for q in range(2, p))]
        out = []
        for i in range(1 + turn * self.n, 1 + (turn + 1) * self.n):
            point = {}
            for (k, (a, b)), base, s in zip(sorted(space.items()), primes, shift, strict=False):
                u, f, j = 0.0, 1.0, i
                while j:
                    f /= base
                    u += f * (j % base)
                    j //= base
                point[k] = float(a + (b - a) * ((u + s) % 1))
            out.append(point)
        return out


@dataclass(frozen=True)
class ParzenSearch:
    """Draws near good trials and keeps what a ratio of densities prefers; scores only of trials that have them."""

    n: int
    score: str
    seed: int = 0
    good_share: float = 0.25
    candidates: int = 24

    def propose(self, space: Space, history: list[Trial], turn: int) -> list[dict[str, float]]:
        done = sorted((t for t in history if t.scores and self.score in t.scores), key=lambda t: (t.scores[self.score], t.id))
        if len(done) < 8:
            return RandomSearch(self.n, self.seed).propose(space, history, turn)
        rng, n_good = np.random.default_rng((self.seed, turn)), max(2, int(len(done) * self.good_share))

        def density(x: np.ndarray, at: np.ndarray, width: float) -> np.ndarray:
            return np.exp(-(((x[:, None] - at[None]) / width) ** 2) / 2).mean(1) + 1e-12

        out = []
        for _ in range(self.n):
            total, draws = np.zeros(self.candidates), {}
            for k, (a, b) in sorted(space.items()):
                good, bad = (np.array([t.params[k] for t in part]) for part in (done[:n_good], done[n_good:]))
                width = max((b - a) / 6, 1e-12)
                x = np.clip(rng.choice(good, self.candidates) + rng.standard_normal(self.candidates) * width, a, b)
                draws[k] = x
                total += np.log(density(x, good, width)) - np.log(density(x, bad, width))
            best = int(total.argmax())
            out.append({k: float(v[best]) for k, v in draws.items()})
        return out


@dataclass(frozen=True)
class Bar:
    """A hard requirement on a metric; a missing metric fails it."""

    metric: str
    kind: str
    value: float
    tolerance: float = 0.0

    def column(self) -> F.Column:
        x = F.col("scores")[self.metric]
        test = {"ge": x >= self.value, "le": x <= self.value, "within": F.abs(x - self.value) <= self.tolerance}[self.kind]
        return F.coalesce(test, F.lit(False))

    def passes(self, scores: dict[str, float]) -> bool:
        x = scores.get(self.metric)
        return x is not None and {"ge": x >= self.value, "le": x <= self.value, "within": abs(x - self.value) <= self.tolerance}[self.kind]


def rank(trials: DataFrame, bars: list[Bar], score: str) -> DataFrame:
    """Trials that pass every bar, by ascending score, ties by id."""
    ok = F.lit(True)
    for b in bars:
        ok = ok & b.column()
    return trials.where(F.col("feasible") & F.col("scores").isNotNull() & ok).withColumn("place", F.row_number().over(W.orderBy(F.col("scores")[score], "id")))


def trial_table(spark: SparkSession, trials: list[Trial]) -> DataFrame:
    rows = [(t.id, t.params, t.scores, t.feasible, t.reason) for t in trials]
    return spark.createDataFrame(rows, "id int, params map<string,double>, scores map<string,double>, feasible boolean, reason string")


def lexicographic(trials: DataFrame, keys: list[tuple[str, bool]]) -> DataFrame:
    """Adds ``place`` in the total order by several scores (name, ascending), ties by id."""
    order = [F.col("scores")[k].asc() if up else F.col("scores")[k].desc() for k, up in keys]
    return trials.withColumn("place", F.row_number().over(W.orderBy(*order, "id"))).orderBy("place")


def banded_winner(rows: list[dict], stages: list[tuple[str, bool, float]]) -> tuple[dict, list[dict]]:
    """Sequential reduction: each stage keeps what is within a band of its best. Such ties aren't transitive, so no sort expresses it."""
    live, audit = list(rows), []
    for key, ascending, band in stages:
        best = min(r[key] for r in live) if ascending else max(r[key] for r in live)
        live = [r for r in live if abs(r[key] - best) <= band]
        audit.append({"stage": key, "best": best, "kept": [r["id"] for r in live]})
    return live[0], audit


def tune(space: Space, strategy: RandomSearch | HaltonSearch | ParzenSearch, feasible: Callable[[dict], tuple[bool, str]], scorer: Callable[[dict], dict[str, float]] | None, bars: list[Bar], score: str, rounds: int = 1, batch: Callable[[list[dict]], list[dict[str, float]]] | None = None) -> list[Trial]:
    """All trials; infeasible ones are never scored. The winner is the first of those that pass the bars.

    With ``batch`` the proposals of a round are scored together, in one plan, instead of one by one.
    """
    history: list[Trial] = []
    for turn in range(rounds):
        proposed = strategy.propose(space, history, turn)
        gates = [feasible(params) for params in proposed]
        asked = [p for p, (ok, _) in zip(proposed, gates, strict=True) if ok]
        found = iter(batch(asked) if batch is not None and asked else [scorer(p) for p in asked])
        for params, (ok, reason) in zip(proposed, gates, strict=True):
            history.append(Trial(len(history), params, next(found) if ok else None, ok, reason))
    return sorted(history, key=lambda t: (not (t.scores is not None and all(b.passes(t.scores) for b in bars)), (t.scores or {}).get(score, np.inf), t.id))


# Gates. A feasibility gate answers before any solve.
def coherence_feasible(n_tiles: int, required: set[str]) -> tuple[bool, str]:
    joint = required & {"SAMPLES", "COVARIANCE"}
    return (not joint or n_tiles <= 1), f"joint {sorted(joint)} over {n_tiles} tiles" if joint and n_tiles > 1 else ""


def bytes_feasible(needed: float, limit: float) -> tuple[bool, str]:
    return needed <= limit, "" if needed <= limit else f"{needed:.3g} bytes above {limit:.3g}"


def frontier(spark: SparkSession, errors: dict[int, list[float]], limit: float = 0.5) -> DataFrame:
    """Worst pair error by number of tiles, and whether it is within the limit."""
    return spark.createDataFrame([(n, max(e), max(e) <= limit) for n, e in sorted(errors.items())], "n_tiles int, worst double, feasible boolean")


def authorize(estimate: dict[str, float], ceilings: dict[str, float]) -> tuple[bool, list[str]]:
    """Spend check: each estimate against its ceiling; an absent ceiling waits."""
    over = [k for k, v in sorted(estimate.items()) if k not in ceilings or v > ceilings[k]]
    return not over, over


# Stages and bands by paired moving-block bootstrap.
def assemble_scores(track: DataFrame, resolution: Callable[[DataFrame], float | None], mu_bar: float) -> dict[str, float]:
    """Skill and coverage of a scored track (value, mean, var); the resolution, which is dear, only for
    skills at or above the bar, and only where it can be had."""
    row = track.agg(stats.skill(F.col("value"), F.col("mean")).alias("mu"), stats.coverage(F.col("mean"), F.col("var"), F.col("value")).alias("coverage")).first()
    scores = {"mu": row["mu"], "coverage": row["coverage"]}
    if row["mu"] is not None and row["mu"] >= mu_bar and (found := resolution(track)) is not None:
        scores["lambda_x"] = found
    return scores


def run_stage(space: Space, strategy: RandomSearch | HaltonSearch | ParzenSearch, feasible: Callable[[dict], tuple[bool, str]], scorer: Callable[[dict], dict[str, float]], accept: Callable[[dict], dict[str, float]], bars: list[Bar], score: str, rounds: int = 1) -> dict:
    """Tune on the validation side, then one run of the winner on the acceptance side, whose scores are
    recorded whatever they are; without a trial that passes the bars, nothing is touched."""
    trials = tune(space, strategy, feasible, scorer, bars, score, rounds)
    best = trials[0] if trials and trials[0].scores is not None and all(b.passes(trials[0].scores) for b in bars) else None
    return {"trials": trials, "winner": best, "acceptance": accept(best.params) if best is not None else None}


def segments(track: DataFrame, gap_seconds: float) -> DataFrame:
    """Adds segment: stretches of a mission's track that blocks don't leave, cut at gaps and where the day changes."""
    order, day = ["t", "seq"], F.floor("t")
    before = beside(track, ["mission"], day, order, ["t"])
    fresh = F.col("_prev").isNull() | ((F.col("t") - F.col("_prev.t")) * 86400.0 > gap_seconds) | (day != F.floor("_prev.t"))
    return running(before.withColumn("_new", fresh.cast("int")).drop("_prev", "_next"), ["mission"], day, order, F.col("_new"), "segment").drop("_new", "_all")


def block_bands(a: np.ndarray, b: np.ndarray, y: np.ndarray, block: int = 50, draws: int = 200, seed: int = 0) -> dict[str, float]:
    """Two standard errors of the difference of two maps' skills on one track, from the same blocks for both."""
    rng, n = np.random.default_rng(seed), len(y)
    block = min(block, n)
    starts = rng.integers(0, n - block + 1, (draws, -(-n // block)))
    diff = []
    for row in starts:
        at = (row[:, None] + np.arange(block)).ravel()[:n]
        signal = np.sqrt((y[at] ** 2).mean())
        mu = [1 - np.sqrt(((y[at] - m[at]) ** 2).mean()) / signal if signal else 0.0 for m in (a, b)]
        diff.append(mu[0] - mu[1])
    return {"mu_band": 2 * float(np.std(diff, ddof=1)), "mu_delta": float(np.mean(diff))}


def adjudicate(delta_mu: float, band_mu: float, delta_lambda: float | None, band_lambda: float) -> tuple[str, str]:
    """Winner of two lanes: by skill outside its band, else by resolution if it is usable, else a tie."""
    if abs(delta_mu) > band_mu:
        return ("a" if delta_mu > 0 else "b"), "mu"
    if delta_lambda is not None and abs(delta_lambda) > band_lambda:
        return ("a" if delta_lambda < 0 else "b"), "lambda_x"
    return "tie", "within bands"


# Records.
def changed_rows(before: DataFrame, after: DataFrame, key: str, digest: str) -> DataFrame:
    """added, removed or modified keys of two states."""
    a, b = before.select(key, F.col(digest).alias("_a")), after.select(key, F.col(digest).alias("_b"))
    kind = F.when(F.col("_a").isNull(), "added").when(F.col("_b").isNull(), "removed").when(F.col("_a") != F.col("_b"), "modified")
    return a.join(b, key, "full").select(key, kind.alias("change")).where("change IS NOT NULL")


def gate_refusals(block: dict, required: dict[str, type]) -> list[str]:
    """What a gate's record lacks or has of a wrong type."""
    return [f"missing {k}" if k not in block else f"{k} isn't {t.__name__}" for k, t in sorted(required.items()) if k not in block or not isinstance(block[k], t)]


@dataclass
class LockedTouch:
    """Context manager around locked data: needs an explicit grant, and tallies each opening."""

    product: str
    granted: bool
    ledger: list[str] = field(default_factory=list)

    def __enter__(self) -> LockedTouch:
        if not self.granted:
            raise PermissionError(f"{self.product} is locked")
        self.ledger.append(self.product)
        return self

    def __exit__(self, *_: object) -> None:
        self.granted = False


def write_seal(content: str, path: str) -> str:
    """Write-once digest of a content; another content for the same path is refused."""
    import hashlib

    sha = hashlib.sha256(content.encode()).hexdigest()
    file = Path(path)
    if file.exists() and file.read_text() != sha:
        raise FileExistsError(f"{path} seals another content")
    file.write_text(sha)
    return sha
