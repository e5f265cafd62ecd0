"""Monte-Carlo evolution of networks: many independent chains, one task each.

A chain is sequential by nature, so parallelism comes from chains (seeds, grid points, segments of a
run). Randomness is counter-based: the numbers of step s come from a Philox stream keyed by (seed,
s div BLOCK) at row s mod BLOCK, so a chain resumed from any stored snapshot replays exactly.

Edges are picked uniformly from an ordered list, not by rejection trials; ``trials`` gives the
rejection rule instead, with its skipped moves.
"""

from __future__ import annotations

import math
from bisect import bisect_left, insort
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import spread
from ..sources.schema import PARAMS, params

BLOCK, DRAWS = 256, 64


class Chain:
    """State of one network and its moves."""

    def __init__(self, n: int, seed: int, p: dict[str, float] | None = None, step: int = 0, trials: bool = False, exact_boundary: bool = False) -> None:
        self.n, self.seed, self.p, self.step, self.trials, self.exact = n, seed, dict(PARAMS if p is None else p), step, trials, exact_boundary
        self.re, self.im = [0.0] * n, [0.0] * n
        self.near: list[dict[int, float]] = [{} for _ in range(n)]  # oriented phases by neighbour
        self.edges: list[tuple[int, int]] = []
        self._block = -1
        self.tried = self.accepted = 0

    # -- state --
    def load(self, nodes, edges) -> Chain:
        """Amplitudes (node_id, re, im), ids of at least n dropped; edges (src, dst, theta)."""
        for k, re, im in nodes:
            if 0 <= k < self.n:
                self.re[k], self.im[k] = float(re), float(im)
        for i, j, t in edges:
            if 0 <= i < self.n and 0 <= j < self.n and i != j:
                i, j, t = (i, j, t) if i < j else (j, i, -t)
                if j not in self.near[i]:
                    insort(self.edges, (int(i), int(j)))
                self.near[i][j], self.near[j][i] = float(t), -float(t)
        return self

    def _numbers(self) -> list[float]:
        block, row = divmod(self.step, BLOCK)
        if block != self._block:
            g = np.random.Generator(np.random.Philox(key=np.array([self.seed & (1 << 64) - 1, block], np.uint64)))
            self._u, self._z, self._block = g.random((BLOCK, DRAWS)), g.standard_normal((BLOCK, 2)), block
        self.z = self._z[row]
        return self._u[row]

    # -- energies --
    def psi_energy(self, i: int) -> float:
        p, re, im = self.p, self.re, self.im
        a, b = re[i], im[i]
        rho = a * a + b * b
        e = p["mass2"] * rho + p["lam_psi"] * rho * rho + p["lam_pauli"] * math.exp(min(700.0, rho / max(1e-9, p["rho0"])))
        for j, t in self.near[i].items():
            c, d = re[j], im[j]
            e += p["lam_g"] * (rho + c * c + d * d) - p["kappa"] * ((a * c + b * d) * math.cos(t) - (a * d - b * c) * math.sin(t))
        return e

    def edge_energy(self, u: int, v: int, theta: float) -> float:
        """Hop, stress and triangles of an edge whose phase from u to v is theta."""
        p, re, im = self.p, self.re, self.im
        a, b, c, d = re[u], im[u], re[v], im[v]
        e = p["lam_g"] * (a * a + b * b + c * c + d * d) - p["kappa"] * ((a * c + b * d) * math.cos(theta) - (a * d - b * c) * math.sin(theta))
        if p["beta"]:
            one, two = self.near[u], self.near[v]
            if len(one) > len(two):
                for k, t in two.items():
                    if k in one:
                        e += p["beta"] * (1 - math.cos(theta + t - one[k]))
            else:
                for k, t in one.items():
                    if k in two:
                        e += p["beta"] * (1 - math.cos(theta + two[k] - t))
        return e

    def action(self) -> float:
        """The whole action, computed anew."""
        p = self.p
        total = 0.0
        for i in range(self.n):
            rho = self.re[i] ** 2 + self.im[i] ** 2
            total += p["mass2"] * rho + p["lam_psi"] * rho * rho + p["lam_pauli"] * math.exp(rho / max(1e-9, p["rho0"])) + p["mu_deg2"] * len(self.near[i]) ** 2
        beta, p["beta"] = p["beta"], 0.0
        total += sum(self.edge_energy(i, j, self.near[i][j]) + p["lam_e"] for i, j in self.edges)
        p["beta"] = beta
        for i, j in self.edges:
            for k in self.near[j]:
                if k > j and k in self.near[i]:
                    total += beta * (1 - math.cos(self.near[i][j] + self.near[j][k] - self.near[i][k]))
        return total

    # -- moves --
    def _accept(self, delta: float, u: float, log_q: float = 0.0) -> bool:
        temp = self.p["temp"]
        if temp <= 1e-12:
            return delta <= 0
        x = -delta / temp + log_q
        return x >= 0 or u < math.exp(x)

    def toggle_delta(self, u: int, v: int, theta: float) -> float:
        own = self.edge_energy(u, v, theta) + self.p["lam_e"]
        du, dv, mu = len(self.near[u]), len(self.near[v]), self.p["mu_deg2"]
        if v in self.near[u]:
            return -own + mu * ((1 - 2 * du) + (1 - 2 * dv))
        return own + mu * ((1 + 2 * du) + (1 + 2 * dv))

    def _toggle(self, u: int, v: int, log_q: float, draw: float, angle: float) -> None:
        exists = v in self.near[u]
        theta = self.near[u][v] if exists else (2 * angle - 1) * math.pi
        self.tried += 1
        if not self._accept(self.toggle_delta(u, v, theta), draw, log_q):
            return
        self.accepted += 1
        i, j = (u, v) if u < v else (v, u)
        if exists:
            del self.near[u][v], self.near[v][u]
            self.edges.pop(bisect_left(self.edges, (i, j)))
        else:
            self.near[u][v], self.near[v][u] = theta, -theta
            insort(self.edges, (i, j))

    def _pick_edge(self, u: np.ndarray) -> tuple[int, int] | None:
        n = self.n
        if not self.trials:
            return self.edges[int(u[2] * len(self.edges))] if self.edges else None
        for k in range(20):
            i, j = int(u[8 + 2 * k] * n), int(u[9 + 2 * k] * n)
            if i != j and j in self.near[i]:
                return i, j
        return None

    def move(self) -> None:
        """One step: a psi, a theta or a rewiring move."""
        u, p, n = self._numbers(), self.p, self.n
        if u[0] < p["p_psi"]:
            i = int(u[1] * n)
            before, old = self.psi_energy(i), (self.re[i], self.im[i])
            self.re[i] += p["psi_step"] * self.z[0]
            self.im[i] += p["psi_step"] * self.z[1]
            delta = self.psi_energy(i) - before
            if delta > 0 and not (p["temp"] > 1e-12 and u[3] < math.exp(-delta / p["temp"])):
                self.re[i], self.im[i] = old
        elif u[0] < p["p_psi"] + p["p_theta"]:
            if (edge := self._pick_edge(u)) is not None:
                i, j = edge
                old = self.near[i][j]
                new = (old + p["theta_step"] * self.z[0] + math.pi) % (2 * math.pi) - math.pi
                delta = self.edge_energy(i, j, new) - self.edge_energy(i, j, old)
                if delta <= 0 or p["temp"] > 1e-12 and u[3] < math.exp(-delta / p["temp"]):
                    self.near[i][j], self.near[j][i] = new, -new
        elif u[1] < p["p_triadic"]:
            around = sorted(self.near[int(u[2] * n)])
            if len(around) >= 2:
                a = int(u[4] * len(around))
                b = int(u[5] * (len(around) - 1))
                b += b >= a
                self._toggle(around[a], around[b], 0.0, u[3], u[6])
        else:
            self._global(u)
        self.step += 1

    def _global(self, u: np.ndarray) -> None:
        n, edges = self.n, len(self.edges)
        free = n * (n - 1) // 2 - edges
        if edges + free == 0:
            return
        remove = u[2] < (0.0 if not edges else 1.0 if not free else 0.5)
        # At the boundaries the direction is forced; the exact ratio accounts for that.
        shift = 0.0
        if self.exact:
            full = edges + free
            after = edges - 1 if remove else edges + 1
            shift = (-math.log(2) if edges in (0, full) else 0.0) + (math.log(2) if after in (0, full) else 0.0)
        if remove:
            i, j = self.edges[int(u[4] * edges)]
            self._toggle(i, j, math.log(max(1, edges) / max(1, free + 1)) + shift, u[3], u[6])
            return
        for k in range(28):
            i, j = int(u[8 + 2 * k] * n), int(u[9 + 2 * k] * n)
            if i != j and j not in self.near[i]:
                self._toggle(i, j, math.log(max(1, free) / max(1, edges + 1)) + shift, u[3], u[6])
                return

    # -- measuring --
    def triangles(self) -> int:
        return sum(1 for i, j in self.edges for k in self.near[j] if k > j and k in self.near[i])

    def metrics(self) -> dict:
        d = [len(x) for x in self.near] or [0]
        return {"step": self.step, "k_min": min(d), "k_avg": round(sum(d) / len(d), 5), "k_max": max(d), "n_edges": len(self.edges), "triangles": self.triangles(), "temp": self.p["temp"]}

    def snapshot(self) -> dict:
        return {"psi_re": list(self.re), "psi_im": list(self.im), "src": [i for i, _ in self.edges], "dst": [j for _, j in self.edges], "theta": [self.near[i][j] for i, j in self.edges]}


def temperature(step: int, t0: float, decay: float, floor: float = 1e-20) -> float:
    return max(t0 * decay**step, floor)


LOG = "step long, k_min long, k_avg double, k_max long, n_edges long, triangles long, temp double"
STATE = "psi_re array<double>, psi_im array<double>, src array<int>, dst array<int>, theta array<double>"


def evolve(chain: Chain, steps: int, interval: int, t0: float | None = None, decay: float = 1.0, goal: tuple[int, int, float] | None = None) -> Iterator[dict]:
    """Metrics and state every ``interval`` steps, until ``steps`` or, with a goal (streak, least degree, mean degree), completion."""
    streak, level = 0, None
    while chain.step < steps:
        for _ in range(min(interval, steps - chain.step)):
            if t0 is not None:
                chain.p["temp"] = temperature(chain.step, t0, decay)
            chain.move()
        m = chain.metrics()
        streak, level = (streak + 1 if level == int(m["k_avg"] * 1000) else 1), int(m["k_avg"] * 1000)
        yield {**m, **chain.snapshot(), "streak": streak}
        if goal and streak >= goal[0] and m["k_min"] >= goal[1] and m["k_avg"] >= goal[2]:
            return


def _named(row) -> dict[str, float]:
    return params(**{k: float(row[k]) for k in PARAMS if k in row})


def per_chain(runs: DataFrame, keys: list[str], schema: str, f: Callable[[dict], list[dict]]) -> DataFrame:
    """One task per row of ``runs`` (keys identify rows): f gives the rows of a chain."""
    fields = ", ".join(f"{c} {t}" for c, t in runs.select(*keys).dtypes)

    def chain(pdf: pd.DataFrame) -> pd.DataFrame:
        names = [x.strip().split(" ")[0] for x in (fields + ", " + schema).split(", ")]
        out = [{**{k: row[k] for k in keys}, **r} for row in pdf.to_dict("records") for r in f(row)]
        return pd.DataFrame(out, columns=names)

    return spread(runs, *keys).groupBy(*keys).applyInPandas(chain, f"{fields}, {schema}")


def simulate(runs: DataFrame, keys: list[str], steps: int, interval: int, t0: float | None = None, decay: float = 1.0, goal: tuple[int, int, float] | None = None, keep_state: bool = False) -> DataFrame:
    """Log rows (and states) of every run: columns n, seed and any parameter by name."""
    names = LOG + (", " + STATE if keep_state else "") + ", streak long"

    def f(row: dict) -> list[dict]:
        return list(evolve(Chain(int(row["n"]), int(row["seed"]), _named(row)), steps, interval, t0, decay, goal))

    return per_chain(runs, keys, names, f)


def sweep(points: DataFrame, keys: list[str], max_steps: int, interval: int = 10_000, streak: int = 100, mean_degree: float = 1.999, min_degree: int = 4, decay: float = 0.9999) -> DataFrame:
    """End state of every grid point; a column ``cooling`` overrides the decay."""

    def f(row: dict) -> list[dict]:
        chain = Chain(int(row["n"]), int(row["seed"]), _named(row))
        rate, t0, run, level, m, state = float(row.get("cooling", decay)), chain.p["temp"], 0, None, None, "TIMEOUT"
        while chain.step < max_steps:
            chain.p["temp"] = temperature(chain.step, t0, rate)
            for _ in range(interval):
                chain.move()
            m = chain.metrics()
            if math.isnan(chain.re[0]):
                state = "NAN_PSI"
                break
            run, level = (run + 1 if level == int(m["k_avg"] * 1000) else 1), int(m["k_avg"] * 1000)
            if run >= streak:
                state = ("CRYSTALLIZED" if m["k_min"] >= min_degree else "STABLE") if m["k_avg"] >= mean_degree else "COLLAPSED"
                break
        m = m or chain.metrics()
        return [{"steps": chain.step, "status": state, **{k: m[k] for k in ("k_avg", "triangles", "k_min", "k_max")}}]

    return per_chain(points, keys, "steps long, status string, k_avg double, triangles long, k_min long, k_max long", f)


def resume(states: DataFrame, keys: list[str], n: int, targets: str = "targets", decay: float = 1.0, t0: float | None = None) -> DataFrame:
    """From stored states (one row per segment: step, seed, state columns, an array of target steps) the states at each target."""

    def f(row: dict) -> list[dict]:
        chain = Chain(n, int(row["seed"]), step=int(row["pad"])).load(zip(range(n), row["psi_re"], row["psi_im"], strict=False), zip(row["src"], row["dst"], row["theta"], strict=True))
        out = []
        for t in sorted(row[targets]):
            while chain.step < t:
                if t0 is not None:
                    chain.p["temp"] = temperature(chain.step, t0, decay)
                chain.move()
            out.append({**chain.metrics(), **chain.snapshot()})
        return out

    return per_chain(states, keys, f"{LOG}, {STATE}", f)


def verify(states: DataFrame, keys: list[str], n: int, relative: float = 1e-4) -> DataFrame:
    """Replay each segment and compare with what is stored (expected_triangles, expected_k_avg at the segment's one target)."""
    again = resume(states, keys, n).select(*keys, F.col("triangles").alias("t"), F.col("k_avg").alias("k"))
    j = states.select(*keys, "expected_triangles", "expected_k_avg").join(again, keys)
    same = (F.col("t") == F.col("expected_triangles")) & (F.abs(F.col("k") - F.col("expected_k_avg")) <= relative * F.greatest(F.abs("k"), F.abs("expected_k_avg")))
    return j.select(*keys, same.alias("matches"))


def stitch(states: DataFrame, log: DataFrame, keys: list[str], n: int, interval: int, relative: float = 1e-4) -> DataFrame:
    """``[keys], step``: of each run the latest stored step that a replay from the interval before it reproduces, falling back interval by interval; null if none does.

    ``states``: rows of the stored chain (LOG and STATE columns) at multiples of ``interval``; ``log``: ``[keys], step, triangles, k_avg``.
    """
    target = log.select(*keys, F.col("step").alias("target"), F.col("triangles").alias("expected_triangles"), F.col("k_avg").alias("expected_k_avg"))
    at = states.withColumn("target", F.col("step") + interval).join(target, [*keys, "target"])
    # All segments are replayed at once: each is a chain of its own, and the latest that matches counts.
    segments = at.withColumn("pad", F.col("step")).withColumn("targets", F.array("target")).drop("step")
    same = verify(segments, [*keys, "target"], n, relative).where("matches").groupBy(*keys).agg(F.max("target").alias("step"))
    return states.select(*keys).distinct().join(same, keys, "left")


def heal(runs: DataFrame, keys: list[str], warm: int, cluster: int, rapid: int, long: int, temp: float = 0.6) -> DataFrame:
    """Damage and healing: evolve, remove all edges of two clusters, heal shortly and at length; per phase the edges and those that are new."""

    def f(row: dict) -> list[dict]:
        chain = Chain(int(row["n"]), int(row["seed"]), _named(row))
        for _ in range(warm):
            chain.move()
        base = set(chain.edges)
        first = max(range(chain.n), key=lambda k: (len(chain.near[k]), -k))
        ball = _ball(chain, first, cluster)
        rim = sorted({x for k in _reach(chain, ball, 5) for x in [k]} - set(ball))
        victims = set(ball) | (set(_ball(chain, rim[0], cluster)) if rim else set())
        out = [_phase("baseline", chain, base, victims)]
        for v in victims:
            for w in list(chain.near[v]):
                del chain.near[v][w], chain.near[w][v]
        chain.edges = sorted((i, j) for i in range(chain.n) for j in chain.near[i] if i < j)
        out.append(_phase("void", chain, base, victims))
        chain.p["temp"], chain.p["p_psi"], chain.p["p_theta"] = temp, 0.005, 0.005
        for name, steps in (("healed", rapid), ("integrated", long)):
            for _ in range(steps):
                chain.move()
            out.append(_phase(name, chain, base, victims))
        return out

    return per_chain(runs, keys, "phase string, n_edges long, new_edges long, victims long, victim_edges long, triangles long", f)


def _ball(chain: Chain, start: int, size: int) -> list[int]:
    seen, queue = [start], [start]
    while queue and len(seen) < size:
        for x in sorted(chain.near[queue.pop(0)]):
            if x not in seen and len(seen) < size:
                seen.append(x)
                queue.append(x)
    return seen


def _reach(chain: Chain, nodes: list[int], hops: int) -> set[int]:
    seen, edge = set(nodes), set(nodes)
    for _ in range(hops):
        edge = {x for k in edge for x in chain.near[k]} - seen
        seen |= edge
    return seen


def _phase(name: str, chain: Chain, base: set, victims: set[int]) -> dict:
    return {
        "phase": name, "n_edges": len(chain.edges), "new_edges": sum(e not in base for e in chain.edges), "victims": len(victims),
        "victim_edges": sum(i in victims or j in victims for i, j in chain.edges), "triangles": chain.triangles(),
    }


def quench(runs: DataFrame, keys: list[str], warm: int, frozen: int = 500, rewired: int = 1000, kick: float = 1.5, rewire: float = 0.15) -> DataFrame:
    """A perturbed copy relaxes, first with frozen edges, then rewiring: |psi| of every node before and after, with hops from the kicked one."""

    def f(row: dict) -> list[dict]:
        chain = Chain(int(row["n"]), int(row["seed"]), _named(row))
        for _ in range(warm):
            chain.move()
        centre = max(range(chain.n), key=lambda k: (len(chain.near[k]), -k))
        hops = _hops(chain, centre)
        rho = [a * a + b * b for a, b in zip(chain.re, chain.im, strict=True)]
        curve = [_forman(chain, k) for k in range(chain.n)]
        chain.re[centre], chain.im[centre] = chain.re[centre] * (1 + kick), chain.im[centre] * (1 + kick)
        chain.p["p_psi"], chain.p["p_theta"] = 0.6, 0.4
        for _ in range(frozen):
            chain.move()
        chain.p["p_psi"], chain.p["p_theta"] = 0.5, 0.5 - rewire
        for _ in range(rewired):
            chain.move()
        return [{"node_id": k, "d": hops.get(k), "rho_before": rho[k], "rho_after": chain.re[k] ** 2 + chain.im[k] ** 2, "curvature_before": curve[k], "curvature_after": _forman(chain, k)} for k in range(chain.n)]

    return per_chain(runs, keys, "node_id long, d double, rho_before double, rho_after double, curvature_before double, curvature_after double", f)


def light_cone_records(runs: DataFrame, keys: list[str], warm: int, moves: int = 10_000, every: int = 100, kick: float = 1.5) -> DataFrame:
    """One node kicked; amplitudes of all nodes each ``every`` moves, with hops from it."""

    def f(row: dict) -> list[dict]:
        chain = Chain(int(row["n"]), int(row["seed"]), _named(row))
        for _ in range(warm):
            chain.move()
        centre = max(range(chain.n), key=lambda k: (len(chain.near[k]), -k))
        hops = _hops(chain, centre)
        record = lambda t: [{"t": t, "node_id": k, "d": hops.get(k), "psi_re": chain.re[k], "psi_im": chain.im[k]} for k in range(chain.n)]
        out = record(0)
        chain.re[centre], chain.im[centre] = chain.re[centre] * (1 + kick), chain.im[centre] * (1 + kick)
        chain.p["p_psi"], chain.p["p_theta"] = 0.6, 0.4
        for t in range(1, moves + 1):
            chain.move()
            if t % every == 0:
                out += record(t)
        return out

    return per_chain(runs, keys, "t long, node_id long, d double, psi_re double, psi_im double", f)


def _hops(chain: Chain, start: int) -> dict[int, float]:
    seen, edge, d = {start: 0.0}, [start], 0.0
    while edge:
        d += 1
        edge = [x for x in {y for k in edge for y in chain.near[k]} if x not in seen]
        seen |= dict.fromkeys(edge, d)
    return seen


def _forman(chain: Chain, k: int) -> float:
    own = chain.near[k]
    return sum(4 - len(own) - len(chain.near[x]) for x in own) / len(own) if own else 0.0
