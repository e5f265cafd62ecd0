"""Column functions of amplitudes, phases and energies. A complex number is two DOUBLE columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F



def density(re: Column, im: Column) -> Column:
    return re * re + im * im


def modulus(re: Column, im: Column) -> Column:
    return F.hypot(re, im)


def phase(re: Column, im: Column) -> Column:
    return F.atan2(im, re)


def wrap(theta: Column) -> Column:
    """An angle in [-pi, pi)."""
    return F.pmod(theta + F.pi(), 2 * F.pi()) - F.pi()


def edge_key(a: Column, b: Column) -> tuple[Column, Column]:
    return F.least(a, b), F.greatest(a, b)


def oriented(theta: Column, i: Column, j: Column) -> Column:
    return F.when(i < j, theta).otherwise(-theta)


def link(theta: Column) -> tuple[Column, Column]:
    """exp(i theta) as real and imaginary part."""
    return F.cos(theta), F.sin(theta)


def self_energy(rho: Column, p: dict[str, float]) -> Column:
    return p["mass2"] * rho + p["lam_psi"] * rho * rho + p["lam_pauli"] * F.exp(rho / max(1e-9, p["rho0"]))


def transport(re_i: Column, im_i: Column, re_j: Column, im_j: Column, theta: Column) -> Column:
    """Re(conj(psi_i) exp(i theta) psi_j)."""
    return (re_i * re_j + im_i * im_j) * F.cos(theta) - (re_i * im_j - im_i * re_j) * F.sin(theta)


def hop_energy(re_i: Column, im_i: Column, re_j: Column, im_j: Column, theta: Column, p: dict[str, float]) -> Column:
    return -p["kappa"] * transport(re_i, im_i, re_j, im_j, theta)


def stress_energy(rho_i: Column, rho_j: Column, p: dict[str, float]) -> Column:
    return p["lam_g"] * (rho_i + rho_j)


def triangle_energy(t_ij: Column, t_jk: Column, t_ik: Column, p: dict[str, float]) -> Column:
    return p["beta"] * (1 - F.cos(t_ij + t_jk - t_ik))


def degree_energy(d: Column, p: dict[str, float]) -> Column:
    return p["mu_deg2"] * d * d


def toggle_delta(exists: Column, edge: Column, d_u: Column, d_v: Column, p: dict[str, float]) -> Column:
    """Change of the action when an edge (its own energy ``edge``) is removed or added."""
    own = edge + p["lam_e"]
    return F.when(exists, -own + p["mu_deg2"] * ((1 - 2 * d_u) + (1 - 2 * d_v))).otherwise(own + p["mu_deg2"] * ((1 + 2 * d_u) + (1 + 2 * d_v)))


def accept_probability(delta: Column, temp: float, log_q: Column | None = None) -> Column:
    """min(1, exp(-dE / T + log q)); at T of practically zero 1 where dE <= 0, else 0."""
    if temp <= 1e-12:
        return F.when(delta <= 0, 1.0).otherwise(0.0)
    exponent = -delta / temp + (log_q if log_q is not None else F.lit(0.0))
    return F.when(exponent >= 0, 1.0).otherwise(F.exp(exponent))


def proposal_log_ratio(exists: Column, edges: Column, pairs: Column) -> Column:
    """Forward and backward choice of a global toggle: ln(E / (NE + 1)) to remove, ln(NE / (E + 1)) to add, with counts of at least 1."""
    free = pairs - edges
    at_least = lambda c: F.greatest(F.lit(1.0), c.cast("double"))
    return F.when(exists, F.ln(at_least(edges) / at_least(free + 1))).otherwise(F.ln(at_least(free) / at_least(edges + 1)))


def pair_count(n: Column) -> Column:
    return F.floor(n * (n - 1) / 2)


def temperature(step: Column, t0: float, decay: float, floor: float = 1e-20) -> Column:
    return F.greatest(t0 * F.pow(F.lit(decay), step), F.lit(floor))


def forman(d_u: Column, d_v: Column) -> Column:
    return 4 - d_u - d_v


def quantised(k: Column) -> Column:
    """Thousandths, truncated."""
    return (k * 1000).cast("long")


def mean_degree(edges: Column, n: Column) -> Column:
    return F.try_divide(2.0 * edges, n)


def efficiency(avg_triangles: Column, goal: Column) -> Column:
    return F.when((goal > 0) & (avg_triangles > 0), avg_triangles / goal * 1e6)
