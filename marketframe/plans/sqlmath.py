"""SQL text of the normal distribution, for the twins (same published coefficients)."""

from __future__ import annotations

from ..functions import normal as nz


def _horner(coefs: list[float], x: str) -> str:
    text = f"{coefs[0]:.17e}"
    for c in coefs[1:]:
        text = f"({text} * {x} + {c:.17e})"
    return text


def cdf(x: str) -> str:
    """Upper-tail form on abs(x); ``x`` should be a plain column."""
    a = f"abs({x})"
    frac = f"({a} + 0.65e0)"
    for k in ("4e0", "3e0", "2e0", "1e0"):
        frac = f"({a} + {k} / {frac})"
    dens = f"exp(-{a} * {a} / 2e0)"
    up = (
        f"CASE WHEN {a} > 37e0 THEN 0e0 WHEN {a} < {nz.CDF_SPLIT:.17e} THEN {dens} * {_horner(nz.CDF_NUM, a)} / {_horner(nz.CDF_DEN, a)} "
        f"ELSE {dens} / {frac} / {nz.CDF_SCALE:.17e} END"
    )
    return f"(CASE WHEN {x} IS NULL THEN NULL WHEN {x} > 0 THEN 1e0 - ({up}) ELSE ({up}) END)"


def ppf(p: str) -> str:
    q = f"({p} - 0.5e0)"
    r = f"(0.180625e0 - {q} * {q})"
    t = f"sqrt(-ln(CASE WHEN {q} < 0 THEN {p} ELSE 1e0 - {p} END))"
    mid, out = f"({t} - 1.6e0)", f"({t} - 5e0)"
    size = (
        f"CASE WHEN {t} <= 5e0 THEN {_horner(nz.PPF_C, mid)} / {_horner(nz.PPF_D, mid)} ELSE {_horner(nz.PPF_E, out)} / {_horner(nz.PPF_F, out)} END"
    )
    return (
        f"(CASE WHEN {p} > 0 AND {p} < 1 THEN CASE WHEN abs{q} <= 0.425e0 THEN {q} * {_horner(nz.PPF_A, r)} / {_horner(nz.PPF_B, r)} "
        f"WHEN {q} < 0 THEN -({size}) ELSE ({size}) END END)"
    )
