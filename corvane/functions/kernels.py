"""Chemistry kernels in plain Python: element counts, sub-formula masses, explained intensity."""

from __future__ import annotations

import re
from bisect import bisect_left

from .molecules import cut_masses

# Monoisotopic masses, and those of an electron and a proton.
MASSES = {"H": 1.00782503207, "C": 12.0, "N": 14.0030740048, "O": 15.99491461956, "S": 31.972071, "P": 30.97376163, "F": 18.99840322, "Cl": 34.96885268, "Br": 78.9183371}
MASSES |= {"I": 126.904473, "Na": 22.9897692809, "K": 38.96370668, "Si": 27.9769265325, "B": 11.0093054, "Se": 79.9165213}
PROTON = 1.00727646688
#: Masses of the pieces that one or two cuts of a graph (weights, bonds) leave.
fragments = cut_masses
_PART = re.compile(r"([A-Z][a-z]?)(\d*)")


def elements(formula: str | None) -> dict[str, int]:
    """Element counts of a formula such as C6H12O6; empty for null or unknown text."""
    out: dict[str, int] = {}
    if not formula or _PART.sub("", formula):
        return out
    for name, n in _PART.findall(formula):
        out[name] = out.get(name, 0) + int(n or 1)
    return out


def mass(formula: str | None) -> float | None:
    counts = elements(formula)
    if not counts or any(e not in MASSES for e in counts):
        return None
    return sum(MASSES[e] * n for e, n in counts.items())


def subformula_masses(formula: str | None, most: int = 4_000_000) -> list[float]:
    """Sorted distinct masses of all sub-formulas. A formula with more of them than `most` gives none: it is no evidence."""
    counts, total = elements(formula), 1
    if any(e not in MASSES for e in counts):
        return []
    for n in counts.values():
        total *= n + 1
    if total > most:
        return []
    masses = {0.0}
    for e, n in counts.items():
        masses = {m + k * MASSES[e] for m in masses for k in range(n + 1)}
    return sorted({round(m, 6) for m in masses} - {0.0})


def near_any(masses: list[float], value: float, tolerance: float) -> bool:
    i = bisect_left(masses, value - tolerance)
    return i < len(masses) and masses[i] <= value + tolerance


def explained(peaks: list[tuple[float, float]], masses: list[float], ppm: float = 10.0, hydrogens: int = 0) -> float:
    """The share of the intensity whose m/z, less a proton and give or take some hydrogens, is one of the sorted masses."""
    total = sum(i for _, i in peaks)
    if total <= 0:
        return 0.0
    hit = sum(i for mz, i in peaks if any(near_any(masses, mz - PROTON + k * MASSES["H"], mz * ppm / 1e6) for k in range(-hydrogens, hydrogens + 1)))
    return hit / total
