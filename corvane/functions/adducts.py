"""Ions of molecules: adducts, and how much of a spectrum a molecule's formula or its pieces account for."""

from __future__ import annotations

from functools import lru_cache
from typing import NamedTuple

import numpy as np

from .kernels import MASSES

ELECTRON = 0.00054858
_PROTON, _WATER = 1.0072765, 18.0105646


class Adduct(NamedTuple):
    #: What the ion's m/z adds to the neutral mass, its sign, and the atoms it gains and loses.
    shift: float
    positive: bool
    atoms: dict[str, int]
    #: Mass of an ion besides the proton that a fragment may keep; 0 where there is none.
    carrier: float = 0.0


# Shifts, signs, compositions and carriers of the ten adducts.
ADDUCTS = {
    "[M+H]+": Adduct(_PROTON, True, {"H": 1}),
    "[M+NH4]+": Adduct(17.0265491 + _PROTON, True, {"N": 1, "H": 4}, MASSES["N"] + 4 * MASSES["H"] - ELECTRON),
    "[M-H2O+H]+": Adduct(_PROTON - _WATER, True, {"H": -1, "O": -1}),
    "[M-2H2O+H]+": Adduct(_PROTON - 2 * _WATER, True, {"H": -3, "O": -2}),
    "[M+Na]+": Adduct(22.9897697 - ELECTRON, True, {"Na": 1}, MASSES["Na"] - ELECTRON),
    "[M+K]+": Adduct(38.9637069 - ELECTRON, True, {"K": 1}, MASSES["K"] - ELECTRON),
    "[M-H]-": Adduct(-_PROTON, False, {"H": -1}),
    "[M-H2O-H]-": Adduct(-_PROTON - _WATER, False, {"H": -3, "O": -1}),
    "[M+CH2O2-H]-": Adduct(46.0054793 - _PROTON, False, {"C": 1, "H": 1, "O": 2}, MASSES["C"] + MASSES["H"] + 2 * MASSES["O"] + ELECTRON),
    "[M+Cl]-": Adduct(34.96885271 + ELECTRON, False, {"Cl": 1}, MASSES["Cl"] + ELECTRON),
}
#: Tolerances in daltons; hydrogens that a piece may gain or lose; sub-formulas above which a formula is no evidence.
FORMULA_DA, PIECE_DA = 0.005, 0.01
HYDROGENS = (-2, -1, 0, 1, 2)
MOST_SUBFORMULAS = 4_000_000


def likeliest(mass: float, precursor: float, names: list[str]) -> str | None:
    """The adduct that puts the mass nearest to the precursor's m/z."""
    return min((a for a in names if a in ADDUCTS), key=lambda a: abs(mass + ADDUCTS[a].shift - precursor), default=None)


def ion_of(formula: dict[str, int], adduct: str) -> dict[str, int] | None:
    """The ion's element counts; None where the molecule lacks what the adduct takes."""
    ion = dict(formula)
    for e, n in ADDUCTS[adduct].atoms.items():
        ion[e] = ion.get(e, 0) + n
    return None if any(n < 0 for n in ion.values()) else {e: n for e, n in ion.items() if n}


@lru_cache(maxsize=256)
def _subformulas(ion: tuple[tuple[str, int], ...], most: int) -> np.ndarray | None:
    size = 1
    for _, n in ion:
        size *= n + 1
    if size > most:
        return None
    every = np.zeros(1)
    for e, n in ion:
        every = np.add.outer(every, MASSES[e] * np.arange(n + 1)).ravel()
    return np.unique(every)


def _share(known: np.ndarray, at: np.ndarray, intensities: np.ndarray, tolerance: float) -> float:
    """Intensity at places within the tolerance of one of the sorted numbers, over all intensity; 0 where there is none."""
    total = float(intensities.sum())
    if not len(known) or total <= 0:
        return 0.0
    above = np.searchsorted(known, at)
    gap = np.minimum(np.abs(known[np.minimum(above, len(known) - 1)] - at), np.abs(known[np.maximum(above - 1, 0)] - at))
    return float(intensities[gap <= tolerance].sum()) / total


def explained_by_formula(formula: dict[str, int] | None, mzs, intensities, precursor: float, names: list[str], tolerance: float = FORMULA_DA, most: int = MOST_SUBFORMULAS) -> float:
    """The share of the intensity at sub-formulas of the ion that the likeliest adduct makes.

    0 without a formula, with elements of unknown mass, where the ion would lack atoms, and where there are more sub-formulas than most.
    """
    if not formula or any(e not in MASSES for e in formula):
        return 0.0
    adduct = likeliest(sum(MASSES[e] * n for e, n in formula.items()), precursor, names)
    ion = ion_of(formula, adduct) if adduct else None
    known = _subformulas(tuple(sorted(ion.items())), most) if ion else None
    if known is None:
        return 0.0
    neutral = np.asarray(mzs, float) + (ELECTRON if ADDUCTS[adduct].positive else -ELECTRON)
    return _share(known, neutral, np.asarray(intensities, float), tolerance)


def explained_by_pieces(pieces: list[float] | None, mzs, intensities, adduct: str, tolerance: float = PIECE_DA) -> float:
    """The share of the intensity at pieces of a molecule, give or take some hydrogens, that carry a proton or the adduct's own ion."""
    if not pieces:
        return 0.0
    return _share(ions_of(pieces, adduct), np.asarray(mzs, float), np.asarray(intensities, float), tolerance)


def _shares(known: np.ndarray, at: np.ndarray, intensities: np.ndarray, row: np.ndarray, n: int, tolerance: float) -> np.ndarray:
    """_share() of n spectra at once, whose peaks lie end to end; row says whose a peak is."""
    total = np.bincount(row, intensities, n)
    if not len(known):
        return np.zeros(n)
    above = np.searchsorted(known, at)
    gap = np.minimum(np.abs(known[np.minimum(above, len(known) - 1)] - at), np.abs(known[np.maximum(above - 1, 0)] - at))
    return np.divide(np.bincount(row, np.where(gap <= tolerance, intensities, 0.0), n), total, out=np.zeros(n), where=~(total <= 0))


def all_explained_by_formula(formula: dict[str, int] | None, mzs: np.ndarray, intensities: np.ndarray, row: np.ndarray, precursors: np.ndarray, names: list[str], tolerance: float = FORMULA_DA, most: int = MOST_SUBFORMULAS) -> np.ndarray:
    """explained_by_formula() of one candidate with many spectra, whose peaks lie end to end; row says whose a peak is."""
    out, names = np.zeros(len(precursors)), [a for a in names if a in ADDUCTS]
    if not formula or any(e not in MASSES for e in formula) or not names:
        return out
    mass = sum(MASSES[e] * n for e, n in formula.items())
    pick = np.abs(mass + np.array([ADDUCTS[a].shift for a in names])[:, None] - precursors[None, :]).argmin(axis=0)
    for k in np.unique(pick).tolist():
        ion = ion_of(formula, names[k])
        known = _subformulas(tuple(sorted(ion.items())), most) if ion else None
        if known is None:
            continue
        on = pick[row] == k
        neutral = mzs[on] + (ELECTRON if ADDUCTS[names[k]].positive else -ELECTRON)
        out += np.where(pick == k, _shares(known, neutral, intensities[on], row[on], len(out), tolerance), 0.0)
    return out


def ions_of(pieces: list[float] | None, adduct: str) -> np.ndarray:
    """The sorted ions of a molecule's pieces, as explained_by_pieces() knows them."""
    if not pieces:
        return np.zeros(0)
    known = ADDUCTS.get(adduct)
    positive = known.positive if known else adduct.endswith("+")
    proton = MASSES["H"] - ELECTRON
    carriers = [proton if positive else -proton, *([known.carrier] if known and known.carrier else [])]
    return np.sort(np.add.outer(np.add.outer(np.asarray(pieces), MASSES["H"] * np.array(HYDROGENS)), np.array(carriers)).ravel())


def all_explained_by_pieces(ions: np.ndarray, mzs: np.ndarray, intensities: np.ndarray, row: np.ndarray, n: int, tolerance: float = PIECE_DA) -> np.ndarray:
    """explained_by_pieces() of one candidate and adduct (ions_of()) with many spectra, whose peaks lie end to end."""
    return _shares(ions, mzs, intensities, row, n, tolerance)
