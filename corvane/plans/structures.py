"""Molecules: SMILES texts made of the part's numbers, and what the structure operators say of them.

Equal molecules are written in two ways, from either end, and some have a salt's second part; one in
eleven can't be read. SQL counts atoms by the same numbers.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import bits, structures
from .registry import plan

#: Ring systems written to end a text and to begin one; the ends of the chain likewise.
_RINGS = (("c1ccccc1", "c1ccc(cc1)"), ("N1CCCCC1", "C1CCN(CC1)"), ("C1CC1", "C1CC1"), ("c1cccs1", "s1cccc1"), ("c1ccc2ccccc2c1", "c1ccc2cc(ccc2c1)"))
_ENDS = (("O", "O"), ("N", "N"), ("OC(=O)", "C(=O)O"), ("Cl", "Cl"))

#: p_partkey, ring, chain, tail, salt and the counts of atoms; unreadable parts left out.
_ATOMS = """
with m as (select p_partkey, (p_partkey % 5)::int as ring, (p_size % 6)::int as chain, ((p_partkey // 5) % 4)::int as tail, p_partkey % 7 = 0 as salt from part where p_partkey % 11 <> 0),
a as (select *, [6, 5, 3, 4, 10][ring + 1] + chain + case when tail = 2 then 1 else 0 end as c,
  [5, 10, 5, 3, 7][ring + 1] + 2 * chain + [1, 2, 1, 0][tail + 1] + case when salt then 1 else 0 end as h,
  case when ring = 1 then 1 else 0 end + case when tail = 1 then 1 else 0 end as n, [1, 0, 2, 0][tail + 1] as o,
  case when ring = 3 then 1 else 0 end as s, case when tail = 3 then 1 else 0 end + case when salt then 1 else 0 end as cl from m)
"""
_MASS = "c * 12.0::double + h * 1.00782503207::double + n * 14.0030740048::double + o * 15.99491461956::double + s * 31.972071::double + cl * 34.96885268::double"


def molecules(t):
    """p_partkey and its SMILES text."""
    pick = lambda texts, k: F.element_at(F.array(*map(F.lit, texts)), k.cast("int") + 1)
    key = F.col("p_partkey")
    ring, tail, chain = key % 5, F.floor(key / 5) % 4, F.repeat(F.lit("C"), F.col("p_size") % 6)
    ends_with_ring = F.concat(pick([e for e, _ in _ENDS], tail), chain, pick([r for r, _ in _RINGS], ring))
    begins_with_it = F.concat(pick([r for _, r in _RINGS], ring), chain, pick([e for _, e in _ENDS], tail))
    text = F.concat(F.when(key % 2 == 0, ends_with_ring).otherwise(begins_with_it), F.when(key % 7 == 0, ".Cl").otherwise(""))
    return t.part.select("p_partkey", F.when(key % 11 == 0, F.concat(text, F.lit("("))).otherwise(text).alias("smiles"))


@plan("udf01_structure_key", _ATOMS + "select p.p_partkey, case when m.p_partkey is not null then min(m.p_partkey) over (partition by ring, chain, tail, salt) end as same_as from part p left join m using (p_partkey)")
def _(t):
    """The smallest part of the same structure, found by canonical keys; null where a text can't be read."""
    keyed = structures.described(molecules(t), "smiles").select("p_partkey", "key")
    return structures.one_of_each(keyed, "key", "p_partkey", "same_as").select("p_partkey", "same_as")


@plan("udf02_circular_fingerprint", _ATOMS + "select p_partkey, 32::bigint as words, 1.0::double as alike from m")
def _(t):
    """Words of each fingerprint, and its Tanimoto similarity to that of the first part of the same structure, which may be written otherwise."""
    known = structures.described(molecules(t), "smiles").where("key is not null").select("p_partkey", "key", "fingerprint")
    first = known.groupBy("key").agg(F.min_by("fingerprint", "p_partkey").alias("other"))
    return known.join(first, "key").select("p_partkey", F.size("fingerprint").alias("words"), bits.tanimoto(F.col("fingerprint"), F.col("other")).alias("alike"))


@plan("udf03_structure_mass", _ATOMS + f"select p_partkey, c::bigint as carbons, h::bigint as hydrogens, round({_MASS}, 6) as mass from a")
def _(t):
    found = structures.masses(molecules(t), "smiles").where("formula is not null")
    return found.select("p_partkey", F.col("formula")["C"].alias("carbons"), F.coalesce(F.col("formula")["H"], F.lit(0)).alias("hydrogens"), "mass")


def _spectra(t):
    """An order's lines as a spectrum, and each of its parts as a candidate: rid, part, smiles, mzs, intensities, precursor, positive, adduct."""
    lines = t.lineitem.select(F.col("l_orderkey").alias("rid"), F.struct((F.col("l_partkey") % 200 + F.col("l_discount")).cast("double").alias("mz"), F.col("l_quantity").cast("double").alias("i")).alias("peak"), F.col("l_partkey").alias("part"))
    spectra = lines.groupBy("rid").agg(F.array_sort(F.collect_list("peak")).alias("peaks"), F.collect_set("part").alias("parts"))
    rows = spectra.select("rid", F.col("peaks.mz").alias("mzs"), F.col("peaks.i").alias("intensities"), F.explode("parts").alias("part"))
    named = structures.masses(molecules(t), "smiles").where("mass is not null").select(F.col("p_partkey").alias("part"), "smiles", "mass")
    positive = F.col("rid") % 3 != 0
    precursor = F.when(positive, F.col("mass") + F.when(F.col("rid") % 2 == 0, 1.0072765).otherwise(22.98922112)).otherwise(F.col("mass") - 1.0072765)
    adduct = F.when(~positive, "[M-H]-").when(F.col("rid") % 2 == 0, "[M+H]+").otherwise("[M+Na]+")
    return rows.join(named, "part").withColumns({"positive": positive, "precursor": precursor, "adduct": adduct})


@plan("udf05_evidence_with_adducts")
def _(t):
    """The share of each order's spectrum that each candidate's ion accounts for, by sub-formulas and by pieces."""
    by_formula = structures.explained_by_formula(_spectra(t), "smiles", "mzs", "intensities", "precursor", "positive", 0.02)
    both = structures.explained_by_pieces(by_formula, "smiles", "mzs", "intensities", "adduct", 0.05)
    return both.select("rid", "part", "by_formula", "by_pieces")


@plan("udf06_structure_fragments")
def _(t):
    return structures.pieces(molecules(t), "smiles").select("p_partkey", F.explode("pieces").alias("mass"))
