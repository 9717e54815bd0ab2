"""Molecules: hand-checked texts, keys and fingerprints under renumbering, cuts against all cuts, evidence of spectra."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from corvane.functions import adducts, molecules, scalars
from corvane.functions.kernels import MASSES
from corvane.functions.molecules import read
from corvane.operators import bits, structures

CAFFEINE = "Cn1cnc2c1c(=O)n(C)c(=O)n2C"
TEXTS = [CAFFEINE, "OC[C@H]1OC(O)[C@H](O)[C@@H](O)[C@@H]1O", "c1ccc2cc3ccccc3cc2c1", "CC(=O)[O-].[Na+]", "C1CC1C2CC2", "C1CC2CCC1CC2", "C12C3C4C1C5C2C3C45", "CC(C)(C)C(C)(C)C(C)(C)C", "O=C(N)c1ccncc1", "C.C.C.CC"]


@pytest.mark.parametrize(
    "text, formula",
    [
        ("CCO", {"C": 2, "H": 6, "O": 1}), ("c1ccccc1", {"C": 6, "H": 6}), ("C1=CC=CC=C1", {"C": 6, "H": 6}), (CAFFEINE, {"C": 8, "H": 10, "N": 4, "O": 2}),
        ("CC(=O)[O-].[Na+]", {"C": 2, "H": 3, "Na": 1, "O": 2}), ("c1cc[nH]c1", {"C": 4, "H": 5, "N": 1}), ("[O-][N+](=O)c1ccccc1", {"C": 6, "H": 5, "N": 1, "O": 2}),
        ("CS(=O)(=O)N", {"C": 1, "H": 5, "N": 1, "O": 2, "S": 1}), ("N#Cc1ccncc1", {"C": 6, "H": 4, "N": 2}), ("[13CH4]", {"C": 1, "H": 4}), ("C%12CC%12", {"C": 3, "H": 6}), ("F/C=C/[C@@H](Cl)Br", {"Br": 1, "C": 3, "Cl": 1, "F": 1, "H": 3}),
        ("[NH3+:7]CC", {"C": 2, "H": 8, "N": 1}), ("[Cu++]", {"Cu": 1}), ("[H][H]", {"H": 2}),
    ],
)
def test_formulas(text, formula):
    assert read(text).formula() == formula


@pytest.mark.parametrize("text", [None, "", "not a smiles", "C(", "C)", "C1CC", "C==C", "[Xx]", "C11", "1CC", "C.", ".C", "C-", "[C", "()", "C(.C)", "C12CC12", "[C+-]", "C=1CC-1"])
def test_unreadable_texts(text):
    assert read(text) is None


def test_charges_isotopes_and_bonds():
    m = read("[13C@@H](=O)([O-])[Fe+2]")
    assert m.isotopes == [13, 0, 0, 0] and m.charges == [0, 0, -1, 2] and m.hydrogens == [1, 0, 0, 0]
    assert m.bonds == [(0, 1, 2), (0, 2, 1), (0, 3, 1)]
    assert read("c1ccccc1-c1ccccc1").bonds[6] == (5, 6, 1) and not molecules.ring_bonds(read("c1ccccc1-c1ccccc1"))[6]


def renumbered(m, rng):
    order = rng.sample(range(len(m.elements)), len(m.elements))
    place = {a: k for k, a in enumerate(order)}
    bonds = [(*sorted((place[a], place[b])), o) for a, b, o in m.bonds]
    rng.shuffle(bonds)
    return molecules.Molecule(*[[x[a] for a in order] for x in (m.elements, m.aromatic, m.charges, m.isotopes, m.hydrogens)], bonds)


def made_up(rng, n, more):
    bonds = {(rng.randrange(a), a) for a in range(1, n) if rng.random() < 0.9} | {tuple(sorted(rng.sample(range(n), 2))) for _ in range(more)}
    return molecules.Molecule([rng.choice("CNO") for _ in range(n)], [False] * n, [0] * n, [0] * n, [rng.randrange(4) for _ in range(n)], [(a, b, 1) for a, b in sorted(bonds)])


def test_keys_and_fingerprints_do_not_depend_on_the_numbering():
    rng = random.Random(1)
    for m in [*map(read, TEXTS), *(made_up(rng, rng.randrange(2, 10), rng.randrange(5)) for _ in range(40))]:
        key, print_ = molecules.structure_key(m), molecules.circular_fingerprint(m)
        assert len(key) == 14 and len(print_) == 32
        for _ in range(4):
            other = renumbered(m, rng)
            assert molecules.structure_key(other) == key and molecules.circular_fingerprint(other) == print_


def test_all_graphs_of_five_atoms_have_a_code_each():
    pairs, known = list(itertools.combinations(range(5), 2)), {}
    for chosen in range(1 << len(pairs)):
        bonds = [p for k, p in enumerate(pairs) if chosen >> k & 1]
        m = molecules.Molecule(["C"] * 5, [False] * 5, [0] * 5, [0] * 5, [0] * 5, [(a, b, 1) for a, b in bonds])
        least = min(tuple(sorted(tuple(sorted((p[a], p[b]))) for a, b in bonds)) for p in itertools.permutations(range(5)))
        known.setdefault(molecules.canonical_code(m), set()).add(least)
    assert len(known) == 34 and all(len(x) == 1 for x in known.values())


@pytest.mark.parametrize("a, b", [("c1ccccc1", "C1=CC=CC=C1"), ("OCC", "CCO"), ("NC(=O)C", "N=C(O)C"), ("Oc1ccccn1", "O=c1cccc[nH]1"), ("C[C@H](N)O", "C[C@@H](N)O"), (CAFFEINE, "CN1C=NC2=C1C(=O)N(C)C(=O)N2C"), ("C.CC", "CC.C")])
def test_one_structure_written_in_two_ways(a, b):
    assert molecules.structure_key(read(a)) == molecules.structure_key(read(b))


@pytest.mark.parametrize("a, b", [("CCCO", "CC(C)O"), ("CCO", "CC=O"), ("CCO", "[13CH3]CO"), ("CCN", "CC[NH3+]"), ("c1ccccc1", "C1CCCCC1"), ("C1CC1.C1CC1", "C1CCCCC1")])
def test_different_structures(a, b):
    assert molecules.structure_key(read(a)) != molecules.structure_key(read(b))


def test_symmetric_structures_are_quick():
    assert molecules.structure_key(read("C" + "C(C)(C)" * 15 + "C")) and molecules.structure_key(read("C" * 300)) and molecules.structure_key(read(".".join(["CC"] * 300)))


def all_cuts(weights, bonds):
    out = [sum(weights)]
    for n in range(3):
        for cut in itertools.combinations(range(len(bonds)), n):
            part = list(range(len(weights)))
            for k, (a, b) in enumerate(bonds):
                if k not in cut:
                    part = [part[a] if x == part[b] else x for x in part]
            out += [sum(w for w, p in zip(weights, part) if p == x) for x in set(part)]
    return sorted(out)


def same_masses(got, want):
    return all(min(abs(x - y) for y in want) < 2e-6 for x in got) and all(min(abs(x - y) for y in got) < 2e-6 for x in want)


def test_pieces_against_all_cuts():
    rng = random.Random(2)
    for m in [*map(read, TEXTS), *(made_up(rng, rng.randrange(2, 12), rng.randrange(6)) for _ in range(150))]:
        weights = [MASSES[e] + h * MASSES["H"] for e, h in zip(m.elements, m.hydrogens)]
        assert same_masses(molecules.fragment_masses(m, MASSES), all_cuts(weights, [(a, b) for a, b, _ in m.bonds]))


def test_pieces_of_hand_checked_cases():
    found = molecules.fragment_masses(read("CCO"), MASSES)
    for x in (15.02348, 31.01839, 29.03913, 17.00274, 14.01565, 46.04186):
        assert min(abs(x - y) for y in found) < 1e-4
    assert molecules.fragment_masses(read("not a smiles"), MASSES) == [] == molecules.fragment_masses(read("[Au]"), MASSES)
    assert 1 < len(molecules.fragment_masses(read("C" * 70), MASSES)) <= 2 * 69 + 1  # over 64 bonds: one cut


def test_evidence_of_hand_checked_spectra():
    formula, plus = read(CAFFEINE).formula(), [a for a, x in adducts.ADDUCTS.items() if x.positive]
    share = lambda mz, i, at=195.0877, names=plus: adducts.explained_by_formula(formula, mz, i, at, names)
    assert share([138.0662, 195.0877], [1, 1]) == 1 and share([138.0662, 150.5], [1, 3]) == pytest.approx(0.25) and share([400.0], [1]) == 0
    assert adducts.explained_by_formula(read("C").formula(), [1.0], [1.0], 16.0313 - 36.02, plus) == 0  # two waters can't leave methane
    assert adducts.explained_by_formula({"C": 400, "H": 400, "N": 400}, [12.0], [1.0], 1e4, plus) == 0 and share([], []) == 0
    ethanol = molecules.fragment_masses(read("CCO"), MASSES)
    ion = 31.01839 + MASSES["H"] - adducts.ELECTRON
    for mz, i, adduct, want in (([ion], [1.0], "[M+H]+", 1), ([ion, 500.0], [1.0, 1.0], "[M+H]+", 0.5), ([ion - 2 * MASSES["H"]], [1.0], "[M+H]+", 1), ([500.0], [1.0], "[M+H]+", 0), ([31.01839 - MASSES["H"] + adducts.ELECTRON], [1.0], "[M-H]-", 1)):
        assert adducts.explained_by_pieces(ethanol, mz, i, adduct) == want
    assert adducts.explained_by_pieces([], [100.0], [1.0], "[M+H]+") == 0


def test_columns(spark):
    rows = spark.createDataFrame([(1, CAFFEINE), (2, "CN1C=NC2=C1C(=O)N(C)C(=O)N2C"), (3, None), (4, "C("), (5, "[Au]C")], "id long, smiles string")
    got = {r.id: r for r in structures.described(rows, "smiles").collect()}
    assert got[1].key == got[2].key and got[1].mass == pytest.approx(194.080376, abs=1e-5) and got[1].formula == {"C": 8, "H": 10, "N": 4, "O": 2}
    assert got[3].key is None and got[4].fingerprint is None and got[5].mass is None and got[5].key
    both = structures.described(rows, "smiles").where("id < 3").select(F.col("fingerprint").alias("f")).collect()
    t = spark.createDataFrame([(both[0].f, both[0].f, read_bits("CCO"))], "a array<long>, b array<long>, c array<long>").select(bits.tanimoto(F.col("a"), F.col("b")).alias("same"), bits.tanimoto(F.col("a"), F.col("c")).alias("other")).first()
    assert t.same == 1 and 0 <= t.other < 0.3
    assert [len(r.pieces) for r in structures.pieces(rows, "smiles").orderBy("id").collect()][2:] == [0, 0, 0]
    spectra = rows.selectExpr("smiles", "array(138.0662D, 150.5D) as mz", "array(1D, 3D) as i", "195.0877D as at", "true as positive")
    assert [r.by_formula for r in structures.explained_by_formula(spectra, "smiles", "mz", "i", "at", "positive").collect()][:3] == [0.25, 0.25, 0.0]
    assert structures.described(rows.limit(0), "smiles").count() == 0


def read_bits(text):
    return molecules.circular_fingerprint(read(text))


def test_formula_mass_in_the_engine(spark):
    rows = spark.createDataFrame([("C2H6O",), ("NaCl",), ("C",), ("c?",), ("",), (None,), ("Xx2",)], "f string")
    got = [r.m for r in rows.select(scalars.formula_mass(F.col("f")).alias("m")).collect()]
    assert got[:3] == pytest.approx([46.04186, 57.95862, 12.0], abs=1e-4) and got[3:] == [None] * 4
