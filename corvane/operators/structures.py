"""Molecules in columns: SMILES text to keys, fingerprints, formulas and masses, and spectra against candidate structures.

A task takes batches of rows and reads each distinct text of a batch once. Rows stay where they are.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions import adducts, molecules
from ..functions.kernels import MASSES


def _with(df: DataFrame, inputs: list[str], schema: str, make: Callable[[], Callable[..., tuple]]) -> DataFrame:
    """df with the columns of schema, as the function that make() returns gives them for a row's inputs; equal rows of a batch are worked out once."""
    new = df.sparkSession.createDataFrame([], schema).schema
    out = StructType([*df.schema.fields, *new.fields])
    places = [df.columns.index(c) for c in inputs]

    def run(batches):
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_type

        kinds, work = [to_arrow_type(f.dataType) for f in new.fields], make()
        for batch in batches:
            known: dict = {}
            rows = []
            for given in zip(*(batch.column(k).to_pylist() for k in places), strict=True):
                key = given[0] if len(given) == 1 else repr(given)
                if key not in known:
                    known[key] = work(*given)
                rows.append(known[key])
            columns = [pa.array([r[k] for r in rows], kinds[k]) for k in range(len(kinds))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], out.names)

    return df.mapInArrow(run, out)


def described(df: DataFrame, smiles: str) -> DataFrame:
    """df with key (14 letters), fingerprint (32 longs), formula (element: count) and mass; null where the text can't be read, mass too where an element's is unknown."""

    def make():
        def work(text):
            m = molecules.read(text)
            if m is None:
                return None, None, None, None
            formula = m.formula()
            mass = sum(MASSES[e] * n for e, n in formula.items()) if all(e in MASSES for e in formula) else None
            return molecules.structure_key(m), molecules.circular_fingerprint(m), list(formula.items()), mass

        return work

    return _with(df, [smiles], "key string, fingerprint array<long>, formula map<string, int>, mass double", make)


def masses(df: DataFrame, smiles: str) -> DataFrame:
    """df with formula and mass alone."""

    def make():
        def work(text):
            m = molecules.read(text)
            formula = m.formula() if m else None
            return list(formula.items()) if m else None, sum(MASSES[e] * n for e, n in formula.items()) if m and all(e in MASSES for e in formula) else None

        return work

    return _with(df, [smiles], "formula map<string, int>, mass double", make)


def pieces(df: DataFrame, smiles: str) -> DataFrame:
    """df with pieces: the sorted masses of what one or two cuts leave; empty where the text can't be read."""
    return _with(df, [smiles], "pieces array<double>", lambda: lambda text: (molecules.fragment_masses(molecules.read(text), MASSES),))


#: Rows whose spectra are worked out together.
TOGETHER = 100_000


def _with_shares(df: DataFrame, texts: list[str], mzs: str, intensities: str, numbers: list[str], name: str, make: Callable[[], Callable]) -> DataFrame:
    """df with a share of each row's spectrum. Rows of like texts go to work(*texts, mzs, intensities, row, *numbers) together, their peaks end to end;
    null inputs give null (but a null of the first text is given to work()), as do lists of unequal length. A null m/z explains nothing.
    """
    out = StructType([*df.schema.fields, *df.sparkSession.createDataFrame([], f"{name} double").schema.fields])
    at = {c: df.columns.index(c) for c in (*texts, mzs, intensities, *numbers)}

    def run(batches):
        import numpy as np
        import pandas as pd
        import pyarrow as pa
        import pyarrow.compute as pc

        work = make()

        def shares(table):
            column = {c: table.column(k).combine_chunks() for c, k in at.items()}
            sizes = [pc.fill_null(pc.list_value_length(column[c]), -1).to_numpy(zero_copy_only=False) for c in (mzs, intensities)]
            good = (sizes[0] == sizes[1]) & np.logical_and.reduce([column[c].is_valid().to_numpy(zero_copy_only=False) for c in at if c != texts[0]])
            rows = np.flatnonzero(good)
            order = pd.DataFrame({c: column[c].take(pa.array(rows)).to_pandas() for c in texts}).groupby(texts, sort=False, dropna=False).ngroup().to_numpy() if len(rows) else rows
            rows = rows[np.argsort(order, kind="stable")]
            group = np.sort(order)
            taken = {c: column[c].take(pa.array(rows)) for c in at}
            mz, weight = (taken[c].flatten().to_numpy(zero_copy_only=False).astype(float) for c in (mzs, intensities))
            ends = np.append(0, np.cumsum(sizes[0][rows]))
            found = np.full(table.num_rows, np.nan)
            starts = np.append(np.flatnonzero(np.append(True, group[1:] != group[:-1])), len(rows)) if len(rows) else np.zeros(1, int)
            for a, b in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
                peaks = slice(ends[a], ends[b])
                row = np.repeat(np.arange(b - a), np.diff(ends[a : b + 1]))
                found[rows[a:b]] = work(*[taken[c][a].as_py() for c in texts], mz[peaks], weight[peaks], row, b - a, *[taken[c].slice(a, b - a).to_numpy(zero_copy_only=False).astype(float) for c in numbers])
            mask = np.ones(table.num_rows, bool)
            mask[rows] = False
            return pa.array(found, pa.float64(), mask=mask)

        def emit(waiting):
            table = pa.Table.from_batches(waiting)
            yield from pa.Table.from_arrays([*table.columns, shares(table)], out.names).to_batches(max_chunksize=10_000)

        waiting = []
        for batch in batches:
            if batch.num_rows:
                waiting.append(batch)
            if sum(b.num_rows for b in waiting) >= TOGETHER:
                yield from emit(waiting)
                waiting = []
        if waiting:
            yield from emit(waiting)

    return df.mapInArrow(run, out)


def explained_by_formula(df: DataFrame, smiles: str, mzs: str, intensities: str, precursor: str, positive: str, tolerance: float = adducts.FORMULA_DA) -> DataFrame:
    """df with by_formula: the share of each row's spectrum that its candidate's formula accounts for, under the likeliest adduct of the ion's sign."""

    def make():
        names = {sign: [a for a, x in adducts.ADDUCTS.items() if x.positive == sign] for sign in (True, False)}
        read: dict = {}

        def work(text, sign, mz, intensity, row, n, at):
            if text not in read:
                if len(read) > 100_000:
                    read.clear()
                m = molecules.read(text)
                read[text] = m.formula() if m else None
            return adducts.all_explained_by_formula(read[text], mz, intensity, row, at, names[sign], tolerance)

        return work

    return _with_shares(df, [smiles, positive], mzs, intensities, [precursor], "by_formula", make)


def explained_by_pieces(df: DataFrame, smiles: str, mzs: str, intensities: str, adduct: str, tolerance: float = adducts.PIECE_DA) -> DataFrame:
    """df with by_pieces: the share of each row's spectrum that pieces of its candidate account for."""

    def make():
        read: dict = {}

        def work(text, name, mz, intensity, row, n):
            if (text, name) not in read:
                if len(read) > 10_000:
                    read.clear()
                read[text, name] = adducts.ions_of(molecules.fragment_masses(molecules.read(text), MASSES), name)
            return adducts.all_explained_by_pieces(read[text, name], mz, intensity, row, n, tolerance)

        return work

    return _with_shares(df, [smiles, adduct], mzs, intensities, [], "by_pieces", make)


def one_of_each(df: DataFrame, key: str, order: str, name: str) -> DataFrame:
    """df with the smallest order of the rows that have the same structure key; null keys have none."""
    first = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.min(order).alias(name))
    return df.join(first, key, "left")
