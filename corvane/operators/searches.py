"""Searches of peak lists in mass windows: a chunk of a window's records is indexed by bin and mass, and queries run through it one batch after another.

Of a query and a record nothing is made unless they share a bin and are near each other; a pair is summed where it meets, in arrays, and no pair is
shuffled, joined or grouped. A chunk holds about CHUNK records, so the memory of a task doesn't grow with the tables; a window of many records has several
chunks, and each query goes to all chunks of its windows. What is shuffled is each record once and each query once for each of its chunks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .rangejoin import MOST_PARTS, ppm_sides

#: Records of a chunk, about, and queries that meet one chunk in one task, about.
CHUNK, ASKS = 32_768, 65_536
#: Pairs of a query and a record in its mass window that are looked at together; one query may have more.
CELLS = 2_000_000
#: Rows of a task.
ROWS = 200_000
_NONE = np.iinfo(np.int64).min
#: Longs of a set of windows, each window a bit by its number modulo their bits.
WORDS = 8


def _ids(column) -> np.ndarray:
    """A column of whole numbers; null is _NONE."""
    return np.asarray(column.fill_null(_NONE))


def or_null(ids: np.ndarray):
    """An Arrow column of what _ids() gave."""
    import pyarrow as pa

    return pa.array(ids, mask=ids == _NONE)


def _words(rows) -> np.ndarray:
    """The bits of places() of each row, if it has any."""
    return np.asarray(rows.column("places").flatten()).reshape(rows.num_rows, -1)


class Chunk:
    """Records by mass, their peaks by bin, lot (id modulo lots) and mass."""

    def __init__(self, rows, lots: int):
        mz = np.asarray(rows.column("mz"))
        order = np.argsort(mz, kind="stable")
        self.mz, self.rid, self.key = mz[order], _ids(rows.column("id"))[order], _ids(rows.column("key"))[order]
        peaks = rows.column("bins")
        owner = np.empty(len(order), np.int64)
        owner[order] = np.arange(len(order))
        owner = np.repeat(owner, np.asarray(peaks.value_lengths()))
        self.lots, self.n = lots, len(order)
        self.places = _words(rows)[order]
        self.bins, code = np.unique(np.asarray(peaks.flatten()), return_inverse=True)
        place = (code * lots + np.mod(self.rid, lots)[owner]) * self.n + owner
        by_place = np.argsort(place, kind="stable")
        self.place, self.weight, self.owner = place[by_place], np.asarray(rows.column("ws").flatten())[by_place], owner[by_place]

    def spans(self, bins: np.ndarray, lots: np.ndarray | int, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each (bin, lot) the peaks of the records low to high (without): which question, and the peak's place."""
        code = np.searchsorted(self.bins, bins)
        code[code == len(self.bins)] = 0
        at = np.flatnonzero(self.bins[code] == bins) if len(self.bins) else np.zeros(0, np.int64)
        base = (code[at] * self.lots + (lots[at] if isinstance(lots, np.ndarray) else lots)) * self.n
        begin = np.searchsorted(self.place, base + low[at])
        sizes = np.searchsorted(self.place, base + high[at]) - begin
        ends = np.cumsum(sizes)
        return np.repeat(at, sizes), np.arange(ends[-1] if len(ends) else 0) + np.repeat(begin - (ends - sizes), sizes)


class Pairs:
    """Queries and records near each other that share a bin: q and rec are the pairs' places among the asks and in the chunk; total() adds up over a pair's shared bins."""

    def __init__(self, asks: dict, chunk: Chunk, cell: np.ndarray, cells: int, starts: np.ndarray, low: np.ndarray, keep: Callable[[np.ndarray, np.ndarray], np.ndarray]):
        self.cell, self.cells = cell, cells
        found = np.flatnonzero(np.bincount(cell, minlength=cells))
        q = np.searchsorted(starts, found, side="right") - 1
        rec = found - starts[q] + low[q]
        ok = keep(q, rec)
        self.found, self.q, self.rec = found[ok], q[ok], rec[ok]
        self.asks, self.chunk = asks, chunk

    def total(self, values: np.ndarray) -> np.ndarray:
        return np.bincount(self.cell, values, self.cells)[self.found]


def _met(chunk: Chunk, rows, tolerance: float, apart: Callable, work: Callable, lots: int) -> Iterator[tuple]:
    asks = {"q": _ids(rows.column("id")), "mz": np.asarray(rows.column("mz")), "key": _ids(rows.column("key")), "mark": np.asarray(rows.column("mark")), "places": _words(rows)}
    lists = rows.column("bins")
    firsts = np.concatenate([[0], np.cumsum(np.asarray(lists.value_lengths()))])
    bins, weights = np.asarray(lists.flatten()), np.asarray(rows.column("ws").flatten())
    reach = asks["mz"] * tolerance
    slack = asks["mz"] * 1e-9  # the sides are rounded; pairs are checked below
    low, high = np.searchsorted(chunk.mz, asks["mz"] - reach - slack), np.searchsorted(chunk.mz, asks["mz"] + reach + slack, side="right")
    ends = np.cumsum(high - low)
    at = 0
    while at < len(ends):
        upto = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + CELLS, side="right")))
        some, own = slice(at, upto), slice(firsts[at], firsts[upto])
        starts = ends[some] - (high - low)[some] - (ends[at - 1] if at else 0)
        q = np.repeat(np.arange(upto - at), np.diff(firsts[at : upto + 1]))
        part = {k: v[some] for k, v in asks.items()}
        lo, hi, b = low[some][q], high[some][q], bins[own]
        moves = [(None, k) for k in range(lots)]
        if lots > 1:
            moves += [(s, np.mod(part["q"] + s, lots)[q]) for s in range(1 - lots, lots)]
        hits = []
        for shift, lot in moves:
            peak, place = chunk.spans(b - (shift or 0), lot, lo, hi)
            if shift is not None:  # the remainder has the sign of the difference
                gap = chunk.rid[chunk.owner[place]] - part["q"][q[peak]]
                fits = gap >= 0 if shift > 0 else gap <= 0 if shift < 0 else np.ones(len(gap), bool)
                peak, place = peak[fits], place[fits]
            hits.append((peak, place, np.full(len(peak), shift is not None)))
        peak, place, moved = (np.concatenate(x) for x in zip(*hits, strict=True))
        near = lambda i, rec, part=part, reach=reach[some]: (np.abs(chunk.mz[rec] - part["mz"][i]) <= reach[i]) & apart(part, i, chunk, rec)
        cell = starts[q[peak]] + chunk.owner[place] - low[some][q[peak]]
        pairs = Pairs(part, chunk, cell, int(ends[upto - 1] - (ends[at - 1] if at else 0)), starts, low[some], near)
        if len(pairs.found):
            yield from work(pairs, weights[own][peak], chunk.weight[place], moved)
        at = upto


def unique(rows: DataFrame, key: str) -> bool:
    return rows.groupBy(key).count().where("count > 1").isEmpty()


def search(asks: DataFrame, library: DataFrame, rows: DataFrame, ppm: float, apart: Callable, work: Callable[..., Iterator[tuple]], schema: str, lots: int = 1) -> DataFrame:
    """What work(pairs, query weights, record weights, moved) yields as tuples of columns by the schema, for each chunk and batch of queries.

    asks: q, mz, key, mark (a boolean); library: rid, mz, key; both may have places (arrays of longs, null: all bits); rows: (rid, peaks), as peaks.records() gives them, one row for each record. A pair is near if its
    masses are within ppm of the query's and apart(asks, which, chunk, which) is true. A record has one row on either side (unique()), and so has each pair in the result.
    lots: for more than 1, bins that are equal when the record's move up by (rid - q) % lots are shared too; those hits are moved.
    """
    spark = asks.sparkSession
    peaks = rows.select("rid", F.transform("peaks", lambda p: p["bin"].cast("long")).alias("bins"), F.transform("peaks", lambda p: p["w"]).alias("ws"))
    mine, theirs, _ = ppm_sides(asks, "mz", library.withColumnRenamed("mz", "__mz"), "__mz", ppm)
    counts = lambda side, n: side.groupBy("__bin").agg(F.count("*").alias(n))
    a, b = F.col("__a"), F.col("__b")
    sizes = counts(mine, "__a").join(counts(theirs, "__b"), "__bin").select("__bin", "__a", "__b", F.ceil(b / CHUNK).alias("__chunks"), F.ceil(a / ASKS).alias("__lots")).persist()
    total = sizes.agg(F.sum(a * F.col("__chunks") + b * F.col("__lots")), F.collect_list(F.when((F.col("__chunks") > 1) | (F.col("__lots") > 1), F.struct("__bin", "__chunks", "__lots")))).first()
    sizes.unpersist()
    n = min(max(int(spark.conf.get("spark.sql.shuffle.partitions")), (total[0] or 0) // ROWS), MOST_PARTS)
    large = F.broadcast(spark.createDataFrame([tuple(x) for x in total[1]], "__bin long, __chunks long, __lots long"))

    def side(rows: DataFrame, own: str, other: str, id_: str, ask: bool) -> DataFrame:
        """own and other: how many parts of this side, and of the other, there are."""
        rows = rows.join(large, "__bin", "left").fillna(1, ["__chunks", "__lots"])
        part = F.pmod(F.xxhash64(id_), F.col(own))
        copy = F.explode(F.sequence(F.lit(0).cast("long"), F.col(other) - 1))
        rows = rows.withColumn("__part", part).withColumn("__copy", copy)
        slot = F.col("__part") * F.col("__chunks") + F.col("__copy") if ask else F.col("__copy") * F.col("__chunks") + F.col("__part")
        places = F.coalesce("places", F.array(*[F.lit(-1).cast("long")] * WORDS)) if "places" in rows.columns else F.array().cast("array<long>")
        return rows.select("__bin", slot.alias("__slot"), F.lit(ask).alias("ask"), F.col(id_).cast("long").alias("id"), F.col("mz" if ask else "__mz").alias("mz"), F.col("key").cast("long").alias("key"), F.col("mark") if ask else F.lit(False).alias("mark"), "bins", "ws", places.alias("places"))

    mine, theirs, _ = ppm_sides(asks.join(peaks.withColumnRenamed("rid", "q"), "q"), "mz", library.withColumnRenamed("mz", "__mz").join(peaks, "rid"), "__mz", ppm)
    both = side(theirs, "__chunks", "__lots", "rid", False).unionByName(side(mine, "__lots", "__chunks", "q", True))
    both = both.repartition(n, "__bin", "__slot").sortWithinPartitions("__bin", "__slot", "ask", "id")
    out = spark.createDataFrame([], schema).schema

    def run(batches):
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_schema

        made = to_arrow_schema(out)
        at, held, chunk = None, [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.stack([np.asarray(batch.column(k)).astype(np.int64) for k in (0, 1)] + [np.asarray(batch.column(2).cast(pa.int8())).astype(np.int64)])
            starts = np.flatnonzero(np.concatenate(([True], (keys[:, 1:] != keys[:, :-1]).any(axis=0))))
            for i, j in zip(starts, [*starts[1:], batch.num_rows], strict=True):
                where, piece = tuple(keys[:2, i]), batch.slice(i, j - i)
                if not keys[2, i]:
                    if where != at:
                        at, held, chunk = where, [], None
                    held.append(piece)
                elif where == at:
                    if chunk is None:
                        chunk = Chunk(pa.Table.from_batches(held).combine_chunks().to_batches()[0], lots)
                        held = []
                    for found in _met(chunk, piece, ppm / 1e6, apart, work, lots):
                        for k in range(0, len(found[0]), 100_000):
                            yield pa.RecordBatch.from_arrays([(c if isinstance(c, pa.Array) else pa.array(c)).slice(k, 100_000).cast(f.type) for c, f in zip(found, made, strict=True)], schema=made)

    return both.mapInArrow(run, out)


def places(rows: DataFrame, bins: str) -> list:
    """Aggregates: an array of WORDS longs with a bit for each of the windows in the column."""
    bit = F.pmod(F.col(bins), F.lit(64 * WORDS))
    word = lambda k: F.coalesce(F.bit_or(F.when(F.floor(bit / 64) == k, F.expr(f"shiftleft(1L, int(pmod({bins}, 64)))"))), F.lit(0).cast("long"))
    return F.array(*[word(k) for k in range(WORDS)])


def with_places(asks: DataFrame, library: DataFrame, ppm: float) -> tuple[DataFrame, DataFrame]:
    """Both sides with places: the windows where the key's records lie, and those of the other asks of the ask's key (where mark says that there are any).

    Where the two have no bit in common, the key's records are near no other ask of that key. Records without a key have all bits.
    """
    mine, theirs, _ = ppm_sides(asks.where("mark").select("q", "key", "mz"), "mz", library.select("key", F.col("mz").alias("__mz")), "__mz", ppm)
    held = theirs.where("key is not null").groupBy("key").agg(places(theirs, "__bin").alias("places"))
    mine = mine.withColumn("__place", F.pmod("__bin", F.lit(64 * WORDS)))
    own = mine.groupBy("q", "key").agg(places(mine, "__place").alias("__own"))
    shared = mine.select("q", "key", "__place").distinct().groupBy("key", "__place").count()
    every = shared.groupBy("key").agg(places(shared, "__place").alias("__all"))
    twice = shared.where("count > 1").groupBy("key").agg(places(shared, "__place").alias("__twice"))
    none = F.array(*[F.lit(0).cast("long")] * WORDS)
    others = own.join(every, "key").join(twice, "key", "left").withColumn("__twice", F.coalesce("__twice", none))
    word = lambda k: F.col("__all")[k].bitwiseAND(F.bitwise_not(F.col("__own")[k])).bitwiseOR(F.col("__twice")[k])
    others = others.select("q", F.array(*[word(k) for k in range(WORDS)]).alias("places"))
    return asks.join(others, "q", "left"), library.join(held, "key", "left")


def other_key(asks: dict, i: np.ndarray, chunk: Chunk, rec: np.ndarray) -> np.ndarray:
    """Both have a key, and not the same."""
    a, b = asks["key"][i], chunk.key[rec]
    return (a != b) & (a != _NONE) & (b != _NONE)


def other_record(asks: dict, i: np.ndarray, chunk: Chunk, rec: np.ndarray) -> np.ndarray:
    return asks["q"][i] != chunk.rid[rec]


def _named(pairs: Pairs) -> tuple[np.ndarray, np.ndarray]:
    return pairs.asks["q"][pairs.q], pairs.chunk.rid[pairs.rec]


def cosine(pairs: Pairs, qw: np.ndarray, rw: np.ndarray, moved: np.ndarray) -> Iterator[tuple]:
    """q, rid, sim: the sum of products over shared bins of normalised records."""
    yield *_named(pairs), pairs.total(qw * rw)


def reverse(pairs: Pairs, qw: np.ndarray, rw: np.ndarray, moved: np.ndarray) -> Iterator[tuple]:
    """q, rid, plain (the cosine), reverse (the query's norm taken over shared bins alone) and hybrid, their mean."""
    plain, norm = pairs.total(qw * rw), np.sqrt(pairs.total(qw * qw))
    back = np.divide(plain, norm, out=np.zeros_like(plain), where=norm > 0)
    yield *_named(pairs), plain, back, (plain + back) / 2


def entropy(pairs: Pairs, qw: np.ndarray, rw: np.ndarray, moved: np.ndarray) -> Iterator[tuple]:
    """q, rid, sim: the entropy similarity over shared bins of entropy_weights(); weights of 0 share nothing."""
    on = (qw > 0) & (rw > 0)
    a, b = np.where(on, qw, 1.0), np.where(on, rw, 1.0)
    shares = (a + b) * np.log(a + b) - a * np.log(a) - b * np.log(b)
    some = pairs.total(on) > 0
    q, rid = _named(pairs)
    yield q[some], rid[some], pairs.total(np.where(on, shares, 0.0))[some] / np.log(4)


def larger(pairs: Pairs, qw: np.ndarray, rw: np.ndarray, moved: np.ndarray) -> Iterator[tuple]:
    """q, rid, direct and shifted (the cosines as they are and moved, 0 without any) and sim, the larger."""
    direct, shifted = (pairs.total(np.where(on, qw * rw, 0.0)) for on in (~moved, moved))
    yield *_named(pairs), direct, shifted, np.maximum(direct, shifted)


def best_of_keys(most: int, digits: int) -> Callable[..., Iterator[tuple]]:
    """qkey, q, key, sim, and the ask's mark: the best cosine of each key's records with each ask.

    Of an ask whose sims stand alone only the `most` best keys of a chunk, by the rounded sim and then the key, are handed on. A marked ask's sims are added to those of its key's
    other asks: keys that may meet another one (places) are all handed on, the others stand alone.
    """

    def work(pairs: Pairs, qw: np.ndarray, rw: np.ndarray, moved: np.ndarray) -> Iterator[tuple]:
        asks, chunk, q, rec = pairs.asks, pairs.chunk, pairs.q, pairs.rec
        sim, key = pairs.total(qw * rw), chunk.key[rec]
        order = np.lexsort((-sim, key, q))
        q, key, sim, rec = q[order], key[order], sim[order], rec[order]
        first = np.concatenate(([True], (q[1:] != q[:-1]) | (key[1:] != key[:-1])))
        q, key, sim, rec = q[first], key[first], sim[first], rec[first]
        keep = np.zeros(len(q), bool)
        marked = np.flatnonzero(asks["mark"][q])
        keep[marked] = (asks["places"][q[marked]] & chunk.places[rec[marked]]).any(axis=1)
        scaled = sim * 10.0**digits
        up = np.floor(scaled + 0.5)
        keep |= np.abs(scaled - np.floor(scaled) - 0.5) < 1e-4  # may be rounded either way
        rest = np.flatnonzero(~keep)
        rest = rest[np.lexsort((key[rest], -up[rest], q[rest]))]
        starts = np.flatnonzero(np.concatenate(([True], q[rest][1:] != q[rest][:-1]))) if len(rest) else rest
        keep[rest[np.arange(len(rest)) - np.repeat(starts, np.diff(np.append(starts, len(rest)))) < most]] = True
        q = q[keep]
        yield or_null(asks["key"][q]), asks["q"][q], or_null(key[keep]), sim[keep], asks["mark"][q]

    return work
