"""Versioned dimension merge by reverse-time resolution: changes become the versions of each key.

Changes are dealt by range of (key, time), so that the changes of one key, however many, lie in many
parts. Each part is scanned from its newest change to its oldest: an attribute that a change leaves
open stays pending until an older change gives a value, or a deletion or insertion settles it. Equal
neighbours coalesce, and versions come out newest first; their numbers are turned round at the end.
What one part needs of its neighbours (the state before its first change, the next version's start)
is a row for each part, not for each change.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, LongType, StructField, StructType, TimestampType

from .common import table, written

#: What an update, an insertion and a deletion are in the scan; other marks count as updates.
UPDATE, INSERT, DELETE = 0, 1, 2
_NEVER = np.iinfo(np.int64).min


def micros(df: DataFrame, column: str) -> Column:
    """Microseconds since 1970 of a time: of one without a zone as it stands (UTC), whatever the session's zone; of an instant as such."""
    c = F.col(f"`{column}`")
    if isinstance(df.schema[column].dataType, TimestampType):
        return F.unix_micros(c)
    c = c.cast("timestamp_ntz")
    seconds = F.unix_date(c.cast("date")) * F.lit(86_400).cast("long") + F.hour(c) * 3_600 + F.minute(c) * 60
    return seconds * 1_000_000 + (F.extract(F.lit("SECOND"), c) * 1_000_000).cast("long")


def _in_order(changes: DataFrame, attributes: list[str]) -> DataFrame:
    """part, key, t, kind (null where no change of that time stays), seq, the attributes, n and prev, one row for each key and time
    (n: its change ids that the key has not had before) and one for each change id that the key had at a time before, prev."""
    known = changes.where(F.col("t").isNotNull())
    by_seq = known.groupBy("key", "seq").agg(F.max(F.struct("change", "t", *change_fields(attributes))).alias("c"))
    stays = by_seq.select("key", "c.t", F.struct("seq", F.col("c.change").alias("change"), *[F.col(f"c.{x}").alias(x) for x in ("kind", *attributes)]).alias("top"))
    ids = known.where("change is not null").groupBy("key", "change", "t").agg(F.lit(1))
    before = F.lag("t").over(Window.partitionBy("key", "change").orderBy("t"))
    ids = ids.select("key", "t", before.alias("prev"))
    first = ids.where("prev is null").select("key", "t", F.lit(None).cast(stays.schema["top"].dataType).alias("top"), F.lit(1).cast("long").alias("n"))
    times = stays.withColumn("n", F.lit(0).cast("long")).unionByName(first).groupBy("key", "t").agg(F.max("top").alias("top"), F.sum("n").alias("n"))
    times = times.select("key", "t", *[F.col(f"top.{x}").alias(x) for x in ("kind", "seq", *attributes)], "n", F.lit(None).cast("long").alias("prev"))
    again = ids.where("prev is not null").select("key", "t", "prev", F.lit(0).cast("long").alias("n"))
    every = times.unionByName(again, allowMissingColumns=True)
    return every.repartitionByRange("key", "t").select(F.spark_partition_id().alias("part"), *every.columns)


def change_fields(attributes: list[str]) -> list[Column]:
    kind = F.when(F.col("op") == "D", DELETE).when(F.col("op") == "I", INSERT).otherwise(UPDATE)
    return [kind.cast("int").alias("kind"), *[F.col(a) for a in attributes]]


def _entering(ordered: DataFrame, attributes: list[str]) -> DataFrame:
    """For each part the state of its first key before the part: part, has, kind, and the attributes; null where nothing is known of the key.

    A part tells of its last key what settles each attribute last: one row a part. A key's parts are
    looked through in their order.
    """
    settles = lambda a: F.col("kind").isNotNull() & (F.col(a).isNotNull() | (F.col("kind") != UPDATE))
    last = lambda when, *c: F.max(F.when(when, F.struct("key", "t", *c)))
    told = [last(settles(a), F.when(F.col("kind") != DELETE, F.col(a)).alias("v")).alias(f"__{a}") for a in attributes]
    parts = ordered.groupBy("part").agg(F.min(F.struct("key")).alias("first"), F.max(F.struct("key")).alias("last"), last(F.col("kind").isNotNull(), "kind").alias("__kind"), *told)
    own = lambda c: F.when(F.col(f"{c}.key").eqNullSafe(F.col("last.key")), F.col(c)).alias(c)
    tells = parts.select(F.col("last.key").alias("key"), "part", F.lit(False).alias("asks"), own("__kind"), *[own(f"__{a}") for a in attributes])
    asks = parts.select(F.col("first.key").alias("key"), "part", F.lit(True).alias("asks"))
    w = Window.partitionBy("key").orderBy("part").rangeBetween(Window.unboundedPreceding, -1)
    state = [F.last(c, ignorenulls=True).over(w).alias(c) for c in ("__kind", *[f"__{a}" for a in attributes])]
    got = asks.unionByName(tells, allowMissingColumns=True).select("part", "asks", *state).where("asks")
    return got.select("part", F.col("__kind").isNotNull().alias("has"), F.col("__kind.kind").alias("kind"), *[F.col(f"__{a}.v").alias(a) for a in attributes])


def _codes(values: pa.ChunkedArray, entering: pa.Scalar) -> tuple[np.ndarray, int, pa.Array]:
    """Numbers for values, -1 for null; the number of one more value; and the values by number."""
    coded = pa.chunked_array([values.combine_chunks(), pa.array([entering.as_py()], values.type)]).combine_chunks().dictionary_encode()
    numbers = np.asarray(coded.indices.fill_null(-1)).astype(np.int64)
    return numbers[:-1], int(numbers[-1]), coded.dictionary


def _scan(attributes: list[str], rows: pa.Table, entering: pa.Table, schema: pa.Schema) -> pa.Table:
    """Versions of one part, newest first, and a row (edge) for its first and its last key."""
    order = pc.sort_indices(rows.append_column("__kept", rows["kind"].is_valid()), [("key", "ascending"), ("t", "descending"), ("__kept", "ascending")], null_placement="at_start")
    rows = rows.take(order)
    size, t = rows.num_rows, np.asarray(rows["t"])
    keys = np.asarray(rows["key"].combine_chunks().dictionary_encode(null_encoding="encode").indices)
    run = np.concatenate(([0], np.cumsum(keys[1:] != keys[:-1])))
    kept = np.flatnonzero(np.asarray(rows["kind"].is_valid()))
    kind = np.asarray(rows["kind"].take(pa.array(kept))).astype(np.int64)
    of, n_kept = run[kept], len(kept)
    has = entering["has"][0].as_py()

    states, values = [(kind == DELETE).astype(np.int64)], []
    came = [int(entering["kind"][0].as_py() == DELETE)]
    for a in attributes:
        code, given, dictionary = _codes(rows[a].take(pa.array(kept)), entering[a][0])
        at = _older((code >= 0) | (kind != UPDATE), of)  # where the pending attribute is settled
        there = at.clip(max=n_kept - 1)
        settled = np.where(kind[there] == DELETE, -1, code[there])
        states.append(np.where(at < n_kept, settled, np.where((of == 0) & has, given, -1)))
        values.append(dictionary)
        came.append(given)
    # a kept change starts a version unless its state is that of the next older one
    starts = np.ones(n_kept, bool)
    if n_kept:
        state = np.stack(states)
        starts[:-1] = (state[:, :-1] != state[:, 1:]).any(axis=0) | (of[:-1] != of[1:])
        oldest = np.flatnonzero(of == 0)
        if has and len(oldest):
            starts[oldest[-1]] = (state[:, oldest[-1]] != np.array(came)).any()
    begin = np.flatnonzero(starts)  # among the kept
    place, runs = kept[begin], of[begin]
    since = t[place]
    newest = np.concatenate(([True], runs[1:] != runs[:-1])) if len(begin) else np.zeros(0, bool)
    until = np.concatenate(([_NEVER], since[:-1])) if len(begin) else since
    number = _from_the_end(runs)

    belongs = np.searchsorted(place, np.arange(size))  # the version of each row: the next older start
    inside = (belongs < len(place)) & (run[np.minimum(place[np.minimum(belongs, max(len(place) - 1, 0))], size - 1)] == run if len(place) else False)
    counted, prev = np.asarray(rows["n"]), np.asarray(rows["prev"].fill_null(_NEVER))
    counts = np.zeros(len(begin), np.int64)
    np.add.at(counts, belongs[inside], (counted + ((prev != _NEVER) & (prev < since[belongs.clip(max=max(len(since) - 1, 0))])) if len(since) else counted)[inside])
    lead = ~inside & (run == 0) & bool(has)  # these belong to a version that starts in an older part

    out = {"key": rows["key"].take(pa.array(place)), "edge": pa.array(np.zeros(len(begin), bool)), "number": number, "since": since, "until": pa.array(until, mask=newest), "newest": newest}
    out |= {"deleted": pa.array(states[0][begin].astype(bool)), "n": counts, "seq": rows["seq"].take(pa.array(place))}
    for a, codes, dictionary in zip(attributes, states[1:], values, strict=True):
        out[a] = dictionary.take(pa.array(codes[begin], mask=codes[begin] < 0))
    versions = pa.table({f.name: _cast(out.get(f.name), f, len(begin), rows["part"][0]) for f in schema}, schema=schema)
    edges = []
    for r in sorted({0, int(run[-1])}):
        mine = since[runs == r]
        first, last = (int(mine[-1]), int(mine[0])) if len(mine) else (None, None)
        ahead = lead if r == 0 else np.zeros(size, bool)
        edges.append({"part": rows["part"][0].as_py(), "key": rows["key"][int(np.flatnonzero(run == r)[0])].as_py(), "edge": True, "number": len(mine), "since": first, "until": last, "n": int(counted[ahead].sum()), "prevs": prev[ahead & (prev != _NEVER)].tolist()})
    return pa.concat_tables([versions, pa.Table.from_pylist(edges, schema=schema)])


def _cast(column, field: pa.Field, n: int, part: pa.Scalar):
    if field.name == "part":
        return pa.repeat(part.cast(field.type), n)
    if column is None:
        return pa.nulls(n, field.type)
    return (column if isinstance(column, (pa.Array, pa.ChunkedArray)) else pa.array(column)).cast(field.type)


def _older(settled: np.ndarray, runs: np.ndarray) -> np.ndarray:
    """For each place the first at or after it (older) that is settled in its run, else the length."""
    n = len(settled)
    at = np.minimum.accumulate(np.where(settled, np.arange(n), n)[::-1])[::-1]
    found = at < n
    found[found] = runs[at[found]] == runs[np.flatnonzero(found)]
    return np.where(found, at, n)


def _from_the_end(runs: np.ndarray) -> np.ndarray:
    """1 for the last row of each run, 2 for the one before it, and so on."""
    ends = np.searchsorted(runs, runs, side="right")
    return ends - np.arange(len(runs))


def merged_versions(changes: DataFrame, attributes: list[str], key: str = "client_id", change: str = "change_id", seq: str = "seq", op: str = "op", at: str = "valid_at") -> DataFrame:
    """The versions of each key: key, version (int, from 1 by time), valid_from and valid_to (microseconds since 1970, end exclusive,
    null if open), is_deleted, the attributes, first_seq (that of the change kept at valid_from) and n_changes (distinct change ids inside,
    of changes that were dropped too).

    Of a key's changes with equal seq the one with the largest change id stays, of those at one time the
    one with the largest seq. D deletes, I sets all attributes, anything else sets those that are not
    null. Equal neighbouring states are one version. at is a time, or microseconds as a long.

    Nulls: changes without a time are left out; a null key is a key, null seqs equal one another and
    come before all others, a null change id comes before all others and is not counted, a null op is an
    update. Repeated rows count once; of rows that agree in key, seq and change id the one with the
    largest time and values stays. Texts may be of any length. An empty table gives an empty one. Other
    columns are not read.
    """
    time = F.col(f"`{at}`") if isinstance(changes.schema[at].dataType, LongType) else micros(changes, at)
    named = {"key": key, "change": change, "seq": seq, "op": op}
    inner = [f"a{k}" for k in range(len(attributes))]  # clear of all names used here
    slim = changes.select(*[F.col(f"`{c}`").alias(n) for n, c in named.items()], time.alias("t"), *[F.col(f"`{a}`").alias(x) for a, x in zip(attributes, inner, strict=True)])
    ordered = written(_in_order(slim, inner), "changes-in-order")
    kinds = {f.name: f.dataType for f in ordered.schema}
    long = {n: LongType() for n in ("number", "since", "until", "n")}
    types = {"part": kinds["part"], "key": kinds["key"], "edge": BooleanType(), **long, "newest": BooleanType(), "deleted": BooleanType(), "seq": kinds["seq"], **{x: kinds[x] for x in inner}, "prevs": ArrayType(LongType())}
    schema = StructType([StructField(n, kind) for n, kind in types.items()])
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(schema)

    def scan(_, rows: pa.Table, entering: pa.Table) -> pa.Table:
        return _scan(inner, rows, entering, arrow)

    found = written(ordered.groupBy("part").cogroup(_entering(ordered, inner).groupBy("part")).applyInArrow(scan, schema), "versions-by-part")
    edges = _between(found.where("edge"))
    versions = found.where("not edge").alias("v").join(edges.alias("e"), (F.col("v.part") == F.col("e.part")) & F.col("v.key").eqNullSafe(F.col("e.key")), "left")
    newest = F.col("v.newest")
    return versions.select(
        F.col("v.key").alias(key),
        (F.col("v.number") + F.coalesce("e.versions_before", F.lit(0))).cast("int").alias("version"),
        F.col("v.since").alias("valid_from"),
        F.coalesce("v.until", F.when(newest, F.col("e.next_start"))).alias("valid_to"),
        F.col("v.deleted").alias("is_deleted"),
        *[F.col(f"v.{x}").alias(a) for a, x in zip(attributes, inner, strict=True)],
        F.col("v.seq").alias("first_seq"),
        (F.col("v.n") + F.coalesce(F.when(newest, F.col("e.more")), F.lit(0))).alias("n_changes"),
    )


def _between(edges: DataFrame) -> DataFrame:
    """part, key, versions_before, next_start and more (changes of the key's last version here that lie in newer parts), a row for each edge of a part."""
    w = Window.partitionBy("key").orderBy("part")
    before, after = w.rowsBetween(Window.unboundedPreceding, -1), w.rowsBetween(1, Window.unboundedFollowing)
    placed = edges.select("part", "key", F.col("until").alias("last_start"), F.sum("number").over(before).alias("versions_before"), F.max("until").over(before).alias("begun"), F.min("since").over(after).alias("next_start"), "n", "prevs")
    own = F.col("n") + F.size(F.filter("prevs", lambda p: p < F.col("begun")))
    more = placed.where("begun is not null").groupBy(F.col("key").alias("__key"), "begun").agg(F.sum(own).alias("more"))
    joined = placed.drop("begun").join(more, F.col("key").eqNullSafe(F.col("__key")) & (F.col("last_start") == F.col("begun")), "left")
    return joined.select("part", "key", "versions_before", "next_start", "more")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    changes = table(spark, sf_dir, "client_changes")
    early = F.crc32(F.col("change_id").cast("string").cast("binary")) % 3 == 0
    at = micros(changes, "valid_at") - F.when(early, 240 * 3_600_000_000).otherwise(0)
    cents = F.floor(100 * F.col("balance") + 0.5).cast("long")
    changes = changes.select("client_id", "change_id", "seq", "op", at.alias("at"), "source", "segment", "city", cents.alias("balance_cents"))
    versions = merged_versions(changes, ["source", "segment", "city", "balance_cents"], at="at")
    seconds = lambda c: F.expr(f"({c} - pmod({c}, 1000000L)) div 1000000L").alias(c)
    return versions.select(*[seconds(c) if c in ("valid_from", "valid_to") else F.col(c) for c in versions.columns])


_SQL = """
with poly as (select list_transform(range(0, 256), lambda b: list_reduce(range(0, 8), lambda c, k: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end, b::bigint)) as t),
once as (select distinct change_id, client_id, seq, op, valid_at, source, segment, city, balance from client_changes where valid_at is not null),
sums as (select *, xor(list_reduce(list_transform(string_split(change_id::varchar, ''), lambda x: ascii(x)::bigint), lambda s, b: xor(s >> 8, t[(xor(s, b) & 255) + 1]), 4294967295), 4294967295) as h from once, poly),
moved as (select change_id, client_id, seq, op, source, segment, city, floor(100 * balance + 0.5)::bigint as cents, epoch_us(valid_at) - case when h % 3 = 0 then 864000000000 else 0 end as t from sums),
by_seq as (select * from moved qualify row_number() over (partition by client_id, seq order by change_id desc) = 1),
kept as (select * from by_seq qualify row_number() over (partition by client_id, t order by seq desc) = 1),
eras as (select *, sum(case when op in ('D', 'I') then 1 else 0 end) over (partition by client_id order by t) as era from kept),
states as (select client_id, t, seq, op = 'D' as is_deleted,
  last_value(case when op <> 'D' then source end ignore nulls) over w as source, last_value(case when op <> 'D' then segment end ignore nulls) over w as segment,
  last_value(case when op <> 'D' then city end ignore nulls) over w as city, last_value(case when op <> 'D' then cents end ignore nulls) over w as balance_cents
  from eras window w as (partition by client_id, era order by t rows between unbounded preceding and current row)),
settled as (select client_id, t, seq, is_deleted, case when not is_deleted then source end as source, case when not is_deleted then segment end as segment, case when not is_deleted then city end as city, case when not is_deleted then balance_cents end as balance_cents from states),
marked as (select *, lag(t) over w is null or is_deleted <> lag(is_deleted) over w or source is distinct from lag(source) over w or segment is distinct from lag(segment) over w or city is distinct from lag(city) over w or balance_cents is distinct from lag(balance_cents) over w as starts from settled window w as (partition by client_id order by t)),
versions as (select *, row_number() over w as version, lead(t) over w as u from marked where starts window w as (partition by client_id order by t)),
counts as (select v.client_id, v.version, count(distinct m.change_id) as n from versions v join moved m on m.client_id is not distinct from v.client_id and m.t >= v.t and (v.u is null or m.t < v.u) group by all)
select v.client_id, v.version::int as version, (v.t // 1000000)::bigint as valid_from, (v.u // 1000000)::bigint as valid_to, is_deleted, source, segment, city, balance_cents, seq as first_seq, n::bigint as n_changes
from versions v join counts c on c.client_id is not distinct from v.client_id and c.version = v.version
"""

QUERIES = {"op11_versioned_merge": query}
SQL: dict[str, str] = {"op11_versioned_merge": _SQL}
