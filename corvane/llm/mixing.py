"""Mixing sources to target weights by weighted fair queueing, with DataFrame operations alone.

Each source's documents are shuffled by a hash and queued, again and again up to the repeat limit.
A queued document's virtual finish time is its source's cumulative size, itself included, over the
source's target. All queues are merged in the order of finish times and cut where the total budget
is used up.

Nothing here is ordered in one task. Rows that agree in id, source and text are counted first and
queued one after another, so that many of them are one row until then. Cumulative sums go by slots
of the hash: sums of slots first, then rows within their slot, so that a source of any share is
spread over all slots. The cut goes by buckets of finish times: sums of buckets first, then the rows
of the one bucket that holds it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD, shared_dir, table, written

#: Slots of the shuffled order for each source (3 hexadecimal digits of the hash), and buckets of finish times.
SLOT_DIGITS = 3
BUCKETS = 65536
WEIGHTS = (5, 2, 1)
#: A source gives at most so many times its size.
REPEATS = 3


def sized(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", row_col: str | None = None) -> DataFrame:
    """id, source, size (words of the text; null: 0) and the shuffled place of each document: a hash of its id and text; row_col comes along as `row`."""
    text = F.col(text_col).cast("string")
    return docs.select(
        F.col(id_col).alias("id"),
        F.col(source_col).cast("string").alias("source"),
        F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        F.md5(F.concat(F.lit("mix:"), F.coalesce(F.col(id_col).cast("string"), F.lit("null")), F.lit(":"), F.md5(F.coalesce(text, F.lit(""))))).alias("place"),
        *([F.col(row_col).alias("row")] if row_col else []),
    )


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, repeats: int = REPEATS) -> DataFrame:
    """source, source_size, total and target, a row for each source.

    Sources are taken by code point, null last, and weigh `weights` in turn. Targets are the shares by
    weight of the total size, but at most `repeats` times the source's size; what is cut off is shared
    again among the others. That is a common level times the weight: sources in the order of
    repeats * size / weight are cut off as long as that lies at or below the level that is left for the rest.
    The windows run over one row for each source.
    """
    by = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    one = Window.partitionBy(F.lit(0))
    turn = (F.row_number().over(one.orderBy(F.col("source").isNull(), "source")) - 1) % len(weights)
    weigh = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (turn + 1).cast("int"))
    by = by.withColumn("weight", weigh).withColumn("total", F.sum("source_size").over(one).cast("long"))
    by = by.withColumn("limit", repeats * F.col("source_size").cast("double")).withColumn("ratio", F.col("limit") / F.col("weight"))
    line = one.orderBy("ratio", F.col("source").isNull(), "source")
    before = line.rowsBetween(Window.unboundedPreceding, -1)
    after = line.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    level = (F.col("total") - F.coalesce(F.sum("limit").over(before), F.lit(0.0))) / F.sum("weight").over(after)
    by = by.withColumn("level", level)
    free = F.col("ratio") > F.col("level")
    by = by.withColumn("common", F.min(F.when(free, F.struct("ratio", "level"))).over(one)["level"])
    target = F.when(F.col("common").isNull(), F.col("limit")).otherwise(F.least(F.col("limit"), F.col("common") * F.col("weight")))
    return by.select("source", F.col("source_size").cast("long").alias("source_size"), "total", target.alias("target"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = WEIGHTS, repeats: int = REPEATS) -> DataFrame:
    """id, source, size, source_size, target and taken (words that the mix takes, repeats counted) of each document.

    A row out for each row in. Documents without words take nothing. Rows that agree in id, source
    and text are queued one after another, so that the cut may lie between them; which of them is
    taken can't be told. A null source is a source of its own; a null id counts as the text 'null'.
    An empty table gives an empty result. Other columns are not read.
    """
    return _mixed(docs, id_col, text_col, source_col, weights, repeats).select(F.col("id").alias(id_col), "source", "size", "source_size", "target", "taken")


def _mixed(docs: DataFrame, id_col: str, text_col: str, source_col: str, weights: tuple[int, ...], repeats: int) -> DataFrame:
    """mix() with the place and the number of each row among those that agree with it."""
    shared_dir(docs.sparkSession)  # checkpoints need one
    rows = sized(docs, id_col, text_col, source_col).groupBy("id", "source", "size", "place").agg(F.count("*").alias("copies"))
    rows = rows.withColumn("slot", F.substring("place", 1, SLOT_DIGITS)).checkpoint()
    key = [F.col("source").isNull(), F.coalesce("source", F.lit(""))]
    goal = targets(rows.select("source", (F.col("size") * F.col("copies")).alias("size")), weights, repeats)
    # Cumulative size within the source: of the slots before, then within the slot.
    slots = rows.groupBy("source", "slot").agg(F.sum(F.col("size") * F.col("copies")).alias("slot_size"))
    ahead = F.coalesce(F.sum("slot_size").over(Window.partitionBy("source").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    slots = slots.withColumn("ahead", ahead).drop("slot_size")
    slots = slots.join(goal.withColumnRenamed("source", "g_source"), F.col("source").eqNullSafe(F.col("g_source"))).drop("g_source")
    slots = slots.withColumnsRenamed({"source": "s_source", "slot": "s_slot"})
    own = F.coalesce(F.sum(F.col("size") * F.col("copies")).over(Window.partitionBy("source", "slot").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    queued = rows.withColumn("own", own).join(slots, (F.col("slot") == F.col("s_slot")) & F.col("source").eqNullSafe(F.col("s_source")))
    queued = queued.withColumn("number", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    queued = queued.withColumn("cumulative", F.col("ahead") + F.col("own") + F.col("number") * F.col("size"))
    queued = queued.select("id", "source", "size", "place", "copies", "number", "source_size", "total", "target", "cumulative").checkpoint()
    rounds = [F.when((F.col("target") > 0) & (F.col("size") > 0), (F.lit(e) * F.col("source_size") + F.col("cumulative")) / F.col("target")) for e in range(repeats)]
    bucket = lambda finish: F.least(F.floor(finish * (BUCKETS // 4)), F.lit(BUCKETS - 1))
    # A finish time stands for place in the merged order; targets sum to the budget, so the cut lies near 1.
    events = queued.select("size", "total", *key_columns(key), F.explode(F.array(*rounds)).alias("finish")).where(F.col("finish").isNotNull())
    sums = events.withColumn("bucket", bucket(F.col("finish"))).groupBy("bucket").agg(F.sum("size").alias("amount"), F.max("total").alias("total"))
    before = F.coalesce(F.sum("amount").over(Window.partitionBy(F.lit(0)).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    edge = sums.withColumn("before", before).where((F.col("before") < F.col("total")) & (F.col("before") + F.col("amount") >= F.col("total")))
    edge = edge.select(F.col("bucket").alias("cut_bucket"), "before")
    inside = events.withColumn("bucket", bucket(F.col("finish"))).join(F.broadcast(edge), F.col("bucket") == F.col("cut_bucket"))
    order = F.struct("finish", "k_null", "k_source")
    line = Window.partitionBy("bucket").orderBy("finish", "k_null", "k_source")
    fits = inside.withColumn("run", F.col("before") + F.sum("size").over(line)).where(F.col("run") <= F.col("total"))
    # One row: the bucket of the cut and the last place in it that fits the budget (null if none does).
    cut = edge.join(fits.groupBy("cut_bucket").agg(F.max(order).alias("last")), "cut_bucket", "left")
    result = queued.select("*", *key_columns(key)).crossJoin(F.broadcast(cut.agg(F.max("cut_bucket").alias("cut_bucket"), F.max("last").alias("last"))))
    place = lambda f: F.struct(f.alias("finish"), F.col("k_null"), F.col("k_source"))
    times = sum(F.when(f.isNull(), 0).when(bucket(f) < F.col("cut_bucket"), 1).when((bucket(f) == F.col("cut_bucket")) & F.coalesce(place(f) <= F.col("last"), F.lit(False)), 1).otherwise(0) for f in rounds)
    return result.select("id", "source", "size", "place", "copies", "number", "source_size", "target", (times * F.col("size")).cast("long").alias("taken"))


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = WEIGHTS, repeats: int = REPEATS) -> DataFrame:
    """The mix itself: each row, with all its columns, as often as the mix takes it.

    Rows without words (null or empty texts) go; null ids and sources stand for themselves, as in mix().
    What is taken depends on id, source and text, so the first two and the place lead back to the rows.
    Rows that agree in these are numbered by a hash of all their columns and stand for the mix's numbers. An empty table gives an empty one.
    """
    taken = _mixed(docs, id_col, text_col, source_col, weights, repeats).where("taken > 0")
    taken = taken.select(F.col("place").alias("__place"), F.col("source").alias("__source"), F.col("copies").alias("__copies"), F.col("number").alias("__number"), F.floor(F.col("taken") / F.col("size")).cast("int").alias("__times"))
    taken = written(taken, "taken")
    # The rows travel as one struct, so that no column of theirs meets one of the mix.
    slim = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), *[F.col(f"`{c}`").alias(n) for c, n in ((id_col, "id"), (text_col, "text"), (source_col, "source"))])
    keyed = sized(slim, "id", "text", "source", "row")
    same = (F.col("place") == F.col("__place")) & F.col("source").eqNullSafe(F.col("__source"))
    found = keyed.join(taken.where("__copies = 1"), same).select("row", "__times")
    many = taken.where("__copies > 1")
    if not many.isEmpty():
        again = keyed.join(many.select("__place", "__source").distinct(), same, "left_semi")
        line = Window.partitionBy("place", "source").orderBy(F.xxhash64(F.to_json("row")))  # JSON, because maps have no hash
        again = again.withColumn("number", F.row_number().over(line)).join(many, same & (F.col("number") == F.col("__number")))
        found = found.unionByName(again.select("row", "__times"))
    return found.select("row", F.explode(F.sequence(F.lit(1), F.col("__times")))).select("row.*")


def key_columns(key: list) -> list:
    return [key[0].alias("k_null"), key[1].alias("k_source")]


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


QUERIES = {"op4_mix_sources": query}
SQL = {
    "op4_mix_sources": r"""
with d as (select doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::bigint as size,
                  md5('mix:' || coalesce(doc_id::varchar, 'null') || ':' || md5(coalesce(text, ''))) as place,
                  row_number() over () as n from documents),
s as (select source, sum(size)::bigint as source_size from d group by source),
w as (select *, [5.0::double, 2.0::double, 1.0::double][((row_number() over (order by source is null, encode(source)) - 1) % 3 + 1)::int] as weight,
             sum(source_size) over ()::bigint as total, 3 * source_size::double as cap from s),
r as (select *, cap / weight as ratio from w),
l as (select *, (total - coalesce(sum(cap) over (order by ratio, source is null, encode(source) rows between unbounded preceding and 1 preceding), 0))
                / sum(weight) over (order by ratio, source is null, encode(source) rows between current row and unbounded following) as level from r),
c as (select arg_min(level, ratio) as common from l where ratio > level),
t as (select source, source_size, total, case when common is null then cap else least(cap, common * weight) end as target from l, c),
q as (select d.n, d.doc_id, d.source, d.size, t.source_size, t.total, t.target,
             sum(d.size) over (partition by d.source order by place, n rows between unbounded preceding and current row)::bigint as cumulative
      from d join t on d.source is not distinct from t.source),
e as (select q.*, ((k * source_size + cumulative) / target)::double as finish from q, (select unnest([0, 1, 2]) as k) where target > 0 and size > 0),
a as (select *, sum(size) over (order by finish, source is null, encode(source)) as run from e),
x as (select n, sum(size) as taken from a where run <= total group by n)
select q.doc_id, q.size, q.source_size, q.target, coalesce(x.taken, 0)::bigint as taken from q left join x using (n)
""",
}
