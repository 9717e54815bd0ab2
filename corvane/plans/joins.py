"""Joins: windows on a value, intervals, nearest values, lookups, bans, pairings."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import rangejoin, topk
from ..operators.lineage import cut
from ..operators.ranking import numbered
from ..sources.tables import peaks, signal, spectra
from .registry import plan

#: Rows of a window that are looked at first for its 8 negatives.
NEGATIVES_DRAWN = 64


def asked(t):
    """The queries of a search: records whose id is divisible by 50. All records are the library that they search."""
    return spectra(t).where("rid % 50 = 0").select("rid", "mz", "key")


@plan("jon01_ppm_window", "select a.rid as q, s.rid from spectra a join spectra s on abs(s.mz - a.mz) <= a.mz * (500 / 1e6::double)", "spectra")
def _(t):
    q = spectra(t).select(F.col("rid").alias("q"), F.col("mz").alias("q_mz"))
    return rangejoin.ppm_join(q, "q_mz", spectra(t).select("rid", "mz"), "mz", 500, rangejoin.FINE).select("q", "rid")


@plan("jon02_shift_window", "select distinct a.rid as q, p_partkey from spectra a, (select unnest([1.00728::double, 22.98922::double, -1.00728::double]) as s), part where abs(p_retailprice - ((a.mz / 100) - s)) <= 0.5", "spectra")
def _(t):
    q = spectra(t).select(F.col("rid").alias("q"), (F.col("mz") / 100).alias("v"))
    return rangejoin.shifted_join(q, "v", "q", t.part, "p_retailprice", "p_partkey", (1.00728, 22.98922, -1.00728), 0.5)


@plan("jon03_wide_window", "select a.rid as q, count(*)::bigint as n, round(max(s.mz - a.mz), 6) as widest from spectra a join spectra s on abs(s.mz - a.mz) <= 2000 group by 1", "spectra")
def _(t):
    q = spectra(t).select(F.col("rid").alias("q"), F.col("mz").alias("q_mz"))
    return rangejoin.window_counts(q, "q_mz", spectra(t).select("mz"), "mz", 2000).where("n > 0").select("q", "n", (F.col("most") - F.col("q_mz")).alias("widest"))


@plan("jon04_point_in_interval", "with i as (select (1000 * k)::double as lo, (1000 * k + 700)::double as hi, k from (select unnest(range(0, 500)) as k)) select o_orderkey, k::bigint as k from orders join i on o_totalprice >= lo and o_totalprice < hi")
def _(t):
    i = t.spark.range(500).select((F.col("id") * 1000.0).alias("lo"), (F.col("id") * 1000.0 + 700).alias("hi"), F.col("id").alias("k"))
    return rangejoin.interval_join(t.orders.select("o_orderkey", "o_totalprice"), "o_totalprice", i, "lo", "hi").select("o_orderkey", "k")


@plan("jon05_key_lookup", "select l_orderkey, l_linenumber::bigint as l_linenumber, p_brand from lineitem join part on l_partkey = p_partkey where p_size < 5")
def _(t):
    return t.lineitem.join(t.part.where("p_size < 5"), F.col("l_partkey") == F.col("p_partkey")).select("l_orderkey", "l_linenumber", "p_brand")


@plan("jon06_lookup_default", "select c_custkey, round(coalesce(v, -1), 6) as v from customer left join (select o_custkey, max(o_totalprice) as v from orders where o_orderstatus = 'P' group by 1) on c_custkey = o_custkey")
def _(t):
    v = t.orders.where("o_orderstatus = 'P'").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max("o_totalprice").alias("v"))
    return t.customer.join(v, "c_custkey", "left").select("c_custkey", F.coalesce("v", F.lit(-1.0)).alias("v"))


@plan("jon07_misses_dropped", "select o_orderkey, round(p_retailprice, 6) as mass from orders join part on o_custkey = p_partkey where p_retailprice > 0")
def _(t):
    return t.orders.join(t.part, F.col("o_custkey") == F.col("p_partkey")).where("p_retailprice > 0").select("o_orderkey", F.col("p_retailprice").alias("mass"))


@plan("jon08_banned", "select o_orderkey from orders where o_custkey not in (select c_custkey from customer where c_nationkey < 5) and o_orderkey not in (select l_orderkey from lineitem where l_linenumber = 7)")
def _(t):
    free = t.orders.join(t.customer.where("c_nationkey < 5").select(F.col("c_custkey").alias("o_custkey")), "o_custkey", "left_anti")
    return free.join(t.lineitem.where("l_linenumber = 7").select(F.col("l_orderkey").alias("o_orderkey")), "o_orderkey", "left_anti").select("o_orderkey")


@plan("jon09_coverage", "select round(avg((c_custkey in (select o_custkey from orders))::int), 6) as covered, count(*)::bigint as n from customer")
def _(t):
    have = t.orders.select(F.col("o_custkey").alias("c_custkey")).distinct().withColumn("hit", F.lit(1))
    return t.customer.join(have, "c_custkey", "left").agg(F.avg(F.coalesce("hit", F.lit(0))).alias("covered"), F.count("*").alias("n"))


@plan("jon10_first_source_wins", "with u as (select p_partkey as k, p_brand as v, 0 as src from part where p_partkey % 5 <> 0 union all select p_partkey, p_type, 1 from part where p_partkey % 3 = 0) select k, arg_min(v, src) as v from u group by k")
def _(t):
    u = t.part.where("p_partkey % 5 <> 0").select(F.col("p_partkey").alias("k"), F.col("p_brand").alias("v"), F.lit(0).alias("src")).union(t.part.where("p_partkey % 3 = 0").select("p_partkey", "p_type", F.lit(1)))
    return u.groupBy("k").agg(F.min_by("v", "src").alias("v"))


@plan("jon11_name_map", "select c_custkey, coalesce(n_nationkey, -1)::bigint as k from (select c_custkey, ' ' || upper(n_name) || '  ' as raw from customer left join nation on c_nationkey = n_nationkey and n_nationkey <> 3) left join nation on lower(trim(raw)) = lower(trim(n_name))")
def _(t):
    raw = t.customer.join(t.nation.where("n_nationkey <> 3"), F.col("c_nationkey") == F.col("n_nationkey"), "left").select("c_custkey", F.concat(F.lit(" "), F.upper("n_name"), F.lit("  ")).alias("raw"))
    names = t.nation.groupBy(F.lower(F.trim("n_name")).alias("name")).agg(F.max_by("n_nationkey", "n_nationkey").alias("k"))
    return raw.join(names, F.lower(F.trim("raw")) == F.col("name"), "left").select("c_custkey", F.coalesce("k", F.lit(-1)).alias("k"))


@plan("jon12_one_to_one", "with k as (select doc_id, count(*)::bigint as n from labels group by 1) select d.doc_id, coalesce(n, 0)::bigint as matches from documents d left join k using (doc_id)")
def _(t):
    """Documents in their own order of ids, with how often the labels name them: 1 is an alignment, 0 and more are planted faults."""
    named = t.labels.groupBy("doc_id").agg(F.count("*").alias("n"))
    return t.documents.select("doc_id").join(named, "doc_id", "left").select("doc_id", F.coalesce("n", F.lit(0)).alias("matches"))


@plan("jon13_bin_match", "select a.rid as q, r.rid, round(sum(x.w * y.w), 6) as s from asked a join spectra r on abs(r.mz - a.mz) <= a.mz * (1000 / 1e6::double) join peaks x on x.rid = a.rid join peaks y on y.rid = r.rid and x.bin = y.bin group by 1, 2", "spectra asked peaks")
def _(t):
    from ..operators import peaks as pk

    q = asked(t).select(F.col("rid").alias("q"), F.col("mz").alias("q_mz"))
    sides = rangejoin.ppm_sides(q, "q_mz", spectra(t).select("rid", "mz"), "mz", 1000)
    return pk.shared_cosine(pk.shared(*sides, pk.merged(peaks(t), ["rid"], "bin", "w"), "rid", "q", "rid"), ["q", "rid"]).withColumnRenamed("sim", "s")


@plan("jon14_nearest", "select s_suppkey, round(arg_min(p_retailprice, [abs(p_retailprice - v), p_retailprice]), 6) as near from (select s_suppkey, 900 + abs(s_acctbal) / 10 as v from supplier) s join part on abs(p_retailprice - v) <= 5 group by 1")
def _(t):
    s = t.supplier.select("s_suppkey", (900 + F.abs("s_acctbal") / 10).alias("v"))
    return rangejoin.nearest_join(s, "v", t.part.select(F.col("p_retailprice").alias("near")), "near", 5.0).where("near is not null").select("s_suppkey", "near")


@plan("jon15_pairs_in_group", "select a.s_suppkey as a, b.s_suppkey as b from supplier a join supplier b on a.s_nationkey = b.s_nationkey and a.s_suppkey < b.s_suppkey")
def _(t):
    a = t.supplier.select(F.col("s_suppkey").alias("a"), "s_nationkey")
    return a.join(t.supplier.select(F.col("s_suppkey").alias("b"), "s_nationkey"), "s_nationkey").where("a < b").select("a", "b")


@plan("jon16_closest_of_few", "select p_partkey, arg_min(name, d) as name from (select p_partkey, name, abs(p_retailprice % 100 - s) as d from part, (values ('H', 1.00728::double), ('Na', 22.98922::double), ('K', 38.96316::double), ('NH4', 18.03383::double)) v(name, s)) group by 1")
def _(t):
    few = F.array(*[F.struct(F.lit(s).alias("s"), F.lit(n).alias("name")) for n, s in (("H", 1.00728), ("Na", 22.98922), ("K", 38.96316), ("NH4", 18.03383))])
    gaps = F.transform(few, lambda x: F.struct(F.abs(F.col("p_retailprice") % 100 - x["s"]).alias("d"), x["name"].alias("name")))
    return t.part.select("p_partkey", F.array_min(gaps)["name"].alias("name"))


@plan("jon17_hashed_pairing", "with b as (select s_suppkey, row_number() over (order by s_suppkey) - 1 as n, count(*) over () as c from supplier) select p_partkey, s_suppkey from part join b on ('0x' || substr(md5('p:' || p_partkey), 1, 8))::bigint % c = n")
def _(t):
    b = numbered(t.supplier.select("s_suppkey"), ["s_suppkey"], "n")
    c = t.supplier.count()
    place = F.conv(F.substring(topk.shuffled("p", F.col("p_partkey")), 1, 8), 16, 10).cast("long") % max(c, 1)
    return t.part.withColumn("n", place).join(b, "n").select("p_partkey", "s_suppkey")


@plan("jon18_fold_lookup", "select o_orderkey, (('0x' || substr(md5('fold:' || o_custkey), 1, 8))::bigint % 5)::bigint as fold from orders")
def _(t):
    from ..operators.splits import group_fold

    folds = t.orders.select("o_custkey").distinct().withColumn("fold", group_fold(F.col("o_custkey"), 5))
    return t.orders.join(folds, "o_custkey").select("o_orderkey", "fold")


@plan("jon19_neighbours", "select event_id, round(lag(value) over w, 6) as before, round(lead(value) over w, 6) as after from signal window w as (partition by series order by sec, event_id)", "signal")
def _(t):
    from ..operators.ranking import with_neighbours

    return with_neighbours(signal(t), ["series"], ["sec", "event_id"], {"before": ("value", -1), "after": ("value", 1)}).select("event_id", "before", "after")


@plan("jon20_canonical_key", "select o_orderkey, (md5(lower(trim(o_orderpriority))) = md5(lower('1-urgent')))::int::bigint as hit from orders")
def _(t):
    key = lambda c: F.md5(F.lower(F.trim(c)))
    return t.orders.select("o_orderkey", (key(F.col("o_orderpriority")) == key(F.lit("1-urgent"))).cast("int").alias("hit"))


@plan("jon21_window_negatives", "with p as (select a.rid as q, a.key as qkey, s.key, min(s.rid) as rid from asked a join spectra s on abs(s.mz - a.mz) <= 500 where s.key % 11 <> 0 or s.key = a.key group by 1, 2, 3), r as (select q, key, (key = qkey)::int::bigint as y, row_number() over (partition by q order by (key = qkey) desc, md5('n:' || q || ':' || key), key) as n from p) select q, key, y, n::bigint as n from r where n <= 8", "spectra asked")
def _(t):
    """Of each query's window the rows under a bound of the hash are drawn, about NEGATIVES_DRAWN by the window's count; queries that got fewer than 8 keys draw the whole window."""
    a = asked(t).select(F.col("rid").alias("q"), F.col("mz").alias("q_mz"), F.col("key").alias("qkey")).where(F.abs(F.col("mz") - F.col("mz")) <= 500)
    banned = t.customer.where("c_custkey % 11 = 0").select(F.col("c_custkey").alias("key"))
    free = spectra(t).select("mz", "key").join(banned, "key", "left_anti")
    lot = topk.shuffled("n", F.col("q"), F.col("key"))
    bound = F.lower(F.lpad(F.hex(F.floor(F.lit(NEGATIVES_DRAWN * float(1 << 32)) / F.col("n"))), 8, "0"))
    bounded = cut(rangejoin.window_counts(a, "q_mz", free, "mz", 500).select("q", "q_mz", "qkey", F.when(F.col("n") > NEGATIVES_DRAWN, bound).alias("under")))
    near = lambda asks: rangejoin.absolute_join(asks.hint("shuffle_hash"), "q_mz", rangejoin.spread(free), "mz", 500).where((F.col("key") != F.col("qkey")) & (F.col("under").isNull() | (lot < F.col("under")))).select("q", "qkey", "key")
    first = cut(near(bounded).distinct())
    full = first.groupBy("q").count().where("count >= 8").select("q")
    rest = near(bounded.where("under is not null").join(full, "q", "left_anti").withColumn("under", F.lit(None).cast("string")))
    own = a.where("qkey is not null").select("q", "qkey", F.col("qkey").alias("key"))  # the query itself is in its window
    found = first.unionByName(rest).distinct().unionByName(own)
    y = (F.col("key") == F.col("qkey")).cast("int")
    return topk.top_k(found.withColumn("y", y), ["q"], [F.col("y").desc(), lot, F.col("key")], 8, "n").select("q", "key", "y", "n")


@plan("jon22_fact_to_structure", "select l_orderkey, l_linenumber::bigint as l_linenumber, p_type from lineitem join part on l_partkey = p_partkey where l_orderkey not in (select o_orderkey from orders where o_orderstatus = 'P')")
def _(t):
    dropped = t.orders.where("o_orderstatus = 'P'").select(F.col("o_orderkey").alias("l_orderkey"))
    return t.lineitem.join(dropped, "l_orderkey", "left_anti").join(t.part, F.col("l_partkey") == F.col("p_partkey")).select("l_orderkey", "l_linenumber", "p_type")
