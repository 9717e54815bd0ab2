"""Scans, filters, samples and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import rangejoin, topk
from ..operators.ranking import numbered, quantiles, running_before
from ..sources import readers
from ..sources.tables import scores, signal
from .registry import plan


@plan("src01_pruned_scan", "select l_orderkey, l_partkey, l_quantity from lineitem where l_shipdate < timestamp '1995-06-01'")
def _(t):
    return t.lineitem.where("l_shipdate < timestamp_ntz'1995-06-01 00:00:00'").select("l_orderkey", "l_partkey", "l_quantity")


@plan("src02_nested_values", "select vec_id, i::bigint as pos, round(embedding[i + 1]::double, 6) as v from embeddings, (select unnest(range(0, 64)) as i)")
def _(t):
    return t.embeddings.select("vec_id", F.posexplode("embedding").alias("pos", "v"))


@plan("src03_whole_table", "select vec_id, label::bigint as label, len(embedding)::bigint as n from embeddings")
def _(t):
    return t.embeddings.select("vec_id", "label", F.size("embedding").alias("n"))


@plan("src08_sharded_columns", "select o_orderkey, o_totalprice from orders union all select p_partkey, p_retailprice from part")
def _(t):
    return t.orders.select("o_orderkey", "o_totalprice").union(t.part.select("p_partkey", "p_retailprice"))


@plan("src09_position_slice", "with s as (select series, value, row_number() over (partition by series order by sec, event_id) - 1 as pos from signal) select series, pos::bigint as pos, round(value, 6) as value from s where pos between 10 and 29", "signal")
def _(t):
    """The table laid out by position in the shared folder, and a slice of 20 positions of each series read from it."""
    import uuid

    from ..operators.lineage import shared_dir
    from ..sources import positioned

    path = f"{shared_dir(t.spark)}/positions-{uuid.uuid4().hex}"
    positioned.write(signal(t).select("series", "sec", "event_id", "value"), path, "series", ["sec", "event_id"])
    return positioned.one_slice(t.spark, path, 10, 20).select("series", "pos", "value")


@plan("src12_unlabelled", "select doc_id from documents where doc_id not in (select doc_id from labels where doc_id is not null)")
def _(t):
    return t.documents.join(t.labels, "doc_id", "left_anti").select("doc_id")


@plan("src13_numbered_labels", "select (row_number() over (order by n_name) - 1)::bigint as id, n_name as label from nation")
def _(t):
    return numbered(t.nation.select(F.col("n_name").alias("label")), ["label"], "id")


@plan("src14_json_log", "select event_id, (props->>'$.k')::bigint as k from events")
def _(t):
    return t.events.select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"))


@plan("src16_several_roots", "select c_custkey as id, c_name as name, 'customer' as root from customer union all select s_suppkey, s_name, 'supplier' from supplier")
def _(t):
    return t.customer.select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.lit("customer").alias("root")).union(t.supplier.select("s_suppkey", "s_name", F.lit("supplier")))


@plan("src17_candidate_set", "select p_name as name, min(p_partkey)::bigint as first_id, count(*)::bigint as rows from part where length(p_name) between 5 and 40 and not contains(p_name, '.') group by 1")
def _(t):
    return t.part.where("length(p_name) between 5 and 40 and not contains(p_name, '.')").groupBy(F.col("p_name").alias("name")).agg(F.min("p_partkey").alias("first_id"), F.count("*").alias("rows"))


@plan("src18_dense_counts", "select c_custkey, count(o_orderkey)::bigint as orders from customer left join orders on c_custkey = o_custkey group by 1")
def _(t):
    counts = t.orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("orders"))
    return readers.dense(t.customer.select("c_custkey"), counts, "c_custkey", ["orders"])


@plan("flt01_conjunction", "select o_orderkey from orders where o_totalprice between 1000 and 200000 and abs(coalesce(o_totalprice - 100000, 0)) <= 90000 and o_orderpriority in ('1-URGENT', '2-HIGH', '3-MEDIUM')")
def _(t):
    return t.orders.where(F.col("o_totalprice").between(1000, 200000) & (F.abs(F.coalesce(F.col("o_totalprice") - 100000, F.lit(0.0))) <= 90000) & F.col("o_orderpriority").isin("1-URGENT", "2-HIGH", "3-MEDIUM")).select("o_orderkey")


def _curated(t, most=3):
    from ..operators.peaks import curate

    lists = t.lineitem.groupBy("l_orderkey").agg(F.collect_list(F.struct(F.col("l_partkey").cast("double").alias("mz"), (F.col("l_quantity") / 50).alias("it"))).alias("peaks"))
    return lists.select("l_orderkey", curate(F.col("peaks"), F.lit(1500.0), 0.1, most).alias("peaks"))


_CURATED = """with p as (select l_orderkey, l_partkey::double as mz, l_quantity / 50 as it from lineitem where l_partkey <= 1500 and l_quantity / 50 >= 0.1),
r as (select *, row_number() over (partition by l_orderkey order by it desc, mz) as n, count(*) over (partition by l_orderkey) as c from p) """


@plan("flt02_curated_peaks", _CURATED + "select l_orderkey, (row_number() over (partition by l_orderkey order by mz, it) - 1)::bigint as pos, round(mz, 6) as mz, round(sqrt(it), 6) as it from r where n <= 3")
def _(t):
    return _curated(t).select("l_orderkey", F.posexplode("peaks").alias("pos", "p")).select("l_orderkey", "pos", "p.mz", "p.it")


@plan("flt03_enough_peaks", _CURATED + "select l_orderkey, least(max(c), 64)::bigint as n from r group by 1 having max(c) >= 3")
def _(t):
    return _curated(t, 64).select("l_orderkey", F.size("peaks").alias("n")).where("n >= 3")


@plan("flt04_text_shape", r"select page_id from pages where not contains(url, '?') and length(url) between 20 and 60 and regexp_matches(url, '[0-9]+$') and starts_with(url, 'http')")
def _(t):
    return t.pages.where(~F.col("url").contains("?") & F.length("url").between(20, 60) & F.col("url").rlike("[0-9]+$") & F.col("url").startswith("http")).select("page_id")


@plan("flt05_popular_first", "select l_partkey, round(sum(l_extendedprice), 6) as v from lineitem where l_partkey in (select l_partkey from lineitem group by 1 having count(*) >= 30) group by 1")
def _(t):
    popular = t.lineitem.groupBy("l_partkey").count().where("count >= 30").select("l_partkey")
    return t.lineitem.join(popular, "l_partkey", "left_semi").groupBy("l_partkey").agg(F.sum("l_extendedprice").alias("v"))


@plan("flt06_below_percentile", "select event_id from events where value <= (select quantile_cont(value, 0.1) from events)")
def _(t):
    cut = quantiles(t.events, [], "value", {"cut": 0.1})
    return t.events.crossJoin(F.broadcast(cut)).where("value <= cut").select("event_id")


@plan("flt07_threshold_for_count", "with r as (select o_totalprice as v, row_number() over (order by o_totalprice) - 1 as i, count(*) over () as n from orders), p as (select v, i, (n - 1) * (1 - 500.0::double / n) as pt from r) select round(max(case when i = floor(pt) then v end) + (max(case when i = ceil(pt) then v end) - max(case when i = floor(pt) then v end)) * (max(pt) - floor(max(pt))), 6) as threshold from p")
def _(t):
    n = t.orders.count()
    return quantiles(t.orders, [], "o_totalprice", {"threshold": 1 - 500.0 / max(n, 1)})


@plan("flt08_frequent_bits", "with b as (select i, avg((embedding[i + 1] > 0.2)::int) as share from embeddings, (select unnest(range(0, 64)) as i) group by i) select i::bigint as bit, round(share, 6) as share from b where share > 0.005 and share < 0.995")
def _(t):
    bits = t.embeddings.select(F.posexplode("embedding").alias("bit", "v"))
    return bits.groupBy("bit").agg(F.avg((F.col("v") > F.lit(0.2).cast("double")).cast("double")).alias("share")).where("share > 0.005 and share < 0.995")


@plan("flt09_with_positive", "select o_custkey as qid, count(*)::bigint as n, round(1.0 / count(*), 6) as weight from orders where o_custkey in (select o_custkey from orders where o_orderstatus = 'F') group by 1")
def _(t):
    return t.orders.join(t.orders.where("o_orderstatus = 'F'").select("o_custkey"), "o_custkey", "left_semi").groupBy(F.col("o_custkey").alias("qid")).agg(F.count("*").alias("n"), (1 / F.count("*")).alias("weight"))


@plan("flt10_renumbered", "select o_orderkey, (dense_rank() over (order by o_custkey) - 1)::bigint as qid from orders")
def _(t):
    # Numbers are given to the distinct keys, not to the rows.
    some = t.orders
    ids = numbered(some.select("o_custkey").distinct(), ["o_custkey"], "qid")
    return some.join(ids, "o_custkey").select("o_orderkey", "qid")


@plan("flt11_gated_term", "with g as (select o_custkey, avg(o_totalprice) as m from orders group by 1) select o_orderkey, round(case when m < 150000 then o_totalprice + 1000 else o_totalprice end, 6) as score from orders join g using (o_custkey)")
def _(t):
    gate = t.orders.groupBy("o_custkey").agg(F.avg("o_totalprice").alias("m"))
    return t.orders.join(gate, "o_custkey").select("o_orderkey", F.when(F.col("m") < 150000, F.col("o_totalprice") + 1000).otherwise(F.col("o_totalprice")).alias("score"))


@plan("flt12_fits_any_shift", "select p_partkey from part where len(list_filter([0.0::double, 1.00728::double, 22.98922::double], lambda s: abs((p_retailprice - s) % 10 - 1) < 0.5)) > 0")
def _(t):
    shifts = F.array(*[F.lit(s) for s in (0.0, 1.00728, 22.98922)])
    return t.part.where(F.exists(shifts, lambda s: F.abs((F.col("p_retailprice") - s) % 10 - 1) < 0.5)).select("p_partkey")


@plan("flt13_same_attribute", "select a.p_partkey, b.s_suppkey from part a join supplier b on a.p_size = b.s_nationkey")
def _(t):
    parts, suppliers = t.part.select("p_partkey", F.col("p_size").cast("long").alias("k")), t.supplier.select("s_suppkey", F.col("s_nationkey").cast("long").alias("k"))
    suppliers, parts = rangejoin.shared_out(suppliers, parts, "k", "p_partkey")
    return parts.join(suppliers.hint("shuffle_hash"), ["k", "__lot"]).select("p_partkey", "s_suppkey")


_CYCLES = "c as (select *, row_number() over (partition by series order by sec, event_id) - 1 as pos, sum(reset::int) over (partition by series order by sec, event_id) as cycle from signal)"


@plan("flt14_no_straddling", f"with {_CYCLES} select series, (pos // 5)::bigint as win, min(cycle)::bigint as cycle from c group by 1, 2 having min(cycle) = max(cycle) and count(*) = 5", "signal")
def _(t):
    from ..operators.signal import positions, tumbling, whole_windows

    s = positions(signal(t), "series", "sec", "event_id")
    s = running_before(s.withColumn("step", F.col("reset").cast("int")), ["series"], "pos", "step", "before").withColumn("cycle", F.col("before") + F.coalesce("step", F.lit(0)))
    return whole_windows(tumbling(s, 5), ["series", "win"], 5, "cycle").select("series", "win", F.col("lo").alias("cycle"))


@plan("flt15_mapped_scores", "with m as (select * from (values ('click', 0), ('view', 1), ('purchase', 2), ('other', 3)) v(class, k)), f as (select distinct file, start from scores) select f.file, f.start, m.k::bigint as k, round(coalesce(score, 0.5), 6) as score from f cross join m left join scores s on s.file = f.file and s.start = f.start and s.class = m.class", "scores")
def _(t):
    s = scores(t)
    names = F.array(*[F.struct(F.lit(c).alias("class"), F.lit(k).alias("k")) for k, c in enumerate(("click", "view", "purchase", "other"))])
    rows = s.select("file", "start").distinct().select("file", "start", F.inline(names))
    return rows.join(s, ["file", "start", "class"], "left").select("file", "start", "k", F.coalesce("score", F.lit(0.5)).alias("score"))


@plan("flt16_padded_prefix", "select vec_id, round(list_sum(list_transform(embedding[1:(label % 8 + 1)::int], lambda x: x::double)), 6) as s from embeddings")
def _(t):
    return t.embeddings.select("vec_id", F.aggregate(F.slice("embedding", F.lit(1), F.col("label") % 8 + 1), F.lit(0.0), lambda a, v: a + v.cast("double")).alias("s"))


@plan("smp01_every_nth", "with r as (select o_orderkey, o_custkey, row_number() over (partition by o_custkey order by o_orderkey) as n from orders) select o_orderkey from r where (n - 1) % 4 = 0")
def _(t):
    return topk.every_nth(t.orders, "o_orderkey", 4, ["o_custkey"]).select("o_orderkey")


@plan("smp02_evenly_spaced", "with r as (select series, event_id, row_number() over (partition by series order by event_id) - 1 as p, count(*) over (partition by series) as n from signal) select series, event_id from r where n <= 6 or list_contains(list_transform(range(0, 6), lambda i: round_even(i * (n - 1) / 5.0::double, 0)), p::double)", "signal")
def _(t):
    return topk.evenly_spaced(signal(t), ["series"], "event_id", 6).select("series", "event_id")


@plan("smp03_bernoulli", "select o_orderkey from orders where ('0x' || substr(md5('s1:' || o_orderkey), 1, 8))::bigint < 429496729")
def _(t):
    return t.orders.where(topk.fraction("s1", 0.1, F.col("o_orderkey"))).select("o_orderkey")


@plan("smp04_capped_strata", "select o_orderkey, o_orderpriority from (select *, row_number() over (partition by o_orderpriority order by md5('s2:' || o_orderkey), o_orderkey) as n from orders) where n <= 30")
def _(t):
    return topk.capped_sample(t.orders, ["o_orderpriority"], ["o_orderkey"], 30, "s2").select("o_orderkey", "o_orderpriority")


@plan("smp05_ids_only", "select doc_id from documents order by md5('s3:' || doc_id), doc_id limit 50")
def _(t):
    return t.documents.select("doc_id").orderBy(topk.shuffled("s3", F.col("doc_id")), "doc_id").limit(50)


@plan("set01_union_distinct", "select c_nationkey::bigint as k from customer union select s_nationkey from supplier")
def _(t):
    return t.customer.select(F.col("c_nationkey").alias("k")).union(t.supplier.select("s_nationkey")).distinct()


@plan("set02_union_all", "select 0::bigint as split, c_custkey as qid from customer union all select 1, s_suppkey from supplier")
def _(t):
    return t.customer.select(F.lit(0).alias("split"), F.col("c_custkey").alias("qid")).unionByName(t.supplier.select(F.lit(1).alias("split"), F.col("s_suppkey").alias("qid")))


@plan("set03_intersect", "select o_custkey as k from orders intersect select c_custkey from customer where c_acctbal > 5000")
def _(t):
    return t.orders.select(F.col("o_custkey").alias("k")).intersect(t.customer.where("c_acctbal > 5000").select("c_custkey"))


@plan("set04_except", "select c_custkey as k from customer except select o_custkey from orders where o_orderstatus = 'F'")
def _(t):
    return t.customer.select(F.col("c_custkey").alias("k")).exceptAll(t.orders.where("o_orderstatus = 'F'").select("o_custkey").distinct())


@plan("set05_distinct", "select distinct l_returnflag, l_linestatus from (select * from lineitem union all select * from lineitem)")
def _(t):
    return t.lineitem.union(t.lineitem).select("l_returnflag", "l_linestatus").dropDuplicates()
