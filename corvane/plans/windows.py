"""Window functions, sorts and top-k."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import ranking, signal as sig, topk
from ..sources.tables import scores, signal
from .aggregates import candidates
from .registry import plan

_POS = "p as (select *, row_number() over (partition by series order by sec, event_id) - 1 as pos from signal)"


def placed(t):
    return sig.positions(signal(t), "series", "sec", "event_id")


@plan("win01_average_rank", "select file, start, class, round((rank() over (partition by class order by score) + (count(*) over (partition by class, score) - 1) / 2.0::double - 1) / greatest(1, count(*) over (partition by class) - 1), 6) as r from scores", "scores")
def _(t):
    return ranking.average_rank(scores(t), ["class"], "score", "r").select("file", "start", "class", "r")


@plan("win02_ordinal_rank", "select qid, cid, round((row_number() over (partition by qid order by score desc, cid) - 1) / greatest(1, count(*) over (partition by qid) - 1)::double, 6) as r from cand", "cand")
def _(t):
    return candidates(t).select("qid", "cid", ranking.ordinal_rank(["qid"], [F.col("score").desc(), F.col("cid")]).alias("r"))


@plan("win03_gap", "select qid, cid, round(score - max(score) over (partition by qid), 6) as gap from cand", "cand")
def _(t):
    return candidates(t).select("qid", "cid", ranking.gap_to_best(["qid"], "score").alias("gap"))


@plan("win04_z_score", "select qid, cid, round(case when count(*) over w < 2 or stddev_pop(score) over w < 1e-9 then 0 else (score - avg(score) over w) / stddev_pop(score) over w end, 5) as z from cand window w as (partition by qid)", "cand")
def _(t):
    return candidates(t).select("qid", "cid", F.round(ranking.z_score(["qid"], "score"), 5).alias("z"))


@plan("win05_rolling", "select file, start, class, round(max(score) over w, 6) as top, round(avg(score) over w + 1e-7, 4) as mid from scores window w as (partition by file, class order by start rows between 6 preceding and 6 following)", "scores")
def _(t):
    rows = ranking.rolled(scores(t), ["file", "class"], ["start"], "score", 6, {"top": "max", "mid": "mean"})
    return rows.select("file", "start", "class", "top", F.round(F.col("mid") + 1e-7, 4).alias("mid"))


_RANK = "(rank() over (partition by class order by {c}) + (count(*) over (partition by class, {c}) - 1) / 2.0::double - 1) / greatest(1, count(*) over (partition by class) - 1)"


@plan("win06_context_blend", f"with a as (select *, {_RANK.format(c='score')} as r from scores), b as (select *, max(r) over (partition by file, class order by start rows between 6 preceding and 6 following) as ctx from a) select file, start, class, round(0.2::double * r + 0.8::double * {_RANK.format(c='ctx')}, 6) as blend from b", "scores")
def _(t):
    own = ranking.average_rank(scores(t), ["class"], "score", "r")
    context = ranking.rolled(own, ["file", "class"], ["start"], "r", 6, {"ctx": "max"})
    return ranking.average_rank(context, ["class"], "ctx", "rc").select("file", "start", "class", (0.2 * F.col("r") + 0.8 * F.col("rc")).alias("blend"))


@plan("win07_row_number", "select qid, cid, row_number() over (partition by qid order by score desc, cid)::bigint as n from cand", "cand")
def _(t):
    return candidates(t).select("qid", "cid", ranking.ordinal_rank(["qid"], [F.col("score").desc(), F.col("cid")], scaled=False).alias("n"))


@plan("win08_boundaries", "select event_id, (case when row_number() over w > 1 and event_type is not distinct from lag(event_type) over w then 0 else 1 end)::bigint as new from signal window w as (partition by series order by event_id)", "signal")
def _(t):
    rows = ranking.with_neighbours(signal(t), ["series"], ["event_id"], {"before": ("event_type", -1)})
    return rows.select("event_id", F.when(~F.col("first") & F.col("event_type").eqNullSafe(F.col("before")), 0).otherwise(1).alias("new"))


@plan("win09_prefix_sum", "select event_id, round(coalesce(sum(value) over (partition by series order by event_id rows between unbounded preceding and 1 preceding), 0), 4) as before from signal", "signal")
def _(t):
    return ranking.running_before(signal(t), ["series"], "event_id", "value", "before").select("event_id", F.round("before", 4).alias("before"))


@plan("win10_first_crossing", "with c as (select l_orderkey, l_linenumber, sum(l_quantity) over (partition by l_orderkey order by l_linenumber) / sum(l_quantity) over (partition by l_orderkey) as share from lineitem) select l_orderkey, min(l_linenumber)::bigint as at from c where share >= 0.95 group by 1")
def _(t):
    w = Window.partitionBy("l_orderkey")
    share = F.sum("l_quantity").over(w.orderBy("l_linenumber")) / F.sum("l_quantity").over(w)
    return t.lineitem.withColumn("share", share).where("share >= 0.95").groupBy("l_orderkey").agg(F.min("l_linenumber").alias("at"))


@plan("win11_representative", "select p_brand, p_partkey from (select *, row_number() over (partition by p_brand order by (p_type like '%BRASS%') desc, p_size desc, p_partkey) as n from part) where n = 1")
def _(t):
    return topk.first_of_each(t.part, ["p_brand"], [F.col("p_type").contains("BRASS").desc(), F.col("p_size").desc(), F.col("p_partkey")]).select("p_brand", "p_partkey")


@plan("win12_quantile_map", "with a as (select label, vec_id, round(embedding[1], 1)::double as s, row_number() over (partition by label order by round(embedding[1], 1), vec_id) as n from embeddings), b as (select label, embedding[2]::double as v, row_number() over (partition by label order by embedding[2]) as n from embeddings), m as (select a.label, vec_id, s, v from a join b on a.label = b.label and a.n = b.n) select vec_id, round(avg(v) over (partition by label, s), 6) as mapped from m")
def _(t):
    left = t.embeddings.select("label", "vec_id", F.round(F.col("embedding")[0], 1).cast("double").alias("s"))
    right = t.embeddings.select("label", F.col("embedding")[1].cast("double").alias("v"))
    return ranking.quantile_map(left, ["label"], "s", right, "v", "mapped", "vec_id").select("vec_id", "mapped")


@plan("win13_sliding_windows", f"with {_POS}, w as (select series, k, value from p, (select unnest(range(0, (select max(pos) // 5 + 1 from p))) as k) where pos >= k * 5 and pos < k * 5 + 20) select series, k::bigint as win, count(*)::bigint as rows, round(avg(value), 6) as mean from w group by 1, 2", "signal")
def _(t):
    return sig.sliding(placed(t), 20, 5).groupBy("series", "win").agg(F.count("*").alias("rows"), F.avg("value").alias("mean"))


@plan("win14_chunk_spread", f"with {_POS}, c as (select series, pos // 40 as win, (pos % 40) // 8 as chunk, stddev_pop(value) as s from p group by 1, 2, 3) select series, win::bigint as win, round(avg(s), 6) as chunk_mean, round(stddev_pop(s), 5) as chunk_sd, round(quantile_cont(s, 0.95), 6) as chunk_q95, round(max(s), 6) as chunk_max from c group by 1, 2", "signal")
def _(t):
    return sig.chunk_spread(sig.tumbling(placed(t), 40), ["series", "win"], "value", 8).withColumn("chunk_sd", F.round("chunk_sd", 5))


@plan("win15_trend", f"with {_POS} select series, (pos // 20)::bigint as win, round(regr_slope(value, pos % 20), 6) as slope from p group by 1, 2", "signal")
def _(t):
    return sig.trend(sig.tumbling(placed(t), 20), ["series", "win"], "value")


@plan("win16_split_groups", "select o_orderkey, o_custkey, ((row_number() over (partition by o_custkey order by md5('g:' || o_orderkey), o_orderkey) - 1) // 3)::bigint as piece from orders")
def _(t):
    w = Window.partitionBy("o_custkey").orderBy(topk.shuffled("g", F.col("o_orderkey")), "o_orderkey")
    return t.orders.select("o_orderkey", "o_custkey", F.floor((F.row_number().over(w) - 1) / 3).alias("piece"))


@plan("win17_loudest", f"with {_POS}, r as (select series, pos, sqrt(avg(value * value) over w) as rms, count(*) over w as n from p window w as (partition by series order by pos rows between current row and 9 following)), b as (select series, pos, round(rms, 9) as rms, row_number() over (partition by series order by round(rms, 9) desc, pos) as k from r where n = 10) select series, pos::bigint as start, round(rms, 6) as rms from b where k = 1", "signal")
def _(t):
    return sig.loudest(placed(t), "series", "value", 10)


@plan("win18_segment_starts", "with d as (select file, min(start) as a, max(start) as b from scores group by 1) select file, unnest(list_distinct(list_transform(range(0, 6), lambda i: round_even(a + (b - a) * i / 5.0::double, 0)::bigint)))::bigint as start from d", "scores")
def _(t):
    d = scores(t).groupBy("file").agg(F.min("start").alias("a"), F.max("start").alias("b"))
    starts = F.transform(F.sequence(F.lit(0), F.lit(5)), lambda i: F.rint(F.col("a") + (F.col("b") - F.col("a")) * i / 5.0).cast("long"))
    return d.select("file", F.explode(F.array_distinct(starts)).alias("start"))


@plan("win19_hashed_crop")
def _(t):
    n, size = F.size("embedding"), 16
    offset = F.pmod(F.conv(F.substring(topk.shuffled("crop", F.col("vec_id")), 1, 8), 16, 10).cast("long"), n - size + 1)
    padded = F.concat("embedding", F.array_repeat(F.lit(0.0).cast("float"), size))
    return t.embeddings.select("vec_id", offset.alias("start"), F.slice(padded, (offset + 1).cast("int"), F.lit(size)).alias("crop"))


@plan("top01_top_25", "select qid, cid, n::bigint as n from (select *, row_number() over (partition by qid order by score desc, cid) as n from cand) where n <= 25", "cand")
def _(t):
    return topk.top_k(candidates(t), ["qid"], [F.col("score").desc(), F.col("cid")], 25, "n").select("qid", "cid", "n")


@plan("top02_largest_then_sorted", "select l_orderkey, array_to_string(list(l_partkey order by l_partkey), ';') as parts from (select *, row_number() over (partition by l_orderkey order by l_quantity desc, l_partkey, l_linenumber) as n from lineitem) where n <= 3 group by 1")
def _(t):
    top = topk.top_k(t.lineitem, ["l_orderkey"], [F.col("l_quantity").desc(), F.col("l_partkey"), F.col("l_linenumber")], 3)
    return top.groupBy("l_orderkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list("l_partkey")), lambda x: x.cast("string")), ";").alias("parts"))


@plan("top03_positive_only", "select s_nationkey::bigint as k, s_suppkey, n::bigint as n from (select *, row_number() over (partition by s_nationkey order by s_acctbal desc, s_suppkey) as n from supplier where s_acctbal > 0) where n <= 3")
def _(t):
    return topk.top_k(t.supplier.where("s_acctbal > 0"), ["s_nationkey"], [F.col("s_acctbal").desc(), F.col("s_suppkey")], 3, "n").select(F.col("s_nationkey").alias("k"), "s_suppkey", "n")


@plan("top04_both_ends", "with r as (select *, row_number() over (partition by c_nationkey order by c_acctbal desc, c_custkey) as a, row_number() over (partition by c_nationkey order by c_acctbal, c_custkey) as b from customer) select c_custkey, 'top' as side from r where a <= 2 union all select c_custkey, 'bottom' from r where b <= 2")
def _(t):
    return topk.both_ends(t.customer, ["c_nationkey"], "c_acctbal", "c_custkey", 2).select("c_custkey", "side")


@plan("top05_cut_after_statistics", "with z as (select *, (score - avg(score) over w) as d, row_number() over (partition by qid order by score desc, cid) as n from cand window w as (partition by qid)) select qid, cid, round(d, 5) as d from z where n <= 5", "cand")
def _(t):
    rows = candidates(t).withColumn("d", F.round(F.col("score") - F.avg("score").over(Window.partitionBy("qid")), 5))
    return topk.top_k(rows, ["qid"], [F.col("score").desc(), F.col("cid")], 5).select("qid", "cid", "d")


@plan("top06_seeds", "select qid, cid from (select *, row_number() over (partition by qid order by score desc, cid) as n from cand) where n <= 1", "cand")
def _(t):
    return topk.first_of_each(candidates(t), ["qid"], [F.col("score").desc(), F.col("cid")]).select("qid", "cid")


@plan("top07_multi_key_sort", "select c_custkey, c_mktsegment, c_nationkey::bigint as c_nationkey from customer order by c_mktsegment, c_nationkey desc, c_custkey")
def _(t):
    return t.customer.select("c_custkey", "c_mktsegment", "c_nationkey").orderBy("c_mktsegment", F.col("c_nationkey").desc(), "c_custkey")


@plan("top08_best_setting", "with e as (select o_orderpriority as s, avg(abs(o_totalprice - 150000)) as m, stddev_pop(abs(o_totalprice - 150000)) as d from orders group by 1) select arg_min(s, m) as by_mean, arg_min(s, d) as by_sd, arg_min(s, m + d) as by_both from e")
def _(t):
    x = F.abs(F.col("o_totalprice") - 150000)
    e = t.orders.groupBy(F.col("o_orderpriority").alias("s")).agg(F.avg(x).alias("m"), F.stddev_pop(x).alias("d"))
    return e.agg(F.min_by("s", "m").alias("by_mean"), F.min_by("s", "d").alias("by_sd"), F.min_by("s", F.col("m") + F.col("d")).alias("by_both"))


@plan("top09_backward_elimination")
def _(t):
    """Drops one feature a round while the ridge fit doesn't get worse; all rounds use one pass's Gram matrix."""
    import numpy as np

    from ..operators.models import gram, ridge

    rows = t.lineitem.select(F.array(F.lit(1.0), "l_quantity", "l_discount", "l_tax").alias("x"), F.col("l_extendedprice").alias("y"))
    xx, xy, n = gram(rows, "x", "y", 4)
    gain = lambda keep: float(xy[keep] @ ridge(xx[np.ix_(keep, keep)], xy[keep], [1.0])[1.0]) if n else 0.0
    keep, steps = [0, 1, 2, 3], []
    while len(keep) > 1:
        best = max(((gain([k for k in keep if k != d]), d) for d in keep))
        steps.append((len(steps), int(best[1]), round(best[0] / max(1.0, gain([0, 1, 2, 3])), 6)))
        keep.remove(best[1])
    return t.spark.createDataFrame(steps, "step long, dropped long, share double")


# Signal features.


@plan("agg33b_window_summary", f"with {_POS} select series, (pos // 50)::bigint as win, round(avg(value), 6) as mean, round(stddev_pop(value), 6) as sd, round(max(value), 6) as high, round(quantile_cont(value, 0.95), 6) as q950, round(avg((abs(value) > 20)::int), 6) as above_20 from p group by 1, 2", "signal")
def _(t):
    return sig.summary(sig.tumbling(placed(t), 50), ["series", "win"], "value").select("series", "win", "mean", "sd", "high", "q950", "above_20")


@plan("win13b_time_to_next", "select event_id, (min(case when reset then sec end) over (partition by series order by sec, event_id rows between current row and unbounded following) - sec)::bigint as ttf from signal", "signal")
def _(t):
    return sig.time_to_next(signal(t), "series", "sec", F.col("reset"), "event_id").select("event_id", "ttf")


@plan("scf42_spectrum")
def _(t):
    return sig.spectrum(sig.tumbling(placed(t), 64), ["series", "win"], "value")
