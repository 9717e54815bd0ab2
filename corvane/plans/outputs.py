"""Sinks and models."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import compose, metrics, models, rangejoin, reports
from ..operators.ranking import quantiles
from ..operators.splits import group_fold
from ..sources import sinks
from ..sources.tables import scores, signal
from .aggregates import candidates
from .registry import plan
from .windows import placed

_LIST = "with r as (select *, row_number() over (partition by qid order by score desc, cid) as n from cand), l as (select qid, string_agg(cid::varchar, ';' order by n) as items from r where n <= 25 group by 1) select c_custkey as qid, coalesce(items, 'C') as items from customer left join l on qid = c_custkey"


def submission(t):
    w = Window.partitionBy("qid").orderBy(F.col("score").desc(), "cid")
    rows = candidates(t).withColumn("n", F.row_number().over(w)).where("n <= 25")
    return compose.ranked_list(rows, "qid", "n", "cid", "C", t.customer.select(F.col("c_custkey").alias("qid")))


@plan("snk05_submission", _LIST, "cand")
def _(t):
    return submission(t)


@plan("snk05b_wide_submission", "select file || '_' || start as row_id, round(coalesce(max(case when class = 'click' then score end), 0.5), 6) as click, round(coalesce(max(case when class = 'view' then score end), 0.5), 6) as view from scores group by 1", "scores")
def _(t):
    rows = scores(t).withColumn("row_id", F.concat_ws("_", "file", "start"))
    ids = rows.select("row_id").distinct()
    wide = sinks.wide_scores(rows.where(F.col("class").isin("click", "view")), "row_id", "class", "score", ["click", "view"])
    return ids.join(wide, "row_id", "left").fillna(0.5, ["click", "view"])


@plan("snk06_validator", f"with base as ({_LIST}), f as (select * from base union all select qid, items from base where qid % 7 = 0 union all select null, items from base where qid % 17 = 0 union all select -qid, '' from base where qid % 11 = 0 union all select -1000000 - qid, null from base where qid % 19 = 0 union all select -2000000 - qid, repeat(items || ';', 30) || items from base where qid % 13 = 0), k as (select qid, count(*) as n from f group by 1) select (select count(*) from f where qid is null or items is null)::bigint as nulls, (select count(*) from f where items = '')::bigint as empty, (select count(*) from k where n > 1)::bigint as repeated, (select count(*) from f where len(string_split(items, ';')) > 25)::bigint as too_long", "cand")
def _(t):
    """A submission with planted faults of each kind."""
    base = submission(t)
    more = [
        base.where("qid % 7 = 0"),
        base.where("qid % 17 = 0").withColumn("qid", F.lit(None).cast("long")),
        base.where("qid % 11 = 0").select(-F.col("qid"), F.lit("")),
        base.where("qid % 19 = 0").select(-1000000 - F.col("qid"), F.lit(None).cast("string")),
        base.where("qid % 13 = 0").select(-2000000 - F.col("qid"), F.concat(F.repeat(F.concat("items", F.lit(";")), F.lit(30)), "items")),
    ]
    return sinks.submission_faults(reduce(DataFrame.union, more, base), "qid", "items")


@plan("snk08_log_once", "select o_orderkey as run, case when o_orderkey % 2 = 0 then 'logged' else o_orderstatus end as status from orders")
def _(t):
    """Runs that the log has keep what it says of them; the others are added once, although they come twice."""
    runs = t.orders.select(F.col("o_orderkey").alias("run"), F.col("o_orderstatus").alias("status"))
    n = 2 * t.orders.count()
    twice, log = (rangejoin.by_size(df, n, "run") for df in (runs.union(runs), runs.where("run % 2 = 0").withColumn("status", F.lit("logged"))))
    return sinks.log_once(twice, log, ["run"])


# Models: numeric checks are in the tests; SQL replays what is arithmetic.


@plan("mlo01_one_vs_rest")
def _(t):
    rows = t.embeddings.withColumn("x", F.transform("embedding", lambda v: v.cast("double")))
    classes = list(range(10))
    train = rows.where(group_fold(F.col("vec_id"), 5) != 0)
    return models.class_scores(rows, "x", models.one_vs_rest(train, "x", "label", classes), classes).select("vec_id", "label", *[f"p_{k}" for k in classes])


@plan("mlo02_standardise", "select vec_id, round((embedding[1]::double - m) / s, 6) as z from embeddings, (select avg(embedding[1]::double) as m, stddev_pop(embedding[1]::double) as s from embeddings where label < 8)")
def _(t):
    x = F.col("embedding")[0].cast("double")
    fit = t.embeddings.where("label < 8").agg(F.avg(x).alias("m"), F.stddev_pop(x).alias("s"))
    return t.embeddings.crossJoin(F.broadcast(fit)).select("vec_id", ((x - F.col("m")) / F.col("s")).alias("z"))


@plan("mlo03_ridge_sweep", "with s as (select sum(l_quantity * l_quantity) as xx, sum(l_quantity * l_extendedprice) as xy from lineitem) select a::double as alpha, round(xy / (xx + a), 4) as w from s, (select unnest([0.0::double, 10.0, 1000.0]) as a)")
def _(t):
    xx, xy, _ = models.gram(t.lineitem.select(F.array("l_quantity").alias("x"), F.col("l_extendedprice").alias("y")), "x", "y", 1)
    found = models.ridge(xx, xy, [0.0, 10.0, 1000.0])
    return t.spark.createDataFrame([(a, round(float(w[0]), 4)) for a, w in found.items()], "alpha double, w double")


def _window_table(t):
    from ..operators import signal as sig

    rows = sig.tumbling(placed(t), 20)
    target = sig.time_to_next(signal(t), "series", "sec", F.col("reset"), "event_id").select("event_id", "ttf")
    rows = rows.join(target, "event_id")
    return sig.summary(rows, ["series", "win"], "value").join(rows.groupBy("series", "win").agg((F.max_by("ttf", "off") / 3600.0).alias("y")), ["series", "win"]).where("y is not null")


@plan("mlo04_boosted_trees")
def _(t):
    table = _window_table(t).persist()
    model = models.boosted(table.where(group_fold(F.col("series"), 5) != 0), ["mean", "sd", "rms", "q500"], "y", classify=False, iterations=5)
    from pyspark.ml.feature import VectorAssembler

    ready = VectorAssembler(inputCols=["mean", "sd", "rms", "q500"], outputCol="features").transform(table)
    return model.transform(ready).select("series", "win", "y", models.clipped(F.col("prediction"), 0.0, 1000.0).alias("guess"))


@plan("mlo05_kernel_ridge")
def _(t):
    rows = t.embeddings.select("vec_id", F.transform("embedding", lambda v: v.cast("double")).alias("x"), F.col("label").cast("double").alias("y"))
    rows = models.kernel_features(rows, "x", 64, 1.4, 32)
    xx, xy, _ = models.gram(rows, "rff", "y", 32)
    return rows.select("vec_id", models.dot(F.col("rff"), models.ridge(xx, xy, [1.0])[1.0]).alias("guess"))


@plan("mlo05_nu_svr")
def _(t):
    """Every vector's label as support vectors guess it, fitted on at most 1,000 of them."""
    from ..operators import svr

    rows = t.embeddings.select("vec_id", F.transform("embedding", lambda v: v.cast("double")).alias("x"), F.col("label").cast("double").alias("y"))
    return svr.predicted(rows, "x", svr.fit(rows, "vec_id", "x", "y", most=1000)).select("vec_id", "guess")


@plan("mlo06_wrappers", "select o_orderkey, round(least(greatest(exp(ln(1 + o_totalprice)) - 1, 0), 100000), 4) as guess, round(list_median([o_totalprice, o_totalprice * 0.5, 90000]), 4) as blend from orders")
def _(t):
    x = F.col("o_totalprice")
    members = F.array_sort(F.array(x, x * 0.5, F.lit(90000.0)))
    return t.orders.select("o_orderkey", F.round(models.clipped(F.expm1(F.log1p(x)), 0.0, 100000.0), 4).alias("guess"), F.round(members[1], 4).alias("blend"))


@plan("mlo07_pairwise_ranker")
def _(t):
    rows = t.embeddings.select(F.col("label").alias("qid"), "vec_id", F.transform("embedding", lambda v: v.cast("double")).alias("x"), (F.col("embedding")[0] > 0.1).cast("int").alias("y"))
    w = models.pairwise_ranker(rows, "qid", "x", "y", 64, rounds=5)
    return rows.select("qid", "vec_id", "y", models.dot(F.col("x"), w).alias("score"))


@plan("mlo07_lambdarank")
def _(t):
    """Which line of an order brought the most, learned on the other orders: held-out lines by the mean of four seeds."""
    from ..operators import ranker

    brought = F.col("l_extendedprice") * (1 - F.col("l_discount")) * (1 + F.col("l_tax"))
    best = F.max(F.struct(brought, "l_linenumber")).over(Window.partitionBy("l_orderkey"))  # an order has a few lines
    lines = rangejoin.by_size(t.lineitem.withColumn("line", F.xxhash64("l_partkey", "l_suppkey", "l_linenumber")), t.lineitem.count(), "l_orderkey")
    lines = lines.select("l_orderkey", "line", "l_quantity", "l_extendedprice", "l_discount", "l_tax", (F.col("l_linenumber") == best["l_linenumber"]).cast("int").alias("y"), (F.col("l_orderkey") % 3 + 1).alias("cls"), (group_fold(F.col("l_orderkey"), 5) == 0).alias("held")).persist()  # read by each pass before the trees; dealt by order, so none of them shuffles it
    names = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
    train = ranker.class_weights(lines.where("not held"), "l_orderkey", "y", "cls", {1: 0.14, 2: 0.126, 3: 0.735})
    model = ranker.fit(train, "l_orderkey", "line", names, "y", "weight", ranker.Settings(trees=4, depth=3, bins=32, rate=0.3, l2=1e-6))
    return model.scored(lines.where("held")).select("l_orderkey", "line", "y", "score")


_TREES = [
    [{"feature": 0, "threshold": 10.0, "left": 1, "right": 2}, {"value": -0.5}, {"feature": 1, "threshold": 0.05, "left": 3, "right": 4}, {"value": 0.25}, {"value": 0.75}],
    [{"feature": 1, "threshold": 0.02, "left": 1, "right": 2}, {"value": 0.1}, {"value": -0.1}],
]


@plan("mlo08_tree_scorer", "select l_orderkey, l_linenumber::bigint as n, round(1 / (1 + exp(-(0.2 + case when l_quantity <= 10 then -0.5 when l_discount <= 0.05 then 0.25 else 0.75 end + case when l_discount <= 0.02 then 0.1 else -0.1 end))), 6) as p from lineitem")
def _(t):
    return t.lineitem.select("l_orderkey", F.col("l_linenumber").alias("n"), models.ensemble_score(_TREES, ["l_quantity", "l_discount"], 0.2, True).alias("p"))


#: Rows of a block of queries or candidates.
PLACED = 8192


def _placed(asks, candidates):
    """Of each query of a block, how many candidates of the other block are ahead of the truth, and how many there are."""
    import numpy as np

    from ..operators import blocks

    q, own, guess = blocks.numbers(asks.field("vec_id")), np.asarray(asks.field("own")), asks.field("probabilities")
    good, ahead = np.flatnonzero(np.asarray(guess.is_valid())), np.zeros(len(q), dtype=np.int64)
    if len(good):
        p = np.asarray(guess.flatten()).reshape(len(good), -1)
        known = np.asarray(candidates.field("other").is_valid()) & np.asarray(candidates.field("word").is_valid())
        ids, words = (blocks.numbers(candidates.field(c))[known] for c in ("other", "word"))
        flags = (words[:, None] >> np.arange(p.shape[1] - 1, -1, -1) & 1).astype(float)
        for k in range(0, len(good), 256):
            at = good[k : k + 256]
            ahead[at] = blocks.soft_ahead(p[k : k + 256], own[at], flags, q[at][:, None] == ids[None, :])
    yield q, own, ahead, np.full(len(q), len(candidates))


def _places(asked, rows, n: int):
    """vec_id, own, place and candidates of guesses (vec_id, label, probabilities of n bits, own) among rows (vec_id, label, bits) of their label.

    Bits that are null, of another number or with a null inside are similar to nothing. Blocks of rows meet, and what is kept of a pair is its part in a count.
    """
    from ..operators import bits, blocks

    whole = (F.size("bits") == n) & ~F.exists("bits", lambda v: v.isNull())
    candidates = rows.select("label", F.col("vec_id").alias("other"), F.when(whole, bits.pack(F.transform("bits", lambda v: v > 0))).alias("word"))
    counts = blocks.met(asked, candidates, "label", "vec_id", "other", _placed, "vec_id long, own double, ahead long, n long", PLACED)
    return counts.groupBy("vec_id").agg(F.first("own").alias("own"), (F.sum("ahead") + 1).alias("place"), F.sum("n").alias("candidates"))


@plan("mlo09_ranking_network")
def _(t):
    """The first 32 signs of each vector as a network guesses them from the other 32 values and the label, ranked against its label's vectors.

    The rows whose id is divisible by 50 are the queries, and held out of the training: vec_id, the Tanimoto of the guess and the
    truth, its place and how many candidates there are.
    """
    import uuid

    from ..operators import bits, network
    from ..operators.lineage import shared_dir

    signs = F.transform(F.slice("embedding", 1, 32), lambda v: (v > 0).cast("double"))
    rest = F.transform(F.slice("embedding", 33, 32), lambda v: v.cast("double") * 8)
    marks = F.array(*[(F.col("label") == k).cast("double") for k in range(10)])
    rows = t.embeddings.select("vec_id", "label", F.concat(rest, marks).alias("x"), signs.alias("bits"))
    held = F.col("vec_id") % 50 == 0
    settings = network.Settings(hidden=(64,), epochs=3, batches=4, rate=5e-3)
    train = network.with_pools(rows.where(~held), "vec_id", "label", "bits", most=15)
    net = network.fit(train, "vec_id", "x", "bits", shared_dir(t.spark), "pool", settings, run=f"network-{uuid.uuid4().hex}")
    guessed = network.predicted(rows.where(held), "x", net)
    asked = guessed.select("vec_id", "label", "probabilities", bits.soft_tanimoto(F.col("probabilities"), F.col("bits")).alias("own"))
    return _places(asked, rows, net.layers[-1][0].shape[1])


@plan("mlo10_probability_mean", "select vec_id, round((1 / (1 + exp(-embedding[1]::double)) + 1 / (1 + exp(-embedding[2]::double))) / 2, 6) as p from embeddings")
def _(t):
    return t.embeddings.select("vec_id", models.probability_mean([F.col("embedding")[i].cast("double") for i in (0, 1)]).alias("p"))


@plan("mlo11_pseudo_labels")
def _(t):
    """Within each fold: a ridge head fitted on the labelled rest, its surest unlabelled rows added, and the head fitted again."""
    rows = t.embeddings.select("vec_id", F.transform("embedding", lambda v: v.cast("double")).alias("x"), (F.col("label") < 5).cast("double").alias("y"), group_fold(F.col("vec_id"), 3).alias("fold")).withColumn("known", F.col("vec_id") % 4 == 0)

    def fit(train):
        head = lambda some, y: models.ridge(*models.gram(some.withColumn("t", y), "x", "t", 64)[:2], [1.0])[1.0]
        first = head(train.where("known"), F.col("y"))
        guessed = train.where("not known").withColumn("g", models.dot(F.col("x"), first))
        cut = quantiles(guessed, [], "g", {"hi": 0.9, "lo": 0.1})
        sure = guessed.crossJoin(F.broadcast(cut)).where("g >= hi or g <= lo").withColumn("y", (F.col("g") >= F.col("hi")).cast("double"))
        both = train.where("known").select("x", "y").unionByName(sure.select("x", "y"))
        second = head(both, F.col("y"))
        return lambda held: held.select("vec_id", "fold", models.dot(F.col("x"), second).alias("score"))

    return models.out_of_fold(rows, "fold", [0, 1, 2], fit)


@plan("mlo12_cohorts", "with c as (select n_nationkey, n_nationkey in (select c_nationkey from customer) as mapped, n_nationkey in (select s_nationkey from supplier where s_acctbal > 5000) as labelled from nation) select mapped, labelled, count(*)::bigint as classes from c group by 1, 2")
def _(t):
    flag = lambda df, c, name: df.select(F.col(c).alias("n_nationkey")).distinct().withColumn(name, F.lit(True))
    rows = t.nation.join(flag(t.customer, "c_nationkey", "mapped"), "n_nationkey", "left").join(flag(t.supplier.where("s_acctbal > 5000"), "s_nationkey", "labelled"), "n_nationkey", "left").fillna(False, ["mapped", "labelled"])
    return rows.groupBy("mapped", "labelled").agg(F.count("*").alias("classes"))


@plan("mlo14_mlp_probe")
def _(t):
    """Each row's class as a network sees it that was fitted without the row's fold."""
    rows = t.embeddings.select("vec_id", F.transform("embedding", lambda v: v.cast("double")).alias("x"), F.col("label").cast("double").alias("y"), group_fold(F.col("vec_id"), 2).alias("fold"))
    fit = lambda train: lambda held: models.mlp_probe(train, "x", "y", 64, 10, iterations=20)(held).select("vec_id", "fold", "y", "guess")
    return models.out_of_fold(rows, "fold", [0, 1], fit)


@plan("mlo15_grouped_cv")
def _(t):
    rows = t.embeddings.select("vec_id", F.transform("embedding", lambda v: v.cast("double")).alias("x"), F.col("label").cast("double").alias("y"), group_fold(F.col("label"), 3).alias("fold"))
    alphas, parts = [0.1, 10.0], []
    for fold in range(3):  # one pass over a fold's training rows serves all settings
        found = models.ridge(*models.gram(rows.where(F.col("fold") != fold), "x", "y", 64)[:2], alphas)
        held = rows.where(F.col("fold") == fold)
        parts += [held.select("fold", "y", models.dot(F.col("x"), found[a]).alias("guess"), F.lit(a).alias("alpha")) for a in alphas]
    return metrics.error_by_fold(reduce(DataFrame.unionByName, parts).withColumn("group", F.struct("alpha", "fold")), "group", "y", F.col("guess")).select("group.*", "*").drop("group")


_MIX = "(select unnest([1.0::double, 0.25]) as late)"
_HEADS = f"""with r as (select o_orderkey, ('0x' || substr(md5('fold:' || o_custkey), 1, 8))::bigint % 4 as fold, o_orderpriority < '3' as early, (o_custkey % 100)::double / 10 as x, o_totalprice / 1000 as y from orders),
w as (select r.*, late, case when early then 1.0::double else late end as w from r, {_MIX}),
f as (select a.fold, b.late, sum(w) as sw, sum(w * x) as sx, sum(w * y) as sy, sum(w * x * x) as sxx, sum(w * x * y) as sxy from (select distinct fold from r) a join w b on b.fold <> a.fold group by 1, 2),
h as (select fold, late, alpha, (sxy - sx * sy / sw) / (sxx - sx * sx / sw + alpha) as c, sy / sw as my, sx / sw as mx from f, (select unnest([1.0::double, 1000.0]) as alpha))
select r.fold::bigint as fold, late, alpha, round(avg(abs(r.y - (my + c * (r.x - mx)))), 6) as mae, count(*)::bigint as n from r join h using (fold) group by 1, 2, 3"""


@plan("mlo15_weighted_heads", _HEADS)
def _(t):
    """Heads for each fold, two penalties and two weights of the later priorities, all from one pass: their held-out errors."""
    from ..operators import heads

    rows = t.orders.select(group_fold(F.col("o_custkey"), 4).alias("fold"), (F.col("o_orderpriority") < "3").alias("early"), F.array((F.col("o_custkey") % 100).cast("double") / 10).alias("x"), F.array(F.col("o_totalprice") / 1000).alias("y"))
    sums = heads.fold_sums(rows, ["fold", "early"], "x", "y", 1, 1)
    parts = []
    for late in (1.0, 0.25):
        rest = heads.without_each(heads.mixed(sums, {True: 1.0, False: late}), [0, 1, 2, 3])
        for alpha in (1.0, 1000.0):
            held = heads.scored(rows, "x", "fold", {f: v.ridge(alpha) for f, v in rest.items()})
            error = F.abs(F.col("y")[0] - F.col("scores")[0])
            parts.append(held.groupBy("fold").agg(F.avg(error).alias("mae"), F.count("*").alias("n")).select("fold", F.lit(late).alias("late"), F.lit(alpha).alias("alpha"), "mae", "n"))
    return reduce(DataFrame.unionByName, parts)


@plan("mlo12_head_variants")
def _(t):
    """Macro AUC of held-out rows by cohort (classes with many or few labelled rows) for heads with and without the unsure rows' weight."""
    from ..operators import heads

    classes = list(range(10))
    y = F.array(*[(F.col("label") == k).cast("double") for k in classes])
    rows = t.embeddings.select("vec_id", "label", F.transform("embedding", lambda v: v.cast("double")).alias("x"), y.alias("y"), group_fold(F.col("vec_id"), 3).alias("fold"), (F.col("vec_id") % 4 == 0).alias("sure"))
    sums = heads.fold_sums(rows, ["fold", "sure"], "x", "y", 64, 10)
    parts = []
    for name, mix in (("sure alone", {True: 1.0}), ("all", {True: 1.0, False: 1.0}), ("weighted", {True: 1.0, False: 0.2})):
        rest = heads.without_each(heads.mixed(sums, mix), [0, 1, 2])
        held = heads.scored(rows, "x", "fold", {f: v.ridge(10.0) for f, v in rest.items()})
        long = held.select("label", F.posexplode("scores").alias("class", "score")).select("class", "score", (F.col("label") == F.col("class")).cast("int").alias("hit"))
        by_class = metrics.auc(long, ["class"], "score", "hit")
        parts.append(by_class.groupBy((F.col("class") < 5).alias("cohort")).agg(F.avg("auc").alias("auc"), F.count("*").alias("classes")).select(F.lit(name).alias("head"), "cohort", "auc", "classes"))
    return reduce(DataFrame.unionByName, parts)


@plan("mlo16_staged_metrics", "with a as (select event_type as class, avg(value) as m from events group by 1) select 'raw' as stage, round(avg(m), 6) as metric from a union all select 'clipped', round(avg(least(m, 50)), 6) from a")
def _(t):
    a = t.events.groupBy("event_type").agg(F.avg("value").alias("m"))
    stage = lambda name, c: a.agg(F.lit(name).alias("stage"), F.avg(c).alias("metric"))
    return stage("raw", F.col("m")).union(stage("clipped", F.least("m", F.lit(50.0))))


_LINES = "b as (select l_orderkey as q, l_partkey * 10000000 + l_suppkey * 100 + l_linenumber as line, l_quantity, l_extendedprice, l_discount, l_linenumber, l_extendedprice * (1 - l_discount) * (1 + l_tax) as brought from lineitem), r as (select *, (row_number() over (partition by q order by brought desc, line) = 1)::int as y from b)"


def _candidate_lines(t):
    """An order's lines as a candidate list: y marks the line that brought the most."""
    brought = F.col("l_extendedprice") * (1 - F.col("l_discount")) * (1 + F.col("l_tax"))
    line = F.col("l_partkey") * 10000000 + F.col("l_suppkey") * 100 + F.col("l_linenumber")
    rows = t.lineitem.select(F.col("l_orderkey").alias("q"), line.alias("line"), "l_quantity", "l_extendedprice", "l_discount", brought.alias("brought"))
    rows = rangejoin.by_size(rows, t.lineitem.count(), "q")
    first = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("brought"), "line")) == 1
    return rows.withColumn("y", first.cast("int")).drop("brought")


@plan("evl08_table", f"with {_LINES}, p as (select q, min(case when y = 1 then place end) as place from (select *, row_number() over (partition by q order by l_discount desc, line) as place from r) group by 1) select o_orderpriority as cohort, count(*)::bigint as queries, round(avg(case when place <= 2 then 1.0::double / place else 0 end), 6) as mrr, coalesce(sum((place <= 2)::int), 0)::bigint as near, count(place)::bigint as listed from orders left join p on q = o_orderkey group by 1")
def _(t):
    """How the discount stands as a score for an order's best line, by priority."""
    queries = t.orders.select(F.col("o_orderkey").alias("q"), F.col("o_orderpriority").alias("cohort"))
    return reports.standing(_candidate_lines(t), queries, "q", "line", "l_discount", "y", "cohort", most=2)


@plan("evl08_feature_auc", f"with {_LINES}, u as (unpivot (select q, y, l_quantity::double as l_quantity, l_extendedprice::double as l_extendedprice, l_discount::double as l_discount from r) on l_quantity, l_extendedprice, l_discount into name feature value v), k as (select *, rank() over (partition by feature, q order by v) + (count(*) over (partition by feature, q, v) - 1) / 2.0::double as rk from u), a as (select feature, q, (sum(case when y = 1 then rk else 0 end) - 1) / (count(*) - 1) as auc from k group by 1, 2 having count(*) > 1) select feature, round(avg(auc), 6) as auc, count(*)::bigint as queries from a group by 1")
def _(t):
    return reports.feature_auc(_candidate_lines(t), "q", ["l_quantity", "l_extendedprice", "l_discount"], "y")


@plan("evl05_weight_sweep", f"with {_LINES}, g as (select * from (select unnest([0.0::double, 0.5, 1.0]) as l_quantity), (select unnest([0.0::double, 100.0, -100.0]) as l_discount)), x as (select g.l_quantity as wq, g.l_discount as wd, q, y, row_number() over (partition by g.l_quantity, g.l_discount, q order by round(g.l_quantity * r.l_quantity + g.l_discount * r.l_discount, 9) desc, line) as place from r, g), p as (select wq, wd, q, 1.0::double / min(case when y = 1 then place end) as rr from x group by 1, 2, 3) select wq as l_quantity, wd as l_discount, (select count(*) from orders)::bigint as queries, round(sum(rr) / (select count(*) from orders), 6) as mrr from p group by 1, 2")
def _(t):
    """Nine weighings of two terms by what they find of each order's best line, from one pass over the lines."""
    settings = [{"l_quantity": a, "l_discount": b} for a in (0.0, 0.5, 1.0) for b in (0.0, 100.0, -100.0)]
    queries = t.orders.select(F.col("o_orderkey").alias("q"))
    return reports.swept(_candidate_lines(t), queries, "q", "line", "y", settings, most=1000)


@plan("evl08_cv")
def _(t):
    """What the whole learned ranker (its own settings, all folds) gains over the quantity on held-out orders, by priority."""
    queries = t.orders.select(F.col("o_orderkey").alias("q"), F.col("o_orderpriority").alias("cohort"))
    oof = reports.cross_validated(_candidate_lines(t), "q", "line", ["l_quantity", "l_extendedprice", "l_discount"], "y")
    return reports.gain(oof, queries, "q", "line", "l_quantity", "score", "y", "cohort")


@plan("evl07_out_of_fold")
def _(t):
    rows = t.orders.select("o_orderkey", F.array(F.lit(1.0), (F.col("o_custkey") % 100).cast("double")).alias("x"), F.col("o_totalprice").alias("y"), group_fold(F.col("o_custkey"), 3).alias("fold"))

    def fit(train):
        w = models.ridge(*models.gram(train, "x", "y", 2)[:2], [1.0])[1.0]
        return lambda held: held.select("o_orderkey", "fold", models.dot(F.col("x"), w).alias("guess"))

    return models.out_of_fold(rows, "fold", [0, 1, 2], fit)
