"""A learned ranker: boosted trees on LambdaRank gradients, several seeds grown side by side.

Queries may be of any size: a query's rows are spread over tasks. A pair counts if one of its rows
is among the query's `top` best by the current score and the labels differ; it weighs as much as the
NDCG at `top` changes when the two swap places. So a row needs its query's best rows only, which are
joined to it, and what it does to one of them is added to the histograms at that one's bins: sums of
gradients are all that a tree is grown from, and they add up over tasks.

Queries of at most WHOLE rows with labels 0 and 1 lie whole in blocks: a row of binaries holds some
thousands of rows of many queries, so their places and pairs need neither a shuffle nor a copy for
each tree, and a task works on whole arrays.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import asdict, dataclass, field, replace

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .lineage import cut
from .models import ensemble_score
from .rangejoin import MOST_PARTS, ROWS

#: Rows of a query that lies whole in a block, at most, and of a block, about.
WHOLE, BLOCK = 256, 16_384
#: Bytes of blocks up to which each task has them all, and grows the trees of one seed by itself.
SENT = 64_000_000


@dataclass(frozen=True)
class Settings:
    trees: int = 100
    depth: int = 5
    bins: int = 64
    rate: float = 0.1
    l2: float = 1.0
    least_rows: int = 20
    top: int = 30
    seeds: tuple[int, ...] = (0, 1, 2, 3)
    #: Shares of the queries and of the features that a tree of a seed sees.
    queries: float = 0.8
    features: float = 0.8
    #: Rounds after which scores are kept in a checkpoint instead of being worked out from all trees.
    kept_after: int = 20


@dataclass(frozen=True)
class _Members(Settings):
    """Settings of rankers that are grown side by side: seeds has those of each in turn, without the fold that each leaves out (none: all queries)."""

    without: tuple[int, ...] = ()


@dataclass
class Ranker:
    features: list[str]
    #: For each seed its trees, as lists of nodes for models.ensemble_score.
    trees: list[list[list[dict]]] = field(default_factory=list)

    def score(self) -> Column:
        """The mean over the seeds of a row's score."""
        every = [ensemble_score(t, self.features) for t in self.trees]
        return sum(every[1:], every[0]) / len(every)

    def scored(self, df: DataFrame, name: str = "score") -> DataFrame:
        """df with a column of score(), worked out by whole batches: the expression of many trees is too long for the JVM to compile."""
        from pyspark.sql.pandas.types import to_arrow_schema
        from pyspark.sql.types import DoubleType, StructField, StructType

        out = StructType([*df.schema.fields, StructField(name, DoubleType())])
        flat, n, schema = self.flat(), len(self.features), to_arrow_schema(out)
        x = F.array(*[F.coalesce(F.col(c).cast("double"), F.lit(float("nan"))) for c in self.features])

        def run(batches):
            import pyarrow as pa

            for b in batches:
                scores = flat_scores(flat, np.asarray(b.column(b.num_columns - 1).flatten()).reshape(-1, n))
                yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(scores)], schema=schema)

        return df.select(*df.columns, x.alias("__x")).mapInArrow(run, out)

    def flat(self) -> list[dict[str, np.ndarray]]:
        """For each seed flat arrays over all nodes of its trees: feature (-1 in leaves), threshold, left, right, value, and root of each tree."""
        out = []
        for trees in self.trees:
            parts: dict[str, list] = {k: [] for k in ("feature", "threshold", "left", "right", "value", "root")}
            for nodes in trees:
                base = len(parts["value"])
                parts["root"].append(base)
                for n in nodes:
                    leaf = "value" in n
                    row = (-1, 0.0, 0, 0, n["value"]) if leaf else (n["feature"], n["threshold"], base + n["left"], base + n["right"], 0.0)
                    for k, v in zip(("feature", "threshold", "left", "right", "value"), row, strict=True):
                        parts[k].append(v)
            out.append({k: np.array(v) for k, v in parts.items()})
        return out


def flat_scores(flat: list[dict[str, np.ndarray]], x: np.ndarray) -> np.ndarray:
    """Scores of rows by the arrays of Ranker.flat(): all rows walk down a tree together; NaN goes left."""
    total = np.zeros(len(x))
    for seed in flat:
        for root in seed["root"]:
            at = np.full(len(x), root)
            while (inner := seed["feature"][at] >= 0).any():
                v = x[np.arange(len(x)), np.maximum(seed["feature"][at], 0)]
                down = np.where(~(v > seed["threshold"][at]), seed["left"][at], seed["right"][at])
                at = np.where(inner, down, at)
            total += seed["value"][at]
    return total / len(flat)


def discounts(n: int) -> np.ndarray:
    return 1 / np.log2(np.arange(n) + 2)


def pair_weights(own_score, own_label, own_place, score, label, place, ideal, top: int):
    """(gradient, curvature) that each pair gives its first row: label 1 wants to be above label 0. Arrays broadcast; place: 0 for the best, top and more beyond the cut."""
    steps = np.append(discounts(top), 0.0)
    change = np.abs(steps[np.minimum(own_place, top)] - steps[np.minimum(place, top)]) / ideal
    sign = np.where(own_label > label, -1.0, 1.0)
    miss = 1 / (1 + np.exp(np.clip(sign * (score - own_score), -50, 50)))  # how likely the pair is the wrong way round
    counts = own_label != label
    return np.where(counts, sign * change * miss, 0.0), np.where(counts, change * miss * (1 - miss), 0.0)


def class_weights(df: DataFrame, query: str, label: str, of_class: str, shares: dict) -> DataFrame:
    """df, without the queries that have no positive row, and with a column weight: the share of the query's class over the number of its queries with a positive."""
    has = df.groupBy(query, of_class).agg(F.max(label).alias("__has")).where(F.col("__has") > 0).select(query, of_class)
    counts = {r[of_class]: r["count"] for r in has.groupBy(of_class).count().where(F.col(of_class).isin(list(shares))).collect()}  # a row for each class of shares
    weight = F.lit(0.0)
    for k, share in shares.items():
        weight = F.when(F.col(of_class) == k, share / max(1, counts.get(k, 0))).otherwise(weight)
    return df.join(has.select(query), query, "left_semi").withColumn("weight", weight)


def fit(df: DataFrame, query: str, row: str, features: list[str], label: str, weight: str | None = None, settings: Settings = Settings(), edges: list[list[float]] | None = None) -> Ranker:
    """A ranker of the rows of each query. label: 1 for what should come first, else 0; row tells a query's rows apart; weight is the query's.

    Null features count as NaN, which goes left; rows without a query, row number or label are left out,
    as are queries without both labels. An empty table gives trees of one leaf. edges: for each feature
    the sorted values that a split may be at, at most 255; where none are given, approximate quantiles,
    which follow the table's partitioning, as splits then do a little.
    """
    return Ranker(features, _fitted(df, query, row, features, label, weight, settings, edges))


def fit_without_each(df: DataFrame, query: str, row: str, features: list[str], label: str, fold: str, folds: list[int], weight: str | None = None, settings: Settings = Settings(), edges: list[list[float]] | None = None) -> dict[int, Ranker]:
    """For each fold the ranker, as fit() gives it, of the queries of the others; fold is the query's. All are grown side by side, so that their trees read the rows together.

    They share the edges; where none are given, these are quantiles of all rows' features (labels play no part in them).
    """
    members = _Members(**asdict(settings) | {"seeds": settings.seeds * len(folds)}, without=tuple(k for k in folds for _ in settings.seeds))
    trees = _fitted(df, query, row, features, label, weight, members, edges, fold)
    n = len(settings.seeds)
    return {k: Ranker(features, trees[i * n : (i + 1) * n]) for i, k in enumerate(folds)}


def _fitted(df: DataFrame, query: str, row: str, features: list[str], label: str, weight: str | None, s: Settings, edges: list[list[float]] | None, fold: str | None = None) -> list[list[list[dict]]]:
    held = df.where(F.col(query).isNotNull() & F.col(row).isNotNull() & F.col(label).isNotNull())
    edges = edges or quantile_edges(held, features, s.bins)
    values = F.array(*[F.coalesce(F.col(c).cast("double"), F.lit(float("nan"))) for c in features])
    rows = held.select(F.col(query).alias("query"), F.col(row).cast("long").alias("row"), F.col(label).cast("int").alias("label"), (F.col(weight) if weight else F.lit(1.0)).cast("double").alias("weight"), values.alias("x"), *([F.col(fold).cast("int").alias("fold")] if fold else []))
    ideal = np.cumsum(discounts(s.top)).tolist()
    sizes = rows.groupBy("query").agg(F.sum("label").alias("positives"), F.count("*").alias("size"), (F.min("label") >= 0).alias("__low"), (F.max("label") <= 1).alias("__high")).where("positives > 0 and positives < size")
    whole = (F.col("size") <= WHOLE) & F.col("__low") & F.col("__high")
    sizes = sizes.select("query", F.element_at(F.array(*map(F.lit, ideal)), F.least("positives", F.lit(s.top)).cast("int")).alias("ideal"), "size", whole.alias("whole")).persist()
    seeds = range(len(s.seeds))
    counts = {r["whole"]: r for r in sizes.groupBy("whole").agg(F.sum("size").alias("rows"), F.count("*").alias("queries")).collect()}  # two rows at most
    blocks = _blocks(rows, sizes, counts[True]["rows"], False in counts, edges).persist() if True in counts else None
    base = _binned(rows.join(sizes.where("not whole").select("query", "ideal"), "query"), edges, len(seeds)).persist() if False in counts else None
    if blocks is not None and base is None:
        held = blocks.agg(F.sum(sum((F.length(c) for c in _names(_BLOCK)[1:]), F.size("names") * 64))).first()[0]
        if held <= SENT:
            alone = _grown_alone(blocks, edges, s)
            for df in (blocks, sizes):
                df.unpersist()
            return alone
    trees: list[list[list[dict]]] = [[] for _ in seeds]
    since = 0
    for t in range(s.trees):
        later = [x[since:] for x in trees]
        in_blocks = _block_statistics(blocks, later, edges, s, t).persist() if blocks is not None else None
        scored = statistics = None
        if base is not None:
            scored = _scored(base, later, edges).persist()
            statistics = _statistics(scored.join(_best(scored, s.top, len(seeds)), "query"), len(edges), s, t).persist()
        splits = lambda trees, open_nodes, chosen, of=(statistics, in_blocks): _splits(of[0], trees, open_nodes, chosen, edges, s, of[1])
        for k, tree in enumerate(_grown(splits, edges, s, t)):
            trees[k].append(tree)
        for df in (statistics, in_blocks):
            if df is not None:
                df.unpersist()
        if (t + 1) % s.kept_after == 0 and t + 1 < s.trees:
            later = [x[since:] for x in trees]
            if base is not None:
                kept = cut(_scored(base, later, edges))
                base.unpersist()
                base = kept
            if blocks is not None:
                kept = cut(_block_scored(blocks, later, edges))
                blocks.unpersist()
                blocks = kept
            since = t + 1
        if scored is not None:
            scored.unpersist()
    for df in (base, blocks, sizes):
        if df is not None:
            df.unpersist()
    return trees


def quantile_edges(df: DataFrame, features: list[str], bins: int) -> list[list[float]]:
    """At most bins - 1 numbers for each feature."""
    shares = [k / bins for k in range(1, bins)]
    return [sorted(set(q)) for q in df.select(*[F.col(c).cast("double") for c in features]).approxQuantile(features, shares, 1 / (4 * bins))]


def _binned(rows: DataFrame, edges: list[list[float]], seeds: int) -> DataFrame:
    """The rows with a byte for each feature: how many edges are below the value, NaN being below all; and scores of 0."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            x = np.asarray(batch.column(batch.schema.get_field_index("x")).flatten()).reshape(-1, len(edges))
            bins = np.stack([np.where(np.isnan(x[:, k]), 0, np.searchsorted(e, x[:, k])) for k, e in enumerate(edges)], axis=1).astype(np.uint8)
            keep = [batch.column(batch.schema.get_field_index(c)) for c in ("query", "row", "label", "weight", "ideal")]
            scores = pa.array([[0.0] * seeds] * len(x), pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([*keep, pa.array([b.tobytes() for b in bins], pa.binary()), scores, *[batch.column(batch.schema.get_field_index(c)) for c in more]], ["query", "row", "label", "weight", "ideal", "bins", "scores", *more])

    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    more = [c for c in ("fold",) if c in kinds]
    return rows.mapInArrow(run, f"query {kinds['query']}, row long, label int, weight double, ideal double, bins binary, scores array<double>" + "".join(f", {c} int" for c in more))


def _leaves(bins: np.ndarray, nodes: list[dict], edges: list[list[float]]) -> np.ndarray:
    """The node where each row of bins ends in a tree that may still grow."""
    at = np.zeros(len(bins), np.int64)
    for k, n in enumerate(nodes):  # children come after their parents
        if "feature" in n:
            here = at == k
            at[here] = np.where(bins[here, n["feature"]] <= n["bin"], n["left"], n["right"])
    return at


def _stepped(bins: np.ndarray, at: np.ndarray, nodes: list[dict]) -> np.ndarray:
    """The nodes where rows at nodes `at` go, one level down; those in leaves stay."""
    feature, bar, left, right = (np.array([n.get(c, -1) for n in nodes]) for c in ("feature", "bin", "left", "right"))
    own = feature[at]
    return np.where(own < 0, at, np.where(bins[np.arange(len(bins)), own] <= bar[at], left[at], right[at]))


def _bins_of(batch, name: str = "bins") -> np.ndarray:
    column = batch.column(batch.schema.get_field_index(name))
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(len(column), -1)


def _scored(base: DataFrame, trees: list[list[list[dict]]], edges: list[list[float]]) -> DataFrame:
    if not any(trees):
        return base

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            if not batch.num_rows:
                continue
            bins = _bins_of(batch)
            scores = np.asarray(batch.column(6).flatten()).reshape(len(bins), -1).copy()
            for k, own in enumerate(trees):
                for nodes in own:
                    scores[:, k] += np.array([n.get("value", 0.0) for n in nodes])[_leaves(bins, nodes, edges)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:6], pa.array(list(scores), pa.list_(pa.float64())), *batch.columns[7:]], batch.schema.names)

    return base.mapInArrow(run, base.schema)


def _best(scored: DataFrame, top: int, seeds: int) -> DataFrame:
    """query, best: for each seed its query's top rows by score (ties: the smaller row). A task hands on no more than top rows of a query."""

    def run(batches):
        import pandas as pd

        kept, pruned = pd.DataFrame(), 0
        for batch in batches:
            pdf = batch.select(["query", "row", "label", "bins"]).to_pandas()
            scores = np.asarray(batch.column(batch.schema.get_field_index("scores")).flatten()).reshape(len(pdf), -1)
            parts = [pdf[["query", "row", "label", "bins"]].assign(seed=k, less=-scores[:, k]) for k in range(seeds)]
            kept = pd.concat([kept, *parts])
            if len(kept) > 2 * pruned + 200_000:
                kept = _cut(kept, top)
                pruned = len(kept)
        yield _cut(kept, top)[["query", "seed", "less", "row", "label", "bins"]] if len(kept) else pd.DataFrame(columns=["query", "seed", "less", "row", "label", "bins"])

    def in_arrow(batches):
        import pyarrow as pa

        for pdf in run(batches):
            yield from pa.Table.from_pandas(pdf, schema=schema, preserve_index=False).to_batches()

    def of_seed(k: int):
        return lambda x: x["seed"] == k

    from pyspark.sql.pandas.types import to_arrow_schema

    kind = scored.schema["query"].dataType.simpleString()
    spec = f"query {kind}, seed int, less double, row long, label int, bins binary"
    schema = to_arrow_schema(scored.sparkSession.createDataFrame([], spec).schema)
    local = scored.mapInArrow(in_arrow, spec)
    gathered = local.groupBy("query").agg(F.sort_array(F.collect_list(F.struct("seed", "less", "row", "label", "bins"))).alias("all"))
    best = [F.slice(F.filter("all", of_seed(k)), 1, top) for k in range(seeds)]
    return gathered.select("query", F.concat(*best).alias("best"))


def _cut(pdf, top: int):
    pdf = pdf.sort_values(["query", "seed", "less", "row"])
    return pdf[pdf.groupby(["query", "seed"], sort=False).cumcount() < top]


def _grown(splits: Callable[..., dict], edges: list[list[float]], s: Settings, t: int) -> list[list[dict]]:
    """A tree for each seed, grown level by level by what splits(trees, open nodes, chosen features) finds, as _splits() gives it."""
    seeds = range(len(s.seeds))
    trees: list[list[dict]] = [[{}] for _ in seeds]
    chosen = [np.random.default_rng([seed, t]).permutation(len(edges))[: max(1, round(s.features * len(edges)))] for seed in s.seeds]
    open_nodes = [{0} for _ in seeds]
    value = lambda g, h: -s.rate * g / (h + s.l2) if h + s.l2 > 0 else 0.0
    for level in range(max(s.depth, 1)):
        found: dict[tuple[int, int], list[dict]] = {}
        for (k, node, _), split in splits(trees, open_nodes, chosen).items():
            found.setdefault((k, node), []).append(split)
        more = False
        for k in seeds:
            for node in sorted(open_nodes[k]):
                options = found.get((k, node))
                if not options:
                    trees[k][node]["value"] = 0.0
                    continue
                best = max((o for o in options if o["gain"] > 1e-12), key=lambda o: (o["gain"], -o["feature"]), default=None)
                if not s.depth or best is None:
                    trees[k][node]["value"] = value(options[0]["g"], options[0]["h"])
                    continue
                left = len(trees[k])
                trees[k][node] |= {"feature": best["feature"], "bin": best["bin"], "threshold": edges[best["feature"]][best["bin"]], "left": left, "right": left + 1, "nan_left": True}
                # The last leaves take their sums from the split's sides.
                last = level + 1 == s.depth
                trees[k] += [{"value": value(best[f"g_{side}"], best[f"h_{side}"])} if last else {} for side in ("left", "right")]
                more = more or not last
            open_nodes[k] = {n for n, x in enumerate(trees[k]) if not x}
        if not more:
            break
    return trees


_SPLIT = ("node", "feature", "bin", "gain", "g", "h", "g_left", "h_left", "g_right", "h_right")


def _best_of(sums: np.ndarray, nodes: list[int], features, edges: list[list[float]], s: Settings) -> list[tuple]:
    """_SPLIT of each node and feature with any sums; sums: (node, feature, bin, gradient or curvature or count)."""
    rows, width = [], sums.shape[2]
    for i, f in ((i, f) for i in range(len(nodes)) for f in features.tolist()):
        if not sums[i, f].any():
            continue
        g, h, count = sums[i, f].T
        gl, hl, cl = np.cumsum(g)[:-1], np.cumsum(h)[:-1], np.cumsum(count)[:-1]
        gain = gl**2 / (hl + s.l2) + (g.sum() - gl) ** 2 / (h.sum() - hl + s.l2) - g.sum() ** 2 / (h.sum() + s.l2)
        gain[(cl < s.least_rows) | (count.sum() - cl < s.least_rows) | (np.arange(width - 1) >= len(edges[f]))] = 0
        at = int(np.argmax(gain)) if len(gain) else 0
        sides = [float(x.sum()) for x in (g[: at + 1], h[: at + 1], g[at + 1 :], h[at + 1 :])]
        rows.append((nodes[i], f, at, float(gain[at]) if len(gain) else 0.0, float(g.sum()), float(h.sum()), *sides))
    return rows


def _splits(statistics: DataFrame | None, trees, open_nodes, chosen, edges, s: Settings, blocks: DataFrame | None = None) -> dict:
    """(seed, node, feature) -> the best split there, with the node's sums. Each task adds up its own histograms, a row for each seed; theirs add up by seed."""
    width = max((len(e) for e in edges), default=0) + 1
    names = [sorted(x) for x in open_nodes]
    out = "seed int, " + ", ".join(f"{c} {'int' if i < 3 else 'double'}" for i, c in enumerate(_SPLIT))

    # (bins, gradient, curvature, count) of the rows that a member's tree sees.
    def of_rows(batch):
        bins, sums = _bins_of(batch), np.moveaxis(np.asarray(batch.column(1).flatten()).reshape(batch.num_rows, len(names), 3), 0, 2)
        yield lambda k: (bins, *sums[k])

    def of_blocks(batch):
        for held, seen, sums in zip(*batch.columns, strict=True):
            bins = np.frombuffer(held.as_buffer(), np.uint8).reshape(-1, len(edges))
            seen = np.frombuffer(seen.as_buffer(), bool).reshape(len(names), -1)
            ends = 2 * np.cumsum(seen.sum(axis=1))
            sums = np.split(np.frombuffer(sums.as_buffer()), ends[:-1])
            yield lambda k, bins=bins, seen=seen, sums=sums: (bins[seen[k]], *sums[k].reshape(2, -1), None)

    def add(batches, parts_of):
        import pyarrow as pa

        total = [np.zeros((len(n), len(edges), width, 3)) for n in names]
        for part in (part for batch in batches if batch.num_rows for part in parts_of(batch)):
            for k, nodes in enumerate(names):
                if nodes:
                    bins, *sums = part(k)
                    _fill(total[k], bins, _leaves(bins, trees[k], edges), nodes, chosen[k], *sums)
        held = [k for k, x in enumerate(total) if x.any()]
        yield pa.RecordBatch.from_arrays([pa.array(held, pa.int32()), pa.array([total[k].tobytes() for k in held], pa.binary())], ["seed", "cells"])

    def split(batches):
        import pyarrow as pa

        sums: dict = {}
        for batch in batches:
            for k, cells in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                sums[k] = sums.get(k, 0) + np.frombuffer(cells.as_buffer()).reshape(len(names[k]), len(edges), width, 3)
        rows = [(k, *r) for k, cells in sums.items() for r in _best_of(cells, names[k], chosen[k], edges, s)]
        types = [pa.int32()] * 4 + [pa.float64()] * 7
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], x) for i, x in enumerate(types)], [c.split()[0] for c in out.split(", ")])

    def added(df: DataFrame, parts_of):
        return df.mapInArrow(lambda batches: add(batches, parts_of), "seed int, cells binary")

    found = [added(df, of) for df, of in ((statistics, of_rows), (blocks, of_blocks)) if df is not None]
    if not found:
        return {}
    parts = (found[0].unionByName(found[1]) if len(found) > 1 else found[0]).repartition("seed")
    got = parts.mapInArrow(split, out).collect()  # seeds x open nodes x features
    return {(r.seed, r.node, r.feature): r.asDict() for r in got}


def _sampled(query_codes: np.ndarray, queries, seed: int, t: int, share: float) -> np.ndarray:
    """Which queries a tree of a seed sees: decided by a checksum of the query's text, so that a rerun agrees."""
    import zlib

    seen = np.array([zlib.crc32(f"{seed}:{t}:{q}".encode()) < share * 2**32 for q in queries])
    return seen[query_codes]


_BLOCK = "names array<binary>, sizes binary, labels binary, weights binary, ideals binary, folds binary, bins binary, scores binary"


def _blocks(rows: DataFrame, sizes: DataFrame, n_rows: int, others: bool, edges: list[list[float]]) -> DataFrame:
    """A row for about BLOCK rows of queries that lie whole in it: by query its id as text, size, weight, ideal and fold (where rows have one), by row label, bins and scores (empty: 0). Rows of a query go by their number."""
    n = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(-(-n_rows // ROWS), MOST_PARTS))
    if others:  # before they are dealt: those may have any number of rows
        rows = rows.join(sizes.where("whole").select("query"), "query", "left_semi")
    dealt = rows.repartition(n, "query").join(sizes.where("whole").select("query", "ideal").repartition(n, "query"), "query")
    dealt = dealt.sortWithinPartitions("query", "row").select("query", "label", "weight", "ideal", "x", *[c for c in rows.columns if c == "fold"])

    def pack(table):
        import pyarrow as pa

        query = table.column("query").combine_chunks()
        first = _starts(query)
        x = np.asarray(table.column("x").combine_chunks().flatten()).reshape(len(query), -1)
        bins = np.stack([np.where(np.isnan(x[:, k]), 0, np.searchsorted(e, x[:, k])) for k, e in enumerate(edges)], axis=1).astype(np.uint8)
        weight, ideal = (np.asarray(table.column(c))[first] for c in ("weight", "ideal"))
        fold = np.asarray(table.column("fold"))[first].astype(np.int32) if "fold" in table.column_names else np.zeros(0, np.int32)
        held = [np.diff(np.append(first, len(query))).astype(np.int32), np.asarray(table.column("label")).astype(np.uint8), weight, ideal, fold, bins]
        names = pa.array([[str(q).encode() for q in query.take(pa.array(first)).to_pylist()]], pa.list_(pa.binary()))
        return pa.RecordBatch.from_arrays([names, *[pa.array([v.tobytes()], pa.binary()) for v in [*held, np.zeros(0)]]], _names(_BLOCK))

    def run(batches):
        import pyarrow as pa

        kept: list = []
        for batch in batches:
            if batch.num_rows:
                kept.append(batch)
            if sum(b.num_rows for b in kept) >= BLOCK:
                table = pa.Table.from_batches(kept)
                first = _starts(table.column("query").combine_chunks())
                last = int(first[-1])  # the last query may go on
                cuts = np.unique([0, *first[np.searchsorted(first, np.arange(BLOCK, last, BLOCK))], last])
                for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                    yield pack(table.slice(int(a), int(b - a)))
                kept = table.slice(last).to_batches()
        if kept:
            yield pack(pa.Table.from_batches(kept))

    return dealt.mapInArrow(run, _BLOCK)


def _names(schema: str) -> list[str]:
    return [c.split()[0] for c in schema.split(", ")]


def _starts(query) -> np.ndarray:
    """Where each query of a sorted Arrow array begins."""
    codes = np.asarray(query.dictionary_encode().indices)
    return np.flatnonzero(np.concatenate(([True], codes[1:] != codes[:-1])))


def _numbers_of(batch, name: str, k: int, kind=np.float64) -> np.ndarray:
    return np.frombuffer(batch.column(batch.schema.get_field_index(name))[k].as_buffer(), kind)


def _block_scores(batch, k: int, bins: np.ndarray, trees: list[list[list[dict]]], edges: list[list[float]]) -> np.ndarray:
    """For each seed its scores of a block's rows: the kept ones and those of the trees since."""
    kept = _numbers_of(batch, "scores", k)
    scores = kept.reshape(len(trees), -1).copy() if len(kept) else np.zeros((len(trees), len(bins)))
    for own, into in zip(trees, scores, strict=True):
        for nodes in own:
            into += np.array([n.get("value", 0.0) for n in nodes])[_leaves(bins, nodes, edges)]
    return scores


def _block_scored(blocks: DataFrame, trees: list[list[list[dict]]], edges: list[list[float]]) -> DataFrame:
    def run(batches):
        import pyarrow as pa

        for batch in batches:
            scores = []
            for k in range(batch.num_rows):
                bins = _numbers_of(batch, "bins", k, np.uint8).reshape(-1, len(edges))
                scores.append(_block_scores(batch, k, bins, trees, edges).tobytes())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(scores, pa.binary())], batch.schema.names)

    return blocks.mapInArrow(run, _BLOCK)


def _block_statistics(blocks: DataFrame, trees: list[list[list[dict]]], edges: list[list[float]], s: Settings, t: int) -> DataFrame:
    """bins, seen, sums of each block: for each seed which rows its tree sees, and these rows' gradients and curvatures, one seed after another."""
    apart = np.array(getattr(s, "without", ()))

    def run(batches):
        import zlib

        import pyarrow as pa

        for batch in batches:
            for k in range(batch.num_rows):
                bins = _numbers_of(batch, "bins", k, np.uint8).reshape(-1, len(edges))
                names = batch.column(0)[k].as_py()
                starts = [zlib.crc32(f"{seed}:{t}:".encode()) for seed in s.seeds]
                seen = np.array([[zlib.crc32(q, c) for q in names] for c in starts]) < s.queries * 2**32  # as _sampled
                if len(apart):
                    seen &= _numbers_of(batch, "folds", k, np.int32) != apart[:, None]
                sizes, labels = _numbers_of(batch, "sizes", k, np.int32), _numbers_of(batch, "labels", k, np.uint8)
                sums = _whole_pairs(sizes, labels, _numbers_of(batch, "weights", k), _numbers_of(batch, "ideals", k), _block_scores(batch, k, bins, trees, edges), seen, s.top)
                seen = np.repeat(seen, sizes, axis=1)
                held = b"".join(x[:, on].tobytes() for x, on in zip(sums, seen, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array([x], pa.binary()) for x in (bins.tobytes(), seen.tobytes(), held)], ["bins", "seen", "sums"])

    return blocks.mapInArrow(run, "bins binary, seen binary, sums binary")


def _whole_pairs(sizes: np.ndarray, labels: np.ndarray, weights: np.ndarray, ideals: np.ndarray, scores: np.ndarray, seen: np.ndarray, top: int) -> np.ndarray:
    """(seed, 2, row): gradient and curvature of the rows of whole queries, which lie one after another; 0 in queries that a seed's tree doesn't see. Each positive row meets its query's others."""
    n, of = len(labels), np.repeat(np.arange(len(sizes)), sizes)
    begin = np.cumsum(sizes) - sizes
    others = np.flatnonzero(labels == 0)
    per_query = np.bincount(of[others], minlength=len(sizes))
    before = np.cumsum(per_query) - per_query
    up = np.flatnonzero(labels == 1)
    times = per_query[of[up]]
    every_one = np.repeat(up, times)
    every_two = others[np.arange(len(every_one)) - np.repeat(np.cumsum(times) - times - before[of[up]], times)]
    query = of[every_one]
    shares = (weights / ideals)[query]
    steps = np.append(discounts(top), 0.0)
    out = np.zeros((len(scores), 2, n))
    for k, own in enumerate(scores):
        met = seen[k][query]
        one, two = every_one[met], every_two[met]
        place = np.empty(n, np.int64)
        place[np.lexsort((-own, of))] = np.arange(n) - begin[of]  # equal scores: in the order of the rows
        step = steps[np.minimum(place, top)]  # 0 for both beyond the cut, so that such a pair adds nothing
        miss = 1 / (1 + np.exp(np.clip(own[one] - own[two], -50, 50)))
        g = np.abs(step[one] - step[two]) * shares[met] * miss
        h = g * (1 - miss)
        out[k, 0] = np.bincount(two, g, n) - np.bincount(one, g, n)
        out[k, 1] = np.bincount(two, h, n) + np.bincount(one, h, n)
    return out


def _grown_alone(blocks: DataFrame, edges: list[list[float]], s: Settings) -> list[list[list[dict]]]:
    """For each seed its trees, as the rounds over `blocks` give them: a task for each seed, which has all blocks (SENT bytes at most)."""
    spark, names = blocks.sparkSession, _names(_BLOCK)
    sent = spark.sparkContext.broadcast([tuple(r[c] for c in names) for r in blocks.collect()])

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for k in batch.column(0).to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array([k]), pa.array([json.dumps(_alone(sent.value, edges, s, k))])], ["id", "trees"])

    n = len(s.seeds)
    got = spark.range(0, n, 1, n).mapInArrow(run, "id long, trees string").collect()  # a seed's trees each
    sent.unpersist()
    return [json.loads(r["trees"]) for r in sorted(got)]


def _alone(blocks: list[tuple], edges: list[list[float]], s: Settings, k: int) -> list[list[dict]]:
    """The trees of seed k from blocks (_BLOCK) at hand."""
    import zlib

    seed, width = s.seeds[k], max((len(e) for e in edges), default=0) + 1
    own = replace(s, seeds=(seed,))
    apart = getattr(s, "without", ())
    held = [(names, *(np.frombuffer(x, kind) for x, kind in zip(rest, (np.int32, np.uint8, float, float, np.int32), strict=True)), np.frombuffer(bins, np.uint8).reshape(-1, len(edges))) for names, *rest, bins, _ in blocks]
    scores, trees = [np.zeros(len(b[-1])) for b in held], []
    for t in range(s.trees):
        start, rows = zlib.crc32(f"{seed}:{t}:".encode()), []
        for (names, sizes, labels, weights, ideals, folds, bins), score in zip(held, scores, strict=True):
            seen = np.array([zlib.crc32(q, start) for q in names]) < s.queries * 2**32  # as _sampled
            if apart:
                seen &= folds != apart[k]
            g, h = _whole_pairs(sizes, labels, weights, ideals, score[None], seen[None], s.top)[0]
            on = np.repeat(seen, sizes)
            rows.append((on, bins[on], g[on], h[on]))
        leaves = [np.zeros(len(b[-1]), np.int64) for b in held]

        def splits(trees, open_nodes, chosen, rows=rows, leaves=leaves):
            nodes = sorted(open_nodes[0])
            sums = np.zeros((len(nodes), len(edges), width, 3))
            for i, (on, bins, g, h) in enumerate(rows):
                leaves[i] = _stepped(held[i][-1], leaves[i], trees[0])
                _fill(sums, bins, leaves[i][on], nodes, chosen[0], g, h, None)
            return {(0, r[0], r[1]): dict(zip(_SPLIT, r, strict=True)) for r in _best_of(sums, nodes, chosen[0], edges, own)}

        (tree,) = _grown(splits, edges, own, t)
        trees.append(tree)
        values = np.array([n.get("value", 0.0) for n in tree])
        for b, at, score in zip(held, leaves, scores, strict=True):
            score += values[_stepped(b[-1], at, tree)]
    return trees


def _statistics(ready: DataFrame, n_features: int, s: Settings, t: int) -> DataFrame:
    """bins, sums: for each seed gradient, curvature and count (1 where the tree sees the query). Rows stand for themselves; further rows
    of count 0 bring a best row what a batch's rows below the cut do to it."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            if batch.num_rows:
                bins, sums = _pairs(batch, n_features, s, t)
                flat = pa.array(sums.reshape(-1))
                offsets = pa.array(np.arange(len(bins) + 1, dtype=np.int32) * (3 * len(s.seeds)))
                yield pa.RecordBatch.from_arrays([pa.array([b.tobytes() for b in bins], pa.binary()), pa.ListArray.from_arrays(offsets, flat)], ["bins", "sums"])

    return ready.mapInArrow(run, "bins binary, sums array<double>")


def _pairs(batch, n_features: int, s: Settings, t: int) -> tuple[np.ndarray, np.ndarray]:
    at = batch.schema.get_field_index
    codes = batch.column(at("query")).dictionary_encode()
    queries, of = codes.dictionary.to_pylist(), np.asarray(codes.indices)
    first = np.unique(of, return_index=True)[1]
    lists = batch.column(at("best")).take(first)  # sorted by seed and place
    of_list, flat = np.repeat(np.arange(len(queries)), np.asarray(lists.value_lengths())), lists.flatten()
    t_seed, t_less, t_rows, t_labels = (np.asarray(flat.field(c)) for c in ("seed", "less", "row", "label"))
    t_all = np.frombuffer(b"".join(flat.field("bins").to_pylist()), np.uint8).reshape(len(flat), -1)
    runs = np.flatnonzero(np.concatenate(([True], (of_list[1:] != of_list[:-1]) | (t_seed[1:] != t_seed[:-1])))) if len(flat) else np.zeros(0, int)
    t_place = np.arange(len(flat)) - np.repeat(runs, np.diff(np.append(runs, len(flat))))
    width = min(s.top, int(t_place.max(initial=0)) + 1)  # no query of the batch has more
    bins, label, row = _bins_of(batch), np.asarray(batch.column(at("label"))), np.asarray(batch.column(at("row")))
    weight, ideal = np.asarray(batch.column(at("weight"))), np.asarray(batch.column(at("ideal")))
    scores = np.asarray(batch.column(at("scores")).flatten()).reshape(len(bins), -1)
    sums = np.zeros((len(bins), len(s.seeds), 3))
    more_bins, more_sums, apart = [bins], [sums], getattr(s, "without", ())
    for k, seed in enumerate(s.seeds):
        mine = t_seed == k
        where = of_list[mine], t_place[mine]
        shape = (len(queries), width)
        t_score, t_label, t_row, there = np.zeros(shape), np.zeros(shape, int), np.zeros(shape, np.int64), np.zeros(shape, bool)
        t_bins = np.zeros((*shape, n_features), np.uint8)
        t_score[where], t_label[where], t_row[where], there[where] = -t_less[mine], t_labels[mine], t_rows[mine], True
        t_bins[where] = t_all[mine]
        own = there[of] & (t_row[of] == row[:, None])
        place = np.where(own.any(axis=1), own.argmax(axis=1), s.top)
        g, h = pair_weights(scores[:, k][:, None], label[:, None], place[:, None], t_score[of], t_label[of], np.arange(width)[None, :], ideal[:, None], s.top)
        seen = _sampled(of, queries, seed, t, s.queries)
        if apart:
            seen &= np.asarray(batch.column(at("fold"))) != apart[k]
        on = there[of] & seen[:, None]
        g, h = np.where(on, g * weight[:, None], 0.0), np.where(on, h * weight[:, None], 0.0)
        sums[:, k] = np.stack([g.sum(axis=1), h.sum(axis=1), seen], axis=1)
        below = place == s.top  # their pairs seen from the other side
        if below.any():
            back = np.zeros((*shape, 3))
            np.add.at(back[:, :, 0], of[below], -g[below])
            np.add.at(back[:, :, 1], of[below], h[below])
            some = (back != 0).any(axis=2)
            part = np.zeros((int(some.sum()), len(s.seeds), 3))
            part[:, k] = back[some]
            more_bins.append(t_bins[some])
            more_sums.append(part)
    return np.concatenate(more_bins), np.concatenate(more_sums)


def _fill(into: np.ndarray, bins: np.ndarray, leaf: np.ndarray, nodes: list[int], features, g: np.ndarray, h: np.ndarray, count: np.ndarray | None) -> None:
    """count: None where each row counts 1."""
    places = np.full(max(nodes[-1], int(leaf.max(initial=0))) + 1, -1)
    places[nodes] = np.arange(len(nodes))
    place, width = places[leaf], into.shape[2]
    on = np.flatnonzero(place >= 0)
    sums = [v[on] if v is not None else None for v in (g, h, count)]
    for f in features:
        cell = place[on] * width + bins[on, f]
        for n, v in enumerate(sums):
            into[:, f, :, n] += np.bincount(cell, v, len(nodes) * width).reshape(len(nodes), width)
