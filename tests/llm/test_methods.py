"""Operators against brute force, planted cases and held-out accuracy."""

import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from corvane.llm import bm25, boosting, doc_stats, jaccard_join, license_scan, mixing, quality_rank, quality_rules, signature_tree, toxicity, warc

BIG = "/root/testdata/sf0.01"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def read(spark, name, where=BIG):
    return spark.read.parquet(f"{where}/{name}.parquet")


def shingles(text, words):
    own = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(tuple(own[k : k + words]) for k in range(len(own) - words + 1)) if len(own) >= words else frozenset([tuple(own)] if own else [])


def components(rows, words, percent):
    """Brute force: id -> (set size, smallest id of the component)."""
    sets = [(i, shingles(t, words)) for i, t in rows]
    up = list(range(len(sets)))

    def find(a):
        while up[a] != a:
            a = up[a]
        return a

    holders = defaultdict(list)
    for k, (_, s) in enumerate(sets):
        shared = Counter(j for g in s for j in holders[g])
        for g in s:
            holders[g].append(k)
        for j, n in shared.items():
            if 100 * n >= percent * (len(s) + len(sets[j][1]) - n):
                a, b = find(k), find(j)
                up[max(a, b)] = min(a, b)
    least = defaultdict(lambda: 1 << 60)
    for k, (i, _) in enumerate(sets):
        least[find(k)] = min(least[find(k)], i)
    return {i: (len(s), least[find(k)]) for k, (i, s) in enumerate(sets)}


@pytest.mark.parametrize(("words", "percent"), [(4, 85), (5, 80)])
def test_jaccard_components(spark, words, percent):
    docs = read(spark, "documents")
    want = components([(r["doc_id"], r["text"]) for r in docs.collect()], words, percent)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_join.jaccard_components(docs, words, percent).collect()}
    assert got == want


@pytest.mark.parametrize("percent", [20, 50, 80, 95])
def test_jaccard_at_any_threshold(spark, percent, monkeypatch):
    """Sets of very different sizes link where the threshold allows it; blocks of several parts."""
    monkeypatch.setattr(jaccard_join, "PART_SETS", 8)
    rng = random.Random(percent)
    rows = []
    for _ in range(40):
        base = [f"w{rng.randrange(10**6)}" for _ in range(rng.choice([12, 60, 403, 900]))]
        for _ in range(rng.randrange(1, 8)):
            rows.append((len(rows), " ".join(base[: int(len(base) * rng.choice([0.22, 0.3, 0.5, 0.55, 0.82, 0.97, 1.0]))])))
    rng.shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_join.jaccard_components(docs, 3, percent).collect()}
    assert got == components(rows, 3, percent)


def test_large_block_is_split_and_whole(spark, monkeypatch):
    """A block over many parts, with members that only other parts connect."""
    monkeypatch.setattr(jaccard_join, "PART_SETS", 16)
    rng = random.Random(3)
    vocabulary = [f"w{k}" for k in range(3000)]
    base = [rng.choice(vocabulary) for _ in range(120)]
    rows = []
    for i in range(150):  # a chain of drifting copies
        for _ in range(2):
            base[rng.randrange(len(base))] = rng.choice(vocabulary)
        rows.append((i, " ".join(base)))
    passage = [rng.choice(vocabulary) for _ in range(60)]
    rows += [(1000 + i, " ".join([rng.choice(vocabulary) for _ in range(40)] + passage)) for i in range(80)]
    rng.shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_join.jaccard_components(docs, 4, 85).collect()}
    assert got == components(rows, 4, 85)


def test_signature_tree_against_all_pairs():
    rng = np.random.default_rng(1)
    sets = []
    for _ in range(60):
        base = rng.integers(0, 1 << 62, rng.integers(1, 200), dtype=np.uint64)
        for _ in range(rng.integers(1, 5)):
            own = base.copy()
            own[: rng.integers(0, max(1, len(own) // 8) + 1)] += np.uint64(1)
            sets.append(np.unique(own))
    forest = signature_tree.Forest(sets, 85)
    root = forest.tree(list(range(len(sets))))
    forest.traverse(root, root)
    linked = {(i, j) for i in range(len(sets)) for j in range(i) if 100 * len(np.intersect1d(sets[i], sets[j])) >= 85 * len(np.union1d(sets[i], sets[j]))}
    plain = signature_tree.Components(len(sets))
    for i, j in linked:
        plain.join(i, j)
    assert [plain.find(i) for i in range(len(sets))] == [forest.components.find(i) for i in range(len(sets))]
    alive = signature_tree.Possible([signature_tree.bitmap(s) for s in sets], [len(s) for s in sets], 85).alive
    assert all(alive[i] and alive[j] for i, j in linked)


def brute_search(rows, asked, k=10):
    """(query, rank) -> (id, score) of all (id, text), every document scored; ties go to the smaller id."""
    texts = [(i, Counter(re.findall(r"[0-9a-z\x80-\U0010ffff]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")))) for i, t in rows]
    n, df = len(texts), Counter(t for _, c in texts for t in c)
    mean = sum(sum(c.values()) for _, c in texts) / n
    out = {}
    for q, own in asked:
        words = Counter(re.findall(r"[0-9a-z\x80-\U0010ffff]+", re.sub("[A-Z]", lambda m: m[0].lower(), own or "")))
        scores = []
        for i, c in texts:
            length = sum(c.values())
            s = sum(f * np.log1p((n - df[t] + 0.5) / (df[t] + 0.5)) * c[t] * 2.2 / (c[t] + 1.2 * (0.25 + 0.75 * length / mean)) for t, f in words.items() if t in c)
            scores += [(-round(s, 7), i)] if s > 0 else []
        out |= {(q, r): (i, -s) for r, (s, i) in enumerate(sorted(scores)[:k], 1)}
    return out


@pytest.mark.parametrize("options", [{}, {"shard_bytes": 60_000}, {"shard_bytes": 200_000, "asked_terms": 1000}])
def test_search_against_brute_force(spark, options):
    """Ids, ranks and scores; one shard and many, one block of queries and several."""
    docs = read(spark, "documents", "/root/testdata/sf0.001")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    want = brute_search(rows, [r for r in rows if r[0] % 5 == 0])
    got = {(r["query_id"], r["rank"]): (r["doc_id"], r["score"]) for r in bm25.search(docs, docs.where("doc_id % 5 = 0"), **options).collect()}
    assert {k: v[0] for k, v in got.items()} == {k: v[0] for k, v in want.items()}
    assert all(abs(v[1] - want[k][1]) <= 1e-6 * v[1] for k, v in got.items())


def test_search_ties_and_long_texts(spark):
    """Equal documents at the last rank go by id, across shards; a very long text is a query like others."""
    rng = random.Random(6)
    long = " ".join(f"w{rng.randrange(3000)}" for _ in range(50_000))
    rows = [(i, "alpha beta gamma") for i in range(40, 0, -1)] + [(100 + i, f"alpha w{i}") for i in range(30)] + [(500, long), (501, long + " omega")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    asked = [(1, "alpha beta gamma"), (500, long)]
    want = brute_search(rows, asked)
    got = {(r["query_id"], r["rank"]): r["doc_id"] for r in bm25.search(docs, spark.createDataFrame(asked, "doc_id long, text string"), shard_bytes=150).collect()}
    assert got == {k: v[0] for k, v in want.items()}
    assert [got[1, r] for r in range(1, 11)] == list(range(1, 11))


def brute_stats(text):
    text = text or ""
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    windows = [tuple(words[k : k + 3]) for k in range(len(words) - 2)]
    times = Counter(windows)
    hit = {j for k, w in enumerate(windows) if times[w] > 1 for j in range(k, k + 3)}
    return len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), sum(1 for k, x in enumerate(lines) if x in lines[:k]), len(hit)


def test_base_statistics(spark):
    rows = [r["text"] for r in read(spark, "documents").limit(300).collect()]
    rows += [None, "", "a b a b a b", "x\x0by\x1cz  q", "l\nl\n\n \nl", "é é é é #|<", "a b c a b c a b", "a\rb\x85c"]
    assert [doc_stats.base(t)[:5] for t in rows] == [brute_stats(t) for t in rows]


def held_out(i):
    return zlib.crc32(str(i).encode()) % 5 == 0


def test_quality_of_held_out_rows(spark):
    docs, labels = read(spark, "documents", "/root/testdata/sf0.1"), read(spark, "labels", "/root/testdata/sf0.1")
    truth = {r["doc_id"]: r["quality"] for r in labels.collect()}
    scored = [r for r in quality_rank.score(docs, quality_rank.fit(docs, labels)).collect() if r["doc_id"] in truth]
    assert all(r["held_out"] == held_out(r["doc_id"]) for r in scored)
    test = [r for r in scored if r["held_out"]]
    assert np.mean([r["predicted"] == truth[r["doc_id"]] for r in test]) > 0.97
    kept = {r["doc_id"]: r for r in quality_rules.apply_rules(docs, quality_rules.fit(docs, labels)).collect()}
    test = [kept[i] for i in truth if held_out(i) and not kept[i]["base_failed"]]
    assert np.mean([r["kept"] == truth[r["doc_id"]] for r in test]) > 0.97


def test_toxicity_of_held_out_rows(spark):
    docs, labels = read(spark, "documents", "/root/testdata/sf0.1"), read(spark, "labels", "/root/testdata/sf0.1")
    truth = {r["doc_id"]: r["toxic"] for r in labels.collect()}
    got = {r["doc_id"]: r for r in toxicity.score(docs, toxicity.fit(docs, labels)).collect()}
    toxic = [got[i]["toxic"] for i, y in truth.items() if y and held_out(i)]
    clean = [got[i]["toxic"] for i, y in truth.items() if not y and held_out(i)]
    assert np.mean(toxic) > 0.85 and np.mean(clean) < 0.01


def test_chain_feeds_later_models():
    rng = np.random.default_rng(0)
    x = (rng.random((600, 6)) < 0.3).astype(float)
    y = np.stack([x[:, 0], x[:, 0] * x[:, 1], np.maximum(x[:, 0], x[:, 2])], axis=1)
    weights = toxicity.fit_chain(x, y, np.arange(600) % 5)
    assert [len(w) for w in weights] == [7, 8, 9]
    p = toxicity.Chain({}, ("a", "b", "c"), weights).predict(x)
    assert ((p > 0.5) == (y > 0.5)).mean() > 0.98


def test_chain_against_brute_force(spark):
    """The terms by plain counts, the kinds as a partition of the toxic rows, the folds and the models by their optimality, the scores by loops."""
    docs, labels = read(spark, "documents"), read(spark, "labels")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    truth = {r["doc_id"]: r["toxic"] for r in labels.collect() if r["toxic"] is not None and not held_out(r["doc_id"]) and r["doc_id"] in texts}
    chain = toxicity.fit(docs, labels)
    words = {i: toxicity.words(texts[i]) for i in truth}
    n, hot = len(truth), sum(truth.values())
    a = Counter(w for i, own in words.items() if truth[i] for w in own)
    m = Counter(w for own in words.values() for w in own)
    strength = {w: (a[w] * n - m[w] * hot) ** 2 / (m[w] * (n + 1 - m[w])) for w in a if a[w] >= 3 and a[w] * n > m[w] * hot}
    assert sorted(chain.terms) == sorted(sorted(strength, key=lambda w: (-strength[w], w))[: toxicity.TERMS])
    rows = sorted(((zlib.crc32(str(i).encode()), truth[i], words[i] & set(chain.terms)) for i in truth), key=lambda r: (r[0], r[1], sorted(r[2])))
    x, folds = chain.matrix([own for *_, own in rows]), np.array([h // 5 % toxicity.FOLDS for h, *_ in rows])
    toxic = np.array([t for _, t, _ in rows], dtype=float)
    kind = toxicity.kinds_of(x[toxic == 1], toxicity.KINDS)
    y = np.stack([*(np.bincount(np.flatnonzero(toxic)[kind == k], minlength=n) for k in range(toxicity.KINDS)), toxic], axis=1).astype(float)
    assert (y[:, :-1].sum(axis=1) == toxic).all()
    everyone = [words[i] for i in sorted(truth, key=lambda i: (zlib.crc32(str(i).encode()), truth[i]))]

    def without(out, k):
        """Category k's model without the folds: terms, kinds and inputs of its own rows alone; (terms, weights of 0 to k)."""
        on = [i for i in range(n) if folds[i] not in out]
        hot, a, m = sum(toxic[i] for i in on), Counter(w for i in on if toxic[i] for w in everyone[i]), Counter(w for i in on for w in everyone[i])
        gap = {w: a[w] * len(on) - m[w] * hot for w in a if a[w] >= 3}
        by = {w: g * g / (m[w] * (len(on) + 1 - m[w])) for w, g in gap.items() if g > 0}
        own_terms = sorted(sorted(by, key=lambda w: (-by[w], w))[: toxicity.TERMS])
        own_x = np.array([[float(t in everyone[i]) for t in own_terms] for i in on])
        hot_rows = [p for p, i in enumerate(on) if toxic[i]]
        own_kind = toxicity.kinds_of(own_x[hot_rows], toxicity.KINDS)
        if out:
            whole = dict(zip(np.flatnonzero(toxic).tolist(), kind.tolist(), strict=True))
            same = sum(own_kind[p] == whole[on[r]] for p, r in enumerate(hot_rows))
            if 2 * same < len(hot_rows):
                own_kind = 1 - own_kind
        seen, fits = np.zeros((len(on), 0)), []
        for j in range(k + 1):
            target = np.zeros(len(on))
            for p, r in enumerate(hot_rows):
                target[r] = 1 if j == toxicity.KINDS else own_kind[p] == j
            fits.append((np.hstack([own_x, seen]), target))
            if j < k:
                column = np.zeros(len(on))
                for f in {folds[i] for i in on}:
                    other_terms, models = without(out | {int(f)}, j)
                    for r, i in enumerate(on):
                        if folds[i] == f:
                            at = [float(t in everyone[i]) for t in other_terms]
                            for w in models:
                                at.append(toxicity.probabilities(np.array([at]), w)[0])
                            column[r] = at[-1]
                seen = np.hstack([seen, column[:, None]])
        return own_terms, [toxicity.fit_logistic(v, y) for v, y in fits]

    root_terms, weights = without(frozenset(), toxicity.KINDS)
    assert root_terms == list(chain.terms) and len(weights) == len(chain.weights)
    for k, (w, own) in enumerate(zip(weights, chain.weights, strict=True)):
        assert len(own) == len(chain.terms) + k + 1 and np.allclose(w, own, atol=1e-6)
    p = np.array([1 / (1 + np.exp(-(sum(r * c for r, c in zip(row, chain.weights[0])) + chain.weights[0][-1]))) for row in x])
    assert np.abs(x.T @ (p - y[:, 0]) + 0.3 * chain.weights[0][:-1]).max() < 1e-2  # at the least of the penalised loss its gradient is nothing
    for r in toxicity.score(docs, chain).collect():
        own, ps = toxicity.words(texts[r["doc_id"]]), []
        for w in chain.weights:
            ps.append(1 / (1 + np.exp(-(sum(w[i] for t, i in chain.terms.items() if t in own) + sum(p * w[len(chain.terms) + j] for j, p in enumerate(ps)) + w[-1]))))
        assert np.allclose([r[f"p_{c}"] for c in chain.categories], ps) and r["toxic"] == int(ps[-1] >= toxicity.THRESHOLD)


def test_kinds_split_what_is_unlike():
    rng = np.random.default_rng(3)
    x = np.zeros((90, 8))
    x[:60, :4] = rng.random((60, 4)) < 0.8
    x[60:, 4:] = rng.random((30, 4)) < 0.8
    x = x[x.sum(axis=1) > 0]
    kind = toxicity.kinds_of(x, 2)
    assert (kind == (x[:, 4:].sum(axis=1) > 0)).all()
    assert toxicity.kinds_of(x[:0], 2).tolist() == [] and set(toxicity.kinds_of(x[:1], 2)) == {0}


def test_ranker_against_brute_force(spark):
    """Pairs, loss and cut by loops: the weights are where the loss of the pairs is least, the scores follow from them."""
    docs, labels = read(spark, "documents"), read(spark, "labels")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    truth = {r["doc_id"]: r["quality"] for r in labels.collect() if r["quality"] is not None and not held_out(r["doc_id"]) and r["doc_id"] in texts}
    ranker = quality_rank.fit(docs, labels)
    rows = sorted((truth[i], doc_stats.features(doc_stats.base(texts[i]))) for i in truth)
    rows.sort(key=lambda r: (r[0], r[1][::-1]))
    f = [[*x, *(min(max(v, 0), 1) ** 0.5 for v in x)] for _, x in rows]
    f = [[(v - mu) / sd for v, mu, sd in zip(x, ranker.mean, ranker.scale)] for x in f]
    good, bad = [x for (y, _), x in zip(rows, f) if y == 1], [x for (y, _), x in zip(rows, f) if y == 0]
    step = max(1, len(good) // quality_rank.PAIRS)
    pairs = [[g - b for g, b in zip(good[(7 * i + k * step) % len(good)], bad[i])] for i in range(len(bad)) for k in range(quality_rank.PAIRS)]
    wrong = [1 / (1 + np.exp(sum(d * w for d, w in zip(p, ranker.weights)))) for p in pairs]
    gradient = [-sum(q * p[j] for q, p in zip(wrong, pairs)) / len(pairs) + 1e-3 * ranker.weights[j] for j in range(len(ranker.weights))]
    assert max(map(abs, gradient)) < 1e-5
    raw = sorted(sum(a * b for a, b in zip(x, ranker.weights)) for x in f)
    place = len(bad) / len(rows) * (len(raw) - 1)
    low = int(place)
    assert ranker.cut == pytest.approx(raw[low] + (place - low) * (raw[min(low + 1, len(raw) - 1)] - raw[low]), abs=1e-6)
    for r in quality_rank.score(docs, ranker).collect():
        x = doc_stats.features(doc_stats.base(texts[r["doc_id"]]))
        z = sum((v - mu) / sd * w for v, mu, sd, w in zip([*x, *(min(max(v, 0), 1) ** 0.5 for v in x)], ranker.mean, ranker.scale, ranker.weights))
        s = 1 / (1 + np.exp(-np.clip((z - ranker.cut) * ranker.slope + np.log(0.3 / 0.7), -35, 35)))
        assert r["score"] == pytest.approx(s, abs=1e-6) and r["predicted"] == int(r["score"] >= 0.3) and r["held_out"] == held_out(r["doc_id"])


def test_boosting_is_monotone_and_flat():
    rng = np.random.default_rng(2)
    x = rng.random((2000, 3))
    y = (x[:, 0] - 0.5 * x[:, 1] ** 2 + 0.1 * np.sin(20 * x[:, 2]) + 0.05 * rng.normal(size=2000) > 0.35).astype(float)
    model = boosting.fit(x, y, {0: 1, 1: -1})
    probe = np.repeat(rng.random((50, 3)), 40, axis=0)
    for j, sign in ((0, 1), (1, -1)):
        rows = probe.copy()
        rows[:, j] = np.tile(np.linspace(0, 1, 40), 50)
        steps = np.diff(model.margin(rows).reshape(50, 40), axis=1) * sign
        assert steps.min() >= -1e-12
    assert ((model.probability(x) > 0.5) == y).mean() > 0.9

    def walk(row):
        total = model.base
        for k in model.roots:
            while model.left[k] != k:
                k = model.left[k] if row[model.feature[k]] <= model.threshold[k] else model.right[k]
            total += model.value[k]
        return total

    assert np.allclose(model.margin(x[:50]), [walk(r) for r in x[:50]])


def test_pairwise_ranker_orders_by_the_signal():
    rng = np.random.default_rng(4)
    x = rng.random((500, 3))
    y = (x[:, 1] < 0.8).astype(float)
    ranker = quality_rank.fit_ranker(x, y)
    s = ranker.score(x)
    assert ((s >= quality_rank.CUT) == (y == 1)).mean() > 0.95 and s.min() >= 0 and s.max() <= 1


def water_fill(sizes, weights, repeats=3):
    """Shares by weight, cut at the limit, what is cut off shared again until none is above."""
    total, out, free = sum(sizes), [0.0] * len(sizes), set(range(len(sizes)))
    while free:
        left = total - sum(out[i] for i in range(len(sizes)) if i not in free)
        share = {i: left * weights[i] / sum(weights[j] for j in free) for i in free}
        over = {i for i in free if share[i] >= repeats * sizes[i]}
        if not over:
            for i in free:
                out[i] = share[i]
            break
        for i in over:
            out[i] = float(repeats * sizes[i])
        free -= over
    return out


def test_mixing(spark):
    rng = random.Random(8)
    rows = [(i, "w " * rng.choice([1, 3, 20, 100]), rng.choice(["a"] * 8 + ["b", "c", "Z", "é", None])) for i in range(4000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix(docs).collect()
    names = sorted({s for *_, s in rows if s is not None}) + [None]
    sizes = [sum(t.count("w") for _, t, s in rows if s == n) for n in names]
    want = water_fill(sizes, [(5, 2, 1)[k % 3] for k in range(len(names))])
    for n, size, target in zip(names, sizes, want, strict=True):
        own = [r for r in got if r["source"] == n]
        assert own[0]["source_size"] == size and own[0]["target"] == pytest.approx(target)
        assert abs(sum(r["taken"] for r in own) - target) <= 350
    assert all(r["taken"] <= 3 * r["size"] and r["taken"] % max(1, r["size"]) == 0 for r in got)
    again = {(r["doc_id"], r["taken"]) for r in mixing.mix(docs.repartition(7)).collect()}
    assert again == {(r["doc_id"], r["taken"]) for r in got}


def test_mixing_of_repeated_ids(spark):
    """Rows that repeat an id, or have none, are taken one by one: each source comes near its target."""
    rows = [(None if i % 2 else 5, "w " * 10, "a") for i in range(400)] + [(i, "v " * 10, "b") for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("extra", F.monotonically_increasing_id())
    got = mixing.mix(docs).collect()
    assert len(got) == 800
    for source, target in (("a", 40000 / 7), ("b", 16000 / 7)):
        own = [r for r in got if r["source"] == source]
        assert own[0]["target"] == pytest.approx(target) and abs(sum(r["taken"] for r in own) - target) <= 20
    again = sorted((r["doc_id"] or 0, r["taken"]) for r in mixing.mix(docs.repartition(5)).collect())
    assert again == sorted((r["doc_id"] or 0, r["taken"]) for r in got)
    mixed = Counter((r["source"], r["extra"]) for r in mixing.mixed_documents(docs).collect())
    assert max(mixed.values()) <= 3
    for source in "ab":
        assert sum(n * 10 for (s, _), n in mixed.items() if s == source) == sum(r["taken"] for r in got if r["source"] == source)


def test_licenses_found_and_confirmed(spark):
    prose = "some words of prose that say nothing at all about terms"
    rows = [(k, f"{prose}\n{t}\n{prose}", name, 0) for k, (name, t) in enumerate(license_scan.TEMPLATES.items())]
    rows += [(100, f"{prose} {prose} Licensed under the Apache License, Version 2.0. {prose}", "Apache-2.0", 0), (101, "this work is licenced under the GNU General Public License, version 3", "GPL-3.0", 1), (102, "THIS WORK IS LICENSED UNDER THE GNU GENERAL PUBLIC LICENSE, VERSION 2.", "GPL-2.0", 0)]
    rows += [(200, "My driving license was renewed with permission.", None, 0), (201, "Licensed under the Apache License, Version 7.0.", None, 0), (202, prose, None, 0)]
    docs = spark.createDataFrame([(i, t) for i, t, *_ in rows], "doc_id long, text string")
    got = {r["doc_id"]: (r["license"], r["differing"]) for r in license_scan.scan(docs).collect()}
    assert got == {i: (n, d) for i, _, n, d in rows if n}


@pytest.mark.parametrize("before, after", [(4, 4), (7, 23), (40, 2), (2, 40), (30, 31)])
def test_licenses_inside_lines(before, after):
    """Verbatim wording is found wherever it stands in a line, whatever the compressor saves there."""
    prose = "all the code samples of each chapter in this guide were written by many hands for readers who like to learn at night while others sleep or walk along some quiet river".split()
    words = lambda n, at: " ".join(prose[(at + k) % len(prose)] for k in range(n))
    scanner = license_scan.Scanner(license_scan.TEMPLATES)
    for at, (name, t) in enumerate(license_scan.TEMPLATES.items()):
        text = f"{words(before, at)} {t} {words(after, at + 9)}"
        found = [(r[2], r[4], r[5]) for r in scanner.scan(text)]
        assert found == [(name, 0, True)], text
    (start, stop, *rest), = scanner.scan(said := "All code samples in this guide are released under the MIT License unless stated otherwise")
    assert said[start:stop] == "released under the MIT License" and rest[0] == "MIT"
    assert [r[2] for r in scanner.scan("If you want it, it is released under the MIT License for everyone to use")] == ["MIT"]


@pytest.mark.parametrize("lines", [1, 45, 400])
def test_wrapped_licenses_in_long_paragraphs(lines):
    """A notice broken over lines is found in a paragraph of any length."""
    prose = "\n".join(["some words of prose that say nothing at all about terms"] * lines)
    scanner = license_scan.Scanner(license_scan.TEMPLATES)
    for name, t in license_scan.TEMPLATES.items():
        words = t.split()
        for pieces in (2, 3):
            cut = [len(words) * k // pieces for k in range(pieces + 1)]
            wrapped = "\n".join(" ".join(words[a:b]) for a, b in zip(cut, cut[1:]))
            found = scanner.scan(f"{prose}\n{wrapped}\n{prose}")
            assert [(r[2], r[4], r[5]) for r in found] == [(name, 0, True)]


@pytest.mark.parametrize("n", [1, 5, 40, 121, 300, 900])
def test_templates_of_any_length_and_wording(n):
    """A template of the user's own, without any usual word, in a long paragraph; some words may differ, more may not."""
    rng = random.Random(n)
    own = [f"{rng.choice('bcdfglmnprst')}{rng.choice('aeiou')}{rng.randrange(10**6):x}".translate(str.maketrans("0123456789", "ghjkqvwxyz")) for _ in range(n)]
    scanner = license_scan.Scanner({"own": " ".join(own), "none": "..."})
    prose = " ".join(f"prose{k % 97}".translate(str.maketrans("0123456789", "abcdefghij")) for k in range(5000))
    text = f"{prose}\n{' '.join(own)} {prose}"
    ((start, stop, name, _, differing, exact),) = scanner.scan(text)
    assert (text[start:stop], name, differing, exact) == (" ".join(own), "own", 0, True)
    changed = [f"{w}x" if k % 10 == 5 else w for k, w in enumerate(own)]
    want = [] if sum(a != b for a, b in zip(own, changed)) > license_scan.DIFFERENT * n else [sum(a != b for a, b in zip(own, changed))]
    assert [r[4] for r in scanner.scan(f"{prose} {' '.join(changed)} {prose}")] == want
    assert scanner.scan(f"{prose} {' '.join(own[: n // 2])} {prose}") == []
    assert len(scanner.scan(" ".join([text] * 3))) == 3 and len(scanner.scan(" ".join([" ".join(own)] * 4))) == 4


def test_full_license_texts():
    """Whole license texts over paragraphs are one finding each, also where a year and holder come before."""
    scanner = license_scan.Scanner(license_scan.TEMPLATES)
    for name in ("MIT-text", "BSD-2-Clause-text", "BSD-3-Clause-text", "ISC-text", "Zlib-text", "Apache-2.0-header", "GPL-3.0-header"):
        words = license_scan.TEMPLATES[name].split()
        wrapped = "\n\n".join("\n # ".join(" ".join(words[k : k + 9]) for k in range(at, min(at + 63, len(words)), 9)) for at in range(0, len(words), 63))
        found = scanner.scan(f"Copyright (c) 2020 Somebody\n\n{wrapped}\n\nimport os\n")
        assert [(r[2], r[4]) for r in found] == [(name, 0)]


def test_licenses_in_documents(spark):
    docs = read(spark, "documents")
    fixed = [license_scan.TEMPLATES[n] for n in ("Apache-2.0", "MIT", "GPL-3.0", "CC-BY-NC-4.0")]
    want = {r["doc_id"] for r in docs.collect() if any(t in (r["text"] or "") for t in fixed)}
    assert {r["doc_id"] for r in license_scan.scan(docs).collect()} == want


def test_warc_payloads_hold_anything():
    body = b"WARC/1.1\r\n\r\n\r\nContent-Length: 5\r\n\r\n"
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\nContent-Length: %d\r\n\r\n" % len(body) + body
    record = b"WARC/1.1\r\nWARC-Type: response\r\nWARC-Target-URI: u\r\nWARC-Payload-Digest: sha256:x\r\nX-Row-Id: 7\r\nContent-Length: %d\r\n\r\n" % len(block) + block + b"\r\n\r\n"
    assert warc.parse(record * 2) == [("response", "7", None, "u", "x", len(body), body)] * 2
