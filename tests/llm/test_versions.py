"""The versioned merge against a plain walk forwards in time, over few and over many parts."""

import random
from collections import defaultdict
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from corvane.llm import versions

ATTRIBUTES = ["city", "cents"]
SCHEMA = "client_id long, change_id long, seq long, op string, at long, city string, cents long"


def low(x):
    return (x is not None, x if x is not None else 0)


def walked(rows):
    """One change after the other, oldest first."""
    by_client = defaultdict(set)
    for r in rows:
        if r[4] is not None:
            by_client[r[0]].add(r)
    out = []
    for client, changes in by_client.items():
        by_seq, by_time = {}, {}
        for r in sorted(changes, key=lambda r: (low(r[1]), r[4])):
            by_seq[r[2]] = r
        for r in sorted(by_seq.values(), key=lambda r: (low(r[2]), low(r[1]))):
            by_time[r[4]] = r
        found, state = [], None
        for t in sorted(by_time):
            _, _, seq, op, _, city, cents = by_time[t]
            if op == "D":
                new = (True, None, None)
            elif op == "I" or state is None:
                new = (False, city, cents)
            else:
                new = (False, city if city is not None else state[1], cents if cents is not None else state[2])
            if new != state:
                found.append([t, None, *new, seq])
            state = new
        for a, b in zip(found, found[1:]):
            a[1] = b[0]
        for k, (a, b, *rest) in enumerate(found):
            inside = {r[1] for r in changes if r[4] >= a and (b is None or r[4] < b)} - {None}
            out.append((client, k + 1, a, b, *rest, len(inside)))
    return sorted(out, key=str)


def merged(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit("own") for c in ("key", "part", "t", "n", "prev", "a0")}).repartition(3)
    return sorted((tuple(r) for r in versions.merged_versions(df, ATTRIBUTES, at="at").collect()), key=str)


def changes(n, clients, times, seqs, rng, ids=10**6):
    some = lambda x, share=0.3: None if rng.random() < share else x
    return [(rng.choice(clients), rng.randrange(ids), rng.randrange(seqs), rng.choice("IUUUUD"), rng.randrange(times), some(rng.choice("ab")), some(rng.randrange(2))) for _ in range(n)]


@pytest.fixture
def parts(spark):
    key = ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")
    was = [spark.conf.get(k) for k in key]

    def set_to(n):
        spark.conf.set(key[0], str(n))
        spark.conf.set(key[1], "false")

    yield set_to
    for k, v in zip(key, was):
        spark.conf.set(k, v)


@pytest.mark.parametrize("n_parts", [1, 4, 23])
def test_against_a_walk_forwards(spark, parts, n_parts):
    parts(n_parts)
    rng = random.Random(n_parts)
    rows = changes(400, [1, 1, 1, 1, 2, 3, None], 150, 10**6, rng)
    rows += changes(60, [7], 30, 20, rng, ids=25)  # equal seqs, equal times, ids that come again
    rows += rows[:40]
    assert merged(spark, rows) == walked(rows)


def test_one_client_over_many_parts_keeps_pending_attributes(spark, parts):
    parts(12)
    rows = [(1, 0, 0, "I", 0, "a", 5)] + [(1, k, k, "U", k, None, None) for k in range(1, 200)]  # nothing changes for long
    rows += [(1, 200 + k, 200 + k, "U", 200 + k, None, k % 2) for k in range(40)] + [(1, 300, 300, "D", 300, "x", 1), (1, 301, 301, "U", 301, None, None)]
    got = merged(spark, rows)
    assert got == walked(rows) and got[0][:4] == (1, 1, 0, 200) and got[0][-1] == 200


def test_ids_that_come_again_in_other_parts_count_once_a_version(spark, parts):
    parts(12)
    rows = [(1, k % 7, k, "U", k, "a", 1) for k in range(150)] + [(1, k % 5, k, "U", k, "b", 1) for k in range(150, 300)]
    got = merged(spark, rows)
    assert got == walked(rows) and [r[-1] for r in got] == [7, 5]


def test_nulls_ties_and_empty_tables(spark, parts):
    parts(3)
    long = "x" * 100_000
    rows = [(None, 1, 1, "U", 5, long, None), (None, 1, 1, "U", 5, long, None), (1, None, None, None, 3, "a", None), (1, 4, None, "U", 2, "b", None), (1, 5, 9, "D", None, "c", 1), (2, 6, 1, "D", 1, "c", 1), (2, None, 2, "U", 1, None, 1)]
    got = merged(spark, rows)
    assert got == walked(rows)
    assert [r for r in got if r[0] is None] == [(None, 1, 5, None, False, long, None, 1, 1)]
    assert merged(spark, []) == []
    assert merged(spark, [(1, 1, 1, "U", None, "a", 1)]) == []


def test_text_keys_and_times_without_a_zone(spark):
    zone = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        rows = [("é", 1, 1, "U", datetime(2024, 3, 10, 2, 30), "a"), ("é", 2, 2, "D", datetime(2024, 3, 10, 2, 30, 0, 5), "a")]
        df = spark.createDataFrame(rows, "client_id string, change_id long, seq int, op string, valid_at timestamp_ntz, city string")
        got = sorted(tuple(r) for r in versions.merged_versions(df, ["city"]).collect())
        t = 1710037800000000  # 02:30 of that day in UTC
        assert got == [("é", 1, t, t + 5, False, "a", 1, 1), ("é", 2, t + 5, None, True, None, 2, 1)]
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)
