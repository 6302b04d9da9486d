"""Joins whose keys may hold a large part of all rows."""

import random

import pytest
from pyspark.sql import functions as F

from pagetrail import schemas
from pagetrail.operators import accounts, files, intervals
from pagetrail.sources import tables
from pagetrail.streaming import jobs


def valid(requests, sessions):
    return sorted((r for r in requests if any(None not in (r[1], r[2], *s) and s[0] == r[1] and s[1] <= r[2] < s[2] for s in sessions)), key=repr)


@pytest.fixture(scope="module")
def made():
    """A user with half of all rows; spans from a second to years, before 1970 too; nulls, empty spans and repeats."""
    pick = random.Random(3)
    user = lambda: 1 if pick.random() < 0.5 else pick.choice([2, 3, 4, None])
    spans = []
    for _ in range(150):
        start = pick.randint(-100_000, 400_000)
        spans.append((user(), start, start + pick.choice([-5, 0, 1, 60, 3600, 7200, 86_400, 90_000])))
    spans += [(4, -5, 90_000_000), (2, None, 7), (3, 4, None), spans[0]]
    asked = [(k, user(), pick.choice([None, *[pick.randint(-120_000, 520_000)] * 9])) for k in range(500)]
    return asked + asked[:20], spans


def frames(spark, asked, spans):
    r = spark.createDataFrame([(k, u, t, "x") for k, u, t in asked], schemas.REQUESTS)
    return r, spark.createDataFrame([("k", "h", *s) for s in spans], schemas.SESSIONS)


def test_requests_in_sessions(spark, made):
    asked, spans = made
    r, s = frames(spark, asked, spans)
    got = sorted(((x.request_id, x.user_id, x.ts) for x in accounts.valid_at_request(r, s).collect()), key=repr)
    assert got == valid(asked, spans) and got
    one = [x for x in spans if None not in x and x[2] - x[1] == 86_400]
    got = sorted(((x.request_id, x.user_id, x.ts) for x in accounts.valid_at_request(r, frames(spark, asked, one)[1]).collect()), key=repr)
    assert got == valid(asked, one) and got
    assert accounts.valid_at_request(r, s.filter("false")).count() == accounts.valid_at_request(r.filter("false"), s).count() == 0


def test_a_hot_user_is_many_groups(spark, made):
    _, s = frames(spark, *made)
    cut = intervals.parts(s, "user_id", "creation_datetime", "expires_at_datetime")
    assert cut.filter("__key = 1").select("__level", "__bin").distinct().count() > 50
    most = cut.groupBy("__key", "__level", "__bin").agg(F.count(F.lit(1)).alias("n"), F.min("__to"), F.max("__from")).agg(F.max("n")).first()[0]
    assert most <= 20


@pytest.mark.parametrize("parts", [1, 3])
def test_both_sides_as_streams(spark, made, tmp_path, parts):
    asked = [x for x in made[0] if None not in x]
    spans = [x for x in made[1] if None not in x and x[2] - x[1] <= 86_400]
    asked.sort(key=lambda x: x[2])
    spans.sort(key=lambda x: x[1])
    for k in range(parts):  # one file after the other
        part = [x[k * len(x) // parts : (k + 1) * len(x) // parts] for x in (asked, spans)]
        for df, name in zip(frames(spark, *part), "rs", strict=True):
            df.coalesce(1).write.mode("append").parquet(f"{tmp_path}/{name}")
    out = jobs.run_valid(tables.read_capture_stream(spark, f"{tmp_path}/r", schema=schemas.REQUESTS), tables.read_capture_stream(spark, f"{tmp_path}/s", schema=schemas.SESSIONS), f"{tmp_path}/stream")
    assert sorted(((x.request_id, x.user_id, x.ts) for x in out.collect()), key=repr) == valid(asked, spans)


def test_a_hot_hash_stays_where_it_is(spark):
    rows = [(k, "hot" if k % 2 else None if k % 4 == 0 else f"h{k % 30}", f"f{k}") for k in range(5, 2000)] + [(None, "hot", "last"), (3, "h99", "a"), (3, "h99", "a"), (None, None, "z")]
    f = spark.createDataFrame(rows, "id long, hash string, filename string")
    first = {}
    for i, h, name in rows:
        first[h] = min(first.get(h, (True, 0, "")), (i is None, i or 0, name)) if h in first else (i is None, i or 0, name)
    want = sorted(((i, h, first[h][1], first[h][2], i == first[h][1]) for i, h, _ in rows), key=repr)
    for most in (2, 200):
        out = files.file_dedup(f, most)
        assert sorted(map(tuple, out.collect()), key=repr) == want
    assert "hot" in files.frequent(f, 2) and len(files.frequent(f, 2)) <= 2
    assert files.file_dedup(f.filter("false")).count() == 0 and files.file_dedup(f.filter("hash IS NULL")).count() == sum(h is None for _, h, _ in rows)
