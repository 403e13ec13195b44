import bisect
import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from recordloom import errors, session
from recordloom.functions import ids, text, web
from recordloom.operators import paging, profile, registry, sets, traffic
from recordloom.plans.load import append_records
from recordloom.sources.records import ROWNR, field_text, from_json_records, to_json_records


def numbered(spark, n=1000):
    return spark.range(n).select(
        F.col("id").alias(ROWNR), F.concat(F.lit("v"), (F.col("id") % 7).cast("string")).alias("v"), F.col("id").cast("string").alias("n")
    )


def test_clamping():
    assert [paging.clamp_limit(x) for x in (None, 1, 100, 101, 0, -3, "7")] == [100, 1, 100, 100, 100, 100, 7]
    assert [paging.clamp_offset(x) for x in (None, -1, 0, "5")] == [0, 0, 0, 5]
    for bad in ("", "x", "1.0", " 1", "99999999999"):
        with pytest.raises(errors.BadNumber):
            paging.clamp_limit(bad)


@pytest.mark.parametrize("sort", [None, "v", "V,desc", "n,asc"])
def test_deep_pages_equal_shallow_ones(spark, monkeypatch, sort):
    df = numbered(spark).withColumn("v", F.when(F.col(ROWNR) % 10 < 9, F.col("v"))).cache()
    for offset in (0, 3, 250, 888, 899, 905, 995, 1000, 5000):
        monkeypatch.setattr(paging, "SHALLOW_OFFSET", 10**9)
        plain = [tuple(r) for r in paging.page_of(df, 7, offset, sort).collect()]
        monkeypatch.setattr(paging, "SHALLOW_OFFSET", 5)
        monkeypatch.setattr(paging, "COUNT_CELLS", 16)
        assert [tuple(r) for r in paging.page_of(df, 7, offset, sort).collect()] == plain
        assert len(plain) == max(0, min(7, 1000 - offset))


def test_envelope_links(spark):
    df = numbered(spark, 30)
    request = {"v": "~v[0-4]", "_limit": "5", "_offset": "5"}
    out = paging.envelope(paging.query_request(df, request), 5, 5, 12, "http://h/dataset/i", request).first()
    assert out["result_count"] == 22 and out["query_time"] == 12 and len(out["results"]) == 5
    assert out["prev"] == "http://h/dataset/i/json?_offset=0&_limit=5&v=%7Ev%5B0-4%5D"
    assert out["next"] == "http://h/dataset/i/json?_offset=10&_limit=5&v=%7Ev%5B0-4%5D"
    last = paging.envelope(paging.query(df, {}, 10, 20), 10, 20).first()
    assert (last["prev_offset"], last["next_offset"]) == (10, 30)  # an exactly full last page still links on
    past = paging.envelope(paging.query(df, {}, 10, 50), 10, 50).first()
    assert (past["results"], past["result_count"], past["next_offset"]) == ([], 0, None)


def test_profiles_and_sets(spark):
    df = spark.createDataFrame([(5, "a", None), (9, None, "xyz")], f"{ROWNR} long, p string, q string")
    assert [r[0] for r in profile.column_names(df).collect()] == ["p"]
    assert sorted(r[0] for r in profile.all_column_names(df).collect()) == ["p", "q"]
    assert dict(map(tuple, profile.max_lengths(df).collect())) == {"p": 1, "q": 3}
    both = append_records(df, df.select(ROWNR, "q", "p"))
    assert [r[0] for r in both.orderBy(ROWNR).collect()] == [5, 9, 15, 19]
    assert sets.same_rows(df, df.select(ROWNR, "q", "p")).first()["same"]
    assert not sets.same_rows(df, df.limit(1)).first()["same"]
    with pytest.raises(errors.LoadRejected):
        append_records(df, df.drop("q"))


def test_names_that_are_null_do_not_meet_in_one_task(spark):
    """Half of the names are null and a quarter means nothing; their rows are spread over the partitions of the join."""
    conf = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false", "spark.sql.shuffle.partitions": "8"}
    before = {k: spark.conf.get(k, None) for k in conf}
    ids_ = [f"00000000-0000-0000-0000-{i:012d}" for i in range(5)]
    rows = [(i, None if i % 2 else f"a{i % 5}" if i % 4 else "no such name" if i % 8 else ids_[i % 5]) for i in range(4000)]
    names = spark.createDataFrame(rows, "i int, name string")
    aliases = spark.createDataFrame([(ids_[i], f"a{i}") for i in range(3)], "dataset_id string, alias string")
    datasets = spark.createDataFrame([(x, 3) for x in ids_[:4]], "id string, status int")
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        out = registry.resolve_names(names, aliases, datasets)
        got = {r["i"]: (r["dataset_id"], r["valid"]) for r in out.collect()}
        sizes = [r["n"] for r in out.groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()]
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    for i, name in rows:
        wanted = {f"a{k}": ids_[k] for k in range(3)}.get(name, name if name in ids_ else None)
        assert got[i] == (wanted if wanted in ids_[:4] else None, wanted is not None)
    assert len(got) == 4000 and len(sizes) == 8 and max(sizes) < 1600


def test_json_records(spark):
    df = spark.createDataFrame([(1, "a", None), (2, "", 'q"')], f"{ROWNR} long, p string, `x y` string")
    coded = to_json_records(df)
    assert [r["data"] for r in coded.orderBy(ROWNR).collect()] == ['{"p":"a"}', '{"p":"","x y":"q\\""}']
    assert from_json_records(coded, ["p", "x y"]).orderBy(ROWNR).collect() == df.orderBy(ROWNR).collect()
    junk = spark.createDataFrame([(1, "{"), (2, '{"p":"k"}'), (3, None)], f"{ROWNR} long, data string")
    assert [tuple(r) for r in from_json_records(junk, ["p"]).collect()] == [(2, "k")]
    assert [r[0] for r in junk.select(field_text(F.col("data"), "p")).collect()] == [None, "k", None]


def test_scalars(spark):
    row = spark.range(1).select(
        text.strip_controls(F.lit(" \t a \n")).alias("strip"),
        text.count_of(F.lit("a;b;;c"), ";").alias("n"),
        ids.is_uuid(F.lit("0a0b0c0d-0000-1111-2222-0123456789AB")).alias("uuid"),
        ids.is_uuid(F.lit("0a0b0c0d-0000-1111-2222-0123456789AB\n")).alias("uuid_nl"),
        text.is_alphanumeric(F.lit("äß9")).alias("an"),
        text.is_alphanumeric(F.lit("")).alias("an_empty"),
        web.query_parameters(F.lit("a=1&b=&c&=x&a=2&d=x%20y+z&e=f=g&bad=%zz")).alias("q"),
        text.json_texts(F.lit('["a","b","a"]')).alias("j"),
        registry.status_name(F.lit(9)).alias("s"),
        ids.dataset_url(F.lit("http://h"), F.lit("i")).alias("u"),
    ).first()
    assert (row["strip"], row["n"], row["uuid"], row["uuid_nl"], row["an"], row["an_empty"]) == (" a", 3, True, False, True, False)
    assert row["q"] == {"a": "2", "b": "", "c": "", "d": "x y z", "e": "f=g", "bad": None}
    assert row["j"] == ["a", "b"] and row["s"] == "Unknown" and row["u"] == "http://h/dataset/i"


START = dt.datetime(2024, 1, 1)
DAY_MICROS = 86_400_000_000


def request_log(spark, seed, n, step_ms):
    """Rows ``(id, key, ts)`` with ties; key "hot" has half of them, one row has no time."""
    rng = random.Random(seed)
    rows = [
        (i, rng.choice(["hot", "hot", "b", None]), START + dt.timedelta(milliseconds=rng.randrange(n * step_ms)))
        for i in range(n)
    ]
    rows.append((n, "b", None))
    return rows, spark.createDataFrame(rows, "id long, key string, ts timestamp_ntz")


@pytest.mark.parametrize("hot_rows", [10, 10**6])
def test_trailing_counts_by_brute_force(spark, hot_rows):
    rows, df = request_log(spark, 1, 600, 700)
    got = traffic.trailing_counts(df, "key", "ts", 60, limit=40, retry_after=True, hot_rows=hot_rows)
    got = {r["id"]: r for r in got.collect()}
    assert len(got) == len(rows)
    times = {}
    for _, k, t in rows:
        if t:
            times.setdefault(k, []).append(t)
    for ts in times.values():
        ts.sort()
    for i, k, t in rows:
        if t is None:
            assert got[i]["trailing_count"] is None and got[i]["retry_at"] is None
            continue
        a, b = bisect.bisect_right(times[k], t - dt.timedelta(seconds=60)), bisect.bisect_left(times[k], t)
        assert got[i]["trailing_count"] == b - a and got[i]["over_limit"] == (b - a >= 40)
        due = times[k][a] + dt.timedelta(seconds=60, milliseconds=1) if b - a >= 40 else None
        assert got[i]["retry_at"] == due
    assert any(r["over_limit"] for r in got.values())


def test_no_stretch_of_a_burst_is_too_long(spark, monkeypatch):
    """Nine tenths of a hot key in one hour, many of them in the same instant."""
    rng = random.Random(8)
    rows = [("hot", rng.choice([5, rng.randrange(3_600_000_000)]) if i % 10 else rng.randrange(30 * DAY_MICROS)) for i in range(40_000)]
    rows += [(None, rng.randrange(DAY_MICROS)) for _ in range(500)]
    monkeypatch.setattr(traffic, "SORT_ROWS", 3_000)
    steps = spark.createDataFrame(rows, "k string, t long").withColumns({"adds": F.lit(1), "ends": F.lit(0)})
    cut = traffic.cut_timeline(steps, 1000)
    sizes = cut.groupBy("part", "cut").agg(F.count("*").alias("n"), F.min(F.struct("k", "t")).alias("a"), F.max(F.struct("k", "t")).alias("b")).orderBy("part", "cut").collect()
    assert max(s["n"] for s in sizes) <= 1000 and sum(s["n"] for s in sizes) == len(set(rows)) and len(sizes) < 60
    order = lambda x: (x["k"] is not None, x["k"] or "", x["t"])
    assert all(order(x["b"]) < order(y["a"]) for x, y in zip(sizes, sizes[1:]))
    assert cut.agg(F.sum("adds")).first()[0] == len(rows)


def test_session_zone_does_not_matter(spark):
    rows, df = request_log(spark, 5, 50, 900)
    utc = traffic.trailing_counts(df, "key", "ts", 60).orderBy("id").collect()
    spark.conf.set("spark.sql.session.timeZone", "Europe/Stockholm")
    try:
        assert traffic.trailing_counts(df, "key", "ts", 60).orderBy("id").collect() == utc
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


@pytest.mark.parametrize("limit, step_ms", [(1, 900), (4, 300), (4, 20), (30, 3)])
def test_sliding_admission_by_brute_force(spark, limit, step_ms):
    rows, df = request_log(spark, 2, 500, step_ms)
    got = {r["id"]: r["admitted"] for r in traffic.sliding_admission(df, "key", "ts", "id", limit, 5).collect()}
    taken, seen = {}, {False: 0, True: 0}
    for i, k, t in sorted((r for r in rows if r[2]), key=lambda r: (r[2], r[0])):
        window = {x for x in taken.get(k, set()) if t - x < dt.timedelta(seconds=5)}
        admitted = len(window) < limit
        taken[k] = window | {t} if admitted else window
        assert got.pop(i) == admitted
        seen[admitted] += 1
    assert list(got.values()) == [None] and all(seen.values())
    free = traffic.sliding_admission(df, "key", "ts", "id", None, 5)
    assert free.where("NOT admitted").isEmpty()


@pytest.mark.parametrize("limit, seconds", [(1, 2), (5, 1), (50, 1)])
def test_average_admission_by_brute_force(spark, limit, seconds):
    rows, df = request_log(spark, 3, 500, 40)
    got = {r["id"]: r["admitted"] for r in traffic.average_admission(df, "key", "ts", "id", limit, seconds).collect()}
    state = {}
    interval = 1_000_000 / (limit / seconds)
    for i, k, t in sorted((r for r in rows if r[2]), key=lambda r: (r[2], r[0])):
        now = round((t - START).total_seconds() * 1_000_000)
        free, kept = state.get(k, (now, 0.0))
        if now > free:
            free, kept = now, min(limit / seconds, kept + (now - free) / interval)
        admitted = free <= now
        if admitted:
            spent = min(1.0, kept)
            free, kept = free + int((1 - spent) * interval), kept - spent
            state[k] = (free, kept)
        assert got.pop(i) == admitted, i
    assert list(got.values()) == [None]


def test_a_limit_of_zero_refuses_all(spark):
    assert traffic.SlidingWindow(0, 10).take(np.array([1, 2, 50])).tolist() == [0, 0, 0]
    df = spark.sql("SELECT 1 AS id, 'a' AS k, timestamp'2024-01-01' AS ts")
    assert [r["admitted"] for r in traffic.sliding_admission(df, "k", "ts", "id", 0, 5).collect()] == [False]


def test_shared_folder_without_a_setting():
    class Bare:
        """A local session whose checkpoint folder is not set."""

        conf = type("Conf", (), {"get": staticmethod(lambda name, default=None: default)})
        sparkContext = type("Context", (), {"master": "local[2]", "applicationId": "bare"})

    assert session.shared_folder(Bare) == session.shared_folder(Bare)
    Bare.sparkContext.master = "spark://cluster"
    with pytest.raises(RuntimeError):
        session.shared_folder(Bare)
