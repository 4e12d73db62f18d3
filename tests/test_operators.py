import math
import random

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from slitloom.functions import photometry as P
from slitloom.operators import images as I
from slitloom.operators import lookups as L
from slitloom.operators import quantiles as Q
from slitloom.operators import series as R
from slitloom.plans import acquisition

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(round(v, 9) + 0.0)
    if isinstance(v, list | tuple):
        return [plain(x) for x in v]
    return str(v)


@pytest.mark.parametrize("name", acquisition.ORACLES)
def test_query_is_its_sql(spark, name):
    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    got = entry.queries()[name](spark, sf)
    rel = con.sql(entry.oracle_sql()[name])
    cols = sorted(got.columns)
    assert cols == sorted(rel.columns)
    rows = sorted(str([plain(r[c]) for c in cols]) for r in got.collect())
    at = [list(rel.columns).index(c) for c in cols]
    assert rows == sorted(str([plain(r[i]) for i in at]) for r in rel.fetchall())


def test_entry_runs(spark):
    assert entry.entry(spark).limit(3).count() == 3


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_hysteresis_is_the_loop(spark):
    rng = random.Random(1)
    rows, want = [], {}
    for k in range(40):
        n = rng.randrange(1, 25)
        sev = [rng.choice([None, 1.0, 1.1, 1.2, 1.25, 1.4, 2.0]) for _ in range(n)]
        v = np.array([np.nan if s is None else s for s in sev])
        measured = np.isfinite(v)
        flag = P.hysteresis(np.where(measured, v, 0), measured, 1.3)
        for x in range(n):
            rows.append((k, x, sev[x]))
            want[k, x] = bool(flag[x])
    df = spark.createDataFrame(rows, "k int, x int, severity double")
    got = {(r["k"], r["x"]): r["flag"] for r in R.hysteresis(df, "severity", "x", 1.3, ["k"]).collect()}
    assert got == want


def test_merge_is_a_fold(spark):
    rows = [("a", 1.0, 5.0), ("a", 2.5, 9.0), ("a", 4.0, 1.0), ("a", 4.6, 2.0), ("a", 9.0, 1.0), ("b", 3.0, 1.0)]
    df = spark.createDataFrame(rows, "k string, x double, depth double")
    got = sorted((r["k"], r["x"], r["depth"]) for r in R.merge_close(df, "x", "depth", 2.0, ["k"]).collect())
    assert got == [("a", 2.5, 9.0), ("a", 4.6, 2.0), ("a", 9.0, 1.0), ("b", 3.0, 1.0)]


def test_nearest_within_is_brute_force(spark):
    rng = random.Random(2)
    left, right = [(i, rng.uniform(-50, 50)) for i in range(80)], [(rng.uniform(-50, 50),) for _ in range(60)]
    got = {r["k"]: r["place"] for r in L.nearest_within(spark.createDataFrame(left, "k int, at double"), spark.createDataFrame(right, "place double"), "k", "at", "place", 0.8).collect()}
    want = {k: min((p[0] for p in right if abs(p[0] - v) <= 0.8), key=lambda p: (abs(p - v), p), default=None) for k, v in left}
    assert got == {k: p for k, p in want.items() if p is not None}


def test_transpose_and_halo_do_not_depend_on_partitions(spark):
    img = np.random.default_rng(0).normal(1000, 20, (24, 100)).astype(np.float32)
    cols = [(x, [float(v) for v in img[:, x]]) for x in range(100)]
    df = spark.createDataFrame(cols, "x int, col array<float>")
    whole = P.temporal_nlm(img.astype(float), 0, 20)

    def kernel(pdf, lo, hi):
        part = np.stack(pdf["col"].to_list(), 1).astype(float)
        first = int(pdf["x"].iloc[0])
        out = P.temporal_nlm(part, 0, 20, lo=lo - first, hi=hi - first)
        import pandas as pd

        return pd.DataFrame({"x": np.arange(lo, hi, dtype=np.int32), "col": list(out.T)})

    for n in (1, 4, 7):
        rows = {r["y"]: r["row"] for r in I.transposed(df.repartition(n)).collect()}
        assert all(np.allclose(rows[y], img[y]) for y in range(24))
        got = {r["x"]: r["col"] for r in I.halo_blocks(df.repartition(n), kernel, "x int, col array<double>", 100, 32, 3).collect()}
        assert all((np.array(got[x]) == whole[:, x]).all() for x in range(100))


def test_global_percentiles_with_ties_and_nulls(spark):
    values = [1.0, 2.0, 2.0, 2.0, 5.0, None]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    got = {r["p"]: r["v"] for r in Q.global_nearest_rank(df, "v", [0, 50, 75, 100]).collect()}
    assert got == {0.0: 1.0, 50.0: 2.0, 75.0: 2.0, 100.0: 5.0}
    assert Q.global_nearest_rank(df.where(F.lit(False)), "v", [50]).collect() == []


@pytest.mark.parametrize("name", ["row_transpose", "frame_grid_mean"])
def test_means_that_end_in_5_round_as_in_the_sql(spark, tmp_path, name):
    rng = random.Random(3)
    at = np.datetime64("2024-01-01T00:00:00", "us")
    rows = [(16 * x + y, at + np.timedelta64(x, "h"), y, (rng.randrange(10**9) * 10 + 5) / 1e7) for x in range(40) for y in range(16)]
    ids, ts, users, values = zip(*rows, strict=True)
    pq.write_table(pa.table({"event_id": ids, "ts": pa.array(ts, pa.timestamp("us")), "user_id": users, "value": values}), tmp_path / "events.parquet")
    con = duckdb.connect()
    con.execute(f"create view events as select * from '{tmp_path}/events.parquet'")
    rel = con.sql(entry.oracle_sql()[name])
    want = sorted(rel.fetchall())
    got = entry.queries()[name](spark, str(tmp_path)).select(*rel.columns).collect()
    assert sorted(tuple(r) for r in got) == want


def peak_memory(spark, run):
    """What run() gives, and the execution memory of its stages (bytes, all tasks of the largest)."""
    sc = spark.sparkContext
    sc.setJobGroup(group := f"peak-{random.random()}", "")
    out = run()
    store, tracker = sc._jsc.sc().statusStore(), sc.statusTracker()
    sc._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    stages = {s for j in tracker.getJobIdsForGroup(group) for s in tracker.getJobInfo(j).stageIds}
    sc.setLocalProperty("spark.jobGroup.id", None)
    return out, max(store.lastStageAttempt(s).peakExecutionMemory() for s in stages)


def test_nearest_within_crowded_cells_pairs_none(spark):
    rng = random.Random(4)
    left, right = [(i, rng.uniform(0, 0.5)) for i in range(4000)], sorted(rng.uniform(0, 0.5) for _ in range(4000))
    df, places = spark.createDataFrame(left, "k int, at double"), spark.createDataFrame([(p,) for p in right], "place double")
    got, peak = peak_memory(spark, lambda: {r["k"]: r["place"] for r in L.nearest_within(df, places, "k", "at", "place", 0.5).collect()})
    r = np.array(right)
    assert got == {k: float(r[np.abs(r - v).argmin()]) for k, v in left}
    assert peak < 300e6  # 16 M pairs took over 1 GB


def test_as_of_takes_the_first_listed_of_crowded_stamps(spark):
    rng = random.Random(5)
    scans = [(i % 3000, rng.randrange(3000)) for i in range(4000)]  # some names twice
    refs = [(f"l{i:05d}", rng.randrange(0, 6000, 7), f"p{i}") for i in range(4000)]
    rng.shuffle(refs)
    df, references = spark.createDataFrame(scans, "k int, at bigint"), spark.createDataFrame(refs, "listing string, stamp bigint, path string")
    got, peak = peak_memory(spark, lambda: {r["k"]: (r["distance"], r["listing"], r["stamp"], r["path"]) for r in L.as_of_nearest(df, references, "k", "at", "stamp", "listing", 600, carry=["path"]).collect()})
    at, name = np.array([s for _, s, _ in refs]), np.array([n for n, _, _ in refs])
    want = {}
    for k, v in scans:
        d = np.abs(at - v)
        i = min(np.flatnonzero(d == d.min()), key=lambda i: name[i])
        want[k] = min(want.get(k, (10**9, "", 0, "")), (int(d[i]), *refs[i]))
    assert got == want
    assert peak < 300e6


@pytest.mark.parametrize("rows", [7, 150, 10**6])
def test_nearest_within_is_the_same_in_any_number_of_parts(spark, monkeypatch, rows):
    monkeypatch.setattr(L, "ROWS", rows)
    rng = random.Random(6)
    scans, refs = [(i % 130, rng.randrange(-900, 900)) for i in range(160)], [(i, rng.randrange(-90, 90) * 10) for i in range(140)]
    df, references = spark.createDataFrame(scans, "k int, at int"), spark.createDataFrame(refs, "listing int, stamp bigint")
    got = {r["k"]: (r["distance"], r["listing"], r["stamp"]) for r in L.as_of_nearest(df, references, "k", "at", "stamp", "listing", 9).collect()}
    want = {}
    for k, v in scans:
        want[k] = min([(abs(v - s), i, s) for i, s in refs if abs(v - s) <= 9] + [want.get(k, (99,))])
    assert got == {k: v for k, v in want.items() if v != (99,)}


def test_nearest_within_odd_places(spark):
    nan, inf = float("nan"), float("inf")
    left = spark.createDataFrame([(0, 0.3), (1, None), (2, nan), (3, inf), (4, -inf), (5, 1e300), (6, -0.0), (7, 0.55)], "k int, at double")
    right = spark.createDataFrame([(0.39999999999999997,), (None,), (nan,), (inf,), (1e300,), (0.0,), (0.5,), (0.6,), (0.5,)], "place double")
    got = {r["k"]: r["place"] for r in L.nearest_within(left, right, "k", "at", "place", 0.1).collect()}
    assert got == {0: 0.39999999999999997, 5: 1e300, 6: 0.0, 7: 0.6 if abs(0.55 - 0.6) < abs(0.55 - 0.5) else 0.5}
    whole = spark.createDataFrame([(0, 10), (1, 11), (2, 13)], "k int, at int")
    got = {r["k"]: r["place"] for r in L.nearest_within(whole, spark.createDataFrame([(10.5,), (13.5,)], "place double"), "k", "at", "place", 1).collect()}
    assert got == {0: 10.5, 1: 10.5, 2: 13.5}
