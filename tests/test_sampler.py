"""The sampler on a stream against the fold over the table, late rows, and a restart."""

import glob

import pytest
from pyspark.sql import functions as F

from spanquarry.operators import folds, sampling
from spanquarry.plans import source_queries, window_queries
from spanquarry.streaming import live, sampler

SF, HOUR = "/root/testdata/sf0.001", 3600


def test_diversity_is_the_same(spark):
    rows = [(m, s, i) for m in (0, 1, 7, 500) for s in (0.5, 0.8, 1.0) for i in (True, False)]
    got = spark.createDataFrame(rows, "mass long, similarity double, incident boolean").select("*", sampling.diversity(F.col("mass"), F.col("similarity"), F.col("incident")).alias("d")).collect()
    assert all(r.d == pytest.approx(sampler.diversity_of(r.mass, r.similarity, r.incident), rel=1e-12) for r in got)


def test_stream_equals_the_fold_over_a_restart(spark, tmp_path):
    rows = source_queries.sampler_rows(window_queries.probabilities(spark, SF), 7).cache()
    found = folds.leader_clusters(rows, HOUR)
    table = rows.join(found, "trace_id").withColumn("p_d", sampling.diversity(F.col("mass"), F.col("similarity"), F.col("incident")))
    want = {r.trace_id: (r.cluster, r.mass, r.kept[0]) for r in found.join(folds.keep_fold(table, 0.025, HOUR, (7,)), "trace_id").collect()}
    low, high = rows.agg(F.min("sec"), F.max("sec")).first()
    middle = (low + high) // 2
    path, arriving = f"{tmp_path}/in", lambda: spark.readStream.schema(rows.schema).parquet(f"{path}/*")
    last = lambda k: rows.limit(1).withColumn("g", F.lit("end")).withColumn("start_ns", F.lit((high + 86_400 * k) * 10**9)).withColumn("trace_id", F.lit("end"))
    run = lambda: live.run_once(sampler.sampled(arriving(), "g", 0.025, HOUR, stretch=5 * 86_400_000), f"{tmp_path}/out", f"{tmp_path}/state", "append")
    with sampler.rocks(spark):
        rows.where(F.col("sec") < middle).orderBy(F.desc("start_ns")).write.parquet(f"{path}/part=0")  # in any order
        first = run().count()
        rows.where(F.col("sec") >= middle).unionByName(last(9)).write.parquet(f"{path}/part=1")
        run()
        rows.limit(3).withColumn("trace_id", F.concat(F.lit("late-"), "trace_id")).unionByName(last(10)).write.parquet(f"{path}/part=2")
        got = run()
    assert 0 < first < len(want)
    assert {r.trace_id: (r.cluster, r.mass, r.kept) for r in got.where("not late").collect()} == want
    assert all(not r.kept for r in got.where("late").collect())


def test_many_files_of_the_stream_come_in_order_of_time(spark, monkeypatch):
    want = {r.trace_id: r.kept for r in window_queries.keep_fold(spark, SF).collect()}
    monkeypatch.setattr(source_queries, "FILE_ROWS", 60)
    got = {r.trace_id: (r.cluster is not None, r.kept) for r in source_queries.live_sampler(spark, SF).collect()}
    assert got == {t: (True, kept) for t, kept in want.items()}


def test_the_state_takes_blocks_and_few_partitions(spark):
    """A stream of single rows cost 0.2 ms a trace in one task, and each batch opened the state of every shuffle partition."""
    spark.conf.set("spark.sql.shuffle.partitions", "24")
    try:
        shared = spark.conf.get("spark.checkpoint.dir").removeprefix("file://")
        there = set(glob.glob(f"{shared}/state-*"))
        n = source_queries.live_sampler(spark, SF).count()
        assert spark.conf.get("spark.sql.shuffle.partitions") == "24"
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
    (state,) = set(glob.glob(f"{shared}/state-*")) - there
    assert len(glob.glob(f"{state}/state/0/[0-9]*")) <= 2
    assert spark.read.parquet(f"{shared}/arriving-{state.rsplit('-', 1)[1]}/*").count() <= 30 * 4 + 4 < n / 3  # stretches, and what the files cut


def test_groups_of_a_stream_are_folded_apart_in_any_order(spark, tmp_path, monkeypatch):
    rows = source_queries.sampler_rows(window_queries.probabilities(spark, SF), 7).cache()
    third = F.pmod(F.crc32("trace_id"), F.lit(3))
    mixed = rows.withColumn("g", F.when(third == 0, "a").when(third == 1, "b"))  # and null
    high = rows.agg(F.max("sec")).first()[0]
    last = rows.limit(1).withColumn("g", F.lit("end")).withColumn("start_ns", F.lit((high + 9 * 86_400) * 10**9))
    mixed.orderBy(F.xxhash64("trace_id")).coalesce(1).write.parquet(f"{tmp_path}/in/part=0")
    last.coalesce(1).write.parquet(f"{tmp_path}/in/part=1")
    arriving = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    monkeypatch.setattr(sampler, "CHUNK", 50)  # a stretch is taken in several parts
    with sampler.rocks(spark, 2):
        got = live.run_once(sampler.sampled(arriving, "g", 0.025, HOUR, stretch=86_400_000), f"{tmp_path}/out", f"{tmp_path}/state", "append").where("not late")
    got, want = {r.trace_id: (r.cluster, r.mass, r.kept) for r in got.collect()}, {}
    for g in ("a", "b", None):
        index, fold = folds.LeaderIndex(HOUR), folds.KeepFold(0.025, HOUR)
        for r in sorted(mixed.where(F.col("g").eqNullSafe(F.lit(g))).collect(), key=lambda r: (r.start_ns, r.trace_id)):
            cluster, how, mass = index.add(r.sec, r.tokens)
            keep = fold.decide(r.sec, r.p_s, sampler.diversity_of(mass, how, r.incident), r.has_error, r.incident, r.near, r.alarm, r.u, r.v, r.w)
            want[r.trace_id] = (cluster, mass, keep)
    assert len(want) == rows.count() and got == want


def test_no_events_give_no_rows(spark, tmp_path):
    spark.read.parquet(f"{SF}/events.parquet").limit(0).write.parquet(f"{tmp_path}/events.parquet")
    assert source_queries.live_sampler(spark, str(tmp_path)).count() == 0
