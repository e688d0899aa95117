"""Golden cases of the job operators."""

import pytest
from pyspark.sql import functions as F

from jobloom.functions.ordering import with_position, with_running_sum
from jobloom.functions.scalars import clean_annotations, parse_quantity
from jobloom.operators import fairshare, fold, grouping, health, maintain, search
from jobloom.operators.search import Filter
from jobloom.sources import job_tables
from jobloom.streaming import ingest


def updates(spark, *states):
    rows = [("j", i, s) for i, s in enumerate(states)]
    df = spark.createDataFrame([(j, i, None if s == "run" else s, "r" if s == "run" else None) for j, i, s in rows], "job_id string, seq long, state short, latest_run_id string")
    return df.withColumns({c: F.lit(None).cast("string") for c in fold.JOB_COLUMNS if c not in df.columns})


@pytest.mark.parametrize(("states", "final"), [((6, 3), 6), ((4, 3), 4), ((5, 3), 5), ((7, 5), 7), ((7, 3), 7), ((5, 4, 7), 7), ((4, 7), 7), ((9, 7), 9), ((5, "run"), 5)])
def test_conflation(spark, states, final):
    row = fold.conflate_job_updates(updates(spark, *states)).first()
    assert row.state == final
    assert row.latest_run_id is None


def log(spark, n=60):
    kinds = ["SubmitJob", "JobRunLeased", "JobRunAssigned", "JobRunRunning", "ReprioritisedJob", "JobSucceeded", "JobRunPreempted", "CancelledJob"]
    kind = lambda i: kinds[0] if i < 5 else kinds[1] if i < 10 else kinds[2 + (i // 5 * 5 + i) % 6]
    rows = [(f"j{i % 5}", f"r{i % 5}", "q", "s", "u", i, 1000 + i, kind(i), i % 9, "why", None, "c", "n", "p", True, "PodError", 1, 3) for i in range(n)]
    return spark.createDataFrame(rows, "job_id string, run_id string, queue string, jobset string, user string, seq long, created long, kind string, priority long, reason string, requestor string, cluster string, node string, pool string, terminal boolean, error_kind string, exit_code int, bytes long")


def test_fold_does_not_depend_on_batches(spark):
    events = log(spark).cache()
    whole = [sorted(map(str, df.collect())) for df in fold.fold_log(events)]
    for cuts in ((30,), (7, 19, 44)):
        jobs = runs = None
        for a, b in zip((0, *cuts), (*cuts, 60)):
            jobs, runs = (spark.createDataFrame(df.collect(), df.schema) for df in fold.fold_log(events.where((F.col("seq") >= a) & (F.col("seq") < b)), jobs, runs))
        assert [sorted(map(str, df.select(*w.columns).collect())) for df, w in zip((jobs, runs), fold.fold_log(events))] == whole


def test_replay_changes_nothing(spark):
    events = log(spark)
    jobs, runs = fold.fold_log(events)
    again, runs_again = fold.fold_log(events, jobs, runs)
    assert sorted((r.job_id, r.owner) for r in jobs.collect()) == sorted((r.job_id, r.owner) for r in again.collect())
    assert sorted(map(str, runs.collect())) == sorted(map(str, runs_again.collect()))


def mixed_log(spark, seed, n=90):
    """Events of any kind in any order: updates before creates, several ends, preemptions after them."""
    import random

    rng = random.Random(seed)
    kinds = ["SubmitJob", "JobRunLeased", "JobRunAssigned", "JobRunRunning", "ReprioritisedJob", "JobSucceeded", "JobRunPreempted", "CancelledJob", "JobErrors", "JobRequeued"]
    rows = [(f"j{rng.randrange(6)}", f"r{rng.randrange(9)}", "q", "s", "u", i, 1000 + i, rng.choice(kinds), rng.randrange(9), "why", None, "c", "n", "p", rng.random() < 0.5, rng.choice(["PodError", "JobRejected", "JobRunPreemptedError"]), 1, 3) for i in range(n)]
    return spark.createDataFrame(rows, log(spark, 1).schema)


def shown(tables):
    return {name: sorted(map(str, df.select(*sorted(df.columns)).collect())) for name, df in tables.items()}


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_reduced_parts_do_not_depend_on_cuts(spark, seed):
    events = mixed_log(spark, seed).cache()
    whole = shown(fold.tables_of(fold.reduce_log(events)))
    jobs, runs = fold.fold_log(events)
    assert whole["job"] == shown({"job": jobs})["job"] and whole["job_run"] == shown({"job_run": runs})["job_run"]
    for cuts in ((1,), (17, 18, 50), (5, 30, 44, 80)):
        parts = [fold.reduce_log(events.where((F.col("seq") >= a) & (F.col("seq") < b))) for a, b in zip((0, *cuts), (*cuts, 90))]
        joined = parts[0]
        for part in parts[1:]:  # parts are joined and reduced again, as the store does
            joined = {name: spark.createDataFrame(again.collect(), again.schema) for name, df in joined.items() for again in [fold.REDUCED[name](df.unionByName(part[name]))]}
        assert shown(fold.tables_of(joined)) == whole


def test_job_tables_round_trip(spark, tmp_path):
    jobs = spark.createDataFrame([("a", 3, 5), ("b", 4, 6)], "job_id string, state int, priority long")
    runs = spark.createDataFrame([("r", "a", None), ("s", "b", 9)], "run_id string, job_id string, finished long")
    job_tables.write_tables({"job": jobs, "job_run": runs}, str(tmp_path))
    both = job_tables.read_tables(spark, str(tmp_path), names=("job", "job_run"))
    assert {name: set(df.columns) for name, df in both.items()} == {name: set(job_tables.SCHEMAS[name]) for name in both}
    ended = job_tables.read_tables(spark, str(tmp_path), active=False, names=("job", "job_run"))
    assert [r.job_id for r in ended["job"].collect()] == ["b"] and [r.run_id for r in ended["job_run"].collect()] == ["s"]
    assert "active=false" in "".join(ended["job"].inputFiles()) or "PartitionFilters" in ended["job"]._jdf.queryExecution().toString()


def test_runs_are_not_sorted_to_meet_their_jobs(spark, sf_dir):
    """The ended jobs are hashed and the runs stream by, so that a sort of all runs can't spill."""
    from jobloom.jobs import registry

    plan = registry.queries()["s3_job_tables"](spark, sf_dir)._jdf.queryExecution().sparkPlan().toString()
    assert "ShuffledHashJoin [latest_run_id" in plan and "LeftOuter, BuildLeft" in plan


def test_weighted_cost(spark):
    rows = spark.createDataFrame([(0.5, 2.0), (0.0, 0.0), (0.5, 0.0)], "cost double, weight double")
    assert [r[0] for r in rows.select(fairshare.weighted_cost("cost", "weight")).collect()] == [0.25, 0.0, float("inf")]


def test_statistics_are_exact(spark):
    from jobloom.operators.metrics import statistics

    rows = spark.createDataFrame([("a", v) for v in (5, 1, 1, 9)] + [("b", 3), ("b", None), (None, 2)], "k string, v long")
    got = {r.k: (r["count"], r.sum, r.min, r.max, r.median, r.le_3) for r in statistics(rows, ("k",), "v", (3,)).collect()}
    assert got == {"a": (4, 16, 1, 9, 3.0, 2), "b": (1, 3, 3, 3, 3.0, 1), None: (1, 2, 2, 2, 2.0, 1)}


def test_windows_of_event_time(spark, tmp_path):
    rows = spark.createDataFrame([("r", "cpu", 1.0, 10), ("r", "cpu", 3.0, 20), ("r", "cpu", 5.0, 70)], "run_id string, resource string, current double, s long").select("run_id", "resource", "current", F.timestamp_seconds("s").alias("at"))
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = ingest.windowed_utilisation(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in")), "1 minute", "10 seconds")
    query = stream.writeStream.format("memory").queryName("usage").outputMode("complete").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    assert query.awaitTermination(120)
    assert sorted((r.max_current, r.avg_current) for r in spark.table("usage").collect()) == [(3.0, 2.0), (5.0, 5.0)]


@pytest.mark.parametrize("bad", [Filter("cpu", "startsWith", "1"), Filter("nothing", "exact", 1), Filter("submitted", "exact", 1)])
def test_filters_that_are_not_allowed(bad):
    with pytest.raises(ValueError):
        search.validate([bad])


def test_unknown_state():
    with pytest.raises(ValueError):
        search.state_ordinals(["QUEUED", "NOWHERE"])


def test_groups_cannot_be_ordered_by_state_counts(spark):
    groups = spark.createDataFrame([("q", 1, 1)], "name string, count long, queued long")
    with pytest.raises(ValueError):
        grouping.order_groups(groups, "queued")


@pytest.mark.parametrize(
    ("demands", "capped", "uncapped"),
    [([10.0], [1.0], [1.0]), ([0.01], [0.01], [1.0]), ([10.0, 10.0], [0.5, 0.5], [0.5, 0.5]), ([0.01, 0.4, 10.0], [0.01, 0.4, 0.59], [0.3808333, 0.495, 0.59])],
)
def test_fair_shares(demands, capped, uncapped):
    got = fairshare.share_out([1.0] * len(demands), demands)
    assert got[0] == pytest.approx(capped, abs=1e-6)
    assert got[1] == pytest.approx(uncapped, abs=1e-6)


@pytest.mark.parametrize(("demands", "share"), [([], 1.0), ([1.0], 0.5), ([1.0, 1.0], 1 / 3), ([0.01], 0.99)])
def test_theoretical_share(demands, share):
    assert fairshare.share_out([1.0] * len(demands), demands, 1.0)[0][-1] == pytest.approx(share)


def test_fairness_error(spark):
    shares = spark.createDataFrame([("p", "a", 0.5, 0.5), ("p", "b", 0.5, 0.0)], "pool string, queue string, capped_share double, actual_share double")
    assert fairshare.fairness_error(shares).first().fairness_error == pytest.approx(0.5)


def test_prune_at_ten_hours(spark):
    hour = 3600
    job = spark.createDataFrame([("old", 4, -10 * hour - 60), ("young", 4, -9 * hour), ("running", 3, -11 * hour)], "job_id string, state short, last_transition_time long")
    kept = maintain.prune_jobs({"job": job}, 0, 10 * hour)["job"]
    assert {r.job_id for r in kept.collect()} == {"young", "running"}


def test_hot_and_cold(spark, tmp_path):
    job = spark.createDataFrame([("a", 1), ("b", 4), ("c", 8)], "job_id string, state short")
    maintain.write_hot_cold(job, str(tmp_path / "t"))
    assert {r.job_id for r in maintain.read_hot_cold(spark, str(tmp_path / "t"), True).collect()} == {"a", "c"}
    assert maintain.read_hot_cold(spark, str(tmp_path / "t")).count() == 3


@pytest.mark.parametrize(("text", "milli", "value"), [("100m", True, 100), ("1.5", True, 1500), ("2Gi", False, 2 << 30), ("1e3", False, 1000), ("0.1", False, 1), (None, False, 0), ("junk", False, 0), ("12k", False, 12000)])
def test_quantities(spark, text, milli, value):
    df = spark.createDataFrame([(text,)], "q string")
    assert df.select(parse_quantity(F.col("q"), milli).alias("v")).first().v == value


def test_annotations(spark):
    df = spark.createDataFrame([({"x/a": "1\x00", "SECRET": "2", "b": "v" * 2000},)], "m map<string,string>")
    got = df.select(clean_annotations(F.col("m"), "x/", ["secret"]).alias("m")).first().m
    assert got == {"a": "1", "b": "v" * 1024}


def test_exit_code_zero_never_matches(spark):
    failed = spark.createDataFrame([("r", "", "", [("c", 0, "OOMKilled", "")], [])], "run_id string, pod_reason string, pod_error string, containers array<struct<name:string,exit_code:int,reason:string,termination_message:string>>, pod_events array<struct<type:string,reason:string,message:string>>")
    rules = [health.Rule("oom", ("OOMKilled",)), health.Rule("exit", not_exit_codes=(1,))]
    assert health.categorise_failures(failed, rules, "other").first().category == "other"


def test_positions_and_running_sums(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("k"), (F.col("id") % 3).alias("g"))
    assert [r.position for r in with_position(df, "k").orderBy("k").collect()] == list(range(1000))
    rows = with_running_sum(df, "k", "k", within=("g",)).collect()
    total: dict[int, int] = {}
    for r in sorted(rows, key=lambda r: (r.g, r.k)):
        total[r.g] = total.get(r.g, 0) + r.k
        assert r.running == total[r.g]


def test_bytes_are_cut_greedily(spark):
    df = spark.createDataFrame([("s", i, n) for i, n in enumerate([5, 5, 5, 20, 1, 9, 1])], "key string, seq long, bytes long")
    got = [r.part for r in fold.limit_by_bytes(df, 10, ["key"]).orderBy("seq").collect()]
    assert got == [0, 0, 1, 2, 3, 3, 4]


@pytest.mark.parametrize("name", ["i26_limit_by_bytes", "i26_limit_by_count", "i18_active_jobs_on_executor", "i18_queued_jobs"])
def test_no_group_is_gathered(spark, sf_dir, name):
    from jobloom.jobs import registry

    plan = registry.queries()[name](spark, sf_dir)._jdf.queryExecution().toString()
    assert "FlatMapGroupsInPandas" not in plan and "collect_list" not in plan


def test_cut_functions_compose():
    import random

    import numpy as np

    rng = random.Random(5)
    for _ in range(300):
        most = rng.choice([0, 3, 10, 40])
        stretches = [np.array([rng.choice([0, 0, 1, 2, 5, 12, 50]) for _ in range(rng.randrange(1, 12))]) for _ in range(3)]
        whole = stretches[0]
        function = fold._CutFunction.of_sizes(whole, most)
        for more in stretches[1:]:
            whole = np.concatenate([whole, more])
            function = function.then(fold._CutFunction.of_sizes(more, most), most)
            function = fold._CutFunction.of_rows(function.rows().sample(frac=1, random_state=1))
        fills = np.arange(0, 60)
        for f, got in zip(fills, function.of(fills, most)):
            _, part, filled = fold._walk(whole.tolist(), most, 0, int(f))
            assert (part, filled) == tuple(got)


@pytest.mark.parametrize("most", [0, 5, 20, 10_000])
def test_bytes_are_cut_greedily_across_ranges(spark, most):
    import random

    rng = random.Random(most)
    rows = [("q", "hot" if i % 8 else rng.choice(["a", "z", None]), i, rng.choice([0, 0, 1, 2, 3, 7, 30])) for i in range(1500)]
    df = spark.createDataFrame(rows, "queue string, jobset string, seq long, bytes long").repartition(5)
    want, state = {}, {}
    for _, jobset, i, n in rows:
        part, filled = state.get(jobset, (0, 0))
        if filled and filled + n > most:
            part, filled = part + 1, 0
        state[jobset] = part, filled + n
        want[i] = part
    out = fold.limit_by_bytes(df, most, ["queue", "jobset"])
    assert {r.seq: r.part for r in out.collect()} == want and out.columns == [*df.columns, "part"]
    counts = fold.parts_by_count(df.where("jobset is not null"), 8, ["queue", "jobset"])
    assert counts.where("jobset = 'hot'").groupBy("part").count().where("count = 8").count() == sum(j == "hot" for _, j, _, _ in rows) // 8


def test_nested_runs_carry_what_is_asked(spark, sf_dir):
    from jobloom.jobs import registry

    plan = registry.queries()["q9_q10_nested_runs"](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert "run_id" in plan and not [c for c in ("termination_reason", "failure_category", "annotations", "memory") if c in plan]
