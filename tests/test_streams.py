"""Streams over several files give the tables a batch gives."""

import os

from pyspark.sql import functions as F

from bazaarlens.operators import deals, upsert
from bazaarlens.plans.deal_queries import RAM
from bazaarlens.streaming import jobs


def _files(df, folder, parts):
    for i in range(parts):
        df.where(F.col("part") == i).drop("part").coalesce(1).write.parquet(f"{folder}/in{i}")
    inputs = f"{folder}/in"
    os.makedirs(inputs)
    for i in range(parts):
        name = next(n for n in os.listdir(f"{folder}/in{i}") if n.endswith(".parquet"))
        os.link(f"{folder}/in{i}/{name}", f"{inputs}/{i}.parquet")
    return inputs


def test_snapshot_stream_equals_batch(spark, tmp_path):
    rows = [(f"f{i % 7}", f"{i:03d}", f"2024-01-{1 + i % 28:02d}", f"t{i}", float(i), "EUR", "", "r", i % 3) for i in range(60)]
    df = spark.createDataFrame(
        rows, "fingerprint string, sighting_id string, seen_at string, title string, price double, currency string, query string, run_id string, part int"
    )
    folder = str(tmp_path)
    inputs = _files(df, folder, 3)
    stream = jobs.read_new_files(spark, inputs, df.drop("part").schema, max_files=1)
    run = jobs.snapshot_stream(stream, f"{folder}/out", f"{folder}/cp")
    run.awaitTermination()
    assert jobs.last_batch(run) == 2
    got = jobs.latest_snapshot(spark, f"{folder}/out", 2).select("fingerprint", "seen_count", "first_seen", "last_seen")
    want = upsert.upsert_listings(None, df.drop("part")).select(*got.columns)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    assert spark.read.parquet(f"{folder}/out/observations").count() == 60


def test_decisions_and_seen_state(spark, tmp_path):
    rows = [(f"l{i % 10}", "EBAY", "DDR4 RAM 32gb", "", float(i), None, "2024-01-01 00:00:00", i % 2) for i in range(20)]
    df = spark.createDataFrame(
        rows, "listing_id string, platform string, title string, description string, price double, image_url string, seen string, part int"
    )
    folder = str(tmp_path)
    inputs = _files(df, folder, 2)
    stream = jobs.with_event_time(jobs.read_new_files(spark, inputs, df.drop("part").schema, max_files=1), "seen")
    fresh = jobs.unseen(stream, ["listing_id"], "event_time")
    jobs.decide_stream(fresh, RAM, f"{folder}/out", f"{folder}/cp").awaitTermination()
    got = spark.read.parquet(f"{folder}/out/decisions")
    assert got.count() == 10 and got.select("listing_id").distinct().count() == 10
    assert deals.run_stats(got).first()["notified"] == spark.read.parquet(f"{folder}/out/alerts").count()


def test_offers_over_the_cap_wait_for_the_next_cycle(spark, tmp_path):
    from dataclasses import replace

    rows = [(f"l{i:02d}", "EBAY", "DDR4 RAM 32gb", "", float(i), None, "2024-01-01 00:00:00", i % 3) for i in range(12)]
    df = spark.createDataFrame(
        rows, "listing_id string, platform string, title string, description string, price double, image_url string, seen string, part int"
    )
    folder = str(tmp_path)
    inputs = _files(df, folder, 3)
    stream = jobs.read_new_files(spark, inputs, df.drop("part").schema, max_files=1)
    jobs.decide_stream(stream, replace(RAM, max_total_items=3), f"{folder}/out", f"{folder}/cp").awaitTermination()
    decided = [r["listing_id"] for r in spark.read.parquet(f"{folder}/out/decisions").collect()]
    rest = [r["listing_id"] for r in jobs.waiting(spark, f"{folder}/out", 2).collect()]
    assert len(decided) == 9 and sorted(decided + rest) == [f"l{i:02d}" for i in range(12)]


def test_dry_runs_write_nothing(spark, tmp_path):
    policy = jobs.WritePolicy.of(full_dry_run=True)
    assert not (policy.state or policy.decisions or policy.alerts)
    assert jobs.WritePolicy.of(quiet=True) == jobs.WritePolicy(True, True, False)


OFFERS = "listing_id string, platform string, title string, description string, price double, image_url string"


def _offers(spark, folder, ids):
    rows = [(i, "EBAY", "DDR4 RAM 32gb", "", 50.0, None) for i in ids]
    spark.createDataFrame(rows, OFFERS).repartition(3).write.mode("append").parquet(f"{folder}/in")
    return jobs.first_sightings(jobs.read_new_files(spark, f"{folder}/in", spark.createDataFrame([], OFFERS).schema))


def _by_turn(spark, folder):
    by = {}
    for r in spark.read.parquet(f"{folder}/out/decisions").select("batch", "turn", "listing_id").collect():
        by.setdefault((r["batch"], r["turn"]), []).append(r["listing_id"])
    return {k: sorted(ids) for k, ids in by.items()}


def test_queue_is_fair_over_restarts_and_repeated_turns(spark, tmp_path):
    from dataclasses import replace

    folder, rules = str(tmp_path), replace(RAM, max_total_items=4)
    spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "false")
    try:
        # the second run brings smaller ids and repeats, which must not go before the first run's rest
        for ids in (["m%d" % i for i in range(6)], ["a1", "a2", "a3", "m1", "m5", "a1"], ["b1"]):
            jobs.decide_stream(_offers(spark, folder, ids), rules, f"{folder}/out", f"{folder}/cp").awaitTermination()
    finally:
        spark.conf.unset("spark.sql.streaming.noDataMicroBatches.enabled")
    want = {(0, 0): ["m0", "m1", "m2", "m3"], (1, 0): ["a1", "a2", "m4", "m5"], (2, 0): ["a3", "b1"]}
    assert _by_turn(spark, folder) == want
    assert jobs.waiting(spark, f"{folder}/out", 0).count() == 2
    assert jobs.waiting(spark, f"{folder}/out", 1).count() == 1
    # a turn that is run again after a failure finds its head and gives the same decisions
    jobs._turn(spark, rules, f"{folder}/out", (1, 0), jobs.WritePolicy())
    assert _by_turn(spark, folder) == want
    assert jobs.drain(spark, rules, f"{folder}/out") == 0


def test_drain_takes_turns_until_none_waits(spark, tmp_path):
    from dataclasses import replace

    folder, rules = str(tmp_path), replace(RAM, max_total_items=2)
    stream = _offers(spark, folder, ["m%d" % i for i in range(7)]).sparkSession
    plain = jobs.read_new_files(stream, f"{folder}/in", spark.createDataFrame([], OFFERS).schema)
    jobs.decide_stream(plain, rules, f"{folder}/out", f"{folder}/cp").awaitTermination()
    assert jobs.drain(spark, rules, f"{folder}/out", turns=1) == 1
    assert sorted(r["listing_id"] for r in jobs.waiting(spark, f"{folder}/out", 0).collect()) == ["m4", "m5", "m6"]
    assert jobs.drain(spark, rules, f"{folder}/out") == 2
    assert _by_turn(spark, folder) == {(0, 0): ["m0", "m1"], (0, 1): ["m2", "m3"], (0, 2): ["m4", "m5"], (0, 3): ["m6"]}


def test_full_dry_run_leaves_the_folder_empty(spark, tmp_path):
    from dataclasses import replace

    folder = str(tmp_path)
    for cap in (0, 2):
        stream = _offers(spark, folder, ["m1", "m2", "m3"])
        policy = jobs.WritePolicy.of(full_dry_run=True)
        jobs.decide_stream(stream, replace(RAM, max_total_items=cap), f"{folder}/out", f"{folder}/cp{cap}", policy).awaitTermination()
    assert not os.path.exists(f"{folder}/out")


def test_a_batch_rewrites_only_the_buckets_it_touches(spark, tmp_path):
    from bazaarlens.streaming import snapshots

    folder, schema = str(tmp_path), "fingerprint string, sighting_id string, seen_at string, title string, price double"
    batches = [
        [(f"f{i}", f"{i:03d}", "2024-03-01", f"t{i}", float(i)) for i in range(40)],
        [("f1", "900", "2024-02-01", "older", 7.0), (None, "901", "2024-02-01", "no key", 1.0)],
        [("f1", "902", "2024-04-01", "newer", 8.0)],
        [],
        [("f2", "903", "2024-04-01", "newer", 9.0)],
    ]
    tables = [spark.createDataFrame(b, schema) for b in batches]
    # urls are known from the third batch on
    tables[2] = tables[2].withColumn("url", F.lit("u"))
    for n, rows in enumerate(tables):
        # the second time as after a failure
        for _ in range(2):
            snapshots.merge_batch(rows, upsert.upsert_listings, "fingerprint", folder, n, buckets=16)
        written = [d for d in os.listdir(f"{folder}/snapshot/batch={n}") if d.startswith("_bucket")]
        assert len(written) <= len(batches[n])
    everything = tables[0]
    for t in tables[1:]:
        everything = everything.unionByName(t, allowMissingColumns=True)
    columns = ["fingerprint", "title", "price", "url", "seen_count", "first_seen", "last_seen"]
    got = snapshots.read_snapshot(spark, folder, 4).select(*columns)
    want = upsert.upsert_listings(None, everything).select(*columns)
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect())) and got.count() == 41
    # versions that no kept manifest names are gone
    named = set()
    for n in (3, 4):
        named |= {(r["version"], r["bucket"]) for r in spark.read.parquet(f"{folder}/manifest/batch={n}").collect()}
    there = {(n, int(d[8:])) for n in range(5) for d in os.listdir(f"{folder}/snapshot/batch={n}") if d.startswith("_bucket=")}
    assert there == named and sorted(os.listdir(f"{folder}/manifest")) == ["batch=3", "batch=4"]


def test_snapshot_of_nothing(spark, tmp_path):
    from bazaarlens.streaming import snapshots

    rows = spark.createDataFrame([], "fingerprint string, sighting_id string, seen_at string, price double")
    for n in range(3):
        snapshots.merge_batch(rows, upsert.upsert_listings, "fingerprint", str(tmp_path), n)
    assert snapshots.read_snapshot(spark, str(tmp_path), 2).count() == 0


def test_alerts_come_from_the_decisions_written(spark, tmp_path, monkeypatch):
    """A cycle holds no decisions in memory: they are written once, and alerts and prices are read from there."""
    held = []
    offers = spark.createDataFrame(
        [("a", "EBAY", "2x32GB Corsair DDR4 RAM", "memoria", 90.0, None), ("b", "EBAY", "sedia", "", 9.0, None)],
        "listing_id string, platform string, title string, description string, price double, image_url string",
    )
    monkeypatch.setattr(type(offers), "persist", lambda self, *a, **k: held.append(self) or self)
    read = {}
    for name, policy in (("all", jobs.WritePolicy()), ("silent", jobs.WritePolicy(decisions=False))):
        jobs._write(offers, RAM, f"{tmp_path}/{name}", (0, 0), policy)
        read[name] = [[r["listing_id"] for r in spark.read.parquet(f"{tmp_path}/{name}/{kind}").collect()] for kind in ("alerts", "prices")]
        assert len(held) == (name == "silent")
    assert read["all"] == read["silent"] == [["a"], ["a"]]
