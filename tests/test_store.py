import os
import time

import pytest
from pyspark.sql import functions as F

from ladder.sources import store


def test_materialize_reuses_until_inputs_change(spark, tmp_out):
    src = os.path.join(tmp_out, "src.parquet")
    spark.range(10).write.parquet(src)
    builds = []

    def build():
        builds.append(1)
        return spark.read.parquet(src).select((F.col("id") * 2).alias("x"))

    first = store.materialize(spark, build, "t", [src])
    assert first.count() == 10 and len(builds) == 1
    again = store.materialize(spark, build, "t", [src])
    assert again.count() == 10 and len(builds) == 1
    time.sleep(1.1)  # a newer modification time on the changed input
    spark.range(20).write.mode("overwrite").parquet(src)
    changed = store.materialize(spark, build, "t", [src])
    assert changed.count() == 20 and len(builds) == 2


def _scratch_folders(spark):
    root = store.table_root(spark).removeprefix("file:") + "/_scratch"
    return sorted(os.listdir(root)) if os.path.isdir(root) else []


def test_nested_inputs_change_the_fingerprint(spark, tmp_out):
    src = os.path.join(tmp_out, "src.parquet")
    spark.range(4).selectExpr("id", "1 a", "id % 2 b").write.partitionBy("a", "b").parquet(src)
    before = store.fingerprint(spark, [src])
    assert store.fingerprint(spark, [src]) == before
    spark.range(1).write.mode("append").parquet(f"{src}/a=1/b=1")
    assert store.fingerprint(spark, [src]) != before


def test_a_failing_build_leaves_nothing(spark, tmp_out):
    before = _scratch_folders(spark)

    def build():
        store.write_scratch(spark.range(5))
        return spark.range(3).select(F.raise_error(F.lit("no")).alias("x"))

    with pytest.raises(Exception, match="no"):
        store.materialize(spark, build, "failing", [])
    root = store.table_root(spark).removeprefix("file:")
    assert _scratch_folders(spark) == before
    assert not [x for x in os.listdir(root) if x.startswith("failing")]


def _tables(spark, name):
    root = store.table_root(spark).removeprefix("file:")
    return sorted(x for x in os.listdir(root) if x.startswith(f"{name}-") and not x.endswith(".crc"))


def test_the_first_of_two_publishers_wins(spark):
    def build():
        # another driver builds and publishes the same table meanwhile
        path = f"{store.table_root(spark)}/raced-{store.fingerprint(spark, [], 'raced')}"
        spark.range(7).write.parquet(f"{path}.other")
        assert store.publish(spark, path, "other") == f"{path}.other"
        return spark.range(5)

    assert store.materialize(spark, build, "raced", []).count() == 7
    assert store.materialize(spark, build, "raced", []).count() == 7
    assert len(_tables(spark, "raced")) == 2  # the winner's folder and the manifest


def test_interleaved_publishers_leave_one_whole_table(spark, monkeypatch):
    path = f"{store.table_root(spark)}/both-1"
    spark.range(3).write.parquet(f"{path}.a")
    spark.range(4).write.parquet(f"{path}.b")
    # A store that can't refuse a second file: the later manifest counts, and the earlier folder stays for its readers.
    old = store.write_json
    monkeypatch.setattr(store, "write_json", lambda s, p, d, replace=False: old(s, p, d, True))
    first, second = store.publish(spark, path, "a"), store.publish(spark, path, "b")
    assert (first, second) == (f"{path}.a", f"{path}.b") and store.published(spark, path) == second
    assert spark.read.parquet(first).count() == 3 and spark.read.parquet(second).count() == 4


def test_a_killed_publisher_leaves_nothing_that_counts(spark):
    name, made = "killed", []
    path = f"{store.table_root(spark)}/{name}-{store.fingerprint(spark, [], name)}"
    spark.range(9).write.parquet(f"{path}.dead")  # data without a manifest
    assert store.published(spark, path) is None
    fs, hpath = store._hadoop(spark, f"{path}.json")
    out = fs.create(hpath, False)
    out.write(bytearray(b'{"data": "dead", "fi'))  # killed while it wrote the manifest
    out.close()
    assert store.materialize(spark, lambda: made.append(1) or spark.range(5), name, []).count() == 5
    assert store.materialize(spark, lambda: made.append(1) or spark.range(5), name, []).count() == 5 and len(made) == 1


def test_a_table_with_a_lost_file_is_built_again(spark):
    made = []

    def get():
        return store.materialize(spark, lambda: made.append(1) or spark.range(8).repartition(2), "lossy", [])

    assert get().count() == 8
    os.remove(get().inputFiles()[0].removeprefix("file://"))
    assert get().count() == 8 and len(made) == 2


def test_cluster_sessions_need_a_checkpoint_folder():
    class Sc:
        master = "local-cluster[2,1,512]"
        getCheckpointDir = staticmethod(lambda: None)

    class Session:
        sparkContext = Sc()

        class conf:
            get = staticmethod(lambda key, default=None: default)

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        store.ensure_checkpoint_dir(Session())


def test_write_scratch_cuts_lineage_and_is_cleaned_by_materialize(spark):
    before = _scratch_folders(spark)

    def build():
        numbered = store.write_scratch(spark.range(5).withColumn("y", F.col("id") + 1))
        assert "FileScan parquet" in numbered._jdf.queryExecution().executedPlan().toString()
        return numbered

    out = store.materialize(spark, build, "scratch_user", [])
    assert sorted(r.y for r in out.collect()) == [1, 2, 3, 4, 5]
    assert _scratch_folders(spark) == before


def test_a_changed_input_is_seen_at_the_next_call(spark, tmp_out):
    """Nothing to invalidate: a query called with a plain path sees the input as it is then."""
    import shutil

    from support import SF_SMALL
    from ladder.plans.queries import QUERIES
    from ladder.sources.tables import TABLES

    sf = os.path.join(tmp_out, "sf")
    os.makedirs(sf)
    for t in TABLES:
        shutil.copy(f"{SF_SMALL}/{t}.parquet", f"{sf}/{t}.parquet")
    before = QUERIES["latest_year"](spark, sf).first().latest_year
    orders = spark.read.parquet(f"{SF_SMALL}/orders.parquet")
    time.sleep(1.1)
    orders.where(F.year("o_orderdate") < before).write.mode("overwrite").parquet(f"{sf}/orders_new.parquet")
    shutil.rmtree(f"{sf}/orders.parquet", ignore_errors=True)
    if os.path.exists(f"{sf}/orders.parquet"):
        os.remove(f"{sf}/orders.parquet")
    os.rename(f"{sf}/orders_new.parquet", f"{sf}/orders.parquet")
    after = QUERIES["latest_year"](spark, sf).first().latest_year
    assert after == before - 1


def _copy_of(sf, tables=("orders", "customer", "lineitem", "supplier", "nation")):
    import shutil

    from support import SF_SMALL

    for t in tables:
        shutil.copy(f"{SF_SMALL}/{t}.parquet", f"{sf}/{t}.parquet")


def test_a_file_replaced_midway_is_noticed(spark, tmp_out):
    from ladder.plans.dashboard import shared_statements
    from ladder.plans.queries import QUERIES
    from ladder.sources.run import InputChanged

    _copy_of(tmp_out)
    with pytest.raises(InputChanged, match="orders"):
        with shared_statements(spark, tmp_out) as run:
            QUERIES["income_by_decile"](spark, run).collect()
            time.sleep(1.1)
            _copy_of(tmp_out, ["orders"])


def test_files_added_midway_are_not_read(spark, tmp_out):
    from ladder.sources.run import Run
    from ladder.sources.tables import read_table

    spark.range(10).write.parquet(f"{tmp_out}/orders.parquet")
    run = Run(tmp_out)
    assert read_table(spark, run, "orders").count() == 10
    files = run.files(f"{tmp_out}/orders.parquet")
    spark.range(5).write.mode("append").parquet(f"{tmp_out}/orders.parquet")
    assert read_table(spark, run, "orders").count() == 10 and run.files(f"{tmp_out}/orders.parquet") == files
    run.verify()
    assert read_table(spark, Run(tmp_out), "orders").count() == 15


def test_pinned_files_are_those_listed(spark, tmp_out):
    spark.range(100).selectExpr("id", "id % 40 k").write.partitionBy("k").parquet(f"{tmp_out}/t")
    want = [f for f in store.list_files(spark, f"{tmp_out}/t") if f[0].endswith(".parquet")]
    assert store.pinned_files(spark.read.parquet(f"{tmp_out}/t")) == want and len(want) >= 40
