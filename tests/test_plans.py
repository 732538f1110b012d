"""Plans stay as designed: pushed filters, pruned columns, a top-1 before the shuffle."""

from keyfold import catalogue
from keyfold.config import StorageConfig
from keyfold.operators import log
from keyfold.plans.store import Store


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_latest_limits_before_the_shuffle(spark, sf):
    text = plan(log.latest(catalogue.events_log(spark, sf)))
    assert text.count("WindowGroupLimit") == 2 and text.count("Exchange hashpartitioning") == 1
    assert "ReadSchema: struct<event_id:bigint,user_id:bigint,event_type:string,props:string>" in text


def test_sizes_read_what_they_need(spark, sf):
    assert "l_" not in plan(catalogue.kv_multi_get(spark, sf))
    assert "Exchange" not in plan(catalogue.kv_entry_size(spark, sf))


def test_store_pushes_keys_to_the_scan(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"), StorageConfig())
    store.apply(spark.createDataFrame([(i, "SET", b"k%d" % i, b"v") for i in range(9)], "seq bigint, op string, key binary, value binary"))
    text = plan(store.get(b"k3"))
    assert "EqualTo(key" in text and "PushedFilters" in text
    assert plan(store.get(b"zz")).count("FileScan") == 0


def test_folds_are_one_shuffle_and_no_global_gather(spark, sf):
    text = plan(catalogue.kv_rotation_exact(spark, sf))
    assert text.count("Exchange") == 1 and "SinglePartition" not in text
