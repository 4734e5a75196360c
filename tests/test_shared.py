from pathlib import Path

import pytest
from pyspark import SparkFiles

from tessera.plans.shared import ensure_checkpoint_dir, hot_keys, own_folder, pairs_within, scratch, share, store
from tests.conftest import rows


def test_no_machine_local_folder_on_a_cluster():
    for master in ("spark://host:7077", "yarn", "k8s://https://host"):
        with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
            own_folder(master)
    assert Path(own_folder("local[4]")).is_dir()


def test_stored_tables_go_with_their_scope(spark):
    folder = Path(ensure_checkpoint_dir(spark).removeprefix("file:"))
    kept = store(spark.range(5))
    with scratch(spark):
        held = set(folder.glob("table-*"))
        assert rows(store(spark.range(3))) == [(0,), (1,), (2,)]
        assert len(set(folder.glob("table-*")) - held) == 1
    assert set(folder.glob("table-*")) == held and kept.count() == 5


def test_shared_bytes_reach_every_task(spark):
    for _ in range(2):
        name = share(spark, "some-bytes.bin", b"\x00\x01\xff" * 1_000)

    def read(batches):
        for batch in batches:
            import pyarrow as pa

            size = len(Path(SparkFiles.get(name)).read_bytes())
            yield pa.RecordBatch.from_pydict({"n": [size] * batch.num_rows})

    assert set(rows(spark.range(0, 8, 1, 4).mapInArrow(read, "n long"))) == {(3_000,)}


def test_hot_keys(spark):
    df = spark.createDataFrame([("a", 5), ("a", 6), ("b", 1), (None, 9), ("c", 20)], "k string, n int")
    assert hot_keys(df, "k", None, 2, 9) == [("a", 2)] and hot_keys(df, "k", "n", 11, 9) == [("c", 20), ("a", 11)] and hot_keys(df, "k", "n", 1, 1) == [("c", 20)]


def test_pairs_within_groups(spark):
    data = [(g, i) for g, n in (("a", 40), ("b", 1), ("c", 2)) for i in range(n)]
    found = rows(pairs_within(spark.createDataFrame(data, "g string, i int").repartition(3), ["g"], "i", 7))
    assert found == sorted(((g, i, j) for g, i in data for h, j in data if g == h and i < j), key=repr)
