import json

from tessera.streaming.actions import act_on
from tessera.streaming.intervals import gap_changes
from tests import world


def test_gaps_of_a_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    schema = "k string, lo long, hi long"

    def send(n, *data):
        (tmp_path / "in" / f"{n}.json").write_text("\n".join(json.dumps(dict(zip(("k", "lo", "hi"), d))) for d in data))

    send(0, ("a", 0, 10), ("a", 20, 30), ("b", 5, 6), (None, 1, 2), ("a", 9, 9))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
    query = gap_changes(stream, "k", "lo", "hi").writeStream.outputMode("update").format("memory").queryName("gaps").option("checkpointLocation", str(tmp_path / "state")).start()
    try:
        query.processAllAvailable()
        send(1, ("a", 12, 14), ("b", 6, 9))
        query.processAllAvailable()
        send(2, ("a", 5, None))
        query.processAllAvailable()
    finally:
        query.stop()
    found = sorted(map(tuple, spark.table("gaps").collect()))
    assert found == [("a", 10, 12, "closed"), ("a", 10, 12, "opened"), ("a", 10, 20, "closed"), ("a", 10, 20, "opened"), ("a", 14, 20, "closed"), ("a", 14, 20, "opened")]


def test_actions_from_a_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "0.json").write_text('{"request_id": 1, "identity": "KX-5060", "dept": "D03"}\n{"request_id": 2, "identity": "KX-5061", "dept": "D99"}')
    stream = spark.readStream.schema("request_id long, identity string, dept string").json(str(tmp_path / "in"))
    done = []
    query = act_on(stream, lambda: world.engine(spark), "equipment", "transfer", lambda batches, after, n: done.append((n, [b.ledger().count() for b in batches]))).option("checkpointLocation", str(tmp_path / "state")).start()
    try:
        query.processAllAvailable()
    finally:
        query.stop()
    assert done == [(0, [1])]
