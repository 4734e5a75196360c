import json
import os
import subprocess
import sys
from pathlib import Path

import pyspark
import pytest

from tessera.catalogue import general, interface, reference
from tests.catalogue import TABLES, compare, connection, plain

pytestmark = pytest.mark.skipif(not TABLES.exists(), reason="needs the test tables")
QUERIES, ORACLE = reference.QUERIES | interface.QUERIES | general.QUERIES, reference.ORACLE | interface.ORACLE | general.ORACLE


@pytest.fixture(scope="module")
def con():
    return connection()


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_its_sql(spark, con, name):
    compare(spark, con, QUERIES[name], ORACLE[name])


def test_every_query_is_registered(spark):
    import __spark_entry__

    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries()) >= set(QUERIES)
    assert set(QUERIES) - set(ORACLE) == {"p4_found"}
    assert __spark_entry__.entry(spark).count() > 0


CLUSTER = """
import json, sys
from pyspark.sql import SparkSession
from tessera.catalogue import interface

to, at, name = sys.argv[1:]
spark = (
    SparkSession.builder.master("local-cluster[2,1,1024]").config("spark.executor.memory", "1g").config("spark.ui.enabled", "false").config("spark.driver.host", "127.0.0.1")
    .config("spark.sql.session.timeZone", "UTC").config("spark.checkpoint.dir", f"file://{to}/shared").config("spark.sql.warehouse.dir", f"{to}/warehouse").getOrCreate()
)
try:
    df = interface.QUERIES[name](spark, at)
    print("ROWS", json.dumps([df.columns, [tuple(r) for r in df.collect()], df._jdf.queryExecution().executedPlan().toString()]))
finally:
    spark.stop()
"""


def test_executors_of_their_own_reach_the_database(con, tmp_path):
    home = tmp_path / "home"
    home.mkdir()
    for p in Path(pyspark.__file__).parent.iterdir():
        if p.name != "work":  # where executors of a local cluster keep their files
            (home / p.name).symlink_to(p)
    env = os.environ | {"SPARK_HOME": str(home), "SPARK_SCALA_VERSION": "2.13", "SPARK_LOCAL_IP": "127.0.0.1", "SPARK_LOCAL_DIRS": str(tmp_path), "PYSPARK_PYTHON": sys.executable, "PYTHONPATH": str(Path(__file__).parent.parent)}
    run = subprocess.run([sys.executable, "-c", CLUSTER, str(tmp_path), str(TABLES), "database_aggregate"], env=env, cwd=tmp_path, capture_output=True, text=True, timeout=300)
    told = [x for x in run.stdout.splitlines() if x.startswith("ROWS ")]
    assert told, run.stderr[-3000:]
    columns, found, plan = json.loads(told[0].removeprefix("ROWS "))
    wanted = con.execute(ORACLE["database_aggregate"])
    names = [d[0] for d in wanted.description]
    assert sorted(columns) == sorted(names) and plain(found, columns) == plain(wanted.fetchall(), names)
    assert "PushedAggregates: [COUNT(*), SUM(N_KEY), MAX(N_KEY)]" in plan
