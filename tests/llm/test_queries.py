import pytest

from tessera.llm.queries import ORACLE, QUERIES
from tests.catalogue import TABLES, compare, connection

pytestmark = pytest.mark.skipif(not TABLES.exists(), reason="needs the test tables")


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_its_sql(spark, name):
    compare(spark, connection(), QUERIES[name], ORACLE[name])


def test_the_others_have_a_row_for_each_document(spark):
    documents = spark.read.parquet(f"{TABLES}/documents.parquet")
    for name in ("p6_ids", "p8_forms"):
        assert QUERIES[name](spark, str(TABLES)).select("doc_id").subtract(documents.select("doc_id")).count() == 0
        assert QUERIES[name](spark, str(TABLES)).count() == documents.count()
    shares = QUERIES["p7_shares"](spark, str(TABLES)).collect()
    assert len(shares) == 8 and abs(sum(r.reached_share for r in shares) - 1) < 1e-9
