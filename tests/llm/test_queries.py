import __spark_entry__ as entry
from lexiflow.llm import queries as Q


def test_registered_in_order():
    names = [n for n in entry.queries() if n.startswith("p")]
    assert [n for n in names if n.endswith("_found")] == [f"p{i}_found" for i in (1, 2, 3, 4, 5, 8)] and {"p6_ids", "p7_packed", "p7_summary", "p8_levels"} <= {*names}
    assert set(Q.oracle_sql()) <= set(Q.queries())


def test_columns(spark):
    small = "/root/testdata/sf0.001"
    assert Q.p6_ids(spark, small).dtypes == [("doc_id", "bigint"), ("ids", "array<int>")]
    assert Q.p4_found(spark, small).columns == ["token", "mark"]
    assert Q.p2_found(spark, small).columns == ["td_id"]
