"""column_vote_customer: votes of all labels over all columns."""

from veilspark.config import EngineConfig
from veilspark.operators.tables import column_votes
from veilspark.plans.queries import QUERIES


def test_every_column_votes(spark, tmp_path):
    rows = [(k, f"c{k}", "ann@example.org" if k % 2 else "call EMP-12345", 1.5, "BUILDING") for k in range(1, 8)]
    rows += [(8, "=A1", "", 0.0, None), (9, None, "bob@example.org, EMP-54321", 2.0, "10.0.0.1")]
    spark.createDataFrame(rows, "c_custkey long, c_name string, c_address string, c_acctbal double, c_mktsegment string").write.parquet(f"{tmp_path}/customer.parquet")
    got = {(r["name"], r["label"]): (r["votes"], r["hit_cells"]) for r in QUERIES["column_vote_customer"](spark, str(tmp_path)).collect()}
    assert got == {("c_address", "EMAIL"): (5, 8), ("c_address", "EMPLOYEE_ID"): (4, 8), ("c_mktsegment", "SWIFT_CODE"): (7, 8), ("c_mktsegment", "IP_ADDRESS"): (1, 8)}


def test_values_are_detected_once_and_by_many_tasks(spark):
    long = spark.createDataFrame([(k, i, f"c{i}", v) for k, v in enumerate(("ann@example.org", "EMP-12345 ABC-1234", "10.0.0.1", "none")) for i in range(2)], "row_id long, ix int, name string, value string")
    votes = column_votes(long, EngineConfig(ignored_column_labels=("IP_ADDRESS", "EMPLOYEE_ID")))
    assert votes.columns == ["ix", "name", "label", "votes", "first", "hit_cells"]
    plan = votes._sc._jvm.PythonSQLUtils.explainString(votes._jdf.queryExecution(), "simple")
    assert plan.count("[_merged(") == 1 and "RoundRobinPartitioning(4)" in plan
    got = {(r["ix"], r["name"], r["label"], r["votes"], tuple(r["first"]), r["hit_cells"]) for r in votes.collect()}
    assert got == {(i, f"c{i}", label, 1, (row, pos), 2) for i in range(2) for label, row, pos in (("EMAIL", 0, 0), ("LICENSE_PLATE", 1, 1))}
