"""The decision matrix filter: every cohort takes part in the query, and the filters it leaves
out work by themselves."""
from facetwise.operators import decision as DM
from facetwise.plans import q_decision

SCHEMA = ("shape string, size_range string, color string, clarity string, confidence int, stock_pcs int, sales_pct double, vdb_rate double, "
          "current_rate double, inventory_ratio double, sales_history_available boolean, recommendation_score double, action string")
ROWS = [("ROUND", "1.00-1.10", "D", "IF", 70), ("OVAL", "2.00-2.10", "E", "VS1", 60), ("ROUND", "2.00-2.10", "F", "SI1", 79), ("OVAL", "1.00-1.10", "D", "IF", 80)]


def matrix(spark):
    rest = (10, 150.0, None, None, 0.4, True, 50.0, "Hold")
    return spark.createDataFrame([(*r, *rest) for r in ROWS], SCHEMA)


def test_the_filter_query_keeps_every_shape_and_size(spark, monkeypatch):
    monkeypatch.setattr(q_decision, "dm_df", lambda s, d: matrix(s))
    found = q_decision.decision_matrix_filter(spark, "").select("shape", "size_range").collect()
    assert sorted(map(tuple, found)) == [("OVAL", "2.00-2.10"), ("ROUND", "1.00-1.10"), ("ROUND", "2.00-2.10")]


def test_equality_and_text_filters(spark):
    shown = lambda **f: sorted(r["confidence"] for r in DM.matrix_filter(matrix(spark), **f).collect())
    assert shown(shape="ROUND", search="Round 1.") == [70]
    assert shown(color="D") == [70, 80] and shown(search="2.10 e") == [60]
