"""Words of sessions, counted in stretches of rows."""

import pyarrow as pa
from pyspark.sql import functions as F

from quarry.operators import tags, words

ROWS = [
    ("s", None, "Foo foo FOO barbar x1"), ("s", -5, "BarBar baz-1 Foo"), ("s", -5, "barBar Ab the The"), ("t", 2, "ABC abc def1 Def1"), ("t", 1, "abc ABC. 12 Defdef."),
    ("t", 2**62, "zzzz ZZZZ defDef"), ("u", -(2**63), "zeta ZETA beta"), ("u", 2**63 - 1, "beta Beta"), ("u", 3, None),
]


def _turns(spark):
    d = spark.createDataFrame(ROWS, "session_id string, seq long, text string")
    return d.withColumns({"is_meta": F.lit(0), "is_sidechain": F.lit(0)})


def _plan(d):
    return d._jdf.queryExecution().executedPlan().toString()


def test_stretches_are_bounded_and_add_up():
    rb = pa.RecordBatch.from_arrays([pa.array([r[0] for r in ROWS]), pa.array([r[1] for r in ROWS], pa.int64()), pa.array([r[2] or "" for r in ROWS])], names=["session_id", "seq", "text"])
    whole = [r for b in words._counts()(iter([rb])) for r in b.to_pylist()]
    parts = [b.to_pylist() for b in words._counts(held=3)(iter([rb]))]
    assert max(map(len, parts)) < len(whole) and len(parts) > 3
    n = {}
    for r in (r for p in parts for r in p):
        n[r["session_id"], r["low"]] = n.get((r["session_id"], r["low"]), 0) + r["n"]
    assert n == {(r["session_id"], r["low"]): r["n"] for r in whole}
    assert next((r["seq"], r["word"]) for r in whole if (r["session_id"], r["low"]) == ("t", "abc")) == (1, "abc")
    assert next((r["seq"], r["pos"]) for r in whole if (r["session_id"], r["low"]) == ("u", "beta")) == (-(2**63), 2)


def test_tags_sort_no_words_where_they_are_read(spark):
    plan = _plan(tags.derive(_turns(spark)))
    assert plan.count("MapInArrow") == 1  # texts are cut into words once
    below = plan[: plan.index("MapInArrow")].rsplit("Exchange", 1)[1]
    assert "Aggregate" not in below and "Sort" not in below
