"""The forward index of related terms: first spellings, met without a sort of all words."""

import re

from pyspark.sql import functions as F

from quarry.functions.text import STOPWORDS
from quarry.operators import related

ROWS = [
    ("s", None, "Foo foo FOO barbar x1"), ("s", -5, "BarBar baz-1 Foo"), ("s", -5, "barBar Ab the The"), ("t", 2, "ABC abc def1 Def1"), ("t", 1, "abc ABC. 12 Defdef."),
    ("t", 2**62, "zzzz ZZZZ defDef"), ("u", -(2**63), "zeta ZETA beta"), ("u", 2**63 - 1, "beta Beta"), ("u", 3, None),
]


def _turns(spark):
    d = spark.createDataFrame(ROWS, "session_id string, seq long, text string")
    return d.withColumns({"is_meta": F.lit(0), "is_sidechain": F.lit(0)})


def _first():
    """(session, low) to (seq, spelling) of the first distinctive word; null comes before any number."""
    out = {}
    for s, seq, text in sorted(ROWS, key=lambda r: (r[1] is not None, r[1] or 0)):
        for w in re.findall(r"[A-Za-z0-9][A-Za-z0-9._-]*", text or ""):
            if (len(w) > 3 or re.search("[0-9_-]", w) or w.isupper() and len(w) > 1) and w.lower() not in STOPWORDS and re.search("[a-z]", w.lower()):
                out.setdefault((s, w.lower()), (seq, w))
    return out


def _plan(d):
    return d._jdf.queryExecution().executedPlan().toString()


def test_forward_index_keeps_first_spelling(spark, tmp_path):
    related.add_to_forward(_turns(spark), str(tmp_path / "f"))
    got = {(r.session_id, r.low): (r.seq, r.term) for r in related.Store(spark, str(tmp_path / "f")).read("terms").collect()}
    assert got == _first()
    assert got["s", "foo"] == (None, "FOO") and got["u", "beta"] == (-(2**63), "beta")


def test_distinctive_words_are_met_in_a_hash_table(spark):
    plan = _plan(related.distinctive(_turns(spark)))
    assert "HashAggregate" in plan and "Sort" not in plan
