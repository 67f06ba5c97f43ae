"""What plans of registered queries compute once."""

import __spark_entry__ as entry


def test_match_terms_are_extracted_once(spark, sf):
    d = entry.queries()["recall_match_terms"](spark, sf)
    assert d._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract_all") == 1
    assert d.where("terms = ''").count() == 0
