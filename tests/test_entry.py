import os
import sys

import pytest

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data here")


def test_every_query_has_rows_or_a_schema(spark):
    import __spark_entry__ as e
    from loomline.plans.catalogue import REGISTRY

    assert e.entry(spark).limit(1).count() == 1
    known, sql = e.queries(), e.oracle_sql()
    assert set(sql) <= set(known)
    for name, make in known.items():
        frame = make(spark, DATA) if name in REGISTRY.queries else None
        if frame is not None:
            assert len(frame.columns) == len(set(frame.columns)), name
            frame.write.format("noop").mode("overwrite").save()  # every query of the core runs


def test_core_does_not_need_the_subpackage():
    core = [m for m in sys.modules if m.startswith("loomline.") and ".llm" not in m]
    for m in core:
        path = getattr(sys.modules[m], "__file__", None)
        if path:
            assert "loomline.llm" not in open(path, encoding="utf-8").read(), m
