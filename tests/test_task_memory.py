"""Bytes of one task, and the packed traits of image marks."""

from __future__ import annotations

import pytest

from foliometer import session
from foliometer.operators import marks

SIZES = ("spark.sql.files.maxPartitionBytes", "spark.sql.adaptive.advisoryPartitionSizeInBytes")


@pytest.mark.parametrize(("given", "after"), [("128MB", (32 << 20, 16 << 20)), ("9437184b", (9 << 20, 9 << 20))])
def test_a_task_reads_a_bounded_number_of_bytes(spark, given, after):
    fresh = spark.newSession()
    for key in SIZES:
        fresh.conf.set(key, given)
    session.configure(fresh)
    assert tuple(session.size_in_bytes(fresh.conf.get(key)) for key in SIZES) == after


def test_image_marks_hold_one_number_for_all_traits(spark):
    columns = "doc_id int, digest int, page_no int, a double, b double, c double, d double, e double, f double, "
    columns += "alpha double, has_smask boolean, x0 double, y0 double, x1 double, y1 double"
    page, unit = (0.0, 0.0, 10.0, 10.0), (5.0, 0.0, 0.0, 5.0, 2.5, 2.5)
    rows = [
        (1, 7, 1, *unit, 1.0, False, *page),
        (1, 7, 2, *unit, None, None, *page),  # unknown on this page, false on the other
        (1, 8, 1, 1.0, 1.0, -1.0, 1.0, 0.0, 0.0, None, None, *page),  # tilted; transparency never known
        (1, 9, 1, 1.0, 0.0, 0.0, 1.0, 0.0, 0.0, 1.0, False, *page),  # plain
        (2, 7, 1, None, 1.0, 0.0, 1.0, 0.0, 0.0, 0.4, None, *page),  # no box
        (2, 7, 1, *unit, 0.4, False, *page),
    ]
    lengths = spark.createDataFrame([(1, 2), (2, 1)], "doc_id int, n_pages int")
    found = marks.detect_image_marks(spark.createDataFrame(rows, columns), lengths)
    plan = found._jdf.queryExecution().toString()
    assert "bit_or(" in plan and "max(diagonal" not in plan
    names = ("doc_id", "digest", "n_pages", "most_per_page", "diagonal", "transparent", "centred", "big", "total_pages")
    assert sorted(tuple(row[name] for name in names) for row in found.collect()) == [
        (1, 7, 2, 1, False, False, True, True, 2),
        (1, 8, 1, 1, True, None, False, False, 2),
        (2, 7, 1, 2, False, True, True, True, 1),
    ]
