"""Settings that registered queries run with."""

import pytest

from featmart.plans import catalog
from featmart.session import MOST_TASKS, TASK_BYTES

SIZE = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
FIRST = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"


@pytest.mark.parametrize("size, first, kept", [("64MB", None, False), ("67108864b", "200", False), ("1g", None, False), ("8m", "1500", True)])
def test_a_task_reads_a_bounded_piece(spark, sf, size, first, kept):
    before = spark.conf.get(SIZE), spark.conf.get(FIRST, None)
    try:
        spark.conf.set(SIZE, size)
        spark.conf.set(FIRST, first) if first else spark.conf.unset(FIRST)
        catalog.PLANS["constant_groups"](spark, sf)
        found = spark.conf.get(SIZE), spark.conf.get(FIRST)
        assert found == ((size, first) if kept else (str(TASK_BYTES), str(MOST_TASKS)))
    finally:
        for key, value in zip((SIZE, FIRST), before):
            spark.conf.set(key, value) if value else spark.conf.unset(key)


@pytest.mark.parametrize("size, kept", [("128MB", False), ("134217728b", False), ("1m", True)])
def test_a_task_scans_a_bounded_piece(spark, sf, size, kept):
    scan = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(scan)
    try:
        spark.conf.set(scan, size)
        catalog.PLANS["tracking_period_card"](spark, sf)
        assert spark.conf.get(scan) == (size if kept else str(TASK_BYTES))
    finally:
        spark.conf.set(scan, before)
