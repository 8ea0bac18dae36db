"""Helpers of the functions folder."""

from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from cliploom.functions.ranking import placed
from cliploom.functions.shared import stored, work_tables


@pytest.mark.parametrize("group", [[], ["g"], ["g", "h"]])
def test_places_as_by_counting(spark, group):
    rng = np.random.default_rng(3)
    rows = [(None if g == 3 else int(g), str(h), None if v == 0 else int(v), int(i)) for i, (g, h, v) in enumerate(zip(np.where(rng.random(3000) < 0.5, 7, rng.integers(0, 6, 3000)), rng.integers(0, 2, 3000), rng.integers(0, 900, 3000)))]
    df = spark.createDataFrame(rows, "g long, h string, v long, `_row` long").repartition(5)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = placed(df, [F.col("v"), F.col("_row")], group, "at").collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(got) == len(rows) and got[0].asDict().keys() == {"g", "h", "v", "_row", "at"}
    groups = defaultdict(list)
    for r in got:
        groups[tuple(r[k] for k in group)].append(r)
    for members in groups.values():
        ordered = sorted(members, key=lambda r: (r.v is not None, r.v or 0, r._row))
        assert [r.at for r in ordered] == list(range(1, len(members) + 1))


def test_places_of_equal_rows_and_of_none(spark):
    df = spark.createDataFrame([(1,)] * 700, "a int")
    assert sorted(r.place for r in placed(df, [F.col("a")]).collect()) == list(range(1, 701))
    assert placed(df.limit(0), [F.col("a")], ["a"]).collect() == []


def test_work_tables_go_at_the_end(spark):
    with work_tables() as made:
        kept, gone = stored(spark.range(3), "kept"), stored(spark.range(4), "gone")
        made.remove(kept)
    assert kept.count() == 3
    with pytest.raises(Exception, match="PATH_NOT_FOUND|does not exist|FILE_NOT_EXIST"):
        spark.read.parquet(gone.stored_at).count()
