"""K4: published versions, the current one, as of a time, and what changed."""

import datetime as dt
import os

import pytest

from tagweave.sources import versions as vs


def _rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_versions_are_published_read_and_compared(spark, tmpdir_run):
    root = os.path.join(tmpdir_run, "captions")
    table = lambda rows: spark.createDataFrame(rows, "name string, text string")
    one, two = [("a", "x"), ("b", "y"), ("c", None)], [("a", "x"), ("b", "z"), ("d", ""), ("c", "now")]
    day = lambda d: dt.datetime(2024, 1, d, tzinfo=dt.timezone.utc)
    assert vs.current(root) is None and vs.versions(root) == {}
    with pytest.raises(ValueError):
        vs.read_version(spark, root)
    assert vs.publish(table(one), root, when=day(1)) == 1
    # a version whose write failed has no entry: it is not read, and its number is taken again
    table([("half", "written")]).write.parquet(os.path.join(root, "v0002"))
    assert _rows(vs.read_version(spark, root)) == _rows(table(one)) and vs.current(root) == 1
    assert vs.publish(table(two), root, when=day(3)) == 2
    assert _rows(vs.read_version(spark, root)) == _rows(table(two))
    assert _rows(vs.read_version(spark, root, as_of=day(2))) == _rows(table(one)) == _rows(vs.read_version(spark, root, 1))
    with pytest.raises(ValueError):
        vs.read_version(spark, root, as_of=dt.datetime(2023, 1, 1, tzinfo=dt.timezone.utc))
    got = vs.diff(vs.read_version(spark, root, 1), vs.read_version(spark, root, 2))
    assert _rows(got) == [("b", "changed", "y", "z"), ("c", "changed", None, "now"), ("d", "added", None, "")]
    assert _rows(vs.diff(table(two), table(one)).where("change = 'removed'")) == [("d", "removed", "", None)]
    assert vs.diff(table(one), table(one)).count() == 0
    vs.set_current(root, 1)
    assert _rows(vs.read_version(spark, root)) == _rows(table(one))
    with pytest.raises(ValueError):
        vs.set_current(root, 9)
