from datetime import datetime, timedelta

import pytest

from gridloom import streaming

DAY = datetime(2024, 1, 1)


def arrive(spark, path, rows):
    """Rows (user, minute, total) as a new file."""
    full = [(i, DAY + timedelta(minutes=m), u, "ok", t, 0.0, t, f"{u}-1") for i, (u, m, t) in enumerate(rows)]
    spark.createDataFrame(full, streaming.SCHEMA).coalesce(1).write.mode("append").parquet(path)


@pytest.fixture
def run(spark, tmp_path):
    paths = [str(tmp_path / n) for n in ("in", "out", "mark")]

    def go(build, *batches):
        for rows in batches:
            arrive(spark, paths[0], rows)
            streaming.drain(build(streaming.replay(spark, paths[0], None)), *paths[1:])
        return [tuple(r) for r in spark.read.parquet(paths[1]).collect()]

    return go


def test_window_waits_for_the_watermark_and_then_stays(run):
    """A row an hour late still counts, one later does not; the stream starts anew for each batch."""
    hours = lambda rows: streaming.tumbling(rows, 60, "1 hour")
    found = run(hours, [(1, 10, 1.0)], [(1, 100, 2.0)], [(1, 50, 4.0)], [(1, 400, 8.0)], [(1, 410, 0.5)], [(1, 30, 16.0)], [(1, 2000, 0.0)])
    assert sorted(found) == [(DAY, 5.0), (DAY + timedelta(hours=1), 2.0), (DAY + timedelta(hours=6), 8.5)]


def test_late_row_joins_two_sessions(run):
    gap = lambda rows: streaming.sessions(rows, "30 minutes", "2 hours")
    found = run(gap, [(1, 0, 1.0), (1, 50, 2.0), (2, 0, 1.0), (2, 50, 2.0)], [(1, 25, 4.0)], [(3, 1000, 0.0)], [(2, 25, 9.0)], [(3, 3000, 0.0)])
    at = lambda m: DAY + timedelta(minutes=m)
    first = [(1, at(0), at(80), 3, 7.0), (2, at(0), at(30), 1, 1.0), (2, at(50), at(80), 1, 2.0)]
    assert sorted(found) == [*first, (3, at(1000), at(1030), 1, 0.0)]


def test_session_is_final_with_its_day(run):
    found = run(streaming.session_summary, [(1, 0, 1.0), (2, 5, 2.0)], [(1, 600, 3.0)], [(9, 1440 + 61, 0.0)])
    assert sorted(found) == [("1-1", 2, 4.0, 0.0, 4.0), ("2-1", 1, 2.0, 0.0, 2.0)]


def test_no_rows(run):
    assert run(lambda rows: streaming.tumbling(rows, 15), []) == []
