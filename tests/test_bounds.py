"""What one task works on does not grow with the tables."""

from runledger import session
from runledger.plans import testbed


def test_pieces_follow_rows(spark, monkeypatch):
    monkeypatch.setattr(testbed, "PIECE_ROWS", 100)
    try:
        assert testbed.spread(spark.range(5000).coalesce(8)).rdd.getNumPartitions() == 50
        assert spark.conf.get(session.INITIAL) == "50"
        assert testbed.spread(spark.range(5000, numPartitions=60)).rdd.getNumPartitions() == 60
    finally:
        testbed.spread(spark.range(10))
    assert spark.conf.get(session.INITIAL, None) is None


def test_tasks_read_bounded_bytes(spark):
    for key, most in session.TASK_BYTES.items():
        before = spark.conf.get(key)
        try:
            for asked, kept in (("1g", most), ("1m", 1 << 20)):
                spark.conf.set(key, asked)
                session.bound_tasks(spark, 1)
                assert session._size(spark.conf.get(key)) == kept
        finally:
            spark.conf.set(key, before)
