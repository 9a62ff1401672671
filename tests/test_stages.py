import time
from datetime import datetime, timedelta

from ledgerloom.streaming.decisions import keyed_state
from ledgerloom.streaming.stages import latest_stages

SCHEMA = "document_id long, stage string, ts timestamp, event_id long"


def test_state_stays_bounded_over_many_epochs(spark, tmp_path):
    at = lambda d, h=0: datetime(2024, 1, 1) + timedelta(days=d, hours=h)
    epochs = [[(d * 10 + k, s, at(d, h), d * 100 + k * 10 + h) for k in range(5) for h, s in enumerate(("read", "mapped", "done"))] for d in range(0, 60, 10)]
    epochs[1] += [(2, "late", at(0, 0), 999), (100, "early", at(9, 23), 1)]  # too late; and before its newest event, in time
    epochs[4] += [(2, "again", at(40, 1), 998)]  # comes back after its state has gone
    for rows in epochs:
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        time.sleep(1.1)
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    with keyed_state(spark):
        query = latest_stages(stream, "2 hours", idle_days=5).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start()
        query.awaitTermination()
    sizes = [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]]
    got = {}
    for r in sorted(spark.read.parquet(str(tmp_path / "out")).collect(), key=lambda r: (r.ms, r.event_id)):
        got.setdefault(r.document_id, []).append(r.stage)
    assert all(got[d * 10 + k][-1] == "done" for d in range(0, 60, 10) for k in range(5) if d * 10 + k != 2)
    assert got[2][-1] == "again" and "late" not in got[2] and "early" not in got[100]
    assert sizes[-1] <= 6 and max(sizes) <= 12, "documents of former epochs stay in the state"
