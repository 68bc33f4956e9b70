"""Hour windows from the minutes of two hours."""

import datetime as dt
import random
from collections import Counter

from pyspark.sql import functions as F

from quarry.streaming import rate


def test_hour_windows_without_sixty_copies(spark):
    rng = random.Random(5)
    rows = [(u, dt.datetime(2024, 1, 1) + dt.timedelta(seconds=rng.choice([rng.randrange(7200), rng.randrange(90_000)])))
            for u in (1, 2, None) for _ in range(600)] + [(3, dt.datetime(2024, 1, 1)), (3, None)]
    events = spark.createDataFrame(rows, "user_id long, ts timestamp")
    want = Counter()
    for u, t in rows:
        if t is not None:
            minute = t.replace(second=0, microsecond=0)
            want.update((u, minute - dt.timedelta(minutes=k)) for k in range(60))
    hours = rate.hour_counts(events)
    got = hours.collect()
    assert {(r.user_id, r.window_start): r.n for r in got} == want and len(got) == len(want)
    assert all(r.over_limit == (r.n > rate.PER_HOUR) for r in got) and any(r.over_limit for r in got)
    local = rate.hour_counts(events.withColumn("ts", F.col("ts").cast("timestamp_ntz")))
    assert local.schema["window_start"].dataType.typeName() == "timestamp_ntz"
    assert {(r.user_id, r.window_start): r.n for r in local.collect()} == want
    # a minute is shuffled for two hours, not for sixty windows
    nodes, copies = [hours._jdf.queryExecution().optimizedPlan()], []
    while nodes:
        node = nodes.pop()
        nodes += [node.children().apply(i) for i in range(node.children().size())]
        if node.nodeName() == "Expand":
            copies.append(node.projections().size())
    assert copies == [2]
