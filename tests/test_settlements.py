"""Late settlements become corrections of intervals that stay closed."""

import random
from collections import Counter

from pyspark.sql import functions as F

from docquarry.streaming.settlements import reconciled
from docquarry.streaming.windows import event_stream


def test_late_settlements_are_corrections(spark, tmp_path):
    rng = random.Random(2)
    path = f"{tmp_path}/events.parquet"
    files = []
    for k in range(5):
        rows = [(f"s{rng.randrange(2)}", 1000 * k + rng.randrange(900), rng.randrange(-5, 50)) for _ in range(8)]
        if k >= 2:
            rows += [("s0", 50 + k, 7), ("s1", 1000 * (k - 2), 3)]  # long after their intervals
        files.append(rows)
        spark.createDataFrame(rows, "scope string, s long, amount long").withColumn("ts", F.timestamp_seconds("s")).coalesce(1).write.mode("append").parquet(f"file://{path}")
    log = [tuple(r) for r in reconciled(event_stream(spark, f"file://{path}", 1), "scope", "ts", "amount", 100, 500).collect()]
    want, closed, totals, mark = [], {}, Counter(), 0
    counts = Counter()
    for batch, rows in enumerate(files):
        mark = max([mark, *(s for _, s, _ in rows)])
        late, late_n = Counter(), Counter()
        for scope, s, amount in rows:
            key = (scope, s // 100)
            if key in closed:
                late[key] += amount
                late_n[key] += 1
            totals[key] += amount
            counts[key] += 1
        want += [("correction", *key, late[key], late_n[key], batch) for key in late_n]
        for key in [k for k in counts if k not in closed and (k[1] + 1) * 100 + 500 <= mark]:
            closed[key] = True
            want.append(("closed", *key, totals[key], counts[key], batch))
    want += [("closed", *key, totals[key], counts[key], len(files)) for key in counts if key not in closed]
    assert Counter(log) == Counter(want)
    assert sum(r[0] == "correction" for r in log) >= 4
    added = Counter()
    for _, scope, interval, amount, _, _ in log:
        added[scope, interval] += amount
    assert added == totals and max(Counter(r[1:3] for r in log if r[0] == "closed").values()) == 1
