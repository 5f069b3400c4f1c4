"""Scaling probe: N copies of the sf0.1 log fixture written as text files,
then read -> parse -> order -> block sequences / count windows / time windows.

Copies keep block ids, so every block grows N-fold (hotter keys as N grows).
Usage: python scripts/scale_probe.py <copies> [rows_per_slice]
Prints one JSON line with seconds per stage.
"""

import json
import os
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql import functions as F  # noqa: E402

from logsift.operators import sequences as Q  # noqa: E402
from logsift.session import get_spark  # noqa: E402
from logsift.sources import fixtures as X  # noqa: E402
from logsift.sources.logs import parse_logs, read_log_text  # noqa: E402


def main():
    copies = int(sys.argv[1]) if len(sys.argv) > 1 else 1
    rps = int(sys.argv[2]) if len(sys.argv) > 2 else 4_000_000
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = get_spark()
    out = os.path.join(tempfile.mkdtemp(prefix="logsift-scale-"), "lines")
    lines = X.log_lines(spark, sf, persist=False)
    rep = lines.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(copies - 1))))
    rep.orderBy("copy", "line_no").select("value").write.text(out)
    t = {}
    t0 = time.perf_counter()
    parsed = parse_logs(read_log_text(spark, out), templates="fixture")
    ordered = Q.order_logs(parsed, rows_per_slice=rps)
    t["read_parse_order"] = time.perf_counter() - t0
    for name, df in [("block_sequences", Q.block_sequences(ordered)),
                     ("count_windows", Q.count_windows(ordered, 100, 0)),
                     ("time_windows", Q.time_windows(ordered, 60, 0))]:
        t0 = time.perf_counter()
        df.write.format("noop").mode("overwrite").save()
        t[name] = time.perf_counter() - t0
    print(json.dumps({"copies": copies, "lines": ordered.n_rows, "rows_per_slice": rps,
                      "slices": ordered.plan.n_buckets,
                      "seconds": {k: round(v, 2) for k, v in t.items()}}))


if __name__ == "__main__":
    main()
