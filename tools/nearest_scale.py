"""Scale experiment for the exact nearest join (not a registered query).

Left and right points are derived with spark.range: a third of each side sits
in one 0.05-degree hot spot, the rest spreads over a 30 x 40 degree box.
Usage: python tools/nearest_scale.py [left_rows] [right_rows]
"""

import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql import functions as F  # noqa: E402

from floodflow.operators.nearest import nearest_join  # noqa: E402
from floodflow.session import build_session  # noqa: E402


def points(spark, n, seed, name):
    u1 = F.pmod(F.xxhash64(F.col("id"), F.lit(seed)), F.lit(1 << 30)).cast("double") / F.lit(float(1 << 30))
    u2 = F.pmod(F.xxhash64(F.col("id"), F.lit(seed + 1)), F.lit(1 << 30)).cast("double") / F.lit(float(1 << 30))
    hot = F.col("id") % 3 == 0
    lat = F.when(hot, F.lit(52.0) + u1 * 0.05).otherwise(F.lit(35.0) + u1 * 30)
    lon = F.when(hot, F.lit(4.0) + u2 * 0.05).otherwise(F.lit(-10.0) + u2 * 40)
    return spark.range(n).select(F.col("id").alias(name), lat.alias("lat"), lon.alias("lon"))


def main():
    nl = int(sys.argv[1]) if len(sys.argv) > 1 else 1_000_000
    nr = int(sys.argv[2]) if len(sys.argv) > 2 else 100_000
    spark = build_session("local[8]", shuffle_partitions=32, extra={"spark.driver.memory": "16g"})
    t = time.time()
    rows = nearest_join(points(spark, nl, 1, "id"), points(spark, nr, 7, "rid"), "id").count()
    print({"left": nl, "right": nr, "rows": rows, "sec": round(time.time() - t, 1)})


if __name__ == "__main__":
    main()
