"""Times the headline queries and prints one line of JSON.

Each query is run once to warm up and three times for the figure, the median; results are counted by Spark's noop sink,
so every column is computed.
"""

from __future__ import annotations

import json
import os
import statistics
import time

from pyspark.sql import SparkSession

from tickloom import queries

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
PACK = "; ".join([f"M{n}: MA(C,{n})" for n in (5, 10, 20, 60)] + [f"H{n}: HHV(H,{n})" for n in (9, 20)] + [f"L{n}: LLV(L,{n})" for n in (9, 20)] + ["S: STD(C,20)", "VA: VAR(C,20)", "T: SLOPE(C,10)", "W: WMA(C,10)", "X: CROSS(M5,M10)", "B: BARSLAST(C>50)", "Y: COUNT(C>O,10)", "Z: EVERY(C>O,3)", "R: REF(C,5)", "A: AVEDEV(C,10)", "D: DEVSQ(C,10)", "E: EMA(C,12)"])
HEADLINES = {
    "two_averages": queries.QUERIES["two_averages"],
    "kdj": queries.QUERIES["kdj"],
    "macd": queries.QUERIES["macd"],
    "rsi": queries.QUERIES["rsi"],
    "high_screen": queries.QUERIES["high_screen"],
    "pack_of_20": queries.scripted(PACK),
}


def main() -> None:
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]")
        .config("spark.sql.shuffle.partitions", CPUS)
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    took = {}
    for name, query in HEADLINES.items():
        times = []
        for _ in range(4):
            start = time.perf_counter()
            query(spark, SF_DIR).write.format("noop").mode("overwrite").save()
            times.append(time.perf_counter() - start)
        took[name] = round(statistics.median(times[1:]), 3)
    print(json.dumps({"metric": "median seconds of the headline scripts, summed", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": SF_DIR}))
    spark.stop()


if __name__ == "__main__":
    main()
