"""Alerts kept in pages' order, so that a page deep in the list reads only the parts that hold it.

The table is cut into parts by ranges of (newest first, alert_id), each a folder, and an index holds how many alerts of
each severity, status and attack type a part has. The counts say in which parts a page lies, under any filter.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from watchmere.operators.alerts import MAX_PAGE_SIZE, filter_alerts

PART_ROWS = 1_000_000
PART = "part"
KINDS = ("severity", "status", "attack_type")


class AlertPages:
    """Alerts under `path`, written once by `write` and read page by page.

    A snapshot: alerts that change later need another `write`. `part` is the name of the folders' column.
    """

    def __init__(self, spark: SparkSession, path: str):
        columns = spark.read.parquet(f"{path}/columns").schema
        self.alerts = spark.read.schema(columns).parquet(f"{path}/alerts")
        self.index = spark.read.parquet(f"{path}/index")

    @classmethod
    def write(cls, alerts: DataFrame, path: str, part_rows: int = PART_ROWS) -> AlertPages:
        """Cut `alerts` into parts of about so many rows. Rows without a time come last, as in a sorted list.

        A second sorting column that is unique cuts apart alerts of one instant too, so no time is a hot part.
        """
        order = [F.desc("event_time"), F.asc("alert_id")]
        parts = max(1, -(-alerts.count() // part_rows))
        ranged = alerts.repartitionByRange(parts, *order).withColumn(PART, F.spark_partition_id())
        ranged.sortWithinPartitions(PART, *order).write.partitionBy(PART).parquet(f"{path}/alerts")
        ranged.limit(0).write.parquet(f"{path}/columns")
        pages = alerts.sparkSession.read.schema(ranged.schema).parquet(f"{path}/alerts")
        pages.groupBy(PART, *KINDS).agg(F.count("*").alias("n")).write.parquet(f"{path}/index")
        return cls(alerts.sparkSession, path)

    def page(
        self,
        page: int = 1,
        page_size: int = 20,
        severity: str | None = None,
        status: str | None = None,
        attack_type: str | None = None,
    ) -> DataFrame:
        """One page, newest first, with the number of alerts that pass the filters on every row; empty past the end.

        The index is summed to one row per part, of which there is one per `part_rows` alerts; of these at most a row
        per alert on the page comes to the driver, to name the parts that the scan is to read.
        """
        if page < 1 or not 1 <= page_size <= MAX_PAGE_SIZE:
            raise ValueError("page starts at 1 and page_size lies between 1 and 100")
        chosen = {"severity": severity, "status": status, "attack_type": attack_type}
        first = (page - 1) * page_size
        counts = filter_alerts(self.index, **chosen).groupBy(PART).agg(F.sum("n").alias("n"))
        upto = Window.orderBy(PART).rowsBetween(Window.unboundedPreceding, 0)
        ends = counts.withColumn("end", F.sum("n").over(upto)).withColumn("total", F.sum("n").over(Window.partitionBy()))
        held = ends.filter((F.col("end") > first) & (F.col("end") - F.col("n") < first + page_size)).collect()
        if not held:
            return self.alerts.drop(PART).withColumn("total", F.lit(0).cast("bigint")).limit(0)
        rows = filter_alerts(self.alerts, **chosen).filter(F.col(PART).isin([r[PART] for r in held]))
        before = min(r["end"] - r["n"] for r in held)
        rows = rows.orderBy(F.desc("event_time"), "alert_id").offset(first - before).limit(page_size)
        return rows.drop(PART).withColumn("total", F.lit(held[0]["total"]).cast("bigint"))
