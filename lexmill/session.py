"""Sessions for tests, benchmarks and the command line. On a cluster the session comes from spark-submit."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def spread(df: DataFrame, least: int = 4 << 20) -> DataFrame:
    """A table of fewer files than there are cores, too small for that to be right, dealt over all cores.

    Large inputs have more splits than cores and are left as they are, so they never pay this shuffle; nor do inputs of
    less than ``least`` bytes, or anything but a plain scan of files.
    """
    spark = df.sparkSession
    cores = spark.sparkContext.defaultParallelism
    plan = df._jdf.queryExecution().optimizedPlan()
    size = int(str(plan.stats().sizeInBytes()))
    per_task = 64 << 20
    if not least <= size <= cores * per_task or len(df.inputFiles()) >= cores or "Relation" not in plan.nodeName():
        return df
    return df.repartition(cores)


def local_session(cpus: int | str = 8, partitions: int = 8, memory: str = "8g", app: str = "lexmill") -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.driver.memory", memory)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark
