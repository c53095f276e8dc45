"""Session helpers: required settings."""

from __future__ import annotations

from pyspark.sql import SparkSession


def prepare(spark: SparkSession) -> SparkSession:
    """All instants are UTC inside the engine; local time appears only where it is displayed."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


def local_session(cores: str = "8", app: str = "drivetrace", memory: str = "8g") -> SparkSession:
    """A single-machine session for tests and the bench.

    Call sites of column expressions are not recorded: plans here hold hundreds of them, and each
    costs several round trips while a plan is built. Plans are described briefly to listeners, as the
    long form is written anew at each adaptive step.
    """
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", cores if cores.isdigit() else "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.sql.ui.explainMode", "simple")
        .config("spark.sql.maxPlanStringLength", "20000")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return prepare(spark)

