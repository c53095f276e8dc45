from datetime import datetime, timedelta, timezone

from pyspark.sql import functions as F

UTC = timezone.utc


def utc(text: str) -> datetime:
    return datetime.fromisoformat(text).replace(tzinfo=UTC)


def frame(spark, columns: str, rows):
    """Rows with times as ISO text in UTC for columns of type timestamp."""
    fields = [c.strip().rsplit(" ", 1) for c in columns.split(",")]
    text = ", ".join(f"{n} {'string' if t == 'timestamp' else t}" for n, t in fields)
    df = spark.createDataFrame(rows, text)
    return df.withColumns({n: F.col(n).cast("timestamp") for n, t in fields if t == "timestamp"}) if any(
        t == "timestamp" for _, t in fields
    ) else df


def values(df, *columns, order=None):
    rows = df.orderBy(*(order or columns)).collect()
    return [tuple(r[c] for c in columns) for r in rows]


def at(base: str, seconds: float) -> str:
    return (datetime.fromisoformat(base) + timedelta(seconds=seconds)).isoformat(sep=" ")
