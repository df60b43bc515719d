"""Daily price bars: reading, cleaning, liveness, and storage by asset class."""

from __future__ import annotations

import time
from collections.abc import Iterator
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

PRICES = ("open", "high", "low", "close", "adj_close", "volume")
UNUSED = ("dividends", "stock_splits", "capital_gains")


def normal_names(df: DataFrame) -> DataFrame:
    """Lower case, underscores for spaces, ``index`` becomes ``date``; corporate-action columns go."""
    names = [c.strip().lower().replace(" ", "_") for c in df.columns]
    return df.toDF(*["date" if n == "index" else n for n in names]).drop(*UNUSED)


def typed_bars(df: DataFrame) -> DataFrame:
    """Numbers by ``try_cast`` (what does not parse is null); a missing adj_close column is the close."""
    if "close" not in df.columns:
        return df.limit(0)
    if "adj_close" not in df.columns:
        df = df.withColumn("adj_close", F.col("close"))
    return df.withColumns({c: F.col(c).try_cast("double") for c in PRICES if c in df.columns} | {"date": F.col("date").cast("date")})


def valid_bars(df: DataFrame) -> DataFrame:
    """Rows whose close and adjusted close are positive; null fails."""
    return df.filter((F.col("close") > 0) & (F.col("adj_close") > 0))


def live_entities(df: DataFrame, end: F.Column, entity: str = "ticker", days: int = 730, least: int = 252) -> DataFrame:
    """Rows of entities with ``least`` rows or more in the ``days`` before ``end``."""
    alive = df.groupBy(entity).agg(F.count_if(F.col("date") >= F.date_sub(end, days)).alias("n")).filter(F.col("n") >= least)
    return df.join(alive.select(entity), entity, "left_semi")


def clean_bars(df: DataFrame, dimension: DataFrame | None = None) -> DataFrame:
    """Raw bars to panel rows: names, types, validity, dimension and time of ingestion."""
    from .instruments import instruments, with_instrument

    out = valid_bars(typed_bars(normal_names(df)))
    out = with_instrument(out, dimension if dimension is not None else instruments(df.sparkSession))
    return out.withColumn("ingested_at", F.current_timestamp())


def union_bars(frames: list[DataFrame]) -> DataFrame:
    """All frames by column name; there must be one at least."""
    if not frames:
        raise ValueError("no bars to union")
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def write_layer(df: DataFrame, path: str, group: str = "asset_class", order: tuple[str, ...] = ("ticker", "date"), compression: str = "snappy") -> None:
    """Parquet by asset class, sorted within files. Rows of a class are spread over files by entity, so that a
    large class is not one task."""
    dealt = df.repartition(F.col(group), F.pmod(F.xxhash64(order[0]), F.lit(64)))
    dealt.sortWithinPartitions(group, *order).write.mode("overwrite").option("compression", compression).partitionBy(group).parquet(path)


def write_results(df: DataFrame, path: str, keys: tuple[str, ...] = ("model",)) -> None:
    """Predictions, metrics or bench rows as Parquet, written by the executors, by ``keys``."""
    df.write.mode("overwrite").partitionBy(*keys).parquet(path)


def only(df: DataFrame, tickers: tuple[str, ...], entity: str = "ticker") -> DataFrame:
    """The rows of some tickers, for development; all rows if none is named."""
    return df.filter(F.col(entity).isin(*tickers)) if tickers else df


def read_layer(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def failed_tickers(raw: DataFrame) -> DataFrame:
    """The tickers whose files could not be read."""
    return raw.filter(F.col("date").isNull() & F.col("close").isNull() & F.col("volume").isNull()).select("ticker").distinct()


class _File(InputPartition):
    def __init__(self, path: str) -> None:
        self.path = path


class _BarsReader(DataSourceReader):
    def __init__(self, path: str, attempts: int, wait: float) -> None:
        self.path, self.attempts, self.wait = path, attempts, wait

    def partitions(self) -> list[_File]:
        return [_File(str(p)) for p in sorted(Path(self.path).glob("*.csv"))]

    def read(self, partition: _File) -> Iterator[tuple]:
        import pandas as pd

        for attempt in range(1, self.attempts + 1):
            try:
                frame = pd.read_csv(partition.path, dtype=str, keep_default_na=False)
                break
            except (OSError, ValueError):
                frame = None
                if attempt < self.attempts:
                    time.sleep(self.wait * 2**attempt)
        ticker = Path(partition.path).stem
        if frame is None:
            yield (ticker, *[None] * (1 + len(PRICES)))
            return
        if frame.empty:
            return
        frame.columns = [c.strip().lower().replace(" ", "_") for c in frame.columns]
        frame = frame.rename(columns={"index": "date"})
        if "close" not in frame:
            return
        if "adj_close" not in frame:
            frame["adj_close"] = frame["close"]
        for row in frame.reindex(columns=["date", *PRICES]).itertuples(index=False, name=None):
            yield (ticker, *(v if isinstance(v, str) and v != "" else None for v in row))


class BarsDataSource(DataSource):
    """``spark.read.format("daily_bars").load(folder)``: one CSV file of bars for each ticker, one partition each.
    A file that cannot be read is tried three times, with growing pauses, and then is one row with its ticker alone, which
    ``failed_tickers`` lists and ``valid_bars`` drops; a readable file without rows or closes has no rows."""

    @classmethod
    def name(cls) -> str:
        return "daily_bars"

    def schema(self) -> str:
        return "ticker string, date string, open string, high string, low string, close string, adj_close string, volume string"

    def reader(self, schema) -> _BarsReader:
        return _BarsReader(self.options["path"], int(self.options.get("attempts", 3)), float(self.options.get("wait", 1.0)))
