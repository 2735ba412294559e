"""A read-only catalog over a folder of parquet files or folders, one for each table."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strata.errors import StrataError
from strata.plans import lower, parser


class Folder:
    """`views` adds tables that are DataFrames already."""

    def __init__(self, spark: SparkSession, path: str, views: dict[str, DataFrame] | None = None):
        self.spark, self.path, self.views = spark, path.rstrip("/"), dict(views or {})
        for key, value in lower.SETTINGS.items():
            spark.conf.set(key, value)

    def frame(self, table: str, hints: list[lower.Hint]) -> DataFrame:
        if table not in self.views:
            try:
                self.views[table] = self.spark.read.parquet(f"{self.path}/{table}.parquet")
            except AnalysisException as e:
                if e.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
                    raise StrataError("UNKNOWN_TABLE", f"no table {table}") from None
                raise
        return self.views[table]

    def query(self, sql: str, *params: object) -> DataFrame:
        """The rows of a SELECT, lazily."""
        statement = parser.parse(sql, params)
        if not isinstance(statement, lower.n.Select):
            raise StrataError("READ_ONLY", "this catalog only answers SELECT")
        return lower.lower_select(self, statement)


def money(df: DataFrame, *columns: str, scale: int = 2) -> DataFrame:
    """df with columns as exact decimals of 18 digits."""
    return df.withColumns({c: F.col(c).cast(f"decimal(18,{scale})") for c in columns})
