"""JSON-lines, parameter and table files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Names of the splits.
SPLITS = {"dev": "validation", "val": "validation", "development": "validation"}


def split_name(name: str) -> str:
    return SPLITS.get(name, name)


def scan(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """Rows of JSON lines with a declared schema."""
    return spark.read.schema(schema).json(path)


def last_wins(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The last row of each key in `order`: one aggregate with partial combination, no sort."""
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("_r")).select(*keys, "_r.*")


def scan_split(spark: SparkSession, root: str, name: str, schema: StructType | str) -> DataFrame:
    """Rows of <root>/<split>.jsonl, the split by any of its names."""
    return scan(spark, f"{root}/{split_name(name)}.jsonl", schema)


def scan_keyed(spark: SparkSession, path: str, schema: StructType | str, keys: list[str]) -> DataFrame:
    """JSON lines with the last line of each key; files are read in splits, lines ordered by file, split and place."""
    at = F.struct("_metadata.file_path", "_metadata.file_block_start", F.monotonically_increasing_id().alias("k"))
    lines = spark.read.text(path).select(F.col("value").alias("line"), at.alias("_at")).where("trim(line) <> ''")
    rows = lines.select(F.from_json("line", schema if isinstance(schema, str) else schema.simpleString()).alias("r"), "_at").select("r.*", "_at")
    return last_wins(rows, keys, "_at").drop("_at")


def write_record(record: DataFrame, path: str) -> None:
    """A one-row parameter record as one JSON line."""
    record.limit(1).coalesce(1).write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def read_record(spark: SparkSession, path: str) -> dict:
    """The parameter record of write_record."""
    return spark.read.json(path).first().asDict(recursive=True)


def write(df: DataFrame, path: str) -> None:
    """JSON lines, nulls kept."""
    df.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def subset(gold: DataFrame, system: DataFrame, flag: str, key: str = "id") -> tuple[DataFrame, DataFrame]:
    """Gold rows whose flag is true, and the system rows of their keys."""
    kept = gold.where(F.col(flag))
    return kept, system.join(kept.select(key), key, "left_semi")


def first_topics(df: DataFrame, k: int, order: str, zero_is_none: bool = False) -> DataFrame:
    """The first k rows in order; k < 0 is all, and k = 0 is all or, with zero_is_none, none."""
    if k < 0 or k == 0 and not zero_is_none:
        return df
    return df.orderBy(order).limit(k)
