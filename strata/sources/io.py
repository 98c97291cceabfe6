"""Sources and sinks: typed CSV with null tokens, table writers, weights tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strata.operators.quality import GateError, guard, not_null
from strata.session import materialize
from strata.sources.checkpoint import read_checkpoint

# The tokens pandas reads as missing by default.
PANDAS_NA = ("", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL",
             "NaN", "None", "n/a", "nan", "null")


def read_csv(spark: SparkSession, path: str, schema: T.StructType,
             null_tokens: Sequence[str] = PANDAS_NA, line_breaks: bool = True) -> DataFrame:
    """Header CSV -> typed table. Columns are taken by their names in the header,
    whatever their order; a missing one fails, further ones are left out, and
    files with different headers fail. Quoted fields are read as pandas does: a
    doubled quote is a quote, commas and line breaks belong to the field. For
    those a file is not split; ``line_breaks=False`` splits large files
    whose fields hold none (a line break in a field then fails). Every field is read as a string first
    (never inferred: ``"2:0"`` must not become a timestamp), null tokens become
    null, then each column is cast to its declared type (ANSI: a bad value
    fails)."""
    raw = (spark.read.option("header", True).option("inferSchema", False).option("enforceSchema", False)
           .option("quote", '"').option("escape", '"').option("multiLine", line_breaks).option("mode", "FAILFAST").csv(path))
    missing = [f.name for f in schema.fields if f.name not in raw.columns]
    if missing:
        raise ValueError(f"missing columns in {path}: {missing}")
    tokens = list(null_tokens)
    cols = []
    for f in schema.fields:
        s = F.trim(F.col(f.name)) if not isinstance(f.dataType, T.StringType) else F.col(f.name)
        v = F.when(F.col(f.name).isin(tokens) | F.col(f.name).isNull(), F.lit(None)).otherwise(s)
        cols.append(v.cast(f.dataType).alias(f.name))
    return raw.select(*cols)


def write_table(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite",
                partition_by: Sequence[str] | None = None) -> None:
    """Write a table (parquet between stages; CSV with header for hand-off, in which
    a quote inside a field is doubled; null is an empty field, an empty text a
    quoted one)."""
    w = df.write.mode(mode)
    if partition_by:
        w = w.partitionBy(*partition_by)
    if fmt == "csv":
        w.options(header=True, quote='"', escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).csv(path)
    else:
        w.format(fmt).save(path)


def split_identity(df: DataFrame, id_col: str) -> tuple[DataFrame, DataFrame]:
    """Keep the identity column beside the features: returns (index, features)."""
    return df.select(id_col), df


def save_weights(spark: SparkSession, weights: dict, path: str) -> None:
    """Parameter dict ``name -> ndarray`` -> parquet ``(name, shape, values)``."""
    rows = [(k, [int(s) for s in v.shape], [float(x) for x in v.ravel()]) for k, v in weights.items()]
    schema = "name string, shape array<int>, values array<double>"
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("overwrite").parquet(path)


def load_weights(spark: SparkSession, path: str) -> DataFrame:
    """The weights table (one row per parameter tensor): the library's Parquet, or a
    training framework's checkpoint file (``.pt``, ``.pth``)."""
    return read_checkpoint(spark, path) if path.endswith((".pt", ".pth")) else spark.read.parquet(path)


def submission(df: DataFrame, id_col: str, pred_col: str, out: str = "demand",
               id_out: str = "Index", expected: DataFrame | None = None, enforce: bool = True) -> DataFrame:
    """Output contract ``Index, demand``. With ``enforce`` a row without an id or
    a prediction (null, NaN) fails the job that reads the result. ``expected``:
    the table whose ``id_col`` must come out, each id once; the result is then
    written once (so the plan behind it runs once) and its ids are compared with the
    expected ones in one aggregation."""
    res = df.select(F.col(id_col).cast("long").alias(id_out), F.col(pred_col).cast("double").alias(out))
    if expected is not None:
        res, _ = materialize(guard(res, not_null([id_out, out], nan=True)) if enforce else res)
        sides = (expected.select(F.col(id_col).cast("long").alias("id"), F.lit(1).alias("e"), F.lit(0).alias("g"))
                 .unionAll(res.select(F.col(id_out).alias("id"), F.lit(0).alias("e"), F.lit(1).alias("g"))))
        bad = sides.groupBy("id").agg(F.sum("e").alias("e"), F.sum("g").alias("g")).agg(
            F.count_if((F.col("e") != F.col("g")) | (F.col("e") > 1) | F.col("id").isNull()).alias("n")).collect()[0]["n"]
        if bad:
            raise GateError(f"submission: {bad} ids are missing, repeated, null or unknown")
        return res
    return guard(res, not_null([id_out, out], nan=True)) if enforce else res
