"""The canonical sales view over the star schema, and generic readers and writers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

PROMO_DISCOUNT = 0.05


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sales(spark: SparkSession, sf_dir: str) -> DataFrame:
    """date, state_id, store_id, cat_id, dept_id, item_id, units, revenue, promo: one row per line item.

    A department is a category's items of one maker, whose digit the brand begins with.

    The dimensions join on keys; which of them are broadcast is left to their sizes.
    """
    line = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_partkey", F.col("l_shipdate").cast("date").alias("date"), F.col("l_quantity").alias("units"), F.col("l_extendedprice").alias("revenue"), (F.col("l_discount") >= PROMO_DISCOUNT).alias("promo"))
    place = (
        table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
        .join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
        .join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
        .select(F.col("s_suppkey").alias("l_suppkey"), F.col("r_name").alias("state_id"), F.col("n_name").alias("store_id"))
    )
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_type").alias("cat_id"), F.concat_ws("/", "p_type", F.substring("p_brand", 7, 1)).alias("dept_id"), F.col("p_brand").alias("item_id"))
    return line.join(place, "l_suppkey").join(part, "l_partkey").select("date", "state_id", "store_id", "cat_id", "dept_id", "item_id", "units", "revenue", "promo")


#: Declared schemas of the panel files, so that no reader infers.
SALES_SCHEMA = T.StructType([T.StructField("date", T.DateType()), *[T.StructField(c, T.StringType()) for c in ("store_id", "state_id", "item_id", "dept_id", "cat_id")], T.StructField("sales", T.IntegerType()), T.StructField("sell_price", T.DoubleType()), T.StructField("promo", T.ByteType()), T.StructField("snap", T.ByteType())])
TRUTH_SCHEMA = T.StructType([T.StructField("elasticity_by_category", T.MapType(T.StringType(), T.DoubleType())), T.StructField("elasticity_by_item", T.MapType(T.StringType(), T.DoubleType())), *[T.StructField(c, T.DoubleType()) for c in ("elasticity_spread", "cross_elasticity", "promo_display_lift", "zero_share")], *[T.StructField(c, T.IntegerType()) for c in ("n_series", "n_rows", "days")], T.StructField("date_min", T.StringType()), T.StructField("date_max", T.StringType())])


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """CSV with a header and a declared schema; gzip by suffix."""
    return spark.read.schema(schema).csv(path, header=True)


def write_csv(df: DataFrame, path: str, gzip: bool = False) -> None:
    df.write.mode("overwrite").option("compression", "gzip" if gzip else "none").csv(path, header=True)


def read_json_document(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """One JSON object per file, maps as maps."""
    return spark.read.schema(schema).json(path, multiLine=True)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_parquet(df: DataFrame, path: str, partition_by: tuple[str, ...] = ()) -> None:
    df.write.mode("overwrite").partitionBy(*partition_by).parquet(path)


def report_lines(sections: dict[str, tuple[DataFrame, list[str]]]) -> DataFrame:
    """(section, line, value): each section's title, then its rows as tab-separated text; line has the row's sort keys, null for the title."""
    out = None
    for at, (title, (df, order)) in enumerate(sections.items()):
        keys = F.struct(*[F.col(c).cast("string").alias(f"k{i}") for i, c in enumerate([*order, *[order[-1]] * (3 - len(order))][:3])])
        body = df.select(F.lit(at).alias("section"), keys.alias("line"), F.concat_ws("\t", *df.columns).alias("value"))
        head = df.sparkSession.range(1).select(F.lit(at).alias("section"), F.lit(None).cast(body.schema["line"].dataType).alias("line"), F.lit(f"## {title}").alias("value"))
        part = head.unionByName(body)
        out = part if out is None else out.unionByName(part)
    return out


def write_report(sections: dict[str, tuple[DataFrame, list[str]]], path: str) -> None:
    """A text report: sections one after the other, each a title and its rows in the order of up to three columns.

    The rows are dealt by ranges of that order, so the parts of the folder, by name, are the report; no task has it all.
    """
    report_lines(sections).orderBy("section", "line").select("value").write.mode("overwrite").text(path)


def available(spark: SparkSession, path: str) -> bool:
    """Whether a path exists in whatever store Spark reaches."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)
