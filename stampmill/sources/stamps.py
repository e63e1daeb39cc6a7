"""The stamp store: Parquet rows of one image and its metadata."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from stampmill.operators.keyed import fetch
from stampmill.operators.lineage import settle
from stampmill.operators.ordering import global_row_number

SCHEMA_VERSION = 3
# The metadata of a stamp, unsigned types widened one step.
META = T.StructType(
    [T.StructField(name, kind) for name, kind in (
        ("band_idx", T.ShortType()), ("x0", T.IntegerType()), ("y0", T.IntegerType()), ("ra", T.DoubleType()), ("dec", T.DoubleType()),
        ("pixel_scale", T.FloatType()), ("sky_noise", T.FloatType()), ("host_id", T.LongType()), ("tract", T.IntegerType()), ("patch", T.IntegerType()),
        ("n_cells_spanned", T.ShortType()), ("n_visits_min", T.ShortType()), ("n_visits_max", T.ShortType()), ("cell_depth_ratio", T.FloatType()),
        ("variance_step", T.FloatType()), ("frac_no_data", T.FloatType()), ("frac_inexact_psf", T.FloatType()), ("frac_rejected", T.FloatType()))]
)
STORED = T.StructType([*META.fields, T.StructField("native_size", T.IntegerType()), T.StructField("schema_version", T.IntegerType()),
                       T.StructField("image", T.ArrayType(T.FloatType()))])


def read_stamps(spark: SparkSession, path: str) -> DataFrame:
    """Open a stamp set; refuse missing metadata, another schema version or mixed sizes.

    The check reads two narrow columns, never the images.
    """
    found = spark.read.parquet(path)
    missing = [f.name for f in STORED if f.name not in found.columns]
    if missing:
        raise ValueError(f"{path} has no {missing}; it is not a stamp set of schema {SCHEMA_VERSION}")
    check = found.agg(
        F.count_if(~F.col("schema_version").eqNullSafe(F.lit(SCHEMA_VERSION))).alias("stale"),
        F.min("native_size").alias("least"), F.max("native_size").alias("most")).first()
    if check["stale"]:
        raise ValueError(f"{check['stale']} stamps in {path} are not of schema {SCHEMA_VERSION}")
    if check["least"] != check["most"]:
        raise ValueError(f"{path} mixes native sizes {check['least']} to {check['most']}")
    return found


def stored_form(df: DataFrame) -> DataFrame:
    """The columns as stored: missing metadata filled with -1 or NaN, wrong images refused."""
    names = [f.name for f in STORED]
    unknown = sorted(set(df.columns) - set(names))
    if unknown:
        raise ValueError(f"unknown stamp metadata {unknown}")
    if not {"image", "native_size"} <= set(df.columns):
        raise ValueError("a stamp needs an image and its native_size")
    n = F.col("native_size")
    wrong = F.raise_error(F.lit("an image does not have native_size squared pixels")).cast("array<float>")
    out = []
    for field in STORED:
        blank = F.lit(float("nan") if isinstance(field.dataType, (T.FloatType, T.DoubleType)) else -1)
        if field.name == "image":
            column = F.when(F.size("image") == n * n, F.col("image").cast("array<float>")).otherwise(wrong)
        elif field.name == "schema_version":
            column = F.lit(SCHEMA_VERSION)
        elif field.name in df.columns:
            column = F.coalesce(F.col(field.name).cast(field.dataType), blank.cast(field.dataType))
        else:
            column = blank
        out.append(column.cast(field.dataType).alias(field.name))
    return df.select(*out)


def write_stamps(df: DataFrame, path: str, rows_per_file: int, mode: str = "errorifexists") -> None:
    """Write with at most `rows_per_file` rows in a file, each task its own files."""
    stored_form(df).write.option("maxRecordsPerFile", rows_per_file).mode(mode).parquet(path)


def file_map(df: DataFrame, rows_per_file: int, order: tuple[str, ...]) -> DataFrame:
    """(order columns, row_index, file_id): which uniform file each row goes to."""
    numbered = global_row_number(df.select(*order), *order)
    return numbered.withColumn("file_id", F.floor(F.col("row_index") / rows_per_file))


def repack(df: DataFrame, path: str, rows_per_file: int, order: tuple[str, ...], mode: str = "errorifexists", tasks: int | None = None) -> None:
    """Rewrite a set into uniform files, rows in order within each; the last file is short. Adds file_id.

    Whole files are dealt over a bounded number of tasks, each of which cuts its sorted rows every
    `rows_per_file`. With mode "overwrite" it can run again; the set must not be read from `path`.
    """
    placed = file_map(df, rows_per_file, order)
    n_files = (placed.agg(F.max("file_id")).first()[0] or 0) + 1
    tasks = min(int(n_files), tasks or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    # Each task gets its share of the files, told by number, so no pass over the images looks for bounds.
    share = F.floor(F.col("file_id") * tasks / int(n_files)).cast("int")
    whole = df.join(placed.withColumn("_task", share), list(order)).repartitionById(tasks, "_task").sortWithinPartitions("file_id", "row_index").drop("row_index", "_task")
    whole.write.option("maxRecordsPerFile", rows_per_file).mode(mode).parquet(path)


def gather(df: DataFrame, indices: DataFrame) -> DataFrame:
    """Rows by `row_index` in the asked order; an index asked twice comes twice. `indices` is (ord, row_index).

    Only the narrow asked table is sorted as a whole. Its places tell each row's task, images meet them where they
    are read while the asked keys are few, and move once.
    """
    placed = settle(global_row_number(indices.select("ord", "row_index"), "ord", "row_index", name="_place"))
    n = max(placed.count(), 1)
    tasks = min(n, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    asked = placed.withColumn("_task", F.floor(F.col("_place") * tasks / n).cast("int"))
    found = fetch(df, asked, ["row_index"]).repartitionById(tasks, "_task").sortWithinPartitions("_place")
    return found.select("ord", "row_index", *[c for c in df.columns if c != "row_index"])
