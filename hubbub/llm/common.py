"""What the corpus operators share: a folder that all executors reach, staged tables, column checks."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

#: The contract's white space, as characters.
BLANKS = " \t\n\x0b\x0c\r"

_own_dirs: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. Only a local session without it gets a folder of its own."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own_dirs:
        _own_dirs[app] = "file://" + tempfile.mkdtemp(prefix="spark-shared-")
    return _own_dirs[app]


def fresh_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def stage(df: DataFrame, label: str) -> DataFrame:
    """Write df to the shared folder and read it again: the lineage ends there, and a lost executor
    costs a re-read instead of a recomputation."""
    spark = df.sparkSession
    path = fresh_path(spark, label)
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.staged_at = path
    return out


def discard(*staged: DataFrame) -> None:
    """Delete staged tables that nothing will read again."""
    for df in staged:
        sc = df.sparkSession.sparkContext
        path = sc._jvm.org.apache.hadoop.fs.Path(df.staged_at)
        path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)


def col(name: str) -> F.Column:
    """The column of exactly this name, whatever characters are in it."""
    return F.col("`" + name.replace("`", "``") + "`")


def free_name(df: DataFrame, name: str) -> str:
    """name, or a longer one that no column of df has."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def plain_names(df: DataFrame, without: tuple[str, ...]) -> tuple[list, StructType, list[str]]:
    """df's columns but for `without` under the names c0, c1 and so on, their schema, and their own names. mapInArrow
    resolves names itself and takes a dot for a field of a struct."""
    kept = [f for f in df.schema.fields if f.name not in without]
    columns = [col(f.name).alias(f"c{i}") for i, f in enumerate(kept)]
    return columns, StructType([StructField(f"c{i}", f.dataType) for i, f in enumerate(kept)]), [f.name for f in kept]


def few_at_once(batches, rows: int = 1000):
    """The rows of Arrow batches in smaller ones, so that what a worker makes of their texts stays small: it keeps the most
    memory that it ever took, for as long as it lives."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def tables(sf_dir: str):
    """name -> DataFrame over a folder of <name>.parquet tables."""
    spark = SparkSession.active()
    return lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")


def n_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def whole_text(col) -> F.Column:
    """A text column with null as the empty string."""
    return F.coalesce(col, F.lit(""))


def unbroken_words(text) -> F.Column:
    """Count of maximal runs of non-blank characters, without a regular expression's match objects."""
    folded = F.translate(text, BLANKS[1:], " " * (len(BLANKS) - 1))
    return F.size(F.filter(F.split(folded, " "), lambda w: w != "")).cast("long")
