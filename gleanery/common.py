"""Shared pieces: reading tables, folding text, cutting lineage, checked broadcasts."""

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def folded(c: str | Column) -> Column:
    """Without outer blanks and in lower case."""
    return F.lower(F.regexp_replace(c, r"^\s+|\s+$", ""))


def durable(df: DataFrame) -> DataFrame:
    """The rows written to the folder that all executors share, so a lost executor loses none.

    The folder is the one the session names in spark.checkpoint.dir; only where none is set
    (tests on one machine) a folder of this machine is taken.
    """
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(df.sparkSession.conf.get("spark.checkpoint.dir", None) or tempfile.mkdtemp(prefix="gleanery"))
    return df.checkpoint()


def stored(df: DataFrame) -> DataFrame:
    """Like durable, for rows by the million: compressed columns in the same folder, deleted when the session's JVM ends."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(df.sparkSession.conf.get("spark.checkpoint.dir", None) or tempfile.mkdtemp(prefix="gleanery"))
    to = f"{sc.getCheckpointDir()}/stored-{uuid.uuid4()}"
    path = sc._jvm.org.apache.hadoop.fs.Path(to)
    df.write.parquet(to)
    path.getFileSystem(sc._jsc.hadoopConfiguration()).deleteOnExit(path)
    return df.sparkSession.read.schema(df.schema).parquet(to)


def if_small(df: DataFrame, rows: int, most: int = 100_000) -> DataFrame:
    """df with a broadcast hint if its counted rows stay under the bound, else as it is (a shuffled join)."""
    return F.broadcast(df) if rows <= most else df


def ship(spark: SparkSession) -> None:
    """Gives the executors this package as a zip, once per context, so that Python workers find it wherever they run."""
    sc = spark.sparkContext
    if getattr(sc, "_gleanery", False):
        return
    root = Path(__file__).parent
    target = Path(tempfile.mkdtemp(prefix="gleanery"), "gleanery.zip")
    with zipfile.ZipFile(target, "w") as z:
        for f in sorted(root.rglob("*")):
            if f.is_file() and f.suffix in (".py", ".npz"):
                z.write(f, Path(root.name, f.relative_to(root)))
    sc.addPyFile(str(target))
    sc._gleanery = True
