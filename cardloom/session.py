"""Session helpers: a local test session, table loading, materialisation that survives lost executors."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = "*", app: str = "cardloom", memory: str = "8g") -> SparkSession:
    """Session for tests and the bench. On a cluster the caller brings its own."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the test tables; reads are lazy, columns and filters reach the scan."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share: the checkpoint folder of the context, else spark.checkpoint.dir.

    Only a local session, as in tests, may do without: it gets a temporary one.
    """
    sc = spark.sparkContext
    place = sc.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if place is None:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        place = tempfile.mkdtemp(prefix="cardloom-")
        sc.setCheckpointDir(place)
        place = sc.getCheckpointDir()
    return place.rstrip("/")


def materialise(df: DataFrame) -> DataFrame:
    """Cuts the lineage of something that is read more than once.

    It is written as a table into the folder all executors share, so losing an executor loses nothing, and columns that
    a reader doesn't need are not read.
    """
    path = f"{shared_folder(df.sparkSession)}/cardloom-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
