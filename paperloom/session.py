"""Session, table access and lineage cuts shared by all operators."""

from __future__ import annotations

import atexit
import os
import re
import shutil
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def local_session(app: str = "paperloom", cores: str = "*", **conf: str) -> SparkSession:
    """A session for tests and the bench; a cluster brings its own."""
    base = {
        "spark.sql.shuffle.partitions": "8",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": "8g",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    }
    builder = SparkSession.builder.master(f"local[{cores}]").appName(app)
    for key, value in {**base, **conf}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ship(spark: SparkSession) -> None:
    """Make this package importable for the Python workers of the cluster, once for each context."""
    sc, root = spark.sparkContext, Path(__file__).resolve().parent
    if getattr(sc, "_paperloom_shipped", False) or not root.is_dir():
        return
    archive = Path(tempfile.mkdtemp(prefix="paperloom-code-")) / "paperloom_code.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, f"{root.name}/{p.relative_to(root)}")
    sc.addPyFile(str(archive))  # Spark copies it to every executor
    sc._paperloom_shipped = True


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that all of the cluster shares, which spark.checkpoint.dir names.

    Only a local master, which is one machine, may do without it; it then gets a temporary folder that is removed
    at its end. On a cluster a machine's own folder would not be seen by the others, so that is an error.
    """
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        named = sc.getConf().get("spark.checkpoint.dir")
        if not named:
            if not re.fullmatch(r"local(\[.*\])?", sc.master):
                raise ValueError("set spark.checkpoint.dir to a folder that all machines of the cluster share")
            named = tempfile.mkdtemp(prefix="paperloom-ckpt-")
            atexit.register(shutil.rmtree, named, ignore_errors=True)
        sc.setCheckpointDir(named)
    return sc._jsc.sc().getCheckpointDir().get()


def checkpoint(df: DataFrame) -> DataFrame:
    """Write df to the cluster's shared checkpoint folder and cut its lineage.

    The folder is that of `shared_folder`; spark.cleaner.referenceTracking.cleanCheckpoints lets Spark remove
    what is no longer referenced.
    """
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def tokenizer_dir() -> str:
    return os.environ.get("PAPERLOOM_TOKENIZERS", "/opt/tokenizers")
