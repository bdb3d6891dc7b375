"""Session settings for tests, benchmarks and stand-alone jobs.

Library functions never set cluster options themselves: they take the caller's session.
"""

from __future__ import annotations

import gc
import io
import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "cellweave", cpus: int | str = "*", partitions: int = 8, **conf: str) -> SparkSession:
    """Local session used by the tests and the benchmark."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "12g")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors' Python workers, once per application.

    Functions of the package travel by name; workers of a cluster, or of a session started in another folder, find them
    only if they have the package. The archive is made beside the driver and served by it, as all added files are.
    """
    context = spark.sparkContext
    if getattr(context, "_cellweave_shipped", False):
        return
    root = os.path.dirname(os.path.abspath(__file__))
    packed = io.BytesIO()
    with zipfile.ZipFile(packed, "w", zipfile.ZIP_DEFLATED) as archive:
        for folder, _, names in sorted(os.walk(root)):
            for name in sorted(n for n in names if n.endswith(".py")):
                path = os.path.join(folder, name)
                archive.write(path, os.path.join("cellweave", os.path.relpath(path, root)))
    target = os.path.join(tempfile.mkdtemp(prefix="cellweave-"), "cellweave.zip")
    with open(target, "wb") as out:
        out.write(packed.getvalue())
    context.addPyFile(target)
    context._cellweave_shipped = True


def _ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the shared folder named by the cluster; a scratch folder only in local mode."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is not None:
        return
    shared = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if shared:
        sc.setCheckpointDir(shared)
    elif sc.master.startswith("local"):
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="cellweave-checkpoint-"))
    else:
        raise ValueError("iterative operators need spark.checkpoint.dir to name a folder all executors can reach")


def shared_folder(spark: SparkSession) -> str:
    """Folder for intermediate tables, reachable by all executors."""
    _ensure_checkpoint_dir(spark)
    return spark.sparkContext.getCheckpointDir()


def cut_lineage(df: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Store ``df`` as a table in the shared folder and read it back; ``by`` names columns that become its folders.

    A lost executor then re-reads files instead of replaying the whole loop; the columnar files are smaller
    than row checkpoints and give the planner real sizes.
    """
    path = f"{shared_folder(df.sparkSession)}/stage-{uuid.uuid4().hex}"
    df.write.parquet(path, partitionBy=by)
    stored = df.sparkSession.read.schema(df.schema).parquet(path)
    stored._stage_path = path
    return stored


def release(stored: DataFrame) -> None:
    """Delete a table made by :func:`cut_lineage` that no later step reads; loops keep one generation this way."""
    path = getattr(stored, "_stage_path", None)
    if path is not None:
        jvm, context = stored.sparkSession._jvm, stored.sparkSession.sparkContext._jsc
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(context.hadoopConfiguration()).delete(target, True)


def drop_old_shuffles(spark: SparkSession) -> None:
    """Let go of the shuffle files of plans that nothing refers to; Spark does so when the driver collects its garbage, which
    loops of large rounds need not make it do."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()
