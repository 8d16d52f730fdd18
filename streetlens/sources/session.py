"""Sessions."""

from __future__ import annotations

import atexit
import contextlib
import gc
import re
import shutil
import tempfile
import uuid
from pathlib import Path

from py4j.protocol import Py4JError
from pyspark.sql import DataFrame, SparkSession

_LOCAL: dict[str, str] = {}
ROOT = str(Path(__file__).resolve().parents[2])


def reachable(spark: SparkSession) -> SparkSession:
    """Let Python workers import this checkout, wherever the driver was started.
    On a cluster where the package is installed the extra path is without effect."""
    own = spark.sparkContext.environment
    if ROOT not in own.get("PYTHONPATH", "").split(":"):
        own["PYTHONPATH"] = ":".join(filter(None, (own.get("PYTHONPATH"), ROOT)))
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder that the session names in spark.checkpoint.dir. A session in one process
    that names none gets a temporary one, which goes with the driver; on a cluster a
    machine's own folder would lose rows with the machine, so that none named is an error."""
    named = spark.conf.get("spark.checkpoint.dir", "")
    if named:
        return named
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise RuntimeError("spark.checkpoint.dir names no folder that all executors share")
    if "folder" not in _LOCAL:
        _LOCAL["folder"] = tempfile.mkdtemp(prefix="shared-")
        atexit.register(shutil.rmtree, _LOCAL["folder"], ignore_errors=True)
    return _LOCAL["folder"]


def removed(spark: SparkSession, path: str) -> None:
    """Delete a folder of a file system that the session reaches."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def collected(spark: SparkSession) -> None:
    """Let Spark remove the files of shuffles and checkpoints that nothing refers to any
    more: it learns of them only when the driver collects its garbage, which may not happen
    while a job of many rounds lasts. The driver's memory is given back with it."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()
    trimmed(spark)


def trimmed(spark: SparkSession) -> None:
    """Let the system have what the C library holds free in the driver's Java: compilers, and
    what else is outside of the heap, leave hundreds of MB of it. A Java that has no such
    command keeps it."""
    jvm, gateway = spark.sparkContext._jvm, spark.sparkContext._gateway
    with contextlib.suppress(Py4JError):
        beans = jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer()
        # the server's own class is closed to calls, its interface is not
        invoke = next(m for m in jvm.java.lang.Class.forName("javax.management.MBeanServer").getMethods() if m.getName() == "invoke")
        given = gateway.new_array(jvm.java.lang.Object, 4)
        given[0], given[1] = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand"), "systemTrimNativeHeap"
        invoke.invoke(beans, given)


def staged(df: DataFrame) -> DataFrame:
    """The rows of df, written once as a table of the shared folder and read again: for
    large tables that several branches of a plan read, each of them some columns and rows."""
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/stage-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def settled(df: DataFrame) -> DataFrame:
    """The rows of df, computed once and kept by a reliable checkpoint in the shared folder.

    For small tables that several branches of a plan read, where the rows they come from
    are many: a plan would compute them again for each branch."""
    sc = df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()
