"""Session set-up, table loading, reliable checkpoints and package shipping."""

from __future__ import annotations

import atexit
import os
import re
import tempfile
import uuid
import zipfile
from pathlib import Path

from py4j.protocol import Py4JError
from pyspark.sql import DataFrame, SparkSession

_SHIPPED: set[str] = set()
COMPILED_BYTES = 8_000  # HotSpot leaves methods of more bytecode to its interpreter


def build_session(master: str = "local[*]", shuffle_partitions: int = 8, app: str = "tallyweir", **conf: str) -> SparkSession:
    """A session with the settings that every operator assumes: UTC, AQE, Arrow."""
    builder = (
        SparkSession.builder.master(master)
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.sql.codegen.hugeMethodLimit", str(COMPILED_BYTES))
        .config("spark.ui.enabled", "false")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def keep_methods_compiled(spark: SparkSession) -> None:
    """Have Spark generate code that the JVM compiles, in a session that others have built.

    Wide expressions fused into one method of over ``COMPILED_BYTES`` are interpreted, about four times as slow; with this limit Spark
    falls back to projections split into small methods. A limit that the session's owner has chosen is kept.
    """
    if spark.conf.get("spark.sql.codegen.hugeMethodLimit") == "65535":
        spark.conf.set("spark.sql.codegen.hugeMethodLimit", str(COMPILED_BYTES))


def release_finished(spark: SparkSession) -> None:
    """Have the driver's JVM let go of what finished plans hold, which Spark only frees once the JVM collects.

    For loops that plan and run many small jobs: their plans, shuffles and broadcasts would else pile up to the driver's limit. The
    compilers of queries leave native memory behind besides, which goes back to the system where the JVM knows how (17.0.9 and later on Linux).
    """
    jvm, gateway = spark.sparkContext._jvm, spark.sparkContext._gateway
    jvm.System.gc()
    try:
        # called by way of the interface, as the server's own class is closed to others
        invoke = next(m for m in jvm.java.lang.Class.forName("javax.management.MBeanServer").getMethods() if m.getName() == "invoke")
        args = gateway.new_array(jvm.java.lang.Object, 4)
        args[0], args[1] = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand"), "systemTrimNativeHeap"
        args[2], args[3] = gateway.new_array(jvm.java.lang.Object, 0), gateway.new_array(jvm.java.lang.String, 0)
        invoke.invoke(jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer(), args)
    except Py4JError:  # a JVM without this command
        pass


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table ``name`` of a data directory."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors once per application.

    Arrow functions are pickled by reference, so executors must be able to import the package even where they
    share no file system with the driver.
    """
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    root = Path(__file__).resolve().parent
    target = Path(tempfile.mkdtemp(prefix="tallyweir-ship-")) / "tallyweir_pkg.zip"
    with zipfile.ZipFile(target, "w") as zf:
        for path in sorted(root.rglob("*.py")):
            zf.write(path, Path(root.name) / path.relative_to(root))
    spark.sparkContext.addPyFile(str(target))
    _SHIPPED.add(app)


def checkpoint_folder(spark: SparkSession) -> str:
    """The shared folder that the cluster names in ``spark.checkpoint.dir``.

    Where that is unset, a session whose executors all live in this process (master ``local``) gets a folder of this machine; any other
    is refused, as tables in a folder that executors don't share are lost with them.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named:
            if not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
                raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
            named = os.path.join(tempfile.gettempdir(), "tallyweir-checkpoints")
        sc.setCheckpointDir(named)
    return sc.getCheckpointDir()


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` written once as a Parquet table in the shared checkpoint folder and read again, with its lineage cut.

    A table is computed once, where ``DataFrame.checkpoint`` runs the last stage twice, and is columnar and compressed. The tables of a
    session go when its driver ends.
    """
    spark = df.sparkSession
    base = f"{checkpoint_folder(spark)}/tables"
    if base not in _TABLES:
        _TABLES[base] = []
        atexit.register(_drop_tables, spark, base)
    path = f"{base}/{uuid.uuid4().hex}"
    _TABLES[base].append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


_TABLES: dict[str, list[str]] = {}


def _drop_tables(spark: SparkSession, base: str) -> None:
    """Remove the tables that this driver wrote, as far as its session still runs."""
    try:
        jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        for path in _TABLES.get(base, []):
            target = jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(conf).delete(target, True)
    except Exception:  # noqa: BLE001 - the session has ended before: the folder's owner cleans up
        pass
