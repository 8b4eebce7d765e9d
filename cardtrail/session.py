"""Session helpers: building a session for tests/bench, the shared scratch root,
and the size bound under which a side may be broadcast."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import SparkSession

_DEFAULTS = {
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.parquet.filterPushdown": "true",
}


def build_session(master: str = "local[*]", app: str = "cardtrail",
                  shuffle_partitions: int | None = None,
                  extra: dict | None = None) -> SparkSession:
    """Session for tests and the bench. On a cluster, use the cluster's own
    session; every function here only reads its settings."""
    b = SparkSession.builder.master(master).appName(app)
    for k, v in _DEFAULTS.items():
        b = b.config(k, v)
    if shuffle_partitions is not None:
        b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for k, v in (extra or {}).items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder for lineage cuts: ``spark.checkpoint.dir``.

    It is read from the session. Only a local-mode session without one gets a
    fresh temporary folder (tests); a cluster session without one is an error,
    because a machine-local folder does not survive the loss of an executor.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    sc = _context(spark)
    if not root and sc is not None:
        root = sc.getCheckpointDir()
    if not root:
        master = (sc.master if sc is not None else spark.conf.get("spark.master", "")) or ""
        if not master.startswith("local"):
            raise RuntimeError(
                "set spark.checkpoint.dir to a shared folder (HDFS/S3/...) "
                "before tracing on a cluster")
        root = tempfile.mkdtemp(prefix="cardtrail-ckpt-")
        spark.conf.set("spark.checkpoint.dir", root)
        if sc is not None:
            sc.setCheckpointDir(root)
    return root.rstrip("/")


def _context(spark: SparkSession):
    """The SparkContext of a classic session, None for a Connect session."""
    try:
        return spark.sparkContext
    except Exception:  # noqa: BLE001 - Connect sessions have no context
        return None


def parallelism(spark: SparkSession) -> int | None:
    sc = _context(spark)
    return sc.defaultParallelism if sc is not None else None


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new, unique folder under the shared checkpoint root."""
    return f"{checkpoint_root(spark)}/cardtrail/{name}-{uuid.uuid4().hex}"


_UNITS = {"": 1, "b": 1, "k": 1 << 10, "kb": 1 << 10, "m": 1 << 20, "mb": 1 << 20,
          "g": 1 << 30, "gb": 1 << 30, "t": 1 << 40, "tb": 1 << 40}


def _bytes(text: str) -> int:
    m = re.fullmatch(r"\s*(-?\d+)\s*([a-zA-Z]*)\s*", text)
    if not m:
        return -1
    return int(m.group(1)) * _UNITS.get(m.group(2).lower(), 1)


def broadcast_row_limit(spark: SparkSession, row_bytes: int = 64) -> int:
    """Most rows of a card list that may be broadcast.

    ``cardtrail.broadcast.maxRows`` wins if set; otherwise the session's
    ``spark.sql.autoBroadcastJoinThreshold`` divided by ``row_bytes`` (a
    32-character card plus row overhead). 0 disables explicit broadcasts.
    """
    explicit = spark.conf.get("cardtrail.broadcast.maxRows", None)
    if explicit is not None:
        return max(int(explicit), 0)
    thr = _bytes(spark.conf.get("spark.sql.autoBroadcastJoinThreshold", "10485760"))
    return max(thr // row_bytes, 0) if thr > 0 else 0


def delete_path(spark: SparkSession, path: str) -> bool:
    """Recursively delete a folder of the shared file system (through Hadoop's
    FileSystem, so HDFS/S3/local alike)."""
    sc = _context(spark)
    if sc is None:      # a Connect client cannot reach the file system; keep it
        return False
    p = sc._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(sc._jsc.hadoopConfiguration())
    return bool(fs.delete(p, True))
