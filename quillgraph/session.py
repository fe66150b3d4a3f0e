"""Session helpers: table loading and cutting of lineage in the shared folder."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_LOCAL: dict[str, str] = {}


def ship(spark: SparkSession) -> None:
    """Hand this package to the Python workers, once a context, so that they need no installed copy."""
    context = spark.sparkContext
    if getattr(context, "_quillgraph_shipped", False):
        return
    root = Path(__file__).parent
    archive = Path(tempfile.mkdtemp(prefix="quillgraph-ship-")) / "quillgraph.zip"
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as z:
        for f in sorted(root.rglob("*")):
            if f.suffix in (".py", ".npz") and "__pycache__" not in f.parts:
                z.write(f, f"{root.name}/{f.relative_to(root)}")
    context.addPyFile(str(archive))
    context._quillgraph_shipped = True  # type: ignore[attr-defined]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One parquet table of a scale folder."""
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """Folder all executors share: ``spark.checkpoint.dir`` of the session.

    Only where the setting is absent (tests on one machine) a temporary folder of this process is used;
    a cluster without the setting is an error rather than a silent machine-local path.
    """
    conf = spark.sparkContext.getConf()
    named = conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    if "dir" not in _LOCAL:
        _LOCAL["dir"] = "file://" + tempfile.mkdtemp(prefix="quillgraph-")
    return _LOCAL["dir"]


class Scratch:
    """Written tables that cut lineage; each can be dropped as soon as its successor is written.

    A lost executor costs nothing: the rows are read again from the shared folder.
    """

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex[:12]}"
        self.serial = 0

    def write(self, df: DataFrame) -> DataFrame:
        self.serial += 1
        path = f"{self.root}/{self.serial}"
        df.write.mode("overwrite").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path  # type: ignore[attr-defined]
        return out

    def drop(self, *dfs: DataFrame | None) -> None:
        jvm = self.spark.sparkContext._jvm
        for df in dfs:
            path = getattr(df, "_scratch_path", None)
            if path:
                p = jvm.org.apache.hadoop.fs.Path(path)
                p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
