"""Tables that iterative operators write between rounds, in a folder that all executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_made: list[tuple[SparkSession, str]] = []
_own: dict[str, str] = {}


def folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; in local mode, where one machine is all there is, a temp folder if that is unset."""
    conf = spark.sparkContext.getConf()
    path = conf.get("spark.checkpoint.dir")
    if path:
        return path.rstrip("/")
    master = conf.get("spark.master", "")
    if not master.startswith("local") or "cluster" in master:
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own:
        _own[app] = tempfile.mkdtemp(prefix="clonoframe-")
    return _own[app]


class Rounds:
    """Writes one table after the other; each cuts the lineage, so a lost executor costs the running round at most."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.base, self.n = spark, f"{folder(spark)}/rounds/{name}-{uuid.uuid4().hex}", 0
        _made.append((spark, self.base))

    def write(self, df: DataFrame) -> DataFrame:
        path, self.n = f"{self.base}/{self.n}", self.n + 1
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)


def _remove_all() -> None:
    for spark, path in _made:
        try:
            if spark.sparkContext._jsc is not None:
                p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
                p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
        except Exception:  # noqa: BLE001  the session may have ended first
            return


atexit.register(_remove_all)
