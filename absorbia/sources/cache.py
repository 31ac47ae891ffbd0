"""Results and tables kept from one session to the next."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession


class ResultStore:
    """Tables as Parquet and results as one-row JSON text under a folder that Spark can reach."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _has(self, path: str) -> bool:
        jvm = self.spark._jvm
        p = jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(p)

    def table(self, key: str, make) -> DataFrame:
        """The table kept under key, made and written first if there is none."""
        path = f"{self.folder}/tables/{key}"
        if not self._has(path):
            make().write.mode("overwrite").parquet(path)
        return self.spark.read.parquet(path)

    def save_result(self, key: str, result: dict) -> None:
        self.spark.createDataFrame([(json.dumps(result, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(f"{self.folder}/results/{key}")

    def load_result(self, key: str) -> dict | None:
        path = f"{self.folder}/results/{key}"
        return json.loads(self.spark.read.text(path).first()[0]) if self._has(path) else None
