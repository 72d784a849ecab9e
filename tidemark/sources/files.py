"""Small metadata files on whatever file system the root is on, through Hadoop's API."""

from __future__ import annotations

import json

from pyspark.sql import SparkSession


class Files:
    def __init__(self, spark: SparkSession):
        self.spark = spark

    def _at(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def read_json(self, path: str, default: object) -> object:
        fs, p = self._at(path)
        if not fs.exists(p):
            return default
        stream = fs.open(p)
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def write_json(self, path: str, value: object) -> None:
        """Write beside and rename, so that readers see the old file or the new one."""
        fs, p = self._at(path)
        beside = self.spark._jvm.org.apache.hadoop.fs.Path(path + ".next")
        out = fs.create(beside, True)
        out.write(json.dumps(value, sort_keys=True).encode())
        out.close()
        if fs.exists(p):
            fs.delete(p, False)
        fs.rename(beside, p)

    def delete(self, path: str) -> None:
        fs, p = self._at(path)
        fs.delete(p, True)

    def children(self, path: str) -> list[str]:
        fs, p = self._at(path)
        return [s.getPath().toString() for s in fs.listStatus(p)] if fs.exists(p) else []
