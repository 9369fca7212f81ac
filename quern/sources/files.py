"""Small files and folders on any store that Hadoop's file systems reach."""

from __future__ import annotations

from pyspark.sql import SparkSession


class Store:
    def __init__(self, spark: SparkSession):
        self._jvm, self._conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()

    def _at(self, path: str):
        p = self._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self._conf), p

    def exists(self, path: str) -> bool:
        fs, p = self._at(path)
        return fs.exists(p)

    def read(self, path: str) -> str:
        fs, p = self._at(path)
        stream = fs.open(p)
        try:
            return bytes(self._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
        finally:
            stream.close()

    def write(self, path: str, text: str) -> None:
        """Replace a file by one rename: readers see the old text or the new."""
        fs, p = self._at(path)
        part = self._jvm.org.apache.hadoop.fs.Path(f"{path}.tmp")
        stream = fs.create(part, True)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()
        context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), self._conf)
        rename = self._jvm.java.lang.Class.forName("org.apache.hadoop.fs.Options$Rename")
        how = self._jvm.java.lang.reflect.Array.newInstance(rename, 1)
        self._jvm.java.lang.reflect.Array.set(how, 0, rename.getField("OVERWRITE").get(None))
        context.rename(part, p, how)

    def delete(self, path: str) -> None:
        fs, p = self._at(path)
        fs.delete(p, True)

    def size(self, path: str) -> int:
        fs, p = self._at(path)
        return fs.getContentSummary(p).getLength()
