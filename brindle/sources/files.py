"""Small files in any store that Spark's file system layer reaches."""

from __future__ import annotations

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


class Files:
    def __init__(self, spark: SparkSession, root: str):
        self.jvm, self.root = spark._jvm, root.rstrip("/")
        self.conf, self.gateway = spark._jsc.hadoopConfiguration(), spark.sparkContext._gateway

    def _at(self, name: str):
        path = self.jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)
        return path.getFileSystem(self.conf), path

    def names(self, folder: str = "") -> list[str]:
        fs, path = self._at(folder)
        return [s.getPath().getName() for s in fs.listStatus(path)] if fs.exists(path) else []

    def read(self, name: str) -> str:
        fs, path = self._at(name)
        stream = fs.open(path)
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def create(self, name: str, text: str) -> bool:
        """Writes a new file, whole or not at all; False if it is there already.

        Of several writers one succeeds where the store links or renames without replacing: local files and HDFS. An object
        store whose rename copies gives no such promise; there only one session may write at a time.
        """
        fs, path = self._at(name)
        draft = self._at(f".{name}.{self.jvm.java.util.UUID.randomUUID()}")[1]
        stream = fs.create(draft, False)
        stream.write(text.encode())
        stream.close()
        try:
            if fs.getScheme() == "file":
                to, of = (self.jvm.java.nio.file.Paths.get(p.toUri().getPath(), self._none(self.jvm.java.lang.String)) for p in (path, draft))
                self.jvm.java.nio.file.Files.createLink(to, of)
                fs.delete(draft, False)
            else:
                context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(path.toUri(), self.conf)
                context.rename(draft, path, self._none(getattr(self.jvm.org.apache.hadoop.fs, "Options$Rename")))
            return True
        except Py4JJavaError as error:
            fs.delete(draft, False)
            if fs.exists(path):
                return False
            raise error

    def _none(self, kind):
        return self.gateway.new_array(kind, 0)

    def delete(self, name: str) -> None:
        fs, path = self._at(name)
        fs.delete(path, True)
