"""Names, texts and bytes in folders of any file system that Spark can reach."""

from __future__ import annotations

from pyspark.sql import SparkSession


class Files:
    """Names in a folder of any file system that Spark can reach."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._path = lambda p: jvm.org.apache.hadoop.fs.Path(p)
        self._fs = self._path(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def exists(self, name: str = "") -> bool:
        return self._fs.exists(self._path(f"{self.path}/{name}" if name else self.path))

    def folders(self) -> list[str]:
        if not self.exists():
            return []
        return sorted(s.getPath().getName() for s in self._fs.listStatus(self._path(self.path)) if s.isDirectory())

    def names(self, name: str) -> list[str]:
        """The files of a folder."""
        at = self._path(f"{self.path}/{name}")
        return sorted(s.getPath().getName() for s in self._fs.listStatus(at) if s.isFile()) if self._fs.exists(at) else []

    def size(self, name: str) -> int:
        """Bytes of all files below a folder."""
        return self._fs.getContentSummary(self._path(f"{self.path}/{name}")).getLength()

    def move(self, name: str, to: str) -> None:
        if not self._fs.rename(self._path(f"{self.path}/{name}"), self._path(f"{self.path}/{to}")):
            raise OSError(f"{self.path}/{name} could not be moved")

    def make(self, *names: str) -> None:
        for name in names:
            self._fs.mkdirs(self._path(f"{self.path}/{name}"))

    def delete(self, name: str) -> None:
        self._fs.delete(self._path(f"{self.path}/{name}"), True)

    def write(self, name: str, text: str) -> None:
        self.write_bytes(name, text.encode())

    def write_bytes(self, name: str, content: bytes) -> None:
        out = self._fs.create(self._path(f"{self.path}/{name}"), True)
        try:
            out.write(bytearray(content))
        finally:
            out.close()

    def read(self, name: str) -> str:
        source = self._fs.open(self._path(f"{self.path}/{name}"))
        try:
            return bytes(source.readAllBytes()).decode()
        finally:
            source.close()
