"""Files of tables, by the file system that the cluster uses: moving, deleting, and journals of changes.

A journal is a small JSON file in the database's folder that says what a change is about to do. It is created
exclusively, so that of two changes of one table one fails, and goes when all is done; ``Database.recover`` takes up those left over.
"""

from __future__ import annotations

import json

from pyspark.sql import SparkSession

FOLDER = "_tidemark_journal"


class Busy(RuntimeError):
    """Another change of the table is under way, or was cut off and waits for recovery."""


class Files:
    def __init__(self, spark: SparkSession):
        self._jvm, self._conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()

    def _path(self, path: str):
        return self._jvm.org.apache.hadoop.fs.Path(path)

    def url(self, path: str):
        """The path of an escaped URL, as ``_metadata.file_path`` has it."""
        return self._jvm.org.apache.hadoop.fs.Path(self._jvm.java.net.URI(path)).toString()

    def _of(self, path: str):
        p = self._path(path)
        return p.getFileSystem(self._conf), p

    def exists(self, path: str) -> bool:
        fs, p = self._of(path)
        return fs.exists(p)

    def move(self, old: str, new: str) -> None:
        fs, p = self._of(old)
        target = self._path(new)
        fs.mkdirs(target.getParent())
        if not fs.rename(p, target):
            raise OSError(f"{old} can't be moved to {new}")

    def delete(self, path: str) -> None:
        fs, p = self._of(path)
        fs.delete(p, True)

    def below(self, path: str) -> list[str]:
        """Data files below a folder, relative to it; those whose names Spark passes over are left out."""
        fs, p = self._of(path)
        found, root = [], fs.makeQualified(p).toUri()
        if not fs.exists(p):
            return found
        walk = fs.listFiles(p, True)
        while walk.hasNext():
            rest = root.relativize(walk.next().getPath().toUri()).getPath()
            if not any(x.startswith(("_", ".")) and "=" not in x for x in rest.split("/")):
                found.append(rest)
        return sorted(found)

    def names(self, path: str) -> list[str]:
        fs, p = self._of(path)
        return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []

    def write_new(self, path: str, text: str) -> None:
        """A file that is not there yet; ``Busy`` if it is."""
        fs, p = self._of(path)
        try:
            out = fs.create(p, False)
        except Exception as e:
            if fs.exists(p):
                raise Busy(path) from e
            raise
        try:
            out.write(bytearray(text.encode()))
        finally:
            out.close()

    def read(self, path: str) -> str:
        fs, p = self._of(path)
        source = fs.open(p)
        try:
            return bytes(source.readAllBytes()).decode()
        finally:
            source.close()


class Journal:
    """The journals of a database, one for each table that a change is at."""

    def __init__(self, spark: SparkSession, database: str | None):
        self.files, self.spark = Files(spark), spark
        name = database or spark.catalog.currentDatabase()
        facts = {r[0]: r[1] for r in spark.sql(f"DESCRIBE DATABASE {name}").collect()}
        self.folder = f"{facts['Location'].rstrip('/')}/{FOLDER}"

    def begin(self, table: str, entry: dict) -> str:
        """Of a change that is being prepared; only what is decided too is gone through with."""
        path = f"{self.folder}/{table.rpartition('.')[2].lower()}.json"
        self.files.write_new(path, json.dumps(entry))
        return path

    def decide(self, path: str, entry: dict) -> None:
        """Beside the journal at ``path``: one exclusive write."""
        self.files.write_new(path + ".decided", json.dumps(entry))

    def pending(self) -> list[tuple[str, dict]]:
        """Paths and entries: what was decided if anything was. A file cut off in writing says nothing."""
        found = []
        for name in self.files.names(self.folder):
            if name.endswith(".json") and not name.startswith("."):
                path = f"{self.folder}/{name}"
                begun, decided = self._entry(path), self._entry(path + ".decided")
                found.append((path, decided or begun or {"table": name.removesuffix(".json"), "kind": "files", "decided": False}))
        return found

    def _entry(self, path: str) -> dict | None:
        try:
            return json.loads(self.files.read(path)) if self.files.exists(path) else None
        except ValueError:
            return None

    def end(self, path: str) -> None:
        self.files.delete(path + ".decided")
        self.files.delete(path)
