"""A log of numbered entries in a shared folder, each written once and only if its number is free.

An entry is a small JSON file. It is written beside the log under a name of its own and then renamed to its number,
which fails if the number is taken; so no reader meets half an entry, two writers never share a file, and the order is
that of the numbers, whatever the clocks say. Who loses a number looks at what came first and tries the next one. The
rename is as atomic as the store's (it is on HDFS and on local disks).
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import SparkSession


class VersionLog:
    def __init__(self, spark: SparkSession, folder: str):
        self.folder, hadoop = folder.rstrip("/"), spark.sparkContext._jvm.org.apache.hadoop
        self._spark, self._jvm, self._path = spark, spark.sparkContext._jvm, hadoop.fs.Path
        self._fs = self._path(self.folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _file(self, name: str):
        return self._path(f"{self.folder}/{name}")

    def entries(self) -> list[tuple[int, dict]]:
        """(number, entry), in the order of their numbers."""
        if not self._fs.exists(self._path(self.folder)):
            return []
        names = sorted(s.getPath().getName() for s in self._fs.listStatus(self._path(self.folder)))
        return [(int(n[:-5]), self._read(n)) for n in names if n.endswith(".json") and n[:-5].isdigit()]

    def _read(self, name: str) -> dict:
        stream = self._fs.open(self._file(name))
        try:
            return json.loads(self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def put(self, number: int, entry: dict) -> bool:
        """Write the entry with this number; False if there is one."""
        draft = self._file(f"draft-{uuid.uuid4().hex}")
        stream = self._fs.create(draft, False)
        try:
            stream.write(bytearray(json.dumps(entry).encode()))
        finally:
            stream.close()
        files = self._jvm.org.apache.hadoop.fs
        context = files.FileContext.getFileContext(self._fs.getUri(), self._spark.sparkContext._jsc.hadoopConfiguration())
        rename = getattr(files, "Options$Rename")
        how = self._spark.sparkContext._gateway.new_array(rename, 1)
        how[0] = rename.NONE
        try:
            context.rename(draft, self._file(f"{number:012d}.json"), how)
        except Exception as e:  # noqa: BLE001  py4j hides the Java type
            if not self._fs.exists(self._file(f"{number:012d}.json")):
                raise
            self._fs.delete(draft, False)
            if "AlreadyExists" not in str(e):
                raise
            return False
        return True

    def append(self, make: Callable[[list[tuple[int, dict]]], dict | None]) -> int | None:
        """Add what `make` gives for the entries so far, as the next one, or nothing where it gives None.

        If another writer takes the number first, `make` is asked again with that writer's entry among them.
        """
        while True:
            seen = self.entries()
            entry = make(seen)
            if entry is None:
                return None
            number = seen[-1][0] + 1 if seen else 1
            if self.put(number, entry):
                return number
