"""Small files in a shared folder that are created at once or not at all.

``Folder.create`` publishes a file with its whole content only if no file of that name exists, so of several writers one
wins and the others learn of it. That is all that version numbers and manifests need. On a local file system a hard link
does it, elsewhere a rename that refuses to overwrite, which file systems of a cluster carry out in one step.
"""

from __future__ import annotations

import json
import uuid
from typing import Any

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession

_TAKEN = ("FileAlreadyExistsException",)


class Folder:
    """A folder of any file system that Spark reaches; names are paths below it."""

    def __init__(self, spark: SparkSession, root: str):
        self._spark, self.root = spark, root.rstrip("/")
        self._hadoop = spark._jvm.org.apache.hadoop.fs
        self._conf = spark._jsc.hadoopConfiguration()
        self._fs = self._path().getFileSystem(self._conf)

    def _path(self, name: str = ""):
        return self._hadoop.Path(f"{self.root}/{name}" if name else self.root)

    def exists(self, name: str = "") -> bool:
        return self._fs.exists(self._path(name))

    def names(self, folder: str = "") -> list[str]:
        """What lies directly in ``folder``, in order; nothing if there is no such folder."""
        if not self.exists(folder):
            return []
        return sorted(s.getPath().getName() for s in self._fs.listStatus(self._path(folder)))

    def read(self, name: str) -> str:
        stream = self._fs.open(self._path(name))
        try:
            return self._spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def remove(self, name: str) -> None:
        self._fs.delete(self._path(name), True)

    def move(self, name: str, to: str) -> None:
        """Rename a file; the new name must be free."""
        if not self._fs.rename(self._path(name), self._path(to)):
            raise FileExistsError(f"{name} can't become {to} in {self.root}.")

    def create(self, name: str, text: str) -> bool:
        """Publish ``text`` as ``name``; False if that name is taken."""
        draft = f"_drafts/{uuid.uuid4().hex}"
        stream = self._fs.create(self._path(draft), False)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()
        self._fs.mkdirs(self._path(name).getParent())
        try:
            self._publish(draft, name)
        except Py4JJavaError as error:
            if error.java_exception.getClass().getSimpleName() in _TAKEN:
                return False
            raise
        finally:
            self._fs.delete(self._path(draft), False)
        return True

    def _publish(self, draft: str, name: str) -> None:
        source, target = self._fs.makeQualified(self._path(draft)), self._fs.makeQualified(self._path(name))
        jvm = self._spark._jvm
        if self._fs.getUri().getScheme() == "file":
            to_path = lambda p: jvm.java.io.File(p.toUri().getPath()).toPath()
            jvm.java.nio.file.Files.createLink(to_path(target), to_path(source))
            return
        rename = getattr(self._hadoop, "Options$Rename")
        options = self._spark.sparkContext._gateway.new_array(rename, 1)
        options[0] = rename.NONE
        self._hadoop.FileContext.getFileContext(target.toUri(), self._conf).rename(source, target, options)


class Versions:
    """Numbered JSON records in a folder; each number is taken once, the highest is current."""

    def __init__(self, spark: SparkSession, root: str, folder: str = "versions"):
        self.files, self._folder = Folder(spark, root), folder

    def _name(self, number: int) -> str:
        return f"{self._folder}/{number:012d}.json"

    def numbers(self) -> list[int]:
        return [int(n.removesuffix(".json")) for n in self.files.names(self._folder) if n.endswith(".json") and not n.startswith(".")]

    def latest(self) -> tuple[int, Any] | None:
        numbers = self.numbers()
        return (numbers[-1], self.read(numbers[-1])) if numbers else None

    def read(self, number: int) -> Any:
        return json.loads(self.files.read(self._name(number)))

    def commit(self, number: int, record: Any) -> bool:
        """Take ``number`` for ``record``; False if another writer has it."""
        return self.files.create(self._name(number), json.dumps(record))

    def remove(self, number: int) -> None:
        self.files.remove(self._name(number))
