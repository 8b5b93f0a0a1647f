"""Files through Hadoop's file systems, so any URI Spark knows will do, and the head that is swapped atomically."""

from __future__ import annotations

import atexit
import fcntl
import hashlib
import json
import os
import tempfile
import time
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession


class Conflict(RuntimeError):
    """Another writer was first."""


class Store:
    """A folder tree at ``root`` (a path or any URI with a Hadoop file system)."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")
        self._jvm = spark._jvm
        self._conf = spark._jsc.hadoopConfiguration()

    def path(self, key: str):
        if ".." in key.split("/"):
            raise ValueError(f"key {key!r} leaves the store")
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{key}")

    @property
    def fs(self):
        return self.path("").getFileSystem(self._conf) if self.root else None

    def exists(self, key: str) -> bool:
        return self.fs.exists(self.path(key))

    def read(self, key: str, most: int = 1 << 18) -> bytes:
        """At most ``most`` bytes; a larger object is refused by its metadata, before it is opened."""
        status = self.fs.getFileStatus(self.path(key))
        if status.getLen() > most:
            raise ValueError(f"{key} has {status.getLen()} bytes, the limit is {most}")
        stream = self.fs.open(self.path(key))
        try:
            return bytes(self._jvm.org.apache.commons.io.IOUtils.toByteArray(stream))
        finally:
            stream.close()

    def put_immutable(self, key: str, data: bytes) -> None:
        """Create-only: equal bytes that are there already are success, and count as written now; others a conflict."""
        if not self.put_new(key, data):
            if self.read(key, max(len(data), 1 << 18)) != data:
                raise Conflict(key)
            self.touch(key)

    def put_new(self, key: str, data: bytes) -> bool:
        """Creates an object whole, or not at all and False if there is one: of two writers one wins.

        Local files are written aside, synced, and renamed under a lock; elsewhere the file system's own exclusive
        creation decides (object stores are asked for a conditional write).
        """
        if self.local is not None:
            temporary = f"{key}.{uuid.uuid4().hex}.tmp"
            os.makedirs(os.path.dirname(f"{self.local}/{key}"), exist_ok=True)
            with open(f"{self.local}/{temporary}", "wb") as file:
                file.write(data)
                file.flush()
                os.fsync(file.fileno())
            if self.rename_new(temporary, key):
                return True
            os.unlink(f"{self.local}/{temporary}")
            return False
        try:
            builder = self.fs.createFile(self.path(key)).recursive().overwrite(False).opt("fs.option.create.conditional.overwrite", True)
            stream = builder.build()
            stream.write(bytearray(data))
            stream.close()
        except Py4JJavaError as e:
            if self.exists(key):
                return False
            raise OSError(f"can't create {key}") from e
        return True

    @property
    def local(self) -> str | None:
        """The root as a local folder, if it is one."""
        return self.root.removeprefix("file://") if self.fs.getScheme() == "file" else None

    def rename_new(self, source: str, target: str) -> bool:
        """Rename that never replaces; local files need a lock for that, as their rename does replace."""
        if self.local is not None:
            base = self.local
            os.makedirs(os.path.dirname(f"{base}/{target}"), exist_ok=True)
            with open(f"{base}/.lock", "w") as lock:
                fcntl.flock(lock, fcntl.LOCK_EX)
                if os.path.exists(f"{base}/{target}"):
                    return False
                os.rename(f"{base}/{source}", f"{base}/{target}")
                folder = os.open(os.path.dirname(f"{base}/{target}"), os.O_RDONLY)
                try:
                    os.fsync(folder)
                finally:
                    os.close(folder)
                return True
        self.fs.mkdirs(self.path(target).getParent())
        return not self.exists(target) and self.fs.rename(self.path(source), self.path(target))

    def place(self, source: str, target: str) -> None:
        """Moves a folder to a name of the caller's own; what isn't there, because nothing was written, becomes an empty one."""
        self.fs.mkdirs(self.path(target).getParent())
        if not self.exists(source):
            self.fs.mkdirs(self.path(target))
        elif not self.fs.rename(self.path(source), self.path(target)):
            raise OSError(f"can't rename {source}")

    def touch(self, key: str) -> None:
        """Counts as modified now, so that collection, which spares what is young, spares it."""
        if self.local is not None:
            os.utime(f"{self.local}/{key}")
        else:
            self.fs.setTimes(self.path(key), int(time.time() * 1000), -1)

    def modified(self, key: str) -> int | None:
        """When it was last modified, in ms; None if it isn't there."""
        return self.fs.getFileStatus(self.path(key)).getModificationTime() if self.exists(key) else None

    def list(self, key: str, temporary: bool = False) -> list[tuple[str, int, int]]:
        """(key, bytes, modified in ms) of the entries under a key; what writers have under way only if ``temporary``."""
        if not self.exists(key):
            return []
        found = self.fs.listStatus(self.path(key))
        names = [(s.getPath().getName(), s) for s in found]
        size = lambda s: self.fs.getContentSummary(s.getPath()).getLength() if s.isDirectory() else s.getLen()
        return [(f"{key}/{n}", size(s), s.getModificationTime()) for n, s in names if (temporary or not n.endswith(".tmp")) and not n.startswith(".")]

    def delete(self, key: str) -> bool:
        return self.fs.delete(self.path(key), True)


class HeadFile:
    """A chain's head: numbered manifests of which the highest counts; a swap creates the next number, once.

    Whoever comes second finds the number taken and fails, as files are created exclusively.
    """

    LIMIT = 256 << 10

    def __init__(self, store: Store, chain_id: int) -> None:
        self.store, self.folder = store, f"chains/{chain_id}/heads"

    def read(self) -> tuple[int, dict | None]:
        numbers = sorted(int(k.rsplit("-", 1)[1].removesuffix(".json")) for k, _, _ in self.store.list(self.folder))
        if not numbers:
            return 0, None
        return numbers[-1], json.loads(self.store.read(self.key(numbers[-1]), self.LIMIT))

    def at(self, version: int) -> dict | None:
        return json.loads(self.store.read(self.key(version), self.LIMIT)) if self.store.exists(self.key(version)) else None

    def key(self, version: int) -> str:
        return f"{self.folder}/head-{version:012d}.json"

    def compare_and_swap(self, version: int, head: dict) -> int:
        data = json.dumps(head, sort_keys=True).encode()
        if len(data) > self.LIMIT:
            raise ValueError("head is too large")
        now, _ = self.read()
        if now != version or not self.store.put_new(self.key(version + 1), data):
            raise Conflict(f"head is at {now}, not {version}")
        return version + 1


def digest_of(head: dict) -> str:
    return hashlib.sha256(json.dumps(head, sort_keys=True).encode()).hexdigest()


def shared_dir(spark: SparkSession) -> str:
    """Folder that driver and executors share: ``spark.checkpoint.dir``.

    Where that is unset a temporary one is made, once a session, if all runs in one process (master ``local``); on a
    cluster that would be a folder of each machine's own, and is an error.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError(f"spark.checkpoint.dir must name a shared folder when the master is {master}")
        path = f"file://{tempfile.mkdtemp(prefix='tidemark-')}"
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def scratch(spark: SparkSession, label: str) -> str:
    """A new folder's name under the shared one. What is written there is deleted when the driver's process ends."""
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    if not _SCRATCH:
        atexit.register(clear_scratch, spark)
    _SCRATCH.append(path)
    return path


_SCRATCH: list[str] = []


def clear_scratch(spark: SparkSession) -> None:
    """Delete all that ``scratch`` has named so far; frames that read from there can't be read any more."""
    while _SCRATCH:
        try:
            path = spark._jvm.org.apache.hadoop.fs.Path(_SCRATCH.pop())
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
        except Exception:  # noqa: BLE001 - the JVM may have gone first; the folder's owner clears the rest
            _SCRATCH.clear()


def stage(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once to the shared folder and go on from the files: a costly pass doesn't run twice, and outlives executors."""
    path = scratch(df.sparkSession, label)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
