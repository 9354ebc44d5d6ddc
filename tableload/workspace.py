"""Scratch folders that every executor can reach, and a few file-system calls."""

from __future__ import annotations

import contextlib
import hashlib
import tempfile
import threading
import time
import uuid
from collections import Counter
from collections.abc import Callable, Iterator

from pyspark.sql import SparkSession

# Seconds for which a writer's lease holds without being renewed.
LEASE_SECONDS = 120.0

# Session setting that names a session as a writer; streams hand it on to the sessions of their batches.
_WRITER = "spark.tableload.writer"


def scratch_root(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    A local session without the setting gets a fresh temporary folder; a cluster without it is refused, since a
    machine-local folder is not visible to the other executors.
    """
    context = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not root:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = tempfile.mkdtemp(prefix="tableload-")
        context.setCheckpointDir(root)
    return root


def scratch_path(spark: SparkSession, label: str) -> str:
    """A path below the scratch root that nobody has used yet."""
    return f"{_own_scratch(spark)}/{label}-{uuid.uuid4().hex}"


def _own_scratch(spark: SparkSession) -> str:
    return f"{scratch_root(spark).rstrip('/')}/tableload/{spark.sparkContext.applicationId}"


def drop_scratch(spark: SparkSession) -> None:
    """Delete what this application has staged; results that are not written yet can no longer be computed."""
    remove(spark, _own_scratch(spark))


def _hadoop(spark: SparkSession, path: str):
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration()), hadoop_path


def exists(spark: SparkSession, path: str) -> bool:
    fs, hadoop_path = _hadoop(spark, path)
    return fs.exists(hadoop_path)


def subfolders(spark: SparkSession, path: str) -> list[str]:
    """Names of the folders directly below ``path``; empty when it does not exist."""
    fs, hadoop_path = _hadoop(spark, path)
    if not fs.exists(hadoop_path):
        return []
    return sorted(s.getPath().getName() for s in fs.listStatus(hadoop_path) if s.isDirectory())


def _hidden(name: str) -> bool:
    """Whether scans skip a file or folder of this name; a partition column may begin with an underscore."""
    return name.startswith(".") or (name.startswith("_") and "=" not in name)


def first_file(spark: SparkSession, path: str) -> str | None:
    """Some data file at or below ``path``, found without listing the rest; hidden folders hold none."""
    fs, hadoop_path = _hadoop(spark, path)
    if not fs.exists(hadoop_path):
        return None
    open_folders = [fs.listStatusIterator(hadoop_path)]
    while open_folders:
        if not open_folders[-1].hasNext():
            open_folders.pop()
            continue
        status = open_folders[-1].next()
        if _hidden(status.getPath().getName()):
            continue
        if not status.isDirectory():
            return status.getPath().toString()
        open_folders.append(fs.listStatusIterator(status.getPath()))
    return None


def partition_folders(spark: SparkSession, path: str, columns: list[str], values: list) -> list[str]:
    """The folders below ``path`` of partitions given by their column values as text, those that exist.

    A folder that holds some of them is listed once; no call to the file system is made per partition.
    """
    name_of = spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.getPartitionPathString
    below: dict[str, set[str]] = {}
    folders = []
    for row in values:
        folder = path
        for column, value in zip(columns, row, strict=True):
            if folder not in below:
                below[folder] = set(subfolders(spark, folder))
            name = name_of(column, value)
            if name not in below[folder]:
                break
            folder = f"{folder}/{name}"
        else:
            folders.append(folder)
    return folders


def move(spark: SparkSession, path: str, target: str) -> None:
    """Rename a folder this library wrote; the target, on the same file system, must not exist."""
    fs, hadoop_path = _hadoop(spark, path)
    if exists(spark, target) or not fs.rename(hadoop_path, _hadoop(spark, target)[1]):
        raise FileExistsError(f"{path} cannot be moved to {target}")


def replace_folder(spark: SparkSession, path: str, target: str) -> None:
    """Rename a folder this library wrote to ``target``, on the same file system, in the place of any that is there."""
    fs, hadoop_path = _hadoop(spark, path)
    place = _hadoop(spark, target)[1]
    fs.delete(place, True)
    fs.mkdirs(place.getParent())
    if not fs.rename(hadoop_path, place):
        raise FileExistsError(f"{path} cannot be moved to {target}")


def touch(spark: SparkSession, path: str) -> None:
    """Create an empty file, or replace one."""
    fs, hadoop_path = _hadoop(spark, path)
    fs.create(hadoop_path, True).close()


def fingerprint(spark: SparkSession, path: str) -> str:
    """A hash of the names, lengths and times of all data files at or below ``path``, from the listing alone."""
    fs, hadoop_path = _hadoop(spark, path)
    found, files = [], fs.listFiles(hadoop_path, True)
    while files.hasNext():
        status = files.next()
        if not _hidden(status.getPath().getName()):
            found.append(f"{status.getPath()} {status.getLen()} {status.getModificationTime()}")
    return hashlib.sha256("\n".join(sorted(found)).encode()).hexdigest()[:16]


def file_names(spark: SparkSession, path: str) -> set[str]:
    """Names of the files directly below ``path``; empty when it does not exist."""
    fs, hadoop_path = _hadoop(spark, path)
    if not fs.exists(hadoop_path):
        return set()
    return {s.getPath().getName() for s in fs.listStatus(hadoop_path) if not s.isDirectory()}


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder this library wrote; nothing happens when it is gone already."""
    fs, hadoop_path = _hadoop(spark, path)
    fs.delete(hadoop_path, True)


class LeaseError(RuntimeError):
    """Another session writes the table."""


class Lease:
    """The right of one session to write a table: a file beside it, with its owner and the time until which it holds.

    The file is created in one step that fails where it exists. Its holder renews it well before it ends; one that was not
    renewed is stale, its writer having died, and is taken over. A session may take its own lease again. Clocks of
    drivers have to agree to a few seconds.
    """

    _holders: Counter[tuple[str, str]] = Counter()
    _lock = threading.Lock()

    def __init__(self, spark: SparkSession, target: str, seconds: float = LEASE_SECONDS):
        owner = spark.conf.get(_WRITER, None)
        if owner is None:
            owner = uuid.uuid4().hex
            spark.conf.set(_WRITER, owner)
        self.spark, self.owner, self.seconds = spark, owner, seconds
        self.path = f"{target.rstrip('/')}.writer"

    def _read(self) -> tuple[str, float] | None:
        """Owner and end; None without a file. One that is being written is read again."""
        fs, path = _hadoop(self.spark, self.path)
        for _ in range(20):
            if not fs.exists(path):
                return None
            with contextlib.suppress(Exception):
                stream = fs.open(path)
                try:
                    text = self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
                finally:
                    stream.close()
                owner, end = text.split(" ")
                return owner, float(end)
            time.sleep(0.05)
        raise LeaseError(f"{self.path} is no lease")

    def _write(self, replace: bool) -> None:
        fs, path = _hadoop(self.spark, self.path)
        stream = fs.create(path, replace)
        try:
            stream.writeBytes(f"{self.owner} {time.time() + self.seconds}")
        finally:
            stream.close()

    def take(self) -> None:
        key = (self.owner, self.path)
        with Lease._lock:
            if not Lease._holders[key]:
                found = self._read()
                if found is not None:
                    if found[0] != self.owner and found[1] > time.time():
                        raise LeaseError(f"another session writes {self.path.removesuffix('.writer')}")
                    # of several that find it stale, only one can move it away
                    aside = f"{self.path}.{uuid.uuid4().hex}"
                    fs, path = _hadoop(self.spark, self.path)
                    if not fs.rename(path, _hadoop(self.spark, aside)[1]):
                        raise LeaseError(f"another session takes over {self.path}")
                    remove(self.spark, aside)
                try:
                    self._write(replace=False)
                except Exception as failure:
                    raise LeaseError(f"another session writes {self.path.removesuffix('.writer')}") from failure
            Lease._holders[key] += 1

    def check(self) -> None:
        """Fail if the lease was lost to another session, as when this driver was halted for long."""
        found = self._read()
        if found is None or found[0] != self.owner:
            raise LeaseError(f"the lease {self.path} was lost")

    def renew(self) -> None:
        self.check()
        self._write(replace=True)

    def release(self) -> None:
        key = (self.owner, self.path)
        with Lease._lock:
            Lease._holders[key] -= 1
            if not Lease._holders[key]:
                del Lease._holders[key]
                found = self._read()
                if found is not None and found[0] == self.owner:
                    remove(self.spark, self.path)

    def hold(self, ended: Callable[[float], bool]) -> None:
        """Renew the lease until ``ended``, which waits for as many seconds as it is given, then release it."""
        try:
            while not ended(self.seconds / 4):
                with contextlib.suppress(LeaseError):  # the writer finds out before it publishes
                    self.renew()
        finally:
            self.release()


@contextlib.contextmanager
def writer(spark: SparkSession, target: str, seconds: float = LEASE_SECONDS) -> Iterator[Lease]:
    """Be the only writer of a table, or fail with ``LeaseError``; the lease is renewed meanwhile."""
    lease = Lease(spark, target, seconds)
    lease.take()
    done = threading.Event()
    renewing = threading.Thread(target=lease.hold, args=(done.wait,), daemon=True)
    renewing.start()
    try:
        yield lease
    finally:
        done.set()
        renewing.join()
