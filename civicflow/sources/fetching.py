"""Sources behind requests, archives, and files that several workers share.

No connection is opened here: the caller hands over a function that does so. Files are named by paths
that Spark's file systems can open.
"""

from __future__ import annotations

import io
import re
import time
import zipfile
from collections.abc import Callable, Iterator

import pandas as pd
from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

Response = tuple[int, bytes]

#: Answers for which another attempt may help: too many requests, and errors of the server.
AGAIN = frozenset({408, 425, 429, *range(500, 600)})


def attempted(url: str, get: Callable[[str], Response], attempts: int = 3, wait: float = 1.0, pause: Callable[[float], None] = time.sleep) -> tuple[int | None, bytes | None, int, str | None]:
    """(status, body, attempts, error) of a request that is repeated after 1, 2, 4, ... waits while it fails in a way that may pass."""
    status = body = error = None
    for n in range(1, attempts + 1):
        try:
            status, body = get(url)
            error = None if status < 400 else f"status {status}"
        except Exception as e:  # a transport may fail in any way; the request is reported, not lost
            status, body, error = None, None, f"{type(e).__name__}: {e}"
        if error is None or (status is not None and status not in AGAIN):
            break
        if n < attempts:
            pause(wait * 2 ** (n - 1))
    return status, body if error is None else None, n, error


def fetched(requests: DataFrame, get: Callable[[str], Response], attempts: int = 3, wait: float = 1.0, workers: int = 8, most_bytes: int = 16 << 20) -> DataFrame:
    """(url, status, body, attempts, error) for each different url of requests (url), asked by so many workers at a time.

    A request that fails for good has an error and no body. A null url is left out. Answers leave a
    worker as soon as they hold ``most_bytes`` together, so memory is bounded by that and one answer.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ["url", "status", "body", "attempts", "error"]
        held, size = [], 0
        for pdf in batches:
            for url in pdf["url"]:
                held.append((url, *attempted(url, get, attempts, wait)))
                size += len(held[-1][2] or b"")
                if size >= most_bytes or len(held) >= 1000:
                    yield pd.DataFrame(held, columns=names).astype({"status": "Int32"})
                    held, size = [], 0
        if held:
            yield pd.DataFrame(held, columns=names).astype({"status": "Int32"})

    urls = requests.select("url").where("url is not null").distinct().repartition(workers)
    return urls.mapInPandas(run, "url string, status int, body binary, attempts int, error string")


def unzipped(spark: SparkSession, path: str, wanted: str = r".*", longest: int = 256 << 20) -> DataFrame:
    """(path, member, content, error) of the files in ZIP archives whose names match ``wanted`` as a whole.

    A member over ``longest`` bytes, one that can't be read, and an archive that isn't one (member
    null) have an error and no content. Members go on one by one; folders are left out.
    """
    pattern = re.compile(wanted)

    def members(path: str, data: bytes) -> Iterator[tuple]:
        try:
            archive = zipfile.ZipFile(io.BytesIO(data))
        except zipfile.BadZipFile as e:
            yield path, None, None, f"BadZipFile: {e}"
            return
        for info in archive.infolist():
            if info.is_dir() or not pattern.fullmatch(info.filename):
                continue
            try:
                with archive.open(info) as f:
                    content = f.read(longest + 1)
                yield (path, info.filename, content, None) if len(content) <= longest else (path, info.filename, None, f"over {longest} bytes")
            except (zipfile.BadZipFile, RuntimeError, NotImplementedError, OSError, EOFError) as e:
                yield path, info.filename, None, f"{type(e).__name__}: {e}"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for p, data in zip(pdf["path"], pdf["content"], strict=True):
                for row in members(p, bytes(data)):
                    yield pd.DataFrame([row], columns=["path", "member", "content", "error"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "path string, member string, content binary, error string")


def unique_names(rows: DataFrame, name: str, order: str) -> DataFrame:
    """rows with a column unique_name: the first of a name, by order, keeps it; later ones get _1, _2, ... before the last dot.

    A name that a number would make equal to another row's own name isn't looked for again.
    """
    place = F.row_number().over(Window.partitionBy(name).orderBy(order)) - 1
    stem, suffix = F.regexp_replace(name, r"(?s)(?<=.)\.[^.]*$", ""), F.regexp_extract(name, r"(?s).(\.[^.]*)$", 1)
    return rows.withColumn("unique_name", F.when(place == 0, F.col(name)).otherwise(F.concat(stem, F.lit("_"), place.cast("string"), suffix)))


def without_numbered(paths: list[str]) -> list[str]:
    """Paths whose file name doesn't end in a number before ``.csv.gz``, as those of repeated downloads do."""
    return [p for p in paths if not re.fullmatch(r".+_\d+\.csv\.gz", p.rsplit("/", 1)[-1])]


def files_below(spark: SparkSession, path: str, names: list[str]) -> DataFrame:
    """(path, length, modificationTime) of the files in all folders below a path whose names are in a list; no content is read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "length", "modificationTime")
    return files.where(F.element_at(F.split("path", "/"), -1).isin(names))


def work_order(units: DataFrame, unit: str, seed: int = 0) -> DataFrame:
    """units dealt over tasks by a hash of the unit, so that large ones that stand together don't land in one task."""
    return units.repartition(F.xxhash64(F.col(unit), F.lit(seed)))


def _claim_of(spark: SparkSession, folder: str, unit: str) -> tuple:
    """The file that claims a unit, and its file system. Letters that may not stand in a name are written by their number."""
    safe = re.sub(r"[^A-Za-z0-9._-]", lambda m: f"%{ord(m[0]):x}.", unit)
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder.rstrip('/')}/{safe}.claim")
    return path, path.getFileSystem(spark._jsc.hadoopConfiguration())


def claim(spark: SparkSession, folder: str, unit: str) -> bool:
    """Whether this worker is the first to claim a unit: a file in a shared folder that only one can create."""
    path, system = _claim_of(spark, folder, unit)
    try:
        system.create(path, False).close()
    except Py4JJavaError as e:
        # The same error comes where the folder is a file, which isn't another's claim. A claim may be released by now.
        taken = "FileAlreadyExistsException" in e.java_exception.getClass().getName() and system.getFileStatus(path.getParent()).isDirectory()
        if taken or system.exists(path):
            return False
        raise
    return True


def release(spark: SparkSession, folder: str, unit: str) -> None:
    """Removes a unit's claim."""
    path, system = _claim_of(spark, folder, unit)
    system.delete(path, False)
