"""Tables that follow from input files, built once for each state of these and published whole.

A table's key is a fingerprint of its name, its parameters and, for each input file, path, size and time of change. A table that is
there is read; one that isn't is built beside and renamed into place, so readers see all of it or nothing. Of two
that build the same at once the first to rename wins, and the other reads what is there. With ``stale`` the newest table
of that name and parameters is served at once while the new one is built behind it.
"""

from __future__ import annotations

import hashlib
import json
import threading
import uuid
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession

Build = Callable[[], DataFrame]
_building: dict[str, threading.Thread] = {}
_lock = threading.Lock()


def _path(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())


def fingerprint(spark: SparkSession, inputs: Sequence[str]) -> str:
    """Of all files below the inputs: path, size and time of change. A missing input counts as none."""
    seen = []
    for i in sorted(inputs):
        p, files = _path(spark, i)
        found = files.listFiles(p, True) if files.exists(p) else None
        while found is not None and found.hasNext():
            f = found.next()
            seen.append((f.getPath().toString(), f.getLen(), f.getModificationTime()))
    return hashlib.sha256(json.dumps(sorted(seen)).encode()).hexdigest()[:32]


def _folder(root: str, name: str, parameters: Mapping[str, object]) -> str:
    told = hashlib.sha256(json.dumps(parameters, sort_keys=True, default=str).encode()).hexdigest()[:16]
    return f"{root.rstrip('/')}/{name}/{told}"


def _published(spark: SparkSession, place: str) -> bool:
    p, files = _path(spark, f"{place}/_SUCCESS")
    return bool(files.exists(p))


def _newest(spark: SparkSession, folder: str) -> str | None:
    p, files = _path(spark, folder)
    if not files.exists(p):
        return None
    made = [(f.getModificationTime(), f.getPath().toString()) for f in files.listStatus(p) if f.isDirectory() and not f.getPath().getName().startswith(".")]
    return max(made)[1] if made else None


def _publish(spark: SparkSession, place: str, build: Build) -> None:
    folder, name = place.rsplit("/", 1)
    beside = f"{folder}/.{name}-{uuid.uuid4().hex}"
    build().write.parquet(beside)
    source, files = _path(spark, beside)
    target, _ = _path(spark, place)
    # A rename onto a folder that is there moves into it or fails, as the store has it: the first one has won.
    if files.exists(target) or not files.rename(source, target):
        files.delete(source, True)
    inside, _ = _path(spark, f"{place}/{beside.rsplit('/', 1)[1]}")
    if files.exists(inside):  # two renames at once: the later one moved into the first one's table
        files.delete(inside, True)


def derived(
    spark: SparkSession,
    root: str,
    name: str,
    inputs: Sequence[str],
    build: Build,
    parameters: Mapping[str, object] | None = None,
    stale: bool = False,
) -> DataFrame:
    """The table ``name`` under ``root`` for the present state of the inputs, built if it isn't there.

    With ``stale`` an older table of the same name and parameters is returned while the new one is built, by one thread of
    this driver however many ask; ``settle`` waits for it. Without an older table the call builds and waits.
    """
    folder = _folder(root, name, parameters or {})
    place = f"{folder}/{fingerprint(spark, inputs)}"
    if not _published(spark, place):
        old = _newest(spark, folder) if stale else None
        if old:
            with _lock:
                if place not in _building or not _building[place].is_alive():
                    _building[place] = threading.Thread(target=_publish, args=(spark, place, build), daemon=True)
                    _building[place].start()
            return spark.read.parquet(old)
        _publish(spark, place, build)
    return spark.read.parquet(place)


def settle() -> None:
    """Waits for all tables that are being built."""
    with _lock:
        waiting = list(_building.values())
        _building.clear()
    for t in waiting:
        t.join()


def prune(spark: SparkSession, root: str, name: str, parameters: Mapping[str, object] | None = None, keep: int = 2) -> int:
    """Deletes all but the newest tables of a name and parameters, and what builds that died have left; says how many."""
    p, files = _path(spark, _folder(root, name, parameters or {}))
    if not files.exists(p):
        return 0
    made = sorted(((f.getModificationTime(), f.getPath()) for f in files.listStatus(p)), key=lambda x: (x[1].getName().startswith("."), -x[0]))
    gone = [path for _, path in made[keep:]] + [path for _, path in made[:keep] if path.getName().startswith(".")]
    for path in gone:
        files.delete(path, True)
    return len(gone)
