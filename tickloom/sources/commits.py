"""A commit log for folders of Parquet files: which folders make up a table is what its newest commit says.

``<path>/_log/<version>.json`` holds what one commit adds and takes away, a line a folder of one symbol's day in one
batch, and which batch of which stream it brings. A commit is one file that a rename puts in place unless it is there
already; the store has to give that (HDFS and a single local writer do). So readers see all of a commit or nothing:
files that a lost job wrote belong to no commit, and a batch that a stream replays is known by its number, also after
its files were compacted away.

Every ``CHECKPOINT_EVERY`` commits the state is written out whole (``<version>.state``), so a reader reads one state and
the few commits behind it. Folders that no commit names any more go in ``vacuum``, after a while in which readers under
way still need them.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Sequence
from urllib.parse import unquote

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from py4j.protocol import Py4JJavaError

from tickloom import schemas as S

CHECKPOINT_EVERY = 50
#: A folder is kept so long after the last commit that named it, or, if none did, after its files were written.
KEPT_HOURS = 24.0
ENTRY = "version bigint, op string, kind string, folder string, symbol string, date string, files bigint, app string, app_batch bigint, at_ms bigint"
FOLDER = ("kind", "folder", "symbol", "date", "files")


class Conflict(Exception):
    """What a commit wanted to take away is gone already."""


def _system(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    hadoop = jvm.org.apache.hadoop.fs.Path(path)
    return jvm, hadoop, hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _names(spark: SparkSession, path: str) -> list[str]:
    _, hadoop, system = _system(spark, path)
    return sorted(f.getPath().getName() for f in system.listStatus(hadoop)) if system.exists(hadoop) else []


def versions(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the commits whose files are still there."""
    return [int(n[:-5]) for n in _names(spark, f"{path}/_log") if n.endswith(".json") and not n.startswith(("_", "."))]


def _put(spark: SparkSession, path: str, lines: list[dict]) -> bool:
    """A new file with these lines, whole or not at all; False if there is one of that name."""
    jvm, target, system = _system(spark, path)
    draft = jvm.org.apache.hadoop.fs.Path(target.getParent(), f"_{uuid.uuid4().hex}.draft")
    out = system.create(draft, False)
    out.write("".join(json.dumps(line) + "\n" for line in lines).encode())
    out.close()
    rename = jvm.org.apache.hadoop.fs.Options.Rename
    options = spark.sparkContext._gateway.new_array(rename, 1)
    options[0] = rename.NONE
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(system.getUri(), spark.sparkContext._jsc.hadoopConfiguration())
    try:
        context.rename(system.makeQualified(draft), system.makeQualified(target), options)
        return True
    except (Py4JJavaError, PySparkException) as error:
        system.delete(draft, False)
        if "FileAlreadyExists" in str(error):
            return False
        raise


def entries(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """The lines that make up the state at ``version`` (now, if None): those of the newest state before it and of the commits since."""
    names = _names(spark, f"{path}/_log")
    reach = [n for n in names if n[:1].isdigit() and (version is None or int(n.split(".")[0]) <= version)]
    state = max((n for n in reach if n.endswith(".state")), default=None)
    known = -1 if state is None else int(state.split(".")[0])
    files = [n for n in reach if n == state or (n.endswith(".json") and int(n.split(".")[0]) > known)]
    if not files:
        return spark.createDataFrame([], ENTRY)
    return spark.read.schema(ENTRY).json([f"{path}/_log/{n}" for n in files])


def folders(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """kind, folder, symbol, date, files of what the table consists of."""
    last = F.max_by(F.struct("op", *FOLDER[2:]), "version").alias("_l")
    return entries(spark, path, version).filter("folder IS NOT NULL").groupBy("kind", "folder").agg(last).filter("_l.op = 'add'").select("kind", "folder", "_l.symbol", "_l.date", "_l.files")


def applied(spark: SparkSession, path: str, app: str) -> int:
    """Number of the newest batch of the stream ``app`` that is in the table; -1 if none. A stream's batches come in order."""
    newest = entries(spark, path).filter(F.col("app") == app).agg(F.max("app_batch")).first()[0]
    return -1 if newest is None else newest


def written(spark: SparkSession, path: str, kind: str, batch: str) -> list[dict]:
    """The folders of one batch of one kind, as they lie there (a batch has some files a symbol and day)."""
    root = f"{path}/{kind}/batch={batch}"
    if not _system(spark, root)[2].exists(_system(spark, root)[1]):
        return []
    found: dict[str, dict] = {}
    for name in spark.read.schema("n int").parquet(root).inputFiles():
        symbol, date = unquote(name).rsplit("/", 3)[1:3]
        folder = f"{kind}/batch={batch}/{symbol}/{date}"
        own = found.setdefault(folder, {"kind": kind, "folder": folder, "symbol": unquote(symbol.partition("=")[2]), "date": unquote(date.partition("=")[2]), "files": 0})
        own["files"] += 1
    return list(found.values())


def size(spark: SparkSession, path: str, folder: str) -> int:
    """Bytes of the files of one folder."""
    _, hadoop, system = _system(spark, f"{path}/{folder}")
    return system.getContentSummary(hadoop).getLength()


def commit(spark: SparkSession, path: str, adds: Sequence[dict], removes: Sequence[dict] = (), app: str | None = None, app_batch: int | None = None) -> int | None:
    """Put one commit in place; its version, or None if that batch of ``app`` is in the table already.

    Others may commit meanwhile: what is only added goes behind them, what is to be taken away has to be there still.
    """
    while True:
        done = versions(spark, path)
        version = (done[-1] if done else 0) + 1
        if app is not None and applied(spark, path, app) >= app_batch:
            return None
        if removes:
            wanted = {(r["kind"], r["folder"]) for r in removes}
            live = folders(spark, path).filter(F.col("folder").isin(sorted(f for _, f in wanted))).select("kind", "folder").collect()
            if {tuple(r) for r in live} != wanted:
                raise Conflict(f"{len(wanted) - len(live)} of {len(wanted)} folders are no part of {path} any more")
        same = {"version": version, "at_ms": int(time.time() * 1000)}
        lines = [{"op": "remove", **r, **same} for r in removes] + [{"op": "add", **r, **same} for r in adds]
        if app is not None:
            lines.append({"op": "batch", "app": app, "app_batch": app_batch, **same})
        if _put(spark, f"{path}/_log/{version:020d}.json", lines or [{"op": "none", **same}]):
            if version % CHECKPOINT_EVERY == 0:
                checkpoint(spark, path, version)
            return version


def checkpoint(spark: SparkSession, path: str, version: int) -> None:
    """The state at ``version`` in one place, next to the commits; written by Spark, whatever its size."""
    found = entries(spark, path, version)
    live = found.filter("folder IS NOT NULL").groupBy("kind", "folder").agg(F.max_by(F.struct(*[F.col(c) for c in ("version", "op", *FOLDER[2:], "at_ms")]), "version").alias("_l")).select("kind", "folder", "_l.*")
    # Folders taken away stay named, so that ``vacuum`` knows since when.
    apps = found.filter("app IS NOT NULL").groupBy("app").agg(F.max("app_batch").alias("app_batch")).withColumns({"op": F.lit("batch"), "version": F.lit(version)})
    target = f"{path}/_log/{version:020d}.state"
    draft = f"{path}/_log/_{uuid.uuid4().hex}"
    live.unionByName(apps, allowMissingColumns=True).write.json(draft)
    _, source, system = _system(spark, draft)
    if not system.exists(_system(spark, target)[1]):
        system.rename(source, _system(spark, target)[1])


def vacuum(spark: SparkSession, path: str, kept_hours: float = KEPT_HOURS) -> int:
    """Delete day folders of batches that no commit names, or none has for ``kept_hours``; how many went.

    Folders that are in the table now stay whatever their age. Younger ones without a commit may be those of a job
    under way. Batches are gone through one by one, and only the folders of one batch are held at a time.
    """
    limit = int((time.time() - kept_hours * 3600) * 1000)
    gone = 0
    for kind in _names(spark, path):
        if kind.startswith(("_", ".")):
            continue
        for name in _names(spark, f"{path}/{kind}"):
            if not name.startswith("batch="):
                continue
            batch = name.partition("=")[2]
            prefix = f"{kind}/{name}/"
            last = {r.folder: r for r in entries(spark, path).filter(F.col("folder").startswith(prefix)).groupBy("folder").agg(F.max_by("op", "version").alias("op"), F.max("at_ms").alias("at_ms")).collect()}
            for own in written(spark, path, kind, batch):
                _, hadoop, system = _system(spark, f"{path}/{own['folder']}")
                known = last.get(own["folder"])
                since = known.at_ms if known else system.getFileStatus(hadoop).getModificationTime()
                if (known is None or known.op != "add") and since < limit:
                    system.delete(hadoop, True)
                    gone += 1
    return gone
