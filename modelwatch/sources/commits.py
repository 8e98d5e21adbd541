"""Numbered commits on shared storage: what readers see changes in one step, and a writer with an old view is turned away.

A commit is one small JSON file named by its number. It is written under another name and renamed; a rename never replaces a
file, so of two writers that saw the same number one wins and the other gets ``StaleVersion``. The highest number is the state.
"""

from __future__ import annotations

import json
import re
import uuid
from dataclasses import dataclass, field

from pyspark.sql import SparkSession

NAME = re.compile(r"(\d{12})\.json")


class StaleVersion(RuntimeError):
    """Another writer has committed since the expected version was read."""


@dataclass(frozen=True)
class Version:
    """A commit's number (0: nothing committed yet) and what it says."""

    number: int = 0
    state: dict = field(default_factory=dict)


def _at(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark._jsc.hadoopConfiguration())


def _numbers(spark: SparkSession, root: str) -> list[int]:
    folder, fs = _at(spark, f"{root}/commits")
    if not fs.exists(folder):
        return []
    return sorted(int(m[1]) for s in fs.listStatus(folder) if (m := NAME.fullmatch(s.getPath().getName())))


def _file(root: str, number: int) -> str:
    return f"{root}/commits/{number:012d}.json"


def version(spark: SparkSession, root: str, number: int) -> Version:
    """The commit of a given number."""
    return Version(number, json.loads(spark.read.text(_file(root, number), wholetext=True).first()[0]))


def latest(spark: SparkSession, root: str) -> Version:
    """The newest commit; number 0 and an empty state where there is none."""
    numbers = _numbers(spark, root)
    return version(spark, root, numbers[-1]) if numbers else Version()


def commit(spark: SparkSession, root: str, expected: Version, state: dict) -> Version:
    """Publish ``state`` as the successor of ``expected``; raises ``StaleVersion`` if there is one already, and changes nothing."""
    if (newest := _numbers(spark, root)[-1:]) and newest[0] != expected.number:
        raise StaleVersion(f"{root} is at {newest[0]}, expected {expected.number}")
    made = Version(expected.number + 1, state)
    draft, fs = _at(spark, f"{root}/commits/.draft-{uuid.uuid4().hex}")
    target, _ = _at(spark, _file(root, made.number))
    out = fs.create(draft, False)
    out.write(bytearray(json.dumps(state, sort_keys=True).encode()))
    out.close()
    jvm = spark._jvm
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark._jsc.hadoopConfiguration())
    try:
        context.rename(draft, target, spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0))
    except Exception as error:
        fs.delete(draft, False)
        if fs.exists(target):
            raise StaleVersion(f"{root} has got version {made.number} meanwhile") from error
        raise
    return made


def delete(spark: SparkSession, path: str) -> None:
    """Remove a folder or file below shared storage."""
    where, fs = _at(spark, path)
    fs.delete(where, True)


def forget(spark: SparkSession, root: str, keep: int) -> tuple[list[Version], list[Version]]:
    """Delete all commits but the newest ``keep``; returns those that went and those that are left, oldest first."""
    versions = [version(spark, root, n) for n in _numbers(spark, root)]
    for old in versions[:-keep]:
        delete(spark, _file(root, old.number))
    return versions[:-keep], versions[-keep:]


def folders(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder; none where it does not exist."""
    where, fs = _at(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(where)) if fs.exists(where) else []
