"""A registry of data sets and models: a folder for each entry, a JSON file for each of its states.

A state is never changed. A change writes the next number under a temporary name and gives
it its own by a rename that fails where the name is taken, so that of two writers who saw
the same state one wins and the other is told. Readers take an entry's largest number; a
deleted entry's last state says so. Any store that Spark reads will do.
"""

from __future__ import annotations

import json
import os
import re
import uuid
from urllib.parse import unquote, urlparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prescriva.sources import tables

IDENTIFIER = re.compile(r"[A-Za-z0-9][A-Za-z0-9_-]{0,63}")
STATES = "id string, version long, kind string, dataset string, state string, created string, deleted boolean, data string"


class Conflict(RuntimeError):
    """Somebody else has written this version."""


def _exclusive_rename(spark: SparkSession, source: str, target: str) -> bool:
    """Give ``source`` the name ``target``; False, and nothing done, where that is taken."""
    if urlparse(source).scheme in ("", "file"):
        # A second link to the file: the one local operation that never replaces a name.
        source, target = (unquote(urlparse(p).path) for p in (source, target))
        try:
            os.link(source, target)
        except FileExistsError:
            return False
        os.unlink(source)
        return True
    return _renamed_by_context(spark, source, target)


def _renamed_by_context(spark: SparkSession, source: str, target: str) -> bool:
    from py4j.protocol import Py4JJavaError

    sc = spark.sparkContext
    jvm = sc._jvm
    kind = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
    options = sc._gateway.new_array(kind, 1)
    options[0] = kind.NONE
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(jvm.java.net.URI(source), sc._jsc.hadoopConfiguration())
    try:
        context.rename(jvm.org.apache.hadoop.fs.Path(source), jvm.org.apache.hadoop.fs.Path(target), options)
    except Py4JJavaError as e:
        if "FileAlreadyExistsException" in str(e.java_exception.getClass().getName()):
            return False
        raise
    return True


class Registry:
    """Entries of a folder; each is a few hundred bytes, so that they are written by the driver."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _fs(self, path: str):
        sc = self.spark.sparkContext
        where = sc._jvm.org.apache.hadoop.fs.Path(path)
        return where.getFileSystem(sc._jsc.hadoopConfiguration()), where

    def _put(self, row: dict) -> None:
        fs, entry = self._fs(f"{self.folder}/{row['id']}")
        fs.mkdirs(entry)
        temporary = f"{self.folder}/{row['id']}/_{uuid.uuid4().hex}"
        out = fs.create(self._fs(temporary)[1], True)
        try:
            out.write(bytearray(json.dumps(row, ensure_ascii=False).encode()))
        finally:
            out.close()
        if not _exclusive_rename(self.spark, temporary, f"{self.folder}/{row['id']}/{row['version']:08d}.json"):
            fs.delete(self._fs(temporary)[1], False)
            raise Conflict(f"version {row['version']} of {row['id']} exists")

    def create(self, name: str, kind: str, created: str, dataset: str | None = None, state: str = "new", data: dict | None = None) -> dict:
        """A new entry; a name that exists, deleted ones included, is a conflict."""
        if not IDENTIFIER.fullmatch(name):
            raise ValueError(f"{name!r} is no identifier: letters, digits, - and _, 64 at most")
        row = {"id": name, "version": 1, "kind": kind, "dataset": dataset, "state": state, "created": created, "deleted": False, "data": json.dumps(data or {}, ensure_ascii=False)}
        self._put(row)
        return row

    def versions(self) -> DataFrame:
        """All states of all entries."""
        fs, root = self._fs(self.folder)
        if not fs.exists(root) or not fs.globStatus(self._fs(f"{self.folder}/*/[0-9]*.json")[1]):
            return self.spark.createDataFrame([], STATES)
        return self.spark.read.schema(STATES).json(f"{self.folder}/*/[0-9]*.json")

    def list(self) -> DataFrame:
        """The present state of each entry that isn't deleted."""
        return latest(self.versions())

    def get(self, name: str) -> dict:
        """The present state; an unknown or deleted entry is an error."""
        if IDENTIFIER.fullmatch(name):
            fs, _ = self._fs(self.folder)
            found = fs.globStatus(self._fs(f"{self.folder}/{name}/[0-9]*.json")[1]) or []
            if found:
                row = json.loads(self.spark.read.text(str(max(f.getPath().toString() for f in found)), wholetext=True).first()[0])
                if not row["deleted"]:
                    return row
        raise KeyError(name)

    def change(self, seen: dict, **changes) -> dict:
        """The next state after ``seen``; a conflict if somebody else has changed the entry since."""
        unknown = set(changes) - {"state", "dataset", "data", "deleted"}
        if unknown:
            raise ValueError(f"can't be changed: {', '.join(sorted(unknown))}")
        if "data" in changes:
            changes["data"] = json.dumps(changes["data"], ensure_ascii=False)
        row = {**seen, **changes, "version": seen["version"] + 1}
        self._put(row)
        return row

    def delete(self, name: str) -> None:
        self.change(self.get(name), deleted=True)

    def active(self) -> DataFrame:
        """(dataset, model, created): the newest ready model of each data set."""
        return tables.active_models(self.list().where("kind = 'model'").select("dataset", F.col("id").alias("model"), "created", "state"))


def latest(versions: DataFrame) -> DataFrame:
    """Of all states (id, version, deleted, ...) each entry's last one, without entries that are deleted."""
    own = [c for c in versions.columns if c != "id"]
    last = versions.groupBy("id").agg(F.max_by(F.struct(*own), "version").alias("s"))
    return last.select("id", "s.*").where("not deleted")


def with_dataset_names(models: DataFrame, datasets: DataFrame, name: str = "name") -> DataFrame:
    """``models`` with the ``name`` of their data sets (id, name); models of data sets that are gone are left out."""
    return models.join(datasets.select(F.col("id").alias("dataset"), name), "dataset")
