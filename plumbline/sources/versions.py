"""Tables in versions: a commit writes data first and a manifest last, and nothing that was committed ever changes.

    data/<id>/        rows of one commit, as Parquet
    ledger/<id>/      what the commit did, as Parquet
    manifests/<n>.json    version n: its parent, its data, its ledger; claimed by <n>.claim, and by <parent>.next

Only manifests say what exists, so a commit that fails on its way leaves files nobody reads and the versions before it as they
were. A writer claims its number by creating a file that must not exist; a number that failed stays unused. The right to follow
a version is claimed alike, in the moment before the manifest gets its name: of two commits made from one version, one is
refused. (A driver lost between these two steps leaves ``<parent>.next`` without a manifest; that file then has to be removed.)
Readers name a version or take the last one when they start; what they read can't change under them. Undoing is a commit too:
a new manifest that points to the data of an older version, without writing rows.
"""

from __future__ import annotations

import datetime as dt
import json
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import Refused
from .results import snapshot

VERSIONS = "version long, parent long, kind string, note string, at string, rows long, fingerprint string, data string, ledger string"


def _folder(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(f"{path}/manifests")
    return jvm, place, place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _numbers(spark: SparkSession, path: str, ending: str) -> list[int]:
    _, place, fs = _folder(spark, path)
    if not fs.exists(place):
        return []
    names = [status.getPath().getName() for status in fs.listStatus(place)]
    return sorted(int(n.removesuffix(ending)) for n in names if n.endswith(ending))


def _create(spark: SparkSession, path: str, name: str, else_: str) -> None:
    """A file that only one writer can create."""
    jvm, place, fs = _folder(spark, path)
    try:
        fs.create(jvm.org.apache.hadoop.fs.Path(place, name), False).close()
    except Py4JJavaError as taken:
        if "FileAlreadyExists" not in str(taken.java_exception):
            raise
        raise Refused("VERSION_TAKEN", else_) from taken


def _claim(spark: SparkSession, path: str) -> int:
    """The next number."""
    number = max([*_numbers(spark, path, ".claim"), *_numbers(spark, path, ".json"), 0]) + 1
    _create(spark, path, f"{number}.claim", f"another writer is committing version {number} of {path}")
    return number


def _publish(spark: SparkSession, path: str, manifest: dict) -> int:
    """The manifest under its final name, at once and whole."""
    jvm, place, fs = _folder(spark, path)
    parent = manifest["parent"]
    _create(spark, path, f"{parent}.next", f"another version of {path} follows version {parent}")
    part = jvm.org.apache.hadoop.fs.Path(place, f"{manifest['version']}.part")
    out = fs.create(part, True)
    out.write(bytearray(json.dumps(manifest).encode()))
    out.close()
    if not fs.rename(part, jvm.org.apache.hadoop.fs.Path(place, f"{manifest['version']}.json")):
        raise Refused("NOT_PUBLISHED", f"version {manifest['version']} of {path}")
    return manifest["version"]


def manifest(spark: SparkSession, path: str, version: int | None = None) -> dict:
    """What a version consists of; the last one unless given."""
    there = _numbers(spark, path, ".json")
    if not there or (version is not None and version not in there):
        raise Refused("NO_SUCH_VERSION", f"{path} has versions {there}")
    text = spark.read.option("wholetext", "true").text(f"{path}/manifests/{version or there[-1]}.json").first()[0]
    return json.loads(text)


def versions(spark: SparkSession, path: str) -> DataFrame:
    """One row per committed version."""
    if not _numbers(spark, path, ".json"):
        return spark.createDataFrame([], VERSIONS)
    return spark.read.schema(VERSIONS).json(f"{path}/manifests/*.json")


def read(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """A version's rows; the last one unless given."""
    held = manifest(spark, path, version)
    return spark.read.schema(T.StructType.fromJson(held["schema"])).parquet(f"{path}/{held['data']}")


def commit(df: DataFrame, path: str, kind: str = "write", note: str = "", ledger: DataFrame | None = None, parent: int | None = None) -> int:
    """``df`` as the next version of the table at ``path``; returns its number.

    ``parent``: the version that ``df`` was made from (the last one unless given). If another commit has followed it since,
    this one is refused.
    """
    spark = df.sparkSession
    parent = max([*_numbers(spark, path, ".json"), 0]) if parent is None else parent
    number = _claim(spark, path)
    data = f"data/{uuid.uuid4().hex}"
    df.write.mode("errorifexists").parquet(f"{path}/{data}")
    written = spark.read.schema(df.schema).parquet(f"{path}/{data}")
    kept = snapshot(written).first()
    log = None
    if ledger is not None:
        log = f"ledger/{uuid.uuid4().hex}"
        ledger.write.mode("errorifexists").parquet(f"{path}/{log}")
    return _publish(spark, path, {
        "version": number, "parent": parent, "kind": kind, "note": note, "at": dt.datetime.now(dt.UTC).isoformat(timespec="seconds"),
        "rows": kept["rows"], "fingerprint": str(kept["fingerprint"]), "data": data, "ledger": log, "schema": written.schema.jsonValue()})


def undo(spark: SparkSession, path: str, to: int | None = None) -> int:
    """A new version with the rows of version ``to`` (the last one's parent unless given); no rows are written."""
    last = manifest(spark, path)
    back = last["parent"] if to is None else to
    if not back:
        raise Refused("NOTHING_TO_UNDO", f"version {last['version']} of {path} has no parent")
    old = manifest(spark, path, back)
    number = _claim(spark, path)
    return _publish(spark, path, {**old, "version": number, "parent": last["version"], "kind": "undo", "note": f"back to {back}",
                                  "at": dt.datetime.now(dt.UTC).isoformat(timespec="seconds"), "ledger": None})


def ledgers(spark: SparkSession, path: str) -> DataFrame | None:
    """All commits' ledger rows with their ``version``; those of failed commits aren't among them."""
    held = [m for m in (manifest(spark, path, n) for n in _numbers(spark, path, ".json")) if m["ledger"]]
    out = None
    for m in held:  # one folder per version
        rows = spark.read.parquet(f"{path}/{m['ledger']}").withColumn("version", F.lit(m["version"]).cast("long"))
        out = rows if out is None else out.unionByName(rows, allowMissingColumns=True)
    return out
