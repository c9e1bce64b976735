"""Tables by key that several jobs add to: the best row of each key, in hash buckets of which only those touched are rewritten.

``path/data`` holds the buckets' files, each write in a folder of its own that nobody changes later; ``path/manifests`` holds one
small file a version, which names the folder of each bucket. A writer merges the buckets that its rows fall into, writes them
aside and then puts the next version's manifest in place by a rename that fails where that version is there already. It then
looks again: buckets that nobody else has touched are kept as they are, others are merged anew. So a reader sees a whole
version, a writer that dies leaves nothing that anyone reads, and no row is lost between writers. The rename is atomic
on HDFS and on stores with a conditional put."""

from __future__ import annotations

import json
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factledger.sources.scratch import discard, stored

BUCKETS = 64
TRIES = 50


class _Folder:
    """What a store needs of the file system that its path is in."""

    def __init__(self, spark: SparkSession, path: str):
        self.jvm, self.conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        self.hadoop, self.path = self.jvm.org.apache.hadoop.fs, path
        self.files = self.at("").getFileSystem(self.conf)

    def at(self, name: str):
        return self.hadoop.Path(f"{self.path}/{name}" if name else self.path)

    def names(self, folder: str) -> list[str]:
        place = self.at(folder)
        return sorted(x.getPath().getName() for x in self.files.listStatus(place)) if self.files.exists(place) else []

    def read(self, name: str) -> str:
        opened = self.files.open(self.at(name))
        try:
            return bytes(opened.readAllBytes()).decode()
        finally:
            opened.close()

    def put(self, name: str, text: str) -> bool:
        """Whether the file could be put there; false where one of that name is there."""
        aside = self.at(f"making-{uuid.uuid4().hex}")
        out = self.files.create(aside, False)
        out.write(bytearray(text.encode()))
        out.close()
        self.files.mkdirs(self.at(name).getParent())
        options = self.jvm.java.lang.reflect.Array.newInstance(getattr(self.hadoop, "Options$Rename")._java_lang_class, 1)
        options[0] = getattr(self.hadoop, "Options$Rename").NONE
        context = self.hadoop.FileContext.getFileContext(self.files.makeQualified(self.at("")).toUri(), self.conf)
        try:
            context.rename(self.files.makeQualified(aside), self.files.makeQualified(self.at(name)), options)
        except Py4JJavaError as error:
            self.files.delete(aside, False)
            if "FileAlreadyExists" not in error.java_exception.getClass().getName():
                raise
            return False
        return True


def _version(name: str) -> int:
    return int(name.split(".")[0])


def _manifests(folder: _Folder) -> list[str]:
    return [x for x in folder.names("manifests") if x.endswith(".json")]


def _current(folder: _Folder) -> tuple[int, dict]:
    names = _manifests(folder)
    return (_version(names[-1]), json.loads(folder.read(f"manifests/{names[-1]}"))) if names else (0, {"buckets": 0, "folders": {}})


def read_store(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The rows of the newest version; none where there is no store."""
    folders = list(_current(_Folder(spark, path))[1]["folders"].values())
    return spark.read.schema(schema).parquet(*[f"{path}/{x}" for x in folders]) if folders else spark.createDataFrame([], schema)


def upsert(rows: DataFrame, path: str, key: str, best: list[Column], buckets: int = BUCKETS) -> int:
    """Adds the rows: of all rows of a key, those in the store included, the one stays whose ``best`` is greatest in their order
    (null is least; ties: the greatest row as text). Since that hangs on the rows alone, the order of writers doesn't matter. Rows without key
    are left out. Returns the version; the number of buckets is that of the first version."""
    spark, schema = rows.sparkSession, rows.schema
    folder = _Folder(spark, path)
    version, manifest = _current(folder)
    count = manifest["buckets"] or buckets
    rank = F.struct(*best, F.to_json(F.struct(*rows.columns)))
    bucketed = lambda df: df.withColumn("__bucket", F.pmod(F.xxhash64(F.col(key).cast("string")), F.lit(count)))
    one = lambda df: df.groupBy("__bucket", key).agg(F.max_by(F.struct(*rows.columns), rank).alias("x")).select("__bucket", "x.*")
    new = stored(one(bucketed(rows.where(F.col(key).isNotNull()))), "upsert")
    touched = [str(r[0]) for r in new.select("__bucket").distinct().collect()]  # at most the number of buckets
    try:
        if not touched:
            return version
        made, base = None, None
        for _ in range(TRIES):
            old = {b: manifest["folders"][b] for b in touched if b in manifest["folders"]}
            if made is None or old != base:
                base, made = old, f"data/{uuid.uuid4().hex}"
                kept = bucketed(spark.read.schema(schema).parquet(*[f"{path}/{x}" for x in old.values()])) if old else None
                merged = new if kept is None else one(kept.unionByName(new))
                merged.repartition(count, "__bucket").write.partitionBy("__bucket").parquet(f"{path}/{made}")
            folders = {**manifest["folders"], **{b: f"{made}/__bucket={b}" for b in touched}}
            if folder.put(f"manifests/{version + 1:012d}.json", json.dumps({"buckets": count, "folders": folders}, sort_keys=True)):
                return version + 1
            version, manifest = _current(folder)
            if manifest["buckets"] != count:
                return upsert(rows, path, key, best, buckets)
        raise RuntimeError(f"{path}: other writers were first {TRIES} times")
    finally:
        discard(new)


def vacuum(spark: SparkSession, path: str, keep: int = 2) -> int:
    """Removes what none of the newest ``keep`` versions names, and returns how many folders went. Nobody may write meanwhile,
    and readers of older versions must be done."""
    folder = _Folder(spark, path)
    names = _manifests(folder)
    used = {x for name in names[-keep:] for x in json.loads(folder.read(f"manifests/{name}"))["folders"].values()}
    for name in names[:-keep]:
        folder.files.delete(folder.at(f"manifests/{name}"), False)
    gone = [f"data/{made}/{b}" for made in folder.names("data") for b in folder.names(f"data/{made}") if b.startswith("__bucket=") and f"data/{made}/{b}" not in used]
    for name in gone:
        folder.files.delete(folder.at(name), True)
    return len(gone)
