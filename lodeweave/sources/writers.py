"""Sinks: versioned snapshots with a manifest, idempotent imports, and publication of several tables at once.

Files are made with the file system's own exclusive create, so of two writers one wins and the other gets an error, and
no clock decides what is current. All paths may be on any file system that Spark reaches.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeweave.functions import hashing


def digest_of(rows: DataFrame) -> str:
    """A digest of a table's rows that doesn't depend on their order or files."""
    return rows.agg(hashing.content_digest(F.to_json(F.struct(*sorted(rows.columns)), {"ignoreNullFields": "false"})).alias("digest")).first()["digest"]


class _Files:
    """Small files of one folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.jvm = spark.sparkContext._jvm
        self.folder = folder.rstrip("/")
        self.fs = self._path("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}" if name else self.folder)

    def exists(self, name: str) -> bool:
        return self.fs.exists(self._path(name))

    def names(self, name: str = "") -> list[str]:
        p = self._path(name)
        return sorted(x.getPath().getName() for x in self.fs.listStatus(p)) if self.fs.exists(p) else []

    def create(self, name: str, content: dict) -> bool:
        """Write a file whole if there is none of its name; whether there was none."""
        hidden = f"{name}.{self.jvm.java.util.UUID.randomUUID()}.tmp"
        out = self.fs.create(self._path(hidden), True)
        out.write(json.dumps(content, sort_keys=True).encode())
        out.close()
        try:
            # the name is taken first, by an exclusive create; readers see it once its content has been moved there
            self.fs.create(self._path(f"{name}.claim"), False).close()
        except Exception as e:  # noqa: BLE001  what the JVM raises has one class in Python
            self.fs.delete(self._path(hidden), False)
            if "already exists" in str(e) or "FileAlreadyExists" in str(e):
                return False
            raise
        return self.fs.rename(self._path(hidden), self._path(name))

    def read(self, name: str) -> dict:
        stream = self.fs.open(self._path(name))
        try:
            return json.loads(self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def delete(self, name: str) -> None:
        self.fs.delete(self._path(name), True)


def import_snapshot(rows: DataFrame, path: str, version: str) -> str:
    """Write a version once: ``inserted``, or ``unchanged`` if it is there with the same rows; other rows are an error.

    The manifest is written last, so a version without one is an unfinished import and is written anew.
    """
    spark, digest = rows.sparkSession, digest_of(rows)
    files, manifest = _Files(spark, path), f"_manifest-{version}.json"
    if files.exists(manifest):
        if files.read(manifest)["digest"] != digest:
            raise ValueError(f"version {version} is there with other rows")
        return "unchanged"
    rows.write.mode("overwrite").parquet(f"{path}/version={version}")
    if digest_of(spark.read.parquet(f"{path}/version={version}")) != digest:
        raise ValueError("what was read back differs from what was written")
    if not files.create(manifest, {"version": version, "digest": digest}) and files.read(manifest)["digest"] != digest:
        raise ValueError(f"version {version} was written meanwhile with other rows")
    return "inserted"


def publish(rows: DataFrame, path: str, version: str) -> None:
    """Import a version and then point to it; readers see the old or the new one, never a part."""
    import_snapshot(rows, path, version)
    files = _Files(rows.sparkSession, f"{path}/_pointer")
    while True:  # numbers, not times: the next one is taken by whoever creates it first
        number = max((int(x.split(".")[0]) for x in files.names()), default=0) + 1
        if files.create(f"{number:012d}.json", {"version": version}):
            return


def current(spark: SparkSession, path: str) -> DataFrame:
    """The version that the pointer with the largest number names."""
    files = _Files(spark, f"{path}/_pointer")
    last = max(x for x in files.names() if x.endswith(".json"))
    return spark.read.parquet(f"{path}/version={files.read(last)['version']}")


def publish_all(tables: dict[str, DataFrame], root: str) -> int:
    """Publish several tables as one: the number of the publication.

    Its journal is written first (prepared), then the tables beside those of earlier publications, then a single commit
    file. Readers follow commits, so they see all tables of one publication. While one is under way, or was cut off and not
    yet seen to by ``recover``, others are refused.
    """
    spark = next(iter(tables.values())).sparkSession
    files = _Files(spark, root)
    number = max((_number(x) for x in files.names() if x.startswith("commit-") and x.endswith(".json")), default=0) + 1
    digests = {name: digest_of(rows) for name, rows in sorted(tables.items())}
    if not files.create(f"journal-{number}.json", {"number": number, "status": "prepared", "digests": digests}):
        raise RuntimeError(f"publication {number} is under way, or was cut off and needs recover()")
    for name, rows in tables.items():
        rows.write.mode("overwrite").parquet(f"{root}/{number}/{name}")
    if _written(spark, root, number, digests) != set(digests):
        raise ValueError("what was read back differs from what was written")
    if not files.create(f"commit-{number}.json", {"number": number, "digests": digests}):
        raise RuntimeError(f"publication {number} was committed by another writer")
    return number


def _written(spark: SparkSession, root: str, number: int, digests: dict[str, str]) -> set[str]:
    """The tables of a publication that are there whole."""
    files, out = _Files(spark, f"{root}/{number}"), set()
    for name, digest in digests.items():
        if files.exists(f"{name}/_SUCCESS") and digest_of(spark.read.parquet(f"{root}/{number}/{name}")) == digest:
            out.add(name)
    return out


def _number(name: str) -> int:
    return int(name.split(".")[0].split("-")[1])


def recover(spark: SparkSession, root: str) -> str:
    """What became of the last publication: ``absent`` (none was begun), ``completed``, ``rolled_back`` (cut off before its
    commit; its files are deleted now) or ``in_doubt`` (committed, but its tables differ from its journal).

    To be called when no writer is at work: one that is under way can't be told from one that was cut off.
    """
    files = _Files(spark, root)
    begun = [_number(x) for x in files.names() if x.startswith("journal-")]
    if not begun:
        return "absent"
    number = max(begun)
    if files.exists(f"commit-{number}.json"):
        digests = files.read(f"commit-{number}.json")["digests"]
        return "completed" if _written(spark, root, number, digests) == set(digests) else "in_doubt"
    for name in (str(number), *[f"{kind}-{number}.json{end}" for kind in ("journal", "commit") for end in ("", ".claim")]):
        files.delete(name)
    return "rolled_back"


def published(spark: SparkSession, root: str, name: str) -> DataFrame:
    """A table of the last committed publication."""
    numbers = [_number(x) for x in _Files(spark, root).names() if x.startswith("commit-") and x.endswith(".json")]
    return spark.read.parquet(f"{root}/{max(numbers)}/{name}")


def markdown(rows: DataFrame, title: str, most: int = 1000) -> str:
    """A report of a small table; more than ``most`` rows are an error, not a cut."""
    found = rows.limit(most + 1).collect()
    if len(found) > most:
        raise ValueError(f"a report has at most {most} rows")
    cell = lambda v: "" if v is None else str(v).replace("|", "\\|").replace("\n", " ")
    lines = [f"# {title}", "", "| " + " | ".join(rows.columns) + " |", "|" + " --- |" * len(rows.columns)]
    return "\n".join(lines + ["| " + " | ".join(cell(v) for v in r) + " |" for r in found]) + "\n"


def response(decided: DataFrame, candidates: DataFrame, most: int = 5) -> DataFrame:
    """One JSON line for each decision, with its best ``most`` candidates as debug payload, so that a line is bounded."""
    debug = candidates.where(F.col("rrf_rank") <= most).groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rrf_rank", "doc_id", "matches", "conflicts"))).alias("debug"))
    doc = F.when(F.col("status") == "matched", F.col("top_id")).alias("doc_id")
    return decided.join(debug, "query_id", "left").select("query_id", F.to_json(F.struct("query_id", "status", "reason", doc, "confidence", "debug")).alias("line"))


def write_postings(docs: DataFrame, tokens, path: str, id_col: str = "doc_id", buckets: int = 64) -> None:
    """Materialise the inverted index, dealt by token so that later joins on tokens prune files."""
    docs.select(F.col(id_col).alias("doc_id"), F.explode(F.array_distinct(tokens)).alias("token")).withColumn("bucket", F.pmod(F.xxhash64("token"), F.lit(buckets))).repartition("bucket").write.partitionBy(
        "bucket"
    ).mode("overwrite").parquet(path)


def write_embeddings(docs: DataFrame, path: str, version: str, text_col: str = "search_text", id_col: str = "doc_id") -> str:
    """Vectors with their version and the digest of the text they were made from."""
    from lodeweave.functions import exact

    rows = docs.select(F.col(id_col).alias("doc_id"), exact.embed(text_col).alias("vec"), F.sha2(text_col, 256).alias("checksum"))
    return import_snapshot(rows, path, version)
