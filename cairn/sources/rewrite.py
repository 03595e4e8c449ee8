"""Taking rows out of tables on disk: of all versions of a folder, only files that hold one of them are written anew."""

from __future__ import annotations

import json
import uuid
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

JOURNAL = "_erasing.json"


class Folder:
    """A folder on whatever file system its path names."""

    def __init__(self, spark: SparkSession, path: str):
        self.jvm, self.path = spark._jvm, path.rstrip("/")
        self.fs = self.at("").getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())

    def at(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def names(self) -> list[str]:
        return sorted(f.getPath().getName() for f in self.fs.listStatus(self.at("")))

    def read(self, name: str) -> str | None:
        if not self.fs.exists(self.at(name)):
            return None
        stream = self.fs.open(self.at(name))
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def write(self, name: str, text: str) -> None:
        stream = self.fs.create(self.at(name + ".tmp"), True)
        stream.write(bytearray(text.encode()))
        stream.close()
        self.fs.rename(self.at(name + ".tmp"), self.at(name))


def versions(spark: SparkSession, folder: str) -> list[str]:
    """Paths of the versions in a folder; the folder itself if it has none."""
    found = [n for n in Folder(spark, folder).names() if n.startswith("version=")]
    return [f"{folder.rstrip('/')}/{n}" for n in found] or [folder.rstrip("/")]


def _finish(spark: SparkSession, folder: Folder) -> None:
    """Puts the files that a journal names in the place of the old ones; as often as it takes."""
    journal = folder.read(JOURNAL)
    if journal is None:
        return
    plan = json.loads(journal)
    staged = Folder(spark, f"{folder.path}/{plan['staged']}")
    for old in plan["old"]:
        folder.fs.delete(folder.at(old), False)
    for name in staged.names():
        if not name.startswith("dir="):
            continue
        own, into = Folder(spark, f"{staged.path}/{name}"), unquote(name[4:])
        for f in own.names():
            if f.endswith(".parquet"):
                folder.fs.rename(own.at(f), folder.at(f if into == "." else f"{into}/{f}"))
    folder.fs.delete(staged.at(""), True)
    folder.fs.delete(folder.at(JOURNAL), False)


def erase_rows(spark: SparkSession, path: str, gone: DataFrame, column: str) -> dict:
    """Takes the rows of a Parquet folder whose column is among gone(name, as text) out of its files. Files without one keep
    their names and bytes. New files are complete before an old one goes, and a journal lets the next call end what a lost
    driver began; between the two a reader may miss rows, so hold readers of the version off. Raises if a row is left.
    Returns the path and the numbers of files written anew and of rows that went."""
    folder = Folder(spark, path)
    _finish(spark, folder)
    name = gone.select(F.col("name").cast("string").alias("_gone")).distinct()

    def rows(*files: str) -> DataFrame:
        # Partition folders stay as they are named; their columns are not read out of the names.
        return spark.read.option("recursiveFileLookup", "true").parquet(*(files or [folder.path])).select("*", F.col("_metadata.file_path").alias("_file"))

    try:
        every = rows()
    except Exception as e:  # a folder without a data file
        if "UNABLE_TO_INFER_SCHEMA" in str(e):
            return {"path": path, "files": 0, "rows": 0}
        raise
    if column not in every.columns:
        raise ValueError(f"{path} has no column {column} in its files")
    on = F.col(column).cast("string") == F.col("_gone")
    hit = every.join(name, on, "left_semi").groupBy("_file").agg(F.count("*").alias("n")).collect()  # names of files
    if not hit:
        return {"path": path, "files": 0, "rows": 0}
    root = folder.fs.makeQualified(folder.at("")).toUri().getPath().rstrip("/")

    def relative(file: str) -> str:
        return unquote(folder.jvm.java.net.URI(file).getPath())[len(root) + 1 :]

    old = [(r["_file"], relative(r["_file"])) for r in hit]
    place = F.create_map(*[F.lit(x) for f, rel in old for x in (f, rel.rpartition("/")[0] or ".")])
    kept = rows(*[f for f, _ in old]).withColumn("dir", place[F.col("_file")]).drop("_file").join(name, on, "left_anti")
    staged = f"_erasing-{uuid.uuid4().hex}"
    kept.write.partitionBy("dir").parquet(f"{folder.path}/{staged}")
    folder.write(JOURNAL, json.dumps({"staged": staged, "old": [rel for _, rel in old]}))
    _finish(spark, folder)
    if len(folder.names()) and any(n.endswith(".parquet") or "=" in n for n in folder.names()):
        spark.catalog.refreshByPath(folder.path)
        if not rows().join(name, on, "left_semi").isEmpty():
            raise RuntimeError(f"{path} still holds rows that were to go")
    return {"path": path, "files": len(old), "rows": sum(r["n"] for r in hit)}


def erase_everywhere(spark: SparkSession, folders: dict[str, list[str]], gone: dict[str, DataFrame], names: dict[str, dict[str, str]]) -> list[dict]:
    """erase_rows() for all versions and backups of tables. folders: of each table the folders that hold it; names: of each
    table its columns that name something, with the kind of thing; gone(name): of each kind what goes."""
    out = []
    for table, columns in names.items():
        for folder in folders.get(table, ()):
            for path in versions(spark, folder):
                for column, kind in columns.items():
                    out.append({"table": table, "column": column, **erase_rows(spark, path, gone[kind], column)})
    return out
