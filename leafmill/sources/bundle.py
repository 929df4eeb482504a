"""The bundle of a finished session: written by tasks, published at once, and only then the tenant's data go.

Tasks write files of their own below a staging folder of the attempt.  The commit moves what the successful tasks wrote into the
bundle and then puts the manifest in place by one rename: readers go by the manifest, so they see the bundle before or after,
never a part of it.  A failed job removes its staging folder and leaves what was there; what a task writes after that, as
tasks end by themselves, goes with a later bundle once it is a day old.
"""

from __future__ import annotations

import gzip
import json
import posixpath
import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from leafmill.functions.plan import remove_folder, shared_folder, written

MANIFEST, DAY = "manifest.json", 86_400
#: Rows of a bundle: which of its parts, under which name there, and what it holds.
SCHEMA = "part string, name string, body binary"


def _fs(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


@dataclass
class Written(WriterCommitMessage):
    files: list[tuple[str, str, int]]


class BundleWriter(DataSourceWriter):
    def __init__(self, options: dict):
        self.path, self.job = options["path"].rstrip("/"), uuid.uuid4().hex

    def _staging(self, root: str) -> str:
        return f"{root}/_staging_{self.job}"

    def write(self, iterator) -> Written:
        """One file for each part of the bundle and task; an attempt that is repeated writes other files."""
        fs, root = _fs(self.path)
        context = TaskContext.get()
        own = f"{context.partitionId():05d}-{context.taskAttemptId()}"
        streams, files, opened = {}, {}, []
        try:
            for part, name, body in iterator:
                if part not in streams:
                    where = f"{part}/{own}.jsonl.gz"
                    fs.create_dir(posixpath.dirname(f"{self._staging(root)}/{where}"), recursive=True)
                    opened.append(fs.open_output_stream(f"{self._staging(root)}/{where}", compression=None))
                    streams[part], files[part] = gzip.GzipFile(fileobj=opened[-1], mode="wb", compresslevel=1, mtime=0), [part, where, 0]
                streams[part].write((json.dumps({"name": name, "body": bytes(body or b"").hex() if part == "bytes" else bytes(body or b"").decode()}) + "\n").encode())
                files[part][2] += 1
        finally:
            for s in (*streams.values(), *opened):
                s.close()
        return Written([tuple(f) for f in files.values()])

    def commit(self, messages) -> None:
        fs, root = _fs(self.path)
        before = read_manifest(self.path)
        files = []
        for part, where, n in (f for m in messages if m is not None for f in m.files):
            at = f"{part}/{self.job}-{posixpath.basename(where)}"
            fs.create_dir(posixpath.dirname(f"{root}/{at}"), recursive=True)
            fs.move(f"{self._staging(root)}/{where}", f"{root}/{at}")
            files.append({"part": part, "file": at, "rows": n})
        new = f"{root}/_{self.job}.json"
        fs.create_dir(root, recursive=True)
        with fs.open_output_stream(new) as out:
            out.write(json.dumps({"files": sorted(files, key=lambda f: f["file"])}).encode())
        fs.move(new, f"{root}/{MANIFEST}")
        for old in before["files"]:
            fs.delete_file(f"{root}/{old['file']}")
        self._clear(fs, root)
        self._clear_old(fs, root)

    def abort(self, messages) -> None:
        fs, root = _fs(self.path)
        self._clear(fs, root)

    def _clear(self, fs, root: str) -> None:
        from pyarrow.fs import FileType

        if fs.get_file_info(self._staging(root)).type != FileType.NotFound:
            fs.delete_dir(self._staging(root))


    def _clear_old(self, fs, root: str) -> None:
        from pyarrow.fs import FileSelector

        for f in fs.get_file_info(FileSelector(root)):
            if f.base_name.startswith("_staging_") and f.mtime is not None and time.time() - f.mtime.timestamp() > DAY:
                fs.delete_dir(f.path)


class BundleSink(DataSource):
    @classmethod
    def name(cls) -> str:
        return "leafmill_bundle"

    def schema(self) -> str:
        return SCHEMA

    def writer(self, schema, overwrite: bool) -> BundleWriter:
        return BundleWriter(self.options)


def read_manifest(path: str) -> dict:
    """Files of the published bundle, with their part and rows; none where there is no bundle."""
    from pyarrow.fs import FileType

    fs, root = _fs(path.rstrip("/"))
    if fs.get_file_info(f"{root}/{MANIFEST}").type == FileType.NotFound:
        return {"files": []}
    with fs.open_input_stream(f"{root}/{MANIFEST}") as f:
        return json.loads(f.read())


def read_bundle(spark: SparkSession, path: str, part: str) -> DataFrame:
    """(name, body) of a part of the published bundle; the body of ``bytes`` is binary."""
    files = [f"{path.rstrip('/')}/{f['file']}" for f in read_manifest(path)["files"] if f["part"] == part]
    rows = spark.read.schema("name string, body string").json(files) if files else spark.createDataFrame([], "name string, body string")
    return rows.withColumn("body", F.unhex("body")) if part == "bytes" else rows


def store_bytes(files: DataFrame, path: str) -> None:
    """Contents (workspace_id, id, content) by tenant and the first two digits of their id, so that a lookup reads one small folder."""
    files.select("workspace_id", F.substring("id", 1, 2).alias("shard"), "id", "content").write.mode("append").partitionBy("workspace_id", "shard").parquet(path)


def load_bytes(spark: SparkSession, path: str, workspace: str, ids: list[str]) -> DataFrame:
    """(id, content) of some of a tenant's files, each once."""
    rows = spark.read.schema("id string, content binary, workspace_id string, shard string").parquet(path)
    wanted = rows.filter((F.col("workspace_id") == workspace) & F.col("shard").isin(*{i[:2] for i in ids}) & F.col("id").isin(*ids))
    return wanted.groupBy("id").agg(F.first("content").alias("content"))


def bundle_rows(tables: dict[str, DataFrame], workspace: str, contents: DataFrame | None = None, lines_of: Callable[[DataFrame], DataFrame] | None = None, step: Callable[[str, DataFrame], DataFrame] = lambda name, df: df) -> DataFrame:
    """Rows of a tenant's bundle: its invoices as JSON, its sheets row by row, and its files' bytes.

    ``lines_of`` gives the line items of some invoices (invoice_id), which otherwise are picked from all; ``step`` may write
    a table of that name that later ones need.
    """
    from leafmill.operators.reports import export_invoices, export_json, export_lines, tenant

    own = step("own", tenant(tables["invoices"], workspace))
    ids = own.select(F.col("id").alias("invoice_id"))
    lines = lines_of(ids) if lines_of else tables["line_items"].join(ids, "invoice_id", "left_semi")
    sheet = lambda df, part: df.select(F.lit(part).alias("part"), F.xxhash64(*df.columns).cast("string").alias("name"), F.to_json(F.struct(*df.columns)).cast("binary").alias("body"))
    rows = step("sheet", sheet(export_invoices(own, tables["documents"], tables["vendors"]), "invoices"))
    rows = rows.union(export_json(own, lines).select(F.lit("json").alias("part"), F.lit("invoice").alias("name"), F.col("json").cast("binary").alias("body")))
    rows = rows.union(sheet(export_lines(own, tables["vendors"], lines), "lines"))
    if contents is not None:
        rows = rows.union(contents.filter(F.col("workspace_id") == workspace).select(F.lit("bytes").alias("part"), F.concat_ws("/", "workspace_id", "id").alias("name"), F.col("content").alias("body")))
    return rows


def finish_session(tables: dict[str, DataFrame], path: str, workspace: str, contents: DataFrame | None = None, lines_of: Callable[[DataFrame], DataFrame] | None = None) -> dict[str, DataFrame]:
    """Publish a tenant's bundle, then give the tables without the tenant; a failure raises and nothing is purged.

    The tenant's invoices and their sheet are written on the way, so that the disk holds the shuffle files of one step at a time.
    """
    from leafmill.operators.state import purge

    spark = tables["invoices"].sparkSession
    spark.dataSource.register(BundleSink)
    folder = shared_folder(spark, "session")
    try:
        rows = bundle_rows(tables, workspace, contents, lines_of, lambda name, df: written(df, f"{folder}/{name}"))
        rows.write.format("leafmill_bundle").mode("append").option("path", path).save()
    finally:
        remove_folder(spark, folder)
    return purge(tables, spark.createDataFrame([(workspace,)], "workspace_id string"))
