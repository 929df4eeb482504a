"""Documents from files: scan, guard, identify, classify and read the text."""

from __future__ import annotations

import email
import email.policy
import html
import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.operators.schemas import ERROR, PAGE
from leafmill.sources.bundle import _fs

# Fixed values.
ALLOWED_TYPES = ("application/pdf", "image/png", "image/jpeg", "image/jpg", "image/tiff", "image/x-tiff", "message/rfc822", "application/vnd.ms-outlook", "text/html", "text/plain")
EXTENSIONS = {"pdf": "application/pdf", "png": "image/png", "jpg": "image/jpeg", "jpeg": "image/jpeg", "tif": "image/tiff", "tiff": "image/tiff", "eml": "message/rfc822", "msg": "application/vnd.ms-outlook", "html": "text/html", "htm": "text/html", "txt": "text/plain"}
MAX_BYTES = 25 * 1024 * 1024
CHARS_PER_PAGE = 50


def content_id(content: Column, workspace: Column) -> Column:
    """Hash of the bytes, salted by the tenant."""
    return F.sha2(F.concat(content, F.encode(workspace, "UTF-8")), 256)


def mime_type(path: Column, given: Column | None = None) -> Column:
    known = F.create_map(*[F.lit(x) for kv in EXTENSIONS.items() for x in kv])
    guess = F.try_element_at(known, F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1)))
    return F.coalesce(*([] if given is None else [F.nullif(given, F.lit(""))]), guess, F.lit("application/octet-stream"))


def classify_mime(mime: Column) -> Column:
    """Document type by MIME type; a PDF's is settled by ``classify_pages``."""
    return (
        F.when(mime.isin("image/png", "image/jpeg", "image/jpg", "image/tiff", "image/x-tiff"), "image")
        .when(mime.isin("message/rfc822", "application/vnd.ms-outlook"), "email")
        .when(mime.isin("text/html", "text/plain"), "text_pdf")
        .when(mime == "application/pdf", "pdf")
        .otherwise("unknown")
    )


def classify_pages(pages: Column) -> Column:
    """text_pdf from 50 characters a page on average, else scanned_pdf; no pages are a scan."""
    total = F.aggregate(pages, F.lit(0), lambda s, p: s + F.length(F.coalesce(p["text"], F.lit(""))))
    return F.when((F.size(pages) > 0) & (total >= CHARS_PER_PAGE * F.size(pages)), "text_pdf").otherwise("scanned_pdf")


def put_files(files: DataFrame, path: str, each: int = 250) -> None:
    """Write (name, content) as files below ``path``, in folders of about ``each``, a task a folder or a few.

    Names are told apart by the caller; a file that is written again, by a task that is repeated, replaces itself.
    """
    folders = max(1, -(-files.count() // each))

    def put(rows: Iterator) -> None:
        fs, root = _fs(path)
        made = set()
        for folder, name, content in rows:
            if folder not in made:
                fs.create_dir(f"{root}/{folder}", recursive=True)
                made.add(folder)
            with fs.open_output_stream(f"{root}/{folder}/{name}") as out:
                out.write(bytes(content or b""))

    folder = F.pmod(F.xxhash64("name"), F.lit(folders)).alias("folder")
    files.select(folder, "name", F.col("content").cast("binary").alias("content")).repartition(folders, "folder").foreachPartition(put)


def scan(spark: SparkSession, path: str, workspace: str, glob: str | None = None) -> DataFrame:
    """Files below ``path`` with their tenant, type and content id; ``status`` is processing, rejected or skipped."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    df = reader.load(path).withColumn("workspace_id", F.lit(workspace)).withColumn("mime_type", mime_type(F.col("path")))
    status = F.when(~F.col("mime_type").isin(*ALLOWED_TYPES), "rejected").when(F.col("length") > MAX_BYTES, "skipped").otherwise("processing")
    return df.select("path", F.element_at(F.split("path", "/"), -1).alias("filename"), "modificationTime", "length", "content", "workspace_id", "mime_type", content_id(F.col("content"), F.col("workspace_id")).alias("id"), classify_mime(F.col("mime_type")).alias("document_type"), status.alias("status"))


def first_arrivals(files: DataFrame) -> DataFrame:
    """One row for each content id: the earliest file."""
    cols = [c for c in files.columns if c != "id"]
    return files.groupBy("id").agg(F.min_by(F.struct(*cols), F.struct("modificationTime", "path")).alias("f")).select("id", "f.*")


def unseen(files: DataFrame, documents: DataFrame, force: bool = False) -> DataFrame:
    """Files that are not there already as complete documents without errors."""
    if force:
        return files
    done = documents.filter((F.col("status") == "complete") & (F.size(F.coalesce("errors", F.array())) <= 0)).select("id")
    return files.join(done, "id", "left_anti")


def email_text(content: bytes) -> str:
    """Subject line, then every text part; HTML parts without their tags."""
    message = email.message_from_bytes(content, policy=email.policy.default)
    parts = [f"Subject: {message['subject']}"] if message["subject"] else []
    for part in message.walk():
        kind = part.get_content_type()
        if part.get_content_disposition() == "attachment" or kind not in ("text/plain", "text/html"):
            continue
        body = part.get_payload(decode=True) or b""
        text = body.decode(part.get_content_charset() or "utf-8", "replace")
        parts.append(html.unescape(re.sub("<[^>]+>", " ", text)) if kind == "text/html" else text)
    return "\n".join(parts)


Reader = Callable[[bytes, str], list[dict]]


def read_pages(files: DataFrame, readers: dict[str, Reader] | None = None) -> DataFrame:
    """Adds ``pages``, ``raw_text`` and ``errors``.

    Mails and text are read here.  PDF and image readers are given in ``readers`` by document type; each
    takes the bytes and the MIME type and returns pages (text, words).  A reader that fails leaves an error.
    """
    readers = readers or {}

    def plain(content: bytes, mime: str) -> list[dict]:
        text = content.decode("utf-8", "replace")
        return [{"text": html.unescape(re.sub("<[^>]+>", " ", text)) if mime == "text/html" else text}]

    own: dict[str, Reader] = {"email": lambda c, m: [{"text": email_text(c)}], "text_pdf": plain, "unknown": plain, **readers}

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            pages, errors = [], []
            for content, mime, kind in zip(b["content"], b["mime_type"], b["document_type"]):
                found, wrong = [], []
                try:
                    if kind in own:
                        found = own[kind](bytes(content), mime)
                    else:
                        wrong = [{"stage": "text_extract", "message": f"no reader for {kind}", "detail": None, "fatal": True}]
                except Exception as e:  # a broken file is a row with an error
                    wrong = [{"stage": "text_extract", "message": str(e), "detail": type(e).__name__, "fatal": True}]
                pages.append([{"page_num": i, "text": p.get("text", ""), "words": p.get("words", [])} for i, p in enumerate(found)])
                errors.append(wrong)
            yield pd.DataFrame({"id": b["id"], "pages": pages, "errors": errors})

    text = files.select("id", "content", "mime_type", "document_type").mapInPandas(read, f"id string, pages array<{PAGE}>, errors array<{ERROR}>")
    return files.drop("content").join(text, "id").withColumn("raw_text", F.array_join(F.transform("pages", lambda p: p["text"]), "\n\n"))


def cascade(*engines: Reader, accept: float = 0.4) -> Reader:
    """A reader that tries engines in turn; a page stands if its words' mean confidence reaches ``accept`` or no engine is left."""

    def read(content: bytes, mime: str) -> list[dict]:
        for i, engine in enumerate(engines):
            last = i == len(engines) - 1
            try:
                pages = engine(content, mime)
            except Exception:
                if last:
                    raise
                continue
            scores = [w["confidence"] for p in pages for w in p.get("words", [])]
            if last or (scores and sum(scores) / len(scores) >= accept):
                return pages
        return []

    return read
