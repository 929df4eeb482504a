"""Mails as a Spark data source, for batches and streams: attachments of a mailbox as rows.

A mailbox numbers its mails in the order of arrival (UIDs).  A stream's offset is the highest number that it has read, kept in the
query's checkpoint, so a restart reads nothing twice.  The driver asks for numbers only; mails are fetched by the tasks, some
at a time, each with a connection of its own.
"""

from __future__ import annotations

import email
import email.policy
import hashlib
import importlib
from collections.abc import Iterator
from typing import Protocol

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

# Fixed values.
PRESETS = {"gmail": ("imap.gmail.com", 993), "outlook": ("outlook.office365.com", 993)}
ATTACHMENT_TYPES = ("application/pdf", "image/png", "image/jpeg", "image/tiff", "text/html", "text/plain")
SCHEMA = "uid long, place int, message_id string, subject string, sender string, filename string, mime_type string, content binary, attachment_hash string"


def attachments(raw: bytes) -> Iterator[tuple]:
    """Attachments of the accepted types; one without a name is named by its hash."""
    m = email.message_from_bytes(raw, policy=email.policy.default)
    for part in m.iter_attachments():
        kind, content = part.get_content_type(), part.get_payload(decode=True) or b""
        if kind in ATTACHMENT_TYPES and content:
            digest = hashlib.sha256(content).hexdigest()
            yield str(m["message-id"] or ""), str(m["subject"] or ""), str(m["from"] or ""), part.get_filename() or f"attachment_{digest[:8]}", kind, content, digest


class Mailbox(Protocol):
    def numbers(self, after: int, unseen: bool) -> list[int]: ...

    def fetch(self, uid: int) -> bytes: ...

    def close(self) -> None: ...


class ImapBox:
    """A folder of an IMAP server, opened read-only."""

    def __init__(self, options: dict):
        import imaplib

        host, port = PRESETS.get(options.get("preset", ""), (options.get("host"), int(options.get("port", 993))))
        self.box = imaplib.IMAP4_SSL(host, port)
        self.box.login(options.get("user"), options.get("password"))
        self.box.select(options.get("folder", "INBOX"), readonly=True)

    def numbers(self, after: int, unseen: bool) -> list[int]:
        asked = [f"UID {after + 1}:*", *(["UNSEEN"] if unseen else [])]
        found = self.box.uid("SEARCH", None, *asked)[1][0] or b""
        # The server answers with its last mail where none is newer.
        return sorted(n for n in map(int, found.split()) if n > after)

    def fetch(self, uid: int) -> bytes:
        return self.box.uid("FETCH", str(uid), "(RFC822)")[1][0][1]

    def close(self) -> None:
        self.box.logout()


def open_box(options: dict) -> Mailbox:
    """The mailbox of the options: ``box`` names another kind than IMAP as ``module:class``."""
    if options.get("enabled", "false").lower() != "true":
        raise ValueError("the mail source is off; set the option enabled to true")
    module, _, name = options.get("box", "").partition(":")
    return (getattr(importlib.import_module(module), name) if module else ImapBox)(options)


class MailPartition(InputPartition):
    def __init__(self, numbers: list[int]):
        self.numbers = numbers


def _dealt(numbers: list[int], options: dict) -> list[MailPartition]:
    each = int(options.get("batch", 20))
    return [MailPartition(numbers[i : i + each]) for i in range(0, len(numbers), each)]


def _read(partition: MailPartition, options: dict) -> Iterator[tuple]:
    box = open_box(options)
    try:
        for uid in partition.numbers:
            for place, row in enumerate(attachments(box.fetch(uid))):
                yield uid, place, *row
    finally:
        box.close()


class MailReader(DataSourceReader):
    """Unseen mails, in groups of ``batch`` a task."""

    def __init__(self, options: dict):
        self.options = dict(options)

    def partitions(self):
        box = open_box(self.options)
        try:
            return _dealt(box.numbers(0, True), self.options)
        finally:
            box.close()

    def read(self, partition):
        return _read(partition, self.options)


class MailStream(DataSourceStreamReader):
    """Mails by number, ``max_mails`` a micro-batch at most; the offset is the last number read."""

    def __init__(self, options: dict):
        self.options, self.known = dict(options), int(options.get("after", 0))

    def _numbers(self, after: int) -> list[int]:
        box = open_box(self.options)
        try:
            return box.numbers(after, False)
        finally:
            box.close()

    def initialOffset(self) -> dict:
        return {"uid": int(self.options.get("after", 0))}

    def latestOffset(self) -> dict:
        waiting = self._numbers(self.known)[: int(self.options.get("max_mails", 1000))]
        self.known = waiting[-1] if waiting else self.known
        return {"uid": self.known}

    def partitions(self, start: dict, end: dict):
        self.known = max(self.known, end["uid"])
        return _dealt([n for n in self._numbers(start["uid"]) if n <= end["uid"]], self.options)

    def read(self, partition):
        return _read(partition, self.options)

    def commit(self, end: dict) -> None:
        """Mails stay as they are; what was read is in the query's checkpoint."""


class MailSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "leafmill_mail"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> MailReader:
        return MailReader(self.options)

    def streamReader(self, schema) -> MailStream:
        return MailStream(self.options)


def each_once(mails: DataFrame) -> DataFrame:
    """Each content once: the first attachment that holds it.  Of a stream, for each micro-batch."""
    rest = [c for c in mails.columns if c != "attachment_hash"]
    first = mails.groupBy("attachment_hash").agg(F.min_by(F.struct(*rest), F.struct("uid", "place")).alias("a"))
    return first.select(*[F.col("a")[c].alias(c) for c in rest], "attachment_hash")


def unseen_attachments(spark: SparkSession, **options) -> DataFrame:
    """Attachments of unseen mails, each content once."""
    spark.dataSource.register(MailSource)
    return each_once(spark.read.format("leafmill_mail").options(**options).load())


def attachment_stream(spark: SparkSession, **options) -> DataFrame:
    """Attachments as mails arrive."""
    spark.dataSource.register(MailSource)
    return spark.readStream.format("leafmill_mail").options(**options).load()
