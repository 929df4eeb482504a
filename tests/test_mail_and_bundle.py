"""Mail as a stream with offsets; the two-phase bundle."""

import json
import os
from email.message import EmailMessage

import pytest
from pyspark.sql import functions as F


def put(folder, uid, *contents):
    m = EmailMessage()
    m["Subject"], m["From"], m["Message-ID"] = f"Mail {uid}", "a@example.com", f"<{uid}@x>"
    m.set_content("see attached")
    for i, c in enumerate(contents):
        m.add_attachment(c, maintype="application", subtype="pdf", filename=f"{uid}_{i}.pdf")
    (folder / f"{uid}.eml").write_bytes(m.as_bytes())


def test_mail_stream_reads_nothing_twice(spark, tmp_path):
    from leafmill.sources.mail import attachment_stream, each_once, unseen_attachments

    box = tmp_path / "box"
    box.mkdir()
    options = {"enabled": "true", "box": "tests.folder_box:FolderBox", "folder": str(box), "batch": "2", "max_mails": "3"}
    for uid in range(1, 6):
        put(box, uid, b"same", f"own {uid}".encode(), b"same")
    got = []

    def run():
        def take(batch, batch_id):
            got.append([(r["uid"], r["place"], bytes(r["content"])) for r in each_once(batch).orderBy("uid", "place").collect()])

        stream = attachment_stream(spark, **options)
        stream.writeStream.foreachBatch(take).option("checkpointLocation", str(tmp_path / "progress")).trigger(processingTime="0 seconds").start().processAllAvailable()
        for q in spark.streams.active:
            q.stop()

    run()
    fetched = (box / "fetched").read_text().split()
    assert sorted(map(int, fetched)) == [1, 2, 3, 4, 5]
    # Within a micro-batch the repeated content goes, and its first bearer stays.
    rows = [r for b in got for r in b]
    assert sorted(c for _, _, c in rows if c != b"same") == [f"own {u}".encode() for u in range(1, 6)]
    assert all(sum(c == b"same" for _, _, c in b) <= 1 for b in got) and (1, 0, b"same") in rows
    put(box, 6, b"later")
    got.clear()
    run()
    assert [r for b in got for r in b] == [(6, 0, b"later")]
    assert sorted(map(int, (box / "fetched").read_text().split())) == [1, 2, 3, 4, 5, 6]
    assert unseen_attachments(spark, **options).filter("content = cast('same' as binary)").select("uid", "place").collect() == [(1, 0)]
    with pytest.raises(Exception, match="the mail source is off"):
        unseen_attachments(spark, folder=str(box)).count()


def test_imap_presets_and_numbers(monkeypatch):
    import imaplib

    from leafmill.sources.mail import ImapBox

    class Server:
        def __init__(self, host, port):
            self.where = (host, port)

        login = select = logout = lambda self, *a, **k: None

        def uid(self, command, *a):
            return ("OK", [b"4 7 9"]) if command == "SEARCH" else ("OK", [(b"7", b"raw " + a[0].encode())])

    monkeypatch.setattr(imaplib, "IMAP4_SSL", Server)
    box = ImapBox({"preset": "gmail", "user": "u", "password": "p"})
    assert box.box.where == ("imap.gmail.com", 993) and ImapBox({"host": "h", "port": "1"}).box.where == ("h", 1)
    assert box.numbers(4, True) == [7, 9] and box.fetch(7) == b"raw 7"


def rows(spark, n=40):
    return spark.range(n).repartition(4).select(F.when(F.col("id") % 2 == 0, "json").otherwise("bytes").alias("part"), F.col("id").cast("string").alias("name"), F.concat(F.lit("row "), F.col("id").cast("string")).cast("binary").alias("body"))


def test_bundle_is_published_at_once(spark, tmp_path):
    from leafmill.sources.bundle import BundleSink, read_bundle, read_manifest

    spark.dataSource.register(BundleSink)
    path = str(tmp_path / "bundle")
    save = lambda df: df.write.format("leafmill_bundle").mode("append").option("path", path).save()
    bad = F.udf(lambda x: 1 / 0 if x == "7" else x)
    with pytest.raises(Exception, match="ZeroDivisionError"):
        save(rows(spark).withColumn("name", bad("name")))
    kept = lambda: {f for d, _, fs in os.walk(path) for f in fs if not f.endswith(".crc") and "_staging_" not in d}
    assert read_manifest(path) == {"files": []} and kept() == set()
    save(rows(spark))
    want = sorted((str(i), f"row {i}") for i in range(0, 40, 2))
    assert sorted(map(tuple, read_bundle(spark, path, "json").collect())) == want
    assert sorted((r["name"], bytes(r["body"]).decode()) for r in read_bundle(spark, path, "bytes").collect()) == sorted((str(i), f"row {i}") for i in range(1, 40, 2))
    # A failure leaves what was published; a repeat replaces it.
    with pytest.raises(Exception, match="ZeroDivisionError"):
        save(rows(spark).withColumn("name", bad("name")))
    assert sorted(map(tuple, read_bundle(spark, path, "json").collect())) == want
    save(rows(spark, 10))
    assert read_bundle(spark, path, "json").count() == 5
    assert kept() == {os.path.basename(f["file"]) for f in json.load(open(f"{path}/manifest.json"))["files"]} | {"manifest.json"}


def test_session_is_purged_after_its_bundle(spark, tmp_path):
    from leafmill.plans.reading import positioned
    from leafmill.sources import domain as D
    from leafmill.sources.bundle import finish_session, load_bytes, read_bundle, store_bytes

    sf = "/root/testdata/sf0.001"
    t = {"invoices": D.invoices(spark, sf).withColumn("validation_report", F.lit(None).cast("string")), "documents": D.documents(spark, sf), "vendors": D.vendors(spark, sf), "line_items": positioned(D.lines(spark, sf))}
    contents = t["documents"].select("workspace_id", "id", F.col("filename").cast("binary").alias("content"))
    store_bytes(contents, str(tmp_path / "bytes"))
    one = t["documents"].filter("workspace_id = 'ws1'").first()
    held = load_bytes(spark, str(tmp_path / "bytes"), "ws1", [one["id"]])
    assert [(r["id"], bytes(r["content"]).decode()) for r in held.collect()] == [(one["id"], one["filename"])]
    assert load_bytes(spark, str(tmp_path / "bytes"), "ws2", [one["id"]]).count() == 0
    path = str(tmp_path / "bundle")
    left = finish_session(t, path, "ws1", contents)
    n = t["invoices"].filter("workspace_id = 'ws1'").count()
    assert n > 0 and left["invoices"].filter("workspace_id = 'ws1'").count() == 0 and left["invoices"].count() == t["invoices"].count() - n
    assert all(json.loads(r["body"]) for r in read_bundle(spark, path, "json").collect()) and read_bundle(spark, path, "json").count() == n
    assert read_bundle(spark, path, "bytes").count() == n and read_bundle(spark, path, "invoices").count() == n


def test_bundle_takes_little_room(spark, tmp_path, monkeypatch):
    """Its texts lay as they are, and the lines of all tenants were shuffled with theirs, beside the files of all other steps."""
    import gzip
    import re

    from leafmill.operators.reports import export_invoices, export_json, export_lines, tenant
    from leafmill.plans.reading import positioned
    from leafmill.sources import bundle as B
    from leafmill.sources import domain as D

    sf = "/root/testdata/sf0.001"
    # A column without a type, as those that nothing has filled yet.
    t = {"invoices": D.invoices(spark, sf).withColumn("validation_report", F.lit(None)), "documents": D.documents(spark, sf), "vendors": D.vendors(spark, sf), "line_items": positioned(D.lines(spark, sf))}
    contents = t["documents"].select("workspace_id", "id", F.col("filename").cast("binary").alias("content"))
    own = tenant(t["invoices"], "ws1")
    want = {
        "json": sorted(r["json"] for r in export_json(own, t["line_items"]).collect()),
        "invoices": sorted(r["j"] for r in export_invoices(own, t["documents"], t["vendors"]).select(F.to_json(F.struct("*")).alias("j")).collect()),
        "lines": sorted(r["j"] for r in export_lines(own, t["vendors"], t["line_items"]).select(F.to_json(F.struct("*")).alias("j")).collect()),
    }
    steps = []
    monkeypatch.setattr(B, "shared_folder", lambda spark, name: steps.append(f"{tmp_path}/{name}") or steps[-1])
    monkeypatch.setattr(B, "written", lambda df, folder, write=B.written: steps.append(folder) or write(df, folder))
    for k, lines_of in enumerate((None, lambda ids: positioned(D.lines(spark, sf, ids)))):
        path = str(tmp_path / f"bundle{k}")
        B.finish_session(t, path, "ws1", contents, lines_of)
        for part, texts in want.items():
            assert sorted(r["body"] for r in B.read_bundle(spark, path, part).collect()) == texts and texts
        for f in B.read_manifest(path)["files"]:
            with gzip.open(f"{path}/{f['file']}") as lines:
                assert sum(1 for _ in lines) == f["rows"]
    session = f"{tmp_path}/session"
    assert steps == [session, f"{session}/own", f"{session}/sheet"] * 2 and not os.path.exists(session)
    # Lines of others leave before their texts are made, and so before any shuffle but that by the invoice.
    plan = D.lines(spark, sf, own.select(F.col("id").alias("invoice_id")))._jdf.queryExecution().optimizedPlan().toString().splitlines()
    depth = lambda what: min(re.search(r"[A-Z]", line).start() for line in plan if what in line)
    assert depth("Join LeftSemi") > depth("Join Inner") > depth("coalesce(")
    # After a failure nothing is left but what was published.
    bad = F.udf(lambda x: 1 / 0)
    with pytest.raises(Exception, match="ZeroDivisionError"):
        B.finish_session(t, path, "ws1", contents.withColumn("id", bad("id")), None)
    assert not os.path.exists(session) and B.read_bundle(spark, path, "json").count() == len(want["json"])
