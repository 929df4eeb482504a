"""Memory by event order over a stream in several micro-batches."""

import random

from pyspark.sql import functions as F

from leafmill.operators.vendors import EVENT, NO_MEMORY, keep_products, remember

SCHEMA = "workspace_id string, vendor_id long, at timestamp, ord long, number string, tax_id string, currency string, terms string, confidence double, has_lines boolean, has_order boolean, products array<string>"


def test_late_rows_across_batches(spark, tmp_path):
    from leafmill.streaming.ordered import STORE, ordered_memory
    from leafmill.streaming.streams import event_stream, run_once

    rng = random.Random(6)
    rows = []
    for n in range(240):
        products = rng.choice([None, [], rng.choices([f"p{i}" for i in range(40)], k=rng.randint(1, 6))])
        rows.append([("w", None)[n == 9], n % 3, n, rng.choice(["", None, f"N{n % 50}"]), rng.choice(["", None, "T1", "T2"]), rng.choice(["EUR", None, ""]), rng.choice([None, "30"]), rng.choice([None, rng.random()]), n % 2 == 0, rng.choice([True, False, None]), products])
    # Arrivals are shuffled inside 20 seconds, so none comes later than that; a file is a micro-batch.
    order = sorted(range(240), key=lambda n: n + rng.random() * 20)
    for b in range(6):
        part = [rows[n] for n in order[b * 40 : b * 40 + 40]]
        df = spark.createDataFrame([(w, v, None, *rest) for w, v, *rest in part], SCHEMA).withColumn("at", F.timestamp_seconds(F.col("ord") + 10**9))
        df.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    out = ordered_memory(event_stream(spark, str(tmp_path / "in"), df.schema, 1), "200 seconds")
    got = {r["vendor_id"]: r for r in run_once(out, ["workspace_id", "vendor_id"], conf=STORE).collect()}
    for v in range(3):
        memory, products = NO_MEMORY, []
        for r in rows:
            if r[1] == v and r[0]:
                memory, products = remember(memory, tuple(r[3:10])), keep_products(products, r[10] or [])
        assert [got[v][c] for c in ("invoice_count", "avg_confidence", "historical_invoice_numbers", "tax_ids")] == list(memory[:4])
        assert got[v]["products"] == products and got[v]["preferred_currency"] == memory[5] and got[v]["rate_purchase_order"] == memory[8]
    assert len(got) == 3 and 0 < max(r["waiting"] for r in got.values()) <= 80
    assert len(EVENT) == 7


def test_a_key_asks_the_store_twice():
    """Each call is a round trip: six for each vendor and micro-batch, and a frame of its own, were most of the time."""
    from leafmill.streaming.ordered import OrderedMemory

    calls, held = [], {}

    class Store:
        get = lambda self: calls.append("get") or held.get("v")
        update = lambda self, v: calls.append("update") or held.update(v=v)

    class Handle:
        getValueState = lambda self, *a: Store()
        registerTimer = lambda self, at: calls.append(at)

    class Now:
        def __init__(self, at):
            self.getCurrentWatermarkInMs = lambda: at

    p = OrderedMemory()
    p.init(Handle())
    row = lambda n: {"_ms": n, "ord": n, **dict.fromkeys(EVENT), "confidence": n / 10, "products": None}
    seen = [next(p.handleInputRows(("w", 1), iter([row(n)]), Now(2))) for n in (5, 7, 4, 1)]
    assert calls == ["get", 5, "update", "get", "update", "get", 4, "update", "get", "update"]
    assert [(r["invoice_count"], r["waiting"]) for r in seen] == [(1, 1), (2, 2), (3, 3), (4, 3)]
    last = next(p.handleExpiredTimer(("w", 1), Now(6), None))
    memory = NO_MEMORY
    for n in (1, 4, 5, 7):
        memory = remember(memory, (None, None, None, None, n / 10, None, None))
    assert calls[-3:] == ["get", 7, "update"] and last["waiting"] == 1 and last["avg_confidence"] == memory[1] == seen[-1]["avg_confidence"]


def test_a_vendors_rows_need_no_frame_of_their_own(monkeypatch):
    """Joining and sorting a frame for each vendor took longer than folding its few invoices."""
    import pandas as pd

    from leafmill.operators.vendors import MEMORY_NAMES
    from leafmill.streaming import streams

    class State:
        exists, kept = False, None
        update = lambda self, m: setattr(self, "kept", m)

    rows = [(n, f"N{n}", None, ("EUR", None)[n % 2], None, (n * 7 % 10) / 10, n % 2 == 0, False) for n in (4, 1, 3, 2)]
    b = [pd.DataFrame(part, columns=["ord", *EVENT]) for part in (rows[:3], rows[3:])]
    monkeypatch.setattr(streams.pd, "concat", None)
    state = State()
    out = next(streams._remember(("w", 1), iter(b), state))
    memory = NO_MEMORY
    for _, *event in sorted(rows):
        memory = remember(memory, event)
    assert state.kept == memory and out[list(MEMORY_NAMES)].iloc[0]["invoice_count"] == 4


def test_vendors_share_a_key(spark, tmp_path):
    """Each vendor was a key of its own: some calls to the store, and a batch of output, for its few invoices of a micro-batch."""
    from leafmill.streaming.ordered import STORE, ordered_memory
    from leafmill.streaming.streams import event_stream, run_once

    rng = random.Random(8)
    # Texts, nulls and numbers that are none pass as they are; times are seconds, so that some vendors no longer wait.
    text = lambda: rng.choice([None, "", "é\"\\\n", "T1", "p 2"])
    rows = [(f"w{n % 3}", n * 7 % 23, n, text(), text(), text(), text(), rng.choice([None, float("nan"), rng.random(), 1e-7]), rng.choice([True, None]), n % 2 == 0, rng.choice([None, [], [text() or "p" for _ in range(4)]])) for n in range(300)]
    order = sorted(range(300), key=lambda n: n + rng.random() * 90)
    for b in range(4):
        df = spark.createDataFrame([(*rows[n][:2], None, *rows[n][2:]) for n in order[b * 75 : b * 75 + 75]], SCHEMA).withColumn("at", F.timestamp_seconds(F.col("ord") + 10**9))
        df.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    got = []
    for buckets in (None, 1, 5):
        stream = ordered_memory(event_stream(spark, str(tmp_path / "in"), df.schema, 1), "95 seconds", buckets)
        got.append(sorted(map(tuple, run_once(stream, ["workspace_id", "vendor_id"], conf=STORE).collect()), key=lambda r: r[:2]))
        plan = stream._jdf.queryExecution().analyzed().toString()
        assert ("_bucket" in plan) == (buckets is not None)
    assert got[0] == got[1] == got[2] and len(got[0]) == 69
    for *key, count, average, numbers, _, _, currency, _, _, _, products, _ in got[0]:
        memory, kept = NO_MEMORY, []
        for r in rows:
            if list(r[:2]) == key:
                memory, kept = remember(memory, r[3:10]), keep_products(kept, r[10] or [])
        assert (count, average, numbers, currency, products) == (*memory[:3], memory[5], kept)


def test_a_bucket_asks_the_store_as_often_as_a_vendor():
    import json

    from leafmill.streaming.ordered import OrderedMemories

    calls, held = [], {}

    class Store:
        get = lambda self: calls.append("get") or held.get("v")
        update = lambda self, v: calls.append("update") or held.update(v=v)

    class Handle:
        getValueState = lambda self, *a: Store()
        registerTimer = lambda self, at: calls.append(at)

    class Now:
        getCurrentWatermarkInMs = lambda self: 7

    p = OrderedMemories()
    p.init(Handle())
    row = lambda v, n: {"_row": json.dumps(dict(enumerate([n, "w", v, n, *[None] * len(EVENT), None])))}
    first = list(p.handleInputRows((3,), iter([row(v, n) for v in range(30) for n in (8, 5)]), Now()))
    assert calls == ["get", 8, "update"] and [(r["vendor_id"], r["invoice_count"], r["waiting"]) for r in first] == [(v, 2, 1) for v in range(30)]
    # Only those with new rows are put out; the others keep theirs.
    then = list(p.handleInputRows((3,), iter([row(4, 9)]), Now()))
    assert [(r["vendor_id"], r["invoice_count"], r["waiting"]) for r in then] == [(4, 3, 2)] and calls[3:] == ["get", "update"]


def test_rounding_and_products_without_decimals_and_heaps():
    from collections import Counter
    from decimal import ROUND_HALF_UP, Decimal

    from leafmill.operators.vendors import three

    rng = random.Random(2)
    plain = lambda x: float(Decimal(repr(x)).quantize(Decimal("1e-9"), ROUND_HALF_UP).quantize(Decimal("1e-3"), ROUND_HALF_UP))
    near = [k / 1000 + 0.0005 + d for k in range(0, 1000, 7) for d in (0.0, 1e-16, -1e-16, 4e-10, -4e-10, -5e-10, -6e-10, 1e-8, -1e-8, 1e-6)]
    for x in [*near, *(rng.random() for _ in range(3000)), *(rng.random() * 10**6 for _ in range(300)), 0.0, 1.0, -0.25, -0.0005, 3e7 + 0.12345, 1 / 3]:
        assert three(x) == plain(x)
    for _ in range(300):
        kept, new = [rng.sample(range(30), rng.randint(0, 20)), rng.choices(range(30), k=rng.randint(0, 8))]
        assert keep_products(kept, new) == [p for p, _ in Counter([*kept, *new]).most_common(20)]


def test_the_stream_begins_without_the_events_shuffle_files(spark, monkeypatch):
    """Those of the joins behind the events lay on the disk as long as the stream ran."""
    from leafmill.plans import registry, streams

    steps = []
    monkeypatch.setattr(streams, "written", lambda df, folder, write=streams.written: steps.append("written") or write(df, folder))
    monkeypatch.setattr(streams.S, "run_once", lambda *a, run=streams.S.run_once, **k: steps.append("stream") or run(*a, **k))
    assert registry.queries()["q_stream_memory_ordered"](spark, "/root/testdata/sf0.001").count() > 0 and steps == ["written", "stream"]
