"""Vendor memory over a stream whose invoices arrive out of order: a reorder buffer with event-time timers."""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from leafmill.operators.vendors import EVENT, MEMORY, MEMORY_NAMES, NO_MEMORY, keep_products, remember

#: State of many keys needs a store outside the memory of the executor.
STORE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}
OUT = f"workspace_id string, vendor_id long, {MEMORY}, products array<string>, waiting int"

_ROW = Row("workspace_id", "vendor_id", *MEMORY_NAMES, "products", "waiting")
_TAKEN = ("_ms", "ord", *EVENT, "products")


def _sortable(row: list) -> list:
    """Nulls come first, as in the batch's sort."""
    return [(x is not None, x) for x in row[: 1 + len(EVENT)]]


def _plain(x):
    return None if x is None or (not isinstance(x, (list, str)) and x != x) else x.item() if hasattr(x, "item") else x


class OrderedMemory(StatefulProcessor):
    """Invoices of a vendor wait until the watermark says that none before them is to come; then they are folded
    into the memory in their order.  What is put out counts those that wait as well, in the order known so far.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        # One value, as each call to the store is a round trip: (vendor, memory, products, (time, row) of those that wait), the next timer.
        self.state = handle.getValueState("state", "packed binary")

    def _folded(self, memory: tuple, products: list, rows: list[list]) -> tuple[tuple, list]:
        for _, *event, bought in sorted(rows, key=_sortable):
            memory, products = remember(memory, tuple(event)), keep_products(products, bought or [])
        return memory, products

    def _read(self, key: tuple, rows: Iterator[Row]) -> dict[tuple, list]:
        """(time, row) of each vendor."""
        new = []
        for at, order, *event, bought in (tuple(r[c] for c in _TAKEN) for r in rows):
            new.append((at, [_plain(x) for x in (order, *event)] + [list(bought) if bought is not None else []]))
        return {tuple(key): new}

    def _settle(self, new: dict[tuple, list], now: int, fired: bool = False) -> Iterator[Row]:
        """A row of each vendor that has new invoices or some that no longer wait."""
        stored = self.state.get()
        known, timer = json.loads(zlib.decompress(stored[0])) if stored else ([], None)
        held = {(workspace, vendor): (tuple(memory), products, rows) for workspace, vendor, memory, products, rows in known}
        timer, out = None if fired else timer, []
        for vendor, rows in new.items():
            memory, products, before = held.get(vendor, (NO_MEMORY, [], []))
            held[vendor] = memory, products, before + rows
        for vendor, (memory, products, rows) in held.items():
            if due := [r for at, r in rows if at <= now]:
                memory, products = self._folded(memory, products, due)
                rows = [(at, r) for at, r in rows if at > now]
                held[vendor] = memory, products, rows
            if due or vendor in new:
                memory, products = self._folded(memory, products, [r for _, r in rows])
                out.append(_ROW(*vendor, *memory, products, len(rows)))
        soon = min((at for _, _, rows in held.values() for at, _ in rows), default=None)
        if soon is not None and soon != timer:
            self.handle.registerTimer(timer := soon)
        if out or fired:
            # Packed, as each micro-batch writes it anew: a tenth of the room and less to send.
            self.state.update((zlib.compress(json.dumps([[(*vendor, *kept) for vendor, kept in held.items()], timer]).encode(), 1),))
        yield from out

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        yield from self._settle(self._read(key, rows), timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[Row]:
        yield from self._settle({}, timerValues.getCurrentWatermarkInMs(), True)

    def close(self) -> None:
        pass


class OrderedMemories(OrderedMemory):
    """The same for a key that many vendors share, whose rows come as texts: a call, a batch and cells less for each."""

    def _read(self, key: tuple, rows: Iterator[Row]) -> dict[tuple, list]:
        new = {}
        for r in rows:
            at, workspace, vendor, *row = json.loads(r["_row"]).values()
            new.setdefault((workspace, vendor), []).append((at, row))
        return new


def ordered_memory(invoices: DataFrame, delay: str = "1 day", buckets: int | None = 1024) -> DataFrame:
    """Vendor memory by event order, whatever the order of arrival: workspace_id, vendor_id, at (a time that never falls
    as ``ord`` rises), ord, the columns of ``EVENT`` and products (array).

    Rows later than ``delay`` behind the latest are left out by the watermark, so a vendor's buffer holds no more than its
    invoices of that time.  The last row of a vendor is the fold of all its invoices in their order.

    A key of the state takes milliseconds in each micro-batch, so vendors share one of ``buckets`` by a hash; None: a key for
    each vendor.  A task holds the vendors of one key: some dozens are enough.  It stays for the life of a checkpoint.
    """
    rows = invoices.select("workspace_id", "vendor_id", "at", "ord", *EVENT, "products").withColumn("_ms", F.unix_millis("at")).filter("workspace_id is not null and vendor_id is not null")
    rows = rows.withWatermark("at", delay)
    if buckets is None:
        return rows.groupBy("workspace_id", "vendor_id").transformWithState(OrderedMemory(), OUT, "Update", "EventTime")
    real = {f.name for f in rows.schema if f.dataType.typeName() in ("float", "double")}
    value = lambda c: F.when(~F.isnan(c), F.col(c)) if c in real else F.col(c)
    taken = F.struct(*[value(c).alias(str(i)) for i, c in enumerate(("_ms", "workspace_id", "vendor_id", *_TAKEN[1:]))])
    packed = rows.select(F.pmod(F.xxhash64("workspace_id", "vendor_id"), F.lit(buckets)).alias("_bucket"), "at", F.to_json(taken, {"ignoreNullFields": "false"}).alias("_row"))
    return packed.groupBy("_bucket").transformWithState(OrderedMemories(), OUT, "Update", "EventTime")
