"""Whole searches out of a stream of pages, by arbitrary stateful processing.

A search's pages arrive in any order and in any number of files.  ``WholeSearch`` holds them as
state under the search's id until the page that ends the search is known (its ``last`` page, or page
number CAP - 1) and all pages before it are there, and then hands all of them out in one
micro-batch.  A search whose end is lost has a timer: when none of its pages has come for PATIENCE_MS,
what is there goes out with the next micro-batch.  Pages that come after that go out by the same
rule as a search of their own.  A page that arrives twice is held once.

Timers are of processing time on purpose: a watermark would drop pages that land late, and no page
may be lost.

State is one list of at most CAP pages for each open search; a closed search leaves none.
"""

from __future__ import annotations

import contextlib
from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

CAP = 10                  # pages of a search at most
PATIENCE_MS = 2 * 3600 * 1000      # for a search whose end is lost


def is_whole(numbers: set[int], ends: set[int], cap: int = CAP) -> bool:
    """Pages 0 to the first end are there; the page before the cap always ends a search."""
    end = min(ends | {n for n in numbers if n >= cap - 1}, default=None)
    return end is not None and numbers >= set(range(end + 1))


class WholeSearch(StatefulProcessor):
    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.pages = handle.getListState("pages", self.schema)

    def __init__(self, schema: T.StructType, cap: int = CAP, patience_ms: int = PATIENCE_MS):
        self.schema, self.cap, self.patience_ms = schema, cap, patience_ms

    def _held(self) -> dict[int, tuple]:
        return {row[self.number]: tuple(row) for row in self.pages.get()} if self.pages.exists() else {}

    @property
    def number(self) -> int:
        return self.schema.names.index("page_no")

    def _release(self, held: dict[int, tuple]) -> Iterator[Row]:
        self.pages.clear()
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        for n in sorted(held):
            yield Row(**dict(zip(self.schema.names, held[n])))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        held = self._held()
        last = self.schema.names.index("last")
        for row in rows:
            page = tuple(row[c] for c in self.schema.names)
            if page[self.number] is not None:
                held.setdefault(page[self.number], page)
        if not held:
            return
        ends = {n for n, page in held.items() if page[last]}
        if is_whole(set(held), ends, self.cap):
            yield from self._release(held)
            return
        self.pages.put([held[n] for n in sorted(held)])
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.patience_ms)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        yield from self._release(self._held())

    def close(self) -> None:
        pass


def whole_searches(pages: DataFrame, cap: int = CAP, patience_ms: int = PATIENCE_MS) -> DataFrame:
    """The pages of a stream, a search's pages together; ``pages`` has search_id, page_no and last.
    Pages without a number are left out; pages without a search are one search."""
    out = T.StructType(pages.schema.fields)
    return pages.groupBy("search_id").transformWithState(
        WholeSearch(out, cap, patience_ms), out, "append", "processingTime")


@contextlib.contextmanager
def state_on_disk(spark: SparkSession):
    """For the start of a query with state: the store that spills to disk, without the megabytes that
    it sets aside for each partition's log, and no micro-batch without data (timers fire with the next
    data, so a drain of what has landed ends)."""
    wanted = {"spark.sql.streaming.stateStore.providerClass":
              "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
              "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
              "spark.sql.streaming.stateStore.rocksdb.compression": "zstd",
              "spark.sql.streaming.noDataMicroBatches.enabled": "false"}
    before = {k: spark.conf.get(k, None) for k in wanted}
    for k, v in wanted.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)
