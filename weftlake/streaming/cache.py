"""The result cache as stream state: entries age out by timers and leave first in, first out, while the stream runs.

A stream of requests is dealt to shards by url; each shard holds at most its share of the cache's size. Its state is two maps
(an entry by url, a url by its place in the queue) and one value (the queue's ends and the size held), so that a request reads and writes
single entries, however many there are. Answers don't depend on how requests are cut into batches: an entry that is too old is at
the queue's head, where it leaves before any other would, whether a timer or a request finds it there.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..functions.batches import give_back

#: The state store that keeps maps on disk; a session needs it before the stream starts.
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Requests of a call that are Python objects at a time, and keys of a state that a call holds at most.
SLICE, MOST = 10_000, 100_000
ANSWERS = "seq long, url string, at timestamp, from_cache boolean, fetched_at timestamp, n_held long, held long"


class _View:
    """A map state during one call: keys are read once while they are held, and what has changed is written at the end.

    n is how many keys the state has; once all of these have been read, it is asked no more. A key that came and went without being in the
    state is forgotten, and beyond MOST keys what has changed is written and all are let go, so that memory doesn't grow with the requests.
    """

    def __init__(self, state, n: int):
        self.state, self.n = state, n
        self._let_go()

    def _let_go(self) -> None:
        self.held, self.changed, self.stored, self.unread = {}, set(), set(), self.n

    def get(self, key):
        if key in self.held:
            return self.held[key]
        if not self.unread or not self.state.containsKey((key,)):
            return None
        self._bound()
        self.unread -= 1
        self.stored.add(key)
        self.held[key] = tuple(self.state.getValue((key,)))
        return self.held[key]

    def put(self, key, value) -> None:
        """None takes the key away. What is put has been asked for by get before, or is known to be new."""
        if value is None and key not in self.stored:
            self.held.pop(key, None)
            self.changed.discard(key)
            return
        self.held[key] = value
        self.changed.add(key)
        self._bound()

    def _bound(self) -> None:
        if len(self.held) > MOST:
            self.write()
            self._let_go()

    def write(self) -> None:
        for key in self.changed:
            if self.held[key] is not None:
                self.state.updateValue((key,), self.held[key])
                self.n += key not in self.stored
                self.stored.add(key)
            else:
                self.state.removeKey((key,))
                self.n -= 1
                self.stored.discard(key)
                del self.held[key]
        self.changed.clear()


def _ordered(rows: Iterator) -> Iterator[tuple[list, list, list, list]]:
    """A call's requests in the order of (at, seq), SLICE of them at a time: seq, url, at in microseconds, size. All wait in Arrow's columns."""
    import pyarrow as pa
    import pyarrow.compute as pc

    kinds = {"seq": pa.int64(), "url": pa.large_string(), "at": pa.int64(), "size": pa.int64()}
    parts: dict[str, list] = {c: [] for c in kinds}
    for d in rows:
        for c, kind in kinds.items():
            values = d["at"].dt.as_unit("us").astype("int64") if c == "at" else d[c]
            parts[c].append(pa.array(values, kind, from_pandas=True))
    t = pa.table({c: pa.concat_arrays(parts.pop(c)) for c in kinds})
    order = pc.sort_indices(t, sort_keys=[("at", "ascending"), ("seq", "ascending")])
    for lo in range(0, len(order), SLICE):
        some = t.take(order.slice(lo, SLICE))
        yield tuple(some[c].to_pylist() for c in kinds)


class Cache(StatefulProcessor):
    """A shard: requests (seq, url, at, size) in the order of (at, seq) within a batch, for which they wait in Arrow's columns; a miss fetches and stores its page."""

    def __init__(self, ttl_seconds: int, max_size: int):
        self.ttl, self.most = ttl_seconds * 1_000_000, max_size

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.entries = handle.getMapState("entries", "url string", "place long, at long, size long")
        self.queue = handle.getMapState("queue", "place long", "url string")
        self.ends = handle.getValueState("ends", "first long, next long, held long, n long")

    def _open(self) -> list:
        e = list(self.ends.get()) if self.ends.exists() else [0, 0, 0, 0]
        self.by_url, self.by_place = _View(self.entries, e[3]), _View(self.queue, e[1] - e[0])
        return e

    def _close(self, e: list) -> None:
        self._wake(e)
        self.by_url.write()
        self.by_place.write()
        self.ends.update(tuple(e))

    def _first(self, e: list):
        """(url, its entry) at the queue's head; no entry where the url has since been stored again."""
        (url,) = self.by_place.get(e[0])
        entry = self.by_url.get(url)
        return url, entry if entry is not None and entry[0] == e[0] else None

    def _drop_first(self, e: list) -> None:
        url, entry = self._first(e)
        self.by_place.put(e[0], None)
        e[0] += 1
        if entry is not None:
            self.by_url.put(url, None)
            e[2] -= entry[2]
            e[3] -= 1

    def _age(self, e: list, now: int) -> None:
        """Drops what is too old at a time: the queue is in the order of fetching."""
        while e[0] < e[1]:
            entry = self._first(e)[1]
            if entry is not None and now - entry[1] <= self.ttl:
                return
            self._drop_first(e)

    def _wake(self, e: list) -> None:
        """One timer a shard, for its oldest entry."""
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t[0] if isinstance(t, tuple) else t)
        entry = self._first(e)[1] if e[0] < e[1] else None
        if entry is not None:
            self.handle.registerTimer((entry[1] + self.ttl) // 1000 + 1)

    def handleInputRows(self, key, rows: Iterator, timerValues) -> Iterator:
        import pandas as pd

        e = self._open()
        for requests in _ordered(rows):
            out = []
            for seq, url, at, size in zip(*requests, strict=True):
                self._age(e, at)
                entry = self.by_url.get(url)
                if entry is None:
                    while e[0] < e[1] and e[2] + size > self.most:
                        self._drop_first(e)
                    self.by_url.put(url, (e[1], at, size))
                    self.by_place.put(e[1], (url,))
                    e = [e[0], e[1] + 1, e[2] + size, e[3] + 1]
                out.append((seq, url, at, entry is not None, entry[1] if entry is not None else at, e[3], e[2]))
            got = pd.DataFrame(out, columns=["seq", "url", "at", "from_cache", "fetched_at", "n_held", "held"])
            for c in ("at", "fetched_at"):
                got[c] = pd.to_datetime(got[c], unit="us")
            yield got
        self._close(e)
        give_back()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator:
        import pandas as pd

        e = self._open()
        self._age(e, expiredTimerInfo.getExpiryTimeInMs() * 1000)
        self._close(e)
        yield pd.DataFrame()

    def close(self) -> None:
        pass


def answer(requests: DataFrame, ttl_seconds: int = 3600, max_size: int = 500_000_000, shards: int = 64, late: str = "0 seconds", shard: Column | None = None) -> DataFrame:
    """A stream of requests(seq long, url string, at timestamp, size long) with whether the cache answers each: ANSWERS.

    size is that of the page that a miss fetches and stores. An entry answers until it is older than ttl_seconds; a shard holds
    max_size / shards at most, or one entry that is larger alone. n_held and held are the shard's after the request. Requests should come in the order of `at`
    (within `late` of one another; later ones are left out by the watermark); null urls, times and sizes are not requests. A shard is
    chosen by a hash of the url, or is the column `shard`, which must follow from the url.
    """
    d = requests.withColumn("shard", F.pmod(F.xxhash64("url"), F.lit(shards)) if shard is None else shard)
    d = d.select("seq", "url", "at", F.col("size").cast("long").alias("size"), "shard").where("url is not null and at is not null and size is not null")
    return d.withWatermark("at", late).groupBy("shard").transformWithStateInPandas(Cache(ttl_seconds, max_size // shards), outputStructType=ANSWERS, outputMode="append", timeMode="eventTime")


def run_available(requests: DataFrame, at: str, **how) -> DataFrame:
    """Answers to everything that the stream's source holds now, kept with their state under `at`; called again there it goes on where it stopped. All answers so far."""
    spark = requests.sparkSession
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    spark.conf.set(key, ROCKS)
    try:
        w = answer(requests, **how).writeStream.format("parquet").option("path", f"{at}/answers").option("checkpointLocation", f"{at}/state")
        w.trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set(key, before)
    return spark.read.schema(ANSWERS).parquet(f"{at}/answers")
