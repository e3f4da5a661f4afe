"""Streams that keep state, stopped and started again, against plain replays and the batch jobs."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from weftlake.operators import crawl as X, track as T
from weftlake.sources import state as S
from weftlake.streaming import cache, crawler, tracker

DAY = dt.datetime(2024, 1, 1)
REQUEST = "seq long, url string, at timestamp, size long"


def replay(requests, ttl, most):
    """One shard after the other, request by request: url -> (at, size), in the order of fetching."""
    held, out = {}, {}
    for seq, url, at, size in sorted(requests, key=lambda r: (r[2], r[0])):
        own = held.setdefault(hash_of(url), {})
        for u in [u for u, (t, _) in own.items() if at - t > ttl]:
            del own[u]
        hit = url in own
        first = own[url][0] if hit else at
        if not hit:
            while own and sum(s for _, s in own.values()) + size > most:
                del own[next(iter(own))]
            own[url] = (at, size)
        out[seq] = (hit, first, len(own), sum(s for _, s in own.values()))
    return out


def hash_of(url):
    return int(url[-1]) % 2


def test_cache_stream(spark, tmp_path):
    rng = random.Random(2)
    at, requests = DAY, []
    for i in range(240):
        at += dt.timedelta(seconds=rng.choice([0, 1, 20, 300, 4000 if i % 40 == 0 else 5]))
        requests.append((i, f"https://h/{rng.randrange(14)}", at, rng.choice([10, 200, 900, 5000])))
    odd = [(1000, None, DAY, 1), (1001, "https://h/1", None, 1), (1002, "https://h/1", DAY, None)]
    source = f"{tmp_path}/requests"
    stream = spark.readStream.schema(REQUEST).option("maxFilesPerTrigger", 1).parquet(f"{source}/*")
    how = {"ttl_seconds": 600, "max_size": 4000, "shards": 2, "shard": F.substring("url", -1, 1).cast("long") % 2}

    def give(k, rows):
        spark.createDataFrame(rows, REQUEST).coalesce(1).write.parquet(f"{source}/{k}")

    give(0, requests[:70] + odd)
    give(1, requests[70:71])
    first = cache.run_available(stream, f"{tmp_path}/run", **how).collect()
    assert len(first) == 71
    give(2, requests[71:200])
    give(3, requests[200:])
    got = cache.run_available(stream, f"{tmp_path}/run", **how).collect()  # a new query, from the state of the first
    want = replay(requests, dt.timedelta(seconds=600), 2000)
    assert {r["seq"]: (r["from_cache"], r["fetched_at"], r["n_held"], r["held"]) for r in got} == want and len(got) == len(want)
    assert 20 < sum(r["from_cache"] for r in got) < 220
    assert len(cache.run_available(stream, f"{tmp_path}/run", **how).collect()) == len(want)  # nothing new


ITEM = "title string, snippet string, url string, source string, ord long, seen timestamp"
WATCH = [("Alpha Corp", ["ALP"]), ("Beta", []), ("Gamma", ["gm"])]


def items(day, rows):
    return [(t, s, u, f"feed{i}", i, DAY + dt.timedelta(days=day)) for i, (t, s, u) in enumerate(rows)]


RUNS = [
    items(0, [("alpha corp rises", None, "http://a/1?x=1"), ("ALP again", "beta too", "http://a/1#z"), ("none", None, "http://a/2"), ("Beta", None, "http://b/1/")]),
    items(30, [("Beta", "x", "http://b/1"), ("gm up", None, "http://c/1"), ("alphabet", "alp.", "http://a/3")]),
    items(100, [("Beta", None, "http://b/1"), ("GM", None, "http://c/1"), ("Gamma", None, "http://c/2")]),
    items(200, [("gm", None, "http://c/1"), ("Alpha Corp", None, "http://a/1"), ("Beta", None, "http://b/1")]),
]


def tracked(rows):
    return sorted((r["run"], r["entity"], r["url"], r["first_seen"]) for r in rows)


def test_track_stream_is_track_run_by_run(spark, tmp_path):
    source, path = f"{tmp_path}/items", f"{tmp_path}/stream"
    stream = spark.readStream.schema(ITEM).option("maxFilesPerTrigger", 1).parquet(f"{source}/*")
    want, counts, batch = [], {}, f"{tmp_path}/batch"
    for k, rows in enumerate(RUNS):
        d = spark.createDataFrame(rows, ITEM)
        d.coalesce(1).write.parquet(f"{source}/{k}")
        tracker.track_stream(stream, WATCH, path).awaitTermination()  # each time a new query, from the checkpoint
        now = (DAY + dt.timedelta(days=[0, 30, 100, 200][k])).strftime("%Y-%m-%dT%H:%M:%S.000Z")
        sweep = d.select(F.lit("Beta").alias("entity"), F.col("ord").alias("rank"), "title", "url", "snippet")
        out = T.track(spark, [(n, a, []) for n, a in WATCH], sweep, None, batch, now)
        counts |= {(k, r["entity"]): (r["n_new"], r["total_known"]) for r in out.collect()}
        want += [(k, r["entity"], r["url"], r["first_seen"]) for r in S.read_state(spark, batch).collect() if r["first_seen"] == now]
    assert tracked(tracker.new_mentions(spark, path).collect()) == sorted(want)
    assert {(r["run"], r["entity"]): (r["n_new"], r["total_known"]) for r in tracker.runs(spark, path).collect()} == counts
    again = [r for r in tracked(tracker.new_mentions(spark, path).collect()) if r[2] == "http://b/1" or r[2] == "http://c/1"]
    assert [(r[0], r[1]) for r in again] == [(1, "Gamma"), (3, "Beta")]  # pruned by the third run, reported again by the fourth

    before = tracked(tracker.new_mentions(spark, path).collect()), tracker.runs(spark, path).collect(), sorted(S.read_state(spark, f"{path}/state").collect())
    tracker.run(spark.createDataFrame(RUNS[3], ITEM), 3, WATCH, path)  # the last batch, played again
    assert (tracked(tracker.new_mentions(spark, path).collect()), tracker.runs(spark, path).collect(), sorted(S.read_state(spark, f"{path}/state").collect())) == before
    S.remove(spark, f"{path}/state/version=4")  # the last batch failed before its end
    tracker.run(spark.createDataFrame(RUNS[3], ITEM), 3, WATCH, path)
    assert (tracked(tracker.new_mentions(spark, path).collect()), sorted(S.read_state(spark, f"{path}/state").collect())) == (before[0], before[2])
    tracker.run(spark.createDataFrame([], ITEM), 4, WATCH, path)
    assert not S.written(spark, f"{path}/state/version=5")


@pytest.mark.parametrize("how", [{}, {"max_pages": 17}, {"max_depth": 2}, {"exclude": ["*7"]}])
def test_crawl_stream_is_the_batch_crawl(spark, tmp_path, how):
    pages = spark.range(60).where("id % 11 <> 10").select("id", F.least("id", F.lit(50)).alias("content_hash"), F.element_at(F.array(*map(F.lit, X.TIERS)), (F.col("id") % 3 + 1).cast("int")).alias("tier"))
    edges = spark.range(60).select(F.col("id").alias("src"), F.posexplode(F.array(F.col("id") * 2 + 1, F.col("id") * 2 + 2, F.col("id") % 5)).alias("pos", "dst"))
    want = X.crawl_report(pages, edges, 0, **how)
    part = crawler.crawl_stream(pages, edges, 0, f"{tmp_path}/c", max_waves=2, **how)
    assert {r["depth"] for r in part.pages.collect()} == {0, 1}
    got = crawler.crawl_stream(pages, edges, 0, f"{tmp_path}/c", **how)
    for a, b in zip(got, want, strict=True):
        drop = [c for c in a.columns if c == "ord"]
        assert sorted(a.drop(*drop).collect()) == sorted(b.drop(*drop).collect())
    assert [r["id"] for r in got.pages.orderBy("depth", "ord").collect()] == [r["id"] for r in want.pages.orderBy("depth", "ord").collect()]
    same = crawler.crawl_stream(pages, edges, 0, f"{tmp_path}/c", **how)  # nothing is left to read
    assert sorted(same.pages.collect()) == sorted(got.pages.collect())


def test_progress_of_waves_and_batches(spark, tmp_path):
    """What waves tell as they end equals the final tables, with repeats, failures and a budget; a stream's batches are rows too."""
    pages = spark.range(60).where("id % 11 <> 10").select("id", F.least("id", F.lit(50)).alias("content_hash"), (F.col("id") + 1).alias("tokens"))
    edges = spark.range(60).select(F.col("id").alias("src"), F.posexplode(F.array(F.col("id") * 2 + 1, F.col("id") * 2 + 2)).alias("pos", "dst"))
    w = X.Waves(f"{tmp_path}/w", pages, edges, max_pages=40, tell=True)
    w.start(0)
    depth, told = 0, []
    while True:
        more = w.step(depth)
        told.append({r["wave"] for r in w.progress().collect()})
        depth += 1
        if more < 0:
            break
    assert told == [set(range(k + 1)) for k in range(depth)]  # each wave's row is there when it has ended
    rows = w.progress().collect()
    out = w.result()
    assert sum(r["pages"] for r in rows) == out.tiers.agg(F.sum("n")).first()[0] == w.every("read").count() == 40
    assert sum(r["new"] for r in rows) == out.pages.count() and sum(r["failures"] for r in rows) == out.errors.count()
    assert sum(r["tokens"] for r in rows) == out.pages.join(pages, "id").agg(F.sum("tokens")).first()[0]

    from weftlake.streaming import progress

    for k in range(3):
        spark.range(k * 10, k * 10 + 5 + k).coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
    stream = progress.observed(spark.readStream.schema("id long").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*"), "ids", n=F.count(F.lit(1)), most=F.max("id"))
    log = progress.Batches(spark, f"{tmp_path}/log")
    q = stream.writeStream.queryName("ids").format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
    q.awaitTermination()
    log.stop()
    got = progress.batches(spark, f"{tmp_path}/log").orderBy("batch").collect()
    assert [(r["name"], r["rows"], r["observed"]["ids.n"]) for r in got] == [("ids", 5, "5"), ("ids", 6, "6"), ("ids", 7, "7")]
    assert max(int(r["observed"]["ids.most"]) for r in got) == 26 and sum(r["rows"] for r in got) == spark.read.parquet(f"{tmp_path}/out").count()


class Kept:
    """A map or value state, in memory; what is asked of it is counted."""

    def __init__(self):
        self.rows, self.asked = {}, 0

    def containsKey(self, k):
        self.asked += 1
        return k in self.rows

    def getValue(self, k):
        return self.rows[k]

    def updateValue(self, k, v):
        self.rows[k] = v

    def removeKey(self, k):
        del self.rows[k]

    def exists(self):
        return () in self.rows

    def get(self):
        return self.rows[()]

    def update(self, v):
        self.rows[()] = v


class Handle:
    def __init__(self):
        self.states = {}

    def getMapState(self, name, *_):
        return self.states.setdefault(name, Kept())

    getValueState = getMapState

    def listTimers(self):
        return []

    def registerTimer(self, at):
        pass


@pytest.mark.parametrize("most", [2000, 40_000])
def test_cache_holds_a_bounded_part_of_a_call(monkeypatch, most):
    """A call's answers come in slices, its views stay small and the state isn't asked for what it can't hold; a second call goes on from the state of the first."""
    import pandas as pd

    monkeypatch.setattr(cache, "MOST", 30, raising=False)
    rng = random.Random(3)
    requests = [(i, f"https://h/{rng.randrange(300)}0", DAY + dt.timedelta(seconds=i // 3), rng.choice([0, 10, 200, 900, 5000])) for i in range(25_000)]
    want, handle, got, sizes, held = replay(requests, dt.timedelta(seconds=600), most), Handle(), {}, [], []
    for part in (requests[:24_000], requests[24_000:]):
        c = cache.Cache(600, most)
        c.init(handle)
        part = rng.sample(part, len(part))
        frames = [pd.DataFrame(part[k : k + 7000], columns=["seq", "url", "at", "size"]) for k in range(0, len(part), 7000)]
        for f in c.handleInputRows((0,), iter(frames), None):
            sizes.append(len(f))
            held.append(max(len(c.by_url.held), len(c.by_place.held)))
            got |= {r.seq: (r.from_cache, r.fetched_at, r.n_held, r.held) for r in f.itertuples()}
        if most == 2000 and len(got) == 24_000:
            asked = handle.states["entries"].asked
    assert got == want and max(sizes) <= 10_000
    assert max(held) <= 31
    n = handle.states["ends"].get()[3]
    assert len(handle.states["entries"].rows) == len(handle.states["queue"].rows) == n == want[24_999][2]
    assert most != 2000 or asked < 24_000
