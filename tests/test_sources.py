"""Sources, sinks and the stream of scan events."""

import json
import urllib.error
from datetime import datetime, timedelta

import pandas as pd
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, TimerValues

from quirespark import schemas
from quirespark.operators import covers, quality
from quirespark.sources import response_cache, sru, tables, turns, vision
from quirespark.sources.versions import Versions
from quirespark.streaming import retention, scan_queue


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_stored_answers_are_not_broadcast(spark):
    """Their texts may be far longer than a plan takes them for."""
    requested = spark.createDataFrame([(k, f"k{k}") for k in range(4)], "n int, cache_key string")
    answers = spark.createDataFrame([("k0", " <a/>"), ("k1", "oops"), ("k2", None)], "cache_key string, data string")
    found = sru.replayed(requested, answers)
    assert rows(found.select("n", "success", "data", "error")) == [
        (0, True, " <a/>", ""), (1, False, "", "Response does not appear to be XML"),
        (2, False, "", "HTTP error: no stored answer"), (3, False, "", "HTTP error: no stored answer"),
    ]
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()


def test_outcomes_are_data():
    def fails(error):
        def get():
            raise error

        return get

    assert sru.outcome(lambda: " <a/>") == (True, " <a/>", "")
    assert sru.outcome(lambda: "oops") == (False, "", "Response does not appear to be XML")
    assert sru.outcome(fails(TimeoutError())) == (False, "", "Request timed out after 30s")
    assert sru.outcome(fails(urllib.error.URLError(TimeoutError()))) == (False, "", "Request timed out after 30s")
    assert sru.outcome(fails(urllib.error.HTTPError("u", 503, "Busy", None, None))) == (False, "", "HTTP 503: Busy")
    assert sru.outcome(fails(urllib.error.URLError("refused")))[2].startswith("HTTP error:")


def test_data_source_replays_answers(spark):
    sru.register(spark)
    answers = json.dumps({"a=1": "<x/>", "a=2": "down"})
    asked = json.dumps(["a=1", "a=2", "a=3"])
    found = {r.query: r for r in spark.read.format("sru").options(base_url="http://x", queries=asked, answers=answers, partitions="2").load().collect()}
    assert found["a=1"].success and found["a=1"].data == "<x/>"
    assert found["a=2"].error == "Response does not appear to be XML" and found["a=3"].error.startswith("HTTP error")
    assert spark.read.format("sru").options(base_url="http://x").load().count() == 0


def test_requests_keep_their_distance():
    clock, slept = [100.0], []

    def sleep(seconds):
        slept.append(seconds)
        clock[0] += seconds

    for address, passed in (("u", 0), ("u", 1), ("v", 0), ("u", 7)):
        clock[0] += passed
        sru.wait(address, 3.0, lambda: clock[0], sleep)
    assert slept == [2.0]


def test_requests_and_replay(spark, monkeypatch):
    monkeypatch.setenv("SRU_LC_URL", "http://mirror")
    catalogs = sru.endpoints(spark)
    assert {r.catalog: r.base_url for r in catalogs.collect()}["LC"] == "http://mirror" and catalogs.count() == 4
    queries = spark.createDataFrame([("NLI", "alma.isbn=1"), ("LC", "bath.isbn=1")], "catalog string, query string")
    requested = sru.requests(queries, catalogs)
    by = {r.catalog: r for r in requested.collect()}
    assert by["NLI"].params["query"] == 'alma.isbn = "1"' and by["LC"].params["query"] == "bath.isbn=1" and by["NLI"].params["version"] == "1.2"
    answers = requested.where("catalog = 'LC'").select("cache_key", F.lit("<ok/>").alias("data"))
    assert {(r.catalog, r.success) for r in sru.replayed(requested, answers).collect()} == {("NLI", False), ("LC", True)}


def test_cover_sizes(spark):
    urls = spark.createDataFrame([("a",), ("bad",), ("a",)], "url string")

    def fetch(url):
        if url == "bad":
            raise OSError
        return 500

    assert rows(sru.cover_sizes(urls, fetch)) == [("a", 500), ("bad", 0)]


def test_response_cache(spark, tmp_path):
    cache, t = response_cache.ResponseCache(spark, f"{tmp_path}/cache"), datetime(2024, 1, 1)
    assert cache.entries(t).count() == 0
    cache.put(spark.createDataFrame([("k", "old"), ("j", "x")], "cache_key string, data string"), t)
    cache.put(spark.createDataFrame([("k", "new")], "cache_key string, data string"), t + timedelta(days=1))
    assert rows(cache.entries(t + timedelta(days=2))) == [("j", "x"), ("k", "new")]
    assert rows(cache.entries(t + timedelta(days=30, hours=1))) == [("k", "new")]
    cache.invalidate(spark.createDataFrame([("k",)], "cache_key string"), t + timedelta(days=3))
    asked = spark.createDataFrame([("k",), ("j",), ("z",)], "cache_key string")
    assert rows(cache.misses(asked, t + timedelta(days=4))) == [("k",), ("z",)]
    cache.clear()
    assert cache.entries(t).count() == 0


def test_catalog_tables(spark, tmp_path):
    catalog = tables.Catalog(spark, str(tmp_path))
    catalog.write("author", spark.createDataFrame([(1, "A", ["x"])], "pk long, name string, variant_names array<string>"))
    got = catalog.read("author")
    assert got.schema.simpleString() == schemas.AUTHOR.simpleString() and got.first().name_romanized == ""


def test_json(spark):
    df = spark.createDataFrame([('[{"title": "a", "subjects": ["s"]}, {"author": "b"}]',), ("[]",)], "c string")
    parsed = tables.candidates_from_json(df, "c")
    first = parsed.first().c
    assert (first[0].title, first[0].subjects, first[1].title, first[1].author) == ("a", ["s"], None, "b")
    again = tables.candidates_from_json(tables.candidates_to_json(parsed, "c"), "c")
    assert again.collect() == parsed.collect()
    languages = spark.createDataFrame([(i, code, name) for i, (code, name) in enumerate([("en", "English"), ("he", "Hebrew"), ("ghe", "Southern Ghale")])], "n int, code string, name string")
    assert [r.code for r in tables.suggestions(languages, "HE", ["code", "name"], "n").collect()] == ["he", "ghe"]
    assert tables.suggestions(languages, "h", ["code", "name"], "n").count() == 0
    assert json.loads(tables.as_json(languages).first().json)["code"] == "en"


def test_images(spark, tmp_path):
    (tmp_path / "a.jpg").write_bytes(b"img")
    (tmp_path / "b.txt").write_bytes(b"no")
    images = tables.staged_images(spark, str(tmp_path))
    assert images.count() == 1
    read = vision.read_title_pages(images, lambda content: '```json\n{"title": "T%d"}\n```' % len(content)).first()
    assert read.ocr_output.title == "T3" and "content" not in read.asDict()
    assert vision.read_title_pages(images).first().ocr_output.title is None
    assert quality.stale_files(images.drop("content"), datetime.now() + timedelta(days=31)).count() == 1
    assert quality.stale_files(images.drop("content"), datetime.now()).count() == 0


EVENTS = [(1, "pending", 1), (2, "pending", 1), (1, "confirmed", 3), (3, "discarded", 2), (2, "pending", 4), (1, "pending", 2)]


def _write_events(spark, path, events):
    df = spark.createDataFrame(events, "scan_id long, status string, s int")
    df.select("scan_id", "status", F.timestamp_seconds(F.col("s") + 1_700_000_000).alias("ts")).coalesce(1).write.mode("append").parquet(path)


def test_stream_equals_batch(spark, tmp_path):
    path = f"{tmp_path}/events"
    _write_events(spark, path, EVENTS)
    batch = scan_queue.latest_status(spark.read.parquet(path))
    stream = spark.readStream.schema(spark.read.parquet(path).schema).parquet(path)
    query = scan_queue.latest_status(stream).writeStream.outputMode("complete").format("memory").queryName("states")
    query.option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start().awaitTermination()
    assert rows(spark.table("states").select("scan_id", "status")) == rows(batch.select("scan_id", "status")) == [(1, "confirmed"), (2, "pending"), (3, "discarded")]


def test_states_are_kept_across_batches(spark, tmp_path):
    path, out = f"{tmp_path}/events", f"{tmp_path}/states"
    assert scan_queue.current_states(spark, out) is None
    for events in (EVENTS[:3], EVENTS[3:], [(2, "confirmed", 9)]):
        _write_events(spark, path, events)
        stream = spark.readStream.schema(spark.read.parquet(path).schema).parquet(path)
        scan_queue.upsert_states(stream, out, f"{tmp_path}/cp").awaitTermination()
    assert rows(scan_queue.current_states(spark, out).select("scan_id", "status")) == [(1, "confirmed"), (2, "confirmed"), (3, "discarded")]


def test_a_batch_writes_only_what_it_changes(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(scan_queue, "BATCHES", 3)
    path, out = f"{tmp_path}/events", f"{tmp_path}/states"

    def run():
        stream = spark.readStream.schema("scan_id long, status string, ts timestamp").parquet(path)
        scan_queue.upsert_states(stream, out, f"{tmp_path}/cp").awaitTermination()

    _write_events(spark, path, [(i, "pending", i) for i in range(500)])
    run()
    for k in range(5):  # each from the checkpoint, in a query of its own
        _write_events(spark, path, [(i, "confirmed", 1000 + k) for i in range(10 * k, 10 * k + 10)])
        run()
        state = Versions(spark, out).current()[1]
        if state["batches"]:
            assert spark.read.parquet(f"{out}/{state['batches'][-1]}").count() == 10
    assert len(state["batches"]) <= 3 and state["base"]
    found = scan_queue.current_states(spark, out)
    assert found.count() == 500 and found.where("status = 'confirmed'").count() == 50


def test_discarded_scans_expire_by_event_time(spark, tmp_path):
    path, out = f"{tmp_path}/events", f"{tmp_path}/states"
    hour = 3600

    def run(events):
        _write_events(spark, path, events)
        stream = spark.readStream.schema("scan_id long, status string, ts timestamp").parquet(path)
        states = retention.expiring_states(stream, timedelta(hours=10), delay="1 hour")
        scan_queue.write_changes(states, out, f"{tmp_path}/cp", gone="expired").awaitTermination()
        return {r.scan_id: r.status for r in scan_queue.current_states(spark, out).collect()}

    first = [(1, "pending", 0), (1, "discarded", hour), (2, "discarded", hour), (2, "pending", 2 * hour), (3, "discarded", 9 * hour), (4, "confirmed", 0), (None, "discarded", 0)]
    assert run(first) == {1: "discarded", 2: "pending", 3: "discarded", 4: "confirmed"}
    # The watermark comes to 12 h: the first has been discarded for more than 10; the second moved on in time.
    assert run([(5, "pending", 13 * hour)]) == {1: "expired", 2: "pending", 3: "discarded", 4: "confirmed", 5: "pending"}
    # Late for any scan: dropped.  In time: a scan that expired begins anew.
    assert run([(4, "discarded", 11 * hour), (1, "pending", 13 * hour), (6, "pending", 30 * hour)]) == {1: "pending", 2: "pending", 3: "expired", 4: "confirmed", 5: "pending", 6: "pending"}
    assert scan_queue.current_states(spark, out, gone="expired").count() == 5


class _Handle:
    """Stands in for a stream's state of one bucket, and counts the calls."""

    def __init__(self):
        self.value, self.timers, self.calls = None, set(), 0

    def getValueState(self, name, schema):  # noqa: N802
        return self

    def get(self):
        self.calls += 1
        return self.value

    def update(self, value):
        self.calls += 1
        self.value = value

    def clear(self):
        self.update(None)

    def registerTimer(self, at):  # noqa: N802
        self.calls += 1
        self.timers.add(at)

    def deleteTimer(self, at):  # noqa: N802
        self.calls += 1
        self.timers.remove(at)


def test_states_of_a_bucket_share_their_calls():
    """A thousand scans of a bucket cost no more calls of the state than one, and have one timer."""
    handle = _Handle()
    processor = retention._Expiring(T.StructField("scan_id", T.LongType()), 1000, frozenset(["discarded"]), "gone")
    processor.init(handle)
    second = 1_000_000
    discarded = pd.DataFrame({"scan_id": range(1000), "status": "discarded", "at": [n % 3 * second for n in range(1000)]})
    halves = iter([discarded[:500], discarded[500:]])
    assert len(pd.concat(processor.handleInputRows((0,), halves, TimerValues(0, 0)))) == 1000
    assert handle.calls <= 3 and handle.timers == {1000}
    assert list(processor.handleInputRows((0,), iter([discarded]), TimerValues(0, 0))) == []  # nothing new
    gone = pd.concat(processor.handleExpiredTimer((0,), TimerValues(0, 2500), ExpiredTimerInfo(1000)))
    assert len(gone) == 667 and set(gone.status) == {"gone"} and handle.timers == {1000, 3000}
    moved = pd.DataFrame({"scan_id": range(1000), "status": "pending", "at": 2 * second + 1})
    assert len(pd.concat(processor.handleInputRows((0,), iter([moved]), TimerValues(0, 2500)))) == 1000
    assert handle.timers == {1000} and len(handle.value[0]) == 1000 and handle.value[3] is None


def test_buckets_hold_many_scans_over_batches(spark, tmp_path):
    """Two buckets of many scans, in three runs: scans go one after another, move on and begin anew, as one by one."""
    path, out = f"{tmp_path}/events", f"{tmp_path}/states"
    hour = 3600

    def run(events):
        _write_events(spark, path, events)
        stream = spark.readStream.schema("scan_id long, status string, ts timestamp").parquet(path)
        states = retention.expiring_states(stream, timedelta(hours=10), delay="1 hour", buckets=2)
        scan_queue.write_changes(states, out, f"{tmp_path}/cp", gone="expired").awaitTermination()
        return {r.scan_id: r.status for r in scan_queue.current_states(spark, out).collect()}

    scans = range(60)
    assert run([(i, "discarded", i % 3 * hour) for i in scans]) == dict.fromkeys(scans, "discarded")
    # The watermark comes to 11 h and a half: a third went at 10 h, a third at 11 h; the last third stays till 12 h.
    want = {i: "expired" if i % 3 < 2 else "discarded" for i in scans}
    assert run([(99, "pending", 12 * hour + 1800)]) == want | {99: "pending"}
    # Some that went begin anew, some that stayed move on; the others of the last third go.
    later = {i: "pending" for i in scans if i % 5 == 0}
    want = {i: later.get(i, "expired") for i in scans}
    assert run([(i, "pending", 14 * hour) for i in later]) == want | {99: "pending"}


@pytest.mark.parametrize("status", schemas.SCAN_STATUSES)
def test_statuses(status):
    assert status in ("pending", "confirmed", "discarded")


def test_demo_is_loaded_once(spark):
    from quirespark.operators import catalog
    from quirespark.sources import demo

    once = demo.load(spark)
    twice = demo.load(spark, once)
    counts = {k: df.count() for k, df in once.items()}
    assert counts == {k: df.count() for k, df in twice.items()} == {"record": 26, "author": 7, "publisher": 5, "series": 3, "series_volume": 47}
    assert counts == {k: df.count() for k, df in demo.load(spark, twice, clear=True).items()}
    gaps = catalog.held_and_gaps(once["series"].select("series_pk"), once["series_volume"], "series_pk")
    assert rows(gaps.select("series_pk", "gap_count")) == [(1, 5), (2, 2), (3, 1)]
    assert {r.language for r in once["record"].collect()} == {"heb", "eng", "ger", "yid"}


def test_staging(spark, tmp_path):
    images = spark.createDataFrame([("a.JPG", b"1"), ("b.png", b"2"), ("c.jpg", b"1")], "name string, content binary")
    placed = {r.name: r.image for r in tables.stage_images(images, str(tmp_path)).collect()}
    assert placed["a.JPG"] == placed["c.jpg"] != placed["b.png"] and placed["b.png"].endswith(".png")


def test_requests_of_all_tasks_keep_their_distance(spark, tmp_path):
    """Two partitions, one of whose tasks fails once, after it has asked: no two requests are nearer than the delay."""
    log = tmp_path / "asked"
    log.mkdir()

    def get(base_url, params):
        import os
        import time
        from pathlib import Path

        name = f"{params['query']}-{os.getpid()}-{time.time_ns()}"
        Path(log, name).write_text(str(time.time()))
        return f"<r>{params['query']}</r>"

    asked = spark.createDataFrame([("a", f"q{k}") for k in range(6)], "base_url string, q string").repartition(2)
    asked = asked.select("base_url", F.create_map(F.lit("query"), "q").alias("params"), "q")
    found = sru.fetched(asked, 0.2, get)
    assert rows(found.select("q", "success", "data")) == [(f"q{k}", True, f"<r>q{k}</r>") for k in range(6)]
    found = sru.fetched(asked, 0.2, get)  # all of it again, as after a failure
    found.count()
    times = sorted(float(f.read_text()) for f in log.iterdir())
    assert len(times) == 12 and min(y - x for x, y in zip(times, times[1:], strict=False)) > 0.15


def test_turns():
    now = [0.0]
    line = turns.Turns(lambda: now[0])
    assert [line.take("a", 3), line.take("a", 3), line.take("b", 3)] == [0, 3, 0]
    now[0] = 100.0
    assert [line.take("a", 3), line.take("a", 0.5), line.take("a", 1)] == [0, 3, 3.5]


def test_covers_stop_at_the_first_image(spark, tmp_path):
    log = tmp_path / "fetched"
    log.mkdir()

    def fetch(url):
        import time
        from pathlib import Path

        Path(log, f"{url.replace('/', '_')}-{time.time_ns()}").touch()
        if "bad" in url:
            raise TimeoutError
        return 43 if "blank" in url else 101

    ids = spark.createDataFrame(
        [(1, "ISBN", "good"), (1, "OCLC", "x"), (2, "ISBN", "blank"), (2, "OCLC", "bad"), (2, "LCCN", "z"), (3, "ISBN", "bad"), (4, "ISBN", "had")],
        "record_pk long, identifier_type string, value string",
    )
    records = spark.createDataFrame([(1, ""), (2, ""), (3, ""), (4, "one"), (5, "")], "record_pk long, cover_url string")
    found = sru.first_covers(covers.wanted_covers(records, ids, base_url="b"), fetch, delay=0.05)
    assert rows(found) == rows(found) == [(1, "b/isbn/good-M.jpg"), (2, "b/lccn/z-M.jpg")]
    assert sorted(f.name.split("-M")[0] for f in log.iterdir()) == ["b_isbn_bad", "b_isbn_blank", "b_isbn_good", "b_lccn_z", "b_oclc_bad"]


def test_viaf_requests(spark):
    asked = spark.createDataFrame([("VIAF", "q"), ("LC", "q")], "catalog string, query string")
    found = {r.catalog: r.params for r in sru.requests(asked, sru.endpoints(spark)).collect()}
    assert found["VIAF"] == {"query": "q", "maximumRecords": "10", "recordSchema": "VIAF"}
    assert found["LC"]["operation"] == "searchRetrieve" and found["LC"]["recordSchema"] == "marcxml"


# --- Tables that change together ------------------------------------------------------------------


@pytest.fixture
def shelves(spark, tmp_path, monkeypatch):
    from quirespark.sources import catalogue

    monkeypatch.setattr(catalogue, "BUCKET_ROWS", 10)
    made = catalogue.Catalogue(spark, f"{tmp_path}/catalogue")

    def fill(draft):
        draft.create("record", spark.createDataFrame([(i, f"t{i}", None) for i in range(40)], "record_pk long, title string, note string"), "record_pk")
        draft.create("identifier", spark.createDataFrame([(100 + i, i % 40) for i in range(60)], "pk long, record_pk long"), "pk")
        draft.create("image", spark.createDataFrame([(i, i) for i in range(40)], "pk long, record_pk long"), "pk")
        draft.create("author", spark.createDataFrame([(1, "Ann"), (2, "Bob")], "pk long, name string"), "name", "pk")

    made.change(fill)
    return made


def test_a_delete_is_published_over_all_tables_at_once(spark, shelves):
    ids = spark.createDataFrame([(3,), (39,), (77,)], "id long")
    shelves.delete_records(ids, {"record": "record_pk", "identifier": "record_pk"}, {"image": "record_pk"})
    assert shelves.read("record").count() == 38 and shelves.read("identifier").where("record_pk IN (3, 39)").count() == 0
    assert rows(shelves.read("image").where("record_pk IS NULL").select("pk")) == [(3,), (39,)] and shelves.read("image").count() == 40


def test_a_failure_between_tables_leaves_the_old_state(spark, shelves):
    before = {n: rows(shelves.read(n)) for n in ("record", "identifier", "image", "author")}
    number = shelves.versions.current()[0]

    def fails_midway(draft):
        draft.delete("record", spark.createDataFrame([(1,), (2,)], "id long"))
        assert draft.read("record").count() == 38
        raise RuntimeError("between two tables")

    with pytest.raises(RuntimeError):
        shelves.change(fails_midway)
    assert shelves.versions.current()[0] == number and {n: rows(shelves.read(n)) for n in before} == before


def test_edits_touch_only_their_buckets(spark, shelves):
    folders = shelves.versions.current()[1]["tables"]["record"]["folders"]
    shelves.change(lambda draft: draft.upsert("record", spark.createDataFrame([(5, "new")], "record_pk long, title string")))
    now = shelves.versions.current()[1]["tables"]["record"]["folders"]
    assert sum(a != b for a, b in zip(folders, now, strict=True)) == 1
    assert shelves.read("record").where("record_pk = 5").first().title == "new" and shelves.read("record").count() == 40
    shelves.change(lambda draft: draft.upsert("record", spark.createDataFrame([(500, "added", "n")], "record_pk long, title string, note string")))
    assert shelves.read("record").count() == 41


def test_two_runs_at_once_create_each_name_once(spark, shelves):
    from concurrent.futures import ThreadPoolExecutor

    def run(names):
        incoming = spark.createDataFrame([(n,) for n in names], "name string")
        shelves.change(lambda draft: draft.get_or_create("author", incoming))

    with ThreadPoolExecutor(2) as pool:
        list(pool.map(run, (["Ann", "Cid", "Dot", "Eve"], ["Dot", "Eve", "Fay", ""])))
    found = rows(shelves.read("author").select("name", "pk"))
    assert [n for n, _ in found] == ["Ann", "Bob", "Cid", "Dot", "Eve", "Fay"] and sorted(k for _, k in found) == [1, 2, 3, 4, 5, 6]
    assert shelves.vacuum(0) >= 0 and shelves.read("author").count() == 6


def test_the_cache_is_merged_when_its_tail_is_long(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(response_cache.ResponseCache, "TAIL", 3)
    cache, t = response_cache.ResponseCache(spark, f"{tmp_path}/cache", 4), datetime(2024, 1, 1)
    for k in range(9):
        cache.put(spark.createDataFrame([("same", f"v{k}"), (f"k{k}", "x")], "cache_key string, data string"), t + timedelta(minutes=k))
    cache.invalidate(spark.createDataFrame([("k2",)], "cache_key string"), t + timedelta(hours=1))
    state = cache.versions.current()[1]
    assert len(state["tail"]) <= 3 and cache._log(state).count() <= 10 + 2 * 3 + 1
    want = sorted([("same", "v8"), *((f"k{k}", "x") for k in range(9) if k != 2)])
    assert rows(cache.entries(t + timedelta(hours=2))) == want
    cache.compact(t + timedelta(hours=2))
    assert rows(cache.entries(t + timedelta(hours=2))) == want and cache.versions.current()[1]["tail"] == []
    asked = spark.createDataFrame([("same",), ("k2",), ("new",)], "cache_key string")
    assert rows(cache.misses(asked, t + timedelta(hours=2))) == [("k2",), ("new",)]
    cache.put(spark.createDataFrame([("same", "late")], "cache_key string, data string"), t + timedelta(minutes=8))
    assert ("same", "late") in rows(cache.entries(t + timedelta(hours=2)))  # stored last, at the same time
    assert cache.vacuum(0) >= 0
