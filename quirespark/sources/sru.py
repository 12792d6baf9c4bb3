"""SRU catalogues as a Spark data source; stored answers may take a catalogue's place.

The option ``queries`` is for the queries of one cataloguer, a list that the driver holds anyway; for a table of
them ``requests`` and ``replayed`` join requests with answers.
``spark.read.format("sru").options(base_url=..., queries=json)`` gives a row ``query, success, data,
error`` for each query: what goes wrong is data, never an exception, so that one catalogue's failure
doesn't stop another's job.
"""

from __future__ import annotations

import json
import math
import os
import time
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from quirespark.durable import written
from quirespark.functions.text import cache_key, quote_cql_values
from quirespark.shipping import ship

from .turns import Queue, serve

TIMEOUT, DELAY = 30.0, 3.0
RESULT = "query string, success boolean, data string, error string"
#: Catalogues with their addresses, protocol versions and whether values must be quoted.
ENDPOINTS = (
    ("NLI", "https://nli.alma.exlibrisgroup.com/view/sru/972NNL_INST", "1.2", True, "marcxml", 20),
    ("LC", "http://lx2.loc.gov:210/LCDB", "1.1", False, "marcxml", 20),
    ("DNB", "https://services.dnb.de/sru/dnb", "1.1", False, "MARC21-xml", 20),
    ("VIAF", "https://viaf.org/viaf/search", "", False, "VIAF", 10),
)
#: What requests say of themselves.
HEADERS = {"Accept": "application/xml", "User-Agent": "quirespark (library catalogue; gentle)"}


def endpoints(spark: SparkSession) -> DataFrame:
    """``catalog, base_url, version, quotes, record_schema, max_records``; addresses may be set in
    ``SRU_<catalog>_URL``."""
    rows = [(name, os.environ.get(f"SRU_{name}_URL", url), *rest) for name, url, *rest in ENDPOINTS]
    return spark.createDataFrame(rows, "catalog string, base_url string, version string, quotes boolean, record_schema string, max_records int")


def parameters(query: Column, version: Column | str = "1.1", max_records: Column | int = 20, record_schema: Column | str = "marcxml") -> Column:
    """The parameters of a request, as a map; a catalogue without a version, VIAF, gets neither version nor operation."""
    as_column = lambda x: x if isinstance(x, Column) else F.lit(x)
    every = F.create_map(
        F.lit("operation"), F.lit("searchRetrieve"), F.lit("version"), as_column(version), F.lit("query"), query,
        F.lit("maximumRecords"), as_column(max_records).cast("string"), F.lit("recordSchema"), as_column(record_schema),
    )
    return F.when(as_column(version) != "", every).otherwise(F.map_filter(every, lambda k, _: ~k.isin("operation", "version")))


def requests(queries: DataFrame, catalogs: DataFrame) -> DataFrame:
    """``queries`` (catalog, query, ...) with ``base_url, params`` and ``cache_key``."""
    joined = queries.join(F.broadcast(catalogs), "catalog")  # a row for each catalogue
    query = F.when(F.col("quotes"), quote_cql_values(F.col("query"))).otherwise(F.col("query"))
    params = parameters(query, F.col("version"), F.col("max_records"), F.col("record_schema"))
    return joined.select(*queries.columns, "base_url", params.alias("params")).withColumn("cache_key", cache_key(F.col("base_url"), F.col("params")))


def outcome(get: Callable[[], str]) -> tuple[bool, str, str]:
    """(success, data, error) of a request."""
    try:
        text = get()
    except TimeoutError:
        return False, "", f"Request timed out after {TIMEOUT:g}s"
    except urllib.error.HTTPError as error:
        return False, "", f"HTTP {error.code}: {error.reason}"
    except (urllib.error.URLError, OSError) as error:
        if isinstance(getattr(error, "reason", None), TimeoutError):
            return False, "", f"Request timed out after {TIMEOUT:g}s"
        return False, "", f"HTTP error: {error}"
    if not text.strip().startswith("<"):
        return False, "", "Response does not appear to be XML"
    return True, text, ""


def http_text(base_url: str, params: dict[str, str], timeout: float = TIMEOUT) -> str:
    """What an address answers."""
    asked = urllib.request.Request(f"{base_url}?{urllib.parse.urlencode(params)}", headers=HEADERS)
    with urllib.request.urlopen(asked, timeout=timeout) as reply:
        return reply.read().decode("utf-8", "replace")


def fetched(requested: DataFrame, delay: float | None = None, get: Callable[[str, dict[str, str]], str] = http_text) -> DataFrame:
    """A table of requests (see ``requests``) with ``success, data, error`` of each answer.

    Requests are asked where they are, by however many tasks; for each address they take turns, ``delay``
    seconds apart (by default ``SRU_REQUEST_DELAY`` or 3).  Answers are written down, so that nothing that
    follows asks again.  What goes wrong is data, so that one catalogue's failure doesn't stop another's job.
    """
    spark = requested.sparkSession
    delay = float(os.environ.get("SRU_REQUEST_DELAY", DELAY)) if delay is None else delay
    at = serve(spark) if delay > 0 else None
    names = ["success", "data", "error"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turns = None
        for batch in batches:
            for k in range(batch.num_rows):
                one = batch.slice(k, 1)
                base_url, params = one.column("base_url")[0].as_py(), dict(one.column("params")[0].as_py() or [])
                if at:
                    turns = turns or Queue(at)
                    turns.wait(base_url, delay)
                answer = outcome(lambda u=base_url, p=params: get(u, p))
                yield pa.RecordBatch.from_arrays([*one.columns, *(pa.array([x]) for x in answer)], names=[*one.schema.names, *names])

    ship(spark)
    kinds = (T.BooleanType(), T.StringType(), T.StringType())
    schema = T.StructType([*requested.schema.fields, *(T.StructField(n, k) for n, k in zip(names, kinds, strict=True))])
    return written(requested.mapInArrow(run, schema), "answers")


_LAST: dict[str, float] = {}


def wait(base_url: str, delay: float, now: Callable[[], float] = time.monotonic, sleep: Callable[[float], None] = time.sleep) -> None:
    """Wait until ``delay`` seconds have gone by since this process last asked at the address."""
    left = _LAST.get(base_url, -math.inf) + delay - now()
    if left > 0:
        sleep(left)
    _LAST[base_url] = now()


class _One(InputPartition):
    def __init__(self, queries: list[str], sharing: int):
        self.queries, self.sharing = queries, sharing


class SruReader(DataSourceReader):
    def __init__(self, options: dict):
        self.options = dict(options)

    def partitions(self) -> list[InputPartition]:
        """One, unless ``partitions`` asks for more: these then take turns, each waiting as many times longer."""
        queries = json.loads(self.options.get("queries", "[]"))
        n = max(1, min(len(queries), int(self.options.get("partitions", "1"))))
        return [_One(queries[k::n], n) for k in range(n)]

    def _get(self, query: str, sharing: int = 1) -> str:
        o = self.options
        if "answers" in o:  # stored ones, by query, instead of a catalogue
            answers = json.loads(o["answers"])
            if query not in answers:
                raise urllib.error.URLError("no stored answer")
            return answers[query]
        wait(o["base_url"], sharing * float(o.get("delay", os.environ.get("SRU_REQUEST_DELAY", DELAY))))
        params = {"query": query, "maximumRecords": o.get("max_records", "20"), "recordSchema": o.get("record_schema", "marcxml")}
        if version := o.get("version", "1.1"):
            params = {"operation": "searchRetrieve", "version": version} | params
        return http_text(o["base_url"], params, float(o.get("timeout", TIMEOUT)))

    def read(self, partition: _One) -> Iterator[tuple]:
        for query in partition.queries:
            yield (query, *outcome(lambda q=query: self._get(q, partition.sharing)))


class SruSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "sru"

    def schema(self) -> str:
        return RESULT

    def reader(self, schema) -> SruReader:
        return SruReader(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(SruSource)


def replayed(requested: DataFrame, answers: DataFrame) -> DataFrame:
    """Requests (see ``requests``) with stored answers (``cache_key, data``); one without an answer failed.

    Answers are judged where they are, so that their texts are shuffled only if what follows uses them; and they
    are merged, as a plan takes texts that it makes for far shorter than they are and would broadcast them all.
    """
    judged = answers.select("cache_key", "data", F.coalesce(F.ltrim("data").startswith("<"), F.lit(False)).alias("__good"), F.col("data").isNotNull().alias("__held"))
    joined = requested.join(judged.hint("merge"), "cache_key", "left")
    good = F.coalesce("__good", F.lit(False))
    error = F.when(~F.coalesce("__held", F.lit(False)), "HTTP error: no stored answer").when(~good, "Response does not appear to be XML").otherwise("")
    return joined.select(*requested.columns, good.alias("success"), F.when(good, F.col("data")).otherwise("").alias("data"), error.alias("error"))


#: Bytes from which on an image isn't a blank; no more are read.
LEAST_BYTES = 100


def http_size(url: str, timeout: float = 5.0) -> int:
    """How many bytes the address answers with, of those that tell an image from a blank."""
    with urllib.request.urlopen(urllib.request.Request(url, headers={"User-Agent": HEADERS["User-Agent"]}), timeout=timeout) as reply:
        return len(reply.read(LEAST_BYTES + 1))


def cover_sizes(candidates: DataFrame, fetch: Callable[[str], int] = http_size) -> DataFrame:
    """``url, body_size`` of candidates' images, by ``fetch``, which gives the number of bytes; failures are 0.

    Sizes are written down, so that nothing that follows asks again.
    """

    @F.pandas_udf("long")
    def size(urls):
        return urls.map(lambda url: _size(url, fetch)).astype("int64")

    ship(candidates.sparkSession)
    return written(candidates.select("url").distinct().withColumn("body_size", size("url")), "sizes")


def _size(url: str, fetch: Callable[[str], int]) -> int:
    try:
        return int(fetch(url))
    except Exception:  # a source's failure is data here
        return 0


def first_covers(candidates: DataFrame, fetch: Callable[[str], int] = http_size, delay: float = 0.5, record: str = "record_pk") -> DataFrame:
    """``record, cover_url``: of each record's candidates (``record, priority, url``) the first whose image is
    large enough; later ones are asked only where earlier ones failed.

    All tasks together begin a record every ``delay`` seconds.  Answers are written down.
    """
    spark = candidates.sparkSession
    at = serve(spark) if delay > 0 else None
    ranked = F.transform(F.array_sort(F.collect_list(F.struct("priority", "url"))), lambda c: c["url"])
    asked = candidates.groupBy(record).agg(ranked.alias("__urls"))  # three of a record at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turns = None
        for batch in batches:
            found = []
            for urls in batch.column("__urls"):
                if at:
                    turns = turns or Queue(at)
                    turns.wait("covers", delay)
                found.append(next((url for url in urls.as_py() if _size(url, fetch) >= LEAST_BYTES), None))
            yield pa.RecordBatch.from_arrays([batch.column(record), pa.array(found, pa.string())], names=[record, "cover_url"])

    ship(spark)
    schema = T.StructType([asked.schema[record], T.StructField("cover_url", T.StringType())])
    return written(asked.mapInArrow(run, schema), "covers").where("cover_url IS NOT NULL")
