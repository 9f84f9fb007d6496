"""Fetching as a Spark source (S02, S04-S06, X12, X13): requests are dealt by host and answered while they are read.

``frontier`` writes the requests as Parquet, in buckets by a hash of their host; ``pages`` reads them through the Python
data source ``inkstream_web``, a task a file. A task asks for a few addresses at once, each within a deadline; whatever goes
wrong with one is a row with status 0 and its error, and the others are not touched. A filter on ``host``, as a ``site:``
operator gives it, is pushed down: only that host's buckets are listed, and only its rows asked for.

A host's requests share ``SLICES`` buckets, so no more than ``SLICES`` tasks ask it at a time, and a large host is cut.
Files are read in batches, so a task's memory is bounded by a batch's answers.
"""

from __future__ import annotations

import time
import urllib.error
import urllib.request
import zlib
from collections.abc import Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor

import pyarrow as pa
from pyarrow import fs, parquet
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition

from inkstream.functions import keys
from inkstream.session import partitions

#: Buckets that a host's requests may share; requests asked for between two batches of answers; bytes of an answer.
SLICES, BATCH, MOST_BYTES = 4, 64, 16 << 20
#: What requests say of themselves.
HEADERS = {"User-Agent": "Mozilla/5.0 (compatible; inkstream)", "Accept": "text/html,application/xhtml+xml,application/xml;q=0.9,*/*;q=0.8"}
SCHEMA = "url string, host string, status int, body string, error string"


def frontier(requests: DataFrame, path: str, buckets: int | None = None) -> int:
    """Write requests (column url; for ``staged`` answers also status, body and delay_ms) below ``path``; the number of
    buckets, which ``pages`` needs. Without a host there is nobody to ask: such rows go under an empty host."""
    n = buckets or partitions(requests.sparkSession)
    host = F.coalesce(keys.without_www(keys.host("url")), F.lit(""))
    slice_ = F.pmod(F.xxhash64("url"), F.lit(SLICES))
    rows = requests.withColumn("host", host).withColumn("bucket", F.pmod(F.crc32(F.col("host").cast("binary")) + slice_, F.lit(n)).cast("int"))
    rows.repartition(n, "bucket").sortWithinPartitions("bucket", "host", "url").write.partitionBy("bucket").parquet(path)
    return n


def register(spark: SparkSession) -> None:
    spark.dataSource.register(WebSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def pages(spark: SparkSession, path: str, buckets: int, transport: str = "http", deadline: float = 15.0, at_once: int = 2) -> DataFrame:
    """The answers to a frontier's requests: url, host, status, body (null unless the status is 200), error."""
    register(spark)
    options = {"buckets": buckets, "transport": transport, "deadline": deadline, "at_once": at_once}
    return spark.read.format("inkstream_web").options(**options).load(path)


class WebSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "inkstream_web"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> WebReader:
        o = self.options
        return WebReader(o["path"], int(o["buckets"]), o.get("transport", "http"), float(o.get("deadline", 15)), int(o.get("at_once", 2)))


class File(InputPartition):
    def __init__(self, path: str):
        self.path = path


class WebReader(DataSourceReader):
    def __init__(self, path: str, buckets: int, transport: str, deadline: float, at_once: int):
        self.path, self.buckets, self.transport, self.deadline, self.at_once = path, buckets, transport, deadline, at_once
        self.hosts: set[str] | None = None

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Filters that name hosts are this source's; all others stay Spark's."""
        for f in filters:
            if isinstance(f, (EqualTo, In)) and f.attribute == ("host",):
                named = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.hosts = named if self.hosts is None else self.hosts & named
            else:
                yield f

    def partitions(self) -> Sequence[InputPartition]:
        store, root = _store(self.path)
        wanted = range(self.buckets) if self.hosts is None else sorted({(zlib.crc32((h or "").encode()) + s) % self.buckets for h in self.hosts for s in range(SLICES)})
        found = []
        for bucket in wanted:
            listed = store.get_file_info(fs.FileSelector(f"{root}/bucket={bucket}", allow_not_found=True))
            found += [File(x.path) for x in sorted(listed, key=lambda x: x.path) if x.path.endswith(".parquet")]
        return found

    def read(self, partition: File | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # nothing was listed
            return
        store, _ = _store(self.path)
        ask = STAGED if self.transport == "staged" else HTTP
        with ThreadPoolExecutor(self.at_once) as pool, store.open_input_file(partition.path) as raw:
            for batch in parquet.ParquetFile(raw).iter_batches(BATCH):
                rows = [r for r in batch.to_pylist() if self.hosts is None or r["host"] in self.hosts]
                answers = list(pool.map(lambda r: answer(ask, r, self.deadline), rows))
                yield pa.RecordBatch.from_pydict({
                    "url": pa.array([r["url"] for r in rows], pa.string()), "host": pa.array([r["host"] for r in rows], pa.string()), "status": pa.array([a[0] for a in answers], pa.int32()),
                    "body": pa.array([a[1] for a in answers], pa.string()), "error": pa.array([a[2] for a in answers], pa.string()),
                })


def _store(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def answer(ask, request: dict, deadline: float) -> tuple[int, str | None, str | None]:
    """Status, body and error of one request; nothing that it does is an error of the task."""
    try:
        status, body = ask(request, deadline)
    except TimeoutError:
        return 0, None, "timeout"
    except urllib.error.HTTPError as e:
        status, body = e.code, None
    except Exception as e:  # an address that cannot be read, a host that does not answer
        return 0, None, f"network: {type(e).__name__}"
    return status, body if status == 200 else None, None if status == 200 else f"http_{status}"


def HTTP(request: dict, deadline: float) -> tuple[int, str]:
    """One address by GET. The deadline holds for the answer as a whole, not for each of its parts."""
    end = time.monotonic() + deadline
    with urllib.request.urlopen(urllib.request.Request(request["url"], headers=HEADERS), timeout=deadline) as found:
        parts, size = [], 0
        while part := found.read1(1 << 16):
            parts.append(part)
            size += len(part)
            if time.monotonic() > end:
                raise TimeoutError
            if size > MOST_BYTES:
                raise ValueError("the answer is too long")
        return found.status, b"".join(parts).decode(found.headers.get_content_charset() or "utf-8", "replace")


def STAGED(request: dict, deadline: float) -> tuple[int, str | None]:
    """The answer that stands in the request's own row, as a service would give it: after ``delay_ms``, status 0 being a
    broken line."""
    if (request.get("delay_ms") or 0) > 1000 * deadline:
        raise TimeoutError
    if not request.get("status"):
        raise ConnectionError
    return request["status"], request.get("body")
