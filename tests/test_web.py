"""The fetching source: hosts, deadlines, errors as rows, filters that reach it; and a real server."""

import http.server
import threading
import time

import pytest

from inkstream.sources import web


def requests(spark, rows):
    return spark.createDataFrame(rows, "url string, status int, body string, delay_ms int")


def test_errors_are_rows(spark, tmp_path):
    rows = [("https://www.a.com/1", 200, "one", 0), ("https://a.com/2", 404, "gone", 0), ("https://b.com/1", 0, None, 0), ("https://b.com/2", 200, "late", 5000), ("no url", 200, "x", 0), (None, 200, "y", None)]
    n = web.frontier(requests(spark, rows), f"{tmp_path}/f", 3)
    got = {r["url"]: tuple(r)[1:] for r in web.pages(spark, f"{tmp_path}/f", n, "staged", 1.0).collect()}
    assert got == {
        "https://www.a.com/1": ("a.com", 200, "one", None), "https://a.com/2": ("a.com", 404, None, "http_404"), "https://b.com/1": ("b.com", 0, None, "network: ConnectionError"),
        "https://b.com/2": ("b.com", 0, None, "timeout"), "no url": ("", 200, "x", None), None: ("", 200, "y", None),
    }


def test_hosts_reach_the_source(spark, tmp_path):
    """A filter on hosts lists their buckets alone and leaves nothing of it to Spark; others stay with Spark."""
    rows = [(f"https://h{i % 40}.com/{i}", 200, str(i), 0) for i in range(800)]
    n = web.frontier(requests(spark, rows), f"{tmp_path}/f", 64)
    reader = web.WebReader(f"{tmp_path}/f", n, "staged", 1.0, 2)
    whole = len(reader.partitions())
    rest = list(reader.pushFilters([web.EqualTo(("host",), "h7.com"), web.EqualTo(("status",), 200)]))
    assert [f.attribute for f in rest] == [("status",)] and 0 < len(reader.partitions()) <= web.SLICES < whole
    some = web.pages(spark, f"{tmp_path}/f", n, "staged").where("host IN ('h7.com', 'h8.com') AND status = 200")
    assert sorted(int(r["body"]) for r in some.collect()) == [i for i in range(800) if i % 40 in (7, 8)]
    assert web.pages(spark, f"{tmp_path}/f", n, "staged").where("host = 'nobody.com'").count() == 0
    assert web.pages(spark, f"{tmp_path}/f", n, "staged").count() == 800


@pytest.fixture
def server():
    class Answers(http.server.BaseHTTPRequestHandler):
        now = most = 0
        lock = threading.Lock()

        def do_GET(self):
            cls = type(self)
            with cls.lock:
                cls.now += 1
                cls.most = max(cls.most, cls.now)
            try:
                if self.path == "/slow":
                    self.send_response(200)
                    self.end_headers()
                    for _ in range(40):
                        self.wfile.write(b"x")
                        self.wfile.flush()
                        time.sleep(0.1)
                    return
                time.sleep(0.05)
                self.send_response(403 if self.path == "/no" else 200)
                self.end_headers()
                self.wfile.write(f"<p>{self.path} ü</p>".encode())
            except OSError:
                pass  # the client went away
            finally:
                with cls.lock:
                    cls.now -= 1

        def log_message(self, *_):
            pass

    s = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Answers)
    threading.Thread(target=s.serve_forever, daemon=True).start()
    yield s, Answers
    s.shutdown()


def test_a_real_server(spark, tmp_path, server):
    """Answers, refusals, an answer that trickles past the deadline, a port where nobody listens; never more at once than
    allowed."""
    s, answers = server
    base = f"http://127.0.0.1:{s.server_port}"
    rows = [(f"{base}/{p}", None, None, None) for p in ("no", "slow", *map(str, range(12)))] + [("http://127.0.0.1:9/x", None, None, None)]
    n = web.frontier(requests(spark, rows), f"{tmp_path}/f", 1)
    began = time.monotonic()
    got = {r["url"].removeprefix(base): (r["status"], r["body"], r["error"]) for r in web.pages(spark, f"{tmp_path}/f", n, "http", deadline=1.0, at_once=2).collect()}
    assert got.pop("/no") == (403, None, "http_403") and got.pop("/slow") == (0, None, "timeout")
    assert got.pop("http://127.0.0.1:9/x")[0] == 0
    assert got == {f"/{i}": (200, f"<p>/{i} ü</p>", None) for i in range(12)}
    assert answers.most <= 2 and time.monotonic() - began < 30


def test_one_bad_row_stops_nothing():
    assert web.answer(web.HTTP, {"url": "nonsense"}, 1.0)[0] == 0
    assert web.answer(web.STAGED, {"status": 500, "body": "b"}, 1.0) == (500, None, "http_500")
