"""Paged and scrolled reading from a server in this process."""

import json
import threading
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs, urlsplit

import pytest

from termloom.sources import pages


class Handler(BaseHTTPRequestHandler):
    def log_message(self, *args):
        pass

    def answer(self, found, code=200):
        self.send_response(code)
        self.end_headers()
        self.wfile.write(json.dumps(found).encode())

    def do_GET(self):
        at = urlsplit(self.path)
        asked = {k: v[0] for k, v in parse_qs(at.query).items()}
        total, sn, ln = int(asked["total"]), int(asked["sn"]), int(asked["ln"])
        self.server.seen.append((sn, ln))
        if at.path == "/gone":
            return self.answer({}, 404)
        if at.path == "/busy" and len(self.server.seen) % 2:
            return self.answer({}, 503)
        if at.path == "/locked" and self.headers.get("Authorization") != "Basic YTpi":
            return self.answer({}, 401)
        rows = [{"ID": str(i), "NAME": f"노트북 {i}", "N": i} | ({} if i % 2 else {"ODD": None}) for i in range(sn, min(sn + ln, total + 1))]
        if at.path == "/short":
            rows = rows[:5]
        return self.answer({"total_count": total, "fieldname_list": ["ID", "NAME", "N", "ODD"], "result": rows})

    def do_POST(self):
        body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
        if self.path.startswith("/_search/scroll"):
            key = body["scroll_id"]
        else:
            cut = body.get("slice", {"id": 0, "max": 1})
            key = f"{cut['id']}-{len(self.server.scrolls)}"
            least = body["query"].get("range", {}).get("n", {}).get("gte", 0)
            self.server.scrolls[key] = [{"_id": str(i), "_source": {"n": i}} for i in range(least, 25) if i % cut["max"] == cut["id"]], body["size"]
        left, size = self.server.scrolls[key]
        self.server.scrolls[key] = left[size:], size
        self.answer({"_scroll_id": key, "hits": {"hits": left[:size]}})

    def do_DELETE(self):
        self.server.ended.append(json.loads(self.rfile.read(int(self.headers["Content-Length"])))["scroll_id"])
        self.answer({})


@pytest.fixture
def server():
    served = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    served.seen, served.scrolls, served.ended = [], {}, []
    threading.Thread(target=served.serve_forever, daemon=True).start()
    served.url = f"http://127.0.0.1:{served.server_port}"
    yield served
    served.shutdown()


def test_every_row_is_read(spark, server):
    for total, tasks in ((25, 3), (11, 2), (10, 1), (0, 1)):
        df = pages.read_pages(spark, f"{server.url}/list?total={total}", 0, 3)
        rows = df.collect()
        assert df.columns == ["ID", "NAME", "N", "ODD"]
        assert sorted(int(r.ID) for r in rows) == list(range(1, total + 1))
        assert {(r.NAME, r.N, r.ODD) for r in rows} == {(f"노트북 {i}", str(i), None) for i in range(1, total + 1)}
        assert df.rdd.getNumPartitions() == tasks
    assert {ln for _, ln in server.seen} == {10} and min(sn for sn, _ in server.seen) == 1


def test_start_and_runs_of_pages(spark, server, monkeypatch):
    assert pages.read_pages(spark, f"{server.url}/list?total=45", 21, 10).count() == 25
    monkeypatch.setattr(pages, "MOST_TASKS", 2)
    reader = pages.PagedReader(pages.StructType(), {"url": f"{server.url}/list?total=45", "length": 10})
    assert reader.partitions() == [pages.Run(1, 21), pages.Run(31, 41)]


def test_errors_are_tried_again_and_never_passed_over(spark, server):
    busy = pages.PagedReader(pages.PagedJson({"url": f"{server.url}/busy?total=12"}).schema(), {"url": f"{server.url}/busy?total=12", "length": 10})
    assert sum(len(list(busy.read(p))) for p in busy.partitions()) == 12
    short = pages.PagedReader(pages.StructType(), {"url": f"{server.url}/short?total=12"})
    with pytest.raises(ValueError, match="5 rows of 12"):
        list(short.read(pages.Run(1, 1)))
    gone = pages.PagedReader(pages.StructType(), {"url": f"{server.url}/gone?total=12"})
    server.seen.clear()
    with pytest.raises(OSError):
        gone.partitions()
    assert len(server.seen) == 1
    assert pages.read_pages(spark, f"{server.url}/locked?total=3", user="a", password="b").count() == 3


def test_scroll(spark, server):
    for slices in (1, 2):
        df = pages.scan_remote(spark, f"{server.url}/names", {"range": {"n": {"gte": 3}}}, slices, size=4)
        assert sorted((int(r._id), json.loads(r._source)["n"]) for r in df.collect()) == [(i, i) for i in range(3, 25)]
        assert df.rdd.getNumPartitions() == slices
    assert len(server.ended) >= 3
