"""Paged feeds as a stream against a local server; broken answers."""

import gzip
import http.server
import json
import threading

import pytest

from tallyworks.sources import http as H

FEEDS: dict[str, list[int]] = {}
BODIES: dict[str, bytes] = {}


@pytest.fixture
def base():
    class Answer(http.server.BaseHTTPRequestHandler):
        def do_GET(self):
            name, _, page = self.path.strip("/").partition("/")
            if name in BODIES:
                body = BODIES[name]
            elif name in FEEDS and not (name == "broken" and page == "2"):
                at = (int(page) - 1) * 3
                body = json.dumps({"meta": {"total": len(FEEDS[name])}, "items": FEEDS[name][at : at + 3]}).encode()
            else:
                self.send_error(404)
                return
            self.send_response(200)
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *_):
            pass

    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Answer)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}"
    server.shutdown()


def drained(spark, base, tmp_path, names, **options):
    H.register(spark)
    urls = " ".join(f"{base}/{n}/{{page}}" for n in names)
    stream = spark.readStream.format("http_pages").options(urls=urls, field="items", count="meta.total", perPage="3", **options).load()
    query = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).start()
    try:
        query.processAllAvailable()
    finally:
        query.stop()
    return sorted((r.url.split("/")[3], r.page, json.loads(r.value) if r.value else None, (r.error or "").split(":")[0]) for r in spark.read.parquet(str(tmp_path / "out")).collect())


def test_pages_come_once_over_triggers_and_restarts(spark, base, tmp_path):
    FEEDS.update(a=[1, 2, 3, 4], b=[], broken=[1, 2, 3, 4, 5])
    first = drained(spark, base, tmp_path, ["a", "b", "broken", "gone"])
    assert first == [("a", 1, 1, ""), ("a", 1, 2, ""), ("a", 1, 3, ""), ("a", 2, 4, ""), ("broken", 1, 1, ""), ("broken", 1, 2, ""), ("broken", 1, 3, ""), ("broken", 2, None, "HTTPError")]
    FEEDS["a"] += [5, 6, 7]
    FEEDS["b"] += [9]
    again = drained(spark, base, tmp_path, ["a", "b", "broken", "gone"])
    assert again == sorted([*first, ("a", 2, 5, ""), ("a", 2, 6, ""), ("a", 3, 7, ""), ("b", 1, 9, "")])


def test_limits_of_a_feed_and_of_a_harvest(spark, base, tmp_path):
    FEEDS.update(c=[1, 2, 3, 4, 5])
    assert drained(spark, base, tmp_path, ["c"], maxItems="4") == [("c", 1, 1, ""), ("c", 1, 2, ""), ("c", 1, 3, ""), ("c", 2, 4, "")]
    late = H.PagePartition(f"{base}/c/{{page}}", 1, 0, 3, 0.0)
    assert [r[3].split(":")[0] for r in H._Pages({"urls": "x"}).read(late)] == ["TimeoutError"]


def test_broken_answers_are_skipped_or_named(spark, base, monkeypatch):
    H.register(spark)
    packed = gzip.compress(json.dumps({"hits": [1, 2]}).encode() * 200)
    BODIES.update(whole=gzip.compress(b'{"hits": [1, 2]}'), half=packed[: len(packed) // 2], list=b"[1]", text=gzip.compress(b"<rss/>"), halftext=packed[:-9])
    urls = " ".join(f"{base}/{n}" for n in ("whole", "half", "list", "gone"))
    assert [r.value for r in spark.read.format("http_json").option("urls", urls).option("field", "hits").load().collect()] == ["1", "2"]
    rows = {r.url.rsplit("/", 1)[1]: r for r in spark.read.format("http_text").option("urls", f"{base}/text {base}/halftext").load().collect()}
    assert (rows["text"].value, rows["text"].truncated) == ("<rss/>", False) and rows["halftext"].truncated and rows["halftext"].value.startswith('{"hits"')
    assert H.fetch(f"{base}/list", max_bytes=2) == (b"[1", True)
