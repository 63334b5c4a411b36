import json

import pytest

from docloom.sources import feed


def page(path, k, items):
    (path / f"{k}.json").write_text(json.dumps(items))
    (path / "latest.json").write_text(json.dumps({"pages": k + 1}))


def test_two_polls_and_crashes_between(spark, tmp_path, monkeypatch):
    url = tmp_path / "feed"
    url.mkdir()
    (url / "latest.json").write_text('{"pages": 0}')
    out, state = str(tmp_path / "out"), str(tmp_path / "state")
    told = lambda: json.loads((url / "acknowledged.json").read_text())["pages"] if (url / "acknowledged.json").exists() else 0
    got = lambda: sorted(json.loads(r["item"])["id"] for r in feed.poll(spark, str(url), out, state, feed.FolderFeed).collect())
    page(url, 0, [{"id": 1}, {"id": 2}])
    page(url, 1, [])
    page(url, 2, [{"id": 3, "text": "é"}])
    assert got() == [1, 2, 3] and told() == 3
    assert got() == [1, 2, 3] and told() == 3  # nothing new
    page(url, 3, [{"id": 4}])
    with monkeypatch.context() as m:  # written, but the poll dies before it acknowledges
        m.setattr(feed.FeedReader, "commit", lambda self, end: (_ for _ in ()).throw(OSError("gone")))
        with pytest.raises(OSError, match="gone"):
            got()
    assert told() == 3
    assert got() == [1, 2, 3, 4] and told() == 4
    page(url, 4, [{"id": 5}])
    (url / "4.json").rename(url / "kept")  # the source fails while a batch is read
    with pytest.raises(Exception, match="4.json"):
        got()
    (url / "kept").rename(url / "4.json")
    assert got() == [1, 2, 3, 4, 5] and told() == 5


def test_http_feed(spark, tmp_path):
    import threading
    from http.server import BaseHTTPRequestHandler, HTTPServer

    pages, told = {"/d/latest.json": '{"pages": 2}', "/d/0.json": '[{"id": 1}]', "/d/1.json": '[{"id": 2}, {"id": 3}]'}, []

    class Handler(BaseHTTPRequestHandler):
        def do_GET(self):
            ok = self.headers["Authorization"] == "Bearer t"
            self.send_response(200 if ok else 401)
            self.end_headers()
            self.wfile.write(pages[self.path].encode() if ok else b"")

        def do_PUT(self):
            told.append((self.path, json.loads(self.rfile.read(int(self.headers["Content-Length"])))))
            self.send_response(204)
            self.end_headers()

        def log_message(self, *a):
            pass

    server = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    try:
        got = feed.poll(spark, f"http://127.0.0.1:{server.server_port}/d", str(tmp_path / "out"), str(tmp_path / "state"), auth_header="Bearer t").collect()
    finally:
        server.shutdown()
    assert sorted((r["page"], json.loads(r["item"])["id"]) for r in got) == [(0, 1), (1, 2), (1, 3)]
    assert told[-1] == ("/d/acknowledged.json", {"pages": 2})
