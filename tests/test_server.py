"""HTTP, accounts, metrics, the model's service, tables in memory, exclusive commits."""

import json
import threading
import urllib.error
import urllib.request
from http.server import BaseHTTPRequestHandler, HTTPServer

import pyarrow as pa
import pytest

from siltstone import nl, server
from siltstone.accounts import Accounts, Identity, Unauthorized, sign, verified
from siltstone.errors import EngineError
from siltstone.fs import Files
from siltstone.plans import ir
from siltstone.session import Session, to_ipc
from siltstone.telemetry import Metrics

SECRET = b"0123456789abcdef0123"


@pytest.fixture
def running(spark, tmp_path):
    api = server.Api(spark, str(tmp_path), SECRET, nl.Canned({"How many": '{"Aggregate":{"input":{"Scan":{"dataset":"t","columns":[],"snapshot_id":""}},"group_by":[],"aggregates":[{"func":"Count","arg":null,"alias":"n"}]}}'}, lambda prompt: "Words."))
    http = server.serve(api, port=0)
    threading.Thread(target=http.serve_forever, daemon=True).start()
    base = f"http://127.0.0.1:{http.server_port}"

    def ask(method, path, body=None, token=""):
        raw = json.dumps(body).encode() if body is not None else None
        request = urllib.request.Request(base + path, raw, {"Authorization": f"Bearer {token}"} if token else {}, method=method)
        try:
            with urllib.request.urlopen(request) as r:
                text = r.read().decode()
                return r.status, json.loads(text) if r.headers["Content-Type"] == "application/json" else text
        except urllib.error.HTTPError as e:
            return e.code, json.loads(e.read())

    yield api, ask
    http.shutdown()


def test_requests(spark, running):
    api, ask = running
    status, found = ask("POST", "/auth/signup", {"email": "A@x.org", "password": "long enough", "workspace": "team"})
    assert status == 201
    token = found["token"]
    assert ask("GET", "/datasets")[0] == ask("POST", "/query", {"dataset": "t", "sql": "x"}, "bad.token.x")[0] == 401
    assert ask("POST", "/auth/login", {"email": "a@x.org", "password": "wrong one"}) == ask("POST", "/auth/login", {"email": "nobody@x.org", "password": "wrong one"})
    assert ask("POST", "/auth/signup", {"email": "a@x.org", "password": "long enough"})[0] == 400
    schema = spark.createDataFrame([], "k string, v long").schema.jsonValue()
    assert ask("POST", "/datasets", {"name": "t", "schema": schema}, token)[0] == 201
    api.session(api.accounts.who(token)).ingest("t", spark.createDataFrame([("a", 1), ("b", 1 << 60)], "k string, v long"))
    assert ask("GET", "/datasets", token=token) == (200, [{"name": "t", "columns": {"k": "string", "v": "bigint"}}])
    status, found = ask("POST", "/query", {"dataset": "t", "sql": "SELECT k, v FROM t ORDER BY k"}, token)
    assert (status, found["rows"], found["cache_hit"]) == (200, [{"k": "a", "v": 1}, {"k": "b", "v": str(1 << 60)}], False)
    assert ask("POST", "/query/nl", {"dataset": "t", "question": "How many?"}, token)[1]["rows"] == [{"n": 2}]
    assert ask("POST", "/explain", {"dataset": "t", "sql": "SELECT k FROM t WHERE v > 5"}, token)[1]["files_before"] >= 1
    assert ask("POST", "/datasets/t/summary", {}, token)[1]["rows"] == 2
    assert "quality" in ask("POST", "/datasets/t/insights", {}, token)[1]
    assert [h["source"] for h in ask("GET", "/history?limit=1", token=token)[1]] == ["nl"]
    assert ask("POST", "/query", {"dataset": "t"}, token)[0] == 400 and ask("POST", "/query", {"dataset": "none", "sql": "SELECT 1"}, token)[0] == 404
    assert ask("GET", "/nothing", token=token)[0] == 404
    # another workspace sees nothing of it; one of the same name is the same
    other = ask("POST", "/auth/signup", {"email": "b@x.org", "password": "long enough"})[1]["token"]
    assert ask("GET", "/datasets", token=other) == (200, []) and ask("POST", "/datasets/t/summary", {}, other)[0] == 404
    same = ask("POST", "/auth/signup", {"email": "c@x.org", "password": "long enough", "workspace": "team"})[1]["token"]
    assert len(ask("GET", "/datasets", token=same)[1]) == 1
    status, text = ask("GET", "/metrics")
    assert status == 200 and 'siltstone_request_total{outcome="success",route="POST /query"}' in text and "siltstone_query_seconds_bucket" in text


def test_tokens():
    token = sign(Identity("u", "w"), SECRET, 1000, 60)
    assert verified(token, SECRET, 1059) == Identity("u", "w")
    none = sign(Identity("u", "w"), SECRET, 1000).split(".")
    for bad, key, now in ((token, SECRET, 1060), (token, b"another secret that is long", 1001), (token[:-2] + "xx", SECRET, 1001), ("a.b", SECRET, 1), ("", SECRET, 1), (f"eyJhbGciOiJub25lIn0.{none[1]}.", SECRET, 1001)):
        with pytest.raises(Unauthorized):
            verified(bad, key, now)


def test_a_short_secret_is_an_error(spark, tmp_path):
    with pytest.raises(EngineError):
        Accounts(spark, str(tmp_path), b"short")


def test_metrics():
    m = Metrics()
    with m.timed("x", kind='a"b'):
        pass
    with pytest.raises(ValueError), m.timed("x", kind="c"):
        raise ValueError
    assert m.value("x_total", kind="c", outcome="error") == 1
    assert 'x_total{kind="a\\"b",outcome="success"} 1' in m.text() and 'x_seconds_bucket{kind="c",le="+Inf"} 1' in m.text()


def test_a_models_service(monkeypatch):
    seen, answers = [], [(503, {}), (200, {"choices": [{"message": {"content": "four"}}], "usage": {"prompt_tokens": 3, "completion_tokens": 1}}), (400, {}), (200, {"choices": []})]

    class Handler(BaseHTTPRequestHandler):
        def do_POST(self):
            seen.append((self.headers["Authorization"], json.loads(self.rfile.read(int(self.headers["Content-Length"])))))
            status, body = answers.pop(0)
            raw = json.dumps(body).encode()
            self.send_response(status)
            self.send_header("Content-Length", str(len(raw)))
            self.end_headers()
            self.wfile.write(raw)

        def log_message(self, *args):
            pass

    http = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=http.serve_forever, daemon=True).start()
    monkeypatch.setenv("SILTSTONE_MODEL_KEY", "key")
    monkeypatch.setenv("SILTSTONE_MODEL_URL", f"http://127.0.0.1:{http.server_port}/v1")
    monkeypatch.setenv("SILTSTONE_MODEL", "m")
    service = nl.ChatService.from_environment()
    assert service.complete("two and two?") == "four"
    assert seen[1] == ("Bearer key", {"model": "m", "messages": [{"role": "user", "content": "two and two?"}], "temperature": 0})
    with pytest.raises(EngineError, match="400"):
        service.complete("x")
    with pytest.raises(EngineError, match="no answer"):
        service.complete("x")
    http.shutdown()
    http.server_close()
    with pytest.raises(EngineError, match="reached"):
        nl.ChatService(service.url, "m", attempts=1).complete("x")


def test_tables_in_memory(spark, tmp_path):
    session = Session(spark, str(tmp_path))
    table = pa.table({"k": ["a", "b", "a"], "v": [1, 2, None]})
    session.register_arrow("x", to_ipc(table))
    assert session.query("x", "SELECT k, COUNT(v) AS n FROM x GROUP BY k ORDER BY k").rows() == [{"k": "a", "n": 1}, {"k": "b", "n": 1}]
    assert session.query_plan(ir.Filter(ir.Scan("x"), ir.Binary(ir.Column("v"), "Gt", ir.literal(1)))).rows() == [{"k": "b", "v": 2}]
    assert session.query("x", "SELECT DISTINCT k FROM x ORDER BY k").rows() == [{"k": "a"}, {"k": "b"}]
    assert session.explain("x", "SELECT k FROM x").files_before == 0
    session.register_arrow("x", table.slice(0, 1))  # not the earlier result from the cache
    assert session.query("x", "SELECT k, COUNT(v) AS n FROM x GROUP BY k ORDER BY k").rows() == [{"k": "a", "n": 1}]


def test_one_of_many_writers_wins(spark, tmp_path):
    files, done = Files(spark), []

    def write(k):
        try:
            files.write_new(f"{tmp_path}/one", str(k).encode())
            done.append(k)
        except EngineError:
            pass

    threads = [threading.Thread(target=write, args=(k,)) for k in range(12)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert len(done) == 1 and files.read(f"{tmp_path}/one") == str(done[0]).encode()
    assert files.names(str(tmp_path)) == ["one"]


def test_parts_of_a_corpus_become_one(spark, tmp_path, monkeypatch):
    from siltstone import corpora

    monkeypatch.setattr(corpora, "MOST_PARTS", 3)
    session = Session(spark, str(tmp_path))
    for rows in ([("a", "one"), ("b", "two")], [("b", "three"), ("c", "four")], [("c", ""), ("a", "five")], [("d", "six")]):
        session.ingest_corpus("k", spark.createDataFrame(rows, "doc_id string, text string"))
        want = {"a": "one", "b": "two"} if len(rows) == 2 and rows[0][0] == "a" else None
        got = {r["doc_id"]: r["text"] for r in session.corpora.chunks("k").collect()}
        assert want is None or got == want
    assert got == {"a": "five", "b": "three", "d": "six"}
    assert len(session.corpora._parts("k")) == 2  # that of the first three, and one
