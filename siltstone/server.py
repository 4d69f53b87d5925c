"""The session's verbs over HTTP with JSON bodies. Every request but signup, login and metrics needs a bearer token, and sees its workspace alone."""

from __future__ import annotations

import json
import logging
from collections.abc import Callable
from dataclasses import asdict
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs, unquote, urlsplit

from pyspark.sql import SparkSession
from pyspark.sql import types as T

from siltstone import nl
from siltstone.accounts import Accounts, Identity, Unauthorized
from siltstone.errors import EngineError, NotFound
from siltstone.session import Result, Session
from siltstone.telemetry import METRICS

log = logging.getLogger(__name__)

#: Bytes of a request's body.
LARGEST = 1 << 20


class Api:
    """Requests to answers, without the transport."""

    def __init__(self, spark: SparkSession, root: str, secret: bytes, provider: nl.Provider | None = None):
        self.spark, self.root, self.provider = spark, root, provider
        self.accounts = Accounts(spark, root, secret)
        self._sessions: dict[str, Session] = {}

    def session(self, who: Identity) -> Session:
        """One for each user, so that what they share is the workspace's data and not their names in its history."""
        key = f"{who.workspace}/{who.user}"
        if key not in self._sessions:
            self._sessions[key] = Session(self.spark, self.root, who.workspace, who.user, self.provider)
        return self._sessions[key]

    def answer(self, method: str, target: str, body: bytes = b"", token: str = "") -> tuple[int, str | dict | list]:
        """Status, and text or what goes as JSON."""
        at = urlsplit(target)
        parts, query = [unquote(p) for p in at.path.strip("/").split("/")], {k: v[-1] for k, v in parse_qs(at.query).items()}
        name = f"{method} /" + "/".join([parts[0], *("{name}" if k == 1 and parts[0] == "datasets" else p for k, p in enumerate(parts[1:], 1))])
        known = self._routes()
        status, found = 500, {"error": "internal error"}
        try:
            with METRICS.timed("siltstone_request", route=name if name in known or name in ("GET /metrics", "POST /auth/signup", "POST /auth/login") else "other"):
                status, found = self._answer(name, known, parts, query, body, token)
        except Unauthorized as e:
            status, found = 401, {"error": str(e)}
        except NotFound as e:
            status, found = 404, {"error": str(e)}
        except (EngineError, KeyError, TypeError, ValueError) as e:
            status, found = 400, {"error": f"the request lacks {e}" if isinstance(e, KeyError) else str(e)}
        except Exception:
            log.exception("%s failed", name)
        return status, found

    def _answer(self, name: str, known: dict, parts: list[str], query: dict, body: bytes, token: str) -> tuple[int, str | dict | list]:
        if name == "GET /metrics":
            return 200, METRICS.text()
        sent = json.loads(body) if body else {}
        if not isinstance(sent, dict):
            raise EngineError("the body must be a JSON object")
        if name == "POST /auth/signup":
            return 201, {"token": self.accounts.signup(sent["email"], sent["password"], sent.get("workspace", ""))}
        if name == "POST /auth/login":
            return 200, {"token": self.accounts.login(sent["email"], sent["password"])}
        session = self.session(self.accounts.who(token))
        if name not in known:
            raise NotFound(f"no {name}")
        return known[name](session, sent, query, parts)

    def _routes(self) -> dict[str, Callable[[Session, dict, dict, list[str]], tuple[int, dict | list]]]:
        return {
            "POST /query": lambda s, b, q, p: (200, _rows(s.query_plan(json.dumps(b["plan"])) if "plan" in b else s.query(b["dataset"], b["sql"]))),
            "POST /query/nl": lambda s, b, q, p: (200, _rows(s.query_nl(b["dataset"], b["question"], bool(b.get("narrate"))))),
            "POST /explain": lambda s, b, q, p: (200, asdict(s.explain(b["dataset"], b["sql"]))),
            "POST /datasets": lambda s, b, q, p: (201, _dataset(s.create_dataset(b["name"], T.StructType.fromJson(b["schema"])))),
            "GET /datasets": lambda s, b, q, p: (200, [_dataset(d) for d in s.datasets()]),
            "POST /datasets/{name}/summary": lambda s, b, q, p: (200, s.summary(p[1]).to_dict()),
            "POST /datasets/{name}/insights": lambda s, b, q, p: (200, s.insights(p[1])),
            "POST /research": lambda s, b, q, p: (200, asdict(s.research(b["dataset"], b["question"], b.get("corpus", "")))),
            "GET /history": lambda s, b, q, p: (200, s.history(int(q.get("limit", 100)))),
        }


def _rows(r: Result) -> dict:
    return {"columns": r.table.column_names, "rows": r.json_rows(), "cache_hit": r.cache_hit, "narration": r.narration}


def _dataset(d) -> dict:  # noqa: ANN001
    return {"name": d.name, "columns": {f.name: f.dataType.simpleString() for f in d.schema}}


def serve(api: Api, host: str = "127.0.0.1", port: int = 8080) -> ThreadingHTTPServer:
    """A server that is bound but not yet running: serve_forever() runs it, shutdown() ends that."""

    class Handler(BaseHTTPRequestHandler):
        def _do(self) -> None:
            size = int(self.headers.get("Content-Length") or 0)
            if size > LARGEST:
                status, found = 413, {"error": "the body is too large"}
            else:
                kind, _, token = self.headers.get("Authorization", "").partition(" ")
                status, found = api.answer(self.command, self.path, self.rfile.read(size), token if kind.lower() == "bearer" else "")
            raw = found.encode() if isinstance(found, str) else json.dumps(found, default=str).encode()
            self.send_response(status)
            self.send_header("Content-Type", "text/plain; version=0.0.4" if isinstance(found, str) else "application/json")
            self.send_header("Content-Length", str(len(raw)))
            self.end_headers()
            self.wfile.write(raw)

        do_GET = do_POST = _do

        def log_message(self, *args: object) -> None:
            log.debug(*args)

    return ThreadingHTTPServer((host, port), Handler)
