"""A thin HTTP adapter: GET / leads to /docs, GET /train runs the pipeline, POST /predict?text= answers with a summary."""

from __future__ import annotations

import logging
from collections.abc import Callable
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs, urlsplit

log = logging.getLogger(__name__)
DOCS = "GET /train runs all stages; POST /predict?text=... returns a summary of the text.\n"
LONGEST = 1 << 20


def server(train: Callable[[], object], predict: Callable[[str], str], host: str = "127.0.0.1", port: int = 8080) -> ThreadingHTTPServer:
    """A server that calls ``train`` and ``predict``; an error in either is logged and answered with status 500."""

    class Handler(BaseHTTPRequestHandler):
        def answer(self, status: int, text: str, **headers: str) -> None:
            body = text.encode()
            self.send_response(status)
            for k, v in {"Content-Type": "text/plain; charset=utf-8", "Content-Length": str(len(body)), **headers}.items():
                self.send_header(k, v)
            self.end_headers()
            self.wfile.write(body)

        def attempt(self, work: Callable[[], str]) -> None:
            try:
                text = work()
            except Exception as e:
                log.exception("%s failed", self.path)
                self.answer(500, f"Error: {type(e).__name__}: {e}\n")
            else:
                self.answer(200, text)

        def do_GET(self) -> None:  # noqa: N802
            at = urlsplit(self.path).path
            if at == "/":
                self.answer(307, "", Location="/docs")
            elif at == "/docs":
                self.answer(200, DOCS)
            elif at == "/train":
                self.attempt(lambda: f"Training successful: {', '.join(train())}\n")
            else:
                self.answer(404, "not found\n")

        def do_POST(self) -> None:  # noqa: N802
            parts = urlsplit(self.path)
            if parts.path != "/predict":
                return self.answer(404, "not found\n")
            size = int(self.headers.get("Content-Length") or 0)
            if size > LONGEST:
                return self.answer(413, "too long\n")
            given = parse_qs(parts.query) | parse_qs(self.rfile.read(size).decode("utf-8", "replace"))
            if "text" not in given:
                return self.answer(422, "text is missing\n")
            return self.attempt(lambda: predict(given["text"][0]))

        def log_message(self, form: str, *args: object) -> None:
            log.debug(form.split("?")[0], *args[:1])

    return ThreadingHTTPServer((host, port), Handler)
