import threading
import urllib.error
import urllib.parse
import urllib.request

import pytest

from tessera.operators.summarizers import Lead
from tessera.plans import pipeline, serve


class Stay(urllib.request.HTTPRedirectHandler):
    def redirect_request(self, *args):
        return None


@pytest.fixture
def ask(spark):
    fails = []

    def train():
        if fails:
            raise OSError("disk full")
        fails.append(1)
        return ["a", "b"]

    s = serve.server(train, lambda text: pipeline.predict(spark, text, Lead(1)), port=0)
    threading.Thread(target=s.serve_forever, daemon=True).start()

    def call(path, data=None):
        try:
            with urllib.request.build_opener(Stay).open(f"http://127.0.0.1:{s.server_port}{path}", data) as r:
                return r.status, r.read().decode()
        except urllib.error.HTTPError as e:
            return e.code, e.headers.get("Location") or e.read().decode()

    yield call
    s.shutdown()


def test_routes(ask):
    assert ask("/") == (307, "/docs")
    assert ask("/docs")[0] == 200 and ask("/other")[0] == 404 and ask("/other", b"")[0] == 404
    assert ask("/train") == (200, "Training successful: a, b\n")
    assert ask("/train") == (500, "Error: OSError: disk full\n")
    assert ask(f"/predict?text={urllib.parse.quote('é one\ntwo')}", b"") == (200, "é one")
    assert ask("/predict", b"") == (422, "text is missing\n")
