"""Model calls over HTTP against a stub service, and the memo."""

from __future__ import annotations

import json
import threading
import time
from collections import Counter
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest
from pyspark.sql import functions as F

from lorespark import http_chat
from lorespark.operators.memo import ask_once, memo_table
from lorespark.plans import study
from lorespark.providers import Answer, messages


@pytest.fixture
def service():
    """Answers with the user's message reversed; ``fail`` says how many times a message is refused first, and how."""
    seen, fail, lock = [], {}, threading.Lock()

    class Handler(BaseHTTPRequestHandler):
        def do_POST(self):
            asked = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            if self.path.endswith("/embeddings"):
                self.send_response(200)
                self.end_headers()
                self.wfile.write(json.dumps({"data": [{"index": i, "embedding": [len(t), float(asked["model"] == "m")]} for i, t in enumerate(asked["input"])][::-1]}).encode())
                return
            said = asked["messages"][-1]["content"].strip("#")
            with lock:
                seen.append((said, asked["model"], self.headers.get("Authorization"), time.monotonic()))
                code = fail.get(said, []).pop(0) if fail.get(said) else 200
            self.send_response(code)
            if code == 429:
                self.send_header("Retry-After", "0.3")
            self.end_headers()
            if code == 200:
                self.wfile.write(json.dumps({"choices": [{"message": {"content": said[::-1]}}], "usage": {"total_tokens": 7}}).encode() if said != "odd" else b"no json")

        def log_message(self, *_):
            pass

    server = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_address[1]}/v1", seen, fail
    server.shutdown()


def one(text):
    return [{"role": "user", "content": text}]


def test_client_tries_again_and_gives_up(service):
    url, seen, fail = service
    chat = http_chat.HttpChat("openai", "key", url, rate=1000, burst=50, tries=3, pause=0.01)
    assert chat(one("abc"), "m", 5, 0.1) == Answer(True, "cba", 7) and seen[-1][2] == "Bearer key"
    fail["wait"] = [429]
    assert chat(one("wait"), "m", 5, 0.1).text == "tiaw" and seen[-1][3] - seen[-2][3] >= 0.3
    fail["down"] = [503, 500, 503]
    assert chat(one("down"), "m", 5, 0.1) == Answer(False, None, 0, "HTTP 503")
    fail["no"] = [401]
    assert chat(one("no"), "m", 5, 0.1).error == "HTTP 401" and sum(s[0] == "no" for s in seen) == 1
    assert "JSONDecodeError" in chat(one("odd"), "m", 5, 0.1).error
    assert not http_chat.HttpChat("openai", "k", "http://127.0.0.1:9", tries=1)(one("x"), "m", 1, 0.0).ok


def test_rate_is_bounded_across_clients(tmp_path, monkeypatch):
    monkeypatch.setattr(http_chat.tempfile, "gettempdir", lambda: str(tmp_path))
    buckets = [http_chat.TokenBucket("x", 20, 2) for _ in range(3)]
    began = time.monotonic()
    threads = [threading.Thread(target=lambda b=b: [b.take() for _ in range(4)]) for b in buckets]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert time.monotonic() - began >= (12 - 2) / 20 * 0.9


def test_each_distinct_request_is_sent_once(spark, service, tmp_path):
    url, seen, fail = service
    make, folder = http_chat.routed("key", url), str(tmp_path / "memo")

    def run(texts, model="gpt-4o", **how):
        rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, t string").repartition(3)
        asked = rows.withColumn("asked", F.when(F.col("t").isNotNull(), messages("s", F.col("t"))))
        got = ask_once(asked, "asked", folder, make, model, **how).orderBy("id").collect()
        assert [r.id for r in got] == list(range(len(texts)))
        return [(r.answer.ok, r.answer.text) for r in got]

    fail["bad"] = [401]
    first = run(["one", "two", "one", None, "bad", "one"])
    assert first == [(True, "eno"), (True, "owt"), (True, "eno"), (False, None), (False, None), (True, "eno")]
    assert Counter(s[0] for s in seen) == {"one": 1, "two": 1, "bad": 1}
    assert run(["two", "three", "one", "bad"]) == [(True, "owt"), (True, "eerht"), (True, "eno"), (True, "dab")]  # what failed is asked again
    assert Counter(s[0] for s in seen) == {"one": 1, "two": 1, "three": 1, "bad": 2}
    run(["one"], model="qwen-max")
    run(["one"], max_tokens=9)
    assert sum(s[0] == "one" for s in seen) == 3 and memo_table(spark, folder).read().count() == 6


def test_rewrites_go_through_the_memo(spark, service, tmp_path):
    url, seen, _ = service
    rows = spark.createDataFrame([("find x",), ("find x",), ("",), (None,)], "user_query string")
    for _ in range(2):
        got = study.rewrite(rows, template="{user_query}", make=http_chat.routed(None, url), memo=str(tmp_path / "memo")).collect()
        assert sorted(r.std_query for r in got) == ["", "", "x dnif", "x dnif"]
    assert len(seen) == 1


def test_registry(monkeypatch):
    monkeypatch.setattr(http_chat, "FACTORIES", {})
    http_chat.register("qwen", lambda provider, api_key, base_url: lambda *_: Answer(True, provider, 1))
    assert http_chat.routed()()(one("x"), "qwen-max", 1, 0.0).text == "qwen"
    assert isinstance(http_chat.client("openai", "k", "http://own"), http_chat.HttpChat) and http_chat.client("openai", "k", "http://own").base == "http://own"


def test_embeddings_over_http(spark, service):
    from lorespark.providers import embed

    url, _, _ = service
    assert http_chat.HttpEmbedder("m", base_url=url)(["a", "bcd"]) == [[1, 1.0], [3, 1.0]] and http_chat.HttpEmbedder(base_url=url)([]) == []
    rows = spark.createDataFrame([("ab",), (None,), ("abcd",)], "t string")
    got = embed(rows, "t", lambda: http_chat.HttpEmbedder("m", base_url=url)).collect()
    assert [r.vector for r in got] == [[2.0, 1.0], None, [4.0, 1.0]]
    down = embed(rows, "t", lambda: http_chat.HttpEmbedder("m", base_url="http://127.0.0.1:9", tries=1)).collect()
    assert [r.vector for r in down] == [None] * 3
