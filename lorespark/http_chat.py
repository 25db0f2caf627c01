"""A chat client over HTTP behind the ``Chat`` interface: registry, rate limit, back-off.

The protocol is the common one of ``/chat/completions``. All workers of one
executor share a token bucket (a small file under a lock on that machine), so
calls per second are bounded per executor, whatever the number of its workers.
Answers that say "later" (429 and 5xx) and broken connections are tried again
after growing pauses, or after as long as the service asks for.
"""

from __future__ import annotations

import contextlib
import fcntl
import hashlib
import json
import os
import random
import tempfile
import time
import urllib.error
import urllib.request
from collections.abc import Callable

from lorespark.providers import DEFAULT_PROVIDER, EMBED_MODEL, PREFIXES, Answer, Chat, endpoint

RETRY = {408, 409, 429, 500, 502, 503, 504, 529}


class TokenBucket:
    """``rate`` calls a second on average and ``burst`` at once, for all processes of a machine that use the same name."""

    def __init__(self, name: str, rate: float, burst: int = 1):
        self.rate, self.burst = rate, max(1, burst)
        self.path = os.path.join(tempfile.gettempdir(), f"lorespark-bucket-{hashlib.md5(name.encode()).hexdigest()}")

    def take(self) -> float:
        """Waits for a token; gives the seconds waited."""
        with open(self.path, "a+b") as f:
            fcntl.flock(f, fcntl.LOCK_EX)
            f.seek(0)
            held, now = f.read(), time.time()
            try:
                tokens, at = map(float, held.split())
            except ValueError:
                tokens, at = float(self.burst), now
            tokens = min(self.burst, tokens + max(0.0, now - at) * self.rate) - 1  # a debt is waited for outside the lock
            f.truncate(0)
            f.write(f"{tokens} {max(now, at)}".encode())
        wait = max(0.0, -tokens / self.rate)
        time.sleep(wait)
        return wait


class HttpChat:
    """One provider's chat service. Keys and addresses: arguments, then the environment, then the fixed values."""

    def __init__(self, provider: str = DEFAULT_PROVIDER, api_key: str | None = None, base_url: str | None = None, rate: float = 5.0, burst: int = 5, tries: int = 5, pause: float = 0.5, timeout: float = 120.0):
        self.key, self.base = endpoint(provider, api_key, base_url)
        self.tries, self.pause, self.timeout = tries, pause, timeout
        self.bucket = TokenBucket(self.base, rate, burst)

    def post(self, path: str, body: dict, read: Callable):
        """(what ``read`` makes of the answer, None), or (None, the last error)."""
        headers = {"Content-Type": "application/json"} | ({"Authorization": f"Bearer {self.key}"} if self.key else {})
        error = None
        for attempt in range(self.tries):
            self.bucket.take()
            try:
                with urllib.request.urlopen(urllib.request.Request(f"{self.base.rstrip('/')}{path}", json.dumps(body).encode(), headers), timeout=self.timeout) as got:
                    return read(json.load(got)), None
            except urllib.error.HTTPError as e:
                error, asked = f"HTTP {e.code}", e.headers.get("Retry-After")
                with contextlib.closing(e):
                    if e.code not in RETRY:
                        break
            except (OSError, ValueError, KeyError, IndexError, TypeError) as e:  # the connection, or an answer of another form
                error, asked = f"{type(e).__name__}: {e}", None
            if attempt + 1 < self.tries:
                own = self.pause * 2**attempt * random.uniform(0.5, 1.5)
                time.sleep(float(asked) if asked and asked.replace(".", "", 1).isdigit() else own)
        return None, error

    def __call__(self, messages: list[dict[str, str]], model: str, max_tokens: int, temperature: float) -> Answer:
        body = {"model": model, "messages": messages, "max_tokens": max_tokens, "temperature": temperature}
        read = lambda said: Answer(True, said["choices"][0]["message"]["content"], int((said.get("usage") or {}).get("total_tokens") or 0))
        found, error = self.post("/chat/completions", body, read)
        return found or Answer(False, None, 0, error)


class HttpEmbedder:
    """Embeddings of one provider over HTTP, many texts a call; a call that keeps failing raises, which ``embed`` takes for no vectors."""

    def __init__(self, model: str = EMBED_MODEL, provider: str = DEFAULT_PROVIDER, api_key: str | None = None, base_url: str | None = None, **how):
        self.model, self.calls = model, HttpChat(provider, api_key, base_url, **how)

    def __call__(self, texts: list[str]) -> list[list[float]]:
        if not texts:
            return []
        found, error = self.calls.post("/embeddings", {"model": self.model, "input": texts}, lambda said: [x["embedding"] for x in sorted(said["data"], key=lambda x: x["index"])])
        if found is None or len(found) != len(texts):
            raise OSError(error or "another number of vectors than of texts")
        return found


#: What makes a provider's client from (provider, api_key, base_url).
FACTORIES: dict[str, Callable[..., Chat]] = {}


def register(provider: str, factory: Callable[..., Chat]) -> None:
    """``factory(provider, api_key=..., base_url=...)`` makes this provider's clients; others are made as ``HttpChat``."""
    FACTORIES[provider] = factory


def client(provider: str, api_key: str | None = None, base_url: str | None = None) -> Chat:
    return FACTORIES.get(provider, HttpChat)(provider, api_key=api_key, base_url=base_url)


class RoutedChat:
    """Calls the provider that a model's name belongs to. Factories travel with it to the executors."""

    def __init__(self, api_key: str | None = None, base_url: str | None = None):
        self.factories, self.settings, self.clients = dict(FACTORIES), (api_key, base_url), {}

    def __call__(self, messages, model, max_tokens, temperature) -> Answer:
        provider = next((p for prefix, p in PREFIXES.items() if model.startswith(prefix)), DEFAULT_PROVIDER)
        if provider not in self.clients:
            self.clients[provider] = self.factories.get(provider, HttpChat)(provider, api_key=self.settings[0], base_url=self.settings[1])
        return self.clients[provider](messages, model, max_tokens, temperature)


def routed(api_key: str | None = None, base_url: str | None = None) -> Callable[[], Chat]:
    """For ``ask(make=...)``: the factories registered now, on every executor."""
    held = RoutedChat(api_key, base_url)
    return lambda: held
