"""The external map: chunks through a translation backend, rate-limited per partition, with results that say what happened."""

from __future__ import annotations

import json
import re
import threading
import time
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.replies import without_thinking
from .batches import parts, release

# The mark after each request, request settings in order of trial, and what in an error's text asks for the next one.
STOP = "⏹️"
EXTRA_BODIES = [{"thinking": {"type": "disabled"}}, {"thinking": "disabled"}, {}]
DOWNGRADE = ["400", "422", "500", "502", "BadRequest", "InvalidParameter", "BadGateway", "Unprocessable"]
RESULT = "book_id string, chunk_id long, trans string, status string, error string"


class ReplyError(Exception):
    """A reply that isn't a completion."""

    def __init__(self, message: str, raw: str = "", content_type: str = "", status_code: int | None = None):
        super().__init__(f"{message} (content type {content_type or 'unknown'}, status {status_code}): {raw[:500]}")
        self.raw, self.content_type, self.status_code = raw, content_type, status_code


def messages(system: str, text: str) -> list[dict[str, str]]:
    return [{"role": "system", "content": system}, {"role": "user", "content": text + STOP}]


class RateLimiter:
    """Up to `permits` starts per `interval` seconds, in a window that the first start after the last window opens. Off if either is not positive."""

    def __init__(self, interval: float = 0, permits: int = 1, clock: Callable[[], float] = time.monotonic, sleep: Callable[[float], None] = time.sleep):
        self.interval, self.permits, self.clock, self.sleep = interval, permits, clock, sleep
        self.opened, self.used, self.lock = None, 0, threading.Lock()

    def acquire(self) -> None:
        while self.interval > 0 and self.permits > 0:
            with self.lock:
                now = self.clock()
                if self.opened is None or now - self.opened >= self.interval:
                    self.opened, self.used = now, 0
                if self.used < self.permits:
                    self.used += 1
                    return
                wait = self.opened + self.interval - now
            self.sleep(max(0.0, wait))
        return


@dataclass
class ChatBackend:
    """An OpenAI-compatible chat completion over HTTP. The key is read on the worker by `key`, so it is in no plan or file."""

    url: str
    model: str
    key: Callable[[], str]
    system: str
    temperature: float = 0.7
    timeout: float = 60.0
    post: Callable[[str, dict, dict, float], tuple[int, str, str]] | None = None
    mode: int = field(default=0, init=False)

    def _post(self, body: dict) -> str:
        headers = {"Content-Type": "application/json", "Authorization": f"Bearer {self.key()}"}
        send = self.post or _http
        code, kind, text = send(f"{self.url.rstrip('/')}/chat/completions", body, headers, self.timeout)
        if code >= 400:
            raise RuntimeError(f"Error code: {code} - {text[:500]}")
        try:
            choices = json.loads(text).get("choices")
        except (ValueError, AttributeError) as e:
            raise ReplyError("plain text instead of a completion", text, kind, code) from e
        if not choices:
            raise ReplyError("no choices", text, kind, code)
        message = choices[0].get("message")
        if message is None:
            raise ReplyError("no message", text, kind, code)
        content = message.get("content")
        content = message.get("reasoning_content") or None if content is None else content
        if content is None:
            raise ReplyError("no content", text, kind, code)
        return content

    def __call__(self, chunk_id: int, text: str) -> str:
        body = {"model": self.model, "messages": messages(self.system, text), "temperature": self.temperature, "stream": False, "stop": [STOP]}
        while True:
            try:
                return without_thinking(self._post(body | EXTRA_BODIES[self.mode]))
            except ReplyError:
                raise
            except Exception as e:
                if self.mode + 1 == len(EXTRA_BODIES) or not any(x in str(e) for x in DOWNGRADE):
                    raise
                self.mode += 1  # kept for later chunks


def _http(url: str, body: dict, headers: dict, timeout: float) -> tuple[int, str, str]:
    request = urllib.request.Request(url, json.dumps(body).encode(), headers)
    try:
        with urllib.request.urlopen(request, timeout=timeout) as reply:
            return reply.status, reply.headers.get("Content-Type", ""), reply.read().decode()
    except urllib.error.HTTPError as e:
        return e.code, e.headers.get("Content-Type", ""), e.read().decode(errors="replace")


class FakeBackend:
    """Deterministic: the text itself, or for every k-th chunk one of several faults."""

    FAULTS = ("none", "drop", "swap", "unbalance", "duplicate", "forge", "think", "fence", "error")

    def __init__(self, faults: tuple[str, ...] = ("none",), change: Callable[[str], str] = lambda x: x):
        self.faults, self.change = faults, change

    def __call__(self, chunk_id: int, text: str) -> str:
        fault, text = self.faults[chunk_id % len(self.faults)], self.change(text)
        if fault == "error":
            raise RuntimeError(f"Error code: 503 - chunk {chunk_id}")
        if fault == "drop":
            return re.sub(r"(?s)\n?<(\d+)>(?:(?!</\1>).)*</\1>\Z", "", text)
        if fault == "swap":
            return re.sub(r"(</?)1>", r"\g<1>0>", text)
        if fault == "unbalance":
            return text.replace("</t1>", "", 1)
        if fault == "duplicate":
            return re.sub(r"<t1>", "<t1><t1>", text, count=1)
        if fault == "forge":
            return re.sub(r"</(\d+)>", r"<s99/></\1>", text, count=1)
        if fault == "think":
            return f"<think>about {chunk_id}</think>\n\n{text}"
        if fault == "fence":
            return f"```html\n{text}\n```"
        return text


def translated(chunks: DataFrame, backend: Callable[[int, str], str], *, interval: float = 0, permits: int = 1, partitions: int | None = None) -> DataFrame:
    """(book_id, chunk_id, trans, status ok or api_error, error). permits: calls at a time, and starts per interval, of all tasks together. With an interval, or
    with `partitions`, chunks are dealt over so many tasks (at most one per permit), each with as many threads as its share of the permits; the rest of an uneven
    division is left unused. Write the result before anything reads it, or a second evaluation repeats the calls."""
    rows, share = chunks.select("book_id", "chunk_id", "orig"), 1
    names = [c.split()[0] for c in RESULT.split(", ")]
    if partitions or interval > 0:
        tasks = max(1, min(partitions or 1, permits))
        rows, share = rows.repartition(tasks), max(1, permits // tasks)

    def call(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        limiter = RateLimiter(interval, share)

        def one(row: tuple) -> tuple:
            book, chunk, text = row
            limiter.acquire()
            try:
                return book, chunk, without_thinking(backend(chunk, text)), "ok", None
            except Exception as e:  # any failure of a call is a result of its chunk
                return book, chunk, None, "api_error", str(e)[:2000]

        with ThreadPoolExecutor(share) as pool:
            for batch in batches:
                asked = (row for part in parts(batch, "orig", 256) for row in zip(*(c.to_pylist() for c in part.columns)))
                done = pool.map(one, asked) if share > 1 else map(one, asked)
                while some := list(islice(done, 256)):
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64() if k == 1 else pa.string()) for k, c in enumerate(zip(*some))], names)
        release()

    return rows.mapInArrow(call, RESULT)


def judged(results: DataFrame, chunks: DataFrame, mode: str = "anchor") -> DataFrame:
    """With error_type: api_error for failed calls, else the format check's result."""
    from .checks import format_of

    rows = results.join(chunks.select("book_id", "chunk_id", "n_blocks"), ["book_id", "chunk_id"])
    return rows.withColumn("error_type", F.when(F.col("status") == "api_error", "api_error").otherwise(format_of(F.col("trans"), F.col("n_blocks"), mode)))
