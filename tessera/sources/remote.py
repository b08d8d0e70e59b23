"""Services over HTTP: embedding, chat and document parsing, with retries, result checks and an injectable transport.

Addresses, models and keys are parameters; nothing is contacted unless a caller makes one of these objects. All of them pickle, so
executors call the service batch by batch; a retry repeats one request, not a task.
"""

from __future__ import annotations

import io
import json
import time
import urllib.error
import urllib.request
import zipfile
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

import numpy as np

from .providers import retrying


class ServiceError(RuntimeError):
    """An answer that isn't what the interface promises; ``status`` is the HTTP code if there is one."""

    def __init__(self, message: str, status: int | None = None):
        super().__init__(message)
        self.status = status


def call(method: str, url: str, headers: dict[str, str] | None = None, body: bytes | None = None, timeout: float = 60) -> bytes:
    """One request; a status other than success is a ``ServiceError``, a broken connection a ``ConnectionError``."""
    request = urllib.request.Request(url, data=body, headers=headers or {}, method=method)
    try:
        with urllib.request.urlopen(request, timeout=timeout) as r:
            return r.read()
    except urllib.error.HTTPError as e:
        raise ServiceError(f"{method} {url}: {e.code}", e.code) from e
    except urllib.error.URLError as e:
        raise ConnectionError(f"{method} {url}: {e.reason}") from e


Transport = Callable[..., bytes]


@dataclass
class _Service:
    url: str
    key: str = ""
    model: str = ""
    timeout: float = 60
    retries: int = 3
    transport: Transport = call
    sleep: Callable[[float], None] = time.sleep

    def _post(self, url: str, payload: dict) -> dict:
        headers = {"Content-Type": "application/json"} | ({"Authorization": f"Bearer {self.key}"} if self.key else {})
        body = json.dumps(payload, ensure_ascii=False).encode()
        return json.loads(retrying(lambda: self.transport("POST", url, headers, body, self.timeout), self.retries, self.sleep))


@dataclass
class HttpEmbedder(_Service):
    """``POST url {model, input}`` -> ``{data: [{index, embedding}]}``, in requests of ``batch`` texts."""

    width: int = 1024
    batch: int = 10

    def embed(self, texts: Sequence[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.width))
        for at in range(0, len(texts), self.batch):
            part = list(texts[at : at + self.batch])
            data = self._post(self.url, {"model": self.model, "input": part, "dimensions": self.width}).get("data")
            if not isinstance(data, list) or len(data) != len(part) or not all(d.get("embedding") for d in data):
                raise ServiceError(f"embedding: {len(part)} texts sent, {len(data) if isinstance(data, list) else 'no'} vectors came back")
            for i, d in enumerate(sorted(data, key=lambda d: d.get("index", 0))):
                out[at + i] = d["embedding"]
        return out


def json_object(text: str) -> dict:
    """The object that a reply is, or else the widest part of it in braces; an error if that is no object either."""
    for part in (text, text[text.find("{") : text.rfind("}") + 1]):
        try:
            value = json.loads(part)
        except json.JSONDecodeError:
            continue
        if isinstance(value, dict):
            return value
    raise ServiceError(f"not a JSON object: {text[:200]}")


@dataclass
class HttpChat(_Service):
    """``POST url {model, messages, temperature}`` -> ``{choices: [{message: {content}}]}``."""

    prompts: dict[str, str] = field(default_factory=dict)  # system texts by task name, see ``providers.RuleChat``

    def messages(self, messages: Sequence[dict[str, str]], temperature: float = 0.2, **more) -> str:
        reply = self._post(self.url, {"model": self.model, "messages": list(messages), "temperature": temperature} | more)
        try:
            return reply["choices"][0]["message"]["content"]
        except (KeyError, IndexError, TypeError) as e:
            raise ServiceError("chat: a reply without a message") from e

    def text(self, system: str, user: str, temperature: float = 0.2) -> str:
        return self.messages([{"role": "system", "content": system}, {"role": "user", "content": user}], temperature)

    def json(self, system: str, user: str, temperature: float = 0.1) -> dict:
        return json_object(self.messages([{"role": "system", "content": system}, {"role": "user", "content": user}], temperature, response_format={"type": "json_object"}))

    def chat(self, system: str, prompts: Sequence[str], temperature: float = 0.1) -> list[str]:
        said = self.prompts.get(system.removeprefix("task: "), system)
        return [self.text(said, p, temperature) for p in prompts]


@dataclass
class RemoteParser(_Service):
    """A parser with tasks: create one, upload the file, poll until it is done, download a zip, take its Markdown.

    ``POST url/tasks`` -> ``{data: {task_id, upload_url}}``; ``PUT upload_url``; ``GET url/tasks/<id>`` -> ``{data: {state, zip_url, error}}``
    with state ``done`` or ``failed`` at the end. One file at a time for each Python worker.
    """

    options: dict = field(default_factory=dict)
    every: float = 5
    patience: float = 600
    suffixes: tuple[str, ...] = (".pdf",)

    @property
    def parameters(self) -> str:
        return json.dumps({"model": self.model} | self.options, sort_keys=True, ensure_ascii=False)

    def _data(self, method: str, url: str, body: dict | None = None) -> dict:
        headers = {"Content-Type": "application/json"} | ({"Authorization": f"Bearer {self.key}"} if self.key else {})
        raw = retrying(lambda: self.transport(method, url, headers, None if body is None else json.dumps(body).encode(), self.timeout), self.retries, self.sleep)
        reply = json.loads(raw)
        if not isinstance(reply.get("data"), dict) or reply.get("code", 0) != 0:
            raise ServiceError(f"parser: {reply.get('msg') or 'no data'}")
        return reply["data"]

    def parse(self, name: str, content: bytes) -> str:
        if not name.lower().endswith(self.suffixes):
            raise ValueError(f"not a file that this parser takes: {name}")
        task = self._data("POST", f"{self.url}/tasks", {"name": name, "model": self.model} | self.options)
        if not task.get("upload_url"):
            raise ServiceError("parser: no place to upload to")
        retrying(lambda: self.transport("PUT", task["upload_url"], {}, content, self.timeout), self.retries, self.sleep)
        waited = 0.0
        while (state := self._data("GET", f"{self.url}/tasks/{task['task_id']}")).get("state") != "done":
            if state.get("state") == "failed":
                raise ServiceError(f"parser: {name}: {state.get('error') or 'failed'}")
            if waited >= self.patience:
                raise TimeoutError(f"parser: {name}: not done after {self.patience} s")
            self.sleep(self.every)
            waited += self.every
        packed = retrying(lambda: self.transport("GET", state["zip_url"], {}, None, self.timeout), self.retries, self.sleep)
        with zipfile.ZipFile(io.BytesIO(packed)) as z:
            found = sorted(n for n in z.namelist() if n.endswith("full.md"))
            if not found:
                raise ServiceError(f"parser: {name}: no Markdown in the result")
            return z.read(found[0]).decode("utf-8")
