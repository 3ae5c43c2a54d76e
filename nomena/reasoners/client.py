"""Clients of language models. The model is outside of the engine: whatever answers messages with a text fits in."""

from __future__ import annotations

import json
import os
import time
import urllib.request
import uuid
from collections import Counter
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Protocol

from ..functions.answers import request_key_of

Messages = list[dict[str, str]]


class Client(Protocol):
    def complete(self, messages: Messages, model: str = "", temperature: float = 0.0) -> str: ...


@dataclass
class Stub:
    """Answers by a function of the messages, for tests and dry runs; by default the first id that the last message names."""

    answer: Callable[[Messages], str] | None = None

    def complete(self, messages: Messages, model: str = "", temperature: float = 0.0) -> str:
        if self.answer:
            return self.answer(messages)
        ids = [w for w in messages[-1]["content"].replace(",", " ").replace(":", " ").split() if w.isdigit()]
        return json.dumps({"entity_id": int(ids[0]) if ids else -1, "confidence": 1.0})


@dataclass
class Http:
    """A server that speaks the common chat completion protocol."""

    base_url: str
    api_key: str = "EMPTY"
    timeout: float = 120.0

    def complete(self, messages: Messages, model: str = "", temperature: float = 0.0) -> str:
        body = json.dumps({"model": model, "messages": messages, "temperature": temperature}).encode()
        ask = urllib.request.Request(f"{self.base_url.rstrip('/')}/chat/completions", body, {"Content-Type": "application/json", "Authorization": f"Bearer {self.api_key}"})
        with urllib.request.urlopen(ask, timeout=self.timeout) as r:
            return json.load(r)["choices"][0]["message"]["content"] or ""


@dataclass
class Retrying:
    """Asks again after errors, waiting twice as long each time, up to a limit; the last error is raised."""

    client: Client
    tries: int = 6
    delay: float = 2.0
    longest: float = 30.0
    sleep: Callable[[float], None] = time.sleep

    def complete(self, messages: Messages, model: str = "", temperature: float = 0.0) -> str:
        wait = self.delay
        for left in range(self.tries - 1, -1, -1):
            try:
                return self.client.complete(messages, model, temperature)
            except Exception:
                if not left:
                    raise
                self.sleep(wait)
                wait = min(2 * wait, self.longest)
        raise ValueError("no tries")


@dataclass
class Cached:
    """Keeps answers in a folder that all executors share, a file each: the n-th equal request of a case has the n-th answer, so repeated samples stay apart and reruns agree.

    case is part of the key's place: equal requests of different rows share answers only at equal counts. Files are written beside and renamed; a broken one is asked anew.
    """

    client: Client
    folder: str
    seen: Counter = field(default_factory=Counter)

    def complete(self, messages: Messages, model: str = "", temperature: float = 0.0) -> str:
        key = request_key_of(model=model, messages=messages, temperature=temperature)
        path = os.path.join(self.folder, f"{key}-{self.seen[key]}.json")
        self.seen[key] += 1
        try:
            with open(path, encoding="utf-8") as f:
                return json.load(f)["content"]
        except (OSError, ValueError, KeyError):
            pass
        content = self.client.complete(messages, model, temperature)
        os.makedirs(self.folder, exist_ok=True)
        beside = f"{path}.{uuid.uuid4().hex}"
        with open(beside, "w", encoding="utf-8") as f:
            json.dump({"content": content}, f, ensure_ascii=False)
        os.replace(beside, path)
        return content
