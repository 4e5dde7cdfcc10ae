"""What the search needs of a language model, and one client that speaks the common chat protocol."""

from __future__ import annotations

import json
import re
import urllib.request
from typing import Protocol


class Client(Protocol):
    def complete(self, messages: list[dict], model: str) -> str:
        """The model's text."""

    def call_tool(self, messages: list[dict], model: str, name: str, schema: dict) -> str | None:
        """The JSON arguments of a forced tool call, or None without one. Text beside it is never looked at."""


class HttpClient:
    """Posts to a chat endpoint with a key. send is the transport; extra: further fields of every request, as the provider has them."""

    def __init__(self, url: str, key: str, send=None, timeout: float = 90, extra: dict | None = None):
        if not key:
            raise ValueError("a key is needed")
        self.url, self.key, self.timeout = url, key, timeout
        self.send, self.extra = send or self._post, extra or {}

    def _post(self, body: dict) -> dict:
        headers = {"Authorization": f"Bearer {self.key}", "Content-Type": "application/json"}
        request = urllib.request.Request(self.url, json.dumps(body).encode(), headers)
        with urllib.request.urlopen(request, timeout=self.timeout) as response:
            return json.load(response)

    def complete(self, messages: list[dict], model: str) -> str:
        return self.send(self.extra | {"model": model, "messages": messages})["choices"][0]["message"]["content"]

    def call_tool(self, messages: list[dict], model: str, name: str, schema: dict) -> str | None:
        tool = {"type": "function", "function": {"name": name, "parameters": schema}}
        choice = {"type": "function", "function": {"name": name}}
        reply = self.send(self.extra | {"model": model, "messages": messages, "tools": [tool], "tool_choice": choice})
        calls = reply["choices"][0]["message"].get("tool_calls") or []
        return next((c["function"].get("arguments") for c in calls if (c.get("function") or {}).get("name") == name), None)


def first_object(text: str) -> dict:
    """The first JSON object in a text, which may be fenced or have prose around it."""
    decoder = json.JSONDecoder()
    for m in re.finditer(r"\{", text):
        try:
            found, _ = decoder.raw_decode(text, m.start())
        except ValueError:
            continue
        if isinstance(found, dict):
            return found
    raise ValueError("there is no JSON object in the answer")
