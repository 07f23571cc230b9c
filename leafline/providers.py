"""Interfaces for what is not part of the engine: extraction, embedding, reranking and chat models.

The deterministic stand-ins need no model and no network; their figures say nothing about the
models that they stand in for.
"""

from __future__ import annotations

import re
import zlib
from typing import Any, Protocol

import numpy as np


class LineExtractor(Protocol):
    def pages(self, content: bytes) -> list[dict[str, Any]]:
        """Pages with page_number, width, height, lines (text, top, bottom), glyphs and extraction_error."""


class Embedder(Protocol):
    def encode(self, texts: list[str]) -> np.ndarray:
        """Unit vectors, float32, one row per text."""


class Reranker(Protocol):
    def score(self, pairs: list[tuple[str, str]]) -> list[float]:
        """A logit for each (question, text)."""


class ChatClient(Protocol):
    def complete(self, messages: list[dict[str, str]], tools: list[dict] | None = None) -> dict[str, Any]:
        """The response of a chat-completions endpoint."""


_word = re.compile(r"\w+")


class HashingEmbedder:
    """Words and character triples hashed into a fixed number of dimensions."""

    def __init__(self, dimensions: int = 256):
        self.dimensions = dimensions

    def encode(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.dimensions), np.float32)
        for i, text in enumerate(texts):
            for w in _word.findall(text.lower()):
                padded = f" {w} "
                for g in (w, *(padded[j : j + 3] for j in range(len(padded) - 2))):
                    h = zlib.crc32(g.encode("utf-8", "replace"))
                    out[i, h % self.dimensions] += 1.0 if h & 0x80000000 else -1.0
        length = np.linalg.norm(out, axis=1, keepdims=True)
        return out / np.where(length == 0, 1.0, length)


class OverlapReranker:
    """Logit of the share of the question's words that the text has."""

    def score(self, pairs: list[tuple[str, str]]) -> list[float]:
        out = []
        for query, text in pairs:
            asked = set(_word.findall(query.lower()))
            share = len(asked & set(_word.findall(text.lower()))) / len(asked) if asked else 0.0
            out.append(16.0 * share - 10.0)
        return out


class ExtractiveChat:
    """Repeats the first source's first words and cites it; asks for the document's status where a question is about its pages."""

    def complete(self, messages: list[dict[str, str]], tools: list[dict] | None = None) -> dict[str, Any]:
        import json

        content = messages[-1]["content"]
        if tools:
            about_pages = re.search(r"(?i)\bhow many pages\b|多少页", content)
            name, arguments = ("document_status", {}) if about_pages else ("retrieve_pdf", {"query": content})
            call = {"id": "call-1", "type": "function", "function": {"name": name, "arguments": json.dumps(arguments)}}
            return {"choices": [{"message": {"content": None, "tool_calls": [call]}}], "usage": {"total_tokens": len(content.split())}}
        if messages[-1]["role"] == "tool":
            told = json.loads(content)
            if "context" not in told:
                return self._say(f"{told.get('file_name')}: {told.get('page_count')} pages, {told.get('chunk_count')} chunks." if told else "Nothing is known of the document.")
            content = told["context"]
        m = re.search(r"\[(S\d+)\][^\n]*\n\[p(\d+)\] (.{0,80})", content)
        return self._say(f"{m.group(3).strip()} [{m.group(1)}, page {m.group(2)}]" if m else "The context does not answer this.")

    @staticmethod
    def _say(answer: str) -> dict[str, Any]:
        return {"choices": [{"message": {"content": answer}}], "usage": {"total_tokens": len(answer.split())}}


class HttpChat:
    """Chat completions over HTTP with a bearer key; temperature without reasoning, reasoning effort with it."""

    def __init__(self, base_url: str, model: str, api_key: str, max_tokens: int = 600, temperature: float = 0.2, reasoning_effort: str | None = None, timeout: float = 60.0):
        self.base_url, self.model, self.api_key = base_url.rstrip("/"), model, api_key
        self.max_tokens, self.temperature, self.reasoning_effort, self.timeout = max_tokens, temperature, reasoning_effort, timeout

    def payload(self, messages: list[dict[str, str]], tools: list[dict] | None = None) -> dict[str, Any]:
        body: dict[str, Any] = {"model": self.model, "messages": messages, "stream": False, "max_tokens": self.max_tokens}
        body |= {"thinking": {"type": "enabled"}, "reasoning_effort": self.reasoning_effort} if self.reasoning_effort else {"thinking": {"type": "disabled"}, "temperature": self.temperature}
        return body | ({"tools": tools, "tool_choice": "required"} if tools else {})

    def complete(self, messages: list[dict[str, str]], tools: list[dict] | None = None) -> dict[str, Any]:
        import json
        import urllib.error
        import urllib.request

        request = urllib.request.Request(f"{self.base_url}/chat/completions", json.dumps(self.payload(messages, tools)).encode(), {"Authorization": f"Bearer {self.api_key}", "Content-Type": "application/json"}, method="POST")
        try:
            with urllib.request.urlopen(request, timeout=self.timeout) as response:
                return json.loads(response.read())
        except urllib.error.HTTPError as e:
            raise RuntimeError(f"the chat endpoint returned {e.code}: {e.read().decode(errors='replace')}") from e
        except urllib.error.URLError as e:
            raise RuntimeError(f"no connection to the chat endpoint: {e.reason}") from e
