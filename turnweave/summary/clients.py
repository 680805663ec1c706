"""Chat clients. One loop serves every provider; a provider is a ``Dialect``."""

from __future__ import annotations

import hashlib
import json
import time
import urllib.error
import urllib.request
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field
from typing import Protocol

from .messages import first_candidate, first_choice, plain, prepared, with_instruction
from .policy import ChatError, RateLimited, RateLimiter, Retry, error_message, generation, requests_per_minute, retry_after


class ChatClient(Protocol):
    def chat(self, messages: Sequence[dict]) -> str: ...


class DryRun:
    """Answers with the last line of the last user message, 120 characters at most."""

    def chat(self, messages: Sequence[dict]) -> str:
        said = next((m.get("content") for m in reversed(messages) if m.get("role") == "user" and (isinstance(m.get("content"), str) or plain(m.get("content")))), "")
        lines = (said if isinstance(said, str) else plain(said)).splitlines()
        return f"[dry-run] {lines[-1][:120] if lines else ''}".strip()


class Digest:
    """Answers with the SHA-256 of all it was told: each message's role and plain text. A change anywhere in a prompt changes
    every later answer, so a fold over it can be held against SQL."""

    def chat(self, messages: Sequence[dict]) -> str:
        told = "\x1e".join(f"{m['role']}\x1f{m['content']}" for m in prepared(messages))
        return hashlib.sha256(told.encode()).hexdigest()


@dataclass(frozen=True)
class Dialect:
    url: Callable[[str], str]
    headers: Callable[[str], dict]
    payload: Callable[[str, Sequence[dict], dict], dict]
    read: Callable[[object], str]
    retry: Retry


def _generate(model, messages, options):
    return with_instruction(messages) | {"generationConfig": generation(**options)}


def _complete(model, messages, options):
    limit = options.get("max_tokens")
    return {"model": model, "messages": prepared(messages), "temperature": options.get("temperature", 0.7)} | ({"max_tokens": limit} if limit and limit > 0 else {})


#: The key goes into a header, never into the address.
DIALECTS = {
    "gemini": Dialect(lambda m: f"https://generativelanguage.googleapis.com/v1beta/models/{m}:generateContent", lambda k: {"x-goog-api-key": k}, _generate, first_candidate, Retry(base=1.5)),
    "openrouter": Dialect(lambda m: "https://openrouter.ai/api/v1/chat/completions", lambda k: {"Authorization": f"Bearer {k}"}, _complete, first_choice, Retry(base=2.0, stop_at_limit=True)),
}


def post(url: str, headers: Mapping[str, str], body: bytes, timeout: float) -> tuple[int, Mapping[str, str], str]:
    request = urllib.request.Request(url, body, {"Content-Type": "application/json", **headers})
    try:
        with urllib.request.urlopen(request, timeout=timeout) as r:
            return r.status, dict(r.headers), r.read().decode()
    except urllib.error.HTTPError as e:
        return e.code, dict(e.headers), e.read().decode(errors="replace")


@dataclass
class HttpChat:
    """A client over HTTP. ``send`` and ``sleep`` can be replaced in tests."""

    dialect: Dialect
    model: str
    api_key: str | None
    options: dict = field(default_factory=lambda: {"temperature": 0.7, "max_tokens": None})
    timeout: float = 120.0
    retry: Retry | None = None
    limiter: RateLimiter = field(default_factory=lambda: RateLimiter(0))
    send: Callable = post
    sleep: Callable[[float], None] = time.sleep
    headers: dict = field(default_factory=dict)

    def chat(self, messages: Sequence[dict]) -> str:
        if not self.api_key:
            raise ChatError("the API key is missing; use DryRun to go without")
        try:
            body = json.dumps(self.dialect.payload(self.model, messages, self.options), ensure_ascii=False).encode()
        except ValueError as e:
            raise ChatError(str(e)) from e
        retry = self.retry or self.dialect.retry
        for attempt in range(1, max(1, retry.attempts) + 1):
            last = attempt >= retry.attempts
            text, status, problem = self._once(body, attempt, retry)
            if text:
                return text
            if not last or status == 503:
                self.sleep(retry.after(status, attempt))
            if last:
                raise ChatError(problem)
        raise ChatError("no attempt was made")

    def _once(self, body: bytes, attempt: int, retry: Retry) -> tuple[str, int | None, str]:
        """Text, or the status (None: no usable answer) and what went wrong."""
        self.limiter.wait()
        try:
            status, headers, answer = self.send(self.dialect.url(self.model), self.dialect.headers(self.api_key) | self.headers, body, self.timeout)
        except OSError as e:
            return "", None, f"the request failed: {e}"
        if status == 429 and retry.stop_at_limit:
            raise RateLimited(error_message(answer) or "rate limit", attempt, retry_after(headers))
        if status >= 400:
            return "", status, f"HTTP {status} {error_message(answer)}".strip()
        try:
            return self.dialect.read(json.loads(answer)), None, "no usable text in the answer"
        except ValueError:
            return "", None, "the answer is no JSON"


def build(provider: str, model: str, api_key: str | None, dry_run: bool = False, per_minute: int | None = None, **options) -> ChatClient:
    """A client by provider name; without ``per_minute`` the limit goes by the model's name where the provider has one."""
    if dry_run:
        return DryRun()
    name = provider.strip().lower()
    if name not in DIALECTS:
        raise ValueError(f"unknown provider {provider!r}")
    limit = requests_per_minute(model) if per_minute is None and name == "gemini" else per_minute or 0
    return HttpChat(DIALECTS[name], model, api_key, **{"limiter": RateLimiter.shared((name, model, api_key), limit)} | options)
