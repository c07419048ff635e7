"""Language models for the review, made by the prefix of their names.

    script:replies.json       replies from a file: {"Pattern name": "reply", "*": "any other"}
    https://host/path#model   a chat service that takes and gives JSON over HTTP
"""

from __future__ import annotations

import json
import os
import time
import urllib.error
import urllib.request
from collections.abc import Callable
from pathlib import Path
from typing import Protocol

#: Environment variable with the key of an HTTP service.
KEY = "FACTLOOM_MODEL_KEY"
#: Tokens of a reply, bytes of a reply read, tries at a busy service, and the longest wait between them in seconds.
MOST_TOKENS, MOST_BYTES, TRIES, LONGEST_WAIT = 1024, 1 << 20, 4, 30.0

#: What a reply should look like; a service that refuses schemas is asked again without.
SCHEMA = {
    "type": "object",
    "properties": {"verdict": {"type": "string", "enum": ["confirmed", "uncertain", "rejected"]}, "rationale": {"type": "string"}},
    "required": ["verdict", "rationale"],
}


class Model(Protocol):
    """A language model: one prompt in, its reply and token counts out."""

    name: str

    def complete(self, system: str, prompt: str) -> tuple[str, int, int]: ...


class ScriptedModel:
    """A model without a service: replies by rule, counts 100 tokens in and 20 out."""

    def __init__(self, reply: Callable[[str], str] | str, name: str = "scripted"):
        self.name, self._reply = name, reply

    def complete(self, system: str, prompt: str) -> tuple[str, int, int]:
        return (self._reply(prompt) if callable(self._reply) else self._reply), 100, 20


def scripted(name: str, most_tokens: int | None = None) -> ScriptedModel:
    replies = json.loads(Path(name.partition(":")[2]).read_text(encoding="utf-8"))

    def reply(prompt: str) -> str:
        head = prompt.split("\n", 1)[0].removeprefix("CANDIDATE ")
        return replies.get(head, replies.get("*", ""))

    return ScriptedModel(reply, name)


class HttpModel:
    """A chat service: posts {model, system, prompt, max_tokens, schema}, reads {text, tokens_in, tokens_out, stop}.

    A busy service (429) is tried again, as long after as it says and
    LONGEST_WAIT at most; one that refuses the schema (400) is asked without it.
    A refusal, a reply cut off at max_tokens or one of over MOST_BYTES is an
    error, which leaves the match unreviewed.
    """

    def __init__(self, name: str, most_tokens: int | None = None):
        self.name, self.most_tokens = name, most_tokens or MOST_TOKENS
        self.url, _, self.model = name.partition("#")
        self.schema = True

    def _post(self, body: dict) -> dict:
        headers = {"Content-Type": "application/json"}
        if os.environ.get(KEY):
            headers["Authorization"] = f"Bearer {os.environ[KEY]}"
        request = urllib.request.Request(self.url, json.dumps(body).encode(), headers)
        with urllib.request.urlopen(request, timeout=120) as answer:
            data = answer.read(MOST_BYTES + 1)
        if len(data) > MOST_BYTES:
            raise RuntimeError(f"a reply of over {MOST_BYTES} bytes")
        return json.loads(data)

    def complete(self, system: str, prompt: str) -> tuple[str, int, int]:
        body = {"model": self.model, "system": system, "prompt": prompt, "max_tokens": self.most_tokens}
        for tried in range(1, TRIES + 1):
            try:
                got = self._post(body | ({"schema": SCHEMA} if self.schema else {}))
            except urllib.error.HTTPError as e:
                if e.code == 400 and self.schema:
                    self.schema = False
                elif e.code == 429 and tried < TRIES:
                    said = e.headers.get("Retry-After", "")
                    time.sleep(min(LONGEST_WAIT, float(said) if said.replace(".", "", 1).isdigit() else 2.0**tried))
                else:
                    raise RuntimeError(f"the service answered {e.code}") from e
                continue
            if got.get("stop") in ("refusal", "max_tokens"):
                raise RuntimeError(f"no verdict: {got['stop']}")
            return str(got.get("text", "")), int(got.get("tokens_in", 0)), int(got.get("tokens_out", 0))
        raise RuntimeError(f"the service stayed busy for {TRIES} tries")


#: Makers of models by prefix of a model's name; users can register their own.
PROVIDERS: dict[str, Callable[[str, int | None], Model]] = {"script:": scripted, "http://": HttpModel, "https://": HttpModel}


def create_model(name: str, most_tokens: int | None = None) -> Model:
    for prefix, make in PROVIDERS.items():
        if name.startswith(prefix):
            return make(name, most_tokens)
    raise ValueError(f"no provider for model {name!r}; known prefixes: {', '.join(sorted(PROVIDERS))}")
