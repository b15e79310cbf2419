"""Language models behind HTTP: answers, image captions, translation. Plug-ins; anything callable does in their place."""

from __future__ import annotations

import base64
import json
import os
import urllib.request
from collections.abc import Callable
from pathlib import Path

#: Models that take no temperature and call the limit max_completion_tokens, by the beginning of their names. Fixed values.
_REASONING = ("gpt-4o", "gpt-5", "o1")
_TRANSLATE = "Put the following text into English. Keep technical terms as they are and add nothing."


def request_body(model: str, messages: list[dict], temperature: float, max_tokens: int) -> dict:
    """Body of a chat request as the model takes it."""
    if model.startswith(_REASONING):
        return {"model": model, "messages": messages, "max_completion_tokens": max_tokens}
    return {"model": model, "messages": messages, "temperature": temperature, "max_tokens": max_tokens}


class HttpCompleter:
    """A chat service that takes {model, messages, ...} and gives choices[0].message.content.

    The key is read from an environment variable when it is needed; it is neither kept nor logged."""

    def __init__(self, endpoint: str, model: str, temperature: float = 0.7, max_tokens: int = 500, key_variable: str = "", timeout: float = 120.0):
        self.endpoint, self.model, self.temperature, self.max_tokens, self.key_variable, self.timeout = endpoint, model, temperature, max_tokens, key_variable, timeout

    def _asked(self, messages: list[dict], temperature: float) -> str:
        headers = {"Content-Type": "application/json"}
        if key := os.environ.get(self.key_variable or " "):
            headers["Authorization"] = f"Bearer {key}"
        body = json.dumps(request_body(self.model, messages, temperature, self.max_tokens)).encode()
        with urllib.request.urlopen(urllib.request.Request(self.endpoint, body, headers), timeout=self.timeout) as answer:
            return json.loads(answer.read())["choices"][0]["message"]["content"]

    def __call__(self, prompt: str) -> str:
        """The answer to a prompt; where there is none, a text that begins with [ERROR]."""
        try:
            return self._asked([{"role": "user", "content": prompt}], self.temperature)
        except Exception as e:  # noqa: BLE001 - a model's failure is part of the answer
            return f"[ERROR] {e}"

    def caption(self, image_path: str, prompt: str) -> str | None:
        """What the model says about an image; null where the file or the answer fails."""
        try:
            data = base64.b64encode(Path(image_path).read_bytes()).decode()
            content = [{"type": "text", "text": prompt}, {"type": "image_url", "image_url": {"url": f"data:image/png;base64,{data}"}}]
            return self._asked([{"role": "user", "content": content}], self.temperature)
        except Exception:  # noqa: BLE001 - one image must not end the step
            return None

    def translate(self, text: str) -> str:
        """The text in English at temperature 0; as it is where that fails or it is empty."""
        if not text:
            return text
        try:
            return self._asked([{"role": "system", "content": _TRANSLATE}, {"role": "user", "content": text}], 0).strip()
        except Exception:  # noqa: BLE001 - the text itself will do
            return text


def captioner(completer: HttpCompleter, template: str, root: str = "") -> Callable[[], Callable[[str, str], str | None]]:
    """For enrich.captions(): fills a template's {{ context }} with the text beside an image below a folder; a missing file is skipped."""

    def make():
        def caption(path: str, text: str) -> str | None:
            file = Path(root) / path
            return completer.caption(str(file), template.replace("{{ context }}", text)) if file.exists() else None

        return caption

    return make
