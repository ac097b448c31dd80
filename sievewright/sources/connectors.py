"""Second-stage providers.  Clients are imported in the workers, so none has to be installed here."""

from __future__ import annotations

import os
from collections.abc import Callable, Sequence

from sievewright.functions.responses import ResponseError

Messages = Sequence[tuple[str, str]]


def require_key(provider: str, names: Sequence[str], api_key: str | None) -> str | None:
    """An explicit key; None if the client will find one itself; an error if there is none."""
    from sievewright.operators.classification import DependencyError

    if api_key:
        return api_key
    if any(os.environ.get(n) for n in names):
        return None
    raise DependencyError(f"no API key for {provider}: set {' or '.join(names)} or pass api_key")


def require_text(provider: str, text: object) -> str:
    if not isinstance(text, str) or not text.strip():
        raise ResponseError(f"{provider} returned no text")
    return text.strip()


#: The models that are asked where none is named.
DEFAULT_MODELS = {"openai": "gpt-4o-mini", "anthropic": "claude-3-5-haiku-latest", "gemini": "gemini-2.0-flash"}


def output_text(response: object) -> str | None:
    """A response's joined text, or else the text parts of its output items one after another."""
    whole = getattr(response, "output_text", None)
    if isinstance(whole, str) and whole.strip():
        return whole
    parts = (getattr(part, "text", None) for item in getattr(response, "output", None) or () for part in getattr(item, "content", None) or ())
    return "".join(x for x in parts if isinstance(x, str) and x.strip())


def _client(module: str):
    import importlib

    from sievewright.operators.classification import DependencyError

    try:
        return importlib.import_module(module)
    except ImportError as e:
        raise DependencyError(f"the package of {module} is not installed") from e


def _openai(model, api_key, generation) -> Callable[[Messages], str]:
    client = _client("openai").OpenAI(**({"api_key": api_key} if api_key else {}))
    model = model or DEFAULT_MODELS["openai"]

    def complete(messages: Messages) -> str:
        turns = [{"role": r, "content": c} for r, c in messages]
        if hasattr(client, "responses"):
            got = client.responses.create(model=model, input=turns, temperature=generation.temperature, max_output_tokens=generation.max_tokens)
            return require_text("openai", output_text(got))
        got = client.chat.completions.create(model=model, messages=turns, temperature=generation.temperature, max_tokens=generation.max_tokens)
        return require_text("openai", got.choices[0].message.content if got.choices else None)

    return complete


def _anthropic(model, api_key, generation) -> Callable[[Messages], str]:
    client = _client("anthropic").Anthropic(**({"api_key": api_key} if api_key else {}))

    def complete(messages: Messages) -> str:
        system = "\n\n".join(c for r, c in messages if r == "system")
        turns = [{"role": r, "content": c} for r, c in messages if r != "system"]
        got = client.messages.create(model=model or DEFAULT_MODELS["anthropic"], system=system, messages=turns, temperature=generation.temperature, max_tokens=generation.max_tokens)
        return require_text("anthropic", "".join(getattr(x, "text", "") or "" for x in got.content))

    return complete


def _gemini(model, api_key, generation) -> Callable[[Messages], str]:
    client = _client("google.genai").Client(**({"api_key": api_key} if api_key else {}))

    def complete(messages: Messages) -> str:
        from sievewright.operators.classification import single_prompt

        got = client.models.generate_content(model=model or DEFAULT_MODELS["gemini"], contents=single_prompt(messages), config={"temperature": generation.temperature, "max_output_tokens": generation.max_tokens})
        return require_text("gemini", getattr(got, "text", None))

    return complete


CONNECTORS = {"openai": _openai, "anthropic": _anthropic, "gemini": _gemini}


def connector(provider: str, model: str | None, api_key: str | None, generation) -> Callable[[], Callable[[Messages], str]]:
    """A builder that makes the provider's client in the worker that calls it."""
    from sievewright.operators.classification import KEY_NAMES

    key = require_key(provider, KEY_NAMES[provider], api_key)
    return lambda: CONNECTORS[provider](model, key, generation)
