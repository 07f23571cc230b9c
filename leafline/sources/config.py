"""Settings: environment files, precedence of arguments, places of local models."""

from __future__ import annotations

import os
from collections.abc import MutableMapping
from pathlib import Path


def load_env(path: str | Path, environment: MutableMapping[str, str] | None = None) -> None:
    """KEY=VALUE lines into the environment; what is set already stays, blank lines and comments are skipped, quotes around a value go."""
    environment = os.environ if environment is None else environment
    file = Path(path)
    if not file.exists():
        return
    for line in file.read_text(encoding="utf-8").splitlines():
        key, equals, value = line.partition("=")
        key = key.strip()
        if equals and key and not key.startswith("#"):
            environment.setdefault(key, value.strip().strip("\"'"))


def setting(argument: str | None, name: str, default: str | None = None, environment: MutableMapping[str, str] | None = None) -> str | None:
    """The argument, else the environment, else the default."""
    environment = os.environ if environment is None else environment
    return argument or environment.get(name) or default


def model_place(model: str, cache: str | Path, allow_download: bool = False) -> str:
    """A folder as it is; the name where downloads are allowed; else the snapshot that the cache's refs/main names, or a FileNotFoundError."""
    if Path(model).exists() or allow_download:
        return model
    folder = Path(cache) / ("models--" + model.replace("/", "--"))
    reference = folder / "refs" / "main"
    if reference.is_file() and (snapshot := folder / "snapshots" / reference.read_text().strip()).is_dir():
        return str(snapshot)
    raise FileNotFoundError(f"{model} is not in {cache}")


def chat_client(env_file: str | Path = ".env", base_url: str | None = None, model: str | None = None, max_tokens: int = 600, temperature: float = 0.2, reasoning_effort: str | None = None, timeout: float = 60.0, environment: MutableMapping[str, str] | None = None):
    """The chat model that arguments, environment and environment file name, in that order; None without a key in CHAT_API_KEY."""
    from leafline.providers import HttpChat

    environment = os.environ if environment is None else environment
    load_env(env_file, environment)
    key = setting(None, "CHAT_API_KEY", environment=environment)
    if not key:
        return None
    base, name = setting(base_url, "CHAT_BASE_URL", environment=environment), setting(model, "CHAT_MODEL", environment=environment)
    if not base or not name:
        raise ValueError("a chat model needs a base URL and a name: --base-url and --llm-model, or CHAT_BASE_URL and CHAT_MODEL")
    return HttpChat(base, name, key, max_tokens, temperature, reasoning_effort, timeout)
