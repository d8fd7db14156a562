"""Configuration: defaults, file, environment and arguments."""

from __future__ import annotations

import json
import os
from pathlib import Path

NAME = "strata.config.json"
DEFAULTS = {
    "rootDir": ".",
    "store": ".strata/store",
    "languages": ["ts", "js"],
    "include": ["**/*"],
    "exclude": ["**/node_modules/**", "**/dist/**", "**/.git/**"],
    "maxNestedStructDepth": 3,
    "summarizer": {"apiEndpoint": "", "apiKey": "", "model": "gpt-4o-mini", "concurrency": 5, "maxRetries": 3},
    "embedding": {"apiEndpoint": "", "apiKey": "", "model": None, "dimension": None, "concurrency": 5, "maxRetries": 3, "defaultModel": None},
    "watcher": {"batchIntervalMinutes": 10, "minChangeLines": 5, "debounceMs": 500},
}
#: environment variable -> (section, key); each key is decided on its own.
ENVIRONMENT = {
    "STRATA_EMBEDDING_API_ENDPOINT": ("embedding", "apiEndpoint"),
    "STRATA_EMBEDDING_API_KEY": ("embedding", "apiKey"),
    "STRATA_EMBEDDING_MODEL": ("embedding", "model"),
    "STRATA_EMBEDDING_DIMENSION": ("embedding", "dimension"),
    "OPENAI_API_KEY": ("summarizer", "apiKey"),
}


def find(start: str | Path, *, parents: int = 5) -> Path | None:
    """The configuration file in `start`, the working folder, or up to five folders above it."""
    here = Path.cwd().resolve()
    for folder in [Path(start).resolve(), here, *list(here.parents)[:parents]]:
        if (folder / NAME).is_file():
            return folder / NAME
    return None


def merged(base: dict, over: dict) -> dict:
    """over on base, section by section; None in over leaves the value below."""
    out = dict(base)
    for k, v in over.items():
        out[k] = merged(base[k], v) if isinstance(v, dict) and isinstance(base.get(k), dict) else base.get(k) if v is None else v
    return out


def load(start: str | Path = ".", arguments: dict | None = None, environ: dict | None = None) -> dict:
    """Arguments over environment over file over defaults, for each key on its own."""
    out = DEFAULTS
    path = find(start)
    if path:
        out = merged(out, json.loads(path.read_text()))
    for name, (section, key) in ENVIRONMENT.items():
        value = (os.environ if environ is None else environ).get(name)
        if value:
            out = merged(out, {section: {key: int(value) if key == "dimension" else value}})
    return merged(out, arguments or {})


def write_default(folder: str | Path = ".") -> Path:
    """Writes the defaults; refuses to overwrite."""
    path = Path(folder) / NAME
    with path.open("x") as f:
        json.dump(DEFAULTS, f, indent=2)
    return path
