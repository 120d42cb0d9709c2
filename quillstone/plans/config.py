"""Settings: command line over environment over file over defaults."""

from __future__ import annotations

import os
import tomllib
from collections.abc import Mapping
from dataclasses import dataclass, field, fields, replace
from pathlib import Path

from ..operators.predicates import Tags
from ..schema import ConfigurationError

FILE, PREFIX = "quillstone.toml", "QUILLSTONE_"
MODES = {"dense": "dense_only", "fts": "lexical_only", "hybrid": "hybrid"}
CHOICES = {"mode": tuple(MODES), "metric": ("cosine", "dot", "l2"), "fusion": ("rrf", "linear"), "provider": ("npu", "cpu", "auto")}
TRUE, FALSE = ("1", "true", "yes", "on"), ("0", "false", "no", "off")


@dataclass(frozen=True)
class Config:
    archive_path: str = ""
    index_path: str = "index"
    model: str = "hashing"
    provider: str = "auto"
    mode: str = "hybrid"
    metric: str = "cosine"
    fusion: str = "rrf"
    top_k: int = 10
    rrf_k: int = 60
    color: bool = True
    tags: Mapping[str, tuple[str, ...]] = field(default_factory=dict)

    def registry(self) -> Tags:
        return Tags(self.tags)


def find_file(start: Path, home: Path | None = None) -> Path | None:
    """The file in this folder or one above it, or in the user's settings folder."""
    home = home or Path.home()
    for folder in (start, *start.parents, home / ".config" / "quillstone"):
        if (folder / FILE).is_file():
            return folder / FILE
    return None


def coerced(name: str, value: object, source: str) -> object:
    kind = next(f.type for f in fields(Config) if f.name == name)
    text = str(value).strip()
    if kind == "bool":
        if isinstance(value, bool):
            return value
        if text.lower() in (*TRUE, *FALSE):
            return text.lower() in TRUE
        raise ConfigurationError(f"{name} in {source} must be true or false, not {text!r}")
    if kind == "int":
        if isinstance(value, bool) or not text.lstrip("+").isdigit() or int(text) < 1:
            raise ConfigurationError(f"{name} in {source} must be a positive number, not {text!r}")
        return int(text)
    if not isinstance(value, str) or not text:
        raise ConfigurationError(f"{name} in {source} must be a text that isn't blank")
    if name in CHOICES and text not in CHOICES[name]:
        raise ConfigurationError(f"{name} in {source} must be one of {', '.join(CHOICES[name])}, not {text!r}")
    return text


def load(options: Mapping[str, object] | None = None, environ: Mapping[str, str] | None = None, start: Path | None = None) -> Config:
    """The settings; unknown names in the file are refused."""
    environ = os.environ if environ is None else environ
    out, path = Config(), find_file(start or Path.cwd())
    names = {f.name for f in fields(Config)} - {"tags"}
    if path is not None:
        try:
            table = tomllib.loads(path.read_text("utf-8"))
        except (tomllib.TOMLDecodeError, UnicodeDecodeError) as e:
            raise ConfigurationError(f"{path} can't be read: {e}") from e
        tags = table.pop("tags", {})
        if extra := sorted(set(table) - names):
            raise ConfigurationError(f"{path} holds unknown settings: {', '.join(extra)}")
        if not isinstance(tags, dict) or not all(isinstance(v, list) and v and all(isinstance(x, str) and x.strip() for x in v) for v in tags.values()):
            raise ConfigurationError(f"tags in {path} must be lists of folders")
        out = replace(out, tags={k: tuple(v) for k, v in tags.items()}, **{k: coerced(k, v, str(path)) for k, v in table.items()})
    from_env = {n: coerced(n, environ[PREFIX + n.upper()], "the environment") for n in names if environ.get(PREFIX + n.upper())}
    given = {k: coerced(k, v, "the command line") for k, v in (options or {}).items() if v is not None and k in names}
    return replace(out, **from_env, **given)
