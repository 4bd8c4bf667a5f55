"""Settings: a TOML file, found upwards from the working directory, then environment variables CORBEL_<NAME>."""

import os
import tomllib
from dataclasses import dataclass, fields
from pathlib import Path

from .schema import ConfigError

FILE, PREFIX = "corbel.toml", "CORBEL_"


@dataclass
class Config:
    db: str = "corbel-index"
    model: str = "dummy-64"
    embed_backend: str = "dummy"
    embed_url: str = ""
    api_key: str = ""
    dimension: int = 64
    splitter: str = "bytes"
    chunk_size: int = 512
    chunk_overlap: int = 50
    embed_batch_size: int = 64
    embed_cache: str = ""
    tokenizer: str = ""
    generate_url: str = ""
    generate_model: str = ""
    host: str = "127.0.0.1"
    port: int = 8080
    cors_origins: str = ""
    rate_limit: int = 0
    request_timeout: int = 30
    public_stats: bool = False
    max_query_length: int = 10_000
    top_k: int = 10
    alpha: float = 0.5
    extensions: str = "txt,md,csv,json,jsonl,html,docx,pdf"

    def check(self) -> "Config":
        if not 0 <= self.chunk_overlap < self.chunk_size:
            raise ConfigError("chunk_overlap must be less than chunk_size")
        if not 0 <= self.alpha <= 1:
            raise ConfigError("alpha must be from 0 to 1")
        if self.dimension < 1 or self.top_k < 1:
            raise ConfigError("dimension and top_k must be positive")
        return self


def discover(start: Path | None = None) -> Path | None:
    here = (start or Path.cwd()).resolve()
    return next((p / FILE for p in (here, *here.parents) if (p / FILE).is_file()), None)


def load(path: str | None = None, env: dict | None = None) -> Config:
    """Defaults, overridden by the file's keys (tables are flattened) and then by the environment."""
    found = Path(path) if path else discover()
    said: dict = {}
    if found:
        try:
            data = tomllib.loads(found.read_text())
        except (OSError, tomllib.TOMLDecodeError) as e:
            raise ConfigError(f"{found}: {e}") from e
        for key, value in data.items():
            said |= value if isinstance(value, dict) else {key: value}
    env = os.environ if env is None else env
    kinds = {f.name: type(f.default) for f in fields(Config)}
    if unknown := sorted(set(said) - set(kinds)):
        raise ConfigError(f"unknown settings: {', '.join(unknown)}")
    said |= {name: env[PREFIX + name.upper()] for name in kinds if PREFIX + name.upper() in env}
    try:
        return Config(**{name: str(value).lower() in ("1", "true", "yes") if kinds[name] is bool else kinds[name](value) for name, value in said.items()}).check()
    except ValueError as e:
        raise ConfigError(str(e)) from e


def query_text(text: str, config: Config) -> str:
    """A checked query, without control characters."""
    text = "".join(c for c in text if c in "\n\t" or not (ord(c) < 32 or 127 <= ord(c) < 160))
    if not text.strip():
        raise ConfigError("the query is empty")
    if len(text) > config.max_query_length:
        raise ConfigError(f"the query has more than {config.max_query_length} characters")
    return text


def clamp(k: int, most: int = 1000) -> int:
    return max(1, min(k, most))
