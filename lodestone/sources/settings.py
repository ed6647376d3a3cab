"""Settings from the environment, and the driver's log."""

from __future__ import annotations

import logging
import os
import sys
from dataclasses import dataclass, fields
from functools import lru_cache


@dataclass(frozen=True)
class Settings:
    """Every field may be set as PREFIX_<FIELD> in the environment; a number that can't be read keeps its default."""

    data_dir: str = "data"
    model_dir: str = "models"
    index_dir: str = "index"
    log_file: str = "logs/engine.log"
    log_level: str = "INFO"
    embedding_url: str = ""
    embedding_batch: int = 64
    embedding_timeout: int = 60
    top_k: int = 10
    candidates: int = 100


def from_env(prefix: str = "LODESTONE", env: dict[str, str] | None = None, embedding_prefix: str = "ST") -> Settings:
    """Settings from the environment. The service's own variables (ST_EMBEDDING_URL, ...) override the others."""
    env = dict(os.environ) if env is None else env
    found: dict[str, object] = {}
    for f in fields(Settings):
        raw = env.get(f"{prefix}_{f.name.upper()}")
        if f.name.startswith("embedding_"):
            raw = env.get(f"{embedding_prefix}_{f.name.upper()}", raw)
        if raw is None:
            continue
        if isinstance(f.default, int):
            try:
                found[f.name] = int(raw.strip())
            except ValueError:
                continue
        else:
            found[f.name] = raw
    return Settings(**found)


@lru_cache(maxsize=1)
def settings() -> Settings:
    """The process's settings, read once."""
    return from_env()


def configure_logging(name: str = "lodestone", level: str = "INFO", path: str | None = None) -> logging.Logger:
    """A logger to the terminal and, with a path, to a file; calling it again adds nothing."""
    log = logging.getLogger(name)
    log.setLevel(level)
    if not log.handlers:
        shape = logging.Formatter("%(asctime)s %(levelname)s %(name)s %(message)s")
        handlers: list[logging.Handler] = [logging.StreamHandler(sys.stderr)]
        if path:
            os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
            handlers.append(logging.FileHandler(path, encoding="utf-8"))
        for h in handlers:
            h.setFormatter(shape)
            log.addHandler(h)
    return log


def peak_memory_mb() -> float:
    """Peak resident memory of the driver's Python, 0 where the system does not tell."""
    try:
        import resource

        return resource.getrusage(resource.RUSAGE_SELF).ru_maxrss / 1024
    except ImportError:
        return 0.0


def recommended_workers(cpus: int | None = None) -> int:
    return min(256, max(48, 12 * (cpus or os.cpu_count() or 8)))
