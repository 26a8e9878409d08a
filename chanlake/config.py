"""Settings of a collection and its exports: defaults, a JSON file, the environment, and what is wrong with them."""

from __future__ import annotations

import json
import os
from collections.abc import Mapping
from dataclasses import asdict, dataclass, fields

#: Settings that the environment may give, as CHANLAKE_ and the name in capitals.
FROM_ENVIRONMENT = ("api_id", "api_hash", "session_name", "data_dir", "batch_size", "media_concurrent_downloads", "log_level")


@dataclass
class Config:
    api_id: int | None = None
    api_hash: str | None = None
    session_name: str = "chanlake"
    data_dir: str = "./data"
    batch_size: int = 100
    iter_wait_time: int = 2
    max_retries: int = 3
    media_concurrent_downloads: int = 3
    download_photos: bool = True
    download_videos: bool = True
    download_documents: bool = True
    max_media_size_mb: int = 100
    flood_wait_multiplier: float = 1.5
    min_request_delay: float = 0.5
    default_export_format: str = "parquet"
    compression: str = "snappy"
    log_level: str = "INFO"
    log_file: str | None = None

    @classmethod
    def from_env(cls, env: Mapping[str, str] = os.environ) -> Config:
        """Numbers are read as such; an empty or zero id is none."""
        whole = {"api_id", "batch_size", "media_concurrent_downloads"}
        given = {n: env[f"CHANLAKE_{n.upper()}"] for n in FROM_ENVIRONMENT if f"CHANLAKE_{n.upper()}" in env}
        out = cls(**{n: int(v or 0) if n in whole else v for n, v in given.items()})
        out.api_id = out.api_id or None
        return out

    @classmethod
    def from_file(cls, path: str) -> Config:
        with open(path, encoding="utf-8") as f:
            given = json.load(f)
        odd = sorted(set(given) - {f.name for f in fields(cls)})
        if odd:
            raise ValueError(f"{path}: unknown settings {odd}")
        return cls(**given)

    def to_file(self, path: str) -> None:
        """All settings, so that reading the file gives the same."""
        with open(path, "w", encoding="utf-8") as f:
            json.dump(asdict(self), f, indent=2)

    def errors(self) -> list[str]:
        found = {
            "api_id is required": not self.api_id,
            "api_hash is required": not self.api_hash,
            "batch_size must be >= 1": self.batch_size < 1,
            "media_concurrent_downloads must be >= 1": self.media_concurrent_downloads < 1,
        }
        return [text for text, wrong in found.items() if wrong]
