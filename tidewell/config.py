"""Parameters of the engine, from defaults, a mapping, and the environment."""

from __future__ import annotations

import json
import os
from collections.abc import Mapping
from dataclasses import dataclass, fields, replace


def flattened(values: Mapping[str, object]) -> dict[str, object]:
    """Values of nested sections by their own names; a later one holds."""
    out: dict[str, object] = {}
    for name, value in values.items():
        out |= flattened(value) if isinstance(value, Mapping) else {name: value}
    return out


@dataclass(frozen=True)
class Config:
    chunk_tokens: int = 400
    overlap_tokens: int = 90
    min_chunk_chars: int = 50
    native_chars: int = 100
    files_per_batch: int = 10
    embedding_batch: int = 64
    embedding_dimension: int = 1024
    metric: str = "cosine"
    top_k: int = 8
    min_similarity: float = 0.45
    sql_max_rows: int = 50
    cache_entries: int = 100
    cache_seconds: float = 3600
    primary_model: str = "primary"
    models: str = "primary"
    cors_origins: str = ""
    default_url: str = ""
    affiliation: str = "de la Banque"

    @classmethod
    def read(cls, path: str, environ: Mapping[str, str] | None = None) -> Config:
        """:meth:`load` with the values of a JSON file, or a YAML file where a library for it is installed; nested sections are flattened."""
        with open(path, encoding="utf-8") as file:
            text = file.read()
        try:
            values = json.loads(text)
        except ValueError:
            import yaml

            values = yaml.safe_load(text)
        return cls.load(flattened(values or {}), environ)

    @classmethod
    def load(cls, values: Mapping[str, object] | None = None, environ: Mapping[str, str] | None = None, prefix: str = "TIDEWELL_") -> Config:
        """Defaults, then ``values``, then environment variables by upper-case name."""
        environ = os.environ if environ is None else environ
        kinds = {f.name: type(getattr(cls(), f.name)) for f in fields(cls)}
        given = {k: kinds[k](v) for k, v in (values or {}).items() if k in kinds}
        given |= {k: kind(environ[prefix + k.upper()]) for k, kind in kinds.items() if prefix + k.upper() in environ}
        return replace(cls(), **given)

    def chunking(self) -> dict[str, object]:
        """Options of :func:`tidewell.operators.chunking.chunked`."""
        return {"size": self.chunk_tokens, "overlap": self.overlap_tokens, "min_chars": self.min_chunk_chars, "affiliation": self.affiliation}

    def listed(self, name: str) -> list[str]:
        """A comma-separated value as a list."""
        return [v.strip() for v in getattr(self, name).split(",") if v.strip()]

    def resolve_model(self, key: str | None) -> str:
        return key if key in self.listed("models") else self.primary_model
