"""Configuration: schemas, and their YAML files."""

from __future__ import annotations

from pathlib import Path
from typing import Any

from ..errors import ConfigError
from .analysis import AnalysisConfig, RunConfig
from .manifest import Manifest
from .spec import Spec
from .synthetic import SyntheticConfig

__all__ = ["AnalysisConfig", "Manifest", "RunConfig", "SyntheticConfig", "load_analysis", "load_config", "load_manifest", "load_synthetic"]


def _yaml(file: str | Path) -> dict:
    import yaml

    try:
        with open(file, encoding="utf-8") as f:
            data = yaml.safe_load(f)
    except OSError as e:
        raise ConfigError(f"{file}: {e.strerror}") from e
    except yaml.YAMLError as e:
        raise ConfigError(f"{file}: not YAML: {e}") from e
    if not isinstance(data, dict):
        raise ConfigError(f"{file}: the top level must be a mapping")
    return data


def _read(cls: type[Spec], data: dict, file: str | Path) -> Any:
    try:
        return cls.read(data)
    except ConfigError as e:
        raise ConfigError(f"{file}: {e}") from e


def _anchored(m: Manifest, file: str | Path) -> Manifest:
    """A relative base path is taken from the file's own folder."""
    return m if m.base_path.is_absolute() else m.replace(base_path=(Path(file).resolve().parent / m.base_path).resolve())


def load_manifest(file: str | Path) -> Manifest:
    return _anchored(_read(Manifest, _yaml(file), file), file)


def load_analysis(file: str | Path) -> AnalysisConfig:
    return _read(AnalysisConfig, _yaml(file), file)


def load_synthetic(file: str | Path) -> SyntheticConfig:
    return _read(SyntheticConfig, _yaml(file), file)


def load_config(file: str | Path) -> RunConfig:
    """A file with the sections ``manifest`` and ``analysis``."""
    c = _read(RunConfig, _yaml(file), file)
    return c.replace(manifest=_anchored(c.manifest, file))
