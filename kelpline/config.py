"""Configuration: defaults, TOML files, environment and overrides."""

from __future__ import annotations

import os
import tomllib
from dataclasses import asdict, dataclass, field, fields, replace
from pathlib import Path

from .functions.embed import DEFAULT_MODEL
from .sources.discover import DEFAULT_INDEX_PATTERNS

FILE_NAMES = ("config.toml", ".kelpline.toml")


def config_home() -> Path:
    return Path(os.environ.get("XDG_CONFIG_HOME") or Path.home() / ".config") / "kelpline"


def cache_home() -> Path:
    return Path(os.environ.get("XDG_CACHE_HOME") or Path.home() / ".cache") / "kelpline"


@dataclass(frozen=True)
class StoreConfig:
    path: str = "kelpline-store"


@dataclass(frozen=True)
class EmbeddingConfig:
    model: str = DEFAULT_MODEL
    cache_dir: str = field(default_factory=lambda: str(cache_home() / "models"))


@dataclass(frozen=True)
class ChunkingConfig:
    strategy: str = "recursive"
    chunk_size: int = 1536
    chunk_overlap: int = 200


@dataclass(frozen=True)
class IndexingConfig:
    batch_size: int = 100
    embedding_batch_size: int = 64
    patterns: tuple[str, ...] = DEFAULT_INDEX_PATTERNS
    exclude_patterns: tuple[str, ...] = ()


@dataclass(frozen=True)
class ImageConfig:
    enabled: bool = False
    model: str = ""
    min_image_size: int = 100


@dataclass(frozen=True)
class Config:
    store: StoreConfig = field(default_factory=StoreConfig)
    embedding: EmbeddingConfig = field(default_factory=EmbeddingConfig)
    chunking: ChunkingConfig = field(default_factory=ChunkingConfig)
    indexing: IndexingConfig = field(default_factory=IndexingConfig)
    images: ImageConfig = field(default_factory=ImageConfig)


#: flags that override a setting: (section, setting)
OVERRIDES = {
    "store": ("store", "path"), "model": ("embedding", "model"), "cache_dir": ("embedding", "cache_dir"), "chunker": ("chunking", "strategy"), "chunk_size": ("chunking", "chunk_size"),
    "chunk_overlap": ("chunking", "chunk_overlap"), "batch_size": ("indexing", "batch_size"), "patterns": ("indexing", "patterns"), "exclude": ("indexing", "exclude_patterns"),
}


def find_config(start: str | Path = ".") -> Path | None:
    """The user's file first, then the nearest one from ``start`` upwards."""
    own = config_home() / "config.toml"
    if own.is_file():
        return own
    here = Path(start).resolve()
    return next((d / n for d in (here, *here.parents) for n in FILE_NAMES if (d / n).is_file()), None)


def from_dict(data: dict) -> Config:
    """Unknown sections and settings are ignored."""
    out = Config()
    for section in fields(Config):
        given = data.get(section.name)
        if isinstance(given, dict):
            known = {f.name for f in fields(getattr(out, section.name))}
            values = {k: tuple(v) if isinstance(v, list) else v for k, v in given.items() if k in known}
            out = replace(out, **{section.name: replace(getattr(out, section.name), **values)})
    return out


def with_environment(config: Config) -> Config:
    """``KELPLINE_STORE`` and ``KELPLINE_CACHE`` take the place of the store's path and the cache folder."""
    if value := os.environ.get("KELPLINE_STORE"):
        config = replace(config, store=replace(config.store, path=value))
    if value := os.environ.get("KELPLINE_CACHE"):
        config = replace(config, embedding=replace(config.embedding, cache_dir=value))
    return config


def load_config(path: str | Path | None = None) -> Config:
    found = Path(path) if path else find_config()
    data = tomllib.loads(found.read_text("utf-8")) if found and found.is_file() else {}
    return with_environment(from_dict(data))


def with_overrides(config: Config, **given) -> Config:
    """Settings by flag name; ``None`` changes nothing, unknown flags raise ``KeyError``."""
    for flag, value in given.items():
        section, name = OVERRIDES[flag]
        if value is not None:
            config = replace(config, **{section: replace(getattr(config, section), **{name: tuple(value) if isinstance(value, list) else value})})
    return config


def toml_value(value) -> str:
    if isinstance(value, bool):
        return "true" if value else "false"
    if isinstance(value, (int, float)):
        return str(value)
    if isinstance(value, str):
        return '"' + value.replace("\\", "\\\\").replace('"', '\\"') + '"'
    if isinstance(value, (list, tuple)):
        return "[" + ", ".join(toml_value(v) for v in value) + "]"
    raise TypeError(f"no TOML value: {type(value).__name__}")


def render(config: Config | None = None) -> str:
    out = []
    for section, values in asdict(config or Config()).items():
        out.append(f"[{section}]")
        out += [f"{k} = {toml_value(v)}" for k, v in values.items()]
        out.append("")
    return "\n".join(out)


def init(target: str | Path | None = None, local: bool = False, force: bool = False) -> Path:
    """Write the defaults; refuses to overwrite without ``force``."""
    path = Path(target) if target else Path(".kelpline.toml") if local else config_home() / "config.toml"
    if path.exists() and not force:
        raise FileExistsError(f"{path} exists; use force to overwrite it")
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(render(), "utf-8")
    return path


def scrub_model_cache(cache_dir: str | Path) -> list[str]:
    """Remove ``models--*`` folders that are incomplete, without snapshot, or with a dangling or empty model file."""
    import shutil

    gone = []
    for folder in sorted(Path(cache_dir).glob("models--*")):
        snapshots = [p for p in (folder / "snapshots").glob("*") if p.is_dir()] if (folder / "snapshots").is_dir() else []
        models = [p for s in snapshots for p in s.rglob("*.onnx")]
        broken = any(folder.rglob("*.incomplete")) or not snapshots or any(not p.exists() or p.stat().st_size == 0 for p in models)
        if broken:
            shutil.rmtree(folder, ignore_errors=True)
            gone.append(folder.name)
    return gone
