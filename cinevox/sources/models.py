"""Folders of network weights: ``model.safetensors`` beside ``config.json``."""

from __future__ import annotations

from pyarrow import fs as pafs

from ..operators import network
from ..operators.config import Config

WEIGHTS, CONFIG = "model.safetensors", "config.json"  # fixed values of the folder's form


def _at(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path.rstrip("/"))


def is_model(path: str) -> bool:
    fs, base = _at(path)
    return all(i.type == pafs.FileType.File for i in fs.get_file_info([f"{base}/{WEIGHTS}", f"{base}/{CONFIG}"]))


def save_model(path: str, weights: network.Weights, config: Config) -> None:
    fs, base = _at(path)
    fs.create_dir(base, recursive=True)
    for name, data in ((WEIGHTS, network.dumps(weights)), (CONFIG, config.to_json().encode())):
        with fs.open_output_stream(f"{base}/{name}") as out:
            out.write(data)


def load_model(path: str) -> tuple[network.Weights, Config]:
    """Weights and configuration; a folder without both is an error."""
    if not is_model(path):
        raise FileNotFoundError(f"{path} has no {WEIGHTS} with a {CONFIG}")
    fs, base = _at(path)
    parts = []
    for name in (WEIGHTS, CONFIG):
        with fs.open_input_stream(f"{base}/{name}") as data:
            parts.append(data.read())
    return network.loads(parts[0]), Config.from_json(parts[1].decode())


def resolve_models(path: str) -> list[str]:
    """The folder itself if it is a model, or else the models right below it, by name; none is an error."""
    if is_model(path):
        return [path]
    fs, base = _at(path)
    inside = sorted(i.base_name for i in fs.get_file_info(pafs.FileSelector(base, allow_not_found=True)) if i.type == pafs.FileType.Directory)
    found = [f"{path.rstrip('/')}/{name}" for name in inside if is_model(f"{path.rstrip('/')}/{name}")]
    if not found:
        raise FileNotFoundError(f"no model in {path}")
    return found
