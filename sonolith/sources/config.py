"""Run options and hyper-parameters from YAML, logging."""

from __future__ import annotations

import logging


def filled(value, variables: dict[str, str]):
    """``${name}`` replaced in all strings of nested lists and maps."""
    if isinstance(value, str):
        for name, text in variables.items():
            value = value.replace("${" + name + "}", text)
        return value
    if isinstance(value, dict):
        return {k: filled(v, variables) for k, v in value.items()}
    if isinstance(value, list):
        return [filled(v, variables) for v in value]
    return value


def load_config(text: str) -> dict:
    """YAML text; base_path fills templates in the other values. An empty text is an empty config."""
    import yaml

    found = yaml.safe_load(text) or {}
    base = found.get("base_path")
    return filled(found, {"base_path": str(base)}) if base is not None else found


def load_all(paths: str, options: str, hyperparameters: str) -> dict:
    """One config of paths, run options and hyper-parameters; options win over paths."""
    out = load_config(paths)
    base = {"base_path": str(out["base_path"])} if "base_path" in out else {}
    return out | filled(load_config(options), base) | {"hyperparameters": filled(load_config(hyperparameters), base)}


def log_to(path: str, name: str = "sonolith") -> logging.Logger:
    logger = logging.getLogger(name)
    logger.setLevel(logging.INFO)
    if not any(getattr(h, "baseFilename", None) == path for h in logger.handlers):
        handler = logging.FileHandler(path)
        handler.setFormatter(logging.Formatter("%(asctime)s %(levelname)s %(message)s"))
        logger.addHandler(handler)
    return logger


def notify(message: str, send=None) -> None:
    """Hands a message to ``send``, or prints it."""
    (send or print)(message)
