"""Configurations: YAML sections of fields, looked at as one table of ``section.field`` keys."""

from __future__ import annotations

from typing import Any

#: The datasets that there are, as (split version, dataset folder).
DATASETS = (("v1", "split_v1"), ("v2", "split_v2"))
VERSION, FOLDER = "data.split_version", "data.dataset_root"


def flat(config: dict[str, Any]) -> dict[str, Any]:
    return {f"{section}.{field}": value for section, fields in config.items() for field, value in (fields or {}).items()}


def nested(fields: dict[str, Any]) -> dict[str, Any]:
    out: dict[str, Any] = {}
    for key, value in fields.items():
        section, _, field = key.partition(".")
        out.setdefault(section, {})[field] = value
    return out


def settled(fields: dict[str, Any]) -> dict[str, Any]:
    """The fields with version and folder of the dataset filled in from ``DATASETS``.

    Both are compared without case and outer spaces. A folder of another name stands for itself, as long as no version is
    asked for.
    """
    asked = [None if fields.get(k) is None else str(fields[k]).strip().lower() for k in (VERSION, FOLDER)]
    fitting = [d for d in DATASETS if all(a is None or a == x for a, x in zip(asked, d, strict=True))]
    if asked[0] is not None and not fitting:
        raise ValueError(f"no dataset is {dict(zip((VERSION, FOLDER), asked, strict=True))}; there are {DATASETS}")
    return fields | dict(zip((VERSION, FOLDER), fitting[0], strict=True)) if len(fitting) == 1 else fields


def load(path: str, **replaced: Any) -> dict[str, Any]:
    """The configuration of a YAML file, some fields replaced by key; a key that the file doesn't have is a KeyError."""
    import yaml

    with open(path, encoding="utf-8") as f:
        fields = flat(yaml.safe_load(f))
    unknown = sorted(set(replaced) - set(fields))
    if unknown:
        raise KeyError(f"{path} has no {unknown}")
    return nested(settled(fields | replaced))


def latent_shape(side: int, halvings: int, channels: int, first: int) -> dict[str, Any]:
    """What follows from an encoder's sizes: each stage halves the side and doubles the channels."""
    return {"factor": 1 << halvings, "side": side >> halvings, "latents": channels * (side >> halvings) ** 3, "stages": [first << k for k in range(halvings + 1)]}
