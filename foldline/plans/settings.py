"""Settings of runs: sections of named values from YAML, with dotted overrides and a hash.

A section's fields and defaults are declared once, in a table; unknown names are errors.
"""

from __future__ import annotations

import hashlib
import json
from types import SimpleNamespace

REQUIRED = object()

DATA = {
    "dataset": {"name": REQUIRED, "pdb_dir": REQUIRED, "train_pairfile": REQUIRED, "val_pairfile": REQUIRED, "scop_lookup": None},
    "outputs": {"out_dir": REQUIRED},
    "features": {"virtual_center": [270.0, 0.0, 2.0], "sequence_delta_convention": "j_minus_i", "max_ca_dist": 5.0},
    "sampling": {"max_pairs_per_alignment": None, "seed": 123},
    "preprocessing": {"fail_on_skipped_alignments": False, "max_skipped_fraction": 0.01, "validate_cigars": True, "full_report": False},
}
TRAIN = {
    "model": {"quantizer": "vq", "input_dim": 10, "hidden_dim": 64, "z_dim": 4, "n_states": 20, "levels": None, "loss": "smooth_l1", "commitment_cost": 0.25, "decay": 0.99, "min_count": 1.0, "l2_normalize": True, "replacement_warmup_steps": 500},
    "train": {"lr": 1e-3, "weight_decay": 1e-4, "batch_size": 512, "max_epochs": 20, "patience": 5, "scheduler": "none", "clip_grad_norm": 1.0, "seed": 1, "kmeans_init": True, "kmeans_seed": 0, "kmeans_init_batches": 8},
    "data": {"processed_dir": "data/processed/scop_ca5_v1"},
    "outputs": {"out_dir": "outputs/models/scop_v2_default"},
}


def read_yaml(text: str):
    import yaml

    return yaml.safe_load(text)


class Settings(SimpleNamespace):
    """Sections as attributes, their values as attributes of those."""

    def as_dict(self) -> dict:
        return {name: dict(vars(section)) for name, section in vars(self).items()}

    def hash(self) -> str:
        """The same for the same values, the output folder included."""
        return hashlib.sha256(json.dumps(self.as_dict(), sort_keys=True).encode()).hexdigest()


def resolve(declared: dict, given: dict | None, overrides: dict[str, object] | None = None) -> Settings:
    """Defaults, then what is given, then overrides {"section.name": value}, of which None counts as not given."""
    if given is not None and not isinstance(given, dict):
        raise ValueError(f"settings must be sections of values, not {type(given).__name__}")
    given = {k: dict(v or {}) for k, v in (given or {}).items()}
    for dotted, value in (overrides or {}).items():
        section, _, name = dotted.partition(".")
        if value is not None:
            given.setdefault(section, {})[name] = value
    if unknown := [f"{s}.{n}" for s, values in given.items() for n in values if n not in declared.get(s, {})]:
        raise ValueError(f"unknown settings: {', '.join(sorted(unknown))}")
    found = Settings(**{s: SimpleNamespace(**{n: given.get(s, {}).get(n, default) for n, default in names.items()}) for s, names in declared.items()})
    if missing := [f"{s}.{n}" for s, names in declared.items() for n in names if getattr(getattr(found, s), n) is REQUIRED]:
        raise ValueError(f"missing settings: {', '.join(missing)}")
    return found


def load(declared: dict, path: str | None, overrides: dict[str, object] | None = None) -> Settings:
    given = None
    if path:
        with open(path) as f:
            given = read_yaml(f.read())
        if not isinstance(given, dict):
            raise ValueError(f"{path} does not hold sections of values")
    found = resolve(declared, given, overrides)
    if hasattr(found, "features"):
        if found.features.sequence_delta_convention != "j_minus_i":
            raise ValueError("features.sequence_delta_convention: only j_minus_i is known")
        found.features.virtual_center = [float(x) for x in found.features.virtual_center]
        if len(found.features.virtual_center) != 3:
            raise ValueError("features.virtual_center: three numbers")
    return found


def parse_overrides(args: list[str]) -> dict[str, object]:
    """--section.name value pairs, values as YAML reads them."""
    found, rest = {}, list(args)
    while rest:
        flag = rest.pop(0)
        if not flag.startswith("--") or "." not in flag:
            raise ValueError(f"unknown argument {flag}")
        name, equals, value = flag[2:].partition("=")
        if not equals:
            if not rest:
                raise ValueError(f"{flag} needs a value")
            value = rest.pop(0)
        found[name] = read_yaml(value)
    return found
