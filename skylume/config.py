"""Parameters of an explanation run."""

from __future__ import annotations

from dataclasses import dataclass, fields
from pathlib import Path


@dataclass(frozen=True)
class Params:
    """Defaults are the published setting: two hops, ten buckets, a tenth of slack."""

    hops: int = 2
    k: int = 10
    epsilon: float = 0.1
    workers: int = 8
    seed: int = 42
    hidden: int = 16
    classes: int = 10
    model: str = "gcn2"
    method: str = "simple"
    #: In the queries of one wave, a frontier of more edges is cut to ``frontier_keep`` of them; the search takes all.
    frontier_limit: int = 10
    frontier_keep: int = 8


def load_params(path: str) -> Params:
    """Read ``name: value`` lines; unknown names are an error, missing ones keep defaults."""
    kinds = {f.name: type(f.default) for f in fields(Params)}
    found = {}
    for line in Path(path).read_text().splitlines():
        name, colon, value = line.partition("#")[0].partition(":")
        if not colon or not name.strip():
            continue
        if name.strip() not in kinds:
            raise ValueError(f"unknown parameter {name.strip()!r}")
        found[name.strip()] = kinds[name.strip()](value.strip())
    return Params(**found)
