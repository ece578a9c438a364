"""Options and small helpers of the driver: configurations, retries, environment, prompts and argument lists."""

from __future__ import annotations

import os
import re
import time
from collections.abc import Callable, Mapping
from typing import Any


def flatten(config: Mapping[str, Any]) -> dict[str, Any]:
    """Leaf keys of a nested configuration; a later leaf of the same name replaces an earlier one."""
    out: dict[str, Any] = {}
    for key, value in config.items():
        out |= flatten(value) if isinstance(value, Mapping) else {key: value}
    return out


def resolve(defaults: Mapping[str, Any], file: Mapping[str, Any], given: Mapping[str, Any]) -> tuple[dict[str, Any], list[str]]:
    """(defaults, replaced by the file's leaves, replaced by what was given; the file's keys that have no default)."""
    leaves = flatten(file)
    return {k: given.get(k, leaves.get(k, v)) for k, v in defaults.items()}, sorted(set(leaves) - set(defaults))


def read_config(path: str) -> dict[str, Any]:
    """A configuration from JSON, or from YAML where that library is there."""
    with open(path, encoding="utf-8") as f:
        if path.endswith(".json"):
            import json

            return json.load(f)
        import yaml

        return yaml.safe_load(f) or {}


def retried(work: Callable[..., Any], tries: int = 3, waits: tuple[float, ...] = (2.0, 5.0), never: tuple[type[Exception], ...] = (FileNotFoundError,), sleep: Callable[[float], None] = time.sleep) -> Callable[..., Any]:
    """work that is tried again after an exception, with growing waits between; errors of `never` and the last one are raised."""

    def run(*args, **options):
        for n in range(tries):
            try:
                return work(*args, **options)
            except never:
                raise
            except Exception:
                if n == tries - 1:
                    raise
                sleep(waits[min(n, len(waits) - 1)])

    return run


def expand(path: str, environment: Mapping[str, str] | None = None) -> str:
    """path with ~ and variables put in; raises where one is unknown."""
    known = os.environ if environment is None else environment
    out = re.sub(r"\$(?:\{(\w+)\}|(\w+))", lambda m: known.get(m[1] or m[2], m[0]), path)
    if out.startswith("~"):
        out = known.get("HOME", os.path.expanduser("~")) + out[1:]
    if "$" in out:
        raise ValueError(f"unknown variable in {path!r}")
    return out


def dimensions(given: str | Mapping[str, Any] | list, known: Mapping[str, list[str]]) -> list[tuple[str, str]]:
    """(first, second level) pairs of an argument: 'A / B; C', 'A, C', one name, a mapping to lists, or a list of such; a first level alone stands for all its second ones. Unknown names raise."""
    if isinstance(given, Mapping):
        asked = [(a, b) for a, bs in given.items() for b in (bs or [None])]
    elif isinstance(given, list):
        return list(dict.fromkeys(p for x in given for p in dimensions(x, known)))
    else:
        marks = ";" if ";" in given else "\0" if "/" in given else ","
        asked = [((p + [None])[0], (p + [None])[1]) for x in given.split(marks) if x.strip() for p in [[y.strip() for y in x.split("/")]]]
    out = []
    for a, b in asked:
        if a not in known or b is not None and b not in known[a]:
            raise ValueError(f"unknown dimension {a if b is None else f'{a} / {b}'}; known: {', '.join(known)}")
        out += [(a, x) for x in (known[a] if b is None else [b])]
    return list(dict.fromkeys(out))


def loader_options(shuffle: bool, sampler: object | None) -> dict[str, Any]:
    """Options of a loader: a sampler has its own order, so it can't be shuffled too."""
    if sampler is not None and shuffle:
        raise ValueError("a sampler and shuffle exclude one another")
    return {"shuffle": shuffle and sampler is None, "sampler": sampler}


def evolve(objective: Callable[[list[float]], float], mean: list[float], rounds: int, population: int, elite: int, spread: float = 1.0, seed: int = 0) -> tuple[list[float], list[float]]:
    """(mean of the last elite, best objective of each round) of a search that draws around the mean, asks objective for each and moves to the best ones' mean and deviation."""
    import random

    draw, history, spreads = random.Random(seed), [], [spread] * len(mean)
    for _ in range(rounds):
        asked = sorted(((objective(x), x) for x in ([draw.gauss(m, s) for m, s in zip(mean, spreads)] for _ in range(population))), key=lambda p: -p[0])
        best = [x for _, x in asked[:elite]]
        history.append(asked[0][0])
        mean = [sum(c) / len(best) for c in zip(*best)]
        spreads = [(sum((v - m) ** 2 for v in c) / max(1, len(best) - 1)) ** 0.5 for c, m in zip(zip(*best), mean)]
    return mean, history
