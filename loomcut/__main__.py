"""python -m loomcut REGISTRY --datasets a b --steps locate curate: prints the plan. REGISTRY: JSON of {name: [raw_root, dest_root]}."""

from __future__ import annotations

import argparse
import json

from .plans import steps


def main(args: list[str] | None = None) -> list[steps.Task]:
    parser = argparse.ArgumentParser(prog="loomcut", description=__doc__)
    parser.add_argument("registry")
    parser.add_argument("--datasets", nargs="+", default=["all"])
    parser.add_argument("--steps", nargs="+", default=["all"])
    given = parser.parse_args(args)
    with open(given.registry) as f:
        registry = {k: steps.Dataset(k, *v) for k, v in json.load(f).items()}
    tasks = steps.plan(registry, given.datasets, given.steps)
    steps.run(tasks, {}, dry_run=True)
    return tasks


if __name__ == "__main__":
    main()
