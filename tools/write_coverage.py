"""Write docs/COVERAGE.md from the registered queries."""

from __future__ import annotations

import collections
import re
import sys

sys.path.insert(0, __file__.rsplit("/", 2)[0])

from talentgrid.plans import load_all  # noqa: E402

registry = load_all()
by_id: dict[str, list[str]] = collections.defaultdict(list)
for name, covers in registry.COVERS.items():
    for part in re.sub(r" \([^)]*\)", "", covers).split(", "):
        mark = "" if name in registry.ORACLES else " (rows)"
        by_id[part].append(f"`{name}`{mark}")


def order(key: str):
    family, number = re.match(r"([A-Z]+)-(\d+)", key).groups()
    return family, int(number)


lines = ["# Coverage", "", "Registered queries per inventory id; *(rows)* marks queries without equivalent SQL.", "",
         "| Id | Queries |", "|---|---|"]
lines += [f"| {key} | {', '.join(by_id[key])} |" for key in sorted(by_id, key=order)]
lines += ["", f"{len(registry.QUERIES)} queries, {len(registry.ORACLES)} with SQL.", "",
          "Without a query of their own, in unit tests or as parameters: SRC-2, SRC-3 (`sources/readers.py`), UDF-2 (scorers share one signature), "
          "UDF-3 (the `value` column of a pool), UDF-4 (`overrides` of `effort_costs`, thresholds of `link`)."]
open(__file__.rsplit("/", 2)[0] + "/docs/COVERAGE.md", "w").write("\n".join(lines) + "\n")
print(lines[-3])
