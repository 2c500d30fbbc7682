"""Rewrite FIXTURES.md §4 from the registry's oracle SQL.

Usage: python tools/fixtures_doc.py
"""

from __future__ import annotations

import os
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)


def main() -> None:
    from custos.plans.registry import ORACLE_BODIES, QUERIES

    path = os.path.join(ROOT, "FIXTURES.md")
    text = open(path).read()
    head = text[: text.index("## 4. Oracle query per key")]
    lines = ["## 4. Oracle query per key", "",
             "Generated from `custos/plans/registry.py` by `python tools/fixtures_doc.py`. Each query is run after",
             "the prefix of §3 (DuckDB) and compared with the Spark query of the same key at sf0.01",
             "(`python tools/compare.py`). `avg_age_range_empty` returns one row, `n = 0`, so there is a row to",
             "compare. Averages are rounded to 6 digits on both sides.", "", "```sql"]
    for key in QUERIES:
        lines.append(f"-- key: {key}")
        lines.append(ORACLE_BODIES[key].strip() + ";")
    lines += ["```", ""]
    with open(path, "w") as f:
        f.write(head + "\n".join(lines))


if __name__ == "__main__":
    main()
