"""Write PLANS.md: the physical plan of every registered query.

Usage: python tools/explain.py [sf_dir]
For each query: the operator tree of ``explain("formatted")`` plus the scans'
pushed filters and read schemas. Plans are the initial adaptive plans; AQE
may still turn a sort-merge join into a broadcast join at run time.
"""

from __future__ import annotations

import contextlib
import io
import os
import re
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def condensed(df) -> str:
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain("formatted")
    text = buf.getvalue()
    tree, _, details = text.partition("\n\n\n")
    tree = tree.replace("== Physical Plan ==\n", "")
    keep = []
    current = None
    for line in details.splitlines():
        head = re.match(r"^\((\d+)\) (.*)$", line)
        if head:
            current = f"({head.group(1)}) {head.group(2).strip()}"
        elif current and "Scan" in current and line.startswith(("PushedFilters", "ReadSchema")):
            keep.append(f"{current}: {line}")
    return tree.rstrip() + ("\n\n" + "\n".join(keep) if keep else "")


def main() -> None:
    from custos.plans import fixtures as fx
    from custos.plans.registry import QUERIES, _mask_all
    from custos.session import local_session
    from custos.streaming.running import running_partials

    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.1"
    spark = local_session(8)
    out = ["# Physical plans", "",
           f"Generated by `python tools/explain.py {sf}` (local[8], AQE on, 8 shuffle partitions).",
           "Initial adaptive plans: at run time AQE may coalesce partitions, switch a sort-merge join to a",
           "broadcast join when a shuffle stage turns out small, and split skewed partitions.", ""]
    for name, query in QUERIES.items():
        if name.startswith("stream_"):
            df = running_partials(spark, fx.stream_catalog(sf), _mask_all())
        else:
            df = query(spark, sf)
        out += [f"## {name}", "", "```", condensed(df), "```", ""]
    with open(os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "PLANS.md"), "w") as f:
        f.write("\n".join(out))
    spark.stop()


if __name__ == "__main__":
    main()
