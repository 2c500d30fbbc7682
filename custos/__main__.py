"""Run the clinical queries as Spark jobs (``python -m custos`` or ``spark-submit custos_job.py``).

  series      one patient's values of one component over time (O26)
  average     average of one component over an age range (O27)
  series-all  series of every patient, one component or all (B1, B2)
  averages    averages per age range, one component or all (B3, B4)

Tables come from a JSON file of flat settings (``<name>``, ``<name>_type``,
JDBC credentials and partition options: see ``custos.sources.settings``);
``--input-bytes`` and ``--cores`` size the shuffles; the policy comes from
the JSON envelope the policy service returned. Results are written to
``--output`` as JSON lines (one object per row, null fields left out) or
Parquet; nothing is collected to the driver.
"""

from __future__ import annotations

import argparse
import datetime as dt
import json
import sys

from pyspark.sql import DataFrame, SparkSession

from custos.plans import clinical
from custos.plans.policy import Envelope
from custos.session import recommended_conf, sizing_conf
from custos.sources.settings import catalog_from_settings


def _ranges(text: str) -> list[tuple[int, int]]:
    out = []
    for part in text.split(","):
        start, _, end = part.strip().partition("-")
        out.append((int(start), int(end)))
    return out


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="custos", description=__doc__.split("\n\n")[0])
    sub = p.add_subparsers(dest="command", required=True)
    common = argparse.ArgumentParser(add_help=False)
    common.add_argument("--settings", required=True, help="JSON file of flat table settings")
    common.add_argument("--envelope", required=True, help="JSON file with the policy service's answer")
    common.add_argument("--output", required=True, help="folder to write the result to")
    common.add_argument("--format", choices=("json", "parquet"), default="json")
    common.add_argument("--mode", default="errorifexists", help="save mode (errorifexists, overwrite, ...)")
    common.add_argument("--input-bytes", type=int, default=None,
                        help="bytes of blood tests read: sizes the shuffles (with --cores)")
    common.add_argument("--cores", type=int, default=None, help="cores of the cluster (default: what Spark sees)")
    s = sub.add_parser("series", parents=[common])
    s.add_argument("--social-id", required=True)
    s.add_argument("--component", required=True)
    a = sub.add_parser("average", parents=[common])
    a.add_argument("--component", required=True)
    a.add_argument("--start", type=int, required=True)
    a.add_argument("--end", type=int, required=True)
    a.add_argument("--as-of", type=dt.date.fromisoformat, default=None)
    sa = sub.add_parser("series-all", parents=[common])
    sa.add_argument("--component", default=None, help="one component; all components when left out")
    av = sub.add_parser("averages", parents=[common])
    av.add_argument("--component", default=None, help="one component; all components when left out")
    av.add_argument("--ranges", type=_ranges, required=True, help="age ranges such as 18-40,40-65")
    av.add_argument("--as-of", type=dt.date.fromisoformat, default=None)
    return p


def build(spark: SparkSession, args: argparse.Namespace) -> DataFrame:
    with open(args.settings) as f:
        catalog = catalog_from_settings(json.load(f))
    with open(args.envelope) as f:
        envelope = Envelope.parse(f.read())
    if args.command == "series":
        return clinical.component_series(spark, catalog, envelope, args.social_id, args.component)
    if args.command == "average":
        return clinical.component_average(spark, catalog, envelope, args.component, args.start, args.end,
                                          args.as_of)
    if args.command == "series-all":
        if args.component is None:
            return clinical.series_all_components(spark, catalog, envelope)
        return clinical.series_all_patients(spark, catalog, envelope, args.component)
    if args.component is None:
        return clinical.average_by_components_and_ranges(spark, catalog, envelope, args.ranges, args.as_of)
    return clinical.average_by_age_ranges(spark, catalog, envelope, args.component, args.ranges, args.as_of)


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> None:
    args = parser().parse_args(argv)
    if spark is None:
        spark = SparkSession.builder.appName(f"custos-{args.command}").getOrCreate()
        # Recommended settings, unless the cluster configuration says otherwise.
        given = spark.sparkContext.getConf()
        for key, value in recommended_conf().items():
            if not given.contains(key) and spark.conf.isModifiable(key):
                spark.conf.set(key, value)
        if args.input_bytes is not None:
            for key, value in sizing_conf(args.input_bytes, args.cores or spark.sparkContext.defaultParallelism).items():
                if not given.contains(key):
                    spark.conf.set(key, value)
    build(spark, args).write.mode(args.mode).format(args.format).save(args.output)


if __name__ == "__main__":
    main(sys.argv[1:])
