"""Command line: run reports the way the analysis scripts are run.

    python -m shelfwise list
    python -m shelfwise run act_prioritized_list --sf-dir /root/testdata/sf0.01
    python -m shelfwise run dq --fact /data/inventory --format csv      # a whole family
    python -m shelfwise run all --sf-dir DIR --out /results             # write each as Parquet
    python -m shelfwise run all --fact /data/inventory --store /data/stored
    python -m shelfwise run all --stored /data/stored                   # no scan of the source

A family is a key prefix: dq (validation), inv (inventory), dem (demand),
sup (supplier), risk, act, actq.
"""

from __future__ import annotations

import argparse
import sys


def _parse(field, value: str):
    """``value`` as the type of a ``Params`` field; ValueError for anything else."""
    kind = str(field.type)
    if kind == "bool":
        if value.lower() not in ("true", "false"):
            raise ValueError(f"{field.name} takes true or false, not {value!r}")
        return value.lower() == "true"
    if kind.startswith("int"):
        return None if "None" in kind and value.lower() == "none" else int(value)
    return float(value) if kind == "float" else value


def main(argv: list[str] | None = None) -> int:
    ap = argparse.ArgumentParser(prog="shelfwise")
    sub = ap.add_subparsers(dest="cmd", required=True)
    sub.add_parser("list")
    run = sub.add_parser("run")
    run.add_argument("what", help="report key, family prefix or 'all'")
    src = run.add_mutually_exclusive_group(required=True)
    src.add_argument("--sf-dir", help="folder with the TPC-H style source tables")
    src.add_argument("--fact", help="inventory fact table (files with the fixed schema)")
    src.add_argument("--stored", help="folder that an earlier --store wrote")
    run.add_argument("--store", help="keep the fact table and its aggregates in this folder (with --fact)")
    run.add_argument("--format", default="parquet", choices=["parquet", "csv"])
    run.add_argument("--out", help="write each report as Parquet under this folder")
    run.add_argument("--rows", type=int, default=50, help="rows to show when not writing")
    run.add_argument(
        "--param",
        action="append",
        default=[],
        metavar="NAME=VALUE",
        help="override a threshold or limit of Params, e.g. --param cv_high=0.5",
    )
    args = ap.parse_args(argv)

    from shelfwise.plans.registry import REPORTS

    if args.cmd == "list":
        for key, (qid, op) in REPORTS.items():
            print(f"{qid}  {key:32s} {(op.__doc__ or '').strip().splitlines()[0]}")
        return 0

    keys = [k for k in REPORTS if args.what in ("all", k) or k.startswith(args.what + "_")]
    if not keys:
        print(f"no report matches {args.what!r}", file=sys.stderr)
        return 2

    from dataclasses import fields, replace

    from shelfwise.params import DEFAULT
    from shelfwise.session import local_session

    known = {f.name: f for f in fields(DEFAULT)}
    overrides = {}
    for item in args.param:
        name, _, value = item.partition("=")
        if name not in known:
            print(f"unknown parameter {name!r}; known: {', '.join(known)}", file=sys.stderr)
            return 2
        try:
            overrides[name] = _parse(known[name], value)
        except ValueError as e:
            print(f"{name}: {e}", file=sys.stderr)
            return 2
    params = replace(DEFAULT, **overrides)
    from shelfwise.sources.loader import read_inventory
    from shelfwise.sources.store import inventory_data, open_inventory, scratch_path, store_inventory

    from pyspark.sql import SparkSession

    spark = SparkSession.getActiveSession() or local_session()
    if args.sf_dir:
        data = inventory_data(spark, args.sf_dir)
    elif args.stored:
        data = open_inventory(spark, args.stored)
    else:
        # the fact table is read for its stored copy and aggregates, not once per report
        store = args.store or scratch_path(spark, "cli", "inventory")
        store_inventory(read_inventory(spark, args.fact, fmt=args.format), store, params)
        data = open_inventory(spark, store)
    for key in keys:
        df = REPORTS[key][1](data, params)
        if args.out:
            df.write.mode("overwrite").parquet(f"{args.out.rstrip('/')}/{key}")
            print(f"wrote {key}")
        else:
            print(f"== {key}")
            df.show(args.rows, truncate=False)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
