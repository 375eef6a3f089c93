"""python -m foldline.cli build-features|validate|report|train|evaluate|compare"""

from __future__ import annotations

import argparse
import json
import os
import sys

from pyspark.sql import SparkSession

from foldline.plans import alphabet, dataset, reporting, settings


def main(argv: list[str] | None = None) -> int:
    top = argparse.ArgumentParser(prog="foldline", description=__doc__)
    commands = top.add_subparsers(dest="command", required=True)
    for name in ("build-features", "validate", "train"):
        one = commands.add_parser(name, help="further --section.name value pairs override the settings")
        one.add_argument("--config", required=name != "train")
        if name == "build-features":
            one.add_argument("--force", action="store_true")
    commands.add_parser("report").add_argument("--out-dir", required=True)
    one = commands.add_parser("evaluate")
    for flag in ("--model", "--pdb-dir", "--pairfile", "--out-dir"):
        one.add_argument(flag, required=True)
    one.add_argument("--virt", type=float, nargs=3)
    one.add_argument("--max-failure-rate", type=float, default=1.0)
    one = commands.add_parser("compare")
    one.add_argument("runs", nargs="+", help="name=folder")
    one.add_argument("--out-dir")
    args, rest = top.parse_known_args(argv)
    try:
        if args.command == "report":
            with open(f"{args.out_dir}/report.json") as f, open(f"{args.out_dir}/report.md", "w") as to:
                to.write(reporting.markdown(json.load(f)))
            return 0
        if args.command == "compare":
            print(json.dumps(reporting.compare(dict(r.split("=", 1) for r in args.runs), args.out_dir), indent=2))
            return 0
        spark = SparkSession.builder.appName(f"foldline {args.command}").getOrCreate()
        if args.command == "evaluate":
            print(json.dumps(alphabet.evaluate(spark, args.model, args.pdb_dir, args.pairfile, args.out_dir, args.virt, args.max_failure_rate), indent=2))
            return 0
        found = settings.load(settings.TRAIN if args.command == "train" else settings.DATA, args.config, settings.parse_overrides(rest))
        if args.command == "train":
            alphabet.train(spark, found)
        elif args.command == "validate":
            print(json.dumps(dataset.validate(spark, found), indent=2))
        else:
            dataset.build(spark, found, args.force)
        return 0
    except (ValueError, OSError, RuntimeError) as e:
        print(f"{args.command}: {e}", file=sys.stderr)
        return 1


if __name__ == "__main__":
    os.environ.setdefault("PYARROW_IGNORE_TIMEZONE", "1")
    sys.exit(main())
