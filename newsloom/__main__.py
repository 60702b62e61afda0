"""``python -m newsloom STAGE --config FILE``: one command for a whole run."""

from __future__ import annotations

import argparse
import json
import sys

from newsloom import pipeline
from newsloom.runtime import session
from newsloom.sources.records import PipelineConfig


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="newsloom", description="Builds the tables and packages of a run.")
    parser.add_argument("stage", choices=[*pipeline.STAGES, "compare"], help="what to run; compare sets two outputs side by side")
    parser.add_argument("--config", required=True, help="JSON (or YAML) file with the parameters of the run")
    parser.add_argument("--master", default=None, help="Spark master; that of the environment by default")
    parser.add_argument("--other", help="for compare: the output folder of the run to compare with")
    args = parser.parse_args(argv)
    config = PipelineConfig.read(args.config)
    spark = session("newsloom", args.master) if args.master else session("newsloom")
    try:
        if args.stage == "compare":
            if not args.other:
                parser.error("compare needs --other")
            done = pipeline.compare(spark, args.other, config.output, f"{config.output}/comparison")
        else:
            done = pipeline.STAGES[args.stage](spark, config)
    except pipeline.Stopped as e:
        print(f"stopped: {e}", file=sys.stderr)
        return 1
    print(json.dumps(done, ensure_ascii=False, indent=2, default=str))
    return 0


if __name__ == "__main__":
    sys.exit(main())
