"""Command line: python -m nameflow.cli INPUT [OUTPUT] [options]"""

from __future__ import annotations

import shutil
import sys
import tempfile
from dataclasses import replace
from pathlib import Path

from . import sinks
from .config import ConfigError, parse
from .plans.run import run
from .sources.pcap import CaptureError


def main(argv: list[str] | None = None) -> int:
    from pyspark.sql import SparkSession

    try:
        c = parse(sys.argv[1:] if argv is None else argv)
    except (ConfigError, OSError, UnicodeDecodeError) as e:
        print(f"error: {e}", file=sys.stderr)
        return 2
    spark = SparkSession.builder.appName("nameflow").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    with tempfile.TemporaryDirectory() as folder:
        if c.input == "-":  # a finite stream; captures are read by offset
            spooled = Path(folder) / "capture"
            with spooled.open("wb") as f:
                shutil.copyfileobj(sys.stdin.buffer, f)
            c = replace(c, input=str(spooled))
        try:
            summary = run(spark, c, sys.stdout)
        except BrokenPipeError:
            return 0
        except (CaptureError, OSError) as e:
            print(f"error: {e}", file=sys.stderr)
            return 1
    if c.output != "-" and not c.silent:
        print(sinks.summary_json(summary) if c.report == "json" else sinks.summary_text(summary), end="")
    return 0


if __name__ == "__main__":
    sys.exit(main())
