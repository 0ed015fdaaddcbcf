"""Side tools: python -m nameflow.tools catalog IN.csv OUT.tsv [--top N] | generate OUT.pcap [--profile FOLDER] [options]"""

from __future__ import annotations

import argparse
import json
import sys

from .config import ConfigError

DEFAULT_SECONDS = 300


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="nameflow.tools")
    sub = p.add_subparsers(dest="tool", required=True)
    c = sub.add_parser("catalog", help="the most frequent allowed names of a record CSV")
    c.add_argument("input")
    c.add_argument("output")
    c.add_argument("--top", type=int, default=10_000)
    c.add_argument("--blocked", action="append", default=[], help="a zone (with a dot) or a part of a name")
    g = sub.add_parser("generate", help="a synthetic capture")
    g.add_argument("output")
    g.add_argument("--profile", help="folder of profile.toml and its catalog")
    g.add_argument("--catalog", help="catalog file, where no profile is given")
    g.add_argument("--transactions", type=int)
    g.add_argument("--duration-seconds", type=float)
    g.add_argument("--qps", type=float)
    g.add_argument("--clients", type=int)
    g.add_argument("--resolvers", type=int)
    g.add_argument("--seed", type=int, default=1)
    g.add_argument("--start-epoch-seconds", type=int, default=0)
    return p


def transactions(a: argparse.Namespace, qps: float) -> int:
    if a.transactions is not None and a.duration_seconds is not None:
        raise ConfigError("give transactions or a duration, not both")
    n = a.transactions if a.transactions is not None else round((a.duration_seconds or DEFAULT_SECONDS) * qps)
    if n <= 0:
        raise ConfigError("no transactions to generate")
    return n


def main(argv: list[str] | None = None, spark=None) -> int:
    from .generator import profile, traffic
    from .operators import catalog
    from .sources.pcap import write_classic

    a = parser().parse_args(argv)
    if spark is None:
        from pyspark.sql import SparkSession

        spark = SparkSession.builder.appName("nameflow-tools").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    try:
        if a.tool == "catalog":
            rows = catalog.read_records(spark, a.input)
            found = catalog.summary(rows, a.top, blocked=a.blocked).first().asDict()
            catalog.write_catalog(catalog.top(rows, a.top, blocked=a.blocked), a.output)
        else:
            p = profile.load(a.profile) if a.profile else traffic.DEFAULT
            source = a.catalog or p.catalog
            if not source:
                raise ConfigError("a catalog or a profile is needed")
            t = traffic.transactions(spark, p, catalog.load_catalog(spark, source), transactions(a, a.qps or p.qps), a.seed, a.qps, a.clients, a.resolvers, a.start_epoch_seconds * 1_000_000)
            rows = traffic.packets(t, p, a.seed)
            found = traffic.summary(t, rows).first().asDict()
            found["packets"] = write_classic(((r.ts_us, r.data) for r in traffic.frames(rows).toLocalIterator()), a.output)
    except (ConfigError, ValueError, OSError) as e:
        print(f"error: {e}", file=sys.stderr)
        return 1
    print(json.dumps(found))
    return 0


if __name__ == "__main__":
    sys.exit(main())
