"""Settings: command line over environment over default, and their validation."""

from __future__ import annotations

import argparse
import os
from dataclasses import dataclass
from pathlib import Path

DEFAULT_TIMEOUT_MS, MOST_TIMEOUT_MS = 1200, 5000
TRUE = {"true", "y", "yes", "enabled", "on", "1"}


class ConfigError(ValueError):
    pass


@dataclass(frozen=True)
class Config:
    input: str
    output: str
    format: str = "csv"
    timeout_ms: int = DEFAULT_TIMEOUT_MS
    monotonic: bool = False
    zstd: bool = False
    parquet_v2: bool = False
    key_file: str | None = None
    salt_file: str | None = None
    report: str = "text"
    silent: bool = False
    canonical_order: bool = False

    @property
    def timeout_us(self) -> int:
        return self.timeout_ms * 1000


def env_bool(text: str | None) -> bool:
    return (text or "").strip().lower() in TRUE


def parse_timeout(text: str) -> int:
    try:
        ms = int(text)
    except ValueError:
        raise ConfigError(f"the match timeout {text!r} is not a number of milliseconds") from None
    if not 1 <= ms <= MOST_TIMEOUT_MS:
        raise ConfigError(f"the match timeout must be 1 to {MOST_TIMEOUT_MS} ms")
    return ms


def parse(argv: list[str], env: dict[str, str] | None = None) -> Config:
    env = os.environ if env is None else env
    p = argparse.ArgumentParser(prog="nameflow", description="DNS transactions of a packet capture")
    p.add_argument("input", nargs="?", help="capture file, or - for standard input")
    p.add_argument("output", nargs="?", help="output file or folder, or - for standard output (CSV)")
    p.add_argument("--format", choices=("csv", "parquet", "pq"))
    p.add_argument("--match-timeout-ms")
    for flag in ("monotonic-capture", "zstd", "parquet-v2", "silent", "canonical-order", "dns-wire-fast-path"):
        p.add_argument(f"--{flag}", action="store_true")
    p.add_argument("--anonymize-key-file")
    p.add_argument("--anonymize-salt-file")
    p.add_argument("--report-format", choices=("text", "json"))
    p.add_argument("--threads", help="accepted and ignored")
    a = vars(p.parse_args(argv))

    def value(name: str, default=None):
        return a.get(name) if a.get(name) is not None else env.get(f"NAMEFLOW_{name.upper()}", default)

    def flag(name: str) -> bool:
        return bool(a.get(name)) or env_bool(env.get(f"NAMEFLOW_{name.upper()}"))

    kind = value("format", "csv")
    kind = "parquet" if kind == "pq" else kind
    if kind not in ("csv", "parquet"):
        raise ConfigError(f"unknown format {kind!r}")
    source = value("input")
    if not source:
        raise ConfigError("no input given")
    c = Config(
        input=source, output=value("output") or f"dns_output.{kind}", format=kind, timeout_ms=parse_timeout(str(value("match_timeout_ms", DEFAULT_TIMEOUT_MS))), monotonic=flag("monotonic_capture"),
        zstd=flag("zstd"), parquet_v2=flag("parquet_v2"), key_file=value("anonymize_key_file"), salt_file=value("anonymize_salt_file"), report=value("report_format", "text"), silent=flag("silent"), canonical_order=flag("canonical_order"),
    )
    validate(c)
    return c


def validate(c: Config) -> None:
    if (c.zstd or c.parquet_v2) and c.format != "parquet":
        raise ConfigError("zstd and parquet-v2 need the parquet format")
    if c.output == "-" and c.format != "csv":
        raise ConfigError("standard output takes CSV only")
    if c.output == "-" and c.report == "json":
        raise ConfigError("standard output leaves no room for a JSON report")
    if c.input == "-":
        if os.isatty(0):
            raise ConfigError("standard input is a terminal")
    elif "://" not in c.input:
        if not Path(c.input).is_file():
            raise ConfigError(f"input {c.input} is not a regular file")
    if c.output != "-" and "://" not in c.output:
        out = Path(c.output)
        if out.is_symlink():
            raise ConfigError(f"output {c.output} is a symbolic link")
        if c.format == "csv" and out.is_dir():
            raise ConfigError(f"output {c.output} is a folder")
        if c.input != "-" and out.exists() and Path(c.input).exists() and os.path.samefile(c.input, out):
            raise ConfigError("input and output are the same file")
    for f in (c.key_file, c.salt_file):
        if f and not os.access(f, os.R_OK):
            raise ConfigError(f"{f} cannot be read")
