"""Traffic profiles: a strict TOML file with its catalog, and its validation."""

from __future__ import annotations

import hashlib
import tomllib
from dataclasses import dataclass
from pathlib import Path

SCHEMA_VERSION = 1
KINDS = ("positive", "negative", "reverse", "root")
CODES = {"noerror": 0, "formerr": 1, "servfail": 2, "nxdomain": 3, "notimp": 4, "refused": 5}
_KEYS = {
    "": {"schema_version", "profile_name", "catalog_path", "catalog_sha256", "generation_defaults", "latent", "query_types", "duplicate_model", "response_codes", "response_delay", "retry_delay"},
    "generation_defaults": {"qps", "clients", "resolvers", "duplicate_max"},
    "latent": {"logical_timeout_rate", "duplicate_transaction_rate"},
    "query_types": set(KINDS),
    "duplicate_model": {"retry_count_weights"},
    "response_codes": set(CODES),
    "response_delay": {"unit", "normal", "servfail"},
    "retry_delay": {"answered_steps", "unanswered_steps"},
}


class ProfileError(ValueError):
    pass


@dataclass(frozen=True)
class Profile:
    name: str
    catalog: str
    qps: float
    clients: int
    resolvers: int
    duplicate_max: int
    timeout_rate: float
    duplicate_rate: float
    query_types: dict[str, list[tuple[str, int]]]
    retry_counts: list[tuple[int, int]]
    response_codes: dict[str, int]
    normal_delay: list[tuple[int, int, int]]
    servfail_delay: list[tuple[int, int, int]]
    answered_steps: list[tuple[int, int]]
    unanswered_steps: list[tuple[int, int]]


def _need(ok: bool, what: str) -> None:
    if not ok:
        raise ProfileError(what)


def _range(r, what: str) -> tuple[int, int]:
    lo, hi = (r["min"], r["max"]) if isinstance(r, dict) else r
    _need(0 <= lo <= hi, f"{what}: the range {lo}..{hi} is empty")
    return int(lo), int(hi)


def load(folder: str, file: str = "profile.toml") -> Profile:
    path = Path(folder) / file
    raw = tomllib.loads(path.read_text(encoding="utf-8"))
    for part, keys in _KEYS.items():
        there = raw if not part else raw.get(part)
        _need(isinstance(there, dict), f"section {part} is missing")
        _need(set(there) == keys, f"section {part or 'top'}: keys {sorted(set(there) ^ keys)} are unknown or missing")
    _need(raw["schema_version"] == SCHEMA_VERSION, f"schema version {raw['schema_version']} is not {SCHEMA_VERSION}")
    catalog = path.parent / raw["catalog_path"]
    digest = hashlib.sha256(catalog.read_bytes()).hexdigest()
    _need(digest == raw["catalog_sha256"].lower(), f"{catalog} has SHA-256 {digest}, not {raw['catalog_sha256']}")
    types = {k: [(x["qtype"], x["weight"]) for x in raw["query_types"][k]] for k in KINDS}
    for k, v in types.items():
        _need(v and all(w > 0 for _, w in v), f"query types {k} need positive weights")
    retries = [(x["retry_count"], x["weight"]) for x in raw["duplicate_model"]["retry_count_weights"]]
    _need(bool(retries) and all(w > 0 for _, w in retries) and all(a[0] < b[0] for a, b in zip(retries, retries[1:], strict=False)), "retry counts must rise and have positive weights")
    _need(sum(raw["response_codes"].values()) == 1000, "response codes must add up to 1000 per mille")
    delays = {}
    for k in ("normal", "servfail"):
        got = [(x["share_per_mille"], *_range(x["range_us"], k)) for x in raw["response_delay"][k]["buckets"]]
        _need(sum(x[0] for x in got) == 1000, f"{k} delays must add up to 1000 per mille")
        delays[k] = got
    steps = {}
    for k in ("answered_steps", "unanswered_steps"):
        rows = raw["retry_delay"][k]
        _need(bool(rows) and [x["step"] for x in rows] == list(range(1, len(rows) + 1)), f"{k} must be numbered from 1")
        steps[k] = [_range(x["range_us"], k) for x in rows]
    d, latent = raw["generation_defaults"], raw["latent"]
    for k, v in latent.items():
        _need(0 <= v <= 1, f"{k} is not a probability")
    _need(d["qps"] > 0 and d["clients"] > 0 and d["resolvers"] > 0, "defaults must be positive")
    return Profile(raw["profile_name"], str(catalog), d["qps"], d["clients"], d["resolvers"], d["duplicate_max"], latent["logical_timeout_rate"], latent["duplicate_transaction_rate"], types, retries, raw["response_codes"], delays["normal"], delays["servfail"], steps["answered_steps"], steps["unanswered_steps"])
