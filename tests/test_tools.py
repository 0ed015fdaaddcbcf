"""Profiles and the side tools."""

import hashlib

import pytest

from nameflow import tools
from nameflow.generator import profile
from nameflow.sources import pcap

CATALOG = "10\texample.com\n8\twww.example.org\n"
PROFILE = """
schema_version = 1
profile_name = "fixture"
catalog_path = "catalog.tsv"
catalog_sha256 = "{sha}"
[generation_defaults]
qps = 100.0
clients = 12
resolvers = 3
duplicate_max = 3
[latent]
logical_timeout_rate = {timeout}
duplicate_transaction_rate = {duplicate}
[query_types]
positive = [{{qtype = "A", weight = 3}}, {{qtype = "AAAA", weight = 1}}]
negative = [{{qtype = "A", weight = 1}}]
reverse = [{{qtype = "PTR", weight = 1}}]
root = [{{qtype = "NS", weight = 1}}]
[duplicate_model]
retry_count_weights = [{{retry_count = 1, weight = 4}}, {{retry_count = 2, weight = 1}}]
[response_codes]
formerr = 1
noerror = 974
nxdomain = 18
notimp = 1
refused = 3
servfail = {servfail}
[response_delay]
unit = "us"
normal = {{buckets = [{{name = "all", share_per_mille = 1000, range_us = {{min = 10, max = 400}}}}]}}
servfail = {{buckets = [{{name = "all", share_per_mille = 1000, range_us = {{min = 1000, max = 4000}}}}]}}
[retry_delay]
answered_steps = [{{step = 1, range_us = {{min = 1000, max = 2000}}}}]
unanswered_steps = [{{step = 1, range_us = {{min = 1000, max = 2000}}}}]
"""


def folder(tmp_path, timeout=0.0, duplicate=0.0, servfail=3, sha=None, catalog=CATALOG):
    (tmp_path / "catalog.tsv").write_text(catalog)
    (tmp_path / "profile.toml").write_text(PROFILE.format(sha=sha or hashlib.sha256(catalog.encode()).hexdigest(), timeout=timeout, duplicate=duplicate, servfail=servfail))
    return str(tmp_path)


def test_profiles(tmp_path):
    assert profile.load(folder(tmp_path)).retry_counts == [(1, 4), (2, 1)]
    for bad in ({"servfail": 4}, {"timeout": 1.5}, {"sha": "0" * 64}):
        with pytest.raises(profile.ProfileError):
            profile.load(folder(tmp_path, **bad))
    text = (tmp_path / "profile.toml").read_text().replace("schema_version = 1", "schema_version = 2")
    folder(tmp_path)
    (tmp_path / "profile.toml").write_text(text.replace("0" * 64, hashlib.sha256(CATALOG.encode()).hexdigest()))
    with pytest.raises(profile.ProfileError, match="version"):
        profile.load(str(tmp_path))


def test_generate(spark, tmp_path, capsys):
    import json

    where, out = folder(tmp_path, timeout=1.0, duplicate=1.0), [tmp_path / "a.pcap", tmp_path / "b.pcap"]
    for path in out:
        assert tools.main(["generate", str(path), "--profile", where, "--transactions", "16", "--seed", "7"], spark) == 0
    got = json.loads(capsys.readouterr().out.splitlines()[-1])
    assert out[0].read_bytes() == out[1].read_bytes()
    assert (got["response_packets"], got["timeouts"]) == (0, 16) and got["duplicate_packets"] >= 16
    index = pcap.inspect(str(out[0]))
    assert index.packets == got["packets"] == got["query_packets"] and index.regressions == 0 and index.failure is None
    assert tools.main(["generate", str(out[0]), "--transactions", "5"], spark) == 1


def test_catalog_tool(spark, tmp_path, capsys):
    (tmp_path / "r.csv").write_text("name\nA.example\na.example\nb.blocked.test\n")
    assert tools.main(["catalog", str(tmp_path / "r.csv"), str(tmp_path / "c.tsv"), "--blocked", "blocked.test"], spark) == 0
    assert (tmp_path / "c.tsv").read_text() == "2\ta.example\n"
    assert tools.main(["catalog", str(tmp_path / "r.csv"), str(tmp_path / "c.tsv"), "--top", "0"], spark) == 1
