"""Physical-plan checks: pushdown, pruning, what gets broadcast."""

import os
import re

import pytest

from conftest import SF_SMALL
from flowlens.operators.exfil import agg_exfil
from flowlens.operators.features import extract_features
from flowlens.operators.ics import ics_base
from flowlens.operators.lateral import agg_lateral, score_lateral
from flowlens.sources.fixtures import flows_from_lineitem
from flowlens.sources.flows import read_flows


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    """The fixture stored as a plain flow table (stored columns, like real data)."""
    path = os.path.join(str(tmp_path_factory.mktemp("stored")), "flows.parquet")
    flows_from_lineitem(spark, SF_SMALL).write.parquet(path)
    return read_flows(spark, path)


def test_ics_filter_reaches_parquet_scan(stored):
    p = plan(ics_base(extract_features(stored)))
    scan = [ln for ln in p.splitlines() if "FileScan parquet" in ln][0]
    assert "PushedFilters" in scan and "dst_port" in scan.split("PushedFilters")[1]


def scan_columns(p: str) -> set:
    cols = re.search(r"FileScan parquet \[([^\]]*)\]", p).group(1)
    return {c.split("#")[0] for c in cols.split(",")}


def test_lateral_scan_reads_only_needed_columns(stored):
    assert scan_columns(plan(agg_lateral(stored))) == {
        "timestamp", "src_ip", "dst_ip", "dst_port", "packets", "bytes", "duration"}


def test_exfil_scan_prunes_columns(stored):
    assert "src_port" not in scan_columns(plan(agg_exfil(stored)))


def test_fanout_join_removed_when_unused(stored):
    p = plan(agg_lateral(extract_features(stored)))
    assert "Join" not in p


def test_only_one_row_aggregates_are_broadcast(spark, stored):
    g = agg_lateral(stored)
    p = score_lateral(g)._jdf.queryExecution().optimizedPlan().toString()
    # every broadcast-hinted side is a global aggregate (no grouping keys)
    for m in re.finditer(r"ResolvedHint \(strategy=broadcast\)\n\s*\+- Aggregate \[([^\]]*)\]", p):
        assert m.group(1).strip() == ""
    assert "strategy=broadcast" in p


def exchanges(df) -> list:
    return [ln for ln in plan(df).splitlines() if "Exchange hashpartitioning" in ln]


def test_shuffle_counts_match_the_readme(stored):
    from flowlens.operators.flows_rollup import agg_flows
    lat = exchanges(agg_lateral(stored))
    assert len(lat) == 2 and "gid" in lat[1]            # (src, window, value, gid) then (src, window)
    assert len(exchanges(agg_exfil(stored))) == 2
    assert len(exchanges(ics_base(extract_features(stored)))) == 1
    assert len(exchanges(agg_flows(stored))) == 1
