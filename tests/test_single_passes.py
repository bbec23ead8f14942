"""Input is parsed, and rows are shuffled or scored, once."""

import os
import re

from conftest import SF_SMALL
from flowlens.operators.common import created_tables, drop_stored, materialize
from flowlens.operators.features import extract_features
from flowlens.operators.forest import iforest_score, iforest_train
from flowlens.plans import catalog, model_queries, store_queries
from flowlens.sources.fixtures import flows_from_lineitem


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def rows(df) -> list:
    return sorted(tuple(map(str, r)) for r in df.collect())


def test_text_is_parsed_once(spark):
    for q in (catalog.q_src_json, catalog.q_src_csv):
        p = plan(q(spark, SF_SMALL))
        assert "FileScan parquet" in p and "FileScan text" not in p and "FileScan csv" not in p


def test_stored_fanout_leaves_the_rows_where_they_are(spark):
    flows = flows_from_lineitem(spark, SF_SMALL)
    f = extract_features(flows, stored_fanout=True)
    p = plan(f)
    assert "BroadcastHashJoin" in p and "SortMergeJoin" not in p
    assert "Join" not in plan(f.drop("unique_destinations"))      # an unread lookup goes, as the lazy one does
    assert rows(f) == rows(extract_features(flows))


def test_training_scores_are_read_not_computed_again(spark):
    f = materialize(extract_features(flows_from_lineitem(spark, SF_SMALL), stored_fanout=True), "features")
    model = iforest_train(f, ["bytes", "packets"], n_trees=10, materialize_input=False, keep_scores=True)
    plain = iforest_train(f, ["bytes", "packets"], n_trees=10)
    assert model.nodes.sort_values(["tree_id", "node_id"]).equals(plain.nodes.sort_values(["tree_id", "node_id"]))
    kept, again = iforest_score(model, f), iforest_score(model, f.where("true").select("*"))
    assert "ArrowEvalPython" not in plan(kept) and "ArrowEvalPython" in plan(again)
    expected = rows(again)
    assert rows(kept) == expected
    drop_stored(model.kept[1])                    # the kept scores are gone: the forest runs again
    assert rows(iforest_score(model, f)) == expected


def test_trained_reports_run_the_forest_once(spark):
    model_queries._MODELS.pop(SF_SMALL, None)
    before = len(created_tables())
    store_queries.q_trained_risk_band(spark, SF_SMALL).collect()
    store_queries.q_trained_topk_anomalies(spark, SF_SMALL).collect()
    made = [os.path.basename(p) for p in created_tables()[before:]]
    assert sum("score" in p for p in made) == 1, made


def test_summary_reads_the_groups_as_they_are_stored(spark):
    before = len(created_tables())
    model_queries.q_attack_summary(spark, SF_SMALL).collect()
    store_queries.q_trained_attack_summary(spark, SF_SMALL).collect()
    made = [os.path.basename(p) for p in created_tables()[before:]]
    assert not [p for p in made if re.match(r"flowlens-(lateral|exfil|trained-part)-[0-9a-f]+$", p)], made
