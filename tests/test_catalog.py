"""Every catalog query against its SQL on the smallest tables, and the driver's contract."""

import math
import os

import duckdb
import pandas as pd
import pytest

import __spark_entry__
from quorate.plans import catalog


def plain(v):
    if v is None or v is pd.NaT or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, float):
        return v + 0.0
    return v if isinstance(v, (int, str, bool)) else str(v)


@pytest.fixture(scope="module")
def duck(tiny):
    c = duckdb.connect()
    for f in os.listdir(tiny):
        c.execute(f"create view {f.removesuffix('.parquet')} as select * from '{tiny}/{f}'")
    return c


#: Queries that SQL doesn't express, and the test that holds their operator against a plain version or planted structure; for the three
#: reports on model errors it holds the model, and SQL holds the reports themselves on other scores (surprising_votes, hardest_voters, error_classes).
COVERED = {
    "change_points": "test_rollcall_operators.test_pelt_finds_a_step", "overdispersion": "test_studies.test_tarone_against_its_formula", "pagerank": "test_studies.test_pagerank_is_the_power_iteration", "betweenness": "test_rollcall_operators.test_betweenness_of_a_path",
    "principal_components": "test_rollcall_operators.test_latent_positions_separate_the_parties", "ideal_points": "test_rollcall_operators.test_latent_positions_separate_the_parties", "latent_classes": "test_rollcall_operators.test_latent_positions_separate_the_parties",
    "vector_clusters": "test_studies.test_vector_clusters_are_the_planted_ones", "windowed_positions": "test_studies.test_windowed_positions_part_the_parties",
    "vote_models": "test_fitted.test_vote_models_find_the_blocs", "passage_models": "test_fitted.test_passage_models_of_tallies", "model_importances": "test_fitted.test_importances_favour_the_party", "model_surprises": "test_fitted.test_vote_models_find_the_blocs",
    "model_hardest_voters": "test_fitted.test_vote_models_find_the_blocs", "model_error_classes": "test_fitted.test_vote_models_find_the_blocs", "component_count": "test_fitted.test_components_of_two_blocs", "component_loadings": "test_fitted.test_components_of_two_blocs",
    "reconstruction_error": "test_fitted.test_reconstruction_flags_the_odd_voter", "component_holdout": "test_fitted.test_components_of_two_blocs", "second_component": "test_fitted.test_second_component_folds", "correspondence": "test_fitted.test_correspondence_against_the_burt_table",
    "member_clusters": "test_fitted.test_member_clusters_find_the_blocs", "clade_support": "test_fitted.test_clade_support_of_the_blocs", "communities": "test_fitted.test_louvain_near_the_best_partition", "potts_communities": "test_fitted.test_louvain_on_two_cliques",
    "within_party_communities": "test_fitted.test_communities_of_the_blocs", "path_centralities": "test_fitted.test_path_centralities_of_a_path", "null_backbone": "test_fitted.test_null_backbone_joins_only_the_blocs",
    "alike_names": "test_linked.test_blocks_against_difflib", "matched_names": "test_linked.test_first_come_is_one_by_one", "session_quantiles": "test_linked.test_merged_summaries_keep_their_bound", "merged_quantiles": "test_linked.test_merged_summaries_keep_their_bound", "text_topics": "test_linked.test_planted_topics_are_found", "document_topics": "test_linked.test_planted_topics_are_found",
    "item_communities": "test_studies.test_planted_communities_are_found", "bridge_items": "test_studies.test_betweenness_of_all_and_of_some_sources", "tetrachoric_correlations": "test_studies.test_planted_correlations_are_found",
    "transfer_scores": "test_carried.test_planted_blocs_carry_over", "transfer_importances": "test_carried.test_rank_comparison_by_hand",
}


def test_every_query_is_held_against_something():
    assert set(COVERED) == set(catalog.QUERIES) - set(catalog.ORACLES)
    for where in COVERED.values():
        module, name = where.split(".")
        assert f"def {name}(" in open(os.path.join(os.path.dirname(__file__), f"{module}.py")).read(), where


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, tiny, duck, name):
    df = catalog.QUERIES[name](spark, tiny)
    cols = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=str)
    if name not in catalog.ORACLES:
        return
    out = duck.execute(catalog.ORACLES[name])
    names = [d[0] for d in out.description]
    assert sorted(names) == cols
    want = sorted((tuple(plain(r[names.index(c)]) for c in cols) for r in out.fetchall()), key=str)
    assert got == want


def test_contract(spark):
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert __spark_entry__.entry(spark).count() > 0
