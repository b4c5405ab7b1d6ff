"""Queries of fitted models and of structure; SQL can't express them, so tests hold them against plain versions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import agreement, graph, latent, models, predict, structure, synthesis
from . import catalog, more
from .catalog import KAPPA, Tables, on, register


def _coo(t: Tables) -> DataFrame:
    return agreement.encode(t.votes)


def _held(t: Tables) -> DataFrame:
    return models.held_out_votes(_coo(t), t.members, t.items)


def _chamber_graph(t: Tables) -> DataFrame:
    """Edges of kappa between members of one chamber."""
    m = t.members.select("voter", "chamber")
    ends = catalog._graph(t).join(m.toDF("a", "chamber"), "a").join(m.toDF("b", "other"), "b")
    return ends.where("chamber = other").select("chamber", "a", "b", "weight")


def _party_graph(t: Tables) -> DataFrame:
    p = t.members.select("voter", "party")
    ends = graph.edges(catalog._pairs(t), KAPPA).join(p.toDF("a", "party"), "a").join(p.toDF("b", "other"), "b")
    return ends.where("party = other").select("party", "a", "b", "weight")


# ---------------------------------------------------------------- classifiers

register("vote_models", on(lambda t: models.vote_models(_coo(t), t.members, t.items), *models.METRICS))
register("passage_models", on(lambda t: models.passage_models(t.votes, t.items), *models.METRICS))
register("model_importances", on(lambda t: models.importances(_coo(t), t.members, t.items), "weight"))
register("model_surprises", on(lambda t: predict.surprises(_held(t)), "error"))
register("model_hardest_voters", on(lambda t: predict.hardest(_held(t)), "accuracy"))
register("model_error_classes", on(lambda t: synthesis.error_classes(_held(t), "party")))

# ---------------------------------------------------------------- components and categories

register("component_count", on(lambda t: structure.component_count(_coo(t), t.members), "eigenvalue", "explained", "chance"))
register("component_loadings", on(lambda t: structure.loadings(_coo(t), t.members), "loading"))
register("reconstruction_error", on(lambda t: structure.reconstruction(_coo(t), t.members), "rmse"))
register("component_holdout", on(lambda t: structure.component_holdout(_coo(t), t.members), "accuracy", "auc", "rmse", "baseline"))
register("second_component", on(lambda t: structure.second_component(latent.principal_components(_coo(t), t.members)), "r2", "score"))
register("correspondence", on(lambda t: structure.correspondence(more._categories(t), t.members), "coordinate", "share"))

# ---------------------------------------------------------------- clusters, communities, null model

register("member_clusters", on(lambda t: structure.member_clusters(_coo(t), t.members), "quality"))
register("clade_support", on(lambda t: structure.clade_support(_coo(t), t.members), "height", "support"))
register("communities", on(lambda t: structure.communities(_chamber_graph(t), "chamber"), "modularity"))
register("potts_communities", on(lambda t: structure.communities(_chamber_graph(t), "chamber", (0.05, 0.1, 0.15, 0.2, 0.25, 0.3, 0.4, 0.5), constant=True), "modularity"))
register("within_party_communities", on(lambda t: structure.communities(_party_graph(t), "party"), "modularity"))
register("path_centralities", on(lambda t: structure.path_centralities(_chamber_graph(t), "chamber"), "closeness", "harmonic", "eigenvector"))
register("null_backbone", on(lambda t: structure.null_backbone(_coo(t), t.members).withColumn("p", F.round("p", 12)), "expected"))
