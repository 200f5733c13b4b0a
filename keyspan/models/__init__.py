"""Regression, clustering and tree models per key or over a whole table."""

from keyspan.models.clustering import (
    bisecting_kmeans,
    cluster_centers,
    gaussian_mixture,
    gaussians,
    kmeans,
    lda,
    lda_quality,
    split_tree,
)
from keyspan.models.components import components_for_variance
from keyspan.models.forest_search import (
    children_together,
    load_together,
    parents_together,
    save_together,
    search_together,
    train_together,
)
from keyspan.models.forests import predicted
from keyspan.models.linear import linear_regression, lr_params
from keyspan.models.power_iteration import power_iteration
from keyspan.models.transfer import (
    ensemble,
    train_children,
    train_from_first,
    train_incremental,
    train_parents,
    train_until,
)
from keyspan.models.trees import (
    gradient_boost,
    gradient_boost_exhaustive,
    random_forest,
    random_forest_exhaustive,
    tree_params,
)

__all__ = [
    "bisecting_kmeans",
    "children_together",
    "cluster_centers",
    "components_for_variance",
    "ensemble",
    "gaussian_mixture",
    "gaussians",
    "gradient_boost",
    "gradient_boost_exhaustive",
    "kmeans",
    "lda",
    "lda_quality",
    "linear_regression",
    "load_together",
    "lr_params",
    "parents_together",
    "power_iteration",
    "predicted",
    "random_forest",
    "random_forest_exhaustive",
    "save_together",
    "search_together",
    "split_tree",
    "train_children",
    "train_from_first",
    "train_incremental",
    "train_parents",
    "train_together",
    "train_until",
    "tree_params",
]
