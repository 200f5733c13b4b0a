"""Column-level building blocks: sampling by hash, accuracy figures, scaling."""

from keyspan.functions.metrics import regression_metrics
from keyspan.functions.sampling import fold_of, in_fraction, sample_fraction, split
from keyspan.functions.scaling import assemble, minmax_scale, scaled_vectors

__all__ = [
    "assemble",
    "fold_of",
    "in_fraction",
    "minmax_scale",
    "regression_metrics",
    "sample_fraction",
    "scaled_vectors",
    "split",
]
