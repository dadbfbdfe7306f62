"""Query plans over the driver tables."""

from . import q_detectors, q_models, q_registry, q_relations, q_scalars, q_streams, q_windows  # noqa: F401
from .registry import QUERIES, SQL  # noqa: F401
