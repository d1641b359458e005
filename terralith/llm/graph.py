"""Connected components, as the clustering operators find them."""

from ..operators.clustering import components as connected_components

__all__ = ["connected_components"]
