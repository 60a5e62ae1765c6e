"""The registered queries; importing this package registers all of them."""

from . import artifacts, candidates, conditionals, discovery, evaluation, fingerprinting, grouping, history, projections, ranking, scalars, semantics, sources, stores, syntax, verification  # noqa: F401
