"""All registered queries; importing this package fills the registry."""

from rankwell.plans import audit, evaluation, identity, matching, preparation, retrieval, scoring, sources, stability, temporal, text  # noqa: F401
from rankwell.plans import catalog

QUERIES = dict(catalog.QUERIES)
ORACLES = {name: catalog.oracle_query(statement) for name, statement in catalog.ORACLES.items()}
