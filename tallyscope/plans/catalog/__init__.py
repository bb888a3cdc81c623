"""All registered queries; importing this package fills the registry."""

from tallyscope.plans.catalog import (  # noqa: F401
    alerts,
    detectors,
    documents,
    ledgers,
    laws,
    measures,
    risks,
    rules,
)
