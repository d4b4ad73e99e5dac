"""All named queries.  Importing this package fills the registry."""

from nightframe.plans.catalog import aggregates, evaluation, modeling, order, rows, scalars, signals  # noqa: F401
from nightframe.plans.catalog.aggregates import flagship  # noqa: F401
