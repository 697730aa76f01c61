"""Every operator as a query over the given tables, next to its SQL equivalent."""

from qaloom.catalog import curation, jobs, pairs, retrieval, tables, text  # noqa: F401
from qaloom.catalog.registry import ORACLES, QUERIES  # noqa: F401
