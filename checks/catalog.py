"""All registered queries (importing a module registers its entries)."""

from checks import queries_relational, queries_customers, queries_value, queries_models  # noqa: F401
from checks.registry import ENTRIES

__all__ = ["ENTRIES"]
