"""Registered queries and the stages that chain them."""

from siltstone.plans import checks, protocols, queries, tables  # noqa: F401
