"""Queries over the tables, each with its SQL; importing this package registers them."""

from . import aggregates, collections, exact, extras, graphs, live, more, ordering, patterns, relations, rules, scalars, sources, streams, systems  # noqa: F401
