"""Queries over the driver's tables; each module registers its own."""

from loomgraph.plans import context, index, queries, services, structure, texts, themes, upserts  # noqa: F401
