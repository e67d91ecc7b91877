"""Registered queries by family; importing this package registers all of them with the catalogue."""

from wardline.catalogue import QUERIES, SQL
from wardline.queries import aggregates, domain, entities, graphs, joins, quality, scalars, streams, territories, units

__all__ = ["QUERIES", "SQL", "aggregates", "domain", "entities", "graphs", "joins", "quality", "scalars", "streams", "territories", "units"]
