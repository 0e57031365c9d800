"""All queries of the library by name, and the SQL they are held against."""

from . import connectors, expressions, further, geography, grids, lattices, relations, scenarios, series, streams, training

FAMILIES = [expressions, series, geography, relations, streams, further, grids, scenarios, training, connectors, lattices]
QUERIES = {name: f for m in FAMILIES for name, f in m.REG.queries.items()}
ORACLES = {name: s for m in FAMILIES for name, s in m.REG.oracles.items()}
