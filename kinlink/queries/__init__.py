"""Every operator as a query on the given tables, with the SQL it is checked against."""

from kinlink.queries import clusters, crosstabs, links, signatures, stores

_MODULES = (signatures, links, crosstabs, clusters, stores)

QUERIES = {name: run for module in _MODULES for name, run in module.QUERIES.items()}
ORACLES = {name: sql for module in _MODULES for name, sql in module.ORACLES.items()}
