"""Named queries over a folder of tables, with their SQL twins."""

from graphloom.plans import answers, data_quality, graph, retrieval, streams, text

_MODULES = [data_quality, graph, text, retrieval, streams, answers]
REGISTRY = {name: query for module in _MODULES for name, query in module.QUERIES.items()}
ORACLES = {name: sql for module in _MODULES for name, sql in getattr(module, "ORACLES", {}).items()}
