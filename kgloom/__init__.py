"""kgloom: knowledge-graph question answering and corpus preparation on Spark.

The names below load their modules on first use, so that Python workers import only what they run.
"""

from __future__ import annotations

import importlib

_PLACES = {
    "Config": "model", "GraphError": "model", "SearchMode": "model", "KnowledgeGraph": "graph", "HashingEncoder": "operators.vectors", "ModelEncoder": "operators.vectors",
    "Engine": "pipeline", "LanguageModel": "pipeline", "Result": "pipeline", "ScriptedModel": "pipeline",
    "SparqlSyntaxError": "plans.sparql", "check_syntax": "plans.sparql", "compile_sparql": "plans.sparql", "execute": "plans.sparql", "execute_or_empty": "plans.sparql", "run_sparql": "plans.sparql",
    "read_ntriples": "sources.rdf", "read_parquet": "sources.rdf", "write_ntriples": "sources.rdf", "write_parquet": "sources.rdf",
}
__all__ = sorted(_PLACES)


def __getattr__(name: str):
    if name in _PLACES:
        return getattr(importlib.import_module(f"{__name__}.{_PLACES[name]}"), name)
    raise AttributeError(f"module {__name__!r} has no attribute {name!r}")
