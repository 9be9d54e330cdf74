"""Configuration, schemas, exceptions and search modes."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace
from enum import StrEnum

TRIPLES = "s string, p string, o string, o_kind string, o_datatype string, o_lang string"
LABELS = "uri string, label string"
INVERSES = "p string, inv string"
COLLECTION = "id string, uri string, label string, description string, embedding array<float>"
SEEDS = "question_id string, entity_uri string, label string, source string, score double, description string, entity_from string, entity_types array<string>"
RELATIONS = "question_id string, relation_uri string, label string, distance double, description string, relation_from string, relation_types array<string>"
STEP = "struct<s: string, p: string, o: string>"
PLACE = "struct<uri: string, label: string, is_node: boolean>"
MERGED = "struct<subject: string, subject_uri: string, predicate: string, predicate_uri: string, object: string, object_uri: string>"
MENTION = "struct<name: string, types: array<string>>"
QUESTIONS = "id string, query_type string, question struct<`1`: string, `2`: string>, golden_entities array<string>, golden_relations array<string>, golden_sparql string, answer array<map<string, struct<type: string, value: string>>>"

RDF_TYPE = "http://www.w3.org/1999/02/22-rdf-syntax-ns#type"
RDFS_LABEL = "http://www.w3.org/2000/01/rdf-schema#label"
OWL_INVERSE = "http://www.w3.org/2002/07/owl#inverseOf"
XSD = "http://www.w3.org/2001/XMLSchema#"


class GraphError(Exception):
    """Base of all errors of this package."""


class ConfigurationError(GraphError):
    """A setting is missing or contradicts another."""


class PipelineError(GraphError):
    """A stage of the question pipeline failed."""


class SeedNodeError(PipelineError):
    """Seeds could not be found."""


class SubgraphExtractionError(PipelineError):
    """Paths could not be grown."""


class SPARQLGenerationError(PipelineError):
    """No usable query was generated."""


class SPARQLExecutionError(PipelineError):
    """A query failed or took too long."""


class AnswerGenerationError(PipelineError):
    """No answer was generated."""


class EntityNotFoundError(GraphError):
    """A URI is not in the graph."""


class ValidationError(GraphError):
    """An input does not have the expected form."""


class VectorDBError(GraphError):
    """A vector collection is missing or broken."""


class SchemaError(GraphError):
    """A graph schema is missing or broken."""


class SearchMode(StrEnum):
    hybrid = "hybrid"
    keyword = "keyword"
    semantic = "semantic"


@dataclass(frozen=True)
class Config:
    """All settings; ``preset`` gives the named early-stopping variants."""

    min_subgraphs: int = 3
    max_subgraphs: int = 15
    quality_threshold_ratio: float = 0.65
    absolute_prob_threshold: float = 1.5
    enable_neighbor_limiting: bool = True
    neighbor_limit: int = 100
    seed_relation_boost: float = 1.2
    seed_relation_max_k: int = 5
    enable_schema_based_filtering: bool = False
    enable_restricted_relation_filtering: bool = False
    restricted_relations: tuple[str, ...] = ()
    semantic_similarity_threshold: float = 0.5
    fuzzy_match_threshold: float = 0.7
    schema_top_k_entities: int = 5
    schema_top_k_relations: int = 5
    use_schema_aware_templates: bool = True
    collection_name: str = "top_entity_descriptions"
    relation_collection_name: str = "relation_descriptions"
    type_prefix: str = "http://kg.example/schema#"
    excluded_predicate_labels: tuple[str, ...] = ("authorOf",)
    execution_timeout: float = 15.0
    sparql_instruction: str | None = None
    extraction_instruction: str | None = None
    sparql_artifact: dict | None = None
    extraction_artifact: dict | None = None
    use_optimized_prompts: bool = True
    few_shot: tuple[tuple[str, str], ...] = ()
    entity_descriptor: Callable | None = field(default=None, compare=False)
    relation_descriptor: Callable | None = field(default=None, compare=False)

    @classmethod
    def preset(cls, name: str, **more) -> Config:
        least, most, ratio, floor = {"default": (3, 15, 0.65, 1.5), "aggressive": (2, 10, 0.75, 2.0), "conservative": (5, 20, 0.4, 1.0), "disabled": (25, 25, 0.65, 1.5)}[name]
        return cls(min_subgraphs=least, max_subgraphs=most, quality_threshold_ratio=ratio, absolute_prob_threshold=floor, **more)

    def with_(self, **changes) -> Config:
        return replace(self, **changes)

    def instruction(self, stage: str, default: str, explicit: str | None = None) -> str:
        """A prompt's instruction: explicit argument, then own setting, then optimised artifact, then default."""
        own = getattr(self, f"{stage}_instruction")
        artifact = getattr(self, f"{stage}_artifact") if self.use_optimized_prompts else None
        learnt = ((artifact or {}).get("predict") or {}).get("signature", {}).get("instructions")
        return explicit or own or learnt or default
