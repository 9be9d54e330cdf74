"""A knowledge graph: triples with derived labels and inverse relations."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kgloom.model import OWL_INVERSE, RDFS_LABEL


class KnowledgeGraph:
    """Triples (s, p, o, o_kind, o_datatype, o_lang) as a set."""

    def __init__(self, triples: DataFrame, labels: DataFrame | None = None, inverses: DataFrame | None = None):
        self.triples = triples
        self._labels, self._inverses = labels, inverses

    @cached_property
    def labels(self) -> DataFrame:
        """(uri, label): one label for each uri, the least."""
        if self._labels is not None:
            return self._labels
        return self.triples.where((F.col("p") == RDFS_LABEL) & (F.col("o_kind") == "literal")).groupBy(F.col("s").alias("uri")).agg(F.min("o").alias("label"))

    @cached_property
    def inverses(self) -> DataFrame:
        """(p, inv): the declared inverse of each relation, read in the declared direction; the least if several."""
        if self._inverses is not None:
            return self._inverses
        return self.triples.where(F.col("p") == OWL_INVERSE).groupBy(F.col("s").alias("p")).agg(F.min("o").alias("inv"))
