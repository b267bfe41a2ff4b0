"""The mesh data model: entities, sets and tags as DataFrames.

vertex(id, x, y, z); elem(etype, id, conn) with ordered vertex ids in conn; member(set_id, pos, etype, id);
link(parent_id, child_id); a tag is a table (etype, id, value) of the entities that have a value, and
perhaps a default for the others. Entities are named by (etype, id).
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Entity types and their numbers.
ETYPES = {"VERTEX": 0, "EDGE": 1, "TRI": 2, "QUAD": 3, "POLYGON": 4, "TET": 5, "PYRAMID": 6, "PRISM": 7, "KNIFE": 8, "HEX": 9, "POLYHEDRON": 10, "ENTITYSET": 11}
# Dimension of each entity type, in the order of their numbers.
DIMENSIONS = (0, 1, 2, 2, 2, 3, 3, 3, 3, 3, 3, 4)


class MeshError(ValueError):
    """A request that has no answer: an unknown type, a missing tag value without default, and the like."""


def etype_of(name: str | int) -> int:
    if isinstance(name, int) and 0 <= name < len(DIMENSIONS):
        return name
    if name in ETYPES:
        return ETYPES[name]
    raise MeshError(f"unknown entity type {name!r}")


def dimension(etype: Column) -> Column:
    return F.element_at(F.array(*[F.lit(d) for d in DIMENSIONS]), etype.cast("int") + 1)


def elem_vertex(elem: DataFrame) -> DataFrame:
    """(etype, id, pos, vid): a row for each vertex of each element, in order."""
    return elem.select("etype", "id", F.posexplode("conn").alias("pos", "vid"))


@dataclass(frozen=True)
class Tag:
    """Values of some entities, and the value that the others count as having (None: none)."""

    values: DataFrame
    default: object = None


@dataclass(frozen=True)
class Mesh:
    vertex: DataFrame
    elem: DataFrame
    tags: Mapping[str, Tag] = field(default_factory=dict)
    member: DataFrame | None = None
    link: DataFrame | None = None

    def tag(self, name: str) -> Tag:
        if name not in self.tags:
            raise MeshError(f"no tag {name!r}")
        return self.tags[name]

    def entities(self) -> DataFrame:
        """(etype, id) of every vertex and element."""
        vertices = self.vertex.select(F.lit(ETYPES["VERTEX"]).alias("etype"), "id")
        return vertices.unionByName(self.elem.select(F.col("etype").cast("int").alias("etype"), "id"))
