"""Text files of vertices and triangles with nested scopes and transforms.

A scope (begin ... end) begins with the transform around it; trans, scale, rot and mmult put one more inside
it, mload replaces it. Which transform holds at a line is a scan over the commands before it, in order: the commands
of a chunk become one element, which says how many scopes it closes, what it does to the one that is left, and which it
opens; elements are then applied to one another's stacks, and each chunk goes through its own commands from there.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import ETYPES, Mesh, MeshError
from ..storage import written
from . import lines as L

#: Commands in a chunk.
CHUNK = 4096
SCOPES = ("begin", "end", "trans", "scale", "rot", "mmult", "mload", "set")
#: Commands that are read over: normals, colours, textures and counters.
SKIPPED = ("n", "c", "r", "bind", "inc", "dec", "vn", "vc", "fc", "t_scale", "t_trans", "tex")

Level = tuple[bool, list, int | None, int | None]  # whether the transform is whole (or goes inside the one below), its 16 numbers, first vertex, correction
SAME: Level = (False, np.eye(4).ravel().tolist(), None, None)


def matrix(words: list[str]) -> np.ndarray:
    """The transform of a command."""
    op, m = words[0], np.eye(4)
    try:
        v = [float(x) for x in words[1:] if op != "rot"]
        if op == "trans":
            m[:3, 3] = v[:3]
        elif op == "scale":
            m[:3, :3] = np.diag(v[:3])
        elif op == "rot":
            a, i = math.radians(float(words[2])), "xyz".index(words[1])
            j, k = (i + 1) % 3, (i + 2) % 3
            m[j, j] = m[k, k] = math.cos(a)
            m[k, j], m[j, k] = math.sin(a), -math.sin(a)
        else:
            m = np.array(v).reshape(4, 4)
    except (ValueError, IndexError) as e:
        raise MeshError(f"can't read {' '.join(words)!r}") from e
    return m


def inside(outer: Level, inner: Level) -> Level:
    """One level's doing after another's."""
    whole, m, first, correction = inner
    if not whole:
        m = (np.array(outer[1]).reshape(4, 4) @ np.array(m).reshape(4, 4)).ravel().tolist()
    return whole or outer[0], m, outer[2] if first is None else first, outer[3] if correction is None else correction


def applied(stack: list[Level], words: list[str], next_vertex: int, closed: int = 0) -> tuple[list[Level], int]:
    """A stack of levels after a command, and how many levels were closed below it."""
    op, top = words[0], stack[-1]
    if op == "begin":
        return [*stack, (top[0], top[1], next_vertex, 0)], closed
    if op == "end":
        return (stack[:-1], closed) if len(stack) > 1 else ([SAME], closed + 1)
    if op == "set":
        return ([*stack[:-1], (*top[:3], int(words[2]))], closed) if words[1:2] == ["vertex_correction"] and len(words) > 2 else (stack, closed)
    return [*stack[:-1], inside(top, (op == "mload", matrix(words).ravel().tolist(), None, None))], closed


def _chunks(rows: DataFrame) -> DataFrame:
    """(chunk, closed, stack) of each chunk's commands (chunk, line, next_vertex, w)."""

    def run(own: pa.Table) -> pa.Table:
        stack, closed = [SAME], 0
        for next_vertex, words in _in_order(own, "next_vertex", "w"):
            stack, closed = applied(stack, words, next_vertex, closed)
        return pa.table({"chunk": own["chunk"].slice(0, 1), "closed": [closed], "stack": [json.dumps(stack)]})

    return rows.groupBy("chunk").applyInArrow(run, "chunk long, closed long, stack string")


def _before(chunks: DataFrame) -> DataFrame:
    """(chunk, stack): the stack before each chunk. One row a chunk goes through one task."""

    def run(batches):
        stack: list[Level] = [(True, SAME[1], 1, 0)]
        for chunk, closed, text in _rows(batches):
            yield pa.RecordBatch.from_pydict({"chunk": [chunk], "stack": [json.dumps(stack)]})
            if closed >= len(stack):
                raise MeshError("more scopes end than begin")
            stack = stack[: len(stack) - closed]
            base, *opened = json.loads(text)
            entry = stack[-1]
            stack = [*stack[:-1], inside(entry, tuple(base)), *(inside(entry, tuple(level)) for level in opened)]

    return chunks.repartition(1).sortWithinPartitions("chunk").mapInArrow(run, "chunk long, stack string")


def _rows(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple]:
    return (row for b in batches for row in zip(*(c.to_pylist() for c in b.columns), strict=True))


def _in_order(own: pa.Table, *columns: str) -> Iterator[tuple]:
    own = own.sort_by("line").select(columns)
    return zip(*(c.to_pylist() for c in own.columns), strict=True)


def _states(rows: DataFrame) -> DataFrame:
    """(line, m, first, correction): what holds after each command (chunk, line, next_vertex, w, stack).

    A chunk is a group, as only a grouping holds it together: rows that a join deals out and repartition()
    deals alike may be read where they were written, a part of a chunk here and a part there.
    """

    def run(own: pa.Table) -> pa.Table:
        stack, out = [tuple(level) for level in json.loads(own["stack"][0].as_py())], []
        for line, next_vertex, words in _in_order(own, "line", "next_vertex", "w"):
            stack, _ = applied(stack, words, next_vertex)
            out.append((line, *stack[-1][1:]))
        return pa.table([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.list_(pa.float64()), pa.int64(), pa.int64()), strict=True)], names=["line", "m", "first", "correction"])

    return rows.groupBy("chunk").applyInArrow(run, "line long, m array<double>, first long, correction long")


def read(spark: SparkSession, path: str) -> Mesh:
    """The triangles of a file, vertices and faces numbered from 1 in its order, each vertex moved by the transform of its scope.

    A face counts vertices from its scope's first one, or back from the last one if negative. Unknown commands,
    faces with another number of corners and scopes that don't match are errors.
    """
    rows = L.lines(spark, path).select(F.lit(0).alias("head_line"), "line", L.words(F.regexp_replace("text", "#.*$", "")).alias("w")).filter(F.size("w") > 0)
    op = F.get("w", F.lit(0))
    rows = written(L.counted(rows, (op == "v").cast("long")).select("line", "w", op.alias("op"), (F.col("before") + 1).alias("next_vertex")), "commands")
    shape = F.when(F.col("op") == "v", F.size("w") >= 4).when(F.col("op") == "f", F.size("w") == 4).otherwise(F.col("op").isin(*SCOPES, *SKIPPED))
    bad = rows.filter(~shape).select("line", F.array_join("w", " ")).limit(1).collect()
    if bad:
        raise MeshError(f"line {bad[0][0]}: {bad[0][1]!r}")
    scopes = rows.filter(F.col("op").isin(*SCOPES)).select(F.lit(0).alias("head_line"), "line", "next_vertex", "w")
    scopes = written(L.counted(scopes, F.lit(1)).select(F.floor(F.col("before") / CHUNK).alias("chunk"), "line", "next_vertex", "w"), "scopes")
    states = written(_states(scopes.join(_before(_chunks(scopes)), "chunk").select("chunk", "line", "next_vertex", "w", "stack")), "states")
    met = L.carried(rows, F.when(F.col("op").isin(*SCOPES), F.col("line"))).filter(F.col("op").isin("v", "f"))
    met = written(met.join(states.withColumnRenamed("line", "mark"), "mark", "left").select("line", "op", "next_vertex", F.transform("w", lambda x: x.try_cast("double")).alias("n"), "m", F.coalesce("first", F.lit(1)).alias("first"), F.coalesce("correction", F.lit(0)).alias("correction")), "placed")
    n = lambda i: F.get("n", F.lit(i))
    at = lambda r: F.when(F.col("m").isNull(), n(r + 1)).otherwise(sum((F.get("m", F.lit(4 * r + c)) * n(c + 1) for c in range(3)), F.get("m", F.lit(4 * r + 3))))
    vertex = met.filter("op = 'v'").select(F.col("next_vertex").alias("id"), *[at(r).alias(c) for r, c in enumerate("xyz")])
    if not vertex.filter("x is null or y is null or z is null").isEmpty():
        raise MeshError("a vertex has no coordinates")
    corner = lambda i: (F.when(n(i) < 0, n(i) + F.col("next_vertex")).otherwise(n(i) + F.col("correction") + F.col("first") - 1)).cast("long")
    faces = met.filter("op = 'f'").select(F.lit(0).alias("head_line"), "line", F.array(corner(1), corner(2), corner(3)).alias("conn"))
    elem = L.counted(faces, F.lit(1)).select(F.lit(ETYPES["TRI"]).alias("etype"), (F.col("before") + 1).alias("id"), "conn")
    return Mesh(vertex, elem)


def write(mesh: Mesh, path: str) -> None:
    """Write a mesh's triangles as a folder of parts, vertices numbered anew in the order of their ids; other elements are left out."""
    from ..storage import numbered

    spark = mesh.vertex.sparkSession
    vertex = written(numbered(mesh.vertex, ["id"], "place"), "vertices")
    tri = mesh.elem.filter(F.col("etype") == ETYPES["TRI"])
    at = tri.select("id", F.posexplode("conn").alias("pos", "vid")).join(vertex.select(F.col("id").alias("vid"), "place"), "vid")
    face = at.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "place"))), lambda s: s["place"].cast("string")).alias("c"))
    out = L.heading(spark, -1, "#$SMF 1.0", f"#$vertices {vertex.count()}", f"#$faces {tri.count()}")
    out = out.unionByName(vertex.select(F.lit(0).alias("section"), F.col("place").alias("at"), F.concat_ws(" ", F.lit("v"), *[L.number(F.col(c)) for c in "xyz"]).alias("text")))
    L.write(out.unionByName(face.select(F.lit(1).alias("section"), F.col("id").alias("at"), F.concat_ws(" ", F.lit("f"), F.array_join("c", " ")).alias("text"))), path)
