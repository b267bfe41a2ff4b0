"""Text formats whose records go over several lines; what can't be read is an error, not a loss."""

import struct

import pytest
from pyspark.sql import functions as F

from meshloom.model import ETYPES, Mesh, MeshError
from meshloom.sources import cards, gmsh, lines, stl


def write(tmp_path, text, name="file"):
    path = tmp_path / name
    path.write_text(text)
    return f"file://{path}"


def elements(mesh):
    return sorted((r.etype, r.id, list(r.conn)) for r in mesh.elem.collect())


def tag(mesh, name):
    return {(r.etype, r.id): r.value for r in mesh.tag(name).values.collect()}


def test_sections_and_records_over_many_chunks(spark, monkeypatch):
    monkeypatch.setattr(lines, "CHUNK", 3)
    text = ["x", "*A", *[f"a{i}" for i in range(10)], "*B", "*C", "c0", "c1"]
    rows = spark.createDataFrame(list(enumerate(text, 1)), "line long, text string").repartition(3)
    got = lines.sections(rows, r"^\*").groupBy("head").agg(F.sort_array(F.collect_list("text")).alias("t")).collect()
    assert {r.head: r.t for r in got} == {"*A": [f"a{i}" for i in range(10)], "*C": ["c0", "c1"]}
    got = sorted(map(tuple, lines.records(rows, F.col("text").startswith("*")).collect()))
    assert got == [(2, ["*A", *[f"a{i}" for i in range(10)]]), (13, ["*B"]), (14, ["*C", "c0", "c1"])]


def test_abaqus_lines_that_go_on(spark, tmp_path):
    text = "\n".join(
        ["*HEADING", "a model", "** note", "*NODE, NSET=all", *[f"{i}, {i}.0, 0.5," if i % 2 else f"{i}, {i}.0" for i in range(1, 21)]]
    ).replace("0.5,", "0.5,\n 2.5")
    text += "\n*ELEMENT, TYPE=C3D8R,\n ELSET=Left\n1, 1, 2, 3, 4,\n** note inside\n5, 6, 7, 8\n*Element, type=C3D20\n2,1,2,3,4,5,6,7,8,9,10,11,12,\n13,14,15,16,17,18,\n19,20\n*ELEMENT,TYPE=S8R\n3,1,2,3,4,5,6,7,8\n*ELEMENT,TYPE=STRI65\n4,1,2,3,4,5,6\n*ELEMENT, TYPE=C3D15\n5,1,2,3,4,5,6,7,8,9,10,11,12,13,14,15\n*MATERIAL\n"
    mesh = cards.abaqus(spark, write(tmp_path, text))
    hexa = [*range(1, 13), *range(17, 21), *range(13, 17)]
    prism = [1, 2, 3, 4, 5, 6, 7, 8, 9, 13, 14, 15, 10, 11, 12]
    assert elements(mesh) == [(ETYPES["TRI"], 4, [1, 2, 3, 4, 5, 6]), (ETYPES["QUAD"], 3, list(range(1, 9))), (ETYPES["PRISM"], 5, prism), (ETYPES["HEX"], 1, list(range(1, 9))), (ETYPES["HEX"], 2, hexa)]
    assert tag(mesh, "NAME") == {(ETYPES["HEX"], 1): "LEFT"} and mesh.vertex.count() == 20
    assert mesh.vertex.filter("id = 3").first()[1:] == (3.0, 0.5, 2.5)
    for bad in ("*ELEMENT, TYPE=C3D8\n1, 1, 2, 3, 4, 5, 6, 7", "*ELEMENT, TYPE=COHAX4\n1, 1, 2, 3, 4"):
        with pytest.raises(MeshError):
            cards.abaqus(spark, write(tmp_path, "*NODE\n1,0,0,0\n" + bad, "bad"))


def test_nastran_fields_and_continuations(spark, tmp_path):
    rows = [f"GRID    {i:8d}        {float(i):8.3f}{0.5:8.2f}  -1.5-3" for i in range(1, 5)]
    rows += [f"GRID*   {5:16d}{'':16}{6.25:16}{-1.5:16}", f"*       {'2.5E1':>16}", "GRID,6,,7.0,8.,9.", "$ note"]
    rows += [f"GRID    {i:8d}            0.0     0.0     0.0" for i in range(7, 21)]
    rows += ["CHEXA          1       3       1       2       3       4       5       6+A", "+A             7       8", "CTRIA3,2,4,1,2,3", "CBAR           3       5       1       2     1.0     0.0     0.0"]
    rows += ["CHEXA          4       3       1       2       3       4       5       6+", "+              7       8       9      10      11      12      13      14+", "              15      16      17      18      19      20"]
    rows += ["CQUAD4*                9               7               1               2", "*                      3               4", "PSHELL         7       1     0.1"]
    mesh = cards.nastran(spark, write(tmp_path, "\n".join(rows)))
    assert elements(mesh) == [(ETYPES["EDGE"], 3, [1, 2]), (ETYPES["TRI"], 2, [1, 2, 3]), (ETYPES["QUAD"], 9, [1, 2, 3, 4]), (ETYPES["HEX"], 1, list(range(1, 9))), (ETYPES["HEX"], 4, list(range(1, 21)))]
    at = {r.id: (r.x, r.y, r.z) for r in mesh.vertex.collect()}
    assert len(at) == 20 and at[2] == (2.0, 0.5, -0.0015) and at[5] == (6.25, -1.5, 25.0) and at[6] == (7.0, 8.0, 9.0)
    assert tag(mesh, "MATERIAL_SET")[(ETYPES["QUAD"], 9)] == 7
    with pytest.raises(MeshError):
        cards.nastran(spark, write(tmp_path, "CHEXA          1       3       1       2       3       4       5       6", "bad"))


def second_order(spark):
    kinds = [("EDGE", 3), ("TRI", 6), ("QUAD", 8), ("QUAD", 9), ("TET", 10), ("HEX", 20), ("HEX", 27), ("PRISM", 15), ("PYRAMID", 13), ("TET", 4)]
    elem = spark.createDataFrame([(ETYPES[k], i, [100 * i + j for j in range(n)]) for i, (k, n) in enumerate(kinds, 1)], "etype int, id long, conn array<long>")
    vertex = elem.select(F.explode("conn").alias("id")).select("id", *[(F.col("id") / k).alias(c) for k, c in ((1, "x"), (3, "y"), (7, "z"))])
    return Mesh(vertex, elem)


def test_gmsh_second_order(spark, tmp_path):
    mesh = second_order(spark)
    gmsh.write(mesh, f"file://{tmp_path}/out")
    back = gmsh.read(spark, f"file://{tmp_path}/out")
    assert elements(back) == elements(mesh) and back.vertex.exceptAll(mesh.vertex).count() == 0
    head, nodes = "$MeshFormat\n2.2 0 8\n$EndMeshFormat\n", "$Nodes\n1\n1 0 0 0\n$EndNodes\n$Elements\n1\n"
    file = gmsh.read(spark, write(tmp_path, head + nodes.replace("\n1\n1 0", "\n1\n1 0") + "1 11 2 5 6 " + " ".join(map(str, range(10))) + "\n2 15 2 0 0 1\n$EndElements\n"))
    assert elements(file) == [(ETYPES["TET"], 1, [0, 1, 2, 3, 4, 5, 6, 7, 9, 8])]  # the last two edges stand the other way round
    assert tag(file, "MATERIAL_SET") == {(5, 1): 5} and tag(file, "PARTITION_GROUP") == {(5, 1): 6}
    for line, version in (("1 13 2 0 0 " + " ".join(["1"] * 18), "2.2"), ("1 4 2 0 0 1 1 1", "2.2"), ("1 4 2 0 0 1 1 1 1", "4.1")):
        with pytest.raises(MeshError):
            gmsh.read(spark, write(tmp_path, head.replace("2.2", version) + nodes + line + "\n$EndElements\n", "bad"))
    with pytest.raises(MeshError):
        gmsh.write(Mesh(mesh.vertex, spark.createDataFrame([(ETYPES["POLYGON"], 1, [100, 101, 102])], mesh.elem.schema)), f"file://{tmp_path}/no")


def test_ideas_records_of_different_length(spark, tmp_path, monkeypatch):
    """Lines of nodes that look like first lines; chunks that begin inside a record."""
    monkeypatch.setattr(lines, "CHUNK", 4)
    rows = ["    -1", "   164", "  header", "    -1", "    -1", "  2411"]
    for i in range(1, 10):
        rows += [f"{i:10d}         1         1        11", f"  {i}.0000000000000000D+00   0.5D+00   1.0E-01"]
    rows += ["    -1", "    -1", "  2412"]
    want = []
    for i in range(1, 40):
        kind, n, name = ((115, 8, "HEX"), (21, 2, "EDGE"), (111, 4, "TET"), (44, 4, "QUAD"))[i % 4]
        conn = [(i + j) % 9 + 1 for j in range(n)]
        rows += [f"{i:10d}{kind:10d}{2:10d}{i % 3:10d}{7:10d}{n:10d}"] + (["         0         1         1"] if kind == 21 else []) + ["".join(f"{v:10d}" for v in conn)]
        want.append((ETYPES[name], i, conn))
    mesh = cards.ideas(spark, write(tmp_path, "\n".join([*rows, "    -1"])))
    assert elements(mesh) == sorted(want) and mesh.vertex.filter("id = 4").first()[1:] == (4.0, 0.5, 0.1)
    assert tag(mesh, "MATERIAL_SET")[(ETYPES["EDGE"], 5)] == 2 and tag(mesh, "PHYSICAL_SET")[(ETYPES["EDGE"], 5)] == 2
    with pytest.raises(MeshError):
        cards.ideas(spark, write(tmp_path, "\n".join(["    -1", "  2412", "         1       118         1         1         7        10", "1 2 3 4 5 6 7 8", "9 10", "    -1"]), "bad"))


def test_binary_stl(spark, tmp_path):
    facets = [((0, 0, 0), (1, 0, 0), (0, 1, 0)), ((1, 0, 0), (1, 1, 0), (0, 1, -0.0))]
    data = b"solid?".ljust(80) + struct.pack("<I", 2) + b"".join(struct.pack("<12fH", 0, 0, 1, *[c for p in f for c in p], 0) for f in facets)
    folder = tmp_path / "stl"
    folder.mkdir()
    (folder / "a.stl").write_bytes(data)
    (folder / "b.stl").write_bytes(data)
    mesh = stl.read_binary(spark, f"file://{folder}")
    assert mesh.vertex.count() == 4 and [r[1] for r in elements(mesh)] == [1, 2, 3, 4]
    at = {r.id: (r.x, r.y) for r in mesh.vertex.collect()}
    assert [[at[v] for v in conn] for _, _, conn in elements(mesh)] == [[p[:2] for p in f] for f in facets] * 2
    (folder / "c.stl").write_bytes(data[:-1])
    with pytest.raises(Exception, match="no binary file"):
        stl.read_binary(spark, f"file://{folder}")


@pytest.mark.parametrize("chunk", [4096, 3])
def test_smf_scopes_and_transforms(spark, tmp_path, monkeypatch, chunk):
    """Nested scopes cut over many chunks, against a walk line by line."""
    import numpy as np

    from meshloom.sources import smf

    monkeypatch.setattr(smf, "CHUNK", chunk)
    text = ["#$SMF 1.0", "v 1 2 3", "begin", "trans 1 0 0", "v 0 0 0", "begin", "rot z 90", "scale 2 2 2", "v 1 0 0", "v 0 1 0", "f 1 2 -1", "end", "v 1 1 1", "f 1 2 3", "trans 0 0 5", "begin", "mload 1 0 0 9 0 1 0 8 0 0 1 7 0 0 0 1", "v 0 0 0", "end", "v 0 0 0", "end", "v 4 5 6", "begin", "mmult 0 1 0 0 1 0 0 0 0 0 1 0 0 0 0 1 # swap", "set vertex_correction -1", "v 7 8 9", "v 7 8 9", "f 2 3 -2", "end"]
    mesh = smf.read(spark, write(tmp_path, "\n".join(text)))
    at = {r.id: (round(r.x, 9) + 0.0, round(r.y, 9) + 0.0, round(r.z, 9) + 0.0) for r in mesh.vertex.collect()}
    assert at == {1: (1, 2, 3), 2: (1, 0, 0), 3: (1, 2, 0), 4: (-1, 0, 0), 5: (2, 1, 1), 6: (9, 8, 7), 7: (1, 0, 5), 8: (4, 5, 6), 9: (8, 7, 9), 10: (8, 7, 9)}
    assert [c for _, _, c in elements(mesh)] == [[3, 4, 4], [2, 3, 4], [9, 10, 9]]
    assert np.allclose(smf.matrix(["rot", "x", "90"])[:3, :3] @ [0, 1, 0], [0, 0, 1])
    for bad in ("end", "f 1 2", "frob 1", "begin\nend\nend", "trans 1 x 0\nv 1 1 1"):
        with pytest.raises(Exception, match="."):
            smf.read(spark, write(tmp_path, bad, "bad")).vertex.count()
    smf.write(mesh, f"file://{tmp_path}/out{chunk}")
    back = smf.read(spark, f"file://{tmp_path}/out{chunk}")
    assert back.vertex.exceptAll(mesh.vertex).count() == 0


def test_smf_chunks_that_lie_in_several_files(spark, tmp_path, monkeypatch):
    """A chunk's commands come from several files, and their stacks turn out small enough to broadcast while the join runs."""
    from meshloom.sources import lines, smf

    monkeypatch.setattr(lines, "CHUNK", 8)
    monkeypatch.setattr(smf, "CHUNK", 64)
    text = ["begin", "trans 0 0 1", *[x for i in range(100) for x in ("begin", f"trans {i} 0 0", "v 0 0 0", "v 1 0 0", "v 0 1 0", "f 1 2 3", "end")], "end"]
    conf = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "8k", "spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.files.maxPartitionBytes": "1k", "spark.sql.files.openCostInBytes": "0"}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        got = smf.read(spark, write(tmp_path, "\n".join(text), "scenes")).vertex.orderBy("id").collect()
    finally:
        for k in conf:
            spark.conf.unset(k)
    assert [tuple(r) for r in got] == [(3 * i + j + 1, i + (j == 1), float(j == 2), 1.0) for i in range(100) for j in range(3)]
