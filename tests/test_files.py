import json
import struct

import pytest
from pyspark.sql import functions as F

from wardline.sources import files


def test_csv(spark, tmp_path):
    at = tmp_path / "a.csv"
    at.write_text('﻿name,place,n\n"Rao, A","5th ""Main""\nroad",3\nB,,x\n', encoding="utf-8")
    rows = files.read_csv(spark, str(at)).collect()
    assert [tuple(r) for r in rows] == [("Rao, A", '5th "Main"\nroad', "3"), ("B", None, "x")]
    assert dict(files.read_csv(spark, str(at), infer=True).dtypes) == {"name": "string", "place": "string", "n": "string"}
    at.write_text("# note\nunit, decision\na , keep\nb,\nc,  \n")
    assert [tuple(r) for r in files.resolutions(spark, str(at)).collect()] == [("a", "keep")]
    at.write_text("a,b\n1,2\n3\n4,5,6\n")
    rows = files.read_csv(spark, str(at), schema="a string, b string, bad string", ragged="bad").collect()
    assert [(r.a, r.b) for r in rows] == [("1", "2"), ("3", None), ("4", "5")] and [r.bad is None for r in rows] == [True, False, False]


def test_documents(spark, tmp_path):
    (tmp_path / "x.ndjson").write_text('{"id": "a", "v": [1, 0]}\n{"id": "a", "v": [0, 1]}\n{"id": "b", "v": [1, 1]}\n')
    rows = files.read_ndjson(spark, str(tmp_path / "x.ndjson"), "id string, v array<int>")
    keys = spark.createDataFrame([("a",), ("b",)], "id string")
    assert sorted((r.id, r.v) for r in files.wanted(rows, "id", keys).collect()) == [("a", [0, 1]), ("b", [1, 1])]
    with pytest.raises(Exception, match="no row for c"):
        files.wanted(rows, "id", spark.createDataFrame([("c",)], "id string")).collect()
    assert files.document(rows, "id", "b") == {"id": "b", "v": [1, 1]} and files.document(rows, "id", "z") is None
    (tmp_path / "g.json").write_text(json.dumps({"type": "FeatureCollection", "features": [{"properties": {"code": 1}}, {"properties": {"code": 2}}]}, indent=1))
    assert [r.properties.code for r in files.read_features(spark, str(tmp_path / "g.json"), "properties: struct<code: int>").collect()] == [1, 2]
    mark = '<Placemark><ExtendedData><SchemaData schemaUrl="s"><SimpleData name="POL_STAName">{}</SimpleData></SchemaData></ExtendedData>{}</Placemark>'
    point = "<Point><coordinates>{}</coordinates></Point>"
    (tmp_path / "k.kml").write_text("<kml><Document>" + mark.format("A", point.format("77.5,12.9,0")) + mark.format("B", "<MultiGeometry>" + point.format("77.6,13.0") + "</MultiGeometry>") + mark.format("C", point.format("x,y")) + "</Document></kml>")
    assert sorted(tuple(r) for r in files.read_placemarks(spark, str(tmp_path / "k.kml")).collect()) == [("A", 12.9, 77.5), ("B", 13.0, 77.6)]
    (tmp_path / "m.bin").write_bytes(struct.pack("<3f", 1.5, 2.5, 3.5))
    assert [r.value for r in files.read_array(spark, str(tmp_path / "m.bin"), "<f4", 3).orderBy("place").collect()] == [1.5, 2.5, 3.5]
    with pytest.raises(Exception, match="has 3 values"):
        files.read_array(spark, str(tmp_path / "m.bin"), "<f4", 4).collect()


def test_views(spark, tmp_path):
    spark.range(3).write.parquet(str(tmp_path / "mo_signatures.parquet"))
    assert files.register_all(spark, str(tmp_path)) == ["MoSignatures"] and spark.table("MoSignatures").count() == 3


def test_writers_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1, 'a "b", c\nd', ""), (2, None, "x")], "k long, t string, u string")
    assert files.write_typed(df, str(tmp_path / "p"), {"k": "int", "t": "string", "u": "string"}) == 2
    back = spark.read.parquet(str(tmp_path / "p"))
    assert back.dtypes[0] == ("k", "int") and back.filter("u IS NULL").count() == 1
    files.write_csv(df, str(tmp_path / "c"))
    assert sorted(str(r.t) for r in files.read_csv(spark, str(tmp_path / "c")).collect()) == ["None", 'a "b", c\nd']
    assert [r[0] for r in df.orderBy("k").select(files.cell_text(F.col("t"))).collect()] == ['"a ""b"", c\nd"', ""]
    files.write_ndjson(df, str(tmp_path / "j"))
    assert files.read_ndjson(spark, str(tmp_path / "j"), df.schema).exceptAll(df).isEmpty()
    found = files.manifest(spark, str(tmp_path / "j")).collect()
    assert found and all(len(r.sha256) == 64 and r.bytes > 0 for r in found if r.file.endswith(".json"))
    assert "| 2 |  | x |" in files.report("t", df)


def test_puts(spark, tmp_path):
    path = files.put_document(str(tmp_path), "a", {"x": 1})
    assert json.load(open(path)) == {"id": "a", "x": 1} and [p.name for p in tmp_path.iterdir()] == ["a.json"]
    clock = [100.0]
    cache = files.Cache(str(tmp_path / "cache"), lambda: clock[0])
    cache.put("k", [1], 10)
    assert cache.get("k") == [1] and cache.get("other") is None
    clock[0] = 111.0
    assert cache.get("k") is None
    old = spark.createDataFrame([(1, "a"), (2, "b")], "k long, v string")
    new = spark.createDataFrame([(2, "c"), (3, "d"), (1, "a")], "k long, v string")
    assert sorted(tuple(r) for r in files.upsert(old, new, "k").collect()) == [(1, "a"), (2, "c"), (3, "d")]
    assert sorted(tuple(r) for r in files.changed(new, old).collect()) == [(2, "c"), (3, "d")]
    counts = spark.createDataFrame([("s", "h", 3), ("s", "g", 5), ("t", "h", 1)], "station string, head string, n long")
    assert {r.key: json.loads(r.value) for r in files.warm(counts, 1).collect()} == {"station:s": [{"head": "g", "n": 5}, {"head": "h", "n": 3}]}
    parts = spark.createDataFrame([("x" * 25,)], "v string").select(files.pieces(F.col("v"), 10).alias("p")).first().p
    assert [len(p.said) for p in parts] == [10, 10, 5]
