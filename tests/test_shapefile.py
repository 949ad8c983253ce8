import struct

from rayloom.sources.shapefile import read_shapefile


def record(nth, body):
    return struct.pack(">2i", nth, len(body) // 2) + body


def shp(kind, bodies):
    records = b"".join(record(i + 1, b) for i, b in enumerate(bodies))
    return struct.pack(">7i", 9994, 0, 0, 0, 0, 0, (100 + len(records)) // 2) + struct.pack("<2i8d", 1000, kind, *[0.0] * 8) + records


def dbf(fields, rows):
    width = 1 + sum(n for _, n in fields)
    head = struct.pack("<4BIHH20x", 3, 124, 1, 1, len(rows), 33 + 32 * len(fields), width)
    told = b"".join(name.encode().ljust(11, b"\0") + b"C" + bytes(4) + bytes([n]) + bytes(15) for name, n in fields)
    return head + told + b"\r" + b"".join(b" " + b"".join(v.encode().ljust(n) for v, (_, n) in zip(r, fields)) for r in rows) + b"\x1a"


def test_points_and_polygons(spark, tmp_path):
    (tmp_path / "a.shp").write_bytes(shp(1, [struct.pack("<i2d", 1, 1.5, 2.5), struct.pack("<i", 0), struct.pack("<i4d", 11, 7.0, 8.0, 9.0, 0.0)]))
    (tmp_path / "a.dbf").write_bytes(dbf([("name", 6), ("n", 3)], [("one", "1"), ("", "2"), ("three", "")]))
    ring = [0.0, 0.0, 4.0, 0.0, 4.0, 4.0, 0.0, 0.0]
    hole = [1.0, 1.0, 2.0, 1.0, 2.0, 2.0, 1.0, 1.0]
    (tmp_path / "b.shp").write_bytes(shp(5, [struct.pack("<i4d2i2i16d", 5, 0, 0, 4, 4, 2, 8, 0, 4, *ring, *hole)]))
    (tmp_path / "b.prj").write_text("ignored")
    got = {(r.file[-1], r.nth): r for r in read_shapefile(spark, str(tmp_path)).collect()}
    assert [(got["a", i].kind, got["a", i].x, got["a", i].y) for i in range(3)] == [("Point", 1.5, 2.5), ("Null", None, None), ("Point", 7.0, 8.0)]
    assert [got["a", i].properties for i in range(3)] == [{"name": "one", "n": "1"}, {"name": None, "n": "2"}, {"name": "three", "n": None}]
    assert got["b", 0].rings == [ring[:-2], hole[:-2]] and got["b", 0].properties == {} and len(got) == 4
