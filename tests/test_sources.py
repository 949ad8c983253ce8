"""Files in, files out."""

import json

from pyspark.sql import functions as F

from rayloom.sources import coco, tables

DOC = {
    "images": [{"id": 1, "file_name": "images/a.jpg", "width": 100, "height": 50}, {"id": 2, "file_name": "images/b.jpg", "width": 100, "height": 50}],
    "annotations": [{"id": 7, "image_id": 1, "category_id": 1, "iscrowd": 0, "bbox": [1, 2, 3, 4], "area": 12, "segmentation": [[1, 2, 4, 2, 4, 6, 1, 6]]}, {"id": 8, "image_id": 9, "category_id": 1, "segmentation": [[0, 0, 1, 0, 1, 1]]}],
    "categories": [{"id": 1, "name": "cover", "supercategory": "plate"}],
}


def test_coco_round_trip(spark, tmp_path):
    (tmp_path / "doc.json").write_text(json.dumps(DOC))
    path = str(tmp_path / "doc.json")
    images, anns, cats = coco.read_images(spark, path), coco.read_annotations(spark, path), coco.read_categories(spark, path)
    assert [len(r.annotations) for r in coco.nested(images, anns).orderBy("image_id").collect()] == [1, 0]
    assert [r.id for r in coco.orphans(images, anns).collect()] == [8]
    label = coco.labels(images, anns).first()
    assert (label.label_id, label.file_name, tuple(label.box)) == (7, "a.jpg", (1.0, 2.0, 3.0, 4.0))
    said = json.loads(coco.document(images.withColumnRenamed("image_id", "id"), anns, cats).first().value)
    assert len(said["images"]) == 2 and said["annotations"][0]["bbox"] == [1.0, 2.0, 3.0, 4.0] and said["categories"] == DOC["categories"]
    per = coco.documents(images.select(F.col("image_id").alias("id"), "file_name", F.when(F.col("image_id") == 1, "trn").otherwise("val").alias("dataset")), anns.filter("id = 7"), cats)
    assert {r.dataset: len(json.loads(r.value)["annotations"]) for r in per.collect()} == {"trn": 1, "val": 0}
    line = coco.yolo_lines(anns.filter("id = 7"), images).first()
    assert line.line.split()[:3] == ["0", "0.01", "0.04"]


def test_detections_as_array_or_document(spark, tmp_path):
    det = {"id": 3, "file_name": "t/x_0_0.jpg", "category_id": 1, "score": 0.5, "bbox": [4, 4, 2, 2], "segmentation": [[0, 0, 1, 0, 1, 1]]}
    (tmp_path / "a.json").write_text(json.dumps([det, det | {"det_id": 9, "det_class": 4}]))
    (tmp_path / "b.json").write_text(json.dumps({"annotations": [det]}))
    got = coco.read_detections(spark, {"val": str(tmp_path / "a.json"), "tst": str(tmp_path / "b.json")})
    assert sorted((r.dataset, r.det_id, r.det_class, r.file_name) for r in got.collect()) == [("tst", 3, 0, "x_0_0.jpg"), ("val", 3, 0, "x_0_0.jpg"), ("val", 9, 4, "x_0_0.jpg")]
    assert coco.confident(got, 0.6).count() == 0 and got.select(coco.from_centre().alias("b")).first().b == [3.0, 3.0, 2.0, 2.0]
    images = spark.createDataFrame([(5, "z/x_0_0.jpg")], "image_id long, file_name string")
    assert {r.image_id for r in coco.in_images(got, images).collect()} == {5}


def test_trajectories_and_layers(spark, tmp_path):
    (tmp_path / "t.csv").write_text("file_name,datetimeoriginal,x_m_,y_m_,z_m_,gpsimgdirection,gpspitch,gpsroll,gps_sec_s_\np1,now,1,2,3,4,5,6,7\n")
    row = tables.read_trajectory(spark, str(tmp_path / "t.csv")).first()
    assert (row.file_name, row.x, row.yaw, row.time) == ("p1.jpg", 1.0, 4.0, 7.0)
    item = {"dataSourceId": "lb4-1", "gpsWeekSeconds": 1.5, "imagePath": ["x/102-lb4-0-35582.jpg"], "x": 1, "y": 2, "z": 3, "rx": 0, "ry": 0, "rz": 0}
    (tmp_path / "v").mkdir()
    (tmp_path / "v/a.json").write_text(json.dumps({"items": [item, item | {"dataSourceId": "car"}]}))
    (tmp_path / "v/b.json").write_text("{broken")
    got = tables.read_vendor_trajectory(spark, str(tmp_path / "v")).collect()
    assert [(r.frame_id, r["size"], r.camera_model) for r in got] == [("102-35582", 2048, "lb4")]
    layer = {"type": "FeatureCollection", "features": [{"type": "Feature", "properties": {"k": "1"}, "geometry": {"type": "Point", "coordinates": [1, 2]}}, {"type": "Feature", "properties": {}, "geometry": {"type": "Polygon", "coordinates": [[[0, 0], [1, 0], [1, 1]]]}}]}
    (tmp_path / "l.json").write_text(json.dumps(layer))
    rows = tables.read_geojson(spark, str(tmp_path / "l.json")).orderBy("kind").collect()
    assert (rows[0].x, rows[0].properties["k"]) == (1.0, "1") and rows[1].rings == [[0.0, 0.0, 1.0, 0.0, 1.0, 1.0]]
    said = json.loads(tables.geojson_lines(spark.createDataFrame([(1.0, 2.0, "FP")], "x double, y double, tag string")).first().value)
    assert said["geometry"]["coordinates"] == [1.0, 2.0] and said["properties"] == {"tag": "FP"}


def test_progress_and_reports(spark, tmp_path):
    for run in ("a", "b"):
        (tmp_path / "runs" / run).mkdir(parents=True)
        (tmp_path / "runs" / run / "progress.csv").write_text("metrics/precision(M),metrics/recall(M),metrics/mAP50(M)\n0.5,0.5,0.4\n")
    got = tables.read_progress(spark, str(tmp_path / "runs/*/progress.csv"))
    assert sorted((r.run, r.precision) for r in got.collect()) == [("a", 0.5), ("b", 0.5)]
    tables.write_reports({"m": got}, str(tmp_path / "out"))
    assert spark.read.csv(str(tmp_path / "out/m"), header=True).count() == 2


def test_geopackage_round_trip(spark, tmp_path):
    from rayloom.sources import geopackage

    rows = [(1, "a", 1.5, 2.5, None, True), (2, None, None, None, [[0.0, 0.0, 4.0, 0.0, 4.0, 3.0]], None), (3, "c", None, None, [[0.0, 0.0, 1.0, 0.0, 1.0, 1.0], [5.0, 5.0, 6.0, 5.0, 6.0, 6.0]], False), (4, "none", None, None, None, None)]
    df = spark.createDataFrame(rows, "id long, name string, x double, y double, rings array<array<double>>, ok boolean")
    done = geopackage.write_geopackage(df.repartition(2), str(tmp_path / "g"), "found", rings="rings")
    assert sum(r.n for r in done.collect()) == 4
    got = {int(r.properties["id"]): r for r in geopackage.read_geopackage(spark, str(tmp_path / "g"), "found").collect()}
    assert (got[1].kind, got[1].x, got[1].y, got[1].properties["name"]) == ("Point", 1.5, 2.5, "a")
    assert got[2].rings == [[0.0, 0.0, 4.0, 0.0, 4.0, 3.0, 0.0, 0.0]] and "name" not in got[2].properties
    assert got[3].kind == "MultiPolygon" and len(got[3].rings) == 2 and got[4].kind is None
    empty = geopackage.write_geopackage(df.limit(0), str(tmp_path / "e"), "found").first()
    assert empty.n == 0 and geopackage.read_geopackage(spark, str(tmp_path / "e")).count() == 0


def test_geopackage_boxes_columns_and_ranges(spark, tmp_path):
    from rayloom.sources import geopackage

    points = spark.range(5000).select("id", F.concat(F.lit("n"), "id").alias("name"), (F.col("id") % 100).cast("double").alias("x"), F.floor(F.col("id") / 100).cast("double").alias("y"))
    geopackage.write_geopackage(points.repartition(3), str(tmp_path / "g"), "found")
    box = (10.0, 20.0, 12.0, 21.0)
    want = {(x, y) for x in (10.0, 11.0, 12.0) for y in (20.0, 21.0)}
    got = geopackage.read_geopackage(spark, str(tmp_path / "g"), "found", box, ["id"], rows=300).collect()
    assert {(r.x, r.y) for r in got} == want and len(got) == 6 and all(set(r.properties) == {"id"} for r in got)
    assert geopackage.read_geopackage(spark, str(tmp_path / "g"), rows=300).count() == 5000 and geopackage.read_geopackage(spark, str(tmp_path / "g"), "other").count() == 0
    steps, one = {}, str(next((tmp_path / "g").iterdir()))
    for index in (True, False):  # with the index only the pages of what is in the box are read
        with geopackage.database(one) as con:
            ((table, column, low, high, indexed),) = geopackage.layers_of(con)
            assert indexed
            count = [0]
            con.set_progress_handler(lambda: count.__setitem__(0, count[0] + 1), 1)
            found = geopackage.select_rows(con, table, column, low, high, index, box, None).fetchall()
            steps[index] = (count[0], len(found))
    assert steps[True][1] <= 6 and steps[False][1] == high and steps[True][0] < steps[False][0] / 20
    rings = spark.createDataFrame([(1, [[0.0, 0.0, 9.0, 0.0, 9.0, 9.0]]), (2, [[50.0, 50.0, 60.0, 50.0, 60.0, 60.0]]), (3, None)], "id long, rings array<array<double>>")
    geopackage.write_geopackage(rings.coalesce(1), str(tmp_path / "p"), "areas", rings="rings")
    assert [r.properties["id"] for r in geopackage.read_geopackage(spark, str(tmp_path / "p"), box=(8.0, -5.0, 30.0, 1.0)).collect()] == ["1"]


def test_config_section(tmp_path):
    from rayloom.sources import config

    (tmp_path / "c.yaml").write_text("job:\n  paths: ['{data}/a', 'b']\n  one: '{data}'\n  n: 3\n")
    assert config.section(str(tmp_path / "c.yaml"), "job", {"data": "/d"}) == {"paths": ["/d/a", "b"], "one": "/d", "n": 3}
