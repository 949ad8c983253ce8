"""Documents read in ranges and written in pieces."""

import json
import os
import random

import pytest
from pyspark.sql import functions as F

from rayloom.sources import coco, split_json


def junk(rng, depth=0):
    k = rng.randrange(7)
    if k == 0:
        return rng.choice(["", 'a"b', "}{][", "\\", '\\\\"', '\\"]', "é😀", '"images": [', " x\\\\"])
    if k in (1, 2) or depth > 3:
        return rng.choice([rng.randrange(1000), None, True])
    if k < 5:
        return [junk(rng, depth + 1) for _ in range(rng.randrange(4))]
    return {rng.choice(["images", "annotations", "a", 'b"', "c\\", "{"]): junk(rng, depth + 1) for _ in range(rng.randrange(4))}


def any_document(rng):
    if rng.random() < 0.2:
        return [{"a": junk(rng, 1)} for _ in range(rng.randrange(6))]
    doc = {"info": {"a": {"b": [{"x": 1}]}}} if rng.random() < 0.5 else {}
    for k in rng.sample(["images", "annotations", "licenses", "categories", 'x"y'], 3):
        doc[k] = [junk(rng, 1) if rng.random() < 0.2 else {str(i): junk(rng, 2) for i in range(rng.randrange(3))} for _ in range(rng.randrange(6))]
    return doc | ({"end": 5} if rng.random() < 0.3 else {})


def planned(path, size):
    """The plan as :func:`split_json.make_plan` has it, without Spark."""
    n = os.path.getsize(path)
    fs, at = split_json.opened(path)
    with fs.open_input_file(at) as source:
        told = [(a, min(a + size, n), *split_json.summary(source, a, min(a + size, n))) for a in range(0, n, size)]
        ranges, edge = split_json.add_up(path, n, told)
        arrays, level = split_json.arrays_of(path, source, [split_json.outermost(source, r) for r in edge])
    return split_json.Plan(ranges, {path: arrays}, {path: level})


def test_any_document_in_ranges_and_blocks_of_any_size(tmp_path, monkeypatch):
    rng = random.Random(7)
    for k in range(150):
        doc, path = any_document(rng), str(tmp_path / f"{k}.json")
        with open(path, "w", encoding="utf-8") as f:
            json.dump(doc, f, ensure_ascii=rng.random() < 0.5, indent=rng.choice([None, 1, 4]))
        monkeypatch.setattr(split_json, "BLOCK", rng.choice([1, 3, 7, 50, 4096]))
        reader, got = split_json._Reader(planned(path, rng.choice([1, 2, 5, 17, 64, 1000]))), {}
        for part in reader.partitions():
            for batch in reader.read(part):
                for r in batch.to_pylist():
                    got.setdefault(r["section"], []).append(json.loads(r["value"]))
        want = {"records": doc} if isinstance(doc, list) else {k: [x for x in v if isinstance(x, dict)] for k, v in doc.items() if isinstance(v, list)}
        assert got == {k: v for k, v in want.items() if v}


def test_a_broken_document_is_an_error(tmp_path):
    for k, text in enumerate(('{"images": [{"id": 1}', '{"images": [{"id": "1}]}', "[{}]]")):
        (tmp_path / f"{k}.json").write_text(text)
        with pytest.raises(ValueError):
            planned(str(tmp_path / f"{k}.json"), 5)


def tables(spark, n):
    ring = F.array(*[F.col("id").cast("double") + v for v in (0, 0, 4, 0, 4, 3, 0, 3)])
    anns = spark.range(n).select("id", (F.col("id") % 7).alias("image_id"), F.lit(1).alias("category_id"), F.array(*[F.lit(float(v)) for v in range(4)]).alias("bbox"), F.lit(12.0).alias("area"), F.array(ring).alias("segmentation"))
    images = spark.range(6).select("id", F.concat(F.lit('a/é"{['), F.col("id").cast("string"), F.lit("\\.jpg")).alias("file_name"), F.lit(9).alias("width"), F.lit(9).alias("height"))
    return images, anns, spark.createDataFrame([(1, "cover", "plate")], "id int, name string, supercategory string")


def test_written_in_pieces_and_read_in_ranges(spark, tmp_path):
    images, anns, cats = tables(spark, 20_000)
    path = str(tmp_path / "doc.json")
    coco.write_document(images.repartition(3), anns.repartition(5), cats, path)
    assert os.listdir(tmp_path) == ["doc.json"]  # neither pieces nor halves stay
    said = json.loads((tmp_path / "doc.json").read_text())
    assert list(said) == ["images", "annotations", "categories"] and [a["id"] for a in said["annotations"]] == list(range(20_000))
    plan = split_json.make_plan(spark, path, 200_000)
    got = coco.read_annotations(spark, plan)
    assert got.rdd.getNumPartitions() >= 8
    before = spark.read.schema(f"annotations array<struct<{', '.join(f.replace(' ', ':', 1) for f in coco.ANNOTATION.split(', '))}>>").json(path, multiLine=True).select(F.inline("annotations"))
    assert got.exceptAll(before).isEmpty() and before.exceptAll(got).isEmpty()
    assert coco.orphans(coco.read_images(spark, plan), got).count() == len([i for i in range(20_000) if i % 7 == 6])
    assert coco.read_images(spark, plan).filter("image_id = 3").first().file_name == 'a/é"{[3\\.jpg' and coco.number_of_classes(spark, path) == 1


def test_a_failed_write_leaves_nothing(spark, tmp_path):
    images, anns, cats = tables(spark, 50)
    path = str(tmp_path / "doc.json")
    coco.write_document(images, anns, cats, path)
    before = (tmp_path / "doc.json").read_text()
    with pytest.raises(Exception):
        coco.write_document(images, anns.withColumn("area", F.raise_error(F.lit("no area")).cast("double")), cats, path)
    assert (tmp_path / "doc.json").read_text() == before and os.listdir(tmp_path) == ["doc.json"]


def test_many_files_and_empty_arrays(spark, tmp_path):
    images, anns, cats = tables(spark, 30)
    for k in range(3):
        coco.write_document(images, anns.limit(0) if k else anns, cats, str(tmp_path / f"{k}.json"))
    coco.write_records(anns.select("id", F.lit(0.5).alias("score")), str(tmp_path / "r" / "records.json")) if (tmp_path / "r").mkdir() is None else None
    assert coco.read_annotations(spark, str(tmp_path / "*.json")).count() == 30 and coco.read_images(spark, str(tmp_path / "*.json")).count() == 18
    assert coco.read_detections(spark, {"val": str(tmp_path / "r"), "trn": str(tmp_path / "1.json")}).count() == 30
    (tmp_path / "r" / "records.json").write_text("")
    assert coco.read_detections(spark, {"val": str(tmp_path / "r")}).count() == 0
