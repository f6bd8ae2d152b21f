"""Documents and lines read by byte ranges: the same as read whole, wherever they are cut."""

import json
import random

import pytest
from pyspark.sql import functions as F

from mixloom.sources.annotations import read_annotations, read_large_annotations, write_large_annotations
from mixloom.sources.history import VALUES, read_whole_history, write_whole_history
from mixloom.sources.models import read_label_lines, write_label_lines
from mixloom.sources.points import read_labelled_points, write_points
from mixloom.sources.ranges import State, _composed, numbered_lines, read_elements, read_lists, walk

ODD = ['plain', 'a "quoted" one', "br{ack}e[t]s", "back\\slash", 'end\\"', "\\\\", "zwölf 漢字 🙂", "comma, colon: {", '"', "{", "}{", ""]


@pytest.fixture
def small_ranges(spark):
    """Ranges of few bytes, so that cuts fall everywhere."""
    small = {
        "spark.sql.files.maxPartitionBytes": "1500b", "spark.sql.files.openCostInBytes": "1b",
        "spark.sql.adaptive.coalescePartitions.enabled": "false",
    }
    before = {k: spark.conf.get(k) for k in small}
    for k, v in small.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def document(rng, n):
    annotations = [
        {"id": i, "image_id": i // 2, "category_id": rng.randrange(4), "area": rng.random() * 100,
         "bbox": [rng.random() for _ in range(4)], "iscrowd": i % 2, "note": rng.choice(ODD),
         "segmentation": rng.choice([[], {"counts": [1, 2], "size": {"h": 1}}, [{"x": [{}]}, {"y": "}"}]])}
        for i in range(n)
    ]
    categories = [{"id": i, "name": name} for i, name in enumerate(ODD[:4])]
    return {"info": {"annotations": [{"id": -1}], "by": ODD}, "na{me": "annotations", "annotations": annotations,
            "odd,\" key": [{"id": -2}], "categories": categories, "licenses": [{"id": -3}]}


def same_rows(a, b):
    return sorted(map(str, a.collect())) == sorted(map(str, b.select(a.columns).collect()))


@pytest.mark.parametrize("form", [{}, {"indent": 1}, {"separators": (",", ":"), "ensure_ascii": False}])
def test_document_by_ranges(spark, tmp_path, small_ranges, form):
    whole = document(random.Random(1), 150)
    path = tmp_path / "a.json"
    path.write_text(json.dumps(whole, **form), encoding="utf-8")
    cats, anns = read_large_annotations(spark, {"val": str(path)})
    want_cats, want_anns = read_annotations(spark, {"val": str(path)}, multi_line=True)
    assert anns.count() == 150 and same_rows(anns, want_anns) and same_rows(cats, want_cats)
    lines = spark.read.option("lineSep", "{").text(str(path))
    assert lines.rdd.getNumPartitions() > 15
    elements = read_elements(spark, str(path), ["annotations", "odd,\" key"]).collect()
    found = sorted((r.key, json.dumps(json.loads(r.value))) for r in elements)
    assert found == sorted((k, json.dumps(e)) for k in ("annotations", "odd,\" key") for e in whole[k])


def test_document_of_a_large_element_and_many_documents(spark, tmp_path, small_ranges):
    rng = random.Random(2)
    wide = {"annotations": [{"id": 1, "segmentation": [{"x": [k, {}]} for k in range(400)]}, {"id": 2}], "categories": []}
    texts = [json.dumps(wide), json.dumps(document(rng, 20)) + "\n" + json.dumps(document(rng, 7)), "  \n", "{}"]
    for k, t in enumerate(texts):
        (tmp_path / f"{k}.json").write_text(t, encoding="utf-8")
    got = read_elements(spark, str(tmp_path), ["annotations"]).collect()
    assert len(got) == 2 + 27
    assert sorted(len(r.value) for r in got)[-1] == len(json.dumps(wide["annotations"][0]))
    assert all(isinstance(json.loads(r.value), dict) for r in got)


@pytest.mark.parametrize("text", ['{"annotations": [{"id": 1}, {"id": 2', '{"annotations": [{"id": 1}]', '{"a": "b', '{"a": []}}'])
def test_document_that_does_not_close(spark, tmp_path, text):
    (tmp_path / "a.json").write_text(text)
    with pytest.raises(ValueError, match="close"):
        read_elements(spark, str(tmp_path / "a.json"), ["annotations"])


def test_malformed_element_raises(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"annotations": [{"id": oops}], "categories": []}')
    with pytest.raises(Exception, match="MALFORMED|malformed|FAILFAST"):
        read_large_annotations(spark, {"val": str(tmp_path / "a.json")})[1].collect()


def test_document_written_in_parts(spark, tmp_path, small_ranges):
    rows = [(i, i // 3, i % 5, i / 7, [0.5, 1.0, i / 9, None], i % 2) for i in range(200)] + [(5, 1, 0, 5 / 7, None, None)] * 3
    schema = "id long, image_id long, category_id long, area double, bbox array<double>, iscrowd int"
    anns = spark.createDataFrame(rows, schema).repartition(6)
    cats = spark.createDataFrame([(i, t) for i, t in enumerate(ODD)], "id long, name string")
    path = str(tmp_path / "parts")
    write_large_annotations(cats, anns, path)
    parts = sorted((tmp_path / "parts").glob("part-*"))
    whole = json.loads("".join(p.read_text(encoding="utf-8") for p in parts))
    assert len(parts) > 3 and len(whole["annotations"]) == 203 and [c["name"] for c in whole["categories"]] == ODD
    back_cats, back = read_large_annotations(spark, {"val": path}, joined=True)
    assert same_rows(anns, back) and same_rows(cats, back_cats)
    empty = str(tmp_path / "empty")
    write_large_annotations(cats.where("false"), anns.where("false"), empty)
    assert [t.count() for t in read_large_annotations(spark, {"val": empty}, joined=True)] == [0, 0]


def test_lists_by_ranges(spark, tmp_path, small_ranges):
    rng = random.Random(3)
    lists = {t: [rng.random() * 10 ** rng.randint(-9, 9) for _ in range(rng.randint(0, 60))] for t in ODD}
    lists["third"] = [float(i) for i in range(500)]
    for k, form in enumerate(({}, {"indent": 0}, {"separators": (",", ":"), "ensure_ascii": False})):
        path = tmp_path / f"{k}.json"
        path.write_text(json.dumps(lists, **form), encoding="utf-8")
        got = read_lists(spark, str(path)).collect()
        assert sorted((r.key, r.pos, float(r.value)) for r in got) == sorted(
            (t, i, v) for t, own in lists.items() for i, v in enumerate(own)
        )


def test_history_in_the_form_of_one_object(spark, tmp_path, small_ranges):
    rng = random.Random(4)
    rows = [(t, i, rng.random(), None if i % 7 == 3 else rng.random() * 1e-9, 1e12 * rng.random())
            for t in ODD for i in range(1 + rng.randrange(30))]
    rows += [("third", i, float(i), 0.5, 2.0) for i in range(300)]
    df = spark.createDataFrame(rows, "category string, pos long, wh double, hw double, area double").repartition(5)
    path = str(tmp_path / "history")
    write_whole_history(df, path)
    for name in VALUES:
        parts = sorted((tmp_path / "history" / f"name={name}").glob("part-*"))
        assert len(parts) > 1
        whole = json.loads("".join(p.read_text(encoding="utf-8") for p in parts))
        assert {t: len(v) for t, v in whole.items()} == {t: sum(r[0] == t for r in rows) for t in {r[0] for r in rows}}
        (tmp_path / f"{name}.json").write_text(json.dumps(whole))
    assert same_rows(df, read_whole_history(spark, path))
    assert same_rows(df, read_whole_history(spark, {n: str(tmp_path / f"{n}.json") for n in VALUES}))
    write_whole_history(df.where("false"), str(tmp_path / "none"))
    assert read_whole_history(spark, str(tmp_path / "none")).count() == 0
    with pytest.raises(ValueError, match="without a name"):
        write_whole_history(df.withColumn("category", F.lit(None).cast("string")), str(tmp_path / "null"))


def test_lines_do_not_depend_on_cuts(spark, tmp_path, small_ranges):
    rows = [f"line {i} " + "é" * (i % 40) for i in range(700)]
    (tmp_path / "one").mkdir()
    (tmp_path / "many").mkdir()
    (tmp_path / "one" / "a.txt").write_text("\n".join(rows) + "\n", encoding="utf-8")
    for k in range(12):
        own = rows[k * 60 : (k + 1) * 60 if k < 11 else None]
        (tmp_path / "many" / f"part-{k}.txt").write_text("\n".join(own), encoding="utf-8")
    for name in ("one", "many"):
        lines, count = numbered_lines(spark, str(tmp_path / name))
        assert count == 700 and {(r.line, r.value) for r in lines.collect()} == set(enumerate(rows))
    cut = numbered_lines(spark, str(tmp_path / "one"))[0]
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4000b")
    with pytest.raises(Exception, match="another way"):
        cut.agg(F.max("line")).collect()


def test_points_and_labels_by_line(spark, tmp_path, small_ranges):
    rows = [(3 * i, i / 3, -i / 7, i % 4) for i in range(500)]
    df = spark.createDataFrame(rows, "point_id long, x double, y double, component int").repartition(7)
    write_points(df.repartitionByRange(4, "point_id").sortWithinPartitions("point_id"), f"{tmp_path}/p", fmt="text")
    write_label_lines(df, f"{tmp_path}/l")
    got = read_labelled_points(spark, f"{tmp_path}/p", f"{tmp_path}/l", n_cols=2).collect()
    assert sorted((r.point_id, r.x, r.y, r.component) for r in got) == [(i, x, y, c) for i, (_, x, y, c) in enumerate(rows)]
    write_label_lines(df.where("point_id > 0"), f"{tmp_path}/short")
    with pytest.raises(ValueError, match="500 points and 499 labels"):
        read_labelled_points(spark, f"{tmp_path}/p", f"{tmp_path}/short")
    (tmp_path / "bad.txt").write_text("1\nx\n")
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        read_label_lines(spark, str(tmp_path / "bad.txt"))[0].collect()


def test_any_cut_composes():
    """Two stretches walked apart give the state of one walk."""
    text = json.dumps(document(random.Random(5), 6), ensure_ascii=False).encode()
    _, end = walk(text, State())
    assert (end.inside, end.depth) == (False, 0)
    cuts = [i for i, c in enumerate(text) if c in b"{,"]
    for cut in cuts:
        _, first = walk(text[:cut], State(), last_keys=True)
        after = [walk(text[cut:], s, last_keys=True)[1] for s in (State(), State(inside=True, cut=True))]
        both = _composed(first, after[first.inside])
        assert (both.inside, both.depth, both.keys[1][1]) == (False, 0, b"licenses")


def test_text_of_ranges_without_quotes_stays_with_the_tasks(spark, tmp_path, small_ranges, monkeypatch):
    from mixloom.sources.ranges import range_states, ranged_text

    (tmp_path / "a.json").write_text(json.dumps({"a": list(range(10_000)), 'b"': [1]}))
    lines, sent = ranged_text(spark, str(tmp_path), ","), []
    plain = type(lines).collect
    monkeypatch.setattr(type(lines), "collect", lambda self: (rows := plain(self), sent.append(len(str(rows))))[0])
    ranges = range_states(lines, ",", False)
    assert len(ranges) > 30 and sum(sent) / len(ranges) < 500  # bytes a range, of 1,500 in the file


def test_ranges_that_begin_inside_a_string(spark, tmp_path, small_ranges):
    long = ", {\\" * 900 + '"'
    whole = {"a" + long: [1, 2.5], long: [3], "annotations": [{"id": 1, "note": long}, {"id": 2}], "categories": [{"id": 3}]}
    (tmp_path / "a.json").write_text(json.dumps(whole))
    got = read_lists(spark, str(tmp_path)).where("value != 'oops'").collect()
    assert {(r.key, r.pos, r.value) for r in got} == {("a" + long, 0, "1"), ("a" + long, 1, "2.5"), (long, 0, "3")}
    cats, anns = read_large_annotations(spark, {"val": str(tmp_path)})
    assert sorted(r.id for r in anns.collect()) == [1, 2] and [r.id for r in cats.collect()] == [3]
