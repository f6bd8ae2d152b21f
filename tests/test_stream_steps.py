"""A model moved by a stream: restarts, repeated batches, empty batches, errors."""

import numpy as np
import pytest

from mixloom.plans.blocks import coordinates, sum_blocks
from mixloom.plans.minibatch import minibatch_update
from mixloom.streaming import steps as S


def run(spark, blobs, start, folder, parts=(0, 1, 2), **options):
    for part in parts:
        blobs.where(f"point_id % 3 = {part}").write.mode("append").parquet(f"{folder}/in")
        stream = spark.readStream.schema(blobs.schema).parquet(f"{folder}/in")
        S.step_stream(stream, start, f"{folder}/model", f"{folder}/progress", **options).awaitTermination()
    return S.read_version(spark, f"{folder}/model")


def plain(blobs, start, parts=(0, 1, 2)):
    model, totals = start, []
    for t, part in enumerate(parts):
        sums = sum_blocks(coordinates(blobs.where(f"point_id % 3 = {part}")), model)
        model = minibatch_update(model, sums, 0.5 / (1 + t / 100.0))
        totals.append(sums.total)
    return model, totals


def same(a, b):
    for x, y in ((a.weights, b.weights), (a.means, b.means), (a.covs, b.covs)):
        np.testing.assert_allclose(x, y, rtol=1e-12)


def test_steps_of_a_stream(spark, blobs, start, tmp_path):
    got = run(spark, blobs, start, str(tmp_path))
    want, totals = plain(blobs, start)
    same(got.mixture, want)
    assert (got.number, got.step, got.points) == (2, 3, 200)
    told = S.version_history(spark, f"{tmp_path}/model").orderBy("version").collect()
    assert [r.step for r in told] == [1, 2, 3] and sum(r.points for r in told) == 600
    np.testing.assert_allclose([r.loglik for r in told], totals)


def test_killed_before_and_after_the_version_is_written(spark, blobs, start, tmp_path, monkeypatch):
    folder, write = str(tmp_path), S._write
    run(spark, blobs, start, folder, parts=(0,))

    def killed_after(*args):
        write(*args)
        raise RuntimeError("killed after the version was written")

    def killed_before(spark, store, version):
        # the files of the version without the mark that it is whole
        write(spark, store, version)
        S._folder(spark, store)[0].delete(S._folder(spark, f"{S._path(store, version.number)}/_SUCCESS")[1], False)
        raise RuntimeError("killed before the version was whole")

    for part, broken in ((1, killed_after), (2, killed_before)):
        monkeypatch.setattr(S, "_write", broken)
        with pytest.raises(Exception, match="killed"):
            run(spark, blobs, start, folder, parts=(part,))
        monkeypatch.setattr(S, "_write", write)
        known = S.versions(spark, f"{folder}/model")
        assert known == [0, 1]
        stream = spark.readStream.schema(blobs.schema).parquet(f"{folder}/in")
        S.step_stream(stream, start, f"{folder}/model", f"{folder}/progress").awaitTermination()
    got = S.read_version(spark, f"{folder}/model")
    same(got.mixture, plain(blobs, start)[0])
    assert got.step == 3 and S.versions(spark, f"{folder}/model") == [0, 1, 2]


def test_batch_without_points_makes_no_step(spark, blobs, start, tmp_path):
    folder = str(tmp_path)
    blobs.where("point_id < 0").coalesce(1).write.parquet(f"{folder}/in")
    stream = spark.readStream.schema(blobs.schema).parquet(f"{folder}/in")
    S.step_stream(stream, start, f"{folder}/model", f"{folder}/progress").awaitTermination()
    got = run(spark, blobs, start, folder, parts=(0,))
    same(got.mixture, plain(blobs, start, (0,))[0])
    assert got.step == 1


def test_old_versions_go_and_foreign_streams_are_refused(spark, blobs, start, tmp_path):
    folder = str(tmp_path)
    run(spark, blobs, start, folder, keep=2)
    assert S.versions(spark, f"{folder}/model") == [1, 2]
    stream = spark.readStream.schema(blobs.schema).parquet(f"{folder}/in")
    with pytest.raises(ValueError, match="another stream"):
        S.step_stream(stream, start, f"{folder}/model", f"{folder}/other")
    with pytest.raises(ValueError, match="no finished version 0"):
        S.read_version(spark, f"{folder}/model", 0)


def test_missing_coordinates_end_the_stream_and_leave_the_model(spark, blobs, start, tmp_path):
    folder = str(tmp_path)
    before = run(spark, blobs, start, folder, parts=(0,))
    spark.createDataFrame([(1, None, 2.0)], blobs.schema).write.mode("append").parquet(f"{folder}/in")
    stream = spark.readStream.schema(blobs.schema).parquet(f"{folder}/in")
    with pytest.raises(Exception, match="NULL or NaN"):
        S.step_stream(stream, start, f"{folder}/model", f"{folder}/progress").awaitTermination()
    after = S.read_version(spark, f"{folder}/model")
    assert after.number == before.number
    same(after.mixture, before.mixture)
