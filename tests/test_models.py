"""Layouts from models; a forest trained on a pool, saved, loaded and applied on the main path."""

import pytest
from pyspark.ml import PipelineModel
from pyspark.sql import functions as F

from strandline.operators import inference, models, signal
from strandline.plans import domain, signals

DATA = "/root/testdata/sf0.001"


class Model:
    def __init__(self, n=None):
        if n is not None:
            self.n_features_in_ = n


def test_layout_of_a_model():
    assert signal.layout_of(Model()) == (193, None) and signal.layout_of(Model(171), {}) == (171, None) and signal.layout_of(Model(78), None) == (78, None)
    select = lambda *x, n=193: {"feature_select": {"indices": list(x), "from_dim": n}}
    assert signal.layout_of(Model(3), select(0, 5, 192)) == (193, [0, 5, 192]) and signal.layout_of(Model(), select(1, n=171)) == (171, [1])
    for model, meta in ((Model(100), None), (Model(2), select(0, 5, 192)), (Model(1), select(193)), (Model(1), select(-1)), (Model(), {"feature_select": {"indices": []}}), (Model(), select()), (Model(1), select(0, n=50))):
        with pytest.raises(ValueError):
            signal.layout_of(model, meta)


@pytest.mark.parametrize("chosen", [(), (0, 7, 50, 120, 192)])
def test_forest_saved_loaded_and_applied(spark, tmp_path, chosen):
    # The fixed model labels windows; a forest learns from their features what it says.
    teacher, readings = signals.LinearModel(), signals.readings(spark, "/root/testdata/sf0.01")
    go = lambda model, **more: inference.classified_windows(readings, model, domain.CLASSES, signals.MODEL, 25.0, acc_unit="g", gyro_unit="rads", **more)
    said = go(teacher).select("device_id", "part_ms", "idx", "label").toPandas()
    windows = {}

    class Spy(models.Transformer):
        def _transform(self, dataset):
            windows["df"] = dataset
            return models.ClassProbabilities(domain.CLASSES)._transform(dataset.withColumn("probability", models.array_to_vector(F.array(*[F.lit(0.25)] * 4))))

    go(Spy())
    vectors = signal.features(windows["df"], 16, 193)
    pool = vectors.withColumnRenamed("window_idx", "idx").join(spark.createDataFrame(said), ["device_id", "part_ms", "idx"])
    model = models.train(pool.select("label", "features"), domain.CLASSES, 16.0, chosen, trees=15, depth=6)
    model.write().overwrite().save(f"file://{tmp_path}/model")
    loaded = PipelineModel.load(f"file://{tmp_path}/model")
    assert signal.layout_of(loaded.stages[1], {"feature_select": {"indices": list(chosen), "from_dim": 193}} if chosen else None)[0] == 193
    got = go(loaded)
    assert got.columns == go(teacher).select(*got.columns).columns
    key = lambda df: {(r.device_id, r.part_ms, r.idx): (r.label, round(r.confidence, 9), len(r.probs)) for r in df.collect()}
    found = key(got)
    assert found == key(go(model)) and {x[2] for x in found.values()} == {4}
    if not chosen:
        own = {(r.device_id, r.part_ms, r.idx): r.label for r in said.itertuples()}
        assert sum(found[k][0] == v for k, v in own.items()) > 0.8 * len(own) > 50
    top = models.importances(loaded).collect()
    assert len(top) == (len(chosen) or 193) and top[0].importance >= top[-1].importance and set(r.place for r in top) == set(chosen or range(193))
    assert inference.behaviour(got, domain.CLASSES, 1000, 500).count() > 0
    with pytest.raises(ValueError):
        models.train(pool.select("label", F.slice("features", 1, 100).alias("features")), domain.CLASSES, 16.0)
