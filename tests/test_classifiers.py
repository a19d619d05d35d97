"""Classifiers are fitted with the strength and the trees that are asked for."""

import pytest

from inkwell.operators import model
from inkwell.plans import catalogue

SMALL = "/root/testdata/sf0.001"


def test_regularisation_follows_the_training_fold(spark, monkeypatch):
    seen, plain = [], model.classifier
    monkeypatch.setattr(model, "classifier", lambda kind, **o: seen.append(plain(kind, **o)) or seen[-1])
    rows = spark.createDataFrame([(i % 2, i % 4 // 2, float(i % 2 + i % 3)) for i in range(40)], "label int, fold int, x double")
    model.cross_validate(rows, ["x"], "lr", folds=2).collect()
    assert [1 / c.getRegParam() for c in seen] == pytest.approx([20, 20])


def test_queries_ask_for_the_reference_sizes(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(catalogue, "_folded", lambda *a: None)
    monkeypatch.setattr(catalogue.model, "cross_validate", lambda rows, names, kind, **o: seen.append((kind, o.get("trees", o.get("rounds", o.get("total_weight"))))))
    for q in (catalogue.lr_cv, catalogue.rf_holdout, catalogue.gbt_holdout):
        q(spark, SMALL)
    assert seen == [("lr", None), ("rf", 200), ("gbt", 200)]


def test_kernel_bound_is_a_parameter(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(model.KernelMachine, "fit", lambda self, x, y: seen.append(len(x)) or self)
    rows = spark.range(50).selectExpr("id doc_id", "int(id % 2) label", "double(id) x")
    model.fit_kernel(rows, ["x"], most=20)
    model.fit_kernel(rows, ["x"])
    assert seen == [20, 50]


def test_refit_report_and_reload(spark, tmp_path):
    rows = spark.createDataFrame([(i, i % 2, float(i % 2 * 3 + i % 5), float(i % 7)) for i in range(60)], "doc_id long, label int, x double, noise double")
    for kind, options in (("lr", {}), ("rf", {"trees": 5})):
        fitted = model.fit(rows, ["x", "noise"], kind, **options)
        model.save(fitted, str(tmp_path / kind))
        first, again = ({r.doc_id: r.score for r in model.score(rows, m, ["doc_id"]).collect()} for m in (fitted, model.load(str(tmp_path / kind))))
        assert first == again and sum(first[i] > 0.5 for i in range(1, 60, 2)) > 20
        if kind == "rf":
            assert model.importances(fitted, ["x", "noise"], 1)[0][0] == "x"
        else:
            top, bottom = model.coefficients(fitted, ["x", "noise"], 1)
            assert top[0][0] == "x" and top[0][1] > bottom[0][1]


def test_features_are_divided_by_the_deviation_of_all_rows(spark):
    rows = spark.createDataFrame([(0, 1.0), (1, 3.0), (1, 8.0), (0, 4.0)], "label int, x double")
    fitted = model.fit(rows, ["x"], "lr")
    got = sorted(r.scaled[0] for r in fitted.transform(rows).collect())
    x = [1.0, 3.0, 4.0, 8.0]
    deviation = (sum((v - 4) ** 2 for v in x) / 4) ** 0.5
    assert got == pytest.approx([(v - 4) / deviation for v in x])


def test_folds_have_mean_and_deviation(spark):
    rows = spark.createDataFrame([(i % 2, i % 4 // 2, float(i % 2 + i % 3)) for i in range(40)], "label int, fold int, x double")
    got = model.cross_validate(rows, ["x"], "lr", folds=2).collect()
    f = [r.f1 for r in got]
    assert got[0].mean_f1 == pytest.approx(sum(f) / 2) and got[0].deviation_f1 == pytest.approx(abs(f[0] - f[1]) / 2)


def test_rows_are_computed_once(spark):
    made = spark.sparkContext.accumulator(0)

    def run(parts):
        for part in parts:
            made.add(len(part))
            yield part

    rows = spark.range(40).selectExpr("int(id % 2) label", "int(id % 4 div 2) fold", "double(id % 2 + id % 3) x").mapInPandas(run, "label int, fold int, x double")
    model.fit(rows, ["x"], "lr")
    assert made.value == 40
    model.cross_validate(rows, ["x"], "lr", folds=2).collect()
    assert made.value == 80


def test_grid_has_the_reference_families_and_classifiers(spark, monkeypatch):
    seen = []

    def tried(kind):
        def run(rows, names, *a, **o):
            seen.append((kind or a[0], len(names), o))
            return rows.sparkSession.createDataFrame([(0.5,)], "mean_f1 double")

        return run

    monkeypatch.setattr(catalogue.model, "cross_validate", tried(None))
    monkeypatch.setattr(catalogue.model, "cross_validate_kernel", tried("svm"))
    got = catalogue.grid_best(spark, SMALL).collect()
    assert [(k, o) for k, _, o in seen] == [("lr", {}), ("svm", {"c": 10.0}), ("gbt", {"rounds": 300, "depth": 4}), ("rf", {"trees": 300})] * 3
    assert [n for _, n, _ in seen] == [126] * 4 + [500] * 4 + [626] * 4
    assert [(r.family, r.kind) for r in got if r.best] == [("style", "lr")]


def test_kernel_folds_see_all_other_rows(spark, monkeypatch):
    monkeypatch.setattr(model, "HELD_BYTES", 0)
    rows = spark.createDataFrame([(i % 2, i // 2 % 3, float(i % 2) * 2 + i % 7 / 10, float(i % 5)) for i in range(90)], "label int, fold int, x double, y double")
    got = model.cross_validate_kernel(rows, ["x", "y"], folds=3).collect()
    assert [r.accuracy for r in sorted(got)] == [1.0] * 3 and got[0].mean_f1 == 1.0 and got[0].deviation_f1 == 0.0
