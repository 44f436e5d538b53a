"""The stored cube: equal to a full run, only changed months read, safe against a refresh that died."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from peagelens.operators import traffic
from peagelens.schema import FACT
from peagelens.sources import cube, fact
from peagelens.sources.fact import paid

ROW = (1, datetime(2024, 1, 5, 3, 20), "A", 1, "VL", 2.0, 2.0, "Cash", "Non", "Standard", None)


def rows(spark, *changes):
    made = []
    for change in changes:
        row = dict(zip(FACT.fieldNames(), ROW))
        row.update(change)
        made.append(tuple(row.values()))
    return spark.createDataFrame(made, FACT)


def full(tx):
    return sorted(map(repr, traffic.hourly_cube(paid(tx), cells=True).collect()))


def stored(spark, path, at):
    return sorted(map(repr, cube.read_cube(spark, path, at).collect()))


@pytest.fixture
def loaded(spark, tmp_path):
    path, at = str(tmp_path / "fact"), str(tmp_path / "cube")
    early = [{"date_heure": datetime(2024, m, 3, h), "id_transaction": m * 100 + h} for m in (1, 2) for h in range(5)]
    fact.write_fact(rows(spark, *early, {"date_heure": None}, {"montant_net": None}, {"gare": None}), path)
    return path, at


def test_only_changed_months_are_aggregated(spark, loaded):
    path, at = loaded
    first = cube.refresh_cube(spark, path, at)
    assert first == ["2024-01", "2024-02", "__HIVE_DEFAULT_PARTITION__"]
    assert cube.refresh_cube(spark, path, at) == []
    assert stored(spark, path, at) == full(fact.read_fact(spark, path))
    fact.append_fact(rows(spark, {"date_heure": datetime(2024, 3, 1, 7)}), path)
    plan_rows = cube.changed_rows(spark, path, ["2024-03"])
    assert plan_rows.inputFiles() and all("annee_mois=2024-03" in f for f in plan_rows.inputFiles())
    assert cube.refresh_cube(spark, path, at) == ["2024-03"]
    fact.append_fact(rows(spark, {"date_heure": datetime(2024, 1, 3, 2), "montant_net": 9.0}), path)
    assert cube.refresh_cube(spark, path, at) == ["2024-01"]
    assert stored(spark, path, at) == full(fact.read_fact(spark, path))
    assert cube.drop_stale(spark, path, at) == 1
    assert stored(spark, path, at) == full(fact.read_fact(spark, path))


def test_full_refresh_of_the_fact_replaces_every_state(spark, loaded):
    path, at = loaded
    cube.refresh_cube(spark, path, at)
    fact.write_fact(rows(spark, {"date_heure": datetime(2024, 2, 9, 1)}), path)
    assert cube.read_cube(spark, path, at).count() == 1
    assert stored(spark, path, at) == full(fact.read_fact(spark, path))
    assert cube.drop_stale(spark, path, at) == 3


def test_a_refresh_that_died_is_done_again(spark, loaded, monkeypatch):
    path, at = loaded
    system = cube._system

    def broken(spark, where):
        files, there = system(spark, where)

        class Files:
            exists, delete, listStatus = files.exists, files.delete, files.listStatus

            def create(self, *_):
                raise OSError("lost")

        return Files(), there

    monkeypatch.setattr(cube, "_system", broken)
    with pytest.raises(OSError, match="lost"):
        cube.refresh_cube(spark, path, at)
    monkeypatch.setattr(cube, "_system", system)
    assert len(cube.refresh_cube(spark, path, at)) == 3
    assert stored(spark, path, at) == full(fact.read_fact(spark, path))


def test_months_without_paying_passages_and_empty_tables(spark, tmp_path):
    path, at = str(tmp_path / "fact"), str(tmp_path / "cube")
    fact.write_fact(rows(spark, {"montant_net": 0.0}), path)
    assert cube.refresh_cube(spark, path, at) == ["2024-01"]
    assert cube.refresh_cube(spark, path, at) == []
    assert cube.read_cube(spark, path, at).count() == 0
    none = str(tmp_path / "none")
    fact.write_fact(rows(spark, {}).where(F.lit(False)), none)
    assert cube.read_cube(spark, none, at + "-none").count() == 0
