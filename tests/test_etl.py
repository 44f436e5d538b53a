import os
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from peagelens.operators.etl import load_report, normalise_headers, run_etl, transform
from peagelens.schema import FACT
from peagelens.session import fresh_path, scratch, settle, shared_dir
from peagelens.sources.exports import as_documents, write_forecast_csv, write_json
from peagelens.sources.fact import paid, read_fact, save_fact_table
from peagelens.sources.raw import BAD_RECORD, read_raw, write_raw

STAMP = datetime(2024, 5, 1, 6)
HEADER = (
    "`ID_transaction` string, ` Date Heure ` string, `Gare` string, `Voie` string, "
    "`Classe vehicule` string, `Montant_paye ` string, `Type_paiement` string, "
    "`Statut Abonnement` string, `Type_transaction` string"
)
ROWS = [
    ("1", "2024-01-05 10:00:00", "Allada", "2", "VL", "500", "Carte", "Oui", "Standard"),
    ("2", "bad-date", "Allada", "x", "PL", "-20.5", " Abonné ", "Non", "Standard"),
    ("3", "2024-02-01 00:00:00.25", None, "1", "VL", "N/A", "Badge", "Non", "Exonere"),
]


def raw_frame(spark):
    return spark.createDataFrame(ROWS, HEADER)


def test_headers(spark):
    names = normalise_headers(raw_frame(spark)).columns
    assert names[1] == "date_heure" and names[4] == "classe_vehicule" and names[5] == "montant_paye"


def test_transform(spark):
    df = transform(raw_frame(spark), STAMP)
    assert df.schema == FACT
    rows = {r.id_transaction: r for r in df.collect()}
    assert rows[2].date_heure is None and rows[2].voie is None
    assert (rows[2].montant_paye, rows[2].montant_net) == (-20.5, 0.0)
    assert rows[3].montant_paye is None and rows[3].montant_net is None
    assert rows[3].date_heure == datetime(2024, 2, 1, 0, 0, 0, 250000)
    assert {r.load_timestamp for r in rows.values()} == {STAMP}
    assert {r.id_transaction for r in paid(df).collect()} == {1}


def test_load_is_a_full_refresh(spark, tmp_path):
    csv_path, fact_path = str(tmp_path / "csv"), str(tmp_path / "fact")
    for rows in (ROWS, ROWS[:2]):
        write_raw(spark.createDataFrame(rows, HEADER), csv_path)
        report = run_etl(spark, csv_path, fact_path, STAMP)
        assert report.rows == len(rows)
        fact = read_fact(spark, fact_path)
        assert fact.schema == FACT
        expected = transform(spark.createDataFrame(rows, HEADER), STAMP)
        assert sorted(fact.collect(), key=repr) == sorted(expected.collect(), key=repr)


def test_column_order_of_the_file_does_not_matter(spark, tmp_path):
    path = str(tmp_path / "csv")
    df = raw_frame(spark)
    write_raw(df.select(*[f"`{c}`" for c in reversed(df.columns)]), path)
    again = transform(read_raw(spark, path), STAMP)
    assert sorted(again.collect(), key=repr) == sorted(transform(df, STAMP).collect(), key=repr)


def test_missing_markers(spark, tmp_path):
    path = tmp_path / "in.csv"
    path.write_text("a,b\nNA,1\nnull,NaN\n None,x\n", encoding="utf-8")
    assert [tuple(r) for r in read_raw(spark, str(path)).drop(BAD_RECORD).collect()] == [
        (None, "1"), (None, None), (" None", "x"),
    ]


def test_time_range_reads_only_its_months(spark, tmp_path):
    csv_path, fact_path = str(tmp_path / "csv"), str(tmp_path / "fact")
    write_raw(raw_frame(spark), csv_path)
    run_etl(spark, csv_path, fact_path, STAMP, rebalance=False)
    part = read_fact(spark, fact_path, datetime(2024, 1, 1), datetime(2024, 2, 1))
    assert [r.id_transaction for r in part.collect()] == [1]
    plan = part._jdf.queryExecution().executedPlan().toString()
    assert "annee_mois" in plan.split("PartitionFilters:")[1].split("]")[0]


def test_catalog_table(spark):
    for rows in (ROWS, ROWS[:1]):
        df = transform(spark.createDataFrame(rows, HEADER), STAMP)
        save_fact_table(df, "passages_probe")
        stored = spark.table("passages_probe")
        assert stored.count() == len(rows) and "annee_mois" in stored.columns
    spark.sql("DROP TABLE passages_probe")


def test_sinks(spark, tmp_path):
    forecast = spark.createDataFrame(
        [(g, datetime(2024, 1, 1, h), 1.5, 0.0, 3.0) for g in ("A-x Y", "B") for h in (0, 1)],
        "gare string, datetime timestamp_ntz, predicted double, lower_95 double, upper_95 double",
    )
    path = tmp_path / "forecast"
    write_forecast_csv(forecast, str(path))
    files = sorted(p.parent.name for p in path.glob("gare_safe=*/*.csv"))
    assert files == ["gare_safe=a_x_y", "gare_safe=b"]
    text = next(path.glob("gare_safe=a_x_y/*.csv")).read_text(encoding="utf-8").splitlines()
    assert text[0] == "datetime,predicted,lower_95,upper_95"
    assert text[1].startswith("2024-01-01 00:00:00,1.5,")
    write_json(forecast, str(tmp_path / "json"))
    assert spark.read.json(str(tmp_path / "json")).count() == 4
    document = as_documents(forecast.where("gare = 'A-x Y'").orderBy("datetime")).first().document
    assert document.startswith('{"gare":"A-x Y","datetime":"2024-01-01T00:00:00"')


def test_settled_tables_live_in_the_named_folder(spark):
    df = settle(spark.range(3).withColumn("x", F.col("id") * 2), "probe")
    assert shared_dir(spark) in df.inputFiles()[0]
    assert df.agg(F.sum("x")).first()[0] == 6


HAND_HEADER = (
    "ID_transaction, Date Heure ,Gare,Voie,Classe vehicule,Montant_paye ,Type_paiement,"
    "Statut Abonnement,Type_transaction"
)


def hand_written(path, *lines):
    path.write_text("\n".join([HAND_HEADER, *lines]) + "\n", encoding="utf-8")
    return str(path)


def test_quotes_of_other_writers(spark, tmp_path):
    path = hand_written(
        tmp_path / "q.csv",
        '1,2024-01-05 10:00:00,"Porto ""Nord"", A",1.0,VL,500,Carte,Oui,Standard',
        '2.0,2024-01-05 11:00:00,"A,B",2,VL, NaN,"x""y",Non,Standard',
    )
    rows = {r.id_transaction: r for r in transform(read_raw(spark, path), STAMP).collect()}
    assert rows[1].gare == 'Porto "Nord", A' and (rows[1].voie, rows[1].montant_paye) == (1, 500.0)
    assert rows[2].gare == "A,B" and rows[2].type_paiement == 'x"y' and rows[2].montant_paye is None


def test_line_breaks_in_quotes(spark, tmp_path):
    path = hand_written(
        tmp_path / "m.csv", '1,2024-01-05 10:00:00,"two\nlines",1,VL,5,Carte,Oui,Standard'
    )
    rows = transform(read_raw(spark, path, multiline=True), STAMP).collect()
    assert [r.gare for r in rows] == ["two\nlines"]


def test_losses_are_counted(spark, tmp_path):
    path = hand_written(
        tmp_path / "l.csv",
        "1,2024-01-05 10:00:00,A,1.5,VL,abc,Carte,Oui,Standard",
        "x,05/01/2024 10:00,A,NA,VL,5,Carte,Oui,Standard",
        "3,2024,A,1,VL,5,Carte,Oui",
        "4,2024-01-05 10:00:00,A,1,VL,5,Carte,Oui,Standard,more",
    )
    counts = {r.measure: r.n for r in load_report(read_raw(spark, path)).collect()}
    assert counts == {
        "rows": 4, "malformed": 2, "lost_id_transaction": 1, "lost_date_heure": 2, "lost_voie": 1,
        "lost_montant_paye": 1,
    }
    report = run_etl(
        spark, path, str(tmp_path / "fact"), STAMP, formats=["dd/MM/yyyy HH:mm"]
    )
    assert (report.rows, report.malformed) == (4, 2)
    assert report.lost == {"id_transaction": 1, "date_heure": 1, "voie": 1, "montant_paye": 1}
    times = [r.date_heure for r in read_fact(spark, str(tmp_path / "fact")).collect()]
    assert times.count(datetime(2024, 1, 5, 10)) == 3 and times.count(None) == 1


def test_absent_column_is_an_error(spark):
    with pytest.raises(ValueError, match="lacks gare, voie"):
        transform(raw_frame(spark).drop("Gare", "Voie"), STAMP)


def test_scratch_leaves_nothing(spark, tmp_path):
    with scratch(spark) as folder:
        settle(spark.range(3))
        inside = fresh_path(spark, "x")
    assert inside.startswith(folder) and not os.path.exists(folder.removeprefix("file:"))
    assert not fresh_path(spark, "x").startswith(folder)


def test_refresh_swaps_a_pointer(spark, tmp_path):
    """A refresh that dies midway leaves the old table readable; a done one replaces it whole."""
    from pyspark.sql import functions as F

    from peagelens.schema import FACT
    from peagelens.sources.fact import current_version, write_fact

    path = str(tmp_path / "table")

    def rows(ids, month):
        made = [(i, datetime(2024, month, 1), "A", 1, "VL", 1.0, 1.0, "Cash", "Non", "Standard", None) for i in ids]
        return spark.createDataFrame(made, FACT)

    def ids(df):
        return sorted(r.id_transaction for r in df.collect())

    write_fact(rows([1, 2], 1), path)
    held, first = read_fact(spark, path), current_version(spark, path)
    broken = rows([7, 8], 2).withColumn("montant_net", F.expr("raise_error('killed')").cast("double"))
    with pytest.raises(Exception, match="killed"):
        write_fact(broken, path)
    assert current_version(spark, path) == first and ids(read_fact(spark, path)) == [1, 2]
    write_fact(rows([3], 2), path)
    assert ids(read_fact(spark, path)) == [3] and ids(held) == [1, 2]
    assert ids(read_fact(spark, path, datetime(2024, 1, 1), datetime(2024, 2, 1))) == []
    write_fact(rows([4], 3), path)
    assert ids(read_fact(spark, path)) == [4]
    assert len(list((tmp_path / "table").glob("version-*"))) == 2


def test_plain_folder_is_still_read(spark, tmp_path):
    from peagelens.schema import FACT
    from peagelens.sources.fact import MONTH, current_version
    from pyspark.sql import functions as F

    path = str(tmp_path / "plain")
    row = (1, datetime(2024, 1, 1), "A", 1, "VL", 1.0, 1.0, "Cash", "Non", "Standard", None)
    made = spark.createDataFrame([row], FACT).withColumn(MONTH, F.lit("2024-01"))
    made.write.partitionBy(MONTH).parquet(path)
    assert current_version(spark, path) is None and read_fact(spark, path).count() == 1


def test_stations_of_one_file_name_get_folders_of_their_own(spark, tmp_path):
    rows = [(g, STAMP, 1.0 * k, 0.0, 9.0) for k, g in enumerate(["A B", "a-b", "A-B", "C"])]
    forecast = spark.createDataFrame(rows, "gare string, datetime timestamp_ntz, predicted double, lower_95 double, upper_95 double")
    write_forecast_csv(forecast, str(tmp_path / "csv"))
    back = spark.read.option("header", True).csv(str(tmp_path / "csv")).collect()
    assert {r.gare_safe: float(r.predicted) for r in back} == {"a_b": 0.0, "a_b~2": 2.0, "a_b~3": 1.0, "c": 3.0}
