"""Cases that once gave wrong answers: collated duplicates, parameters against stored sums,
CSV header order, paths that look alike, command-line types, unknown suppliers."""

import shutil
from dataclasses import replace

import pytest

from pyspark.sql import functions as F

from shelfwise.__main__ import main
from shelfwise.operators import quality, risk
from shelfwise.params import DEFAULT
from shelfwise.plans.registry import REPORTS, run
from shelfwise.sources import store
from shelfwise.sources.derive import derive_from_frames
from shelfwise.sources.loader import read_inventory, with_collation
from tests.conftest import SF_SMALL


def test_duplicates_under_a_collation(make_inventory):
    df = with_collation(make_inventory([dict(SKU_ID="ab"), dict(SKU_ID="AB"), dict(SKU_ID="áb", Order_Quantity=1)]))
    assert [r.record_count for r in quality.business_key_duplicates(df).collect()] == [3]
    assert quality.full_row_duplicates(df).first()[0] == 1


def test_hot_row_repeated_many_times(make_inventory):
    df = make_inventory([dict(SKU_ID="HOT")] * 3000 + [dict(SKU_ID=f"S{i}") for i in range(50)])
    assert [(r.SKU_ID, r.record_count) for r in quality.business_key_duplicates(df).collect()] == [("HOT", 3000)]
    assert quality.full_row_duplicates(df).first()[0] == 1


def test_parameters_that_enter_the_stored_summary(spark):
    params = replace(DEFAULT, overstock_rop_multiple=3)
    got = run(spark, "risk_overstock_exposure", SF_SMALL, params).collect()
    want = risk.overstock_exposure(store.inventory_table(spark, SF_SMALL), params).collect()
    assert got == want and got != run(spark, "risk_overstock_exposure", SF_SMALL).collect()


def test_csv_columns_are_bound_by_name(spark, tmp_path):
    fact = store.inventory_table(spark, SF_SMALL).limit(20)
    swapped = [c for c in fact.columns if c not in ("SKU_ID", "Warehouse_ID")]
    fact.select("Date", "Warehouse_ID", "SKU_ID", *[c for c in swapped if c != "Date"]).write.option("header", True).csv(str(tmp_path / "swapped"))
    fact.write.option("header", True).csv(str(tmp_path / "same"))
    assert sorted(read_inventory(spark, str(tmp_path / "same"), "csv").collect(), key=str) == sorted(fact.collect(), key=str)
    with pytest.raises(Exception, match="CSV header"):
        read_inventory(spark, str(tmp_path / "swapped"), "csv").collect()


def test_folders_with_similar_paths(spark, tmp_path):
    for name, sf in (("a_b/x", "sf0.001"), ("a/b/x", "sf0.01")):
        (tmp_path / name).mkdir(parents=True)
        for t in ("lineitem", "supplier", "nation", "region"):
            shutil.copy(f"/root/testdata/{sf}/{t}.parquet", tmp_path / name / f"{t}.parquet")
    rows = [store.inventory_table(spark, str(tmp_path / name)).count() for name in ("a_b/x", "a/b/x")]
    assert rows == [5992, 59924]


@pytest.mark.parametrize("value", ["approx_distinct=no", "sku_profile_top=many", "cv_high=x"])
def test_command_line_rejects_other_types(value, capsys):
    assert main(["run", "dq_row_count", "--sf-dir", SF_SMALL, "--param", value]) == 2


def test_command_line_booleans(spark, capsys):
    assert main(["run", "dq_dimension_cardinality", "--sf-dir", SF_SMALL, "--param", "approx_distinct=False"]) == 0
    assert "200" in capsys.readouterr().out


def test_stored_inventory_is_reused(spark, tmp_path):
    fact = store.inventory_table(spark, SF_SMALL)
    store.store_inventory(fact, str(tmp_path / "kept"))
    data = store.open_inventory(spark, str(tmp_path / "kept"))
    for key in ("inv_abc_concentration", "dq_summary", "dem_promotion_impact", "act_prioritized_list"):
        assert REPORTS[key][1](data, DEFAULT).collect() == run(spark, key, SF_SMALL).collect()
    # analysis reports read the stored tables, not the fact table
    files = REPORTS["risk_pair_profile"][1](data, DEFAULT).inputFiles()
    assert files and all("/kept/pair/" in f for f in files)


def test_unknown_supplier_is_kept_for_the_contract(spark):
    read = lambda t: spark.read.parquet(f"{SF_SMALL}/{t}.parquet")
    lineitem = read("lineitem")
    unknown = derive_from_frames(lineitem, read("supplier").filter("s_suppkey <> 3"), read("nation"), read("region"))
    assert unknown.count() == 5992 and unknown.filter(F.col("Region").isNull()).count() > 0


def test_grains_grow_with_the_input(spark):
    small, large = (store.inventory_data(spark, f"/root/testdata/{sf}").grain("supplier_pair").count() for sf in ("sf0.001", "sf0.01"))
    assert large > 8 * small


def test_dirty_reports_are_not_vacuous(spark):
    from shelfwise.plans import all_queries

    for key, fn in all_queries().items():
        if key.startswith("dirty_"):
            rows = fn(spark, SF_SMALL).collect()
            assert rows and (len(rows) > 5 or all(v for v in rows[0].asDict().values() if v is not None and v != 0))


def test_keys_with_accents_and_marks(spark):
    """Collated keys against an independent folding: several accents, a sharp s, combining marks, case, NULL."""
    import unicodedata

    import duckdb

    from shelfwise.plans.registry import collated_units

    skus = ["Größe", "GROSSE", "große", "Gro\u0308ße", "ÀÉÎÕÜ", "aéi\u0302õu", "aeiou", "Ĥat", "hat", "h\u0302AT", "ñandú", "NANDU", None, "plain", "Ångström", "angstrom"]
    rows = [(s, w, i) for i, s in enumerate(skus) for w in ("WĤ_1", "wh_1", "WH_2")]
    fact = spark.createDataFrame(rows, "SKU_ID string, Warehouse_ID string, Units_Sold int")
    got = sorted(((r.SKU_ID or "", r.Warehouse_ID, r.records, r.units) for r in collated_units(fact).collect()))
    con = duckdb.connect()
    con.execute("CREATE TABLE f (SKU_ID VARCHAR, Warehouse_ID VARCHAR, Units_Sold INT)")
    con.executemany("INSERT INTO f VALUES (?, ?, ?)", [(s and unicodedata.normalize("NFC", s), w, i) for s, w, i in rows])
    want = con.execute("""SELECT COALESCE(replace(strip_accents(lower(SKU_ID)), 'ß', 'ss'), '') AS s, strip_accents(lower(Warehouse_ID)) AS w, COUNT(*), SUM(Units_Sold)
        FROM f GROUP BY 1, 2 ORDER BY 1, 2""").fetchall()
    assert got == sorted(want)
