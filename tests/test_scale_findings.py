"""What differs from SQL only in tables larger than the driver's small ones."""

import datetime

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from helpers import compare

from quirefold.operators import inspection
from quirefold.plans import decks, encoders, inspections, jobs, lookups  # noqa: F401 (they register their queries)
from quirefold.plans.catalogue import ORACLES, QUERIES
from quirefold.sources import objects


@pytest.mark.parametrize("name", ["r2_r4_watched_jobs", "r4_r5_watchdog_stream"])
def test_a_client_that_was_silent_for_days_is_still_known(spark, tmp_path, name):
    # A day is 144,000 events. Clients that hide, run a job out of date or end one, and go on after days.
    ids = {1: [7, 22, 200_000, 200_001, 200_024], 2: [1_001, 1_007, 400_002, 400_010], 3: [14, 26, 300_000, 300_005], 4: [900_000], 5: [28, 44, 500_001, 500_003, 500_006]}
    rows = sorted((i, u) for u, own in ids.items() for i in own)
    kinds = ["click", "view", "error", "signup", "purchase"]
    at = datetime.datetime(2024, 1, 1)
    pq.write_table(pa.table({"event_id": [i for i, _ in rows], "ts": pa.array([at] * len(rows), pa.timestamp("us")), "user_id": [u for _, u in rows], "event_type": [kinds[i % 5] for i, _ in rows], "value": [float(i % 120) for i, _ in rows], "props": ["{}"] * len(rows)}), tmp_path / "events.parquet")
    assert compare(QUERIES[name], ORACLES[name], spark, str(tmp_path)) > 0


def test_best_attempt_rounds_prices_as_sql_does(spark, tmp_path):
    # Cut to whole numbers, the first deck's prices are equal and the third's in another order; halves go to the even number.
    rows = [(1, 1, 40.0, 10.7), (1, 2, 40.0, 10.2), (2, 1, 40.0, 11.5), (2, 2, 40.0, 12.4), (3, 1, 40.0, 21.4), (3, 2, 40.0, 20.6), (4, 1, 40.0, 12.5), (4, 2, 40.0, 11.6), (5, 1, 3.0, 9.0), (5, 2, 4.0, 9.0)]
    columns = list(zip(*rows, strict=True))
    pq.write_table(pa.table({"l_orderkey": columns[0], "l_linenumber": pa.array(columns[1], pa.int32()), "l_quantity": columns[2], "l_extendedprice": columns[3]}), tmp_path / "lineitem.parquet")
    assert compare(QUERIES["t8_best_attempt"], ORACLES["t8_best_attempt"], spark, str(tmp_path)) == 5


def test_an_inspection_works_out_what_is_asked_for_alone(spark, monkeypatch):
    documents = spark.createDataFrame([(1, '{"qpdf": [{}, {"obj:2 0 R": {"value": {"/MediaBox": "5 0 R"}}, "obj:5 0 R": {"value": [0, 0, 30, 40]}, "obj:3 0 R": {"value": {"/Type": "/Page", "/Parent": "2 0 R"}}}], "pages": [{"object": "3 0 R"}]}')], "deck_id long, json string")

    def never(*_):
        raise AssertionError("not asked for")

    for name in ("image_records", "reached_images", "features_of"):
        monkeypatch.setattr(inspection, name, never)
    assert [(r["page"], r["width"], r["height"]) for r in inspection.inspect(documents).pages.collect()] == [(1, 30.0, 40.0)]


def test_only_values_that_hold_a_reference_are_gone_into(spark):
    rows = [(1, "1 0 R", '{"/A": {"/B": [1, {"/C": "2 0 R"}], "/D": {"/E": "text"}}, "/F": "3 0 R"}'), (1, "2 0 R", '{"/G": {"/H": {"/I": 1}}}'), (1, "3 0 R", '"1 0 R"')]
    o = spark.createDataFrame(rows, "deck_id long, ref string, json string").selectExpr("deck_id", "ref", "parse_json(json) AS dict")
    assert {(r["src"], r["key"], r["dst"]) for r in objects.references(o).collect()} == {("1 0 R", "/C", "2 0 R"), ("1 0 R", "/F", "3 0 R"), ("3 0 R", "", "1 0 R")}
    assert objects.nested(o, holding=objects.HOLDS_REF).where("src = '2 0 R'").count() == 0 < objects.nested(o).where("src = '2 0 R'").count()
