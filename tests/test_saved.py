import os
from dataclasses import replace

import pytest

from vespertide.operators import common, signals
from vespertide.operators.common import finished, kept, load_table, saved, shared_folder
from vespertide.settings import DEFAULTS
from vespertide.sources import tables


@pytest.fixture
def source(spark, tmp_path):
    spark.range(10).write.parquet(f"{tmp_path}/source")
    return f"{tmp_path}/source"


@pytest.fixture
def built(spark, source):
    calls = []

    def get(made_of=()):
        return saved(spark, "numbers", [source], lambda: (calls.append(1), spark.read.parquet(source).selectExpr("id", "id * 2 AS twice"))[1], made_of)

    return get, calls


def another_session(monkeypatch):
    """What a session that shares the folder knows: nothing."""
    monkeypatch.setattr(common, "_CHECKED", {})


def place(spark):
    at = spark.conf.get("spark.checkpoint.dir") + "/saved"
    return max((f"{at}/{n}" for n in os.listdir(at) if n.startswith("numbers-")), key=os.path.getmtime)


def test_two_sessions_share_one_save(spark, built, monkeypatch):
    get, calls = built
    assert get().count() == 10
    another_session(monkeypatch)
    assert get().count() == 10 and len(calls) == 1


def test_a_changed_source_or_setting_is_built_anew(spark, built, source, monkeypatch):
    get, calls = built
    get()
    get([{"min_df": 3}])
    assert len(calls) == 2
    spark.range(5).write.mode("append").parquet(source)
    assert get().count() == 15 and len(calls) == 3


@pytest.mark.parametrize("harm", ["cut", "gone", "manifest", "unfinished"])
def test_a_cut_save_is_none_and_is_built_anew(spark, built, monkeypatch, harm):
    get, calls = built
    get()
    at = place(spark)
    part = next(f"{at}/data/{n}" for n in os.listdir(f"{at}/data") if n.startswith("part"))
    if harm == "cut":
        with open(part, "r+b") as f:
            f.truncate(20)
    elif harm == "gone":
        os.remove(part)
    elif harm == "manifest":
        with open(f"{at}/manifest.json", "w") as f:
            f.write('{"rows": 1')
        os.remove(f"{at}/.manifest.json.crc")
    else:
        os.remove(f"{at}/manifest.json")
    assert load_table(spark, at) is None
    assert load_table(spark, f"{at}/nowhere") is None
    another_session(monkeypatch)
    assert get().count() == 10 and len(calls) == 2


def test_signals_are_those_of_their_settings_and_items(spark, sf_dir):
    items = tables.items(spark, sf_dir)
    sources = [f"{sf_dir}/documents.parquet"]
    usual = signals.saved_metadata(items, sources)
    rare = signals.saved_metadata(items, sources, replace(DEFAULTS, min_df=50))
    few = signals.saved_metadata(items.where("id < 50"), sources)
    assert 0 < rare.idf.count() < usual.idf.count()
    assert few.ids.agg({"id": "max"}).first()[0] < 50 <= usual.ids.agg({"id": "max"}).first()[0]
    assert signals.saved_metadata(items, sources).idf.count() == usual.idf.count()


def test_what_was_kept_on_the_way_is_deleted(spark):
    at = shared_folder(spark).removeprefix("file:")
    before = set(os.listdir(at)) if os.path.exists(at) else set()

    def make():
        a = kept(spark.range(10))
        return finished(lambda: kept(a.where("id > 2")).where("id < 6")).unionByName(kept(spark.range(100, 101)))

    out = finished(make)
    assert sorted(r["id"] for r in out.collect()) == [3, 4, 5, 100]
    assert len(set(os.listdir(at)) - before) == 1
    with pytest.raises(ZeroDivisionError):
        finished(lambda: kept(spark.range(3)) and 1 / 0)
    assert len(set(os.listdir(at)) - before) == 1
