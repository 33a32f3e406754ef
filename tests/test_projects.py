"""Runs of whole projects where pairs share tables, stores, months, mappings and options."""

import json

import pytest
from pyspark.sql import functions as F

from ledgerline.plans import runner
from ledgerline.plans.runner import run_pair, run_project
from ledgerline.plans.spec import Project
from ledgerline.sources.store import Store


@pytest.fixture
def folder(spark, tmp_path):
    """t: 40 rows on 20 days, with a number k and a text v; late: the same ten days later."""
    day = F.date_add(F.lit("2024-01-25").cast("date"), (F.col("id") % 20).cast("int"))
    spark.range(40).select("id", (F.col("id") % 5).alias("k"), (F.col("id") % 3).cast("string").alias("v"), day.alias("d"), F.date_add(day, 10).alias("e")).write.parquet(f"{tmp_path}/t")
    return tmp_path


def side(folder, **more):
    return {"name": "t", "source": "parquet", "table": f"{folder}/t", "date_col": "d"} | more


def project(folder, **pairs) -> Project:
    return Project.from_json(json.dumps({"pairs": {n: {"left": l, "right": r, "vintage": "month", "col_filter": {"include": ["k", "v"]}} | more for n, (l, r, more) in pairs.items()}}))


def totals(p) -> dict[str, int]:
    return {r.dt: r.n_total for r in p.where("column_name = 'k'").collect()}


def test_pairs_that_share_a_table(spark, folder):
    a, b, c = side(folder, where="k < 2"), side(folder, where="k < 3"), side(folder, where="k < 3", date_col="e")
    store = Store(spark, f"file://{folder}/store")
    one = project(folder, a=(a, a, {}), b=(b, b, {}), c=(c, c, {}))
    assert len(one.sides()) == 3
    for kept in (None, store):
        out = run_project(spark, one, kept)
        assert [r.s for n in "abc" for r in out[n].rows.agg(F.sum("left_count").alias("s")).collect()] == [16, 24, 24]
        assert {r.status for n in "abc" for r in out[n].rows.collect()} == {"match"}
        assert sum(totals(out["a"].left_profile).values()) == 16 and sum(totals(out["b"].right_profile).values()) == 24
        assert totals(out["c"].left_profile).keys() == {"2024-02-01"} and not any(r.has_diff for n in "abc" for r in out[n].columns.collect())
        for o in out.values():
            o.release()


def test_stored_buckets_follow_rows_days_and_types(spark, folder):
    store = Store(spark, f"file://{folder}/store")
    run = lambda **more: run_pair(spark, project(folder, a=(side(folder), side(folder), more)).pairs[0], store=store)
    first = totals(run().left_profile)
    assert first == {"2024-01-01": 14, "2024-02-01": 26}
    stored = lambda: store._last("col_stats")[0]
    before = stored()
    assert totals(run().left_profile) == first and stored() == before  # nothing was left to be profiled
    assert totals(run(excludeDates=["2024-02-03"]).left_profile) == {"2024-01-01": 14, "2024-02-01": 24}
    assert totals(run(toDate="2024-01-31").left_profile) == {"2024-01-01": 14}
    typed = run(col_type_overrides={"k": "categorical"}).left_profile
    assert {r.col_type for r in typed.where("column_name = 'k'").collect()} == {"categorical"}
    spark.read.parquet(f"{folder}/t").where("id = 39").select(F.lit(100).cast("long").alias("id"), "k", "v", "d", "e").write.mode("append").parquet(f"{folder}/t")
    assert totals(run().left_profile) == {"2024-01-01": 14, "2024-02-01": 27}  # the running month is profiled again
    before = stored()
    run(mode="full")
    assert stored() > before


def test_months_and_dates_that_cannot_be_read(spark, tmp_path):
    rows = [(202401, "a")] * 3 + [(202402, "b")] * 2 + [(202403, "a"), (99, "z"), (None, "z"), (None, "z")]
    for name, chosen in (("l", rows), ("r", rows[:5] + rows[5:6] * 2)):
        spark.createDataFrame(chosen, "m int, v string").write.parquet(f"{tmp_path}/{name}")
    of = lambda n, kind: {"name": n, "source": "parquet", "table": f"{tmp_path}/{n}", "date_col": "m", "date_type": kind}
    for kind in ("num", "num_yyyymm", "integer"):
        for vintage, want in (("day", {"202401": 3, "202402": 2}), ("quarter", {"2024-01-01": 5}), ("all", {"all": 5}), ("sample@1", None)):
            config = {"pairs": {"p": {"left": of("l", kind), "right": of("r", kind), "vintage": vintage, "toDate": "2024-12-31" if vintage == "day" else ""}}}
            out = run_pair(spark, Project.from_json(json.dumps(config)).pairs[0])
            assert out.matching == ["202401", "202402"] and {(r.dt, r.status) for r in out.rows.collect()} == {("202401", "match"), ("202402", "match"), ("202403", "mismatch")}
            got = {r.dt: r.n_total for r in out.left_profile.collect()}
            assert got == want if want and vintage != "all" else set(got) == {"all"}
            if vintage != "day":  # bounds leave them out
                assert out.undated == {"left": (2, 1), "right": (0, 0)} and "1 rows on the left" in out.warnings()[0]
            out.release()
    texts = spark.createDataFrame([("2024/13/99", "x")], "m string, v string")
    texts.write.parquet(f"{tmp_path}/bad")
    none = run_pair(spark, Project.from_json(json.dumps({"pairs": {"p": {"left": of("bad", "string"), "right": of("bad", "string")}}})).pairs[0])
    assert none.rows.count() == 0 and none.undated["left"] == (0, 1) and len(none.warnings()) == 3


def test_mappings_of_runs(spark, folder):
    spark.read.parquet(f"{folder}/t").select(F.col("k").alias("K"), F.col("v").alias("val"), F.col("id").alias("src_id"), "d").write.parquet(f"{folder}/u")
    store = Store(spark, f"file://{folder}/store")
    left, right = side(folder), {"name": "u", "source": "parquet", "table": f"{folder}/u", "date_col": "d"}
    rules = [{"left": "i*", "right": "src_i*"}, {"left": "v", "right": "val"}]
    config = {"pairs": {"a": {"left": left, "right": right, "col_rules": rules}, "b": {"left": right, "right": left}, "c": {"left": left, "right": right, "col_map": {"k": "K"}}}}
    out = run_project(spark, Project.from_json(json.dumps(config)), store)
    assert out["a"].mapping == {"id": "src_id", "k": "K", "v": "val"} and not any(r.has_diff for r in out["a"].columns.collect())
    assert out["b"].mapping == {"src_id": "id", "K": "k", "val": "v"}  # the stored one, turned around
    assert out["c"].mapping == {"k": "K"}
    assert {(r.left_col, r.state) for r in store.read("mappings").where("source_table = 'parquet_t'").collect()} == {("d", "name"), ("id", "rule 0"), ("k", "name"), ("v", "rule 1")}


def test_keys_are_applied_or_refused(folder):
    good = {"left": side(folder), "right": side(folder), "description": "x", "diff_map": {"a": 1}, "mode": "full"}
    of = lambda more, **top: Project.from_json(json.dumps({"pairs": {"p": good | more}} | top))
    pair = of({}, settings={"seed": 7, "exact": False}, metadata={"title": "t"}).pairs[0]
    assert pair.mode == "full" and pair.notes == {"description": "x", "diff_map": {"a": 1}}
    s = of({"left": side(folder, date_transform="datetime_to_date", vintage_transform="date_trunc('YEAR', {col})", vintage="day")}).pairs[0].left
    assert s.dated.transform == "datetime_to_date" and s.dated.bucketed.startswith("date_trunc")
    kinds = {"fiscal": {"label": "F", "category": "string", "format": "YYYYMMDD"}, "odd": {"label": "O", "category": "string", "format": "Q?", "parse_to_date": "to_date({col}, 'yyyy')"}, "never": {"label": "N", "category": "string", "format": "Q?"}}
    assert of({"left": side(folder, date_type="fiscal")}, date_types=kinds).pairs[0].left.date_type == "string_compact"
    assert of({"left": side(folder, date_type="odd")}, date_types=kinds).pairs[0].left.transform.startswith("to_date")
    for more, top, said in (
        ({"colmap": {}}, {}, "unknown keys colmap"), ({"left": side(folder, filter="x")}, {}, "unknown keys filter"), ({}, {"setting": {}}, "unknown keys setting"), ({}, {"settings": {"x": 1}}, "unknown keys x"), ({"mode": "some"}, {}, "unknown mode"),
        ({"left": side(folder, vintage="year")}, {}, "can't be compared"), ({"left": side(folder, date_type="never")}, {"date_types": kinds}, "can't be read"), ({}, {"date_types": {"bad": {"label": "x"}}}, "needs a label"), ({"vintage": "decade"}, {}, "unknown vintage"),
    ):
        with pytest.raises(ValueError, match=said):
            of(more, **top)


def test_sql_file_sources(spark, folder):
    (folder / "q.sql").write_text("-- first\nSELECT 1 AS a;\n-- t\nSELECT id, d, k FROM parquet.`%s/t`\nWHERE k < 2;\n" % folder)
    s = {"source": "sqlfile", "table": f"file://{folder}/q.sql", "name": "t", "date_col": "d"}
    out = run_pair(spark, Project.from_json(json.dumps({"pairs": {"p": {"left": s, "right": side(folder, where="k < 2"), "vintage": "all"}}})).pairs[0])
    assert {r.status for r in out.rows.collect()} == {"match"} and out.left_profile.count() == 2
    with pytest.raises(ValueError, match="no block 'nope'"):
        run_pair(spark, Project.from_json(json.dumps({"pairs": {"p": {"left": s | {"options": {"block": "nope"}}, "right": side(folder)}}})).pairs[0])


def test_a_shared_table_is_read_once(spark, folder, monkeypatch):
    """Three pairs that need different columns of one table: one count and one profile are made of it."""
    made = []

    class Counted(runner.Shared):
        def __init__(self, tables):
            super().__init__(tables)
            made.append(self._kept)

    monkeypatch.setattr(runner, "Shared", Counted)

    def run(*pairs) -> int:
        out = run_project(spark, project(folder, **{n: (side(folder), side(folder), {"col_filter": {"include": cs}} | more) for n, cs, more in pairs}))
        assert [sorted(r.left_col for r in o.columns.select("left_col").distinct().collect()) for o in out.values()] == [cs for _, cs, _ in pairs]
        return len(made[-1])

    assert run(("a", ["k"], {}), ("b", ["id"], {}), ("c", ["k", "v"], {})) == 2
    assert run(("a", ["k"], {}), ("b", ["v"], {"excludeDates": ["2024-02-01"]})) == 3  # other days
    assert run(("a", ["k"], {}), ("b", ["k"], {"col_type_overrides": {"k": "categorical"}})) == 3  # other types
