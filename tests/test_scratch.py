import os

from docloom.sources.scratch import materialize, scratch_dir, scratch_scope


def folders(spark):
    return {f for f in os.listdir(scratch_dir(spark).removeprefix("file://")) if f.startswith("docloom-")}


def test_scopes_delete_what_is_not_kept(spark):
    before = folders(spark)
    outside = materialize(spark.range(3), "outside")
    with scratch_scope(spark) as keep:
        lost = materialize(spark.range(5), "lost")
        with scratch_scope(spark) as inner:
            a = materialize(lost.filter("id > 1"), "a")
            b = inner(materialize(a.selectExpr("id * 2 AS id"), "b").unionAll(outside))
        assert b.count() == 6
        kept = keep(materialize(b.groupBy().count(), "kept").filter("count > 0"))
    assert kept.first()[0] == 6 and outside.count() == 3
    assert sorted(f.rsplit("-", 1)[-1] for f in folders(spark) - before) == ["kept", "outside"]


def test_a_scope_that_fails_is_left(spark):
    before = folders(spark)
    try:
        with scratch_scope(spark):
            materialize(spark.range(3), "x")
            raise KeyError("x")
    except KeyError:
        pass
    assert folders(spark) == before
    materialize(spark.range(3), "after")
    assert len(folders(spark)) == len(before) + 1
