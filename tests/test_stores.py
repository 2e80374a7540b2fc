"""Stored tables: joins without a shuffle, rewrites of touched folders, labels, keyed state."""

import random
import uuid

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import Row

from leadlake.operators import profile, stores
from leadlake.operators.ranking import keep_best
from leadlake.operators.upsert import upsert_rows
from leadlake.streaming import flags, increments

ROWS = "k int, seq int, v string"


def test_stores_join_without_an_exchange_of_rows(spark, tmp_path):
    mark = uuid.uuid4().hex[:8]
    for name in ("left", "right"):
        stores.create_store(spark, f"{name}_{mark}", f"{tmp_path}/{name}")
    left = stores.save_bucketed(spark.createDataFrame([(f"c{i % 40}",) for i in range(90)] + [(None,)], "credit_code string"), f"left_{mark}.t", "credit_code", 4)
    right = stores.save_bucketed(spark.createDataFrame([(f"c{i % 60}",) for i in range(20, 200)], "credit_code string"), f"right_{mark}.t", "credit_code", 4)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = stores.coverage(left, right)
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Exchange hashpartitioning" not in plan and plan.count("Exchange SinglePartition") == 1
        assert tuple(found.first()) == (40, 40)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_only_touched_folders_are_rewritten(spark, tmp_path):
    rng = random.Random(1)
    rows = [(i, rng.randrange(9), "old") for i in range(500)]
    table = stores.KeyedTable(f"{tmp_path}/t", ("k",), 64)
    table.create(spark.createDataFrame(rows, ROWS))
    changes = spark.createDataFrame([(3, 9, "new"), (3, 8, "older"), (4, -1, "late"), (900, 1, "added")], ROWS)
    stores.files_by_part(spark, table.path).write.parquet(f"{tmp_path}/before")
    parts = table.upsert(changes, "seq")
    assert 0 < len(parts) <= 3
    after = stores.files_by_part(spark, table.path)
    changed = stores.rewritten(spark.read.parquet(f"{tmp_path}/before"), after)
    assert sorted(int(r[0]) for r in changed.collect()) == parts
    want = upsert_rows(spark.createDataFrame(rows, ROWS), changes, ["k"], "seq")
    assert sorted(map(tuple, table.read(spark).collect())) == sorted(map(tuple, want.collect()))
    assert table.upsert(changes, "seq") == parts
    assert sorted(map(tuple, table.read(spark).collect())) == sorted(map(tuple, want.collect()))
    assert table.patch(changes.limit(0), ["v"], "seq") == []
    table.patch(spark.createDataFrame([(3, 9, None), (5, -5, "stale")], ROWS), ["v"], "seq")
    assert {r["k"]: r["v"] for r in table.read(spark).collect() if r["k"] in (3, 5)} == {3: None, 5: "old"}


def test_slices_of_any_name(spark, tmp_path):
    names = ["a", "b/c=d%", "中 文", None, "1"]
    rows = spark.createDataFrame([(i, i, names[i % 5]) for i in range(50)], ROWS)
    table = stores.SlicedTable(f"{tmp_path}/s", "v")
    table.create(rows)
    for i, name in enumerate(names):
        table.refresh(spark.createDataFrame([(1000 + i, 0, name)] if i % 2 == 0 else [], ROWS), name)
    got = sorted((tuple(r) for r in table.read(spark, rows.schema).collect()), key=repr)
    assert got == sorted([(1000 + i, 0, names[i]) for i in (0, 2, 4)], key=repr)


def test_a_label_is_loaded_once_and_unfinished_loads_are_not_read(spark, tmp_path):
    target, rows = str(tmp_path / "t"), spark.createDataFrame([(1, 1, "a"), (2, 1, "b")], ROWS)
    assert increments.load_once(rows, target, "first") and not increments.load_once(rows, target, "first")
    # A second load is lost when half of its data is written, before its record.
    rows.limit(1).write.parquet(f"{target}/delta/load={uuid.uuid4().hex}")
    assert increments.read_loads(spark, target).count() == 2 and not increments.loaded(spark, target, "second")
    assert increments.load_once(rows, target, "second")
    assert increments.read_loads(spark, target).count() == 4
    # Two writers of one label that meet: one of them counts, the same for every reader.
    spark.createDataFrame([("second", "zz")], increments.LEDGER).write.mode("append").parquet(f"{target}/ledger")
    rows.write.parquet(f"{target}/delta/load=zz")
    assert increments.read_loads(spark, target).count() == 4
    with pytest.raises(PySparkException):
        increments.load_once(rows.selectExpr("*", "raise_error('lost') AS x"), target, "third")
    assert not increments.loaded(spark, target, "third") and increments.read_loads(spark, target).count() == 4


def test_flags_from_state_over_batches(spark, tmp_path):
    schema = "credit_code string, contact_type string, contact_value string, op string, at long"
    source, target = str(tmp_path / "in"), str(tmp_path / "out")
    rng, given, changed = random.Random(7), [], []
    for batch in range(3):
        rows = [
            (f"c{rng.randrange(12)}", rng.choice(["mobile", "landline", "email", "fax"]), str(rng.randrange(4)), rng.choice(["add", "add", "delete"]), rng.randrange(3000))
            for _ in range(40)
        ] + [("late", "mobile", "1", ("add", "delete", "add")[batch], (50, 60, 55)[batch])]
        given += rows
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
        query = increments.flag_stream(increments.file_stream(spark, source, schema), f"{tmp_path}/check", target)
        query.awaitTermination()
        assert query.lastProgress["numInputRows"] == len(rows)
        changed.append(increments.read_loads(spark, target).filter(f"batch_id = {batch}").count())
    last = {}
    for code, kind, value, op, at in given:
        key = (code, kind, value)
        if kind != "fax" and (key not in last or (at, op) > last[key]):
            last[key] = (at, op)
    want = {c: tuple(sum(k[0] == c and k[1] == kind and v[1] == "add" for k, v in last.items()) for kind in ("mobile", "landline", "email")) for c in {g[0] for g in given}}
    got = {r["credit_code"]: r for r in increments.read_flags(spark, target).collect()}
    assert {c: (r["mobile_count"], r["has_landline"], r["email_count"]) for c, r in got.items()} == {c: (m, int(t > 0), e) for c, (m, t, e) in want.items()}
    assert got["late"]["mobile_count"] == 0 and all(r["has_contact"] == int(sum(want[c]) > 0) for c, r in got.items())
    assert changed[0] == len({g[0] for g in given[:41]}) and changed[2] < len(want)


def test_figures_of_a_load_come_from_its_write(spark, tmp_path):
    rows = spark.createDataFrame([("N1", 1), ("N1", 2), ("91", 1), (None, 5), ("92", 3), ("92", 3)], "credit_code string, fill_score int")
    figures = profile.load_observed(rows, lambda r: keep_best(r, ["credit_code"], "fill_score", []), f"{tmp_path}/out")
    assert figures == {"rows": 6, "bad_rows": 1, "companies": 3, "surrogate": 1, "duplicates": 2}
    assert spark.read.parquet(f"{tmp_path}/out").count() == 3


class Stored:
    """A state store of one key: a value and a map, with the calls that they got."""

    def __init__(self):
        self.value, self.map, self.calls, self.timers = None, {}, 0, []

    def getValueState(self, name, schema):
        return self

    def getMapState(self, name, key, value, ttl=None):
        return self

    def registerTimer(self, at):
        self.timers.append(at)

    def _call(self, found=None):
        self.calls += 1
        return found

    def get(self):
        return self._call(self.value)

    def update(self, value):
        self.value = self._call(value)

    def getValue(self, key):
        return self._call(self.map.get(key))

    def containsKey(self, key):
        return self._call(key in self.map)

    def updateValue(self, key, value):
        self.map[key] = self._call(value)

    def removeKey(self, key):
        del self.map[self._call(key)]


class Clock:
    def __init__(self, now):
        self.now = now

    def getCurrentProcessingTimeInMs(self):
        return self.now


def test_flags_of_a_large_company_touch_few_chunks():
    change = Row("contact_type", "contact_value", "op", "at")
    rng, state, processor, last = random.Random(3), Stored(), flags.ContactFlags(), {}
    processor.init(state)
    kinds = [*flags.TYPES, "fax"]
    got = {}
    for batch in range(6):
        rows = [change(rng.choice(kinds), rng.choice([None, *map(str, range(3000))]), rng.choice(["add", "add", "delete", "?"]), rng.randrange(2000)) for _ in range(3000 if batch < 4 else 5)]
        state.calls = 0
        for out in processor.handleInputRows(("c",), iter(rows), Clock(0)):
            got = out.asDict()
        for kind, value, op, at in rows:
            at_last, was = last.get((kind, value), (-1, "?"))
            if kind != "fax" and not at_last >= at + (op == "delete" and was == "add"):
                last[kind, value] = (at, op)
        want = [sum(k == kind and op == "add" for (k, _), (_, op) in last.items()) for kind in flags.TYPES]
        assert (got["mobile_count"], got["has_landline"], got["email_count"]) == (want[0], int(want[1] > 0), want[2])
        assert batch < 4 or state.calls <= 2 + 2 * len(rows)
    assert len(state.map) > 16 and state.value[4] == len(last) and state.value[5] is None
    # A small company takes two calls a batch.
    small = Stored()
    processor.init(small)
    (out,) = processor.handleInputRows(("s",), iter([change("mobile", str(i), "add", i) for i in range(flags.CHUNK)]), Clock(0))
    assert out["mobile_count"] == flags.CHUNK and small.calls == 2


def test_deletions_are_forgotten_in_time():
    change = Row("contact_type", "contact_value", "op", "at")
    for many in (1, 500):
        state, processor = Stored(), flags.ContactFlags(forget_ms=100)
        processor.init(state)
        kept = [change("email", str(i), "add", 1) for i in range(many)]

        def run(now, *rows):
            return [r["mobile_count"] for r in processor.handleInputRows(("c",), iter(rows), Clock(now))]

        assert run(0, *kept, change("mobile", "1", "add", 5)) == [1] and state.timers == []
        assert run(10, change("mobile", "1", "delete", 9)) == [0] and state.timers == [110]
        assert run(109, change("mobile", "1", "add", 7)) == []
        assert list(processor.handleExpiredTimer(("c",), Clock(110), None)) == [] and state.value[4] == many
        assert run(120, change("mobile", "1", "add", 7)) == [1]
