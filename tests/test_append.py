"""Retries, offsets and acknowledgements, in both the direct and the sliced form."""

import os
import random

import pytest
from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

from tidemark.operators import append, audit
from tidemark.plans import ordered
from tidemark.plans.ordered import max_before, number_rows
from tidemark.schemas import ATTEMPT, PRODUCER_STATE, STORED_LOG
from tidemark.session import scratch_root
from tidemark.sources import log_table

FORMS = [False, True]  # range-sorted slices, and one window per group


def attempts(spark, rows):
    """rows: (partition, producer, seq) in arrival order."""
    return spark.createDataFrame(
        [(p, f"k{s}", f"v{i}", who, s, 0, 1_000 + i, i) for i, (p, who, s) in enumerate(rows)], ATTEMPT)


def model(rows):
    """What a single sequential log per partition would do with the attempts, one after the other."""
    last, ends, out = {}, {}, []
    for i, (p, who, s) in enumerate(rows):
        known = last.get((p, who))
        if known and s <= known[0]:
            out.append((i, False, known[1]))
        else:
            offset = ends.get(p, 0)
            ends[p] = offset + 1
            last[(p, who)] = (s, offset)
            out.append((i, True, offset))
    return out


def acks(df, form):
    return sorted((r.tie, r.accepted, r.ack_offset) for r in append.append_acks(df, form).collect())


@pytest.mark.parametrize("form", FORMS)
@pytest.mark.parametrize("rows, kept", [
    ([(0, "p", 0), (0, "p", 1), (0, "p", 1), (0, "q", 0), (0, "p", 0), (0, "p", 2)], [("p", 0), ("p", 1), ("p", 2), ("q", 0)]),
    ([(0, "p", 0), (0, "p", 2), (0, "p", 1)], [("p", 0), ("p", 2)]),
    ([(0, "p", 5), (1, "p", 3), (1, "p", 4)], [("p", 3), ("p", 4), ("p", 5)]),
])
def test_dedup_fixtures(spark, form, rows, kept):
    result = append.idempotent_dedup(attempts(spark, rows), form)
    assert sorted((r.producer_id, r.seq) for r in result.collect()) == kept


@pytest.mark.parametrize("form", FORMS)
def test_ack_of_a_duplicate_is_the_latest_offset(spark, form):
    df = attempts(spark, [(0, "p", 0), (0, "p", 1), (0, "p", 0)])
    assert [a for _, _, a in acks(df, form)] == [0, 1, 1]


@pytest.mark.parametrize("form", FORMS)
def test_random_attempts_equal_the_sequential_model(spark, form):
    rng = random.Random(7)
    rows = [(rng.randrange(3), rng.choice("aaaabc"), rng.randrange(60)) for _ in range(600)]
    df = attempts(spark, rows).repartition(5)
    assert acks(df, form) == model(rows)
    stored = append.log_records(df, form)
    assert audit.offset_audit(stored).where("NOT contiguous").isEmpty()
    assert audit.order_audit(stored, 3, form).agg(F.sum("out_of_order")).first()[0] == 0


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(0, 2), st.sampled_from("ab"), st.integers(0, 8)), min_size=1, max_size=40),
       st.sampled_from(FORMS))
def test_any_attempts_equal_the_sequential_model(spark, rows, form):
    assert acks(attempts(spark, rows), form) == model(rows)


def test_ten_writers_one_partition(spark):
    df = (spark.range(0, 10_000, 1, 8)
          .select(F.lit(0).alias("partition"), F.concat(F.lit("thread-"), (F.col("id") % 10).cast("string")).alias("key"),
                  F.lit("v").alias("value"), F.concat(F.lit("p"), (F.col("id") % 10).cast("string")).alias("producer_id"),
                  F.expr("id div 10").alias("seq"), F.lit(0).alias("attempt"),
                  F.lit(5).cast("long").alias("arrival_ms"), F.col("id").alias("tie")))
    for form in FORMS:
        row = audit.offset_audit(append.log_records(df, form)).first()
        assert (row.records, row.first_offset, row.last_offset, row.contiguous) == (10_000, 0, 9_999, True)


def test_retries_around_a_cut(spark):
    """200 writes; 78 to 82 are sent twice, as after a lost acknowledgement."""
    rows = [(0, "p", s) for s in range(83)] + [(0, "p", s) for s in range(78, 83)] + [(0, "p", s) for s in range(83, 200)]
    log = append.log_records(attempts(spark, rows))
    row = audit.offset_audit(log).first()
    assert (row.records, row.last_offset, row.contiguous) == (200, 199, True)
    assert [r.seq for r in log.orderBy("offset").collect()] == list(range(200))


def test_hot_group_in_one_millisecond(spark):
    """A third of all rows from one producer, all with the same arrival time: only the tie orders them."""
    df = (spark.range(0, 3_000, 1, 8)
          .select(F.lit(0).alias("partition"), F.lit("k").alias("key"), F.lit("v").alias("value"),
                  F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("p"), F.col("id").cast("string"))).alias("producer_id"),
                  (F.col("id") * 7919 % 3_001).alias("seq"), F.lit(0).alias("attempt"),
                  F.lit(5).cast("long").alias("arrival_ms"), F.col("id").alias("tie")))
    direct, by_slice = append.append_acks(df, True), append.append_acks(df)
    assert direct.exceptAll(by_slice).isEmpty() and by_slice.exceptAll(direct).isEmpty()


def test_appending_leaves_no_scratch_behind(spark, tmp_path):
    def held():
        folder = f"{scratch_root(spark)}/tidemark"
        return set(os.listdir(folder)) if os.path.isdir(folder) else set()
    before = held()
    append.append_to_log(spark, attempts(spark, [(0, "p", 0), (0, "p", 1)]), str(tmp_path / "log"), 0)
    assert held() == before
    append.log_records(attempts(spark, [(0, "p", 0)]))
    assert len(held() - before) == 1      # a lazy frame keeps what it reads: the slices of its one sort


def test_many_groups_that_span_slices(spark):
    df = spark.range(0, 1_000).select(F.when(F.col("id") % 3 == 0, -1).otherwise(F.col("id") % 50).alias("g"), "id")
    got = number_rows(df, ["g"], ["id"], "n").exceptAll(number_rows(df, ["g"], ["id"], "n", True))
    assert got.isEmpty()


def test_attempts_without_a_number(spark):
    rows = [(0, "k", "v", "p", None, None, 1, 1), (0, "k", "v", "p", 4, -3, 2, 2), (0, "k", "v", "p", None, 0, 3, 3)]
    df = spark.createDataFrame(rows, ATTEMPT)
    assert [(r.tie, r.accepted) for r in append.append_acks(df).orderBy("tie").collect()] == [(1, True), (2, True), (3, False)]
    stored = append.accept_batch(df, spark.createDataFrame([], PRODUCER_STATE))
    assert sorted((r.offset, r.seq) for r in stored.collect()) == [(0, None), (1, 4)]


def test_a_writer_that_dies_leaves_nothing(spark, tmp_path):
    path = str(tmp_path / "log")
    df = attempts(spark, [(0, "p", s) for s in range(100)])
    half = append.log_records(df).where("offset >= 50")
    log_table.write_log(half, f"{path}/_staged_0")
    assert append.append_to_log(spark, df, path, 0) and not append.append_to_log(spark, df, path, 0)
    row = audit.offset_audit(log_table.read_log(spark, path, STORED_LOG)).first()
    assert (row.records, row.contiguous) == (100, True)
    with pytest.raises(ValueError):
        append.append_to_log(spark, df, path, 2)


@pytest.mark.parametrize("form", FORMS)
def test_null_keys_form_a_group(spark, form):
    df = spark.createDataFrame([(None, 1, 5), (None, 2, 3), ("a", 1, 1), (None, 3, 4), (None, 4, 9)], "g string, o int, v long")
    got = {(r.g, r.o): (r.m, r.n) for r in
           max_before(number_rows(df, ["g"], ["o"], "n", form), ["g"], ["o"], "v", "m", form).collect()}
    assert got == {(None, 1): (None, 0), (None, 2): (5, 1), (None, 3): (5, 2), (None, 4): (5, 3), ("a", 1): (None, 0)}


def test_empty_input(spark):
    none = attempts(spark, [(0, "p", 0)]).limit(0)
    for form in FORMS:
        assert append.append_acks(none, form).count() == 0


def test_results_do_not_depend_on_partitioning(spark):
    rng = random.Random(3)
    rows = [(rng.randrange(2), rng.choice("abc"), rng.randrange(40)) for _ in range(300)]
    try:
        for n in (1, 4, 16):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            for form in FORMS:
                assert acks(attempts(spark, rows).repartition(n), form) == model(rows)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 8)


@pytest.mark.parametrize("form", FORMS)
def test_appending_to_an_existing_log(spark, tmp_path, form):
    rng = random.Random(11)
    rows = [(rng.randrange(2), rng.choice("ab"), rng.randrange(80)) for _ in range(200)]
    df, path = attempts(spark, rows), str(tmp_path / "log")
    for n, part in enumerate((df.where("tie < 120"), df.where("tie >= 120"), df)):   # the last one repeats everything
        append.append_to_log(spark, part, path, n, form)
    key = ["partition", "offset", "producer_id", "seq", "timestamp"]
    stored = log_table.read_log(spark, path, STORED_LOG).select(*key)
    want = append.log_records(df).select(*key)
    assert sorted(map(tuple, stored.collect())) == sorted(map(tuple, want.collect()))


@pytest.mark.parametrize("form", FORMS)
def test_plain_append_keeps_retries(spark, form):
    log = append.append_plain(attempts(spark, [(0, "p", 0), (0, "p", 0), (1, "p", 0), (0, "p", 1)]), form)
    assert sorted((r.partition, r.offset, r.seq) for r in log.collect()) == [(0, 0, 0), (0, 1, 0), (0, 2, 1), (1, 0, 0)]


def test_state_and_end_offsets(spark):
    log = append.log_records(attempts(spark, [(0, "p", 0), (0, "q", 4), (0, "p", 3), (1, "p", 2), (0, "p", 1)]))
    state = {(r.partition, r.producer_id): (r.last_seq, r.last_offset) for r in append.producer_state(log).collect()}
    assert state == {(0, "p"): (3, 2), (0, "q"): (4, 1), (1, "p"): (2, 0)}
    assert {(r.partition, r.records, r.next_offset) for r in append.log_end_offsets(log).collect()} == {(0, 3, 3), (1, 1, 1)}
    assert {(r.partition, r.events_processed, r.next_offset) for r in append.consumer_progress(log, 1).collect()} == {(0, 2, 3)}


def folder_bytes(path):
    return sum(os.path.getsize(os.path.join(d, f)) for d, _, names in os.walk(path) for f in names)


def test_rewritten_state_follows_the_batch(spark, tmp_path):
    """A large log, then batches of one producer: only its bucket is written again, and all state is still there."""
    path = str(tmp_path / "log")
    append.append_to_log(spark, attempts(spark, [(i % 4, f"p{i}", 5) for i in range(20_000)]), path, 0)
    whole = folder_bytes(f"{path}/batch_id=0/_state")
    for batch in (1, 2):
        rows = [(1, "p1", 5), (1, "p1", 5 + batch), (0, "p1", 9)]       # a retry, and two that are new or a producer of another partition
        assert append.append_to_log(spark, attempts(spark, rows), path, batch)
        assert folder_bytes(f"{path}/batch_id={batch}/_state") < whole / 20
        assert sum(n.startswith("bucket=") for n in os.listdir(f"{path}/batch_id={batch}/_state")) <= 2
    state = {(r.partition, r.producer_id): (r.last_seq, r.last_offset) for r in log_table.last_state(spark, path, 3).collect()}
    assert len(state) == 20_001 and state[1, "p1"] == (7, 5_001) and state[0, "p1"] == (9, 5_000) and state[2, "p2"] == (5, 0)
    row = audit.offset_audit(log_table.read_log(spark, path, STORED_LOG)).collect()
    assert all(r.contiguous for r in row) and sum(r.records for r in row) == 20_003


def test_a_batch_without_anything_new(spark, tmp_path):
    path = str(tmp_path / "log")
    first = attempts(spark, [(0, "p", 0), (0, "q", 1)])
    for batch, part in enumerate((first, first, first.limit(0), attempts(spark, [(0, "q", 2)]))):
        assert append.append_to_log(spark, part, path, batch)
    stored = log_table.read_log(spark, path, STORED_LOG).collect()
    assert sorted((r.offset, r.producer_id, r.seq) for r in stored) == [(0, "p", 0), (1, "q", 1), (2, "q", 2)]
    assert log_table.last_state(spark, path, 4).count() == 2


@pytest.mark.parametrize("limit", [0, 10**6])
def test_what_slices_hand_on_is_broadcast_or_joined(spark, monkeypatch, limit):
    monkeypatch.setattr(ordered, "MAX_CARRIED", limit)
    rng = random.Random(21)
    rows = [(rng.randrange(2), rng.choice(["hot"] * 9 + [f"p{i}" for i in range(40)]), rng.randrange(300)) for _ in range(900)]
    assert acks(attempts(spark, rows).repartition(6), False) == model(rows)
