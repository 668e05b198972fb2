"""Cases that a table-size switch, a float detour or a replay used to change."""

from pyspark.sql import functions as F

from marktrace.functions import text as X
from marktrace.operators import windows as W
from marktrace.operators.ordered import order_rows
from marktrace.plans.images import score_batch
from marktrace.sources import sinks as K

BIG = 2**60


def test_folds_keep_large_integers_beside_nulls(spark):
    rows = [(BIG + k if k else None, t, BIG + t % 2 if t % 3 else None, BIG + 1 if t % 4 else None) for k in range(3) for t in range(12)]
    df = spark.createDataFrame(rows, "station long, ts_ms long, value long, payload long").repartition(5)
    got = W.repeat_suppression(order_rows(df, ["station"], ["ts_ms"]), "value", "payload", 10**9).collect()
    assert sorted(((r.station, r.ts_ms, r.value, r.payload) for r in got), key=str) == sorted(rows, key=str)


def test_neighbouring_large_keys_stay_apart(spark):
    df = spark.createDataFrame([(BIG + k, t, "s", 0.5, None, False) for k in range(4) for t in range(3)], "k long, ts_ms long, signature string, quality double, remaining_sec double, exited boolean").coalesce(1)
    got = W.retry_admission(order_rows(df, ["k"], ["ts_ms"])).where("reason = 'RETRY_ALLOWED'")
    assert sorted(r.k for r in got.collect()) == [BIG + k for k in range(4)]


def test_null_signature_is_admitted_once(spark):
    rows = [(1, t, None, q, None, False) for t, q in enumerate([0.5, 0.5, None, 0.6])]
    df = spark.createDataFrame(rows, "k long, ts_ms long, signature string, quality double, remaining_sec double, exited boolean")
    got = W.retry_admission(order_rows(df, ["k"], ["ts_ms"])).orderBy("ts_ms").collect()
    assert [r.reason for r in got] == ["RETRY_ALLOWED", "STABLE_AMBIGUITY", "STABLE_AMBIGUITY", "IMPROVED_QUALITY"]


def test_review_rank_is_the_same_when_sliced(spark, sliced):
    rows = [(i, "SBX"[i % 3], [None, float("nan"), 99.0, 0.5, -3.0, 1e9][i % 6] if i % 2 else float(i)) for i in range(60)]
    df = spark.createDataFrame(rows, "id long, ch string, conf double")
    rank = lambda: {r.id: r.position for r in W.review_rank(df, F.col("ch"), ["S", "B"], "conf", "id").collect()}
    whole = rank()
    sliced(10)
    assert rank() == whole


def test_upsert_does_not_go_back(spark):
    schema = "k long, status string, terminal boolean, seq long"
    target = spark.createDataFrame([(1, "SUCCESS", True, 10), (2, "PENDING", False, 1)], schema)
    batch = spark.createDataFrame([(1, "PENDING", False, 5), (2, "SUCCESS", True, 3), (3, "PENDING", False, 1)], schema)
    once = K.upsert(target, batch, "k", ["terminal", "seq"])
    twice = K.upsert(once, batch, "k", ["terminal", "seq"])
    assert sorted(map(tuple, once.collect())) == sorted(map(tuple, twice.collect())) == [(1, "SUCCESS", True, 10), (2, "SUCCESS", True, 3), (3, "PENDING", False, 1)]


def test_redaction(spark):
    cases = {
        'token = "a b" end': "token = *** end",
        "Password:'x y',z": "Password:***,z",
        "api-key=1;b": "api-key=***;b",
        "mytoken=1": "mytoken=1",
        "Authorization: Bearer abc.def, rest": "Authorization: Bearer ***, rest",
        "cookie: a=1; b=2\nnext": "cookie:***\nnext",
        "login now user pw tail": "login now user *** tail",
        "id 24be64 x24be64 a+b a+bc": "id *** x24be64 *** a+bc",
    }
    df = spark.createDataFrame([(k,) for k in cases], "t string")
    rules = X.secret_rules(commands=["login now"])
    got = {r.t: r.m for r in df.select("t", X.redact(F.col("t"), ["24be64", "a+b"], rules).alias("m")).collect()}
    assert got == cases


def test_scoring_keeps_ids(spark):
    df = spark.createDataFrame([(BIG + 1, "a"), (None, "bb"), (BIG, None)], "id long, t string").coalesce(1)
    got = score_batch(df, ["t"], lambda b: b.assign(n=b["t"].str.len())[["n"]], "n long").collect()
    assert {(r.id, r.n, r.error) for r in got} == {(BIG + 1, 1, None), (None, 2, None), (BIG, None, None)}
    broken = score_batch(df, ["t"], lambda b: 1 / 0, "n long").collect()
    assert {r.id for r in broken} == {BIG + 1, None, BIG} and all("ZeroDivision" in r.error for r in broken)
