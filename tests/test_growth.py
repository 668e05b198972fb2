"""Steps that must not grow beyond their input: who travels in a join, what is shuffled, how long a step takes."""

import datetime

from pyspark.sql import functions as F

from marktrace.operators import joins as J


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_confusions_travel_not_the_characters(spark, tmp_path, monkeypatch):
    """A small file of long texts: the statistics do not see how many rows their characters make."""
    path = str(tmp_path / "texts")
    spark.range(2000).select("id", F.repeat(F.lit("B8X"), 100).alias("t")).write.parquet(path)
    confusions = spark.createDataFrame([("8", "B", 1), ("0", "D", 1)], "char string, alt string, rank int")
    chars = spark.read.parquet(path).select("id", F.posexplode(F.split("t", "")).alias("pos", "char"))
    found = J.expand_confusions(chars, confusions)
    assert "BuildRight" in plan_of(found) and "BuildLeft" not in plan_of(found)
    assert found.count() == 400_000
    # a table of very many rules is merged, with the same rows
    monkeypatch.setattr(J, "RULE_ROWS", 1)
    merged = J.expand_confusions(chars, confusions)
    assert "SortMergeJoin" in plan_of(merged) and "BroadcastHashJoin" not in plan_of(merged)
    assert merged.count() == 400_000


def session_reads(spark):
    from test_fusion import GOOD, reads_of

    schema = "session_id string, read_seq int, crop_index int, evidence_group int, variant_name string, ocr_conf double, raw_text string, crop_quality double, variant_weight double"
    texts = [(i % 3, ["raw", "sharp@2", None][i % 3], 0.5137 + i % 5 / 10, ["KDTA5C1230", "KDTA8C1230", "short"][i % 7 % 3]) for i in range(30)]
    rows = [r for s in range(40) for r in reads_of(f"s{s}", texts[s % 8 : s % 8 + s])] + reads_of(None, texts[:4]) + reads_of("none", [(1, "raw", 0.9, "x")])
    return spark.createDataFrame(rows, schema)


def fused_rows(spark, reads):
    from test_fusion import ALLOWED, CONF, PARAMS

    from marktrace.operators import fusion as U

    rules = spark.createDataFrame([("M1", p, ch) for p, cs in ALLOWED.items() for ch in cs], "model string, pos int, allowed_char string")
    return U.fuse_reads(reads, rules, spark.createDataFrame(CONF, "char string, alt string, rank int"), PARAMS)


def test_fusion_shuffles_reads_once(spark):
    """Reads, votes and choices were shuffled by session, position, character and model, and spilled."""
    plan = plan_of(fused_rows(spark, session_reads(spark)))
    assert plan.count("Exchange hashpartitioning(session_id") == 1
    assert "Expand" not in plan


def test_votes_shuffle_reads_once(spark):
    from marktrace.registry import load

    plan = plan_of(load()[0]["a18_position_votes"](spark, "/root/testdata/sf0.001"))
    assert plan.count("Exchange") == 1 and "Expand" not in plan


def test_large_sessions_equal_whole_ones(spark, sliced):
    """Some sessions as one row, some merged first: every field but the order of sums is the same, NULL sessions too."""
    from marktrace.operators import fusion as U

    reads = session_reads(spark)
    plain = lambda v: round(v, 9) if isinstance(v, float) else [plain(x) for x in v] if isinstance(v, list | tuple) else {k: plain(x) for k, x in v.items()} if isinstance(v, dict) else v
    rows = lambda: {r.session_id: plain(r.asDict(True)) for r in fused_rows(spark, reads).collect()}
    votes = lambda: sorted(map(str, (plain(r.asDict()) for r in U.session_votes(reads, ["session_id"], 10).collect())))
    whole, counted = rows(), votes()
    assert None in whole and whole["none"]["status"] == "NO_READ" and len(whole) == 41
    sliced(9)
    assert U.place_by_session(reads, ["session_id"])[1] is not None
    assert rows() == whole and votes() == counted


def test_tasks_follow_the_reads(spark, monkeypatch):
    from marktrace.operators import fusion as U

    monkeypatch.setattr(U, "TASK_READS", 20)
    reads = session_reads(spark)
    assert U.place_by_session(reads, ["session_id"])[0].rdd.getNumPartitions() == -(-reads.count() // 20)


def test_sidecars_are_written_by_many_tasks(spark, monkeypatch):
    """All folders were written by the one task that read the small table."""
    from marktrace.registry import load, storage

    tasks = []
    seen = storage.R.read_sidecars
    monkeypatch.setattr(storage, "TASK_FILES", 4)
    monkeypatch.setattr(storage.R, "read_sidecars", lambda s, path, *a: tasks.append(s.read.text(path).select(F.regexp_extract("_metadata.file_name", r"part-(\d+)", 1)).distinct().count()) or seen(s, path, *a))
    found = load()[0]["s4_sidecars"](spark, "/root/testdata/sf0.001").collect()
    wanted = spark.read.parquet("/root/testdata/sf0.001/supplier.parquet")
    assert {r.item for r in found} == {r.s_suppkey for r in wanted.collect() if r.s_suppkey % 10} and tasks[0] > 1


def test_evidence_is_dealt_to_all_tasks(spark, monkeypatch):
    """Evidence was dealt out by a column of three values: most of five tasks had nothing to do."""
    from marktrace.operators import aggregates as A
    from marktrace.registry import load

    seen, real = [], A.evidence_signature
    monkeypatch.setattr(A, "evidence_signature", lambda df, *a: seen.append(df) or real(df, *a))
    load()[0]["a28_evidence_items"](spark, "/root/testdata/sf0.001")
    assert "REPARTITION_BY_COL" in plan_of(seen[1]) and "hashpartitioning(o_orderstatus" not in plan_of(seen[1])


def test_positions_for_labelling_are_dealt_by_their_number(spark, monkeypatch):
    from marktrace.registry import load

    monkeypatch.setattr(J, "TASK_ROWS", 100)
    plan = plan_of(load()[0]["h10_active_learning"](spark, "/root/testdata/sf0.001"))
    wanted = spark.read.parquet("/root/testdata/sf0.001/part.parquet").agg(F.sum(F.length("p_name"))).first()[0]
    assert "hashpartitioning(session_id" in plan and f", {-(-wanted // 100)})" in plan


def test_a_model_gets_large_batches_in_pieces(spark, monkeypatch):
    from marktrace.plans import images

    monkeypatch.setattr(images, "PIECE_BYTES", 10_000)
    df = spark.createDataFrame([(i, "x" * 500) for i in range(300)], "id long, t string").coalesce(1)
    got = images.score_batch(df, ["t"], lambda b: b.assign(n=len(b))[["n"]], "n long").collect()
    assert sorted(r.id for r in got) == list(range(300)) and all(r.n <= 20 and r.error is None for r in got)


def test_slices_of_a_stream_have_files_by_their_rows(spark, monkeypatch, tmp_path):
    from marktrace.registry import streams

    at = datetime.datetime(2024, 1, 1)
    rows = [(i, at + datetime.timedelta(minutes=i), i % 50, "click", 1.0, None) for i in range(900)]
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string").write.parquet(f"{tmp_path}/events.parquet")
    monkeypatch.setattr(streams, "FILE_ROWS", 30)
    seen = []
    streams.drain_batches(streams.arriving(spark, str(tmp_path)).select("event_id", F.input_file_name().alias("f")), "growth", lambda b, _: seen.append((len({r.f for r in b.collect()}), sorted(r.event_id for r in b.collect()))))
    assert [(n, ids) for n, ids in seen if ids] == [(10, list(range(k, k + 300))) for k in (0, 300, 600)]


def test_reranked_reads_are_dealt_by_ids_alone(spark, monkeypatch):
    """Texts and confidences went through the shuffle and a sort, as an aggregate cannot hold them by hash."""
    from marktrace.registry import load

    monkeypatch.setattr(J, "TASK_ROWS", 500)
    plan = plan_of(load()[0]["h2_rerank_reads"](spark, "/root/testdata/sf0.001"))
    n = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet").count()
    assert "SortAggregate" not in plan and "SortMergeJoin" not in plan and f", {-(-n // 500)})" in plan


def test_reranking_by_table_equals_position_by_position(spark):
    """Several neighbours, forced places, missing confidences, characters without an entry, other lengths and models."""
    import random

    from marktrace.operators import fusion as U

    rng = random.Random(5)
    p = U.FusionParams(length=4, constants={2: "A"})
    allowed = {1: "0158", 2: "A", 3: "BDE", 4: "BDE0158"}
    near = {"8": ["B", "E"], "0": ["D", "8", "Q"], "B": ["8"], "5": ["X", "E"]}
    rules = spark.createDataFrame([("M", i, ch) for i, cs in allowed.items() for ch in cs], "model string, pos int, allowed_char string")
    confusions = spark.createDataFrame([(ch, a, i) for ch, alts in near.items() for i, a in enumerate(alts, 1)], "char string, alt string, rank int")
    rows = [(n, "".join(rng.choice("0158ABDEXÄ") for _ in range(rng.choice([3, 4, 4, 4, 4]))), rng.choice(["M", "M", "M", "N", None]), [rng.choice([0.0, 0.25, 0.9, 1.5, 3.0, None]) for _ in range(rng.choice([2, 4, 4]))]) for n in range(600)]
    got = {r.id: r for r in U.rerank_reads(spark.createDataFrame(rows, "id long, text string, model string, confs array<double>"), rules, confusions, p, ["id"]).collect()}
    assert len(got) == 600
    for n, text, model, confs in rows:
        r = got[n]
        if model != "M" or len(text) != 4:
            assert (r.final_text, r.compliance, r.structure_corrected) == (text, 0.0, False)
            continue
        final, moved, seen = "", False, []
        for i, ch in enumerate(text, 1):
            v = confs[i - 1] if i <= len(confs) else None
            cands = [(v, 0, ch)] + [(None if v is None else v * 0.6, -k, a) for k, a in enumerate(near.get(ch, []), 1)]
            score = lambda x: (float("-inf") if x[0] is None else x[0] + (0.5 if x[2] in allowed[i] else -0.5), x[1])
            top = max(cands, key=score)
            out = p.constants.get(i, top[2])
            moved |= out != ch and (i in p.constants or (out in allowed[i] and ch not in allowed[i]))
            final, seen = final + out, [*seen, top[0]]
        comp = sum(ch in allowed[i] for i, ch in enumerate(final, 1)) / 4
        assert (r.final_text, r.compliance, r.structure_corrected) == (final, comp, moved), (text, confs)
        assert r.score is None if None in seen else abs(r.score - (0.5 * sum(seen) / 4 + 0.5 * comp)) < 1e-12


def test_audited_positions_are_dealt_and_judged_once(spark, monkeypatch):
    """A small file of many positions was one task, and every list of reasons was made twice, mostly to be found empty."""
    import random

    from marktrace.operators import disagreement as G

    rng = random.Random(8)
    monkeypatch.setattr(G, "TASK_ROWS", 300)
    text = lambda: rng.choice([None, "", *["".join(rng.choice("BEEIL1") for _ in range(rng.randint(1, 6))) for _ in range(8)]])
    rows = [(n, *(text() for _ in range(5))) for n in range(400)]
    pairs = [("E", "B"), ("I", "L"), ("I", "L"), ("1", "I")]
    df = spark.createDataFrame(rows, "id long, a string, b string, c string, raw string, fin string")
    out = G.disagreement_audit(df, ["id"], ["a", "b", "c"], "raw", "fin", pairs, weak="1")
    want, positions = {}, 0
    for n, *texts in rows:
        longest = max(len(t or "") for t in texts)
        positions += longest
        for i in range(longest):
            *engines, r, f = [(t or "")[i : i + 1] or None for t in texts]
            seen, found = sorted({e for e in engines if e}), set()
            near = lambda x, y: any({x, y} == set(p) for p in pairs)
            if r and f and r != f:
                found |= {"RAW_FINAL_DISAGREEMENT"} | ({f"CONFUSABLE_{r}_{f}"} if near(r, f) else set())
            if len(seen) > 1:
                found |= {"ENGINE_DISAGREEMENT"} | {f"CONFUSABLE_{x}_{y}" for x in seen for y in seen if x < y and near(x, y)}
            if f and seen and f not in seen:
                found.add("VALIDATOR_CHANGED_CHARACTER")
            if found:
                want[n, i] = (sorted(found), "1" in (r, f))
    assert {(r.id, r.position): (r.reasons, r.weak) for r in out.collect()} == want
    assert f", {-(-positions // 300)})" in plan_of(out)
