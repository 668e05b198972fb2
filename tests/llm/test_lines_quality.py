import hashlib
import random
import zlib

import numpy as np
import pytest

from marktrace.llm import quality
from marktrace.llm.lines import dedup_lines
from marktrace.llm.quality import best_cut, choose_quantile, features, fit, fit_pairs, quality_scores, shrunk

BLANK = " \t\n\x0b\f\r"
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute_lines(rows, chars=40, most=5):
    keys = [[x.strip(BLANK).translate(FOLD) for x in (t or "").split("\n")] for _, t in rows]
    held = {}
    for at, ks in enumerate(keys):
        for k in {k for k in ks if len(k) >= chars}:
            held.setdefault(k, []).append(rows[at][0])
    lost = {k: max((i for i in ids if i is not None), default=None) for k, ids in held.items() if len(ids) >= most}
    out = []
    for (i, t), ks in zip(rows, keys, strict=True):
        kept = [x for x, k in zip((t or "").split("\n"), ks, strict=True) if k not in lost or lost[k] == i]
        out.append((i, len(ks), len(ks) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out, key=str)


def run_lines(df):
    return sorted(((r.doc_id, r.n_lines, r.n_dropped, hashlib.sha256(r.text.encode()).hexdigest()) for r in dedup_lines(df).collect()), key=str)


def test_lines_against_brute_force(frame):
    random.seed(4)
    common = ["L" * 40, "m" * 39, "é" * 40, " \x0b" + "Q" * 41 + "\t", "q" * 41, " " + "z" * 40]
    rows = [(i, "\n".join(random.choice([*common, "own %d" % i, ""]) for _ in range(random.randrange(6)))) for i in range(40)]
    rows += [(None, "L" * 40), (39, "L" * 40), (39, "L" * 40), (7, None), (8, "q" * 41 + "\n" + "q" * 41)]
    assert run_lines(frame(rows)) == brute_lines(rows)


def test_lines_keep_columns_and_empty_tables(frame):
    df = frame(["a"])
    assert dedup_lines(df).drop("n_lines", "n_dropped").columns == df.drop("n_lines").columns
    assert dedup_lines(frame([])).collect() == []


def test_many_lines_and_clashing_columns(spark):
    """Copies of one text of 30,000 lines: work grows with the lines, not with their square."""
    body = [f"line number {i} of a text that is found in many places" for i in range(30_000)]
    rows = [(i, "\n".join([*body, f"own {i}"])) for i in range(5)] + [(9, "\n".join([*body[:3], body[0], "short"]))]
    df = spark.createDataFrame([(*r, "a", "b", "c", "d", 1, 2) for r in rows], "doc_id long, text string, _gone string, _text string, _lines string, _kept string, pos long, row long").repartition(3)
    out = {r.doc_id: r for r in dedup_lines(df).collect()}
    # document 9 keeps the three lines it has, document 4 the others
    assert [out[i].n_dropped for i in range(5)] == [30_000] * 4 + [3] and out[9].n_dropped == 0
    assert out[0].text == "own 0" and out[4].text == "\n".join([*body[3:], "own 4"]) and out[4].n_lines == 30_001
    assert all(tuple(r)[2:8] == ("a", "b", "c", "d", 1, 2) for r in out.values())


def labelled(spark, n=400, seed=2):
    rng = random.Random(seed)
    words = ["the", "of", "and", "reading", "house", "water", "green", "small"]
    docs, labels = [], []
    for i in range(n):
        bad = i % 4 == 0
        docs.append((i, " ".join(rng.choice(words) + ("$$$" if bad and rng.random() < 0.7 else "") for _ in range(rng.randrange(20, 60))), "en", "s", 0))
        labels.append((i, 0 if bad else 1, 0))
    docs += [(n, None, "en", "s", 0), (n + 1, "", "en", "s", 0), (None, "the house of water", "en", "s", 0), (1, "the small house", "en", "s", 0)]
    labels += [(None, 1, 0), (10**9, 0, 0), (3, None, 0), (5, 7, 0)]
    return spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, score long"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_quality_on_held_out_rows(spark):
    docs, labels = labelled(spark)
    got = quality_scores(docs.repartition(4), labels).collect()
    assert len(got) == 404 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)
    held = [r for r in got if r.held_out and r.doc_id < 400]
    assert len(held) > 40 and np.mean([r.predicted == int(r.doc_id % 4 != 0) for r in held]) > 0.97
    assert not any(r.held_out for r in got if r.doc_id is None)


def test_labels_of_held_out_rows_and_other_columns_do_not_matter(spark):
    import zlib

    docs, labels = labelled(spark)
    other = spark.createDataFrame([(r.doc_id, 1 - r.quality if r.doc_id is not None and r.quality in (0, 1) and zlib.crc32(str(r.doc_id).encode()) % 5 == 0 else r.quality, 1) for r in labels.collect()], labels.schema)
    swapped = docs.selectExpr("doc_id", "text", "'zz' AS lang", "'zz' AS source", "9L AS score")
    key = lambda r: (str(r.doc_id), str(r.text))
    a, b = (sorted(((key(r), r.score) for r in quality_scores(d, x).collect())) for d, x in ((docs, labels), (swapped, other)))
    assert a == b


def test_quality_without_labels_or_documents(spark):
    docs, labels = labelled(spark)
    assert {r.score for r in quality_scores(docs, labels.where("quality = 1")).collect()} == {0.5}
    assert quality_scores(docs.limit(0), labels).collect() == []
    assert quality_scores(docs, labels.limit(0)).count() == 404


def test_pairs_and_quantile():
    rng = np.random.default_rng(0)
    good, bad = rng.normal(1, 0.3, (200, 3)), rng.normal(-1, 0.3, (50, 3))
    w = fit_pairs(good, bad)
    assert (good @ w).min() > (bad @ w).max()
    threshold, quantile = choose_quantile(good @ w, bad @ w, 0.2, 0.98)
    assert (bad @ w).max() < threshold < (good @ w).min() and abs(quantile - 0.2) < 1e-9


def test_repeated_rows_and_labels_do_not_fill_the_sample(spark, frame):
    texts = [f"plain words number {i} of a text" if i % 2 else f"{i}$$ ## {i}" for i in range(60)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, quality int")
    ids = [i for i in range(60) if zlib.crc32(str(i).encode()) % 5][:4]
    more = spark.createDataFrame([(i, i % 2) for i in ids for _ in range(40)], "doc_id long, quality int")
    for rows in (6, 60):
        once = fit(frame(texts), labels, rows)
        again = fit(frame([*enumerate(texts)] + [(i, texts[i]) for i in ids for _ in range(40)]), labels.union(more), rows)
        assert all(np.array_equal(a, b) for a, b in zip(vars(once).values(), vars(again).values(), strict=True))


def test_every_labelled_row_counts(spark):
    """90 rows a class in parts of 8: each row's own text moves the weights, and the cut is that of all scores."""
    ids = [i for i in range(300) if zlib.crc32(str(i).encode()) % 5][:180]
    texts = {i: f"plain words number {i} of a text" if i % 2 else f"{i}$$ ## {i}" for i in ids}
    labels = spark.createDataFrame([(i, i % 2) for i in ids], "doc_id long, quality int")
    model = lambda t: fit(spark.createDataFrame(list(t.items()), "doc_id long, text string").repartition(3), labels, 8)
    base = model(texts)
    assert all(not np.array_equal(base.weights, model(texts | {i: "QQQQ"}).weights) for i in (ids[0], ids[-1]))
    size = {i: len(t) for i, t in texts.items()}
    raw = {i: shrunk(features(t).astype(np.float64) @ base.weights, np.array(size[i]), base.average) for i, t in texts.items()}
    good, bad = (np.array([raw[i] for i in ids if i % 2 == q]) for q in (1, 0))
    assert base.threshold == pytest.approx(choose_quantile(good, bad, len(bad) / 180, 0.98)[0])
    assert base.scale == pytest.approx(np.std([*raw.values()]) / 4)


def test_few_rows_of_a_class_reach_every_part(spark):
    ids = [i for i in range(600) if zlib.crc32(str(i).encode()) % 5][:400]
    docs = spark.createDataFrame([(i, f"$$ ## {i}" if i in ids[:3] else f"plain words number {i}") for i in ids], "doc_id long, text string")
    m = fit(docs, spark.createDataFrame([(i, int(i not in ids[:3])) for i in ids], "doc_id long, quality int"), 10)
    assert m.weights.any() and abs(m.quantile - 3 / 400) < 1e-9


def test_cut_against_plain_form(spark, monkeypatch):
    monkeypatch.setattr(quality, "CUT_ROWS", 60)
    rng = np.random.default_rng(4)
    good, bad = rng.normal(0.5, 1, 500), rng.normal(-0.5, 1, 200)
    points = spark.createDataFrame([(float(s), 1) for s in good] + [(float(s), 0) for s in bad], "s double, quality int")
    for keep in (0.98, 0.5, 0.0):
        assert best_cut(points, 500, 200, 0.3, keep) == pytest.approx(choose_quantile(good, bad, 0.3, keep))
    assert best_cut(points.where("quality = 1 OR s > 9").union(points.selectExpr("99D", "0").limit(1)), 500, 1, 0.3, 0.98)[1] == 0.0
