import zlib
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from marktrace.llm.packing import best_fit, pack_best_fit, pack_documents
from marktrace.llm.tokens import TokenCounter, TokenIds, token_counts, vocabulary

tokenizers = pytest.importorskip("tokenizers")
BYTES, WORDS = (tokenizers.Tokenizer.from_file(vocabulary(n)) for n in ("byte_bpe_50k.json", "word_bpe_49k.json"))
COUNTER, IDS = TokenCounter(vocabulary("byte_bpe_50k.json")), TokenIds(vocabulary("word_bpe_49k.json"))
ODD = [None, "", " ", "\n", "a  b", "a   b\n\n x \n y\t\tz", "<|endoftext|>hi<|endoftext|> <|ENDOFTEXT|>", " lead", "trail ", "it's 'S we'll x y", "\x1c\x1d a\x85b \x00 c", "日本語 テキスト é é ́ . é. x", "12 345. 6,", "hi., there!. ok_. z", "x" * 5000, "ab. " * 3000, "İstanbul. ΣΑΣ. ﬁ", "same text", "same text"]
PIECES = st.lists(st.sampled_from(["a", "B", "é", "é", "1", " ", "  ", "\n", ".", ",", "_", "!", "'s", "<|endoftext|>", "\t", "ß", "Σ", "x" * 9, "\x00"]), max_size=25).map("".join)


@settings(max_examples=300, deadline=None)
@given(PIECES)
def test_counts_and_ids_equal_the_library(text):
    assert COUNTER.count([text]) == [len(BYTES.encode(text, add_special_tokens=False).ids)]
    assert IDS.ids([text])[0].tolist() == WORDS.encode(text, add_special_tokens=False).ids


def test_pieces_met_again_are_learned_once(monkeypatch):
    """When too many pieces are remembered, rare ones go; the ids stay those of the library."""
    monkeypatch.setattr("marktrace.llm.tokens.CACHE_PIECES", 200)
    some, learned = TokenIds(vocabulary("word_bpe_49k.json")), []
    learn = some.learn
    monkeypatch.setattr(some, "learn", lambda: (learned.extend(some.number.new), learn()))
    for k in range(60):
        texts = [f"The river, of. stones w{k}x{j} {'é' * (k + 1)}{'ab' * j}!" for j in range(20)]
        assert [x.tolist() for x in some.ids(texts)] == [WORDS.encode(t, add_special_tokens=False).ids for t in texts]
    assert learned.count("river") == learned.count(".") == 1 and len(some.number) < 300


def test_letters_whose_composed_or_lowered_form_ends_with_a_mark():
    texts = ["Aİ. b", "aİ, b", "I\u0307. b", "\u0958, x", "a\u09dc. y", "\u0958. <|endoftext|>. B"]
    assert [x.tolist() for x in IDS.ids(texts)] == [WORDS.encode(t, add_special_tokens=False).ids for t in texts]


def test_words_of_all_latin_characters():
    chars = [chr(c) for c in range(256) if chr(c) not in " \n"]
    texts = [f"{a}{b} {b}a, x{a}{a}. {b}'s{a} 1{a}2" for a in chars for b in ("e", "É", "!", a)]
    fresh = TokenIds(vocabulary("word_bpe_49k.json"))
    assert fresh.agree
    assert [x.tolist() for x in fresh.ids(texts)] == [WORDS.encode(t, add_special_tokens=False).ids for t in texts]


def test_token_counts(frame):
    rows = [*enumerate(ODD), (None, "no id"), (3, "again")]
    got = sorted(token_counts(frame(rows)).collect(), key=str)
    want = []
    for i, t in rows:
        n = len(BYTES.encode(t or "", add_special_tokens=False).ids)
        want.append((i, len((t or "").encode()), n, n > 1024))
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


def test_empty_tables(frame):
    assert token_counts(frame([])).collect() == [] and pack_documents(frame([])).collect() == []


def test_pieces_and_places(frame):
    rows = [*enumerate(ODD), (None, "no id"), (0, "again"), (50, "long words " * 4000)]
    got = pack_documents(frame(rows), capacity=64).collect()
    want = []
    for i, t in rows:
        ids = [*WORDS.encode(t or "", add_special_tokens=False).ids, 0]
        for k in range(0, len(ids), 64):
            want.append((i, k // 64, k, len(ids[k : k + 64]), zlib.crc32(np.array(ids[k : k + 64], dtype="<u4"))))
    assert sorted((tuple(r)[:5] for r in got), key=str) == sorted(want, key=str)
    bins = defaultdict(list)
    for r in got:
        bins[r.sequence_id].append((r.offset, r.length))
    for places in bins.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 64
    assert len(bins) <= 1.02 * sum(w[3] for w in want) / 64 + 2


def test_rounds_merge_what_tasks_leave(spark):
    rng = np.random.default_rng(5)
    sizes = rng.integers(1, 60, 3000).tolist()
    items = spark.createDataFrame([(i, s) for i, s in enumerate(sizes)], "offset long, length long").repartition(40)
    got = pack_best_fit(items.withColumnRenamed("offset", "item"), 100, task_items=100).collect()
    assert sorted(r.item for r in got) == list(range(3000))
    assert len({r.sequence_id for r in got}) <= 1.03 * sum(sizes) / 100


def test_best_fit_takes_the_fullest_bin():
    assert best_fit(np.array([6, 5, 4, 3, 2]), 10).tolist() == [0, 1, 0, 1, 1]
