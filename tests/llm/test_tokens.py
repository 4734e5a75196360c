import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.llm import tokens
from tessera.llm.lexicon import Builder, Lexicon
from tessera.llm.tokens import TOKENIZERS, VOCABULARY, compile_lexicon, cutter, encode, merge, merger, read_ranks, said, splitter
from tests.conftest import rows

RANKS = read_ranks(f"{TOKENIZERS}/{VOCABULARY}")
SCHEMA = "doc_id long, text string, ids string, out int"


def reference(texts):
    tokenizers = pytest.importorskip("tokenizers")
    t = tokenizers.Tokenizer.from_file(f"{TOKENIZERS}/byte_bpe_50k.json")
    t.encode_special_tokens = True
    return [e.ids for e in t.encode_batch(texts, add_special_tokens=False)]


TEXTS = [
    "", " ", "\n\n  \t x", "The valve's stuck; we'll see, it'd be 12,345.67 €", "  two  spaces   three\r\n", "用于现场登记。设备 SN-10329168", "Überprüfung é é​ﬁ", "<|endoftext|> is text",
    "👷🏽‍♀️🔧" * 50, "a" * 30_000, "щ" * 9_000, "x y\n" * 20_000, "　全角　空格", "'s 't 're S'S", "\x00\x01﻿",
]


def test_equals_the_public_tokenizer(spark):
    data = [(i, t, "clash", 1) for i, t in enumerate(TEXTS)] + [(90, None, None, None), (3, TEXTS[3], "again", 2)]
    found = {i: list(ids) for i, ids in encode(spark.createDataFrame(data, SCHEMA).repartition(3), ["doc_id"], "text").collect()}
    assert found.pop(90) == []
    assert found == dict(enumerate(reference(TEXTS)))


def test_every_row_has_one_result(spark):
    df = spark.createDataFrame([(1, "a b", "", 0), (1, "a b", "", 0), (None, None, "", 0)], SCHEMA)
    assert rows(encode(df, ["doc_id"], "text", only_counts=True)) == [(1, 2), (1, 2), (None, 0)]
    assert rows(encode(df.limit(0), ["doc_id"], "text")) == []


@pytest.mark.parametrize("most", [0, 3, 1_000])
def test_lexicon_size_changes_nothing(spark, monkeypatch, most):
    monkeypatch.setattr(tokens.frequent_words, "__defaults__", (most,))
    monkeypatch.setattr(tokens, "CHARACTERS", 40)
    texts = TEXTS[:8] * 3
    found = encode(spark.createDataFrame([(i, t, "", 0) for i, t in enumerate(texts)], SCHEMA), ["doc_id"], "text").orderBy("doc_id").collect()
    assert [list(r[1]) for r in found] == reference(texts)


@given(st.text(st.sampled_from("abcdefgh tionеrsé用ab\n"), max_size=60))
@settings(max_examples=300, deadline=None)
def test_own_merge_equals_the_compiled_one(word):
    for w in splitter()(word):
        assert merge(w.encode(), RANKS) == merger(RANKS)(w)


@given(st.text(st.sampled_from("ab 's\n\t\u00a0\u3000\x1c\u200b12!用 "), max_size=40) | st.text(max_size=30))
@settings(max_examples=1_500, deadline=None)
def test_pieces_have_the_words_of_the_text(text):
    split, pieces = splitter(), cutter()(text)
    assert "".join(map(said, pieces)) == text
    assert [w for p in pieces for w in split(said(p))] == split(text)


@given(st.sets(st.binary(min_size=1, max_size=6), max_size=60), st.lists(st.binary(max_size=6), max_size=30))
@settings(max_examples=300, deadline=None)
def test_lexicon_holds_exactly_its_words(words, others):
    built = Builder()
    for n, w in enumerate(sorted(words)):
        built.add(w, [n, len(w)] if n % 3 else [])
    held = Lexicon(built.buffer())
    for n, w in enumerate(sorted(words)):
        assert held.number(w) == n and held.find(w) == ([n, len(w)] if n % 3 else [])
    assert all(held.find(w) is None for w in others if w not in words)


def test_lexicon_is_minimal_and_mapped(tmp_path):
    words = sorted(a + b + c for a in "pqrs" for b in "xyz" for c in ("ing", "ed", "s"))
    built = Builder()
    for w in words:
        built.add(w.encode(), [1])
    (tmp_path / "l").write_bytes(built.buffer())
    # All stems share their endings: one state after each stem letter pair, and those of the endings.
    assert len(built.states) == 6
    assert Lexicon.map(str(tmp_path / "l")).find(b"rzing") == [1]
    with pytest.raises(ValueError):
        built.add(b"a", [1])


def test_round_trip():
    back = {i: t for t, i in RANKS.items()}
    rng, words = random.Random(0), [w for t in TEXTS for w in splitter()(t)]
    held = Lexicon(compile_lexicon(rng.sample(words, min(len(words), 3_000)), merger(RANKS)))
    for t in TEXTS:
        ids = [i for w in splitter()(t) for i in (held.find(w.encode()) or merge(w.encode(), RANKS))]
        assert b"".join(back[i] for i in ids).decode() == t
