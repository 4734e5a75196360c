import unicodedata

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from tessera.llm import lookalike
from tessera.llm.lookalike import confusables, consistent_forms, letters, lookalikes, parse, prototypes
from tests.conftest import rows

SCHEMA = "doc_id long, text string, look string, own string"
SAME = [
    ("SN-10329168", "ЅΝ\u2011１０３２９１６８"), ("caf\u00e9", "cafe\u0301"), ("a b", "a\u00a0b"), ("a b", "a\u3000b"), ("ab", "a\u200bb\ufeff"), ("no", "n\u00ado"), ("工一日", "\u2f2f\u2f00\u2f47"),
    ("scope", "\u0455\u0441\u043e\u0440\u0435"), ("\u00b5m", "\u03bcm"), ("\u30ac", "\uff76\uff9e"), ("XII", "\u216b"), ("\u212b", "\u00c5"), ("-", "\ufe63"), ("\u0451", "\u00eb"), ("\u1ec7", "e\u0323\u0302"), ("\u26a0", "\u26a0\ufe0f"),
]
DIFFERENT = [("a", "A"), ("1", "2"), ("1", "①"), ("m2", "m²"), ("a.", "a!"), ("e", "\u00e9"), ("и", "\u0439"), ("a b", "a  b"), ("c", "c\u0327"), ("l", "1"), ("O", "0"), ("I", "l"), ("a b", "ab"), ("½", "1/2"), ("ß", "ss"), ("–", "-")]


@pytest.fixture(scope="module")
def skeleton(spark):
    table = prototypes(confusables(spark))
    return lambda text: lookalike.skeleton(text, table)


@pytest.mark.parametrize(("a", "b"), SAME)
def test_look_the_same(skeleton, a, b):
    assert a != b and skeleton(a) == skeleton(b)


@pytest.mark.parametrize(("a", "b"), DIFFERENT)
def test_can_be_told_apart(skeleton, a, b):
    assert skeleton(a) != skeleton(b)


@given(st.text(max_size=40))
@settings(max_examples=500, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
def test_skeletons_are_stable_and_ignore_composition(skeleton, text):
    s = skeleton(text)
    assert skeleton(s) == s
    assert skeleton(unicodedata.normalize("NFC", text)) == skeleton(unicodedata.normalize("NFD", text)) == s


def test_every_letter_of_the_data_folds_or_has_its_reason(spark):
    drawn_like = confusables(spark)
    table, left = letters(drawn_like)
    of_ascii = {drawn_like.get(ord(c), c) for c in "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"}
    alike = {c for c, look in drawn_like.items() if c >= 0x80 and look in of_ascii and unicodedata.category(chr(c))[0] == "L"}
    assert len(drawn_like) > 6_000 and alike <= table.keys() | left.keys() and not table.keys() & left.keys()
    # Where one letter is drawn like an ASCII letter of its case, it folds unless its style or its parts can be seen.
    assert {left[c] for c in alike if c in left} <= {"its style can be seen", "is decomposed", "drawn like a letter of the other case", "can be told apart"}
    assert sum(c in table for c in alike) > 300
    for c, to in table.items():
        assert drawn_like[c] == drawn_like.get(ord(to), to) and to not in table
    assert not any(unicodedata.category(chr(c)) == "Nd" for c in table)


def test_other_data_are_refused():
    with pytest.raises(ValueError):
        parse(b"\0\4xxnothing of the kind, but long enough to be read")


@pytest.mark.parametrize(("a", "b"), [("ρ", "p"), ("σ", "o"), ("Ꭺ", "A"), ("Ⲟ", "O"), ("ꓮ", "A"), ("ꮯ", "c"), ("к", "κ"), ("ո", "n"), ("ニ", "二"), ("Ꮩ", "V"), ("ɡ", "g")])
def test_letters_of_many_blocks(skeleton, a, b):
    assert skeleton(a) == skeleton(b)


@pytest.mark.parametrize(("a", "b"), [("З", "3"), ("б", "6"), ("Ь", "b"), ("ı", "i"), ("٠", "."), ("০", "o"), ("ⁿ", "n"), ("æ", "ae"), ("×", "x")])
def test_other_kinds_stay(skeleton, a, b):
    assert skeleton(a) != skeleton(b)


def brute(data, skeleton):
    docs = [(i, t) for i, t, *_ in data if i is not None and t is not None and skeleton(t).strip()]
    return sorted(((min(i, j), max(i, j)) for n, (i, t) in enumerate(docs) for j, u in docs[n + 1 :] if i != j and t != u and skeleton(t) == skeleton(u)), key=repr)


@pytest.mark.parametrize("copies", [10, 10_000])
def test_pairs(spark, skeleton, copies):
    texts = [t for pair in SAME + DIFFERENT for t in pair] + ["", " ", "​", "　­", None, "long " * 50_000, "long " + "long " * 49_999]
    data = [(i, t, "clash", "clash") for i, t in enumerate(texts)] + [(None, "x", "", "")]
    data += [(200 + i, "copy of one text", "", "") for i in range(60)] + [(300, "copy of one teхt", "", ""), (301, "сopy of one text", "", ""), (301, "сopy of one text", "", "")]
    found = rows(lookalikes(spark.createDataFrame(data, SCHEMA).repartition(4), copies=copies))
    assert found == brute(data, skeleton)
    assert sum(a >= 200 for a, _ in found) == 60 + 60 * 2 + 2
    forms = dict(rows(consistent_forms(spark.createDataFrame(data[:-64], SCHEMA))))
    assert forms[texts.index(None)] is None and forms[1] == "SN-10329168"


def test_empty_table(spark):
    assert rows(lookalikes(spark.createDataFrame([], SCHEMA))) == rows(consistent_forms(spark.createDataFrame([], SCHEMA))) == []
