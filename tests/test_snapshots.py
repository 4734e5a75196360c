import json
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.functions.yamltext import Unreadable, canonical, load
from tessera.operators.snapshots import WARN, model_changes, neighbours, read_model, snapshot_changes
from tests.conftest import rows

yaml = pytest.importorskip("yaml")  # writes texts to read; the library has no use for it



def brute(snapshots):
    """``snapshots``: {scope: {number: {record: content}}}."""
    found = []
    for scope, by_number in snapshots.items():
        numbers = sorted(by_number)
        for before, now in zip(numbers, numbers[1:]):
            old, new = by_number[before], by_number[now]
            for r in sorted(old.keys() | new.keys()):
                change = "added" if r not in old else "removed" if r not in new else "changed" if old[r] != new[r] else None
                if change:
                    found.append((scope, now, r, change))
    return sorted(found, key=repr)


def test_random_snapshots(spark):
    rng = random.Random(1)
    snapshots = {s: {n: {f"r{i}": bytes([rng.randrange(3)]) for i in range(8) if rng.random() < 0.7} for n in rng.sample(range(5_000), 12)} for s in range(6)}
    snapshots[3][6_000] = {}  # a snapshot without records
    data = [(s, n, None, None, "x") for s, by in snapshots.items() for n in by] + [(s, n, r, c, "x") for s, by in snapshots.items() for n, rs in by.items() for r, c in rs.items()]
    data += data[::7] + [(None, 1, "r", b"x", "x"), (1, None, "r", b"x", "x")]  # repeated deliveries; no snapshots
    df = spark.createDataFrame(data, "scope int, number int, record string, content binary, at string")
    assert rows(snapshot_changes(df, ["scope"], "number", "record", "content")) == brute(snapshots)
    assert rows(snapshot_changes(df.limit(0), ["scope"], "number", "record", "content")) == []


def test_neighbours_across_blocks(spark):
    df = spark.createDataFrame([("a", n) for n in (1, 2, 2, 5_000, 9_000, 9_001)] + [("b", 7)], "s string, n int")
    assert rows(neighbours(df, ["s"], "n")) == [("a", 1, None, 2), ("a", 2, 1, 5_000), ("a", 5_000, 2, 9_000), ("a", 9_000, 5_000, 9_001), ("a", 9_001, 9_000, None), ("b", 7, None, None)]


MODEL = {"object_types": {"pump": {"kind": "thing", "values": ["1", "off", 2, 2.5, True, None], "note": "a: b # c"}, "belt": {}}, "link_types": {"drives": {"from": "pump", "to": "belt"}}}


@pytest.mark.parametrize("style", [{}, {"default_flow_style": True}, {"default_flow_style": False, "indent": 4}, {"default_style": '"'}, {"sort_keys": True, "width": 20, "allow_unicode": True}])
@pytest.mark.parametrize("ends", ["\n", "\r\n"])
def test_layouts_of_one_model_agree(style, ends):
    text = "# by hand\n---\n" + yaml.safe_dump(MODEL, **style) + "\n# end\n"
    assert canonical(load(text.replace("\n", ends))) == canonical(MODEL)


LEAVES = st.none() | st.booleans() | st.integers(-1000, 1000) | st.text("ab: #'\"\\\n-[]{},é中!&*?|>%@`~0.", max_size=12)
VALUES = st.recursive(LEAVES, lambda x: st.lists(x, max_size=3) | st.dictionaries(st.text("abc_ -:", min_size=1, max_size=6), x, max_size=3), max_leaves=12)


@given(VALUES, st.sampled_from([None, True, False]))
@settings(max_examples=400, deadline=None)
def test_reads_what_a_writer_writes(value, flow):
    text = yaml.safe_dump(value, default_flow_style=flow, allow_unicode=True)
    assert canonical(load(text)) == canonical(value)


def test_reader_by_hand():
    assert load("a: |\n  x\n   y\n\nb: >-\n  p\n  q\n\n  r\nc:\n- 1\n- - 2\n  - k: v\n    l: w\n") == {"a": "x\n y\n", "b": "p q\nr", "c": [1, [2, {"k": "v", "l": "w"}]]}
    assert load("x: http://a.b:80/c#d\ny: 'it''s' # no\nz: two\n  lines\nw: {a: [1, b c], 'd': }") == {"x": "http://a.b:80/c#d", "y": "it's", "z": "two lines", "w": {"a": [1, "b c"], "d": None}}
    assert load("") is None and load("# only\n") is None
    for bad in ("a: [1", "a: b: c", "\ta: 1", "a: 'x", "a:\n  b: 1\n c: 2"):
        with pytest.raises(Unreadable):
            load(bad)


@pytest.mark.parametrize("plain", ["yes", "no", "off", "010", "0o10", "1_000", "2024-01-01", "12:30", "~", "1.0", "0x1F", "two words"])
def test_an_anchor_changes_no_value(plain):
    """One dialect: the same word means the same with an anchor, a tag of its own or as an explicit key's value."""
    want = canonical({"a": load(f"a: {plain}")["a"], "b": 1})
    for text in (f"a: &x {plain}\nb: 1", f"b: 1\na: &x\n  {plain}", f"? a\n: {plain}\nb: 1", f"{{a: &x {plain}, b: 1}}", f"--- &m\na: {plain}\nb: &n 1\n", f"&k a: {plain}\nb: 1"):
        assert canonical(load(text)) == want
    assert load(f"a: !!str {plain}") == {"a": plain}


def test_words_of_the_core_schema():
    assert load("[yes, no, on, 010, 0o10, 0x1F, 1_000, 2024-01-01, 1e3, .inf, True, ~, 12:30]") == ["yes", "no", "on", 10, 8, 31, "1_000", "2024-01-01", 1000.0, float("inf"), True, None, "12:30"]


def test_anchors_tags_and_explicit_keys():
    assert load("base: &b\n  k: 1\n  l: [1]\nother:\n  <<: *b\n  k: 2\nthird: {<<: [*b, {m: 3}], l: 4}\n") == {"base": {"k": 1, "l": [1]}, "other": {"k": 2, "l": [1]}, "third": {"k": 1, "l": 4, "m": 3}}
    assert load("- &m k: v\n  l: *m\n- &n\n  - 1\n- *n\n- !!int 3\n- !pump {a: 1}\n- ! 12\n") == [{"k": "v", "l": "k"}, [1], [1], 3, {"!pump": {"a": 1}}, "12"]
    assert load("? a\n: - 1\n  - 2\n? [x, y]\n? c\n: &t |\n  text\nd: *t\n") == {"a": [1, 2], '["x", "y"]': None, "c": "text\n", "d": "text\n"}
    bomb = "a: &a [" + "x, " * 9 + "x]\n" + "".join(f"{b}: &{b} [{', '.join(['*' + a] * 10)}]\n" for a, b in zip("abcdefghij", "bcdefghijk"))
    for bad in ("a: *b", "a: &x [*x]", "a: !!int x", bomb):
        with pytest.raises(Unreadable):
            load(bad)


class Aliasing(yaml.SafeDumper):
    def ignore_aliases(self, data):
        return not isinstance(data, (dict, list)) or not data


@given(VALUES, VALUES, st.sampled_from([None, True, False]))
@settings(max_examples=200, deadline=None)
def test_reads_shared_values(value, other, flow):
    text = yaml.dump({"x": value, "y": [value, other], "z": {"k": other, "v": value}}, Dumper=Aliasing, default_flow_style=flow, allow_unicode=True)
    assert canonical(load(text)) == canonical({"x": value, "y": [value, other], "z": {"k": other, "v": value}})


def test_unreadable_texts_are_told(spark):
    data = [(1, 1, 1, "object_types: {a: {}}", None), (2, 1, 2, "object_types: [", '{"config": {"object_types": {}}}'), (3, 1, 3, "object_types: {b: {}}", None)]
    df = spark.createDataFrame(data, "id long, workspace_id int, version int, yaml string, canvas_json string")
    with pytest.raises(Unreadable, match="1 model texts cannot be read: workspace 1, version 2"):
        model_changes(df)
    with pytest.warns(UserWarning, match="version 2"):
        found = model_changes(df, unreadable=WARN)
    assert rows(found) == [(1, 3, "object_types.a", "removed"), (1, 3, "object_types.b", "added")]


def test_models_of_rows(spark):
    one, two = {"object_types": {"a": {"x": 1, "y": [1, 2]}}, "link_types": {}}, {"object_types": {"a": {"y": [1, 2], "x": 1.0}, "b": {}}}
    reordered = {"object_types": {"a": {"x": 1, "y": [2, 1]}, "b": {}}}
    data = [
        (1, 7, 1, yaml.safe_dump(one), None), (2, 7, 3, " \r\n", json.dumps({"config": two, "layout": 1})), (3, 7, 3, yaml.safe_dump(two), "{cut off"),
        (4, 7, 9, json.dumps(reordered), None), (5, 7, None, yaml.safe_dump({"object_types": {}}), None), (6, 7, 5, None, '{"layout": {}}'), (7, 7, 6, "", "{\"config\": {"),
        (8, None, 1, yaml.safe_dump(one), None), (9, 8, 1, "object_types: {}", None), (10, 8, 2, "object_types:\n  z: {}\nlink_types:\n  l: {from: z, to: z}\n", None),
    ]
    df = spark.createDataFrame(data, "id long, workspace_id int, version int, yaml string, canvas_json string")
    assert rows(model_changes(df)) == [(7, 3, "object_types.b", "added"), (7, 9, "object_types.a", "changed"), (8, 2, "link_types.l", "added"), (8, 2, "object_types.z", "added")]
    assert rows(model_changes(df.limit(0))) == []
    for text in ("[1", "text", "a: *b"):  # nothing falls back
        with pytest.raises(Unreadable):
            read_model(text, '{"config": {"a": 1}}')
    assert read_model(" ", '{"config": {"a": 1}}') == {"a": 1} and read_model(None, "[]") is None
    long = {"object_types": {"a": {"note": "x" * 300_000}}}
    assert read_model(yaml.safe_dump(long), None) == long
