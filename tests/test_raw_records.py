"""Nested payloads and drifting files: every form, against plain parsing."""

import json

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from scantable.operators import drift, nested

FORMS = [
    (1, json.dumps({"scene_name": "s", "candidates": [{"support_views": [{"f": 1}, None, 7]}, None, {"scene_name": "t", "support": {"support_views": 5}}]})),
    (2, json.dumps({"payload": {"candidates": json.dumps([{"support_views": json.dumps([1, 2])}])}})),
    (3, json.dumps({"scene_reports": {"a": {"fusion": {"applied": {"support_views": {"f": 1}}}}, "b": {"applied": None, "skipped": [{"x": 1}]}}})),
    (4, json.dumps({"scene_reports": [{"scene_name": "c", "applied": [{"n": 'tab\there "q" \\'}]}]})),
    (5, '{"scene_name": "s", "candidates": [{"a": 1}'),
    (6, None), (7, ""), (8, "null"), (9, "[]"), (10, "not available"), (11, '{"candidates": [1, "x", [2]], "candidates": [3]}'),
    (12, json.dumps({"scene_name": "über", "candidates": [{"support_views": []}, {"support_views": None}, {"support_views": "[]"}]}, ensure_ascii=False)),
    (13, json.dumps({"scene_reports": {"scene_name": "one", "applied": [{}]}})),
    (14, "} {"), (15, '{"a": "\\"}'),
]


def test_candidate_views_all_forms(spark, rows):
    df = spark.createDataFrame(FORMS, "payload_id long, payload string")
    c, a = "candidates", "applied"
    assert rows(nested.candidate_views(df, "payload_id", "payload")) == sorted(
        [
            (1, "s", c, 0, -1), (1, "s", c, 0, 0), (1, "s", c, 0, 2), (1, "t", c, 2, -1), (1, "t", c, 2, 0), (2, None, c, 0, -1), (2, None, c, 0, 0), (2, None, c, 0, 1),
            (3, "a", a, 0, -1), (3, "a", a, 0, 0), (4, "c", a, 0, -1), (11, None, c, 0, -1), (12, "über", c, 0, -1), (12, "über", c, 1, -1), (12, "über", c, 2, -1), (13, "one", a, 0, -1),
        ],
        key=repr,
    )
    assert nested.candidate_views(df.limit(0), "payload_id", "payload").count() == 0


def test_chunks_do_not_change_the_result(spark, rows, monkeypatch):
    df = spark.createDataFrame(FORMS * 3, "payload_id long, payload string").coalesce(1)
    whole = rows(nested.candidate_views(df, "payload_id", "payload"))
    monkeypatch.setattr(nested, "CHUNK", 50)
    assert rows(nested.candidate_views(df, "payload_id", "payload")) == whole


_JSON = st.recursive(st.none() | st.booleans() | st.integers(-99, 99) | st.text(max_size=6), lambda x: st.lists(x, max_size=4) | st.dictionaries(st.text(max_size=5), x, max_size=4), max_leaves=25)


def _flat(value, out, depth=0, key=None, place=0):
    out.append((depth, key, place, value if not isinstance(value, (dict, list)) else type(value).__name__))
    inner = value.items() if isinstance(value, dict) else ((None, v) for v in value) if isinstance(value, list) else ()
    for i, (k, v) in enumerate(inner):
        _flat(v, out, depth + 1, k, i)
    return out


@settings(max_examples=150, deadline=None)
@given(st.lists(_JSON, min_size=1, max_size=4), st.sampled_from([None, 2]), st.booleans())
def test_index_holds_every_value(values, indent, plain):
    texts = [json.dumps(v, indent=indent, ensure_ascii=plain).encode("utf-8", "surrogatepass") for v in values]
    nodes = nested.index(texts)
    for t, value in enumerate(values):
        mine = np.flatnonzero(nodes.text == t)
        depth = {}
        for i in sorted(mine, key=lambda i: (nodes.start[i], -nodes.end[i])):
            depth[i] = depth[nodes.parent[i]] + 1 if nodes.parent[i] >= 0 else 0
        got = []
        for i in mine:
            v = json.loads(nodes.data[nodes.start[i] : nodes.end[i]].tobytes().decode("utf-8", "surrogatepass"))
            got.append((depth[i], json.loads(nodes.data[nodes.key_start[i] : nodes.key_end[i]].tobytes().decode("utf-8", "surrogatepass")) if nodes.key_start[i] >= 0 else None, int(nodes.place[i]), v if not isinstance(v, (dict, list)) else type(v).__name__))
        assert sorted(map(repr, got)) == sorted(map(repr, _flat(value, [])))


_PIECES = st.lists(st.sampled_from(['{', '}', '[', ']', ',', ':', '"a"', '"', '\\', '\\u00e9', '\\ud8', '1', '-0', '01', '1.5e3', '1.', 'true', 'null', 'nul', 'NaN', '-Infinity', ' ', '\n', '\t', 'x', '"b\\n"', '\x01', 'é', '{"k": 1}', '[2]']), max_size=9).map("".join)


def _is_json(text):
    try:
        json.loads(text)
    except ValueError:
        return False
    return True


@settings(max_examples=800, deadline=None)
@given(st.lists(st.one_of(_PIECES, _JSON.map(json.dumps), st.tuples(_JSON.map(json.dumps), st.integers(0, 30)).map(lambda x: x[0][: x[1]])), min_size=1, max_size=6))
def test_grammar_agrees_with_a_parser(texts):
    good = nested.grammatical(nested.structure(*nested.joined([t.encode() for t in texts])))
    assert list(good) == [_is_json(t) for t in texts]


def test_depth_is_not_limited(spark, rows):
    deep = 100_000
    item = '{"a": ' * deep + "[" * deep + "]" * deep + "}" * deep
    df = spark.createDataFrame([(1, '{"candidates": [%s, {"support_views": [1]}], "scene_name": "s"}' % item), (2, "[" * deep)], "id long, t string")
    assert rows(nested.candidate_views(df, "id", "t")) == [(1, "s", "candidates", 0, -1), (1, "s", "candidates", 1, -1), (1, "s", "candidates", 1, 0)]
    assert nested.shred(df, "id", "t").agg({"depth": "max"}).first()[0] == 2 * deep + 1


def test_shred_links(spark):
    df = spark.createDataFrame([(1, '{"a": [1, {"b": null}]}'), (2, "x")], "id long, t string")
    got = {(r.node_id, r.parent_id, r.depth, r.key, r.place, r.kind, r.value) for r in nested.shred(df, "id", "t").collect()}
    assert got == {(0, -1, 0, None, 0, "object", None), (1, 0, 1, "a", 0, "array", None), (2, 1, 2, None, 0, "number", "1"), (3, 1, 2, None, 1, "object", None), (4, 3, 3, "b", 0, "null", "null")}


def _files(spark, files, lines):
    f = spark.createDataFrame(files, "file_id long, series_name string, exported_at timestamp")
    r = spark.createDataFrame([(i, n, x if x is None or isinstance(x, str) else json.dumps(x)) for i, n, x in lines], "file_id long, line_no int, raw_record string")
    return f, r


def test_schema_changes(spark, rows):
    import datetime as dt

    day = lambda i: dt.datetime(2025, 1, i)
    files = [(10, "x", day(2)), (3, "x", day(1)), (4, "y", day(3)), (5, None, day(4)), (6, "x", None)]
    old = [(3, i, {"candidate_id": i, "source_json": f"p{i}", "score": 0.5, "n": i, "gone": 1}) for i in range(5)]
    new = [(10, i, {"candidate_id": f"c-{i}", "sourceJson": f"p{i}" if i else None, "score": {"value": 0.5}, "n": i, "more": "a"}) for i in range(5)]
    broken = [(10, 9, '{"candidate_id": 3, "bad": 1'), (10, 10, None), (10, 11, "[1]"), (10, 12, '{"score": 0.1}')]
    f, r = _files(spark, files, old + new + broken)
    got = rows(drift.schema_changes(f, r), "change_kind", "old_field", "new_field")
    assert got == [("added", "", "more"), ("removed", "gone", ""), ("renamed", "source_json", "sourceJson"), ("type_changed", "candidate_id", "candidate_id"), ("type_changed", "score", "score")]
    table = {(x.file_id, x.candidate_id): x for x in drift.consistent_table(f, r).collect()}
    assert table[(3, 2)].source_path == table[(10, 2)].source_path == "p2" and table[(10, 2)].score == 0.5 and table[(10, 0)].source_path is None
    empty = r.limit(0)
    assert drift.schema_changes(f, empty).count() == 0 and drift.consistent_table(f, empty).count() == 0


def test_half_equal_is_no_rename(spark, rows):
    import datetime as dt

    files = [(1, "x", dt.datetime(2025, 1, 1)), (2, "x", dt.datetime(2025, 1, 2))]
    lines = [(1, i, {"candidate_id": i, "a": i}) for i in range(4)] + [(2, i, {"candidate_id": i, "b": i if i < 2 else -1}) for i in range(4)]
    f, r = _files(spark, files, lines)
    assert rows(drift.schema_changes(f, r), "change_kind") == [("added",), ("removed",)]


def test_fingerprints_and_final_names(spark, rows):
    import datetime as dt

    files = [(i, "x", dt.datetime(2025, 1, i)) for i in (1, 2, 3)]
    lines = [(i, k, {"candidate_id": k, n: f"v{k}"}) for i, n in ((1, "a"), (2, "b"), (3, "c")) for k in range(3)]
    f, r = _files(spark, files, lines)
    known = drift.file_fields(drift.parsed_fields(r))
    assert [v for _, v in rows(drift.fingerprints(f, known), "file_id", "version")] == [1, 2, 3]
    names = drift.final_names(f, known, drift.schema_changes(f, r))
    assert rows(names.where("field in ('a', 'b', 'c')"), "file_id", "final_field") == [(1, "c"), (2, "c"), (3, "c")]
