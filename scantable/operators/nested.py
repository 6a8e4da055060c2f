"""Deeply nested JSON texts to linked flat rows by vectorised structural indexing."""

from __future__ import annotations

import functools
import json
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

#: Bytes indexed at once; a longer text is indexed alone.
CHUNK = 4 << 20

_STRUCTURAL = np.zeros(256, dtype=bool)
_STRUCTURAL[np.frombuffer(b"{}[],:", dtype=np.uint8)] = True
_BLANK = np.zeros(256, dtype=bool)
_BLANK[np.frombuffer(b" \t\r\n", dtype=np.uint8)] = True
_OPEN, _CLOSE = np.zeros(256, dtype=bool), np.zeros(256, dtype=bool)
_OPEN[[ord("{"), ord("[")]] = True
_CLOSE[[ord("}"), ord("]")]] = True
_HEX, _ESCAPE = np.zeros(256, dtype=bool), np.zeros(256, dtype=bool)
_HEX[np.frombuffer(b"0123456789abcdefABCDEF", dtype=np.uint8)] = True
_ESCAPE[np.frombuffer(b'"\\/bfnrtu', dtype=np.uint8)] = True
#: fixed values: scalars of JSON that aren't strings, and the names of numbers that aren't finite
_PLAIN = r"^(-?(0|[1-9][0-9]*)(\.[0-9]+)?([eE][+-]?[0-9]+)?|true|false|null|NaN|-?Infinity)$"


@dataclass
class Bitmaps:
    """Structural characters of texts that lie behind one another in data[offsets[i]:offsets[i + 1]].

    position, depth (of the container a character belongs to) and text of each; inside: bytes of strings with their opening
    quote; quote: quotes that aren't escaped; escape: backslashes that escape the byte behind them; sound: per text, quotes and
    brackets are balanced; live: the texts that are looked at.
    """

    data: np.ndarray
    offsets: np.ndarray
    position: np.ndarray
    depth: np.ndarray
    text: np.ndarray
    inside: np.ndarray
    quote: np.ndarray
    escape: np.ndarray
    sound: np.ndarray
    live: np.ndarray

    @functools.cached_property
    def levels(self) -> np.ndarray:
        """The structural characters by text, depth and position: one container's stand behind one another."""
        key = self.text * (int(self.depth.max(initial=0)) + 2) + self.depth
        return np.argsort(key, kind="stable")

    @functools.cached_property
    def solid(self) -> np.ndarray:
        """Places of all bytes that aren't blank."""
        return np.flatnonzero(~_BLANK[self.data])

    @functools.cached_property
    def before(self) -> np.ndarray:
        """How many such bytes come before each place."""
        return np.concatenate([[0], np.cumsum(~_BLANK[self.data], dtype=np.int32)])


def structure(data: np.ndarray, offsets: np.ndarray) -> Bitmaps:
    """Index of the structural characters.

    Bitmaps of backslashes give the escaped characters, those of the other quotes by their running parity the insides of
    strings; brackets, commas and colons outside are structural, and the prefix sum of opening less closing brackets is
    the depth.
    """
    n, texts = len(data), len(offsets) - 1
    lengths = np.diff(offsets)
    slash = data == 0x5C
    escape = np.zeros(n, dtype=bool)
    escaped = np.zeros(n + 1, dtype=bool)
    if slash.any():
        at = np.flatnonzero(slash)
        first = np.ones(len(at), dtype=bool)
        first[1:] = (at[1:] != at[:-1] + 1) | np.isin(at[1:], offsets, assume_unique=False)
        begin = np.maximum.accumulate(np.where(first, np.arange(len(at)), 0))
        active = at[(np.arange(len(at)) - begin) % 2 == 0]
        escape[active] = True
        escaped[active + 1] = True
        escaped[offsets] = False
    quote = (data == 0x22) & ~escaped[:n]
    # parity of the quotes so far, less that at the begin of the text
    odd = np.zeros(n + 1, dtype=bool)
    np.logical_xor.accumulate(quote, out=odd[1:])
    inside = odd[1:] ^ np.repeat(odd[offsets[:-1]], lengths)
    sound = odd[offsets[1:]] == odd[offsets[:-1]]
    position = np.flatnonzero(_STRUCTURAL[data] & ~inside)
    kind = data[position]
    text = np.repeat(np.arange(texts), np.diff(np.searchsorted(position, offsets)))
    step = _OPEN[kind].astype(np.int64) - _CLOSE[kind]
    total = np.concatenate([[0], np.cumsum(step)])
    edge = np.searchsorted(position, offsets)
    depth = total[1:] - total[edge[:-1]][text] + _CLOSE[kind] if len(position) else np.zeros(0, dtype=np.int64)
    sound &= total[edge[1:]] == total[edge[:-1]]
    if len(position):
        lowest = np.full(texts, 0)
        np.minimum.at(lowest, text, total[1:] - total[edge[:-1]][text])
        sound &= lowest >= 0
    return Bitmaps(data, offsets, position, depth, text, inside, quote, escape, sound, np.ones(texts, dtype=bool))


def spans(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.BinaryArray:
    """data[start[i]:end[i]] of all i as one array."""
    size = end - start
    offsets = np.concatenate([[0], np.cumsum(size)]).astype(np.int64)
    at = np.arange(offsets[-1]) + np.repeat(start - offsets[:-1], size)
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data[at]))])


def grammatical(maps: Bitmaps) -> np.ndarray:
    """Per text, whether it is JSON: decided over the bitmaps, so depth costs nothing and no text is parsed.

    Between two neighbouring structural characters lies at most one scalar. Which neighbours may follow one another, with
    or without a scalar between them, depends on the two and on the kind of their container only; scalars are checked all together.
    """
    data, offsets, good = maps.data, maps.offsets, maps.sound.copy()
    texts = len(offsets) - 1
    if not texts:
        return good
    # a byte 1 and 2 stand for the begin and the end of each text
    edges = np.arange(texts)
    cut = np.searchsorted(maps.position, offsets)
    m = len(maps.position) + 2 * texts
    p, t, role = np.empty(m, dtype=np.int64), np.empty(m, dtype=np.int64), np.ones(m, dtype=np.int8)
    begin, end_, inner = cut[:-1] + 2 * edges, cut[1:] + 2 * edges + 1, np.arange(len(maps.position)) + 2 * maps.text + 1
    p[begin], p[end_], p[inner] = offsets[:-1] - 1, offsets[1:], maps.position
    t[begin], t[end_], t[inner] = edges, edges, maps.text
    role[begin], role[end_] = 0, 2
    k = np.where(role == 1, data[np.clip(p, 0, max(0, len(data) - 1))] if len(data) else 0, role + 1)
    k[role == 0] = 1
    k[role == 2] = 2
    # kind of the container of every structural character: that of the opening bracket at its depth before it
    mine = maps.levels
    kinds = data[maps.position][mine] if len(mine) else np.zeros(0, dtype=np.uint8)
    seq = np.arange(len(mine))
    opened = np.maximum.accumulate(np.where(_OPEN[kinds], seq, 0)) if len(mine) else seq
    curly = np.zeros(len(mine), dtype=bool)
    curly[mine] = kinds[opened] == ord("{")
    in_object = np.zeros(len(p), dtype=bool)
    in_object[role == 1] = curly
    deep = np.ones(len(p), dtype=bool)
    deep[role == 1] = maps.depth >= 1

    solid = maps.solid
    a, b = slice(0, len(p) - 1), slice(1, len(p))
    pair = t[a] == t[b]
    first = maps.before[np.minimum(p[a] + 1, len(data))]
    last = maps.before[p[b]] - 1
    has = (first <= last) & pair
    x, y, obj = k[a], k[b], in_object[a]
    closing = (y == ord("}")) | (y == ord("]"))
    opening = (y == ord("{")) | (y == ord("["))
    value = np.where(has, (y == ord(",")) | closing, opening)  # what may follow where a value is due
    ok = np.select(
        [x == 1, x == ord("{"), x == ord("["), x == ord(":"), (x == ord(",")) & obj, x == ord(","), (x == ord("}")) | (x == ord("]"))],
        [
            np.where(has, y == 2, opening),
            np.where(has, y == ord(":"), y == ord("}")),
            value | (~has & (y == ord("]"))),
            value,
            has & (y == ord(":")),
            value,
            ~has & ((y == ord(",")) | closing | (y == 2)),
        ],
        default=False,
    )
    # a bracket closes one of its own kind, a colon is in an object, nothing structural is outside the root
    ok &= ~((y == ord("}")) & ~in_object[b]) & ~((y == ord("]")) & in_object[b]) & ~((y == ord(":")) & ~in_object[b]) & deep[b]
    good[t[a][pair & ~ok]] = False

    # scalars: one span each
    at = np.flatnonzero(has)
    start, end, of = solid[first[at]], solid[last[at]] + 1, t[a][at]
    quotes = np.flatnonzero(maps.quote)
    n_quotes = np.searchsorted(quotes, end) - np.searchsorted(quotes, start)
    string = (data[start] == 0x22) & maps.quote[end - 1] & (n_quotes == 2) & (end - start >= 2)
    plain = np.flatnonzero(~string)
    if len(plain):
        fits = pc.match_substring_regex(spans(data, start[plain], end[plain]), _PLAIN).to_numpy(zero_copy_only=False)
        good[of[plain[~fits]]] = False
    named = at[y[at] == ord(":")]
    good[t[a][named[~string[np.searchsorted(at, named)]]]] = False
    # strings: no control characters, escapes that exist, four hexadecimal digits behind a u
    control = np.flatnonzero(maps.inside & (data < 0x20))
    text_of = lambda where: np.searchsorted(offsets, where, side="right") - 1
    good[text_of(control)] = False
    slash = np.flatnonzero(maps.escape)
    good[text_of(slash[~maps.inside[slash]])] = False
    slash = slash[(slash + 1 < len(data))]
    good[text_of(slash[~_ESCAPE[data[slash + 1]]])] = False
    u = slash[data[slash + 1] == ord("u")]
    if len(u):
        digits = u[:, None] + np.arange(2, 6)
        within = digits[:, -1] < len(data)
        hexed = np.zeros(len(u), dtype=bool)
        hexed[within] = _HEX[data[digits[within]]].all(axis=1)
        good[text_of(u[~hexed])] = False
    return good


@dataclass
class Nodes:
    """The values of a batch of JSON texts, as columns. Node i spans data[start[i]:end[i]]; roots have parent -1."""

    data: np.ndarray
    escapes: np.ndarray
    text: np.ndarray
    start: np.ndarray
    end: np.ndarray
    parent: np.ndarray
    key_start: np.ndarray
    key_end: np.ndarray
    place: np.ndarray
    depth: np.ndarray
    roots: np.ndarray

    def kind(self, nodes: np.ndarray) -> np.ndarray:
        """First byte of each value."""
        return self.data[self.start[nodes]]

    def texts(self, nodes: np.ndarray) -> pa.Array:
        """Texts of scalars: strings decoded, others as they are written."""
        text = self.kind(nodes) == ord('"')
        out = _text(spans(self.data, self.start[nodes] + text, self.end[nodes] - text))
        coded = np.flatnonzero(text & (np.searchsorted(self.escapes, self.end[nodes]) > np.searchsorted(self.escapes, self.start[nodes])))
        if len(coded):
            plain = pa.array([x.encode("utf-8", "replace").decode() for x in unquoted(self.data, self.escapes, self.start[nodes[coded]], self.end[nodes[coded]])], pa.string())
            mask = np.zeros(len(nodes), dtype=bool)
            mask[coded] = True
            out = pc.replace_with_mask(out, pa.array(mask), plain)
        return out

    def keys(self, nodes: np.ndarray) -> list[str]:
        """Names of members."""
        return unquoted(self.data, self.escapes, self.key_start[nodes], self.key_end[nodes])

    def named(self, name: str) -> np.ndarray:
        """Whether each value is a member of that name, compared over the key's bytes."""
        pattern = np.frombuffer(json.dumps(name).encode(), dtype=np.uint8)
        hit = self.key_end - self.key_start == len(pattern)
        at = np.flatnonzero(hit)
        if len(at):
            hit[at] = (self.data[self.key_start[at][:, None] + np.arange(len(pattern))] == pattern).all(axis=1)
        return hit

    def child(self, nodes: np.ndarray, name: str) -> np.ndarray:
        """Per node its member of that name, -1 without; the last one where a name is repeated."""
        out = np.full(len(nodes), -1)
        if not len(nodes):
            return out
        slot = np.full(len(self.start) + 1, -1)
        slot[nodes] = np.arange(len(nodes))
        found = np.flatnonzero(self.named(name) & (slot[self.parent] >= 0))
        out[slot[self.parent[found]]] = found
        return out

    def find(self, nodes: np.ndarray, name: str) -> np.ndarray:
        """Per node its non-null member of that name, else that of an object one level deeper; -1 without."""
        out = self.child(nodes, name)
        null = (out >= 0) & (self.data[self.start[out]] == ord("n"))
        lost = np.flatnonzero((out < 0) | null)
        if len(lost):
            slot = np.full(len(self.start) + 1, -1)
            slot[nodes[lost]] = lost
            below = np.flatnonzero((slot[self.parent] >= 0) & (self.kind(np.arange(len(self.start))) == ord("{")) & (self.key_start >= 0))
            deep = self.child(below, name)
            has = np.flatnonzero(deep >= 0)
            out[slot[self.parent[below[has]]]] = deep[has]
        return out

    def elements(self, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(element, index of its container in nodes) of arrays and objects."""
        slot = np.full(len(self.start) + 1, -1)
        slot[nodes] = np.arange(len(nodes))
        own = np.flatnonzero(slot[self.parent] >= 0)
        return own, slot[self.parent[own]]


def _text(array: pa.Array) -> pa.Array:
    """Bytes as text; what isn't UTF-8 is replaced."""
    try:
        return array.cast(pa.large_string()).cast(pa.string())
    except pa.ArrowInvalid:
        return pa.array([x.as_py().decode("utf-8", "replace") for x in array], pa.string())


def unquoted(data: np.ndarray, escapes: np.ndarray, start: np.ndarray, end: np.ndarray) -> list[str]:
    """Contents of the string spans; only those with an escape (escapes: their places) are decoded one by one."""
    texts = _text(spans(data, start + 1, end - 1)).to_pylist()
    for i in np.flatnonzero(np.searchsorted(escapes, end) > np.searchsorted(escapes, start)):
        texts[i] = json.loads(data[start[i] : end[i]].tobytes(), strict=False)
    return texts


def joined(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(data, offsets) of texts behind one another."""
    return np.frombuffer(b"".join(texts), dtype=np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)


def index(texts: list[bytes]) -> Nodes:
    """Spans of all values of valid JSON texts, see values()."""
    return values(structure(*joined(texts)))


def values(maps: Bitmaps) -> Nodes:
    """Spans of all values of valid JSON texts: keys, values, parents and places in their containers."""
    data, offsets = maps.data, maps.offsets
    position, depth, text = maps.position, maps.depth, maps.text
    kind = data[position] if len(position) else np.zeros(0, dtype=np.uint8)
    solid = maps.solid
    # within one text and depth, in order: open, (key, colon,) value, comma, ..., close, open, ...
    order = maps.levels
    p, k, t, d = position[order], kind[order], text[order], depth[order]
    opens, closes = _OPEN[k], _CLOSE[k]
    same = np.zeros(len(p), dtype=bool)
    if len(p):
        same[:-1] = (t[1:] == t[:-1]) & (d[1:] == d[:-1]) & ~closes[:-1]
    at = np.arange(len(p))
    opened = np.maximum.accumulate(np.where(opens, at, 0)) if len(p) else at
    in_object = k[opened] == ord("{") if len(p) else np.zeros(0, dtype=bool)
    colon = k == ord(":")
    # a value follows a colon in an object, an opening bracket or comma in an array
    value = np.flatnonzero(same & np.where(in_object, colon, ~colon))
    begin, stop = p[value] + 1, p[np.minimum(value + 1, len(p) - 1)] if len(p) else p[value]
    if len(value):
        first = maps.before[begin]
        last = maps.before[stop] - 1
        real = first <= last  # nothing between brackets: no value
        value, first, last = value[real], first[real], last[real]
        start, end = solid[first], solid[last] + 1
    else:
        start = end = np.zeros(0, dtype=np.int64)
    key_start, key_end = np.full(len(value), -1), np.full(len(value), -1)
    keyed = np.flatnonzero(in_object[value])
    if len(keyed):
        v = value[keyed]
        key_start[keyed] = solid[maps.before[p[v - 1] + 1]]
        key_end[keyed] = solid[maps.before[p[v]] - 1] + 1
    bracket = p[opened[value]]  # where the container opens
    seq = np.arange(len(value))
    new = np.ones(len(value), dtype=bool)
    new[1:] = bracket[1:] != bracket[:-1]
    place = seq - np.maximum.accumulate(np.where(new, seq, 0)) if len(value) else seq
    full = np.flatnonzero((np.diff(offsets) > 0) & maps.live)
    root_first = maps.before[offsets[full]]
    root_last = maps.before[offsets[full + 1]] - 1
    start, end = np.concatenate([start, solid[root_first]]), np.concatenate([end, solid[root_last] + 1])
    by_start = np.argsort(start, kind="stable")
    holder = by_start[np.searchsorted(start[by_start], bracket)] if len(value) else bracket
    pad = np.full(len(full), -1)
    return Nodes(
        data, np.flatnonzero(maps.escape), np.concatenate([t[value], full]), start, end, np.concatenate([holder, pad]),
        np.concatenate([key_start, pad]), np.concatenate([key_end, pad]), np.concatenate([place, np.zeros(len(full), dtype=np.int64)]),
        np.concatenate([d[value], np.zeros(len(full), dtype=np.int64)]).astype(np.int32), np.arange(len(value), len(value) + len(full)),
    )


def only(maps: Bitmaps, good: np.ndarray) -> Bitmaps:
    """The index of the texts marked good; the others' bytes stay, but hold no values."""
    if good.all():
        return maps
    keep = good[maps.text]
    return Bitmaps(maps.data, maps.offsets, maps.position[keep], maps.depth[keep], maps.text[keep], maps.inside, maps.quote, maps.escape, maps.sound, good)


def chunks(batch: pa.RecordBatch, column: str) -> Iterator[tuple[np.ndarray, Bitmaps]]:
    """(row numbers, index) of the rows whose text is JSON, about CHUNK bytes at a time."""
    texts = batch.column(column).cast(pa.binary()).to_pylist()
    rows, held, size = [], [], 0

    def valid() -> Iterator[tuple[np.ndarray, Bitmaps]]:
        maps = structure(*joined(held))
        good = grammatical(maps)
        if good.any():
            yield np.array(rows), only(maps, good)

    for i, x in enumerate(texts):
        if not x or not x.strip():
            continue
        rows.append(i)
        held.append(x)
        size += len(x)
        if size >= CHUNK:
            yield from valid()
            rows, held, size = [], [], 0
    if rows:
        yield from valid()


def shred(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Every value of every JSON text as a row, linked to its container.

    (id, node_id, parent_id, depth, key, place, kind, value): node_id counts within its text, the root is 0 and has parent
    -1; place counts from 0 in the container; kind is object, array, string, number, boolean or null; value is the text of a
    string, of other scalars as they are written, NULL for containers. Texts that are null, blank or no JSON give no rows; depth is not limited.
    """
    id_type = df.schema[id_col].dataType.simpleString()
    names = np.full(256, "number", dtype=object)
    for first, name in {"{": "object", "[": "array", '"': "string", "t": "boolean", "f": "boolean", "n": "null"}.items():
        names[ord(first)] = name

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, maps in chunks(batch, text_col):
                nodes = values(maps)
                order = np.lexsort((-nodes.end, nodes.start, nodes.text))  # containers before what they hold
                number = np.empty(len(order), dtype=np.int64)
                first = np.searchsorted(nodes.text[order], np.arange(len(rows)))
                number[order] = np.arange(len(order)) - first[nodes.text[order]]
                kind = nodes.kind(order)
                scalar = ~_OPEN[kind]
                keyed = nodes.key_start[order] >= 0
                # what has no key or no value of its own becomes an index behind the end, and so a null
                keys = pa.array(nodes.keys(order[keyed]), pa.string()).take(pa.array(np.cumsum(keyed) - 1, mask=~keyed))
                texts = nodes.texts(order[scalar]).take(pa.array(np.cumsum(scalar) - 1, mask=~scalar))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(id_col).take(pa.array(rows[nodes.text[order]])),
                        pa.array(number[order]),
                        pa.array(np.where(nodes.parent[order] >= 0, number[nodes.parent[order]], -1)),
                        pa.array(nodes.depth[order]),
                        keys,
                        pa.array(nodes.place[order].astype(np.int32)),
                        pa.array(names[kind], pa.string()),
                        texts,
                    ],
                    names=["id", "node_id", "parent_id", "depth", "key", "place", "kind", "value"],
                )

    return df.select(id_col, text_col).mapInArrow(run, f"id {id_type}, node_id long, parent_id long, depth int, key string, place int, kind string, value string")


@dataclass
class _Held:
    """List values to expand: nodes of one index with what is known of them from above."""

    nodes: Nodes
    lists: np.ndarray
    row: np.ndarray
    scene: np.ndarray


def _strings(nodes: Nodes, at: np.ndarray) -> np.ndarray:
    """Texts of string values, None for -1, empty ones and other kinds."""
    out = np.full(len(at), None, dtype=object)
    text = np.flatnonzero((at >= 0) & (nodes.data[nodes.start[at]] == ord('"'))) if len(at) else np.zeros(0, dtype=np.int64)
    if len(text):
        out[text] = [x or None for x in unquoted(nodes.data, nodes.escapes, nodes.start[at[text]], nodes.end[at[text]])]
    return out


def _first(*choices: np.ndarray) -> np.ndarray:
    """Per place the first of the choices that isn't None."""
    out = choices[0].copy()
    for other in choices[1:]:
        lost = np.flatnonzero(np.equal(out, None))
        out[lost] = other[lost]
    return out


def _unfold(held: _Held) -> Iterator[tuple[Nodes, np.ndarray, np.ndarray, np.ndarray]]:
    """(index, elements, places, index of the list) of list values in whatever form they are written.

    An array gives its elements, something single is one element at place 0, a JSON text is read again, null gives nothing.
    """
    kind = held.nodes.kind(held.lists) if len(held.lists) else np.zeros(0, dtype=np.uint8)
    arrays = np.flatnonzero(kind == ord("["))
    if len(arrays):
        found, of = held.nodes.elements(held.lists[arrays])
        yield held.nodes, found, held.nodes.place[found], arrays[of]
    single = np.flatnonzero((kind != ord("[")) & (kind != ord('"')) & (kind != ord("n")))
    if len(single):
        yield held.nodes, held.lists[single], np.zeros(len(single), dtype=np.int64), single
    quoted = np.flatnonzero(kind == ord('"'))
    if len(quoted):
        lists = held.lists[quoted]
        inner = [x.strip().encode("utf-8", "surrogatepass") for x in unquoted(held.nodes.data, held.nodes.escapes, held.nodes.start[lists], held.nodes.end[lists])]
        real = np.array([bool(x) for x in inner])
        quoted, inner = quoted[real], [x for x in inner if x]
        maps = structure(*joined(inner))
        good = grammatical(maps) if inner else np.zeros(0, dtype=bool)
        plain = quoted[~good]
        if len(plain):
            yield held.nodes, held.lists[plain], np.zeros(len(plain), dtype=np.int64), plain
        if good.any():
            deeper = values(only(maps, good))
            for nodes, found, places, of in _unfold(_Held(deeper, deeper.roots, deeper.text[deeper.roots], np.full(len(deeper.roots), None, dtype=object))):
                yield nodes, found, places, quoted[deeper.text[deeper.roots[of]]]


def candidate_views(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Items of candidates and applied lists and their support views as flat rows, tied to text, scene and item.

    (id, scene_name, section, item_pos, view_pos): one row with view_pos -1 per item that isn't null, and one per
    element of its support_views that isn't null. Members may be missing or null, stand one object deeper, and lists may
    be written as an array, something single (place 0) or as a JSON text. Reports of scene_reports are a list, an object
    keyed by scene or a single report. scene_name is the item's own, else its report's, else the file's; NULL if none
    says it. Texts that aren't JSON give nothing. All steps work on columns of spans; depth is not limited.
    """
    id_type = df.schema[id_col].dataType.simpleString()

    def items(held: _Held, section: str) -> Iterator[tuple]:
        """Columns (row, scene, section, item, view) of items and views."""
        for nodes, found, places, of in _unfold(held):
            real = nodes.kind(found) != ord("n")
            found, places, of = found[real], places[real], of[real]
            rows, scenes = held.row[of], _first(_strings(nodes, nodes.child(found, "scene_name")), held.scene[of])
            yield rows, scenes, section, places, np.full(len(rows), -1)
            views = nodes.find(found, "support_views")
            has = np.flatnonzero(views >= 0)
            inner = _Held(nodes, views[has], rows[has], scenes[has])
            for deep, view, at, whose in _unfold(inner):
                keep = deep.kind(view) != ord("n")
                yield inner.row[whose[keep]], inner.scene[whose[keep]], section, places[has[whose[keep]]], at[keep]

    def reports(nodes: Nodes, tops: np.ndarray, row: np.ndarray, scene: np.ndarray) -> Iterator[tuple]:
        for deep, found, _, of in _unfold(_Held(nodes, tops, row, scene)):
            # an object that is no report itself holds reports by scene
            alone = (deep.child(found, "applied") >= 0) | (deep.child(found, "scene_name") >= 0) | (deep.child(found, "fusion") >= 0)
            is_object = deep.kind(found) == ord("{")
            keyed = is_object & ~alone & (nodes.kind(tops)[of] != ord("["))
            one = np.flatnonzero(is_object & ~keyed)
            inner, whose = deep.elements(found[keyed])
            report = np.concatenate([found[one], inner])
            if not len(report):
                continue
            above = np.concatenate([of[one], of[keyed][whose]])
            by_key = np.full(len(report), None, dtype=object)
            by_key[len(one) :] = [k or None for k in deep.keys(inner)]
            scenes = _first(_strings(deep, deep.find(report, "scene_name")), by_key, scene[above])
            applied = deep.find(report, "applied")
            has = np.flatnonzero(applied >= 0)
            yield from items(_Held(deep, applied[has], row[above[has]], scenes[has]), "applied")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, maps in chunks(batch, text_col):
                nodes = values(maps)
                roots = nodes.roots
                row = rows[nodes.text[roots]]
                scene = _strings(nodes, nodes.find(roots, "scene_name"))
                for name, section in (("candidates", "candidates"), ("scene_reports", "applied")):
                    lists = nodes.find(roots, name)
                    has = np.flatnonzero(lists >= 0)
                    if section == "candidates":
                        out = items(_Held(nodes, lists[has], row[has], scene[has]), section)
                    else:
                        out = reports(nodes, lists[has], row[has], scene[has])
                    for r, s, of, item, view in out:
                        if len(r):
                            yield pa.RecordBatch.from_arrays(
                                [batch.column(id_col).take(pa.array(r)), pa.array(s, pa.string()), pa.array([of] * len(r), pa.string()), pa.array(item.astype(np.int32)), pa.array(view.astype(np.int32))],
                                names=["id", "scene_name", "section", "item_pos", "view_pos"],
                            )

    return df.select(id_col, text_col).mapInArrow(run, f"id {id_type}, scene_name string, section string, item_pos int, view_pos int")
