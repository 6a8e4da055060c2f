"""Texts cut off before their end: near-copies that go on, and closing-word terminality for the rest."""

from __future__ import annotations

import functools
import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scantable.common import cut, small_or_not

#: Words of a shingle, hash functions, and rows of a band: a pair of similarity 0.8 shares a band with probability 0.9998.
SHINGLE, HASHES, ROWS = 5, 64, 4
#: Whole words before a text's last one that a longer copy must hold, and the fewest of a shorter text.
TAIL, LEAST_TAIL = 8, 3
#: Bits of the bitmaps that spare runs and contexts nobody asks for the way through Spark.
SIEVE = 1 << 24
#: Bytes of text a task splits at once.
CHUNK = 4 << 20
#: Copies share so much of the union of their shingles, as a fraction.
SIMILAR = (8, 10)
#: A text whose closing word ends fewer than this share of the lines that get as far as that word isn't at its end.
TERMINAL = 0.02
#: Other occurrences a context needs before its share counts; with fewer, the shorter context is asked.
ENOUGH = 3
#: A field limit shows in so many different texts of one length, and so many times as many as at the lengths around it.
LIMIT_TEXTS, LIMIT_TIMES = 5, 10

# fixed values: what closes a text, and what a system writes where it cut one
_STOPS = frozenset(".!?。！？；：")
_CLOSER = re.compile(r"""([!?。！？]|(?<!\.)\.(?!\.))[)"'”’»\]}`]*$""")
_ELLIPSIS = re.compile(r"(\.\.\.|…)$")
_MARKER = re.compile(r"(…|\.\.\.)\s*\W?(read on|read more|more|continued|show more|see more)\W?$|[\[(](more|continued|truncated|cut|\.\.\.|…)[\])]$", re.IGNORECASE)
_BROKEN = re.compile(r"(\w-|&(a|am|amp|l|lt|g|gt|q|qu|quo|quot|#\d{0,4})|\\|\b0\.|[,:;(\[{“«–=/@&+<]|，|、|\ufffd)$")
_WORD = re.compile(r"[぀-ヿ㐀-鿿]|[^\s぀-ヿ㐀-鿿]+")
_DIGITS = re.compile(r"\d+")
_BULLET = re.compile(r"\s*([-*+•]|\d+[.)])\s")
_INNER_STOP = re.compile(r"[.!?。！？]\s+\S|[。！？]\S")
_CJK = r"([\x{3040}-\x{30FF}\x{3400}-\x{9FFF}])"
#: What a line is: a list item, prose of several sentences, a text of one line without (title, caption), or another line.
KINDS = "bpts"


def words(line: str) -> list[str]:
    """Words of a line, numbers masked; a CJK character is a word."""
    return _WORD.findall(_DIGITS.sub("#", line))


_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


def _mixed(*parts: np.ndarray) -> np.ndarray:
    """A 64-bit number of several, in order."""
    h = np.uint64(0x2545F4914F6CDD1D)
    for x in parts:
        h = (h ^ x) * _A
        h = h ^ (h >> np.uint64(29))
    h = h * _B
    return h ^ (h >> np.uint64(32))


@functools.lru_cache(maxsize=200_000)
def _number(word: str) -> int:
    """A stable 64-bit number of a word, never 0."""
    return int.from_bytes(hashlib.blake2b(word.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "big") | 1


@dataclass
class Words:
    """All words of a batch of texts: word i is dictionary[codes[i]], of line line[i], and that of text of_line[line[i]].

    starts: where each text's words begin, with an end; first, last: whether a word is its line's first or last;
    raw, masked: numbers of the dictionary's words, as they are and with digits masked; stops: whether they end a sentence.
    """

    codes: np.ndarray
    dictionary: list[str]
    line: np.ndarray
    of_line: np.ndarray
    starts: np.ndarray
    first: np.ndarray
    last: np.ndarray
    kind: np.ndarray
    last_line: np.ndarray
    raw: np.ndarray
    masked: np.ndarray
    masks: list[str]
    stops: np.ndarray


def split(texts: pa.Array) -> Words:
    """Words of non-null texts: split, numbered and counted for the whole batch at once."""
    lines_of = pc.split_pattern(pc.utf8_rtrim(texts, "\r\n"), "\n")
    lines = lines_of.flatten()
    n_lines = np.diff(lines_of.offsets.to_numpy())
    of_line = np.repeat(np.arange(len(texts)), n_lines)
    last_line = np.cumsum(n_lines) - 1
    alone = np.zeros(len(lines), dtype=bool)
    alone[last_line[n_lines == 1]] = True
    yes = lambda pattern: pc.match_substring_regex(lines, pattern).to_numpy(zero_copy_only=False)
    kind = np.where(yes(r"^\s*([-*+•]|[0-9]+[.)])\s"), 0, np.where(yes(r"[.!?。！？]\s+\S|[。！？]\S"), 1, np.where(alone, 2, 3)))
    cjk = yes(_CJK)
    if cjk.any():
        lines = pc.if_else(pa.array(cjk), pc.replace_substring_regex(lines, _CJK, r" \1 "), lines)
    parts = pc.utf8_split_whitespace(lines)
    flat, size = parts.flatten(), np.diff(parts.offsets.to_numpy())
    line = np.repeat(np.arange(len(lines)), size)
    real = pc.not_equal(flat, "").to_numpy(zero_copy_only=False)
    coded = flat.filter(pa.array(real)).dictionary_encode()
    line = line[real]
    dictionary = coded.dictionary.to_pylist()
    codes = coded.indices.to_numpy()
    new = np.append(True, line[1:] != line[:-1]) if len(line) else np.zeros(0, dtype=bool)
    masks = [_DIGITS.sub("#", w) if any(c.isdigit() for c in w) else w for w in dictionary]
    starts = np.searchsorted(of_line[line], np.arange(len(texts) + 1)) if len(line) else np.zeros(len(texts) + 1, dtype=np.int64)
    numbers = lambda names: np.fromiter((_number(w) for w in names), np.uint64, len(names))
    stops = np.fromiter((w[-1] in _STOPS for w in dictionary), bool, len(dictionary))
    return Words(codes, dictionary, line, of_line, starts, new, np.append(new[1:], True)[: len(new)], kind, last_line, numbers(dictionary), numbers(masks), masks, stops)


def _context(kind: np.ndarray, size: int, before: np.ndarray, last: np.ndarray) -> np.ndarray:
    """A number of the last words (0: none) of the sentence so far, in a line of a kind."""
    none = np.zeros_like(last)
    return _mixed(kind.astype(np.uint64), np.full_like(last, size), before if size > 1 else none, last if size else none).view(np.int64)


def shape(text: str) -> str:
    """How a text stops, as far as it shows by itself: 'cut', 'closed' (at a stop or closer) or 'open' (undecided).

    cut: trailing blanks, a cut marker, half a word or number, or a structure left open - JSON text, code fence,
    quotation, bracket, table row.
    """
    body = text.rstrip("\r\n")
    if not body.strip():
        return "closed"
    if body != body.rstrip():  # blanks behind a stop are untidy, others are in the middle of a line
        return "closed" if _CLOSER.search(body.rstrip()) else "cut"
    last = body[body.rfind("\n") + 1 :]
    if _MARKER.search(last):
        return "cut"
    start = body.lstrip()[:1]
    if re.match(r'\s*(\{\s*"|\[\s*[{"\[])', body):
        return "closed" if body[-1] == {"{": "}", "[": "]"}[start] else "cut"
    if sum(1 for line in body.split("\n") if line.lstrip().startswith("```")) % 2:
        return "cut"
    if last.lstrip().startswith("|"):
        table = [line for line in body.split("\n") if line.lstrip().startswith("|")]
        return "closed" if last.rstrip().endswith("|") and last.count("|") >= table[0].count("|") else "cut"
    if last.count("“") > last.count("”") or last.count("«") > last.count("»"):
        return "cut"
    if last.count("(") > last.count(")") and not re.search(r"[:;]-?\($", last):
        return "cut"
    if _BROKEN.search(last):
        return "cut"
    return "closed" if _CLOSER.search(last) else "open"


def _runs(ids: np.ndarray, starts: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(k, places, numbers) for k from LEAST_TAIL to TAIL: the runs of k words of a text that another of its words follows."""
    ends = np.repeat(starts[1:], np.diff(starts))
    h = np.full(len(ids), _A)
    for k in range(1, TAIL + 1):
        n = max(0, len(ids) - k)
        h = (h[:n] ^ ids[k - 1 : k - 1 + n]) * _A
        h ^= h >> np.uint64(29)
        if k >= LEAST_TAIL:
            at = np.flatnonzero(np.arange(n) + k < ends[:n])
            out = (h[at] ^ np.uint64(k)) * _B
            yield k, at, (out ^ (out >> np.uint64(32))).view(np.int64)


def _shingles(ids: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(numbers, offsets) of the shingles of texts, none of them empty: of SHINGLE words, of all words where they are fewer."""
    size = np.diff(starts)
    count = np.maximum(size - SHINGLE + 1, 1)
    offsets = np.concatenate([[0], np.cumsum(count)])
    at = np.arange(offsets[-1]) + np.repeat(starts[:-1] - offsets[:-1], count)
    end = np.repeat(starts[1:], count)
    h = np.zeros(len(at), dtype=np.uint64)
    for i in range(SHINGLE):
        inside = at + i < end
        h = np.where(inside, (h ^ ids[np.minimum(at + i, len(ids) - 1)]) * _A, h)
        h ^= h >> np.uint64(29)
    h = h * _B
    return (h ^ (h >> np.uint64(32))), offsets


def _bands(ids: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """([texts, bands], distinct shingles per text): numbers of the bands of the texts' minhash signatures."""
    h, offsets = _shingles(ids, starts)
    own = np.sort(np.repeat(np.arange(len(starts) - 1, dtype=np.uint64) << np.uint64(44), np.diff(offsets)) | (h >> np.uint64(20)))
    distinct = np.bincount((own[np.append(True, own[1:] != own[:-1])] >> np.uint64(44)).astype(np.int64), minlength=len(starts) - 1)
    low = (h >> np.uint64(32)).astype(np.uint32)
    rng = np.random.default_rng(23)
    mult, add = rng.integers(1, 2**32, HASHES, dtype=np.uint32) | np.uint32(1), rng.integers(0, 2**32, HASHES, dtype=np.uint32)
    least = [np.minimum.reduceat(low * mult[i] + add[i], offsets[:-1]).astype(np.uint64) for i in range(HASHES)]
    out = [_mixed(np.full(len(starts) - 1, i, dtype=np.uint64), *least[i : i + ROWS]) for i in range(0, HASHES, ROWS)]
    return np.stack(out, axis=1).view(np.int64), distinct


def _named(texts: list[str]) -> np.ndarray:
    """A number of each text."""
    return np.array([int.from_bytes(hashlib.blake2b(t.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "big", signed=True) for t in texts], dtype=np.int64)


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, Words]]:
    """The rows whose text has a word, about CHUNK bytes at a time, and their words."""
    for batch in batches:
        batch = batch.filter(pc.fill_null(pc.match_substring_regex(batch.column("text"), r"\S"), False))
        size = np.cumsum(pc.binary_length(batch.column("text")).to_numpy(zero_copy_only=False))
        edges = np.flatnonzero(np.diff(size // CHUNK)) + 1 if len(size) else []
        for a, b in zip([0, *edges], [*edges, batch.num_rows]):
            part = batch.slice(a, b - a)
            if part.num_rows:
                held = split(part.column("text"))
                full = np.diff(held.starts) > 0
                if not full.all():  # blanks that only Unicode knows
                    part = part.filter(pa.array(full))
                    held = split(part.column("text"))
                if part.num_rows:
                    yield part, held


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per text: name, length, shape, contexts and closing word, number of its last words but one, last word, bands of its signature."""
    for batch, held in _texts(batches):
        texts = batch.column("text").to_pylist()
        ids, starts, n = held.raw[held.codes], held.starts, batch.num_rows
        # the run of the last words but one: the longest of at most TAIL words
        tail, has = np.zeros(n, dtype=np.int64), np.zeros(n, dtype=bool)
        for k, at, number in _runs(ids, starts):
            ends_at = np.flatnonzero(at + k + 1 == np.repeat(starts[1:], np.diff(starts))[at])
            of = np.searchsorted(starts, at[ends_at], side="right") - 1
            tail[of], has[of] = number[ends_at], True
        closing = [_closing(held, i) for i in range(n)]
        kind = held.kind[held.last_line]
        before, last = (np.array([c[j] for c in closing], dtype=np.uint64) for j in (0, 1))
        octets = [len(t.encode("utf-8", "surrogatepass")) for t in texts]
        bands, distinct = _bands(ids, starts)
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("doc_id").cast(pa.int64()), batch.column("source"), pa.array(_named(texts)), pa.array([len(t) for t in texts], pa.int64()), pa.array(octets, pa.int64()), pa.array([shape(t) for t in texts], pa.string()),
                pa.array([KINDS[k] for k in kind], pa.string()), *[pa.array(_context(kind, size, before, last)) for size in (2, 1, 0)], pa.array([c[2] for c in closing], pa.string()), pa.array(tail, mask=~has),
                pa.array([held.dictionary[c] for c in held.codes[starts[1:] - 1]], pa.string()), pa.ListArray.from_arrays(pa.array(np.arange(0, bands.size + 1, bands.shape[1], dtype=np.int32)), pa.array(bands.ravel())), pa.array(distinct.astype(np.int32)),
            ],
            names=["doc_id", "source", "name", "n", "octets", "shape", "kind", "ctx2", "ctx1", "ctx0", "word", "tail", "half", "bands", "shingles"],
        )


def _closing(held: Words, text: int) -> tuple[int, int, str]:
    """(number of the last word but two, but one, the last word) of the sentence a text stops in; without an ellipsis at the end."""
    end, line = held.starts[text + 1], held.last_line[text]
    codes = [c for i, c in enumerate(held.codes[max(held.starts[text], end - 4) : end].tolist(), max(held.starts[text], end - 4)) if held.line[i] == line]
    masks = _stems([held.masks[c] for c in codes])
    if not masks:
        return 0, 0, ""
    numbers = []
    for c in reversed(codes[: len(masks) - 1]):
        if held.stops[c] or len(numbers) == 2:
            break
        numbers.append(int(held.masked[c]))
    numbers += [0, 0]
    return numbers[1], numbers[0], masks[-1]


def _stems(line: list[str]) -> list[str]:
    """The words without an ellipsis at the end: what counts is whether lines end behind the word."""
    if line and (bare := _ELLIPSIS.sub("", line[-1])) != line[-1]:
        return [*line[:-1], bare] if bare else line[:-1]
    return line


def _sieve(numbers: DataFrame, name: str) -> np.ndarray:
    """A bitmap of a column's numbers by their last bits: 2 MB at most, whatever their number, and no number is missed."""
    low = F.col(name).bitwiseAND(F.lit(SIEVE - 1))
    rows = numbers.groupBy(F.shiftright(low, 15).alias("part")).agg(F.bitmap_construct_agg(low.bitwiseAND(F.lit(32767))).alias("bits")).collect()
    out = np.zeros(SIEVE >> 3, dtype=np.uint8)
    for r in rows:
        out[r.part << 12 : (r.part + 1) << 12] = np.frombuffer(r.bits, dtype=np.uint8)
    return out


def _passes(numbers: np.ndarray, sieve: np.ndarray) -> np.ndarray:
    """Places of the numbers that may be among those of the sieve."""
    low = numbers & (SIEVE - 1)
    return np.flatnonzero(sieve[low >> 3] >> (low & 7).astype(np.uint8) & 1)


_ASKED = "ctx long, word string, n long, ends long, tail long, name long, more boolean"


def _asked(batches: Iterator[pa.RecordBatch], contexts: np.ndarray, tails: np.ndarray) -> Iterator[pa.RecordBatch]:
    """What other texts ask for, in one pass over all texts: rows of two kinds.

    (ctx, word, n, ends): how often a word follows a context, and closes a line there that isn't its text's last: the
    closing word of a text is left out, as what closes texts is counted once per different text elsewhere.
    (tail, word, name, more): a text holds a run of words, the word behind it, and whether more follow.
    """
    for batch, held in _texts(batches):
        line, codes = held.line, held.codes
        counted = ~(held.last & (line == held.last_line[held.of_line[line]]))
        # the word before, and the one before that, of the same sentence
        numbers = held.masked[codes]
        clear = np.append(False, ~held.stops[codes[:-1]]) & ~held.first
        last = np.where(clear, np.append(np.uint64(0), numbers[:-1]), np.uint64(0))
        before = np.where(clear, np.append(np.uint64(0), last[:-1]), np.uint64(0))
        kind = held.kind[line]
        masks = pa.array(held.masks, pa.string()).dictionary_encode()  # words are counted by their mask
        mask, width = masks.indices.to_numpy()[codes].astype(np.int64), max(1, len(masks.dictionary))
        found = []
        # without words before, a context is a kind of line: counted for all words at once
        at = np.flatnonzero(counted)
        key = kind[at] * width + mask[at]
        n, closes = np.bincount(key, minlength=4 * width), np.bincount(key[held.last[at]], minlength=4 * width)
        cells = np.flatnonzero(n)
        ctx = _context(cells // width, 0, np.zeros(len(cells), dtype=np.uint64), np.zeros(len(cells), dtype=np.uint64))
        hit = _passes(ctx, contexts)
        found.append((ctx[hit], cells[hit] % width, n[cells[hit]], closes[cells[hit]]))
        for size in (2, 1):
            ctx = _context(kind[at], size, before[at], last[at])
            hit = _passes(ctx, contexts)
            ctx, w, ends = ctx[hit], mask[at[hit]], held.last[at[hit]].astype(np.int64)
            if len(ctx):
                order = np.lexsort((w, ctx))
                ctx, w, ends = ctx[order], w[order], ends[order]
                new = np.flatnonzero(np.append(True, (ctx[1:] != ctx[:-1]) | (w[1:] != w[:-1])))
                found.append((ctx[new], w[new], np.diff(np.append(new, len(ctx))), np.add.reduceat(ends, new)))
        ctx, w, n, closes = (np.concatenate([f[i] for f in found]) for i in range(4))
        none = lambda k, t: pa.nulls(k, t)
        k = len(ctx)
        yield pa.RecordBatch.from_arrays(
            [pa.array(ctx), masks.dictionary.take(pa.array(w)), pa.array(n.astype(np.int64)), pa.array(closes.astype(np.int64)), none(k, pa.int64()), none(k, pa.int64()), none(k, pa.bool_())],
            names=["ctx", "word", "n", "ends", "tail", "name", "more"],
        )
        hits = []
        for k, at, number in _runs(held.raw[codes], held.starts):
            hit = _passes(number, tails)
            hits.append((number[hit], at[hit], at[hit] + k))
        tail, at, then = (np.concatenate([h[i] for h in hits]) for i in range(3))
        if not len(tail):
            continue
        of = np.searchsorted(held.starts, at, side="right") - 1
        where, back = np.unique(of, return_inverse=True)
        names = _named(batch.column("text").take(pa.array(where)).to_pylist())
        k = len(tail)
        yield pa.RecordBatch.from_arrays(
            [none(k, pa.int64()), pa.array([held.dictionary[c] for c in codes[then]], pa.string()), none(k, pa.int64()), none(k, pa.int64()), pa.array(tail), pa.array(names[back]), pa.array(then + 1 < held.starts[of + 1])],
            names=["ctx", "word", "n", "ends", "tail", "name", "more"],
        )


def _shingled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(name, shingles): the distinct shingles of each text, as 64-bit numbers."""
    for batch, held in _texts(batches):
        h, offsets = _shingles(held.raw[held.codes], held.starts)
        own = [np.unique(h[a:b]).view(np.int64) for a, b in zip(offsets[:-1], offsets[1:])]
        ends = np.concatenate([[0], np.cumsum([len(x) for x in own])]).astype(np.int32)
        yield pa.RecordBatch.from_arrays([pa.array(_named(batch.column("text").to_pylist())), pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(own)))], names=["name", "shingles"])


def goes_on(tail: str, text: str, n: int) -> bool:
    """Whether text holds the last words of a shorter copy (of n characters) near the same place, and goes on behind them.

    The copy's very last word may be half of one there. The rule for one pair, in plain form; _ends_early() joins by it.
    """
    parts = tail.split(" ")
    if len(parts) < 4:
        return False
    known, half = parts[:-1], parts[-1]
    near = text[max(0, int(n * 0.7) - 200) : int(n * 1.3) + 200]
    tokens = _WORD.findall(near)
    k = len(known)
    for i in range(len(tokens) - k):
        if tokens[i] == known[0] and tokens[i : i + k] == known and tokens[i + k].startswith(half):
            return tokens[i + k] != half or i + k + 1 < len(tokens)
    return False


def cut_texts(docs: DataFrame) -> DataFrame:
    """(doc_id, evidence) of the texts that were cut: evidence is 'shape', 'limit', 'copy' or 'closing'.

    1. Shape: what a text shows by itself, see shape(). Texts that end at a stop or closer are whole.
    2. Copies: texts get minhash signatures over five-word shingles; a text meets the texts that share a band and hold its
       last words with more behind them, wherever in the text, so that it ends inside them. Of those that share SIMILAR of
       the union of their true shingles, one is enough: the text is cut (see _ends_early()).
    3. Closing words: how many of the lines that get as far as the text's last word, in the same context, end there.
       Counted over all lines of all documents, final lines once per different text, the text itself left out. Under
       TERMINAL it is cut, see _unclosed().

    4. Field limits: a length, in characters or bytes, at which a source has far more texts than at the lengths around it;
       texts of that length that don't end at a stop are cut.

    Null, empty and blank texts are no cases. Equal texts get the same answer. Rows with a null doc_id are left out.
    Texts themselves are only read, twice, whole batches at a time; what is shuffled is a row of numbers per text, and what
    others ask of it. Where several kinds of evidence agree, the first of shape, limit, copy, closing is named.
    """
    docs = docs.where("doc_id is not null and text is not null").select("doc_id", "text", "source")
    kinds = "doc_id long, source string, name long, n long, octets long, shape string, kind string, ctx2 long, ctx1 long, ctx0 long, word string, tail long, half string, bands array<long>, shingles int"
    read = cut(docs.mapInArrow(_read, kinds))
    texts = cut(read.groupBy("name").agg(*[F.min_by(c, "doc_id").alias(c) for c in ("source", "n", "octets", "shape", "kind", "ctx2", "ctx1", "ctx0", "word", "tail", "half", "bands", "shingles")], F.min("doc_id").alias("doc_id")))
    open_ones = texts.where("shape = 'open'")

    contexts = _sieve(open_ones.select(F.explode(F.array("ctx2", "ctx1", "ctx0")).alias("ctx")), "ctx")
    tails = _sieve(open_ones.where("tail is not null"), "tail")
    asked = cut(docs.select("text").mapInArrow(lambda batches: _asked(batches, contexts, tails), _ASKED))

    by_copy = _ends_early(docs, texts, open_ones, asked.where("tail is not null").select("tail", "name", F.col("word").alias("next"), "more"))
    by_word = _unclosed(texts, open_ones, asked.where("ctx is not null").select("ctx", "word", "n", "ends"))
    by_shape = texts.where("shape = 'cut'").select("name", F.lit("shape").alias("evidence"))
    sure = cut(by_shape.union(by_word))
    found = sure.union(by_copy).union(_at_limit(texts, sure)).groupBy("name").agg(F.max("evidence").alias("evidence"))
    return read.select("doc_id", "name").join(found, "name").select("doc_id", "evidence").distinct()


def _unclosed(texts: DataFrame, open_ones: DataFrame, grams: DataFrame) -> DataFrame:
    """(name, evidence) of open-ended texts whose closing word isn't one, by all lines of all documents.

    Of the lines that get as far as the word in its context, the share that ends there decides; contexts are the two words
    before it, one, or none, the longest with ENOUGH other occurrences. A whole word in a context that mostly ends
    lines, whatever the word, closes too. Outside prose a word with a comma is the end of a phrase, and no evidence; so is
    one with a full stop in a title or caption. A word never seen closes a title or list item, but not prose.
    """
    levels = F.array(*[F.struct(F.lit(i).alias("size"), F.col(f"ctx{i}").alias("ctx")) for i in (2, 1, 0)])
    asked = open_ones.select("name", "kind", "word", F.explode(levels).alias("c")).select("name", "kind", "word", "c.size", "c.ctx")
    finals = texts.select(F.explode(F.array("ctx2", "ctx1", "ctx0")).alias("ctx"), "word", F.lit(1).cast("long").alias("n"), F.lit(1).cast("long").alias("ends"))
    counted = cut(grams.union(finals).join(asked.select("ctx").distinct(), "ctx", "left_semi").groupBy("ctx", "word").agg(F.sum("n").alias("n"), F.sum("ends").alias("ends")))
    # words meet by up to five first letters, so a context with a large vocabulary isn't joined as a whole
    heads = asked.select("ctx", "kind", "word").distinct().withColumn("head", F.substring("word", 1, 5))
    starts = F.array_distinct(F.transform(F.sequence(F.lit(1), F.lit(5)), lambda i: F.substring(F.col("word"), F.lit(1), i)))
    known = counted.select("ctx", F.col("word").alias("w"), "n", "ends", F.explode(starts).alias("head"))
    bare = F.regexp_replace("w", r"(\.\.\.|…)$", "") == F.col("word")
    reach = heads.join(known, ["ctx", "head"]).where(F.col("w").startswith(F.col("word")) & ~((F.col("kind") != "p") & (F.col("w") == F.concat("word", F.lit(",")))) & ~((F.col("kind") == "t") & (F.col("w") == F.concat("word", F.lit("."))))).groupBy("ctx", "word").agg(
        F.sum("n").alias("n"), F.sum(F.when(bare, F.col("ends")).otherwise(0)).alias("ends"), F.sum(F.when(bare, F.col("n")).otherwise(0)).alias("same")
    )
    whole = counted.groupBy("ctx").agg(F.sum("n").alias("ctx_n"), F.sum("ends").alias("ctx_ends"))
    scored = asked.join(reach, ["ctx", "word"]).join(whole, "ctx").select(
        "name", "kind", "size", (F.col("n") - 1).alias("n"), (F.col("ends") - 1).alias("ends"), (F.col("same") - 1).alias("same"), (F.col("ctx_n") - 1).alias("ctx_n"), (F.col("ctx_ends") - 1).alias("ctx_ends")
    )
    closing_place = (F.col("size") > 0) & (F.col("ctx_n") >= ENOUGH) & (F.col("ctx_ends") >= F.col("ctx_n") * 0.5)
    whole_word = (F.col("size") == 0) & (F.col("same") >= F.greatest(F.lit(1), F.col("n") * 0.1))
    best = scored.groupBy("name", "kind").agg(
        F.max_by(F.struct("n", "ends"), F.when(F.col("n") >= ENOUGH, F.col("size") + 10).otherwise(F.col("size") - 10)).alias("m"), F.max(closing_place).alias("closing_place"), F.max(whole_word).alias("whole_word")
    )
    seen = F.col("m.n") >= ENOUGH
    closes = F.when(seen, F.col("m.ends") >= F.col("m.n") * TERMINAL).otherwise((F.col("m.n") == 0) & F.col("kind").isin("t", "b"))
    return best.where(~closes & ~(F.col("closing_place") & F.col("whole_word"))).select("name", F.lit("closing").alias("evidence"))


def _at_limit(texts: DataFrame, sure: DataFrame) -> DataFrame:
    """(name, evidence) of open-ended texts as long as their source's field limit.

    A limit has at least LIMIT_TEXTS different texts, LIMIT_TIMES as many as the 20 lengths around it have on average, and most
    of those that don't end at a stop are cut by other evidence: texts made to one pattern may well be equally long.
    """
    long = texts.where("source is not null").select("name", "source", "shape", F.explode(F.array(F.struct(F.lit("n").alias("unit"), F.col("n").alias("len")), F.struct(F.lit("octets").alias("unit"), F.col("octets").alias("len")))).alias("l"))
    long = long.select("name", "source", "shape", "l.unit", "l.len")
    counts = cut(long.groupBy("source", "unit", "len").agg(F.count(F.lit(1)).alias("k")))
    around = counts.select("source", "unit", F.explode(F.sequence(F.col("len") - 10, F.col("len") + 10)).alias("len"), F.col("k").alias("other"), F.col("len").alias("at"))
    near = around.groupBy("source", "unit", "len").agg(F.sum(F.when(F.col("at") != F.col("len"), F.col("other")).otherwise(0)).alias("near"))
    odd = long.where("shape <> 'closed'").join(sure.select("name", F.lit(1).alias("hit")).distinct(), "name", "left")
    odd = odd.groupBy("source", "unit", "len").agg(F.count(F.lit(1)).alias("open"), F.count("hit").alias("hits")).where("hits * 2 >= open")
    limits = counts.where(F.col("k") >= LIMIT_TEXTS).join(odd, ["source", "unit", "len"], "left_semi").join(near, ["source", "unit", "len"]).where(F.col("k") >= LIMIT_TIMES * F.col("near") / 20.0)
    return long.where("shape = 'open'").join(limits.select("source", "unit", "len"), ["source", "unit", "len"], "left_semi").select("name", F.lit("limit").alias("evidence")).distinct()


def _ends_early(docs: DataFrame, texts: DataFrame, open_ones: DataFrame, places: DataFrame) -> DataFrame:
    """(name, evidence) of open-ended texts that end inside a longer near-copy.

    places: tail, name, next, more - where a text holds a run of words. A text meets all places where a longer text of one of its
    bands holds its last words and goes on, its very last word being the next one or the beginning of it: band and
    words are one join key, so no partner is left out and the rest of a group of copies isn't looked at. First both sides are
    narrowed to those who meet anybody of about their size, then to those of a common band; only their shingles are then read. A semi-join stops at the first partner
    similar enough.
    """
    # sets that share so much differ by so little in size: their classes are the same or next to one another
    grade = F.floor(F.log(F.col("shingles").cast("double")) / F.log(F.lit(SIMILAR[1] / SIMILAR[0])))
    asks = open_ones.where("tail is not null").select("name", "n", "tail", "half", "bands", grade.alias("grade"))
    near = F.explode(F.sequence(F.col("grade") - 1, F.col("grade") + 1))
    wanted = asks.select("tail", "half", near.alias("their_grade"), "n").groupBy("tail", "half", "their_grade").agg(F.min("n").alias("least"))
    # of the words behind a place only beginnings as long as asked for are formed
    sizes = asks.select("tail", F.length("half").alias("size")).distinct()
    longer = (F.length("next") > F.col("size")) | ((F.length("next") == F.col("size")) & F.col("more"))
    held = places.join(sizes, "tail").where(longer).select("tail", F.expr("substring(next, 1, size)").alias("half"), F.col("name").alias("their")).distinct()
    whole = texts.select(F.col("name").alias("their"), F.col("n").alias("their_n"), grade.alias("their_grade"))
    held = cut(held.join(whole, "their").join(wanted, ["tail", "half", "their_grade"]).where("their_n > least").drop("least"))
    theirs = held.groupBy("tail", "half", F.col("their_grade").alias("grade_met")).agg(F.max("their_n").alias("most"))
    asks = asks.select("*", near.alias("grade_met")).join(theirs, ["tail", "half", "grade_met"]).where("most > n").drop("grade_met", "most", "grade").dropDuplicates(["name"])
    held = held.drop("their_grade").join(texts.select(F.col("name").alias("their"), F.col("bands").alias("their_bands")), "their")
    keyed = lambda df, bands: df.withColumn("band", F.explode(bands)).drop(bands)

    def meets(a: DataFrame, b: DataFrame, also: Column) -> DataFrame:
        a, b = a.alias("a"), b.alias("b")
        same = (F.col("a.band") == F.col("b.band")) & (F.col("a.tail") == F.col("b.tail")) & (F.col("a.half") == F.col("b.half"))
        return a.join(b, same & (F.col("their_n") > F.col("n")) & also, "left_semi")

    mine, theirs = keyed(asks, "bands"), keyed(held, "their_bands")
    some = cut(meets(mine, theirs, F.lit(True)))
    others = cut(meets(theirs, some, F.lit(True)))
    involved = some.select("name").union(others.select("their")).distinct().join(texts.select("name", "doc_id"), "name").select("doc_id")
    shingles = cut(docs.select("doc_id", "text").join(small_or_not(cut(involved)), "doc_id", "left_semi").select("text").mapInArrow(_shingled, "name long, shingles array<long>").dropDuplicates(["name"]))
    both = F.size(F.array_intersect("shingles", "their_shingles")).cast("long")
    alike = both * SIMILAR[1] >= (F.size("shingles") + F.size("their_shingles") - both) * SIMILAR[0]
    verified = meets(some.join(shingles, "name"), others.join(shingles.toDF("their", "their_shingles"), "their"), alike)
    return verified.select("name", F.lit("copy").alias("evidence")).distinct()


def cut_rates(docs: DataFrame, found: DataFrame) -> DataFrame:
    """(source, n_docs, n_cut, cut_rate): how often each source cuts texts; a null source is a source of its own."""
    marked = docs.join(found.select(F.col("doc_id").alias("__id"), F.lit(1).alias("__cut")).distinct(), F.col("doc_id") == F.col("__id"), "left")
    rates = marked.groupBy("source").agg(F.count(F.lit(1)).alias("n_docs"), F.count("__cut").alias("n_cut"))
    return rates.select("source", "n_docs", "n_cut", (F.col("n_cut") / F.col("n_docs")).alias("cut_rate"))
