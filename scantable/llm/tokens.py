"""Sizes of texts in tokens of a public tokenizer."""

from __future__ import annotations

import base64
import functools
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

#: Where the vocabulary files are; a parameter everywhere.
VOCABULARY = os.environ.get("SCANTABLE_TOKENIZER", "/opt/tokenizers/byte_bpe_50k.tiktoken")
#: Characters a tokenizer gets at once, as a rule: pre-tokens of enormous length cost quadratic time.
PIECE = 100_000
# where a pre-token surely ends, whatever comes before and behind: ahead of white space, and behind a run of letters or of digits
_END = r"(?<=\S)(?=\s)|(?<=\p{L})(?=\P{L})|(?<=\p{N})(?=\P{N})"
_LAST_END, _NEXT_END = regex.compile("(?r)" + _END), regex.compile(_END)


@functools.lru_cache(maxsize=4)
def _encoder(path: str):
    import tiktoken

    # fixed value: the published splitting pattern of the 50k byte-level BPE vocabulary
    pattern = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"""
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def count_tokens(text: str | None, path: str = VOCABULARY) -> int:
    """Tokens of the whole text; 0 for null and empty."""
    if not text:
        return 0
    enc = _encoder(path)
    if len(text) <= PIECE:
        return len(enc.encode_ordinary(text))
    total, at = 0, 0
    while at < len(text):
        end = len(text)
        if end - at > PIECE:
            # the last certain end within the piece, else the next one behind it: the sum is that of the whole text
            found = _LAST_END.search(text, at + 1, at + PIECE) or _NEXT_END.search(text, at + PIECE)
            end = found.start() if found else end
        total += len(enc.encode_ordinary(text[at:end]))
        at = end
    return total


def with_tokens(df: DataFrame, text: str, keep: list[str], name: str = "n_tokens", path: str = VOCABULARY) -> DataFrame:
    """keep and the tokens of the text, counted in the map task that reads it: texts aren't shuffled."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = [count_tokens(t.as_py(), path) for t in batch.column(text)]
            cols = [batch.column(k) for k in keep]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(np.array(n, dtype=np.int64))], names=[*keep, name])

    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for k in keep for f in df.schema if f.name == k)
    return df.select(*keep, *([] if text in keep else [text])).mapInArrow(count, f"{kept}, {name} long")
