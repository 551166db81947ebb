"""Token counts: batch encoding in Arrow functions that returns lengths only.

A text is split where a character that isn't white space meets a space, tab or line end. The
byte-level pattern never joins two such sides (a token of the pattern is one run of white
space, or at most one space and a run without any), and nothing in it looks back, so the
pieces' counts add up to the text's. The pieces of a batch that are not yet known go to the
library together, in batches balanced by UTF-8 bytes; counts of short pieces are remembered.
Control characters that Python calls white space and the pattern doesn't are never a side of a boundary.
Long texts are cut into parts of about the batch's bytes at such boundaries, or where a letter of a common script meets a figure
or a mark, which no token of the pattern spans either; a text without any of these goes to the library whole.

Null and empty texts have no bytes and no tokens. Rows are taken one by one: repeated rows
and equal ids each get a row, an empty table gives an empty one, and columns of the input
stay, but for those named like an output, which are replaced.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tessera.llm.base import append_columns

FIELDS = [T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("over_limit", T.BooleanType())]
ODD_SPACE = re.compile("[\x1c-\x1f\u180e]")
PIECE = re.compile(r"\s*\S+|\s+")
BOUNDARY = re.compile("(?<=[^\\s\x1c-\x1f\u180e])(?=[ \t\n\r])")
LETTER = "A-Za-z\u0430-\u044f\u0e01-\u0e30\u3041-\u3096\u30a1-\u30fa\u4e00-\u9fa5\uac00-\ud7a3"
SAFE = re.compile(f"[^\\s\x1c-\x1f\u180e](?=[ \t\n\r])|[{LETTER}](?=[0-9!-/:-@\u3001\u3002\uff0c])|[0-9](?=[{LETTER}!-/:-@\u3001\u3002\uff0c])")


def size_of(text: str) -> int:
    """UTF-8 bytes."""
    return len(text) if text.isascii() else len(text.encode("utf-8", "surrogatepass"))


def by_bytes(texts: Iterable[str], limit: int) -> Iterator[list[str]]:
    """Texts in runs of about limit bytes."""
    run, size = [], 0
    for text in texts:
        run.append(text)
        size += size_of(text)
        if size >= limit:
            yield run
            run, size = [], 0
    if run:
        yield run


def slices(text: str, limit: int) -> Iterator[str]:
    """Parts of a long text, cut at the first safe boundary after about each limit of bytes."""
    size = size_of(text)
    if size <= limit:
        yield text
        return
    step, at = max(1, limit * len(text) // size), 0
    while at < len(text):
        cut = SAFE.search(text, at + step) if at + step < len(text) else None
        end = cut.end() if cut else len(text)
        yield text[at:end]
        at = end


def pieces_of(part: str) -> list[str]:
    return BOUNDARY.split(part) if ODD_SPACE.search(part) else PIECE.findall(part)


class Counter:
    """Counts of whole texts, with a bounded memory of short pieces."""

    def __init__(self, path: str, batch_bytes: int, memory: int = 300_000):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.batch_bytes, self.memory, self.known = batch_bytes, memory, {}

    def encode(self, pieces: list[str]) -> list[int]:
        out = []
        for run in by_bytes(pieces, self.batch_bytes):
            out += [len(e) for e in self.library.encode_batch_fast(run, add_special_tokens=False)]
        return out

    def counts(self, texts: list[str]) -> list[int]:
        cut = [(i, part) for i, text in enumerate(texts) for part in slices(text, self.batch_bytes)]
        out = [0] * len(texts)
        for run in by_bytes([part for _, part in cut], self.batch_bytes):
            owners, cut = cut[: len(run)], cut[len(run) :]
            pieces = [pieces_of(part) for part in run]
            new = list(set().union(*pieces).difference(self.known))
            if len(self.known) + len(new) > self.memory:
                self.known.clear()
                new = list(set().union(*pieces))
            seen = dict(zip(new, self.encode(new), strict=True))
            self.known.update((p, n) for p, n in seen.items() if len(p) <= 64)
            far = {p: n for p, n in seen.items() if len(p) > 64}
            find = self.known.__getitem__
            if far:
                find = lambda p, f=far, k=self.known: f[p] if p in f else k[p]
            for (i, _), own in zip(owners, pieces, strict=True):
                out[i] += sum(map(find, own))
        return out


def count_tokens(docs: DataFrame, vocabulary: str, text: str = "text", limit: int = 1024, batch_bytes: int = 1 << 20) -> DataFrame:
    """docs with n_bytes, n_tokens and over_limit (n_tokens > limit).

    vocabulary is the path of a tokenizers file, or of one of public_tokenizers by its name.
    """
    at = docs.columns.index(text)

    def make():
        counter = Counter(vocabulary_path(vocabulary), batch_bytes)

        def work(batch: pa.RecordBatch) -> list[pa.Array]:
            texts = [t or "" for t in batch.column(at).to_pylist()]
            counts = counter.counts(texts)
            return [
                pa.array([size_of(t) for t in texts], pa.int64()),
                pa.array(counts, pa.int64()),
                pa.array([n > limit for n in counts], pa.bool_()),
            ]

        return work

    return append_columns(docs, FIELDS, make)


def vocabulary_path(name: str) -> str:
    if "/" in name:
        return name
    import public_tokenizers

    return public_tokenizers.path(name)
