"""BPE encoding and decoding as a bounded-lookahead streaming transducer.

Encoding. A pre-token's symbols arrive one by one. A merge of rank r at some place can only be
prevented from the right by a merge of lower rank that takes the symbol at its right edge, and
that one only by another of still lower rank, so what decides a token lies within a fixed
number of symbols of its start. lookahead() computes that number from the merge list. The
transducer merges a window of pending symbols, emits the tokens that start far enough from the window's
end, and keeps the rest; a token boundary of the result splits the merging into independent
halves, so going on from there is exact. Memory is bounded by the lookahead, however long a
pre-token is.

Decoding. Tokens pass one at a time through a state machine that holds at most one unfinished
UTF-8 character. Its plain form writes the tokens themselves, joined by one space, which is what the library does where its file
names no decoder. Both forms begin anew at a word, so the ids and decoded forms of short pre-tokens are remembered together; a text is taken in parts
that end behind white space, so neither all its words nor all its tokens are held at once.

Null and empty texts have no ids and decode to the empty text. Each row is taken by itself:
ties, repeated rows and equal ids change nothing, and an empty table gives an empty one.
"""

from __future__ import annotations

import codecs
import hashlib
import heapq
import json
import unicodedata
from bisect import bisect_left

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tessera.llm.base import append_columns, parts_of
from tessera.llm.token_counts import vocabulary_path

#: White space of the Unicode standard. str.split() also takes U+001C to U+001F.
SPACE = "\t\n\x0b\x0c\r \x85\xa0                　"
ODD = regex.compile("[\x1c-\x1f]")


def byte_letters() -> list[str]:
    """The letter that stands for each byte in byte-level vocabularies."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    letters = {b: chr(b) for b in shown}
    for b in range(256):
        if b not in letters:
            letters[b] = chr(0x100 + len(letters) - len(shown))
    return [letters[b] for b in range(256)]


class Vocabulary:
    """Merges and ids of a tokenizers file with byte-level BPE and an end-of-word suffix."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            whole = json.load(f)
        model = whole["model"]
        self.ids = model["vocab"]
        self.suffix = model["end_of_word_suffix"] or ""
        self.tokens = {i: t for t, i in self.ids.items()}
        self.special = {t["content"]: t["id"] for t in whole["added_tokens"]}
        self.tokens.update({i: t for t, i in self.special.items()})
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.merges = {(self.ids[a], self.ids[b]): (rank, self.ids[a + b]) for rank, (a, b) in enumerate(pairs)}
        self.splits = {new: (a, b, rank) for (a, b), (rank, new) in reversed(self.merges.items())}
        letters = byte_letters()
        self.inner = [self.ids[c] for c in letters]
        self.last = [self.ids[c + self.suffix] for c in letters]
        self.bytes_of = {c: b for b, c in enumerate(letters)}
        pattern = next(p["pattern"]["Regex"] for p in whole["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.pattern = regex.compile(pattern)
        self.lookahead = self._lookahead()

    def length(self, token: str) -> int:
        return len(token.removesuffix(self.suffix)) if self.suffix else len(token)

    def _lookahead(self) -> int:
        """Symbols after a token's start that suffice to decide that token.

        reach(m), in order of rank, is how far the decision on merge m = (u, v) can look from
        the start of u: over uv itself, and from each symbol t on the right edge of uv, which a
        merge of rank c takes, over every merge (t, w) of lower rank than c.
        """
        size = {i: self.length(t) for t, i in self.ids.items()}
        at: dict[int, tuple[list[int], list[int]]] = {}  # left symbol -> ranks, furthest reach so far

        def furthest(t: int, below: float) -> int:
            ranks, reach = at.get(t, ((), ()))
            i = bisect_left(ranks, below)
            return reach[i - 1] if i else 0

        def over(token: int, taken: float) -> int:
            whole = far = size[token]
            t = token
            while True:
                far = max(far, whole - size[t] + furthest(t, taken))
                if t not in self.splits:
                    return far
                _, right, taken = self.splits[t]
                t = right

        for (a, b), (rank, new) in self.merges.items():
            far = max(size[new], size[a] + over(b, rank))
            ranks, reach = at.setdefault(a, ([], []))
            ranks.append(rank)
            reach.append(max(far, reach[-1] if reach else 0))
        return max(over(i, float("inf")) for i in size) + 1

    def merged(self, symbols: list[int]) -> list[int]:
        """All merges applied: the lowest rank first, of equal ranks the leftmost."""
        return self._few(symbols) if len(symbols) <= 24 else self._many(symbols)

    def _few(self, symbols: list[int]) -> list[int]:
        """By looking over all pairs for each merge, which is the faster way for a word."""
        ids, find = list(symbols), self.merges.get
        pairs = [find(p) for p in zip(ids, ids[1:], strict=False)]
        while True:
            best, at = None, -1
            for i, m in enumerate(pairs):
                if m is not None and (best is None or m[0] < best):
                    best, at = m[0], i
            if at < 0:
                return ids
            ids[at : at + 2] = [pairs[at][1]]
            del pairs[at]
            if at:
                pairs[at - 1] = find((ids[at - 1], ids[at]))
            if at < len(pairs):
                pairs[at] = find((ids[at], ids[at + 1]))

    def _many(self, symbols: list[int]) -> list[int]:
        """By a heap of the pairs that can merge."""
        n = len(symbols)
        ids, after, before = list(symbols), [*range(1, n), -1], [*range(-1, n - 1)]
        heap = [(self.merges[p][0], i, p) for i, p in enumerate(zip(ids, ids[1:], strict=False)) if p in self.merges]
        heapq.heapify(heap)
        while heap:
            _, i, pair = heapq.heappop(heap)
            j = after[i]
            if ids[i] != pair[0] or j < 0 or ids[j] != pair[1]:
                continue
            ids[i], ids[j] = self.merges[pair][1], -1
            after[i] = k = after[j]
            if k >= 0:
                before[k] = i
                if (p := (ids[i], ids[k])) in self.merges:
                    heapq.heappush(heap, (self.merges[p][0], i, p))
            if (h := before[i]) >= 0 and (p := (ids[h], ids[i])) in self.merges:
                heapq.heappush(heap, (self.merges[p][0], h, p))
        return [t for t in ids if t >= 0]


class Transducer:
    """Symbols of one pre-token in, tokens out as soon as they are stable."""

    def __init__(self, vocabulary: Vocabulary):
        self.v, self.window = vocabulary, max(64, 4 * vocabulary.lookahead)
        self.pending: list[int] = []

    def push(self, data: bytes) -> list[int]:
        """The tokens that are stable once data is read; no more than a window's bytes are held."""
        out, at = [], 0
        while at < len(data):
            more = data[at : at + self.window + 1 - len(self.pending)]
            self.pending.extend(more)
            at += len(more)
            if len(self.pending) > self.window:
                out.extend(self._stable())
        return out

    def _stable(self):
        """Tokens that start at least the lookahead before the window's end, whose last byte may be any."""
        tokens = self.v.merged([self.v.inner[b] for b in self.pending])
        done, limit = 0, len(self.pending) - self.v.lookahead
        for t in tokens:
            size = self.v.length(self.v.tokens[t])
            if done + size > limit:
                break
            yield t
            done += size
        del self.pending[:done]

    def close(self) -> list[int]:
        if not self.pending:
            return []
        out = self.v.merged([*(self.v.inner[b] for b in self.pending[:-1]), self.v.last[self.pending[-1]]])
        self.pending.clear()
        return out


class Decoder:
    """Tokens in, characters out; holds at most one unfinished character. plain: the tokens as they are, joined by one space."""

    def __init__(self, vocabulary: Vocabulary, plain: bool = False):
        self.v, self.state = vocabulary, codecs.getincrementaldecoder("utf-8")("replace")
        self.plain, self.begun = plain, False

    def push(self, token: int) -> str:
        name = self.v.tokens[token]
        if self.plain:
            gap, self.begun = " " * self.begun, True
            return gap + name
        if name in self.v.special:
            return self.state.decode(b"", True) + name
        ends = bool(self.v.suffix) and name.endswith(self.v.suffix)
        body = name.removesuffix(self.v.suffix) if ends else name
        return self.state.decode(bytes(self.v.bytes_of[c] for c in body), ends) + " " * ends

    def close(self) -> str:
        self.begun = False
        return self.state.decode(b"", True)


class Codec:
    """Whole texts to ids and back, with a bounded memory of short words and of the pre-tokens they are made of."""

    def __init__(self, path: str, memory: int = 300_000):
        self.v = Vocabulary(path)
        self.special = regex.compile("(" + "|".join(regex.escape(s) for s in sorted(self.v.special, key=len, reverse=True)) + ")")
        self.marks = {s[0] for s in self.v.special}
        self.memory, self.known, self.pieces = memory, {}, {}
        self.moving, self.plain = Transducer(self.v), Decoder(self.v, True)

    def words(self, text: str):
        """Lists of the runs without white space, a part of the text at a time."""
        for part in parts_of(text):
            yield [w for w in regex.split(f"[{SPACE}]+", part) if w] if ODD.search(part) else part.split()

    def pre_tokens(self, word: str) -> list[str | int]:
        """A run without white space as special ids and lower-case pre-tokens."""
        out: list[str | int] = []
        for part in self.special.split(word) if not self.marks.isdisjoint(word) and self.special.search(word) else (word,):
            if part in self.v.special:
                out.append(self.v.special[part])
                continue
            if part.isascii():
                part = part.lower()
                if part.isalpha():  # which the pattern takes whole
                    out.append(part)
                    continue
            else:
                # Each letter is lowered by itself: no rule for a sigma at a word's end.
                part = unicodedata.normalize("NFC", part).replace("Σ", "σ").lower()
            out += self.v.pattern.findall(part)
        return out

    def encode_piece(self, piece: str | int) -> list[int]:
        if isinstance(piece, int):
            return [piece]
        self.moving.pending.clear()
        return [*self.moving.push(piece.encode("utf-8", "replace")), *self.moving.close()]

    def told(self, ids: list[int]) -> tuple[int, str, str]:
        """Number of ids, the ids joined by one space, and what they decode to in plain form."""
        text = "".join(map(self.plain.push, ids))
        self.plain.close()
        return len(ids), " ".join(map(str, ids)), text

    def piece(self, piece: str | int) -> tuple[int, str, str]:
        found = self.pieces.get(piece)
        if found is None:
            found = self.told(self.encode_piece(piece))
            if isinstance(piece, int) or len(piece) <= 64:
                if len(self.pieces) >= self.memory:
                    self.pieces.clear()
                self.pieces[piece] = found
        return found

    def entry(self, word: str) -> tuple[int, str, str]:
        """told() of a word's ids."""
        parts = [self.piece(p) for p in self.pre_tokens(word)]
        found = parts[0] if len(parts) == 1 else (sum(p[0] for p in parts), " ".join([p[1] for p in parts]), " ".join([p[2] for p in parts]))
        if len(word) <= 64:
            if len(self.known) >= self.memory:
                self.known.clear()
            self.known[word] = found
        return found

    def digest(self, text: str) -> tuple[int, str, str]:
        """Number of ids and the digests of ids and decoded text; only a part of the text's words is held at once."""
        n, ids_hash, text_hash, begun, known = 0, hashlib.sha256(), hashlib.sha256(), "", self.known
        for words in self.words(text):
            found = [known.get(w) or self.entry(w) for w in words]
            found = [x for x in found if x[0]]
            if not found:
                continue
            n += sum([x[0] for x in found])
            ids_hash.update((begun + " ".join([x[1] for x in found])).encode())
            text_hash.update((begun + " ".join([x[2] for x in found])).encode())
            begun = " "
        return n, ids_hash.hexdigest(), text_hash.hexdigest()

    def encode(self, text: str) -> list[int]:
        return [i for words in self.words(text) for w in words for p in self.pre_tokens(w) for i in self.encode_piece(p)]

    def decode(self, ids: list[int], plain: bool = False) -> str:
        """The text that ids stand for: bytes through the state machine, a space after each word. plain: the library's form."""
        machine = Decoder(self.v, plain)
        return "".join([*map(machine.push, ids), machine.close()])


def encode_decode(docs: DataFrame, vocabulary: str, text: str = "text", ids: bool = False) -> DataFrame:
    """docs with n_tokens, ids_sha256 and decoded_sha256; with ids=True also token_ids and decoded."""
    at = docs.columns.index(text)
    fields = [T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())]
    if ids:
        fields += [T.StructField("token_ids", T.ArrayType(T.IntegerType())), T.StructField("decoded", T.StringType())]

    def make():
        codec = Codec(vocabulary_path(vocabulary))

        def work(batch: pa.RecordBatch) -> list[pa.Array]:
            texts = [t or "" for t in batch.column(at).to_pylist()]
            made = [codec.digest(t) for t in texts]
            out = [pa.array([x[0] for x in made], pa.int64()), pa.array([x[1] for x in made], pa.string()), pa.array([x[2] for x in made], pa.string())]
            if ids:
                lists = [codec.encode(t) for t in texts]
                out += [pa.array(lists, pa.list_(pa.int32())), pa.array([codec.decode(x) for x in lists], pa.string())]
            return out

        return work

    return append_columns(docs, fields, make)
