"""Exact byte-level BPE by backtracking over longest token matches.

An Aho-Corasick automaton finds the longest token at every position.  A token may
follow another only if merging could not have crossed their border; that is
decided from the merge table once per pair and kept.  When no compatible token
fits, the encoder falls back to the next shorter prefix token or steps back, and
never tries a position twice: linear time, the same merges as BPE by rank.

Decoding looks up an offset table over one string of all token bytes.
"""

from __future__ import annotations

import functools
import hashlib
import json
import re
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.shared import give_back_memory

_CACHE = 300_000


def _byte_letters() -> dict[str, int]:
    """The byte-level alphabet: printable Latin-1 bytes stand for themselves, the rest from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class BytePairCodec:
    """Encoder and decoder of a byte-level vocabulary file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = _byte_letters()
        to_bytes = lambda s: bytes(letters[c] for c in s)
        self.ids = {to_bytes(s): i for s, i in spec["model"]["vocab"].items()}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        pairs = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        #: (left id, right id) -> rank; rank of a token is that of the merge that makes it.
        self.merge: dict[tuple[int, int], int] = {}
        self.parts: dict[int, tuple[int, int]] = {}
        for rank, (a, b) in enumerate(pairs):
            left, right = to_bytes(a), to_bytes(b)
            made = self.ids[left + right]
            pair = (self.ids[left], self.ids[right])
            self.merge.setdefault(pair, rank)
            self.parts.setdefault(made, pair)
        self.rank = {t: self.merge[p] for t, p in self.parts.items()}
        self.automaton = ahocorasick.Automaton()
        self.by_id: dict[int, bytes] = {}
        for raw, i in self.ids.items():
            self.by_id[i] = raw
            if len(raw) == 1 or i in self.parts:
                self.automaton.add_word(raw.decode("latin-1"), (len(raw), i))
        self.automaton.make_automaton()
        size = max(*self.by_id, *self.special.values()) + 1
        blobs = [self.by_id.get(i, b"") for i in range(size)]
        for text, i in self.special.items():
            blobs[i] = text.encode()
        self.blob = np.frombuffer(b"".join(blobs), np.uint8)
        self.offset = np.concatenate(([0], np.cumsum([len(b) for b in blobs]))).astype(np.int64)
        self.pattern = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
        self.loose = re.compile(r"[^\S ]|  |^ | $")
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.shorter: dict[int, int | None] = {}
        self.fits: dict[tuple[int, int], bool] = {}
        self.known: dict[str, tuple[int, ...]] = {}  # pretokens

    def _next_prefix(self, token: int) -> int | None:
        """The longest token that is a proper prefix of ``token``."""
        if token not in self.shorter:
            raw = self.by_id[token]
            self.shorter[token] = next((t for n in range(len(raw) - 1, 0, -1) if (t := self.ids.get(raw[:n])) is not None and (n == 1 or t in self.parts)), None)
        return self.shorter[token]

    def _compatible(self, left: int, right: int) -> bool:
        """Whether BPE leaves ``left`` and ``right`` side by side: no merge across their border wins.

        The pieces at the border are undone from the latest merge back; a merge of
        the facing pieces beats them if it ranks before the merges that used them up.
        """
        key = (left, right)
        if key in self.fits:
            return self.fits[key]
        limit = float("inf")
        rank = lambda t: self.rank.get(t, -1)
        a, b, good = left, right, True
        while True:
            across = self.merge.get((a, b))
            if across is not None and across < limit:
                good = False
                break
            ra, rb = rank(a), rank(b)
            if ra < 0 and rb < 0:
                break
            # Undo the later merge.  Left-to-right ties: on equal rank the left one was made first.
            if ra > rb:
                limit, a = ra, self.parts[a][1]
            else:
                limit, b = rb + 0.5, self.parts[b][0]
        if len(self.fits) >= _CACHE:
            self.fits.clear()
        self.fits[key] = good
        return good

    def _pretoken(self, raw: bytes) -> tuple[int, ...]:
        whole = self.ids.get(raw)
        n = len(raw)
        if whole is not None and n == 1:
            return (whole,)
        longest: list[int] = [-1] * n
        reach = [0] * n
        for end, (size, token) in self.automaton.iter(raw.decode("latin-1")):
            at = end - size + 1
            if size > reach[at]:
                reach[at], longest[at] = size, token
        out: list[int] = []
        dead = bytearray(n + 1)
        at, token = 0, longest[0]
        by_id = self.by_id
        while True:
            stop = at + len(by_id[token])
            if not dead[stop] and (not out or self._compatible(out[-1], token)):
                out.append(token)
                at = stop
                if at == n:
                    return tuple(out)
                token = longest[at]
                continue
            shorter = self._next_prefix(token)
            while shorter is None:
                dead[at] = 1
                back = out.pop()
                at -= len(by_id[back])
                shorter = self._next_prefix(back)
            token = shorter

    def _piece(self, text: str) -> tuple[int, ...]:
        """Ids of a stretch that the pattern never joins with its neighbours."""
        made: list[int] = []
        for word in self.pattern.findall(text):
            made += self._kept(word)
        return tuple(made)

    def _kept(self, word: str) -> tuple[int, ...]:
        """Ids of one pretoken, looked up if it was met before; white space alone is not kept."""
        ids = self.known.get(word)
        if ids is None:
            ids = self._pretoken(word.encode("utf-8"))
            if len(word) <= 64 and not word[-1].isspace():
                if len(self.known) >= _CACHE:
                    self.known.clear()
                self.known[word] = ids
        return ids

    def _word(self, piece: str, word: str) -> tuple[int, ...]:
        """Ids of ``piece``, which is ``word`` with or without a space before it.

        Letters are one pretoken and a mark after them is another: no pattern is
        needed for them, and a word is kept once for all marks that follow it.
        """
        if word.isascii():
            if word.isalpha():
                return self._kept(piece)
            if word[-1] in ".,;:!?" and word[:-1].isalpha():
                return self._kept(piece[:-1]) + self._kept(word[-1])
        return self._piece(piece)

    def encode(self, text: str) -> list[int]:
        """Ids of a whole text; the vocabulary's special strings give their own ids."""
        if self.cut is not None and self.cut.search(text):
            out: list[int] = []
            for part in self.cut.split(text):
                out += [self.special[part]] if part in self.special else self.encode(part) if part else []
            return out
        out = []
        known = self.known
        first = True
        # A single space between two other characters always starts a pretoken.
        for word in text.split(" ") if "  " not in text else self._stretches(text):
            piece = word if first else " " + word
            first = False
            ids = known.get(piece)
            if ids is None:
                if not word or word[0].isspace() or word[-1].isspace():
                    return list(self._piece(text)) if len(text) < 1 << 20 else [i for w in self.pattern.findall(text) for i in self._kept(w)]
                ids = self._word(piece, word)
            out += ids
        return out

    def _stretches(self, text: str) -> list[str]:
        return [""]  # makes encode() take the whole text through the pattern

    def decode_bytes(self, ids: np.ndarray) -> bytes:
        """Bytes of ``ids`` by gathering from the offset table."""
        if not len(ids):
            return b""
        start = self.offset[ids]
        size = self.offset[ids + 1] - start
        ends = np.cumsum(size)
        shift = np.repeat(start - (ends - size), size)
        shift += np.arange(ends[-1])
        return self.blob[shift].tobytes()

    def decode(self, ids) -> str:
        return self.decode_bytes(np.asarray(ids, np.int64)).decode("utf-8", errors="replace")


@functools.lru_cache(maxsize=4)
def codec(path: str) -> BytePairCodec:
    return BytePairCodec(path)


def encode_table(docs: DataFrame, path: str, text_col: str = "text", ids_col: str = "ids") -> DataFrame:
    """``docs`` with a column ``ids_col`` of token ids; null text encodes as empty.

    A column of that name is replaced, all others stay; repeated rows stay repeated.
    """
    kept = docs.drop(ids_col)
    schema = kept.withColumn(ids_col, F.array().cast("array<int>")).schema
    names = [f.name for f in schema]
    text_at = kept.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = codec(path)
        for batch in batches:
            made = pa.array([bpe.encode(t.as_py() or "") for t in batch.column(text_at)], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([*batch.columns, made], names)

    return kept.mapInArrow(run, schema)


def decode_table(tokens: DataFrame, path: str, ids_col: str = "ids", text_col: str = "decoded") -> DataFrame:
    """``tokens`` with a column ``text_col`` decoded from ``ids_col``; null ids give null."""
    kept = tokens.drop(text_col)
    schema = kept.withColumn(text_col, F.lit("")).schema
    names = [f.name for f in schema]
    at = kept.columns.index(ids_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = codec(path)
        for batch in batches:
            lists = batch.column(at)
            made = [bpe.decode(x.values.to_numpy().astype(np.int64)) if x.is_valid else None for x in lists]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(made, pa.string())], names)

    return kept.mapInArrow(run, schema)


def round_trip_digests(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256): each text encoded, then its ids decoded.

    A null text is empty and has no tokens.  Texts of any length are encoded whole;
    repeated rows give repeated rows, null ids stay null, other columns are not read,
    an empty table gives an empty result.
    """
    schema = docs.select(F.col(id_col), F.lit(0).cast("long").alias("n_tokens"), F.lit("").alias("ids_sha256"), F.lit("").alias("decoded_sha256")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back_memory()  # of earlier tasks
        bpe = codec(path)
        sha = hashlib.sha256
        decimal = [str(i) for i in range(len(bpe.offset) - 1)]
        for batch in batches:
            counts, listed, decoded = [], [], []
            for text in batch.column(1):
                ids = bpe.encode(text.as_py() or "")
                counts.append(len(ids))
                listed.append(sha(",".join([decimal[i] for i in ids]).encode()).hexdigest())
                decoded.append(sha(bpe.decode(ids).encode("utf-8")).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(listed), pa.array(decoded)], schema.names)

    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(run, schema)
