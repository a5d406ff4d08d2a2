"""Token-id files of patched frame-of-reference blocks.

A file holds the ids of some documents, in order:

    "LPFOR1\\0\\0" | block payloads | footer | footer length (u64) | "LPFOR1\\0\\0"

Ids are cut into blocks of 512.  A block subtracts its minimum and packs the
remainders at the width that covers the 95th percentile, 64 values into as many
little-endian 64-bit words as the width has bits; larger values keep their
low bits in place and put position (u16) and high part (u32) into the block's
exception list.  The footer (compressed) has, per block, its start in the file,
minimum, width and number of exceptions, and per document its id and length, so
any range of ids is read from the blocks it touches.
"""

from __future__ import annotations

import functools
import io
import string
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lectern.llm.shared import fresh_folder, opened, publish, whole_text, written

MAGIC = b"LPFOR1\0\0"
BLOCK = 512
_SHARE = 0.95
_CHUNK = 128  # blocks packed at once


def _widths(rest: np.ndarray) -> np.ndarray:
    """Bits that cover the 95th percentile of each row."""
    at = int(np.ceil(_SHARE * (rest.shape[1] - 1)))
    high = np.partition(rest, at, axis=1)[:, at]
    return np.ceil(np.log2(high.astype(np.float64) + 1)).astype(np.uint8)


def _shifts(width: int) -> Iterator[tuple[int, int, int]]:
    """(value, word, shift) of 64 values packed at ``width`` bits into ``width`` words; negative shifts spill over."""
    for j in range(64):
        word, low = divmod(j * width, 64)
        yield j, word, low
        if low + width > 64:
            yield j, word + 1, low - 64


def _packed(values: np.ndarray, width: int) -> np.ndarray:
    """The low ``width`` bits of rows of a multiple of 64 values, as little-endian 64-bit words."""
    cells = (values & np.uint32((1 << width) - 1)).reshape(-1, 64).T.astype(np.uint64)
    words = np.zeros((width, cells.shape[1]), np.uint64)
    for j, word, shift in _shifts(width):
        words[word] |= cells[j] << np.uint64(shift) if shift >= 0 else cells[j] >> np.uint64(-shift)
    return np.ascontiguousarray(words.T).astype("<u8").reshape(len(values), -1)


def _unpacked(words: np.ndarray, width: int) -> np.ndarray:
    """The values of ``_packed``, row by row."""
    columns = np.ascontiguousarray(words.reshape(-1, width).T).astype(np.uint64)
    cells = np.zeros((64, columns.shape[1]), np.uint64)
    for j, word, shift in _shifts(width):
        cells[j] |= columns[word] >> np.uint64(shift) if shift >= 0 else columns[word] << np.uint64(-shift)
    return (cells.T & np.uint64((1 << width) - 1)).astype(np.uint32).reshape(len(words), -1)


def _packed_bytes(n, width):
    return -(-n // 64) * 8 * width


def pack_blocks(ids: np.ndarray) -> Iterator[tuple[bytes, int, int, int]]:
    """(payload, minimum, width, exceptions) for each full or last block of ``ids`` (uint32)."""
    for at in range(0, len(ids), BLOCK * _CHUNK):
        part = ids[at : at + BLOCK * _CHUNK]
        full = len(part) // BLOCK
        groups = [part[: full * BLOCK].reshape(full, BLOCK)] if full else []
        groups += [part[full * BLOCK :].reshape(1, -1)] if len(part) % BLOCK else []
        for rows in groups:
            low = rows.min(axis=1)
            rest = rows - low[:, None]
            widths = _widths(rest)
            out: list[tuple[bytes, int, int, int]] = [(b"", 0, 0, 0)] * len(rows)
            room = -rest.shape[1] % 64
            for w in np.unique(widths).tolist():
                own = np.flatnonzero(widths == w)
                mine = rest[own]
                packed = _packed(np.pad(mine, ((0, 0), (0, room))), w) if w else np.zeros((len(own), 0), "<u8")
                over = mine >> np.uint32(w) if w < 32 else np.zeros_like(mine)
                row, place = np.nonzero(over)
                places, highs = place.astype("<u2").tobytes(), over[row, place].astype("<u4").tobytes()
                cuts = np.searchsorted(row, np.arange(len(own) + 1)).tolist()
                for k, i in enumerate(own.tolist()):
                    a, b = cuts[k], cuts[k + 1]
                    out[i] = (packed[k].tobytes() + places[2 * a : 2 * b] + highs[4 * a : 4 * b], int(low[i]), w, b - a)
            yield from out


def unpack_blocks(data: bytes, start: np.ndarray, n: np.ndarray, low: np.ndarray, width: np.ndarray, extra: np.ndarray) -> np.ndarray:
    """The ids of blocks that begin at ``start`` in ``data``, one block after another."""
    ends = np.cumsum(n)
    out = np.zeros(ends[-1], np.uint32)
    raw = np.frombuffer(data, np.uint8)
    for size in np.unique(n).tolist():
        for w in np.unique(width[n == size]).tolist():
            own = np.flatnonzero((n == size) & (width == w))
            places = (ends[own] - size)[:, None] + np.arange(size)
            if w:
                cells = raw[start[own][:, None] + np.arange(_packed_bytes(size, w))].view("<u8")
                out[places] = _unpacked(cells, w)[:, :size]
    for b in np.flatnonzero(extra).tolist():
        at, k, first = int(start[b]) + _packed_bytes(int(n[b]), int(width[b])), int(extra[b]), int(ends[b] - n[b])
        place = np.frombuffer(data, "<u2", k, at)
        out[first + place.astype(np.int64)] |= np.frombuffer(data, "<u4", k, at + 2 * k) << np.uint32(width[b])
    return out + np.repeat(low, n).astype(np.uint32)


class TokenFileWriter:
    def __init__(self, out):
        self.out, self.at, self.left = out, len(MAGIC), np.empty(0, np.uint32)
        self.index: list[tuple[int, int, int, int]] = []
        self.docs: list[tuple[int | None, int]] = []
        out.write(MAGIC)

    def _put(self, ids: np.ndarray) -> None:
        for payload, low, width, extra in pack_blocks(ids):
            self.index.append((self.at, low, width, extra))
            self.out.write(payload)
            self.at += len(payload)

    def add(self, doc_ids: list[int | None], lengths: list[int], ids: np.ndarray) -> None:
        """Append documents whose ids lie one after another in ``ids``."""
        self.docs += zip(doc_ids, lengths, strict=True)
        for at in range(0, len(ids), 1 << 20):
            part = np.concatenate([self.left, ids[at : at + (1 << 20)].astype(np.uint32)])
            full = len(part) // BLOCK * BLOCK
            self._put(part[:full])
            self.left = part[full:]

    def close(self) -> None:
        total = len(self.index) * BLOCK + len(self.left)
        self._put(self.left)
        buffer = io.BytesIO()
        starts, lows, widths, extras = (list(x) for x in zip(*self.index, strict=True)) if self.index else ([], [], [], [])
        keys = [d for d, _ in self.docs]
        np.savez(
            buffer, total=np.int64(total), start=np.array(starts, "<u8"), low=np.array(lows, "<u4"), width=np.array(widths, "u1"), extra=np.array(extras, "<u2"),
            doc=np.array([0 if k is None else k for k in keys], "<i8"), null=np.array([k is None for k in keys], bool), length=np.array([n for _, n in self.docs], "<u8"),
        )
        footer = zlib.compress(buffer.getvalue(), 1)
        self.out.write(footer + len(footer).to_bytes(8, "little") + MAGIC)


class TokenFile:
    """Random access to the ids of a file."""

    def __init__(self, source):
        self.source = source
        source.seek(0, 2)
        size = source.tell()
        source.seek(size - 16)
        tail = source.read(16)
        if tail[8:] != MAGIC:
            raise ValueError("not a whole token file")
        n = int.from_bytes(tail[:8], "little")
        source.seek(size - 16 - n)
        foot = np.load(io.BytesIO(zlib.decompress(source.read(n))))
        self.total = int(foot["total"])
        self.start, self.low, self.width, self.extra = (foot[k].astype(np.int64) for k in ("start", "low", "width", "extra"))
        self.doc, self.null, self.length = foot["doc"], foot["null"], foot["length"].astype(np.int64)
        self.stop = np.append(self.start[1:], size - 16 - n)

    def read(self, start: int, stop: int) -> np.ndarray:
        """Ids from position ``start`` to before ``stop``."""
        if stop <= start:
            return np.empty(0, np.uint32)
        first, last = start // BLOCK, (stop - 1) // BLOCK
        self.source.seek(int(self.start[first]))
        data = self.source.read(int(self.stop[last] - self.start[first]))
        blocks = slice(first, last + 1)
        n = np.minimum(BLOCK, self.total - np.arange(first, last + 1) * BLOCK)
        made = unpack_blocks(data, self.start[blocks] - self.start[first], n, self.low[blocks], self.width[blocks], self.extra[blocks])
        return made[start - first * BLOCK : stop - first * BLOCK]

    def documents(self, least: int = 1 << 18) -> Iterator[tuple[int | None, int, np.ndarray]]:
        """(id, start, ids) of each document in order; about ``least`` ids are held at a time."""
        ends = np.cumsum(self.length)
        starts = ends - self.length
        k = 0
        while k < len(ends):
            m = max(k + 1, int(np.searchsorted(ends, starts[k] + least, "right")))
            ids = self.read(int(starts[k]), int(ends[m - 1]))
            for i in range(k, m):
                yield None if self.null[i] else int(self.doc[i]), int(starts[i]), ids[starts[i] - starts[k] : ends[i] - starts[k]]
            k = m


class WordEncoder:
    """The tokenizers library over whole texts, asked once for each distinct word of a call.

    The vocabulary's pattern never joins characters across white space and its
    normalizer works character by character, so a text's ids are those of its
    words one after another.  A word of Latin letters and ASCII marks behind them
    has the ids of its letters in lower case and then those of the marks.  Words,
    parts and ids stay in Arrow and NumPy arrays; a text is a gather from them.
    """

    #: Letters of A-Z and of Latin-1, each one character in lower case, too.
    LETTERS = string.ascii_letters + "".join(map(chr, [*range(0xC0, 0xD7), *range(0xD8, 0xF7), *range(0xF8, 0x100)]))
    SIGNS = string.punctuation
    #: A digit is a piece of its own whatever stands beside it; this one has an id of its own.
    MARK = "\u00b2"
    GROUP = 200  # words asked at once
    LONG = 1000  # bytes of a word that is asked alone
    SLICE = 1 << 17  # words gathered at once

    def __init__(self, path: str, end_id: int = 2):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        [self.mark_id] = self._ids(self.MARK).tolist()
        self.end_id = end_id
        vocabulary = self.library.get_vocab()
        #: Whether an id is the last of a piece.
        self.last = np.zeros(max(vocabulary.values()) + 1, bool)
        self.last[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True

    def _ids(self, text: str) -> np.ndarray:
        return np.array(self.library.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.uint32)

    def _groups(self, words: pa.Array, at: np.ndarray, mark: str) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(places, ids) of ``words`` at the places ``at``, some at a time, joined by ``mark``."""
        cuts = np.append(np.arange(0, len(at), self.GROUP), len(at)).astype(np.int32)
        joined = pc.binary_join(pa.ListArray.from_arrays(pa.array(cuts), words.take(pa.array(at))), mark)
        for k, text in enumerate(joined):
            yield at[cuts[k] : cuts[k + 1]], self._ids(text.as_py())

    def _asked(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(flat, start, size): where in ``flat`` the library's ids of each word lie."""
        size = np.zeros(len(words), np.int32)
        start = np.zeros(len(words), np.int64)
        flat: list[np.ndarray] = []
        used = 0

        def store(places: np.ndarray, ids: np.ndarray, sizes: np.ndarray) -> None:
            nonlocal used
            size[places], start[places] = sizes, used + np.cumsum(sizes) - sizes
            flat.append(ids)
            used += len(ids)

        told = lambda found: found.to_numpy(zero_copy_only=False)
        length = told(pc.binary_length(words))
        short = length <= self.LONG
        letters = short & told(pc.match_substring_regex(words, r"^\p{L}+$"))
        # Each word gives one piece or more, so as many last ids as words part the words.
        torn = [np.empty(0, np.int64)]
        for places, ids in self._groups(words, np.flatnonzero(letters), " "):
            ends = np.flatnonzero(self.last[ids])
            if len(ends) == len(places):
                store(places, ids, np.diff(ends, prepend=-1))
            else:
                torn.append(places)
        special = told(pc.or_(pc.match_substring(words, "<|"), pc.match_substring(words, self.MARK)))
        alone = (length > 0) & (special | ~short)
        rest = np.concatenate([np.flatnonzero((length > 0) & ~letters & ~alone), *torn])
        for places, ids in self._groups(words, rest, self.MARK):
            marks = ids == self.mark_id
            store(places, ids[~marks], np.diff(np.flatnonzero(marks), prepend=-1, append=len(ids)) - 1)
        for place in np.flatnonzero(alone):
            ids = self._ids(words[place].as_py())
            store(np.array([place]), ids, np.array([len(ids)]))
        return np.concatenate([*flat, np.empty(0, np.uint32)]), start, size

    def _gather(self, flat: np.ndarray, start: np.ndarray, size: np.ndarray, numbers: np.ndarray) -> np.ndarray:
        """The ids of ``numbers`` one after another."""
        out = np.empty(int(size[numbers].sum(dtype=np.int64)), np.uint32)
        filled = 0
        for k in range(0, len(numbers), self.SLICE):
            own = numbers[k : k + self.SLICE]
            sizes = size[own]
            ends = np.cumsum(sizes, dtype=np.int64)
            at = np.repeat(start[own] - (ends - sizes), sizes)
            at += np.arange(len(at))
            out[filled : filled + len(at)] = flat[at]
            filled += len(at)
        return out

    def _words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids, sizes) of distinct words, the ids of all one after another."""
        base = pc.ascii_rtrim(words, characters=self.SIGNS)
        latin = pc.match_substring_regex(base, f"^[{self.LETTERS}]+$")
        base = pc.if_else(latin, pc.utf8_lower(base), words)
        sign = pc.if_else(latin, pc.utf8_ltrim(words, characters=self.LETTERS), "")
        parts = pa.concat_arrays([base, sign]).dictionary_encode()
        flat, start, size = self._asked(parts.dictionary)
        both = parts.indices.to_numpy().reshape(2, -1)
        return self._gather(flat, start, size, both.T.ravel()), size[both].sum(axis=0, dtype=np.int32)

    def encode_all(self, texts: list[bytes | None] | pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids, lengths) of texts in UTF-8, the ids of all after one another, the end's included."""
        if not isinstance(texts, pa.Array):
            texts = pa.array(texts, pa.binary()).cast(pa.string())
        split = pc.ascii_split_whitespace(texts.fill_null(""))
        stops = np.cumsum(pc.list_value_length(split).to_numpy(), dtype=np.int64)
        words = split.flatten().dictionary_encode()
        del split
        ids, size = self._words(words.dictionary.cast(pa.string()))
        flat, size = np.append(ids, np.uint32(self.end_id)), np.append(size, np.int32(1))
        numbers = np.insert(words.indices.to_numpy(), stops, len(size) - 1)
        del words
        lengths = np.add.reduceat(size[numbers], np.append(0, stops[:-1] + np.arange(1, len(stops))), dtype=np.int64) if len(stops) else stops
        return self._gather(flat, np.cumsum(size, dtype=np.int64) - size, size, numbers), lengths


def _by_size(batches: Iterable[pa.RecordBatch], most: int) -> Iterator[pa.Table]:
    """The rows (id, text) in order, in tables of about ``most`` bytes or of one row."""
    held: list[pa.RecordBatch] = []
    room = most
    for batch in batches:
        ends = np.cumsum(pc.binary_length(batch.column(1)).fill_null(0).to_numpy(), dtype=np.int64) + 16 * np.arange(1, batch.num_rows + 1)
        at = done = 0
        while at < batch.num_rows:
            stop = max(at if held else at + 1, int(np.searchsorted(ends, done + room, "right")))
            if stop > at:
                held.append(batch.slice(at, stop - at))
                room -= int(ends[stop - 1]) - done
                at, done = stop, int(ends[stop - 1])
            if at < batch.num_rows:
                yield pa.Table.from_batches(held)
                held, room = [], most
    if held:
        yield pa.Table.from_batches(held)


@functools.lru_cache(maxsize=2)
def word_encoder(path: str, end_id: int) -> WordEncoder:
    return WordEncoder(path, end_id)


def write_token_files(docs: DataFrame, path: str, folder: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 2, shard_bytes: int = 32 << 20) -> DataFrame:
    """Encode and write ``docs`` in ascending order of id; returns the manifest.

    Manifest: (part, uri, docs, ids, start): files in order, with the ids written
    before each.  A null text counts as empty; ``end_id`` ends each document.
    Nulls come first, rows repeating an id follow each other by text.  A file gets
    its name from the task attempt, and only attempts that ended well are in the
    manifest, so lost executors leave nothing that is read.  Files hold about
    ``shard_bytes`` of text each, so their number and not their size grows with the
    data; rows of one hot id are parted by how their texts begin.  An empty table
    gives an empty manifest, other columns are not read.
    """
    spark = docs.sparkSession
    text = whole_text(text_col)
    total = docs.agg(F.sum(F.octet_length(text).cast("long"))).first()[0] or 0
    slim = docs.select(F.col(id_col).cast("long").alias("_id"), F.substring(text, 1, 64).alias("_begins"), F.col(text_col).alias("_text"))
    ordered = slim.repartitionByRange(max(1, -(-total // shard_bytes)), "_id", "_begins").sortWithinPartitions("_id", "_text").select("_id", "_text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = word_encoder(path, end_id)
        task = TaskContext.get()
        uri = f"{folder}/part-{task.partitionId():06d}-{task.taskAttemptId()}.lpfor"
        count = total = 0

        def write(out) -> None:
            nonlocal count, total
            writer = TokenFileWriter(out)
            for part in _by_size(batches, shard_bytes):
                ids, lengths = encoder.encode_all(pa.concat_arrays(part.column(1).chunks))
                writer.add(part.column(0).to_pylist(), lengths.tolist(), ids)
                count, total = count + len(lengths), total + len(ids)
                del part, ids, lengths  # before the next rows come
            writer.close()

        publish(uri, write)
        yield pa.RecordBatch.from_arrays([pa.array([task.partitionId()], pa.int64()), pa.array([uri]), pa.array([count], pa.int64()), pa.array([total], pa.int64())], ["part", "uri", "docs", "ids"])

    files = written(ordered.mapInArrow(run, "part long, uri string, docs long, ids long"), "token-manifest")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return files.withColumn("start", F.coalesce(F.sum("ids").over(before), F.lit(0)))


def read_token_files(manifest: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, start, n_tokens, ids_crc32) of every document in the files of ``manifest``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                with opened(uri) as source:
                    rows = [(d, base + s, len(ids), zlib.crc32(ids.astype("<u4").tobytes())) for d, s, ids in TokenFile(source).documents()]
                columns = list(zip(*rows, strict=True)) if rows else [[], [], [], []]
                yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.int64()) for c in columns], [id_col, "start", "n_tokens", "ids_crc32"])

    n = max(1, manifest.count())
    spread = manifest.select("uri", "start").repartition(n, "uri")
    return spread.mapInArrow(run, f"`{id_col}` long, start long, n_tokens long, ids_crc32 long")


def token_file_rows(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    manifest = write_token_files(docs, path, fresh_folder(docs.sparkSession, "tokens"), id_col, text_col)
    return read_token_files(manifest, id_col)
