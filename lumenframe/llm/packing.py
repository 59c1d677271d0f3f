"""Cost-balanced packing of tokenised documents into fixed-length sequences."""

from __future__ import annotations

import heapq
import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame

#: Token sequence and padding contract.
SEQ_LEN = 4096
EOD_ID = 2
TOKENIZER = "word_bpe_49k.json"
#: Tokens held by a task before they are packed (about 1,000 sequences).
BUFFER_TOKENS = 1 << 22
#: Distinct white-space separated strings whose ids a task remembers.
CACHE_STRINGS, CACHE_CHARS = 250_000, 8_000_000
#: Pieces of strings that it remembers besides, none of more than LONG characters.
CACHE_PIECES, LONG = 400_000, 128
# Fixed value: the pieces into which the tokenizer cuts a string, in its own order.
PIECES = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
LATIN_END = "\u0250"
#: Texts with these are encoded whole: special tokens, and what Python alone takes for white space.
WHOLE = re.compile("<\\||[\x1c-\x1f]")

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, cost double, ids binary"


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def byte_letters() -> list[str]:
    """The letter that a byte-level tokenizer has for each byte: itself where it is printable, else the next free one from 256."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    free = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(free)) for b in range(256)]


class WordCache:
    """Ids of a text, piece by piece: the tokenizer drops white space and never joins ids across pieces.

    Texts of Latin letters are cut into the tokenizer's pieces here, and each new piece is given to its model
    once. Of other texts, strings between white space are looked up, and those of other letters go through all of
    the tokenizer, as do whole texts that hold the text of a special token (``<|``).
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.words: dict[str, bytes] = {}
        self.pieces: dict[str, bytes] = {}
        self.chars = 0
        self.letters = dict(enumerate(byte_letters()))

    def _piece(self, piece: str) -> bytes:
        if (ids := self.pieces.get(piece)) is None:
            # control characters are ASCII, but no letters of the model
            letters = piece if piece.isascii() and piece.isprintable() else piece.encode().decode("latin-1").translate(self.letters)
            ids = array("I", [t.id for t in self.tok.model.tokenize(letters)]).tobytes()
            if len(piece) <= LONG:
                if len(self.pieces) >= CACHE_PIECES:
                    self.pieces.clear()
                self.pieces[piece] = ids
        return ids

    def _word(self, word: str) -> bytes:
        if word.isascii() or max(word) < LATIN_END:
            return b"".join(map(self._piece, PIECES.findall(word.lower())))
        return array("I", self.tok.encode(word, add_special_tokens=False).ids).tobytes()

    def encode(self, text: str) -> np.ndarray:
        if WHOLE.search(text):
            return np.asarray(self.tok.encode(text, add_special_tokens=False).ids, dtype="<u4")
        if text.isascii() or max(text) < LATIN_END:
            pieces = PIECES.findall(text.lower())
            got = list(map(self.pieces.get, pieces))
            if None in got:
                got = [self._piece(piece) if ids is None else ids for ids, piece in zip(got, pieces, strict=True)]
            return np.frombuffer(b"".join(got), dtype="<u4")
        strings = text.split()
        got = list(map(self.words.get, strings))
        if None in got:
            if len(self.words) >= CACHE_STRINGS or self.chars > CACHE_CHARS:
                self.words.clear()
                self.chars = 0
            for i, ids in enumerate(got):
                if ids is None:
                    word = strings[i]
                    if (ids := self.words.get(word)) is None:
                        ids = self.words[word] = self._word(word)
                        self.chars += len(word)
                    got[i] = ids
        return np.frombuffer(b"".join(got), dtype="<u4")


def cost(length: float, linear: float, quadratic: float) -> float:
    """Estimated training cost of attending within one piece."""
    return linear * length + quadratic * length * length


def plan(lengths: list[int], seq_len: int, linear: float, quadratic: float) -> tuple[list[list[tuple[int, int, int]]], list[tuple[int, int, int]]]:
    """Pieces (document, start, length) of full sequences, and the pieces of fewer than seq_len tokens left over.

    Whole seq_len stretches of long documents fill sequences of their own. What is left of each document
    goes, by descending cost, to the lowest-cost sequence whose remaining capacity takes it; where none
    takes it whole, it is cut over the lowest-cost sequences with any capacity.
    """
    full: list[list[tuple[int, int, int]]] = []
    rest: list[tuple[int, int, int]] = []
    for d, n in enumerate(lengths):
        whole = n // seq_len * seq_len
        full += [[(d, s, seq_len)] for s in range(0, whole, seq_len)]
        if n > whole:
            rest.append((d, whole, n - whole))
    n_open = sum(r[2] for r in rest) // seq_len
    rest.sort(key=lambda r: (-r[2], r[0], r[1]))  # the cost grows with the length
    costs, room = np.zeros(n_open), np.full(n_open, seq_len, dtype=np.int64)
    made: list[list[tuple[int, int, int]]] = [[] for _ in range(n_open)]
    left: list[tuple[int, int, int]] = []
    heap = [(0.0, i) for i in range(n_open)]
    for d, start, n in rest:
        skipped, took = [], False
        while heap and len(skipped) < 32:  # most often the lowest-cost sequence has room
            c, i = heapq.heappop(heap)
            if room[i] >= n:
                took = True
                break
            skipped.append((c, i))
        for x in skipped:
            heapq.heappush(heap, x)
        if not took and heap:
            fits = np.flatnonzero(room >= n)
            if len(fits):
                i, took = int(fits[np.argmin(costs[fits])]), True
                heap = [x for x in heap if x[1] != i]
                heapq.heapify(heap)
        if took:
            made[i].append((d, start, n))
            room[i] -= n
            costs[i] += cost(n, linear, quadratic)
            if room[i]:
                heapq.heappush(heap, (costs[i], i))
            continue
        while n and heap:
            _, i = heapq.heappop(heap)
            k = int(min(n, room[i]))
            made[i].append((d, start, k))
            room[i] -= k
            costs[i] += cost(k, linear, quadratic)
            start, n = start + k, n - k
            if room[i]:
                heapq.heappush(heap, (costs[i], i))
        if n:
            left.append((d, start, n))
    return full + made, left


def powers(left: list[tuple[int, int, int]]) -> list[list[tuple[int, int, int]]]:
    """Cut a remainder into sequences whose lengths are powers of two, which need no padding."""
    total, out, queue = sum(x[2] for x in left), [], list(left)
    for bit in reversed(range(total.bit_length())):
        want = 1 << bit
        if not total & want:
            continue
        seq = []
        while want:
            d, s, n = queue.pop(0)
            k = min(n, want)
            seq.append((d, s, k))
            want -= k
            if n > k:
                queue.insert(0, (d, s + k, n - k))
        out.append(seq)
    return out


def pack(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text", seq_len: int = SEQ_LEN, eod_id: int = EOD_ID, linear: float = 1.0, quadratic: float = 1.0 / 2048, buffer_tokens: int = BUFFER_TOKENS, with_ids: bool = False) -> DataFrame:
    """Pack whole documents into sequences of at most ``seq_len`` tokens; one row per piece.

    A document is its ids followed by ``eod_id``; null text counts as empty (one id). Each task tokenises
    and packs what it scans, ``buffer_tokens`` at a time: nothing is shuffled, no document is held by
    more than one task, and its memory does not grow with the partition. Tokens that do not fill a
    sequence are carried to the task's next buffer; the last of them form sequences whose lengths are
    powers of two, so that nothing is padded. Documents with a null id keep it; rows with equal ids are
    packed one by one. Sequence ids are unique over the tasks (partition number times 2**32 plus a count).
    ``ids`` holds the piece's ids (little-endian unsigned 32-bit) if ``with_ids``, else null.
    """
    path = path or tokenizer_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = WordCache(path)
        base = TaskContext.get().partitionId() << 32
        seq = 0
        # held: (doc id, first token of ids within the document, ids, tokens of the document)
        held: list[tuple[int | None, int, np.ndarray, int]] = []
        end = np.array([eod_id], dtype="<u4")
        tokens = 0

        def emit(sequences: list[list[tuple[int, int, int]]]) -> Iterator[pa.RecordBatch]:
            nonlocal seq
            cols: list[list] = [[] for _ in range(9)]
            for pieces in sequences:
                off = 0
                for d, s, n in pieces:
                    doc, first, ids, total = held[d]
                    raw = ids[s : s + n].tobytes()
                    for c, v in zip(cols, (doc, first + s, n, zlib.crc32(raw), total, base + seq, off, cost(n, linear, quadratic), raw if with_ids else None), strict=True):
                        c.append(v)
                    off += n
                seq += 1
            kinds = [pa.int64()] * 7 + [pa.float64(), pa.binary()]
            if cols[0]:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=[x.split()[0] for x in SCHEMA.split(", ")])

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal held, tokens
            full, left = plan([len(h[2]) for h in held], seq_len, linear, quadratic)
            yield from emit(full)
            held = [(held[d][0], held[d][1] + s, held[d][2][s : s + n].copy(), held[d][3]) for d, s, n in left]
            tokens = sum(len(h[2]) for h in held)

        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = np.append(words.encode(text.as_py() or ""), end)
                held.append((doc, 0, ids, len(ids)))
                tokens += len(ids)
                if tokens >= buffer_tokens:
                    yield from flush()
        yield from flush()
        yield from emit(powers([(d, 0, len(h[2])) for d, h in enumerate(held)]))

    return docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text")).mapInArrow(run, SCHEMA)
