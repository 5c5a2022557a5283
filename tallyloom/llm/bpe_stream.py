"""Byte-level BPE as a streaming transducer with bounded lookahead, and its inverse.

The result is that of applying the merge list in order of rank. A token boundary can move only through a chain of
merges of rising rank, each of which takes the left part of the merge before it as its right part; ``lookahead``
is the longest text such a chain spans in the given merge list. So when so many bytes follow a token, it is stable
and leaves the encoder, and a piece of any length is encoded in memory that does not depend on its length.
Every piece, short or long, passes through the one encoder; what it gave for recent pieces is remembered in it. Between
pieces the library's splitting pattern and special tokens apply as they are. ``Tokenizer.encode_all``, for those who only
want ids, lets the encoder learn short pieces of several texts side by side, which is cheaper.
"""

from __future__ import annotations

import codecs
import hashlib
import heapq
import json
import re
import struct
from collections.abc import Iterable, Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.scratch import text_batches

# Fixed value: the splitting pattern of byte-level tokenizers.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
# Letters, numbers and white space up to U+024F, for texts that have no other characters: the same pieces, found faster.
_L, _N, _S = "A-Za-zªµºÀ-ÖØ-öø-ɏ", "0-9²³¹¼-¾", r" \t-\r\x85\xa0"
FIND_LATIN = re.compile(rf" ?[{_L}]+|'(?:[stmd]|re|ve|ll)| ?[{_N}]+| ?[^{_S}{_L}{_N}]+|[{_S}]+(?![^{_S}])|[{_S}]+").findall
FIND_ANY, WIDE = regex.compile(PATTERN).findall, re.compile("[^\x00-ɏ]").search
#: Where any text may be cut without changing its pieces: after a letter or number before a character of another kind, and before white space.
CUT = regex.compile(r"(?<=\p{L})(?!\p{L})|(?<=\p{N})(?!\p{N})|(?<=\S)(?=\s)")
#: Characters of a long text that are split into pieces at a time, and that the encoder is fed with at a time; what its memory of pieces holds.
SPAN_CHARS, STEP_CHARS, MEMO_BYTES = 1 << 16, 256, 1 << 25
#: Characters of texts whose pieces are learnt together, bytes of the longest such piece, and pieces that are merged side by side.
LEARN_CHARS, LEARN_BYTES, LEARN_ROWS = 1 << 19, 32, 8192
#: In ``merged_together``: the rank of a pair that does not merge.
NEVER = np.int32(2**31 - 1)


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _byte_symbols() -> dict[str, int]:
    """Printable stand-ins of the 256 bytes: themselves, or the next free code point from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class Vocabulary:
    """Tokens, merges and special tokens of a byte-level tokenizer file, and the lookahead that its merges need."""

    def __init__(self, path: str):
        spec = json.load(open(path, encoding="utf-8"))
        symbols = _byte_symbols()
        ids = {bytes(symbols[c] for c in t): i for t, i in spec["model"]["vocab"].items()}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.bytes_of = {i: t for t, i in ids.items()} | {i: t.encode() for t, i in self.special.items()}
        self.ids = ids
        self.byte_ids = [ids.get(bytes([b])) for b in range(256)]
        self.ranks: dict[tuple[int, int], int] = {}
        self.made: list[int] = []
        reach: dict[bytes, int] = {}
        self.lookahead = 1
        for rank, pair in enumerate(spec["model"]["merges"]):
            x, u = (bytes(symbols[c] for c in t) for t in (pair.split(" ") if isinstance(pair, str) else pair))
            self.ranks.setdefault((ids[x], ids[u]), rank)
            self.made.append(ids[x + u])
            # A chain ends in a rule whose right part is freed or made by an earlier rule of the chain.
            span = max(reach.get(u, 0), len(u)) + len(x)
            for t in (x, x + u):
                reach[t] = max(reach.get(t, 0), span)
            self.lookahead = max(self.lookahead, span)
        # The same ranks by pairs as one number, in a table with free slots after each other's.
        self.end = max(self.bytes_of) + 1  # no token
        pairs = np.array([x << 32 | u for x, u in self.ranks], np.int64)
        self.slots = 2 << (16 * len(pairs)).bit_length()
        self.pair_at, self.rank_at = np.full(self.slots, -1, np.int64), np.full(self.slots, NEVER, np.int32)
        for pair, slot, rank in zip(pairs.tolist(), self.slot(pairs).tolist(), self.ranks.values()):
            while self.pair_at[slot] >= 0:
                slot = (slot + 1) % self.slots
            self.pair_at[slot], self.rank_at[slot] = pair, rank
        self.byte_ranks = np.array([[self.ranks.get((x, u), NEVER) for u in self.byte_ids] for x in self.byte_ids], np.int32)
        self.byte_array, self.made_array = np.array(self.byte_ids, np.int64), np.array(self.made, np.int64)
        self.split_special = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None

    def slot(self, pairs: np.ndarray) -> np.ndarray:
        return (pairs.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(65 - self.slots.bit_length())).view(np.int64)

    def ranks_of(self, x: np.ndarray, u: np.ndarray) -> np.ndarray:
        """Ranks of pairs of ids, NEVER for those that do not merge."""
        pairs = x << 32 | u
        at = self.slot(pairs)
        there = self.pair_at[at]
        out = np.where(there == pairs, self.rank_at[at], NEVER)
        more = np.flatnonzero((there != pairs) & (there >= 0))
        while len(more):
            at[more] = (at[more] + 1) % self.slots
            there = self.pair_at[at[more]]
            same = there == pairs[more]
            out[more[same]] = self.rank_at[at[more[same]]]
            more = more[~same & (there >= 0)]
        return out


@lru_cache(4)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def merged(vocab: Vocabulary, piece: bytes) -> list[int]:
    """Ids of a piece, by applying the merge of least rank, leftmost first, until none applies."""
    ids = list(map(vocab.byte_ids.__getitem__, piece))
    if len(ids) > 48:
        return _merged_long(vocab, ids)
    get, made, none = vocab.ranks.get, vocab.made, 1 << 60
    ranks = [get(p, none) for p in zip(ids, ids[1:])]
    while ranks and (rank := min(ranks)) != none:
        at = ranks.index(rank)
        new = ids[at] = made[rank]
        del ids[at + 1], ranks[at]
        if at:
            ranks[at - 1] = get((ids[at - 1], new), none)
        if at < len(ranks):
            ranks[at] = get((new, ids[at + 1]), none)
    return ids


def _merged_long(vocab: Vocabulary, ids: list[int]) -> list[int]:
    """The same with a heap of candidate merges over a linked list."""
    get, n = vocab.ranks.get, len(ids)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    heap = [(r, k, ids[k], ids[k + 1]) for k in range(n - 1) if (r := get((ids[k], ids[k + 1]))) is not None]
    heapq.heapify(heap)
    while heap:
        rank, k, x, u = heapq.heappop(heap)
        if ids[k] != x or (j := after[k]) >= n or ids[j] != u:
            continue
        ids[k], ids[j] = vocab.made[rank], -1
        after[k] = after[j]
        if after[k] < n:
            before[after[k]] = k
            if (r := get((ids[k], ids[after[k]]))) is not None:
                heapq.heappush(heap, (r, k, ids[k], ids[after[k]]))
        if (i := before[k]) >= 0 and (r := get((ids[i], ids[k]))) is not None:
            heapq.heappush(heap, (r, i, ids[i], ids[k]))
    return [i for i in ids if i >= 0]


def merged_together(vocab: Vocabulary, pieces: Sequence[bytes]) -> list[bytes]:
    """Packed ids of each piece, as ``merged`` gives them: in each step every piece does its merge of least rank, leftmost first."""
    if not pieces:
        return []
    sizes = np.array([len(p) for p in pieces])
    n, width = len(pieces), int(sizes.max()) + 1
    # A row's cells; the last one is free in each, and stands for what is left of the first and right of the last id.
    matrix = np.full((n, width), vocab.end, np.int64)
    data, cells = np.frombuffer(b"".join(pieces), np.uint8), np.flatnonzero(np.arange(width) < sizes[:, None])
    ranks = np.full((n, width), NEVER)
    ids, made, start = matrix.reshape(-1), vocab.made_array, np.arange(n) * width
    ids[cells] = vocab.byte_array[data]
    ranks.reshape(-1)[cells[:-1]] = vocab.byte_ranks[data[:-1], data[1:]]
    ranks.reshape(-1)[start + sizes - 1] = NEVER
    after, before = np.arange(1, n * width + 1), np.arange(-1, n * width - 1)
    before[start] = start + width - 1
    while True:
        at = ranks.argmin(1)
        least = ranks[np.arange(len(at)), at]
        on = least != NEVER
        if not on.all():
            ranks, start, at, least = ranks[on], start[on], at[on], least[on]
        if not len(at):
            break
        here, new = start + at, made[least]
        gone, left = after[here], before[here]
        right = after[gone]
        ids[here], ids[gone] = new, vocab.end
        after[here], before[right] = right, here
        flat, shift = ranks.reshape(-1), np.arange(len(at)) * width - start
        flat[gone + shift] = NEVER
        flat[here + shift] = vocab.ranks_of(new, ids[right])
        flat[left + shift] = vocab.ranks_of(ids[left], new)
    kept = matrix != vocab.end
    ends = np.cumsum(4 * kept.sum(1)).tolist()
    data = matrix[kept].astype("<u4").tobytes()
    return [data[a:b] for a, b in zip([0, *ends], ends)]


class Encoder(dict):
    """The transducer: ``feed`` takes bytes of a piece and returns ids that no later byte can change, ``finish`` the rest.

    As a mapping it gives a piece's packed ids. It streams each piece that it does not remember; what it remembers is
    MEMO_BYTES of pieces and ids at most.
    """

    def __init__(self, vocab: Vocabulary):
        self.vocab, self.pending, self.held, self.streamed, self.most = vocab, b"", 0, 0, 4 * vocab.lookahead

    def feed(self, data: bytes) -> list[int]:
        self.pending += data
        out, at = [], 0
        if len(self.pending) > self.most:
            for i in merged(self.vocab, self.pending):
                if at + len(self.vocab.bytes_of[i]) > len(self.pending) - self.vocab.lookahead:
                    break
                out.append(i)
                at += len(self.vocab.bytes_of[i])
            self.pending = self.pending[at:]
        return out

    def finish(self) -> list[int]:
        out, self.pending = merged(self.vocab, self.pending), b""
        return out

    def stream(self, piece: str) -> Iterator[bytes]:
        """Packed ids of a piece, part by part as they become stable."""
        self.streamed += 1
        for at in range(0, len(piece), STEP_CHARS):
            if ids := self.feed(piece[at : at + STEP_CHARS].encode()):
                yield pack(ids)
        yield pack(self.finish())

    def __missing__(self, piece: str) -> bytes:
        self.streamed += 1
        ids: list[int] = []
        for at in range(0, len(piece), STEP_CHARS):
            ids += self.feed(piece[at : at + STEP_CHARS].encode())
        found = pack(ids + self.finish())
        self.held += 4 * len(piece) + len(found)
        if self.held > MEMO_BYTES:
            self.clear()
            self.held = 4 * len(piece) + len(found)
        self[piece] = found
        return found

    def learn(self, pieces: set[str]) -> dict[str, bytes]:
        """Packed ids of each of the pieces. Those not remembered that have LEARN_BYTES at most are merged together, others streamed."""
        if self.held > MEMO_BYTES:
            self.clear()
            self.held = 0
        out = dict(zip(pieces, map(self.get, pieces)))
        missing = [p for p, found in out.items() if found is None]
        short = [p for p in missing if 4 * len(p) <= LEARN_BYTES or len(p.encode()) <= LEARN_BYTES]
        for at in range(0, len(short), LEARN_ROWS):
            part = short[at : at + LEARN_ROWS]
            found = merged_together(self.vocab, [p.encode() for p in part])
            self.held += 4 * sum(map(len, part)) + sum(map(len, found))
            self.update(zip(part, found, strict=True))
            out.update(zip(part, found, strict=True))
        out.update((p, self[p]) for p in missing if out[p] is None)
        return out


def _spans(text: str) -> Iterator[str]:
    """Parts of a long text, cut where no piece crosses; only a run of one kind of character makes a part longer than SPAN_CHARS."""
    at = 0
    while len(text) - at > SPAN_CHARS:
        found = CUT.search(text, at + SPAN_CHARS)
        if not found:
            break
        yield text[at : found.start()]
        at = found.start()
    yield text[at:]


def pack(ids: list[int]) -> bytes:
    """Ids as little-endian unsigned 32-bit integers."""
    return struct.pack(f"<{len(ids)}I", *ids)


class Tokenizer:
    """Encoder and decoder of whole texts over a vocabulary file."""

    def __init__(self, path: str):
        self.vocab = vocabulary(path)
        self.encoder = Encoder(self.vocab)
        self.bytes_of = np.frombuffer(b"".join(self.vocab.bytes_of.get(i, b"") for i in range(max(self.vocab.bytes_of) + 1)), np.uint8)
        self.lengths = np.array([len(self.vocab.bytes_of.get(i, b"")) for i in range(max(self.vocab.bytes_of) + 1)])
        self.starts = np.cumsum(self.lengths) - self.lengths

    @staticmethod
    def find(text: str) -> list[str]:
        return FIND_ANY(text) if WIDE(text) else FIND_LATIN(text)

    def encode(self, text: str) -> Iterator[bytes]:
        """Packed ids of a text, part by part."""
        parts = self.vocab.split_special.split(text) if self.vocab.split_special else [text]
        for k, part in enumerate(parts):
            if k % 2:
                yield self.vocab.special[part].to_bytes(4, "little")
            elif part:
                for span in _spans(part):
                    if len(span) > 2 * SPAN_CHARS:
                        for piece in self.find(span):
                            yield from self.encoder.stream(piece)
                    else:
                        yield b"".join(map(self.encoder.__getitem__, self.find(span)))

    def encode_all(self, texts: Iterable[str]) -> Iterator[Iterator[bytes]]:
        """``encode`` of each text, in order; short pieces of LEARN_CHARS of them are learnt together."""
        held: list[tuple[str, list[str] | None]] = []
        size = 0

        def flush() -> Iterator[Iterator[bytes]]:
            ids_of = self.encoder.learn(set().union(*(pieces for _, pieces in held if pieces is not None))).__getitem__
            for text, pieces in held:
                yield self.encode(text) if pieces is None else iter((b"".join(map(ids_of, pieces)),))

        for text in texts:
            whole = len(text) <= SPAN_CHARS and not (self.vocab.split_special and self.vocab.split_special.search(text))
            held.append((text, self.find(text) if whole else None))
            size += len(text)
            if size >= LEARN_CHARS:
                yield from flush()
                held, size = [], 0
        yield from flush()

    def decode(self, parts: Iterator[bytes]) -> Iterator[str]:
        """Text of packed ids; bytes that are no UTF-8 become replacement characters, also across parts."""
        state = codecs.getincrementaldecoder("utf-8")("replace")
        for part in parts:
            ids = np.frombuffer(part, "<u4")
            sizes = self.lengths[ids]
            ends = np.cumsum(sizes)
            at = np.repeat(self.starts[ids] - ends + sizes, sizes) + np.arange(ends[-1] if len(ends) else 0)
            yield state.decode(self.bytes_of[at].tobytes())
        yield state.decode(b"", True)


@lru_cache(2)
def tokenizer(path: str) -> Tokenizer:
    return Tokenizer(path)


def encode_documents(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text", digests_only: bool = False) -> DataFrame:
    """Columns of ``docs`` as they are without the text, then n_tokens, token_ids (array of int), ids_sha256 and decoded_sha256.

    With ``digests_only``, only ``id_col``, n_tokens and the two digests; ids and text then leave no task.
    Null texts count as empty; special tokens in a text are encoded as such, as the library does by default.
    Output names replace input columns of the same name. No shuffle: a row depends on itself alone.
    """
    text_batches(docs.sparkSession)
    path = path or default_vocabulary()
    made = ["n_tokens", "token_ids", "ids_sha256", "decoded_sha256"]
    keep = [id_col] if digests_only else [c for c in docs.columns if c != text_col and c not in made]
    if digests_only:
        made.remove("token_ids")
    kinds = {"n_tokens": "long", "token_ids": "array<int>", "ids_sha256": "string", "decoded_sha256": "string"}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = tokenizer(path)
        for batch in batches:
            texts = batch.column(len(keep))
            # Rows whose ids are held together: all of a batch at most, a few million characters as a rule.
            at = 0
            while at < len(texts):
                rows, size = [], 0
                while at + len(rows) < len(texts) and size < 4_000_000:
                    text = texts[at + len(rows)].as_py() or ""
                    ids_hash, text_hash, n, kept = hashlib.sha256(), hashlib.sha256(), 0, []

                    def parts(text=text, ids_hash=ids_hash, kept=kept):
                        for part in tok.encode(text):
                            ids_hash.update(part)
                            kept.append(len(part) if digests_only else part)
                            yield part

                    for piece in tok.decode(parts()):
                        text_hash.update(piece.encode())
                    n = sum(kept if digests_only else map(len, kept)) // 4
                    rows.append((n, b"" if digests_only else b"".join(kept), ids_hash.hexdigest(), text_hash.hexdigest()))
                    size += len(text)
                counts = [r[0] for r in rows]
                columns = {"n_tokens": pa.array(counts, pa.int64()), "ids_sha256": pa.array([r[2] for r in rows]), "decoded_sha256": pa.array([r[3] for r in rows])}
                if not digests_only:
                    offsets = [0]
                    for n in counts:
                        offsets.append(offsets[-1] + n)
                    values = pa.Array.from_buffers(pa.int32(), offsets[-1], [None, pa.py_buffer(b"".join(r[1] for r in rows))])
                    columns["token_ids"] = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values)
                yield pa.RecordBatch.from_arrays([batch.column(k).slice(at, len(rows)) for k in range(len(keep))] + [columns[c] for c in made], keep + made)
                at += len(rows)

    schema = ", ".join([f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep] + [f"{c} {kinds[c]}" for c in made])
    return docs.select(*[F.col(f"`{c}`") for c in keep], F.col(text_col)).mapInArrow(run, schema)
