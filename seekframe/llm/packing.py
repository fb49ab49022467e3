"""Packing (4): minimum bin slack over the multiset of remaining lengths.

A document is its ids with an end id. Whole windows of `WINDOW` tokens are cut from its front and are sequences of their
own; what remains (under a window) joins the multiset of remaining lengths of its group. A group is up to `GROUP`
documents of one input partition, so nothing is shuffled and a task holds at most GROUP * WINDOW ids.

Each window starts with the longest remaining piece. A subset-sum over the other lengths with their counts, one bit a
sum, finds the multiset closest to the rest of the window; it stops at the first exact fill, and the counts are tracked
back through the bitsets. Slack that no multiset fills is filled by cutting the longest piece left. What is under a
window when the group ends is cut into sequences whose lengths are powers of two, which need no padding either.

A null text is the empty text (just the end id). A very long text is cut into whole windows as it is encoded; its ids are
held once. Null ids are kept. Repeated rows are packed once each. Ties between multisets go to longer pieces, and between
pieces of a length to the one met last. An empty table gives no sequences. Other columns are ignored, whatever their
names.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from . import tokens
from ._common import id_back, id_key, prepare, text_of
from .token_files import with_end

WINDOW, GROUP = 2048, 16_384
PIECES = "key long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def fill(counts: dict[int, int], lengths: list[int], room: int) -> dict[int, int]:
    """The multiset of lengths (descending; counts says how many of each) with the greatest sum up to room."""
    steps, reach, full = [], 1, (1 << (room + 1)) - 1
    for length in lengths:
        if length > room:
            continue
        left, k = min(counts[length], room // length), 1
        while left > 0:
            k = min(k, left)
            steps.append((length, k, reach))
            reach |= (reach << (length * k)) & full
            left, k = left - k, 2 * k
        if reach >> room & 1:
            break
    total, used = reach.bit_length() - 1, {}
    for length, k, before in reversed(steps):
        if not before >> total & 1:
            used[length] = used.get(length, 0) + k
            total -= length * k
    return used


def pack_group(lengths: list[int], window: int = WINDOW) -> list[list[tuple[int, int, int]]]:
    """Sequences of (item, start, length) for items shorter than a window."""
    held: dict[int, list[tuple[int, int]]] = {}  # length: (item, start)
    for i, n in enumerate(lengths):
        held.setdefault(n, []).append((i, 0))
    order = sorted(held, reverse=True)
    sequences = []

    def take(n: int) -> tuple[int, int]:
        x = held[n].pop()
        if not held[n]:
            del held[n]
            order.remove(n)
        return x

    def give(n: int, x: tuple[int, int]) -> None:
        if n not in held:
            held[n] = []
            order.append(n)
            order.sort(reverse=True)
        held[n].append(x)

    while order:
        n = order[0]
        i, a = take(n)
        pieces, room = [(i, a, n)], window - n
        for m, k in fill({x: len(held[x]) for x in order}, order, room).items() if room and order else ():
            for _ in range(k):
                pieces.append((*take(m), m))
                room -= m
        if room and order:
            m = order[0]
            i, a = take(m)
            pieces.append((i, a, room))
            give(m - room, (i, a + room))
            room = 0
        if not room:
            sequences.append(pieces)
            continue
        # the end of the group
        total, (i, a, n) = window - room, pieces.pop(0)
        while total:
            size = left = 1 << (total.bit_length() - 1)
            own = []
            while left:
                part = min(left, n)
                own.append((i, a, part))
                a, n, left = a + part, n - part, left - part
                if not n and pieces:
                    i, a, n = pieces.pop(0)
            sequences.append(own)
            total -= size
    return sequences


def pack_documents(docs: DataFrame, kind: str, vocabulary: str, end_id: int, window: int = WINDOW, ids: bool = False) -> DataFrame:
    """Pieces: key, start, length, ids_crc32, doc_tokens, sequence_id, offset; with ids=True also ids array<int>."""
    prepare(docs.sparkSession)
    schema = PIECES + ", ids array<int>" * ids
    names = [x.split()[0] for x in schema.split(", ")]

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        encode, sequence, waiting = with_end(kind, vocabulary, end_id), TaskContext.get().partitionId() << 40, []

        def piece(key, start, part, total, offset):
            return (key, start, len(part), zlib.crc32(part.astype("<u4").tobytes()), total, sequence, offset) + ((part.astype(np.int32),) if ids else ())

        def flush():
            nonlocal sequence, waiting
            out = []
            for pieces in pack_group([len(x[2]) for x in waiting], window):
                offset = 0
                for i, a, n in pieces:
                    key, start, rest, total = waiting[i]
                    out.append(piece(key, start + a, rest[a : a + n], total, offset))
                    offset += n
                sequence += 1
            waiting = []
            return pd.DataFrame(out, columns=names)

        for batch in batches:
            out = []
            for key, text in zip(batch["key"].tolist(), batch["t"]):
                found = encode(text)
                whole = len(found) // window * window
                for a in range(0, whole, window):
                    out.append(piece(key, a, found[a : a + window], len(found), 0))
                    sequence += 1
                if len(found) > whole:
                    waiting.append((key, whole, found[whole:].copy(), len(found)))
                if len(waiting) >= GROUP:
                    yield flush()
            if out:
                yield pd.DataFrame(out, columns=names)
        if waiting:
            yield flush()

    return docs.select(id_key().alias("key"), text_of().alias("t")).mapInPandas(pack, schema)


def op4(docs: DataFrame) -> DataFrame:
    pieces = pack_documents(docs, "byte", tokens.vocabulary("byte_bpe_50k.json"), 1)
    return pieces.select(id_back("key").alias("doc_id"), "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
