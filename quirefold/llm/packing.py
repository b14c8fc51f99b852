"""Packing token pieces into fixed windows by minimum bin slack.

A document's ids are cut at whole windows; what remains is a piece shorter than the window. Windows are then filled one
at a time: the longest remaining piece opens one, and a subset-sum over the multiset of remaining lengths, held as
the bits of one integer, finds the lengths that bring it closest to its capacity. The same multiset fills
further windows while its counts last. Pieces left over at the end of a task, less than a window in all but rare cases, go into windows whose
lengths are powers of two. Each task packs its own partition in groups of bounded size: no shuffle, and no group
depends on another.
"""

from __future__ import annotations

import os
import zlib
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from quirefold.llm.common import bound_batches, releasing

WINDOW = 2048
#: Tokens that a task holds at a time.
GROUP_TOKENS = 1 << 21
END_ID = 1
#: Words that a process remembers.
REMEMBERED = 1 << 20


def closest_fill(counts: dict[int, int], capacity: int) -> list[tuple[int, int]]:
    """Lengths and how often, within the counts, whose sum is the largest not above the capacity."""
    sums, mask, steps = 1, (1 << (capacity + 1)) - 1, []
    for length in sorted((x for x in counts if x <= capacity), reverse=True):
        left, take = min(counts[length], capacity // length), 1
        while left > 0 and not sums >> capacity & 1:
            n = min(take, left)
            steps.append((length, n, sums))
            sums = (sums | sums << n * length) & mask
            left, take = left - n, take * 2
        if sums >> capacity & 1:
            break
    at, used = sums.bit_length() - 1, defaultdict(int)
    for length, n, before in reversed(steps):
        if not before >> at & 1:
            at -= n * length
            used[length] += n
    return list(used.items())


def minimum_slack(lengths: list[int], window: int) -> list[list[int]]:
    """Indexes of the pieces in each window; windows in the order in which they were filled."""
    by_length: dict[int, list[int]] = defaultdict(list)
    for i in range(len(lengths) - 1, -1, -1):
        by_length[lengths[i]].append(i)
    counts, out = {x: len(v) for x, v in by_length.items()}, []
    while counts:
        first = max(counts)
        counts[first] -= 1
        fill = [(first, 1), *closest_fill({x: n for x, n in counts.items() if n}, window - first)]
        counts[first] += 1
        need: dict[int, int] = defaultdict(int)
        for x, n in fill:
            need[x] += n
        times = min(counts[x] // n for x, n in need.items())
        for _ in range(times):
            out.append([by_length[x].pop() for x, n in need.items() for _ in range(n)])
        for x, n in need.items():
            counts[x] -= n * times
            if not counts[x]:
                del counts[x]
    return out


class WordEncoder(dict):
    """Ids of texts by a tokenizer that cuts at white space: each word is encoded once and remembered, up to a bound; beyond it those met most often stay.

    Only for tokenizers whose ids of a text are those of its words at ASCII white space, one after another, whatever the case of
    A-Z, as holds for ``word_bpe_49k``: its normaliser, its added tokens and its splitting rule never look across white space, and
    it lower-cases all but its added tokens, whose texts contain ``<|``.
    """

    #: Stands for the end of a document; no word holds a space.
    END = b" "

    def __init__(self, path: str, limit: int = REMEMBERED) -> None:
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        super().__init__()
        self.tokenizer, self.limit = Tokenizer.from_file(path), limit
        self[self.END] = 0
        self.waiting: list[bytes] = []
        self.flat, self.used = np.array([END_ID], dtype="<u4"), 1
        self.start, self.length, self.uses = np.zeros(1, dtype=np.int64), np.ones(1, dtype=np.int64), np.zeros(1, dtype=np.int64)

    def shrink(self) -> None:
        """Keeps the words that were met most often, and more than once."""
        order = np.argsort(-self.uses[1 : len(self)], kind="stable")[: self.limit // 2] + 1
        keep = np.append(0, np.sort(order[self.uses[order] > 1]))
        words = list(self)
        length = self.length[keep]
        stop = np.cumsum(length)
        self.flat = self.flat[np.repeat(self.start[keep] - (stop - length), length) + np.arange(stop[-1])]
        self.start, self.length, self.uses, self.used = stop - length, length, self.uses[keep] // 2, int(stop[-1])
        self.clear()
        self.update((words[i], n) for n, i in enumerate(keep.tolist()))

    def __missing__(self, word: bytes) -> int:
        code = self[word] = len(self)
        self.waiting.append(word)
        return code

    def encode_waiting(self) -> None:
        """Ids of the words met since, in one call but for those that could hold an added token."""
        words = [w.decode("utf-8", "replace") for w in self.waiting]
        plain = [i for i, w in enumerate(words) if "<|" not in w]
        found: list[np.ndarray] = [np.empty(0, dtype="<u4")] * len(words)
        if plain:
            found_ids = self.tokenizer.encode(" ".join(words[i] for i in plain), add_special_tokens=False)
            ids, at = np.array(found_ids.ids, dtype="<u4"), np.array([x for x, _ in found_ids.offsets], dtype=np.int64)
            stop = np.cumsum([len(words[i]) + 1 for i in plain])
            cut = np.searchsorted(at, stop)
            for i, s, e in zip(plain, np.r_[0, cut[:-1]].tolist(), cut.tolist(), strict=True):
                found[i] = ids[s:e]
        for i, w in enumerate(words):
            if "<|" in w:
                found[i] = np.array(self.tokenizer.encode(w, add_special_tokens=False).ids, dtype="<u4")
        new = np.concatenate(found)
        length = np.fromiter(map(len, found), dtype=np.int64, count=len(found))
        if self.used + len(new) > len(self.flat):
            self.flat = np.concatenate([self.flat[: self.used], np.empty(self.used + len(new) + len(self), dtype="<u4")])
        self.flat[self.used : self.used + len(new)] = new
        now, before = len(self), len(self) - len(length)
        if now > len(self.start):
            self.start, self.length, self.uses = (np.concatenate([a, np.zeros(now, dtype=np.int64)]) for a in (self.start, self.length, self.uses))
        self.start[before:now], self.length[before:now] = self.used + np.cumsum(length) - length, length
        self.used += len(new)
        self.waiting = []

    def ids(self, texts: list[bytes | None]) -> list[np.ndarray]:
        """Ids of each text, with the end id."""
        out = []
        for at in range(0, len(texts), 64):
            if len(self) > self.limit:
                self.shrink()
            codes = []
            for text in texts[at : at + 64]:
                raw = text or b""
                words = (raw if b"<|" in raw else raw.lower()).split()
                words.append(self.END)
                codes.append(np.fromiter(map(self.__getitem__, words), dtype=np.int64, count=len(words)))
            if self.waiting:
                self.encode_waiting()
            self.uses[: len(self)] += np.bincount(np.concatenate(codes), minlength=len(self))
            for c in codes:
                length = self.length[c]
                stop = np.cumsum(length)
                out.append(self.flat[np.repeat(self.start[c] - (stop - length), length) + np.arange(stop[-1])])
        return out


@lru_cache(maxsize=1)
def encoder(path: str, limit: int) -> WordEncoder:
    """One encoder a process, so that tasks that follow one another share its words."""
    return WordEncoder(path, limit)


def pack_group(docs: list[tuple[object, np.ndarray]], window: int, last: bool) -> tuple[list[list[tuple[int, int, int]]], list[tuple[int, int, int]]]:
    """Windows of (document's index, start, length), and pieces that are left for the next group unless ``last``."""
    full, pieces = [], []
    for i, (_, ids) in enumerate(docs):
        n = len(ids)
        full += [[(i, at, window)] for at in range(0, n - window + 1, window)]
        if n % window:
            pieces.append((i, n - n % window, n % window))
    packed, left = [], []
    for found in minimum_slack([p[2] for p in pieces], window):
        own = [pieces[j] for j in found]
        if sum(p[2] for p in own) == window:
            packed.append(own)
        else:
            left += own
    # What no subset fills is filled by cutting one piece in two.
    row, room = [], window
    for i, start, length in left:
        while length:
            n = min(length, room)
            row.append((i, start, n))
            start, length, room = start + n, length - n, room - n
            if not room:
                packed.append(row)
                row, room = [], window
    if last and row:
        packed += powers_of_two(row)
        row = []
    return full + packed, row


def powers_of_two(row: list[tuple[int, int, int]]) -> list[list[tuple[int, int, int]]]:
    """The pieces cut into windows whose lengths are the bits of their sum, so none is padded."""
    total, out, pieces = sum(p[2] for p in row), [], list(reversed(row))
    for bit in range(total.bit_length() - 1, -1, -1):
        if total >> bit & 1:
            room, own = 1 << bit, []
            while room:
                i, start, length = pieces.pop()
                n = min(length, room)
                own.append((i, start, n))
                room -= n
                if n < length:
                    pieces.append((i, start + n, length - n))
            out.append(own)
    return out


def pack_documents(docs: DataFrame, tokenizer_path: str | None = None, window: int = WINDOW, group_tokens: int = GROUP_TOKENS, with_ids: bool = False, remembered: int = REMEMBERED, shared: bool = True) -> DataFrame:
    """Pieces of documents in sequences: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, and ids if asked for.

    docs needs ``doc_id`` and ``text``; other columns are ignored. A null or empty text is the end id alone.
    ``remembered``: words that a process remembers the ids of, some 250 bytes each; ``shared``: whether tasks that follow one another in a process share them, so that it keeps them; both change the time, not the result. A repeated row is packed as often as it stands there. Sequences hold ``window`` ids, or, at the end of a task, a power of
    two, so nothing is padded. An empty table gives no rows.
    """
    bound_batches(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if tokenizer_path is None:
            import public_tokenizers

        encode = (encoder if shared else WordEncoder)(tokenizer_path or public_tokenizers.path("word_bpe_49k.json"), remembered)
        task = TaskContext.get()
        next_id = (task.partitionId() if task else 0) << 40
        held: list[tuple[object, np.ndarray, int, int]] = []  # doc_id, ids, where they start, the document's number of ids
        size = 0

        def pack(last: bool) -> pa.RecordBatch:
            nonlocal held, size, next_id
            windows, left = pack_group([(h[0], h[1]) for h in held], window, last)
            rows = []
            for row in windows:
                at = 0
                for i, start, n in row:
                    doc, ids, base, total = held[i]
                    part = np.ascontiguousarray(ids[start : start + n])
                    rows.append((doc, base + start, n, zlib.crc32(part), total, next_id, at, part if with_ids else None))
                    at += n
                next_id += 1
            held = [(held[i][0], held[i][1][s : s + n].copy(), held[i][2] + s, held[i][3]) for i, s, n in left]
            size = sum(len(h[1]) for h in held)
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 8
            data = [pa.array(cols[0], type=doc_type), *(pa.array(c, type=pa.int64()) for c in cols[1:7])]
            return pa.RecordBatch.from_arrays(data + ([pa.array(cols[7], type=pa.list_(pa.int64()))] if with_ids else []), NAMES + (["ids"] if with_ids else []))

        doc_type = pa.int64()
        for b in batches:
            doc_type = b.schema.field("doc_id").type
            for doc, ids in zip(b.column("doc_id").to_pylist(), encode.ids(b.column("text").cast(pa.binary()).to_pylist()), strict=True):
                held.append((doc, ids, 0, len(ids)))
                size += len(ids)
                if size >= group_tokens:
                    yield pack(False)
        if held:
            yield pack(True)

    schema = f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long" + (", ids array<long>" if with_ids else "")
    return docs.select("doc_id", "text").mapInArrow(releasing(run), schema)


NAMES = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]

