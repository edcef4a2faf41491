"""SentencePiece BPE encoding by vectorised merge rounds, and decoding.

A text's words (runs of the space mark with what follows) never merge with each other, so the distinct words of
a batch are encoded together, as one flat numpy array of symbols: each round finds every word's best pair by a
segmented minimum, merges its leftmost occurrences at once, and compacts the array, until no pair remains.
Where merging several occurrences at once could differ from merging them one by one (a merged piece that takes
part in a pair no worse than its own), only the leftmost one is merged in that round.

Results equal those of the sentencepiece library: unknown characters fall back to byte pieces.  Words are also cut
before a line feed, as no piece holds one.  Word results are kept in a cache of bounded bytes, freed at a task's end.

Nulls and edge cases: a null or empty text has no ids, and its digests are those of empty strings; a long word is
merged in the same rounds as others, or by a queue where its merges must go one by one; repeated rows are encoded
each; an empty table gives an empty table; extra columns pass through.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from collections.abc import Iterator
from functools import cache
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import types as T

MARK = "▁"
_WORD = re.compile(f"{MARK}+[^{MARK}\n]*|\n[^{MARK}\n]*")
#: Bytes of words and their ids that a task keeps before it starts anew, and what an entry takes besides.
KEPT, ENTRY = 24 << 20, 250
#: A word of more symbols that must be merged one by one is handed to a queue.
QUEUE_FROM = 1024
_NEVER = np.iinfo(np.int32).max


class _Places(dict):
    """Numbers words as they are met; new ones also go to a list."""

    def __init__(self):
        self.new: list[str] = []

    def __missing__(self, word: str) -> int:
        place = self[word] = len(self)
        self.new.append(word)
        return place


class PieceEncoder:
    def __init__(self, model_file: str):
        self.library = sentencepiece.SentencePieceProcessor(model_file=model_file)
        size = self.library.get_piece_size()
        normal = [i for i in range(size) if not (self.library.is_control(i) or self.library.is_unknown(i) or self.library.is_byte(i) or self.library.is_unused(i))]
        pieces = {self.library.id_to_piece(i): i for i in normal}
        symbols = dict(pieces)
        for piece in pieces:
            for char in piece:
                symbols.setdefault(char, len(symbols) + size)
        if any(re.search(f"[^{MARK}]{MARK}|\n", p) for p in pieces):
            raise ValueError("pieces that cross words are not supported")
        scores = {p: self.library.get_score(i) for p, i in pieces.items()}
        ranks = {s: r for r, s in enumerate(sorted(set(scores.values()), reverse=True))}
        self.first_extra, self.base = size, max(symbols.values()) + 2
        pairs = {}
        rank_of = np.full(self.base, -1, dtype=np.int32)
        for piece, i in pieces.items():
            if len(piece) > 1:
                rank_of[i] = ranks[scores[piece]]
                for cut in range(1, len(piece)):
                    if piece[:cut] in symbols and piece[cut:] in symbols:
                        pairs[symbols[piece[:cut]] * self.base + symbols[piece[cut:]]] = i
        self.keys = np.array(sorted(pairs), dtype=np.int64)
        self.merged = np.array([pairs[k] for k in sorted(pairs)], dtype=np.int32)
        self.rank = rank_of[self.merged]
        # Most pairs are found by one look at a table; those whose place another pair took, by a search.
        bits = max(12, len(self.keys).bit_length() + 2)
        self.multiplier, self.shift = np.uint64(0x9E3779B97F4A7C15), np.uint64(64 - bits)
        place = (self.keys.astype(np.uint64) * self.multiplier >> self.shift).astype(np.int64)
        self.table_pairs = np.zeros(1 << bits, dtype=np.int32)
        self.table_pairs[place] = np.arange(len(self.keys))
        self.table_keys = np.full(1 << bits, -1, dtype=np.int64)
        self.table_keys[place] = self.keys[self.table_pairs[place]]
        self.crowded = np.bincount(place, minlength=1 << bits) > 1
        # A piece is risky if it is part of a pair that ranks no worse than the piece itself.
        self.risky = np.zeros(self.base, dtype=bool)
        for part in (self.keys // self.base, self.keys % self.base):
            self.risky[part[self.rank <= rank_of[part]]] = True
        codes = sorted((ord(s), i) for s, i in symbols.items() if len(s) == 1)
        self.char_codes, self.char_symbols = np.array([c for c, _ in codes], dtype=np.uint32), np.array([i for _, i in codes], dtype=np.int32)
        self.extra_codes = np.zeros(self.base - size, dtype=np.int64)
        extra = self.char_symbols >= size
        self.extra_codes[self.char_symbols[extra] - size] = self.char_codes[extra]
        self.pairs = pairs
        self.rank_of = rank_of
        self.first_byte = self.library.piece_to_id("<0x00>")
        self.forget()

    def forget(self) -> None:
        self.places, self.bytes = _Places(), 0
        self.ids: list[bytes] = []  # of each word, as raw 32-bit integers
        self.text: list[bytes] = []  # of each word, as decimal numbers joined by commas

    def _pairs(self, symbols: np.ndarray, owner: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Merged symbol and rank of the pairs that begin at some places; the rank is _NEVER where there is none."""
        after = np.minimum(at + 1, len(symbols) - 1)
        left, right = symbols[at], symbols[after]
        key = left * self.base + right
        own = (owner[at] == owner[after]) & (after > at) & (left >= 0) & (right >= 0)
        place = (key.astype(np.uint64) * self.multiplier >> self.shift).astype(np.int64)
        found = np.where(own & (self.table_keys[place] == key), self.table_pairs[place], -1)
        rest = np.flatnonzero(own & (found < 0) & self.crowded[place])
        if len(rest):
            near = np.minimum(np.searchsorted(self.keys, key[rest]), len(self.keys) - 1)
            found[rest] = np.where(self.keys[near] == key[rest], near, -1)
        return np.where(found < 0, -1, self.merged[found]), np.where(found < 0, _NEVER, self.rank[found])

    def _queue(self, symbols: list[int]) -> list[int]:
        """Merges of one long word, one by one, best rank and then leftmost first."""
        n = len(symbols)
        after, before, heap = list(range(1, n + 1)), list(range(-1, n - 1)), []

        def offer(i: int) -> None:
            j = after[i]
            if 0 <= i and j < n and symbols[i] >= 0 and symbols[j] >= 0 and (m := self.pairs.get(symbols[i] * self.base + symbols[j])) is not None:
                heapq.heappush(heap, (int(self.rank_of[m]), i, j, symbols[i], symbols[j], m))

        for i in range(n - 1):
            offer(i)
        gone = [False] * n
        while heap:
            _, i, j, left, right, m = heapq.heappop(heap)
            if gone[i] or gone[j] or after[i] != j or symbols[i] != left or symbols[j] != right:
                continue
            symbols[i], gone[j], after[i] = m, True, after[j]
            if after[j] < n:
                before[after[j]] = i
            offer(i)
            if before[i] >= 0:
                offer(before[i])
        return [s for s, g in zip(symbols, gone, strict=True) if not g]

    def encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of some non-empty words with their marks, one after another, and the word of each id."""
        lengths = np.array([len(w) for w in words], dtype=np.int64)
        codes = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), dtype="<u4")
        at = np.minimum(np.searchsorted(self.char_codes, codes), len(self.char_codes) - 1)
        unknown = self.char_codes[at] != codes
        # Unknown characters are the negative numbers of their code points.
        symbols = np.where(unknown, -2 - codes.astype(np.int64), self.char_symbols[at]).astype(np.int64)
        owner = np.repeat(np.arange(len(words)), lengths)
        merged, rank = self._pairs(symbols, owner, np.arange(len(symbols)))
        done_owner, done_symbols = [], []
        while len(symbols):
            starts = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
            sizes = np.diff(np.append(starts, len(owner)))
            best = np.repeat(np.minimum.reduceat(rank, starts), sizes)
            ended = best == _NEVER
            if ended.any():
                done_owner.append(owner[ended])
                done_symbols.append(symbols[ended])
                keep = ~ended
                symbols, owner, merged, rank, best = symbols[keep], owner[keep], merged[keep], rank[keep], best[keep]
                if not len(symbols):
                    break
            hit = rank == best
            # Of a run of overlapping hits every second one is merged, from the left.
            index = np.arange(len(hit))
            run_start = np.maximum.accumulate(np.where(hit & ~np.append(False, hit[:-1]), index, 0))
            hit &= (index - run_start) % 2 == 0
            serial = hit & self.risky[np.maximum(merged, 0)]
            if serial.any():
                slow = np.unique(owner[serial])
                long = slow[np.bincount(owner, minlength=len(words))[slow] > QUEUE_FROM].tolist()
                if long:
                    for w in long:
                        out = np.array(self._queue(symbols[owner == w].tolist()), dtype=np.int64)
                        done_owner.append(np.full(len(out), w))
                        done_symbols.append(out)
                    keep = ~np.isin(owner, long)
                    symbols, owner, merged, rank, hit = symbols[keep], owner[keep], merged[keep], rank[keep], hit[keep]
                    if not len(symbols):
                        break
                places = np.flatnonzero(hit)
                one_by_one = np.zeros(len(words), dtype=bool)
                one_by_one[slow] = True
                repeated = np.append(False, owner[places][1:] == owner[places][:-1])[: len(places)]
                hit[places[repeated & one_by_one[owner[places]]]] = False
            symbols = np.where(hit, merged, symbols)
            keep = ~np.append(False, hit[:-1])
            symbols, owner, merged, rank = symbols[keep], owner[keep], merged[keep], rank[keep]
            # Only the pairs on both sides of a merge are new.
            near = hit[keep]
            near[:-1] |= near[1:].copy()
            changed = np.flatnonzero(near)
            merged[changed], rank[changed] = self._pairs(symbols, owner, changed)
        owners, flat = np.concatenate(done_owner), np.concatenate(done_symbols)
        order = np.argsort(owners, kind="stable")
        return self._with_bytes(flat[order], owners[order])

    def _with_bytes(self, flat: np.ndarray, owners: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Symbols that are no piece become the byte pieces of their character's UTF-8 form."""
        strange = np.flatnonzero((flat < 0) | (flat >= self.first_extra))
        if not len(strange):
            return flat, owners
        own = flat[strange]
        code = np.where(own < 0, -2 - own, self.extra_codes[np.maximum(own - self.first_extra, 0)])
        size = 1 + (code >= 0x80).astype(np.int64) + (code >= 0x800) + (code >= 0x10000)
        repeats = np.ones(len(flat), dtype=np.int64)
        repeats[strange] = size
        out = np.repeat(flat, repeats)
        first = (np.cumsum(repeats) - repeats)[strange]
        for k in range(4):
            has = size > k
            bits = code[has] >> (6 * (size[has] - 1 - k))
            lead = np.array([0, 0, 0xC0, 0xE0, 0xF0])[size[has]] if k == 0 else 0x80
            out[first[has] + k] = self.first_byte + (lead | (bits if k == 0 else bits & 63))
        return out, np.repeat(owners, repeats)

    def _words(self, text: str) -> list[str]:
        """Words of a non-empty text: without the single mark that precedes most of them; a line feed begins one."""
        marked = MARK + text.replace(" ", MARK)
        if MARK * 2 in marked or MARK + "\n" in marked or marked.endswith(MARK):
            return [w[1:] if len(w) > 1 and w[0] == MARK != w[1] else w for w in _WORD.findall(marked)]
        return marked[1:].replace("\n", MARK + "\n").split(MARK)

    def encode(self, texts: list[str | None]) -> list[list[int]]:
        """Places in self.ids and self.text of the words of each text; they hold until the next call."""
        if self.bytes > KEPT:
            self.forget()
        places = self.places
        found = [[places[w] for w in self._words(t)] if t else [] for t in texts]
        new, places.new = places.new, []
        for at in range(0, len(new), 1 << 14):
            part = [w if w[0] in f"{MARK}\n" else MARK + w for w in new[at : at + (1 << 14)]]
            ids, owners = self.encode_words(part)
            cuts = np.searchsorted(owners, np.arange(len(part) + 1))
            raw, text = ids.astype(np.int32).tobytes(), ",".join(map(str, ids.tolist())).encode()
            ends = np.append(0, np.cumsum(2 + sum((ids >= 10**k).astype(np.int64) for k in range(1, 6))))[cuts]
            self.ids.extend([raw[i:j] for i, j in pairwise((4 * cuts).tolist())])
            self.text.extend([text[i : j - 1] for i, j in pairwise(ends.tolist())])
        self.bytes += sum(ENTRY + 4 * len(w) for w in new)
        return found

    def ids_of(self, places: list[int]) -> np.ndarray:
        ids = self.ids
        return np.frombuffer(b"".join([ids[p] for p in places]), dtype=np.int32)


def _slices(lengths: pa.Array, characters: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Bounds of successive texts with about so many characters; lengths are null for null texts."""
    start, size = 0, 0
    for i, n in enumerate(lengths.fill_null(0).to_pylist()):
        size += n
        if size >= characters:
            yield start, i + 1
            start, size = i + 1, 0
    if start < len(lengths):
        yield start, len(lengths)


@cache
def encoder(model_file: str) -> PieceEncoder:
    """One for each process; what it keeps of words is freed at the end of each task."""
    return PieceEncoder(model_file)


def encode(docs: DataFrame, model_file: str, text: str = "text", into: str = "pieces", with_ids: bool = True) -> DataFrame:
    """docs with a struct of the whole text's n_tokens, ids_sha256 and decoded_sha256 and, if asked for, its ids.

    ids_sha256 is the digest of the decimal ids joined by commas, decoded_sha256 that of the text decoded from them.
    A column named as into is replaced.
    """
    docs = docs.drop(into)
    place = docs.columns.index(text)
    fields = [T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())]
    arrow = [pa.field("n_tokens", pa.int64()), pa.field("ids_sha256", pa.string()), pa.field("decoded_sha256", pa.string())]
    if with_ids:
        fields.append(T.StructField("ids", T.ArrayType(T.IntegerType())))
        arrow.append(pa.field("ids", pa.list_(pa.int32())))
    schema = T.StructType([*docs.schema.fields, T.StructField(into, T.StructType(fields))])

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(model_file)
        for batch in batches:
            column = batch.column(place)
            for start, end in _slices(pc.utf8_length(column)):
                sizes, of_ids, of_texts, flat = [], [], [], []
                for places in own.encode(column.slice(start, end - start).to_pylist()):
                    ids = own.ids_of(places)
                    sizes.append(len(ids))
                    of_ids.append(hashlib.sha256(b",".join([own.text[p] for p in places])).hexdigest())
                    decoded = own.library.decode(ids.tolist()) if len(ids) else ""
                    of_texts.append(hashlib.sha256(decoded.encode("utf-8", "surrogatepass")).hexdigest())
                    if with_ids:
                        flat.append(ids)
                columns = [pa.array(sizes, pa.int64()), pa.array(of_ids, pa.string()), pa.array(of_texts, pa.string())]
                if with_ids:
                    offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
                    columns.append(pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(flat))))
                made = pa.StructArray.from_arrays(columns, fields=arrow)
                yield pa.RecordBatch.from_arrays([*(batch.column(i).slice(start, end - start) for i in range(batch.num_columns)), made], [*batch.schema.names, into])
        own.forget()

    return docs.mapInArrow(apply, schema)
