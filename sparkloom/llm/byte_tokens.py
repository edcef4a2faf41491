"""Byte-level BPE ids of whole texts, by the tokenizers library, word by word.

A single space or line feed between two characters that are not white space always begins a new word of the
byte-level pattern (the space belongs to the word after it, the line feed stands alone), so cutting there never
changes the ids.  Each task hands the library the distinct words of a group of texts, many in one text, and joins
their ids.  Arrow cuts and numbers the words, numpy joins, so no word takes a step of Python where it occurs.  Texts with other white space at a cut, or with the string of a
special token that is not taken as text, go to the library whole.

Words of Latin letters, with or without marks after them, need no pattern: if no token of the vocabulary crosses
from their letters to a mark or a space, merges alone find the same ids, in less than half the time.
"""

from __future__ import annotations

import os
import re
from array import array
from collections.abc import Iterable, Iterator
from functools import cache
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: New words in one text for the library.
TOGETHER = 512
#: Letters of the same class in any version of Unicode, and marks that the pattern cuts off them.
LETTERS, MARKS = "".join(chr(c) for a, b in ((65, 90), (97, 122), (0xC0, 0xD6), (0xD8, 0xF6), (0xF8, 0x24F)) for c in range(a, b + 1)), ".,;:!?"
_PLAIN = f"\\A[A-Za-zÀ-ÖØ-öø-ɏ]+[{MARKS}]*\\z"


def _merges_alone(tokenizer_file: str, special_as_text: bool):
    """The tokenizer without its pattern, or None if its ids of joined plain words could differ from those with it."""
    from tokenizers import Tokenizer, models, pre_tokenizers

    bare = Tokenizer.from_file(tokenizer_file)
    model, pattern = bare.model, bare.pre_tokenizer
    if not (isinstance(model, models.BPE) and isinstance(pattern, pre_tokenizers.ByteLevel) and pattern.use_regex and not pattern.add_prefix_space and bare.normalizer is None):
        return None
    if model.dropout or model.ignore_merges or model.continuing_subword_prefix or model.end_of_word_suffix:
        return None
    bare.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
    bare.encode_special_tokens = special_as_text
    letters, marks, space = ("".join(sorted({c for part, _ in bare.pre_tokenizer.pre_tokenize_str(x) for c in part})) for x in (LETTERS, MARKS, " "))
    vocabulary = bare.get_vocab(with_added_tokens=False)
    own, crossing = re.compile(f"[{re.escape(letters + marks + space)}]+"), re.compile(f"[^{space}]{space}|[{re.escape(letters)}][{re.escape(marks)}]")
    if any(own.fullmatch(t) and crossing.search(t) for t in vocabulary) or not vocabulary.keys() >= set(letters + marks + space):
        return None
    return bare


class ByteTokens:
    def __init__(self, tokenizer_file: str, special_as_text: bool = False):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(tokenizer_file)
        self.library.encode_special_tokens = special_as_text
        self.bare = _merges_alone(tokenizer_file, special_as_text)
        self.specials = [] if special_as_text else [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.dtype = np.dtype("<u2") if self.library.get_vocab_size() <= 1 << 16 else np.dtype("<u4")
        self._code = "H" if self.dtype.itemsize == 2 else "I"
        self._line_feed = self._bytes(["\n"])[0]
        # In the joined words only the first id of each begins with a space.
        mark = self.library.encode(" a", add_special_tokens=False).tokens[0][0]
        self._begins = np.zeros(1 + max(self.library.get_vocab().values()), dtype=bool)
        self._begins[[i for token, i in self.library.get_vocab().items() if token.startswith(mark)]] = True

    def _bytes(self, parts: list[str]) -> list[bytes]:
        code = self._code
        return [array(code, e.ids).tobytes() for e in self.library.encode_batch_fast(parts, add_special_tokens=False)] if parts else []

    def _words(self, words: pa.Array, library) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words without a space, each with a space before it, and the number of each word's ids."""
        parts, cuts = [np.zeros(0, dtype=self.dtype)], pa.array([*range(0, len(words), TOGETHER), len(words)], pa.int32())
        for joined in pc.binary_join(pa.ListArray.from_arrays(cuts, words), pa.scalar(" ", words.type)).to_pylist():
            parts.append(np.array(library.encode_batch_fast([" " + joined], add_special_tokens=False)[0].ids, dtype=self.dtype))
        flat = np.concatenate(parts)
        starts = np.flatnonzero(self._begins[flat])
        if len(starts) == len(words) and not starts[:1].any():
            return flat, np.diff(np.append(starts, len(flat)))
        return self._flat(self._bytes([" " + w for w in words.to_pylist()]))

    def _flat(self, runs: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        return np.frombuffer(b"".join(runs), dtype=self.dtype), np.array([len(r) for r in runs], dtype=np.int64) // self.dtype.itemsize

    def _odd(self, words: list[str]) -> list[bytes | None]:
        """Ids of words, each with the space before it; None where a cut beside the word isn't safe.

        Words that begin with a line feed have no space; what follows the line feed is known to be cut there.
        """
        asked = [(2, w[1:]) if w[:1] == "\n" else (1, w) for w in words]
        kinds = [0 if not own or own[0].isspace() or own[-1].isspace() else kind for kind, own in asked]
        flat, sizes = self._words(pa.array([own for k, (_, own) in zip(kinds, asked, strict=True) if k == 1], pa.large_string()), self.library)
        raw, ends = flat.tobytes(), (np.cumsum(sizes) * self.dtype.itemsize).tolist()
        spaced = iter([raw[i:j] for i, j in pairwise([0, *ends])])
        bare = iter(self._bytes([own for k, (_, own) in zip(kinds, asked, strict=True) if k == 2]))
        return [None if k == 0 else self._line_feed + next(bare) if k == 2 else next(spaced) for k in kinds]

    def encode(self, texts: Iterable[str | None]) -> Iterator[bytes]:
        """The ids of each text, as raw little-endian unsigned integers of self.dtype."""
        texts = [t or "" for t in texts]
        column, kind = pa.array(texts, pa.large_string()), pa.large_string()
        cut = pc.if_else(pc.match_substring(column, "\n\n"), column, pc.replace_substring(column, "\n", " \n"))
        # The first word goes in as if it followed a line feed, whose ids are then left out.
        split = pc.split_pattern(pc.binary_join_element_wise(pa.scalar("\n", kind), cut, pa.scalar("", kind)), " ")
        ends, coded = split.offsets.to_numpy(), split.values.dictionary_encode()
        place, words = coded.indices.to_numpy(), coded.dictionary
        plain = pc.match_substring_regex(words, _PLAIN) if self.bare is not None else pa.array([False] * len(words), pa.bool_())
        odd = self._odd(words.filter(pc.invert(plain)).to_pylist())
        made = [self._words(words.filter(plain), self.bare), self._flat([f or b"" for f in odd])]
        # The distinct words' ids, plain words first; then the ids of all words in order.
        flat, runs = (np.concatenate([m[k] for m in made]) for k in (0, 1))
        own = np.argsort(~plain.to_numpy(zero_copy_only=False), kind="stable")
        starts, sizes, unsafe = np.zeros(len(own), dtype=np.int64), np.zeros(len(own), dtype=np.int64), np.zeros(len(own), dtype=bool)
        starts[own], sizes[own] = np.cumsum(runs) - runs, runs
        unsafe[own[len(own) - len(odd) :]] = [f is None for f in odd]
        whole = np.add.reduceat(unsafe[place], ends[:-1], dtype=np.int64) > 0 if len(texts) else unsafe
        for s in self.specials:
            whole |= pc.match_substring(column, s).to_numpy(zero_copy_only=False)
        size = sizes[place]
        after = np.append(0, np.cumsum(size))
        ids = flat[np.repeat(starts[place] - after[:-1], size) + np.arange(after[-1])]
        bounds, lead = after[ends], len(self._line_feed) // self.dtype.itemsize
        for text, alone, start, end in zip(texts, whole.tolist(), bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            yield self._bytes([text])[0] if alone else ids[start + lead : end].tobytes()


@cache
def encoder(tokenizer_file: str, special_as_text: bool = False) -> ByteTokens:
    """One for each process, as loading takes a while."""
    return ByteTokens(tokenizer_file, special_as_text)


def groups(texts: list[str | None], characters: int = 16 << 20) -> Iterator[slice]:
    """Slices of successive texts with about so many characters."""
    start, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t) if t else 0
        if size >= characters:
            yield slice(start, i + 1)
            start, size = i + 1, 0
    if start < len(texts):
        yield slice(start, len(texts))
