"""Tokenizing whole texts by chunks that no token crosses, each distinct chunk once.

Arrow splits the texts of a batch and numbers their distinct chunks; only these
reach Python, and the batch's ids are one Arrow ``take`` of theirs. A worker process
keeps the ids of chunks it has met as packed 32-bit integers. The cache is bounded:
it keeps the chunks met last, between CACHE_CHUNKS and twice as many.
"""

from __future__ import annotations

import functools
import re
import struct
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CACHE_CHUNKS = 250_000


class ChunkCache(dict):
    """chunk -> packed little-endian int32 ids; ``encode`` (of this cache and a chunk)
    gives what is missing. When full, the entries become the older ones, which are
    dropped at the next turn unless they were met again."""

    def __init__(self, encode):
        super().__init__()
        self.encode, self.older = encode, {}

    def __missing__(self, chunk: str) -> bytes:
        ids = self.older.get(chunk)
        if ids is None:
            ids = self.encode(self, chunk)
        if len(self) >= CACHE_CHUNKS:
            self.older = dict(self)
            self.clear()
        self[chunk] = ids
        return ids

    def packed(self, chunks: list[str]) -> bytes:
        return b"".join(map(self.__getitem__, chunks))

    def column(self, chunks: pa.StringArray) -> pa.LargeBinaryArray:
        """Ids of a column's chunks, each distinct one looked up once."""
        chunks = chunks.dictionary_encode()
        return pa.array(map(self.__getitem__, chunks.dictionary.to_pylist()), pa.large_binary()).take(chunks.indices)


class WordTable:
    """Words and their packed ids as Arrow columns; ``encode`` gives those of all words that a
    column misses at once. When it holds more than twice CACHE_CHUNKS, those met last stay."""

    def __init__(self, encode: Callable[[pa.StringArray], pa.LargeBinaryArray]):
        self.encode, self.calls = encode, 0
        self.words, self.ids, self.met = pa.array([], pa.string()), pa.array([], pa.large_binary()), np.zeros(0, np.int64)

    def column(self, words: pa.StringArray) -> pa.LargeBinaryArray:
        words = words.dictionary_encode()
        place = pc.index_in(words.dictionary, value_set=self.words)
        new = words.dictionary.filter(pc.is_null(place))
        place = pc.fill_null(place, -1).to_numpy(zero_copy_only=False).copy()
        place[place < 0] = len(self.words) + np.arange(len(new))
        if len(new):
            self.words = pa.concat_arrays([self.words, new])
            self.ids = pa.concat_arrays([self.ids, self.encode(new)])
            self.met = np.concatenate([self.met, np.zeros(len(new), np.int64)])
        self.calls += 1
        self.met[place] = self.calls
        out = self.ids.take(pa.array(place[words.indices.to_numpy()]))
        if len(self.words) > 2 * CACHE_CHUNKS:
            stay = np.argsort(-self.met, kind="stable")[:CACHE_CHUNKS]
            self.words, self.ids, self.met = self.words.take(pa.array(stay)), self.ids.take(pa.array(stay)), self.met[stay]
        return out


def packed(ids: list[int]) -> bytes:
    """Ids as little-endian 32-bit integers."""
    return struct.pack(f"<{len(ids)}i", *ids)


def id_lists(packed: list[bytes]) -> pa.ListArray:
    """Documents' packed ids as one Arrow list array."""
    offsets = np.concatenate([[0], np.cumsum([len(p) // 4 for p in packed], dtype=np.int64)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(packed), dtype="<i4")))


# --- the word tokenizer -------------------------------------------------------------

_LETTERS = "A-Za-zÀ-ÖØ-öø-ÿ"
_TAIL = ".,!?;:|#$%&*"
_SHAPE = f"([{_LETTERS}]+)([{_TAIL}]*)"
_PLAIN = re.compile(_SHAPE).fullmatch
_EACH_LETTER = "".join(c for c in map(chr, range(256)) if re.match(f"[{_LETTERS}]", c))

#: Words that pass the merge model in one call, as one text.
AT_ONCE = 16_384


@functools.cache
def word_tokenizer(path: str) -> ChunkCache:
    """Cache over a ``tokenizers`` file of byte-level words with lower-casing.

    Plain words go straight to the file's merge model, spelled as its normalizer and
    byte mapping spell them, once for all their cases and trailing punctuation;
    everything else passes the whole tokenizer. ``words`` of the cache is the table of
    plain lower-case words that columns of texts use.
    """
    from tokenizers import Tokenizer
    from tokenizers.pre_tokenizers import ByteLevel, CharDelimiterSplit

    whole = Tokenizer.from_file(path)
    whole.encode_special_tokens = True
    level = ByteLevel(add_prefix_space=False, use_regex=False)
    spelled = str.maketrans({c: level.pre_tokenize_str(c)[0][0] for c in _EACH_LETTER})
    merges = Tokenizer(whole.model)
    merges.pre_tokenizer = CharDelimiterSplit(" ")
    suffix = whole.model.end_of_word_suffix
    last = np.zeros(1 + max(whole.get_vocab().values()), bool)  # tokens that end a word
    last[[i for t, i in whole.get_vocab().items() if suffix and t.endswith(suffix)]] = True

    def one(word: str) -> bytes:
        return packed([t.id for t in whole.model.tokenize(word if word.isascii() else word.translate(spelled))])

    def several(words: pa.StringArray) -> pa.LargeBinaryArray:
        out = []
        for at in range(0, len(words), AT_ONCE):
            part = words.slice(at, AT_ONCE).to_numpy(zero_copy_only=False).tolist()
            ids = np.array(merges.encode_batch_fast([" ".join(part).translate(spelled)], add_special_tokens=False)[0].ids, "<i4")
            ends = np.flatnonzero(last[ids]) + 1
            if len(ends) == len(part):
                ends = np.append(0, 4 * ends)
                out.append(pa.Array.from_buffers(pa.large_binary(), len(part), [None, pa.py_buffer(ends), pa.py_buffer(ids)]))
            else:  # a model whose tokens do not show where words end
                out.append(pa.array(map(one, part), pa.large_binary()))
        return pa.concat_arrays(out)

    def encode(known: ChunkCache, chunk: str) -> bytes:
        m = _PLAIN(chunk)
        if m is None:
            return packed(whole.encode(chunk, add_special_tokens=False).ids)
        word, tail = m.groups()
        low = word.lower()
        if tail or low != word:
            return known[low] + known[tail] if tail else known[low]
        return one(word)

    cache = ChunkCache(encode)
    cache.words = WordTable(several)
    return cache


def chunk_ids(chunks: pa.StringArray, path: str) -> pa.LargeBinaryArray:
    """Packed ids of each chunk. Plain ones are put together from their lower-case word's
    and their trailing punctuation's."""
    known = word_tokenizer(path)
    plain = pc.match_substring_regex(chunks, f"^{_SHAPE}$")
    own = chunks.filter(plain)
    word = known.words.column(pc.utf8_lower(pc.utf8_rtrim(own, _TAIL)))
    tail = known.column(pc.utf8_ltrim(own, _EACH_LETTER))
    rest = known.column(chunks.filter(pc.invert(plain)))
    both = pa.concat_arrays([pc.binary_join_element_wise(word, tail, pa.scalar(b"", pa.large_binary())), rest])
    place = np.argsort(~plain.to_numpy(zero_copy_only=False), kind="stable")  # plain ones first
    return both.take(pa.array(np.argsort(place, kind="stable")))


def text_ids(texts: pa.StringArray, path: str) -> list[memoryview]:
    """Packed ids of each text; a null one has none."""
    spaced = pc.replace_substring(pc.replace_substring(pc.fill_null(texts, ""), "\n", " "), "\t", " ")
    lists = pc.split_pattern(spaced, " ")
    chunks = lists.flatten().dictionary_encode()
    _, ends, data = chunk_ids(chunks.dictionary, path).take(chunks.indices).buffers()
    ends = np.frombuffer(ends, np.int64)[lists.offsets.to_numpy() - lists.offsets[0].as_py()].tolist()
    whole = memoryview(data)
    return [whole[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]


def word_ids(text: str | None, path: str) -> bytes:
    """Packed ids of one text."""
    return bytes(text_ids(pa.array([text], pa.string()), path)[0])
