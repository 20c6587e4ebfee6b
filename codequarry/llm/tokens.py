"""Token ids written in a binary format compressed by Re-Pair grammars, with random access.

Documents stand in ascending doc_id order over range partitions; each partition's documents are cut into shards of about SHARD_BYTES bytes
of text, and each shard is compressed on its own. Re-Pair replaces frequent neighbouring ids by new symbols, round by round, until no pair of
neighbours occurs LEAST times; a round replaces many pairs at once, the most frequent first where they overlap. Rules are stored with the number of ids that each symbol expands to, so a document's ids can be
found and decoded without the rest of the shard.

Shards are the rows of Parquet files in the shared folder: Spark's writer commits them whole, whichever executor is lost, and any store that Spark
reads will do. A shard's payload, all integers little-endian:

    magic "RPG2", then uint32: rules, docs, symbols, blocks, bytes of the head
    the head, one zstandard frame:
        uint32[rules, 2]  the two symbols of a rule; rule r is symbol BASE + r
        uint32[rules]     ids it expands to
        uint32[docs]      symbols of each document (its end id included)
        uint32[docs]      ids of each document (its end id included)
        uint32[blocks]    ids of each block
        uint32[blocks]    bytes of each block
    the blocks, a zstandard frame each: uint32 symbols, BLOCK of them, fewer in the last

The documents' symbols stand one after the other, whatever the blocks. A document is decoded from the blocks that it lies in, an id from one block.
END stands for a document's end id within a shard, so that no rule spans two documents.
"""

from __future__ import annotations

import json
import os
import struct
import zlib
from collections.abc import Iterator
from functools import cached_property, lru_cache
from unicodedata import is_normalized

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ._common import kind, shared_path
from ._words import slices

END_ID, SHARD_BYTES, LEAST, BLOCK = 2, 8 << 20, 16, 1 << 16
BASE, END = 1 << 20, (1 << 32) - 1
_HASH_BITS, _TOGETHER, _ODD = 20, 2000, np.uint64(0x9E3779B97F4A7C15)
#: Signs that the tokenizer splits from letters beside them; code points that Arrow takes for white space, or lower-cases otherwise, than it does.
_SIGNS, _UNLIKE = ".,!?#%&*$|;:()", "[\x1c-\x1f\u0130]"
_MAGIC = b"RPG2"


@lru_cache(maxsize=2)
def _tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


#: What a tokenizer file must say for its texts to be encoded part by part.
_BY_PARTS = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {"type": "Sequence", "pretokenizers": [{"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True}, {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]},
    "truncation": None, "padding": None, "post_processor": None,
}
_BY_PARTS_MODEL = {"type": "BPE", "dropout": None, "unk_token": None, "continuing_subword_prefix": None, "end_of_word_suffix": "</w>", "fuse_unk": False, "byte_fallback": False, "ignore_merges": False}


@lru_cache(maxsize=2)
def by_parts(path: str) -> bool:
    """Whether the ids of a text are those of its parts, as encode's short way needs: the file says what _BY_PARTS says, and no added token holds white space or takes any."""
    said = json.loads(_tokenizer(path).to_str())
    plain = all(not (t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"]) and t["content"].split() == [t["content"]] for t in said["added_tokens"])
    return plain and all(said[k] == v for k, v in _BY_PARTS.items()) and all(said["model"].get(k) == v for k, v in _BY_PARTS_MODEL.items())


@lru_cache(maxsize=2)
def _letter_tokenizer(path: str):
    """The same model for lower-case words of letters, which need neither the pattern nor the composition of the whole."""
    from tokenizers import Tokenizer, normalizers, pre_tokenizers

    t = Tokenizer.from_str(_tokenizer(path).to_str())
    t.normalizer = normalizers.Lowercase()
    t.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
    return t


@lru_cache(maxsize=2)
def _word_ends(path: str) -> np.ndarray:
    vocab = _tokenizer(path).get_vocab(with_added_tokens=True)
    ends = np.zeros(max(vocab.values()) + 1, dtype=bool)
    ends[[i for token, i in vocab.items() if token.endswith("</w>")]] = True
    return ends


def _encode_each(words: list[str], path: str) -> list[np.ndarray]:
    return [np.array(e.ids, dtype=np.uint32) for e in _tokenizer(path).encode_batch_fast(words, add_special_tokens=False)]


#: What a worker remembers of each tokenizer from shard to shard: words of letters, their ids, ids a word; at most KNOWN_WORDS words.
KNOWN_WORDS = 1 << 18
_known: dict[str, tuple[pa.Array, np.ndarray, np.ndarray]] = {}


def _letter_ids(words: pa.Array, path: str) -> tuple[np.ndarray, np.ndarray]:
    """(ids, ids a word) of distinct lower-case words of letters; only those that aren't known yet are encoded."""
    if path not in _known:
        ids, sizes = _encode_letters(words, path)
    else:
        known, known_ids, known_sizes = _known[path]
        at = pc.index_in(words, value_set=known)
        new = at.is_null().to_numpy(zero_copy_only=False)
        new_words = words.filter(pa.array(new))
        new_ids, new_sizes = _encode_letters(new_words, path)
        which = pc.fill_null(at, 0).to_numpy(zero_copy_only=False).astype(np.int64)
        which[new] = len(known) + np.arange(len(new_words))
        every_ids, every_sizes = np.concatenate([known_ids, new_ids]), np.concatenate([known_sizes, new_sizes])
        ids, sizes = _gather(every_ids, every_sizes, which), every_sizes[which]
        if len(known) + len(new_words) <= KNOWN_WORDS:
            _known[path] = pa.concat_arrays([known, new_words]), every_ids, every_sizes
            return ids, sizes
    if len(words) <= KNOWN_WORDS:
        _known[path] = words, ids, sizes
    return ids, sizes


def _encode_letters(words: pa.Array, path: str) -> tuple[np.ndarray, np.ndarray]:
    """(ids, ids a word) of lower-case words of letters, encoded many to a text; a word's last id is the one whose token ends the word."""
    places = pa.array([*range(0, len(words), _TOGETHER), len(words)], pa.int32())
    texts = pc.binary_join(pa.ListArray.from_arrays(places, words), " ").to_pylist() if len(words) else []
    found, sizes = [], []
    for k, e in enumerate(_letter_tokenizer(path).encode_batch_fast(texts, add_special_tokens=False)):
        ids = np.array(e.ids, dtype=np.uint32)
        part = words.slice(k * _TOGETHER, _TOGETHER)
        n = np.diff(np.nonzero(_word_ends(path)[ids])[0], prepend=-1)
        if len(n) != len(part):
            each = _encode_each(part.to_pylist(), path)
            ids, n = np.concatenate(each), np.array([len(x) for x in each])
        found.append(ids)
        sizes.append(n)
    return (np.concatenate(found), np.concatenate(sizes)) if found else (np.zeros(0, dtype=np.uint32), np.zeros(0, dtype=np.int64))


def _numbered(values: pa.Array) -> tuple[pa.Array, np.ndarray]:
    d = values.dictionary_encode()
    return d.dictionary, d.indices.to_numpy(zero_copy_only=False)


def _bytes_of(values: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of strings one after the other, and where each begins (with the end of the last)."""
    _, offsets, data = values.buffers()
    at = np.frombuffer(offsets, dtype=np.int32)[values.offset : values.offset + len(values) + 1] if len(values) else np.zeros(1, dtype=np.int32)
    return np.frombuffer(data or b"", dtype=np.uint8)[at[0] : at[-1]], at.astype(np.int64) - int(at[0])


def _signs_after(words: pa.Array, cores: pa.Array) -> pa.Array:
    """What follows each core in its word."""
    data, at = _bytes_of(words)
    n = at[1:] - at[:-1] - np.diff(_bytes_of(cores)[1])
    upto = np.concatenate([[0], np.cumsum(n)])
    take = np.repeat(at[1:] - upto[1:], n) + np.arange(int(upto[-1]))
    return pa.StringArray.from_buffers(len(words), pa.py_buffer(upto.astype(np.int32)), pa.py_buffer(data[take]))


def _letters(words: pa.Array) -> np.ndarray:
    """Whether each word is of letters alone and composed."""
    plain = pc.string_is_ascii(words).to_numpy(zero_copy_only=False)
    whole = pc.ascii_is_alpha(words).to_numpy(zero_copy_only=False) & plain
    other = np.nonzero(~plain)[0]
    whole[other] = [c.isalpha() and is_normalized("NFC", c) for c in words.take(pa.array(other)).to_pylist()]
    return whole


def _unlike(texts: pa.Array) -> np.ndarray:
    """Places of the texts that hold a sign of _UNLIKE. Nearly always none does, which their bytes tell: 0x1c to 0x1f, or 0xc4 0xb0."""
    data, _ = _bytes_of(texts)
    dotted = np.nonzero(data[:-1] == 0xC4)[0]
    if not ((data - np.uint8(0x1C)) < 4).any() and not (data[dotted + 1] == 0xB0).any():
        return np.zeros(0, dtype=np.int64)
    return np.nonzero(pc.match_substring_regex(texts, _UNLIKE).to_numpy(zero_copy_only=False))[0]


def _gather(ids: np.ndarray, sizes: np.ndarray, which: np.ndarray) -> np.ndarray:
    """The ids of pieces `which`, one after the other; ids and sizes are of all pieces in turn."""
    n = _take(sizes, which) if len(which) else sizes[:0]
    first, upto = np.cumsum(sizes) - sizes, np.concatenate([[0], np.cumsum(n)])
    out = np.empty(int(upto[-1]), dtype=ids.dtype)
    for part in _parts(len(which), 1 << 16):
        m, low, high = n[part], int(upto[part.start]), int(upto[part.stop])
        if high > low:
            out[low:high] = _take(ids, np.repeat(_take(first, which[part]) - upto[part] + low, m) + np.arange(high - low))
    return out


def encode(texts: pa.Array, path: str) -> tuple[np.ndarray, np.ndarray]:
    """(ids as uint32, ids a text) of whole texts without special tokens; null texts have none.

    Where the tokenizer lower-cases, drops white space, never joins what it separates, and splits signs from letters (by_parts), the ids of a text are those of its
    parts between white space, and those of a part are those of its letters and of the signs at its end. Each distinct piece is encoded once, and
    the texts' ids are gathered from the pieces'. Any other tokenizer encodes whole texts.
    """
    texts = pc.fill_null(texts, "").cast(pa.string())
    if not by_parts(path):
        each = _encode_each(texts.to_pylist(), path)
        return np.concatenate([np.zeros(0, dtype=np.uint32), *each]), np.array([len(x) for x in each], dtype=np.int64)
    unlike = _unlike(texts)
    if len(unlike):
        keep = np.ones(len(texts), dtype=bool)
        keep[unlike] = False
        split = pc.utf8_split_whitespace(pc.if_else(pa.array(keep), texts, ""))
    else:
        split = pc.utf8_split_whitespace(texts)
    word = split.flatten().dictionary_encode()
    distinct, at = word.dictionary, word.indices.to_numpy(zero_copy_only=False)
    lower = pc.utf8_lower(distinct)
    core = pc.utf8_rtrim(lower, characters=_SIGNS)
    cores, core_of = _numbered(core)
    ends, end_of = _numbered(_signs_after(lower, core))
    whole = _letters(cores)
    easy = whole[core_of]  # words whose ids are those of their letters and of their signs
    hard = distinct.filter(pa.array(~easy)).to_pylist()

    letter_ids, letter_sizes = _letter_ids(cores.filter(pa.array(whole)), path)
    others = _encode_each(ends.to_pylist(), path) + _encode_each(hard, path)
    ids = np.concatenate([letter_ids, *others]) if others else letter_ids
    sizes = np.concatenate([letter_sizes, np.array([len(x) for x in others], dtype=np.int64)]).astype(np.int64)
    # Two pieces a word: letters and signs, or the word as it is and the empty sign.
    pieces = np.empty((len(distinct), 2), dtype=np.int64)
    pieces[easy, 0] = (np.cumsum(whole) - 1)[core_of[easy]]
    pieces[easy, 1] = len(letter_sizes) + end_of[easy]
    pieces[~easy, 0] = len(letter_sizes) + len(ends) + np.arange(len(hard))
    pieces[~easy, 1] = len(sizes)
    sizes = np.append(sizes, 0)
    word_ids = _gather(ids, sizes, pieces.ravel())
    word_sizes = sizes[pieces].sum(axis=1)
    flat = _gather(word_ids, word_sizes, at)
    upto = np.concatenate([[0], np.cumsum(word_sizes[at])])
    bounds = split.offsets.to_numpy(zero_copy_only=False)
    counts = upto[bounds[1:] - bounds[0]] - upto[bounds[:-1] - bounds[0]]
    if len(unlike):
        each = np.split(flat, np.cumsum(counts)[:-1])
        for k, x in zip(unlike, _encode_each([texts[int(k)].as_py() for k in unlike], path), strict=True):
            each[k], counts[k] = x, len(x)
        flat = np.concatenate(each)
    return flat, counts


def _take(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    """values[at], for places that are all inside: faster than an index, and much faster than a mask."""
    return values.take(at, mode="clip")


def _where(mask: np.ndarray) -> np.ndarray:
    return np.nonzero(mask)[0]


def _parts(n: int, size: int = 1 << 19) -> list[slice]:
    """Parts of an array of n, so that what is made of them on the way is small."""
    return [slice(k, min(n, k + size)) for k in range(0, n, size)]


def _apart(at: np.ndarray, after: np.ndarray) -> np.ndarray:
    """Which of the ascending places are in odd place in a run of neighbours, so that none are neighbours; after: the place after each."""
    index = np.arange(len(at))
    first = np.ones(len(at), dtype=bool)
    first[1:] = after[:-1] != at[1:]
    return _where((index - np.maximum.accumulate(np.where(first, index, 0))) & 1 == 0)


def _frequent(keys: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(places of the keys that occur `least` times or more, rank among such keys of each of these, number by rank); the most frequent key is last.

    Keys are counted by hash: one key stands for its slot, most likely the most frequent there; those that aren't it are left for another hash, and the last
    few are sorted.
    """
    at, factor, found, first = None, int(_ODD), [], 0
    numbers = np.full(len(keys), -1, dtype=np.int32)
    while len(keys) > 1 << _HASH_BITS - 6:
        slots = lambda part: (keys[part] * np.uint64(factor) >> np.uint64(64 - _HASH_BITS)).view(np.int64)  # noqa: B023, E731
        here, n, own = np.empty(1 << _HASH_BITS, dtype=np.uint64), np.zeros(1 << _HASH_BITS, dtype=np.int64), np.empty(len(keys), dtype=bool)
        for part in _parts(len(keys)):
            here[slots(part)] = keys[part]
        for part in _parts(len(keys)):
            slot = slots(part)
            own[part] = _take(here, slot) == keys[part]
            n += np.bincount(_take(slot, _where(own[part])), minlength=1 << _HASH_BITS)
        full = _where(n >= least)
        number = np.full(1 << _HASH_BITS, -1, dtype=np.int32)
        number[full] = np.arange(first, first + len(full))
        for part in _parts(len(keys)):
            mine = _where(own[part])
            numbers[mine + part.start if at is None else _take(at[part], mine)] = _take(number, _take(slots(part), mine))
        found.append(np.stack([here[full], n[full].astype(np.uint64)]))
        rest = _where(~own)
        first, at, keys, factor = first + len(full), rest if at is None else _take(at, rest), _take(keys, rest), factor * int(_ODD) % (1 << 64)
    at = np.arange(len(keys)) if at is None else at
    some, which, n = np.unique(keys, return_inverse=True, return_counts=True)
    taken = _where((n >= least)[which])
    found.append(np.stack([some[n >= least], n[n >= least].astype(np.uint64)]))
    numbers[at[taken]] = (first + np.cumsum(n >= least) - 1)[which[taken]]
    place = _where(numbers >= 0)
    key, n = np.concatenate(found, axis=1)
    # Ties stand in the order of a hash, else the pairs of a repeated passage would wait for one another in turn.
    order = np.lexsort((key * _ODD, n))
    rank = np.empty(len(order), dtype=np.int32)
    rank[order] = np.arange(len(order))
    return place, rank[_take(numbers, place)], n[order].astype(np.int64)


def compress(ids: np.ndarray, least: int = LEAST) -> tuple[np.ndarray, np.ndarray]:
    """(symbols, rules) for ids in which END closes each document. No pair of neighbours within a document is left `least` times or more.

    In a round each place goes to its most frequent pair, from left to right where a pair overlaps itself; pairs that hold half their places, and always
    the most frequent one, become rules. After the first round only pairs that were frequent and those beside replaced places are counted again:
    the count of any other pair can't grow. Replaced places stay in the array, passed over by links, until a quarter of it is such.
    """
    x, rules, n_rules = ids.astype(np.uint32), [], 0
    after = before = None  # the place after and before each, once some in between are passed over
    nxt = lambda at: at + 1 if after is None else _take(after, at)
    prev = lambda at: at - 1 if before is None else _take(before, at)

    def pairs_at(at: np.ndarray) -> np.ndarray:
        keys = np.empty(len(at), dtype=np.uint64)
        for part in _parts(len(at)):
            keys[part] = _take(x, at[part]).astype(np.uint64) << np.uint64(32) | _take(x, nxt(at[part]))
        return keys

    alive, gone = np.ones(len(x), dtype=bool), 0
    ranks = np.zeros(len(x) + 2, dtype=np.int32)  # the rank, from 1, of the pair at each place, itself counted from 1: the first and last are no place
    here = _where((x[:-1] != END) & (x[1:] != END))
    while len(here):
        place, rank, n = _frequent(pairs_at(here), least)
        if not len(n):
            break
        here, own, wins = _take(here, place), rank + 1, []
        for part in _parts(len(here)):
            ranks[here[part] + 1] = own[part]
        for part in _parts(len(here)):
            h, o = here[part], own[part]
            wins.append(_where((o >= _take(ranks, prev(h) + 1)) & (o >= _take(ranks, nxt(h) + 1))) + part.start)
        ranks[:] = 0
        wins = np.concatenate(wins)
        at = _take(here, wins)
        wins = _take(wins, _apart(at, nxt(at)))
        held = np.bincount(_take(rank, wins), minlength=len(n))
        taken = 2 * held >= n
        taken[-1] = True
        wins = _take(wins, _where(_take(taken, _take(rank, wins))))
        at, won = _take(here, wins), _take(rank, wins)
        number = np.cumsum(taken) - 1
        pairs = np.empty(int(taken.sum()), dtype=np.uint64)
        pairs[number[won]] = pairs_at(at)
        x[at] = (BASE + n_rules + number)[won].astype(np.uint32)
        n_rules += len(pairs)
        rules.append(np.stack([pairs >> np.uint64(32), pairs & np.uint64(END)], axis=1).astype(np.uint32))
        dropped = nxt(at)
        alive[dropped] = False
        gone += len(dropped)
        ask = np.zeros(len(x), dtype=bool)
        ask[here] = True
        ask[at] = True
        # A place before one, if it is passed over now, belongs to a replaced place, which is asked.
        ask[np.maximum(prev(at), 0)] = True
        if 4 * gone >= len(x):
            left = _where(alive)
            x, ask = _take(x, left), _take(ask, left)
            after = before = None
            alive, gone, ranks = np.ones(len(x), dtype=bool), 0, np.zeros(len(x) + 2, dtype=np.int32)
            here = _where(ask[:-1])
        else:
            if after is None:
                after, before = np.arange(1, len(x) + 1), np.arange(-1, len(x) - 1)
            then = _take(after, dropped)
            after[at] = then
            inside = then < len(x)
            before[then[inside]] = at[inside]
            ask &= alive
            here = _where(ask)
            here = here[_take(after, here) < len(x)]
        here = _take(here, _where((_take(x, here) != END) & (_take(x, nxt(here)) != END)))
    return _take(x, _where(alive)), np.concatenate(rules) if rules else np.zeros((0, 2), dtype=np.uint32)


def _steps(rules: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of rules whose symbols are ids and rules before the range: about one a round."""
    latest = np.where((rules >= BASE) & (rules != END), rules.astype(np.int64) - BASE, -1).max(axis=1, initial=-1)
    start = 0
    while start < len(rules):
        later = _where(latest[start:] >= start)
        end = start + int(later[0]) if len(later) else len(rules)
        if end == start:
            raise ValueError("a rule stands before its symbols")
        yield start, end
        start = end


def expansion_lengths(rules: np.ndarray) -> np.ndarray:
    """Ids that each rule expands to; a rule's symbols come before it."""
    n = np.ones(len(rules), dtype=np.int64)
    for start, end in _steps(rules):
        n[start:end] = _sizes(rules[start:end].ravel(), n).reshape(-1, 2).sum(axis=1)
    return n


def _spelled(symbols: np.ndarray, table: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """The ids of symbols; table holds those of all rules one after the other, bounds where each rule's begin (with the end of the last)."""
    at = _where((symbols >= BASE) & (symbols != END))
    which = symbols[at] - np.uint32(BASE)
    size = np.ones(len(symbols), dtype=np.int64)
    size[at] = (bounds[1:] - bounds[:-1])[which]
    # An id stands for itself, after the table.
    source = np.arange(len(table), len(table) + len(symbols))
    source[at] = bounds[:-1][which]
    upto = np.cumsum(size)
    place = np.repeat(source - (upto - size), size)
    place += np.arange(len(place))
    return _take(np.concatenate([table, symbols]), place) if len(place) else symbols


def _expansions(rules: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """table and bounds, as _spelled has them."""
    bounds = np.concatenate([[0], np.cumsum(expansion_lengths(rules))])
    table = np.empty(int(bounds[-1]), dtype=np.uint32)
    for start, end in _steps(rules):
        table[bounds[start] : bounds[end]] = _spelled(rules[start:end].ravel(), table, bounds[: start + 1])
    return table, bounds


def expand(symbols: np.ndarray, rules: np.ndarray, expansions: tuple[np.ndarray, np.ndarray] | None = None) -> np.ndarray:
    """The ids of symbols; END becomes the end id. expansions: of the rules, where they are known."""
    ids = _spelled(symbols, *(expansions or _expansions(rules)))
    ids[ids == END] = END_ID
    return ids.astype("<u4")


def pack(ids: np.ndarray, n_ids: np.ndarray) -> bytes:
    symbols, rules = compress(ids)
    ends, lengths = np.nonzero(symbols == END)[0], expansion_lengths(rules)
    per_doc = np.diff(np.concatenate([[-1], ends]))
    packer = zstandard.ZstdCompressor(level=1)
    frames = [packer.compress(symbols[k : k + BLOCK].astype("<u4").tobytes()) for k in range(0, len(symbols), BLOCK)]
    block_ids = [int(_sizes(symbols[k : k + BLOCK], lengths).sum()) for k in range(0, len(symbols), BLOCK)]
    head = packer.compress(b"".join(np.asarray(p).astype("<u4").tobytes() for p in (rules, lengths, per_doc, n_ids, block_ids, [len(f) for f in frames])))
    return b"".join([_MAGIC, struct.pack("<5I", len(rules), len(n_ids), len(symbols), len(frames), len(head)), head, *frames])


def _sizes(symbols: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Ids that each symbol expands to, by the rules' lengths."""
    size, is_rule = np.ones(len(symbols), dtype=np.int64), (symbols >= BASE) & (symbols != END)
    size[is_rule] = lengths[symbols[is_rule] - BASE]
    return size


class Shard:
    """A shard's payload, read."""

    def __init__(self, payload: bytes) -> None:
        if payload[:4] != _MAGIC:
            raise ValueError("not a shard")
        r, d, s, b, size = struct.unpack("<5I", payload[4:24])
        self._payload, self._unpacker = payload, zstandard.ZstdDecompressor()
        data = np.frombuffer(self._unpacker.decompress(payload[24 : 24 + size]), dtype="<u4")
        self.rules, data = data[: 2 * r].reshape(r, 2), data[2 * r :]
        self.lengths, self.per_doc, self.n_ids, block_ids, block_bytes = np.split(data, [r, r + d, r + 2 * d, r + 2 * d + b])
        upto = lambda n: np.concatenate([[0], np.cumsum(n, dtype=np.int64)])
        self.symbol_from, self.id_from, self.block_from, self.byte_from = upto(self.per_doc), upto(self.n_ids), upto(block_ids), 24 + size + upto(block_bytes)
        if len(block_bytes) != b or self.symbol_from[-1] != s or self.byte_from[-1] != len(payload):
            raise ValueError("a shard's parts don't add up")

    @cached_property
    def expansions(self) -> tuple[np.ndarray, np.ndarray]:
        return _expansions(self.rules)

    def block(self, j: int) -> np.ndarray:
        """The symbols of the j-th block."""
        return np.frombuffer(self._unpacker.decompress(self._payload[self.byte_from[j] : self.byte_from[j + 1]]), dtype="<u4")

    def document(self, k: int) -> np.ndarray:
        """The ids of the k-th document, its end id included, from the blocks that it lies in."""
        first, last = int(self.symbol_from[k]), int(self.symbol_from[k + 1])
        blocks = range(first // BLOCK, (last - 1) // BLOCK + 1)
        symbols = np.concatenate([self.block(j) for j in blocks])[first - blocks[0] * BLOCK : last - blocks[0] * BLOCK]
        return expand(symbols, self.rules, self.expansions)

    def token(self, k: int, i: int) -> int:
        """The i-th id of the k-th document: expansion lengths lead to its block, its symbol there, and down the symbol's rules."""
        at = int(self.id_from[k]) + i
        j = int(np.searchsorted(self.block_from, at, side="right")) - 1
        symbols = self.block(j)
        size = _sizes(symbols, self.lengths)
        upto = np.cumsum(size)
        at -= int(self.block_from[j])
        p = int(np.searchsorted(upto, at, side="right"))
        symbol, at = int(symbols[p]), at - int(upto[p] - size[p])
        while BASE <= symbol < END:
            left, right = map(int, self.rules[symbol - BASE])
            n = int(self.lengths[left - BASE]) if BASE <= left < END else 1
            symbol, at = (left, at) if at < n else (right, at - n)
        return END_ID if symbol == END else symbol

    def documents(self) -> Iterator[np.ndarray]:
        """All documents in order; a block's ids are held at a time, and those of the document that it cuts."""
        cut, k = [], 0
        for j in range(len(self.byte_from) - 1):
            ids = expand(self.block(j), self.rules, self.expansions)
            whole = int(np.searchsorted(self.id_from, self.block_from[j + 1], side="right")) - 1
            parts = np.split(ids, self.id_from[k + 1 : whole + 1] - self.block_from[j])
            for part in parts[:-1]:
                yield np.concatenate([*cut, part]) if cut else part
                cut = []
            cut, k = [*cut, parts[-1]], whole


def write(docs: DataFrame, tokenizer_path: str, path: str, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Write docs as shards under path: rows (part, shard, doc_ids, n_tokens, payload).

    Null and empty texts have just their end id. Ascending doc_id, nulls first; rows of one doc_id stand by a hash of the text, then text. An empty table writes no shard.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    # Rows without a doc_id, or of one that many share, are dealt by a hash of their texts.
    rows = rows.withColumn("_h", F.xxhash64("text")).repartitionByRange(F.col("doc_id"), F.col("_h")).sortWithinPartitions("doc_id", "_h", "text").select("doc_id", "text", F.spark_partition_id().alias("part"))
    arrow = pa.schema([("part", pa.int32()), ("shard", pa.int32()), ("doc_ids", pa.list_(to_arrow_type(rows.schema["doc_id"].dataType))), ("n_tokens", pa.int64()), ("payload", pa.binary())])
    schema = f"part int, shard int, doc_ids array<{kind(rows, 'doc_id')}>, n_tokens long, payload binary"

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, rows in enumerate(slices(batches, most=SHARD_BYTES)):
            ids, counts = encode(rows["text"].chunk(0), tokenizer_path)
            pa.default_memory_pool().release_unused()
            symbols, ends = np.empty(len(ids) + len(counts), dtype=np.uint32), np.cumsum(counts + 1) - 1
            inside = np.ones(len(symbols), dtype=bool)
            inside[ends] = False
            symbols[inside], symbols[ends] = ids, END
            del ids, inside
            row = [rows["part"][:1], [number], [rows["doc_id"].to_pylist()], [len(symbols)], [pack(symbols, counts + 1)]]
            yield pa.RecordBatch.from_arrays([pa.array(c.to_pylist() if isinstance(c, pa.ChunkedArray) else c, type=t) for c, t in zip(row, arrow.types, strict=True)], schema=arrow)

    rows.mapInArrow(shards, schema).write.parquet(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of each document, from the shards alone.

    A shard's first start is the sum of n_tokens over the shards before it: within its partition, and over the partitions before. The window over
    partitions has one row a partition; the column of payloads isn't read for either.
    """
    table = spark.read.parquet(path)
    sizes = table.select("part", "shard", "n_tokens")
    before = lambda w: F.coalesce(F.sum("n_tokens").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = sizes.groupBy("part").agg(F.sum("n_tokens").alias("n_tokens")).select("part", before(Window.orderBy("part")).alias("part_first"))
    starts = sizes.select("part", "shard", before(Window.partitionBy("part").orderBy("shard")).alias("first")).join(parts, "part").select("part", "shard", (F.col("first") + F.col("part_first")).alias("first"))
    id_type = table.schema["doc_ids"].dataType.elementType
    arrow = pa.schema([("part", pa.int32()), ("shard", pa.int32()), ("doc_id", to_arrow_type(id_type)), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                shard = Shard(batch["payload"][k].as_py())
                crc = [zlib.crc32(x) for x in shard.documents()]
                n, same = shard.n_ids.astype(np.int64), np.zeros(len(crc), dtype=np.int32)
                ids = batch["doc_ids"][k].values.cast(arrow.field("doc_id").type)
                yield pa.RecordBatch.from_arrays([pa.array(same + batch["part"][k].as_py()), pa.array(same + batch["shard"][k].as_py()), ids, pa.array(shard.id_from[:-1]), pa.array(n), pa.array(crc, type=pa.int64())], schema=arrow)

    # The documents' rows travel to their shard's first start, not the payloads.
    rows = table.select("part", "shard", "doc_ids", "payload").mapInArrow(decode, f"part int, shard int, doc_id {id_type.simpleString()}, start long, n_tokens long, ids_crc32 long")
    return rows.join(starts, ["part", "shard"]).select("doc_id", (F.col("first") + F.col("start")).alias("start"), "n_tokens", "ids_crc32")


def tokenize(docs: DataFrame, tokenizer_path: str, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write docs as shards and read them back: doc_id, start, n_tokens, ids_crc32 for every row."""
    path = path or shared_path(docs.sparkSession, "tokens")
    write(docs, tokenizer_path, path, id_col, text_col)
    return read(docs.sparkSession, path)
