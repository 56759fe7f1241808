"""Token ids of whole texts by the tokenizers library's vocabularies, many words at a time.

Byte-level vocabularies split a text before merging, and every white-space run starts a new part. A text in which no
white space stands before a space, and which holds none of the vocabulary's added tokens, is therefore the concatenation
of its space-led pieces, each of which always gets the same ids. Each distinct piece of a batch is handled once. Pieces
of plain letters, digits and signs are split into parts by the classes of their bytes, for all pieces together; parts
not seen before are merged together too, by the merges that the library's model holds. Whatever is not plainly of that
kind (apostrophes, other white space or scripts, long parts) goes to the library, piece by piece or as a whole text.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from pixelweave.llm.common import worker_cache

VOCABULARY = "byte_bpe_50k.json"
#: Odd pieces of one generation that a worker process remembers (there are two), slots for parts and ids of parts that it
#: remembers, bytes of a part that is merged here, and characters of texts that are looked at together; none of them
#: changes any result.
REMEMBERED, SLOTS, POOL, SHORT, TOGETHER = 100_000, 1 << 20, 1 << 22, 24, 4_000_000
# fixed values: what Unicode counts as white space
ASCII_SPACES = " \t\n\x0b\x0c\r"
OTHER_SPACES = "\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
#: Classes of bytes in plain pieces; letters up to U+024F have one of two bytes, of which the first is 0xC3 to 0xC9.
ODD, LETTER, DIGIT, SIGN, BREAK = range(5)


def byte_classes() -> np.ndarray:
    kind = np.full(256, ODD, np.uint8)
    for b in range(33, 127):
        kind[b] = LETTER if chr(b).isalpha() else DIGIT if chr(b).isdigit() else SIGN
    kind[ord("'")] = ODD  # may start a part of its own
    kind[ord("\n")] = BREAK
    kind[0x80:0xC0] = kind[0xC3:0xCA] = LETTER  # later bytes count only after a first byte that is not odd
    return kind


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def byte_spelling() -> dict[int, str]:
    """Bytes to the letters that byte-level vocabularies write for them: themselves if visible, else from 256 on."""
    visible = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = [b for b in range(256) if b not in visible]
    return {b: chr(256 + k) for k, b in enumerate(hidden)}


class PairRanks:
    """(left id, right id) -> rank of their merge, or NONE: a few hash tables without collisions, for whole arrays."""

    NONE = np.int32(1 << 30)

    def __init__(self, left: np.ndarray, right: np.ndarray):
        key, rank = self.keys(left, right), np.arange(len(left), dtype=np.int32)
        self.levels = []
        bits = max(8, int(len(key)).bit_length() + 4)
        while len(key):
            factor = np.uint64(0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019 * len(self.levels) & ((1 << 64) - 1) | 1)
            slot = self.slots(key, factor, bits)
            _, first = np.unique(slot, return_index=True)
            keys, ranks = np.full(1 << bits, ~np.uint64(0)), np.full(1 << bits, self.NONE, np.int32)
            keys[slot[first]], ranks[slot[first]] = key[first], rank[first]
            self.levels.append((factor, bits, keys, ranks))
            rest = np.setdiff1d(np.arange(len(key)), first)
            key, rank, bits = key[rest], rank[rest], max(8, int(len(rest)).bit_length() + 5)

    @staticmethod
    def keys(left: np.ndarray, right: np.ndarray) -> np.ndarray:
        return left.astype(np.uint64) << np.uint64(32) | right.astype(np.uint64)

    @staticmethod
    def slots(key: np.ndarray, factor: np.uint64, bits: int) -> np.ndarray:
        return ((key * factor) >> np.uint64(64 - bits)).astype(np.int64)

    def find(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = self.keys(left, right)
        out = np.full(key.shape, self.NONE, np.int32)
        for factor, bits, keys, ranks in self.levels:
            slot = self.slots(key, factor, bits)
            np.copyto(out, ranks[slot], where=keys[slot] == key)
        return out


class PieceTokenizer:
    """encode(texts) -> for each text its ids, as little-endian unsigned integers of `dtype`."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.size = self.tok.get_vocab_size()
        self.dtype = np.dtype("<u2" if self.size <= 1 << 16 else "<u4")
        with open(path, encoding="utf-8") as f:
            known = json.load(f)
        pre, model = known.get("pre_tokenizer") or {}, known["model"]
        plain_model = model.get("type", "BPE") == "BPE" and not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges"))
        self.splits = known.get("normalizer") is None and pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True) and plain_model
        self.added = [t["content"] for t in known.get("added_tokens") or ()]
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        if self.splits:
            vocab, spelling = model["vocab"], byte_spelling()
            pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
            self.ranks = PairRanks(np.array([vocab[a] for a, _ in pairs], np.int64), np.array([vocab[b] for _, b in pairs], np.int64))
            self.into = np.array([vocab[a + b] for a, b in pairs], np.int32)
            self.byte = np.array([vocab[spelling.get(b, chr(b))] for b in range(256)], np.int32)
            self.classes = byte_classes()
            rng = np.random.default_rng(1)
            self.marks = rng.integers(0, 1 << 63, (2, 256), np.uint64) << np.uint64(1) | np.uint64(1)
            self.powers = np.array([[pow(base, j, 1 << 64) for j in range(SHORT)] for base in (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)], np.uint64)
            self.forget()

    def forget(self) -> None:
        """The memory of parts: in each slot a part's two hashes, and its place and number of ids in the pool."""
        self.keys, self.check = np.zeros(SLOTS, np.uint64), np.zeros(SLOTS, np.uint64)
        self.place, self.many = np.zeros(SLOTS, np.int32), np.zeros(SLOTS, np.int32)
        self.pool, self.filled = np.zeros(POOL, self.dtype), 0

    def direct(self, texts: list[str]) -> list[bytes]:
        """By the library alone."""
        return [np.array(e.ids, self.dtype).tobytes() for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)]

    def merged(self, data: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of each part (a range of data) one after another, and how many each has; parts of one length go together."""
        number, done = np.zeros(len(start), np.int64), []
        order = np.argsort(size, kind="stable")
        for row in np.split(order, np.flatnonzero(np.diff(size[order])) + 1) if len(order) else ():
            length = int(size[row[0]])
            ids = self.byte[data[start[row][:, None] + np.arange(length)]]
            rank = self.ranks.find(ids[:, :-1], ids[:, 1:])
            while ids.shape[1] > 1 and len(row):
                every = np.arange(len(row))
                at = rank.argmin(1)
                best = rank[every, at]
                more = best < PairRanks.NONE
                if not more.all():
                    done.append((row[~more], ids[~more]))
                    row, ids, rank, at, best = row[more], ids[more], rank[more], at[more], best[more]
                    every = np.arange(len(row))
                ids[every, at] = self.into[best]
                place = np.arange(ids.shape[1] - 1)
                place = place + (place > at[:, None])  # all but the merged pair's right half
                ids = np.take_along_axis(ids, place, 1)
                rank = np.take_along_axis(rank, place[:, :-1], 1)
                if ids.shape[1] > 1:
                    for k in (at - 1, at):
                        some = np.flatnonzero((k >= 0) & (k < rank.shape[1]))
                        rank[some, k[some]] = self.ranks.find(ids[some, k[some]], ids[some, k[some] + 1])
            if len(row):
                done.append((row, ids))
        for row, ids in done:
            number[row] = ids.shape[1]
        first = np.cumsum(number) - number
        out = np.empty(int(number.sum()), self.dtype)
        for row, ids in done:
            out[first[row][:, None] + np.arange(ids.shape[1])] = ids
        return out, number

    def plain(self, data: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of pieces (ranges of data): which are plain, and of those the first places and sizes of parts in order, with
        the space that leads a piece's first part counted in; a part's start is that of its piece where it has the space."""
        kind = self.classes[data]
        ends = start + size
        odd = kind == ODD
        twice = (kind[1:] == BREAK) & (kind[:-1] == BREAK)
        odd[1:] |= twice
        signs = (data[:-1] == 0xC3) & ((data[1:] == 0x97) | (data[1:] == 0xB7))
        odd[:-1] |= signs
        total = np.concatenate([[0], np.cumsum(odd)])
        edge = np.zeros(len(data) + 1, bool)
        edge[1 : len(data)] = (kind[1:] != kind[:-1]) | (kind[1:] == BREAK)
        edge[ends] = edge[start] = True
        cuts = np.flatnonzero(edge)
        longest = np.maximum.reduceat(np.append(np.diff(cuts), 0), np.searchsorted(cuts, start)) if len(start) else size
        good = (size > 0) & (total[ends] == total[start]) & (longest < SHORT)
        good[good] &= (kind[start[good]] != BREAK) & (kind[ends[good] - 1] != BREAK)
        inside = np.zeros(len(data) + 1, np.int8)
        np.add.at(inside, start[good], 1)
        np.add.at(inside, ends[good], -1)
        inside = np.cumsum(inside, dtype=np.int8)[:-1] > 0
        some = np.flatnonzero(inside[cuts[:-1]])
        return good, cuts[some], np.diff(cuts)[some]

    def look_up(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of a space and then each of some distinct pieces: a pool, and the place and number of each one's ids."""
        _, offsets, raw = words.buffers()
        offsets = np.frombuffer(offsets, np.int64, len(words) + 1, 8 * words.offset)
        text = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.empty(0, np.uint8)
        size = np.diff(offsets)
        # each piece with its space before it, one after another
        begin = np.cumsum(size + 1) - size - 1
        data = np.full(int(size.sum()) + len(size), 32, np.uint8)
        body = np.ones(len(data), bool)
        body[begin] = False
        data[body] = text[offsets[0] : offsets[-1]]
        good, start, length = self.plain(data, begin + 1, size)
        leads = body[start - 1] == False  # noqa: E712
        start, length = start - leads, length + leads
        ends = np.cumsum(length)
        at = np.repeat(start - (ends - length), length) + np.arange(int(length.sum()))
        turn = at - np.repeat(start, length)
        hashes = [np.add.reduceat(self.marks[k][data[at]] * self.powers[k][turn], ends - length) if len(start) else np.empty(0, np.uint64) for k in (0, 1)]
        key, check = hashes[0] ^ (hashes[0] >> np.uint64(32)) | np.uint64(1), hashes[1]
        if self.filled + int(length.sum()) > len(self.pool):
            self.forget()
            self.pool = np.zeros(max(POOL, 2 * int(length.sum())), self.dtype)
        slot = (key >> np.uint64(1)).astype(np.int64) & (SLOTS - 1)
        hit = (self.keys[slot] == key) & (self.check[slot] == check)
        place, many = np.where(hit, self.place[slot], 0).astype(np.int64), np.where(hit, self.many[slot], 0).astype(np.int64)
        miss = np.flatnonzero(~hit)
        if len(miss):
            _, one, code = np.unique(check[miss], return_index=True, return_inverse=True)
            one = miss[one]
            ids, number = self.merged(data, start[one], length[one])
            where = self.filled + np.cumsum(number) - number
            self.pool[self.filled : self.filled + len(ids)] = ids
            self.filled += len(ids)
            self.keys[slot[one]], self.check[slot[one]], self.place[slot[one]], self.many[slot[one]] = key[one], check[one], where, number
            place[miss], many[miss] = where[code], number[code]
        ends = np.cumsum(many)
        ids = self.pool[np.repeat(place - (ends - many), many) + np.arange(int(many.sum()))]
        first = np.flatnonzero(leads)
        places, numbers = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
        places[good] = (ends - many)[first]
        numbers[good] = np.add.reduceat(many, first) if len(first) else 0
        rest = np.flatnonzero(~good)
        if len(rest):
            odd = self.odd(words.take(pa.array(rest)).to_pylist())
            numbers[rest] = np.fromiter(map(len, odd), np.int64, len(odd)) // self.dtype.itemsize
            places[rest] = len(ids) + np.cumsum(numbers[rest]) - numbers[rest]
            ids = np.concatenate([ids, np.frombuffer(b"".join(odd), self.dtype)])
        return ids, places, numbers

    def odd(self, pieces: list[str]) -> list[bytes]:
        """Ids of a space and then each piece, by the library."""
        if len(self.known) > REMEMBERED:  # what is not asked for in a generation is forgotten
            self.older, self.known = self.known, {}
        out = [self.known.get(p) or self.older.get(p) for p in pieces]
        new = [k for k, v in enumerate(out) if v is None]
        for k, ids in zip(new, self.direct([" " + pieces[k] for k in new]) if new else ()):
            out[k] = ids
        for p, ids in zip(pieces, out):
            if len(p) <= 64:
                self.known[p] = ids
        return out

    def whole(self, text: str) -> bool:
        """Whether a text must be given to the library as it is."""
        return not self.splits or any(c + " " in text for c in ASCII_SPACES) or any(a in text for a in self.added) or (not text.isascii() and any(c + " " in text for c in OTHER_SPACES))

    def _flat(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of texts that need not go whole."""
        lists = pc.split_pattern(pa.array(texts, pa.large_string()), " ")
        at, words = lists.offsets.to_numpy(), lists.flatten().dictionary_encode()
        code = words.indices.to_numpy().astype(np.int64)
        first = at[:-1]
        leads, lead = np.unique(code[first], return_inverse=True)
        pool, place, number = self.look_up(words.dictionary)
        apart = self.direct(words.dictionary.take(pa.array(leads)).to_pylist())  # they have no space before them
        size = np.fromiter(map(len, apart), np.int64, len(apart)) // self.dtype.itemsize
        place = np.concatenate([place, len(pool) + np.cumsum(size) - size])
        number = np.concatenate([number, size])
        pool = np.concatenate([pool, np.frombuffer(b"".join(apart), self.dtype)])
        code[first] = len(words.dictionary) + lead
        n = number[code]
        ends = np.cumsum(n)
        ids = pool[np.repeat(place[code] - (ends - n), n) + np.arange(ends[-1])]
        return ids, np.diff(np.concatenate([[0], ends])[at])

    def flat(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one after another, and how many each has."""
        ids, number = [], []
        for some in together(texts):
            whole = [self.whole(t) for t in some]
            if not any(whole):
                x, n = self._flat(some)
                ids.append(x)
                number.append(n)
                continue
            apart = self.direct([t for t, w in zip(some, whole) if w])
            x, n = self._flat(rest) if (rest := [t for t, w in zip(some, whole) if not w]) else (np.empty(0, self.dtype), np.empty(0, np.int64))
            plain, apart = iter(np.split(x, np.cumsum(n)[:-1])), iter(apart)
            for w in whole:
                ids.append(np.frombuffer(next(apart), self.dtype) if w else next(plain))
                number.append(np.array([len(ids[-1])]))
        return (np.concatenate(ids), np.concatenate(number)) if ids else (np.empty(0, self.dtype), np.empty(0, np.int64))

    def ended(self, texts: list[str], end: int) -> tuple[np.ndarray, np.ndarray]:
        """As flat, with the id `end` after each text."""
        ids, number = self.flat(texts)
        number = number + 1
        out, body = np.full(int(number.sum()), end, self.dtype), np.ones(int(number.sum()), bool)
        body[np.cumsum(number) - 1] = False
        out[body] = ids
        return out, number

    def encode(self, texts: list[str]) -> list[bytes]:
        ids, number = self.flat(texts)
        raw, ends = ids.tobytes(), (np.cumsum(number) * self.dtype.itemsize).tolist()
        return [raw[a:b] for a, b in zip([0, *ends], ends)]


def together(texts: list[str]) -> Iterator[list[str]]:
    """texts in order, as many at a time as have TOGETHER characters; a longer one alone."""
    some, size = [], 0
    for t in texts:
        if some and size + len(t) > TOGETHER:
            yield some
            some, size = [], 0
        some.append(t)
        size += len(t)
    if some:
        yield some


def tokenizer(path: str) -> PieceTokenizer:
    cache = worker_cache("tokens")
    if path not in cache:
        cache[path] = PieceTokenizer(path)
    return cache[path]


def ids_crc32(ids: np.ndarray) -> int:
    """Unsigned crc32 of the ids as little-endian unsigned 32-bit integers."""
    import zlib

    return zlib.crc32(ids.astype("<u4").tobytes())
