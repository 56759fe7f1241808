"""A static range asymmetric numeral system over integer symbols: numpy kernels and a framed byte format.

A frame holds whole documents in order. Their ids are cut into independent blocks of BLOCK symbols; a block is LANES
coders whose 32-bit words are interleaved in one stream. At every SPAN steps a checkpoint keeps the coders' states and
the place in the stream, so that each span of each block decodes on its own; all spans of a frame are decoded at once,
as rows of one array. Headers and blocks carry crc32 checksums.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

LANES, SPAN, BLOCK = 64, 512, 1 << 16
LOW = np.uint64(1 << 31)
WORD_BITS = np.uint64(32)
MAGIC = b"PWR1"
HEAD = "<4sBHIQQQII"


def frequency_table(counts: np.ndarray) -> tuple[np.ndarray, int]:
    """Frequencies of at least 1 that sum to 2**bits, nearly in proportion to the counts."""
    n = len(counts)
    bits = min(24, max(12, int(n - 1).bit_length() + 4))
    total, room = max(1, int(counts.sum())), (1 << bits) - n
    freq = 1 + np.array([int(c) * room // total for c in counts.tolist()], np.int64)
    freq[int(np.argmax(freq))] += (1 << bits) - int(freq.sum())
    return freq.astype(np.uint64), bits


class Coder:
    def __init__(self, freq: np.ndarray, bits: int):
        self.freq, self.bits = freq.astype(np.uint64), bits
        self.cum = np.concatenate([[0], np.cumsum(self.freq)[:-1]]).astype(np.uint64)
        self.symbol = np.repeat(np.arange(len(freq), dtype=np.int32), self.freq.astype(np.int64))
        self.pad = int(np.argmax(self.freq))

    def _encode(self, symbols: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """symbols (blocks, steps, LANES) -> by block: words, states (spans, LANES), first word of each span."""
        blocks, steps, lanes = symbols.shape
        width = steps * lanes
        bits, shift = np.uint64(self.bits), np.uint64(63 - self.bits)
        x = np.full((blocks, lanes), LOW, np.uint64)
        out, pos, row = np.empty(blocks * width, np.uint32), np.full(blocks, width, np.int64), np.arange(blocks)[:, None] * width
        spans = -(-steps // SPAN)
        states, at = np.empty((blocks, spans, lanes), np.uint64), np.empty((blocks, spans), np.int64)
        for t in range(steps - 1, -1, -1):
            s = symbols[:, t, :]
            f = self.freq[s]
            full = x >= (f << shift)
            number = full.sum(1)
            if number.any():
                pos -= number
                place = (np.cumsum(full, 1) - 1 + pos[:, None] + row)[full]
                out[place] = x[full].astype(np.uint32)
                x = np.where(full, x >> WORD_BITS, x)
            q = x // f
            x = (q << bits) + (x - q * f) + self.cum[s]
            if t % SPAN == 0:
                states[:, t // SPAN], at[:, t // SPAN] = x, pos
        return [(out[b * width + pos[b] : (b + 1) * width], states[b], at[b] - pos[b]) for b in range(blocks)]

    def _decode(self, words: np.ndarray, states: np.ndarray, at: np.ndarray, steps: int) -> np.ndarray:
        """Spans of equally many steps: states (spans, LANES), first words in words -> symbols (spans, steps * LANES)."""
        x, ptr = states.copy(), at.astype(np.int64)
        bits, mask = np.uint64(self.bits), np.uint64((1 << self.bits) - 1)
        out = np.empty((len(x), steps, x.shape[1]), np.int32)
        for t in range(steps):
            slot = x & mask
            s = self.symbol[slot.astype(np.int64)]
            out[:, t] = s
            x = self.freq[s] * (x >> bits) + slot - self.cum[s]
            low = x < LOW
            number = low.sum(1)
            if number.any():
                place = (np.cumsum(low, 1) - 1 + ptr[:, None])[low]
                x[low] = (x[low] << WORD_BITS) | words[place].astype(np.uint64)
                ptr += number
        return out.reshape(len(x), -1)

    def frame(self, directory: bytes, docs: int, first: int, ids: np.ndarray) -> bytes:
        """Encode the ids of some whole documents; directory tells them apart, first is the ids before in the file."""
        parts, n = [], len(ids)
        whole = n // BLOCK
        groups = []
        if whole:
            groups.append((ids[: whole * BLOCK].reshape(whole, -1, LANES), [BLOCK] * whole))
        if rest := n - whole * BLOCK:
            steps = -(-rest // LANES)
            last = np.full(steps * LANES, self.pad, ids.dtype)
            last[:rest] = ids[whole * BLOCK :]
            groups.append((last.reshape(1, steps, LANES), [rest]))
        for symbols, lengths in groups:
            for length, (words, states, at) in zip(lengths, self._encode(symbols)):
                body = states.astype("<u8").tobytes() + at.astype("<u4").tobytes() + words.astype("<u4").tobytes()
                parts.append(struct.pack("<IIII", length, len(at), len(words), zlib.crc32(body)) + body)
        packed = zlib.compress(directory, 1)
        head = struct.pack(HEAD, MAGIC, self.bits, LANES, len(parts), docs, n, first, len(packed), zlib.crc32(packed))
        return head + struct.pack("<I", zlib.crc32(head)) + packed + b"".join(parts)

    def unframe(self, raw: bytes) -> tuple[bytes, int, int, np.ndarray]:
        """directory, documents, ids before, ids; raises ValueError where a checksum fails."""
        magic, bits, lanes, blocks, docs, n, first, size, crc = struct.unpack_from(HEAD, raw)
        p = struct.calcsize(HEAD) + 4
        if magic != MAGIC or bits != self.bits or lanes != LANES or zlib.crc32(raw[: struct.calcsize(HEAD)]) != struct.unpack_from("<I", raw, struct.calcsize(HEAD))[0]:
            raise ValueError("a token frame's header is damaged or of another format")
        packed = raw[p : p + size]
        if zlib.crc32(packed) != crc:
            raise ValueError("a token frame's directory is damaged")
        p += size
        lengths, words, states, at, steps, base = [], [], [], [], [], 0
        for _ in range(blocks):
            length, spans, number, crc = struct.unpack_from("<IIII", raw, p)
            p += 16
            end = p + spans * (8 * LANES + 4) + 4 * number
            if zlib.crc32(raw[p:end]) != crc:
                raise ValueError("a token block is damaged")
            states.append(np.frombuffer(raw, "<u8", spans * LANES, p).reshape(spans, LANES))
            at.append(np.frombuffer(raw, "<u4", spans, p + 8 * spans * LANES).astype(np.int64) + base)
            words.append(np.frombuffer(raw, "<u4", number, end - 4 * number))
            total = -(-length // LANES)
            steps += [min(SPAN, total - k * SPAN) for k in range(spans)]
            lengths.append(length)
            base += number
            p = end
        ids = np.empty(0, np.int32)
        if blocks:
            words, states, at, steps = np.concatenate(words), np.concatenate(states), np.concatenate(at), np.array(steps)
            spans: list[np.ndarray] = [ids] * len(steps)
            for k in np.unique(steps).tolist():
                which = np.flatnonzero(steps == k)
                for w, symbols in zip(which.tolist(), self._decode(words, states[which], at[which], k)):
                    spans[w] = symbols
            pieces, w = [], 0
            for length in lengths:
                number = -(-(-(-length // LANES)) // SPAN)
                pieces.append(np.concatenate(spans[w : w + number])[:length])
                w += number
            ids = np.concatenate(pieces)
        if len(ids) != n:
            raise ValueError("a token frame lacks ids")
        return zlib.decompress(packed), docs, first, ids
