"""A static range asymmetric numeral system (rANS) for token ids, in numpy.

One container holds a run of ids: a shared frequency table, then independent blocks. Each block interleaves ``LANES`` coders
over one stream of 32-bit words; the directory at the front has, for each block, where its words start, its lanes' first
states and a CRC-32 of its ids. Every entry of the directory is a checkpoint: any block can be decoded, and checked, alone.

    "RANS" version:u8 scale:u8 width:u8 lanes:u8 block:u32 n_ids:u64 n_table:u32 n_words:u64
    table: zlib of n_table symbols (width bytes each, ascending differences) and n_table frequencies (u32)
    directory: for each block, first word:u64, crc32:u32, lanes * state:u64
    words: u32 ...

All numbers are little-endian. An empty run is a container without table, directory and words.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

MAGIC = b"RANS"
VERSION = 1
LANES = 32
BLOCK = 1 << 14
LOW = 1 << 31
HEAD = struct.Struct("<4sBBBBIQIQI")


def scaled(counts: np.ndarray, bits: int) -> np.ndarray:
    """Frequencies, 1 at least, that sum to 2 ** bits."""
    total, slots = int(counts.sum()), 1 << bits
    spare = slots - len(counts)
    freq = 1 + (counts.astype(np.float64) * (spare / total)).astype(np.int64)
    left = slots - int(freq.sum())
    if left:
        top = np.argsort(-counts, kind="stable")[: min(len(counts), left)]
        freq[top] += left // len(top)
        freq[top[: left % len(top)]] += 1
    return freq


def encode(ids: np.ndarray) -> bytes:
    """A container of ``ids``, numbers from 0 to 2 ** 32 - 1."""
    n = len(ids)
    if not n:
        return HEAD.pack(MAGIC, VERSION, 0, 0, LANES, BLOCK, 0, 0, 0, 0)
    if int(ids.max()) < 1 << 20:
        tally = np.bincount(ids)
        symbols = np.flatnonzero(tally)
        counts, place = tally[symbols], (np.cumsum(tally > 0) - 1)[ids]
    else:
        symbols, place, counts = np.unique(ids, return_inverse=True, return_counts=True)
    bits = max(12, min(24, int(2 * len(symbols) - 1).bit_length()))
    if len(symbols) > 1 << bits:
        raise ValueError("more than 2 ** 24 different ids in one container")
    freq = scaled(counts, bits)
    start = np.r_[0, np.cumsum(freq)[:-1]]
    n_blocks = -(-n // BLOCK)
    steps = BLOCK // LANES if n_blocks > 1 else -(-n // LANES)
    grid = np.full(n_blocks * steps * LANES, int(np.argmax(counts)), np.int64)
    grid[:n] = place
    grid = np.ascontiguousarray(grid.reshape(n_blocks, steps, LANES).transpose(1, 0, 2))
    state = np.full((n_blocks, LANES), LOW, np.uint64)
    flushed, words = np.zeros(grid.shape, bool), np.zeros(grid.shape, np.uint32)
    f_of, s_of = freq.astype(np.uint64), start.astype(np.uint64)
    up, slot_bits, half = np.uint64(63 - bits), np.uint64(bits), np.uint64(32)
    for t in range(steps - 1, -1, -1):
        f = f_of[grid[t]]
        full = state >= (f << up)
        flushed[t], words[t] = full, state.astype(np.uint32)
        state = np.where(full, state >> half, state)
        q = state // f
        state = (q << slot_bits) + (state - q * f) + s_of[grid[t]]
    by_block = flushed.transpose(1, 0, 2)
    stream = words.transpose(1, 0, 2)[by_block]
    sizes = by_block.sum(axis=(1, 2))
    firsts = np.r_[0, np.cumsum(sizes)[:-1]]
    wide = ids.astype("<u4")
    directory = b"".join(struct.pack("<QI", int(firsts[b]), zlib.crc32(wide[b * BLOCK : (b + 1) * BLOCK].tobytes())) + state[b].astype("<u8").tobytes() for b in range(n_blocks))
    width = 2 if symbols[-1] < 1 << 16 else 4
    table = zlib.compress(np.diff(symbols.astype(np.int64), prepend=0).astype(f"<u{width}").tobytes() + freq.astype("<u4").tobytes(), 6)
    head = HEAD.pack(MAGIC, VERSION, bits, width, LANES, BLOCK, n, len(symbols), len(stream), len(table))
    return head + table + directory + stream.astype("<u4").tobytes()


def decode(data: bytes, blocks: tuple[int, int] | None = None) -> np.ndarray:
    """The ids (u4) of a container, or of its blocks from .. to - 1. Raises ValueError if anything does not check."""
    magic, version, bits, width, lanes, block, n, n_table, n_words, table_size = HEAD.unpack_from(data)
    if magic != MAGIC or version != VERSION:
        raise ValueError("not a container of this version")
    n_blocks = -(-n // block)
    first, last = blocks or (0, n_blocks)
    if not n or first >= last:
        return np.empty(0, "<u4")
    raw = zlib.decompress(data[HEAD.size : HEAD.size + table_size])
    symbols = np.cumsum(np.frombuffer(raw, f"<u{width}", n_table).astype(np.int64))
    freq = np.frombuffer(raw, "<u4", n_table, n_table * width).astype(np.uint64)
    if int(freq.sum()) != 1 << bits:
        raise ValueError("the frequency table is damaged")
    start = np.r_[np.uint64(0), np.cumsum(freq)[:-1]].astype(np.uint64)
    of_slot = np.repeat(np.arange(n_table, dtype=np.int32), freq.astype(np.int64))
    entry = np.dtype([("at", "<u8"), ("crc", "<u4"), ("state", "<u8", (lanes,))])
    at = HEAD.size + table_size
    directory = np.frombuffer(data, entry, n_blocks, at)
    stream = np.frombuffer(data, "<u4", n_words, at + n_blocks * entry.itemsize)
    stream = np.r_[stream, np.zeros(lanes, "<u4")]
    chosen = directory[first:last]
    steps = block // lanes if n_blocks > 1 else -(-n // lanes)
    state, ahead = chosen["state"].astype(np.uint64), chosen["at"].astype(np.int64)[:, None]
    out = np.empty((steps, last - first, lanes), np.int32)
    mask, slot_bits, half, low = np.uint64((1 << bits) - 1), np.uint64(bits), np.uint64(32), np.uint64(LOW)
    for t in range(steps):
        slot = state & mask
        out[t] = symbol = of_slot[slot]
        state = freq[symbol] * (state >> slot_bits) + slot - start[symbol]
        need = state < low
        behind = np.cumsum(need, axis=1)
        word = stream[np.minimum(ahead + behind - need, n_words)]
        state = np.where(need, (state << half) | word, state)
        ahead = ahead + behind[:, -1:]
    if (state != low).any():  # where every lane began
        raise ValueError("the stream is damaged")
    ids = symbols[out.transpose(1, 0, 2).reshape(-1)].astype("<u4")
    ids = ids[: n - first * block]
    for b in range(first, last):
        if zlib.crc32(ids[(b - first) * block : (b - first + 1) * block].tobytes()) != int(directory["crc"][b]):
            raise ValueError(f"block {b} is damaged")
    return ids
