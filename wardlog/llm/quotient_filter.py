"""Counting quotient filters of packed word-id n-grams: lossless, sorted and compact.

An n-gram of up to five 32-bit word ids is packed into 64-bit numbers: the first holds two ids, the rest the others.
An invertible permutation scatters the first number. Its high bits are the quotient, which is stored as a position, and
its low bits together with the rest are the remainder, which is stored in full, so that each n-gram can be given back.
"""

import struct

import numpy as np

MAX_WORDS = 5
MASK = (1 << 64) - 1
# multipliers of a common 64-bit finaliser, and their inverses
FIRST, SECOND = 0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53
FIRST_INVERSE, SECOND_INVERSE = pow(FIRST, -1, 1 << 64), pow(SECOND, -1, 1 << 64)
HEADER = "<IBBB"


def mixed(values):
    """A bijection of 64-bit numbers: each step can be undone."""
    values = values ^ values >> np.uint64(33)
    values = values * np.uint64(FIRST)
    values = values ^ values >> np.uint64(33)
    values = values * np.uint64(SECOND)
    return values ^ values >> np.uint64(33)


def unmixed(values):
    values = values ^ values >> np.uint64(33)
    values = values * np.uint64(SECOND_INVERSE)
    values = values ^ values >> np.uint64(33)
    values = values * np.uint64(FIRST_INVERSE)
    return values ^ values >> np.uint64(33)


def pair(high, low):
    return high.astype(np.uint64) << np.uint64(32) | low.astype(np.uint64)


def permuted(ids):
    """Columns of word ids as (scattered first number, rest numbers)."""
    head = pair(ids[0], ids[1])
    rest = []
    if len(ids) > 2:
        rest.append(pair(ids[2], ids[3]) if len(ids) > 3 else ids[2].astype(np.uint64))
    if len(ids) > 4:
        rest.append(ids[4].astype(np.uint64))
    # what is mixed in depends on the rest alone, so it can be taken out again
    for k, part in enumerate(rest):
        head = head ^ mixed(part + np.uint64(k + 1))
    return mixed(head), rest


def word_ids(head, rest, words):
    """The columns of word ids again."""
    first = unmixed(head)
    for k, part in enumerate(rest):
        first = first ^ mixed(part + np.uint64(k + 1))
    columns = [first >> np.uint64(32), first & np.uint64(0xFFFFFFFF)]
    if words == 3:
        columns.append(rest[0])
    elif words > 3:
        columns += [rest[0] >> np.uint64(32), rest[0] & np.uint64(0xFFFFFFFF)]
    return columns + rest[1:]


def counted(head, rest, counts=None):
    """Sorted distinct n-grams and their counts: merges sorted parts, or counts occurrences."""
    if counts is None and not rest:
        head = np.sort(head)
        new = np.flatnonzero(np.append(True, head[1:] != head[:-1])[:len(head)])
        return head[new], [], np.diff(np.append(new, len(head)))
    order = np.lexsort((*reversed(rest), head)) if rest else np.argsort(head, kind="stable")
    head, rest = head[order], [part[order] for part in rest]
    differs = np.zeros(max(len(head) - 1, 0), bool)
    for part in (head, *rest):
        differs |= part[1:] != part[:-1]
    new = np.flatnonzero(np.append(True, differs)[:len(head)])
    ends = np.append(new, len(head))
    if counts is None:
        sums = np.diff(ends)
    else:
        sums = np.add.reduceat(counts[order], new) if len(new) else counts[:0]
    return head[new], [part[new] for part in rest], sums


def joined(parts):
    """Several (head, rest, counts) one behind the other."""
    heads, rests, counts = zip(*parts)
    return np.concatenate(heads), [np.concatenate(part) for part in zip(*rests)], np.concatenate(counts)


def merged(parts):
    """One sorted table of several."""
    return parts[0] if len(parts) == 1 else counted(*joined(parts))


def counter_planes(counts):
    """Seven bits of each count, then seven more of those that go on."""
    planes = []
    while len(counts):
        more = counts >> 7 > 0
        planes.append(((counts & 127) | more.astype(counts.dtype) << 7).astype(np.uint8).tobytes())
        counts = counts[more] >> 7
    return b"".join(planes)


def counts_of(data, entries):
    counts = np.zeros(entries, np.int64)
    rows, start, shift = np.arange(entries), 0, 0
    while len(rows):
        plane = np.frombuffer(data, np.uint8, len(rows), start)
        counts[rows] |= (plane & 127).astype(np.int64) << shift
        start, shift, rows = start + len(rows), shift + 7, rows[plane >= 128]
    return counts


def encode(head, rest, counts, words, fixed_bits=0):
    """The filter of sorted n-grams whose first fixed_bits bits are equal, as bytes: one bit per quotient tells whether
    it is occupied, one bit per entry whether it ends the run of its quotient, then remainders, rest and counters."""
    entries = len(head)
    quotient_bits = min(max(entries - 1, 1).bit_length(), 64 - fixed_bits)
    width = 64 - fixed_bits - quotient_bits
    body = head & np.uint64(MASK >> fixed_bits)
    quotients = (body >> np.uint64(width)).astype(np.int64)
    occupied = np.zeros(1 << quotient_bits, np.uint8)
    occupied[quotients] = 1
    run_ends = np.append(quotients[1:] != quotients[:-1], True)[:entries]
    size = -(-width // 8)
    low = (body & np.uint64((1 << width) - 1)).astype("<u8").view(np.uint8).reshape(entries, 8)[:, :size]
    data = [
        struct.pack(HEADER, entries, words, fixed_bits, quotient_bits), np.packbits(occupied).tobytes(),
        np.packbits(run_ends).tobytes(), low.tobytes(),
    ]
    data += [part.astype("<u8" if wide else "<u4").tobytes() for part, wide in zip(rest, (words > 3, False))]
    return b"".join([*data, counter_planes(counts)])


def decode(data, prefix):
    """(head, rest, counts) of a filter; prefix is the value of its fixed bits."""
    entries, words, fixed_bits, quotient_bits = struct.unpack_from(HEADER, data)
    width, at = 64 - fixed_bits - quotient_bits, struct.calcsize(HEADER)

    def taken(kind, number):
        nonlocal at
        values = np.frombuffer(data, kind, number, at)
        at += values.nbytes
        return values

    places = 1 << quotient_bits
    occupied = np.flatnonzero(np.unpackbits(taken(np.uint8, -(-places // 8)), count=places))
    run_ends = np.unpackbits(taken(np.uint8, -(-entries // 8)), count=entries)
    # the entry's run is the number of runs that ended before it
    runs = np.cumsum(run_ends) - run_ends
    size = -(-width // 8)
    low = np.zeros((entries, 8), np.uint8)
    low[:, :size] = taken(np.uint8, entries * size).reshape(entries, size)
    head = low.view("<u8").reshape(entries) | occupied[runs].astype(np.uint64) << np.uint64(width)
    if fixed_bits:
        head = head | np.uint64(prefix << 64 - fixed_bits)
    rest = []
    for wide in (words > 3, False)[:(words - 1) // 2]:
        rest.append(taken("<u8" if wide else "<u4", entries).astype(np.uint64))
    return head, rest, counts_of(data[at:], entries)
