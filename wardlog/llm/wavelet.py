"""A wavelet matrix over the character classes of texts, read from their UTF-8 bytes."""

import numpy as np

# classes of bytes; a byte inside a character beyond ASCII is INNER, its first byte OTHER
OTHER, LETTER, DIGIT, BLANK, NEWLINE, END, MARK, INNER = range(8)
LEVELS = 3
WORD = 64


def byte_classes():
    table = np.full(256, OTHER, np.uint8)
    table[0x80:0xC0] = INNER
    for first, last in (("a", "z"), ("A", "Z")):
        table[ord(first):ord(last) + 1] = LETTER
    table[ord("0"):ord("9") + 1] = DIGIT
    for characters, kind in (("\t\r \x0b\x0c", BLANK), ("\n", NEWLINE), (".!?", END), (",;:'\"()[]{}-", MARK)):
        for character in characters:
            table[ord(character)] = kind
    return table


CLASSES = byte_classes()


class Ranks:
    """Bits packed in words of 64, with the number of ones before each word."""

    def __init__(self, bits):
        padded = np.zeros((len(bits) // WORD + 1) * WORD, np.uint8)
        padded[:len(bits)] = bits
        self.words = np.packbits(padded, bitorder="little").view("<u8")
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words), dtype=np.int64)])

    def ones(self, places):
        """Ones before each place."""
        word, bit = np.divmod(places, WORD)
        low = (np.uint64(1) << bit.astype(np.uint64)) - np.uint64(1)
        return self.before[word] + np.bitwise_count(self.words[word] & low)


class WaveletMatrix:
    """Rank of any class at any place in LEVELS steps; places count bytes."""

    def __init__(self, data):
        classes = CLASSES[data]
        self.size = len(classes)
        self.levels = []
        for level in reversed(range(LEVELS)):
            bits = classes >> level & 1
            ranks = Ranks(bits)
            zeros = self.size - int(ranks.before[-1])
            self.levels.append((ranks, zeros))
            classes = np.concatenate([classes[bits == 0], classes[bits == 1]])

    def rank(self, kind, places):
        """How many bytes of the class stand before each place."""
        first, last = np.zeros_like(places), places
        for level, (ranks, zeros) in zip(reversed(range(LEVELS)), self.levels):
            if kind >> level & 1:
                first, last = zeros + ranks.ones(first), zeros + ranks.ones(last)
            else:
                first, last = first - ranks.ones(first), last - ranks.ones(last)
        return last - first

    def count(self, kinds, places):
        """Bytes of any of the classes before each place."""
        return sum(self.rank(kind, places) for kind in kinds)

    def characters(self, places):
        return places - self.rank(INNER, places)

    def after(self, kinds, ordinals, low, high):
        """The first place in low..high that has `ordinals` bytes of the classes before it, by bisection on ranks;
        high where there are fewer."""
        low, high = low.copy(), high.copy()
        while (open_ := low < high).any():
            middle = (low + high) // 2
            enough = self.count(kinds, middle) >= ordinals
            high = np.where(open_ & enough, middle, high)
            low = np.where(open_ & ~enough, middle + 1, low)
        return low
