"""Token ids of whole texts by a given tokenizer file, with known words looked up."""

import json
import re
import sys
from array import array

import numpy as np
from tokenizers import Tokenizer

from wardlog.llm.arrow import in_steps

ID_BYTES = 4
CACHE_BYTES = 64 << 20  # of a worker's known pieces, their ids and the table of them
ENTRY_BYTES = 180  # of a known piece beside its characters and ids
STEP_CHARACTERS = 1 << 19

# How the tokenizer file must clean and split texts for the lookup; fixed values of that file.
CLEANING = ["NFC", "Replace", "Lowercase"]
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"

# In texts of these characters only, lower() and the split below give the tokenizer's own pieces, and no piece
# depends on its neighbours. All other texts go through the tokenizer whole.
PLAIN = re.compile(r"[\t-\r\x20-\x7e\xa1-įı-ɏ]*")
LETTERS = r"A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-ɏ"
DIGITS = r"0-9\xb2\xb3\xb9\xbc-\xbe"
PIECES = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{LETTERS}]+|[{DIGITS}]|[^\s{LETTERS}{DIGITS}]+")


# The byte-level step shows each byte as a character: printable ones as they are, the others from 256 on, in order.
PRINTABLE = {*range(33, 127), *range(161, 173), *range(174, 256)}
SHOWN_BYTES = dict(zip([b for b in range(256) if b not in PRINTABLE], range(256, 512)))
ID_FITS = array("I").itemsize == ID_BYTES and sys.byteorder == "little"


class TextIds:
    """Little-endian 32-bit ids of texts. Pieces met before are looked up, new ones are encoded by the tokenizer's model.
    When the table of pieces reaches its size in bytes, only those of the present step stay."""

    def __init__(self, path):
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.known, self.size = {}, 0
        self.cached = self.splits_alike()

    def splits_alike(self):
        rules = json.loads(self.tokenizer.to_str())
        cleaning = [step["type"] for step in (rules.get("normalizer") or {}).get("normalizers", [])]
        splits = (rules.get("pre_tokenizer") or {}).get("pretokenizers", [])
        bytewise = len(splits) == 2 and splits[1]["type"] == "ByteLevel" and not splits[1].get("add_prefix_space")
        return cleaning == CLEANING and bytewise and splits[0].get("pattern") == {"Regex": SPLIT} and ID_FITS

    def whole(self, text):
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def learn(self, pieces):
        """Takes new pieces into the table; the model is given what cleaning and splitting leave of a text."""
        tokenize = self.tokenizer.model.tokenize
        for piece in pieces:
            shown = piece if piece.isascii() else piece.encode().decode("latin-1").translate(SHOWN_BYTES)
            self.known[piece] = data = array("I", [token.id for token in tokenize(shown)]).tobytes()
            self.size += len(piece) + len(data) + ENTRY_BYTES

    def forget(self, wanted):
        """Keeps only the known pieces among those wanted now: rare ones go, frequent ones are in every step."""
        known = self.known
        self.known = {piece: known[piece] for piece in wanted if piece in known}
        self.size = sum(len(piece) + len(data) + ENTRY_BYTES for piece, data in self.known.items())

    def encode(self, texts):
        """The id bytes of each text, in order."""
        for step in in_steps(((text, len(text)) for text in texts), STEP_CHARACTERS):
            split = [PIECES.findall(t.lower()) if self.cached and PLAIN.fullmatch(t) else None for t in step]
            wanted = set()
            for pieces in split:
                wanted.update(pieces or ())
            if self.size > CACHE_BYTES:
                self.forget(wanted)
            self.learn(wanted.difference(self.known))
            for text, pieces in zip(step, split):
                yield self.whole(text) if pieces is None else b"".join(map(self.known.__getitem__, pieces))
