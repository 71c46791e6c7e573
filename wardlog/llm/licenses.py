"""License scans: exact phrases, and a fuzzy search for short notices.

A notice with at most k edits contains one of k + 1 pieces unchanged. An automaton finds the pieces of all notices
in one pass; around each, bounded-error matching looks for the notice and reports its place and number of edits.
"""

import ahocorasick
import numpy as np
import pyarrow as pa
import regex

from wardlog.llm.arrow import map_batches, term_list, texts, with_columns

PHRASES = {b"mit license": "mit", b"apache license": "apache", b"general public license": "gpl"}

# notice text in lower-case words: (label, allowed edits)
NOTICES = {
    "released under the mit license": ("mit", 3),
    "permission is hereby granted free of charge to any person obtaining a copy": ("mit", 6),
    "licensed under the apache license version 2 0": ("apache", 4),
    "gnu general public license version": ("gpl", 3),
    "you can redistribute it and or modify it under the terms of the gnu": ("gpl", 5),
    "gnu lesser general public license": ("lgpl", 3),
    "redistribution and use in source and binary forms with or without modification are permitted": ("bsd", 7),
    "subject to the terms of the mozilla public license": ("mpl", 4),
    "licensed under a creative commons attribution": ("cc-by", 4),
    "permission to use copy modify and or distribute this software for any purpose": ("isc", 6),
    "this is free and unencumbered software released into the public domain": ("unlicense", 6),
}

SCHEMA = pa.schema([
    ("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()),
    ("last_word", pa.int64()), ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64()),
    ("spans", pa.string()),
])
RESULT = (
    "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, "
    "score double, spans string"
)


def pieces(notice, edits):
    """edits + 1 pieces with their places; together they are the notice."""
    cuts = [len(notice) * i // (edits + 1) for i in range(edits + 2)]
    return [(notice[a:b], a) for a, b in zip(cuts, cuts[1:])]


def seed_automaton(notices):
    by_piece = {}
    for number, (notice, (_, edits)) in enumerate(notices.items()):
        for piece, place in pieces(notice, edits):
            by_piece.setdefault(piece, []).append((number, place))
    automaton = ahocorasick.Automaton()
    for piece, owners in by_piece.items():
        automaton.add_word(piece, (len(piece), owners))
    automaton.make_automaton()
    return automaton


def phrase_places(joined, phrases):
    """(word number, label) of each place; joined has one blank around each word."""
    found = []
    for phrase, label in phrases.items():
        at = joined.find(b" " + phrase + b" ")
        while at >= 0:
            found.append((at, label))
            at = joined.find(b" " + phrase + b" ", at + 1)
    numbers = blanks_before(np.frombuffer(joined, np.uint8), [at for at, _ in found])
    return [(number, label) for number, (_, label) in zip(numbers, found)]


def blanks_before(characters, places):
    """Blanks in front of each place, counted once for all of them."""
    if not places:
        return []
    return np.searchsorted(np.flatnonzero(characters == 32), places).tolist()


def fuzzy_places(text, automaton, notices, patterns):
    """(first word, last word, label, edits, notice length) of notices that stand in the text with few edits."""
    windows = {}
    for end, (length, owners) in automaton.iter(text):
        for number, place in owners:
            notice, (_, edits) = notices[number]
            start = end + 1 - length - place - edits
            windows.setdefault(number, []).append((max(0, start), start + len(notice) + 2 * edits))
    found = []
    for number, spans in windows.items():
        notice, (label, _) = notices[number]
        spans.sort()
        merged = [list(spans[0])]
        for start, end in spans[1:]:
            if start <= merged[-1][1]:
                merged[-1][1] = max(merged[-1][1], end)
            else:
                merged.append([start, end])
        for start, end in merged:
            for match in patterns[number].finditer(text, start, min(end, len(text))):
                if match.end() > match.start():
                    found.append((match.start() + 1, match.end(), label, sum(match.fuzzy_counts), len(notice)))
    if found:
        characters = np.frombuffer(text.encode("utf-32-le"), "<u4")
        first, last = (blanks_before(characters, [f[k] for f in found]) for k in (0, 1))
        found = [(a, b, *f[2:]) for a, b, f in zip(first, last, found)]
    return sorted(found)


def license_scan(docs, phrases=PHRASES, notices=NOTICES):
    """One row per document row: words, exact phrase places, labels, score, and the fuzzy spans.

    docs has doc_id and text; other columns are ignored. A null or empty text has no words and score 0. spans lists
    label:first word:last word:edits. The score is 1 for an exact phrase, else the largest share of a notice that
    needed no edit, else 0. Rows that repeat get equal results; an empty table gives no rows.
    """

    def scan(batches):
        automaton, listed = seed_automaton(notices), list(notices.items())
        patterns = [regex.compile(f"(?e)(?:{regex.escape(n)}){{e<={edits}}}") for n, (_, edits) in listed]
        for batch in batches:
            out = {name: [] for name in SCHEMA.names}
            for text in texts(batch):
                words = term_list(text)
                joined = b" " + b" ".join(words) + b" "
                base = phrase_places(joined, phrases)
                # places in the joined text: its leading blank makes the number of blanks before a word its number + 1
                fuzzy = fuzzy_places(joined.decode(), automaton, listed, patterns)
                spans = [(max(a - 1, 0), max(b - 1, 0), label, edits) for a, b, label, edits, _ in fuzzy]
                exact = sorted({label for _, label in base})
                out["n_words"].append(len(words))
                out["n_base"].append(len(base))
                out["first_word"].append(min((n for n, _ in base), default=None))
                out["last_word"].append(max((n for n, _ in base), default=None))
                out["base_labels"].append(",".join(exact))
                out["labels"].append(",".join(sorted({*exact, *(s[2] for s in spans)})))
                out["score"].append(
                    1.0 if base else max((1 - edits / length for *_, edits, length in fuzzy), default=0.0)
                )
                out["spans"].append(",".join(":".join(map(str, (s[2], s[0], s[1], s[3]))) for s in spans))
            yield with_columns(batch, ["doc_id"], SCHEMA, **out)

    return docs.selectExpr("cast(doc_id as long) doc_id", "text").transform(map_batches, scan, RESULT)
