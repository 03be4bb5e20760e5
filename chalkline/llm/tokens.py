"""Token counts of a public byte-level BPE, per chunk of text.

The tokenizer's pattern never joins text across the end of a chunk as cut here, so
the counts of a text's chunks add up to the count of the text. A chunk ends before
white space that follows other text, before text that follows a line break, or after
a run of CJK punctuation that a letter or digit follows. Text with spaces is made of
words that repeat: their counts are remembered, in a table of bounded size per worker.
"""

from __future__ import annotations

import base64
import os
import re

import numpy as np

DEFAULT_TOKENIZER = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"

# Fixed value: the published pattern that splits text before the merges of the rank files.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

#: How natural a cut at the end of a chunk is.
HARD, WORD, CLAUSE, SENTENCE, LINE, PARAGRAPH = range(6)
#: A chunk of more tokens may be cut inside, every BLOCK characters (no character has over 4 tokens).
LARGE, BLOCK = 64, 16

_CHUNK = re.compile(r"\s*[^\s，。！？；：、]+(?:[，。！？；：、](?:[^\w\s]|_)*)?|\s*[，。！？；：、](?:[^\w\s]|_)*|\s+")
_LINE_START = re.compile(r"\n(?=\S)")
#: With one of these a split at single spaces could cut a run of white space.
_MIXED = ("  ", "\n ", " \n", "\t", "\r", "\x00", "\x0b", "\x0c", "\x85", "\xa0", "\u2028", "\u3000")
_REMEMBER, _LONGEST = 400_000, 48
_STOPS, _PAUSES = ".!?。！？…", ",;:，；：、"
CLOSED = 100
_CLOSERS = "\"')]”’）」』》】"


def end_strength(chunk: str) -> int:
    """How natural a cut after this chunk is, by its own end."""
    if chunk.endswith("\n"):
        return PARAGRAPH if chunk[:-1].rstrip(" \t\r").endswith("\n") else LINE
    last = chunk.rstrip(_CLOSERS)[-1:]
    return SENTENCE if last and last in _STOPS else CLAUSE if last and last in _PAUSES else WORD


class Counter:
    def __init__(self, path: str) -> None:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        self.encode = tiktoken.Encoding("chalkline", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.bytes_of = np.zeros(max(ranks.values()) + 1, np.int64)
        for token, rank in ranks.items():
            self.bytes_of[rank] = len(token)
        self.known: dict[str, int] = {}
        marks = np.zeros(0x10000, np.int8)
        for x in _STOPS:
            marks[ord(x)] = SENTENCE
        for x in _PAUSES:
            marks[ord(x)] = CLAUSE
        for x in _CLOSERS:
            marks[ord(x)] = CLOSED
        self.marks = marks

    def _word(self, key: str) -> int:
        """Tokens, characters and strength of a chunk in one number. A key that starts with NUL has no space before it."""
        chunk = key[1:] if key[:1] == "\x00" else " " + key
        v = len(self.encode(chunk)) << 40 | len(chunk) << 8 | end_strength(chunk)
        if len(key) <= _LONGEST and len(self.known) < _REMEMBER:
            self.known[key] = v
        return v

    def count(self, text: str) -> int:
        return len(self.encode(text))

    def chunks(self, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Characters, tokens and strength of the end of each chunk of ``text``."""
        if not text:
            return (np.zeros(0, np.int64),) * 3
        if text.count(" ") * 12 > len(text) and not any(x in text for x in _MIXED):
            known, word = self.known.get, self._word
            parts = ("\x00" + _LINE_START.sub("\n \x00", text)).split(" ")
            v = np.array([x if (x := known(p)) is not None else word(p) for p in parts], np.int64)
            chars, tokens, strength = v >> 8 & 0xFFFFFFFF, v >> 40, v & 0xFF
        else:
            chars, tokens, strength = self._direct(text)
        if tokens.max() > LARGE:
            chars, tokens, strength = self._blocks(text, chars, tokens, strength)
        return chars, tokens, strength

    def _direct(self, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        parts = _CHUNK.findall(text)
        chars = np.fromiter(map(len, parts), np.int64, len(parts))
        ends = np.cumsum(chars)
        raw = text.encode("utf-8", "surrogatepass").decode("utf-8", "replace")
        code = np.frombuffer(raw.encode("utf-32-le"), np.uint32)
        wide = np.cumsum(1 + (code > 0x7F) + (code > 0x7FF) + (code > 0xFFFF))
        at = np.cumsum(self.bytes_of[np.array(self.encode(raw), np.int64)])
        total = np.searchsorted(at, wide[ends - 1], "right")
        last = code[ends - 1]
        strength = np.maximum(self.marks[np.minimum(last, 0xFFFF)].astype(np.int64), WORD)
        # closing quotes and brackets after a stop, and line breaks that the next chunk starts with
        for i in np.flatnonzero(strength == CLOSED).tolist():
            strength[i] = end_strength(parts[i])
        lines = np.cumsum(code == 10)[ends - 1]
        breaks = np.append(lines[1:] - lines[:-1], 0)
        strength[breaks > 0] = LINE
        strength[breaks > 1] = PARAGRAPH
        return chars, np.diff(total, prepend=0), strength

    def _blocks(self, text: str, chars: np.ndarray, tokens: np.ndarray, strength: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Large chunks as blocks whose counts add up to the chunk's."""
        out: list[list[np.ndarray]] = [[], [], []]
        ends, at = np.cumsum(chars), 0
        for i in np.flatnonzero(tokens > LARGE).tolist():
            chunk = text[ends[i] - chars[i] : ends[i]]
            sizes = [min(BLOCK, len(chunk) - k) for k in range(0, len(chunk), BLOCK)]
            each = np.array([self.count(chunk[k : k + BLOCK]) for k in range(0, len(chunk), BLOCK)], np.int64)
            upto = np.minimum(np.cumsum(each), tokens[i])
            upto[-1] = tokens[i]
            block = (np.array(sizes, np.int64), np.diff(upto, prepend=0), np.array([HARD] * (len(sizes) - 1) + [strength[i]], np.int64))
            for k, (whole, new) in enumerate(zip((chars, tokens, strength), block)):
                out[k] += [whole[at:i], new]
            at = i + 1
        for k, whole in enumerate((chars, tokens, strength)):
            out[k].append(whole[at:])
        return tuple(np.concatenate(x) for x in out)


_counters: dict[str, Counter] = {}


def counter(path: str) -> Counter:
    """The worker's counter for this vocabulary file, at its path or as :func:`share` has sent it."""
    if path not in _counters:
        at = path
        if not os.path.isfile(path):
            from pyspark import SparkFiles

            at = SparkFiles.get(os.path.basename(path))
        _counters[path] = Counter(at)
    return _counters[path]


_shared: set[tuple[str, str]] = set()


def share(spark, path: str) -> None:
    """Send a vocabulary file that only the driver may have to the workers, once an application."""
    sc = spark.sparkContext
    if os.path.isfile(path) and (sc.applicationId, path) not in _shared:
        sc.addFile(path)
        _shared.add((sc.applicationId, path))
