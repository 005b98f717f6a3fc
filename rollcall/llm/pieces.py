"""Exact token ids of whole texts, with one library call per distinct chunk.

A chunk is a stretch of text that no token can cross, so the ids of a text are
the ids of its chunks in a row:

* ``blank_led`` for byte-level vocabularies: a run of white space with the run
  of other characters after it. Their pattern never joins a character to white
  space that follows it.
* ``bare`` for vocabularies that drop white space: a run of other characters.

Special strings of the vocabulary are matched first and are chunks of their
own, as the library does by default.
"""

from __future__ import annotations

import os
import re
from array import array
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache

import numpy as np

# White space by Unicode, as the vocabularies' patterns read it.
BLANK = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: Characters that send a text down the slower, general way.
_ODD = re.compile("[\0\t\x0b-\r\x1c-\x1f\x85\xa0\u1680\u180e\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
_RUNS = re.compile(f"[{BLANK}]*[^{BLANK}]+|[{BLANK}]+")
_BARE = re.compile("[^\x20\t-\r]+")
#: Chunks that a worker remembers, and the longest that it does.
REMEMBERED, LONGEST = 1 << 20, 64


def blank_led(text: str) -> list[str]:
    """Chunks with the white space before them; together they are the text."""
    if _ODD.search(text) or "  " in text or " \n" in text or "\n " in text or "\n\n" in text or text[-1:] in (" ", "\n"):
        return _RUNS.findall(text)
    return text.replace("\n", "\0\n").replace(" ", "\0 ").lstrip("\0").split("\0") if text else []


def bare(text: str) -> list[str]:
    """Runs of characters between ASCII white space."""
    return _BARE.findall(text) if _ODD.search(text) else text.split()


#: A word of plain letters, with the marks that follow it: two pre-tokens.
_WORD = re.compile(r"( ?[A-Za-zÀ-ÖØ-öø-ÿ]+)([!-/:-@\[-`{-~]*)")


def _byte_letters() -> dict[int, int]:
    """How byte-level vocabularies spell the bytes that do not print: 256 and on."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = [b for b in range(256) if b not in shown]
    return {b: 256 + i for i, b in enumerate(hidden)}


class Encoder:
    """Ids by a vocabulary file, remembered per chunk (little-endian uint32).

    A new chunk that is a word with marks goes to the library's model as these
    two pre-tokens; any other goes to the library whole. Without ``specials``
    the special strings are plain text.
    """

    def __init__(self, name: str, cut: Callable[[str], list[str]], lower: bool, specials: bool = True):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from public_tokenizers import path
        from tokenizers import Tokenizer

        self.tok, self.cut, self.lower, self.known = Tokenizer.from_file(path(name)), cut, lower, {}
        self.model, self.letters = self.tok.model, _byte_letters()
        self.tok.encode_special_tokens = not specials
        added = self.tok.get_added_tokens_decoder().values() if specials else ()
        self.special = sorted((t.content for t in added), key=len, reverse=True)
        self.at_special = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None

    def chunks(self, text: str) -> list[str]:
        for s in self.special:
            if s in text:
                parts = self.at_special.split(text)
                return [c for i, p in enumerate(parts) for c in ((p,) if i % 2 else self.cut(p))]
        return self.cut(text)

    def _pre_token(self, word: str) -> bytes:
        got = self.known.get(word)
        if got is None:
            spelled = (word.lower() if self.lower else word).encode().decode("latin-1").translate(self.letters)
            got = self.known[word] = array("I", [t.id for t in self.model.tokenize(spelled)]).tobytes()
        return got

    def learn(self, chunks: Iterable[str]) -> None:
        """Remember the ids of new chunks."""
        other, known = [], self.known
        for c in chunks:
            if m := _WORD.fullmatch(c):
                word, marks = m.groups()
                ids = self._pre_token(word)
                known[c] = ids + self._pre_token(marks) if marks else ids
            else:
                other.append(c)
        for i in range(0, len(other), 4096):
            part = other[i:i + 4096]
            for c, e in zip(part, self.tok.encode_batch_fast(part, add_special_tokens=False)):
                known[c] = np.array(e.ids, "<u4").tobytes()

    def counts(self, chunks: list[str]) -> list[int]:
        """How many ids each chunk has; remembers single pre-tokens only."""
        out = [0] * len(chunks)
        other = []
        if len(self.known) > REMEMBERED:
            self.known.clear()
        for i, c in enumerate(chunks):
            if m := _WORD.fullmatch(c):
                word, marks = m.groups()
                out[i] = (len(self._pre_token(word)) + (len(self._pre_token(marks)) if marks else 0)) // 4
            else:
                other.append(i)
        for k in range(0, len(other), 4096):
            part = other[k:k + 4096]
            for i, e in zip(part, self.tok.encode_batch_fast([chunks[i] for i in part], add_special_tokens=False)):
                out[i] = len(e.ids)
        return out

    def ids(self, texts: Iterable[str]) -> Iterator[bytes]:
        """The ids of each text, as bytes."""
        known = self.known
        for text in texts:
            cut = self.chunks(text)
            try:
                yield b"".join([known[c] for c in cut])
            except KeyError:
                if len(known) > REMEMBERED:
                    known.clear()
                new = {c for c in cut if c not in known}
                self.learn(new)
                yield b"".join([known[c] for c in cut])
                for c in new:
                    if len(c) > LONGEST:
                        del known[c]


@lru_cache(maxsize=2)
def encoder(name: str) -> Encoder:
    """One encoder per worker process and vocabulary file."""
    words = name.startswith("word_")
    return Encoder(name, bare if words else blank_led, lower=words)
