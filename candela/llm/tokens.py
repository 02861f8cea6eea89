"""Token ids of whole texts inside tasks, by a tokenizer file of the tokenizers library.

Byte-level pre-tokenisation always cuts before a single space or line feed between two visible characters, so a text's
ids are those of its pieces one after the other. Each worker keeps the ids of pieces it has met (a bounded number: full,
the store becomes the older one, from which pieces that are met again come back) and hands only new ones to the library:
words of Latin letters, with the marks that follow them apart, straight to its model in the spelling of the byte-level
alphabet, as they are one pre-token each; all others many in one text, one a line.
"""

from __future__ import annotations

import operator
import os
import re

import numpy as np

KEPT_PIECES = 600_000
LINE = 198  # the id of a line feed, which no visible character shares
_OTHER_SPACE = re.compile(r"[^\S \n]")
_TWO_SPACES = ("  ", " \n", "\n ", "\n\n")
_ID = operator.attrgetter("id")
_LINE_BYTES = LINE.to_bytes(4, "little")
#: Marks after a word, which are a pre-token of their own (no apostrophe: that may begin a contraction).
TAIL = ".,;:!?%&#"
LATIN_END = "\u0250"  # letters before this one are letters in every version of Unicode
_SHOWN = {*range(33, 127), *range(161, 173), *range(174, 256)}
#: The byte-level alphabet: bytes that aren't visible characters are spelled by the characters from 256 on.
_SPELLING = {b: 256 + k for k, b in enumerate(b for b in range(256) if b not in _SHOWN)}
_encoders: dict[tuple[str, bool, int | None], Encoder] = {}


def vocabulary(name: str = "byte_bpe_50k.json") -> str:
    """The path of an installed public tokenizer file."""
    import public_tokenizers

    return public_tokenizers.path(name)


class Encoder:
    """Ids of texts as little-endian unsigned 32-bit integers. plain: the strings of special tokens are ordinary text."""

    def __init__(self, path: str, plain: bool = False, kept: int | None = None) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = plain
        self.kept = kept
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.tails: dict[str, bytes] = {"": b""}
        self.by_word = self._spells()

    def _spells(self) -> bool:
        """Whether words of letters and the marks after them are one pre-token each, in the byte-level alphabet."""
        from tokenizers import models

        t = self.tokenizer
        if t.normalizer is not None or t.pre_tokenizer is None or not isinstance(t.model, models.BPE):
            return False
        added = (x.content.rstrip(TAIL) for x in t.get_added_tokens_decoder().values())
        return all(x and not x.isalpha() for x in added) and [x for x, _ in t.pre_tokenizer.pre_tokenize_str("\u00e9 ab,; \u0121\nAb")] == ["\u00c3\u00a9", "\u0120ab", ",;", "\u0120\u00c4\u00a1", "\u010a", "Ab"]

    def _cut(self, text: str) -> list[str] | None:
        """Pieces whose ids don't depend on each other, without the space that leads each of them (a NUL marks the
        first, which has none); None if the text has two spaces or line feeds together, or one at an end."""
        if any(x in text for x in _TWO_SPACES) or "\0" in text or not text or text[0] in " \n" or text[-1] in " \n":
            return None
        return ("\0" + text.replace("\n", " \n")).split(" ")

    def _whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def _learn_words(self, pieces: list[str]) -> list[str]:
        """Learn the words of Latin letters; the other pieces."""
        tokenize, known, ids, ends, words, tails, others = self.tokenizer.model.tokenize, self.known, [], [0], [], [], []
        for x in pieces:
            first = x[0] in "\0\n"
            bare = x.rstrip(TAIL)
            word = bare[1:] if first else bare
            if not word.isalpha():
                others.append(x)
                continue
            if word.isascii():
                spelled = word
            elif max(word) < LATIN_END:
                spelled = word.encode().decode("latin-1").translate(_SPELLING)
            else:
                others.append(x)
                continue
            tail = x[len(bare) :]
            if tail and tail not in self.tails:
                self.tails[tail] = self._whole(tail)
            if tail and bare in known:
                known[x] = known[bare] + self.tails[tail]
                continue
            ids.extend(map(_ID, tokenize(spelled if first else "\u0120" + spelled)))
            ends.append(len(ids) * 4)
            words.append(x)
            tails.append(tail)
        raw = np.array(ids, dtype="<u4").tobytes()
        for x, tail, i, j in zip(words, tails, ends, ends[1:]):
            known[x] = (_LINE_BYTES if x[0] == "\n" else b"") + raw[i:j] + self.tails[tail]
        return others

    def _learn(self, pieces: list[str]) -> None:
        if self.by_word:
            pieces = self._learn_words(pieces)
        texts = [pieces[k : k + 256] for k in range(0, len(pieces), 256)]
        lines = ["\n".join([x[1:] if x[0] in "\0\n" else " " + x for x in part]) for part in texts]
        for part, coded in zip(texts, self.tokenizer.encode_batch_fast(lines, add_special_tokens=False)):
            ids = np.array(coded.ids, dtype="<u4")
            ends = np.flatnonzero(ids == LINE)
            if len(ends) != len(part) - 1:  # never so for vocabularies of this kind
                self.known.update((x, self._whole(x[1:] if x[0] == "\0" else x if x[0] == "\n" else " " + x)) for x in part)
                continue
            raw = ids.tobytes()
            for x, i, j in zip(part, [0, *(ends * 4 + 4).tolist()], [*(ends * 4).tolist(), len(raw)]):
                self.known[x] = (_LINE_BYTES + raw[i:j]) if x[0] == "\n" else raw[i:j]

    def encode(self, texts: list[str]) -> list[bytes]:
        pieces = [self._cut(text) for text in texts]
        met = set().union(*filter(None, pieces))
        fresh = met.difference(self.known)
        if _OTHER_SPACE.search("".join(fresh)):  # kept pieces have none; texts with such pieces are encoded whole
            odd = {x for x in fresh if _OTHER_SPACE.search(x)}
            pieces = [cut if cut and odd.isdisjoint(cut) else None for cut in pieces]
            fresh -= odd
        if len(self.known) + len(fresh) > (self.kept or KEPT_PIECES):
            self.older, self.known, self.tails = self.known, {}, {"": b""}
            fresh = set().union(*filter(None, pieces))
        known = self.known
        again = {x: self.older[x] for x in fresh if x in self.older}
        known.update(again)
        self._learn(list(fresh.difference(again)))
        return [b"".join(map(known.__getitem__, cut)) if cut else self._whole(text) for text, cut in zip(texts, pieces)]


def encoder(path: str, plain: bool = False, kept: int | None = None) -> Encoder:
    """This worker's encoder for a tokenizer file; kept: how many pieces its store holds (None: KEPT_PIECES)."""
    if (path, plain, kept) not in _encoders:
        _encoders[path, plain, kept] = Encoder(path, plain, kept)
    return _encoders[path, plain, kept]


def groups(values, most_chars: int = 1 << 20):
    """Lists of (position, text) of a few megabytes at most (or one text): a batch's texts, in order."""
    part, chars = [], 0
    for k, value in enumerate(values):
        text = value.as_py() or ""
        if part and chars + len(text) > most_chars:
            yield part
            part, chars = [], 0
        part.append((k, text))
        chars += len(text)
    if part:
        yield part
