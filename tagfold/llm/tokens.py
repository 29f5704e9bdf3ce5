"""Ids of whole texts by public tokenizer files of the tokenizers library, with a bounded cache of words.

A text is cut at single blanks between two characters that aren't white space. For the tokenizers here no token crosses
such a place, so the ids of a text are those of its pieces, one after another, and each distinct piece is encoded once
while the cache holds it. Texts with blanks beside other white space go to the library whole, unless white space is dropped.
"""

from __future__ import annotations

import array
import json
import os
import re
import sys
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Most pieces that a cache holds, and most words below them; each is forgotten in two generations.
MOST_PIECES, MOST_WORDS = 300_000, 200_000
#: The same where columns are encoded: most of their pieces are looked up as words.
MOST_RARE_PIECES, MOST_COLUMN_WORDS = 100_000, 400_000

#: Words whose ids don't depend on the Unicode version or on normalisation: ASCII but white space, and Latin letters.
CHARACTERS = "\x21-\x7e\xc0-\xd6\xd8-\xf6\xf8-\u012f\u0131-\u024f"
#: Such words, single line ends between them.
PLAIN = re.compile(f"[{CHARACTERS}]+(?:\n[{CHARACTERS}]+)*")
#: Any white space, by Python's wide notion of it.
SPACE = re.compile(r"\s")
LETTERS = "A-Za-z\xc0-\xd6\xd8-\xf6\xf8-\u012f\u0131-\u024f"
#: What the two pre-tokenizers split plain words into (fixed values: the contractions that they know).
CONTRACTIONS = "'s|'t|'re|'ve|'m|'ll|'d"
#: A word of letters and at most one sign behind it.
WORD_AND_SIGN = f"^(?P<word>[{LETTERS}]+)(?P<sign>[.,;:!?]?)$"


class Generations(dict):
    """A dictionary that makes what it lacks and forgets what wasn't asked for lately: it holds most entries, or twice as many."""

    def __init__(self, most: int, make):
        super().__init__()
        self.most, self.make, self.old = most, make, {}

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        if len(self) >= self.most:
            self.old = dict(self)
            self.clear()
        self[key] = value
        return value


def byte_letters() -> list[str]:
    """The letter that byte-level vocabularies use for each byte: printable ones stand for themselves, others follow from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b if b in shown else next(rest)) for b in range(256)]


class Encoder:
    """Ids of texts by one tokenizer file, as unsigned 32-bit integers in a byte string of the machine's (little) order."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.model = self.library.model
        self.plain = PLAIN.fullmatch
        #: The four bytes of each id.
        self.four = [i.to_bytes(4, "little") for i in range(self.library.get_vocab_size())]
        self.letters = dict(enumerate(byte_letters()))
        self.blank = self.letters[ord(" ")]
        with open(path, encoding="utf-8") as f:
            conf = json.load(f)
        kind = conf["pre_tokenizer"]["type"]
        #: Whether blanks are dropped and case too (word_bpe), or a blank belongs to the word after it (byte_bpe).
        self.dropped = kind == "Sequence"
        known = self.dropped or kind == "ByteLevel" and conf["normalizer"] is None and not conf["pre_tokenizer"]["add_prefix_space"] and conf["pre_tokenizer"]["use_regex"]
        self.by_piece = known and sys.byteorder == "little" and conf["post_processor"] is None and all(not SPACE.search(t["content"]) and not t["lstrip"] and not t["rstrip"] for t in conf["added_tokens"])
        by_column = self.by_piece and self.dropped
        self.pieces = Generations(MOST_RARE_PIECES if by_column else MOST_PIECES, self._piece)
        self.words = Generations(MOST_COLUMN_WORDS if by_column else MOST_WORDS, self._word)
        self.special = [t["content"] for t in conf["added_tokens"]]
        self.parts = re.compile(f"{CONTRACTIONS}|[{LETTERS}]+|[0-9]|[^{LETTERS}0-9]+" if self.dropped else f"{CONTRACTIONS}| ?[{LETTERS}]+| ?[0-9]+| ?[^ \n{LETTERS}0-9]+|\n").findall

    def _word(self, part: str) -> bytes:
        """Ids of one pre-token, by the library's model."""
        letters = part.replace(" ", self.blank) if part.isascii() and part != "\n" else part.encode().decode("latin-1").translate(self.letters)
        at = self.four
        return b"".join([at[t.id] for t in self.model.tokenize(letters)])

    def _piece(self, word: str) -> bytes:
        """Ids of what stands between two blanks, with the blank before it where that belongs to the word."""
        at, given = self.words, word if self.dropped else " " + word
        if self.dropped and self.plain(word):
            word = word.lower()
        piece = word if self.dropped else given
        if word.isascii() and word.isalpha():
            return at[piece]
        if word.isascii() and word[-1:] in ENDS and word[:-1].isalpha():
            return at[piece[:-1]] + at[word[-1]]
        if self.plain(word) and not ("<|" in word and any(s in word for s in self.special)):
            return at[piece] if word.isalpha() else b"".join([at[p] for p in self.parts(piece)])
        return self.whole([given])[0]

    def whole(self, texts: list[str]) -> list[bytes]:
        """The library's own ids of whole texts."""
        return [array.array("I", e.ids).tobytes() for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text, without any begin or end."""
        out: list[bytes | None] = [None] * len(texts)
        at = self.pieces
        for i, text in enumerate(texts):
            if not self.by_piece:
                continue
            if self.dropped:
                out[i] = b"".join([at[p] for p in text.replace("\n", " ").split(" ") if p])
            elif text and text[0] != " " and text[-1] != " " and not any(x in text for x in UNEVEN):
                first, *rest = text.split(" ")
                out[i] = self.whole([first])[0] + b"".join([at[p] for p in rest])
        if rest := [i for i, x in enumerate(out) if x is None]:
            for i, ids in zip(rest, self.whole([texts[i] for i in rest])):
                out[i] = ids
        return out

    def encode_column(self, texts: pa.Array) -> list[bytes]:
        """encode() of a column without nulls: what its texts share, pieces and words in them, is looked up once."""
        if not (self.by_piece and self.dropped):
            return self.encode(texts.to_pylist())
        pieces = pc.split_pattern(pc.replace_substring(texts, "\n", " "), " ")
        coded = pieces.flatten().dictionary_encode()
        found = self._distinct(coded.dictionary)
        sizes = np.fromiter(map(len, found), np.int64, len(found)) // 4
        which = coded.indices.to_numpy()
        counts = sizes.take(which)
        ends = np.r_[0, np.cumsum(counts)]
        # each id's place among those of the distinct pieces
        place = np.repeat((np.cumsum(sizes) - sizes).take(which) - ends[:-1], counts)
        place += np.arange(len(place))
        ids = np.frombuffer(b"".join(found), "<u4").take(place).tobytes()
        cuts = 4 * ends.take(np.r_[0, np.cumsum(pc.list_value_length(pieces).to_numpy())])
        return [ids[a:b] for a, b in zip(cuts.tolist(), cuts[1:].tolist())]

    def _distinct(self, pieces: pa.Array) -> list[bytes]:
        """Ids of different pieces; a word of letters, alone or before one sign, is asked for once however it is written."""
        parts = pc.extract_regex(pieces, WORD_AND_SIGN)
        word, sign = (pc.struct_field(parts, x).dictionary_encode() for x in (0, 1))
        words = pc.utf8_lower(word.dictionary).dictionary_encode()
        at = self.words
        known = [at[w] for w in _strings(words.dictionary)]
        signs = [at[s] if s else b"" for s in _strings(sign.dictionary)]
        others, look = iter(_strings(pieces.filter(pc.is_null(parts)))), self.pieces
        which = words.indices.to_numpy().take(word.indices.fill_null(0).to_numpy()) if known else np.zeros(len(pieces), int)
        which = np.where(parts.is_valid().to_numpy(zero_copy_only=False), which, -1).tolist()
        return [known[i] + signs[j] if i >= 0 else look[next(others)] for i, j in zip(which, sign.indices.fill_null(0).to_numpy().tolist())]


def _strings(values: pa.Array) -> list[str]:
    return values.to_numpy(zero_copy_only=False).tolist()


#: What a text may not have to be cut at blanks: blanks beside other white space, and white space but blanks and line ends.
UNEVEN = ("  ", " \n", "\n ", *(c for c in map(chr, range(0x3001)) if c.isspace() and c not in " \n"))
#: Signs that are a token of their own behind a word.
ENDS = (".", ",", ";", ":", "!", "?")


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One encoder for each Python worker and file, so that tasks share its cache."""
    return Encoder(path)
