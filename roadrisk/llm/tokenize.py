"""Whole-text token ids with the tokenizers library, one call per different piece.

A byte-level or word-level BPE never merges over the start of a run of white
space, so a text's ids are its pieces' ids, joined. Each worker keeps the ids
of the pieces it has met. A new piece that is one word of Latin letters goes
straight to the library's model (normaliser and pre-tokenizer would only map
its characters, which a table taken from them does); any other piece goes
through the whole tokenizer. A text that holds an added token's string goes to
the library whole, unless the encoder is ``plain``: then such strings are
ordinary text. Tests compare with the library's ids of whole texts.
"""

from __future__ import annotations

import os
import re
import string
from struct import pack

#: Unicode White_Space, as the pre-tokenizers' \\s
_WS = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
_PIECE = re.compile(f"[{_WS}]*[^{_WS}]+|[{_WS}]+")
#: for tokenizers that drop white space, ASCII's is enough to split at
_WORD = re.compile(r"[^\x20\x09-\x0D]+")
#: Unicode white space beyond ASCII
_WIDE = re.compile("[\\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]")
#: after a word, a run of these is one piece of its own for the pre-tokenizers
_STOPS = string.punctuation

_encoders: dict[tuple[str, int, bool], Encoder] = {}


def _plain(word: str) -> bool:
    """Latin letters only, all below U+0180 and in composed form."""
    return word.isalpha() and (word.isascii() or max(word) < "\u0180" and "\u0149" not in word and "\u0130" not in word)


def _runs_of_space(text: str) -> bool:
    """Not just words with one space or one line break between them."""
    return (any(x in text for x in ("  ", "\n ", " \n", "\n\n", "\t", "\x0b", "\x0c", "\r")) or text[:1] == " " or text[-1:] == " "
            or not text.isascii() and _WIDE.search(text) is not None)


class Known(dict):
    """Piece -> ids as bytes; a piece not met yet is encoded. ``lead``: what
    stands before each piece in its text. Two generations: a piece of the old one
    that is met again joins the young one, so words met once drive out no others."""

    def __init__(self, tokenizer, lead: str):
        from tokenizers.pre_tokenizers import ByteLevel
        super().__init__()
        self.tokenizer, self.lead, self.model = tokenizer, lead, tokenizer.model
        as_bytes = ByteLevel(add_prefix_space=False, use_regex=False)
        normal = tokenizer.normalizer.normalize_str if tokenizer.normalizer else str
        mapped = lambda c: as_bytes.pre_tokenize_str(normal(c))[0][0]
        self.table = {c: mapped(chr(c)) for c in range(0x180) if chr(c) == " " or _plain(chr(c))}
        self.mapped_lead = mapped(lead) if lead else ""
        #: ASCII letters stay, or are only lower-cased
        self.lowers = self.table[ord("A")] == "a"
        self.stops: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def _whole(self, text: str) -> bytes:
        ids = self.tokenizer.encode(text, add_special_tokens=False).ids
        return pack(f"<{len(ids)}I", *ids)

    def __missing__(self, piece: str) -> bytes:
        out = self.old.get(piece)
        if out is None:
            out = self._new(piece)
        self[piece] = out
        return out

    def _new(self, piece: str) -> bytes:
        word = piece.rstrip(_STOPS)
        if not word or not _plain(word):
            out = self._whole(self.lead + piece)
        elif len(word) < len(piece):
            stops = piece[len(word):]
            if stops not in self.stops:
                self.stops[stops] = self._whole(stops)
            out = self[word] + self.stops[stops]
        elif not word.isascii():
            out = self._model(word.translate(self.table))
        elif self.lowers and not word.islower():
            out = self[word.lower()]
        else:
            out = self._model(word)
        return out

    def _model(self, word: str) -> bytes:
        ids = [t.id for t in self.model.tokenize(self.mapped_lead + word)]
        return pack(f"<{len(ids)}I", *ids)

    def turn(self) -> None:
        """The young generation becomes the old one, the old one is forgotten."""
        self.old = dict(self)
        self.clear()
        self.stops.clear()


class Encoder:
    """A tokenizer file and the ids of the pieces met so far (at most ``keep`` of
    them outlive a call, which bounds a worker's memory). ``plain``: the strings
    of added tokens are ordinary text."""

    def __init__(self, path: str, keep: int = 1_200_000, plain: bool = False):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        t = self.tokenizer = Tokenizer.from_file(path)
        t.encode_special_tokens = plain
        #: strings that the library looks for in the whole text (some of them after lower-casing it)
        self.added = [] if plain else [a.content.lower() for a in t.get_added_tokens_decoder().values()]
        #: white space gives no ids, so pieces are the words alone
        self.words_only = not t.encode(" ", add_special_tokens=False).ids
        self.keep, self.bare = keep, Known(t, "")
        self.led = self.bare if self.words_only else Known(t, " ")

    def ids(self, text: str, lead: bool = False) -> bytes:
        """Ids of a text (``lead``: of a space and the text), as little-endian unsigned 32-bit integers."""
        bare, led = self.bare, self.led
        if len(bare) + (led is not bare and len(led)) > self.keep // 2:
            bare.turn()
            if led is not bare:
                led.turn()
        if self.added and any(a in low for low in [text.lower()] for a in self.added):
            return bare._whole(" " + text if lead else text)
        if self.words_only:
            # the separators \x1c-\x1f aren't white space for the pre-tokenizers
            odd = any(c in text for c in "\x1c\x1d\x1e\x1f")
            return b"".join(map(bare.__getitem__, _WORD.findall(text) if odd else text.split()))
        if _runs_of_space(text) or lead and (not text or text[0].isspace()):
            return b"".join(map(bare.__getitem__, _PIECE.findall(" " + text if lead else text)))
        out, line_break = [], bare["\n"]
        for i, line in enumerate(text.split("\n")):
            if i:
                out.append(line_break)
            first, *rest = line.split(" ")
            out.append(led[first] if lead and not i else bare[first])
            out.extend(map(led.__getitem__, rest))
        return b"".join(out)

    def ids_of(self, texts: list[str]) -> list[bytes]:
        return [self.ids(t) for t in texts]


def encoder(path: str, keep: int = 1_200_000, plain: bool = False) -> Encoder:
    if (path, keep, plain) not in _encoders:
        _encoders[path, keep, plain] = Encoder(path, keep, plain)
    return _encoders[path, keep, plain]
