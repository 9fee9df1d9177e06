"""Fast whole-text encoding with the tokenizers library; runs inside tasks."""

from __future__ import annotations

import json
import re
import string
import sys
import types

import numpy as np
from tokenizers import Tokenizer
from tokenizers.pre_tokenizers import ByteLevel

#: A blank between two characters that are no white space: byte-level BPE never joins across it.
_BLANK = re.compile(r"(?<=\S) (?=\S)")
_PUNCTUATION = string.punctuation


#: Settings of a byte-level BPE, as published, under which texts may be cut at blanks.
_BYTE_LEVEL = {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True}
_BPE_OFF = ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "fuse_unk", "byte_fallback", "ignore_merges")
_TOKEN_OFF = ("single_word", "lstrip", "rstrip", "normalized")


def cuts_at_blanks(tokenizer_json: str) -> bool:
    """Whether a tokenizer is a plain byte-level BPE: no normaliser, truncation or padding, the common pre-tokenizer, and added
    tokens that begin with ``<|`` and hold no white space.  Of any other one, texts are encoded whole."""
    parts = json.loads(tokenizer_json)
    before, model = parts.get("pre_tokenizer") or {}, parts["model"]
    return (
        not any(parts.get(k) for k in ("normalizer", "truncation", "padding"))
        and all(before.get(k) == v for k, v in _BYTE_LEVEL.items())
        and model.get("type") == "BPE"
        and not any(model.get(k) for k in _BPE_OFF)
        and all(
            t["content"].startswith("<|") and not any(map(str.isspace, t["content"])) and not any(t.get(k) for k in _TOKEN_OFF)
            for t in parts.get("added_tokens") or []
        )
    )


def _ids(tokens) -> bytes:
    return b"".join([t.id.to_bytes(4, "little") for t in tokens])


class Encoder:
    """Ids of a text as little-endian 32-bit bytes, the same as ``encode(text, add_special_tokens=False).ids``.

    The byte-level pre-tokenizer starts anew at a single blank or line end between two characters that are no
    white space, so the pieces between them, each led by its blank or line end, encode by themselves.
    Most pieces are words seen before; the ids of the last ``remember`` to twice as many pieces, and as many words,
    are remembered.
    A text with longer runs of white space is only cut at single blanks.  Texts are cut only for tokenizers that
    ``cuts_at_blanks`` knows; others encode them whole, by the library.
    """

    def __init__(self, tokenizer_json: str, remember: int = 400_000):
        self.tokenizer = Tokenizer.from_str(tokenizer_json)
        self.cuts = cuts_at_blanks(tokenizer_json)
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.model = self.tokenizer.model
        to_chars = ByteLevel(add_prefix_space=False, use_regex=False)
        one = {c: to_chars.pre_tokenize_str(c)[0][0] for c in map(chr, range(0x250))}
        self.chars = str.maketrans(one)
        self.remember = remember
        self.pieces: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.words: dict[str, bytes] = {}
        self.tails: dict[str, bytes] = {"": b""}

    def _whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _word(self, word: str) -> bytes:
        found = self.words.get(word)
        if found is None:
            if len(self.words) >= 2 * self.remember:
                self.words.clear()
            found = self.words[word] = _ids(self.model.tokenize(word.translate(self.chars)))
        return found

    def _piece(self, piece: str) -> bytes | None:
        """Ids of a piece, or None if it is part of a longer run of white space."""
        if not piece or piece[0].isspace() and (piece[0] != "\n" or len(piece) == 1 or piece[1].isspace()):
            return None
        line = piece[0] == "\n"
        core = piece[1:] if line else piece
        word = core.rstrip(_PUNCTUATION)
        tail = core[len(word) :]
        # one word of Latin letters and punctuation behind it: two pre-tokens
        if word.isalpha() and (word.isascii() or max(word) < "ɐ") and (not tail or tail[0] != "'" and len(tail) < 9) and "<|" not in tail:
            ids = self.tails.get(tail)
            if ids is None:
                ids = self.tails[tail] = _ids(self.model.tokenize(tail))
            return self._word("\n")[:4] + self._word(word) + ids if line else self._word(" " + word) + ids
        return self._whole(piece if line else " " + piece)

    def encode(self, text: str) -> bytes:
        if not text:
            return b""
        if not self.cuts:
            return self._whole(text)
        cut = text.replace("\n", " \n").split(" ")
        first = self._whole(cut[0])
        out = list(map(self.pieces.get, cut))
        out[0] = first
        if None in out:
            for i, ids in enumerate(out):
                if ids is None:
                    out[i] = ids = self._learn(cut[i])
                    if ids is None:
                        return self._loose(text)
        return b"".join(out)

    def _learn(self, p: str) -> bytes | None:
        ids = self.pieces.get(p)
        if ids is None:
            ids = self.older.get(p)
            if ids is None:
                ids = self._piece(p)
            if ids is not None:
                if len(self.pieces) >= self.remember:
                    self.older, self.pieces = self.pieces, {}
                self.pieces[p] = ids
        return ids

    def _loose(self, text: str) -> bytes:
        pieces = _BLANK.split(text)
        out = [self._whole(pieces[0])]
        for p in pieces[1:]:
            if p[0] == "\n" or any(map(str.isspace, p)):
                out.append(self._whole(" " + p))
            else:
                out.append(self._learn(p))
        return b"".join(out)


def worker_encoder(tokenizer_json: str) -> Encoder:
    """The encoder of this Python worker: what it remembers serves all tasks that the worker is given."""
    holder = sys.modules.setdefault("_mediaweave_worker", types.ModuleType("_mediaweave_worker"))
    if getattr(holder, "vocabulary", None) != tokenizer_json:
        holder.encoder, holder.vocabulary = Encoder(tokenizer_json), tokenizer_json
    return holder.encoder
