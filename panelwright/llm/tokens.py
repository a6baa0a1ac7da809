"""Tokenising whole texts with the tokenizers library, remembering the ids of repeated words.

Byte-pair encoding never crosses the pieces that the pre-tokenizer cuts, so a text's ids are those
of its white-space separated parts, one after the other. Words repeat; a part is encoded once for
each Python worker and found in a bounded dictionary afterwards.
"""

from __future__ import annotations

import gc
import json
import os
import re
from array import array
from collections.abc import Iterable, Iterator
from contextlib import contextmanager

import numpy as np

from .common import sole

#: Parts that a worker remembers in each of two generations (about 250 bytes each).
REMEMBERED = 400_000
#: Bytes of text that are held in parts at a time.
STEP_BYTES = 1 << 20

#: White space beyond single spaces and line ends: bytes whose presence asks for a closer look.
_ODD = (b"  ", b"\n ", b" \n", b"\t", b"\r", b"\x0b", b"\x0c", b"\x1c", b"\x1d", b"\x1e", b"\x1f", b"\xc2\x85", b"\xc2\xa0", b"\xe1\x9a\x80", b"\xe2\x80", b"\xe2\x81\x9f", b"\xe3\x80\x80")
#: Before a single space between two other characters.
_SAFE_CUT = re.compile(r"(?<=\S)(?= \S)")
#: A part of ASCII characters without an apostrophe falls into runs of letters, single digits and runs of others.
_RUNS = re.compile(rb"[a-z]+|[0-9]|[^a-z0-9]+")
#: ASCII signs at the end, after a letter of Latin-1 or ASCII.
_TAIL = re.compile(rb"(?:[a-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])([!-&(-/:-@\[-`{-~]+)$")
#: Letters of Latin-1 and ASCII in lower case only: what the normalizer leaves as it is, and the pre-tokenizer whole.
_PLAIN = re.compile(rb"(?:[a-z]|\xc3[\x9f-\xb6\xb8-\xbf])+")
#: The rule by which a tokenizer has to cut for these three to hold.
_RULE = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Marks a text's first part; no byte of UTF-8.
_FIRST = b"\xff"
#: What ends a sentence at the end of a token.
_STOPS = (".", "!", "?", "\u2026")


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@contextmanager
def no_cycle_search():
    """Hundreds of thousands of new objects, none of them in a cycle, would make the collector walk over all others again and again."""
    was = gc.isenabled()
    gc.disable()
    try:
        yield
    finally:
        if was:
            gc.enable()


class Remembered:
    """Values of recent keys. A full generation becomes the old one, whose values are taken up again when used."""

    def __init__(self):
        self.now: dict = {}
        self.old: dict = {}

    def clear(self) -> None:
        self.now, self.old = {}, {}

    def lacks(self, keys: set) -> list:
        """The keys of neither generation; old ones come to the new one."""
        if len(self.now) > REMEMBERED:
            self.now, self.old = {}, self.now
        missing = keys.difference(self.now)
        if self.old and missing:
            again = {k: self.old[k] for k in missing if k in self.old}
            self.now.update(again)
            missing.difference_update(again)
        return list(missing)


def _letters(tokenizer) -> dict[int, str] | None:
    """For each byte the character that stands for it in the model's vocabulary; null unless the tokenizer cuts by ``_RULE`` and lowers case."""
    spec = json.loads(tokenizer.to_str())
    kinds = [n["type"] for n in (spec["normalizer"] or {}).get("normalizers", [])]
    cuts = (spec["pre_tokenizer"] or {}).get("pretokenizers", [])
    known = len(cuts) == 2 and cuts[0].get("pattern") == {"Regex": _RULE} and cuts[1]["type"] == "ByteLevel" and not (cuts[1]["add_prefix_space"] or cuts[1]["use_regex"])
    if kinds != ["NFC", "Replace", "Lowercase"] or not known or spec["post_processor"] or spec["model"].get("dropout"):
        return None
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(others)}


class PartTokenizer:
    """``style``: "words" for a tokenizer that drops white space and case, "spaces" for one whose
    pre-tokenizer puts a single space before the word it precedes (byte-level BPE).

    Strings of special tokens in a text become those tokens, as the library has it; such texts are encoded whole.
    """

    def __init__(self, path: str, style: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        #: In lower case, since a normalizer may lower a text before it looks for them.
        self.special = [t.content.lower().encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.style = style
        #: The characters by which the model knows the bytes of plain words, where such words can go to it at once.
        self.letters = _letters(self.tokenizer) if style == "words" else None
        self.parts_known, self.pieces = Remembered(), Remembered()

    def parts(self, raw: bytes) -> list[bytes]:
        """With "spaces", every part but the first comes without the space it starts with; the first is marked."""
        if self.style == "words":
            return raw.split()
        # Before a space between two other characters is always the end of a piece.
        if any(x in raw for x in _ODD):
            first, *rest = _SAFE_CUT.split(raw.decode("utf-8", "surrogatepass"))
            parts = [first.encode("utf-8", "surrogatepass"), *(x[1:].encode("utf-8", "surrogatepass") for x in rest)]
        else:
            parts = raw.split(b" ")
        if parts[0]:
            parts[0] = _FIRST + parts[0]
            return parts
        return parts[1:]

    def _whole(self, part: bytes) -> bytes:
        if self.style == "words":
            return part
        return part[1:] if part.startswith(_FIRST) else b" " + part

    def token_kinds(self) -> tuple[np.ndarray, np.ndarray]:
        """For every id, whether its token ends a sentence and whether it starts with a digit."""
        n = self.tokenizer.get_vocab_size()
        stop, digit = np.zeros(n, bool), np.zeros(n, bool)
        for token, i in self.tokenizer.get_vocab().items():
            bare = token.removesuffix("</w>")
            stop[i], digit[i] = bare.endswith(_STOPS), bare[:1].isdigit()
        return stop, digit

    def _split(self, part: bytes) -> list[bytes]:
        """Pieces of a part between which the pre-tokenizer cuts: a last comma or stop after a letter, a line end
        between ASCII characters; letters, digits and signs where its rule is known. They are fewer than the parts, and what is encoded."""
        if self.style == "words":
            part = part.lower()
            if self.letters is not None and not part.isalpha():
                if part.isascii():
                    return [part] if b"'" in part else _RUNS.findall(part)
                end = _TAIL.search(part)
                return [part[: end.start(1)], end[1]] if end else [part]
        elif part.count(b"\n") == 1:
            a, _, b = part.partition(b"\n")
            if a and b and 32 < a[-1] < 127 and 32 < b[0] < 127:
                return [*self._split(a), b"\n", *self._split(b)]
        if part[-1:] in (b",", b".") and part[-2:-1].isalpha():
            return [part[:-1], part[-1:]]
        return [part]

    def _learn(self, parts: list[bytes]) -> None:
        split = [self._split(self._whole(p)) for p in parts]
        new = self.pieces.lacks({x for s in split for x in s})
        if self.letters is not None:
            # A plain word is what the normalizer and the pre-tokenizer would hand to the model anyway.
            model, letters, whole = self.tokenizer.model.tokenize, self.letters, _PLAIN.fullmatch
            plain = [p for p in new if whole(p)]
            self.pieces.now.update((p, array("I", [t.id for t in model(p.decode("latin-1").translate(letters))]).tobytes()) for p in plain)
            new = [p for p in new if not whole(p)]
        got = self.tokenizer.encode_batch_fast([p.decode("utf-8", "surrogatepass") for p in new], add_special_tokens=False)
        self.pieces.now.update((p, array("I", e.ids).tobytes()) for p, e in zip(new, got))
        get = self.pieces.now.__getitem__
        self.parts_known.now.update((p, b"".join(map(get, s))) for p, s in zip(parts, split))

    def encode(self, texts: Iterable[bytes | None]) -> Iterator[bytes]:
        """For each text (UTF-8) its ids, as little-endian unsigned 32-bit integers."""
        held: list[list[bytes] | bytes] = []
        size = 0
        for raw in texts:
            held.append((raw if self._holds_special(raw) else self.parts(raw)) if raw else [])
            size += len(raw or b"")
            if size >= STEP_BYTES:
                yield from self._all(held)
                held, size = [], 0
        yield from self._all(held)

    def clear(self) -> None:
        """Forget all parts."""
        self.parts_known.clear()
        self.pieces.clear()

    def _holds_special(self, raw: bytes) -> bool:
        low = raw.lower()
        return any(x in low for x in self.special)

    def _all(self, held: list[list[bytes] | bytes]) -> Iterator[bytes]:
        sole(self)
        with no_cycle_search():
            self._learn(self.parts_known.lacks(set().union(*(x for x in held if isinstance(x, list)))))
        get = self.parts_known.now.__getitem__
        for x in held:
            if isinstance(x, list):
                yield b"".join(map(get, x))
            else:
                yield array("I", self.tokenizer.encode(x.decode("utf-8", "surrogatepass"), add_special_tokens=False).ids).tobytes()


_open: dict[tuple[str, str], PartTokenizer] = {}


def open_tokenizer(path: str, style: str) -> PartTokenizer:
    """The worker's own copy, loaded once."""
    if (path, style) not in _open:
        _open[path, style] = PartTokenizer(path, style)
    return _open[path, style]
