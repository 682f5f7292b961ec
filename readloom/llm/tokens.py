"""Token ids by a public byte-level BPE tokenizer.

The tokenizer library encodes; this module only remembers what it said. Letters that are new, and signs
after them, go to the library's model at once, as its pre-tokenizer would hand them on, at less than half the cost. The pre-tokenizer never joins text across the
place before a single space, nor across the edges of a run of letters, of stops or of one line break between them, so
a text is the sequence of such pieces, and equal pieces have equal ids. Nor does it join a letter or digit with a stop
after it, so stops before a space or line break are pieces of their own, and a word is remembered once, not once a stop.
Texts with other runs of white space around spaces, or with the three control characters that mark pieces here, are encoded
whole, as are pieces with anything else in them.
"""
from __future__ import annotations

import gc
import os
import re
from array import array

import numpy as np

from readloom.llm import base as B

#: Pieces that a worker remembers in each generation of a memory; bounds its memory to about 150 MB.
REMEMBER = 400_000
_RUN = re.compile(r"\s (?=\s|\Z)| \Z")
_LETTERS, _STOPS = "[A-Za-zÀ-ÖØ-öø-ÿ]++", "[.,;:!?]++"
_PLAIN = re.compile(f"(?:{_LETTERS}|{_STOPS})(?:{_LETTERS}|{_STOPS}|(?<!\n)\n(?=[^\n]))*\\Z")
_PARTS = re.compile(f"{_LETTERS}|{_STOPS}|\n")
#: A stop by itself, and a word after a line break.
_STOP, _LINE, _BEFORE = "\x01", "\x02", "\x03"
_MARKS = [(f"{c} ", f"{_BEFORE}{c} ") for c in ".,;:!?"] + [(f"{c}\n", f"{_BEFORE}{c} {_LINE}") for c in ".,;:!?"] + [(_BEFORE, f" {_STOP}")]
_CUT, _BREAK = re.compile(r"(?<=[^\W_])([.,;:!?])(?=[ \n]|\Z)"), re.compile(rf"({_STOP}[.,;:!?])\n(?=\S)")
#: Letters and then signs without an apostrophe are two words of the pre-tokenizer, whatever they are.
_SIGNS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
_LATIN, _SIGNED = re.compile(f"{_LETTERS}\\Z"), re.compile(f"{_LETTERS}[{re.escape(_SIGNS)}]++\\Z")
#: By byte, its letter in the alphabet of byte-level models.
_SHOWN = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
_ALPHABET = dict(zip([b for b in range(256) if b not in _SHOWN], range(256, 512)))
_LOADED: dict[str, "Encoder"] = {}


class Memory(dict):
    """Pieces and their ids. What is not used while a generation fills up is forgotten with the generation before.

    A new piece gets an empty bytearray, which is filled when the encoder resolves all new pieces at once. A piece that a
    stop may not be cut from raises `odd` if the memory is a strict one, upon which its text is cut with more care.
    """

    def __init__(self, before: str, strict: bool = False, old: dict | None = None):
        super().__init__()
        self.before, self.strict, self.old, self.new, self.odd = before, strict, old or {}, [], False

    def __missing__(self, piece: str) -> bytes | bytearray:
        ids = self.old.get(piece)
        if ids is None:
            if self.strict and not piece[-1:].isalnum() and piece[:1] != _STOP or piece[:1] == _LINE and piece[1].isspace():
                self.odd = True
                return b""
            ids = bytearray()
            self.new.append(piece)
        self[piece] = ids
        return ids

    def next(self) -> Memory:
        if len(self) < REMEMBER:
            return self
        self.old = None
        return Memory(self.before, self.strict, self)


class Encoder:
    def __init__(self, name: str):
        import public_tokenizers
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.tokenizer = Tokenizer.from_file(public_tokenizers.path(name))
        self.first, self.later, self.rough = Memory(""), Memory(" ", strict=True), Memory(" ")
        self.line_break = self.ids("\n")
        self.model = self.tokenizer.model if self.splits_at_letters() else None

    def splits_at_letters(self) -> bool:
        """Whether letters, alone or after a space, and signs are each a word of the model, which then can be asked for it."""
        t = self.tokenizer
        cut = t.pre_tokenizer
        return (type(t.model).__name__ == "BPE" and t.normalizer is None and t.truncation is None and t.padding is None and type(cut).__name__ == "ByteLevel" and cut.use_regex
                and not cut.add_prefix_space and not any(not (y := x.content.strip().rstrip(_SIGNS)) or y.isalpha() for x in t.get_added_tokens_decoder().values()))

    def ids(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids).tobytes()

    def words(self, pieces: list[str], before: str) -> list[bytes]:
        """Ids of pieces of letters and signs after them, by the model alone."""
        out, before, ask, signs = [], before and "\u0120", self.model.tokenize, {}
        for p in pieces:
            x = p.rstrip(_SIGNS)
            ids = array("I", [y.id for y in ask(before + (x if x.isascii() else x.encode().decode("latin-1").translate(_ALPHABET)))]).tobytes()
            if len(x) < len(p):
                after = p[len(x):]
                if after not in signs:
                    signs[after] = array("I", [y.id for y in ask(after)]).tobytes()
                ids += signs[after]
            out.append(ids)
        return out

    def many(self, pieces: list[str]) -> list[bytes]:
        """Ids of pieces without white space but a space before: one text of lines costs half of what as many texts cost."""
        out, mark = [], np.frombuffer(self.line_break, "<u4")[0]
        for i in range(0, len(pieces), 500):
            part = pieces[i:i + 500]
            ids = np.frombuffer(self.ids("\n".join(part)), "<u4")
            cuts = np.flatnonzero(ids == mark).tolist()
            if len(cuts) != len(part) - 1:
                out += map(self.ids, part)
            else:
                whole = ids.tobytes()
                out += [whole[4 * a + 4:4 * b] for a, b in zip([-1, *cuts], [*cuts, len(ids)])]
        return out

    def resolve(self) -> None:
        """Encodes all new pieces. A piece of several parts is put together from theirs."""
        parts = []
        for m in (self.rough, self.later, self.first):  # parts may be new to a memory that follows; parts of first ones have no parts
            simple, todo, letters = [], [], []
            for p in m.new:
                if p.isalpha():
                    (letters if self.model and (p.isascii() or _LATIN.match(p)) else simple).append(p)
                elif p[:1] == _LINE and (p.isascii() and p[1:].isalpha()):
                    parts.append((m, p, [self.line_break, self.first[p[1:]]]))
                elif p[:1] == _STOP or p[:1] == _LINE:
                    m[p][:] = ids = self.ids(p[1:] if p[:1] == _STOP else "\n" + p[1:])
                    m[p] = ids
                elif p[:1] not in ".,;:!?" and _PLAIN.match(p) and len(x := _PARTS.findall(p)) > 1:
                    parts.append((m, p, [(self.later if m.before else m)[x[0]], *map(self.first.__getitem__, x[1:])]))
                elif self.model and _SIGNED.match(p):
                    letters.append(p)
                else:
                    todo.append(p)
            odd = [p for p in todo if not p or p.split(None, 1)[1:] or p.strip() != p]
            simple += set(todo).difference(odd)
            for p, ids in [*zip(letters, self.words(letters, m.before) if letters else ()), *zip(simple, self.many([m.before + p for p in simple])), *((p, self.ids(m.before + p)) for p in odd)]:
                m[p][:] = ids
                m[p] = ids
            m.new = []
        for m, p, x in parts:
            m[p][:] = ids = b"".join(x)
            if "\n" in p:  # hardly ever seen again
                del m[p]
            else:
                m[p] = ids

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        """Ids of each text as unsigned 32-bit numbers; null is empty."""
        self.first, self.later, self.rough = self.first.next(), self.later.next(), self.rough.next()
        out = []
        for t in texts:
            if not t:
                out.append(())
            elif _STOP in t or _LINE in t or _BEFORE in t or ("  " in t or "\n " in t or t[-1] == " " or "\t" in t or not t.isascii() or "\r" in t or "\f" in t or "\v" in t) and _RUN.search(t):
                out.append((self.ids(t),))
            else:
                marked, self.later.odd = t + " ", False
                for stop, mark in _MARKS:
                    marked = marked.replace(stop, mark)
                head, *rest = marked[:-1].split(" ")
                pieces = list(map(self.later.__getitem__, rest))
                if self.later.odd or head and not head[-1].isalnum():
                    head, *rest = _BREAK.sub(rf"\1 {_LINE}", _CUT.sub(rf" {_STOP}\1", t)).split(" ")
                    pieces = [(self.later if p[-1:].isalnum() or p[:1] == _STOP else self.rough)[p] for p in rest]
                out.append([self.first[head], *pieces] if head else pieces)
        self.resolve()
        return [np.frombuffer(b"".join(x), "<u4") for x in out]


def encoder(name: str) -> Encoder:
    if name not in _LOADED:
        _LOADED[name] = Encoder(name)
    return _LOADED[name]


def forget() -> None:
    """Gives the memory of all encoders back: a worker goes on to later stages, where nothing is encoded."""
    if _LOADED:
        _LOADED.clear()
        gc.collect()
    B.give_back()
