"""Exact tokenizer ids with a cache of pieces.

Both supported tokenizers cut a text before their merges, and never merge
across such a cut.  So a column of texts is split, as one array of bytes, at
places that are always cuts; each different piece of a block of texts is looked
up once, new ones are encoded by the tokenizers library, many at a time, with a
separator between, and the ids of a block are gathered by number.  Every text
is encoded whole: the ids are those of the library for the whole text.
"""

from __future__ import annotations

from functools import cache
from itertools import compress, repeat
from operator import not_

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from tokenizers import Tokenizer

#: Texts that the library encodes in one call.
TEXTS_AT_ONCE = 64
_LETTER, _MARK, _DIGIT = 1, 2, 3
_SPACE, _LINE_END = 0x20, 0x0A


def _kinds() -> np.ndarray:
    """Kind of each byte: ASCII letters, marks (no apostrophe: it may join letters), digits, first bytes of Latin letters."""
    kinds = np.zeros(256, np.uint8)
    kinds[0x21:0x7F] = _MARK
    kinds[ord("0") : ord("9") + 1] = _DIGIT
    kinds[ord("A") : ord("Z") + 1] = kinds[ord("a") : ord("z") + 1] = _LETTER
    kinds[ord("'")] = 0
    kinds[0xC3:0xC9] = _LETTER  # U+00C0 to U+023F
    return kinds


def _after_space() -> np.ndarray:
    """Bytes that start a character which no definition of white space includes."""
    found = np.zeros(256, bool)
    found[0x21:0x7F] = found[0xC3:0xF5] = True
    found[0xE1:0xE4] = False  # U+1680, U+2000 and later, U+3000 are white space
    return found


_KIND, _AFTER_SPACE = _kinds(), _after_space()


def piece_starts(data: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Where pieces start in the UTF-8 bytes of texts that end at ``ends``.

    A piece starts with each text; at a space before a character that is surely
    none; where Latin letters, ASCII marks and ASCII digits meet; and before and after a
    line end between two of these.  Multiplication and division sign and the dotted
    capital I (which becomes two characters when lowered) are none of them.
    """
    kind = _KIND[data]
    lead = np.flatnonzero((data >= 0xC3) & (data <= 0xC8))
    pair = data[lead].astype(np.uint16) << 8 | data[lead + 1]
    plain = (pair != 0xC397) & (pair != 0xC3B7) & (pair != 0xC4B0)
    kind[lead[~plain]] = 0
    kind[lead[plain] + 1] = _LETTER
    solid = kind > 0
    last = ends[ends > 0] - 1
    starts = np.zeros(len(data) + 1, bool)
    starts[1:-1] = (kind[1:] != kind[:-1]) & solid[1:] & solid[:-1]
    space = np.flatnonzero((data[:-1] == _SPACE) & _AFTER_SPACE[data[1:]])
    line = np.flatnonzero((data[1:-1] == _LINE_END) & solid[:-2] & solid[2:]) + 1
    # What follows the last byte of a text is another text.
    final = np.zeros(len(data), bool)
    final[last] = True
    space, line = space[~final[space]], line[~final[line]]
    starts[space] = starts[line] = starts[line + 1] = True
    starts[0] = starts[ends] = True
    return np.flatnonzero(starts[:-1])


def lowered(data: np.ndarray) -> np.ndarray:
    """ASCII capitals as small letters, except before characters that might combine with them."""
    upper = (data >= ord("A")) & (data <= ord("Z"))
    upper[:-1] &= data[1:] < 0xC9
    return data | (upper.astype(np.uint8) << 5)


class Encoder:
    """``path``: tokenizer file.  ``mark``: a text that always is a token of its own, used as separator.

    ``lower``: the tokenizer lowers its text.  The cache holds up to ``most`` pieces; a full one keeps the half that was
    used most.  Pieces of over ``longest`` bytes are not kept.
    """

    def __init__(self, path: str, mark: str, lower: bool = False, most: int = 400_000, longest: int = 64):
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
        self.mark, self.lower, self.most, self.longest = mark, lower, most, longest
        (self.mark_id,) = self.tokenizer.encode(mark, add_special_tokens=False).ids
        #: Piece to its number; ids of piece k: flat[at[k] : at[k] + size[k]].
        self.number: dict[bytes, int] = {}
        self.flat, self.at, self.size, self.uses = np.zeros(0, "<u4"), *(np.zeros(0, np.int64) for _ in range(3))

    def _ids(self, texts: list[str]) -> list[np.ndarray]:
        # The library's results hold a string and more for each id: few of them at a time.
        parts = (texts[at : at + TEXTS_AT_ONCE] for at in range(0, len(texts), TEXTS_AT_ONCE))
        return [np.array(e.ids, "<u4") for p in parts for e in self.tokenizer.encode_batch_fast(p, add_special_tokens=False)]

    def _many(self, texts: list[str], group: int = 64) -> tuple[list[int], list[np.ndarray], list[np.ndarray]]:
        """Order in which the texts were encoded, their ids and their numbers of ids.

        Those that hold the separator's sign, or have white space where it might join the separator's, are encoded one by one.
        """
        sign = self.mark.strip(" ") or self.mark

        def joins(t: str) -> bool:
            return sign not in t and not t[-1].isspace() and not (t[0].isspace() if t[0] != " " else t[1].isspace())

        apart = [not joins(t) for t in texts]
        single, joint = (list(compress(range(len(texts)), a)) for a in (apart, map(not_, apart)))
        ids = self._ids([texts[k] for k in single])
        sizes = [np.array([len(i) for i in ids], np.int64)]
        chunks = [joint[at : at + group] for at in range(0, len(joint), group)]
        for chunk, found in zip(chunks, self._ids([self.mark.join([texts[k] for k in c]) for c in chunks]), strict=True):
            between = found == self.mark_id
            cut = np.concatenate([[-1], np.flatnonzero(between), [len(found)]])
            if len(cut) != len(chunk) + 1:
                raise RuntimeError("the separator is not a token of its own")
            ids.append(found[~between])
            sizes.append(np.diff(cut) - 1)
        return single + joint, ids, sizes

    def _learn(self, pieces: list[bytes]) -> np.ndarray:
        """Numbers of new pieces, whose ids are put behind the known ones."""
        order, ids, sizes = self._many([p.decode() for p in pieces])
        size = np.concatenate(sizes)
        self.at = np.concatenate([self.at, len(self.flat) + np.cumsum(size) - size])
        self.size = np.concatenate([self.size, size])
        self.uses = np.concatenate([self.uses, np.zeros(len(size), np.int64)])
        self.flat = np.concatenate([self.flat, *ids])
        number = np.empty(len(pieces), np.int64)
        number[order] = np.arange(len(self.at) - len(pieces), len(self.at))
        return number

    def _gather(self, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the numbered pieces in a row, and where each piece ends."""
        size = self.size[number]
        ends = np.cumsum(size)
        place = np.repeat(self.at[number] - ends + size, size)
        place += np.arange(len(place))
        return self.flat[place], ends

    def _trim(self) -> None:
        keep = np.sort(np.argsort(-self.uses, kind="stable")[: self.most // 2])
        pieces = list(self.number)  # numbers were given in this order
        self.flat, ends = self._gather(keep)
        self.size, self.uses = self.size[keep], self.uses[keep] // 2
        self.at = ends - self.size
        self.number = {pieces[k]: n for n, k in enumerate(keep.tolist())}

    def _block(self, data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(data):
            return np.zeros(0, "<u4"), np.zeros(len(ends), np.int64)
        if self.lower:
            data = lowered(data)
        starts = piece_starts(data, ends)
        bounds = np.append(starts, len(data)).astype(np.int32)
        cut = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(bounds), pa.py_buffer(data)]).dictionary_encode()
        pieces, of = cut.dictionary.to_pylist(), cut.indices.to_numpy()
        number = np.fromiter(map(self.number.get, pieces, repeat(-1)), np.int64, len(pieces))
        new = np.flatnonzero(number < 0)
        few = pc.binary_length(cut.dictionary).to_numpy()[new] <= self.longest
        short, long = new[few], new[~few]
        if len(short):
            number[short] = self._learn([pieces[k] for k in short.tolist()])
            short = short[np.argsort(number[short])]
            self.number.update(zip([pieces[k] for k in short.tolist()], number[short].tolist(), strict=True))
        kept, kept_ids = len(self.at), len(self.flat)
        if len(long):
            number[long] = self._learn([pieces[k] for k in long.tolist()])
        self.uses += np.bincount(number[of], minlength=len(self.at))
        ids, piece_ends = self._gather(number[of])
        self.at, self.size, self.uses, self.flat = self.at[:kept], self.size[:kept], self.uses[:kept], self.flat[:kept_ids]
        if len(self.number) > self.most:
            self._trim()
        return ids, np.concatenate([[0], piece_ends])[np.searchsorted(starts, ends)]

    def column(self, texts: pa.Array, end_id: int | None = None, block: int = 4 << 20) -> tuple[np.ndarray, np.ndarray]:
        """Ids of whole texts in a row, and where each text's ids end; none for a null text, ``end_id`` after each if given.

        Texts are taken in blocks of about ``block`` bytes, a longer text by itself.
        """
        texts = texts.cast(pa.large_string()).fill_null("")
        places = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
        data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
        out, ends, at = [np.zeros(0, "<u4")], [np.zeros(0, np.int64)], 0
        done = 0
        while at < len(texts):
            to = max(at + 1, int(np.searchsorted(places, places[at] + block, "right")) - 1)
            ids, stop = self._block(data[places[at] : places[to]], places[at + 1 : to + 1] - places[at])
            out.append(ids)
            ends.append(stop + done)
            done, at = done + len(ids), to
        ids, stop = np.concatenate(out), np.concatenate(ends)
        if end_id is None:
            return ids, stop
        stop = stop + np.arange(1, len(stop) + 1)
        full = np.empty(len(ids) + len(stop), "<u4")
        inner = np.ones(len(full), bool)
        inner[stop - 1] = False
        full[inner] = ids
        full[stop - 1] = end_id
        return full, stop

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids of whole texts as little-endian unsigned 32-bit integers; none for a null text."""
        ids, ends = self.column(pa.array(texts, pa.string()))
        return [part.tobytes() for part in np.split(ids, ends[:-1])] if texts else []


@cache
def byte_level(path: str) -> Encoder:
    """One encoder for each Python worker, so its cache outlives a task."""
    return Encoder(path, "\n")


@cache
def word_level(path: str, most: int = 400_000) -> Encoder:
    return Encoder(path, " | ", lower=True, most=most)
