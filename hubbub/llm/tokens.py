"""Whole-text encoding with the tokenizers library, remembering what a word encodes to.

A byte-level BPE first cuts a text into pre-tokens and then encodes each alone. Where no two blanks touch,
a pre-token starts at every space and every line feed is one, so a line's first word and every other
word with its space can be encoded alone and joined. All other texts, and those that hold an added token's
string, are encoded in one call. Both give the ids of ``Tokenizer.encode`` on the whole text.

Arrow cuts some MB of texts into words and finds the different ones; only those are looked up, and Arrow puts
their ids in the words' places.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Characters on whose classes two regular expression engines might differ: all outside some Latin blocks.
_FOREIGN = r"[^\x{0}-\x{24F}\x{2010}-\x{2027}\x{20AC}]"

#: Blanks other than single spaces and line feeds within a text.
_UNEVEN = r"\A[ \n]|[ \n]\z|[ \n][ \n]|[\t\x0B-\r\x1C-\x1F\x{85}\x{A0}]"

#: Stands between words: a blank, so that no even text holds it.
_MARK = "\x1f"

#: What ends a word most often.
_STOPS = list(",.;:!?")

#: Bytes of text whose words are looked up together.
PART = 1 << 23

#: Words that an encoder remembers, of each of three kinds.
MEMORY = 600_000

_encoders: dict[tuple[str, int], "WordEncoder"] = {}


def _byte_letters() -> dict[int, int]:
    """The visible letter that byte-level BPE vocabularies write for each byte: bytes that print stand
    for themselves, the others take the code points from 256 on, in order."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = (b for b in range(256) if b not in plain)
    return {b: b for b in plain} | {b: 256 + i for i, b in enumerate(others)}


def _merge(yes: pa.Array, no: pa.Array, mask: pa.Array) -> pa.Array:
    """The values of yes, in their order, where mask holds, those of no elsewhere."""
    mask = mask.to_numpy(zero_copy_only=False)
    at = np.where(mask, np.cumsum(mask), len(yes) + np.cumsum(~mask)) - 1
    return pa.concat_arrays([yes, no]).take(pa.array(at))


class _Memory:
    """Words and their ids as Arrow arrays: `most` words at most; half of them stay, those met last, when it overflows."""

    def __init__(self, most: int):
        self.most, self.parts = most, 0
        self.words = pa.array([], pa.large_string())
        self.ids = pa.array([], pa.large_binary())
        self.met = np.zeros(0, "i4")

    def __len__(self) -> int:
        return len(self.words)

    def look_up(self, words: pa.Array, learn: Callable[[str], bytes]) -> pa.Array:
        """The ids of different words; learn gives those of a word that is not remembered."""
        at = pc.index_in(words, value_set=self.words)
        new = words.filter(at.is_null())
        learned = pa.array([learn(w) for w in new.to_numpy(zero_copy_only=False).tolist()], pa.large_binary())
        ids = pa.concat_arrays([self.ids, learned])
        at = at.fill_null(-1).to_numpy().copy()
        at[at < 0] = np.arange(len(self), len(ids))
        self.parts += 1
        self.met = np.append(self.met, np.zeros(len(new), "i4"))
        self.met[at] = self.parts
        self.words, self.ids = pa.concat_arrays([self.words, new]), ids
        if len(self) > self.most:
            stay = np.sort(np.argsort(self.met, kind="stable")[len(self) - self.most // 2 :])
            self.words, self.ids, self.met = self.words.take(stay), ids.take(stay), self.met[stay]
        return ids.take(at)


class WordEncoder:
    """encode(texts) gives each text's ids as little-endian unsigned 32-bit bytes; each(texts) gives them one by one.

    memory: how many words of a kind are remembered; forgetting costs time but no result.
    """

    def __init__(self, path: str, memory: int = MEMORY):
        import public_tokenizers
        import regex
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.uneven = "|".join([_UNEVEN, _FOREIGN, *map(re.escape, added)])
        self.memory = memory
        self.first = _Memory(memory)
        self.later = _Memory(memory)
        self.pieces: dict[str, bytes] = {}
        self.split = regex.compile(public_tokenizers.PATTERN).findall
        self.letters = _byte_letters()
        self.space = chr(self.letters[0x20])
        self.codes = [i.to_bytes(4, "little") for i in range(max(self.tokenizer.get_vocab().values()) + 1)]
        self.stops = pa.array([self._piece(p) for p in _STOPS], pa.large_binary())

    def _whole(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def encode(self, texts: list[str] | pa.Array) -> list[bytes]:
        return list(self.each(texts))

    def each(self, texts: list[str] | pa.Array) -> Iterator[bytes]:
        texts = texts.cast(pa.large_string()) if isinstance(texts, pa.Array) else pa.array(texts, pa.large_string())
        ends = np.cumsum(pc.binary_length(texts))
        cuts = [0, *(np.flatnonzero(np.diff(ends // PART)) + 1).tolist(), len(texts)]
        for a, b in zip(cuts, cuts[1:]):
            part = texts.slice(a, b - a)
            uneven = pc.match_substring_regex(part, self.uneven)
            even = self._even(part.filter(pc.invert(uneven)))
            whole = (self._whole([t.as_py()])[0] for t in part.filter(uneven))
            for u in uneven.to_pylist():
                yield next(whole if u else even)

    def _even(self, texts: pa.Array) -> Iterator[bytes]:
        marked = pc.replace_substring(texts, "\n", f"{_MARK}\n{_MARK}")
        lists = pc.split_pattern(pc.replace_substring(marked, " ", f"{_MARK} "), _MARK)
        words = lists.flatten().dictionary_encode()
        ids = self._words(words.dictionary).take(words.indices)
        ends = np.cumsum(np.append(0, pc.binary_length(ids)))[np.cumsum(pc.list_value_length(lists))].tolist()
        data = memoryview(ids.buffers()[2] or b"")
        return (data[a:b].tobytes() for a, b in zip([0, *ends], ends))

    def _words(self, words: pa.Array) -> pa.Array:
        """The ids of different words, each with the space before it. A letter word's stop is a piece of its own."""
        stopped = pc.match_substring_regex(words, r"^ ?\pL+[,.;:!?]$")
        ends = words.filter(stopped)
        bare = pa.concat_arrays([words.filter(pc.invert(stopped)), pc.utf8_slice_codeunits(ends, 0, -1)]).dictionary_encode()
        spaced = pc.starts_with(bare.dictionary, " ")
        later = self.later.look_up(bare.dictionary.filter(spaced), self._word)
        first = self.first.look_up(bare.dictionary.filter(pc.invert(spaced)), self._word)
        ids = _merge(later, first, spaced).take(bare.indices)
        plain, n = len(words) - len(ends), len(ends)
        stops = self.stops.take(pc.index_in(pc.utf8_slice_codeunits(ends, -1), value_set=pa.array(_STOPS, pa.large_string())))
        return _merge(pc.binary_join_element_wise(ids.slice(plain, n), stops, pa.scalar(b"", pa.large_binary())), ids.slice(0, plain), stopped)

    def _word(self, word: str) -> bytes:
        if word.isalpha() or word[:1] == " " and word[1:].isalpha():
            return self._piece(word)
        known, out = self.pieces, []
        for piece in self.split(word):
            if piece not in known:
                if len(known) >= self.memory:
                    known.clear()
                known[piece] = self._piece(piece)
            out.append(known[piece])
        return b"".join(out)

    def _piece(self, piece: str) -> bytes:
        if piece.isascii() and piece.isprintable():  # only the space has another letter
            shown = piece.replace(" ", self.space)
        else:
            shown = piece.encode().decode("latin-1").translate(self.letters)
        codes = self.codes
        return b"".join([codes[t.id] for t in self.model.tokenize(shown)])


def word_encoder(path: str, memory: int = MEMORY) -> WordEncoder:
    """One for each Python worker, kept from task to task."""
    if (path, memory) not in _encoders:
        _encoders[path, memory] = WordEncoder(path, memory)
    return _encoders[path, memory]
