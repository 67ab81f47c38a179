"""A word memo before the tokenizers library, for texts whose words repeat.

Byte-level and word-end BPE files both split a text with a pattern that is matched from left to right
without looking back. A single space between two characters that are not white space therefore always
starts a new piece: whatever piece stands before it ends there, as no class that holds a non-space holds
the space, and the space joins the run behind it (or is dropped). One line feed there, or each of two, is a piece
of its own (or dropped). Special strings hold neither, so they never reach across one. Punctuation behind letters, up
to such a place, is a piece of its own, too. So the ids of a text are those of its parts, in order, and each different
part needs the library only once.

Arrow cuts the texts, numbers the different parts of a batch and puts their ids in place; Python sees only the
different parts.
"""

from __future__ import annotations

import os
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

_CUT = re.compile(r"(?<=\S) (?=\S)")
#: Texts that begin or end with white space, hold a space beside other white space, a tab, three line feeds or any white
#: space that is rare, are cut by ``_CUT`` alone.
_ODD = "\\A[ \\n]|[ \\n]\\z| [ \\n]|\\n |\\n\\n\\n|[\\t\\r\x0b\x0c\x1c-\x1f\u0085   -     　]"
_PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


def _string_buffers(strings: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and bytes of strings without nulls."""
    offsets = np.frombuffer(strings.buffers()[1], np.int32, len(strings) + 1, strings.offset * 4).astype(np.int64)
    data = strings.buffers()[2]
    return offsets, np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)


def _strings(parts: list[np.ndarray], sizes: np.ndarray) -> pa.StringArray:
    ends = np.append(0, np.cumsum(sizes)).astype(np.int32)
    return pa.StringArray.from_buffers(len(sizes), pa.py_buffer(ends.tobytes()), pa.py_buffer(np.concatenate(parts).tobytes()))


class WordMemo:
    """Ids of whole texts as little-endian unsigned 32-bit bytes, as ``encode(text, add_special_tokens=False)`` gives them.

    ``rest`` has the ids of parts behind a space, ``first`` those of parts at the beginning of a text or line. ``most``
    bounds the parts of a generation of each; past it the generation becomes the old one, from which parts still in use
    are taken over. A part takes about 150 bytes, so a memo holds at most 0.6 KB times ``most``.
    """

    def __init__(self, path: str, most: int = 200_000):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.most = most
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        size = max(vocabulary.values()) + 1
        spaced, ended = np.zeros(size, bool), np.zeros(size, bool)
        for token, i in vocabulary.items():
            spaced[i] = token.startswith("Ġ")
            ended[i] = token.endswith("</w>")
        self.ended = ended if ended.any() else None
        self.spaced = spaced
        one = self._encode(["a"])[0]
        self.line = self._encode(["a\na"])[0][len(one) : -len(one)]
        specials = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.stems = {x.rstrip(_PUNCTUATION) for x in specials}  # what they begin with, before their last punctuation
        self.odd = _ODD + "".join(f"|\\n\\n{re.escape(x)}" for x in specials)  # there, two line feeds are one piece
        self.held: dict[str, dict[str, bytes]] = {"rest": {}, "first": {}}
        self.old: dict[str, dict[str, bytes]] = {"rest": {}, "first": {}}

    def _encode(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, dtype="<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _letters(self, words: list[str], kind: str) -> dict[str, bytes]:
        """Ids of words of letters. They go to the library joined by what stands before them, and their ids are parted
        again: by the tokens that end a word or start with a space, or by those of line feeds. If the counts
        differ, they go singly."""
        found: dict[str, bytes] = {}
        before = " " if kind == "rest" else "\n"
        for at in range(0, len(words), 64):
            some = words[at : at + 64]
            ids = np.array(self.tokenizer.encode_batch_fast([before + before.join(some)], add_special_tokens=False)[0].ids, dtype="<u4")
            skip = 0
            if self.ended is not None:
                cut = np.append(0, np.flatnonzero(self.ended[ids]) + 1)
            elif kind == "rest":
                cut = np.append(np.flatnonzero(self.spaced[ids]), len(ids))
            else:
                cut, skip = np.append(np.flatnonzero(ids == np.frombuffer(self.line, "<u4")[0]), len(ids)), 4
            if len(cut) != len(some) + 1:
                found.update(zip(some, self._single(some, kind), strict=True))
                continue
            raw, ends = ids.tobytes(), (cut * 4).tolist()
            found.update((w, raw[a + skip : b]) for w, a, b in zip(some, ends[:-1], ends[1:], strict=True))
        return found

    def _single(self, parts: list[str], kind: str) -> list[bytes]:
        return self._encode([" " + p for p in parts] if kind == "rest" else parts)

    def _known(self, parts: list[str], kind: str) -> list[bytes]:
        """The ids of different parts."""
        held = self.held[kind]
        if len(held) > self.most:
            self.old[kind], held = held, {}
            self.held[kind] = held
        found = list(map(held.get, parts))
        new = [i for i, ids in enumerate(found) if ids is None]
        if new:
            asked = [parts[i] for i in new]
            letters, others = [], []
            for p, ids in zip(asked, map(self.old[kind].get, asked), strict=True):
                if ids is not None:
                    held[p] = ids
                elif p.isalpha():
                    letters.append(p)
                else:
                    others.append(p)
            held.update(self._letters(letters, kind))
            if others:
                held.update(zip(others, self._single(others, kind), strict=True))
            for i, ids in zip(new, map(held.__getitem__, asked), strict=True):
                found[i] = ids
        return found

    def _ends_apart(self, words: pa.StringArray) -> np.ndarray:
        """Whether punctuation behind a word is certain to be a piece of its own: the word ends with a Latin letter (of
        ASCII or of the blocks up to U+023F; not with a dotted capital I, which folds to a letter and a mark) and isn't
        the beginning of a special string."""
        offsets, data = _string_buffers(words)
        full = np.flatnonzero(np.diff(offsets) > 0)
        out = np.zeros(len(words), bool)
        last = data[offsets[1:][full] - 1]
        before = data[np.maximum(offsets[1:][full] - 2, 0)]
        out[full] = (last | 32 >= 97) & (last | 32 <= 122) | (last >= 128) & ((before >= 0xC4) & (before <= 0xC8) & ((before != 0xC4) | (last != 0xB0)) | (before == 0xC3) & (last != 0x97) & (last != 0xB7))
        for stem in self.stems:
            out &= ~pc.ends_with(words, stem).to_numpy(zero_copy_only=False)
        return out

    def encode_array(self, texts: pa.Array) -> pa.LargeBinaryArray:
        """The ids of each text; none for null."""
        texts = pc.fill_null(texts.cast(pa.string()), "")
        odd = pc.match_substring_regex(texts, self.odd)
        if not pc.any(odd).as_py():
            return self._parted(pc.split_pattern(pc.replace_substring(texts, "\n", " \n"), " "), True)
        plain = self._parted(pc.split_pattern(pc.replace_substring(texts.filter(pc.invert(odd)), "\n", " \n"), " "), True)
        others = self._parted(pa.array([_CUT.split(t) for t in texts.filter(odd).to_pylist()], pa.list_(pa.string())), False)
        mask = odd.to_numpy(zero_copy_only=False)
        place = np.where(mask, len(plain) + np.cumsum(mask) - 1, np.cumsum(~mask) - 1)
        return pa.concat_arrays([plain, others]).take(pa.array(place))

    def _parted(self, lists: pa.ListArray, finer: bool) -> pa.LargeBinaryArray:
        """The ids of texts from their parts; a text's first part has no space before it. ``finer``: a line feed stands
        before the first part of each line, and punctuation at a part's end is looked up apart."""
        if not len(lists):
            return pa.array([], pa.large_binary())
        bounds = lists.offsets.to_numpy().astype(np.int64)
        flat = lists.values.slice(bounds[0], bounds[-1] - bounds[0])
        bounds = bounds - bounds[0]
        n = len(flat)
        heads, lines, tailed, tails = np.zeros(n, bool), np.zeros(n, bool), np.zeros(n, bool), []
        heads[bounds[:-1]] = True
        if finer:
            offsets, data = _string_buffers(flat)
            lines = offsets[1:] > offsets[:-1]
            lines[lines] = data[offsets[:-1][lines]] == 10
            cores = pc.ascii_rtrim(pc.ascii_ltrim(flat, characters="\n"), characters=_PUNCTUATION)
            sizes, ends = np.diff(_string_buffers(cores)[0]), offsets[1:]
            tailed = sizes + lines < np.diff(offsets)
            coded = cores.dictionary_encode()
            place, words = coded.indices.to_numpy(), coded.dictionary.to_pylist()
            whole = tailed & ~self._ends_apart(coded.dictionary)[place]  # such parts are looked up with their punctuation
            tailed &= ~whole
            if whole.any():
                parts = pc.ascii_ltrim(flat.filter(pa.array(whole)), characters="\n").dictionary_encode()
                place = place.astype(np.int64)
                place[whole] = len(words) + parts.indices.to_numpy()
                words += parts.dictionary.to_pylist()
            starts = (offsets[:-1] + lines + sizes)[tailed]
            lengths = ends[tailed] - starts
            at = np.repeat(starts - np.append(0, np.cumsum(lengths)[:-1]), lengths) + np.arange(lengths.sum())
            coded = _strings([data[at]], lengths).dictionary_encode()
            tail_place, tails = coded.indices.to_numpy(), coded.dictionary.to_pylist()
        else:
            coded = flat.dictionary_encode()
            place, words = coded.indices.to_numpy(), coded.dictionary.to_pylist()
        ahead = (heads | lines) if self.ended is None else np.zeros(n, bool)  # else where a part stands makes no difference
        numbers, values = np.zeros((2, len(words)), np.int64), []
        for i, kind in enumerate(("rest", "first")):
            used = np.zeros(len(words), bool)
            used[place[ahead if i else ~ahead]] = True
            used = np.flatnonzero(used)
            numbers[i, used] = len(values) + np.arange(len(used))
            values += self._known([words[u] for u in used.tolist()], kind)
        base = len(values)
        values += [*self._encode(tails), self.line]
        # each part gives its line feed, its ids and its punctuation's
        before = lines & bool(self.line)
        ends = np.cumsum(1 + before + tailed)
        order = np.empty(ends[-1], np.int64)
        order[ends - 1 - tailed] = numbers[ahead.astype(np.int8), place]
        order[(ends - 2 - tailed)[before]] = len(values) - 1
        if tails:
            order[(ends - 1)[tailed]] = base + tail_place
        ids = pa.array(values, pa.large_binary()).take(pa.array(order))
        starts = np.frombuffer(ids.buffers()[1], np.int64, len(ids) + 1, ids.offset * 8)[np.append(0, ends)[bounds]]
        return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(lists), [None, pa.py_buffer(starts.tobytes()), ids.buffers()[2]])

    def encode(self, texts: list[str]) -> list[bytes]:
        return self.encode_array(pa.array(texts, pa.string())).to_pylist()


_held: dict[str, WordMemo] = {}


def forget() -> None:
    """Drop this worker's memo."""
    _held.clear()


def memo(path: str) -> WordMemo:
    """The memo of this Python worker for a tokenizer file."""
    if path not in _held:
        _held.clear()
        _held[path] = WordMemo(path)
    return _held[path]
