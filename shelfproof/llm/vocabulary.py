"""Token ids of many texts with a tokenizers file, each distinct word encoded once per worker."""

from __future__ import annotations

import itertools
import os
from collections.abc import Collection
from operator import add

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Words a worker remembers; beyond, it forgets all of them and starts again.
REMEMBERED = 1_000_000
#: Letters that stand for themselves under normalisation, then marks that form their own
#: pre-token: such a word is its letters in lower case followed by its marks.
MARKS = ".,;:!?"
PLAIN = f"^[A-Za-zÀ-ÖØ-öø-ÿ]+[{MARKS}]*$"
#: Words in one text given to the library, and what stands between those whose ends their ids do not tell.
TOGETHER, MARK = 512, "\x01"
#: Bytes of texts whose words are looked up together.
PART = 1 << 24
_LOADED: dict[str, Vocabulary] = {}


def default_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def vocabulary(path: str, remembered: int = REMEMBERED) -> Vocabulary:
    """The worker's own copy, kept from task to task."""
    if path not in _LOADED:
        _LOADED[path] = Vocabulary(path)
    _LOADED[path].remembered = remembered
    return _LOADED[path]


def forget() -> None:
    """Drops the worker's copies with all they remember."""
    _LOADED.clear()


def _bytes(words: pa.Array) -> list[bytes]:
    return words.view(pa.binary()).to_numpy(zero_copy_only=False).tolist()


class Vocabulary:
    """Ids as little-endian bytes of ``dtype`` per text.

    Where the tokenizer drops blanks and no token spans one, the ids of a text
    are the ids of its words, one after the other; this is tried on a sample
    when the file is loaded.  Other tokenizers encode whole texts.
    """

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.tok.no_truncation()
        self.tok.no_padding()
        size = self.tok.get_vocab_size()
        self.dtype = np.dtype("<u2" if size <= 1 << 16 else "<u4")
        self.ends = np.zeros(size, dtype=bool)
        for piece, i in self.tok.get_vocab().items():
            self.ends[i] = piece.endswith("</w>")
        one = [self.raw(w) for w in ("Été,", "ab", "9", "'s")]
        self.by_word = self.raw(" \t\nÉté,\r ab\x0b\x0c9  's ") == b"".join(one)
        mark = np.frombuffer(self.raw(MARK), dtype=self.dtype)
        self.mark = int(mark[0]) if len(mark) == 1 and self.raw(f"Été, {MARK} 9") == one[0] + mark.tobytes() + one[2] else None
        self.known: dict[bytes, bytes] = {}
        self.remembered = REMEMBERED

    def raw(self, text: str) -> bytes:
        return np.asarray(self.tok.encode(text, add_special_tokens=False).ids, dtype=self.dtype).tobytes()

    def many(self, texts: list[str]) -> list[bytes]:
        return [np.asarray(e.ids, dtype=self.dtype).tobytes()
                for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)]

    def _together(self, words: list[str], size: int, mark: str) -> None:
        """Encodes words in few calls; ``size`` in one, ``mark`` between them where the end of a word cannot be told from its ids."""
        groups = [words[i:i + size] for i in range(0, len(words), size)]
        got = self.tok.encode_batch_fast([f" {mark} ".join(g) for g in groups], add_special_tokens=False)
        for group, one in zip(groups, got, strict=True):
            ids = np.asarray(one.ids, dtype=self.dtype)
            if mark:
                end = np.flatnonzero(ids == self.mark)
                start, end = [0, *(end + 1).tolist()], [*end.tolist(), len(ids)]
            else:
                end = (np.flatnonzero(self.ends[ids]) + 1).tolist()
                start = [0, *end[:-1]]
            if len(end) == len(group):
                data, width = ids.tobytes(), self.dtype.itemsize
                self.known.update((w.encode(), data[i * width:j * width]) for w, i, j in zip(group, start, end, strict=True))
            else:
                self.known.update((w.encode(), ids) for w, ids in zip(group, self.many(group), strict=True))

    def learn(self, words: Collection[bytes]) -> None:
        """Remembers the ids of words that hold no blank."""
        if len(self.known) + 3 * len(words) > self.remembered:
            self.known.clear()
        known = self.known
        new = pa.array(words, pa.binary())
        plain = pc.match_substring_regex(new.view(pa.string()), PLAIN)
        split = new.filter(plain).view(pa.string())
        letters = _bytes(pc.utf8_lower(pc.utf8_rtrim(split, MARKS)))
        split = _bytes(split)
        marks = [w[len(b):] for w, b in zip(split, letters, strict=True)]
        self._together([w.decode() for w in set(letters) if w not in known], TOGETHER, "")
        other = _bytes(new.filter(pc.invert(plain)))
        readable = {w: w.decode("utf-8", "replace") for w in [*other, *(m for m in set(marks) if m not in known)]}
        same = [w for w, t in readable.items() if w and "\ufffd" not in t and MARK not in t]
        if self.mark is None:
            known.update(zip(same, self.many([readable[w] for w in same]), strict=True))
        else:
            self._together([readable[w] for w in same], TOGETHER, MARK)
        same = [w for w in readable if w not in known]  # no word at all, bytes that are not text, or one with the mark
        known.update(zip(same, self.many([readable[w] for w in same]), strict=True))
        known.update(zip(split, map(add, map(known.__getitem__, letters), map(known.__getitem__, marks)), strict=True))

    def encode(self, texts: list[bytes | None]) -> list[bytes]:
        """Ids of each text; NULL is empty."""
        if not self.by_word:
            return self.many([(t or b"").decode("utf-8", "replace") for t in texts])
        out: list[bytes] = []
        start = size = 0
        for end, text in enumerate(texts, 1):
            size += len(text or b"")
            if size >= PART or end == len(texts):
                out += self._encode(texts[start:end])
                start, size = end, 0
        return out

    def _encode(self, texts: list[bytes | None]) -> list[bytes]:
        """Each distinct word of the texts is looked up once, and Arrow puts the words' ids in their places."""
        words = pc.ascii_split_whitespace(pa.array([t or b"" for t in texts], pa.binary()).view(pa.string()))
        code = words.values.view(pa.binary()).dictionary_encode()
        distinct = _bytes(code.dictionary)
        found = list(map(self.known.get, distinct))
        if None in found:
            new = [w for w, f in zip(distinct, found, strict=True) if f is None]
            step = max(1, self.remembered // 16)  # a word, its letters and its marks are remembered
            learnt: dict[bytes, bytes] = {}
            for at in range(0, len(new), step):
                self.learn(new[at:at + step])
                learnt.update((w, self.known[w]) for w in new[at:at + step])
            found = [learnt[w] if f is None else f for w, f in zip(distinct, found, strict=True)]
        placed = pa.array(found, pa.binary()).take(code.indices)
        _, places, data = placed.buffers()
        if data is None:
            return [b""] * len(texts)
        at = np.frombuffer(places, dtype=np.int32)[words.offsets.to_numpy()].tolist()
        data = memoryview(data)
        return [bytes(data[i:j]) for i, j in itertools.pairwise(at)]

    def counts(self, words: list[bytes]) -> np.ndarray:
        """Number of ids of each word, or of each text where ids do not go by words."""
        if not self.by_word:
            return np.asarray([len(b) // self.dtype.itemsize for b in self.encode(words)], dtype=np.int64)
        sizes = {w: len(self.known[w]) for w in words if w in self.known}
        new = [w for w in dict.fromkeys(words) if w not in sizes]
        step = max(1, self.remembered // 4)  # a word, its letters and its marks are remembered
        for at in range(0, len(new), step):
            self.learn(set(new[at:at + step]))
            sizes.update((w, len(self.known[w])) for w in new[at:at + step])
        return np.asarray([sizes[w] // self.dtype.itemsize for w in words], dtype=np.int64)
