"""Ids of whole texts by the tokenizers library, with a bounded memory of distinct chunks.

Both vocabularies split a text into words before any merge, so the ids of a text are the ids of its
chunks between single spaces, one after another. Arrow splits the texts and finds the distinct
chunks, the library encodes each new one once while it stays in the worker's memory, and numpy puts
the ids of the texts together. Where a text's white space could join two chunks, or a text might hold
an added token, the library gets the whole text.
"""

from __future__ import annotations

import codecs
import re
import unicodedata
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from quern.llm.common import kept_in_worker

#: White space after a space, or a space at the end: only then could a match cross a chunk's start.
_ODD_SPACE = re.compile(r" (?:\s|\Z)")
#: Signs that are never part of a word's match when they follow a letter.
_SIGNS = "!\"#$%&()*+,-./:;<=>?@[]^_`{|}~"
#: Letters of one or two bytes that no normal form changes.
_LATIN = "A-Za-zÀ-ÖØ-öø-ÿ"
#: Distinct chunks that a worker remembers before it begins anew; those of before are kept as long again.
KEEP = 350_000
#: How added tokens of the vocabularies begin.
_ADDED = "<|"


def _byte_chars() -> list[str]:
    """The printable character that stands for each byte in the vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


_CHARS = _byte_chars()
#: Decodes bytes to those characters, but a blank stays one and byte 1 is the space before a word.
_TABLE = "".join({1: _CHARS[32], 32: " "}.get(b, c) for b, c in enumerate(_CHARS))


def _pieces(joined: str) -> str:
    return codecs.charmap_decode(joined.encode(), "strict", _TABLE)[0]


def _strings(array) -> list[str]:
    return array.to_numpy(zero_copy_only=False).tolist()


def _letters(text: str) -> bool:
    """Letters only, also once the vocabulary has normalised it."""
    return text.isalpha() and (text.isascii() or unicodedata.normalize("NFC", text.lower()).isalpha())


def runs(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Positions of the items of runs, one run after another."""
    return np.repeat(starts - (np.cumsum(sizes) - sizes), sizes) + np.arange(int(sizes.sum()))


class Pool:
    """Runs of ids, each by its number."""

    def __init__(self):
        self.ids, self.starts, self.sizes = np.empty(1 << 16, np.uint32), np.empty(1 << 12, np.int64), np.empty(1 << 12, np.int64)
        self.n = self.n_ids = 0

    def add(self, flat: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Numbers of new runs: ``flat`` cut by ``sizes``."""
        for name, used, more in (("ids", self.n_ids, len(flat)), ("starts", self.n, len(sizes)), ("sizes", self.n, len(sizes))):
            old = getattr(self, name)
            if used + more > len(old):
                new = np.empty(max(2 * len(old), used + more), old.dtype)
                new[:used] = old[:used]
                setattr(self, name, new)
        self.ids[self.n_ids : self.n_ids + len(flat)] = flat
        at = slice(self.n, self.n + len(sizes))
        self.starts[at] = self.n_ids + np.cumsum(sizes) - sizes
        self.sizes[at] = sizes
        self.n, self.n_ids = at.stop, self.n_ids + len(flat)
        return np.arange(at.start, at.stop)

    def get(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the runs, one after another, and their sizes."""
        sizes = self.sizes[numbers]
        return self.ids[runs(self.starts[numbers], sizes)], sizes


def _look(known: dict[str, int], names: list[str]) -> np.ndarray:
    """The names' numbers, -1 for unknown ones."""
    return np.fromiter(map(known.get, names, repeat(-1)), dtype=np.int64, count=len(names))


class ChunkEncoder:
    """Encodes texts; ``spaces`` tells whether a chunk keeps the space before it.

    New chunks are encoded many at a time, as one text, and told apart by their first ids: a chunk's
    first id is the only one of a piece that starts with a space, or a mark stands between chunks.
    Words of Latin letters skip the vocabulary's normaliser and pattern, which change nothing in them
    but case: they go to its merges in the form that those would give them.
    """

    MARK = "\0"

    def __init__(self, path: str, spaces: bool, keep: int = KEEP):
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import WhitespaceSplit

        self.tokenizer = Tokenizer.from_file(path)
        self.plain = Tokenizer.from_file(path)
        self.plain.normalizer = None
        self.plain.pre_tokenizer = WhitespaceSplit()
        self.spaces, self.keep = spaces, keep
        vocab = self.tokenizer.get_vocab()
        self.first, self.last = (np.zeros(max(vocab.values()) + 1, dtype=bool) for _ in range(2))
        if spaces:
            self.first[[i for piece, i in vocab.items() if piece.startswith(_CHARS[32])]] = True
        else:
            self.first[self.tokenizer.encode(self.MARK, add_special_tokens=False).ids] = True
            self.last[[i for piece, i in vocab.items() if piece.endswith("</w>")]] = True
        self.pool, self.known = Pool(), {}
        self._renew()

    def _renew(self) -> None:
        """A full memory stays for a while: chunks that come again move on to the new one."""
        self.older, self.older_known = self.pool, self.known
        self.pool, self.tails = Pool(), {}
        self.known: dict[str, int] = {"": int(self.pool.add(np.empty(0, np.uint32), np.zeros(1, np.int64))[0])}

    def _find(self, names: list[str]) -> np.ndarray:
        """Runs of known chunks, -1 for new ones."""
        out = _look(self.known, names)
        missing = np.flatnonzero(out < 0)
        if len(missing) and self.older_known:
            old = _look(self.older_known, [names[i] for i in missing])
            missing, old = missing[old >= 0], old[old >= 0]
            out[missing] = self.pool.add(*self.older.get(old))
            self.known.update(zip([names[i] for i in missing], out[missing].tolist(), strict=True))
        return out

    def _encode(self, texts: list[str]) -> np.ndarray:
        """Runs of texts that the library encodes one by one."""
        each = [np.array(e.ids, dtype=np.uint32) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        return self.pool.add(np.concatenate([*each, np.empty(0, np.uint32)]), np.array([len(x) for x in each], dtype=np.int64))

    def _together(self, words: list[str], tokenizer, join, first=None, last=None, skip: int = 0, n: int = 400) -> np.ndarray:
        """Runs of words encoded many at a time, cut where ``first`` or after ``last`` ids stand."""
        groups = [words[i : i + n] for i in range(0, len(words), n)]
        out = []
        for group, encoded in zip(groups, tokenizer.encode_batch_fast(list(map(join, groups)), add_special_tokens=False), strict=True):
            ids = np.array(encoded.ids, dtype=np.uint32)
            cuts = np.flatnonzero(last[ids]) + 1 if first is None else np.append(np.flatnonzero(first[ids]), len(ids))
            if first is None:
                cuts = np.insert(cuts, 0, 0)
            if len(cuts) != len(group) + 1:  # a chunk holds the mark itself, or none of the kind's signs
                out.append(self._encode([" " + c for c in group] if self.spaces else group))
                continue
            sizes = np.diff(cuts) - skip
            out.append(self.pool.add(ids[runs(cuts[:-1] + skip, sizes)] if skip else ids, sizes))
        return np.concatenate([*out, np.empty(0, np.int64)])

    def _words(self, words: list[str]) -> np.ndarray:
        """Runs of new words (with a space before each, if they keep it)."""
        out = np.empty(len(words), dtype=np.int64)
        latin = pc.match_substring_regex(pa.array(words, pa.string()), f"^[{_LATIN}]+$").to_numpy(zero_copy_only=False)
        some = np.flatnonzero(latin)
        if self.spaces:
            kinds = [(some, self.plain, lambda g: _pieces("\1" + " \1".join(g)), self.first, None, 0)]
            kinds.append((np.flatnonzero(~latin), self.tokenizer, lambda g: " " + " ".join(g), self.first, None, 0))
        else:  # a word of letters alone has one id that ends it
            kinds = [(some, self.plain, lambda g: _pieces(" ".join(g).lower()), None, self.last, 0)]
            other = np.flatnonzero(~latin)
            letters = np.array([_letters(words[i]) for i in other], dtype=bool)
            kinds.append((other[letters], self.tokenizer, " ".join, None, self.last, 0))
            mark = f" {self.MARK} "
            kinds.append((other[~letters], self.tokenizer, lambda g: mark + mark.join(g), self.first, None, 1))
        for at, tokenizer, join, first, last, skip in kinds:
            out[at] = self._together([words[i] for i in at], tokenizer, join, first, last, skip)
        return out

    def _learn(self, new: list[str]) -> np.ndarray:
        """Runs of new chunks: a word and the signs after it apart, for words recur with other signs."""
        chunks = pa.array(new, pa.string())
        stems = pc.utf8_rtrim(chunks, _SIGNS)
        split = pc.and_(pc.less(pc.binary_length(stems), pc.binary_length(chunks)), pc.match_substring_regex(stems, f"[{_LATIN}]$"))
        stems = pc.if_else(split, stems, chunks).dictionary_encode()
        names = _strings(stems.dictionary)
        numbers = self._find(names)
        unknown = np.flatnonzero(numbers < 0)
        if len(unknown):
            words = [names[i] for i in unknown]
            numbers[unknown] = self._words(words)
            self.known.update(zip(words, numbers[unknown].tolist(), strict=True))
        out = numbers[stems.indices.to_numpy()]
        at = np.flatnonzero(split.to_numpy(zero_copy_only=False))
        if len(at):
            mine = out[at]
            tails = [new[i][len(names[s]) :] for i, s in zip(at.tolist(), stems.indices.to_numpy()[at].tolist(), strict=True)]
            unseen = list(set(tails).difference(self.tails))
            self.tails.update(zip(unseen, self._encode(unseen).tolist(), strict=True))
            pairs = np.stack([mine, _look(self.tails, tails)], axis=1)
            flat, sizes = self.pool.get(pairs.ravel())
            out[at] = self.pool.add(flat, sizes.reshape(-1, 2).sum(axis=1))
            self.known.update(zip([new[i] for i in at.tolist()], out[at].tolist(), strict=True))
        return out

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the texts, one text after another, and the texts' bounds in them."""
        if len(self.known) > self.keep:
            self._renew()
        whole = [_ADDED in t or bool(self.spaces and _ODD_SPACE.search(t)) for t in texts]
        cut = ["" if w else t for t, w in zip(texts, whole, strict=True)]
        if not self.spaces:  # this vocabulary lower-cases anyway
            cut = [t.lower() if t.isascii() else t for t in cut]
        parts = pc.split_pattern(pa.array(cut, pa.string()), " ")
        offsets = parts.offsets.to_numpy()
        chunks = parts.values.dictionary_encode()
        names = _strings(chunks.dictionary)
        numbers = self._find(names)
        new = np.flatnonzero(numbers < 0)
        if len(new):
            numbers[new] = self._learn([names[i] for i in new])
        each = numbers[chunks.indices.to_numpy()]
        n, n_ids = self.pool.n, self.pool.n_ids
        if self.spaces:  # the first chunk has no space before it
            each[offsets[:-1]] = self._encode([t if w else t.split(" ", 1)[0] for t, w in zip(texts, whole, strict=True)])
        elif any(whole):
            each[offsets[:-1][np.array(whole)]] = self._encode([t for t, w in zip(texts, whole, strict=True) if w])
        flat, sizes = self.pool.get(each)
        self.pool.n, self.pool.n_ids = n, n_ids  # whole texts and first chunks are not kept
        del parts, chunks
        pa.default_memory_pool().release_unused()  # else Arrow holds on to as much as the largest batch took
        return flat, np.concatenate([[0], np.cumsum(sizes)])[offsets]


def encoder(path: str, spaces: bool, keep: int = KEEP) -> ChunkEncoder:
    """The worker's encoder of a vocabulary file, the only one that it keeps."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    encoders = kept_in_worker("encoder")
    if (path, spaces, keep) not in encoders:
        encoders.clear()
        encoders[path, spaces, keep] = ChunkEncoder(path, spaces, keep)
    return encoders[path, spaces, keep]
