"""Token ids of whole texts by a public tokenizer, with a cache of words.

A text is cut before each blank or line feed that follows a character which is no white space. Both
byte-level pre-tokenization and pre-tokenization into words end a piece at each such place whatever
stands around it, so the ids of a text are those of its chunks, put together; a chunk is encoded by
the tokenizers library once and then found in a cache of each Python worker. The chunks of a batch
are numbered by Arrow first, so the cache is asked once for each different chunk of the batch, and
the ids of all texts are gathered at once.
"""

from __future__ import annotations

import gc
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Also where white space other than blanks and line feeds occurs: \S leaves out all that is white
#: space to either library.
CUT = re.compile(r"(?<=\S)(?=[ \n])")
#: Texts that are not just words with one blank or line feed between them: empty ones, and those with
#: other white space (as \S above has it), more of it in a row, or some at an end.
UNEVEN = r"^$|^[ \n]|[ \n]$|[ \n][ \n]|[\x09\x0b-\x0d\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
#: Marks that may end a word.
MARKS = ".,;:!?*#%$&"
#: Chunks of a cache, some 200 bytes each: workers of a pipeline keep what earlier stages took beside it.
CACHE_LIMIT = 400_000
JOINED = 500

_ENCODERS: dict[str, "Encoder"] = {}


def ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers from each start on, ``sizes`` of them, one range after the other."""
    return np.repeat(starts - (np.cumsum(sizes) - sizes), sizes) + np.arange(int(sizes.sum()))


def strings(texts: pa.Array) -> list[str]:
    """As ``to_pylist``, by way of numpy, which is many times faster."""
    return texts.to_numpy(zero_copy_only=False).tolist()


class Encoder:
    """Encodes texts to little-endian unsigned 32-bit ids."""

    def __init__(self, path: str):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.cache: dict[str, bytes] = {}
        line = self.library.encode("a\n b", add_special_tokens=False).ids
        #: The id of a line feed before a blank, if the tokenizer has one.
        self.line_id = line[1] if len(line) == 3 and line[1:2] == self.library.encode("\n", add_special_tokens=False).ids else None

    def whole(self, text: str) -> bytes:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def learn(self, keys: list[str]) -> None:
        """Encode new chunks, many at a time: those that begin with white space and have none after
        it stand in one text without touching each other. Letters and the marks after them are
        different pieces to either pre-tokenization, so they are encoded apart and put together."""
        cache = self.cache
        ends = {k: k.rstrip(MARKS) for k in keys if k[-1] in MARKS}
        ends = {k: core for k, core in ends.items() if core.isalpha()}
        new = set(keys).difference(ends)
        new.update(k for k in {*ends.values(), *(k[len(core) :] + " " for k, core in ends.items())} if k not in cache)
        alone = [k for k in new if k[-1] == " "]
        for k in alone:
            cache[k] = self.whole(k[:-1])
        lines = [k for k in new if k[0] == "\n" and k[-1] != " "]
        for group, lead in ((lines, ""), (list(new.difference(alone, lines)), "\n ")):
            for at in range(0, len(group), JOINED):
                part = group[at : at + JOINED]
                if self.line_id is None or not self.learn_lines(part, lead):
                    self.learn_places(part)
        for k, core in ends.items():
            cache[k] = cache[core] + cache[k[len(core) :] + " "]

    def learn_lines(self, part: list[str], lead: str) -> bool:
        """Encode chunks that begin with a line feed, or get one before their blank (``lead``): the
        id of the line feed, which is no part of the latter, tells where each begins."""
        ids = np.array(self.library.encode_batch_fast([lead + lead.join(part)], add_special_tokens=False)[0].ids, dtype="<u4")
        cuts = np.flatnonzero(ids == self.line_id)
        if len(cuts) != len(part):
            return False
        data, starts, stops = ids.tobytes(), (4 * (cuts + len(lead[:1]))).tolist(), (4 * np.r_[cuts[1:], len(ids)]).tolist()
        self.cache.update(zip(part, [data[a:b] for a, b in zip(starts, stops, strict=True)], strict=True))
        return True

    def learn_places(self, part: list[str]) -> None:
        """Encode chunks one after the other; the places of ids in the text tell whose they are."""
        chunks = [k if k[0] == "\n" else " " + k for k in part]
        found = self.library.encode("".join(chunks), add_special_tokens=False)
        ids = np.array(found.ids, dtype="<u4")
        stops = np.cumsum([len(c) for c in chunks])
        cuts = np.searchsorted(np.array([a for a, _ in found.offsets], dtype=np.int64), stops, "left") * 4
        data = ids.tobytes()
        self.cache.update(zip(part, [data[a:b] for a, b in zip([0, *cuts[:-1].tolist()], cuts.tolist(), strict=True)], strict=True))

    def ids_of(self, keys: list[str]) -> list[bytes]:
        """The ids of chunks by their keys: "x" for " x", "\\nx" for itself, "x " for "x"."""
        get = self.cache.get
        found = [get(k) for k in keys]
        new = [k for k, x in zip(keys, found, strict=True) if x is None]
        if not new:
            return found
        if len(self.cache) + len(new) > CACHE_LIMIT:  # go on with the words of this batch
            self.cache = {k: x for k, x in zip(keys, found, strict=True) if x is not None}
        self.learn(new)
        return [self.cache[k] for k in keys]

    def gather(self, keys: list[str], index: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all chunks of some texts, and how many each text has."""
        found = self.ids_of(keys)
        sizes = np.fromiter(map(len, found), dtype=np.int64, count=len(found)) // 4
        values = np.frombuffer(b"".join(found), dtype="<u4")
        own = sizes[index]
        ids = values[ranges((np.cumsum(sizes) - sizes)[index], own)]
        ends = np.r_[0, np.cumsum(own)][np.cumsum(counts)]
        return ids, np.diff(ends, prepend=0)

    def encode_even(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        lists = pc.split_pattern(pc.replace_substring(texts, "\n", " \n"), " ")
        counts = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
        flat = lists.flatten()
        coded = flat.dictionary_encode()
        index = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        first = np.cumsum(counts) - counts  # a text's first chunk has no white space before it
        begins = flat.take(pa.array(first)).dictionary_encode()
        n = len(coded.dictionary)
        index[first] = n + begins.indices.to_numpy(zero_copy_only=False)
        used = np.bincount(index, minlength=n + len(begins.dictionary)) > 0
        keys = [*strings(coded.dictionary.filter(pa.array(used[:n]))), *(x + " " for x in strings(begins.dictionary))]
        return self.gather(keys, (np.cumsum(used) - 1)[index], counts)

    def encode_uneven(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        cut = [CUT.split(t) if t else [] for t in texts]
        numbers: dict[str, int] = {}
        index = np.array([numbers.setdefault(c + " ", len(numbers)) for x in cut for c in x], dtype=np.int64)
        return self.gather(list(numbers), index, np.array([len(x) for x in cut], dtype=np.int64))

    def encode_array(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, one after the other, and how many each text has.

        Nothing here makes reference cycles, but very many small objects: without the pauses of the
        cyclic collector it takes a fifth less time."""
        active = gc.isenabled()
        gc.disable()
        try:
            uneven = pc.match_substring_regex(texts, UNEVEN).to_numpy(zero_copy_only=False).astype(bool)
            if not uneven.any():
                return self.encode_even(texts) if len(texts) else (np.zeros(0, dtype="<u4"), np.zeros(0, dtype=np.int64))
            odd = self.encode_uneven(texts.filter(pa.array(uneven)).to_pylist())
            if uneven.all():
                return odd
            even = self.encode_even(texts.filter(pa.array(~uneven)))
            sizes = np.empty(len(texts), dtype=np.int64)
            starts = np.empty(len(texts), dtype=np.int64)
            sizes[uneven], sizes[~uneven] = odd[1], even[1]
            starts[uneven], starts[~uneven] = np.cumsum(odd[1]) - odd[1], np.cumsum(even[1]) - even[1] + len(odd[0])
            return np.concatenate([odd[0], even[0]])[ranges(starts, sizes)], sizes
        finally:
            if active:
                gc.enable()

    def encode(self, texts: list[str]) -> list[bytes]:
        ids, sizes = self.encode_array(pa.array(texts, pa.large_string()))
        return [x.tobytes() for x in np.split(ids, np.cumsum(sizes)[:-1])] if texts else []


def encoder(path: str) -> Encoder:
    """The encoder of this Python worker for a tokenizer file."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def sliced(texts: list[str], most: int = 4_000_000):
    """Ranges of a list of texts with about ``most`` characters each."""
    start = size = 0
    for i, t in enumerate(texts):
        size += len(t)
        if size >= most:
            yield start, i + 1
            start, size = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


def sliced_array(texts: pa.Array, most: int = 4_000_000):
    """Ranges of an array of texts with about ``most`` bytes each; a null has none."""
    size = np.cumsum(pc.binary_length(texts).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))
    start = 0
    while start < len(texts):
        stop = min(len(texts), int(np.searchsorted(size, (size[start - 1] if start else 0) + most)) + 1)
        yield start, stop
        start = stop
