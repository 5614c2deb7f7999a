"""Token ids as the tokenizers library gives them, with each different piece of text encoded once.

Pre-tokenisation never joins text across some places (before a single space,
around a single line end), so a text's ids are those of its pieces put
together. The pieces' ids come from the library and are kept in a bounded
cache per Python worker. Plain texts are split and looked up with array
operations, others piece by piece, and a text with characters whose classes
depend on the version of Unicode is given to the library whole.

Strings of special tokens in a text, such as <|endoftext|>, are those tokens, as
the library has it by default; with special=False they are ordinary text. A
text with what such strings begin with is given to the library whole.
"""

from __future__ import annotations

import gc
import json
import os
import re
from array import array

import numpy as np

#: Pieces kept in each generation of each of a worker's two caches, about 200 bytes each.
CACHE_PIECES = 60_000
#: Longer pieces are kept for one generation only.
CACHE_LENGTH = 64

_GPT2 = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Other than letters, digits and signs whose classes are the same in every version of Unicode, a space and a line end.
_ODD = re.compile("[^\n -~¡-ɏ]")
_STRANGE = re.compile("[^\t\n\r -~¡-ɏ]")


def _plain(text: str) -> bool:
    return text.isascii() and text.replace("\n", " ").isprintable() or not _ODD.search(text)


class Recent:
    """A cache of two generations. A full younger one becomes the older; what is still asked for moves back."""

    def __init__(self, size: int):
        self.size, self.young, self.old = size, {}, {}

    def absent(self, pieces: set[str]) -> set[str]:
        """Those that neither generation has; after this the younger one has the others."""
        young, old = self.young, self.old
        young.update((x, old[x]) for x in pieces if x in old)
        return {x for x in pieces if x not in young}

    def age(self) -> None:
        if len(self.young) > self.size:
            self.old = {k: v for k, v in self.young.items() if len(k) <= CACHE_LENGTH}
            self.young = {}


class Encoder:
    """encode(texts) gives each text's ids as bytes, unsigned 32-bit little-endian. Texts are split by WordTable if it can, else by the regular expression."""

    def __init__(self, path: str, special: bool = True):
        import regex
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.library = Tokenizer.from_file(path)
        self.library.encode_special_tokens = not special
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre, norm = spec.get("pre_tokenizer") or {}, spec.get("normalizer")
        steps = [x["type"] for x in (norm or {}).get("normalizers", [])]
        splits = pre.get("pretokenizers") or [{}]
        self.kind = "library"
        added = spec.get("added_tokens") or []
        begins = os.path.commonprefix([x["content"] for x in added])
        self.marks = ([begins] if len(begins) > 1 else [x["content"] for x in added]) if special else []
        if any(x["normalized"] or x["lstrip"] or x["rstrip"] or x["single_word"] for x in added) and special:
            pass  # such tokens can be more than their strings
        elif pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space") and norm is None:
            self.kind, self.split = "spaced", regex.compile(_GPT2).findall
        elif steps == ["NFC", "Replace", "Lowercase"] and [x.get("type") for x in splits] == ["Split", "ByteLevel"] and splits[0]["behavior"] == "Removed" and splits[0]["invert"] and not splits[1]["use_regex"]:
            self.kind, self.split = "lowered", regex.compile(splits[0]["pattern"]["Regex"]).findall
        self.table = WordTable(self.kind == "lowered")
        self.chunks, self.words = Recent(CACHE_PIECES), Recent(CACHE_PIECES)

    def _library(self, texts: list[str]) -> list[bytes]:
        return [array("I", x.ids).tobytes() for x in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, missing: set[str]) -> None:
        """Put the ids of chunks into the cache."""
        split = {chunk: self.split(chunk) for chunk in self.chunks.absent(missing)}
        new = list(self.words.absent({w for ws in split.values() for w in ws}))
        words = self.words.young
        words.update(zip(new, self._library(new), strict=True))
        self.chunks.young.update((chunk, words[ws[0]] if len(ws) == 1 else b"".join([words[w] for w in ws])) for chunk, ws in split.items())

    def _chunks(self, text: str) -> list[str] | None:
        """Pieces to be encoded on their own; none if the text has to be taken whole."""
        if self.kind == "library" or any(m in text for m in self.marks) or not (plain := _plain(text)) and _STRANGE.search(text):
            return None
        if self.kind == "lowered":
            return text.lower().split()
        if not text:
            return []
        if plain:
            parts = text.replace(" ", "\0 ").replace("\n", "\0\n\0").split("\0")
            # an empty piece or a lone space shows white space that isn't single
            if "" not in parts and " " not in parts:
                return parts
        return self.split(text)

    def _uncommon(self, texts: list[str]) -> list[bytes]:
        parts = [self._chunks(text) for text in texts]
        whole = iter(self._library([t for t, p in zip(texts, parts, strict=True) if p is None]))
        get = self.chunks.young.get
        found = [None if p is None else list(map(get, p)) for p in parts]
        lacking = [k for k, ids in enumerate(found) if ids is not None and None in ids]
        if lacking:
            self._learn({x for k in lacking for x, ids in zip(parts[k], found[k], strict=True) if ids is None})
            for k in lacking:
                found[k] = list(map(get, parts[k]))
        self.chunks.age()
        self.words.age()
        return [next(whole) if ids is None else b"".join(ids) for ids in found]

    def encode(self, texts: list[bytes]) -> list[bytes]:
        """texts: UTF-8. Hand in a few MB at a time: all different pieces of the texts are held at once."""
        if not texts:
            return []
        out: list[bytes | None] = [None] * len(texts)
        common = np.zeros(len(texts), bool) if self.kind == "library" else self.table.common(texts)
        for mark in self.marks:
            own = mark.encode()
            common &= np.asarray([own not in t for t in texts])
        rare = np.flatnonzero(~common).tolist()
        for k, ids in zip(rare, self._uncommon([texts[k].decode("utf-8", "replace") for k in rare]), strict=True):
            out[k] = ids
        often = np.flatnonzero(common).tolist()
        if often:
            for k, ids in zip(often, self.table.encode([texts[k] for k in often], self._library), strict=True):
                out[k] = ids
        return out


LETTER, DIGIT, SIGN, SPACE, LINE, ODD = 1, 2, 3, 4, 5, 0
#: Slots of a worker's table of words, 32 bytes each. With more than WORDS of them in use it takes no more, and starts anew
#: once it lacks more than DRIFT of a batch's words.
SLOTS = 1 << 20
WORDS = 650_000
DRIFT = 0.15
#: Bytes of a word that fit a slot; longer words are in a dictionary.
SLOT_BYTES = 24


class WordTable:
    """Splits texts into words and finds their ids with array operations.

    It takes texts of ASCII and Latin letters of two bytes without an
    apostrophe, which is where the split is plain: by the class of a byte.
    The table is an open-addressing hash table of words and their place in
    one array of ids; words are compared in full, not by hash.
    """

    def __init__(self, lowered: bool):
        self.lowered = lowered
        kinds = np.zeros(256, np.uint8)
        for c in range(33, 127):
            kinds[c] = LETTER if chr(c).isalpha() else DIGIT if chr(c).isdigit() else SIGN
        kinds[ord("'")] = ODD
        kinds[32], kinds[10] = SPACE, LINE
        kinds[0x80:0xC0] = LETTER
        kinds[0xC3 : 0xC4 if lowered else 0xCA] = LETTER
        self.kinds = kinds
        self.lower = np.arange(256, dtype=np.uint8)
        self.lower[65:91] += 32
        self.masks = np.asarray([(1 << 8 * n) - 1 for n in range(9)], np.uint64)
        self._clear()

    def _clear(self) -> None:
        self.slots = np.zeros((SLOTS, 4), np.uint64)  # three words of bytes; place and number of ids, plus one
        self.pool = np.zeros(1 << 20, "<u4")
        self.used = self.words = 0
        self.missed = 0.0  # share of the last batch's words that weren't in the table
        self.long: dict[bytes, int] = {}

    def common(self, texts: list[bytes]) -> np.ndarray:
        """Which of the texts this table can split."""
        data, ends = self._joined(texts)
        kind = self.kinds[data]
        bad = kind == ODD
        two = np.flatnonzero(data[:-1] >= 0xC3)
        after = data[two + 1]
        bad[two] |= (data[two] == 0xC3) & ((after == 0x97) | (after == 0xB7)) | (data[two] == 0xC9) & (after > 0x8F)
        if not self.lowered:
            white = (kind == SPACE) | (kind == LINE)
            bad[1:] |= white[1:] & white[:-1]
            sizes = np.diff(ends, prepend=0)
            bad[(ends - sizes)[sizes > 0]] |= white[(ends - sizes)[sizes > 0]]
            bad[ends[sizes > 0] - 1] |= white[ends[sizes > 0] - 1]
        out = np.ones(len(texts), bool)
        out[np.searchsorted(ends, np.flatnonzero(bad), "right")] = False
        return out

    @staticmethod
    def _joined(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        return np.frombuffer(b"".join(texts), np.uint8), np.cumsum([len(t) for t in texts])

    def _split(self, texts: list[bytes]):
        """Bytes with some room behind, starts and sizes of words, and how many words end with each text."""
        data, ends = self._joined(texts)
        if self.lowered:
            low = self.lower[data]
            lead = np.flatnonzero(data[:-1] == 0xC3)
            low[lead + 1] += (0x20 * (low[lead + 1] < 0x9F)).astype(np.uint8)
            data = low
        n = len(data)
        kind = self.kinds[data]
        before = np.concatenate([[LINE], kind[:-1]]).astype(np.uint8)
        before[ends[:-1][ends[:-1] < n]] = LINE
        if self.lowered:
            white = (kind == SPACE) | (kind == LINE)
            new = ~white & ((kind != before) | (kind == DIGIT))
            new[ends[:-1][ends[:-1] < n]] |= ~white[ends[:-1][ends[:-1] < n]]
            edge = np.flatnonzero(new | white)
            keep = new[edge]
        else:
            new = (kind != before) & (before != SPACE) | (kind == LINE)
            new[ends[:-1][ends[:-1] < n]] = True
            edge = np.flatnonzero(new)
            keep = slice(None)
        sizes = np.diff(np.append(edge, n))
        starts, sizes = edge[keep], sizes[keep]
        return np.concatenate([data, np.zeros(SLOT_BYTES, np.uint8)]), starts, sizes, np.searchsorted(starts, ends)

    def _keys(self, data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Bytes of each word, up to 24, as three integers."""
        eights = np.ndarray(len(data) - 7, "<u8", data, strides=(1,))
        return np.stack([eights[starts + 8 * k] & self.masks[np.clip(sizes - 8 * k, 0, 8)] for k in range(3)], axis=1)

    @staticmethod
    def _slot(keys: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            h = keys[:, 0] * np.uint64(0x9E3779B97F4A7C15) ^ keys[:, 1] * np.uint64(0xC2B2AE3D27D4EB4F) ^ keys[:, 2] * np.uint64(0x165667B19E3779F9)
            h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        return ((h ^ (h >> np.uint64(32))) & np.uint64(SLOTS - 1)).astype(np.int64)

    def _find(self, keys: np.ndarray) -> np.ndarray:
        """Last column of the words' slots, 0 where a word isn't there."""
        out = np.zeros(len(keys), np.uint64)
        open_, at = np.arange(len(keys)), self._slot(keys)
        while len(open_):
            rows = self.slots[at]
            own = keys[open_]
            same = (rows[:, 0] == own[:, 0]) & (rows[:, 1] == own[:, 1]) & (rows[:, 2] == own[:, 2]) & (rows[:, 3] > 0)
            out[open_[same]] = rows[same, 3]
            on = ~same & (rows[:, 3] > 0)
            open_, at = open_[on], (at[on] + 1) & (SLOTS - 1)
        return out

    def _store(self, ids: list[bytes]) -> np.ndarray:
        """Put ids into the pool: their places and numbers, plus one."""
        counts = np.asarray([len(x) // 4 for x in ids], np.uint64)
        flat = np.frombuffer(b"".join(ids), "<u4")
        while len(self.pool) < self.used + len(flat):
            self.pool = np.concatenate([self.pool, np.zeros_like(self.pool)])
        self.pool[self.used : self.used + len(flat)] = flat
        places = np.uint64(self.used) + np.cumsum(counts, dtype=np.uint64) - counts
        self.used += len(flat)
        return (places << np.uint64(32) | counts) + np.uint64(1)

    def _insert(self, keys: np.ndarray, values: np.ndarray) -> None:
        """keys: all different and not in the table."""
        left, at = np.arange(len(keys)), self._slot(keys)
        while len(left):
            free = self.slots[at, 3] == 0
            _, first = np.unique(at, return_index=True)
            put = np.zeros(len(at), bool)
            put[first] = True
            put &= free
            self.slots[at[put], :3] = keys[left[put]]
            self.slots[at[put], 3] = values[left[put]]
            left, at = left[~put], (at[~put] + ~free[~put]) & (SLOTS - 1)
        self.words += len(keys)

    def encode(self, texts: list[bytes], library) -> list[bytes]:
        data, starts, sizes, bounds = self._split(texts)
        full = self.words > WORDS
        if full and self.missed > DRIFT or len(self.long) > CACHE_PIECES:
            self._clear()
            full = False
        value = np.zeros(len(starts), np.uint64)
        long = np.flatnonzero(sizes > SLOT_BYTES)
        if len(long):
            raw = data.tobytes()
            words = [raw[s : s + n] for s, n in zip(starts[long].tolist(), sizes[long].tolist(), strict=True)]
            new = sorted({w for w in words if w not in self.long})
            self.long.update(zip(new, self._store(library([w.decode() for w in new])).tolist(), strict=True))
            value[long] = [self.long[w] for w in words]
        kept = self.used
        short = np.flatnonzero(sizes <= SLOT_BYTES)
        keys = self._keys(data, starts[short], sizes[short])
        found = self._find(keys)
        lacking = np.flatnonzero(found == 0)
        self.missed = len(lacking) / max(1, len(short))
        if len(lacking):
            kinds, first, back = np.unique(keys[lacking], axis=0, return_index=True, return_inverse=True)
            raw, some = data.tobytes(), short[lacking[first]]
            new = [raw[s : s + n].decode() for s, n in zip(starts[some].tolist(), sizes[some].tolist(), strict=True)]
            places = self._store(library(new))
            if not full:
                self._insert(kinds, places)
            found[lacking] = places[back.ravel()]
        value[short] = found
        value -= np.uint64(1)
        counts = (value & np.uint64((1 << 32) - 1)).astype(np.int64)
        ends = np.cumsum(counts)
        total = int(ends[-1]) if len(ends) else 0
        source = np.repeat((value >> np.uint64(32)).astype(np.int64) - ends + counts, counts) + np.arange(total)
        flat = self.pool[source].tobytes()
        if full:  # what isn't in the table is forgotten
            self.used = kept
        cuts = np.concatenate([[0], ends])[np.concatenate([[0], bounds])] * 4
        return [flat[a:b] for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]


#: Characters encoded at once.
BATCH_CHARS = 1_000_000


def batches(batch, text: int, chars: int = BATCH_CHARS):
    """Slices of an Arrow record batch with the texts or bytes in them (null: empty), each of about so many bytes; a longer text is alone."""
    import pyarrow as pa
    import pyarrow.compute as pc

    sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(sizes)
    empty = b"" if pa.types.is_binary(batch.schema.types[text]) or pa.types.is_large_binary(batch.schema.types[text]) else ""
    start = 0
    while start < batch.num_rows:
        stop = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + chars, "right")))
        part = batch.slice(start, stop - start)
        yield part, [t or empty for t in part.column(text).to_pylist()]
        start = stop


_encoders: dict[tuple[str, bool], Encoder] = {}


def encoder(path: str, special: bool = True) -> Encoder:
    """One encoder per worker, file and setting."""
    gc.disable()  # nothing here is cyclic, and each collection would walk the caches
    if (path, special) not in _encoders:
        _encoders[path, special] = Encoder(path, special)
    return _encoders[path, special]


def tokenizer_path(name: str) -> str:
    """Where a public tokenizer file lies on this machine. Called in each worker: the files are installed, not shipped."""
    import public_tokenizers

    return public_tokenizers.path(name)
