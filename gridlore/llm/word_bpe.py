"""Words and merges of a public tokenizer file of the kind BPE with word ends.

Such a file composes characters (NFC), lowers them one by one, drops white space, cuts what is left into words by a
pattern and merges the bytes of each word. Special strings are found in the text as it is, before all that.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterable, Iterator

import numpy as np

# fixed values: the pattern of the tokenizer file, and the white space it knows
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
WHITE_SPACE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
BLOCK_CHARS = 1 << 20  # of a text that are cut into words at a time
GATHERED_CHARS = 1 << 20  # of texts whose new chunks are merged together
SLOT_BITS = 20  # of the tables in which pairs are looked up
KNOWN_BYTES = 96 << 20  # of chunks and their ids that a task remembers
KNOWN_LENGTH = 64  # characters of the longest chunk that is remembered
ENTRY_BYTES = 200  # of an entry, besides its characters and ids


class Words:
    """Cuts texts into chunks between white space, and chunks into words."""

    def __init__(self, path: str):
        import regex

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        kinds = [p.get("pattern", {}).get("Regex") for p in spec["pre_tokenizer"]["pretokenizers"]]
        if PATTERN not in kinds or spec["model"].get("end_of_word_suffix") != "</w>":
            raise ValueError(f"{path} is not a word BPE file of the kind that is known here")
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self._special = re.compile("|".join(map(re.escape, self.special)))
        self._find = regex.compile(PATTERN.replace(r"\s", WHITE_SPACE)).findall
        self._white = re.compile(f"[{WHITE_SPACE}]")
        self._whites = re.compile(f"[{WHITE_SPACE}]+")
        self._separators = re.compile("[\x1c-\x1f]")  # white space for str.split, but not for the tokenizer
        self._path, self._library, self._odd = path, None, None

    @property
    def library(self):
        if self._library is None:
            from tokenizers import Tokenizer

            self._library = Tokenizer.from_file(self._path)
        return self._library

    def odd(self, text: str) -> bool:
        """Whether a text holds a code point that the library may take for something else than this Python does.

        These are the ones that Python's tables have not assigned, and combining marks that the library does not reorder.
        """
        try:
            text.encode("latin-1")  # the quickest test: none of these letters is odd
            return False
        except UnicodeEncodeError:
            pass
        if self._odd is None:
            normalize = self.library.normalizer.normalize_str

            def moved(c: str) -> bool:
                marked = f"a\u0345{c}"
                return normalize(marked) != normalize(unicodedata.normalize("NFC", marked))

            marks = frozenset(c for c in map(chr, range(0x300, 0x110000)) if unicodedata.combining(c) and moved(c))
            plane = map(chr, (*range(0x80, 0xD800), *range(0xE000, 0x10000)))
            low = "".join(re.escape(c) for c in plane if c in marks or unicodedata.category(c) == "Cn")
            self._odd = re.compile(f"[{low}]"), re.compile("[\U00010000-\U0010ffff]"), marks
        low, high, marks = self._odd
        if low.search(text):
            return True
        return any(c in marks or unicodedata.category(c) == "Cn" for c in set(high.findall(text)))

    def words_of(self, chunk: str) -> list[str]:
        if chunk.isalpha():  # a run of letters is one word
            return [chunk]
        if chunk[-1] in ",.;:!?" and chunk[:-1].isalpha():
            return [chunk[:-1], chunk[-1]]
        return self._find(chunk)

    def blocks(self, text: str) -> Iterator[str]:
        """A long text in parts that end before white space, where no word and no character goes on."""
        pos = 0
        while pos < len(text):
            stop = self._white.search(text, pos + BLOCK_CHARS)
            end = stop.start() if stop else len(text)
            yield text[pos:end]
            pos = end

    def _plain(self, text: str) -> list[str]:
        if not text.isascii():
            if self.odd(text):
                # chunks that the library has to read are marked by a blank before them
                parts = [c for c in self._whites.split(text) if c]
                return [x for c in parts for x in ([" " + c] if self.odd(c) else self._plain(c))]
            if "Σ" in text:
                text = text.replace("Σ", "σ")  # lowered alone, not by its place in the word
            text = unicodedata.normalize("NFC", text)
        if self._separators.search(text):
            return [c for c in self._whites.split(text.lower()) if c]
        return text.lower().split()

    def chunks(self, text: str) -> list[str]:
        """What stands between white space in a block, in order; a special string has a blank before it."""
        if "<|" not in text or not self._special.search(text):
            return self._plain(text)
        chunks, pos = [], 0
        for m in self._special.finditer(text):
            chunks += self._plain(text[pos : m.start()])
            chunks.append(" " + m.group())
            pos = m.end()
        return chunks + self._plain(text[pos:])


def byte_symbols() -> list[str]:
    """The character that stands for each byte in byte-level vocabularies: printable ones for themselves."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in own else chr(next(spare)) for b in range(256)]


class Merges:
    """The merges of a word BPE file, applied to many words at once."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        vocab = model["vocab"]
        symbols = byte_symbols()
        self.first = np.array([vocab[s] for s in symbols], np.int64)
        self.last = np.array([vocab[s + "</w>"] for s in symbols], np.int64)
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        self.width = max(vocab.values()) + 1
        keys = np.array([vocab[a] * self.width + vocab[b] for a, b in pairs], np.int64)
        made = np.array([vocab[a + b] for a, b in pairs], np.int64)
        self.none = len(keys)
        # of pairs and what they become, by rank; the last entry is that of no pair
        self.keys, self.made = np.append(keys, -1), np.append(made, -1)
        self.slots: list[tuple[np.uint64, np.ndarray]] = []
        left = np.arange(self.none)
        while len(left):  # pairs that share a slot go to the next table
            factor = np.uint64(0x9E3779B97F4A7C15 + 2 * len(self.slots) * 0x517CC1B727220A95 & (1 << 64) - 1 | 1)
            table = np.full(1 << SLOT_BITS, self.none, np.int32)
            at = self._slot(keys[left], factor)
            table[at] = left
            self.slots.append((factor, table))
            left = left[table[at] != left]

    @staticmethod
    def _slot(pairs: np.ndarray, factor: np.uint64) -> np.ndarray:
        return (pairs.astype(np.uint64) * factor >> np.uint64(64 - SLOT_BITS)).astype(np.int64)

    def ranks(self, pairs: np.ndarray) -> np.ndarray:
        """The rank of each pair, and the number of pairs for one that is never merged."""
        out = np.full(len(pairs), self.none, np.int32)
        for factor, table in self.slots:
            found = table[self._slot(pairs, factor)]
            hit = self.keys[found] == pairs
            out[hit] = found[hit]
        return out

    def ids(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The symbols that survive in all words, one word after the other, and their number in each; no word is empty.

        All words lie in one array of symbols. In every round each word finds its pair of lowest rank and merges all its
        occurrences at once, of overlapping ones every other from the left; words without a pair leave the array.
        """
        none = np.int32(self.none)
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        flat = np.frombuffer(b"".join(words), np.uint8)
        symbols = self.first[flat]
        ends = np.cumsum(sizes) - 1
        symbols[ends] = self.last[flat[ends]]
        owner = np.repeat(np.arange(len(words)), sizes)
        done: list[tuple[np.ndarray, np.ndarray]] = []
        while len(symbols) > 1:
            rank = np.full(len(symbols), none)
            inside = np.flatnonzero(owner[:-1] == owner[1:])
            rank[inside] = self.ranks(symbols[inside] * self.width + symbols[inside + 1])
            starts = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
            lengths = np.diff(np.r_[starts, len(owner)])
            lowest = np.repeat(np.minimum.reduceat(rank, starts), lengths)
            merge = (rank == lowest) & (rank < none)
            # of a run of overlapping occurrences, every other one
            place = np.arange(len(merge))
            run = np.maximum.accumulate(np.where(merge & ~np.r_[False, merge[:-1]], place, 0))
            touching = np.r_[False, merge[1:] & merge[:-1]]
            merge &= ~touching | ((place - run) % 2 == 0)
            where = np.flatnonzero(merge)
            symbols[where] = self.made[rank[where]]
            stays = lowest < none
            done.append((owner[~stays], symbols[~stays]))
            stays[where + 1] = False
            symbols, owner = symbols[stays], owner[stays]
        owner, symbols = (np.concatenate(x) for x in zip(*done, (owner, symbols), strict=True))
        return symbols[np.argsort(owner, kind="stable")], np.bincount(owner, minlength=len(words))


class Known:
    """The ids of chunks that a task has met, as bytes; beyond ``limit`` bytes it forgets them and starts anew.

    Long chunks, as in texts without blanks, are merged each time and not remembered.
    """

    def __init__(self, path: str, limit: int = KNOWN_BYTES):
        self.words, self.merges, self.limit = Words(path), Merges(path), limit
        self.special = {" " + s: np.array([i], "<u4").tobytes() for s, i in self.words.special.items()}
        self.of, self.held = dict(self.special), 0

    def learn(self, blocks: list[list[str]]) -> dict[str, bytes]:
        """Merge the words of all chunks of some blocks that are new, together. Returns those that are not remembered."""
        if self.held > self.limit:
            self.of, self.held = dict(self.special), 0
        new = list(set().union(*blocks).difference(self.of))
        found = {c: np.array(self.words.library.encode(c[1:], add_special_tokens=False).ids, "<u4").tobytes() for c in new if c[0] == " "}
        new = [c for c in new if c[0] != " "]
        cut = [self.words.words_of(c) for c in new]
        words = [w.encode() for c in cut for w in c]
        flat, counts = self.merges.ids(words) if words else (np.zeros(0, np.int64), np.zeros(0, np.int64))
        data = flat.astype("<u4").tobytes()
        ends = np.r_[0, np.cumsum(counts)][np.cumsum(np.fromiter(map(len, cut), np.int64, len(cut)))] * 4
        begins = [0, *ends.tolist()][: len(ends)]
        found.update((c, data[b:e]) for c, b, e in zip(new, begins, ends.tolist(), strict=True))
        once = {}
        for c, ids in found.items():
            if len(c) > KNOWN_LENGTH:
                once[c] = ids
            else:
                self.of[c] = ids
                self.held += ENTRY_BYTES + 2 * len(c) + len(ids)
        return once

    def ids(self, texts: Iterable[str]) -> Iterator[bytes]:
        """The ids of each text, four bytes each; new chunks of about GATHERED_CHARS characters are merged together."""
        rows: list[list[str]] = []
        chars = 0
        for text in texts:
            if len(text) > BLOCK_CHARS:
                yield from self._settled(rows)
                rows, chars = [], 0
                parts = []
                for block in self.words.blocks(text):
                    parts += self._settled([self.words.chunks(block)])
                yield b"".join(parts)
                continue
            rows.append(self.words.chunks(text))
            chars += len(text)
            if chars >= GATHERED_CHARS:
                yield from self._settled(rows)
                rows, chars = [], 0
        yield from self._settled(rows)

    def _settled(self, rows: list[list[str]]) -> list[bytes]:
        once = self.learn(rows)
        self.of.update(once)
        of = self.of.__getitem__
        out = [b"".join(map(of, chunks)) for chunks in rows]
        for c in once:
            del self.of[c]
        return out
