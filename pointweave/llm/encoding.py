"""Exact tokenisation of whole texts by memoised segments, a batch of texts at a time.

A text is cut at *safe boundaries*: a single space whose two neighbours are
ASCII printable characters or letters/digits.  Neither tokenizer family used
here lets a pre-token span such a space, so the concatenation of the segments'
ids equals the ids of the whole text, however long it is.  Words are split and
made distinct by Arrow; only segments not seen before reach the library, and
all others are placed by array operations.  Memory is bounded by
``max_segments`` and by slices of SLICE_BYTES, into which longer texts are cut
at safe boundaries too.  Tokenizers of any other build are applied to whole texts.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

LETTERS = "A-Za-zÀ-ÖØ-öø-ÿ"
#: Stands between segments that are cut into pre-tokens together; no simple segment holds it.
MARK = "\x01"
#: The published pre-token patterns of the two tokenizers, with the letter and digit
#: classes spelled out for the characters that a simple segment may hold, and MARK ending a segment.
BYTE_PATTERN = re.compile(rf"{MARK}|'s|'t|'re|'ve|'m|'ll|'d| ?[{LETTERS}]+| ?[0-9]+| ?[^\s{LETTERS}0-9{MARK}]+|\s+(?![^\s{MARK}])|\s+")
WORD_PATTERN = re.compile(rf"{MARK}|'s|'t|'re|'ve|'m|'ll|'d|[{LETTERS}]+|[0-9]|[^\s{LETTERS}0-9{MARK}]+")
SAFE_CUT = re.compile(r"(?<=[!-~]) (?=[!-~])")
LONGEST_KEPT = 64
#: Segments that a worker remembers, and twice as many pre-tokens, which cost more to encode: some 100 MB in all.
MAX_SEGMENTS = 200_000
BATCH_BYTES = 1 << 18
SLICE_BYTES = 1 << 22


def byte_alphabet() -> dict[int, str]:
    """Byte-level BPE's printable stand-ins: visible Latin-1 bytes stand for themselves, the rest follow from U+0100."""
    visible = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = [b for b in range(256) if b not in visible]
    return {b: chr(b) for b in visible} | {b: chr(256 + i) for i, b in enumerate(hidden)}


def _safe(c: str) -> bool:
    return "!" <= c <= "~" or c.isalnum()


def _safe_ends(words: pa.StringArray, at: int) -> np.ndarray:
    """Whether the first (0) or last (-1) character of each word allows a cut beside it; of an empty word none does."""
    coded = pc.utf8_slice_codeunits(words, at, at + 1 or None).dictionary_encode()
    safe = np.array([c != "" and _safe(c) for c in coded.dictionary.to_pylist()], bool)
    return safe[coded.indices.to_numpy()]


def literal(name: str) -> str:
    """The segment that a memo's name stands for: a word follows a space, and what begins with a space is without it."""
    return name[1:] if name[0] == " " else f" {name}"


def balanced(texts: Iterable[str], most: int = BATCH_BYTES) -> Iterator[list[str]]:
    """Consecutive batches of at most ``most`` UTF-8 bytes; a longer text makes a batch of its own."""
    batch, size = [], 0
    for text in texts:
        n = len(text) if text.isascii() else len(text.encode())
        if batch and size + n > most:
            yield batch
            batch, size = [], 0
        batch.append(text)
        size += n + 16
    if batch:
        yield batch


def cut_long(text: str, most: int = SLICE_BYTES) -> list[str]:
    """Parts of about ``most`` characters whose ids, in turn, are those of the text; fewer where safe boundaries are rare."""
    parts, at = [], 0
    while len(text) - at > most:
        found = SAFE_CUT.search(text, at + most)
        if not found:
            break
        parts.append(text[at : found.start()])
        at = found.start()
    return [*parts, text[at:]]


def gather(flat: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The spans of ``flat``, end to end."""
    before = np.cumsum(lengths) - lengths
    return flat[np.repeat(starts - before, lengths) + np.arange(int(lengths.sum()))]


def slices(texts: list[str | None], most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about ``most`` characters."""
    begin, size = 0, 0
    for i, text in enumerate(texts):
        n = len(text or "")
        if size and size + n > most:
            yield begin, i
            begin, size = i, 0
        size += n + 64
    if begin < len(texts):
        yield begin, len(texts)


def text_slices(column: pa.Array, most: int = SLICE_BYTES) -> Iterator[tuple[int, int, list[str | None]]]:
    """(first, last, texts) of rows of about ``most`` bytes, so that a batch is never held as Python strings at once."""
    sizes = pc.binary_length(column).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64) + 64
    ends = np.cumsum(sizes)
    first = 0
    while first < len(ends):
        last = max(first + 1, int(np.searchsorted(ends, (ends[first - 1] if first else 0) + most, "right")))
        yield first, last, column.slice(first, last - first).to_pylist()
        first = last


class Memo:
    """Strings with a span of ids each, in arrays that grow; short strings are found again until ``most`` are held."""

    def __init__(self, most: int):
        self.most, self.codes = most, {}
        self.n, self.end = 0, 0
        self.starts, self.lengths, self.uses = np.zeros(1024, np.int64), np.zeros(1024, np.int32), np.zeros(1024, np.uint16)
        self.flat = np.zeros(4096, np.uint32)

    def shrink(self) -> None:
        """Called between batches: if too much is held, keep what was met more than once, or nothing if that is too much."""
        if self.n <= self.most and self.end <= 16 * self.most:
            return
        names, at = list(self.codes), np.fromiter(self.codes.values(), np.int64, len(self.codes))
        keep = np.flatnonzero(self.uses[at] > 1)
        keep = keep if 2 * len(keep) <= self.most else keep[:0]
        at = at[keep]
        lengths = self.lengths[at]
        flat = gather(self.flat, self.starts[at], lengths) if self.end else self.flat[:0]
        self.__init__(self.most)
        self.add([names[i] for i in keep], lengths, flat)

    def add(self, names: list[str], lengths: np.ndarray, flat: np.ndarray) -> np.ndarray:
        n, end = self.n + len(names), self.end + len(flat)
        for field, size in (("starts", n), ("lengths", n), ("uses", n), ("flat", end)):
            held = getattr(self, field)
            if size > len(held):
                setattr(self, field, np.concatenate([held, np.zeros(max(size - len(held), len(held)), held.dtype)]))
        new = np.arange(self.n, n)
        self.flat[self.end : end] = flat
        self.lengths[new], self.uses[new] = lengths, 0
        self.starts[new] = self.end + np.cumsum(lengths) - lengths
        self.codes.update(zip(names, range(self.n, n)))
        for name in [x for x in names if len(x) > LONGEST_KEPT]:
            del self.codes[name]
        self.n, self.end = n, end
        return new

    def find(self, names: list[str], make: Callable[[list[str]], tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        """Places of ``names``; ``make`` gives lengths and ids of the distinct unknown ones."""
        codes = np.fromiter(map(self.codes.get, names, repeat(-1)), np.int64, len(names))
        missing = np.flatnonzero(codes < 0)
        if len(missing):
            wanted = [names[i] for i in missing.tolist()]
            new = list(dict.fromkeys(wanted))
            place = self.add(new, *make(new))
            codes[missing] = place if len(new) == len(wanted) else np.fromiter(map(dict(zip(new, place.tolist())).__getitem__, wanted), np.int64, len(wanted))
        self.uses[codes] += 1
        return codes


class SegmentEncoder:
    def __init__(self, path: str, max_segments: int = MAX_SEGMENTS):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.kind = self._kind(spec)
        self.alphabet, self.model = byte_alphabet(), self.tokenizer.model
        self.blank, self.newline = (self.alphabet[ord(c)] for c in " \n")
        special = [re.escape(t["content"][:2]) for t in spec.get("added_tokens", ())]
        #: What sends a segment through the library's whole pipeline instead of its model alone.
        self.odd = re.compile("|".join([rf"[^\n -~{LETTERS}]", *special]))
        self.known, self.counted, self.pretokens = Memo(max_segments), Memo(2 * max_segments), Memo(2 * max_segments)
        self.largest = max(self.tokenizer.get_vocab(with_added_tokens=True).values(), default=0)

    @staticmethod
    def _kind(spec: dict) -> str:
        before, normal = spec.get("pre_tokenizer") or {}, spec.get("normalizer")
        if spec["model"].get("type") != "BPE" or spec["model"].get("dropout"):
            return "other"
        if any(re.search(r"\s", t["content"]) or t.get("lstrip") or t.get("rstrip") or t.get("single_word") for t in spec.get("added_tokens", ())):
            return "other"  # such a token may take up a space, or look beyond one
        if before.get("type") == "ByteLevel" and before.get("use_regex") and not before.get("add_prefix_space") and not normal:
            return "byte"
        parts = [x["type"] for x in before.get("pretokenizers", ())]
        rules = [x["type"] for x in (normal or {}).get("normalizers", ())]
        return "word" if parts == ["Split", "ByteLevel"] and rules == ["NFC", "Replace", "Lowercase"] else "other"

    def _library(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Lengths and ids by the library's batch call, in batches balanced by bytes."""
        ids = [e.ids for batch in balanced(texts) for e in self.tokenizer.encode_batch_fast(batch, add_special_tokens=False)]
        return np.fromiter(map(len, ids), np.int64, len(ids)), np.array([i for x in ids for i in x], np.uint32)

    def _lengths_of(self, names: list[str]) -> tuple[np.ndarray, np.ndarray]:
        return self._lengths(list(map(literal, names)))

    def _lengths(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Lengths alone by the library's batch call, in batches balanced by bytes."""
        lengths = [len(e) for batch in balanced(texts) for e in self.tokenizer.encode_batch_fast(batch, add_special_tokens=False)]
        return np.array(lengths, np.int64), np.zeros(0, np.uint32)

    def _pretokens(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        lengths, flat, tokenize = [], [], self.model.tokenize
        for piece in pieces:
            if piece == MARK:
                lengths.append(0)
                continue
            tokens = tokenize(piece.replace(" ", self.blank).replace("\n", self.newline) if piece.isascii() else piece.encode().decode("latin-1").translate(self.alphabet))
            lengths.append(len(tokens))
            flat += [t.id for t in tokens]
        return np.array(lengths, np.int64), np.array(flat, np.uint32)

    def _segments(self, names: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Lengths and ids of new segments: by the library's BPE model where the pre-tokens are certain, else by its whole pipeline."""
        segments, odd = list(map(literal, names)), np.zeros(len(names), bool)
        if self.odd.search(MARK[:0].join(segments)):
            odd = np.fromiter((self.odd.search(s) is not None for s in segments), bool, len(segments))
        lengths, starts = np.zeros(len(segments), np.int64), np.zeros(len(segments), np.int64)
        plain = [segments[i] for i in np.flatnonzero(~odd)]
        flat = np.zeros(0, np.uint32)
        if plain:
            text = MARK.join(plain)
            pieces = BYTE_PATTERN.findall(text) if self.kind == "byte" else WORD_PATTERN.findall(text.lower())
            codes = self.pretokens.find([*pieces, MARK], self._pretokens)
            held = self.pretokens.lengths[codes]
            flat = gather(self.pretokens.flat, self.pretokens.starts[codes], held)
            ends = np.cumsum(held)[codes == codes[-1]]
            lengths[~odd] = np.diff(ends, prepend=0)
            starts[~odd] = ends - lengths[~odd]
        if odd.any():
            n, more = self._library([segments[i] for i in np.flatnonzero(odd)])
            lengths[odd], starts[odd] = n, len(flat) + np.cumsum(n) - n
            flat = np.concatenate([flat, more])
        return lengths, gather(flat, starts, lengths)

    def _placed(self, texts: list[str], memo: Memo, make) -> tuple[np.ndarray, np.ndarray]:
        """(places of all segments in ``memo``, the number of the first segment of each text and of the end)."""
        memo.shrink()
        self.pretokens.shrink()
        split = pc.split_pattern(pa.array(texts, pa.string()), " ")
        first = split.offsets.to_numpy().astype(np.int64)
        coded = split.flatten().dictionary_encode()
        words, codes = coded.dictionary.to_numpy(zero_copy_only=False), coded.indices.to_numpy()
        opens, ends = (_safe_ends(coded.dictionary, at) for at in (0, -1))
        begins = np.ones(len(codes), bool)
        begins[1:] = opens[codes[1:]] & ends[codes[:-1]]
        begins[first[:-1]] = True
        at = np.flatnonzero(begins)
        sizes = np.diff(at, append=len(codes))
        leading = np.zeros(len(codes), bool)
        leading[first[:-1]] = True
        single = (sizes == 1) & ~leading[at]
        places = np.zeros(len(at), np.int64)
        wanted = np.zeros(len(words), bool)
        wanted[codes[at[single]]] = True
        used = np.flatnonzero(wanted)
        table = np.zeros(len(words), np.int64)
        table[used] = memo.find(words[used].tolist(), make)
        places[single] = table[codes[at[single]]]
        rest = np.flatnonzero(~single)
        joined = [(" " if leading[a] else "  ") + " ".join(words[codes[a : a + n]]) for a, n in zip(at[rest].tolist(), sizes[rest].tolist())]
        places[rest] = memo.find(joined, make)
        return places, np.append(np.cumsum(begins)[first[:-1]] - 1, len(at))

    def encode_batch(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(offsets, ids): the ids of all texts end to end, text i's from offsets[i] to offsets[i + 1]; null has none."""
        counts, parts = [], []
        for lengths, ids in self._batches(texts, self.known, self._segments, self._library):
            counts.append(lengths)
            parts.append(ids)
        return np.concatenate([[0], np.cumsum(np.concatenate([[0][:0], *counts]))]).astype(np.int64), np.concatenate([np.zeros(0, np.uint32), *parts])

    def count_batch(self, texts: list[str | None]) -> np.ndarray:
        """Token counts only; distinct new segments go to the library in batches balanced by bytes."""
        return np.concatenate([np.zeros(0, np.int64), *(lengths for lengths, _ in self._batches(texts, self.counted, self._lengths_of, self._lengths))])

    def _batches(self, texts: list[str | None], memo: Memo, make, whole) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        full = [x or "" for x in texts]
        for a, b in slices(full):
            if self.kind == "other":
                yield whole(full[a:b])
                continue
            if b - a > 1 or len(full[a]) <= SLICE_BYTES:
                yield self._slice(full[a:b], memo, make)
                continue
            parts = [self._slice([x], memo, make) for x in cut_long(full[a])]
            yield sum(n for n, _ in parts), np.concatenate([ids for _, ids in parts])

    def _slice(self, texts: list[str], memo: Memo, make) -> tuple[np.ndarray, np.ndarray]:
        places, first = self._placed(texts, memo, make)
        held = memo.lengths[places]
        ends = np.append(0, np.cumsum(held))[first]
        return np.diff(ends), gather(memo.flat, memo.starts[places], held) if memo is self.known else memo.flat[:0]

    def encode(self, text: str | None) -> np.ndarray:
        """The ids of one text; of null none."""
        return self.encode_batch([text])[1]


@lru_cache(maxsize=4)
def encoder(path: str) -> SegmentEncoder:
    """One encoder a worker and tokenizer, kept for the worker's later tasks."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # an executor's cores already run a worker each
    return SegmentEncoder(path)
