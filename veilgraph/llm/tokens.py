"""Tokenizing with a public vocabulary file: texts are cut into segments that no token spans, each distinct one is encoded once."""

from __future__ import annotations

import gc
import os
import re
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from veilgraph.llm.common import HELD

#: White space beyond ASCII, as the vocabularies' own patterns take it.
_OTHER = "\x85\xa0     　" + "".join(map(chr, range(0x2000, 0x200B)))
_WS = r"\x09-\x0d " + _OTHER
_SAFE = re.compile(rf"(?<=[^{_WS}]) (?=[^{_WS}])")
#: Characters of a long text that are worked on together; distinct segments that are remembered, at most.
PART_CHARS, KEEP = 1 << 20, 900_000
_MARK = np.zeros(256, dtype=bool)
_MARK[list(b".,;:!?")] = True
_LETTER = np.zeros(256, dtype=bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True
_BYTES = np.array([(1 << (8 * k)) - 1 for k in range(8)] + [(1 << 64) - 1], dtype=np.uint64)
_MIX = np.uint64(0xBF58476D1CE4E5B9)
_FACTORS = np.array([0x9E3779B97F4A7C15, 0xD1342543DE82EF95, 0xF1357AEA2E62A9C5], dtype=np.uint64)
#: Segments of up to 23 bytes are told apart by three numbers of eight bytes, the last with the size; longer ones by their bytes.
_WORDS, _LONG = 3, 23


def vocabulary(name: str) -> str:
    """Where a vocabulary file lies on this machine; looked up on the executor that uses it."""
    import public_tokenizers

    return public_tokenizers.path(name)


def safe_parts(text: str, limit: int = PART_CHARS):
    """Parts of a long text, cut only before a single space between two non-spaces: no token spans such a place."""
    start = 0
    while len(text) - start > limit:
        cut = _SAFE.search(text, start + limit)
        if cut is None:
            break
        yield text[start : cut.start()]
        start = cut.start()
    yield text[start:]


def laid_out(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column: text i is bytes[offsets[i]:offsets[i + 1]]; null as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_binary()), b"")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, dtype=np.int64, count=len(column) + 1, offset=8 * column.offset) if offsets else np.zeros(1, dtype=np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data and data.size else np.zeros(0, dtype=np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def chunks(data: np.ndarray, offsets: np.ndarray):
    """(space, bound, start, stop): which bytes are white space, which start a text, and the stretches without white space."""
    n = len(data)
    space = (data == 32) | (data - np.uint8(9) < 5)
    bound = np.zeros(n + 1, dtype=bool)
    bound[offsets] = True
    solid = ~space
    first, last = solid.copy(), solid
    first[1:] &= space[:-1] | bound[1:n]
    last = solid.copy()
    last[:-1] &= space[1:] | bound[1:n]
    return space, bound, np.flatnonzero(first), np.flatnonzero(last) + 1


def stems(data: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """Where each stretch ends without a last . , ; : ! or ? that follows a letter."""
    before, size = data[stop - 2], stop - start
    wide = (size > 2) & (data[stop - 3] == 0xC3) & (before >= 0x80) & (before != 0x97) & (before != 0xB7)
    return stop - (_MARK[data[stop - 1]] & (size > 1) & (_LETTER[before] | wide))


def lowered(data: np.ndarray) -> np.ndarray:
    """The bytes with the letters A-Z and their accented Latin-1 kin in lower case."""
    out = data + ((data - np.uint8(65) < 26).view(np.uint8) << np.uint8(5))
    lead = np.flatnonzero(data[:-1] == 0xC3) + 1
    after = data[lead]
    out[lead[(after >= 0x80) & (after <= 0x9E) & (after != 0x97)]] += 32
    return out


class Split:
    """The stretches without white space of some texts: data[start:end] each, less a last mark, which ends at stop.

    `data` is in lower case if asked for, and ends in some spare bytes.
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray, lower: bool = False):
        self.offsets, self.size = offsets, len(data)
        self.space, self.bound, self.start, self.stop = chunks(data, offsets) if len(data) else (np.zeros(0, bool), np.ones(1, bool), *np.zeros((2, 0), np.int64))
        self.end = stems(data, self.start, self.stop)
        self.data = np.concatenate((lowered(data) if lower and len(data) else data, np.zeros(8 * _WORDS + 8, dtype=np.uint8)))
        self.cut = np.searchsorted(self.start, offsets)  # a text's stretches
        self.named = None

    def names(self, start: np.ndarray, end: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
        """(numbers that tell stretches apart, their hash): the first 24 bytes, the last of which gives way to the size."""
        eight = np.ndarray(shape=(len(self.data) - 7,), dtype="<u8", buffer=self.data, strides=(1,))
        size = end - start
        key = [eight[start] & _BYTES[np.minimum(size, 8)]]
        for k in range(1, _WORDS):
            word = np.zeros(len(start), dtype=np.uint64)
            some = np.flatnonzero(size > 8 * k)
            word[some] = eight[start[some] + 8 * k] & _BYTES[np.minimum(size[some] - 8 * k, 8)]
            key.append(word)
        key[-1] = key[-1] & _BYTES[7] | size.astype(np.uint64) << np.uint64(56)
        h = key[0] * _FACTORS[0]
        for k in range(1, _WORDS):  # (a plain sum would let the top bytes of two numbers cancel)
            h ^= h >> np.uint64(32)
            h += key[k]
            h *= _FACTORS[k]
        return key, scrambled(h)

    def words(self) -> tuple[list[np.ndarray], np.ndarray]:
        """names() of the stretches themselves, found once."""
        if self.named is None:
            self.named = self.names(self.start, self.end)
        return self.named


def scrambled(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _MIX
    return x ^ (x >> np.uint64(27))


class SegmentEncoder:
    """Exact ids of whole texts, for byte-level BPE vocabularies that never merge across the segments cut here.

    A segment is a stretch without white space, with the one space before it, or white space that belongs to none; a
    last mark after a letter is a token of its own. All segments of a batch are told apart by their bytes in one pass of
    array operations; those not met before go to the library. About `keep` are remembered, as flat arrays: beyond
    that, those that more than one batch has used. Texts with special strings or other white space go to it whole.
    """

    def __init__(self, vocab: str, lengths_only: bool = False, keep: int = KEEP):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self._tok = tok = Tokenizer.from_file(vocab if os.path.isabs(vocab) else vocabulary(vocab))
        tok.no_truncation()
        tok.no_padding()
        self._model = tok.model
        self._specials = [t.content.encode() for t in tok.get_added_tokens_decoder().values()]
        self._lengths, self._keep = lengths_only, keep
        self._drops_space = not tok.encode("\n", add_special_tokens=False).ids
        self._sep, self._not_in = (" 0 ", "0") if self._drops_space else ("\n", "\n")
        # may stand beside a separator: no white space but one leading space, no separator, no start of a special string
        starts = "".join({re.escape(x.decode()[0]) for x in self._specials})
        self._plain = re.compile(rf" ?[^{_WS}\x1c-\x1f{self._not_in}{starts}]{{1,200}}").fullmatch
        self._sep_id = tok.encode(self._sep, add_special_tokens=False).ids[0]
        self._alphabet = _byte_alphabet()
        self._marks = np.zeros(256, dtype=np.uint32)
        for c in ".,;:!?":
            (self._marks[ord(c)],) = tok.encode(c, add_special_tokens=False).ids
        self._codes = np.array([ord(self._alphabet[b]) for b in range(256)], dtype="<u2")
        self._forget()

    def _forget(self) -> None:
        # two tables, each sorted by hash; the second holds what is newer
        kinds = [np.uint64] * (1 + _WORDS) + [np.int32, np.uint16, np.uint8]
        self._tables = [[np.zeros(0, dtype=k) for k in kinds] for _ in range(2)]  # hash, key, first place, number of ids, uses
        self._ids = np.zeros(0, dtype=np.uint32)

    def _library(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, dtype=np.uint32) for e in self._tok.encode_batch_fast(texts, add_special_tokens=False)]

    def _encoded(self, data: np.ndarray, start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids end to end, number of each) of the segments data[start:stop]."""
        size = stop - start
        flat = data[_spread(start, size)]
        done = np.cumsum(size)
        # segments of letters alone, maybe after a space: one pre-token each
        wide = np.zeros(len(flat) + 1, dtype=bool)
        wide[:-1] = flat == 0xC3
        strange = ~_LETTER[flat] & ~wide[:-1]
        after = np.zeros(len(flat), dtype=bool)
        after[1:] = wide[:-2]
        strange[after & (flat != 0x97) & (flat != 0xB7)] = False
        led = flat[done - size] == 32
        count = np.add.reduceat(strange.astype(np.int64), done - size) - led
        letters = (count == 0) & (size > led)
        own = np.flatnonzero(letters)
        parts: list[list[int]] = [[]] * len(size)
        if len(own):  # the library's model alone, over the vocabulary's byte alphabet
            begin = (done - size)[own] + (led[own] if self._drops_space else 0)
            long = done[own] - begin + 1
            text = np.full(int(long.sum()), 10, dtype=np.uint8)
            within = np.ones(len(text), dtype=bool)
            within[np.cumsum(long) - 1] = False
            text[within] = flat[_spread(begin, long - 1)]
            if self._drops_space:
                text = lowered(text)
            names = self._codes[text].tobytes().decode("utf-16-le").split(self._alphabet[10])
            whole, collecting = self._model.tokenize, gc.isenabled()
            gc.disable()  # many short-lived objects, no cycles
            try:
                for k, name in zip(own.tolist(), names[:-1], strict=True):
                    parts[k] = [t.id for t in whole(name)]
            finally:
                if collecting:
                    gc.enable()
        rest = np.flatnonzero(~letters).tolist()
        if rest:
            raw = data.tobytes()
            segments = [raw[start[k] : stop[k]].decode() for k in rest]
            plain = [j for j, x in enumerate(segments) if self._plain(x)]
            for at in range(0, len(plain), 5000):
                some = plain[at : at + 5000]
                ids = np.array(self._tok.encode_batch_fast([self._sep.join([segments[j] for j in some]) + self._sep], add_special_tokens=False)[0].ids, dtype=np.uint32)
                ends = np.flatnonzero(ids == self._sep_id)
                if len(ends) != len(some):
                    raise ValueError("a separator joined with a segment")
                ids = ids.tolist()
                for j, a, b in zip(some, [0, *(ends[:-1] + 1).tolist()], ends.tolist(), strict=True):
                    parts[rest[j]] = ids[a:b]
            odd = sorted(set(range(len(segments))).difference(plain))
            for j, e in zip(odd, self._tok.encode_batch_fast([segments[j] for j in odd], add_special_tokens=False), strict=True):
                parts[rest[j]] = e.ids
        sizes = np.fromiter(map(len, parts), dtype=np.int64, count=len(parts))
        return np.fromiter(chain.from_iterable(parts), dtype=np.uint32, count=int(sizes.sum())), sizes

    def _white(self, x: Split) -> tuple[np.ndarray, np.ndarray]:
        """(start, stop) of the white space that leads no stretch, in order: the last character of a run stands alone
        before a stretch, or leads it if it is a space."""
        n, space, bound = x.size, x.space, x.bound
        first, last = space.copy(), space.copy()
        first[1:] &= ~space[:-1] | bound[1:n]
        last[:-1] &= ~space[1:] | bound[1:n]
        first &= last & (x.data[:n] == 32)  # a space of its own before a stretch: the plain case
        first[: n - 1] &= ~bound[1:n]
        if n:
            first[n - 1] = False
        a = np.flatnonzero(space & ~first)
        if not len(a):
            return a, a
        # runs of what is left
        new = np.concatenate(([True], (np.diff(a) > 1) | bound[a[1:]]))
        a, b = a[new], np.concatenate((a[np.flatnonzero(new)[1:] - 1], a[-1:])) + 1
        before = ~bound[b]  # a stretch of the same text follows
        body = b - before
        some, alone = body > a, before & (x.data[b - 1] != 32)
        begin, end = np.concatenate((a[some], b[alone] - 1)), np.concatenate((body[some], b[alone]))
        order = np.argsort(begin, kind="stable")
        return begin[order], end[order]

    def _values(self, x: Split, start: np.ndarray, stop: np.ndarray, named=None) -> tuple[np.ndarray, np.ndarray]:
        """(first place in the list of ids, number of ids) of each segment."""
        if not len(start):
            return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        data, (key, h) = x.data, named or x.names(start, stop)
        long = np.flatnonzero(stop - start > _LONG)
        raw = data.tobytes() if len(long) else b""
        if len(long):
            h = h.copy()
        for k, a, b in zip(long.tolist(), start[long].tolist(), stop[long].tolist(), strict=True):
            h[k] ^= np.uint64(hash(raw[a:b]) & ((1 << 64) - 1))
        coded = pa.array(h).dictionary_encode()
        code, distinct = np.asarray(coded.indices).astype(np.intp), np.asarray(coded.dictionary)
        one = np.empty(len(distinct), dtype=np.int64)
        one[code[::-1]] = np.arange(len(code))[::-1]  # the first segment of each
        if not all((w == w[one][code]).all() for w in key) or any(raw[start[k] : stop[k]] != raw[start[one[code[k]]] : stop[one[code[k]]]] for k in long):
            raise _Collision
        # what is remembered is compared by its bytes too; long segments are never remembered
        begin, many, new = np.zeros(len(distinct), np.int64), np.zeros(len(distinct), np.int64), np.ones(len(distinct), dtype=bool)
        for held, *keys, first, size, used in self._tables:
            at = np.searchsorted(held, distinct)
            at[at == len(held)] = 0
            here = np.flatnonzero(held[at] == distinct) if len(held) else np.zeros(0, np.int64)
            at = at[here]
            for mine, other in zip(keys, key, strict=True):
                if (mine[at] != other[one[here]]).any():
                    raise _Collision
            used[at] = np.minimum(used[at], 254) + 1
            begin[here], many[here], new[here] = first[at], size[at], False
        if new.any():
            new = np.flatnonzero(new)
            ids, sizes = self._encoded(data, start[one[new]], stop[one[new]])
            begin[new], many[new] = len(self._ids) + np.cumsum(sizes) - sizes, sizes
            self._ids = np.concatenate((self._ids, ids))
            new = new[(stop - start)[one[new]] <= _LONG]
            self._insert(1, [distinct[new], *(w[one[new]] for w in key), begin[new], many[new], np.ones(len(new))])
        return begin[code], many[code]

    def _insert(self, side: int, rows: list[np.ndarray]) -> None:
        """Puts rows in their places, one column at a time: no second table stands beside the first."""
        order = np.argsort(rows[0], kind="stable")
        table, place = self._tables[side], np.searchsorted(self._tables[side][0], rows[0][order])
        for k, column in enumerate(rows):
            table[k] = np.insert(table[k], place, column[order].astype(table[k].dtype))

    def _settle(self) -> None:
        """Joins what is newer to the rest when there is enough of it; drops what is too much."""
        if len(self._tables[1][0]) < self._keep // 8:
            return
        self._insert(0, self._tables[1])
        self._tables[1] = [c[:0].copy() for c in self._tables[1]]
        table = self._tables[0]
        used = table[-1]
        if len(used) <= self._keep:
            return
        rows = np.flatnonzero(used > 1)
        if len(rows) > self._keep // 2:
            rows = np.sort(rows[np.argsort(used[rows], kind="stable")[::-1][: self._keep // 2]])
        for k, column in enumerate(table):
            table[k] = column[rows]
        first, size = table[-3].astype(np.int64), table[-2].astype(np.int64)
        self._ids = self._ids[_spread(first, size)]  # those of what has gone, and of long segments, go
        table[-3], table[-1] = (np.cumsum(size) - size).astype(np.int32), np.minimum(table[-1], 2)

    def _fast(self, data: np.ndarray, offsets: np.ndarray, split: Split | None) -> tuple[np.ndarray, np.ndarray]:
        """(ids end to end, or none for lengths only; number of ids of each text)."""
        # in lower case where that is the vocabulary's own first step; beside a combining mark case may matter to it
        low = self._drops_space and not (data & 0xFE == 0xCC).any()
        x = split if split is not None and low else Split(data, offsets, low)
        if self._drops_space:
            begin, size = self._values(x, x.start, x.end, x.words())
        else:
            led = (x.start > 0) & ~x.bound[x.start]
            led &= x.data[np.maximum(x.start - 1, 0)] == 32
            begin, size = self._values(x, x.start - led, x.end)
        marked = x.end < x.stop
        each = size + marked  # of a stretch and its mark
        sizes = np.diff(np.concatenate(([0], np.cumsum(each)))[x.cut])
        white = np.zeros(0, dtype=np.int64)
        if not self._drops_space:
            white, white_end = self._white(x)
            white_begin, white_size = self._values(x, white, white_end)
            sizes += np.bincount(np.searchsorted(offsets, white, side="right") - 1, weights=white_size, minlength=len(sizes)).astype(np.int64)
        if self._lengths:
            self._settle()
            return np.zeros(0, dtype=np.uint32), sizes
        out = np.empty(int(sizes.sum()), dtype=np.uint32)
        place = np.cumsum(each) - each
        if len(white):  # white space goes before the stretch that follows it
            after = np.searchsorted(x.start, white)
            done = np.concatenate(([0], np.cumsum(np.bincount(after, weights=white_size, minlength=len(each) + 1).astype(np.int64))))
            at = np.concatenate((place, [int(each.sum())]))[after] + np.cumsum(white_size) - white_size
            out[_spread(at, white_size)] = self._ids[_spread(white_begin, white_size)]
            place = place + done[1:-1]
        out[_spread(place, size)] = self._ids[_spread(begin, size)]
        some = np.flatnonzero(marked)
        out[place[some] + size[some]] = self._marks[x.data[x.stop[some] - 1]]
        self._settle()
        return out, sizes

    def _odd(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Texts that may hold a special string, or that hold white space beyond ASCII."""
        room = np.concatenate((data, np.zeros(2, dtype=np.uint8)))
        at = []
        for s in self._specials:
            some = np.flatnonzero(data == s[0])
            at.append(some[room[some + 1] == s[1]] if len(s) > 1 else some)
        for lead in (0xC2, 0xE1, 0xE2, 0xE3):
            some = np.flatnonzero(data == lead)
            one, two = room[some + 1], room[some + 2]
            if lead == 0xC2:
                hit = (one == 0x85) | (one == 0xA0)
            elif lead == 0xE2:
                hit = (one == 0x80) & ((two <= 0x8A) | (two == 0xA8) | (two == 0xA9) | (two == 0xAF)) | (one == 0x81) & (two == 0x9F)
            else:
                hit = (one == 0x9A) & (two == 0x80) if lead == 0xE1 else (one == 0x80) & (two == 0x80)
            at.append(some[hit])
        return np.unique(np.searchsorted(offsets, np.concatenate(at), side="right") - 1)

    def encode(self, column: pa.Array, split: Split | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts end to end, number of ids of each text); null as empty. With lengths only, the ids are empty.

        `split` may be the column's Split in lower case, if it has been made already."""
        data, offsets = laid_out(column)
        owner = None
        if len(data) and int(np.diff(offsets).max()) > 4 * PART_CHARS:  # long texts go in parts
            texts = [data[a:b].tobytes().decode() for a, b in zip(offsets, offsets[1:], strict=False)]
            parts = [list(safe_parts(x)) for x in texts]
            owner = np.repeat(np.arange(len(parts)), [len(p) for p in parts])
            pieces = [self.encode(pa.array([x], pa.large_string())) for p in parts for x in p] if len(owner) > len(parts) else None
            if pieces:
                sizes = np.bincount(owner, weights=[s[0] for _, s in pieces], minlength=len(parts)).astype(np.int64)
                return np.concatenate([i for i, _ in pieces]), sizes
        odd = self._odd(data, offsets)
        if not len(odd):
            try:
                return self._fast(data, offsets, split)
            except _Collision:
                self._forget()
                odd = np.arange(len(offsets) - 1)
        texts = [data[offsets[k] : offsets[k + 1]].tobytes().decode() for k in odd]
        parts = [list(safe_parts(x)) for x in texts]
        each = iter(self._library([x for p in parts for x in p]))
        slow = {int(k): np.concatenate([next(each) for _ in p]) for k, p in zip(odd, parts, strict=True)}
        rest = np.setdiff1d(np.arange(len(offsets) - 1), odd)
        ids, sizes = self.encode(pa.array([data[offsets[k] : offsets[k + 1]].tobytes() for k in rest], pa.large_binary())) if len(rest) else (np.zeros(0, np.uint32), np.zeros(0, np.int64))
        all_sizes = np.zeros(len(offsets) - 1, dtype=np.int64)
        all_sizes[rest] = sizes
        for k, x in slow.items():
            all_sizes[k] = len(x)
        if self._lengths:
            return ids, all_sizes
        cut = np.split(ids, np.cumsum(sizes)[:-1]) if len(rest) else []
        found = dict(zip(rest.tolist(), cut, strict=True)) | slow
        return np.concatenate([found[k] for k in range(len(all_sizes))]), all_sizes


class _Collision(Exception):
    """Two different segments have one hash."""


def _spread(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """start[0], start[0] + 1, ... size[0] times, then the same for the next."""
    return np.repeat(start - np.cumsum(size) + size, size) + np.arange(int(size.sum()))


def _byte_alphabet() -> dict[int, str]:
    """The character by which byte-level vocabularies write each byte: itself if it is printable, else the next from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = (b for b in range(256) if b not in set(shown))
    return {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(other)}


def encoder_for(vocab: str, lengths_only: bool = False) -> SegmentEncoder:
    """This Python worker's encoder: what it remembers serves all tasks that the worker runs."""
    if (vocab, lengths_only) not in HELD:
        HELD.clear()
        HELD[vocab, lengths_only] = SegmentEncoder(vocab, lengths_only)
    return HELD[vocab, lengths_only]
