"""SentencePiece (BPE) encoding with seeded merge-dropout, and lossless decoding.

A text is cut at blanks into units that no merge crosses. Within a unit the best merge goes first, the leftmost of equals;
a candidate merge is skipped for good if its keyed hash falls below the dropout rate. The hash covers seed, document, the
unit's place in it and the places of the two symbols, so every occurrence of a word has a draw of its own, the result
depends on nothing else, and a lost task gives the same ids when it runs again. With rate 0 the ids are the library's own.

What is remembered is the segmentation of a word that has come twice, without skips and with given skips, each with the
candidate merges it came by. An occurrence that skips none of these takes it; one that does, and any word that comes for
the first time, is segmented by itself. Words are segmented many at a time as rows of a matrix, and ids stay in arrays.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stowage.llm.batches import column, slices

RATE = 0.1
SPACE = "▁"
#: Bytes of what is remembered, about; it is emptied beyond.
CACHE_BYTES = 64_000_000
LONGEST_ROW = 48
CELLS = 1 << 18
#: Candidate merges of a word whose skips fit into one number beside the word's own.
MASKED, NODE_BITS = 40, 23
NONE = np.int32(2**31 - 1)
UNKNOWN = (1 << 20) - 1


def mixed(x: np.ndarray) -> np.ndarray:
    """Spread every bit of 64-bit numbers over all their bits."""
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


class Model:
    """Pieces, merges and bytes of a BPE model file with byte fallback."""

    def __init__(self, path: str) -> None:
        from sentencepiece import SentencePieceProcessor

        source = SentencePieceProcessor(model_file=path)
        size = source.get_piece_size()
        self.bytes_of: list[bytes] = [b""] * size
        self.byte_id = [0] * 256
        pieces, scores = {}, {}
        for i in range(size):
            piece = source.id_to_piece(i)
            if source.is_byte(i):
                value = int(piece[3:5], 16)
                self.bytes_of[i], self.byte_id[value] = bytes([value]), i
            elif not (source.is_control(i) or source.is_unknown(i)):
                if SPACE in piece.lstrip(SPACE) or "\n" in piece:
                    raise ValueError(f"piece {piece!r} crosses a blank or a line break")
                pieces[piece], scores[piece] = i, source.get_score(i)
                self.bytes_of[i] = piece.replace(SPACE, " ").encode()
        if not all(self.byte_id):
            raise ValueError("the model has no byte fallback")
        ranks = {s: r for r, s in enumerate(sorted(set(scores.values()), reverse=True))}
        symbols = dict(pieces)
        for char in sorted(set("".join(pieces))):
            symbols.setdefault(char, size + len(symbols) - len(pieces))
        self.size = size
        merges = {}
        for piece, i in pieces.items():
            for cut in range(1, len(piece)):
                left, right = symbols.get(piece[:cut]), symbols.get(piece[cut:])
                if left is not None and right is not None:
                    merges[left << 20 | right] = (ranks[scores[piece]], i)
        self.merges = merges
        self.char_ids = np.full(0x110000, UNKNOWN, np.int32)
        for char in set("".join(pieces)):
            self.char_ids[ord(char)] = symbols[char]
        # A blank is the space symbol; a real U+2581 in a text has to be told from it and goes byte by byte.
        self.char_ids[ord(" ")], self.char_ids[ord(SPACE)] = self.char_ids[ord(SPACE)], UNKNOWN
        self._table(merges)

    def _table(self, merges: dict[int, tuple[int, int]]) -> None:
        """An open-addressing table of the merges, looked up for many pairs at once."""
        self.bits = max(4, (4 * len(merges)).bit_length())
        keys = np.full(1 << self.bits, -1, np.int64)
        ranks, ids = np.full(1 << self.bits, NONE, np.int32), np.zeros(1 << self.bits, np.int32)
        for key, slot in zip(merges, self._slots(np.array(list(merges), np.int64)).tolist(), strict=True):
            while keys[slot] != -1:
                slot = (slot + 1) & ((1 << self.bits) - 1)
            keys[slot], (ranks[slot], ids[slot]) = key, merges[key]
        self.keys, self.ranks, self.ids = keys, ranks, ids

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return (mixed(keys.astype(np.uint64)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def lookup(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and new symbol of each pair; the rank is ``NONE`` where there is no merge."""
        keys = left.astype(np.int64) << 20 | right
        slots = self._slots(keys)
        found = self.keys[slots]
        open_ = np.flatnonzero((found != keys) & (found != -1))
        while len(open_):
            slots[open_] = (slots[open_] + 1) & ((1 << self.bits) - 1)
            found = self.keys[slots[open_]]
            open_ = open_[(found != keys[open_]) & (found != -1)]
        hit = self.keys[slots] == keys
        return np.where(hit, self.ranks[slots], NONE), self.ids[slots]


def places(start: np.ndarray, middle: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Numbers that stand for candidate merges within a unit."""
    return (start.astype(np.uint64) << np.uint64(42)) ^ (middle.astype(np.uint64) << np.uint64(21)) ^ end.astype(np.uint64)


class Ranges:
    """Stretches of one growing array, by number."""

    def __init__(self, dtype: type) -> None:
        self.data, self.used = np.zeros(1024, dtype), 0
        self.start, self.count, self.size = np.zeros(256, np.int64), np.zeros(256, np.int64), 0

    def add(self, data: np.ndarray, counts: np.ndarray) -> None:
        self.data = _room(self.data, self.used + len(data))
        self.data[self.used : self.used + len(data)] = data
        self.start, self.count = _room(self.start, self.size + len(counts)), _room(self.count, self.size + len(counts))
        self.start[self.size : self.size + len(counts)] = self.used + np.cumsum(counts) - counts
        self.count[self.size : self.size + len(counts)] = counts
        self.used, self.size = self.used + len(data), self.size + len(counts)

    def of(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Which of ``numbers``, place and value of each element of their stretches."""
        counts = self.count[numbers]
        which = np.repeat(np.arange(len(numbers)), counts)
        place = np.arange(len(which)) - np.repeat(np.cumsum(counts) - counts, counts)
        return which, place, self.data[np.repeat(self.start[numbers], counts) + place]


def _room(data: np.ndarray, size: int) -> np.ndarray:
    return data if size <= len(data) else np.concatenate((data, np.zeros(max(size, 2 * len(data)) - len(data), data.dtype)))


class Known:
    """Segmentations, each with the candidate merges that must not be skipped for it to hold."""

    def __init__(self) -> None:
        self.units: dict[str, int] = {}
        self.once: set[str] = set()
        self.held = 0
        self.ids, self.candidates = Ranges(np.int32), Ranges(np.uint64)
        # Words with the skips they were segmented with, in ascending order, and the numbers of the segmentations.
        self.skips, self.skipped = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def full(self) -> bool:
        held = self.held + 16 * (self.ids.size + self.candidates.size) + 4 * self.ids.used + 8 * self.candidates.used + 16 * len(self.skips)
        return held > CACHE_BYTES or self.ids.size >= 1 << NODE_BITS

    def add(self, ids: np.ndarray, counts: np.ndarray, of_unit: np.ndarray, candidates: np.ndarray) -> None:
        """``of_unit`` says to which segmentation each candidate belongs, in ascending order."""
        self.ids.add(ids, counts)
        self.candidates.add(candidates, np.bincount(of_unit, minlength=len(counts)))

    def remember(self, words: list[str], first: int) -> None:
        self.units.update(zip(words, range(first, first + len(words)), strict=True))
        self.once.difference_update(words)
        self.held += sum(map(len, words)) + 150 * len(words)

    def with_skips(self, keys: np.ndarray) -> np.ndarray:
        """The segmentation for each word and mask, or -1."""
        if not len(self.skips):
            return np.full(len(keys), -1)
        at = np.minimum(np.searchsorted(self.skips, keys), len(self.skips) - 1)
        return np.where(self.skips[at] == keys, self.skipped[at], -1)


class Encoder:
    """Encodes texts for one seed and rate, and remembers segmentations of units."""

    def __init__(self, model: Model, rate: float = RATE, seed: int = 0) -> None:
        if not 0 <= rate <= 1:
            raise ValueError("rate must lie in [0, 1]")
        self.model, self.rate, self.seed = model, rate, seed
        self.limit = np.uint64(min(int(rate * 2**64), 2**64 - 1))
        self.known = Known()

    UNUSUAL = ("  ", " \n", "\0")
    UNIT = re.compile(r"\n| *[^ \n]+| +")

    def units(self, text: str) -> list[str]:
        """``text`` behind a blank, cut before each run of blanks and around line breaks.

        In the usual case the one blank before a unit is left out, and a unit that starts with a line break has none.
        """
        if text[:1] in ("", " ") or any(x in text for x in self.UNUSUAL):
            return ["\0" + u for u in self.UNIT.findall(" " + text)] if text else []
        return text.replace("\n", " \n").split(" ")

    @staticmethod
    def spelled(unit: str) -> str:
        return unit[1:] if unit[:1] == "\0" else unit if unit[:1] == "\n" else " " + unit

    def encode(self, keys: list[int], texts: list[str]) -> list[np.ndarray]:
        """Ids of each text; ``keys`` are 64-bit numbers that stand for the documents."""
        if self.known.full():
            self.known = Known()
        known = self.known
        cut = [self.units(t) for t in texts]
        flat = [u for units in cut for u in units]
        nodes = np.array([known.units.get(u, -1) for u in flat], np.int64)
        new = np.flatnonzero(nodes < 0).tolist()
        numbers: dict[str, int] = {}
        number = np.array([numbers.setdefault(flat[i], len(numbers)) for i in new], np.int64)
        words = list(numbers)
        often = np.bincount(number, minlength=len(words)) > (1 if self.rate else 0)
        often |= np.fromiter((w in known.once for w in words), bool, len(words))
        often &= np.fromiter((len(w) < LONGEST_ROW for w in words), bool, len(words)) | (self.rate == 0)
        first = known.ids.size
        chosen = [w for w, o in zip(words, often.tolist(), strict=True) if o]
        if chosen:
            known.add(*self.traced([self.spelled(w) for w in chosen]))
            known.remember(chosen, first)
        place = np.where(often, first + np.cumsum(often) - 1, -1)
        nodes[new] = place[number]
        once = [w for w, o in zip(words, often.tolist(), strict=True) if not o and len(w) < LONGEST_ROW]
        known.once.update(once)
        known.held += sum(map(len, once)) + 110 * len(once)
        data, start, count = self._dropped(flat, nodes, self._draws(keys, cut) if self.rate else None, first)
        which = np.repeat(start - (np.cumsum(count) - count), count)
        ids = data[which + np.arange(len(which))]
        ends = np.cumsum([0, *map(len, cut)])
        edges = np.concatenate(([0], np.cumsum(count)))[ends].tolist()
        return [ids[a:b] for a, b in zip(edges[:-1], edges[1:], strict=True)]

    def _draws(self, keys: list[int], cut: list[list[str]]) -> np.ndarray:
        """The draw of each occurrence of a unit."""
        counts = np.fromiter(map(len, cut), np.int64, len(cut))
        starts = np.cumsum(counts) - counts
        with np.errstate(over="ignore"):
            of_text = mixed(np.array([k % 2**64 for k in keys], np.uint64) ^ mixed(np.array([(self.seed + 1) * 0x9E3779B97F4A7C15 % 2**64], np.uint64)))
            return mixed(np.repeat(of_text, counts) + (np.arange(counts.sum()) - np.repeat(starts, counts)).astype(np.uint64))

    def _dropped(self, flat: list[str], nodes: np.ndarray, draws: np.ndarray | None, before: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids, and where in them each unit's begin and how many they are; ``nodes`` are the units' segmentations without
        skips, -1 for units not remembered, new ones from ``before`` on."""
        known, alone = self.known, nodes < 0
        if draws is not None:
            told = np.flatnonzero(~alone)
            occurrence, place = self._hits(nodes[told], draws[told])
            some, first = np.unique(occurrence, return_index=True)
            masks = np.bitwise_or.reduceat(np.int64(1) << np.minimum(place, MASKED - 1), first) if len(some) else np.zeros(0, np.int64)
            some = told[some]
            # A unit with more candidates than the mask has bits is segmented by itself.
            wide = known.candidates.count[nodes[some]] >= MASKED
            alone[some[wide]] = True
            some, masks = some[~wide], masks[~wide]
            keys = nodes[some] << MASKED | masks
            missing, index, n = np.unique(keys, return_index=True, return_counts=True)
            # Several skips, or those of a word that is new here, are not likely to come again.
            worth = (known.with_skips(missing) < 0) & ((n > 1) | ((nodes[some[index]] < before) & (masks[index] & (masks[index] - 1) == 0)))
            if worth.any():
                self._with_skips(missing[worth], [flat[i] for i in some[index[worth]].tolist()])
            node = known.with_skips(keys)
            alone[some[node < 0]] = True
            some, node = some[node >= 0], node[node >= 0]
            nodes[some] = node
            more, _ = self._hits(node, draws[some])
            alone[some[more]] = True
        rest = np.flatnonzero(alone)
        more_ids, more_counts = self._segmented([self.spelled(flat[i]) for i in rest.tolist()], None if draws is None else draws[rest])
        start, count = known.ids.start[nodes], known.ids.count[nodes]
        start[rest], count[rest] = known.ids.used + np.cumsum(more_counts) - more_counts, more_counts
        return np.concatenate((known.ids.data[: known.ids.used], more_ids)), start, count

    def _hits(self, nodes: np.ndarray, draws: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Occurrence and place of each candidate of ``nodes`` that its draw skips, in order of occurrence."""
        occurrence, place, candidates = self.known.candidates.of(nodes)
        hit = np.flatnonzero(self._skipped(draws[occurrence], candidates))
        return occurrence[hit], place[hit]

    def _with_skips(self, keys: np.ndarray, words: list[str]) -> None:
        """Remember the segmentations of words that skip the candidates in a mask and no others."""
        known = self.known
        which, place, candidates = known.candidates.of(keys >> MASKED)
        skipped = keys[which] >> place & 1 == 1
        ids, counts, of_unit, seen = self.traced([self.spelled(w) for w in words], (which[skipped], candidates[skipped]))
        new = ~np.isin(self._in_row(of_unit, seen), self._in_row(which, candidates))
        numbers = known.ids.size + np.arange(len(keys))
        known.add(ids, counts, of_unit[new], seen[new])
        at = np.searchsorted(known.skips, keys)
        known.skips, known.skipped = np.insert(known.skips, at, keys), np.insert(known.skipped, at, numbers)

    # -- segmentation ------------------------------------------------------------------------------

    def segment(self, units: list[str], draws: int | np.ndarray) -> list[bytes]:
        """The ids of each unit as 32-bit numbers, under one draw or a draw for each."""
        ids, counts = self._segmented(units, np.broadcast_to(np.asarray(draws, np.uint64), len(units)))
        ends = np.cumsum(counts).tolist()
        return [ids[end - n : end].tobytes() for end, n in zip(ends, counts.tolist(), strict=True)]

    def _segmented(self, units: list[str], draws: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all units one after another, and how many each has; without draws nothing is skipped."""
        parts = []
        for chosen, width in self._runs(units):
            own = None if draws is None else draws[chosen]
            if not width:
                found = [np.frombuffer(self._agenda(units[i], None if draws is None else int(draws[i])), np.int32) for i in chosen.tolist()]
                parts.append((chosen, np.concatenate(found), np.array(list(map(len, found)), np.int64)))
                continue
            skips = (lambda rows, at: np.zeros(len(rows), bool)) if own is None else (lambda rows, at, own=own: self._skipped(own[rows], at))
            parts.append((chosen, *self._rows([units[i] for i in chosen.tolist()], width, skips)))
        return self._in_order(parts, len(units))

    @staticmethod
    def _in_order(parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]], n: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of runs of units, put in the order of the units."""
        if not parts:
            return np.zeros(0, np.int32), np.zeros(n, np.int64)
        chosen, ids, counts = (np.concatenate(x) for x in zip(*parts, strict=True))
        back = np.argsort(chosen)
        start, count = (np.cumsum(counts) - counts)[back], counts[back]
        which = np.repeat(start - (np.cumsum(count) - count), count)
        return ids[which + np.arange(len(which))], count

    def traced(self, units: list[str], skips: tuple[np.ndarray, np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The ids of the units and how many each has, and the candidates they came by as numbers of units and of places; none for
        long units.

        A unit skips the candidates that ``skips`` lists for it in the same form, and no others.
        """
        parts, traces = [], [(np.zeros(0, np.int64), np.zeros(0, np.uint64))]
        listed = np.sort(self._in_row(*skips)) if skips and len(skips[0]) else None
        for chosen, width in self._runs(units):
            if not width:
                found = [np.frombuffer(self._agenda(units[i], None), np.int32) for i in chosen.tolist()]
                parts.append((chosen, np.concatenate(found), np.array(list(map(len, found)), np.int64)))
                continue

            def skipped(rows: np.ndarray, at: np.ndarray, numbers: np.ndarray = chosen) -> np.ndarray:
                traces.append((numbers[rows], at))
                if listed is None:
                    return np.zeros(len(rows), bool)
                wanted = self._in_row(numbers[rows], at)
                return listed[np.minimum(np.searchsorted(listed, wanted), len(listed) - 1)] == wanted

            parts.append((chosen, *self._rows([units[i] for i in chosen.tolist()], width, skipped)))
        of_unit, at = (np.concatenate(x) for x in zip(*traces, strict=True))
        order = np.argsort(of_unit, kind="stable")
        return *self._in_order(parts, len(units)), of_unit[order], at[order]

    @staticmethod
    def _in_row(rows: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Row and candidate of a short unit in one number."""
        rows, short = rows.astype(np.uint64), np.uint64(127)
        return rows << np.uint64(21) | (at >> np.uint64(42)) << np.uint64(14) | (at >> np.uint64(21) & short) << np.uint64(7) | at & short

    @staticmethod
    def _runs(units: Sequence[str]) -> Iterator[tuple[np.ndarray, int]]:
        """Units of like length that fit into one matrix, with its width; 0 for those too long for one."""
        lengths = np.fromiter(map(len, units), np.int64, len(units))
        order = np.argsort(lengths, kind="stable")
        widths = np.where(lengths > LONGEST_ROW, 0, np.maximum(4, -(-lengths // 4) * 4))[order]
        edges = np.flatnonzero(np.concatenate(([True], widths[1:] != widths[:-1], [True]))) if len(units) else np.zeros(1, np.int64)
        for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            width = int(widths[a])
            step = CELLS // width if width else b - a
            for start in range(a, b, step):
                yield order[start : min(start + step, b)], width

    def _skipped(self, draws: np.ndarray, at: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return mixed(draws ^ (at * np.uint64(0x9E3779B97F4A7C15))) < self.limit

    def _codes(self, text: str) -> np.ndarray:
        return self.model.char_ids[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)]

    def _rows(self, units: list[str], width: int, skips: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Segment units of at most ``width`` characters side by side, one merge in each for every round.

        ``skips`` tells which candidate merges are skipped, from their rows and places.
        """
        n = len(units)
        lengths = np.fromiter(map(len, units), np.int64, n)
        inside = np.arange(width) < lengths[:, None]
        symbols = np.full((n, width + 1), UNKNOWN, np.int32)
        symbols[:, :width][inside] = self._codes("".join(units))
        following = np.tile(np.arange(1, width + 2), (n, 1))
        following[np.arange(n), np.maximum(lengths - 1, 0)] = width
        before = np.tile(np.arange(-1, width), (n, 1))
        end = np.tile(np.arange(1, width + 2), (n, 1))
        alive = inside.copy()
        ranks = np.full((n, width + 1), NONE, np.int32)
        merged = np.zeros((n, width + 1), np.int32)

        def offer(rows: np.ndarray, left: np.ndarray, right: np.ndarray) -> None:
            """Put the candidate merge of two neighbours on the agenda, unless it is skipped."""
            rank, new = self.model.lookup(symbols[rows, left], symbols[rows, right])
            if self.rate:
                some = np.flatnonzero(rank != NONE)
                skipped = skips(rows[some], places(left[some], right[some], end[rows[some], right[some]]))
                rank[some[skipped]] = NONE
            ranks[rows, left], merged[rows, left] = rank, new

        rows, left = np.nonzero(inside[:, 1:]) if width > 1 else (np.zeros(0, np.int64),) * 2
        offer(rows, left, left + 1)
        active = np.arange(n)
        while len(active):
            best = ranks[active].argmin(axis=1)
            some = ranks[active, best] != NONE
            active, best = active[some], best[some]
            right = following[active, best]
            after = following[active, right]
            symbols[active, best] = merged[active, best]
            end[active, best] = end[active, right]
            following[active, best] = after
            before[active, after] = best
            alive[active, right] = False
            ranks[active, right] = ranks[active, best] = NONE
            more = after < width
            offer(active[more], best[more], after[more])
            earlier = before[active, best]
            more = earlier >= 0
            offer(active[more], earlier[more], best[more])
        return self._flat(units, symbols[:, :width], alive)

    def _flat(self, units: list[str], symbols: np.ndarray, alive: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all rows one after another, and how many each has."""
        odd = np.flatnonzero(((symbols >= self.model.size) & alive).any(axis=1))
        if not len(odd):
            return symbols[alive], alive.sum(axis=1)
        spelled = {i: np.frombuffer(self._with_bytes([(symbols[i, p], units[i][p]) for p in np.flatnonzero(alive[i]).tolist()]), np.int32) for i in odd.tolist()}
        alive = alive.copy()
        alive[odd] = False
        counts = alive.sum(axis=1)
        counts[odd] = list(map(len, spelled.values()))
        ids, ends = np.zeros(counts.sum(), np.int32), np.cumsum(counts)
        plain = np.ones(len(ids), bool)
        for i, own in spelled.items():
            ids[ends[i] - len(own) : ends[i]] = own
            plain[ends[i] - len(own) : ends[i]] = False
        ids[plain] = symbols[alive]
        return ids, counts

    def _with_bytes(self, symbols: list[tuple[int, str]]) -> bytes:
        """Symbols without a piece are single characters, spelled in bytes."""
        ids: list[int] = []
        for symbol, char in symbols:
            ids.extend([int(symbol)] if symbol < self.model.size else [self.model.byte_id[b] for b in char.encode("utf-8", "surrogatepass")])
        return np.array(ids, np.int32).tobytes()

    def _agenda(self, unit: str, draw: int | None) -> bytes:
        """The same for one long unit, with a heap as the agenda; without a draw nothing is skipped."""
        symbols, n = self._codes(unit).tolist(), len(unit)
        draws = np.array([draw or 0], np.uint64)
        following, before, end = list(range(1, n + 1)), list(range(-1, n - 1)), list(range(1, n + 1))
        alive = [True] * n
        agenda: list[tuple[int, int, int, int, int]] = []

        def offer(left: int, right: int) -> None:
            found = self.model.merges.get(symbols[left] << 20 | symbols[right])
            if found is None:
                return
            if self.rate and draw is not None and self._skipped(draws, places(*(np.array([x]) for x in (left, right, end[right]))))[0]:
                return
            heapq.heappush(agenda, (found[0], left, right, end[right], found[1]))

        for i in range(n - 1):
            offer(i, i + 1)
        while agenda:
            _, left, right, stop, new = heapq.heappop(agenda)
            if not (alive[left] and alive[right] and following[left] == right and end[right] == stop and end[left] == right):
                continue
            symbols[left], end[left], alive[right] = new, stop, False
            after = following[left] = following[right]
            if after < n:
                before[after] = left
                offer(left, after)
            if before[left] >= 0:
                offer(before[left], left)
        return self._with_bytes([(symbols[i], unit[i]) for i in range(n) if alive[i]])

    # -- decoding ----------------------------------------------------------------------------------

    def decode(self, ids: np.ndarray) -> str:
        """The exact text that any segmentation stands for."""
        text = b"".join(map(self.model.bytes_of.__getitem__, ids.tolist())).decode("utf-8", "surrogatepass")
        return text[1:] if text[:1] == " " else text


_ENCODERS: dict[tuple, Encoder] = {}


def encoder(path: str, rate: float, seed: int) -> Encoder:
    """This worker's encoder; the model file must be on every machine."""
    key = path, rate, seed
    if key not in _ENCODERS:
        _ENCODERS[key] = Encoder(Model(path), rate, seed)
    return _ENCODERS[key]


def document_key(doc_id: int | None) -> int:
    return 0x5BD1E995 if doc_id is None else doc_id % 2**64


ENCODED = "doc_id bigint, n_tokens bigint, ids array<int>, text_sha256 string, decoded_sha256 string"


def encode_documents(docs: DataFrame, model_path: str, rate: float = RATE, seed: int = 0) -> DataFrame:
    """``(doc_id, n_tokens, ids, text_sha256, decoded_sha256)``, one row for each row of ``docs(doc_id, text)``.

    The ids are decoded again in the same task, and the digest of what they say stands beside that of the text. A null
    text is empty and has no ids. Rows with equal id and text get equal ids; rows without id share one key. Runs
    of blanks, line breaks, control characters and characters without a piece all come back. Other columns are
    ignored, an empty input gives no rows. No shuffle; texts are handled in runs of bounded size.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = encoder(model_path, rate, seed)
        for batch in slices(batches, "text"):
            texts = [t or "" for t in column(batch, "text")]
            found = tool.encode([document_key(d) for d in column(batch, "doc_id")], texts)
            offsets = np.cumsum([0, *map(len, found)]).astype(np.int32)
            digest = lambda t: hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest()
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array(np.diff(offsets).astype(np.int64)),
                    pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(found))),
                    pa.array(map(digest, texts), pa.string()),
                    pa.array((digest(tool.decode(ids)) for ids in found), pa.string()),
                ],
                ["doc_id", "n_tokens", "ids", "text_sha256", "decoded_sha256"],
            )
        # The worker may next serve a task of another kind.
        tool.known = Known()

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").alias("text"))
    return rows.mapInArrow(run, ENCODED)


def decode_documents(encoded: DataFrame, model_path: str) -> DataFrame:
    """``(doc_id, text)`` from ``encoded(doc_id, ids)``; null ids give a null text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = encoder(model_path, 0.0, 0)
        for batch in batches:
            texts = [None if ids is None else tool.decode(np.array(ids, np.int64)) for ids in column(batch, "ids")]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    rows = encoded.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("ids").alias("ids"))
    return rows.mapInArrow(run, "doc_id bigint, text string")
