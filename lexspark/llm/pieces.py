"""SentencePiece encoding by sampling without replacement, and decoding.

The pieces of a vocabulary that cover a text form a lattice; a path is a segmentation. Pieces weigh
1 / (rank + 2.7) by the rank of their score (a fixed rule of Zipf's; nothing is trained), a path
weighs the product. ``sampled_segmentations`` draws k distinct paths of the lattice of a whole text
by Gumbel top-k: the k paths with the largest log-probability plus Gumbel noise, found by A-star
over regions of paths. A region is all paths that leave a sampled one at some place by other pieces
than those already taken; its bound is the Gumbel maximum of its paths, drawn from its total
probability and truncated at the maximum of the region it was split from. The region with the
largest bound holds the next sample, which is drawn edge by edge with backward probabilities.

No piece reaches over the start of a space run, so the lattice is cut there, and long chunks wherever
no piece of the vocabulary found in them reaches over: backward probabilities are derived once for
each distinct chunk, for all chunks of a length at once. A path still is one of the whole text, and
the noise hangs on the row key alone.
"""

from __future__ import annotations

import functools
import itertools
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexspark.llm.common import mix, table

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
#: Characters of text whose lattices are made at once, at least one text.
BATCH_CHARS = 400_000
#: Edges of lattices (20 bytes each) that a task keeps for its next texts. What is kept changes no result.
KEPT_EDGES = 2_000_000
#: Chunks of more characters are cut where no piece reaches over.
LONG = 48
#: Characters of a chunk whose edges are laid out at once.
BLOCK = 16_384
_BASE = np.uint64(0xD6E8FEB86659FD93)
_GOLD = np.uint64(0x9E3779B97F4A7C15)
_SLOT = np.uint64(46)
_ALL = (1 << 64) - 1


@dataclass(frozen=True)
class Vocabulary:
    """Pieces as sorted hashes with their ids, their log weights, and what each id decodes to."""

    lengths: frozenset[int]
    hashes: np.ndarray
    ids: np.ndarray
    slots: np.ndarray  # the place of the first hash with these upper 18 bits, -1 for none
    most_in_slot: int
    weight: np.ndarray
    odds: np.ndarray
    bytes_of: list[bytes]
    flat_bytes: np.ndarray  # those bytes one after the other, where each id's begin and how many there are
    first_byte: np.ndarray
    n_bytes: np.ndarray
    byte_id: np.ndarray
    whole: bool  # a piece holds a space run inside or a line feed, so that texts cannot be cut into chunks


def _hash(codes: np.ndarray) -> np.uint64:
    h = np.zeros(1, np.uint64)
    for c in codes:
        h = (h + np.uint64(c) + np.uint64(1)) * _BASE
    return h[0]


@functools.cache
def vocabulary(path: str = VOCABULARY) -> Vocabulary:
    """A SentencePiece model's pieces, read once a Python worker."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    ids = range(sp.get_piece_size())
    byte_id = np.full(256, -1, np.int64)
    bytes_of: list[bytes] = []
    held: list[tuple[str, int]] = []
    for i in ids:
        p = sp.id_to_piece(i)
        if sp.is_byte(i):
            byte_id[int(p[3:5], 16)] = i
            bytes_of.append(bytes([int(p[3:5], 16)]))
        elif sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i):
            bytes_of.append(b"")
        else:
            held.append((p, i))
            bytes_of.append(p.encode())
    held.sort(key=lambda x: (-sp.get_score(x[1]), x[1]))
    weight = np.full(len(ids), -np.log(len(held) + 2.7))
    for rank, (_, i) in enumerate(held, 1):
        weight[i] = -np.log(rank + 2.7)
    weight -= np.log(np.exp(weight).sum())
    hashes = np.array([_hash(np.array([ord(c) for c in p])) for p, _ in held], np.uint64)
    order = np.argsort(hashes)
    hashes, held_ids = hashes[order], np.array([i for _, i in held], np.int64)[order]
    slot, first, in_slot = np.unique((hashes >> _SLOT).astype(np.int64), return_index=True, return_counts=True)
    slots = np.full(1 << 18, -1, np.int32)
    slots[slot] = first
    hashes = np.r_[hashes, np.zeros(in_slot.max(initial=1), np.uint64)]  # the places after the last one match nothing
    lengths = frozenset(len(p) for p, _ in held)
    n_bytes = np.array([len(x) for x in bytes_of])
    flat_bytes = np.frombuffer(b"".join(bytes_of), np.uint8)
    return Vocabulary(lengths, hashes, held_ids, slots, int(in_slot.max(initial=1)), weight, np.exp(weight), bytes_of, flat_bytes, np.cumsum(n_bytes) - n_bytes, n_bytes, byte_id, any(re.search(f"[^{SPACE}]{SPACE}|\n", p) for p, _ in held))


class _Chunks:
    """Numbers of distinct chunks of text, in the order in which they are first asked for. Chunks are told by 64 bits of hash.

    A wrong match would make a sample that does not decode to its text; ``sampled_segmentations`` looks at that.
    """

    def __init__(self) -> None:
        self.hashes, self.numbers, self.n = np.empty(0, np.uint64), np.empty(0, np.int32), 0
        self.new: list[tuple[np.ndarray, np.ndarray]] = []  # codes and lengths of chunks without a lattice yet
        self.powers = self.inverse = np.empty(0, np.uint64)

    def of(self, codes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Numbers of the chunks of ``codes`` between ``starts`` and ``ends``: polynomial hashes from sums of all codes before a place."""
        if len(self.powers) <= len(codes):
            n = len(codes) + (1 << 16)
            self.powers = np.multiply.accumulate(np.full(n, _BASE))
            self.inverse = np.multiply.accumulate(np.full(n, np.uint64(pow(int(_BASE), -1, 1 << 64))))
        sums = np.zeros(len(codes) + 1, np.uint64)
        np.cumsum((codes + np.uint64(1)) * self.powers[: len(codes)], out=sums[1:])
        h = mix((sums[ends] - sums[starts]) * self.inverse[starts] + (ends - starts).astype(np.uint64) * _GOLD)
        at = np.minimum(np.searchsorted(self.hashes, h), max(len(self.hashes) - 1, 0))
        miss = np.flatnonzero(self.hashes[at] != h) if len(self.hashes) else np.arange(len(h))
        found = self.numbers[at] if len(self.hashes) else np.empty(len(h), np.int32)
        if len(miss):
            new, first, which = np.unique(h[miss], return_index=True, return_inverse=True)
            found[miss] = which + self.n
            first = miss[first]
            lens = ends[first] - starts[first]
            self.new.append((codes[np.repeat(starts[first] - (np.cumsum(lens) - lens), lens) + np.arange(int(lens.sum()))], lens))
            self.numbers = np.r_[self.numbers, np.arange(self.n, self.n + len(new), dtype=np.int32)]
            self.hashes = np.r_[self.hashes, new]
            order = np.argsort(self.hashes, kind="stable")
            self.hashes, self.numbers = self.hashes[order], self.numbers[order]
            self.n += len(new)
        return found

    def __getitem__(self, chunk: str) -> int:
        return int(self.of(_codes(chunk), np.array([0]), np.array([len(chunk)]))[0])


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


class _Rows:
    """A numpy array that grows at its end without a copy for each addition."""

    def __init__(self, kind: type) -> None:
        self.held, self.n = np.empty(KEPT_EDGES + (1 << 20), kind), 0  # memory that is not written is not taken

    def add(self, new: np.ndarray) -> np.ndarray:
        end = self.n + len(new)
        if end > len(self.held):
            wider = np.empty(max(end, 3 * len(self.held) // 2), self.held.dtype)
            wider[: self.n] = self.held[: self.n]
            self.held = wider
        self.held[self.n : end] = new
        self.n = end
        return self.held[:end]


class Lattice:
    """Lattices of distinct chunks of text: a node is a character's place, a node's edges lie together, the longest piece first.

    Chunks are numbered as they come and keep their numbers; ``add`` makes the lattices of new ones,
    all chunks of one length at once. ``known`` has the numbers.
    """

    def __init__(self, v: Vocabulary) -> None:
        self.v = v
        self.known = _Chunks()
        kinds = {"start": np.int64, "first": np.int32, "n_edges": np.int8, "target": np.int32, "out": np.int32, "log_p": np.float64, "cum": np.float32}
        self.rows = {name: _Rows(kind) for name, kind in kinds.items()}
        self.start, self.first, self.n_edges = (self.rows[x].held[:0] for x in ("start", "first", "n_edges"))  # a chunk's node; a node's edges
        self.target, self.out, self.log_p, self.cum = (self.rows[x].held[:0] for x in ("target", "out", "log_p", "cum"))
        self.flat = np.arange(len(v.weight), dtype=np.int32)  # piece ids; beyond the vocabulary, those of characters made of bytes
        self.wide = np.ones(len(v.weight), np.int8)  # ids from a place in ``flat`` on that belong together
        self.odd: dict[int, int] = {}

    def _spelled(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places in ``flat`` and weights of characters that are no pieces."""
        kinds, which = np.unique(codes, return_inverse=True)
        weights = np.empty(len(kinds))
        places = np.empty(len(kinds), np.int32)
        for i, c in enumerate(kinds.tolist()):
            ids = self.v.byte_id[np.frombuffer(chr(c).encode("utf-8", "replace"), np.uint8)]
            if c not in self.odd:
                self.odd[c] = len(self.flat)
                self.flat = np.concatenate([self.flat, ids.astype(np.int32)])
                self.wide = np.concatenate([self.wide, [len(ids), *[1] * (len(ids) - 1)]]).astype(np.int8)
            places[i], weights[i] = self.odd[c], self.v.weight[ids].sum()
        return places[which], np.exp(weights[which])

    def _found(self, codes: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(length, node, id) of the pieces in rows of characters, by length; a node is a place in the flat rows."""
        v, size = self.v, codes.shape[1]
        text = codes.astype(np.uint64) + np.uint64(1)
        h = np.zeros_like(text)
        for length in range(1, min(size, max(v.lengths)) + 1):
            h = (h[:, : size - length + 1] + text[:, length - 1 :]) * _BASE
            if length not in v.lengths:
                continue
            flat = h.ravel()
            at = v.slots[(flat >> _SLOT).view(np.int64)]
            some = np.flatnonzero(at >= 0)
            at, sought = at[some], flat[some]
            right = v.hashes[at] == sought
            wrong = np.flatnonzero(~right)
            for _ in range(v.most_in_slot - 1):  # others in the slot
                at[wrong] += 1
                right[wrong] = v.hashes[at[wrong]] == sought[wrong]
                wrong = wrong[~right[wrong] & (v.hashes[at[wrong]] < sought[wrong])]
            some = some[right]
            yield length, some if length == 1 else some + some // (size - length + 1) * (length - 1), v.ids[at[right]]

    def cuts(self, codes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Places inside the chunks between ``starts`` and ``ends`` that no piece reaches over."""
        lens = ends - starts + 1  # with a code after each that no piece has
        at = np.repeat(starts - (np.cumsum(lens) - lens), lens) + np.arange(int(lens.sum()))
        last = np.cumsum(lens) - 1
        held = codes[np.minimum(at, len(codes) - 1)]
        held[last] = 0
        over = np.zeros(len(held) + 1, np.int32)
        for length, node, _ in self._found(held[None]):
            if length > 1:
                over[node + 1] += 1
                over[node + length] -= 1
        free = np.cumsum(over[:-1]) == 0
        free[last] = False
        return at[free]

    def _edges(self, codes: np.ndarray, span: int, wide: int) -> tuple[np.ndarray, np.ndarray]:
        """Weights and pieces of the edges of the first ``span`` nodes of each row, ``wide`` cells a node; cell wide - length has the piece of that length."""
        size = codes.shape[1]
        odds, out = np.zeros(len(codes) * span * wide), np.zeros(len(codes) * span * wide, np.int32)
        for length, node, ids in self._found(codes):
            if size > span:
                row, column = np.divmod(node, size)
                inside = column < span
                node, ids = (row * span + column)[inside], ids[inside]
            cell = node * wide + (wide - length)
            odds[cell], out[cell] = self.v.odds[ids], ids
        cell = np.flatnonzero(odds[wide - 1 :: wide] == 0)
        if len(cell):
            out[cell * wide + wide - 1], odds[cell * wide + wide - 1] = self._spelled(codes[:, :span].ravel()[cell])
        return odds, out

    def add(self) -> None:
        """Make what ``known`` has numbered since the last time."""
        if not self.known.new:
            return
        most = max(self.v.lengths)
        codes, lens = (np.concatenate(x) for x in zip(*self.known.new))
        self.known.new = []
        base = len(self.first)
        starts = base + np.cumsum(lens) - lens
        n = len(codes)
        first, n_edges = np.empty(n, np.int64), np.empty(n, np.int8)
        made: list[tuple[np.ndarray, ...]] = []
        edges = len(self.out)
        by_len = np.argsort(lens, kind="stable")
        cuts = np.flatnonzero(np.r_[True, np.diff(lens[by_len]) > 0])
        for a, b in zip(cuts, [*cuts[1:], len(by_len)]):
            size = int(lens[by_len[a]])
            wide = min(size, most)
            at = (starts[by_len[a:b]] - base)[:, None] + np.arange(size)
            # what the paths from the next nodes weigh, over the nearest one's; nothing beyond the chunk's end
            ahead = np.zeros((b - a, wide))
            ahead[:, -1] = 1.0
            for low in range((size - 1) // BLOCK * BLOCK, -1, -BLOCK):  # one block, but for very long chunks
                high = min(low + BLOCK, size)
                odds, out = self._edges(codes[at[:, low : min(high + wide - 1, size)]], high - low, wide)
                cells = odds.reshape(b - a, high - low, wide)
                for i in range(high - low - 1, -1, -1):
                    here = cells[:, i]
                    here *= ahead
                    total = here.sum(axis=1, keepdims=True)
                    here /= total
                    ahead[:, :-1] = ahead[:, 1:] / total
                place = np.flatnonzero(odds)
                p, row = odds[place], place // wide
                length = (row + 1) * wide - place
                node = at[:, low:high].ravel()[row]
                heads = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
                counts = np.diff(np.r_[heads, len(row)])
                cum = np.cumsum(p)
                cum = (cum - np.repeat(cum[heads] - p[heads], counts)).astype(np.float32)
                cum[heads + counts - 1] = np.inf  # the last one takes what rounding leaves
                target = np.where(low + row % (high - low) + length == size, -1, node + base + length)
                first[node[heads]], n_edges[node[heads]] = heads + edges, counts
                edges += len(node)
                made.append((target.astype(np.int32), out[place], np.log(p), cum))
        target, out, log_p, cum = (np.concatenate(x) for x in zip(*made))
        self.first, self.n_edges = self.rows["first"].add(first), self.rows["n_edges"].add(n_edges)
        self.target, self.out = self.rows["target"].add(target), self.rows["out"].add(out)
        self.log_p, self.cum = self.rows["log_p"].add(log_p), self.rows["cum"].add(cum)
        self.start = self.rows["start"].add(starts)

    def walk(self, nodes: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Edges drawn from each node to its chunk's end, in order, and how many each has."""
        n = len(nodes)
        live, now, found, own = np.arange(n), nodes, [], []
        step = 0
        while len(live):
            u = unit(keys[live] + np.array([step], np.uint64) * _GOLD)
            e = self.first[now].astype(np.int64)
            late = np.flatnonzero(u >= self.cum[e])
            while len(late):
                e[late] += 1
                late = late[u[late] >= self.cum[e[late]]]
            found.append(e)
            own.append(live)
            to = self.target[e]
            on = to >= 0
            live, now = live[on], to[on]
            step += 1
        counts = np.zeros(n, np.int64)
        for x in own:
            counts[x] += 1
        starts = np.cumsum(counts) - counts
        edges = np.empty(int(counts.sum()), np.int32)
        for j, (x, e) in enumerate(zip(own, found)):
            edges[starts[x] + j] = e
        return edges, counts

    def pieces(self, edges: np.ndarray) -> np.ndarray:
        """Piece ids of edges; one of bytes gives several."""
        out = self.out[edges]
        wide = self.wide[out].astype(np.int64)
        if (wide == 1).all():
            return self.flat[out]
        ends = np.cumsum(wide)
        return self.flat[np.repeat(out - (ends - wide), wide) + np.arange(ends[-1])]


def unit(x: np.ndarray) -> np.ndarray:
    """Numbers in (0, 1) from 64-bit keys."""
    return ((mix(x) >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53


class _Region:
    """The paths that share a sampled path's edges up to some place from ``at`` on and leave it there, but for places that are ``gone``.

    ``left``, if given, is the log-probability of what is not excluded at ``at``. ``bound`` is the
    Gumbel maximum of all paths of the region, ``place`` where the path that has it leaves.
    """

    def __init__(self, lat: Lattice, edges: np.ndarray, chunk: np.ndarray, at: int, left: float | None, value: float, out: list[int]) -> None:
        self.edges, self.chunk, self.at, self.left, self.value, self.out = edges, chunk, at, left, value, out
        self.each = lat.log_p[edges]
        self.log_p = float(self.each.sum())
        self.before = float(self.each[:at].sum()) if at else 0.0
        self.gone: list[int] = []
        self.bound, self.place = -np.inf, at

    def draw(self, most: float, seed: int) -> None:
        """A bound of what is left, truncated at ``most``, and its place: the maximum of Gumbels is a Gumbel at the sum of their masses."""
        reach, n = 192, len(self.edges) - self.at
        while True:
            each = self.each[self.at : self.at + reach]
            run = each.cumsum()
            with np.errstate(divide="ignore"):
                mass = run - each + np.log(-np.expm1(each))
            if self.left is not None:
                mass[0] = self.left
            for t in self.gone:
                if t < self.at + len(mass):
                    mass[t - self.at] = -np.inf
            top = float(mass.max(initial=-np.inf))
            if reach >= n or run[-1] < top - 38:  # what is beyond is less than the last bit of the sum
                break
            reach *= 16
        if top == -np.inf:
            self.bound = -np.inf
            return
        parts = np.exp(mass - top).cumsum()
        free = self.before + top + math.log(parts[-1]) - math.log(-math.log(_unit(seed)))
        low, high = min(most, free), max(most, free)
        self.bound = low - math.log1p(math.exp(low - high))
        self.place = self.at + min(int(parts.searchsorted(_unit(seed + 1) * parts[-1], side="right")), len(parts) - 1)

    def leave(self) -> None:
        """Take the place that was drawn out of the region."""
        self.gone.append(self.place)


def _mixed(x: int) -> int:
    """``mix`` of one number."""
    x &= _ALL
    x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 & _ALL
    x = (x ^ x >> 27) * 0x94D049BB133111EB & _ALL
    return x ^ x >> 31


def _seed(seed: int, n: int) -> int:
    return _mixed(seed + n * 0xD1B54A32D192ED03)


def _unit(x: int) -> float:
    return ((_mixed(x) >> 11) + 0.5) * 2.0**-53


def _leaving(lat: Lattice, best: _Region, numbers: np.ndarray, seed: int) -> tuple[int, float, list[int]]:
    """An edge drawn where the best region's path leaves, what is left at its node then, and the edges taken there."""
    t = best.place
    before = int(lat.target[best.edges[t - 1]]) if t else -1
    node = before if before >= 0 else int(lat.start[numbers[best.chunk[t]]])
    out = [int(best.edges[t]), *(best.out if t == best.at else [])]
    first = int(lat.first[node])
    free = [e for e in range(first, first + int(lat.n_edges[node])) if e not in out]
    odds = np.exp(lat.log_p[free])
    u = _unit(seed) * odds.sum()
    i = min(int(np.searchsorted(np.cumsum(odds), u, side="right")), len(free) - 1)
    rest = float(odds.sum() - odds[i]) if len(free) > 1 else 0.0
    return free[i], float(np.log(rest)) if rest > 0 else -np.inf, out


def sample_batch(texts: list[str], keys: list[int], k: int, lat: Lattice) -> list[list[tuple[np.ndarray, float, float, float]]]:
    """For each text its samples in order: (piece ids, log-probability, perturbed value, inclusion).

    Fewer than k if the text has fewer segmentations; an empty text has one, of no pieces.
    Inclusion: the probability that the sample is among k, given the (k+1)-th perturbed value.
    """
    marked = [SPACE + t.replace(" ", SPACE) if t else "" for t in texts]
    lens = np.fromiter(map(len, marked), np.int64, len(marked))
    codes = _codes("".join(marked))
    del marked
    head = np.zeros(len(codes) + 1, bool)  # where chunks begin
    if not lat.v.whole:
        space, feed = codes == ord(SPACE), codes == 10
        head[:-1] = feed
        head[1:-1] |= feed[:-1] | (space[1:] & ~space[:-1])
    text_ends = np.cumsum(lens)
    head[text_ends] = head[text_ends - lens] = True
    at = np.flatnonzero(head)
    long = np.flatnonzero(np.diff(at) > LONG)
    if len(long):
        head[lat.cuts(codes, at[long], at[long + 1])] = True
        at = np.flatnonzero(head)
    flat = lat.known.of(codes, at[:-1], at[1:])
    sizes = np.diff(np.searchsorted(at, np.r_[0, text_ends]))
    numbers = np.split(flat, np.cumsum(sizes)[:-1])
    lat.add()
    seeds = mix(np.array(keys, np.uint64) * _GOLD + np.uint64(1))
    own_seeds = seeds.tolist()
    sizes = np.fromiter(map(len, numbers), np.int64, len(numbers))
    ends = np.cumsum(sizes)
    places = np.arange(ends[-1] if len(ends) else 0, dtype=np.uint64) - np.repeat(ends - sizes, sizes).astype(np.uint64)
    edges, counts = lat.walk(lat.start[flat], mix(np.repeat(seeds, sizes) + places * _GOLD))
    chunk = np.repeat(places.astype(np.int32), counts)
    cuts = np.r_[0, np.cumsum(counts)][np.r_[0, ends]]
    tops = -np.log(-np.log(unit(seeds + np.uint64(7))))
    regions: list[list[_Region]] = []
    for i in range(len(texts)):
        one = _Region(lat, edges[cuts[i] : cuts[i + 1]], chunk[cuts[i] : cuts[i + 1]], 0, None, float(tops[i]), [])
        one.draw(one.value, _seed(own_seeds[i], 1))
        regions.append([one])
    for r in range(1, k):
        todo, nodes, keys_, spans = [], [], [], []
        for i, own in enumerate(regions):
            best = max(own, key=lambda x: x.bound)
            if best.bound == -np.inf or len(own) < r:
                continue
            seed = _seed(own_seeds[i], 2 * r)
            e, left, out = _leaving(lat, best, numbers[i], seed)
            c, on = int(best.chunk[best.place]), int(lat.target[e])
            later = lat.start[numbers[i][c + 1 :]]
            nodes.append(np.concatenate([[on], later]) if on >= 0 else later)
            span = np.arange(c if on >= 0 else c + 1, len(numbers[i]), dtype=np.uint64)
            keys_.append((span + np.uint64(1)) * _GOLD + np.uint64(seed))
            spans.append(span)
            todo.append((i, best, e, left, out))
        if not todo:
            break
        edges, counts = lat.walk(np.concatenate(nodes), mix(np.concatenate(keys_)))
        ends = np.r_[0, np.cumsum(counts)]
        a = 0
        for (i, best, e, left, out), span in zip(todo, spans):
            b, t, most = a + len(span), best.place, best.bound
            new = np.concatenate([best.edges[:t], [e], edges[ends[a] : ends[b]]])
            new_chunk = np.concatenate([best.chunk[: t + 1], np.repeat(span.astype(np.int32), counts[a:b])]) if r + 1 < k else best.chunk[:0]
            one = _Region(lat, new, new_chunk, t, left, most, out)
            one.draw(most, _seed(own_seeds[i], 2 * k + 2 * r))
            best.leave()
            best.draw(most, _seed(own_seeds[i], 2 * k + 2 * r + 1))
            regions[i].append(one)
            a = b
    samples = [x for own in regions for x in own]
    edges = np.concatenate([np.empty(0, np.int32), *[x.edges for x in samples]])
    ids, wide = lat.pieces(edges), lat.wide[lat.out[edges]]
    cuts = np.r_[0, np.cumsum(wide)][np.r_[0, np.cumsum([len(x.edges) for x in samples])].astype(np.int64)].tolist()
    found, at = [], 0
    for own in regions:
        limit, rows = max(x.bound for x in own), []
        for x in own:
            inside = 1.0 if limit == -np.inf else -math.expm1(-math.exp(min(max(x.log_p - limit, -745.0), 700.0)))
            rows.append((ids[cuts[at] : cuts[at + 1]], x.log_p, x.value, inside))
            at += 1
        found.append(rows)
    return found


def decoded(ids: np.ndarray, v: Vocabulary) -> str:
    """The text of piece ids: U+2581 are spaces, the first one is not the text's."""
    text = b"".join(map(v.bytes_of.__getitem__, ids.tolist())).decode("utf-8", "replace").replace(SPACE, " ")
    return text.removeprefix(" ")


def round_trips(samples: list[np.ndarray], texts: list[str], v: Vocabulary) -> list[bool]:
    """Whether each sample decodes to its text. The bytes of all samples are laid out at once; where they are not the text's, it is decoded."""
    if not samples:
        return []
    ids = np.concatenate(samples)
    wide = v.n_bytes[ids]
    ends = np.cumsum(wide)
    held = v.flat_bytes[np.repeat(v.first_byte[ids] - (ends - wide), wide) + np.arange(ends[-1] if len(ends) else 0)]
    cuts = np.r_[0, ends][np.r_[0, np.cumsum([len(x) for x in samples])].astype(np.int64)].tolist()
    found, last, marked = [], None, b""
    for x, t, a, b in zip(samples, texts, cuts, cuts[1:]):
        if t is not last:
            last, marked = t, (SPACE + t.replace(" ", SPACE)).encode("utf-8", "replace") if t else b""
        found.append(held[a:b].tobytes() == marked or decoded(x, v) == t.replace(SPACE, " "))
    return found


def row_key(key: object, seed: int) -> int:
    return xxhash.xxh64_intdigest(repr(key), seed)


def sampled_segmentations(docs: DataFrame, k: int = 2, seed: int = 9, model: str = VOCABULARY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, sample, pieces, log_prob, perturbed, inclusion, round_trip)``, up to k rows a row of ``docs``.

    ``pieces`` are the ids of a segmentation of the whole text, distinct among the samples of a row;
    ``round_trip``: they decode to the text (U+2581 in a text decodes as a space). The samples hang on
    the seed and the row's id, not on other rows; rows with equal id and text get equal samples, and
    rows without an id are drawn as one id. Null texts count as empty: one sample of no pieces. Other
    columns are not read, whatever their names. No rows: no rows. ``model`` is a file that every
    executor can read, as an input.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    names = ["doc_id", "sample", "pieces", "log_prob", "perturbed", "inclusion", "round_trip"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(model)
        lat = Lattice(v)
        for b in batches:
            ids, texts = b.column(0), [t or "" for t in b.column(1).to_pylist()]
            keys = [row_key(x, seed) for x in ids.to_pylist()]
            a = 0
            while a < len(texts):
                z, chars = a, 0
                while z < len(texts) and (z == a or chars + len(texts[z]) <= BATCH_CHARS):
                    chars += len(texts[z])
                    z += 1
                found = sample_batch(texts[a:z], keys[a:z], k, lat)
                own = [i for i, rows in enumerate(found, a) for _ in rows]
                place = [j for rows in found for j in range(len(rows))]
                pieces, log_p, value, inside = zip(*itertools.chain.from_iterable(found))
                back = round_trips(list(pieces), [texts[i] for i in own], v)
                offsets = np.r_[0, np.cumsum([len(p) for p in pieces])].astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(pieces), pa.int32()))
                cols = [ids.take(pa.array(own, pa.int64())), pa.array(place, pa.int32()), lists, *[pa.array(x, pa.float64()) for x in (log_p, value, inside)], pa.array(back)]
                yield pa.RecordBatch.from_arrays(cols, names=names)
                a = z
                if len(lat.out) > KEPT_EDGES:
                    lat = Lattice(v)

    ddl = f"doc_id {kind}, sample int, pieces array<int>, log_prob double, perturbed double, inclusion double, round_trip boolean"
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, ddl)


def decode_pieces(encoded: DataFrame, pieces_col: str = "pieces", model: str = VOCABULARY) -> DataFrame:
    """``encoded`` with ``decoded``, the text of its pieces; null for null. A column of that name is replaced."""
    encoded = encoded.drop("decoded")

    @F.pandas_udf("string")
    def run(pieces):  # noqa: ANN001, ANN202
        v = vocabulary(model)
        return pieces.map(lambda p: None if p is None else decoded(np.asarray(p, np.int64), v))

    run.func.__annotations__ = {}
    return encoded.withColumn("decoded", run(F.col(pieces_col)))


def op9_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = sampled_segmentations(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "sample", "pieces", F.size("pieces").cast("long").alias("n_pieces"), F.xxhash64("pieces").alias("pieces_xxh64"), "log_prob", "perturbed", "inclusion", "round_trip")
