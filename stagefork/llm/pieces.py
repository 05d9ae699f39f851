"""SentencePiece encoding and decoding with sampled segmentations.

The lattice of a text has an edge for every vocabulary piece and, where a character
has none, one for its bytes. No piece runs from a word into the blanks before the
next, so the lattice is a row of small lattices, one a word, and equal words share
one. Forward sums over all segmentations weigh every choice exactly.

Segmentations are drawn without replacement by the Gumbel top-k trick as an A-star
search: a set of segmentations carries the largest perturbed log-probability in it,
drawn once from the set's total. Taking the best set yields a segmentation, and what
is left of the set splits by the first word at which a segmentation differs. Totals
are known, so the bounds are tight and no set is opened in vain. All draws are hashes
of row key, sample, word and step.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import slices, table

BLANK = 0x2581
#: A blank sign that stands in the text itself; it goes by its bytes, since the piece decodes to a space.
_LITERAL = 0x110001
#: Characters worked on at a time; draws until a word's other segmentations are listed instead, if it has no more than that.
PIECE, TRIES, LISTED, MANY = 1 << 19, 16, 20_000, 1e6
#: Exponent of piece probabilities: 1 leaves them, 0 makes all segmentations equally likely.
SMOOTHING = 0.5
_P = np.uint64(0x9E3779B97F4A7C15)
_P_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n + 1, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


@dataclass
class Vocabulary:
    """Pieces as a trie over classes of characters; a piece's log-probability falls with its rank.

    The model file holds merge ranks, not probabilities. By Zipf's law the piece of
    rank r has log-probability -log(r + 2) less a constant, times a smoothing exponent
    that makes segmentations differ more. Characters that begin or continue no piece are
    of class 0. The trie's edges lie in an open hash table, a key for node and class.
    """

    classes: np.ndarray  # by character
    n_classes: int
    keys: np.ndarray
    targets: np.ndarray
    piece_at: np.ndarray  # by node, -1: no piece ends there
    logs: np.ndarray  # by id
    weights: np.ndarray  # exp(logs), and a zero at -1
    byte_id: int
    decoded: list[bytes]  # by id

    @classmethod
    def load(cls, path: str, smoothing: float = SMOOTHING) -> Vocabulary:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        bytes_ = [i for i in range(n) if model.is_byte(i)]
        plain = [i for i in range(n) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
        names = {i: model.id_to_piece(i) for i in plain}
        if len(bytes_) != 256 or any("▁" in s.lstrip("▁") for s in names.values()):
            raise ValueError("a vocabulary with byte pieces is needed, and without pieces that run across words")
        rank = np.full(n, max(-model.get_score(i) for i in plain))
        for i in plain:
            rank[i] = -model.get_score(i)
        logs = -np.log(rank + 2)
        logs = (smoothing * (logs - np.log(np.exp(logs[plain]).sum() + np.exp(logs[bytes_]).sum()))).astype(np.float32)
        decoded = [b""] * n
        for k, i in enumerate(bytes_):
            decoded[i] = bytes([k])
        for i, s in names.items():
            decoded[i] = s.replace("▁", " ").encode()
        classes = np.zeros(_LITERAL + 1, np.int64)
        used = sorted({ord(c) for s in names.values() for c in s})
        classes[used] = np.arange(1, len(used) + 1)
        edges: dict[int, int] = {}
        piece_at = [-1]
        for i, s in names.items():
            node = 0
            for c in s:
                key = node * (len(used) + 1) + int(classes[ord(c)])
                node = edges.setdefault(key, len(piece_at))
                if node == len(piece_at):
                    piece_at.append(-1)
            piece_at[node] = i
        size = 1 << (len(edges) * 3).bit_length()
        keys, targets = np.full(size, -1, np.int64), np.full(size, -1, np.int32)
        slots = _slots(np.fromiter(edges, np.int64, len(edges)), size).tolist()
        for slot, (key, node) in zip(slots, edges.items(), strict=True):
            while keys[slot] >= 0:
                slot = (slot + 1) % size
            keys[slot], targets[slot] = key, node
        weights = np.r_[np.exp(logs.astype(np.float64)), 0.0]
        return cls(classes, len(used) + 1, keys, targets, np.array(piece_at, np.int32), logs, weights, bytes_[0], decoded)

    def step(self, node: np.ndarray, kind: np.ndarray) -> np.ndarray:
        """The nodes behind nodes by a class of character, -1 where there is none."""
        key = node * self.n_classes + kind
        slot = _slots(key, len(self.keys))
        found = self.keys[slot]
        out = np.where(found == key, self.targets[slot], -1)
        open_ = np.flatnonzero((found != key) & (found >= 0))
        while len(open_):
            slot[open_] = (slot[open_] + 1) % len(self.keys)
            found = self.keys[slot[open_]]
            hit = found == key[open_]
            out[open_[hit]] = self.targets[slot[open_[hit]]]
            open_ = open_[~hit & (found >= 0)]
        return out


def _slots(key: np.ndarray, size: int) -> np.ndarray:
    return ((key.view(np.uint64) * _P) >> np.uint64(65 - size.bit_length())).view(np.int64)


def text_hash(codes: list[int]) -> int:
    """Of the characters and their number; as `Prefixes` finds it for a part of a text."""
    return int(Prefixes(np.array(codes, np.uint64)).of(np.array([0]), np.array([len(codes)]))[0])


class Prefixes:
    """Hashes of all parts of a row of characters."""

    def __init__(self, codes: np.ndarray):
        self.sums = np.r_[np.uint64(0), np.cumsum(_mix(codes + np.uint64(1)) * _powers(_P, len(codes))[:-1], dtype=np.uint64)]
        self.back = _powers(_P_INVERSE, len(codes))

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return _mix((self.sums[end] - self.sums[start]) * self.back[start] + (end - start).astype(np.uint64))


@dataclass
class Words:
    """Lattices of distinct words of up to one length: `cum[j, w, l]` is the chance that the piece that ends behind character j has at most l + 1 characters."""

    size: np.ndarray
    piece: np.ndarray  # length x words x longest; -2 for a character's bytes
    cum: np.ndarray
    total: np.ndarray
    count: np.ndarray  # of segmentations, MANY at most


def utf8_size(codes: np.ndarray) -> np.ndarray:
    return 1 + (codes >= 0x80) + (codes >= 0x800) + ((codes >= 0x10000) & (codes != _LITERAL))


def lattices(vocabulary: Vocabulary, codes: np.ndarray, start: np.ndarray, size: np.ndarray) -> Words:
    n, length = len(start), int(size.max())
    kinds = vocabulary.classes[codes.view(np.int64)]
    w = np.repeat(np.arange(n), size)
    s = np.arange(len(w)) - np.repeat(np.cumsum(size) - size, size)
    node, found, l = np.zeros(len(w), np.int64), [], 0
    while len(w):  # all starts at once, as long as some piece begins so
        node = vocabulary.step(node, kinds[start[w] + s + l])
        on = node >= 0
        w, s, node = w[on], s[on], node[on]
        ids = vocabulary.piece_at[node]
        hit = np.flatnonzero(ids >= 0)
        found.append((s[hit] + l, w[hit], ids[hit]))
        l += 1
        on = s + l < size[w]
        w, s, node = w[on], s[on], node[on]
    longest = max([l + 1 for l, f in enumerate(found) if len(f[0])], default=1)
    piece = np.full((length, n, longest), -1, np.int32)
    for l, (j, w, ids) in enumerate(found[:longest]):
        piece[j, w, l] = ids
    weight = vocabulary.weights[piece]
    j, w = np.nonzero((np.arange(length)[:, None] < size) & (piece[:, :, 0] < 0))
    piece[j, w, 0] = -2
    weight[j, w, 0] = np.exp(utf8_size(codes[start[w] + j]) * np.float64(vocabulary.logs[vocabulary.byte_id]))
    has = (piece != -1).astype(np.float32)
    sums, count, scale = np.zeros((length + 1, n)), np.zeros((length + 1, n), np.float32), np.zeros(n)
    sums[0] = count[0] = 1
    cum = np.ones((length, n, longest), np.float32)
    for j in range(length):
        top = min(j + 1, longest)
        ways = np.cumsum(weight[j, :, :top] * sums[j - top + 1:j + 1][::-1].T, axis=1)
        sums[j + 1] = ways[:, -1]
        with np.errstate(invalid="ignore"):
            np.divide(ways, ways[:, -1:], out=cum[j, :, :top], casting="same_kind")
        count[j + 1] = np.minimum((has[j, :, :top] * count[j - top + 1:j + 1][::-1].T).sum(axis=1), MANY)
        if j % 8 == 7:  # long words' sums are kept in range
            low = np.flatnonzero((sums[j + 1] < 1e-100) & (sums[j + 1] > 0))
            if len(low):
                sums[max(0, j + 2 - longest):j + 2, low] *= 1e100
                scale[low] -= np.log(1e100)
    rows = np.arange(n)
    return Words(size, piece, cum, np.log(sums[size, rows]) + scale, count[size, rows].astype(np.float64))


@dataclass
class Path:
    """Chosen pieces of every word of the batch: `first` has each word's place in them."""

    first: np.ndarray
    piece: np.ndarray  # id, or -2
    end: np.ndarray  # of the piece's last character, in the batch
    log: np.ndarray  # of each word's segmentation


class Batch:
    """The lattices of some texts and the search over them."""

    def __init__(self, vocabulary: Vocabulary, texts: list[str], keys: list[int], seed: int):
        self.vocabulary = vocabulary
        own = [np.frombuffer((" " + t if t else "").encode("utf-32-le", "surrogatepass"), np.uint32) for t in texts]
        lens = np.array([len(c) for c in own])
        codes = np.concatenate(own).astype(np.uint64) if own else np.zeros(0, np.uint64)
        codes = np.where(codes == BLANK, np.uint64(_LITERAL), np.where(codes == 32, np.uint64(BLANK), codes))
        self.codes, doc = codes, np.repeat(np.arange(len(texts)), lens)
        blank = codes == BLANK
        begins = np.flatnonzero(blank & np.r_[True, ~blank[:-1] | (doc[1:] != doc[:-1])]) if len(codes) else np.zeros(0, np.int64)
        self.start, self.size = begins, np.diff(np.r_[begins, len(codes)])
        self.doc = doc[begins] if len(codes) else begins
        self.bounds = np.searchsorted(self.doc, np.arange(len(texts) + 1))
        self.word = np.arange(len(begins)) - self.bounds[self.doc]
        self.key = _mix(np.array(keys, np.uint64) ^ _mix(np.full(len(keys), seed, np.uint64)))
        self.base = self.key[self.doc] ^ _mix(self.word.astype(np.uint64) << np.uint64(24))
        _, kind_first, self.kind = np.unique(Prefixes(codes).of(begins, begins + self.size), return_index=True, return_inverse=True)
        kind_size = self.size[kind_first] if len(begins) else self.size
        group = np.ceil(np.log2(np.maximum(kind_size, 1)) * 2).astype(int)  # lengths within half an octave share an array
        self.groups: list[Words] = []
        self.kind_group, self.kind_row = np.zeros(len(kind_size), int), np.zeros(len(kind_size), int)
        for g in np.unique(group).tolist():
            at = np.flatnonzero(group == g)
            self.kind_group[at], self.kind_row[at] = len(self.groups), np.arange(len(at))
            self.groups.append(lattices(vocabulary, codes, begins[kind_first[at]], kind_size[at]))
        self.total, self.count = (self._by_word(name) for name in ("total", "count"))

    def _by_word(self, name: str) -> np.ndarray:
        out = np.zeros(len(self.start))
        for g, words in enumerate(self.groups):
            at = self.kind_group[self.kind] == g
            out[at] = getattr(words, name)[self.kind_row[self.kind[at]]]
        return out

    def _uniform(self, which: np.ndarray, sample: int, step: int) -> np.ndarray:
        x = self.base[which] + np.uint64(((step << 8) + sample + 1) * int(_P) & (1 << 64) - 1)
        return (_mix(x) >> np.uint64(11)) * 2.0**-53

    def _log(self, piece: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Log-probability of pieces, bytes among them, that end at places of the batch."""
        out = self.vocabulary.logs[piece]
        raw = np.flatnonzero(piece == -2)
        out[raw] = utf8_size(self.codes[end[raw]]) * self.vocabulary.logs[self.vocabulary.byte_id]
        return out

    def draw(self, which: np.ndarray, sample: int, turn: int = 0) -> Path:
        """An independent segmentation of each word in `which`, from its end to its start."""
        steps, taken = [], np.zeros(len(which), np.int64)
        kind = self.kind[which]
        group = self.kind_group[kind]
        for g, words in enumerate(self.groups):
            at = np.flatnonzero(group == g)
            row = self.kind_row[kind[at]]
            j, step, n = words.size[row].copy(), turn << 12, 0
            while len(at):
                u = self._uniform(which[at], sample, step)
                l = (words.cum[j - 1, row] > u[:, None]).argmax(axis=1)  # the last entry is 1, u is below
                steps.append((at, j, words.piece[j - 1, row, l], n))
                taken[at] += 1
                j = j - l - 1
                more = j > 0
                at, row, j, step, n = at[more], row[more], j[more], step + 1, n + 1
        first = np.r_[0, np.cumsum(taken)]
        piece, end = np.zeros(first[-1], np.int32), np.zeros(first[-1], np.int64)
        for at, j, own, n in steps:  # the n-th from the end
            place = first[at + 1] - 1 - n
            piece[place], end[place] = own, self.start[which[at]] + j - 1
        log = np.add.reduceat(np.r_[self._log(piece, end).astype(np.float64), 0.0], np.minimum(first[:-1], len(piece))) * (taken > 0)
        return Path(first, piece, end, np.minimum(log - self.total[which], 0))

    def _walk(self, i: int, sample: int, turn: int) -> tuple[list[int], list[int], float]:
        """What `draw` gives for one word: pieces, ends and log-probability."""
        words, row = self.groups[self.kind_group[self.kind[i]]], self.kind_row[self.kind[i]]
        j, step, pieces, ends = int(words.size[row]), turn << 12, [], []
        while j:
            u = self._uniform(np.array([i]), sample, step)[0]
            l = int((words.cum[j - 1, row] > u).argmax())
            pieces.append(int(words.piece[j - 1, row, l]))
            ends.append(int(self.start[i]) + j - 1)
            j, step = j - l - 1, step + 1
        log = float(self._log(np.array(pieces), np.array(ends)).sum(dtype=np.float64))
        return pieces[::-1], ends[::-1], min(0.0, log - float(words.total[row]))

    def segments(self, path: Path, i: int) -> tuple:
        return tuple(path.end[path.first[i]:path.first[i + 1]].tolist())

    def other(self, i: int, taken: set[tuple], sample: int) -> tuple[np.ndarray, np.ndarray, float]:
        """A segmentation of word i that isn't in `taken`, after TRIES draws that were: pieces, ends and log-probability."""
        which, turn = np.array([i]), TRIES
        while self.count[i] > LISTED:
            turn += 1
            pieces, ends, log = self._walk(i, sample, turn)
            if tuple(ends) not in taken:
                return np.array(pieces, np.int32), np.array(ends, np.int64), log
        words, row = self.groups[self.kind_group[self.kind[i]]], self.kind_row[self.kind[i]]
        listed: list[tuple[float, list[int], list[int]]] = []
        open_ = [(int(words.size[row]), 0.0, [], [])]
        while open_:
            j, log, pieces, ends = open_.pop()
            if not j:
                if tuple(ends) not in taken:
                    listed.append((log - float(words.total[row]), pieces, ends))
                continue
            end = int(self.start[i]) + j - 1
            for l in range(min(j, words.piece.shape[2])):
                if words.piece[j - 1, row, l] != -1:
                    own = words.piece[j - 1, row, l:l + 1]
                    open_.append((j - l - 1, log + float(self._log(own, np.array([end]))[0]), [int(own[0]), *pieces], [end, *ends]))
        chances = np.exp([x[0] for x in listed])
        u = float(self._uniform(which, sample, 0xFFF)[0])
        log, pieces, ends = listed[min(int(np.searchsorted(np.cumsum(chances) / chances.sum(), u)), len(listed) - 1)]
        return np.array(pieces, np.int32), np.array(ends, np.int64), log

    def search(self, k: int) -> tuple[list[Path], np.ndarray, np.ndarray, np.ndarray]:
        """k paths, and for each text and path: log-probability, perturbed value (-inf: no such path); and the next best value."""
        texts, words = len(self.bounds) - 1, np.arange(len(self.start))
        paths, logs, values = [], np.full((texts, k), -np.inf), np.full((texts, k), -np.inf)
        sets: list[np.ndarray] = []  # of each path: largest perturbed value of what differs from it first at a word
        masses: list[np.ndarray] = []
        parent, branch = np.full((texts, k), -1), np.full((texts, k), -1)
        value = -np.log(-np.log(np.maximum(_mix(self.key + np.uint64(7)) >> np.uint64(11), np.uint64(1)) * 2.0**-53))
        alive = np.ones(texts, bool)
        for s in range(k):
            fresh = words[alive[self.doc] & (self.word > branch[self.doc, s])]
            path = self.draw(fresh, s)
            forbidden, from_ = np.ones(len(words)), np.zeros(len(words), bool)
            if s:
                path = self._joined(fresh, path, paths, parent[:, s], branch[:, s], s, alive, parent, branch)
            mass = np.exp(path.log)
            if s:
                for d in np.flatnonzero(alive & (branch[:, s] >= 0)).tolist():
                    w = self.bounds[d] + branch[d, s]
                    mass[w] += masses[parent[d, s]][w]
                    forbidden[w] = len(self._taken(d, s, int(branch[d, s]), parent, branch))
                from_ = self.word < np.where(branch[:, s] < 0, 0, branch[:, s])[self.doc]
            paths.append(path)
            masses.append(mass)
            before = np.cumsum(path.log) - path.log
            before = before - (before[self.bounds[:-1][self.doc]] if len(words) else 0)
            sums = np.add.reduceat(np.r_[path.log, 0.0], np.minimum(self.bounds[:-1], len(words))) * (np.diff(self.bounds) > 0)
            logs[:, s], values[:, s] = np.where(alive, sums, -np.inf), np.where(alive, value, -np.inf)
            with np.errstate(divide="ignore"):
                left = before + np.log(np.maximum(1 - mass, 1e-12))
                left[(self.count - forbidden < 0.5) | from_ | ~alive[self.doc]] = -np.inf
                chance = np.log(-np.log(np.maximum(self._uniform(words, s, 0x7FFFFF >> 8), 1e-300)))
                sets.append(-np.logaddexp(-values[:, s][self.doc], chance - left))
            best = np.full(texts, -np.inf)
            for p, own in enumerate(sets):
                top = np.maximum.reduceat(np.r_[own, -np.inf], np.minimum(self.bounds[:-1], len(words)))
                top = np.where(np.diff(self.bounds) > 0, top, -np.inf)
                better = top > best
                best = np.where(better, top, best)
                if s + 1 < k:
                    parent[better, s + 1] = p
            value, alive = best, np.isfinite(best)
            if s + 1 < k:
                for d in np.flatnonzero(alive).tolist():
                    own = sets[parent[d, s + 1]][self.bounds[d]:self.bounds[d + 1]]
                    branch[d, s + 1] = w = int(own.argmax())
                    own[w] = -np.inf
        return paths, logs, values, value

    def _taken(self, d: int, s: int, w: int, parent: np.ndarray, branch: np.ndarray) -> list[int]:
        """Paths whose segmentation of word w path s, or what differs from it there, can't have."""
        out = [s]
        while branch[d, s] == w:
            s = parent[d, s]
            out.append(s)
        return out

    def _joined(self, which: np.ndarray, fresh: Path, paths: list[Path], parent: np.ndarray, branch: np.ndarray, s: int, alive: np.ndarray, parents: np.ndarray, branches: np.ndarray) -> Path:
        """Up to its branching word a path is its parent's; there it differs; beyond, it is fresh. Texts without a path have no pieces."""
        words = len(self.start)
        first, size, log = np.zeros(words, np.int64), np.zeros(words, np.int64), np.zeros(words)
        first[which], size[which], log[which] = fresh.first[:-1], np.diff(fresh.first), fresh.log
        pieces, ends, shift = [fresh.piece], [fresh.end], len(fresh.piece)
        old = alive[self.doc] & (self.word < np.where(branch < 0, 0, branch)[self.doc])
        for p, path in enumerate(paths):
            at = np.flatnonzero(old & (parent[self.doc] == p))
            first[at], size[at], log[at] = path.first[at] + shift, np.diff(path.first)[at], path.log[at]
            pieces.append(path.piece)
            ends.append(path.end)
            shift += len(path.piece)

        def put(i: int, own: np.ndarray, end: np.ndarray, value: float) -> None:
            nonlocal shift
            first[i], size[i], log[i] = shift, len(own), value
            pieces.append(own)
            ends.append(end)
            shift += len(own)

        left = []
        for d in np.flatnonzero(alive & (branch >= 0)).tolist():
            i = int(self.bounds[d] + branch[d])
            left.append((i, {self.segments(paths[q], i) for q in self._taken(d, int(parent[d]), int(branch[d]), parents, branches)}))
        for turn in range(1, TRIES + 1):
            if not left:
                break
            tried = self.draw(np.array([i for i, _ in left]), s, turn)
            again = []
            for k, (i, taken) in enumerate(left):
                if self.segments(tried, k) in taken:
                    again.append((i, taken))
                else:
                    part = slice(tried.first[k], tried.first[k + 1])
                    put(i, tried.piece[part], tried.end[part], tried.log[k])
            left = again
        for i, taken in left:
            put(i, *self.other(i, taken, s))
        bounds = np.r_[0, np.cumsum(size)]
        where = np.repeat(first - bounds[:-1], size) + np.arange(bounds[-1])
        return Path(bounds, np.concatenate(pieces)[where], np.concatenate(ends)[where], log)

    def ids(self, path: Path) -> tuple[np.ndarray, np.ndarray]:
        """Vocabulary ids of a path, and each text's place in them."""
        code = self.codes[path.end]
        size = np.where(path.piece == -2, utf8_size(code), 1)
        place = np.r_[0, np.cumsum(size)]
        out = np.repeat(path.piece, size).astype(np.int32)
        single = np.flatnonzero((path.piece == -2) & (size == 1))
        out[place[single]] = code[single].astype(np.int32) + self.vocabulary.byte_id
        for i in np.flatnonzero(size > 1).tolist():
            raw = chr(BLANK if code[i] == _LITERAL else int(code[i])).encode("utf-8", "surrogatepass")
            out[place[i]:place[i + 1]] = np.frombuffer(raw, np.uint8).astype(np.int32) + self.vocabulary.byte_id
        return out, place[path.first[self.bounds]]


def decode(vocabulary: Vocabulary, ids: np.ndarray, bounds: np.ndarray) -> list[bytes]:
    """UTF-8 texts of rows of ids, without the space that encoding puts in front."""
    if not hasattr(vocabulary, "_flat"):
        sizes = np.array([len(b) for b in vocabulary.decoded])
        vocabulary._flat = np.frombuffer(b"".join(vocabulary.decoded), np.uint8), np.r_[0, np.cumsum(sizes)][:-1], sizes
    flat, first, sizes = vocabulary._flat
    n = sizes[ids]
    place = np.r_[0, np.cumsum(n)]
    raw = flat[np.repeat(first[ids] - place[:-1], n) + np.arange(place[-1])].tobytes()
    at = place[bounds].tolist()
    return [raw[a + 1:b] if b > a else b"" for a, b in zip(at, at[1:], strict=False)]


_SCHEMA = "doc_id long, sample int, ids array<int>, n_pieces int, log_prob double, perturbed double, log_inclusion double, round_trip boolean"


def sampled_pieces(docs: DataFrame, k: int = 2, seed: int = 0, model: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, sample (from 1), ids, n_pieces, log_prob, perturbed, log_inclusion, round_trip: up to k rows for every row.

    The samples of a row are distinct, the largest perturbed value first; a text with
    fewer segmentations has as many rows. `log_inclusion` is the logarithm of the chance
    that a segmentation is above the (k+1)-th value. Samples hang on the row's id and
    text alone: rows that repeat both have the same. A null id counts as its own key.
    A null text counts as empty; an empty text has one segmentation without pieces, of
    probability one. `round_trip` says that the ids decode to the text. An empty table
    gives no rows; further columns are not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(Vocabulary.load(model or default_model()))  # its size is the vocabulary's

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = shared.value
        for batch in slices(batches, 1, PIECE):
            yield from _rows(vocabulary, batch.column(0).to_pylist(), [t or "" for t in batch.column(1).to_pylist()], k, seed)

    rows = docs.selectExpr(f"cast(`{id_col}` as long) doc_id", f"cast(`{text_col}` as string) text")
    return rows.mapInArrow(of, _SCHEMA)


def _rows(vocabulary: Vocabulary, doc_ids: list, texts: list[str], k: int, seed: int) -> Iterator[pa.RecordBatch]:
    batch = Batch(vocabulary, texts, [(0x5EED if i is None else i) & (1 << 64) - 1 for i in doc_ids], seed)
    paths, logs, values, beyond = batch.search(k)
    raw = [t.encode("utf-8", "surrogatepass") for t in texts]
    for s, path in enumerate(paths):
        ids, bounds = batch.ids(path)
        has = np.flatnonzero(np.isfinite(values[:, s]))
        same = [a == b for a, b in zip(decode(vocabulary, ids, bounds), raw, strict=True)]
        with np.errstate(over="ignore", divide="ignore", invalid="ignore"):
            gap = logs[:, s] - beyond
            inclusion = np.where(gap < -30, gap, np.log(-np.expm1(-np.exp(np.minimum(gap, 700)))))
        lists = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(ids))
        columns = [
            pa.array(doc_ids, pa.int64()), pa.array(np.full(len(texts), s + 1, np.int32)), lists, pa.array(np.diff(bounds).astype(np.int32)),
            pa.array(logs[:, s]), pa.array(values[:, s]), pa.array(np.where(np.isfinite(beyond), inclusion, 0.0)), pa.array(same, pa.bool_())]
        yield pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in _SCHEMA.split(", ")]).take(pa.array(has))


def op7_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampled_pieces(table(spark, sf_dir, "documents"))
