"""Language-model scores by a hierarchical Pitman-Yor model over words.

There is a restaurant for each previous word, one for the start of a text, and their
common parent for words without context; above it all words and one unknown word are
equally likely. Restaurants are numbered by a hash of the word in CONTEXTS places, so
that their totals are a table of fixed size; words that share a place share a restaurant.
A context's customers are its training tokens; every table of it sends a customer to the
parent. Seating is sampled by Gibbs sweeps: in a sweep the customers of one dish leave
their restaurant and sit down again; the number of their tables is drawn from its exact
conditional distribution, given the other dishes' tables and the parent's probability, by
generalised Stirling numbers. Restaurants and parent are those of the sweep before. The
last sweeps' predictive probabilities are averaged.

A draw is a hash of word, context and sweep, so seatings are computed anew wherever a
word's counts are at hand. Words are dealt to partitions with all their occurrences,
packed by block of documents; words that a sample shows to be very frequent are dealt
in slices of their contexts. Probabilities meet the occurrences there, and only sums a
document move on.
"""

from __future__ import annotations

from array import array
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import discard, id_remainder, saved, slices, table

#: Discount and strength of contexts and of their parent.
D1, S1, D0, S0 = 0.75, 1.0, 0.5, 10.0
#: Places of restaurants; place 0 is the start of a text.
CONTEXTS = 1 << 21
#: Sweeps, of which so many last ones are averaged.
SWEEPS, SAMPLES = 3, 2
#: Customers of a dish up to which its tables are drawn from the exact distribution; beyond, their mean follows the power of the number that this and half of it show.
EXACT = 256
#: Tokens and documents of a block; words, occurrences and documents worked on at a time: in scoring, an occurrence takes some 250 bytes.
BLOCK_TOKENS, BLOCK_DOCS, WORDS, ENTRIES, SUMS = 3_000_000, 1 << 17, 50_000, 1_000_000, 1_000_000
#: An occurrence is 48 bits: document in its block, training flag, context, count.
_N, _CTX, _BYTES = 9, 21, 6
#: Sampled documents, share of their tokens from which a word is dealt in slices, and slices. They only say where a word is counted, not how.
SAMPLED, FREQUENT, SLICED = 1000, 1 / 256, 16
_SUMS, _KINDS = ("doc", "n_tokens", "n_known", "base", "score"), (np.int64,) * 3 + (np.float64,) * 2


class _Ids(dict):
    def __missing__(self, word: bytes) -> int:
        self[word] = found = len(self)
        return found


def tokens(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def place_of(word: bytes) -> int:
    """The restaurant behind a word."""
    return 1 + xxhash.xxh3_64_intdigest(word) % (CONTEXTS - 1)


def _packed(ids: array, sizes: list[int], train: list[bool], words: _Ids, sliced: dict[bytes, int]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Names of words or their slices, the place of each one's first entry, and the entries.

    A block's tokens are many, so keys are built and sorted where they are.
    """
    word = np.array(ids, np.int32)
    sizes = np.array(sizes)
    place = np.array([place_of(w) for w in words], np.int32)
    ctx = np.zeros(len(word), np.int32)
    np.take(place, word[:-1], out=ctx[1:])
    ctx[np.cumsum(sizes) - sizes] = 0
    names = [w.decode("utf-8", "surrogatepass") for w in words]
    for w in sliced.keys() & words.keys():  # a slice's name is the word's with a space and a number
        own = np.flatnonzero(word == words[w])
        word[own] = len(names) + ctx[own] % SLICED
        names += [f"{w.decode('utf-8', 'surrogatepass')} {k}" for k in range(SLICED)]
    rest = np.repeat(((np.arange(len(sizes)) << 1) | np.array(train, np.int64)) << _CTX, sizes)
    rest |= ctx
    del ctx
    if len(names) < 1 << 24:
        rest |= word.astype(np.int64) << 39
        rest.sort()
        first = np.flatnonzero(np.r_[True, rest[1:] != rest[:-1]])
        n, rest = np.diff(first, append=len(rest)).astype(np.int32), rest[first]
        del first
        word = (rest >> 39).astype(np.int32)
        rest &= (1 << 39) - 1
    else:
        order = np.lexsort((rest, word))
        word, rest = word[order], rest[order]
        first = np.flatnonzero(np.r_[True, (word[1:] != word[:-1]) | (rest[1:] != rest[:-1])])
        n, word, rest = np.diff(np.r_[first, len(word)]), word[first], rest[first]
    most = (1 << _N) - 1
    if n.max() > most:  # one document's occurrences in several entries
        parts = -(-n // most)
        word, rest, left = np.repeat(word, parts), np.repeat(rest, parts), np.repeat(n, parts)
        nth = np.arange(len(word)) - np.repeat(np.cumsum(parts) - parts, parts)
        n = np.minimum(most, left - nth * most)
    rest <<= _N
    rest |= n
    return names, np.searchsorted(word, np.arange(len(names) + 1, dtype=word.dtype)), rest


def _unpacked(column: pa.BinaryArray) -> tuple[np.ndarray, np.ndarray]:
    """Number of entries of each row, and the entries."""
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset:column.offset + len(column) + 1]
    raw = np.frombuffer(column.buffers()[2] or b"", np.uint8)[offsets[0]:offsets[-1]].reshape(-1, _BYTES)
    out = np.zeros((len(raw), 8), np.uint8)
    out[:, :_BYTES] = raw
    return np.diff(offsets) // _BYTES, out.view(np.int64).ravel()


def frequent_words(docs: DataFrame, id_col: str, text_col: str) -> dict[bytes, int]:
    """Words, numbered, that have a large share of a bounded sample's tokens: 1 / FREQUENT at most."""
    rows = docs.select(F.xxhash64(id_col, text_col).alias("h"), F.col(text_col).cast("string").alias("text")).orderBy("h").limit(SAMPLED).select("text")

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for batch in slices(batches, 0):
            for text in batch.column(0).to_pylist():
                counts.update(tokens(text))
                counts[b""] += 1
        least = FREQUENT * counts.total()
        found = [w for w, n in counts.items() if n >= least]
        yield pa.RecordBatch.from_arrays([pa.array(found, pa.binary())], names=["word"])

    found = rows.coalesce(1).mapInArrow(of, "word binary").collect()
    return {w: i for i, w in enumerate(sorted(bytes(r["word"]) for r in found))}


def tally(docs: DataFrame, id_col: str, text_col: str, train, sliced: dict[bytes, int]) -> DataFrame:
    """word, block, entries for every word of every block; where word is null, ids has the block's documents."""

    def made(block: int, doc_ids: list, ids: array, sizes: list, train: list, words: _Ids) -> pa.RecordBatch:
        names, first, entries = _packed(ids, sizes, train, words, sliced)
        own = np.flatnonzero(np.diff(first))
        raw = np.ascontiguousarray(entries.view(np.uint8).reshape(-1, 8)[:, :_BYTES])
        offsets = np.r_[first[own], len(entries), len(entries)].astype(np.int32) * _BYTES
        packed = pa.BinaryArray.from_buffers(pa.binary(), len(own) + 1, [None, pa.py_buffer(offsets), pa.py_buffer(raw)])
        id_offsets = np.zeros(len(own) + 2, np.int32)
        id_offsets[-1] = len(doc_ids)
        return pa.RecordBatch.from_arrays(
            [pa.array([*(names[i] for i in own.tolist()), None], pa.string()), pa.array(np.full(len(own) + 1, block)), packed,
             pa.ListArray.from_arrays(pa.array(id_offsets), pa.array(doc_ids, pa.int64()))], names=["word", "block", "entries", "ids"])

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 24
        doc_ids, ids, sizes, flags, words = [], array("i"), [], [], _Ids()
        for batch in slices(batches, 1):
            for doc_id, text, flag in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                own = tokens(text)
                own.append(b"")
                if doc_ids and (len(ids) + len(own) > BLOCK_TOKENS or len(doc_ids) == BLOCK_DOCS):
                    yield made(block, doc_ids, ids, sizes, flags, words)
                    block += 1
                    doc_ids, ids, sizes, flags, words = [], array("i"), [], [], _Ids()
                ids.extend(map(words.__getitem__, own))
                doc_ids.append(doc_id)
                sizes.append(len(own))
                flags.append(flag)
        if doc_ids:
            yield made(block, doc_ids, ids, sizes, flags, words)

    rows = docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string"), train)
    return rows.mapInArrow(of, "word string, block long, entries binary, ids array<long>")


@dataclass
class Totals:
    """What a sweep leaves for the next: tables of each restaurant, and the parent's two numbers; and what sliced words have in the parent."""

    tables: np.ndarray
    parent_customers: float
    parent_tables: float
    sliced_customers: np.ndarray
    sliced_tables: np.ndarray


@dataclass
class Corpus:
    """Training tokens N, distinct ones V, pairs of word and context, customers of each restaurant, and each sweep's totals."""

    n: int
    v: int
    pairs: int
    sliced: dict[bytes, int]
    sliced_counts: np.ndarray
    sliced_pairs: np.ndarray
    customers: np.ndarray | None = None
    sweeps: list[Totals] = field(default_factory=list)


def _stirling(discount: float) -> np.ndarray:
    """Logarithms of generalised Stirling numbers of c customers at t tables."""
    out = np.full((EXACT + 1, EXACT + 1), -np.inf)
    out[1, 1] = 0
    for c in range(1, EXACT):
        t = np.arange(1, c + 1)
        out[c + 1, 1:c + 1] = out[c, 1:c + 1] + np.log(c - discount * t)
        out[c + 1, 2:c + 2] = np.logaddexp(out[c + 1, 2:c + 2], out[c, 1:c + 1])
    return out


_STIRLING = {d: _stirling(d) for d in (D0, D1)}


def _uniform(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return ((x ^ (x >> np.uint64(31))) >> np.uint64(11)) * 2.0**-53


def seated(c: np.ndarray, prior: np.ndarray, discount: float, mass: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Tables of dishes with `c` customers, given the strength `mass` with which others' tables draw new ones.

    The chance of t tables is in proportion to a generalised Stirling number times, for
    each table, mass, a discount for each own table before, and the parent's `prior`. For more
    than EXACT customers the mean is carried on as a power of their number and rounded at random.
    """
    tables = np.minimum(c, 1).astype(np.float64)

    def chances(own: np.ndarray, size: int) -> np.ndarray:
        logs = np.cumsum(np.log((mass[own, None] + discount * np.arange(size)) * prior[own, None]), axis=1) + _STIRLING[discount][size, 1:size + 1]
        return np.exp(logs - logs.max(axis=1, keepdims=True))

    def pieces(at: np.ndarray, size: int) -> Iterator[np.ndarray]:
        step = max(1, (1 << 19) // size)
        return (at[i:i + step] for i in range(0, len(at), step))

    several = np.flatnonzero((c > 1) & (c <= EXACT))
    several = several[np.argsort(c[several], kind="stable")]
    sizes, first = np.unique(c[several], return_index=True)
    for size, at in zip(sizes.astype(int).tolist(), np.split(several, first[1:]), strict=False):
        for own in pieces(at, size):
            sums = np.cumsum(chances(own, size), axis=1)
            tables[own] = 1 + (sums > (_uniform(key[own]) * sums[:, -1])[:, None]).argmax(axis=1)
    for own in pieces(np.flatnonzero(c > EXACT), EXACT):
        half, whole = ((p * np.arange(1, p.shape[1] + 1)).sum(axis=1) / p.sum(axis=1) for p in (chances(own, EXACT // 2), chances(own, EXACT)))
        mean = whole * (c[own] / EXACT) ** np.log2(whole / half)
        tables[own] = np.clip(np.floor(mean + _uniform(key[own])), 1, c[own])
    return tables


def _places(words: list[str], corpus: Corpus) -> np.ndarray:
    """For each name its number among the sliced words, or -1."""
    out = np.full(len(words), -1)
    for i, w in enumerate(words):
        if " " in w:
            out[i] = corpus.sliced[w.rpartition(" ")[0].encode("utf-8", "surrogatepass")]
    return out


def _salt(s: int) -> np.uint64:
    return np.uint64(0x165667B19E3779F9 * (s + 1) & (1 << 64) - 1)


def parent_tables(customers: np.ndarray, before: np.ndarray, hashes: np.ndarray, corpus: Corpus, s: int) -> np.ndarray:
    """Tables of words in the parent at sweep s; `before` are those of the sweep before."""
    room = S0 + D0 * np.maximum(0, (corpus.sweeps[s - 1].parent_tables if s else 0) - before)
    return seated(customers, np.full(len(customers), 1 / (corpus.v + 1)), D0, room, hashes ^ _salt(s))


def sweeps(word: np.ndarray, ctx: np.ndarray, c: np.ndarray, words: list[str], corpus: Corpus, upto: int) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each sweep: tables of each pair, and customers and tables of each word in the parent.

    Of a sliced word these are the whole word's, except for the last sweep of all as long as its totals aren't known: there, customers are the slice's and tables 0.
    """
    out = []
    hashes, hot = _hashes(words), _places(words, corpus)
    cut = np.flatnonzero(hot >= 0)
    key = hashes[word] ^ (ctx.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))
    pairs = np.bincount(word, minlength=len(words)).astype(np.float64)
    pairs[cut] = corpus.sliced_pairs[hot[cut]]
    for s in range(upto + 1):
        if s == 0:
            parent, open_, above = pairs / max(corpus.pairs, 1), np.full(len(c), S1), np.zeros(len(words))
        else:
            last = corpus.sweeps[s - 1]
            own, theirs, above = out[-1]
            parent = predictive(theirs, above, last, corpus.v)
            open_ = S1 + D1 * np.maximum(0, last.tables[ctx] - own)
        t = seated(c, parent[word], D1, open_, key ^ _salt(s))
        customers = np.bincount(word, t, len(words))
        top = np.zeros(len(words))
        if s < len(corpus.sweeps):
            customers[cut], top[cut] = corpus.sweeps[s].sliced_customers[hot[cut]], corpus.sweeps[s].sliced_tables[hot[cut]]
        rest = np.flatnonzero(hot < 0)
        top[rest] = parent_tables(customers[rest], above[rest], hashes[rest], corpus, s)
        out.append((t, customers, top))
    return out


def predictive(customers: np.ndarray, tables: np.ndarray, totals: Totals, v: int) -> np.ndarray:
    """The parent's probability of words; of a word that it doesn't have, with zeros."""
    whole = S0 + totals.parent_customers
    return (customers - D0 * tables) / whole + (S0 + D0 * totals.parent_tables) / whole / (v + 1)


def _hashes(words: list[str]) -> np.ndarray:
    return np.array([xxhash.xxh3_64_intdigest(w.encode("utf-8", "surrogatepass")) for w in words], np.uint64)


def counted(tallied: DataFrame) -> DataFrame:
    """word, ctx, c: training counts of each word or slice in each of its contexts, as two arrays."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for words, _, owner, entries in whole_words(batches):
            n = np.where((entries >> (_N + _CTX)) & 1, entries & ((1 << _N) - 1), 0)
            word, ctx, c = _pairs(owner, entries, n)
            bounds = np.searchsorted(word, np.arange(len(words) + 1))
            has = np.flatnonzero(np.diff(bounds))
            for some in np.split(has, np.arange(10_000, len(has), 10_000)):
                if len(some):
                    offsets = np.r_[bounds[some], bounds[some[-1] + 1]].astype(np.int32)
                    lists = [pa.ListArray.from_arrays(pa.array(offsets - offsets[0]), pa.array(x[offsets[0]:offsets[-1]].astype(k))) for x, k in ((ctx, np.int32), (c, np.int64))]
                    yield pa.RecordBatch.from_arrays([pa.array([words[i] for i in some.tolist()], pa.string()), *lists], names=["word", "ctx", "c"])

    return tallied.where("word is not null").select("word", "block", "entries").mapInArrow(of, "word string, ctx array<int>, c array<long>")


def _pairs(owner: np.ndarray, entries: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word, context and summed count of the pairs that have one, in order."""
    own = n > 0
    key, where = np.unique((owner[own] << _CTX) | ((entries[own] >> _N) & ((1 << _CTX) - 1)), return_inverse=True)
    return key >> _CTX, key & ((1 << _CTX) - 1), np.bincount(where, n[own], len(key)).astype(np.int64)


def whole_words(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[str], np.ndarray, np.ndarray, np.ndarray]]:
    """Words, blocks of their rows, and for each entry its word and itself, for rows in order of word.

    A word's rows may lie in several batches; pieces end where a word ends.
    """
    held: list[pa.RecordBatch] = []
    size = 0

    def piece(rows: pa.Table) -> tuple:
        names = rows.column("word").combine_chunks()
        lens, entries = _unpacked(rows.column("entries").combine_chunks())
        coded = names.dictionary_encode()
        return coded.dictionary.to_pylist(), np.repeat(rows.column("block").to_numpy(), lens), np.repeat(coded.indices.to_numpy().astype(np.int64), lens), entries

    for batch in batches:
        held.append(batch)
        size += batch.column(2).nbytes // _BYTES
        if size > ENTRIES or sum(b.num_rows for b in held) > WORDS:
            rows = pa.Table.from_batches(held)
            last = rows.column("word")[-1].as_py()
            names = rows.column("word")
            cut = rows.num_rows
            while cut and names[cut - 1].as_py() == last:
                cut -= 1
            if cut:
                yield piece(rows.slice(0, cut))
            held = rows.slice(cut).to_batches()
            size = sum(b.column(2).nbytes // _BYTES for b in held)
    if held:
        yield piece(pa.Table.from_batches(held))


def to_bytes(counts: np.ndarray) -> bytes:
    """Whole numbers, none negative: a byte for their width, then 32 bits each, or 64 where one needs them."""
    kind = np.uint32 if counts.max(initial=0) < 1 << 32 else np.uint64
    return bytes([np.dtype(kind).itemsize]) + counts.astype(kind).tobytes()


def from_bytes(x: bytes) -> np.ndarray:
    return np.frombuffer(x, np.uint32 if x[0] == 4 else np.uint64, offset=1).astype(np.int64)


def compact(counts: np.ndarray) -> np.ndarray:
    """Whole numbers, none negative, in the narrowest type that holds them: all tasks are sent these."""
    return counts.astype(np.min_scalar_type(int(counts.max(initial=0))))


def totals(counts: DataFrame, sliced: dict[bytes, int]) -> Corpus:
    """The corpus's sums and those of each sweep.

    A restaurant's sums come from all tasks, each of which sends a row for each part of
    the places; the driver gets CONTEXTS numbers, and one for each sliced word.
    """
    spark = counts.sparkSession
    each = counts.select("word", F.aggregate("c", F.lit(0).cast("long"), lambda a, x: a + x).alias("n"), F.size("c").cast("long").alias("pairs"))
    head = each.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count(F.when(~F.col("word").contains(" "), 1)).alias("v"), F.coalesce(F.sum("pairs"), F.lit(0)).alias("pairs")).first()
    hot = each.where(F.col("word").contains(" ")).groupBy(F.substring_index("word", " ", 1).alias("word")).agg(F.sum("n").alias("n"), F.sum("pairs").alias("pairs")).collect()
    corpus = Corpus(head["n"], head["v"] + len(hot), head["pairs"], sliced, np.zeros(len(sliced)), np.zeros(len(sliced)))
    for r in hot:
        i = sliced[r["word"].encode("utf-8", "surrogatepass")]
        corpus.sliced_counts[i], corpus.sliced_pairs[i] = r["n"], r["pairs"]
    names = [w.decode("utf-8", "surrogatepass") for w in sliced]
    for s in range(SWEEPS):
        shared = spark.sparkContext.broadcast(corpus)
        parts = 512

        def of(batches: Iterator[pa.RecordBatch], s=s, shared=shared) -> Iterator[pa.RecordBatch]:
            corpus = shared.value
            customers, tables = np.zeros(CONTEXTS, np.int64), np.zeros(CONTEXTS, np.int64)
            parent, cut = np.zeros(2), np.zeros(len(corpus.sliced))
            any_ = False
            for batch in batches:
                lens = np.diff(batch.column(1).offsets.to_numpy())
                word, ctx, c = np.repeat(np.arange(len(lens)), lens), batch.column(1).flatten().to_numpy().astype(np.int64), batch.column(2).flatten().to_numpy()
                if not len(word):
                    continue
                any_, words = True, batch.column(0).to_pylist()
                t, own, top = sweeps(word, ctx, c, words, corpus, s)[-1]
                np.add.at(tables, ctx, t.astype(np.int64))
                if s == 0:
                    np.add.at(customers, ctx, c.astype(np.int64))
                hot = _places(words, corpus)
                parent += own[hot < 0].sum(), top[hot < 0].sum()
                np.add.at(cut, hot[hot >= 0], own[hot >= 0])
            if any_:
                rows = [(k, to_bytes((customers if s == 0 else tables[:0])[k::parts]), to_bytes(tables[k::parts])) for k in range(parts)]
                rows.append((-1, parent.tobytes(), cut.tobytes()))
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), (pa.int32(), pa.binary(), pa.binary()), strict=True)], names=["part", "a", "b"])

        def summed_up(group: pa.Table) -> pa.Table:
            k = group.column("part")[0].as_py()
            if k < 0:
                a, b = (np.sum([np.frombuffer(x) for x in group.column(c).to_pylist()], axis=0).tobytes() for c in ("a", "b"))
            else:
                a, b = (to_bytes(np.sum([from_bytes(x) for x in group.column(c).to_pylist()], axis=0, dtype=np.int64)) for c in ("a", "b"))
            return pa.table({"part": pa.array([k], pa.int32()), "a": pa.array([a], pa.binary()), "b": pa.array([b], pa.binary())})

        found = counts.mapInArrow(of, "part int, a binary, b binary").groupBy("part").applyInArrow(summed_up, "part int, a binary, b binary").toArrow()
        customers, tables, parent, cut = np.zeros(CONTEXTS, np.int64), np.zeros(CONTEXTS, np.int64), np.zeros(2), np.zeros(len(sliced))
        for k, a, b in zip(*(c.to_pylist() for c in found.columns), strict=True):
            if k < 0:
                parent, cut = np.frombuffer(a, np.float64).copy(), np.frombuffer(b, np.float64).copy()
            else:
                tables[k::parts] = from_bytes(b)
                if s == 0:
                    customers[k::parts] = from_bytes(a)
        if s == 0:
            corpus.customers = compact(customers)
        before = corpus.sweeps[s - 1].sliced_tables if s else np.zeros(len(sliced))
        top = parent_tables(cut, before, _hashes(names), corpus, s)
        corpus.sweeps.append(Totals(compact(tables), parent[0] + cut.sum(), parent[1] + top.sum(), cut, top))
    return corpus


def pair_probabilities(words: list[str], word: np.ndarray, ctx: np.ndarray, c: np.ndarray, corpus: Corpus) -> tuple[np.ndarray, list[np.ndarray]]:
    """Averaged probability of each pair, and for each sample the parent's probability of each word."""
    own = np.zeros(len(word))
    parents = []
    state = sweeps(word, ctx, c, words, corpus, SWEEPS - 1)
    for s in range(SWEEPS - SAMPLES, SWEEPS):
        t, customers, top = state[s]
        parents.append(predictive(customers, top, corpus.sweeps[s], corpus.v))
        own += after(ctx, parents[-1][word], c - D1 * t, corpus, s) / SAMPLES
    return own, parents


def after(ctx: np.ndarray, parent: np.ndarray, seats: np.ndarray | float, corpus: Corpus, s: int) -> np.ndarray:
    """Probability behind contexts: of the own seats, and of the parent by the context's tables."""
    customers = S1 + corpus.customers[ctx].astype(np.float64)
    return (seats + (S1 + D1 * corpus.sweeps[s].tables[ctx].astype(np.float64)) * parent) / customers


def scored_parts(tallied: DataFrame, corpus: Corpus) -> DataFrame:
    """block and, for its documents as arrays, sums of tokens, known ones, and both scores; each partition adds its words."""
    shared = tallied.sparkSession.sparkContext.broadcast(corpus)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        corpus, held, size = shared.value, [], 0
        for words, block, owner, entries in whole_words(batches):
            n = entries & ((1 << _N) - 1)
            learnt = np.where((entries >> (_N + _CTX)) & 1, n, 0)
            ctx, doc = (entries >> _N) & ((1 << _CTX) - 1), entries >> (_N + _CTX + 1)
            word, pair_ctx, c = _pairs(owner, entries, learnt)
            count, hot = np.bincount(word, c, len(words)), _places(words, corpus)
            count[hot >= 0] = corpus.sliced_counts[hot[hot >= 0]]
            known, parents = pair_probabilities(words, word, pair_ctx, c, corpus)
            p = sum(after(ctx, q[owner], 0.0, corpus, SWEEPS - SAMPLES + k) for k, q in enumerate(parents)) / SAMPLES
            if len(word):
                pair = (word << _CTX) | pair_ctx
                mine = (owner << _CTX) | ctx
                place = np.minimum(np.searchsorted(pair, mine), len(pair) - 1)
                p = np.where(pair[place] == mine, known[place], p)
            base = np.log10((count[owner] + 1) / (corpus.n + corpus.v + 1))
            held.append(_by_document(block, doc, n, n * (count[owner] > 0), n * base, n * np.log10(p)))
            size += len(held[-1][0])
            if size > SUMS:  # documents come again with other words; sums go when there are too many of them, not of their parts
                held = [_by_document(*(np.concatenate(c) for c in zip(*held, strict=True)))]
                size = len(held[0][0])
                if size > SUMS // 2:
                    yield _batch(held[0])
                    held, size = [], 0
        if held:
            yield _batch(_by_document(*(np.concatenate(c) for c in zip(*held, strict=True))))

    return tallied.where("word is not null").select("word", "block", "entries").mapInArrow(of, "block long, doc array<long>, n_tokens array<long>, n_known array<long>, base array<double>, score array<double>")


def _by_document(block, doc, n, known, base, score) -> tuple[np.ndarray, ...]:
    order = np.lexsort((doc, block)) if len(block) else np.zeros(0, np.int64)
    block, doc = block[order], doc[order]
    first = np.flatnonzero(np.r_[True, (block[1:] != block[:-1]) | (doc[1:] != doc[:-1])][: len(block)])
    sums = [np.add.reduceat(x[order], first) if len(first) else x for x in (n, known, base, score)]
    return block[first], doc[first], *sums


def _batch(cols: tuple[np.ndarray, ...]) -> pa.RecordBatch:
    """A row for each block, with its documents and their sums as arrays."""
    block = cols[0]
    first = np.flatnonzero(np.r_[True, block[1:] != block[:-1]][: len(block)])
    offsets = pa.array(np.r_[first, len(block)].astype(np.int32))
    lists = [pa.ListArray.from_arrays(offsets, pa.array(c.astype(k))) for c, k in zip(cols[1:], _KINDS, strict=True)]
    return pa.RecordBatch.from_arrays([pa.array(block[first].astype(np.int64)), *lists], names=["block", *_SUMS])


def summed(parts: DataFrame) -> DataFrame:
    """block, doc and a document's whole sums; a block's rows lie in one partition, one behind the other."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, sums = None, np.zeros((4, 0))
        for batch in batches:
            cols = [batch.column(i) for i in range(6)]
            for i, block in enumerate(cols[0].to_pylist()):
                if block != now:
                    if now is not None:
                        yield done(now, sums)
                    now, sums = block, np.zeros((4, 0))
                doc, *own = (c[i].values.to_numpy() for c in cols[1:])
                if doc.max() >= sums.shape[1]:
                    sums = np.pad(sums, ((0, 0), (0, int(doc.max()) + 1 - sums.shape[1])))
                for k, x in enumerate(own):
                    sums[k, doc] += x
        if now is not None:
            yield done(now, sums)

    def done(block: int, sums: np.ndarray) -> pa.RecordBatch:
        doc = np.arange(sums.shape[1])
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(doc), block)), *(pa.array(c.astype(k)) for c, k in zip((doc, *sums), _KINDS, strict=True))], names=["block", *_SUMS])

    n = int(parts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return parts.repartition(n, "block").sortWithinPartitions("block").mapInArrow(of, "block long, doc long, n_tokens long, n_known long, base double, score double")


def _learnt(docs: DataFrame, id_col: str, text_col: str, modulus: int, held: int) -> tuple[DataFrame, DataFrame, Corpus]:
    """The tally of all documents, the training counts, and the sampled model's totals."""
    train = id_remainder(F.col(id_col), modulus) != held
    sliced = frequent_words(docs, id_col, text_col)
    rows = tally(docs, id_col, text_col, train, sliced)
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # Ids' rows have no word; their block deals them out.
    dealt = rows.repartition(parts, F.coalesce("word", F.concat(F.lit("  "), F.col("block").cast("string")))).sortWithinPartitions("word", "block")
    tallied = saved(dealt, "lm-tally", "zstd")
    counts = saved(counted(tallied), "lm-counts", "zstd")
    return tallied, counts, totals(counts, sliced)


def seating(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", modulus: int = 7, held: int = 2) -> list[tuple[DataFrame, DataFrame]]:
    """For each averaged sweep, (ctx, word, tables) of all restaurants and (word, tables) of their parent."""
    _, counts, corpus = _learnt(docs, id_col, text_col, modulus, held)
    shared = docs.sparkSession.sparkContext.broadcast(corpus)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lens = np.diff(batch.column(1).offsets.to_numpy())
            words, word = batch.column(0).to_pylist(), np.repeat(np.arange(len(lens)), lens)
            ctx, c = batch.column(1).flatten().to_numpy().astype(np.int64), batch.column(2).flatten().to_numpy()
            names = pa.array([w.rpartition(" ")[0] if " " in w else w for w in words], pa.string())
            for s, (t, _, top) in enumerate(sweeps(word, ctx, c, words, shared.value, SWEEPS - 1)):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(word), s)), names.take(pa.array(word)), pa.array(ctx), pa.array(t)], names=["sweep", "word", "ctx", "tables"])
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(words), s)), names, pa.nulls(len(words), pa.int64()), pa.array(top)], names=["sweep", "word", "ctx", "tables"])

    found = saved(counts.mapInArrow(of, "sweep long, word string, ctx long, tables double"), "lm-seats")
    out = []
    for s in range(SWEEPS - SAMPLES, SWEEPS):
        own = found.where(F.col("sweep") == s)
        out.append((own.where("ctx is not null").select("ctx", "word", "tables"), own.where("ctx is null").groupBy("word").agg(F.max("tables").alias("tables"))))
    return out


def lm_scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", modulus: int = 7, held: int = 2) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, perplexity for every row.

    Learns from rows whose crc32(id) mod `modulus` isn't `held`. A null text counts as
    empty and has one token, its end. Rows that repeat an id are documents of their own.
    Without training rows every word is the unknown one. An empty table gives no rows;
    further columns are not read.
    """
    tallied, counts, corpus = _learnt(docs, id_col, text_col, modulus, held)
    discard(counts)
    sums = summed(scored_parts(tallied, corpus))
    ids = tallied.where("word is null").select("block", F.posexplode("ids").alias("doc", "doc_id"))
    found = ids.select("block", F.col("doc").cast("long").alias("doc"), "doc_id").hint("merge").join(sums.hint("merge"), ["block", "doc"])
    return found.select(
        "doc_id", (id_remainder(F.col("doc_id"), modulus) == held).alias("held_out"), "n_tokens", "n_known",
        F.lit(corpus.n).cast("long").alias("train_tokens"), F.col("base").alias("base_score"), "score",
        F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")).alias("perplexity"))


def op8_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scores(table(spark, sf_dir, "documents"))
