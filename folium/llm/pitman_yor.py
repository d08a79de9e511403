"""Language-model scoring with a hierarchical Pitman-Yor model of word pairs.

Every context is a Chinese restaurant of its own.  A table of a context
restaurant is a customer of the shared parent, the restaurant of single words,
whose base gives half its mass to the one unknown word and the rest evenly to
the known.

Seating is sampled by Gibbs sweeps: in a sweep, all customers of a dish leave
and are seated again one after another (the first SINGLE one at a time, the
rest in blocks that grow with the number seated) given the tables of the other
dishes as of the sweep before.  After BURN_IN sweeps, predictive probabilities
are averaged over SAMPLES sweeps.

Spark deals the corpus out by word, pairs of a frequent word (at least one in
CONTEXT_SHARE tokens) by their context: one bucket holds all there is of its
words, so counting, seating and scoring are work on arrays.  Between sweeps,
sums over frequent contexts and words go through the driver: there are at most
CONTEXT_SHARE of them.  Those over all other contexts meet in a shuffle and
come back to the buckets that ask for them; the buckets' table stays where it
is.  A sweep replays those before it from the same seeds, so nothing but these
sums is kept and a lost task can run again.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folium.llm.common import bucket_count, scratch, written

CONTEXT_SHARE = 65_000
BURN_IN, SAMPLES = 2, 2
LAST = BURN_IN + SAMPLES - 1
#: Discount and strength of the context restaurants and of the parent.
DISCOUNT, STRENGTH = 0.75, 2.0
PARENT_DISCOUNT, PARENT_STRENGTH = 0.6, 5.0
UNKNOWN = 0.5
SINGLE = 48
#: Pairs that a task scores at a time.
PAIRS = 200_000
#: Tokens gathered by a task before it hands them on: counts, then pairs.
VOCABULARY_CHUNK, CHUNK = 1_000_000, 500_000
WORDS = 200_000
#: Bytes of text that one bucket of words stands for at most.
BUCKET_BYTES = 32 << 20
SEED = 7

_END = xxhash.xxh64_intdigest(b"end of text")  # no word has a space
_BEGIN = xxhash.xxh64_intdigest(b"begin of text")
#: The place of a context that isn't frequent.
_FAR = 65_535
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


class WordKeys(dict):
    """Word to its hash."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= WORDS:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value


def tokens(text: str | None, known: WordKeys) -> np.ndarray:
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    out = np.empty(len(words) + 1, np.uint64)
    out[:-1] = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
    out[-1] = _END
    return out


def _zip(x: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(x).tobytes())


def _unzip(data: bytes, kind) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(data, max_output_size=1 << 31), kind)


def _zip_keys(x: np.ndarray) -> bytes:
    """Ascending hashes, as the bytes of their differences, the highest first
    of all."""
    return _zip(np.diff(x, prepend=np.uint64(0)).view(np.uint8).reshape(-1, 8).T)


def _unzip_keys(data: bytes) -> np.ndarray:
    return np.cumsum(np.ascontiguousarray(_unzip(data, np.uint8).reshape(8, -1).T).view(np.uint64)[:, 0], dtype=np.uint64)


def _rows(batch: pa.RecordBatch) -> Iterator[dict]:
    """Rows one at a time, whose binary values stay where the batch has them."""
    columns = dict(zip(batch.schema.names, batch.columns, strict=True))
    for i in range(batch.num_rows):
        yield {c: None if not x[i].is_valid else x[i].as_buffer() if pa.types.is_binary(x.type) else x[i].as_py() for c, x in columns.items()}


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _A
    return (x ^ (x >> np.uint64(29))) * _B >> np.uint64(8)


# -- vocabulary


def _vocabulary(buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, waiting, n = WordKeys(), [], 0

        def flush() -> pa.RecordBatch:
            words, counts = np.unique(np.concatenate(waiting), return_counts=True)
            to = (_mixed(words) % np.uint64(buckets)).astype(np.int32)
            order = np.argsort(to, kind="stable")
            ends = np.searchsorted(to[order], np.arange(buckets + 1))
            rows = [(b, _zip_keys(words[order[i:j]]), _zip(counts[order[i:j]])) for b, (i, j) in enumerate(zip(ends[:-1], ends[1:], strict=True)) if i < j]
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int32(), pa.binary(), pa.binary()))], names=["bucket", "words", "counts"])

        for batch in batches:
            for text in batch.column("text"):
                waiting.append(tokens(text.as_py(), known))
                n += len(waiting[-1])
                if n >= VOCABULARY_CHUNK:
                    yield flush()
                    waiting, n = [], 0
        if waiting:
            yield flush()

    return run


def _summed(table: pa.Table) -> pa.Table:
    rows = table.to_pylist()
    words = np.concatenate([_unzip_keys(r["words"]) for r in rows])
    counts = np.concatenate([_unzip(r["counts"], np.int64) for r in rows])
    kinds, of = np.unique(words, return_inverse=True)
    total = np.bincount(of, weights=counts).astype(np.int64)
    return pa.table({"words": pa.array([_zip_keys(kinds)], pa.binary()), "counts": pa.array([_zip(total)], pa.binary()), "types": pa.array([len(kinds)], pa.int64()), "tokens": pa.array([int(total.sum())], pa.int64())})


def _frequent(least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                words, counts = _unzip_keys(row["words"]), _unzip(row["counts"], np.int64)
                many = counts >= least
                yield pa.RecordBatch.from_arrays([pa.array(words[many].view(np.int64)), pa.array(counts[many])], names=["word", "count"])

    return run


# -- the corpus dealt out by word


@dataclass
class Plan:
    """What all tasks know: of the corpus, its sizes and frequent words; of the
    sweeps so far, the sums over contexts and frequent words."""

    buckets: int
    tokens: int
    types: int
    frequent: np.ndarray  # sorted
    frequent_counts: np.ndarray
    customers: np.ndarray | None = None  # of each frequent context
    tables: list[np.ndarray] = field(default_factory=list)  # of each frequent context, by sweep
    all_tables: list[float] = field(default_factory=list)  # of all contexts
    word_customers: list[np.ndarray] = field(default_factory=list)  # of each frequent word in the parent
    word_tables: list[np.ndarray] = field(default_factory=list)
    parent_tables: list[float] = field(default_factory=list)

    @property
    def contexts(self) -> int:
        """Those that are frequent, and the begin of a text."""
        return len(self.frequent) + 1

    def find(self, words: np.ndarray) -> np.ndarray:
        """Place among the frequent words, or -1."""
        if not len(self.frequent):
            return np.full(len(words), -1)
        at = np.minimum(np.searchsorted(self.frequent, words), len(self.frequent) - 1)
        return np.where(self.frequent[at] == words, at, -1)

    def base(self, known: np.ndarray) -> np.ndarray:
        return np.where(known, (1 - UNKNOWN) / max(self.types, 1), UNKNOWN)


_DEALT = pa.schema([("bucket", pa.int32()), ("words", pa.binary()), ("word_at", pa.binary()), ("contexts", pa.binary()), ("far", pa.binary()), ("far_at", pa.binary()), ("counts", pa.binary()), ("chunk", pa.int64()), ("doc_at", pa.binary()), ("doc_entries", pa.binary()), ("learn", pa.binary()), ("doc_ids", pa.list_(pa.int64())), ("n_tokens", pa.binary())])
_DEALT_DDL = "bucket int, words binary, word_at binary, contexts binary, far binary, far_at binary, counts binary, chunk bigint, doc_at binary, doc_entries binary, learn binary, doc_ids array<bigint>, n_tokens binary"


def _deal(plan: Plan):
    """Each document's pairs of context and word, by bucket of the word.  A
    document is known by its chunk, a hash of what the chunk holds, and its
    place there, which takes far less room than a key in each bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, turn = WordKeys(), 0
        docs: list[tuple] = []
        gathered = 0

        def flush() -> pa.RecordBatch:
            words = np.concatenate([d[3] for d in docs])
            lengths = np.array([len(d[3]) for d in docs])
            owner = np.repeat(np.arange(len(docs), dtype=np.uint64), lengths)
            before = np.empty_like(words)
            before[1:] = words[:-1]
            before[np.r_[0, np.cumsum(lengths)[:-1]]] = _BEGIN
            _, first, counts = np.unique(_mixed(words + before * _B) ^ owner * _A, return_index=True, return_counts=True)
            words, before, owner = words[first], before[first], owner[first].astype(np.int64)
            at = plan.find(before)
            context = np.where(at >= 0, at, np.where(before == np.uint64(_BEGIN), len(plan.frequent), _FAR)).astype(np.uint16)
            by = np.where(plan.find(words) < 0, words, np.where(context == _FAR, before, words + before * _A))
            to = (_mixed(by) % np.uint64(plan.buckets)).astype(np.int64)
            order = np.argsort(to * len(docs) + owner)
            words, before, context, owner, counts, to = (x[order] for x in (words, before, context, owner, counts, to))
            ends = np.searchsorted(to, np.arange(plan.buckets + 1))
            chunk = int(np.uint64(xxhash.xxh3_64_intdigest(b"".join(d[1] for d in docs))).astype(np.int64))
            learn = np.array([d[2] for d in docs], dtype=np.uint8)
            rows = [(turn % plan.buckets, None, None, None, None, None, None, chunk, None, None, _zip(learn), [d[0] for d in docs], _zip(lengths.astype(np.int64)))]
            for b in range(plan.buckets):
                i, j = ends[b], ends[b + 1]
                if i < j:
                    kinds, of = np.unique(words[i:j], return_inverse=True)
                    far, far_at = np.unique(before[i:j][context[i:j] == _FAR], return_inverse=True)
                    who, n = np.unique(owner[i:j], return_counts=True)
                    rows.append((b, _zip_keys(kinds), _zip(of.astype(np.uint32)), _zip(context[i:j]), _zip_keys(far), _zip(far_at.astype(np.uint32)), _zip(counts[i:j].astype(np.uint32)), chunk, _zip(np.diff(who, prepend=0).astype(np.int32)), _zip(n.astype(np.uint32)), _zip(learn[who]), None, None))
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(_DEALT)], schema=_DEALT)

        for batch in batches:
            for doc_id, text, held_out in zip(batch.column("doc_id").to_pylist(), batch.column("text"), batch.column("held_out").to_pylist(), strict=True):
                said = text.as_py() or ""
                docs.append((doc_id, xxhash.xxh3_128_digest(f"{doc_id} {said}".encode("utf-8", "surrogatepass")), not held_out, tokens(said, known)))
                gathered += len(docs[-1][3])
                if gathered >= CHUNK:
                    yield flush()
                    docs, gathered, turn = [], 0, turn + 1
        if docs:
            yield flush()

    return run


_SEATED = pa.schema([("kind", pa.string()), ("bucket", pa.int32()), ("words", pa.binary()), ("pairs", pa.binary()), ("contexts", pa.binary()), ("far", pa.binary()), ("far_at", pa.binary()), ("counts", pa.binary()), ("chunk", pa.int64()), ("chunks", pa.binary()), ("chunk_docs", pa.binary()), ("doc_at", pa.binary()), ("entry_docs", pa.binary()), ("entry_counts", pa.binary()), ("pair_entries", pa.binary()), ("learn", pa.binary()), ("doc_ids", pa.list_(pa.int64())), ("n_tokens", pa.binary())])
_SEATED_DDL = "kind string, bucket int, words binary, pairs binary, contexts binary, far binary, far_at binary, counts binary, chunk bigint, chunks binary, chunk_docs binary, doc_at binary, entry_docs binary, entry_counts binary, pair_entries binary, learn binary, doc_ids array<bigint>, n_tokens binary"


def _gather(table: pa.Table) -> pa.Table:
    """A bucket's words, their pairs with training counts, and where each pair
    is; rows of documents pass.  Words, contexts and documents are numbers
    within the bucket, so an entry is sixteen bytes."""
    every = lambda c: np.unique(np.concatenate([np.empty(0, np.uint64), *(_unzip_keys(x.as_buffer()) for x in table.column(c) if x.is_valid)]))
    kinds, others = every("words"), every("far")
    out, keys, counts, docs, learn, places, chunks, held = [], [], [], [], [], [], [], 0
    for batch in table.to_batches(max_chunksize=64):  # what has been read can go
        for r in _rows(batch):
            if r["words"] is None:
                out.append(("docs", r["bucket"], None, None, None, None, None, None, r["chunk"], None, None, None, None, None, None, r["learn"].to_pybytes(), r["doc_ids"], r["n_tokens"].to_pybytes()))
                continue
            n = _unzip(r["doc_entries"], np.uint32)
            place = _unzip(r["contexts"], np.uint16).astype(np.uint64)
            place[place == _FAR] = (_FAR + 1 + np.searchsorted(others, _unzip_keys(r["far"])).astype(np.uint64))[_unzip(r["far_at"], np.uint32)]
            word = np.searchsorted(kinds, _unzip_keys(r["words"])).astype(np.uint64)[_unzip(r["word_at"], np.uint32)]
            keys.append(word << np.uint64(32) | place)
            counts.append(_unzip(r["counts"], np.uint32))
            docs.append(np.repeat(np.arange(held, held + len(n), dtype=np.uint32), n))
            learn.append(_unzip(r["learn"], np.uint8))
            places.append(np.cumsum(_unzip(r["doc_at"], np.int32)))
            chunks.append((r["chunk"], len(n)))
            held += len(n)
    if keys:
        bucket, key = table.column("bucket")[0].as_py(), np.concatenate(keys)
        del table, keys
        order = np.argsort(key, kind="stable")
        key = key[order]
        starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        key, n = key[starts], len(key)
        count, doc = np.concatenate(counts)[order], np.concatenate(docs)[order]
        del order, counts, docs
        pair_counts = np.add.reduceat(count * np.concatenate(learn)[doc].astype(np.int64), starts)
        pairs = np.bincount((key >> np.uint64(32)).astype(np.int64))
        place = (key & np.uint64(0xFFFFFFFF)).astype(np.int64)
        own, chunk_docs = (np.array(x, np.int64) for x in zip(*chunks, strict=True))
        out.append(("words", bucket, _zip_keys(kinds), _zip(pairs.astype(np.uint32)), _zip(np.minimum(place, _FAR).astype(np.uint16)), _zip_keys(others), _zip((place[place > _FAR] - _FAR - 1).astype(np.uint32)), _zip(pair_counts), None, own.tobytes(), _zip(chunk_docs), _zip(np.diff(np.concatenate(places), prepend=0).astype(np.int32)), _zip(doc), _zip(count), _zip(np.diff(np.r_[starts, n]).astype(np.uint32)), None, None, None))
    return pa.table([pa.array([r[k] for r in out], f.type) for k, f in enumerate(_SEATED)], schema=_SEATED)


# -- seating


def seat(customers: np.ndarray, prior: np.ndarray, tables_elsewhere: np.ndarray, discount: float, strength: float, rng: np.random.Generator) -> np.ndarray:
    """Tables that customers of one dish take when they enter a restaurant one
    after another, where tables_elsewhere of other dishes stand: a new table
    with weight prior * (strength + discount * tables), one of theirs with
    (seated - discount * own tables)."""
    out = np.minimum(customers, 1).astype(float)
    many = np.flatnonzero(customers >= 2)
    if not len(many):
        return out
    many = many[np.argsort(-customers[many], kind="stable")]
    c, p, other = customers[many], prior[many], tables_elsewhere[many]
    t = np.ones(len(many))
    seated, live = 1, len(many)
    most = int(c[0])
    while seated < most:
        step = 1 if seated < SINGLE else max(1, seated // 8)
        live = int(np.searchsorted(-c[:live], -seated, side="left"))  # those with more customers than seated
        if not live:
            break
        n = np.minimum(step, c[:live] - seated)
        fresh = p[:live] * (strength + discount * (other[:live] + t[:live]))
        chance = fresh / (np.maximum(seated + (n - 1) / 2 - discount * t[:live], 1e-9) + fresh)
        t[:live] += rng.random(live) < chance if step == 1 else rng.binomial(n, np.minimum(chance, 1))
        seated += step
    out[many] = t
    return out


class Bucket:
    """The restaurants' part that one bucket of words is."""

    def __init__(self, row: dict, plan: Plan) -> None:
        self.plan, self.number = plan, row["bucket"]
        self.words = _unzip_keys(row["words"])
        pairs = _unzip(row["pairs"], np.uint32)
        self.word_of = np.repeat(np.arange(len(self.words), dtype=np.int32), pairs)
        self.context = _unzip(row["contexts"], np.uint16).astype(np.int32)
        self.far = _unzip_keys(row["far"])  # contexts that aren't frequent, after those that are
        self.context[self.context == _FAR] = plan.contexts + _unzip(row["far_at"], np.uint32)
        self.count = _unzip(row["counts"], np.int64)
        self.often = plan.find(self.words)
        own = np.bincount(self.word_of, weights=self.count, minlength=len(self.words))
        self.word_count = np.where(self.often >= 0, plan.frequent_counts[self.often] if len(plan.frequent) else 0, own)
        self.base = plan.base(self.word_count > 0)
        moving = np.zeros(len(self.far), bool)
        self.many = np.flatnonzero(self.count >= 2)
        several = self.context[self.many] - plan.contexts
        moving[several[several >= 0]] = True  # a pair seen once has one table in each sweep
        self.moving, self.everyone = self._homes(np.flatnonzero(moving)), self._homes(np.arange(len(self.far)))
        self.pairs_of_far, self.customers_of_far = np.zeros((2, len(self.far)))
        self.far_tables: dict[int, np.ndarray] = {}
        for told in sorted(row["told"] or (), key=lambda x: x["sweep"]):
            s, got = told["sweep"], _unzip(told["values"], np.int64)
            at, ends = self.moving if 0 < s < LAST else self.everyone
            at = at[ends[told["part"]] : ends[told["part"] + 1]]
            got = got.reshape(-1, len(at))
            if s == 0:
                self.pairs_of_far[at], self.customers_of_far[at] = got
            else:
                for k, more in zip(range(BURN_IN, LAST + 1) if s == LAST else (s,), got, strict=True):
                    self.far_tables.setdefault(k, self.pairs_of_far.copy())[at] = self.pairs_of_far[at] + more

    def _homes(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of far contexts by the part that sums them up, and where
        each part starts."""
        home = (_mixed(self.far[at]) % np.uint64(self.plan.buckets)).astype(np.int64)
        order = np.argsort(home, kind="stable")
        return at[order], np.searchsorted(home[order], np.arange(self.plan.buckets + 1))

    def context_tables(self, sweep: int) -> np.ndarray:
        return np.r_[self.plan.tables[sweep], self.far_tables.get(sweep, self.pairs_of_far)]

    def of_far(self, weights: np.ndarray) -> np.ndarray:
        return np.bincount(self.context, weights=weights, minlength=self.plan.contexts + len(self.far))[self.plan.contexts :]

    def in_parent(self, tables: np.ndarray, sweep: int, before: np.ndarray | None, rng: np.random.Generator, frequent_too: bool) -> tuple[np.ndarray, np.ndarray]:
        """Customers and tables of each word in the parent restaurant."""
        plan = self.plan
        customers = np.bincount(self.word_of, weights=tables, minlength=len(self.words))
        elsewhere = (plan.parent_tables[sweep - 1] if sweep else 0.5 * plan.types) - (before if before is not None else 0)
        seats = seat(customers.astype(np.int64), self.base, np.maximum(elsewhere, 0) * np.ones(len(customers)), PARENT_DISCOUNT, PARENT_STRENGTH, rng)
        if frequent_too and len(plan.frequent):
            often = self.often >= 0
            customers = np.where(often, plan.word_customers[sweep][self.often], customers)
            seats = np.where(often, plan.word_tables[sweep][self.often], seats)
        return customers, seats

    def parent(self, customers: np.ndarray, seats: np.ndarray, sweep: int) -> np.ndarray:
        """Predictive probability of each word in the parent restaurant."""
        plan = self.plan
        return (np.maximum(customers - PARENT_DISCOUNT * seats, 0) + (PARENT_STRENGTH + PARENT_DISCOUNT * plan.parent_tables[sweep]) * self.base) / (PARENT_STRENGTH + plan.all_tables[sweep])

    def sweeps(self, last: int, complete: bool) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """Sweep, tables of each pair, customers and tables of each word in the
        parent.  complete: sums of the last sweep are there as well."""
        plan, tables, seats, chance = self.plan, None, None, None
        for s in range(last + 1):
            rng = np.random.default_rng([SEED, s, self.number])
            if s == 0:
                tables = np.minimum(self.count, 1).astype(float)
            else:
                tables, at = tables.copy(), self.many
                elsewhere = np.maximum(self.context_tables(s - 1)[self.context[at]] - tables[at], 0)
                tables[at] = seat(self.count[at], chance[self.word_of[at]], elsewhere, DISCOUNT, STRENGTH, rng)
            done = s < last or complete
            customers, seats = self.in_parent(tables, s, seats, rng, done)
            if done:
                chance = self.parent(customers, seats, s)
            yield s, tables, customers, seats


_SENT = pa.schema([("to", pa.int32()), ("kind", pa.string()), ("bucket", pa.int32()), ("at", pa.binary()), ("values", pa.binary())])
_SENT_DDL = "to int, kind string, bucket int, at binary, values binary"
_TOLD_DDL = "kind string, bucket int, part int, at binary, values binary"


def _sums(plan: Plan, sweep: int):
    """Sums of a sweep: tables and customers of each frequent context,
    customers of each frequent word in the parent, tables of the other words
    there and of all contexts; of each other context its pairs and customers
    (the first sweep) or the tables that its pairs have beyond one."""

    def sent(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(_SENT)], schema=_SENT)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of_context, customers, of_word, rest = np.zeros(plan.contexts), np.zeros(plan.contexts), np.zeros(max(1, len(plan.frequent))), np.zeros(2)
        for batch in batches:
            for row in _rows(batch):
                bucket, beyond = Bucket(row, plan), []
                for s, tables, in_parent, seats in bucket.sweeps(sweep, complete=False):
                    if s == sweep or sweep == LAST and s >= BURN_IN:
                        beyond.append(bucket.of_far(tables - (bucket.count > 0)))
                    if s == sweep:
                        of_context += np.bincount(bucket.context, weights=tables, minlength=plan.contexts)[: plan.contexts]
                        customers += np.bincount(bucket.context, weights=bucket.count, minlength=plan.contexts)[: plan.contexts]
                        often = bucket.often >= 0
                        of_word += np.bincount(bucket.often[often], weights=in_parent[often], minlength=len(of_word))
                        rest += seats[~often].sum(), tables.sum()
                values = [bucket.of_far(bucket.count > 0), bucket.of_far(bucket.count)] if sweep == 0 else beyond
                at, ends = bucket.moving if 0 < sweep < LAST else bucket.everyone
                rows = [(p, "far", bucket.number, _zip_keys(bucket.far[at[i:j]]), _zip(np.concatenate([v[at[i:j]] for v in values]).astype(np.int64))) for p, (i, j) in enumerate(zip(ends[:-1], ends[1:], strict=True)) if i < j]
                if rows:
                    yield sent(rows)
        rows = []
        for kind, values in (("tables", of_context), ("customers", customers), ("words", of_word), ("rest", rest)):
            at = np.flatnonzero(values)
            for p in range(min(plan.buckets, 16)):
                own = at[at % min(plan.buckets, 16) == p]
                if len(own):
                    rows.append((p, kind, None, _zip(own), _zip(values[own].astype(np.int64))))
        if rows:
            yield sent(rows)

    return run


def _told(table: pa.Table) -> pa.Table:
    """Sums over all buckets: of frequent contexts and words for the driver, of
    other contexts for each bucket that has them, in its order."""
    rows, out, part = table.to_pylist(), [], table.column("to")[0].as_py()
    for kind in ("tables", "customers", "words", "rest"):
        own = [r for r in rows if r["kind"] == kind]
        if own:
            at, of = np.unique(np.concatenate([_unzip(r["at"], np.int64) for r in own]), return_inverse=True)
            total = np.bincount(of, weights=np.concatenate([_unzip(r["values"], np.int64) for r in own]))
            out.append((kind, None, part, _zip(at), _zip(total.astype(np.int64))))
    far = [r for r in rows if r["kind"] == "far"]
    if far:
        keys = [_unzip_keys(r["at"]) for r in far]
        _, of = np.unique(np.concatenate(keys), return_inverse=True)
        values = np.concatenate([_unzip(r["values"], np.int64).reshape(-1, len(k)) for r, k in zip(far, keys, strict=True)], axis=1)
        totals = np.array([np.bincount(of, weights=v)[of] for v in values]).astype(np.int64)
        ends = np.cumsum([0, *map(len, keys)])
        out += [("far", r["bucket"], part, None, _zip(totals[:, i:j])) for r, i, j in zip(far, ends[:-1], ends[1:], strict=True)]
    return pa.table([pa.array([r[k] for r in out], t) for k, t in enumerate((pa.string(), pa.int32(), pa.int32(), pa.binary(), pa.binary()))], names=["kind", "bucket", "part", "at", "values"])


def _scores(plan: Plan, buckets: int):
    """Of each bucket, every document's part of the scores, dealt out by
    document."""
    schema = pa.schema([("to", pa.int32()), ("chunk", pa.int64()), ("doc_at", pa.binary()), ("score", pa.binary()), ("base", pa.binary()), ("known", pa.binary()), ("learn", pa.binary()), ("doc_ids", pa.list_(pa.int64())), ("n_tokens", pa.binary())])

    def out(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*((r[0] % buckets, *r) for r in rows), strict=True), schema, strict=True)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in _rows(batch):
                chunks = np.frombuffer(row["chunks"], np.int64)
                bucket = Bucket(row, plan)
                mean, customers_of = np.zeros(len(bucket.count)), np.r_[plan.customers, bucket.customers_of_far]
                parts = [slice(i, i + PAIRS) for i in range(0, len(mean), PAIRS)]
                for s, tables, customers, seats in bucket.sweeps(LAST, complete=True):
                    if s >= BURN_IN:
                        parent, of_context = bucket.parent(customers, seats, s), bucket.context_tables(s)
                        for i in parts:
                            c = bucket.context[i]
                            mean[i] += (np.maximum(bucket.count[i] - DISCOUNT * tables[i], 0) + (STRENGTH + DISCOUNT * of_context[c]) * parent[bucket.word_of[i]]) / (STRENGTH + customers_of[c])
                base = np.log10((bucket.word_count + 0.1) / (plan.tokens + 0.1 * (plan.types + 1)))
                known = (bucket.word_count > 0).astype(float)
                counts, doc, n = (_unzip(row[c], np.uint32) for c in ("entry_counts", "entry_docs", "pair_entries"))
                starts, place = np.r_[0, np.cumsum(n, dtype=np.int64)], np.cumsum(_unzip(row["doc_at"], np.int32))
                a, b, c = np.zeros((3, len(place)))
                for i in parts:
                    own = slice(starts[i.start], starts[min(i.stop, len(mean))])
                    for into, x in ((a, np.log10(mean[i] / SAMPLES)), (b, base[bucket.word_of[i]]), (c, known[bucket.word_of[i]])):
                        into += np.bincount(doc[own], weights=counts[own] * np.repeat(x, n[i]), minlength=len(place))
                c = c.astype(np.int32)
                ends = np.cumsum(_unzip(row["chunk_docs"], np.int64))
                yield out([(int(k), _zip(np.diff(place[i:j], prepend=0).astype(np.int32)), a[i:j].tobytes(), b[i:j].tobytes(), _zip(c[i:j]), None, None, None) for k, i, j in zip(chunks, np.r_[0, ends[:-1]], ends, strict=True)])

    return run, "to int, chunk bigint, doc_at binary, score binary, base binary, known binary, learn binary, doc_ids array<bigint>, n_tokens binary"


_RESULT = "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, base_score double, score double"


def _totals(table: pa.Table) -> pa.Table:
    """Sums of each document over all buckets.  Chunks that hold the same rows
    have one number: their sums come that many times."""
    rows = table.to_pylist()
    docs, sums = [r for r in rows if r["doc_ids"] is not None], {}
    for r in docs:
        sums.setdefault(r["chunk"], np.zeros((4, len(r["doc_ids"]))))[3] += 1
    for r in rows:
        if r["doc_ids"] is None:
            at, total = np.cumsum(_unzip(r["doc_at"], np.int32)), sums[r["chunk"]]
            total[0, at] += np.frombuffer(r["score"], np.float64)
            total[1, at] += np.frombuffer(r["base"], np.float64)
            total[2, at] += _unzip(r["known"], np.int32)
    mean = {k: x[:3] / x[3] for k, x in sums.items()}
    of = lambda k: np.concatenate([mean[r["chunk"]][k] for r in docs]) if docs else np.empty(0)
    read = lambda name, kind: np.concatenate([_unzip(r[name], kind) for r in docs]) if docs else np.empty(0, kind)
    return pa.table(
        {
            "doc_id": pa.array([i for r in docs for i in r["doc_ids"]], pa.int64()),
            "held_out": pa.array(read("learn", np.uint8) == 0, pa.bool_()),
            "n_tokens": pa.array(read("n_tokens", np.int64), pa.int64()),
            "n_known": pa.array(np.round(of(2)).astype(np.int64), pa.int64()),
            "base_score": pa.array(of(1), pa.float64()),
            "score": pa.array(of(0), pa.float64()),
        }
    )


_LEARNT = ["bucket", "words", "pairs", "contexts", "far", "far_at", "counts"]


def _with_told(words: DataFrame, told: list[DataFrame], buckets: int) -> DataFrame:
    """Buckets with what they were told of their contexts after each sweep."""
    if not told:
        return words.withColumn("told", F.lit(None).cast("array<struct<sweep:int,part:int,values:binary>>"))
    rows = reduce(DataFrame.unionByName, [t.where("kind = 'far'").select("bucket", F.struct(F.lit(s).alias("sweep"), "part", "values").alias("x")) for s, t in enumerate(told)])
    of = rows.repartition(buckets, "bucket").groupBy("bucket").agg(F.collect_list("x").alias("told"))
    return words.join(of.hint("shuffle_hash"), "bucket", "left")


def train(words: DataFrame, plan: Plan) -> list[DataFrame]:
    """Sweeps over the dealt corpus; fills in the plan's sums and gives what
    the buckets are told after each."""
    told: list[DataFrame] = []
    for sweep in range(LAST + 1):
        sent = _with_told(words.select(*_LEARNT), told, plan.buckets).mapInArrow(_sums(plan, sweep), _SENT_DDL)
        told.append(written(sent.groupBy("to").applyInArrow(_told, _TOLD_DDL), "told", "kind"))
        got = {kind: np.zeros(n) for kind, n in (("tables", plan.contexts), ("customers", plan.contexts), ("words", len(plan.frequent)), ("rest", 2))}
        for r in told[-1].where("kind <> 'far'").collect():  # of each frequent context and word at most two numbers and one
            got[r["kind"]][_unzip(bytes(r["at"]), np.int64)] = _unzip(bytes(r["values"]), np.int64)
        before = plan.word_tables[-1] if plan.word_tables else np.zeros(len(plan.frequent))
        elsewhere = np.maximum((plan.parent_tables[-1] if sweep else 0.5 * plan.types) - before, 0)
        of_words = seat(got["words"].astype(np.int64), plan.base(np.ones(len(plan.frequent), bool)), elsewhere, PARENT_DISCOUNT, PARENT_STRENGTH, np.random.default_rng([SEED, sweep]))
        plan.customers = got["customers"]
        plan.tables.append(got["tables"])
        plan.all_tables.append(float(got["rest"][1]))
        plan.word_customers.append(got["words"])
        plan.word_tables.append(of_words)
        plan.parent_tables.append(float(got["rest"][0] + of_words.sum()))
    return told


def model_scores(docs: DataFrame, held_out, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score,
    log10_perplexity`` for each row of docs.

    held_out is a Boolean column over doc_id; the model learns from the other
    rows and scores all.  Tokens are words (runs of characters other than
    space and the controls 9 to 13, A-Z lower-cased) and one end for each
    text; all unknown words are one.  score is the log10 of the averaged
    predictive probability of the text, base_score that of add-0.1 unigrams.

    Defined results: a null or empty text is its end alone; a null held_out
    counts as learnt from; repeated rows are learnt from each time and get the
    same score; without any row to learn from every token is unknown; an empty
    table gives no rows; other columns are not looked at."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text")).withColumn("held_out", F.coalesce(held_out, F.lit(False)))
    buckets = bucket_count(rows, "text", BUCKET_BYTES)
    counted = rows.where(~F.col("held_out")).select("text").mapInArrow(_vocabulary(buckets), "bucket int, words binary, counts binary")
    vocabulary = written(counted.groupBy("bucket").applyInArrow(_summed, "words binary, counts binary, types bigint, tokens bigint"), "vocabulary")
    types, n = (x or 0 for x in vocabulary.agg(F.sum("types"), F.sum("tokens")).first())
    often = vocabulary.select("words", "counts").mapInArrow(_frequent(max(2, -(-n // CONTEXT_SHARE))), "word bigint, count bigint").collect()
    frequent = np.array([r["word"] for r in often], dtype=np.int64).view(np.uint64)
    order = np.argsort(frequent)
    plan = Plan(buckets, n, types, frequent[order], np.array([r["count"] for r in often], dtype=np.int64)[order])

    path = scratch(spark, "pairs")
    name = "pairs_" + path.rsplit("-", 1)[1]
    made = rows.mapInArrow(_deal(plan), _DEALT_DDL).groupBy("bucket").applyInArrow(_gather, _SEATED_DDL)
    made.write.format("parquet").option("path", path).option("compression", "none").bucketBy(buckets, "bucket").saveAsTable(name)  # so sweeps needn't shuffle it
    dealt = spark.table(name)
    words = dealt.where("kind = 'words'")
    told = train(words, plan)
    score, schema = _scores(plan, buckets)
    parts = _with_told(words.select(*_LEARNT, "chunks", "chunk_docs", "doc_at", "entry_docs", "entry_counts", "pair_entries"), told, buckets).mapInArrow(score, schema)
    nothing = [F.lit(None).cast("binary").alias(c) for c in ("doc_at", "score", "base", "known")]
    of_docs = dealt.where("kind = 'docs'").select(F.pmod("chunk", F.lit(buckets)).cast("int").alias("to"), "chunk", *nothing, "learn", "doc_ids", "n_tokens")
    totals = written(parts.unionByName(of_docs).groupBy("to").applyInArrow(_totals, _RESULT), "scores")
    spark.sql(f"DROP TABLE {name}")
    return totals.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(n).cast("bigint").alias("train_tokens"), "base_score", "score", (-F.col("score") / F.col("n_tokens")).alias("log10_perplexity"))
