"""N-gram Jaccard join: documents whose shingle sets overlap enough, and the
groups that such links make.

Method: a grouped prefix join (after GroupJoin and PPJoin).

1. Texts become sets of hashed word shingles.  Documents with the same set
   form one class, known by 128 bits of its hash, and only classes go on.
2. Shingles are dealt out by hash, packed as arrays; each range counts in how
   many classes each shingle is.  A shingle of one class can't link anything
   and stays behind with its count.
3. A class takes its shingles rarest first.  Two linked classes share one of
   the first ``n - ceil(t n) + 1``, its prefix.  Classes of the same prefix and
   size are collapsed into one group, whose row alone is dealt out by the
   shingles of the prefix.
4. For each prefix shingle, pairs of groups are filtered by size and by
   position, then expanded into members.  Members are compared by parity
   sketches, a sure lower bound of the difference of two sets; those of sets
   above 4096 are of a part of the shingles chosen by hash, and reject what
   differs by 8 deviations more than a link could (one in 10^15).  A group of
   very many members is dealt in parts, a shingle of very many classes in
   blocks, and pairs of blocks.
5. A first round emits pairs only between members not joined by pairs before
   (a forest), which are verified on whole sets.  A second round emits every
   pair left between different components, again verified.  So no link is
   lost, and copies by the thousand make thousands of pairs, not millions.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folium.llm.common import bucket_count, connected_components, discard, in_runs, looked_up, scratch, shuffle_width, written

#: Shingles gathered by a task before it hands them on (6 bytes each).
CHUNK = 2_000_000
#: Words whose hash a task remembers.
WORDS = 1_000_000
#: Bytes of text that one bucket of shingles stands for at most.
BUCKET_BYTES = 128 << 20
#: Members of one shingle that are compared in one piece of work; members in
#: one part of a group.
BLOCK, PART = 1024, 64
SKETCH_BITS = (128, 4096)
#: Pairs that a task remembers so as not to name them again.
SEEN = 1_000_000

_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63], dtype=np.uint64)


class WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= WORDS:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value


def shingles(text: str | None, known: WordHashes, width: int = 5) -> np.ndarray:
    """Sorted distinct 48-bit hashes of the word n-grams of a whole text,
    lower-cased in A-Z; of a shorter text, one hash of all its words; of none,
    nothing."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    n = len(words)
    if not n:
        return np.empty(0, np.uint64)
    if n < width:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), seed=n) >> 16], dtype=np.uint64)
    each = np.fromiter(map(known.__getitem__, words), np.uint64, n)
    x = each[: n - width + 1] * _MIX[0]
    for k in range(1, width):
        x ^= x >> np.uint64(29)
        x = x * _MIX[k % 5] + each[k : n - width + 1 + k]
    x ^= x >> np.uint64(32)
    return np.unique(x >> np.uint64(16))


def rate(n: int) -> int:
    """How often the shingles of a set are halved before they are sketched."""
    return max(0, (n - 1).bit_length() - (SKETCH_BITS[1].bit_length() - 1))


def sketch(hashes: np.ndarray, n: int) -> bytes:
    """Parity of the number of hashes that fall on each bit.  Two sketches
    differ in at most as many bits as the sets differ in members.  A set of
    more than SKETCH_BITS has two: of the part that its own rate leaves, and of
    half of that, for partners of the next rate."""
    bits = min(max(1 << (n - 1).bit_length(), SKETCH_BITS[0]), SKETCH_BITS[1])
    mixed = hashes * _MIX[0]
    out = b""
    for level in (rate(n), rate(n) + 1) if 2 * n > SKETCH_BITS[1] else (0,):
        part = mixed[(mixed >> np.uint64(20)) & np.uint64((1 << level) - 1) == 0] if level else mixed
        odd = np.bincount((part >> np.uint64(44)).astype(np.int64) & (bits - 1), minlength=bits) & 1
        out += np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()
    return out


def bound(allowed, level: int):
    """Most bits that sketches at a level of a linked pair differ in, where
    whole sets may differ in so many members."""
    if not level:
        return allowed
    mean = allowed / (1 << level)
    return mean + 8 * np.sqrt(mean) + 40


def _pack(hashes: np.ndarray) -> bytes:
    """Six bytes for each hash."""
    return hashes.astype(np.uint32).tobytes() + (hashes >> np.uint64(32)).astype(np.uint16).tobytes()


def _unpack(data: bytes) -> np.ndarray:
    n = len(data) // 6
    return np.frombuffer(data, np.uint32, n).astype(np.uint64) | np.frombuffer(data, np.uint16, n, 4 * n).astype(np.uint64) << np.uint64(32)


def _zip(numbers: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(numbers.astype(np.int32).tobytes())


def _unzip(data: bytes) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(data, max_output_size=1 << 31), np.int32)


_DEALT = "bucket int, hashes binary, class_ids binary, sizes binary, counts binary, doc_ids array<bigint>"


def _deal(width: int, buckets: int):
    """Of each document its shingles, dealt out by hash range."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, docs, gathered, turn = WordHashes(), [], 0, 0
        schema = pa.schema([("bucket", pa.int32()), ("hashes", pa.binary()), ("class_ids", pa.binary()), ("sizes", pa.binary()), ("counts", pa.binary()), ("doc_ids", pa.list_(pa.int64()))])

        def flush() -> pa.RecordBatch:
            sizes = np.array([len(d[2]) for d in docs], dtype=np.int32)
            rows = [(turn % buckets, None, b"".join(d[1] for d in docs), _zip(sizes), None, [d[0] for d in docs])]
            first = list({d[1]: d[2] for d in docs if len(d[2])}.items())  # copies once
            if first:
                all_of = np.concatenate([x for _, x in first])
                owner = np.repeat(np.arange(len(first), dtype=np.int32), [len(x) for _, x in first])
                own_ids = _identities(b"".join(k for k, _ in first))
                own_sizes = np.array([len(x) for _, x in first], dtype=np.int32)
                bucket = (all_of % np.uint64(buckets)).astype(np.int32)
                order = np.argsort(bucket, kind="stable")
                all_of, owner, bucket = all_of[order], owner[order], bucket[order]
                ends = np.searchsorted(bucket, np.arange(buckets + 1))
                for b in range(buckets):
                    if (low := ends[b]) < (high := ends[b + 1]):
                        who, counts = np.unique(owner[low:high], return_counts=True)
                        rows.append((b, _pack(all_of[low:high]), own_ids[who].tobytes(), _zip(own_sizes[who]), _zip(counts), None))
            return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                found = shingles(text.as_py(), known, width)
                docs.append((doc_id, xxhash.xxh3_128_digest(found.tobytes(), seed=len(found)), found))
                gathered += len(found) + 8
                if gathered >= CHUNK:
                    yield flush()
                    docs, gathered, turn = [], 0, turn + 1
        if docs:
            yield flush()

    return run


def _identities(data: bytes) -> np.ndarray:
    """Two numbers for each class."""
    return np.frombuffer(data, np.uint64).reshape(-1, 2)


def _repeat(table: pa.Table) -> tuple[np.ndarray, ...]:
    """The classes of packed rows, in order; hash, place among the classes and
    size of each entry, and the rows' extra."""
    read = lambda name: [x.as_buffer() for x in table.column(name)]
    counts = [_unzip(x) for x in read("counts")]
    n = np.concatenate(counts)
    hashes, more = np.empty(n.sum(), np.uint64), np.empty(0, np.int32)
    ends = np.cumsum([c.sum() for c in counts])
    for x, end in zip(read("hashes"), ends, strict=True):
        part = _unpack(x)
        hashes[end - len(part) : end] = part
    if "found_in" in table.column_names:
        more = np.empty(len(hashes), np.int32)
        for x, end in zip(read("found_in"), ends, strict=True):
            part = _unzip(x)
            more[end - len(part) : end] = part
    each = np.concatenate([_identities(x) for x in read("class_ids")])
    sizes = np.concatenate([_unzip(x) for x in read("sizes")])
    order = np.lexsort((each[:, 1], each[:, 0]))
    new = np.ones(len(order), bool)
    new[1:] = (each[order[1:]] != each[order[:-1]]).any(axis=1)
    at = np.empty(len(order), np.int64)
    at[order] = np.cumsum(new) - 1
    return each[order[new]], hashes, np.repeat(at.astype(np.int32), n), np.repeat(sizes, n), more


_COUNTED = pa.schema([("bucket", pa.int32()), ("hashes", pa.binary()), ("class_ids", pa.binary()), ("sizes", pa.binary()), ("counts", pa.binary()), ("found_in", pa.binary()), ("doc_ids", pa.list_(pa.int64()))])


def _count(buckets: int):
    """Of a hash range, the shingles of two or more classes with their number
    of classes, dealt out by class; document rows pass."""

    def run(table: pa.Table) -> pa.Table:
        is_doc = table.column("hashes").is_null()
        rows = []
        for row in table.filter(is_doc).to_pylist():
            rows.append((row["bucket"], None, row["class_ids"], row["sizes"], None, None, row["doc_ids"]))
        entries = table.filter(pa.compute.invert(is_doc))
        if entries.num_rows:
            classes, h, ids, sizes, _ = _repeat(entries)
            order = np.argsort(h)
            same = h[order[1:]] == h[order[:-1]]
            shared = np.zeros(len(h), bool)
            shared[1:] |= same
            shared[:-1] |= same
            keep = order[shared]
            h, ids, sizes = h[keep], ids[keep], sizes[keep]
            order = np.lexsort((ids, h))
            h, ids, sizes = h[order], ids[order], sizes[order]
            if len(h):
                first = np.ones(len(h), bool)
                first[1:] = (h[1:] != h[:-1]) | (ids[1:] != ids[:-1])
                h, ids, sizes = h[first], ids[first], sizes[first]
                starts = np.flatnonzero(np.r_[True, h[1:] != h[:-1]])
                found_in = np.diff(np.r_[starts, len(h)])
                found_in = np.repeat(found_in, found_in).astype(np.int32)
                more = found_in > 1
                h, ids, sizes, found_in = h[more], ids[more], sizes[more], found_in[more]
                to = (classes[ids, 1] % np.uint64(buckets)).astype(np.int32)
                order = np.lexsort((ids, to))
                h, ids, sizes, found_in, to = h[order], ids[order], sizes[order], found_in[order], to[order]
                ends = np.searchsorted(to, np.arange(buckets + 1))
                for b in range(buckets):
                    if (low := ends[b]) < (high := ends[b + 1]):
                        who, at, counts = np.unique(ids[low:high], return_index=True, return_counts=True)
                        rows.append((b, _pack(h[low:high]), classes[who].tobytes(), _zip(sizes[low:high][at]), _zip(counts), _zip(found_in[low:high]), None))
        return pa.table([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(_COUNTED)], schema=_COUNTED)

    return run


_CLASSES = pa.schema([("kind", pa.string()), ("doc_id", pa.int64()), ("class_a", pa.int64()), ("class_b", pa.int64()), ("node", pa.int64()), ("n", pa.int32()), ("unshared", pa.int32()), ("prefix", pa.list_(pa.int64())), ("members", pa.list_(pa.int64())), ("sketch", pa.binary())])
_CLASSES_DDL = "kind string, doc_id bigint, class_a bigint, class_b bigint, node bigint, n int, unshared int, prefix array<bigint>, members array<bigint>, sketch binary"


def _classes(percent: int):
    """Rows of documents, and of each class that has a prefix to share, with a
    number of its own, its bucket and its place there."""

    def run(table: pa.Table) -> pa.Table:
        is_doc = table.column("hashes").is_null()
        doc, cls, size = [], [], []
        for row in table.filter(is_doc).to_pylist():
            doc += row["doc_ids"]
            cls.append(_identities(row["class_ids"]).view(np.int64))
            size.append(_unzip(row["sizes"]))
        k, both = len(doc), np.concatenate(cls) if cls else np.empty((0, 2), np.int64)
        out = [pa.table([pa.array(["doc"] * k, pa.string()), pa.array(doc, pa.int64()), pa.array(both[:, 0]), pa.array(both[:, 1]), pa.nulls(k, pa.int64()), pa.array(np.concatenate(size) if size else [], pa.int32()), *(pa.nulls(k, f.type) for f in list(_CLASSES)[6:])], schema=_CLASSES)]
        entries = table.filter(pa.compute.invert(is_doc))
        if entries.num_rows:
            bucket = table.column("bucket")[0].as_py()
            classes, h, ids, sizes, found_in = _repeat(entries)
            order = np.lexsort((h, found_in, ids))
            h, ids, sizes = h[order], ids[order], sizes[order]
            starts = np.flatnonzero(np.r_[True, ids[1:] != ids[:-1]])
            rows = []
            for low, high in zip(starts, np.r_[starts[1:], len(h)], strict=True):
                n = int(sizes[low])
                unshared = n - int(high - low)
                first = n - (percent * n + 99) // 100 + 1 - unshared
                if first > 0:
                    own, (a, b) = h[low:high], classes[ids[low]].view(np.int64).tolist()
                    rows.append(("class", None, a, b, (bucket << 40) + int(ids[low]), n, unshared, own[:first].view(np.int64), own.view(np.int64), sketch(own, n)))
            out.append(pa.table([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(_CLASSES)], schema=_CLASSES))
        return pa.concat_tables(out)

    return run


def _fold(x: int, bits: int, to: int) -> int:
    while bits > to:
        bits //= 2
        x = (x >> bits) ^ (x & ((1 << bits) - 1))
    return x


def _needed(na, nb, percent: int):
    """Least intersection of a link: 100 i >= p (na + nb - i)."""
    return -(-percent * (na + nb) // (100 + percent))


class Members:
    """The groups that have one shingle, and their members."""

    def __init__(self, of: dict[str, np.ndarray], low: int, high: int, raw: list[bytes]) -> None:
        first, last = of["offset"][low], of["offset"][high]
        self.n, self.unshared, self.at, self.group, self.side = (of[c][low:high] for c in ("n", "unshared", "at", "group", "side"))
        self.place = self.unshared + self.at
        self.node, self.component, self.raw = of["nodes"][first:last], of["components"][first:last], raw[first:last]
        self.bounds = of["offset"][low : high + 1] - first
        self.two = bool(of["block_a"][low] != of["block_b"][low])

    def _pairs_of_groups(self, g: int, percent: int) -> tuple[np.ndarray, np.ndarray]:
        """Groups from g on whose members may link with those of g, and in how
        many shared shingles they may differ then."""
        n, need = self.n[g:], _needed(int(self.n[g]), self.n[g:], percent)
        may = (np.minimum(n, n[0]) >= need) & (np.minimum(n - self.place[g:], n[0] - self.place[g]) >= need)
        if self.at[g]:  # groups of one prefix meet at its first shingle
            may &= self.group[g:] != self.group[g]
        if self.two:
            may &= self.side[g:] != self.side[g]
        allowed = n + n[0] - 2 * need - self.unshared[g:] - self.unshared[g]
        may &= allowed >= 0
        at = np.flatnonzero(may)
        return at + g, allowed[at]

    def few(self, percent: int, forest: bool) -> Iterator[tuple[int, int]]:
        """The pairs, one by one."""
        label = list(range(len(self.node))) if forest else self.component.tolist()
        node, bounds, levels = self.node.tolist(), self.bounds.tolist(), {}
        n, place, at, group, side, unshared = (x.tolist() for x in (self.n, self.place, self.at, self.group, self.side, self.unshared))

        def sketch_of(i: int, size: int) -> tuple[int, int, list[int]]:
            if i not in levels:
                data = self.raw[i]
                bits = min(8 * len(data), SKETCH_BITS[1])
                levels[i] = rate(size), bits, [int.from_bytes(data[k : k + bits // 8], "little") for k in range(0, len(data), bits // 8)]
            return levels[i]

        for g in range(len(n)):
            for o in range(g, len(n)):
                if group[g] == group[o] and at[g] or self.two and side[g] == side[o]:
                    continue
                need = _needed(n[g], n[o], percent)
                allowed = n[g] + n[o] - 2 * need - unshared[g] - unshared[o]
                if min(n[g], n[o]) < need or min(n[g] - place[g], n[o] - place[o]) < need or allowed < 0:
                    continue
                for i in range(bounds[g], bounds[g + 1]):
                    for j in range(max(bounds[o], i + 1), bounds[o + 1]):
                        if label[i] == label[j]:
                            continue
                        (ra, wa, xa), (rb, wb, xb) = sketch_of(i, n[g]), sketch_of(j, n[o])
                        level, to = max(ra, rb), min(wa, wb)
                        if level - ra < len(xa) and level - rb < len(xb):
                            apart = (_fold(xa[level - ra], wa, to) ^ _fold(xb[level - rb], wb, to)).bit_count()
                            if apart > bound(allowed, level):
                                continue
                        yield node[i], node[j]
                        if forest:
                            label = [label[i] if x == label[j] else x for x in label]

    def many(self, percent: int, forest: bool) -> Iterator[tuple[int, int]]:
        """The pairs of each member with all others at once."""
        sizes = np.diff(self.bounds)
        of = np.repeat(np.arange(len(self.n)), sizes)
        label = np.arange(len(self.node)) if forest else self.component.copy()
        rates = np.array([rate(int(x)) for x in self.n])[of]
        widths = np.array([min(8 * len(x), SKETCH_BITS[1]) for x in self.raw])
        kind = rates * 65536 + widths
        row_of, words = np.empty(len(of), np.int64), {}
        for k in np.unique(kind):
            own = np.flatnonzero(kind == k)
            row_of[own] = np.arange(len(own))
            words[k] = np.frombuffer(b"".join(self.raw[i] for i in own), np.uint64).reshape(len(own), -1, int(widths[own[0]]) // 64)

        def folded(x: np.ndarray, to: int) -> np.ndarray:
            while x.shape[-1] * 64 > to:
                x = x[..., : x.shape[-1] // 2] ^ x[..., x.shape[-1] // 2 :]
            return x

        for g in range(len(self.n)):
            groups, allowed_of = self._pairs_of_groups(g, percent)
            if not len(groups):
                continue
            among = np.full(len(self.n), -1)
            among[groups] = allowed_of
            candidates = np.flatnonzero(among[of] >= 0)
            for i in range(self.bounds[g], self.bounds[g + 1]):
                j = candidates[(candidates > i) & (label[candidates] != label[i])]
                close = []
                for k in np.unique(kind[j]):
                    own = j[kind[j] == k]
                    level, to = int(max(rates[i], rates[own[0]])), int(min(widths[i], widths[own[0]]))
                    mine, theirs = words[kind[i]][row_of[i]], words[k][row_of[own]]
                    a, b = level - int(rates[i]), level - int(rates[own[0]])
                    if a < len(mine) and b < theirs.shape[1]:
                        apart = np.bitwise_count(folded(theirs[:, b], to) ^ folded(mine[a], to)).sum(axis=1)
                        own = own[apart <= bound(among[of[own]], level)]
                    close.append(own)
                for x in np.concatenate(close).tolist() if close else ():
                    if not forest or label[x] != label[i]:
                        yield int(self.node[i]), int(self.node[x])
                        if forest:
                            label[label == label[x]] = label[i]

    def pairs(self, percent: int, forest: bool) -> Iterator[tuple[int, int]]:
        return (self.few if len(self.node) <= 24 else self.many)(percent, forest)


def _compare(percent: int, forest: bool):
    """Pairs of one shingle's classes that groups and sketches can't tell
    apart.  forest: only pairs of members not joined before, else all pairs of
    different components."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[int, int]] = set()
        for table in in_runs(batches, "shingle", "block_a", "block_b"):
            of = {c: table.column(c).to_numpy() for c in ("shingle", "block_a", "block_b", "n", "unshared", "at", "group", "side")}
            of["n"], of["unshared"] = of["n"].astype(np.int64), of["unshared"].astype(np.int64)
            of["offset"] = np.r_[0, np.cumsum(pa.compute.list_value_length(table.column("nodes")).to_numpy())]
            of["nodes"], of["components"] = (pa.compute.list_flatten(table.column(c)).to_numpy() for c in ("nodes", "components"))
            raw = pa.compute.list_flatten(table.column("sketches")).to_pylist()
            key = [of[c] for c in ("shingle", "block_a", "block_b")]
            change = np.flatnonzero(np.r_[True, np.any([k[1:] != k[:-1] for k in key], axis=0)]) if table.num_rows else []
            found = []
            for low, high in zip(change, np.r_[change[1:], table.num_rows], strict=True):
                if of["offset"][high] - of["offset"][low] > 1:
                    for a, b in Members(of, low, high, raw).pairs(percent, forest):
                        pair = (a, b) if a < b else (b, a)
                        if pair not in seen:
                            if len(seen) >= SEEN:
                                seen.clear()
                            seen.add(pair)
                            found.append(pair)
            if found:
                yield pa.RecordBatch.from_arrays([pa.array([p[0] for p in found], pa.int64()), pa.array([p[1] for p in found], pa.int64())], names=["a", "b"])

    return run


def _groups(classes: DataFrame, component: DataFrame | None) -> DataFrame:
    """``group, other, part, n, unshared, prefix, nodes, components, sketches``:
    classes of the same prefix and size as one row, or as parts of some PART
    members."""
    whole = classes.select("node", "n", "unshared", "prefix", "sketch", F.xxhash64("n", "unshared", "prefix").alias("group"), F.xxhash64(F.lit(1), "n", "unshared", "prefix").alias("other"))
    if component is None:
        whole = whole.withColumn("component", F.col("node"))
    else:
        whole = whole.join(component.select("node", F.col("root").alias("component")), "node", "left").withColumn("component", F.coalesce("component", "node"))
    large = whole.groupBy("group", "other").agg(F.count("*").alias("size")).where(F.col("size") > PART)
    part = F.coalesce(F.pmod(F.xxhash64("node"), F.ceil(F.col("size") / PART)), F.lit(0)).cast("int")
    dealt = whole.join(large, ["group", "other"], "left").withColumn("part", part)
    made = dealt.groupBy("group", "other", "part").agg(*(F.any_value(c).alias(c) for c in ("n", "unshared", "prefix")), F.array_sort(F.collect_list(F.struct("node", "component", "sketch"))).alias("members"))
    return made.select("group", "other", "part", "n", "unshared", "prefix", F.col("members.node").alias("nodes"), F.col("members.component").alias("components"), F.col("members.sketch").alias("sketches"))


def _candidates(classes: DataFrame, component: DataFrame | None, percent: int) -> DataFrame:
    groups = written(_groups(classes, component), "groups")
    key = ["group", "other", "part"]
    keys = groups.select(*key, F.size("nodes").alias("size"), F.array_min("components").alias("low"), F.array_max("components").alias("high"), F.posexplode("prefix").alias("at", "shingle"))
    lively = keys.groupBy("shingle").agg(F.sum("size").alias("in_all"), F.min("low").alias("c0"), F.max("high").alias("c1")).where("c0 <> c1").select("shingle", "in_all")
    rows = keys.select(*key, "at", "shingle").join(lively, "shingle").join(groups.drop("prefix"), key)
    blocks = F.ceil(F.col("in_all") / F.lit(BLOCK)).cast("int")
    rows = rows.withColumn("side", F.pmod(F.xxhash64(*key), blocks).cast("int"))
    rows = rows.withColumn("with", F.explode(F.sequence(F.lit(0), blocks - 1)))
    rows = rows.withColumn("block_a", F.least("side", "with")).withColumn("block_b", F.greatest("side", "with")).drop("with", "in_all", "other")
    dealt = rows.repartition(shuffle_width(classes.sparkSession), "shingle", "block_a", "block_b").sortWithinPartitions("shingle", "block_a", "block_b", "n", "group", "part")
    pairs = written(dealt.mapInArrow(_compare(percent, component is None), "a bigint, b bigint").distinct(), "candidates")
    discard(groups)
    return pairs


def _verified(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    of = lambda x: classes.select(F.col("node").alias(x), F.col("n").alias(f"n_{x}"), F.col("members").alias(f"members_{x}"))
    both = pairs.join(of("b"), "b").join(of("a"), "a").withColumn("common", F.size(F.array_intersect("members_a", "members_b")))
    return both.where(F.col("common") * (100 + percent) >= (F.col("n_a") + F.col("n_b")) * percent).select("a", "b")


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 75) -> DataFrame:
    """``doc_id, n_shingles, component_id, class_id`` for every row of docs.

    Two documents link when 100 * intersection >= percent * union of their
    sets of word n-grams; component_id is the smallest id reachable by links.
    Words are runs of characters other than space and the controls 9 to 13;
    only A-Z are lower-cased.

    Defined results: a null or empty text, or one of white space, has 0
    shingles and links with nothing; a text of fewer words is one shingle;
    repeated rows and equal texts share a class_id and a component; a null id
    is kept and never chosen as component_id unless no other is there; an
    empty table gives no rows; other columns are not looked at."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    buckets = bucket_count(rows, "text", BUCKET_BYTES)
    dealt = rows.mapInArrow(_deal(width, buckets), _DEALT)
    counted = dealt.groupBy("bucket").applyInArrow(_count(buckets), "bucket int, hashes binary, class_ids binary, sizes binary, counts binary, found_in binary, doc_ids array<bigint>")
    made = counted.groupBy("bucket").applyInArrow(_classes(percent), _CLASSES_DDL)
    path = scratch(spark, "classes")
    made.write.partitionBy("kind").parquet(path)
    made = spark.read.schema(made.schema).parquet(path)
    classes = made.where("kind = 'class'").drop("kind", "doc_id")
    identity = ["class_a", "class_b"]
    all_docs = made.where("kind = 'doc'").select("doc_id", *identity, F.col("n").cast("bigint").alias("n_shingles"))

    links = written(_verified(_candidates(classes, None, percent), classes, percent), "links")
    component = connected_components(links)
    late = written(_verified(_candidates(classes, component, percent), classes, percent), "links")
    if not late.isEmpty():
        component = connected_components(component.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(late))

    some = all_docs.where("n_shingles > 0")
    lowest = some.groupBy(*identity).agg(F.min("doc_id").alias("first_id"), F.count("*").alias("docs"))
    rooted = lowest.join(component.join(classes.select("node", *identity), "node").select(*identity, "root"), identity, "left")
    least = rooted.where("root IS NOT NULL").groupBy("root").agg(F.min("first_id").alias("least_id"))
    chosen = rooted.join(least, "root", "left").select(*identity, "docs", F.coalesce("least_id", "first_id").alias("component_id"))
    found = looked_up(some, written(chosen, "class-components"), identity, "docs")
    out = found.unionByName(all_docs.where("n_shingles = 0").withColumn("component_id", F.col("doc_id")))
    return out.select("doc_id", "n_shingles", "component_id", F.col("class_a").alias("class_id"))


def op1_sql() -> str:
    return """
    WITH RECURSIVE t AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') AS w FROM documents),
    s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g FROM t),
    n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
    c AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY ALL),
    l AS (SELECT a, b FROM c JOIN n p ON a = p.doc_id JOIN n q ON b = q.doc_id WHERE 100 * c >= 75 * (p.n + q.n - c)),
    e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
    r AS (SELECT doc_id AS node, doc_id AS reached FROM t UNION SELECT r.node, e.b FROM r JOIN e ON r.reached = e.a)
    SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id FROM (SELECT node AS doc_id, min(reached) AS component_id FROM r GROUP BY node) LEFT JOIN n USING (doc_id)
    """
