"""Best-fit packing of tokenised documents into sequences.

Documents become pieces of at most CAPACITY tokens.  Pieces are dealt out at
random into groups of a bounded size; each group is packed by best fit, then
improved by local search: single pieces move, one piece is exchanged for one
or two for one between underfull bins, whenever that raises the sum of squared
fills, until bins empty or no packing can have fewer.  The emptiest bins of
each group, a bounded number of pieces, are taken apart and packed together in
the next round, in half as many groups at most, until one group is left: so
the rounds end whatever the lengths are, and what remains in nearly full bins
is used as well.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folium.llm.common import written

CAPACITY = 4096
END_ID = 1
#: Pieces in a group, and the share of so many that goes to the next round.
GROUP = 6000
REOPENED = 0.05
#: Pairs of bins that the local search looks at, for each piece of a group.
EFFORT = 30
#: Words whose ids a task remembers.
WORDS = 600_000

#: The white space of Unicode, which the tokenizer drops.
_WHITE = "".join(map(chr, (*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))
_WORD = re.compile(f"[^{_WHITE}]+")
#: Letters that normalising leaves alone but for lower case.
_PLAIN = re.compile("[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+")
_UNUSUAL = re.compile("[^\\x00-\\x7f\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]|<\\|")
_ODD_SPACES = re.compile("[\x1c-\x1f]")


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _byte_letters() -> list[str]:
    """The letter that stands for each byte in a byte-level vocabulary:
    printable bytes stand for themselves, the others for the characters from
    256 on, in order."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    return [chr(b) if b in printable else chr(next(others)) for b in range(256)]


class Tokens:
    """Ids of a text by a byte-level tokenizer that drops white space and never
    joins across it.  A task remembers the ids of each distinct word, as
    little-endian unsigned 32-bit numbers.  A word of letters with plain
    punctuation after it is put together from the ids that the tokenizer's
    model gives to its parts, which are remembered too; any other word goes
    through the whole tokenizer."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.letters = _byte_letters()
        self.parts: dict[str, bytes] = {}
        self.known = _Remembered(self._word)

    def _part(self, part: str) -> bytes:
        if (got := self.parts.get(part)) is None:
            if len(self.parts) >= WORDS:
                self.parts.clear()
            mapped = part if part.isascii() else "".join([self.letters[b] for b in part.encode()])
            got = self.parts[part] = array("I", [t.id for t in self.model.tokenize(mapped)]).tobytes()
        return got

    def _word(self, word: str) -> bytes:
        core = word.rstrip(".,!?;:|")
        if core.isalpha() and (word.isascii() or _PLAIN.fullmatch(core)):
            ids = self._part(core.lower())
            return ids + self._part(word[len(core) :]) if len(core) < len(word) else ids
        return array("I", self.tokenizer.encode(word, add_special_tokens=False).ids).tobytes()

    def ids(self, text: str) -> bytes:
        if not _UNUSUAL.search(text):
            text = text.lower()  # fewer words to tell apart
        words = _WORD.findall(text) if _ODD_SPACES.search(text) else text.split()
        return b"".join(map(self.known.__getitem__, words))


class _Remembered(dict):
    def __init__(self, make) -> None:
        self.make = make

    def __missing__(self, word: str) -> bytes:
        if len(self) >= WORDS:
            self.clear()
        value = self[word] = self.make(word)
        return value


_PIECES = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"


def _pieces(path: str, capacity: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, end = Tokens(path), np.array([END_ID], dtype="<u4").tobytes()

        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = tokens.ids(text.as_py() or "") + end
                for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                    own = ids[at : at + 4 * capacity]
                    rows.append((doc_id, k, at // 4, len(own) // 4, zlib.crc32(own)))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return run


# -- packing of lengths


def best_fit(lengths: np.ndarray, capacity: int) -> list[list[int]]:
    """Bins of indexes, longest first, each into the fullest bin it fits."""
    room_of: list[list[int]] = [[] for _ in range(capacity + 1)]
    open_rooms, bins = 0, []
    for i in np.argsort(-lengths, kind="stable").tolist():
        need = int(lengths[i])
        fitting = open_rooms >> need
        if need and fitting:
            room = need + (fitting & -fitting).bit_length() - 1
            b = room_of[room].pop()
            if not room_of[room]:
                open_rooms ^= 1 << room
            bins[b].append(i)
        else:
            room, b = capacity, len(bins)
            bins.append([i])
        left = room - need
        if left:
            room_of[left].append(b)
            open_rooms |= 1 << left
    return bins


def least_bins(lengths: np.ndarray, capacity: int) -> int:
    """A number of bins that no packing can undercut: sums of lengths by dual
    feasible functions.  One counts pieces that leave less than e of room as
    full and drops those below e; one counts how many of a kind fit into a
    bin."""
    best, half = 0, np.unique(lengths[2 * lengths <= capacity])
    for e in (0, *half[:: max(1, len(half) // 16)].tolist()):
        own = np.where(lengths < e, 0, np.where(lengths > capacity - e, capacity, lengths))
        best = max(best, -(-int(own.sum()) // capacity))
        for k in range(1, 13):
            times, rest = np.divmod((k + 1) * own, capacity)
            best = max(best, -(-int(np.where(rest == 0, k * own, times * capacity).sum()) // (k * capacity)))
    return best


def local_search(bins: list[list[int]], lengths: np.ndarray, capacity: int) -> list[list[int]]:
    """Empties bins, emptiest first, into underfull ones by moves, exchanges
    of one for one and of two for one that raise the sum of squared fills,
    until none does or EFFORT is used up: where no lengths add up, each further
    bin would take a look at all pairs of bins."""
    size = lengths.tolist()
    fill = [sum(size[i] for i in b) for b in bins]
    least = least_bins(lengths, capacity)
    live = {b for b in range(len(bins)) if fill[b] < capacity}
    count = len(bins)
    tried: set[int] = set()
    effort = EFFORT * len(size)
    while count > least and effort > 0:
        source = min((b for b in live - tried if bins[b]), key=lambda b: fill[b], default=None)
        if source is None:
            break
        if sum(capacity - fill[b] for b in live if b != source) < fill[source]:
            break
        changed = False
        for b in sorted((b for b in live if b != source), key=lambda b: fill[b], reverse=True):
            effort -= 1
            if effort <= 0:
                break
            while bins[source] and fill[b] < capacity and (step := _step(bins[source], bins[b], size, fill[source], fill[b], capacity)):
                give, take = step
                for i in give:
                    bins[source].remove(i)
                    bins[b].append(i)
                if take is not None:
                    bins[b].remove(take)
                    bins[source].append(take)
                gain = sum(size[i] for i in give) - (size[take] if take is not None else 0)
                fill[source] -= gain
                fill[b] += gain
                changed = True
            if not bins[source]:
                break
        live = {b for b in live if bins[b] and fill[b] < capacity}
        if not bins[source]:
            count -= 1
            tried.clear()
        elif not changed:
            tried.add(source)
    return [b for b in bins if b]


def _step(source: list[int], target: list[int], size: list[int], fill_source: int, fill_target: int, capacity: int):
    """The step that puts most into the target: pieces given, and the piece
    taken for them, if any.  None if none raises the sum of squares."""
    room = capacity - fill_target
    best, gain = None, 0
    # (f_t + g)^2 + (f_s - g)^2 grows when g > f_s - f_t
    least = max(0, fill_source - fill_target)
    for i in source:
        if gain < size[i] <= room:
            best, gain = ([i], None), size[i]
    if gain == room:
        return best if gain > least else None
    theirs = sorted(target, key=lambda j: size[j])
    their_sizes = np.array([size[j] for j in theirs])
    mine = sorted(source, key=lambda i: size[i])
    ones = np.array([size[i] for i in mine])
    both = [(np.arange(len(mine)), None, ones)]
    if len(mine) > 1:
        a, b = np.triu_indices(len(mine), 1)
        both.append((a, b, ones[a] + ones[b]))
    for a, b, put in both:
        # of the target, the smallest piece that leaves room: put - taken <= room
        at = np.searchsorted(their_sizes, put - room)
        fits = (at < len(their_sizes)) & (put > room)
        if b is not None and len(put):  # two that fit without any exchange are two moves
            fits &= put > room
        if fits.any():
            got = np.where(fits, put - their_sizes[np.minimum(at, len(their_sizes) - 1)], -1)
            k = int(np.argmax(got))
            if got[k] > gain:
                gain = int(got[k])
                best = ([mine[a[k]]] + ([mine[b[k]]] if b is not None else []), theirs[int(at[k])])
    return best if gain > least else None


def pack(lengths: np.ndarray, capacity: int = CAPACITY) -> list[list[int]]:
    return local_search(best_fit(lengths, capacity), lengths, capacity)


_PACKED = _PIECES + ", sequence_id bigint, offset bigint, open boolean"


def reopened(bins: list[list[int]], lengths: np.ndarray, capacity: int, most: int) -> list[int]:
    """The emptiest bins of at most so many pieces together, one bin at least;
    full ones never."""
    fill = [int(lengths[b].sum()) for b in bins]
    out, n = [], 0
    for k in sorted(range(len(bins)), key=lambda k: fill[k]):
        n += len(bins[k])
        if fill[k] == capacity or out and n > most:
            break
        out.append(k)
    return out


def _pack_group(capacity: int, level: int, most: int):
    def run(table: pa.Table) -> pa.Table:
        group = table.column("bin_group")[0].as_py()
        table = table.drop_columns(["bin_group"]).sort_by([("doc_id", "ascending"), ("piece", "ascending"), ("ids_crc32", "ascending")])
        lengths = table.column("length").to_numpy()
        bins = pack(lengths, capacity)
        sequence, offset, opened = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64), np.zeros(len(lengths), bool)
        for k, b in enumerate(bins):
            own = lengths[b]
            sequence[b] = (level << 56) + (group << 24) + k
            offset[b] = np.cumsum(own) - own
        for k in reopened(bins, lengths, capacity, most) if most else ():
            opened[bins[k]] = True
        return table.append_column("sequence_id", pa.array(sequence)).append_column("offset", pa.array(offset)).append_column("open", pa.array(opened))

    return run


def pack_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, capacity: int = CAPACITY, group: int = GROUP) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32, sequence_id, offset`` of
    every piece of every document.

    A document is the tokenizer's ids of its text and then END_ID; one longer
    than capacity is cut into pieces of that length, the last as it comes out.
    Pieces of a sequence lie gapless from offset 0.

    Defined results: a null or empty text is END_ID alone; repeated rows are
    packed each; null ids are kept; an empty table gives no rows; other
    columns are not looked at."""
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    todo = written(rows.mapInArrow(_pieces(tokenizer or default_tokenizer(), capacity), _PIECES), "pieces")
    done: DataFrame | None = None
    level, groups = 0, None
    while True:
        enough = max(1, -(-todo.count() // group))
        groups = enough if groups is None else max(1, min(enough, groups // 2))
        key = F.pmod(F.xxhash64(F.lit(level), "doc_id", "piece", "ids_crc32"), F.lit(groups)).alias("bin_group")
        packed = written(todo.select(key, "*").groupBy("bin_group").applyInArrow(_pack_group(capacity, level, 0 if groups == 1 else max(1, int(REOPENED * group))), _PACKED), "packed")
        closed = packed.where("NOT open").drop("open")
        done = closed if done is None else done.unionByName(closed)
        if groups == 1:
            return done
        todo = packed.where("open").drop("open", "sequence_id", "offset")
        level += 1
