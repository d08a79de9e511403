"""Benchmark decontamination by template canonicalisation.

Words become templates: numbers, names and units turn into typed placeholders,
other words are lower-cased without the punctuation around them.  A text is
read twice: by words, where names are words like others, so that case doesn't
matter; and by names, where each run of capitalised words is one placeholder,
at the start of a sentence too.  Short windows of template words are
hash-joined between documents and benchmark items, reading by reading.  They
are seeds: those of an item on neighbouring diagonals make a band, in which
the item is aligned, so words may be changed, put in or left out.  There the
slots (what the placeholders stand for) must be consistent, each value of the
item standing for one value of the document.  So a question asked again with
other numbers or names is found as well as a copy.  An item of fewer words than
a seed, or of placeholders alone, says too little as a template: it is found
where all its words stand in a row as they are.

The benchmark side of the join is sent to the tasks in blocks of a checked
size; a larger benchmark takes more passes.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WINDOW = 8
COVERAGE = 0.6
#: Template words in a seed, and the diagonals beside the seeds in a band: half
#: an item's words, at most so many, and four.
SEED = 4
BESIDE = 64
#: Characters of benchmark text in one block.
BLOCK_CHARS = 8_000_000
#: Words whose template a task remembers.
WORDS = 1_000_000

#: Units of measure and number words of the template.
UNITS = frozenset(
    "mm cm m km inch inches foot feet yard yards mile miles mg g kg gram grams kilogram kilograms pound pounds lb lbs ounce ounces ton tons ml l liter liters litre litres gallon gallons second seconds sec minute minutes min hour hours h day days week weeks month months year years percent % dollar dollars euro euros cent cents $ € £ usd eur gbp degree degrees celsius fahrenheit kelvin watt watts volt volts hz mph kmh".split()
)
NUMBER_WORDS = frozenset("zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million billion".split())

_NUMBER = re.compile(r"[+-]?[$€£]?\d[\d.,:/-]*(?:st|nd|rd|th)?%?")
_AMOUNT = re.compile(r"[+-]?\d[\d.,]*([a-zA-Z]+)")
_STRIP = re.compile(r"^[^\w$€£%+-]+|[^\w$€£%]+$|^[+-]+(?!\d)")
_NAME, _NUM, _UNIT, _BOTH = (xxhash.xxh64_intdigest(x) >> 2 << 2 for x in ("<name>", "<number>", "<unit>", "<number><unit>"))
_CAPITAL, _STOP = 1, 2


class Templates(dict):
    """Word to the hash of its template, with marks in the low two bits: a
    capital, so perhaps a name; the end of a sentence.  0: no word."""

    def __missing__(self, word: str) -> int:
        if len(self) >= WORDS:
            self.clear()
        core = _STRIP.sub("", word)
        if not core:
            value = 0
        elif _NUMBER.fullmatch(core) or core.lower() in NUMBER_WORDS:
            value = _NUM
        elif core.lower() in UNITS:
            value = _UNIT
        elif (m := _AMOUNT.fullmatch(core)) and m[1].lower() in UNITS:
            value = _BOTH
        else:
            value = xxhash.xxh64_intdigest(core.lower()) >> 2 << 2 or 4
            value |= _CAPITAL * (core[0].isupper() and not core.isupper())
        if value and word[-1] in ".!?:;|":
            value |= _STOP
        self[word] = value
        return value


def template(text: str | None, known: Templates) -> tuple[np.ndarray, list[str]]:
    """Template hashes of a text's words with their marks, the words."""
    words = (text or "").split()
    marked = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
    there = marked != 0
    if not there.all():
        words = [w for w, t in zip(words, there, strict=True) if t]
        marked = marked[there]
    return marked, words


def by_words(marked: np.ndarray) -> np.ndarray:
    return marked & ~np.uint64(3)


def by_names(marked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes where a run of capitalised words inside a sentence is one
    placeholder, and the word that each begins with."""
    capital, stop = (marked & np.uint64(_CAPITAL)) != 0, (marked & np.uint64(_STOP)) != 0
    joins = np.zeros(len(marked), bool)
    joins[1:] = capital[1:] & capital[:-1] & ~stop[:-1]
    first = np.flatnonzero(~joins)
    hashes = by_words(marked)[first]
    hashes[capital[first]] = _NAME
    return hashes, first


@lru_cache(maxsize=None)
def _multiplier(k: int) -> int:
    return xxhash.xxh64_intdigest(f"window {k}") | 1


def windows(hashes: np.ndarray, width: int) -> np.ndarray:
    n = len(hashes) - width + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    x = np.full(n, width, np.uint64)
    for k in range(width):
        x = (x ^ hashes[k : n + k]) * np.uint64(_multiplier(k))
        x ^= x >> np.uint64(31)
    return x


#: What a template word of an item is: a word; a number or unit; surely a
#: name; a name or a word at the start of a sentence.
_WORD, _SLOT, _SURELY, _PERHAPS = range(4)
_PLACEHOLDERS = np.array([_NAME, _NUM, _UNIT, _BOTH], dtype=np.uint64)


class Form:
    """An item in one reading."""

    def __init__(self, item_id: int, reading: int, hashes: np.ndarray, kinds: np.ndarray, values: list[str]) -> None:
        self.item_id, self.reading, self.hashes, self.kinds, self.values = item_id, reading, hashes, kinds, values
        self.plain = int((kinds == _WORD).sum())
        self.beside = min(len(hashes) // 2, BESIDE) + 4

    def need(self, coverage: float) -> int:
        """Words that so many of the item's windows would cover on one
        diagonal; one word less than all is enough from a window on."""
        n = len(self.hashes)
        return n if n < WINDOW else min(n - 1, WINDOW - 1 + int(np.ceil(coverage * (n - WINDOW + 1) - 1e-9)))

    def seeds(self) -> np.ndarray:
        """Places of seeds: windows of two words or more that aren't slots,
        if there are any."""
        telling = (self.kinds == _WORD) | (self.kinds == _SURELY) & (self.reading == 0)
        words = np.lib.stride_tricks.sliding_window_view(telling, SEED).sum(axis=1)
        return np.flatnonzero(words >= min(2, words.max()))


def forms(item_id: int, text: str, known: Templates) -> list[Form]:
    marked, words = template(text, known)
    cores = [_core(w) for w in words]
    capital, starts = (marked & np.uint64(_CAPITAL)) != 0, np.ones(len(marked), bool)
    starts[1:] = (marked[:-1] & np.uint64(_STOP)) != 0
    names = {c for c, x in zip(cores, capital & ~starts, strict=True) if x}
    hashes = by_words(marked)
    kinds = np.where(np.isin(hashes, _PLACEHOLDERS), _SLOT, _WORD)
    kinds[[k for k, c in enumerate(cores) if capital[k] and c in names]] = _SURELY
    out = [Form(item_id, 0, hashes, kinds, cores)]
    if capital.any():
        hashes, first = by_names(marked)
        runs = [cores[a:b] for a, b in zip(first.tolist(), [*first[1:].tolist(), len(cores)], strict=True)]
        kinds = np.where(hashes == _NAME, _PERHAPS, np.where(np.isin(hashes, _PLACEHOLDERS), _SLOT, _WORD))
        kinds[[k for k, r in enumerate(runs) if kinds[k] == _PERHAPS and names.intersection(r)]] = _SURELY
        out.append(Form(item_id, 1, hashes, kinds, [" ".join(r) for r in runs]))
    return [f for f in out if len(f.hashes) >= SEED and f.plain]


class Index:
    """Seeds of a block of items: hash and reading to places."""

    def __init__(self, items: list[tuple[int, str]]) -> None:
        known = Templates()
        self.forms = [f for item_id, text in items for f in forms(item_id, text, known)]
        templated = {f.item_id for f in self.forms}
        self.literal: dict[int, dict[int, list[int]]] = {}  # items found as they are: words, hash, ids
        for item_id, text in items:
            if item_id not in templated and (words := template(text, known)[1]):
                of = self.literal.setdefault(len(words), {})
                of.setdefault(int(windows(as_they_are(words), len(words))[0]), []).append(item_id)
        own = [(windows(f.hashes, SEED), f.seeds()) for f in self.forms]
        none = np.empty(0, np.int64)
        hashes = np.concatenate([np.empty(0, np.uint64), *(w[at] for w, at in own)])
        order = np.argsort(hashes, kind="stable")
        self.form = np.concatenate([none, *(np.full(len(at), k) for k, (_, at) in enumerate(own))])[order].astype(np.int32)
        self.at = np.concatenate([none, *(at for _, at in own)])[order].astype(np.int32)
        self.hashes, self.first, self.count = np.unique(hashes[order], return_index=True, return_counts=True)
        self.reading = np.array([f.reading for f in self.forms], np.int32)
        self.beside = np.array([f.beside for f in self.forms], np.int64)
        self.seen = np.zeros(1 << 22, bool)
        self.seen[(self.hashes >> np.uint64(42)).astype(np.int64)] = True


def _core(word: str) -> str:
    return _STRIP.sub("", word).lower()


def as_they_are(words: list[str]) -> np.ndarray:
    """Hashes of words in lower case, without the punctuation around them."""
    return np.fromiter((xxhash.xxh64_intdigest(_core(w)) for w in words), np.uint64, len(words))


def literal_matches(words: list[str], index: Index) -> list[tuple[int, int, float, str]]:
    out = []
    hashes = as_they_are(words) if index.literal else None
    for width, of in index.literal.items():
        for h in set(windows(hashes, width).tolist()) & of.keys():
            out += [(i, max(1, width - WINDOW + 1), 1.0, "copy") for i in of[h]]
    return out


def align(form: Form, doc: np.ndarray, low: int, width: int) -> list[tuple[int, int]]:
    """Places of item and document that the best local alignment on these
    diagonals pairs: 2 for equal templates, 1 for another word in the place of
    a name, -1 for a word changed, put in or left out."""
    n = len(form.hashes)
    part = np.zeros(n + width, np.uint64)
    a, b = max(low, 0), min(low + n + width, len(doc))
    if a >= b:
        return []
    part[a - low : b - low] = doc[a:b]
    facing = np.lib.stride_tricks.sliding_window_view(part, width)[:n]
    score = np.where(facing == form.hashes[:, None], 2, -1)
    if form.reading == 0 and (soft := form.kinds == _SURELY).any():
        word = (part != 0) & ~np.isin(part, _PLACEHOLDERS)
        may = np.lib.stride_tricks.sliding_window_view(word, width)[:n][soft]
        score[soft] = np.where(may, np.maximum(score[soft], 1), score[soft])
    best, ramp = np.zeros((n + 1, width + 1), np.int64), np.arange(width)
    for i in range(n):
        fresh = np.maximum(np.maximum(best[i, :width] + score[i], best[i, 1:] - 1), 0)
        best[i + 1, :width] = np.maximum.accumulate(fresh + ramp) - ramp
    i, c = divmod(int(best.argmax()), width + 1)
    pairs = []
    while (h := best[i, c]) > 0:
        if h == best[i - 1, c] + score[i - 1, c]:
            if score[i - 1, c] > 0:
                pairs.append((i - 1, low + i - 1 + c))
            i -= 1
        elif h == best[i - 1, c + 1] - 1:
            i, c = i - 1, c + 1
        else:
            c -= 1
    return pairs


def _alike(values: set[str]) -> bool:
    """Whether they can be one name, full or in part."""
    longest = set(max(values, key=len).split())
    return all(longest.issuperset(v.split()) for v in values)


def consistent(form: Form, pairs: list[tuple[int, int]], value_of) -> tuple[list[int], bool] | None:
    """The item's words that are covered, and whether all slots are equal.
    None if a slot contradicts itself.  A value that stands for itself
    somewhere is of a copy; what differs from it elsewhere is a changed word,
    as is a capitalised word that may be no name and contradicts itself."""
    found: dict[str, set[str]] = {}
    kinds: dict[str, int] = {}
    said = [(k, form.values[k], value_of(j)) for k, j in pairs if form.kinds[k] != _WORD]
    for k, a, b in said:
        found.setdefault(a, set()).add(b)
        kinds[a] = int(form.kinds[k])
    changed: set[tuple[str, str]] = set()
    for a, of in found.items():
        if len(of) == 1:
            continue
        if a in of:
            changed |= {(a, b) for b in of if b != a}
        elif kinds[a] == _SLOT or not _alike(of):
            if kinds[a] != _PERHAPS:
                return None
            changed |= {(a, b) for b in of}
    lost = {k for k, a, b in said if (a, b) in changed}
    return [k for k, _ in pairs if k not in lost], all(a == b for k, a, b in said if k not in lost)


def matches(text: str | None, index: Index, known: Templates, coverage: float) -> list[tuple[int, int, float, str]]:
    """``(item_id, windows, coverage, kind)`` of items that a text holds."""
    marked, words = template(text, known)
    whole = literal_matches(words, index)
    hashes, first = by_names(marked)
    n, readings = len(marked), (by_words(marked), hashes)
    of = windows(np.concatenate(readings), SEED)
    at = np.flatnonzero(index.seen[(of >> np.uint64(42)).astype(np.int64)])
    if not len(at) or not len(index.hashes):
        return sorted(whole)
    k = np.minimum(np.searchsorted(index.hashes, of[at]), len(index.hashes) - 1)
    met = index.hashes[k] == of[at]
    at, k = at[met], k[met]
    times = index.count[k]
    entry = np.repeat(index.first[k] - (np.cumsum(times) - times), times) + np.arange(times.sum())
    at, form = np.repeat(at, times), index.form[entry]
    shift = at - index.at[entry]
    names = index.reading[form] == 1
    there = np.where(names, at >= n, at <= n - SEED)
    form, shift = form[there], (shift - np.where(names, n, 0))[there]
    order = np.lexsort((shift, form))
    form, shift = form[order], shift[order]
    new = np.ones(len(form), bool)
    new[1:] = (form[1:] != form[:-1]) | (shift[1:] - shift[:-1] > index.beside[form[1:]])
    bounds = np.flatnonzero(new).tolist()
    best: dict[int, tuple[int, int, int, float, str]] = {}
    for a, b in zip(bounds, [*bounds, len(form)][1:], strict=True):
        own, doc = index.forms[form[a]], readings[index.reading[form[a]]]
        size, need = len(own.hashes), own.need(coverage)
        value_of = (lambda j: _core(words[j])) if own.reading == 0 else (lambda j: " ".join(_core(w) for w in words[first[j] : first[j + 1] if j + 1 < len(first) else n]))
        low, last, step = int(shift[a]) - own.beside, int(shift[b - 1]) + own.beside, 2 * own.beside
        while True:  # bands of neighbouring diagonals, each overlapping the next by half
            width = min(last - low + 1, 2 * step + 1)
            might = np.isin(own.hashes, doc[max(low, 0) : max(low + size + width, 0)]) | (own.kinds == _SURELY)
            if might.sum() >= need and (said := consistent(own, align(own, doc, low, width), value_of)):
                covered, equal = said
                plain = sum(own.kinds[k] == _WORD for k in covered)
                if len(covered) >= need and plain >= coverage * own.plain:
                    found = (len(covered), int(equal), max(1, len(covered) - WINDOW + 1), len(covered) / size, "copy" if equal else "other values")
                    best[own.item_id] = max(best.get(own.item_id, found), found)
            if low + width > last:
                break
            low += step
    return sorted(whole + [(i, *x[2:]) for i, x in best.items()])


def _search(index: Index, coverage: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Templates()
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                rows += ((doc_id, *m) for m in matches(text.as_py(), index, known, coverage))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.int32(), pa.float64(), pa.string()))], names=["doc_id", "item_id", "n_windows", "coverage", "kind"])

    return run


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", coverage: float = COVERAGE) -> DataFrame:
    """``doc_id, item_id, n_windows, coverage, kind`` for each document and
    benchmark item that it holds: aligned with consistent slots, as many
    template words in their order as that share of the item's windows covers,
    and that share of those that aren't slots.  n_windows: windows that so many
    words fill.  coverage: share of the item's words.  kind: copy or other
    values.

    Defined results: null and empty texts match nothing, nor do rows of null
    item id; an item of fewer than four words, or of slots alone, matches where
    its words stand in a row, slots as they are; a shorter item than the window
    must be covered whole, others up to one word at least; parts of an
    item with more diagonals between them than half its words, at most BESIDE,
    and four don't add up; repeated rows of documents give repeated rows, items
    of one id count as one; an empty table on either side gives no rows; other
    columns are not looked at."""
    spark = docs.sparkSession
    items = benchmark.select(F.col(item_col).cast("bigint").alias("item_id"), F.col(item_text_col).alias("text")).where("item_id IS NOT NULL AND text IS NOT NULL")
    blocks = -(-(items.agg(F.sum(F.length("text"))).first()[0] or 0) // BLOCK_CHARS)
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    found = spark.createDataFrame([], "doc_id bigint, item_id bigint, n_windows int, coverage double, kind string")
    for k in range(blocks):
        block = items.where(F.pmod(F.xxhash64("text"), F.lit(blocks)) == k).collect()
        part = rows.mapInArrow(_search(Index([(r.item_id, r.text) for r in block]), coverage), found.schema)
        found = part if blocks == 1 else found.unionByName(part)
    return found


def decontaminated(docs: DataFrame, benchmark: DataFrame, **columns_of) -> DataFrame:
    """The documents that hold no benchmark item, all columns.  Rows of one id
    go together; rows of null id are judged by their texts."""
    key, text = columns_of.get("id_col", "doc_id"), columns_of.get("text_col", "text")
    told = docs.select(F.struct("*").alias("_row"), F.col(key).isNull().alias("_null"), F.coalesce(F.col(key).cast("bigint"), F.xxhash64(text)).alias("_key"), F.col(text).alias("_text"))
    how = columns_of | {"id_col": "_key", "text_col": "_text"}
    bad = [contaminated(told.where(F.col("_null") == F.lit(null)), benchmark, **how).select(F.lit(null).alias("_null"), F.col("doc_id").alias("_key")) for null in (False, True)]
    return told.join(bad[0].unionByName(bad[1]).distinct(), ["_null", "_key"], "left_anti").select("_row.*")
