"""Merkle manifest of a dataset: a digest for each row, a tree of 16 branches
over the rows of each source, one over the sources, and each row's proof.

Trees are built by appending to open subtrees.  A node's witness, the siblings
that lead up from it, hangs on the subtree that it is in; when later siblings
complete a run, the witnesses on all of them are extended and move on to the
parent.  Blocks of 4,096 consecutive nodes are aligned with the tree, so that
tasks append to blocks of their own; the roots of blocks are appended to blocks
of the next tree in the same way, until each source has one, and then those of
the sources.  What a block's root got as witness extends those of its nodes on
the way back.  No task holds more than a block, and only digests are moved."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from hashlib import sha256
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folium.llm.common import UPPER, ascii_lower, discard, written
from folium.operators.storage import numbered_within

BRANCHES = 16
#: Tree levels in a block, and its nodes.
LEVELS = 3
BLOCK = BRANCHES**LEVELS
#: Rows that a task hands on at a time: each has a proof of some kilobytes.
ROWS = 256

STEP = "struct<before: string, after: string>"
Step = tuple[str, str]


class OpenTree:
    """A tree under construction.  Digests are hexadecimal; a witness is a
    list of steps, one for each level, with the digests of the run before and
    after the node."""

    def __init__(self) -> None:
        self.runs: list[list[tuple[str, list[list[Step]]]]] = [[]]

    def append(self, digest: str, witnesses: list[list[Step]], level: int = 0) -> None:
        if level == len(self.runs):
            self.runs.append([])
        self.runs[level].append((digest, witnesses))
        if len(self.runs[level]) == BRANCHES:
            self._complete(level)

    def _complete(self, level: int) -> None:
        run, self.runs[level] = self.runs[level], []
        whole = "".join(digest for digest, _ in run)
        for place, (digest, witnesses) in enumerate(run):
            step = (whole[: len(digest) * place], whole[len(digest) * (place + 1) :])
            for witness in witnesses:
                witness.append(step)
        self.append(sha256(whole.encode()).hexdigest(), [w for _, witnesses in run for w in witnesses], level + 1)

    def root(self, levels: int | None = None) -> str:
        """Completes what is open, over so many levels or until one node is
        left, and gives that one's digest."""
        level = 0
        while level < levels if levels is not None else sum(map(len, self.runs)) > 1:
            if self.runs[level]:
                self._complete(level)
            level += 1
        return next(run[0][0] for run in reversed(self.runs) if run)


def leaf_digest(fields: list[Column]) -> Column:
    """Hexadecimal SHA-256 of fields one after another: ``-`` if null, else
    the number of bytes, a colon and the value."""
    told = [F.coalesce(F.concat(F.octet_length(f.cast("string")).cast("string"), F.lit(":"), f.cast("string")), F.lit("-")) for f in fields]
    return F.sha2(F.concat(*told), 256)


def folded(leaf: Column, proof: Column) -> Column:
    """The root that a leaf and the siblings of a proof give."""
    return F.aggregate(proof, leaf, lambda h, step: F.sha2(F.concat(step["before"], h, step["after"]), 256))


def proof_digest(proof: Column) -> Column:
    return F.sha2(F.array_join(F.transform(proof, lambda step: F.concat(step["before"], step["after"])), ""), 256)


# -- trees of nodes (tree, number, digest) with numbers from 0 in each tree


def _grouped(rows: DataFrame) -> DataFrame:
    blocks = rows.withColumn("block", F.floor(F.col("number") / BLOCK)) if "block" not in rows.columns else rows
    return blocks.repartition("tree", "block").sortWithinPartitions("tree", "block", "number")


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)


def _levels_of(block: int, size: int) -> int | None:
    """A first block that isn't full is all of its tree, and so ends in one
    node; others rise as far as a block does, the last ones too."""
    return None if block == 0 and size < BLOCK else LEVELS


def _block_roots(nodes: DataFrame) -> DataFrame:
    """``tree, number, digest, whole``: the roots of blocks as nodes of the
    next tree; whole where the block is all of its tree."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made: list[tuple] = []
        for (tree, block), own in groupby(_rows(batches), lambda r: r[:2]):
            open_tree, size = OpenTree(), 0
            for row in own:
                open_tree.append(row[2].hex(), [])
                size += 1
            levels = _levels_of(block, size)
            made.append((tree, block, bytes.fromhex(open_tree.root(levels)), levels is None))
            if len(made) == 16 * ROWS:
                yield batch_of(made)
                made = []
        if made:
            yield batch_of(made)

    def batch_of(made: list[tuple]) -> pa.RecordBatch:
        kinds = (pa.string(), pa.int64(), pa.binary(), pa.bool_())
        return pa.RecordBatch.from_arrays([pa.array([r[c] for r in made], kind) for c, kind in enumerate(kinds)], names=["tree", "number", "digest", "whole"])

    return _grouped(nodes.select("tree", "number", "digest")).select("tree", "block", "digest").mapInArrow(run, "tree string, number bigint, digest binary, whole boolean")


def _climbed(nodes: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """The levels of blocks, from nodes (a written table) up, and the roots
    (tree, digest, level) of the trees."""
    levels, roots = [nodes], []
    while True:
        made = written(_block_roots(levels[-1]), "merkle-roots")
        roots.append(made.where("whole").select("tree", "digest", F.lit(len(levels) - 1).alias("level")))
        upper = made.where("NOT whole").drop("whole")
        if upper.isEmpty():
            return levels, reduce(DataFrame.unionByName, roots)
        levels.append(upper)


def _witnessed(nodes: DataFrame, uppers: DataFrame) -> DataFrame:
    """Nodes with ``witness``, their steps up to the end of what the uppers
    (tree, block, upper, subroot, root) of their blocks have."""
    payload = [c for c in nodes.columns if c not in ("tree", "number", "digest")]
    both = nodes.withColumn("block", F.floor(F.col("number") / BLOCK)).unionByName(uppers.withColumn("number", F.lit(-1).cast("bigint")), allowMissingColumns=True)
    first = ["tree", "block", "number", "digest", "upper", "subroot", "root", *payload]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (tree, block), own in groupby(_rows(batches), lambda r: r[:2]):
            *_, upper, subroot, root = next(own)[:7]
            steps = [(s["before"], s["after"]) for s in upper]
            open_tree, rows, witnesses = OpenTree(), [], []
            for row in own:
                rows.append(row)
                witnesses.append([])
                open_tree.append(row[3].hex(), [witnesses[-1]])
            open_tree.root(_levels_of(block, len(rows)))
            for at in range(0, len(rows), ROWS):
                some = rows[at : at + ROWS]
                proofs = [witness + steps for witness in witnesses[at : at + ROWS]]
                flat = [step for proof in proofs for step in proof]
                ends = [0]
                for proof in proofs:
                    ends.append(ends[-1] + len(proof))
                parts = pa.StructArray.from_arrays([pa.array([s[k] for s in flat], pa.string()) for k in range(2)], ["before", "after"])
                constant = [pa.array([x] * len(some), pa.string()) for x in (tree, subroot, root)]
                yield pa.RecordBatch.from_arrays(
                    [constant[0], pa.array([r[2] for r in some], pa.int64()), pa.array([r[3] for r in some], pa.binary()), *constant[1:], pa.ListArray.from_arrays(pa.array(ends, pa.int32()), parts)]
                    + [pa.array([r[7 + c] for r in some], kinds[name]) for c, name in enumerate(payload)],
                    names=["tree", "number", "digest", "subroot", "root", "witness", *payload],
                )

    kinds = {"doc_id": pa.int64(), "also": pa.binary(), "name": pa.string()}
    told = {"doc_id": "bigint", "also": "binary", "name": "string"}
    return _grouped(both).select(first).mapInArrow(run, f"tree string, number bigint, digest binary, subroot string, root string, witness array<{STEP}>" + "".join(f", {c} {told[c]}" for c in payload))


def _proven(levels: list[DataFrame], tops: DataFrame) -> DataFrame:
    """The lowest nodes with their witnesses.  tops: what a tree's root is
    given (tree, level, upper, subroot, root)."""
    found: DataFrame | None = None
    for k in range(len(levels) - 1, -1, -1):
        uppers = tops.where(F.col("level") == k).select("tree", F.lit(0).cast("bigint").alias("block"), "upper", "subroot", "root")
        if found is not None:
            uppers = uppers.unionByName(found.select("tree", F.col("number").alias("block"), F.col("witness").alias("upper"), "subroot", "root"))
        found = _witnessed(levels[k], uppers)
    return found


def merkle_manifest(docs: DataFrame, fields: tuple[str, ...] = ("doc_id", "source", "lang", "n_chars", "text"), key: str = "doc_id", source: str = "source", also: Column | None = None) -> DataFrame:
    """``key, leaf, subroot, root, proof`` for each row, and ``also``, a digest
    that is carried along, where one is given.  proof has a step for each level
    from the leaf to the root: the digests of its run before and after it.

    Defined results: nulls in any field are told from empty values; rows of
    null source are a source of its own, before all others; rows of null key
    come first in their source, and rows of one key in order of their leaves,
    repeated rows each with a leaf; a table of one row has its leaf as subroot
    and root and a proof without steps; an empty table gives no rows.  Other
    columns aren't looked at."""
    name = F.coalesce(F.concat(F.lit("="), F.col(source)), F.lit(""))
    narrow = docs.select(name.alias("tree"), F.col(key).cast("bigint").alias("doc_id"), F.unhex(leaf_digest([F.col(f) for f in fields])).alias("digest"), (F.unhex(also) if also is not None else F.lit(None).cast("binary")).alias("also"))
    narrow = written(narrow.withColumn("order", F.struct("doc_id", "digest")), "merkle-leaves")
    leaves = written(numbered_within(narrow, "tree", "order").select("tree", "number", "digest", "doc_id", "also"), "merkle-nodes")
    discard(narrow)
    levels, subroots = _climbed(leaves)
    subroots = written(subroots, "merkle-subroots")
    every = subroots.select(F.lit("").alias("tree"), F.col("tree").alias("name"), "digest")
    sources = written(numbered_within(every, "tree", "name").select("tree", "number", "digest", "name"), "merkle-sources")
    tops, roots = _climbed(sources)
    nothing = F.array().cast(f"array<{STEP}>").alias("upper")
    top = _proven(tops, roots.select("tree", "level", nothing, F.lit(None).cast("string").alias("subroot"), F.lower(F.hex("digest")).alias("root")))
    given = top.select(F.col("name").alias("tree"), F.col("witness").alias("upper"), F.lower(F.hex("digest")).alias("subroot"), "root").join(subroots.select("tree", "level"), "tree")
    proven = _proven(levels, given)
    return proven.select(F.col("doc_id").alias(key), F.lower(F.hex("digest")).alias("leaf"), "subroot", "root", F.col("witness").alias("proof"), *([F.lower(F.hex("also")).alias("also")] if also is not None else []))


def verified_manifest(docs: DataFrame) -> DataFrame:
    """The manifest's digests of documents, and whether the root is met again
    from rows of which every fifth, by the CRC-32 of its id, has lost the
    capitals of its text."""
    chosen = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    tampered = F.when(chosen, ascii_lower(F.col("text"))).otherwise(F.col("text"))
    fields = [F.col("doc_id"), F.col("source"), F.col("lang"), F.col("n_chars"), tampered]
    made = merkle_manifest(docs, also=F.when(chosen, leaf_digest(fields)))
    back = folded(F.coalesce("also", "leaf"), F.col("proof"))
    return made.select("doc_id", "leaf", "subroot", "root", proof_digest(F.col("proof")).alias("proof_sha256"), back.alias("folded_root")).withColumn("verified", F.col("folded_root") == F.col("root"))


def op13_sql(levels: int = 6) -> str:
    """The same with so many levels written out for each tree: enough for
    sources of 16 million rows each."""
    field = lambda c: f"coalesce(strlen({c}::VARCHAR)::VARCHAR || ':' || {c}::VARCHAR, '-')"
    leaf = lambda text: "sha256(" + " || ".join(field(c) for c in ("doc_id", "source", "lang", "n_chars", text)) + ")"
    crc = """xor(list_reduce(list_prepend(4294967295::UBIGINT, list_transform(range(1, length(s) + 1), lambda i: ascii(substr(s, i, 1))::UBIGINT)),
             lambda a, x: list_reduce([xor(a, x), 0, 0, 0, 0, 0, 0, 0, 0], lambda h, z: (CASE WHEN h & 1 = 1 THEN xor(h >> 1, 3988292384::UBIGINT) ELSE h >> 1 END))), 4294967295::UBIGINT)"""

    def tree(p: str) -> str:
        out = []
        for k in range(levels):
            run = f"OVER (PARTITION BY g, i // {BRANCHES} ORDER BY i ROWS BETWEEN"
            out.append(f"{p}p{k} AS MATERIALIZED (SELECT g, i, h, count(*) OVER (PARTITION BY g) > 1 AS many, coalesce(string_agg(h, '') {run} UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS a, coalesce(string_agg(h, '') {run} 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS b FROM {p}n{k})")
            out.append(f"{p}n{k + 1} AS MATERIALIZED (SELECT g, i // {BRANCHES} AS i, CASE WHEN bool_or(many) THEN sha256(string_agg(h, '' ORDER BY i)) ELSE any_value(h) END AS h FROM {p}p{k} GROUP BY g, i // {BRANCHES})")
        return ",\n".join(out)

    def up(p: str, start: str) -> str:
        out, before = [], start
        for k in range(levels):
            now = f"{p}w{k}"
            out.append(f"{now} AS (SELECT w.* EXCLUDE (proof, fold), w.proof || CASE WHEN many THEN a || b ELSE '' END AS proof, CASE WHEN many THEN sha256(a || fold || b) ELSE fold END AS fold FROM {before} w JOIN {p}p{k} p ON p.g = w.{p}g AND p.i = w.{p}i // {BRANCHES**k})")
            before = now
        return ",\n".join(out)

    return f"""
    WITH d AS (SELECT *, CASE WHEN {crc} % 5 = 0 THEN translate(text, '{UPPER}', '{UPPER.lower()}') ELSE text END AS other FROM (SELECT *, coalesce(doc_id::VARCHAR, '') AS s FROM documents)),
    l AS MATERIALIZED (SELECT doc_id, coalesce('=' || source, '') AS g, {leaf('text')} AS leaf, {leaf('other')} AS changed FROM d),
    o AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i FROM l),
    sn0 AS (SELECT g, i, leaf AS h FROM o), {tree('s')},
    r AS MATERIALIZED (SELECT g AS name, h AS subroot, row_number() OVER (ORDER BY g) - 1 AS i FROM sn{levels}),
    tn0 AS (SELECT 0 AS g, i, subroot AS h FROM r), {tree('t')},
    w AS (SELECT doc_id, leaf, subroot, g AS sg, o.i AS si, 0 AS tg, r.i AS ti, '' AS proof, changed AS fold FROM o JOIN r ON o.g = r.name),
    {up('s', 'w')}, {up('t', f'sw{levels - 1}')}
    SELECT doc_id, leaf, subroot, n.h AS root, sha256(proof) AS proof_sha256, fold AS folded_root, fold = n.h AS verified FROM tw{levels - 1} JOIN tn{levels} n ON true
    """
