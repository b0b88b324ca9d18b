"""Counting every distinct term with burst tries."""

from __future__ import annotations

import struct
from collections import Counter
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenry.functions.text import tokenize
from lumenry.stage import stage

BURST = 512
ROUTE_DEPTH = 3
PIECE_TERMS = 4096


class BurstTrie:
    """Counts of terms; a container that outgrows ``burst`` terms becomes a node of the trie.

    A node is a dict from a character to a node or container, with the counts
    of the term that ends there under the empty string. A container is a dict
    from the rest of a term to its counters ``[occurrences, records]``; it is
    wrapped in a list to tell it from a node.
    """

    def __init__(self, burst: int = BURST):
        self.root: dict | list = [{}]
        self.burst = burst

    def add(self, term: str, occurrences: int, records: int) -> None:
        parent, key, spot, at = None, "", self.root, 0
        while isinstance(spot, dict):
            if at == len(term):
                counts = spot.setdefault("", [0, 0])
                counts[0] += occurrences
                counts[1] += records
                return
            parent, key = spot, term[at]
            at += 1
            if key not in spot:
                spot[key] = [{}]
            spot = spot[key]
        held = spot[0]
        counts = held.get(term[at:])
        if counts is None:
            held[term[at:]] = [occurrences, records]
            if len(held) > self.burst:
                node = self._split(held)
                if parent is None:
                    self.root = node
                else:
                    parent[key] = node
        else:
            counts[0] += occurrences
            counts[1] += records

    @staticmethod
    def _split(held: dict) -> dict:
        node: dict = {}
        for rest, counts in held.items():
            if not rest:
                node[""] = counts
            else:
                node.setdefault(rest[0], [{}])[0][rest[1:]] = counts
        return node

    def leaves(self) -> Iterator[tuple[str, dict]]:
        """Each container with its prefix, in no order; ends at nodes come as containers of one."""
        todo: list[tuple[str, dict | list]] = [("", self.root)]
        while todo:
            prefix, spot = todo.pop()
            if isinstance(spot, list):
                if spot[0]:
                    yield prefix, spot[0]
                continue
            for key, below in spot.items():
                if key == "":
                    yield prefix, {"": below}
                else:
                    todo.append((prefix + key, below))


def pack(terms: Iterable[tuple[str, int, int]]) -> bytes:
    """Sorted terms as front-coded bytes: the length shared with the last term, the rest, both counters."""
    out, last = bytearray(), b""
    for term, occurrences, records in sorted(terms):
        raw = term.encode()
        shared, most = 0, min(len(last), len(raw))
        while shared < most and last[shared] == raw[shared]:
            shared += 1
        out += struct.pack("<IIQQ", shared, len(raw) - shared, occurrences, records) + raw[shared:]
        last = raw
    return bytes(out)


def unpack(blob: bytes) -> Iterator[tuple[str, int, int]]:
    at, last = 0, b""
    while at < len(blob):
        shared, rest, occurrences, records = struct.unpack_from("<IIQQ", blob, at)
        at += 24
        last = last[:shared] + blob[at : at + rest]
        at += rest
        yield last.decode(), occurrences, records


def _count(batches: Iterator[pa.RecordBatch], burst: int) -> Iterator[pa.RecordBatch]:
    """Per partition one trie; its subtrees leave in pieces under their prefix."""
    trie, held = BurstTrie(burst), 0

    def flush() -> Iterator[pa.RecordBatch]:
        prefixes, blobs, sizes = [], [], []
        for prefix, container in trie.leaves():
            by_route: dict[str, list] = {}
            for rest, (occurrences, records) in container.items():
                term = prefix + rest
                by_route.setdefault(term[:ROUTE_DEPTH], []).append((term, occurrences, records))
            for route, terms in by_route.items():
                for i in range(0, len(terms), PIECE_TERMS):
                    piece = terms[i : i + PIECE_TERMS]
                    prefixes.append(route)
                    blobs.append(pack(piece))
                    sizes.append(len(piece))
        yield pa.record_batch([pa.array(prefixes, pa.string()), pa.array(blobs, pa.binary()), pa.array(sizes, pa.int64())], ["prefix", "blob", "terms"])

    for batch in batches:
        column = batch.column(0)
        words = column.flatten().to_pylist()
        occurrences = Counter(words)
        records = Counter(w for row in column.to_pylist() if row for w in set(row))
        for term, n in occurrences.items():
            trie.add(term, n, records[term])
        held += len(occurrences)
        if held > 4_000_000:  # what a worker holds is bounded; the pieces merge later anyway
            yield from flush()
            trie, held = BurstTrie(burst), 0
    yield from flush()


def _merge(batches: Iterator[pa.RecordBatch], burst: int) -> Iterator[pa.RecordBatch]:
    """Matching subtrees of one route, from all workers, into one trie."""
    trie = BurstTrie(burst)
    for batch in batches:
        for blob in batch.column("blob").to_pylist():
            for term, occurrences, records in unpack(blob):
                trie.add(term, occurrences, records)
    for prefix, container in trie.leaves():
        terms = [prefix + rest for rest in container]
        counts = list(container.values())
        yield pa.record_batch(
            [pa.array(terms, pa.string()), pa.array([c[0] for c in counts], pa.int64()), pa.array([c[1] for c in counts], pa.int64())],
            ["term", "occurrences", "records"],
        )


def _reroute(depths: dict[str, int]):
    """Pieces under the global routes; a piece whose terms part further down is divided."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            routes, blobs = [], []
            for prefix, blob in zip(batch.column("prefix").to_pylist(), batch.column("blob").to_pylist()):
                depth = depths.get(prefix, ROUTE_DEPTH)
                if depth <= ROUTE_DEPTH:
                    routes.append(prefix[:depth])
                    blobs.append(blob)
                    continue
                parts: dict[str, list] = {}
                for term in unpack(blob):
                    parts.setdefault(term[0][:depth], []).append(term)
                for route, terms in parts.items():
                    routes.append(route)
                    blobs.append(pack(terms))
            yield pa.record_batch([pa.array(routes, pa.string()), pa.array(blobs, pa.binary())], ["route", "blob"])

    return run


def term_counts(rows: DataFrame, text: str, route_terms: int = 200_000, burst: int = BURST) -> DataFrame:
    """``(term, occurrences, records)`` of all words of the non-null values of ``text``.

    Workers count into burst tries and send their subtrees, packed, under a
    prefix of three characters. There are at most 37 + 37^2 + 37^3 such
    prefixes whatever the data (the words' alphabet has 37 characters), so
    their sizes go to the driver, which widens light routes to one or two
    characters and deepens heavy ones. Matching subtrees are merged by route.
    A null or blank text holds no terms; an empty table gives no rows.
    """
    words = rows.where(F.col(text).isNotNull()).select(tokenize(F.col(text)).alias("words"))
    tries = stage(words.mapInArrow(lambda batches: _count(batches, burst), "prefix string, blob binary, terms bigint"), "tries")
    sizes = {r["prefix"]: r["n"] for r in tries.groupBy("prefix").agg(F.sum("terms").alias("n")).collect()}
    depths = _depths(sizes, route_terms)
    routed = tries.mapInArrow(_reroute(depths), "route string, blob binary")
    return routed.groupBy("route").applyInArrow(lambda table: _merge_table(table, burst), "term string, occurrences bigint, records bigint")


def _merge_table(table: pa.Table, burst: int) -> pa.Table:
    schema = pa.schema([("term", pa.string()), ("occurrences", pa.int64()), ("records", pa.int64())])
    return pa.Table.from_batches(_merge(iter(table.to_batches()), burst), schema)


def _depths(sizes: dict[str, int], route_terms: int) -> dict[str, int]:
    """Length of the route of each prefix: 1 or 2 where all below it is light, more than 3 where it is heavy."""
    below: Counter = Counter()
    for prefix, n in sizes.items():
        for k in (1, 2):
            below[prefix[:k]] += n if len(prefix) >= k else 0
    depths = {}
    for prefix, n in sizes.items():
        if below[prefix[:1]] <= route_terms:
            depths[prefix] = 1
        elif below[prefix[:2]] <= route_terms:
            depths[prefix] = 2
        else:
            depths[prefix] = ROUTE_DEPTH
            while n > route_terms:
                depths[prefix] += 1
                n //= 6
    return depths


def marked_terms(rows: DataFrame, text: str, least: int = 2, common_share: float = 0.25, burst: int = BURST) -> DataFrame:
    """``term_counts`` with ``mark``: ``rare`` under ``least`` occurrences, ``common`` in more than
    ``common_share`` of the records with text, else null. A term that is both (tiny tables) is ``rare``."""
    n = rows.agg(F.count(text).alias("n_records"))
    return (
        term_counts(rows, text, burst=burst).crossJoin(F.broadcast(n))  # one row
        .withColumn(
            "mark",
            F.when(F.col("occurrences") < least, "rare").when(F.col("records") > common_share * F.col("n_records"), "common"),
        )
        .drop("n_records")
    )
