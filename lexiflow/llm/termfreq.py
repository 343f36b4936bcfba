"""Occurrences and records of every distinct term, kept vertically: a compressed bitmap of record identifiers per term.

Identifiers are cut into a block (all but the low 16 bits) and a place in it. A container holds the places of one term in
one block: sorted 16-bit numbers while they are fewer than ``DENSE``, else a bitset of 8 KB; beside it runs the counter of
occurrences. Tasks build containers of the rows they have, equal (term, block) pairs meet and are merged by union, and the
number of records of a term is the sum of its containers' cardinalities. Merging by block spreads a term that stands in
every record over all tasks. A container of the term null holds all records, so their number comes from the same pass.

A (record, position) that came twice counts once. For that the rows of a record are brought together, as whole pieces: rows
that follow each other in the input and have one record and block of positions travel as one row of packed positions,
lengths and characters, a few bytes a token. A record goes by blocks of positions, so even one that has a third of all rows
is spread. Should two deliveries differ in the term, the larger term counts. Rows with a
null record or position are left out; rows with a null term count for the number of records only.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiflow.llm.common import cut

#: From so many places on, a container is a bitset. An array has fewer bytes than a bitset, so the length tells them apart.
DENSE, BITSET_BYTES = 4096, 8192
#: Rows held by a task before their containers leave it.
HELD = 1 << 20
CONTAINERS = "term string, block long, places binary, n long"


def containers(term: np.ndarray, record: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """(term, block, places) for each term code and block of the given rows; a record counts once a term."""
    order = np.lexsort((record, term))
    term, record = term[order], record[order]
    new = np.concatenate([[True], (term[1:] != term[:-1]) | (record[1:] != record[:-1])]) if len(term) else np.zeros(0, bool)
    term, record = term[new], record[new]
    block, place = record >> 16, (record & 0xFFFF).astype("<u2")
    first = np.flatnonzero(np.concatenate([[True], (term[1:] != term[:-1]) | (block[1:] != block[:-1])])) if len(term) else np.zeros(0, np.int64)
    raw, ends = place.tobytes(), np.append(first[1:], len(term))
    out = [raw[2 * a : 2 * b] if b - a < DENSE else bitset(place[a:b]) for a, b in zip(first.tolist(), ends.tolist(), strict=True)]
    return term[first], block[first], out


def bitset(places: np.ndarray) -> bytes:
    bits = np.zeros(1 << 16, dtype=np.uint8)
    bits[places] = 1
    return np.packbits(bits, bitorder="little").tobytes()


def union_sizes(group: np.ndarray, groups: int, places: list[bytes]) -> np.ndarray:
    """Cardinality of the union of the containers of each group; ``group`` rises."""
    sizes = np.zeros(groups, dtype=np.int64)
    length = np.fromiter(map(len, places), np.int64, len(places))
    dense = np.zeros(groups, dtype=bool)
    dense[group[length == BITSET_BYTES]] = True
    plain = ~dense[group]
    if plain.any():
        low = np.frombuffer(b"".join(p for p, keep in zip(places, plain, strict=True) if keep), dtype="<u2")
        key = np.repeat(group[plain], length[plain] // 2) << 16 | low
        sizes += np.bincount(np.unique(key) >> 16, minlength=groups)
    for g in np.flatnonzero(dense):
        bits = np.zeros(1 << 16, dtype=bool)
        for i in range(*np.searchsorted(group, [g, g + 1])):
            if length[i] == BITSET_BYTES:
                bits |= np.unpackbits(np.frombuffer(places[i], dtype=np.uint8), bitorder="little").view(bool)
            else:
                bits[np.frombuffer(places[i], dtype="<u2")] = True
        sizes[g] = np.count_nonzero(bits)
    return sizes


PIECES = "record long, block long, places binary, sizes binary, text binary"


def _slices(data: np.ndarray | pa.Buffer, ends: np.ndarray) -> pa.Array:
    """A buffer cut at ``ends`` into binary values, without a copy."""
    return pa.Array.from_buffers(pa.large_binary(), len(ends) - 1, [None, pa.py_buffer(ends.astype(np.int64)), data if isinstance(data, pa.Buffer) else pa.py_buffer(data)]).cast(pa.binary())


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From (record, position, term) rows to pieces: a null term has the size -1."""
    for batch in batches:
        if not batch.num_rows:
            continue
        record, position, term = batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(2).cast(pa.large_string())
        block = position >> 16
        first = np.flatnonzero(np.concatenate([[True], (record[1:] != record[:-1]) | (block[1:] != block[:-1])]))
        ends = np.append(first, len(record))
        sizes = pc.fill_null(pc.binary_length(term), -1).to_numpy(zero_copy_only=False).astype("<i4")
        stops = np.concatenate([[0], np.cumsum(np.maximum(sizes, 0), dtype=np.int64)])
        text = pc.fill_null(term, "")
        data = text.buffers()[2]
        shift = np.frombuffer(text.buffers()[1], dtype=np.int64)[text.offset]
        yield pa.RecordBatch.from_arrays([
            pa.array(record[first]), pa.array(block[first]), _slices((position & 0xFFFF).astype("<u2"), 2 * ends), _slices(sizes, 4 * ends), _slices(data if data is not None else pa.py_buffer(b""), shift + stops[ends]),
        ], ["record", "block", "places", "sizes", "text"])


def _unpacked(held: list[pa.RecordBatch]) -> tuple[np.ndarray, pa.Array]:
    """(record, term) of the different (record, position) of some pieces; of several terms the largest counts, null the least."""
    part = pa.Table.from_batches(held).combine_chunks()
    joined = lambda name: b"".join(part.column(name).to_pylist())
    place, size = np.frombuffer(joined("places"), dtype="<u2").astype(np.int64), np.frombuffer(joined("sizes"), dtype="<i4").astype(np.int64)
    record, block = part.column("record").to_numpy(), part.column("block").to_numpy()
    count = pc.binary_length(part.column("places")).to_numpy() // 2
    ends = np.concatenate([[0], np.cumsum(np.maximum(size, 0))])
    term = pa.Array.from_buffers(pa.large_string(), len(size), [None, pa.py_buffer(ends), pa.py_buffer(joined("text"))])
    if (size < 0).any():
        term = pc.if_else(pa.array(size >= 0), term, pa.scalar(None, pa.large_string()))
    group = np.cumsum(np.concatenate([[True], (record[1:] != record[:-1]) | (block[1:] != block[:-1])])) - 1
    key = np.repeat(group, count) << 16 | place
    record = np.repeat(record, count)
    if not (key[1:] > key[:-1]).all():
        order = np.argsort(key, kind="stable")
        key = key[order]
        new = np.concatenate([[True], key[1:] != key[:-1]])
        if not new.all():
            first = np.flatnonzero(new)
            several = first[np.diff(np.append(first, len(key))) > 1]
            stop = np.append(first[1:], len(key))[np.searchsorted(first, several)]
            for a, b in zip(several.tolist(), stop.tolist(), strict=True):
                own = [(x is not None, x or "", i) for i, x in zip(order[a:b].tolist(), term.take(pa.array(order[a:b])).to_pylist(), strict=True)]
                order[a] = max(own)[2]
            order = order[first]
        record, term = record[order], term.take(pa.array(order))
    return record, term


def _build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From pieces sorted by record and block to containers."""
    held, tokens = [], 0

    def flush(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        record, term = _unpacked(held)
        coded = term.dictionary_encode()
        code = pc.fill_null(coded.indices, -1).to_numpy(zero_copy_only=False).astype(np.int64)
        words = len(coded.dictionary)
        some = code >= 0
        t, b, p = containers(np.concatenate([code[some], np.full(len(record), words)]), np.concatenate([record[some], record]))
        n = np.bincount(code[some], minlength=words + 1)
        n = np.where(np.concatenate([[True], t[1:] != t[:-1]]), n[t], 0)  # the counter goes with the term's first container
        names = coded.dictionary.take(pa.array(np.where(t == words, -1, t), pa.int64(), mask=t == words))
        return pa.RecordBatch.from_arrays([names.cast(pa.string()), pa.array(b, pa.int64()), pa.array(p, pa.binary()), pa.array(n, pa.int64())], ["term", "block", "places", "n"])

    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        tokens += pc.sum(pc.binary_length(batch.column("places"))).as_py() // 2
        if tokens >= HELD:  # the last record and block may go on in the next batch
            part = pa.Table.from_batches(held).combine_chunks()
            record, block = part.column("record").to_numpy(), part.column("block").to_numpy()
            last = len(record) - int(np.argmin(((record == record[-1]) & (block == block[-1]))[::-1])) if not ((record == record[0]) & (block == block[0])).all() else 0
            if last:
                yield flush(part.slice(0, last).to_batches())
                held = part.slice(last).to_batches()
                tokens = sum(pc.sum(pc.binary_length(x.column("places"))).as_py() // 2 for x in held)
    if held:
        yield flush(held)


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From containers sorted by term and block to (term, records, n) for each term and block."""
    rest: pa.Table | None = None

    def borders(part: pa.Table) -> np.ndarray:
        code = part.column("term").combine_chunks().dictionary_encode(null_encoding="encode")
        code = (code.combine_chunks() if isinstance(code, pa.ChunkedArray) else code).indices.to_numpy()
        block = part.column("block").to_numpy()
        return np.flatnonzero(np.concatenate([[True], (code[1:] != code[:-1]) | (block[1:] != block[:-1])]))

    def merged(part: pa.Table, first: np.ndarray) -> pa.RecordBatch:
        group = np.zeros(part.num_rows, dtype=np.int64)
        group[first[1:]] = 1
        group = np.cumsum(group)
        sizes = union_sizes(group, len(first), part.column("places").to_pylist())
        n = np.add.reduceat(part.column("n").to_numpy(), first)
        names = part.column("term").take(pa.array(first)).combine_chunks()
        return pa.RecordBatch.from_arrays([names.cast(pa.string()), pa.array(sizes), pa.array(n)], ["term", "records", "n"])

    for batch in batches:
        if not batch.num_rows:
            continue
        part = pa.Table.from_batches([batch])
        part = (part if rest is None else pa.concat_tables([rest, part])).combine_chunks()
        first = borders(part)
        if len(first) > 1:
            yield merged(part.slice(0, first[-1]), first[:-1])
        rest = part.slice(first[-1])
    if rest is not None:
        yield merged(rest.combine_chunks(), np.zeros(1, dtype=np.int64))


def term_frequencies(df: DataFrame, record: str, position: str, term: str) -> DataFrame:
    """(term, occurrences, records) of every distinct term; the row of the null term has the number of all records."""
    src = df.select(F.col(record).cast("long").alias("record"), F.col(position).cast("long").alias("position"), F.col(term).cast("string").alias("term"))
    pieces = src.where("record is not null and position is not null").mapInArrow(_pack, PIECES).repartition("record", "block")
    built = pieces.sortWithinPartitions("record", "block").mapInArrow(_build, CONTAINERS)
    merged = built.repartition("term", "block").sortWithinPartitions("term", "block").mapInArrow(_merge, "term string, records long, n long")
    return merged.groupBy("term").agg(F.sum("n").alias("occurrences"), F.sum("records").alias("records"))


def marked(frequencies: DataFrame, least_occurrences: int = 5, least_records: int = 3, common_share: float = 0.1) -> DataFrame:
    """(term, occurrences, records, mark): 'rare' below either minimum, else 'common' in more than the share of all records, else null.

    The frequencies are written once, as the number of all records is one of their rows.
    """
    kept = cut(frequencies)
    total = kept.where("term is null").select("records")
    share = F.col("records") > F.lit(common_share) * total.scalar()
    rare = (F.col("occurrences") < least_occurrences) | (F.col("records") < least_records)
    return kept.where("term is not null").withColumn("mark", F.when(rare, "rare").when(share, "common"))
