"""Frequencies of terms and n-grams with their record counts: suffix-sorted counting."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from frameloom.runtime import cut

#: A shard, the rows of one (first term, salt) that one stack reads, is planned for at most so many rows; it bounds the record sets.
SHARD_ROWS = 200_000
#: Terms that need more than one shard are sent to every executor if there are at most so many, else joined by a shuffle.
FEW_TERMS = 100_000


class SuffixStack:
    """Counts all prefixes of suffixes that arrive in descending lexicographic order.

    The stack holds the terms of the current suffix with count and records so far. What the next suffix doesn't share
    is finished: it is popped, given out, and its records are merged into its parent's, the smaller set into the larger.
    """

    def __init__(self, keep_sets: bool):
        self.terms: list[str] = []
        self.counts: list[int] = []
        self.records: list[set] = []
        self.distinct: list[int] = []
        self.last = None
        self.keep_sets = keep_sets

    def cut_to(self, depth: int) -> Iterator[tuple[list[str], int, int]]:
        while len(self.terms) > depth:
            ngram, count, found, distinct = list(self.terms), self.counts.pop(), self.records.pop(), self.distinct.pop()
            self.terms.pop()
            yield ngram, count, len(found) if self.keep_sets else distinct
            if self.terms:
                self.counts[-1] += count
                if len(self.records[-1]) < len(found):
                    self.records[-1], found = found, self.records[-1]
                self.records[-1] |= found

    def add(self, suffix: list[str], record) -> Iterator[tuple[list[str], int, int]]:
        """One row; rows of one suffix arrive by record."""
        yield from self.add_run(suffix, 1, [] if record is None else [record])

    def add_run(self, suffix: list[str], times: int, records: list) -> Iterator[tuple[list[str], int, int]]:
        """A run of rows with one suffix: how often it occurs and its distinct records in order."""
        shared = 0
        for a, b in zip(self.terms, suffix):
            if a != b:
                break
            shared += 1
        yield from self.cut_to(shared)
        if len(suffix) > shared:
            self.last = None
        for term in suffix[shared:]:
            self.terms.append(term)
            self.counts.append(0)
            self.records.append(set())
            self.distinct.append(0)
        self.counts[-1] += times
        if len(records):
            if self.keep_sets:
                self.records[-1].update(records)
            else:
                self.distinct[-1] += len(records) - (self.last is not None and records[0] == self.last)
                self.last = records[-1]


def _suffixes(rows: DataFrame, groups: list[str], max_len: int) -> DataFrame:
    """Every position's suffix, truncated to ``max_len`` terms, and how often it occurs. Each term goes to the starts it can belong to, so no
    task ever holds a whole record, however long."""
    # copies of a row are merged before they are routed, and rows that have no place are counted, so that neither pile up in one task
    keyed = rows.where("record is not null and position is not null").distinct()
    loose = rows.where("record is null or position is null").groupBy(*groups, "record", "term").agg(F.count(F.lit(1)).alias("times"))
    alone = lambda df: df.select(*groups, "record", F.array("term").alias("suffix"), F.lit(1).cast("long").alias("times"))
    loose = loose.select(*groups, "record", F.array("term").alias("suffix"), "times")
    if max_len == 1:
        return alone(keyed).unionByName(loose)
    placed = rows.where("record is not null and position is not null").groupBy(*groups, "record", "position").agg(F.array_sort(F.collect_set("term")).alias("terms"))
    # where several terms stand in one place the first goes on into n-grams, the others count by themselves
    spread = placed.select(*groups, "record", F.element_at("terms", 1).alias("term"), F.explode(F.sequence(F.lit(0), F.lit(max_len - 1))).alias("j"), "position").withColumn("position", F.col("position") - F.col("j"))
    others = alone(placed.where("size(terms) > 1").select(*groups, "record", "position", F.explode(F.slice("terms", F.lit(2), F.size("terms"))).alias("term")))
    gathered = spread.groupBy(*groups, "record", "position").agg(F.array_sort(F.collect_list(F.struct("j", "term"))).alias("after"))
    runs = gathered.select(*groups, "record", F.transform(F.filter("after", lambda x, i: x["j"] == i), lambda x: x["term"]).alias("suffix"), F.lit(1).cast("long").alias("times")).where("size(suffix) > 0")
    return runs.unionByName(others).unionByName(loose)


def _codes(column) -> np.ndarray:
    """Numbers that are equal where the values are; -1 for null."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return pa.compute.fill_null(column.dictionary_encode().indices, -1).to_numpy(zero_copy_only=False).astype(np.int64)


def _runs(keys: list, suffix, record, max_len: int) -> tuple[np.ndarray, np.ndarray]:
    """Per row of a sorted batch whether it starts a run of (keys, suffix), and whether its record is new to the run."""
    n = len(suffix)
    where, flat = pa.compute.list_parent_indices(suffix).to_numpy(), _codes(suffix.flatten())
    first = np.concatenate([[0], np.cumsum(np.bincount(where, minlength=n))])[:-1]
    table = np.full((n, max_len), -1)
    table[where, np.arange(len(flat)) - first[where]] = flat
    rec = _codes(record)
    same = np.concatenate([[False], (table[1:] == table[:-1]).all(1) & np.logical_and.reduce([c[1:] == c[:-1] for c in map(_codes, keys)])])
    return ~same, ~(same & np.concatenate([[False], rec[1:] == rec[:-1]])) & (rec >= 0)


def ngram_counts(df: DataFrame, record: str, position: str, term: str, max_len: int = 1, groups: tuple[str, ...] = (), shard_rows: int = SHARD_ROWS) -> DataFrame:
    """Occurrences and records of every n-gram of up to ``max_len`` terms, per combination of ``groups``.

    Columns: the groups, ``ngram`` (array of terms), ``n`` (occurrences), ``n_records`` (distinct records). The
    suffixes are routed by their first term (those with more rows than a shard also by a hash of the record, so that record counts of the
    shards add up), sorted in descending order within each task, and counted with a stack, which takes runs of one suffix at a time.

    Terms count exactly as stored; null and empty ones are no terms and break n-grams, as gaps in the positions do. The
    same (record, position) with the same term counts once; of several terms in one place the first in order goes into longer n-grams and each counts by itself.
    A null record or position counts as one occurrence of the single term; null records are no records. An empty table gives no rows; other columns are ignored.
    """
    g = [f"g{i}" for i in range(len(groups))]
    rows = df.where(F.col(term).isNotNull() & (F.col(term) != "")).select(*[F.col(c).alias(a) for c, a in zip(groups, g)], F.col(record).alias("record"), F.col(position).cast("long").alias("position"), F.col(term).alias("term"))
    wide = cut(rows.groupBy(*g, "term").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > shard_rows).select(*[F.col(c).alias(f"w_{c}") for c in g], F.col("term").alias("w_term"), F.ceil(4 * F.col("n") / shard_rows).cast("long").alias("salts")))
    routed = _suffixes(rows, g, max_len).withColumn("first", F.element_at("suffix", 1))
    on = F.col("first") == F.col("w_term")
    for c in g:
        on = on & F.col(c).eqNullSafe(F.col(f"w_{c}"))
    routed = routed.join(F.broadcast(wide) if wide.count() <= FEW_TERMS else wide, on, "left")
    routed = routed.withColumn("salt", F.when(F.col("record").isNull(), 0).otherwise(F.pmod(F.xxhash64("record"), F.coalesce("salts", F.lit(1).cast("long")))))
    # shards lie together by a hash, which sorts faster than their names; of equal hashes the names decide
    shard = [F.xxhash64(*g, "first", "salt"), *g, "first", "salt"] + ([F.col("suffix").desc()] if max_len > 1 else [])
    carried = ["suffix"] if max_len > 1 else []  # of a single term the first is all
    ordered = routed.select(*g, "first", "salt", *carried, "record", "times").repartition(*g, "first", "salt").sortWithinPartitions(*shard, "record")
    fields = [ordered.schema[c] for c in g]
    out = T.StructType([*fields, T.StructField("ngram", T.ArrayType(T.StringType())), T.StructField("n", T.LongType()), T.StructField("n_records", T.LongType())])

    def run(batches):
        stack, shard, held = SuffixStack(max_len > 1), None, []

        def flush(kinds):
            columns = list(zip(*held))
            held.clear()
            kinds = [*kinds, pa.list_(pa.string()), pa.int64(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], [*g, "ngram", "n", "n_records"])

        kinds: list = []
        for batch in batches:
            if not batch.num_rows:
                continue
            kinds = [batch.schema.field(c).type for c in g]
            keys = [batch.column(c) for c in (*g, "salt")]
            suffix = batch.column("suffix") if carried else pa.ListArray.from_arrays(pa.array(np.arange(batch.num_rows + 1, dtype=np.int32)), batch.column("first"))
            record = batch.column("record")
            starts, fresh = _runs(keys, suffix, record, max_len)
            at = np.flatnonzero(starts)
            counts, ends = np.add.reduceat(batch.column("times").to_numpy(), at), np.append(at[1:], len(starts))
            new, values = np.flatnonzero(fresh), record.take(pa.array(np.flatnonzero(fresh))).to_pylist()
            cuts = np.searchsorted(new, np.stack([at, ends]))
            heads = zip(*[k.take(pa.array(at)).to_pylist() for k in keys], suffix.take(pa.array(at)).to_pylist())
            for (*key, terms), n, a, b in zip(heads, counts.tolist(), *cuts.tolist()):
                key.append(terms[0])
                if key != shard:
                    held += [(*shard[: len(g)], *x) for x in stack.cut_to(0)] if shard else []
                    shard = key
                held += [(*key[: len(g)], *x) for x in stack.add_run(terms, n, values[a:b])]
            if len(held) > 20_000:
                yield flush(kinds)
        if shard:
            held += [(*shard[: len(g)], *x) for x in stack.cut_to(0)]
        if held:
            yield flush(kinds)

    parts = ordered.select(*g, "salt", "record", *(carried or ["first"]), "times").mapInArrow(run, out)
    merged = parts.groupBy(*g, "ngram").agg(F.sum("n").alias("n"), F.sum("n_records").alias("n_records"))
    return merged.select(*[F.col(a).alias(c) for c, a in zip(groups, g)], "ngram", "n", "n_records")


def term_bands(counts: DataFrame, totals: DataFrame, group: str, rare_below: int = 3, common_above: float = 0.2) -> DataFrame:
    """Adds ``band``: ``rare`` in fewer than ``rare_below`` records, ``common`` in more than the share
    ``common_above`` of the group's ``total`` records (rare wins), else ``useful``. ``totals`` has one row per group."""
    joined = counts.join(F.broadcast(totals), group, "left")
    return joined.withColumn("band", F.when(F.col("n_records") < rare_below, "rare").when(F.col("n_records") > common_above * F.col("total"), "common").otherwise("useful"))
