"""Frequencies of all n-grams by a distributed suffix array with common-prefix intervals.

All suffixes of all texts are sorted over the cluster by a range partition whose key ends in the
record id, so the suffixes of one term, however hot, spread over many partitions. Within a partition
neighbours' longest common prefixes delimit the intervals: an interval of prefix length n is one
n-gram and its width the number of its occurrences. Intervals that cross a partition bound close as
parts and are added up. Record counts start from the occurrences and lose one for every adjacent pair
of suffixes of the same record, in suffix order, for each prefix length up to the pair's common
prefix. Equal suffixes of one record combine map-side before the sort.

Terms taken whole (:func:`term_frequencies`) are texts between a start and an end mark, cut into words
and single other characters so that nothing of the writing is lost: the term is the interval that
begins with the start mark and is closed by the end mark. A prefix with an end mark is a whole suffix,
and equal suffixes of a record are one row, so its record count needs no second order.

Defined results: null texts are no texts; an empty text is a term but has no n-grams; a null record id
counts for occurrences but is no record; repeated rows count as occurrences; an empty table gives no
rows. Record ids are compared as text.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from graphloom.storage import materialize

#: Between tokens; sorts before everything a token can have, so that the suffixes of one n-gram are neighbours.
_SEP = "\x01"
# Marks around a term that is counted whole, and before one that is written in hexadecimal; private characters.
_START, _END, _HEX = "\ue000", "\ue001", "\ue002"
_OWN = f"[\\x00\\x01{_START}{_END}{_HEX}]"
_SCAN = "grp string, ngram string, n int, occurrences bigint, duplicates bigint, nulls bigint"
_SCAN_ARROW = pa.schema([("grp", pa.string()), ("ngram", pa.string()), ("n", pa.int32()), ("occurrences", pa.int64()), ("duplicates", pa.int64()), ("nulls", pa.int64())])


def _common(a: list[str], b: list[str]) -> int:
    n = 0
    for x, y in zip(a, b):
        if x != y:
            break
        n += 1
    return n


class _Out:
    def __init__(self) -> None:
        self.rows: list[tuple] = []

    def batch(self) -> pa.RecordBatch:
        columns = list(zip(*self.rows)) if self.rows else [[]] * 6
        self.rows = []
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _SCAN_ARROW.types)], schema=_SCAN_ARROW)


def _intervals(batches: Iterator[pa.RecordBatch], whole: bool = False) -> Iterator[pa.RecordBatch]:
    """Common-prefix intervals of sorted (grp, suffix, rec, c): one row per closed interval; ``whole``: only those from a start to an end mark."""
    out = _Out()
    grp, suffix, open_ = None, [], []  # open_[n-1] = [occurrences, duplicates, nulls] of the interval of prefix length n

    def close(down_to: int) -> None:
        while len(open_) > down_to:
            n = len(open_)
            occurrences, duplicates, nulls = open_.pop()
            if not whole or (suffix[0] == _START and suffix[n - 1] == _END):
                out.rows.append((grp, _SEP.join(suffix[:n]), n, occurrences, duplicates, nulls))
            if open_:
                open_[-1][0] += occurrences
                open_[-1][1] += duplicates
                open_[-1][2] += nulls

    for batch in batches:
        for g, s, r, c in zip(*(batch.column(i).to_pylist() for i in range(4))):
            tokens = s.split(_SEP)
            close(_common(suffix, tokens) if g == grp else 0)
            grp, suffix = g, tokens
            while len(open_) < len(tokens):
                open_.append([0, 0, 0])
            # c equal suffixes of one record are c-1 adjacent duplicates at every prefix length
            open_[-1][0] += c
            open_[-1][1] += c - 1 if r is not None else 0
            open_[-1][2] += c if r is None else 0
        if len(out.rows) >= 20_000:
            yield out.batch()
    close(0)
    yield out.batch()


def _suffixes(df: DataFrame, group: Column, record: Column, tokens: Column, max_n: int | None = None) -> DataFrame:
    """(grp, suffix, rec, c): every suffix of every text, equal ones of a record combined."""
    rows = df.select(group.alias("grp"), record.cast("string").alias("rec"), tokens.alias("tokens")).where(F.size("tokens") > 0)
    length = F.size("tokens") if max_n is None else F.lit(max_n)
    each = F.transform(F.sequence(F.lit(1), F.size("tokens")), lambda i: F.array_join(F.slice(F.col("tokens"), i, length), _SEP))
    return rows.select("grp", "rec", F.explode(each).alias("suffix")).groupBy("grp", "suffix", "rec").agg(F.count(F.lit(1)).alias("c"))


def _sorted(combined: DataFrame) -> DataFrame:
    """The suffix array: sorted over all partitions and within each."""
    return combined.select("grp", "suffix", "rec", "c").repartitionByRange("grp", "suffix", "rec").sortWithinPartitions("grp", "suffix", "rec")


def _summed(scans: DataFrame) -> DataFrame:
    return scans.groupBy("grp", "ngram", "n").agg(F.sum("occurrences").alias("occurrences"), (F.sum("occurrences") - F.sum("duplicates") - F.sum("nulls")).alias("records"))


def term_frequencies(df: DataFrame, group: Column, text: Column, record: Column) -> DataFrame:
    """(grp, ngram, n, occurrences, records) of every text as one term, exactly as written; ``n`` is 1."""
    safe = F.when(text.rlike(_OWN), F.concat(F.lit(_HEX), F.hex(F.encode(text, "utf-8")))).otherwise(text)
    tokens = F.concat(F.array(F.lit(_START)), F.regexp_extract_all(safe, F.lit(r"[\p{L}\p{N}]+|[^\p{L}\p{N}]"), F.lit(0)), F.array(F.lit(_END)))
    combined = _suffixes(df.where(text.isNotNull()), group, record, tokens)
    scans = _sorted(combined).mapInArrow(_whole_intervals, _SCAN)
    term = F.regexp_replace("ngram", f"[{_SEP}{_START}{_END}]", "")
    raw = F.when(term.startswith(_HEX), F.decode(F.unhex(F.regexp_replace(term, _HEX, "")), "utf-8")).otherwise(term)
    return _summed(scans).select("grp", raw.alias("ngram"), F.lit(1).alias("n"), "occurrences", "records")


def _whole_intervals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    return _intervals(batches, True)


def ngram_frequencies(df: DataFrame, group: Column, text: Column, record: Column, max_n: int | None = None, tokenize: Callable[[Column], Column] | None = None) -> DataFrame:
    """(grp, ngram, n, occurrences, records) of every n-gram, or of those up to ``max_n`` tokens.

    ``tokenize`` makes an array of tokens from a text; by default a text is one token. Tokens of an
    n-gram are joined by a space.
    """
    if tokenize is None:
        return term_frequencies(df, group, text, record)
    clean = F.transform(tokenize(text), lambda t: F.regexp_replace(t, "[\\x00\\x01]", ""))
    combined = _suffixes(df.where(text.isNotNull()), group, record, clean, max_n)
    if max_n != 1:
        combined = materialize(combined, "suffixes")  # read twice
    scans = _sorted(combined).mapInArrow(_intervals, _SCAN)
    if max_n != 1:
        ordered = combined.where("rec is not null").select("grp", "rec", "suffix").repartitionByRange("grp", "rec", "suffix").sortWithinPartitions("grp", "rec", "suffix")
        ordered = materialize(ordered.withColumn("pid", F.spark_partition_id()), "record-order", ["pid"]).select("grp", "rec", "suffix", F.col("pid").cast("int").alias("pid"))
        # a file is one sorted partition; read it whole and in order
        again = ordered.repartitionByRange("pid").sortWithinPartitions("pid", "grp", "rec", "suffix")
        scans = scans.unionByName(again.mapInArrow(_duplicates_by_pid, _SCAN))
        edges = again.groupBy("pid").agg(F.min(F.struct("grp", "rec", "suffix")).alias("first"), F.max(F.struct("grp", "rec", "suffix")).alias("last"))
        scans = scans.unionByName(_bridged(edges))
    return _summed(scans).withColumn("ngram", F.translate("ngram", _SEP, " "))


def _duplicates_by_pid(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adjacent pairs of one record in (grp, rec, suffix) order; pairs across pids are the edges' part."""
    out = _Out()
    last: tuple = (None, None, None, [])
    for batch in batches:
        for g, r, s, p in zip(*(batch.column(i).to_pylist() for i in range(4))):
            tokens = s.split(_SEP)
            if (p, g, r) == last[:3]:
                for n in range(1, _common(last[3], tokens) + 1):
                    out.rows.append((g, _SEP.join(tokens[:n]), n, 0, 1, 0))
            last = (p, g, r, tokens)
        if len(out.rows) >= 20_000:
            yield out.batch()
    yield out.batch()


def _bridged(edges: DataFrame) -> DataFrame:
    """Duplicates of pairs across partition bounds; one row per partition, so a bounded list."""
    spark = edges.sparkSession
    found = []
    held = sorted(edges.collect(), key=lambda r: r.pid)
    for a, b in zip(held, held[1:]):
        if (a["last"].grp, a["last"].rec) == (b["first"].grp, b["first"].rec):
            x, y = a["last"].suffix.split(_SEP), b["first"].suffix.split(_SEP)
            found += [(a["last"].grp, _SEP.join(y[:n]), n, 0, 1, 0) for n in range(1, _common(x, y) + 1)]
    return spark.createDataFrame(found, _SCAN)


def mark(frequencies: DataFrame, records_total: DataFrame, rare_below: int = 3, common_share: float = 1 / 3) -> DataFrame:
    """Add ``mark``: rare (in fewer than ``rare_below`` records), common (in more than the share of ``records_total``'s rows), else null."""
    most = records_total.count() * common_share
    return frequencies.withColumn("mark", F.when(F.col("records") < rare_below, "rare").when(F.col("records") > F.lit(most), "common"))
