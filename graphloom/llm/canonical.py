"""Free-entered values onto a canonical list by token-level repair and soft TF-IDF.

Only distinct values and distinct tokens are worked on; the rows join in at the end, hot values
salted. The reference list is worked on in blocks of ``BLOCK`` entries, whatever its length; the
weights of its words are those of the whole list.

1. Values split into tokens (white space, punctuation, camel case). A token that ends in a full stop
   may be an abbreviation.
2. Each distinct token joins the reference vocabulary by edit distance with neighbour swaps: both
   sides are keyed by what is left after as many deletions as the bound allows, so that every word
   within the bound shares a key with the token, and the distance is computed for those pairs alone.
   All words within the bound are kept, the nearest first; a token that is a word of the vocabulary is
   not corrected. Abbreviations join by prefix.
3. The corrected tokens of a value score the entries whose rarest word they can mean by soft TF-IDF:
   the idf-weighted cosine in which a token counts by its similarity to the word it was corrected to.
   Entries are ranked by it; those whose greatest possible score is below the best are not scored.
   An exact check follows for the best entry: the score reaches ``MIN_SCORE``, every content token of
   the value and every word of the entry is used, in the entry's order or inverted round a comma.

A short form means its entry, alone or beside the spelt-out name. ``FILLERS`` are words that name
nothing of their own around a value; the list is a parameter.

Defined results: null and blank values and exact names are no cases; a tie between entries is no
match; a value of any length is scored whole (more tokens than entries have lower the score); rows
are never lost: each case row comes out with an entry id or -1.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Callable, Iterator

import pyarrow as pa
import regex
from xxhash import xxh64_intdigest as hash_of
from pyspark.sql import Column, DataFrame, functions as F

from graphloom.operators.skew import hot_keys, salted_join
from graphloom.storage import materialize

#: Entries of the reference list that are broadcast at a time.
BLOCK = 100_000
MIN_SCORE = 0.6
# Words that name no thing of their own around a value.
FILLERS = ["a", "an", "the", "our", "ours", "proposed", "module", "mechanism", "method", "approach", "model", "layer", "block", "node", "type", "entity", "so", "called", "novel", "new"]

_word = regex.compile(r"[\p{L}\p{N}]+")
_cite = regex.compile(r"\[\s*\d+(\s*[,–-]\s*\d+)*\s*\]")
_split = regex.compile(r"[\s_\-/–—,.]")
_token = regex.compile(r"[\p{L}\p{N}]+\.?|,")
_camel = regex.compile(r"(?<=[\p{Ll}\p{N}])(?=\p{Lu})")


def tokens_of(value: str) -> list[str]:
    """Lower-case tokens in order; an abbreviation keeps its full stop, a comma stays as a token."""
    text = _cite.sub(" ", value)
    if not _split.search(text.strip()):
        text = _camel.sub(" ", text)
    return [t.lower() for t in _token.findall(text)]


def swap_distance(a: str, b: str, bound: int) -> int:
    """Edit distance with swaps of neighbours; bound + 1 if it is larger."""
    if abs(len(a) - len(b)) > bound:
        return bound + 1
    before, last = None, list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            cost = min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and y == a[i - 2]:
                cost = min(cost, before[j - 2] + 1)
            row.append(cost)
        if min(row) > bound:
            return bound + 1
        before, last = last, row
    return min(last[-1], bound + 1)


def edit_bound(length: int) -> int:
    """Edits allowed in a token of this length."""
    return 0 if length < 3 else 1 if length < 5 else 2 if length < 8 else 3


def deletions(word: str, most: int) -> set[str]:
    """The word and all that is left of it after up to ``most`` deletions."""
    out = last = {word}
    for _ in range(min(most, len(word))):
        last = {w[:i] + w[i + 1 :] for w in last for i in range(len(w))}
        out = out | last
    return out


def _key_rows(token: str, reach: int) -> list[tuple]:
    """The keys as hashes: what meets by chance is sorted out by the distance."""
    return [(token, hash_of(k.encode("utf-8", "surrogatepass")) - (1 << 63)) for k in deletions(token, edit_bound(len(token) + reach))]


def _checked(token: str, word: str) -> list[tuple]:
    d = swap_distance(token, word, edit_bound(len(token)))
    return [(token, word, d)] if d <= edit_bound(len(token)) else []


def _derive(rows: DataFrame, schema: str, make: Callable[..., list[tuple]]) -> DataFrame:
    """The rows that ``make`` makes of each row, in Arrow batches."""
    fields = [f.split() for f in schema.split(", ")]
    types = [{"string": pa.string(), "int": pa.int32(), "bigint": pa.int64(), "double": pa.float64()}[t] for _, t in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [r for row in zip(*(c.to_pylist() for c in batch.columns)) for r in make(*row)]
            columns = list(zip(*made)) if made else [[] for _ in fields]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=[n for n, _ in fields])

    return rows.mapInArrow(run, schema)


def repair_tokens(tokens: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """(token, repairs): all vocabulary words each distinct token can mean, with their edits.

    ``vocabulary``: word, distinct.
    """
    plain = tokens.where(~F.col("token").endswith(".")).select("token")
    exact = plain.join(vocabulary.select(F.col("word").alias("token")), "token", "left_semi")
    bare = plain.join(vocabulary.select(F.col("word").alias("token")), "token", "left_anti")
    mine = _derive(bare, "token string, key bigint", lambda t: _key_rows(t, 0))
    # a word is reached from tokens up to three letters longer, which may have a wider bound
    theirs = _derive(vocabulary.select("word"), "word string, key bigint", lambda w: _key_rows(w, 3))
    length = F.length("token")
    bound = F.when(length < 3, 0).when(length < 5, 1).when(length < 8, 2).otherwise(3)
    pairs = mine.join(theirs, "key").where(F.abs(length - F.length("word")) <= bound).select("token", "word").distinct()
    pairs = pairs.where(F.levenshtein("token", "word") <= 2 * bound)  # a swap is two plain edits
    near = _derive(pairs, "token string, word string, edits int", _checked)
    short = tokens.where(F.col("token").endswith(".")).select("token", F.expr("substring(token, 1, length(token) - 1)").alias("stem")).where(F.length("stem") >= 3)
    prefixes = vocabulary.select("word", F.explode(F.transform(F.sequence(F.lit(3), F.greatest(F.length("word"), F.lit(3))), lambda k: F.substring(F.col("word"), F.lit(1), k))).alias("stem")).distinct()
    cut = short.join(prefixes, "stem").select("token", "word", F.lit(0).alias("edits"))
    found = near.unionByName(cut).unionByName(exact.select("token", F.col("token").alias("word"), F.lit(0).alias("edits"))).groupBy("token").agg(F.array_sort(F.collect_list(F.struct("edits", "word"))).alias("found"))
    return found.select("token", F.transform("found", lambda f: F.struct(f.word.alias("word"), f.edits.alias("edits"))).alias("repairs"))


class Entries:
    """A block of the reference list of one field with its inverted index; built once per task.

    ``counts`` are the entries of the whole list that have each word of the block, ``total`` all its entries.
    """

    def __init__(self, rows: list[tuple[int, str, str | None]], counts: dict[str, int] | None = None, total: int | None = None) -> None:
        self.names = [(ref, _word.findall(name.lower())) for ref, name, _ in rows]
        self.sets = [frozenset(words) for _, words in self.names]
        if counts is None:
            counts = Counter(w for words in self.sets for w in words)
        total = max(1, len(self.names) if total is None else total)
        self.idf = {w: math.log(1 + total / counts[w]) for words in self.sets for w in words}
        self.unknown = math.log(1 + total)
        self.norms = [sum(self.idf[w] ** 2 for w in words) for _, words in self.names]
        self.by_rarest: dict[str, list[int]] = defaultdict(list)
        for k, (_, words) in enumerate(self.names):
            if words:
                self.by_rarest[min(words, key=lambda w: (counts[w], w))].append(k)
        self.short: dict[str, int | None] = {}
        for k, (_, _, form) in enumerate(rows):
            if form and form.strip():
                key = "".join(_word.findall(form)).lower()
                self.short[key] = None if key in self.short else k

        #: Short forms that may stand beside the spelt-out name: the registered one, initials, three-letter heads.
        self.coded: dict[str, set[int]] = defaultdict(set)
        for k, (_, words) in enumerate(self.names):
            for code in ("".join(w[0] for w in words), "".join(w[:3] for w in words)):
                self.coded[code].add(k)
        for code, k in self.short.items():
            if k is not None:
                self.coded[code].add(k)

    def score(self, content: list[tuple[str, list[tuple[str, int]]]], k: int) -> tuple[float, bool, int]:
        """Soft TF-IDF of the corrected tokens against an entry; whether all of both sides is used in order; edits."""
        words = self.names[k][1]
        used, order, dot, edits = set(), [], 0.0, 0
        norm_value = 0.0
        for token, repairs in content:
            hit = next(((j, e) for w, e in repairs for j, x in enumerate(words) if x == w and j not in used), None)
            weight = self.idf[words[hit[0]]] if hit else max([self.idf.get(w, 0) for w, _ in repairs], default=self.unknown)
            norm_value += weight**2
            if hit:
                used.add(hit[0])
                order.append(hit[0])
                edits += hit[1]
                dot += weight * weight * (1 - hit[1] / max(len(token), len(words[hit[0]])))
            else:
                order.append(-1)
        norm_entry = sum(self.idf[w] ** 2 for w in words)
        value = dot / math.sqrt(norm_value * norm_entry) if norm_value and norm_entry else 0.0
        return value, order, edits

    def match(self, tokens: list[str], repairs: dict[str, list[tuple[str, int]]]) -> tuple[int, float]:
        """(entry id or -1, score of the best entry)."""
        vocabulary = self.idf
        comma = tokens.index(",") if "," in tokens else None
        plain = [t for t in tokens if t != ","]
        kept = [t for t in plain if t.rstrip(".") in vocabulary or t.rstrip(".") not in _FILLERS]
        if not kept:
            kept = plain
        joined = "".join(t.rstrip(".") for t in kept)
        if joined in self.short and self.short[joined] is not None:
            return self.names[self.short[joined]][0], 1.0
        lists = [(t, repairs.get(t, [])) for t in kept]
        best, winners, fits = self.rank(lists, self.candidates(lists), comma)
        # a short form may stand beside the name it abbreviates
        for i, (t, found) in enumerate(lists):
            if len(lists) > 1 and not any(e == 0 for _, e in found) and (coded := self.coded.get(t.rstrip("."))):
                rest = lists[:i] + lists[i + 1 :]
                value, more, right = self.rank(rest, self.candidates(rest) & coded, comma)
                if right and value > best:
                    best, winners, fits = value, more, right
                elif right and value == best:
                    winners = winners | more
        ok = fits and len(winners) == 1 and best >= MIN_SCORE - 1e-9
        return (self.names[min(winners)][0] if ok else -1), best

    def candidates(self, content: list[tuple[str, list[tuple[str, int]]]]) -> set[int]:
        """The entries whose rarest word is among those the tokens can mean."""
        return {k for w in {w for _, found in content for w, _ in found} for k in self.by_rarest.get(w, ())}

    def rank(self, content: list[tuple[str, list[tuple[str, int]]]], candidates: set[int], comma: int | None) -> tuple[float, set[int], bool]:
        """(greatest score, entries that have it and pass the exact check, or else all that have it, whether any passes)."""
        available = {w for _, found in content for w, _ in found}
        bounds = []
        for k in candidates:
            held = self.sets[k]
            part = 1.0 if held <= available else math.sqrt(sum(self.idf[w] ** 2 for w in self.names[k][1] if w in available) / self.norms[k])
            bounds.append((part, k))
        bounds.sort(reverse=True)
        top, winners, passing = 0.0, set(), set()
        for bound, k in bounds:
            if bound < top - 1e-9:
                break
            value, order, edits = self.score(content, k)
            if value < top or not value:
                continue
            if value > top:
                top, winners, passing = value, set(), set()
            size = len(self.names[k][1])
            turned = comma is not None and order == [*range(size - 1, size), *range(size - 1)]
            winners.add(k)
            if order == list(range(size)) or turned:
                passing.add(k)
        return top, passing or winners, bool(passing)


_FILLERS = set(FILLERS)


def _tokenizer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([tokens_of(v) for v in batch.column(1).to_pylist()], pa.list_(pa.string()))], names=["field", "value", "tokens"])


def _blocks(reference: DataFrame) -> Iterator[tuple[dict, dict, dict]]:
    """({field: entries}, {field: {word: entries of the whole list with it}}, {field: all entries}) for each block of the list."""
    words = F.array_distinct(F.regexp_extract_all(F.lower("name"), F.lit(r"[\p{L}\p{N}]+"), F.lit(0)))
    rows = reference.where("name is not null and field is not null").select(F.col("ref_id").cast("bigint"), "field", "name", "short_form").distinct()
    totals = {r.field: r.n for r in rows.groupBy("field").agg(F.count(F.lit(1)).alias("n")).collect()}  # one row a field
    many = max(1, -(-sum(totals.values()) // BLOCK))
    numbered = rows.withColumn("block", F.pmod(F.xxhash64("ref_id", "name"), F.lit(many)))
    used = rows.select("field", "ref_id", "name", F.explode(words).alias("word")).groupBy("field", "word").agg(F.count(F.lit(1)).alias("n"))
    for block in range(many):
        mine = numbered.where(F.col("block") == block)
        entries: dict[str, list] = defaultdict(list)
        for r in mine.select("ref_id", "field", "name", "short_form").collect():
            entries[r.field].append((r.ref_id, r.name, r.short_form))
        here = mine.select("field", F.explode(words).alias("word")).distinct()
        counts: dict[str, dict[str, int]] = defaultdict(dict)
        for r in here.join(used, ["field", "word"]).collect():  # at most the words of a block
            counts[r.field][r.word] = r.n
        yield {f: sorted(e, key=lambda x: (x[0], x[1])) for f, e in entries.items()}, dict(counts), totals


def map_values(values: DataFrame, reference: DataFrame) -> DataFrame:
    """(field, value, ref_id, score) of each distinct (field, value); ref_id -1 where none is meant.

    reference: ref_id, field, name, short_form.
    """
    spark = values.sparkSession
    vocabulary = reference.where("name is not null").select(F.explode(F.regexp_extract_all(F.lower("name"), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))).alias("word")).distinct()
    cut = materialize(values.select("field", "value").distinct().mapInArrow(_tokenizer, "field string, value string, tokens array<string>"), "tokens")
    counted = materialize(cut.select(F.explode(F.array_distinct("tokens")).alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("count")), "distinct-tokens")
    repairs = materialize(repair_tokens(counted, vocabulary), "repairs")
    placed = cut.select("field", "value", "tokens", F.explode(F.array_union(F.array_distinct("tokens"), F.array(F.lit("")))).alias("token"))
    found = salted_join(placed, repairs, "token", hot_keys(counted, "token"), F.xxhash64("field", "value"), how="left")
    joined = found.groupBy("field", "value").agg(F.first("tokens").alias("tokens"), F.collect_list(F.when(F.col("repairs").isNotNull(), F.struct("token", "repairs"))).alias("repairs"))

    scored = None
    blocks = list(_blocks(reference)) or [({}, {}, {})]
    if len(blocks) > 1:
        joined = materialize(joined, "corrected")
    for entries, counts, totals in blocks:
        held = spark.sparkContext.broadcast((entries, counts, totals))

        def scorer(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            parts = {field: Entries(part, held.value[1].get(field, {}), held.value[2][field]) for field, part in held.value[0].items()}
            for batch in batches:
                out = []
                for field, tokens, found in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                    known = {f["token"]: [(r["word"], r["edits"]) for r in f["repairs"] if r["word"] in parts[field].idf] for f in found} if field in parts else {}
                    out.append(parts[field].match(tokens, known) if field in parts else (-1, 0.0))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([r for r, _ in out], pa.int64()), pa.array([s for _, s in out], pa.float64())], names=["field", "value", "ref_id", "score"])

        one = joined.mapInArrow(scorer, "field string, value string, ref_id bigint, score double")
        scored = one if scored is None else scored.unionByName(one)
    if len(blocks) == 1:
        return scored
    best = scored.groupBy("field", "value").agg(F.max(F.struct("score", "ref_id")).alias("best"), F.collect_list(F.struct("score", "ref_id")).alias("all"))  # one row a block
    ties = F.size(F.filter("all", lambda x: (x.score == F.col("best.score")) & (x.ref_id >= 0)))
    return best.select("field", "value", F.when(ties > 1, F.lit(-1)).otherwise(F.col("best.ref_id")).cast("bigint").alias("ref_id"), F.col("best.score").alias("score"))


def map_rows(rows: DataFrame, id_column: str, reference: DataFrame, generated: Column | None = None) -> DataFrame:
    """(id, field, value, ref_id, score) of the case rows.

    rows: id_column, field, value. No cases: null or blank values, exact names of the field and
    values for which ``generated`` (a condition on field and value) holds.
    """
    named = reference.where("name is not null").select(F.col("field"), F.col("name").alias("value")).distinct()
    blank = F.length(F.regexp_replace("value", r"[\s\p{Z}]+", "")) == 0
    wanted = rows.where(F.col("value").isNotNull() & ~blank & (~generated if generated is not None else F.lit(True)))
    cases = wanted.join(named, ["field", "value"], "left_anti").select(F.col(id_column), "field", "value", F.concat_ws("\x1f", "field", "value").alias("key"))
    counted = materialize(cases.groupBy("key").agg(F.count(F.lit(1)).alias("count"), F.first("field").alias("field"), F.first("value").alias("value")), "values")
    mapped = materialize(map_values(counted, reference).withColumn("key", F.concat_ws("\x1f", "field", "value")).select("key", "ref_id", "score"), "mapped")
    return salted_join(cases, mapped, "key", hot_keys(counted, "key"), F.col(id_column)).select(id_column, "field", "value", "ref_id", "score")
