"""Mixing sources to target weights by iterative proportional fitting.

The documents' tokens are summed into cells (source, language, topic). Sources are those with a
target and languages are normalised codes, so both are few; topics are any number and are taken as
they are. The cell table is therefore written, one row per topic, and raked where it lies: a cell's
weight is the product of a factor of its source, of its language and of its topic, held to the
source's greatest repetition. Each round solves every topic's factor exactly in its own row and sums
what the cells then make by source and language; only these sums and the factors of sources and
languages are on the driver. Goals are the target shares by source and, by language and topic, the
shares the usable corpus has. Rounds end when the sums stand; the source step comes last.

Each document is then used ``floor(weight)`` times and once more with the probability of the rest,
drawn by systematic sampling along running sums of the expected tokens within a source: then
each source adds or drops at most ``MOVES`` uses to bring its total to the goal.

The default total is the greatest at which every source that has text reaches its share without
exceeding its repetitions. With a larger total, sources that run out fall short, the report says by
how much, and no text is repeated more often.

Defined results: documents without source, without a target for it or without tokens are not used;
a target source without text has a share of 0 and its target is reported as missed; null and wrong
languages form the group ``und``; null topics form one group; repeated documents are documents of
their own; an empty table gives no rows and a report of zeros.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from graphloom.operators.skew import bucketed_rank, hot_keys, salted_join
from graphloom.storage import materialize

ROUNDS = 100
#: Rounds end when no source or language misses its goal by more than this part.
CLOSE = 1e-6


def language(lang: Column) -> Column:
    """A language code in lower case; ``und`` for none."""
    code = F.lower(F.trim(lang))
    return F.when(code.rlike("^[a-z]{2,3}$"), code).otherwise("und")


def _cells(sized: DataFrame, targets: DataFrame) -> DataFrame:
    wanted = F.broadcast(targets.where("source is not null and target_share > 0 and max_repeats > 0").select("source"))
    return sized.where("tokens > 0").join(wanted, "source").withColumn("lang", language(F.col("lang"))).withColumn("topic", F.coalesce(F.col("topic").cast("string"), F.lit("")))


def _goals(have: dict[str, float], shares: dict[str, float], repeats: dict[str, int], total: float | None) -> dict[str, float]:
    """Tokens each source with text should give; by default the greatest amounts that keep the shares."""
    shares = {s: w for s, w in shares.items() if have.get(s, 0) > 0 and w > 0}
    norm = sum(shares.values())
    if not norm:
        return {}
    shares = {s: w / norm for s, w in shares.items()}
    if total is None:
        total = min(repeats[s] * have[s] / w for s, w in shares.items())
    return {s: min(w * total, repeats[s] * have[s]) for s, w in shares.items()}


def rake(cells: list[tuple[str, str, int, int]], shares: dict[str, float], repeats: dict[str, int], total: float | None = None) -> dict[tuple[str, str, int], float]:
    """The weight of each cell of a small list: how often its documents are used on average.

    cells: (source, language, topic, tokens). Weights times tokens meet the source shares of the
    total; language and topic marginals are met as far as the caps allow.
    """
    have: dict[str, float] = defaultdict(float)
    for source, _, _, n in cells:
        have[source] += n
    goal = _goals(have, shares, repeats, total)
    if not goal:
        return {}
    made = sum(goal.values())
    cells = [c for c in cells if c[0] in goal and c[3] > 0]
    corpus = sum(c[3] for c in cells)
    goals: dict[int, dict] = {0: goal}
    for axis in (1, 2):
        side: dict = defaultdict(float)
        for c in cells:
            side[c[axis]] += c[3] / corpus * made
        goals[axis] = side
    weight = {c[:3]: goal[c[0]] / have[c[0]] for c in cells}
    for _ in range(ROUNDS):
        worst = 0.0
        for axis in (1, 2, 0):
            now: dict = defaultdict(float)
            for c in cells:
                now[c[axis]] += weight[c[:3]] * c[3]
            factor = {k: goals[axis][k] / v if v else 1.0 for k, v in now.items()}
            for c in cells:
                weight[c[:3]] = min(weight[c[:3]] * factor[c[axis]], float(repeats[c[0]]))
            worst = max(worst, *(abs(f - 1) for f in factor.values()))
        if worst < 1e-9:
            break
    for source, wanted in goal.items():  # caps can leave a source short of its goal: its free cells take the rest
        mine = [c for c in cells if c[0] == source]
        cap = float(repeats[source])
        for _ in range(50):
            short = wanted - sum(weight[c[:3]] * c[3] for c in mine)
            free = sum(weight[c[:3]] * c[3] for c in mine if weight[c[:3]] < cap)
            if abs(short) <= 1e-9 * wanted or (short > 0 and not free):
                break
            for c in mine:
                if short < 0 or weight[c[:3]] < cap:
                    weight[c[:3]] = min(cap, weight[c[:3]] * (1 + short / (free if short > 0 else wanted - short)))
    return weight


_WEIGHTS = "source string, lang string, topic string, cell string, tokens bigint, weight double"


def _solved(cells: pa.Array, caps: np.ndarray, a: np.ndarray, b: np.ndarray, level: float) -> tuple[np.ndarray, ...]:
    """(source, language, tokens, weight) of the cells of a batch of topics, each topic at ``level`` times its tokens.

    A topic's factor grows as cells reach their caps; no cell leaves its cap again, so this ends.
    """
    flat = cells.flatten()
    s, l, n = (flat.field(k).to_numpy(zero_copy_only=False) for k in ("s", "l", "n"))
    at = np.repeat(np.arange(len(cells)), np.diff(cells.offsets.to_numpy()))
    n = n.astype(np.float64)
    base, cap = a[s] * b[l], caps[s]
    goal = np.bincount(at, n, len(cells)) * level
    full = np.zeros(len(n), dtype=bool)
    while True:
        free = np.bincount(at, np.where(full, 0.0, base * n), len(cells))
        held = np.bincount(at, np.where(full, cap * n, 0.0), len(cells))
        factor = np.where(free > 0, np.maximum(goal - held, 0.0) / np.where(free > 0, free, 1.0), 0.0)
        now = full | (base * factor[at] >= cap)
        if (now == full).all():
            return s, l, n, np.where(full, cap, base * factor[at]), full
        full = now


def rake_table(cells: DataFrame, shares: dict[str, float], repeats: dict[str, int], total: float | None = None) -> DataFrame:
    """The (written) cells (source, lang, topic, cell, tokens) with their weights; any number of topics."""
    spark = cells.sparkSession
    sides = cells.groupBy("source", "lang").agg(F.sum("tokens").alias("n")).collect()
    have: dict[str, float] = defaultdict(float)
    spoken: dict[str, float] = defaultdict(float)
    for r in sides:
        have[r.source] += r.n
        spoken[r.lang] += r.n
    goal = _goals(have, shares, repeats, total)
    if not goal:
        return spark.createDataFrame([], _WEIGHTS)
    sources, langs = sorted(goal), sorted(spoken)
    caps = np.array([float(repeats[s]) for s in sources])
    want_s = np.array([goal[s] for s in sources])
    level = want_s.sum() / sum(have[s] for s in sources)
    want_l = np.array([spoken[x] for x in langs]) * level
    a, b = want_s / np.array([have[s] for s in sources]), np.ones(len(langs))
    index = lambda names, c: F.create_map(*[F.lit(x) for i, name in enumerate(names) for x in (name, i)])[F.col(c)]
    named = cells.where(F.col("source").isin(sources)).withColumn("s", index(sources, "source")).withColumn("l", index(langs, "lang"))
    topics = materialize(named.groupBy("topic").agg(F.collect_list(F.struct("s", "l", F.col("tokens").alias("n"), "cell")).alias("cells")), "topics")

    for _ in range(ROUNDS):

        def sums(batches: Iterator[pa.RecordBatch], a=a, b=b) -> Iterator[pa.RecordBatch]:
            made = np.zeros((2, len(sources), len(langs)))  # by free cells, by cells at their cap
            for batch in batches:
                s, l, n, w, full = _solved(batch.column(0), caps, a, b, level)
                np.add.at(made, (full.astype(int), s, l), w * n)
            k, s, l = np.nonzero(made)
            yield pa.RecordBatch.from_arrays([pa.array(x.astype(np.int32)) for x in (k, s, l)] + [pa.array(made[k, s, l])], names=["k", "s", "l", "made"])

        made = np.zeros((2, len(sources), len(langs)))
        for r in topics.select("cells").mapInArrow(sums, "k int, s int, l int, made double").groupBy("k", "s", "l").agg(F.sum("made").alias("made")).collect():
            made[r.k, r.s, r.l] = r.made
        free, full = made
        miss = max(np.abs(made.sum((0, 2)) / want_s - 1).max(), np.abs(made.sum((0, 1)) / want_l - 1).max())
        if miss < CLOSE:
            break
        x, y = np.ones(len(sources)), np.ones(len(langs))
        for _ in range(ROUNDS):  # sources and languages against each other, the topics' factors standing
            for axis, mine, other, want in ((0, y, x, want_l), (1, x, y, want_s)):
                loose = (free * (other[:, None] if axis == 0 else other[None, :])).sum(axis)
                left = np.maximum(want - full.sum(axis), 0.0)
                mine[:] = np.where(loose > 0, np.clip(left / np.where(loose > 0, loose, 1.0), 0.01, 100.0), 1.0)
        a, b = np.clip(a * x, 1e-9, 1e9), np.clip(b * y, 1e-9, 1e9)

    def weigh(batches: Iterator[pa.RecordBatch], a=a, b=b) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            s, l, n, w, _ = _solved(lists, caps, a, b, level)
            names = np.repeat(np.array(batch.column(0).to_pylist(), dtype=object), np.diff(lists.offsets.to_numpy()))
            out = [[sources[i] for i in s], [langs[i] for i in l], list(names), lists.flatten().field("cell").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.string()) for c in out), pa.array(n.astype(np.int64)), pa.array(w)], names=["source", "lang", "topic", "cell", "tokens", "weight"])

    raked = materialize(topics.select("topic", "cells").mapInArrow(weigh, _WEIGHTS), "raked")
    by_source = lambda values: F.create_map(*[F.lit(x) for s in sources for x in (s, float(values[s]))])[F.col("source")]
    cap = by_source(repeats)
    # the source step: what a source misses is taken by its cells below the cap, or from all
    scale = dict.fromkeys(sources, 1.0)
    out_of = {s for s in sources if goal[s] >= repeats[s] * have[s] * (1 - 1e-12)}  # sources used up
    fitted = lambda: F.when(F.col("source").isin([*out_of]), cap).otherwise(F.least(cap, F.col("weight") * by_source(scale)))
    for _ in range(50):
        at_cap = F.col("w") >= cap
        now = raked.withColumn("w", fitted()).groupBy("source").agg(F.sum(F.col("w") * F.col("tokens")).alias("all"), F.sum(F.when(at_cap, 0.0).otherwise(F.col("w") * F.col("tokens"))).alias("free")).collect()
        moved = False
        for r in now:
            short = goal[r.source] - r["all"]
            if r.source in out_of or abs(short) <= 1e-9 * goal[r.source] or (short > 0 and not r.free):
                continue
            scale[r.source] *= 1 + short / r.free if short > 0 else goal[r.source] / r["all"]
            moved = True
        if not moved:
            break
    return raked.withColumn("weight", fitted())


def mix(sized: DataFrame, targets: DataFrame, id_column: str = "doc_id", total: float | None = None) -> DataFrame:
    """(id, source, tokens, weight, copies) of every document used at least once.

    sized: id, source, lang, topic, tokens; targets: source, target_share, max_repeats (fixed, small).
    """
    spark = sized.sparkSession
    keyed = _cells(sized, targets).withColumn("cell", F.to_json(F.struct("source", "lang", "topic")))
    held = materialize(keyed.select(id_column, "source", "lang", "topic", "cell", "tokens"), "mixture")
    cells = materialize(held.groupBy("source", "lang", "topic", "cell").agg(F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("count")), "cells")
    goals = targets.where("source is not null").groupBy("source").agg(F.sum("target_share").alias("share"), F.min("max_repeats").alias("repeats")).collect()
    weights = materialize(rake_table(cells, {r.source: r.share for r in goals}, {r.source: r.repeats for r in goals}, total), "weights")
    weighed = salted_join(held, weights.select("cell", "weight"), "cell", hot_keys(cells, "cell"), F.xxhash64(id_column))
    whole = F.floor("weight")
    drawn = weighed.withColumn("part", F.col("weight") - whole)
    # systematic sampling: one more use where the running sum of the expected extra uses passes a whole number
    banded = drawn.withColumn("band", F.floor(F.log2(F.col("tokens"))))
    run = bucketed_rank(banded, ["source", "lang", "band"], id_column, F.col("part"), "before")
    offset = F.pmod(F.xxhash64("source", "lang", "band"), F.lit(1_000_003)) / F.lit(1_000_003.0)
    extra = F.floor(F.col("before") + F.col("part") + offset) - F.floor(F.col("before") + offset)
    repeats = {r.source: r.repeats for r in goals}
    cap = F.col("source").cast("string")
    for source, most in repeats.items():
        cap = F.when(F.col("source") == source, F.lit(most).cast("string")).otherwise(cap)
    drawn = materialize(run.withColumn("copies", (whole + extra).cast("int")).select(id_column, "source", "tokens", "weight", "copies", cap.cast("int").alias("cap")), "drawn")
    wanted = {r.source: r.n for r in weights.groupBy("source").agg(F.sum(F.col("tokens") * F.col("weight")).alias("n")).collect()}
    moved = _settle(drawn, id_column, wanted)
    if moved:
        moves = spark.createDataFrame(moved, f"`{id_column}` {dict(drawn.dtypes)[id_column]}, move int")
        drawn = drawn.join(F.broadcast(moves), id_column, "left").withColumn("copies", F.col("copies") + F.coalesce("move", F.lit(0)))
    return drawn.where("copies > 0").select(id_column, "source", "tokens", "weight", "copies")


#: Documents a source may move by to meet its total after the draw; the bound of the list that is broadcast.
MOVES = 8


def _settle(drawn: DataFrame, id_column: str, wanted: dict[str, float]) -> list[tuple]:
    """(id, +1 or -1): uses to add or drop so that each source's total comes as near its goal as single documents allow.

    Each round takes, per source, the largest document that does not overshoot what is missing.
    """
    actual = {r.source: r.n for r in drawn.groupBy("source").agg(F.sum(F.col("tokens") * F.col("copies")).alias("n")).collect()}
    moved: list[tuple] = []
    for _ in range(MOVES):
        gaps = {s: wanted[s] - actual.get(s, 0) for s in wanted if abs(wanted[s] - actual.get(s, 0)) >= 1}
        if not gaps:
            break
        fits = F.lit(False)
        for source, gap in gaps.items():
            able = F.col("copies") < F.col("cap") if gap > 0 else F.col("copies") > 0
            fits = fits | ((F.col("source") == source) & able & (F.col("tokens") <= abs(gap)))
        free = drawn.where(fits & ~F.col(id_column).isin([m[0] for m in moved] or [None]) if moved else fits)
        best = free.groupBy("source").agg(F.max_by(F.struct(id_column, "tokens"), F.struct("tokens", id_column)).alias("pick")).collect()
        if not best:
            break
        for r in best:
            sign = 1 if gaps[r.source] > 0 else -1
            moved.append((r.pick[0], sign))
            actual[r.source] = actual.get(r.source, 0) + sign * r.pick[1]
    return moved


def share_report(mixed: DataFrame, targets: DataFrame) -> DataFrame:
    """(source, target_share, max_repeats, documents, uses, tokens, share, most_uses): the shares reached."""
    used = mixed.groupBy("source").agg(F.count(F.lit(1)).alias("documents"), F.sum("copies").alias("uses"), F.sum(F.col("tokens") * F.col("copies")).alias("tokens"), F.max("copies").alias("most_uses"))
    total = used.agg(F.sum("tokens")).first()[0] or 0
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    return targets.where("source is not null").select("source", "target_share", "max_repeats").join(used, "source", "left").select(
        "source", "target_share", "max_repeats", zero("documents"), zero("uses"), zero("tokens"), F.coalesce(F.col("tokens") / F.lit(float(total or 1)), F.lit(0.0)).alias("share"), zero("most_uses")
    )


def fit_report(mixed: DataFrame, sized: DataFrame, targets: DataFrame, id_column: str = "doc_id") -> DataFrame:
    """(dimension, value, corpus_share, reached_share, relative_miss): how the mixture meets the language and topic marginals.

    The goal of a language or topic is its share of the tokens of the usable corpus (sources with a target); null is a
    value of its own. ``sized``: id_column, source, lang, topic, tokens.
    """
    usable = sized.where("tokens > 0").join(F.broadcast(targets.where("source is not null").select("source").distinct()), "source", "left_semi")
    uses = mixed.groupBy(F.col(id_column).alias("_id")).agg(F.max("copies").alias("_copies"))
    told = usable.join(uses, F.col(id_column) == F.col("_id"), "left").select("tokens", (F.col("tokens") * F.coalesce("_copies", F.lit(0))).alias("used"), F.explode(F.array(*[F.struct(F.lit(d).alias("dimension"), F.col(c).cast("string").alias("value")) for d, c in (("language", "lang"), ("topic", "topic"))])).alias("x"))
    sums = told.groupBy("x.dimension", "x.value").agg(F.sum("tokens").alias("tokens"), F.sum("used").alias("used"))
    totals = sums.groupBy("dimension").agg(F.sum("tokens").alias("all_tokens"), F.sum("used").alias("all_used"))  # two rows
    corpus, reached = F.col("tokens") / F.col("all_tokens"), F.when(F.col("all_used") > 0, F.col("used") / F.col("all_used")).otherwise(0.0)
    return sums.join(F.broadcast(totals), "dimension").select("dimension", "value", corpus.alias("corpus_share"), reached.alias("reached_share"), (F.abs(reached - corpus) / corpus).alias("relative_miss"))
