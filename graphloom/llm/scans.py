"""Text of scanned pages: furniture out, words mended, paragraphs reflowed.

Two readings of the texts, and between them work on distinct words only:

1. The first lays every text out once and yields running-head candidates (lines keyed by their
   OCR-insensitive skeleton, per source), the words as written with their counts, and the pairs of
   word parts that a line end divides. All are summed up in the reading tasks first.
2. Over distinct words: each word and each joined pair runs through a weighted Levenshtein automaton
   (an OCR confusion costs 1, an insertion, deletion, substitution or swap of neighbours 2, up to
   ``budget``), intersected with the trie of the vocabulary. The vocabulary is every word with at
   least ``LEAST`` uses, in shards of ``SHARD`` words that different tasks hold, so it may grow with
   the collection; retrieval is complete within the budget. Whether a candidate explains a word is a
   matter of ratios (``RATIO``, ``KNOWN_RATIO``), which no collection size changes.
3. The second reading tells furniture from text with the known running heads and takes the findings
   of step 2 for its words, ranking candidates of equal cost by occurrence in the same text, then by
   frequency. The findings are broadcast if they are at most ``FINDINGS``; beyond that each text gets
   its own by joins (a Bloom filter of fixed size first drops the words without any), with the same
   result.

A candidate more than confusions away can be an inflection or another word: it counts only in a scanned
text in which it occurs itself, for a word that is rare beside it and no shorter or longer form of it.
Letter bigrams of capitalised rare words judge names no vocabulary has.

Defined results: null and empty texts give no lines; fenced code and table rows are left alone; a
number list is no furniture; a hyphen that belongs to a word stays; repeated texts are each treated;
texts of any length are worked on whole.
"""

from __future__ import annotations

import json
import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame, functions as F

from graphloom.llm.bitmaps import bitmap, has
from graphloom.operators.skew import hot_keys, salted_join
from graphloom.storage import materialize
from graphloom.tables import wide_enough

#: Uses from which a word belongs to the vocabulary.
LEAST = 3
#: A candidate explains a word if it is this many times as frequent.
RATIO = 5
#: The same for a word that clean text uses, and for candidates more than confusions away.
KNOWN_RATIO = 100
#: Words of the vocabulary whose trie one task holds.
SHARD = 50_000
#: Findings (running heads and words) that are broadcast.
FINDINGS = 500_000
FILTER_BITS = 1 << 25
#: Log-likelihood gain from which a name counts as misread.
NAME_GAIN = 3.5
REMEMBERED = 200_000
#: A longer line is a paragraph, not a running head.
HEAD_WIDTH = 250

# What the scanner takes letters for.
CONFUSIONS = [
    ("a", "@"), ("a", "4"), ("b", "6"), ("b", "8"), ("c", "("), ("cl", "d"), ("d", "cl"), ("e", "c"), ("e", "3"), ("g", "9"), ("g", "6"), ("h", "b"),
    ("i", "!"), ("i", "1"), ("i", "|"), ("in", "m"), ("l", "1"), ("l", "|"), ("l", "!"), ("li", "h"), ("m", "rn"), ("n", "ri"), ("o", "0"), ("rn", "m"),
    ("s", "5"), ("s", "$"), ("fi", "ﬁ"), ("fl", "ﬂ"), ("t", "†"), ("t", "7"), ("t", "+"), ("u", "ii"), ("w", "vv"), ("z", "2"),
]
# Marks that divide a word at a line end.
MARKS = "-\xad¬–‐‑"
# Small words of running heads.
SMALL = {"and", "et", "al", "of", "the", "in", "on", "for", "vol", "no", "pp", "und", "der", "de"}

_number = r"(?:\d{1,4}|\d(?: \d){1,3}|[ivxlc]{1,7}|[\dlIOoi!|SB]{1,4})"
PAGE = rf"(?:[-—–\[(]\s*{_number}\s*[-—–\])]|(?:[Pp]\S{{2}}e\s+|[Pp]\.\s*)?{_number}(?:\s*(?:/|of|0f)\s*{_number})?)"
_page_line = regex.compile(PAGE)
#: The longest page number with what may stand around it.
PAGE_WIDTH = 40
_page_after = regex.compile(rf"(\S.*?)(?:\s{{2,}}|\s+\|\s+)({PAGE})\s*")
_page_before = regex.compile(rf"\s*({PAGE})(?:\s{{2,}}|\s+\|\s+)(\S.*?)\s*")
_set_apart = regex.compile(r"\s\s|\|")
_cue = regex.compile(r"[:·—]|\bet\s+al\b|\d")
_alpha = regex.compile(r"[\p{L}]+")
_edge = regex.compile(r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$")
_plain_word = regex.compile(r"\p{L}+(?:[-’']\p{L}+)*")
_numeral = regex.compile(r"[Ll]?\d+([.,:]\d+)*[a-z%]?|\p{L}")
_name_like = regex.compile(r"[\p{L}@†!(0-9$|+]+")
_odd_end = regex.compile(r"[!(|][,.;:]")
_et_al = regex.compile(r"\bet\s+\S{1,2}\.\s*$")
_parts = regex.compile(r"[^\s·:,.—–|/()]+")
_divided = regex.compile(rf"\S[{regex.escape(MARKS)}]\s*(?:\n|$)")
_soft_edge = ".,;:?\"“”‘’'*_`#|[]{}<>=…/\\)"


def skeleton(text: str) -> str:
    """A key that misreadings do not change: every confusion is taken the same way on both sides."""
    s = text.lower()
    for plain, misread in (("a", "@"), ("t", "†"), ("o", "0"), ("s", "5"), ("g", "9"), ("b", "6"), ("c", "("), ("i", "!"), ("l", "1"), ("n", "ri"), ("d", "cl"), ("u", "ii"), ("w", "vv"), ("m", "rn"), ("h", "li"), ("m", "in"), ("e", "c"), ("h", "b")):
        s = s.replace(misread, plain)
    s = s.replace("l", "i")
    return "".join(_alpha.findall(s))


def title_like(line: str) -> bool:
    """Looks like a running head: at least two words, all but small ones capitalised, no sentence end."""
    for w in line.split():  # most lines of text end here
        if w[0].islower() and (first := _parts.match(w)) and first.group().lower() not in SMALL:
            return False
    if line.lstrip()[:1] in "#|*`{}\"-+>" or line.rstrip()[-1:] in ",;:?!" + MARKS or len([w for w in _alpha.findall(line) if len(w) > 1]) < 2:
        return False
    if line.rstrip().endswith(".") and not _et_al.search(line):
        return False
    heads = [w for w in _parts.findall(line) if _alpha.search(w) and w.lower() not in SMALL]
    return len(heads) >= 1 and all(w[0].isupper() or not w[0].isalpha() for w in heads)


def core(line: str) -> tuple[str, bool]:
    """(line without a page number set off at either end, whether there was one)."""
    if not _set_apart.search(line) or line.lstrip().startswith("|"):
        return line.strip(), False
    m = _page_after.fullmatch(line)
    if m and _alpha.search(m[1]) and len(_alpha.findall(m[1])) > 1:
        return m[1].strip(), True
    m = _page_before.fullmatch(line)
    if m and len(_alpha.findall(m[2])) > 1:
        return m[2].strip(), True
    return line.strip(), False


def _neighbours(lines: list[str], at: int) -> list[int]:
    """The nearest non-blank lines before and after, at most one blank line away."""
    out = []
    for step in (-1, 1):
        j = at + step
        if 0 <= j < len(lines) and not lines[j].strip():
            j += step
        if 0 <= j < len(lines) and lines[j].strip():
            out.append(j)
    return out


def _number_lines(lines: list[str]) -> set[int]:
    """Lines that can be page numbers: not beside another bare number."""
    bare = {i for i, line in enumerate(lines) if 0 < len(short := line.strip()) <= PAGE_WIDTH and _page_line.fullmatch(short)}
    return {i for i in bare if not any(j in bare for j in _neighbours(lines, i))}


@dataclass
class Layout:
    """What a text's lines are: kind per line ('' for text) and which lines are code or tables."""

    lines: list[str]
    kinds: list[str]
    fixed: list[bool]
    #: (skeleton, title-like, beside a page number) of the lines that can be running heads.
    heads: list[tuple[str, bool, bool]] = field(default_factory=list)


def layout(content: str, heads: set[str], survey: bool = True) -> Layout:
    """Tell furniture from text; ``heads`` are the skeletons known as running heads of the source. ``survey``: list the lines that can be heads."""
    lines = content.split("\n")
    candidates: list[tuple[str, bool, bool]] = []
    kinds = [""] * len(lines)
    fixed = [False] * len(lines)
    fenced = False
    for i, line in enumerate(lines):
        if line.lstrip().startswith("```"):
            fenced = not fenced
            fixed[i] = True
        else:
            fixed[i] = fenced or line.lstrip().startswith("|")
    numbers = {i for i in _number_lines(lines) if not fixed[i]}
    for i, line in enumerate(lines):
        if fixed[i] or not line.strip() or i in numbers or len(line) > HEAD_WIDTH or line.lstrip()[:1] in "#|`{}\"":
            continue
        text, set_off = core(line)
        if not survey and not heads and not set_off:
            continue
        key = skeleton(text)
        if len(key) >= 6 and not survey:
            if key in heads or (set_off and title_like(text)):
                kinds[i] = "header"
        elif len(key) >= 6:
            title = title_like(text)
            candidates.append((key, title, set_off or any(j in numbers for j in _neighbours(lines, i))))
            if key in heads or (set_off and title):
                kinds[i] = "header"
    for i in sorted(numbers):
        near = _neighbours(lines, i)
        if not any(kinds[j] == "header" for j in near):
            # a head that is not known yet: of two title-like neighbours the one that looks more like one
            fresh = [j for j in near if not fixed[j] and j not in numbers and len(skeleton(lines[j])) >= 6 and title_like(lines[j])]
            if fresh:
                kinds[max(fresh, key=lambda j: (bool(_cue.search(lines[j])), -len(lines[j])))] = "header"
        if any(kinds[j] == "header" for j in near):
            kinds[i] = "page_number"
    return Layout(lines, kinds, fixed, candidates)


@dataclass
class Token:
    """A word of a text: where it stands, and how it continues on another line if it was split."""

    line: int
    text: str
    tail_line: int = -1
    tail: str = ""
    mark: bool = False


def tokens(lay: Layout) -> Iterator[Token]:
    """The words of the text lines; a word split at a line end comes once, with its tail."""
    text_lines = [i for i, line in enumerate(lay.lines) if not lay.kinds[i] and not lay.fixed[i] and line.strip()]
    taken = -1
    for n, i in enumerate(text_lines):
        words = lay.lines[i].split()
        start = 1 if taken == i else 0
        last = words[-1] if words else ""
        split = len(last) > 1 and last[-1] in MARKS and (last[-2].isalnum() or last[-2] in "@†!(") and bool(_alpha.search(last))
        for k, w in enumerate(words[start:], start):
            if k == len(words) - 1 and split:
                follow = text_lines[n + 1] if n + 1 < len(text_lines) else -1
                tail = lay.lines[follow].split()[0] if follow >= 0 else ""
                if tail and (tail[0].islower() or tail[0] in "@†!(01569" or not tail[0].isalnum() and tail[0] not in MARKS + "#*|`[-") or not tail:
                    if follow >= 0:
                        taken = follow
                    yield Token(i, w[:-1], follow, tail, True)
                else:
                    yield Token(i, w)
            else:
                yield Token(i, w)


def budget(length: int) -> int:
    """The cost up to which candidates of a word are looked for."""
    return 2 if length < 5 else 3


class _Node:
    """A node of the trie: what is below it, the greatest uses of a word below, and (as bits) how many letters may follow."""

    __slots__ = ("below", "word", "most", "lengths")

    def __init__(self) -> None:
        self.below: dict[str, _Node] = {}
        self.word: str | None = None
        self.most = 0
        self.lengths = 0


class Trie:
    """A shard of the vocabulary, and the automaton's walk over it."""

    def __init__(self, words: dict[str, int]) -> None:
        self.counts = words
        self.root = _Node()
        for word, uses in words.items():
            node = self.root
            for at in range(len(word) + 1):
                node.most = max(node.most, uses)
                node.lengths |= 1 << (len(word) - at)
                if at < len(word):
                    node = node.below.get(word[at]) or node.below.setdefault(word[at], _Node())
            node.word = word
        self.most = self.root.most
        #: What a deletion leaves of the words that are frequent enough to be found by a plain edit, with the greatest uses.
        self.nearby: dict[str, int] = {}
        for word, uses in words.items():
            if uses >= KNOWN_RATIO:
                for key in _one_less(word):
                    if uses > self.nearby.get(key, 0):
                        self.nearby[key] = uses

    def may_edit(self, word: str, least: int) -> bool:
        """Whether a word with that many uses can be one plain edit, and one confusion at most, away: a cheap test that never misses one."""
        for variant in (word, *_unconfused(word)):
            if any(self.nearby.get(key, 0) >= least for key in _one_less(variant)):
                return True
        return False

    def candidates(self, word: str, plain: bool = True, least: int = 0, least_plain: int = 0) -> list[tuple[int, bool, str]]:
        """(cost, by confusions only, word) of every other word of the shard within the budget.

        The automaton's states at a node are a row {place in the word: twice the cost, odd once a plain edit was made}.
        A state from which no word of the node can be reached within the budget is dropped, and a node without states
        ends the walk. Words with fewer uses than ``least`` (``least_plain`` after a plain edit) are not looked for;
        ``plain`` false leaves insertions, deletions, substitutions and swaps out.
        """
        most = 2 * budget(len(word)) + 1
        size = len(word)
        found: list[tuple[int, bool, str]] = []
        ends = [[m for m in _MISREAD if word.startswith(m, at)] for at in range(size)]
        plain = plain and self.most >= least_plain
        start = {0: 0}
        if plain:
            for at in range(1, most // 4 + 1):
                start[at] = 4 * at | 1
        stack: list[tuple[_Node, dict[int, int], dict[int, int], str]] = [(self.root, start, {}, "")]
        while stack:
            node, row, above, before = stack.pop()
            if size in row and node.word is not None and node.word != word:
                uses = self.counts[node.word]
                if uses >= (least_plain if row[size] & 1 else least):
                    found.append((row[size] >> 1, not row[size] & 1, node.word))
            for c, below in node.below.items():
                if below.most < least:
                    continue
                edits = plain and below.most >= least_plain
                new: dict[int, int] = {}
                letter = c.isalpha()
                for at, cost in row.items():
                    if cost & 1 and not edits:
                        continue
                    if at < size:
                        ch = word[at]
                        if ch == c:
                            if cost < new.get(at + 1, 99):
                                new[at + 1] = cost
                        elif cost + 4 <= most and letter:
                            step = cost + 4 if not ch.isalpha() and ch not in "-'’" else (cost + 4) | 1 if edits else 99
                            if step <= most and step < new.get(at + 1, 99):
                                new[at + 1] = step
                        if cost + 2 <= most:
                            for misread in ends[at]:
                                if (c, misread) in _CONFUSED and cost + 2 < new.get(at + len(misread), 99):
                                    new[at + len(misread)] = cost + 2
                    if edits and cost + 4 <= most and (cost + 4) | 1 < new.get(at, 99):
                        new[at] = (cost + 4) | 1
                for at, cost in above.items():
                    if at < size and cost + 2 <= most and (edits or not cost & 1):
                        for misread in ends[at]:
                            if (before + c, misread) in _CONFUSED and cost + 2 < new.get(at + len(misread), 99):
                                new[at + len(misread)] = cost + 2
                    if edits and at + 1 < size and cost + 4 <= most and word[at] == c and word[at + 1] == before and (cost + 4) | 1 < new.get(at + 2, 99):
                        new[at + 2] = (cost + 4) | 1
                if edits:
                    for at in sorted(new):
                        place, cost = at, new[at]
                        while place < size and cost + 4 <= most and (cost + 4) | 1 < new.get(place + 1, 99):
                            place, cost = place + 1, (cost + 4) | 1
                            new[place] = cost
                for at in [*new]:
                    slack = (most - new[at]) >> 1  # letters by which the rest may be longer or shorter
                    low = size - at - slack
                    window = (1 << (2 * slack + 1)) - 1
                    if not below.lengths & (window << low if low >= 0 else window >> -low):
                        del new[at]
                if new or (row and c in _PAIR_STARTS):
                    stack.append((below, new, row, c))
        return sorted(found)


def _one_less(word: str) -> set[str]:
    """The word and what one deletion leaves of it."""
    return {word, *(word[:i] + word[i + 1 :] for i in range(len(word)))}


def _unconfused(word: str) -> list[str]:
    """The word with one confusion undone, in every way."""
    out = []
    for plain, misread in CONFUSIONS:
        at = word.find(misread)
        while at >= 0:
            out.append(word[:at] + plain + word[at + len(misread) :])
            at = word.find(misread, at + 1)
    return out


_CONFUSED = set(CONFUSIONS)
_PAIR_STARTS = {plain[0] for plain, _ in CONFUSIONS if len(plain) == 2}
_MISREAD = sorted({m for _, m in CONFUSIONS})


def explains(form: str, n: int, clean: int, word: str, uses: int, confused: bool) -> bool:
    """Whether a candidate's frequency lets it explain a form with ``n`` uses, ``clean`` of them in clean text."""
    if confused:
        return uses >= max(LEAST, (KNOWN_RATIO if clean >= LEAST and form.isalpha() else RATIO) * n)
    return len(form) >= 5 and form.isalpha() and uses >= KNOWN_RATIO * max(1, n) and not (form.startswith(word) or word.startswith(form) or form.endswith(word) or word.endswith(form))


class Names:
    """Letter bigrams of names, to judge words no vocabulary has; at most 5,000 pairs."""

    def __init__(self, bigrams: dict[str, int]) -> None:
        self.bigrams = bigrams
        self.firsts: dict[str, int] = {}
        for pair, n in bigrams.items():
            self.firsts[pair[0]] = self.firsts.get(pair[0], 0) + n

    def likelihood(self, word: str) -> float:
        """Mean-free log-likelihood of a name under the bigrams."""
        marked = f"^{word}$"
        return sum(math.log((self.bigrams.get(a + b, 0) + 0.05) / (self.firsts.get(a, 0) + 1.5)) for a, b in zip(marked, marked[1:]))

    def reading(self, word: str) -> str | None:
        """The likelier name of which ``word`` is a misreading, if there is one."""
        best, now = None, self.likelihood(word)
        symbols = any(not c.isalpha() for c in word)
        frontier = {word}
        for _ in range(2):
            step = set()
            for w in frontier:
                for plain, misread in CONFUSIONS:
                    at = w.find(misread)
                    while at >= 0:
                        step.add(w[:at] + plain + w[at + len(misread) :])
                        at = w.find(misread, at + 1)
            for w in sorted(step):
                if w.isalpha() and (gain := self.likelihood(w) - now) > (0 if symbols else NAME_GAIN) and (best is None or gain > best[0]):
                    best = (gain, w)
            if best:
                break
            frontier = step
        return best[1] if best else None


def forms(raw: str) -> list[str]:
    """The ways to take a written word: without the marks around it first, then with those that may be misread letters."""
    bare = _edge.sub("", raw)
    if not bare or not any(c.isalpha() for c in raw) or _numeral.fullmatch(bare):
        return []
    out = [bare.lower()]
    for whole in (raw.strip(_soft_edge).lower(), raw.lstrip("([\"“").strip(_soft_edge).lower(), raw.strip(_soft_edge + "(").lower()):
        if whole and whole not in out:
            out.append(whole)
    return out


def needs(raw: str) -> list[str]:
    """All forms whose uses and candidates :func:`judge` asks for, parts of compounds included."""
    tries = forms(raw)
    return list(dict.fromkeys(p for t in tries for p in (t, *(t.split("-") if "-" in t else ())) if p))


#: What is known of a form: uses, uses in clean text, candidates (cost, by confusions only, word, uses) that explain it.
Known = dict[str, tuple[int, int, list[tuple[int, bool, str, int]]]]
_nothing = (0, 0, [])


def judge(raw: str, known: Known, names: Names) -> dict | None:
    """What a written word is a misreading of: {"c": [(cost, by confusions only, word, uses)]} or {"name": word}; null if it reads well."""
    tries = forms(raw)
    if not tries:
        return None
    low = tries[0]
    in_vocabulary = lambda w: known.get(w, _nothing)[0] >= LEAST
    held = in_vocabulary(low)
    if not held and "-" in low and all(in_vocabulary(p) or p.isdigit() or not p for p in low.split("-")):
        return None
    found: list[tuple[int, bool, str, int]] = []
    for t in tries[:1] if held else tries:
        found += known.get(t, _nothing)[2]
        if "-" in t and not held and not any(c[1] for c in found):
            parts = t.split("-")
            read = [p if (not p or in_vocabulary(p)) else next((w for _, sure, w, _ in known.get(p, _nothing)[2] if sure), None) for p in parts]
            if all(r is not None for r in read) and read != parts:
                found.append((1, True, "-".join(read), 1))
    sure = [c for c in found if c[1]]
    if sure or found:
        return {"c": sorted(set(sure or found))}
    if held:
        return None
    bare = _edge.sub("", raw)
    if sum(c.isalpha() for c in low) < 3 or (bare[0].isalpha() and not bare[0].isupper()):
        return None
    for t in tries:
        if _name_like.fullmatch(t) and (name := names.reading(t)):
            # a symbol at an end can be punctuation, unless more follows: the name has to be much likelier with it
            if t == low or _odd_end.search(raw) or names.likelihood(name) - names.likelihood(low) > NAME_GAIN:
                return {"name": name}
    return None


def joined_forms(left: str, right: str) -> tuple[str, str]:
    """(joined, hyphened) word of two parts, without the marks around them."""
    a, b = _edge.sub("", left).lower(), _edge.sub("", right).lower()
    return a + b, f"{a}-{b}"


def divides(left: str, right: str, mark: str, known: Known) -> bool:
    """Whether the mark at a line end vanishes when the word is joined."""
    joined, hyphened = joined_forms(left, right)
    n, m = known.get(joined, _nothing), known.get(hyphened, _nothing)
    if n[0] >= LEAST:
        return n[0] * 5 >= (m[0] if m[0] >= LEAST else 0)
    if m[0] >= LEAST:
        return False
    if any(c[1] for c in n[2]):
        return True
    if any(c[1] for c in m[2]):
        return False
    a, b = hyphened.split("-")[:-1] or [""], joined_forms("", right)[0]
    return not (b and known.get(a[-1], _nothing)[0] >= LEAST and known.get(b.split("-")[0], _nothing)[0] >= LEAST and mark in "-–‐‑")


def pair_key(left: str, right: str, mark: str) -> str:
    """The key of a divided word among the findings; no written word has a line end in it."""
    return f"{left}\n{right}\n{mark}"


def pair_parts(left: str, right: str) -> tuple[str, str]:
    """The two parts as they are joined: without the marks around the whole."""
    return left.lstrip(_soft_edge + "("), right.rstrip(_soft_edge)


def finding(key: str, known: Known, names: Names) -> dict | None:
    """What the second reading has to know of a word or a pair; null where there is nothing to tell."""
    if "\n" not in key:
        return judge(key, known, names)
    left, right, mark = key.split("\n")
    vanish = divides(left, right, mark, known)
    a, b = pair_parts(left, right)
    meant = judge(a + ("" if vanish else "-") + b, known, names)
    return {"vanish": vanish, **(meant or {})}


def key_needs(key: str) -> list[str]:
    """:func:`needs` of a word or a pair."""
    if "\n" not in key:
        return needs(key)
    left, right, _ = key.split("\n")
    a, b = pair_parts(left, right)
    joined, hyphened = joined_forms(left, right)
    mine = [joined, hyphened, *hyphened.split("-"), *needs(a + b), *needs(f"{a}-{b}")]
    return [f for f in dict.fromkeys(mine) if f]


@dataclass
class Reading:
    """The result for one text: kinds by line, and the words to replace."""

    lay: Layout
    marks: list[tuple[int, str]] = field(default_factory=list)
    fixes: dict[tuple[int, str], str] = field(default_factory=dict)
    joins: dict[int, tuple[str, bool]] = field(default_factory=dict)


def read(content: str, heads: set[str], findings: dict[str, dict]) -> Reading:
    """Everything found in one text."""
    lay = layout(content, heads, survey=False)
    out = Reading(lay)
    out.marks = [(i, k) for i, k in enumerate(lay.kinds) if k]
    if not _divided.search(content) and findings.keys().isdisjoint(content.split()):
        return out
    words = list(tokens(lay))
    told = [findings.get(pair_key(t.text, t.tail, lay.lines[t.line].rstrip()[-1]) if t.mark else t.text) for t in words]
    if not any(t.mark for t in words) and not any(told):
        return out
    context: dict[str, int] = {}
    for t in words:
        low = _edge.sub("", t.text).lower()
        context[low] = context.get(low, 0) + 1
    scanned = bool(out.marks) or any(t.mark for t in words) or len(lay.lines) > 3

    def meaning(told: dict | None) -> str | None:
        if not told:
            return None
        if "name" in told:
            return told["name"] if scanned else None
        fit = [c for c in told.get("c", ()) if c[1] or (scanned and context.get(c[2]))]
        return min(fit, key=lambda c: (not c[1], c[0], -context.get(c[2], 0), -c[3], c[2]))[2] if fit else None

    found: list[tuple[int, str]] = []
    for t, known in zip(words, told):
        if t.mark:
            vanish = known["vanish"] if known else True
            if vanish:
                found.append((t.line, "hyphen"))
            left, right = pair_parts(t.text, t.tail)
            out.joins[t.line] = (left + ("" if vanish else "-") + right, vanish)
            if meant := meaning(known):
                head = left.lower()
                if not meant.startswith(head):
                    found.append((t.line, "misread"))
                if t.tail_line >= 0 and not meant.endswith(right.lower()):
                    found.append((t.tail_line, "misread"))
                out.fixes[(t.line, t.text)] = meant
        elif meant := meaning(known):
            found.append((t.line, "misread"))
            out.fixes[(t.line, t.text)] = meant
    out.marks = sorted(set(out.marks) | set(found))
    return out


def _as_written(raw: str, meant: str) -> str:
    """``meant`` in the case and between the marks of ``raw``."""
    lead = regex.match(r"[\"“‘(\[*_]*(?=\S*$)", raw).group() if meant[:1].isalpha() and raw[:1] in "\"“‘[*_" else ""
    trail = regex.search(r"[.,;:?\"”’)*_]*$", raw).group()
    body = raw[len(lead) :]
    if body[:1].isupper() or (not body[:1].isalpha() and sum(c.isupper() for c in body) > 0):
        meant = meant.upper() if body.isupper() and len(body) > 2 else meant[:1].upper() + meant[1:]
    return lead + meant + trail


def mend(content: str, heads: set[str], findings: dict[str, dict]) -> str:
    """The text as its author wrote it: no furniture, whole words, one line per paragraph."""
    reading = read(content, heads, findings)
    lay = reading.lay
    paragraphs: list[str] = []
    current: list[str] = []
    after_furniture = False
    skip_first = -1

    def flush() -> None:
        if current:
            paragraphs.append(" ".join(current))
            current.clear()

    for i, line in enumerate(lay.lines):
        if lay.kinds[i]:
            after_furniture = True
            continue
        if lay.fixed[i]:
            flush()
            paragraphs.append(line)
            after_furniture = False
            continue
        if not line.strip():
            around = [j for j in (i - 1, i + 1) if 0 <= j < len(lay.lines) and lay.kinds[j]]
            inside = current and not regex.search(r"[.?!:]['\"”’)]*$", current[-1])
            if not ((after_furniture or around) and inside):
                flush()
            continue
        words = line.split()
        if skip_first == i:
            words = words[1:]
        out = [_as_written(w, reading.fixes[(i, w)]) if (i, w) in reading.fixes else w for w in words]
        if i in reading.joins and words:
            joined, _ = reading.joins[i]
            last = words[-1][:-1]
            out[-1] = _as_written(joined, reading.fixes[(i, last)]) if (i, last) in reading.fixes else joined
            follow = next((j for j in range(i + 1, len(lay.lines)) if not lay.kinds[j] and not lay.fixed[j] and lay.lines[j].strip()), -1)
            tail = lay.lines[follow].split()[0] if follow >= 0 else ""
            stripped = tail.rstrip(_soft_edge)
            out[-1] += tail[len(stripped) :]
            skip_first = follow
        if line.lstrip()[:1] == "#":
            flush()
            paragraphs.append(" ".join(out))
        else:
            current += out
        after_furniture = False
    flush()
    text: list[str] = []
    for p in paragraphs:
        tight = text and p.lstrip()[:1] in "|`" and text[-1].lstrip()[:1] in "|`"
        text += ([] if not text else ["\n" if tight else "\n\n"]) + [p]
    return "".join(text)


def _pairs(lay: Layout) -> Iterator[tuple[str, str, str]]:
    """(left, right, mark) of the split words of a text, whichever of the short lines that follow turn out to be furniture."""
    text_lines = [i for i, line in enumerate(lay.lines) if not lay.kinds[i] and not lay.fixed[i] and line.strip()]
    for n, i in enumerate(text_lines):
        words = lay.lines[i].split()
        last = words[-1]
        if len(last) > 1 and last[-1] in MARKS and (last[-2].isalnum() or last[-2] in "@†!(") and _alpha.search(last):
            if n + 1 == len(text_lines):
                yield last[:-1], "", last[-1]
            for j in text_lines[n + 1 : n + 5]:
                yield last[:-1], lay.lines[j].split()[0], last[-1]
                if len(lay.lines[j]) > HEAD_WIDTH:
                    break


_SURVEY = "part string, source string, key string, n bigint, more bigint, extra bigint"


def _survey(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The first reading. Rows (part, source, key, n, more, extra), summed up within the task:

    head: skeleton of a line of a source, lines, beside a page number, title-like; word: as written,
    uses, uses in clean text; pair: divided word, uses.
    """
    heads: dict[tuple[str, str], list[int]] = {}
    uses, in_clean, pairs = Counter(), Counter(), Counter()

    def flush() -> pa.RecordBatch:
        rows = [("head", source, key, *held) for (source, key), held in heads.items()]
        rows += [("word", None, w, n, in_clean[w], 0) for w, n in uses.items()]
        rows += [("pair", None, p, n, 0, 0) for p, n in pairs.items()]
        for held in (heads, uses, in_clean, pairs):
            held.clear()
        columns = list(zip(*rows)) if rows else [[]] * 6
        types = (pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=["part", "source", "key", "n", "more", "extra"])

    for batch in batches:
        for source, text in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
            lay = layout(text, set())
            for key, title, beside in lay.heads:
                held = heads.setdefault((source, key), [0, 0, 0])
                held[0] += 1
                held[1] += beside
                held[2] |= title
            words = list(tokens(lay))
            whole = [t.text for t in words if not t.mark]
            uses.update(whole)
            if len(whole) == len(words) and not any(lay.kinds):
                in_clean.update(whole)
            pairs.update(pair_key(*p) for p in _pairs(lay))
            if len(heads) + len(uses) + len(pairs) > REMEMBERED:
                yield flush()
    yield flush()


def running_heads(seen: DataFrame) -> DataFrame:
    """(source, key): the skeletons of the running heads of each source, misread ones (two letters off) included.

    A title-like line is one if it recurs in its source and stood beside a page number there; any other line if it
    did so at least three times over all sources and in half of its occurrences.
    """
    by_title = seen.where("title = 1 and n > 1 and beside > 0 and beside * 4 >= n").select("source", "key")
    everywhere = seen.groupBy("key").agg(F.sum("n").alias("all_n"), F.sum("beside").alias("all_beside")).where("all_beside >= 3 and all_beside * 2 >= all_n").select("key")
    by_habit = seen.where("title = 0").join(everywhere, "key").select("source", "key")
    heads = materialize(by_title.unionByName(by_habit).distinct(), "heads")
    ends = lambda c: F.array_distinct(F.array(F.concat(F.lit("^"), F.left(c, F.lit(4))), F.concat(F.right(c, F.lit(4)), F.lit("$"))))
    named = heads.where(F.length("key") >= 10).select("source", F.col("key").alias("head"), F.explode(ends(F.col("key"))).alias("end"))
    misread = seen.select("source", "key", F.explode(ends(F.col("key"))).alias("end")).join(named, ["source", "end"]).where(F.levenshtein("key", "head", 2) >= 0).select("source", "key")
    return heads.unionByName(misread).distinct()


def _derive(rows: DataFrame, schema: str, make) -> DataFrame:
    """``make`` (key, *others) -> rows, over the batches of ``rows``."""
    types = [{"string": pa.string(), "bigint": pa.int64(), "boolean": pa.bool_(), "int": pa.int32()}[f.split()[1]] for f in schema.split(", ")]
    names = [f.split()[0] for f in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [r for row in zip(*(c.to_pylist() for c in batch.columns)) for r in make(*row)]
            columns = list(zip(*made)) if made else [[] for _ in names]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=names)

    return rows.mapInArrow(run, schema)


def _word_of(raw: str, n: int, clean: int) -> list[tuple]:
    bare = _edge.sub("", raw)
    if not _plain_word.fullmatch(bare) or raw.strip(_soft_edge + "()") != bare:  # a sign beside it can be a misread letter
        return []
    return [(bare.lower(), n, clean, n if bare[0].isupper() and bare[1:].islower() else 0)]


def _found_in_shards(queries: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """(form, found): the candidates that explain each form (form, n, clean), as JSON.

    Each shard of the vocabulary comes sorted before the forms that are looked up in it, so a task holds one trie and
    streams the forms. Forms spread over ``lanes`` tasks a shard.
    """
    size = vocabulary.count()
    shards = max(1, -(-size // SHARD))
    lanes = max(1, queries.sparkSession.sparkContext.defaultParallelism // shards)
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    words = vocabulary.select(F.pmod(F.xxhash64("word"), F.lit(shards)).cast("int").alias("shard"), every(lanes).alias("lane"), F.lit(0).alias("kind"), F.col("word").alias("form"), "n", F.lit(0).cast("bigint").alias("clean"))
    asked = queries.select(every(shards).alias("shard"), F.pmod(F.xxhash64("form"), F.lit(lanes)).cast("int").alias("lane"), F.lit(1).alias("kind"), "form", "n", "clean")
    rows = words.unionByName(asked).repartition(shards * lanes, "shard", "lane").sortWithinPartitions("shard", "lane", "kind")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, counts, trie = None, {}, None
        for batch in batches:
            out = []
            for shard, lane, kind, form, n, clean in zip(*(c.to_pylist() for c in batch.columns)):
                if (shard, lane) != here:
                    here, counts, trie = (shard, lane), {}, None
                if kind == 0:
                    counts[form] = n
                    continue
                trie = trie or Trie(counts)
                least, least_plain = max(LEAST, RATIO * n), KNOWN_RATIO * max(1, n)  # what :func:`explains` asks for at least
                plain = len(form) >= 5 and form.isalpha() and trie.may_edit(form, least_plain)
                found = [(cost, sure, w, counts[w]) for cost, sure, w in trie.candidates(form, plain, least, least_plain) if explains(form, n, clean, w, counts[w], sure)]
                if found:
                    out.append((form, json.dumps(found, ensure_ascii=False)))
            columns = list(zip(*out)) if out else [[], []]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in columns], names=["form", "found"])

    return rows.mapInArrow(run, "form string, found string")


def word_findings(survey: DataFrame) -> DataFrame:
    """(key, finding): the words and divided words of which there is something to tell, as JSON."""
    spark = survey.sparkSession
    keys = materialize(survey.where("part <> 'head'").groupBy("part", "key").agg(F.sum("n").alias("n"), F.sum("more").alias("clean")), "keys")
    words = _derive(keys.where("part = 'word'").select("key", "n", "clean"), "word string, n bigint, clean bigint, named bigint", _word_of)
    words = materialize(words.groupBy("word").agg(F.sum("n").alias("n"), F.sum("clean").alias("clean"), F.sum("named").alias("named")), "words")
    vocabulary = words.where(F.col("n") >= LEAST)
    names = words.where("n = named and length(word) > 3").where(F.col("n") < 3 * LEAST).select(F.concat(F.lit("^"), "word", F.lit("$")).alias("w"))
    pairs = names.select(F.explode(F.transform(F.sequence(F.lit(1), F.length("w") - 1), lambda i: F.substring(F.col("w"), i, F.lit(2)))).alias("pair")).where(F.col("pair").rlike(r"^[\^\p{L}][\p{L}$]$"))
    bigrams = spark.sparkContext.broadcast({r.pair: r.n for r in pairs.groupBy("pair").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "pair").limit(5_000).collect()})

    asked = materialize(_derive(keys.select("key"), "key string, form string", lambda key: [(key, f) for f in key_needs(key)]), "asked")
    wanted = asked.select("form").distinct().join(words.select(F.col("word").alias("form"), "n", "clean"), "form", "left").select("form", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("clean", F.lit(0)).alias("clean"))
    wanted = materialize(wanted, "forms")
    told = wanted.join(_found_in_shards(wanted, vocabulary), "form", "left").groupBy("form", "n", "clean").agg(F.collect_list("found").alias("found"))
    # a form that reads well and has no uses tells nothing; parts of a word are few, so a group is small
    told = told.where("n > 0 or size(found) > 0").select("form", F.to_json(F.struct("n", "clean", "found")).alias("told"))
    by_key = asked.join(told, "form", "left").groupBy("key").agg(F.collect_list(F.when(F.col("told").isNotNull(), F.struct("form", "told"))).alias("told"))

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Names(bigrams.value)
        for batch in batches:
            out = []
            for key, told in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                known: Known = {}
                for t in told:
                    v = json.loads(t["told"])
                    known[t["form"]] = (v["n"], v["clean"], sorted(tuple(c) for part in v["found"] for c in json.loads(part)))
                if (found := finding(key, known, model)) is not None:
                    out.append((key, json.dumps(found, ensure_ascii=False)))
            columns = list(zip(*out)) if out else [[], []]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in columns], names=["key", "finding"])

    return by_key.mapInArrow(decide, "key string, finding string")


def _chunk_rows(chunks: DataFrame) -> DataFrame:
    rows = chunks.select(F.col("chunk_key").cast("bigint"), F.coalesce(F.col("metadata.source"), F.lit("")).alias("source"), "content").where(F.length("content") > 0)
    return wide_enough(rows)


def _mark(source: str, key: str) -> str:
    """A head as a key beside those of the words; no word has a tabulator in it."""
    return f"{source}\t{key}"


def _bits(key: str) -> tuple[int, int]:
    h = xxhash.xxh64_intdigest(key.encode("utf-8", "surrogatepass"))
    return h % FILTER_BITS, (h >> 32) % FILTER_BITS


def _second_reading(chunks: DataFrame, schema: str, rows_of) -> DataFrame:
    """``rows_of`` (chunk_key, text, heads, findings) -> rows, over all texts."""
    spark = chunks.sparkSession
    rows = _chunk_rows(chunks)
    survey = materialize(rows.mapInArrow(_survey, _SURVEY), "survey", ["part"]).select("part", "source", "key", "n", "more", "extra")
    seen = materialize(survey.where("part = 'head'").groupBy("source", "key").agg(F.sum("n").alias("n"), F.max("extra").alias("title"), F.sum("more").alias("beside")), "head-lines")
    heads = running_heads(seen).select(F.concat_ws("\t", "source", "key").alias("key"), F.lit(None).cast("string").alias("finding"))
    findings = materialize(word_findings(survey).unionByName(heads), "findings")
    types = [{"string": pa.string(), "bigint": pa.int64(), "int": pa.int32()}[f.split()[1]] for f in schema.split(", ")]
    names = [f.split()[0] for f in schema.split(", ")]

    def out(made: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*made)) if made else [[] for _ in names]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=names)

    held = findings.limit(FINDINGS + 1).collect()
    if len(held) <= FINDINGS:
        by_source: dict[str, set[str]] = {}
        for r in held:
            if r.finding is None:
                source, key = r.key.rsplit("\t", 1)
                by_source.setdefault(source, set()).add(key)
        shared = spark.sparkContext.broadcast((by_source, {r.key: r.finding for r in held if r.finding is not None}))

        def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            heads_of, told = shared.value
            told = {k: json.loads(v) for k, v in told.items()}
            for batch in batches:
                yield out([r for key, source, text in zip(*(batch.column(c).to_pylist() for c in range(3))) for r in rows_of(key, text, heads_of.get(source, set()), told)])

        return rows.mapInArrow(find, schema)

    positions = _derive(findings.select("key"), "at bigint", lambda key: [(b,) for b in _bits(key)])
    filtered = spark.sparkContext.broadcast(bitmap(positions, FILTER_BITS))

    def asks(chunk_key: int, source: str, text: str) -> list[tuple]:
        lay = layout(text, set())
        mine = {_mark(source, key) for key, _, _ in lay.heads} | {w for line in lay.lines for w in line.split()} | {pair_key(*p) for p in _pairs(lay)}
        return [(chunk_key, key) for key in mine if all(has(filtered.value, b) for b in _bits(key))]

    asked = materialize(_derive(rows, "chunk_key bigint, key string", asks), "asked-findings")
    hot = hot_keys(asked.groupBy("key").agg(F.count(F.lit(1)).alias("count")), "key")
    mine = salted_join(asked, findings, "key", hot, F.col("chunk_key")).groupBy("chunk_key").agg(F.collect_list(F.struct("key", "finding")).alias("told"))  # at most the words of one text

    def find_joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = []
            for key, source, text, told in zip(*(batch.column(c).to_pylist() for c in range(4))):
                heads = {t["key"].rsplit("\t", 1)[1] for t in told or [] if t["finding"] is None}
                made += rows_of(key, text, heads, {t["key"]: json.loads(t["finding"]) for t in told or [] if t["finding"] is not None})
            yield out(made)

    return rows.join(mine, "chunk_key", "left").select("chunk_key", "source", "content", "told").mapInArrow(find_joined, schema)


def line_kinds(chunks: DataFrame) -> DataFrame:
    """(chunk_key, line_no, kind): headers, page numbers, split words and misread words, by line from 1."""
    return _second_reading(chunks, "chunk_key bigint, line_no int, kind string", lambda key, text, heads, told: [(key, i + 1, kind) for i, kind in read(text, heads, told).marks])


def mended(chunks: DataFrame) -> DataFrame:
    """(chunk_key, text): every chunk with text as continuous paragraphs."""
    return _second_reading(chunks, "chunk_key bigint, text string", lambda key, text, heads, told: [(key, mend(text, heads, told))])
