"""Text decoded with the wrong character encoding: found by its garbled sequences, restored span by span.

Sequences of every code point. Read as a one-byte encoding, UTF-8 turns each character into two to
four others: one that stands for a lead byte and as many that stand for continuation bytes. For every
encoding these sequences are a regular set, compiled once into an automaton of character classes, so
that all of Unicode is covered, and not a list of letters. Correct text can meet such a sequence by
chance (a letter before a closing quotation mark), so a chain of neighbouring sequences counts if
what it reads back to is in use (``IN_USE``), of one script, and too long or too odd for chance. The
letters and signs of ``ALPHABET`` prove a mistake even where they stand alone: their sequences, also
of text garbled twice, are the patterns of an Aho-Corasick automaton, longest match first.

Multi-byte encodings. UTF-8 read as one of ``MULTI_BYTE`` is found by writing a run back and reading it
as UTF-8; text of those encodings read as Latin letters by reading runs of four and more back.

One-byte mistakes (one one-byte encoding read as another) turn letters into single other letters, so
they show in words only: every distinct non-ASCII word of the collection is read back under every
pair of encodings, and it is garbled if the word it becomes is in at least ``RATIO`` times as many
distinct texts: copies of a text, however many, do not hide its words. Where distinct texts do not
say (few texts, each repeated), documents decide by the same ratio, unless the garbled word has more
distinct texts. The garbled words so found are the patterns of a second automaton, with which all
documents are read again. Up to ``PATTERNS`` words it is broadcast; beyond, a Bloom filter of fixed
size picks the candidate words and a join decides, with the same result.

Words are counted in the reading tasks. Only texts that may be repeated (a Bloom filter over the
hashes of repeated texts says so) hand on their words with the text's hash, so that distinct texts
are counted exactly and the rows shuffled are about the vocabulary of a task, not its text.

Only matched spans are replaced. A span that stands alone between quotation marks is quoted, not
garbled. Characters already lost (U+FFFD) mark a document as affected and stay.

Defined results: null, empty and pure ASCII texts are never affected; repeated texts are each
reported; texts of any length are matched whole; restored text is null for unaffected documents.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import cache, lru_cache

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, Window, functions as F

from graphloom.llm.bitmaps import bitmap, has
from graphloom.operators.skew import hot_keys, salted_join
from graphloom.storage import materialize
from graphloom.tables import wide_enough

# Letters and signs of the languages served, in natural order. The middle dot is left
# out: its garbled form is also a letter followed by a product sign.
ALPHABET = (
    "ÀÁÂÃÄÅÆÇÈÉÊËÌÍÎÏÐÑÒÓÔÕÖØÙÚÛÜÝÞßàáâãäåæçèéêëìíîïðñòóôõöøùúûüýþÿ"
    "ĂăĄąĆćČčĎďĐđĘęĚěĞğĪīİıĹĺĽľŁłŃńŇňŐőŒœŔŕŘřŚśŞşŠšŢţŤťŮůŰűŸŹźŻżŽž"
    "ЁАБВГДЕЖЗИЙКЛМНОПРСТУФХЦЧШЩЪЫЬЭЮЯабвгдежзийклмнопрстуфхцчшщъыьэюяёІіЇїЄє"
    "ΑΒΓΔΘΛΠΣΦΨΩαβγδεζηθικλμνξοπρστυφχψω"
    " ¡§©«¬®°±²³¶»¼½¾¿×÷–—‘’‚“”„†‡•…‰′″‹›€№™←↑→↓−∓∙√∞∩∪≈≠≤≥⁻¹⁰�"
)
# One-byte encodings that UTF-8 is mistaken for.
READ_AS = ["cp1252", "latin_1", "cp1250", "cp1251", "cp1254", "mac_roman", "cp437", "cp850", "cp852", "cp866", "koi8_r", "iso8859_2", "iso8859_15", "mac_cyrillic"]
# One-byte encodings that are mistaken for one another.
ONE_BYTE = ["cp1252", "cp1250", "cp1251", "koi8_r", "cp866", "mac_roman", "mac_cyrillic", "iso8859_2", "iso8859_5", "cp437", "cp850", "cp852"]
# Encodings of several bytes that UTF-8 is mistaken for, and the other way round.
MULTI_BYTE = ["gbk", "cp932", "cp949", "big5", "euc_jp"]
# Ranges of code points in use today.
IN_USE = [
    (0xA0, 0x17F), (0x218, 0x21B), (0x300, 0x36F), (0x370, 0x3FF), (0x400, 0x4FF), (0x531, 0x58F), (0x590, 0x5FF), (0x600, 0x6FF), (0x900, 0xDFF), (0xE00, 0xEFF), (0x10A0, 0x10FF), (0x1200, 0x137F),
    (0x1780, 0x17FF), (0x1E00, 0x1FFF), (0x2000, 0x23FF), (0x2500, 0x27BF), (0x3000, 0x312F), (0x4E00, 0x9FFF), (0xAC00, 0xD7A3), (0xFB00, 0xFB06), (0xFE00, 0xFE0F), (0xFF01, 0xFFEF), (0x1D400, 0x1D7FF), (0x1F000, 0x1FAFF),
]
# What correct text may have right behind a letter.
AFTER_LETTER = set("\xa0 ’”‘“„»«›‹…–—•°™®©§·¹²³ªº½¼¾€")
#: Garbled words that fit a broadcast automaton; beyond, a filter and a join take its place.
PATTERNS = 200_000
#: Bits of the Bloom filters.
FILTER_BITS = 1 << 25
#: Distinct runs of characters whose reading a task remembers.
REMEMBERED = 200_000
#: A word is garbled if the word it is read back to is this many times as frequent.
RATIO = 3
#: The same for a word of one character, which chance meets more easily.
RATIO_SINGLE = 20

OPENING, CLOSING = "“„‘«‹\"'`(‚", "”“’»›\"'`)‘"
_token = regex.compile(r"[^\s!-/:-@\[-`{-~]*[^\x00-\x7f\s][^\s!-/:-@\[-`{-~]*")
_lost = regex.compile("�+")


def _read(data: bytes, encoding: str) -> str:
    """Decode as lenient readers do: bytes the encoding lacks become control characters."""
    out = []
    for b in data:
        try:
            out.append(bytes([b]).decode(encoding))
        except UnicodeDecodeError:
            out.append(chr(b))
    return "".join(out)


@cache
def garbled_sequences() -> dict[str, str]:
    """Garbled sequence -> the character it stands for, for all alphabets, encodings and both depths."""
    found: dict[str, str] = {}

    def add(garbled: str, char: str) -> None:
        if len(garbled) > 1 and not garbled.isascii() and garbled != char:
            found.setdefault(garbled, char)

    for once in READ_AS:
        for char in ALPHABET:
            first = _read(char.encode("utf-8"), once)
            add(first, char)
            if "\x80" <= first[-1] <= "\x9f" and len(first) > 2:  # readers that drop or replace what the encoding lacks
                add(first[:-1] + "�", char)
                add(first[:-1], char)
    for once in ("latin_1", "cp1252"):
        for twice in ("cp1252", "latin_1", "cp1250", "mac_roman", "cp437", "cp850"):
            for char in ALPHABET:
                add(_read(_read(char.encode("utf-8"), once).encode("utf-8"), twice), char)
    return found


@cache
def _automaton():
    import ahocorasick

    machine = ahocorasick.Automaton()
    for garbled, char in garbled_sequences().items():
        machine.add_word(garbled, (len(garbled), char))
    machine.make_automaton()
    return machine


def _quoted(text: str, start: int, end: int) -> bool:
    return start > 0 and end < len(text) and text[start - 1] in OPENING and text[end] in CLOSING


def _weak(garbled: str, char: str) -> bool:
    """Sequences that can meet in correct text or in one-byte garble: they count beside stronger ones only."""
    drawing = all("─" <= c <= "╿" for c in garbled)
    return drawing or (len(garbled) == 2 and ("Ѐ" <= garbled[0] <= "ӿ" or ("Ѐ" <= char <= "ӿ" and garbled.isalpha())))


def _beside_letter(text: str, start: int, end: int) -> bool:
    return (start > 0 and text[start - 1].isalpha()) or (end < len(text) and text[end].isalpha())


def _in_use(char: str) -> bool:
    code = ord(char)
    return any(a <= code <= b for a, b in IN_USE) and unicodedata.category(char) != "Cn"


_scripts = {"HIRAGANA": "CJK", "KATAKANA": "CJK", "IDEOGRAPHIC": "CJK"}


def _script(char: str) -> str:
    """The script of a letter; '' for what is none."""
    if not char.isalpha():
        return ""
    name = unicodedata.name(char, "").split(" ", 1)[0]
    return _scripts.get(name, name)


@cache
def _readers() -> list[tuple[dict[str, int], re.Pattern]]:
    """For each one-byte encoding: what byte a character stands for, and the automaton of all its sequences."""
    out = []
    for name in READ_AS:
        byte_of = {_read(bytes([b]), name): b for b in range(255, 127, -1)}
        char_class = lambda lo, hi: "[" + "".join(re.escape(c) for c, b in byte_of.items() if lo <= b <= hi) + "]"  # noqa: B023, E731
        more = char_class(0x80, 0xBF)
        out.append((byte_of, re.compile(f"{char_class(0xC2, 0xDF)}{more}|{char_class(0xE0, 0xEF)}{more}{{2}}|{char_class(0xF0, 0xF4)}{more}{{3}}")))
    return out


def _strength(garbled: str, back: str) -> int:
    """0: correct text can hold this chain of sequences; 1: it counts beside stronger ones only; 2: it proves a mistake."""
    if not all(_in_use(c) for c in back) or len({_script(c) for c in back} - {""}) > 1:
        return 0
    if garbled.isalpha() and len({_script(c) for c in garbled}) == 1:
        return 0
    if all("─" <= c <= "╿" for c in garbled):
        return 0
    if len(back) > 1:
        return 2 if any(c.isalpha() or ord(c) >= 0x800 for c in back) else 1
    if ord(back) < 0x800:
        return 1
    if 0x2000 <= ord(back) <= 0x2BFF:
        return 2
    return 0 if any("─" <= c <= "╿" for c in garbled) else 1 if all(c in AFTER_LETTER for c in garbled[1:]) else 2


@lru_cache(REMEMBERED)
def _chains(run: str) -> tuple[tuple[int, int, str, int], ...]:
    """(start, end, restored, strength) of the chains of sequences in a run of non-ASCII characters that chance does not explain.

    Chains of the alphabet alone are left to the automaton of patterns.
    """
    best: list[tuple[int, int, str, int]] = []
    for byte_of, automaton in _readers():
        found: list[list] = []
        for m in automaton.finditer(run):
            try:
                char = bytes(byte_of[c] for c in m.group()).decode("utf-8")
            except UnicodeDecodeError:
                continue
            if found and found[-1][1] == m.start():
                found[-1][1], found[-1][2] = m.end(), found[-1][2] + char
            else:
                found.append([m.start(), m.end(), char])
        best += [(a, b, back, strength) for a, b, back in found if (strength := _strength(run[a:b], back))]
    kept: list[tuple[int, int, str, int]] = []
    for a, b, back, strength in sorted(best, key=lambda c: (-c[3], c[0] - c[1])):  # the strongest and longest first, else in the order of the encodings
        if all(b <= x or y <= a for x, y, _, _ in kept):
            kept.append((a, b, back, strength))
    return tuple(sorted(k for k in kept if any(c not in _LETTERS for c in k[2])))


_LETTERS = set(ALPHABET)
_run = re.compile(r"[^\x00-\x7f]{2,}")
_wide_run = re.compile(r"[\u2e80-\u9fff\uac00-\ud7a3\uf900-\ufaff\uff61-\uff9f\ue000-\uf8ff]+")
_latin_run = re.compile(r"[\xa1-\xff]{4,}")


@lru_cache(REMEMBERED)
def _from_multi_byte(run: str) -> str | None:
    """What a run of wide characters is, if it is UTF-8 read as an encoding of several bytes."""
    for name in MULTI_BYTE:
        try:
            back = run.encode(name).decode("utf-8")
        except UnicodeError:
            continue
        scripts = {_script(c) for c in back} - {""}
        if back != run and len(scripts) <= 1 and all(c > "\x7f" and _in_use(c) for c in back):
            return back
    return None


@lru_cache(REMEMBERED)
def _to_multi_byte(run: str) -> str | None:
    """What a run of Latin letters is, if it is text of an encoding of several bytes (its first level of signs) read as one of one byte."""
    data = run.encode("latin_1")
    if all(0xB0 <= b <= 0xD7 for b in data[::2]) and len(data) % 2 == 0 and all(b >= 0xA1 for b in data[1::2]):
        for name in ("gb2312", "euc_kr"):
            try:
                return data.decode(name)
            except UnicodeDecodeError:
                continue
    return None


def wide_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, restored) of runs that a multi-byte encoding garbled.

    Latin letters have to be part of a word; otherwise the run has to be long, or half of all wide
    characters of the text have to read back.
    """
    runs = [(m.start(), m.end(), m.group(), _from_multi_byte(m.group())) for m in _wide_run.finditer(text)]
    back = [r for r in runs if r[3] is not None]
    half = 2 * sum(b - a for a, b, _, _ in back) >= sum(b - a for a, b, _, _ in runs)
    out = []
    for a, b, run, restored in back:
        latin = all(c < "\u0250" or not c.isalpha() for c in restored)
        glued = (a > 0 and text[a - 1].isascii() and text[a - 1].isalpha()) or (b < len(text) and text[b].isascii() and text[b].isalpha())
        if (latin and half and glued) or (not latin and len(run) > 1 and (half or len(restored) >= 4)):
            out.append((a, b, restored))
    out += [(m.start(), m.end(), restored) for m in _latin_run.finditer(text) if (restored := _to_multi_byte(m.group()))]
    return [s for s in out if not _quoted(text, s[0], s[1])]


def sequence_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, restored) of the garbled sequences of a text; neighbours make one span.

    A weak sequence counts if another follows it, or if the text has stronger ones (drawing
    characters: if it is part of a word or makes a word of its own).
    """
    if text.isascii():
        return []
    runs: list[list] = []
    for last, (size, char) in _automaton().iter_long(text):
        start = last - size + 1
        weak = _weak(text[start : last + 1], char)
        if runs and runs[-1][1] == start:
            runs[-1][1], runs[-1][2], runs[-1][3] = last + 1, runs[-1][2] + char, False
        else:
            runs.append([start, last + 1, char, weak])
    runs = [r for r in runs if not _quoted(text, r[0], r[1])]
    chains = [(m.start() + a, m.start() + b, back, strength) for m in _run.finditer(text) for a, b, back, strength in _chains(m.group())]
    chains = [c for c in chains if not _quoted(text, c[0], c[1])]
    # of a chain and the patterns it meets (which know text garbled twice) the longer counts
    chains = [c for c in chains if sum(r[1] - r[0] for r in runs if r[0] < c[1] and c[0] < r[1]) <= c[1] - c[0]]
    proof = [c[:3] for c in chains if c[3] == 2]
    proof += [w for w in wide_spans(text) if all(w[1] <= x[0] or x[1] <= w[0] for x in proof + runs)]
    runs = [r for r in runs if all(r[1] <= a or b <= r[0] for a, b, _ in proof)]
    strong = bool(proof) or any(not weak and not all("─" <= c <= "╿" for c in text[a:b]) for a, b, _, weak in runs)
    kept = list(proof)
    if strong:
        kept += [c[:3] for c in chains if c[3] == 1 and all(c[1] <= a or b <= c[0] for a, b, *_ in runs) and all(c[1] <= a or b <= c[0] for a, b, _ in proof)]
    for a, b, restored, weak in runs:
        if all("─" <= c <= "╿" for c in text[a:b]):
            if _beside_letter(text, a, b) or (len(restored) > 1 and restored.isalpha()):
                kept.append((a, b, restored))
        elif strong or not weak:
            kept.append((a, b, restored))
    return sorted(kept)


def lost_spans(text: str) -> list[tuple[int, int]]:
    """Runs of lost characters that are not quoted."""
    return [m.span() for m in _lost.finditer(text) if not _quoted(text, *m.span())] if "�" in text else []


def words(text: str) -> set[str]:
    """The non-ASCII words of a text."""
    return set() if text.isascii() else {w for w in _token.findall(text) if "�" not in w}


def readings(word: str) -> dict[str, str]:
    """What a word becomes when read back under each pair of one-byte encodings."""
    out: dict[str, str] = {}
    for wrong in ONE_BYTE:
        try:
            data = word.encode(wrong)
        except UnicodeEncodeError:
            continue
        for true in ONE_BYTE:
            if true != wrong:
                try:
                    back = data.decode(true)
                except UnicodeDecodeError:
                    continue
                if back != word and _token.fullmatch(back):
                    out.setdefault(back, f"{true}>{wrong}")
    return out


def _two(key: int) -> tuple[int, int]:
    """The bits of a 64-bit key in a Bloom filter."""
    return key % FILTER_BITS, (key >> 25) % FILTER_BITS


def _bits_of(key: Column) -> Column:
    return F.array(F.pmod(key, F.lit(FILTER_BITS)), F.pmod(F.shiftright(key, 25), F.lit(FILTER_BITS)))


def _may_have(bits: bytes, key: int) -> bool:
    return all(has(bits, b) for b in _two(key))


def _rows(documents: DataFrame) -> DataFrame:
    """(doc_id, copy, text) of the texts with other than ASCII characters; ``copy`` is the hash of the text."""
    text = F.col("text")
    rows = documents.select(F.col("doc_id").cast("bigint"), text).where(F.length(text) != F.octet_length(text))
    return wide_enough(rows.select("doc_id", F.xxhash64("text").alias("copy"), "text"))


def word_counts(documents: DataFrame) -> DataFrame:
    """(word, docs, texts): every non-ASCII word, in how many documents and how many distinct texts it is."""
    rows = _rows(documents)
    repeated = rows.select("copy").groupBy("copy").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    bits = documents.sparkSession.sparkContext.broadcast(bitmap(repeated.select(F.explode(_bits_of(F.col("copy"))).alias("at")), FILTER_BITS))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counted: dict[tuple[str, int | None], int] = {}

        def flush() -> pa.RecordBatch:
            made = pa.RecordBatch.from_pydict({"word": pa.array([w for w, _ in counted], pa.string()), "copy": pa.array([c for _, c in counted], pa.int64()), "n": pa.array(list(counted.values()), pa.int64())})
            counted.clear()
            return made

        for batch in batches:
            for copy, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                own = copy if _may_have(bits.value, copy) else None
                for w in words(text):
                    counted[w, own] = counted.get((w, own), 0) + 1
            if len(counted) > REMEMBERED:
                yield flush()
        yield flush()

    found = rows.select("copy", "text").mapInArrow(count, "word string, copy bigint, n bigint")
    by_text = found.groupBy("word", "copy").agg(F.sum("n").alias("docs"))
    return by_text.groupBy("word").agg(F.sum("docs").alias("docs"), F.sum(F.when(F.col("copy").isNull(), F.col("docs")).otherwise(1)).alias("texts"))


def _read_back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [(w, docs, texts, back, pair) for w, docs, texts in zip(*(batch.column(i).to_pylist() for i in range(3))) for back, pair in readings(w).items()]
        columns = list(zip(*rows)) if rows else [[]] * 5
        types = (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=["word", "docs", "texts", "back", "pair"])


def garbled_words(documents: DataFrame) -> DataFrame:
    """(word, back, pair, docs): the words that one-byte mistakes made, over the whole collection."""
    counted = materialize(word_counts(documents), "word-counts")
    tried = counted.mapInArrow(_read_back, "word string, docs bigint, texts bigint, back string, pair string")
    known = counted.select(F.col("word").alias("back"), F.col("docs").alias("back_docs"), F.col("texts").alias("back_texts"))
    ratio = F.when(F.length("word") == 1, RATIO_SINGLE).otherwise(RATIO)
    by_texts = F.col("back_texts") >= F.col("texts") * ratio
    by_docs = (F.col("back_docs") >= F.col("docs") * ratio) & (F.col("back_texts") >= F.col("texts"))
    better = tried.join(known, "back").where(by_texts | by_docs)
    best = Window.partitionBy("word").orderBy(F.desc("back_texts"), F.desc("back_docs"), "back")
    return better.withColumn("_n", F.row_number().over(best)).where("_n = 1").select("word", "back", "pair", "docs")


class Fixes:
    """The garbled words as patterns of an automaton, with what each was."""

    def __init__(self, back: dict[str, str]) -> None:
        import ahocorasick

        self.back = back
        self.machine = ahocorasick.Automaton()
        for word in back:
            self.machine.add_word(word, word)
        if back:
            self.machine.make_automaton()

    def spans(self, text: str) -> list[tuple[int, int, str]]:
        """(start, end, restored) of the patterns that are whole words of the text and not quoted."""
        if not self.back:
            return []
        out = []
        for last, word in self.machine.iter_long(text):
            start, end = last - len(word) + 1, last + 1
            if (start == 0 or not _inside.match(text[start - 1])) and (end == len(text) or not _inside.match(text[end])):
                out.append((start, end, self.back[word]))
        return out


_inside = regex.compile(r"[^\s!-/:-@\[-`{-~]")


def word_spans(text: str, back: dict[str, str]) -> list[tuple[int, int, str]]:
    """The same for the few words of one text."""
    return [(m.start(), m.end(), back[m.group()]) for m in _token.finditer(text) if m.group() in back] if back else []


def repair(text: str, fixes: "dict[str, str] | Fixes", depth: int = 3) -> tuple[str, bool]:
    """The text with its garbled spans replaced, and whether nothing was lost."""
    spans = sequence_spans(text)
    taken = [(a, b) for a, b, _ in spans]
    by_word = fixes.spans(text) if isinstance(fixes, Fixes) else word_spans(text, fixes)
    spans += [(a, b, back) for a, b, back in by_word if not _quoted(text, a, b) and not any(x < b and a < y for x, y in taken)]
    out, at = [], 0
    for start, end, restored in sorted(spans):
        out += [text[at:start], restored]
        at = end
    fixed = "".join([*out, text[at:]])
    if depth > 1 and fixed != text and sequence_spans(fixed):  # garbled more than once
        return repair(fixed, {}, depth - 1)
    return fixed, not lost_spans(fixed)


def _held(bad: DataFrame) -> dict[str, str] | None:
    """The garbled words, if they are few enough for an automaton that is broadcast."""
    rows = bad.select("word", "back").limit(PATTERNS + 1).collect()
    return {r.word: r.back for r in rows} if len(rows) <= PATTERNS else None


def _hits(documents: DataFrame, bad: DataFrame) -> DataFrame:
    """(doc_id, word, back) of the documents with garbled words, however many words there are; a null word: garbled sequences or losses."""
    key = F.xxhash64("word")
    bits = documents.sparkSession.sparkContext.broadcast(bitmap(bad.select(F.explode(_bits_of(key)).alias("at")), FILTER_BITS))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in batches:
            ids, found = [], []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist()):
                mine = [w for w in words(text) if _may_have(bits.value, _signed(xxhash.xxh64_intdigest(w.encode("utf-8", "surrogatepass"), seed=42)))]
                if sequence_spans(text) or lost_spans(text):
                    mine.append(None)
                ids += [doc_id] * len(mine)
                found += mine
            yield pa.RecordBatch.from_pydict({"doc_id": pa.array(ids, pa.int64()), "word": pa.array(found, pa.string())})

    scanned = materialize(_rows(documents).mapInArrow(scan, "doc_id bigint, word string"), "candidate-words")
    joined = salted_join(scanned.where("word is not null"), bad.select("word", "back"), "word", hot_keys(bad, "word", "docs"), F.col("doc_id"))
    return joined.select("doc_id", "word", "back").unionByName(scanned.where("word is null").select("doc_id", "word", F.lit(None).cast("string").alias("back")))


def _signed(key: int) -> int:
    return key - (1 << 64) if key >> 63 else key


def affected(documents: DataFrame) -> DataFrame:
    """(doc_id) of every document of which at least a part was decoded wrongly."""
    bad = materialize(garbled_words(documents), "garbled-words")
    back = _held(bad)
    if back is None:
        return _hits(documents, bad).select("doc_id").distinct()
    held = documents.sparkSession.sparkContext.broadcast(back)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fixes = Fixes(held.value)
        for batch in batches:
            ids = [i for i, text in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist()) if lost_spans(text) or fixes.spans(text) or sequence_spans(text)]
            yield pa.RecordBatch.from_pydict({"doc_id": pa.array(ids, pa.int64())})

    return _rows(documents).mapInArrow(scan, "doc_id bigint")


def _repaired(ids: list, texts: list[str], fixes: list) -> pa.RecordBatch:
    rows = [(i, *repair(text, fix)) for i, text, fix in zip(ids, texts, fixes)]
    columns = list(zip(*rows)) if rows else [[]] * 3
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.string(), pa.bool_()))], names=["doc_id", "restored", "whole"])


_RESTORED = "doc_id bigint, restored string, whole boolean"


def restore(documents: DataFrame) -> DataFrame:
    """(doc_id, restored, whole) of every affected document; ``whole`` is false where characters were lost."""
    bad = materialize(garbled_words(documents), "garbled-words")
    back = _held(bad)
    if back is not None:
        held = documents.sparkSession.sparkContext.broadcast(back)

        def mend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            fixes = Fixes(held.value)
            for batch in batches:
                mine = [(i, text) for i, text in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist()) if lost_spans(text) or fixes.spans(text) or sequence_spans(text)]
                yield _repaired([i for i, _ in mine], [t for _, t in mine], [fixes] * len(mine))

        return _rows(documents).mapInArrow(mend, _RESTORED)

    fixes = _hits(documents, bad).groupBy("doc_id").agg(F.collect_set(F.when(F.col("word").isNotNull(), F.struct("word", "back"))).alias("fixes"))  # at most the words of one text

    def mend_joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield _repaired(batch.column(0).to_pylist(), batch.column(1).to_pylist(), [{f["word"]: f["back"] for f in found or []} for found in batch.column(2).to_pylist()])

    return documents.select(F.col("doc_id").cast("bigint"), "text").join(fixes, "doc_id").select("doc_id", "text", "fixes").mapInArrow(mend_joined, _RESTORED)
