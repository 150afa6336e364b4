"""Text that was decoded with the wrong character encoding: finding it and restoring the original.

Characters are mapped back to the bytes of a legacy encoding, an automaton over the bytes finds the maximal spans that are
well formed in the encoding the text was written in, and those spans alone are decoded; all else stays as it is.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wickerlane.workspace import materialize

LOST = "\ufffd"
#: Encodings a UTF-8 text may have been read with, one byte a character. "windows" is cp1252 as browsers read it: undefined bytes are C1 controls.
SINGLE = ("windows", "iso8859_15", "mac_roman", "cp850", "cp437", "cp1250", "cp1251", "cp1254", "koi8_r", "cp866", "cp1253", "iso8859_2")
#: Pairs (read with, written in) for multibyte encodings other than UTF-8, or read with a multibyte one.
MULTI = (("gb18030", "utf_8"), ("cp932", "utf_8"), ("big5", "utf_8"), ("euc_kr", "utf_8"), ("cp932", "euc_jp"), ("windows", "cp932"), ("windows", "euc_jp"), ("gb18030", "euc_jp"), ("euc_jp", "cp932"))
#: Pairs (read with, written in) of one-byte encodings, told by the words of the corpus.
SWAPPED = (
    ("cp850", "cp1252"), ("cp437", "cp1252"), ("mac_roman", "cp1252"), ("windows", "cp1251"), ("windows", "cp1254"), ("windows", "cp1250"), ("windows", "iso8859_2"), ("windows", "mac_roman"), ("windows", "cp850"),
    ("cp1251", "koi8_r"), ("koi8_r", "cp1251"), ("cp866", "cp1251"), ("cp1251", "cp866"), ("cp1251", "cp1252"), ("cp1250", "cp1252"), ("windows", "koi8_r"), ("windows", "cp1253"), ("cp1251", "iso8859_5"), ("iso8859_5", "cp1251"), ("mac_cyrillic", "cp1251"), ("cp1251", "mac_cyrillic"),
)
CYRILLIC = ("cp1251", "koi8_r", "cp866")
QUOTES = "’‘“”„‚´`'\""
OPENING, CLOSING = "“\"'‘«„`‹(", "”\"'’»“`›)"


@cache
def byte_of(codec: str) -> dict[str, int]:
    """Character to byte, for the bytes from 0x80 on."""
    out = {}
    for b in range(0x80, 0x100):
        if codec == "windows":
            out[chr(b)] = b  # C1 controls and Latin-1
        else:
            try:
                out[bytes([b]).decode(codec)] = b
            except UnicodeDecodeError:
                pass
    if codec == "windows":
        for b in range(0x80, 0xA0):
            try:
                out[bytes([b]).decode("cp1252")] = b
            except UnicodeDecodeError:
                pass
    return out


@cache
def utf8_automaton(codec: str) -> re.Pattern:
    """The UTF-8 byte automaton with its transitions on the characters of ``codec``."""
    chars = byte_of(codec)

    def state(lo: int, hi: int) -> str:
        return "[" + "".join(re.escape(c) for c, b in chars.items() if lo <= b <= hi) + "]"

    tail, branches = state(0x80, 0xBF), []
    branches.append(state(0xC2, 0xDF) + tail)
    for lo, hi, first in ((0xE0, 0xE0, (0xA0, 0xBF)), (0xE1, 0xEC, (0x80, 0xBF)), (0xED, 0xED, (0x80, 0x9F)), (0xEE, 0xEF, (0x80, 0xBF))):
        branches.append(state(lo, hi) + state(*first) + tail)
    for lo, hi, first in ((0xF0, 0xF0, (0x90, 0xBF)), (0xF1, 0xF3, (0x80, 0xBF)), (0xF4, 0xF4, (0x80, 0x8F))):
        branches.append(state(lo, hi) + state(*first) + tail + tail)
    return re.compile("(?:" + "|".join(b for b in branches if "[]" not in b) + ")+")


#: Blocks of letters, marks and symbols that written text has; a span that decodes to others is a chance hit.
_COMMON = re.compile(
    "[\u00a0-\u017f\u0192\u0218-\u021b\u02c6\u02dc\u0386-\u03ce\u0401-\u045f\u0490\u0491\u1ea0-\u1ef9\u200b-\u200f\u2010-\u203a\u2070-\u209f\u20a0-\u20bf\u2100-\u214f"
    "\u2190-\u21ff\u2200-\u22ff\u2460-\u24ff\u2500-\u257f\u25a0-\u27bf\u3000-\u30ff\u4e00-\u9fff\uac00-\ud7a3\ufe0f\ufeff\uff00-\uffef\u0080-\u009f\ufffd]|[\U0001f300-\U0001faff]"
)
#: Scripts whose letters lie outside those blocks; three of one script in a span are no chance hit.
SCRIPTS = frozenset("ARABIC HEBREW SYRIAC THAANA THAI LAO DEVANAGARI BENGALI GURMUKHI GUJARATI ORIYA TAMIL TELUGU KANNADA MALAYALAM SINHALA GEORGIAN ARMENIAN MYANMAR KHMER ETHIOPIC TIBETAN CYRILLIC GREEK LATIN".split())


@cache
def script(c: str) -> str:
    return unicodedata.name(c, "").split(" ")[0]


def _rare(decoded: str) -> int:
    """Of a span with characters outside the common blocks: 2 for three or more of one script, 1 for fewer, 0 for none such."""
    names = {script(c) for c in decoded if not _COMMON.match(c)}
    if len(names) != 1 or not names <= SCRIPTS:
        return 0
    name = names.pop()
    if sum(script(c) == name for c in decoded) >= 3:
        return 2
    return 0 if name in ("CYRILLIC", "GREEK", "LATIN") else 1


_MARKS = "®™©°ºª»”’"


def quoted(text: str, a: int, b: int) -> bool:
    """The span stands alone between quotes: it is shown as an example."""
    return a > 0 and b < len(text) and text[a - 1] in OPENING and text[b] in CLOSING


def plausible(codec: str, text: str, a: int, b: int, decoded: str) -> int:
    """Whether a well-formed span is garbled text (2) and not sound text that happens to be well formed (0).

    Two letters in a row may be either (1): they count where the text has other spans of the same encoding.
    """
    raw = text[a:b]
    if quoted(text, a, b):
        return 0
    if decoded in QUOTES and not text[max(0, a - 1) : a].strip() and not text[b : b + 1].strip():
        return 0  # a quotation mark that stands by itself between spaces is shown as an example
    if any(not _COMMON.match(c) for c in decoded):
        sure = _rare(decoded)
        if sure < 2:
            return sure if codec == "windows" else 0  # read otherwise, one or two may be a chance hit
    if len(decoded) == 1 and raw.isalpha() and _EAST.match(decoded) and codec not in CYRILLIC:
        return 1 if codec == "windows" else 0  # three letters in a row
    before, after = text[max(0, a - 2) : a], text[b : b + 1]
    if len(decoded) == 1 and raw[0].isupper() and before[-1:].isupper():
        # A capital that ends a word in capitals, before a mark of its own: MAÇÃ®, IRMÃ™, LÃ®. (But SÃ\xad is Sí.)
        word = len(before) == 2 and before.isalpha() and before.isupper()
        if raw[1:] in _MARKS and (word or not after.islower()) or word and decoded.islower():
            return 0
    if codec in CYRILLIC:
        # Sound Cyrillic may hold a pair such as "Рё"; garbled text is dense, or holds what no Russian word has.
        odd = sum(c not in "ёЁ№«»—–…“”„’°§±·©® " and not ("А" <= c <= "я") for c in raw)
        if len(raw) == 2:
            return 2 * (odd >= 1 or raw[1] in "©«»±§")
        return 2 * ((len(decoded) >= 3 or not ("Ѐ" <= decoded[0] <= "ӿ")) and odd >= 1)
    if codec == "windows" or codec == "iso8859_15":
        return 2
    return 2 if any(not c.isalpha() for c in raw) or len(raw) >= 3 else 1


@cache
def _ends(codec: str) -> tuple[frozenset, frozenset]:
    """The characters a multibyte sequence may begin with, and go on with."""
    chars = byte_of(codec)
    return frozenset(c for c, b in chars.items() if 0xC2 <= b <= 0xF4), frozenset(c for c, b in chars.items() if b <= 0xBF)


def _spans_utf8(text: str, codec: str) -> list[tuple[int, int, str]]:
    chars, out = byte_of(codec), []
    for m in utf8_automaton(codec).finditer(text):
        a, decoded = m.start(), bytes(chars[c] for c in m.group()).decode("utf-8")
        sure = plausible(codec, text, *m.span(), decoded)
        if sure:
            out.append((sure, *m.span(), decoded))
        elif len(decoded) > 1:  # chance hits beside garbled text: judge each character by itself
            for c in decoded:
                b = a + len(c.encode())
                sure = plausible(codec, text, a, b, c)
                if sure:
                    out.append((sure, a, b, c))
                a = b
    return [x[1:] for x in out] if any(x[0] == 2 for x in out) else []


_RUN = re.compile("[\u0080-\ufffc](?:[!-~]?[\u0080-\ufffc])*[!-~]?")
_PAIR = re.compile("[\u0080-\U0010ffff]{2,}")
_KANA = re.compile("[\u3041-\u30fe]")
_EAST = re.compile("[\u3000-\u30ff\u4e00-\u9fff\uac00-\ud7a3\uff00-\uff5e]")
_WIDE = re.compile("[\u2e80-\ufaff\uff00-\uffef]")
#: A letter of a word in ASCII letters that is Han or Hangul.
_LONE = re.compile("(?<=[A-Za-z])[\u4e00-\u9fff\uac00-\ud7a3](?=[a-z])")


@cache
def _bytewise() -> re.Pattern:
    return re.compile("[\x21-\x7e" + "".join(re.escape(c) for c in byte_of("windows")) + "]+")


def _runs(text: str) -> list[tuple[int, str, bool]]:
    """Runs of non-ASCII characters (single ASCII ones between them) that may be garbled East Asian text: start, run and whether it is wide."""
    out = []
    for m in _RUN.finditer(text):
        run = m.group()
        if len(run) >= 2 and len(_KANA.findall(run)) <= 0.2 * len(run):
            wide = len(_WIDE.findall(run))
            if 2 * wide >= len(run):
                out.append((m.start(), run, True))
            elif not wide:
                out += [(m.start() + x.start(), x.group(), False) for x in _bytewise().finditer(run) if len(x.group()) >= 2]
    return out


def _pieces(run: str, codec: str) -> Iterator[tuple[int, str, bytes]]:
    """The parts of a run that ``codec`` can have given, with their bytes; other characters stay as they are."""
    at = 0
    while at < len(run):
        try:
            yield at, run[at:], run[at:].encode(codec)
            return
        except UnicodeEncodeError as e:
            if e.start:
                yield at, run[at : at + e.start], run[at : at + e.start].encode(codec)
            at += e.end


def _spans_pairs(runs: list[tuple[int, str, bool]]) -> tuple[str, list[tuple[int, int, str]]]:
    """Chinese (GB) or Korean (EUC) text read byte by byte: the encoding and the spans whose bytes are pairs of it.

    The bytes of all runs together must be distributed as in such text, and not as in Cyrillic or Greek letters.
    """
    m, narrow = byte_of("windows"), [(at, run) for at, run, wide in runs if not wide]
    cut = [(at, run, bytes(m[c] if c > "\x7f" else ord(c) for c in run)) for at, run in narrow]
    pairs = [p for _, _, data in cut for p in zip(data[::2], data[1::2]) if p[0] > 0x7F]
    low = sum((0xA1 <= x <= 0xBF) for p in pairs for x in p)
    high = sum(b >= 0xD0 for _, b in pairs)
    if len(pairs) < 4 or low < 0.3 * len(pairs) or high < 0.15 * len(pairs):
        return "", []
    for right, last, share in (("euc_kr", 0xC8, 1.0), ("gb18030", 0xD7, 0.8)):
        if sum(0xB0 <= a <= last and b >= 0xA1 or a in (0xA1, 0xA3) for a, b in pairs) >= share * len(pairs):
            spans = [(at, at + len(run), data.decode(right, "replace")) for at, run, data in cut]
            return f"windows<{right}", [x for x in spans if LOST not in x[2]]
    return "", []


def _spans_multi(runs: list[tuple[int, str, bool]], wrong: str, right: str) -> list[tuple[int, int, str]]:
    """Spans of the runs whose bytes are well formed in ``right`` but for their ends, and read as East Asian text."""
    out = []
    for start, run, wide in runs:
        if wide == (wrong == "windows"):
            continue
        if wrong == "windows":
            m = byte_of("windows")
            pieces = [(0, run, bytes(m[c] if c > "\x7f" else ord(c) for c in run))]
        else:
            pieces = _pieces(run, wrong)
        for at, piece, data in pieces:
            if len(piece) < 4:
                continue
            best, cut = "", 0
            for skip in range(3 if right == "utf_8" else 2):
                d = data[skip:].decode(right, "replace")
                if not best or d.count(LOST) < best.count(LOST):
                    best, cut = d, skip
                if LOST not in d:
                    break
            lost_ = best.count(LOST)
            if lost_ > 0.3 * len(best):
                continue
            kana = len(_KANA.findall(best))
            if kana < 2 and (right != "utf_8" or lost_ > 1):
                continue
            east = len(_EAST.findall(best))
            good = east + sum(c.isascii() for c in best)
            if kana >= 2 and good >= 0.7 * len(best) or right == "utf_8" and east >= 3 and good >= 0.9 * len(best):
                out.append((start + at, start + at + len(piece), LOST * (cut > 0) + best))
    return out


def _spans_lone(text: str) -> list[tuple[int, int, str]]:
    """Latin letters in UTF-8 that were read as one Han or Hangul character, within words."""
    out = []
    for m in _LONE.finditer(text):
        for codec in ("gb18030", "cp949", "big5", "cp932"):
            try:
                d = m.group().encode(codec).decode("utf-8")
            except UnicodeError:
                continue
            if len(d) == 1 and "\u00df" <= d <= "\u017f" and d.islower():
                out.append((*m.span(), d))
                break
    return out


def _replace(text: str, spans: list[tuple[int, int, str]]) -> str:
    out, at = [], 0
    for a, b, d in spans:
        out += [text[at:a], d]
        at = b
    return "".join([*out, text[at:]])


def repair(text: str, rounds: int = 6) -> tuple[str, list[str]]:
    """The text with its garbled spans decoded, and the encodings undone, the last reading first.

    In each round the encoding whose spans cover most characters is undone. Characters that were lost (U+FFFD) stay.
    """
    undone: list[str] = []
    for _ in range(rounds):
        there = set("".join(_PAIR.findall(text)))
        lone = _spans_lone(text)
        best, spans, name = (len(lone), 0), lone, "multibyte<utf_8"
        if not there and not lone:
            break
        for codec in SINGLE:
            first, further = _ends(codec)
            if there.isdisjoint(first) or there.isdisjoint(further):
                continue
            found = _spans_utf8(text, codec)
            # Readings that cover as much differ in their letters: running text has small ones.
            covered = (sum(b - a for a, b, _ in found), sum(c.islower() for *_, d in found for c in d))
            if covered > best:
                best, spans, name = covered, found, codec
        runs = _runs(text) if there else []
        codec, found = _spans_pairs(runs)
        covered = (sum(b - a for a, b, _ in found), 0)
        if covered > best:
            best, spans, name = covered, found, codec
        for wrong, right in MULTI if runs else ():
            found = _spans_multi(runs, wrong, right)
            covered = (sum(b - a for a, b, _ in found), 0)
            if covered > best:
                best, spans, name = covered, found, f"{wrong}<{right}"
        if not spans:
            break
        text = _replace(text, spans)
        undone.append(name)
    return text, undone


def lost(text: str) -> bool:
    """A replacement character stands in the text, other than quoted as an example."""
    return any(not quoted(text, m.start(), m.end()) for m in re.finditer(LOST, text))


@cache
def swap_table(wrong: str, right: str) -> dict[int, str]:
    """Translation of the characters that ``wrong`` gave back to those of ``right``."""
    out = {}
    for c, b in byte_of(wrong).items():
        try:
            d = chr(b) if right == "windows" else bytes([b]).decode(right)
        except UnicodeDecodeError:
            continue
        out[ord(c)] = d
    return out


WORD = "[A-Za-z\\u0080-\\u02ff\\u0370-\\u058f\\u1e00-\\u2fff]*[\\u0080-\\u02ff\\u0370-\\u058f\\u1e00-\\u2fff][A-Za-z\\u0080-\\u02ff\\u0370-\\u058f\\u1e00-\\u2fff]*"
_LETTER = re.compile(r"[^\W\d_]")


def _readings(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Other readings of each word: its bytes in another one-byte encoding, or its UTF-8 sequences decoded."""
    for pdf in batches:
        out = []
        for w, n, rows in zip(pdf["word"], pdf["n"], pdf["rows"]):
            there = set(w)
            foreign = {ord(c) for c in there if c > "\x7f"}
            for pair in SWAPPED:
                if not foreign <= swap_table(*pair).keys():  # some character is not of this reading
                    continue
                d = w.translate(swap_table(*pair))
                letters = len(_LETTER.findall(d))
                if d != w and letters and len(d) == len(w) and all(_COMMON.match(c) for c in d if c > "\x7f"):
                    out.append((w, n, rows, f"{pair[0]}<{pair[1]}", d, letters >= 3))
            for codec in SINGLE:
                first, further = _ends(codec)
                if there.isdisjoint(first) or there.isdisjoint(further):
                    continue
                chars = byte_of(codec)
                d = utf8_automaton(codec).sub(lambda m: bytes(chars[c] for c in m.group()).decode("utf-8"), w)
                letters = len(_LETTER.findall(d))
                if d != w and letters:
                    out.append((w, n, rows, f"{codec}<utf_8", d, letters >= 3))
        yield pd.DataFrame(out, columns=["word", "n", "rows", "pair", "reading", "long"])


def _fix(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        out = []
        for h, t in zip(pdf["hash"], pdf["text"]):
            fixed, undone = repair(t)
            gone = lost(t)
            if undone or gone:
                out.append((h, fixed, ",".join(undone), gone, "bytes" if undone else "lost"))
        yield pd.DataFrame(out, columns=["hash", "restored", "encodings", "lost", "told_by"])


def _reword(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Only the words given are read anew."""
    word = re.compile(WORD)
    for pdf in batches:
        out = []
        for text, words, readings in zip(pdf["text"], pdf["words"], pdf["readings"]):
            known = dict(zip(words, readings))
            out.append(word.sub(lambda m: known.get(m.group(), m.group()), text))
        yield pd.DataFrame({"hash": pdf["hash"], "restored": out, "encodings": pdf["pair"], "lost": False, "told_by": "words"})


def suspect(text: str) -> Column:
    """A text must hold these for its bytes to tell: characters in a row, a lost one, or a Han or Hangul letter in a word.

    One pattern each: as alternatives of a single one they take fifteen times as long.
    """
    c = F.col(text)
    return c.rlike("[\u0080-\uffff]{2}") | c.contains(LOST) | c.rlike("[\u4e00-\u9fff\uac00-\ud7a3][a-z]")


def garbled(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", known: int = 3, times: int = 4) -> DataFrame:
    """``id_col``, ``restored``, ``encodings``, ``lost`` and ``told_by`` of the texts that hold wrongly decoded characters.

    Multibyte encodings are told by their byte structure (``repair``; ``told_by`` bytes). Between one-byte encodings there
    is none to tell by, and lone pairs of letters may be either, so the words do (``told_by`` words): a word of three letters,
    one not ASCII, is garbled if another reading of its bytes is a word of at least ``known`` texts and in ``times`` as
    many as the word itself. The counts are over all distinct texts; counts over rows do as well where those of distinct
    texts do not speak against them. Only those words are then read anew, and others of the text whose reading by the same
    encodings is more frequent than they are. ``encodings`` names the readings undone;
    ``lost`` tells of characters that cannot be had again (U+FFFD), which make a text a case by themselves
    (``told_by`` lost).

    Each distinct text is looked at once, and its verdict goes to all copies.

    Defined cases: null, empty and ASCII texts never come out; escapes are left alone; a span alone between quotes, or a
    quotation mark alone between spaces, is an example and no case; copies each come out; texts may be of any length and
    are taken whole; an empty table gives an empty result; other columns, whatever their names, are ignored.
    """
    texts = df.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text")).where(F.col("text").rlike("[^\\x00-\\x7f]")).withColumn("hash", F.unhex(F.md5("text")))
    distinct = materialize(texts.groupBy("hash").agg(F.first("text").alias("text"), F.count(F.lit(1)).alias("copies")), "distinct-texts")
    verdict = "hash binary, restored string, encodings string, lost boolean, told_by string"
    spans = distinct.where(suspect("text")).select("hash", "text").mapInPandas(_fix, verdict)

    # The words are read three times below: cheaper written once than cut out of the texts again.
    words = materialize(distinct.select("hash", "copies", F.explode(F.array_distinct(F.expr(f"regexp_extract_all(text, '{WORD}', 0)"))).alias("word")), "words")
    counts = words.groupBy("word").agg(F.count(F.lit(1)).alias("n"), F.sum("copies").alias("rows"))
    readings = counts.mapInPandas(_readings, "word string, n bigint, rows bigint, pair string, reading string, long boolean")
    sound = counts.select(F.col("word").alias("reading"), F.col("n").alias("m"), F.col("rows").alias("sound_rows"))
    more = lambda m, n: (F.col(m) >= known) & (F.col(m) >= times * F.col(n))
    judged = more("m", "n") | more("sound_rows", "rows") & (F.col("m") >= F.col("n"))
    wrong = readings.join(sound, "reading").withColumn("votes", F.col("long") & judged).where(F.col("votes") | F.expr("m > n OR m = n AND sound_rows > rows")).select("word", "pair", "m", "reading", "votes")
    votes = F.count_if("votes")
    hits = words.join(wrong, "word").groupBy("hash", "pair").agg(votes.alias("hits"), F.sum(F.when(F.col("votes"), F.col("m"))).alias("m"), F.collect_list("word").alias("words"), F.collect_list("reading").alias("readings"))
    best = hits.where("hits > 0").groupBy("hash").agg(F.max_by(F.struct("pair", "words", "readings"), F.struct("hits", "m", "pair")).alias("b")).select("hash", "b.*")
    reworded = distinct.select("hash", "text").join(best, "hash").mapInPandas(_reword, verdict)
    # A text told by its bytes keeps that reading; the words come before a lost character.
    both = spans.withColumn("place", F.when(F.col("told_by") == "bytes", 0).otherwise(2)).unionByName(reworded.withColumn("place", F.lit(1)))
    one = both.groupBy("hash").agg(F.min_by(F.struct("restored", "encodings", "told_by"), "place").alias("r"), F.max("lost").alias("lost"))
    return texts.select("id", "hash").join(one, "hash").select(F.col("id").alias(id_col), "r.restored", "r.encodings", "lost", "r.told_by")
