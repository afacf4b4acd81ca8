"""Text that was decoded with the wrong character encoding: found, and restored where possible.

Round trip: a word is encoded again in a candidate wrong encoding and strictly decoded in
the intended one, layer by layer, and the result is accepted when a cost of garbling drops.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

#: Encodings that text in UTF-8 is wrongly read in.
WRONG_FOR_UTF8 = ("cp1252", "latin_1", "cp1250", "cp1251", "mac_roman", "cp437", "cp850", "cp866", "koi8_r", "cp1254",
                  "cp1257", "cp1253", "iso8859_2", "iso8859_15", "cp932", "gbk", "euc_kr", "big5", "euc_jp")
#: (wrongly read in, intended) for texts in older encodings.
PAIRS = (
    ("cp1251", "koi8_r"), ("koi8_r", "cp1251"), ("cp1252", "cp1251"), ("latin_1", "cp1251"), ("latin_1", "koi8_r"),
    ("cp866", "cp1251"), ("cp1251", "cp866"), ("koi8_r", "cp866"), ("cp866", "koi8_r"), ("mac_cyrillic", "cp1251"), ("cp1251", "mac_cyrillic"),
    ("latin_1", "euc_jp"), ("cp1252", "euc_jp"), ("latin_1", "cp932"), ("cp1252", "cp932"), ("mac_roman", "cp932"),
    ("latin_1", "gbk"), ("latin_1", "euc_kr"), ("latin_1", "big5"),
    ("cp437", "cp1252"), ("mac_roman", "cp1252"), ("cp850", "cp1252"), ("cp1251", "cp1252"), ("cp1250", "cp1252"),
    ("cp866", "cp1252"), ("koi8_r", "cp1252"), ("cp1253", "cp1252"),
    ("cp1252", "cp437"), ("latin_1", "cp437"), ("cp1252", "cp850"), ("latin_1", "cp850"), ("cp1252", "mac_roman"), ("latin_1", "mac_roman"),
)
_EAST = ("euc_jp", "cp932", "gbk", "euc_kr", "big5")
#: A word whose cost is at least this shows garbled characters even where no round trip succeeds.
LOST = 1.5
#: Least drop of the cost for which a round trip through older encodings is accepted.
DROP = 1.0

_C1_LEFT = {0x81, 0x8D, 0x8F, 0x90, 0x9D}
_AFTER_LETTER_FINE = frozenset("’'”“»…–—-‐‑)].,;:!?·ªº°™®©²³¹%′″ ​‌‍﻿。、」』）：；！？・ー～〜")
_BETWEEN_FINE = frozenset("’'‘·-‐‑–—…­​‌‍⁠·•→←/⁄™°ªº﻿")
_LEADS = frozenset("ÃÂÅÄâÐÑĂ√¬‚├┬Γ")
#: Kanji and kana that UTF-8 text turns into when read as Shift-JIS (fixed values: the lead bytes E3 81-83).
_SJIS = frozenset("縺繧繝")


@lru_cache(maxsize=4096)
def _kind(ch: str) -> str:
    """l/u: lower, upper letter; o: other letter; s: symbol or mark of punctuation; m: combining; x: wrong anywhere."""
    cat = unicodedata.category(ch)
    o = ord(ch)
    if 0x80 <= o < 0xA0 or ch == "�" or cat in ("Co", "Cn", "Cs"):
        return "x"
    if ch in "ªº":
        return "s"
    if cat == "Ll":
        return "l"
    if cat in ("Lu", "Lt"):
        return "u"
    if cat in ("Lo", "Lm"):
        return "o"
    if cat[0] == "M" or cat == "Cf" and o != 0xAD:
        return "m"
    if cat == "Nd":
        return "d"
    return "s"


@lru_cache(maxsize=4096)
def _script(ch: str) -> str:
    o = ord(ch)
    if o < 0x250:
        return "common" if ch == "µ" else "latin"
    if 0x370 <= o < 0x400 or 0x1F00 <= o < 0x2000:
        return "greek"
    if 0x400 <= o < 0x530:
        return "cyrillic"
    if 0x3040 <= o < 0x3100 or 0x3400 <= o < 0xA000 or 0xF900 <= o < 0xFB00 or 0x20000 <= o < 0x32000:
        return "east"
    if 0xFF61 <= o < 0xFFA0:
        return "half"
    return "other"


#: Letters of the Latin script beyond Latin-1 that the large languages use (fixed values).
_LATIN_USUAL = frozenset("œŒŸąćęłńóśźżĄĆĘŁŃÓŚŹŻčďěňřšťůžČĎĚŇŘŠŤŮŽğışİŞĞőűŐŰăâîșțĂÂÎȘȚđĐāēīūģķļņĀĒĪŪĢĶĻŅŚėįųĖĮŲ")


def cost(word: str) -> float:
    """How garbled a word looks: 0 for a word of any script as people write it."""
    c = 0.0
    n = len(word)
    kinds = ["" if ch < "\x80" and not ch.isalnum() else _kind(ch) for ch in word]
    for i, ch in enumerate(word):
        if ch < "\x80":
            continue
        k = kinds[i]
        before = word[i - 1] if i else ""
        after = word[i + 1] if i + 1 < n else ""
        kb = kinds[i - 1] if i else ""
        ka = kinds[i + 1] if i + 1 < n else ""
        if k == "x":
            c += 2.0
            continue
        if ch == "­":
            c += 1.0 if before in _LEADS else 0.0
            continue
        if ch == " ":
            c += 0.8 if before in "ÃÂ√âĂ" and before else 0.0
            continue
        if k in "luo":
            s = _script(ch)
            if ch in _SJIS:
                c += 1.0
            if s == "half" and kb == "o" and _script(before) == "east":
                c += 0.7
            for other, ko in ((before, kb), (after, ka)):
                if ko and ko in "luo" and (other > "\x7f" and other < ch or other < "\x80"):
                    t = _script(other)
                    if s != t and {s, t} <= {"latin", "greek", "cyrillic", "half"} and "common" not in (s, t):
                        c += 1.2
            if k == "u" and kb == "l" and s != "other":
                c += 1.0
            if k == "l" and kb == "u" and before > "\x7f" and i >= 2 and kinds[i - 2] == "l":
                c += 0.3
            if s == "latin" and ord(ch) >= 0x100 and ch not in _LATIN_USUAL and ch not in "ſ":
                c += 0.5
            if ch in "ƒˆ˜":
                c += 1.0
            if before and before in "ÃÂ" and ch in "œŒžŽšŠŸƒ":
                c += 1.0
            if s == "cyrillic" and not (ch == "ё" or ch == "Ё" or "А" <= ch <= "я" or ch in "іїєґІЇЄҐўЎ"):
                c += 0.6
            if s == "cyrillic" and ch in "ъыьЪЫЬ" and not (kb and kb in "luo"):
                c += 0.6
        elif k == "s":
            letter_before, letter_after = kb != "" and kb in "luo", ka != "" and ka in "luo"
            east = letter_before and _script(before) == "east" or letter_after and _script(after) == "east"
            wide = 0x3000 <= ord(ch) < 0x3040 or 0xFF00 <= ord(ch) < 0xFF61
            if wide:
                continue
            if letter_before and letter_after and ch not in _BETWEEN_FINE and not east:
                formula = unicodedata.category(ch) == "Sm" and (i < 2 or not word[i - 2].isalpha()) and not word[i + 2:i + 3].isalpha()
                c += 0.0 if formula else 1.5
            elif letter_before and before > "\x7f" and ch not in _AFTER_LETTER_FINE:
                c += 1.0 if not east else 0.5
            elif (letter_before or letter_after) and (0x2500 <= ord(ch) < 0x25A0 or ch in "⌠⌡ⁿ∙"):
                c += 1.0
            elif letter_after and ch in "√¬├┬╧╨╤¤€¦¨¯´¸¹³²¼½¾":
                c += 1.0 if ch not in "€¬" else 0.6
            elif letter_before and before in "ÃÂ" and ch in "ªº°²³¹®©™·":
                c += 1.0
            elif letter_before and before in "ÃÂâÅÐÑ" and ch in "“‘†‡":
                c += 1.0
            if kb == "s" and before > "\x7f" and not wide and before != ch and ch not in "”“’‘»«)…–—·" and before not in "”“’‘»«…–—·":
                c += 0.7
    if n == 1 and word in "ÃÂ":
        c += LOST
    odd = [ch for ch in word if ch > "\x7f" and _kind(ch) in "lu"]
    if len(odd) >= 3 and all(_script(ch) == "latin" for ch in odd) and not any(ch.isascii() and ch.isalpha() for ch in word):
        c += 0.5 * len(odd)  # no language writes words of accented letters alone
    return c


#: Ranges of characters that restored text may consist of.
_PLAUSIBLE = ((0xA0, 0x17F), (0x192, 0x192), (0x218, 0x21B), (0x2C6, 0x2DD), (0x300, 0x36F), (0x370, 0x3FF), (0x400, 0x45F), (0x490, 0x491), (0x590, 0x5FF),
              (0x600, 0x6FF), (0x900, 0x97F), (0xE00, 0xE7F), (0x1E00, 0x1EFF), (0x2000, 0x206F), (0x2070, 0x209F), (0x20A0, 0x20BF),
              (0x2100, 0x22FF), (0x2300, 0x27BF), (0x3000, 0x30FF), (0x4E00, 0x9FFF), (0xAC00, 0xD7AF), (0xFB00, 0xFB06),
              (0xFE00, 0xFE0F), (0xFEFF, 0xFEFF), (0xFF00, 0xFFEF), (0x1F000, 0x1FAFF), (0x1D400, 0x1D7FF), (0x20000, 0x2FA1F))


@lru_cache(maxsize=4096)
def _plausible(ch: str) -> bool:
    o = ord(ch)
    return o < 0x80 or any(a <= o <= b for a, b in _PLAUSIBLE)


def _encode(word: str, wrong: str) -> bytes | None:
    try:
        return word.encode(wrong)
    except UnicodeEncodeError:
        if wrong not in ("cp1252", "cp1250", "cp1254", "cp1257", "cp1253"):
            return None
    out = bytearray()
    for ch in word:  # browsers leave the bytes that the code page has not as control characters
        try:
            out += ch.encode(wrong)
        except UnicodeEncodeError:
            if ord(ch) in _C1_LEFT or 0x80 <= ord(ch) < 0xA0:
                out.append(ord(ch))
            else:
                return None
    return bytes(out)


def _weak(word: str) -> bool:
    """A single letter before a closing mark, as ordinary text has it: no evidence by itself."""
    odd = [i for i, ch in enumerate(word) if ch > "\x7f"]
    if len(odd) != 2 or odd[1] != odd[0] + 1:
        return False
    mark = word[odd[1]]
    following = word[odd[1] + 1:odd[1] + 2]
    return mark in "”’–—…»“‘)" and not following.isalnum()


def _step(word: str) -> tuple[str, str] | None:
    """One layer less, and by which encodings; None where no round trip lowers the cost."""
    now = cost(word)
    best: tuple[float, str, str] | None = None
    for wrong in WRONG_FOR_UTF8:
        raw = _encode(word, wrong)
        if raw is None:
            continue
        try:
            got = raw.decode("utf-8")
        except UnicodeDecodeError:
            continue
        if got == word or not all(map(_plausible, got)) and not _nested(got):
            continue
        then = cost(got)
        gain = now - then
        odd = sum(ch > "\x7f" for ch in got)
        if then > now or _weak(word) and gain < 0.8 or gain <= 0 and (odd < 2 or then > 0 or _LEADS.isdisjoint(word)):
            continue
        if best is None or then < best[0]:
            best = then, got, f"{wrong}>utf_8"
    if best:
        return best[1], best[2]
    if now < DROP:
        return None
    for wrong, right in PAIRS:
        raw = _encode(word, wrong)
        if raw is None:
            continue
        try:
            got = raw.decode(right)
        except UnicodeDecodeError:
            continue
        if right in _EAST and any(ch.isascii() and ch.isalpha() for ch in got):
            continue  # Latin words do not hide single ideographs
        then = cost(got)
        marks = sum(ch > "\x7f" and not ch.isalpha() for ch in got)
        if now - then >= DROP and then <= 0.25 * now and all(map(_plausible, got)) and (best is None or then + 0.2 * marks < best[0]):
            best = then + 0.2 * marks, got, f"{wrong}>{right}"
    return (best[1], best[2]) if best else None


def _nested(word: str) -> bool:
    """Not yet plausible, but control characters of a further layer."""
    return all(_plausible(ch) or 0x80 <= ord(ch) < 0xA0 for ch in word) and not word.isascii()


def _parts(word: str) -> tuple[str, list[str]]:
    """Round trips of the stretches of a word that are garbled where the word as a whole is not."""
    out, used, at = [], [], 0
    for m in re.finditer(r"[^\x00-\x7f]{2,}", word):
        got = repair_word(m[0], False)
        out += [word[at:m.start()], got[0]]
        used += got[1]
        at = m.end()
    return "".join(out) + word[at:], used


def repair_word(word: str, split: bool = True) -> tuple[str, list[str], bool]:
    """The word as it was, the layers taken off, and whether it shows garbled characters."""
    layers: list[str] = []
    start = word
    if split and word[-1:] == "Ã" and (got := _step(word + "\xa0")):  # its second byte went as white space
        return got[0], [got[1]], True
    # each layer taken off makes the word shorter or lowers its cost, so this ends
    while not word.isascii() and (got := _step(word)):
        word = got[0]
        layers.append(got[1])
    if split and not layers and cost(word) > 0:
        word, layers = _parts(word)
    lost = any(ch in word for ch in "�") or cost(word) >= LOST
    return word, layers, bool(layers) or lost and start != ""


_ODD = re.compile(r"[^\x00-\x7f]")
_CASED = re.compile(r"[^\W\d_]{2,}")


def odd_words(text: str) -> list[tuple[int, int]]:
    """Bounds of the words (between ASCII white space) that hold a character beyond ASCII."""
    out, at, n = [], 0, len(text)
    while (m := _ODD.search(text, at)):
        a, b = m.start(), m.end()
        while a > 0 and text[a - 1] > " ":
            a -= 1
        while b < n and text[b] > " ":
            b += 1
        out.append((a, b))
        at = b
    return out


def repair(text: str, cache: dict) -> tuple[str, list[str], bool]:
    """The text as it was, the layers found, and whether it is garbled at all."""
    spans = odd_words(text)
    results = []
    for a, b in spans:
        w = text[a:b]
        r = cache.get(w)
        if r is None:
            if len(cache) > 300_000:
                cache.clear()
            r = cache[w] = repair_word(w)
        results.append(r)
    if not any(r[2] for r in results):
        return text, [], False
    layers = sorted({x for r in results for x in r[1]})
    swaps = [x.split(">") for x in layers if not x.endswith(">utf_8")]
    out, at = [], 0
    for (a, b), r in zip(spans, results):
        w = r[0]
        if swaps and not r[2]:  # beside words read in a wrong older encoding, all capitals are such a word too
            for wrong, right in swaps:
                try:
                    got = w.encode(wrong).decode(right)
                except UnicodeError:
                    continue
                other = right in ("cp1251", "koi8_r") and wrong in ("cp1252", "latin_1") and not any(ch.isascii() and ch.isalpha() for ch in w)
                if (w.isupper() and got.islower() or other) and cost(got) <= cost(w):
                    w = got
                    break
        out += [text[at:a], w]
        at = b
    return "".join(out) + text[at:], layers, True


def find_garbled(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, restored (the text as far as it can be restored), layers, whole (nothing lost).

    One row for each garbled text; texts that are null, empty, ASCII or correctly encoded in
    any script give none. Texts are read whole, in time in proportion to their length; equal
    words of a task are judged once. No shuffle. Repeated rows are each reported.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: dict = {}
        for batch in batches:
            keys, texts = batch.column(0), batch.column(1)
            rows, restored, layers, whole = [], [], [], []
            for i, t in enumerate(texts):
                t = t.as_py()
                if not t or t.isascii():
                    continue
                new, used, bad = repair(t, cache)
                if bad:
                    rows.append(i)
                    restored.append(new)
                    layers.append(used)
                    whole.append(bool(used) and not any(cache.get(new[a:b], repair_word(new[a:b]))[2] for a, b in odd_words(new)))
            yield pa.RecordBatch.from_arrays(
                [keys.take(pa.array(rows, type=pa.int32())), pa.array(restored, type=pa.string()),
                 pa.array(layers, type=pa.list_(pa.string())), pa.array(whole, type=pa.bool_())],
                names=[key, "restored", "layers", "whole"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, text).mapInArrow(run, f"`{key}` {kind}, restored string, layers array<string>, whole boolean")
