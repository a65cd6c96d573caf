"""Personal data with offset-preserving deobfuscation.

Base patterns run over the source text. Then transducers rewrite the text: homoglyphs and full-width
forms to ASCII, runs of spelled digits to digits, at/dot disguises to @ and a point. Each output
character keeps the source span it came from, so what the same patterns find in the rewritten text is
mapped back to source offsets. A mapped span is added if it overlaps no base span and no added span of its
own kind: as in the source text, one number can be a card and a phone.

Offsets are code points, end exclusive. Defined cases: a null text is empty and has no spans; equal
texts give equal spans; a text without any disguise isn't rewritten; an empty table gives no rows;
other columns are left alone. Every pattern takes time in proportion to the text, however long its
runs of letters or digits.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factorlake.llm.shared import map_rows

KINDS = ("email", "ip", "card", "phone")
Span = tuple[str, int, int]

_RUN = re.compile(r"[A-Za-z0-9._%+@-]+")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DOTTED = re.compile(r"[0-9][0-9.]*")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")


def emails(text: str) -> Iterator[Span]:
    """Each @ with what precedes it in its run since the last address, and the longest domain after it."""
    if "@" not in text:
        return
    for run in _RUN.finditer(text):
        if "@" not in (found := run.group()):
            continue
        local, at = 0, found.find("@")
        while at >= 0:
            after = found.find("@", at + 1)
            end = len(found) if after < 0 else after
            domain = _DOMAIN.match(found, at + 1, end) if at > local else None
            if domain:
                yield "email", run.start() + local, run.start() + domain.end()
            local = domain.end() if domain else at + 1
            at = after


def ips(text: str) -> Iterator[Span]:
    """Four numbers joined by single points; numbers of a longer chain are taken four by four."""
    for run in _DOTTED.finditer(text):
        if run.group().count(".") < 3:
            continue
        at, group = run.start(), []
        for part in run.group().split("."):
            group = [*group, (at, at + len(part), part)] if part else []
            at += len(part) + 1
            if len(group) == 4:
                if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for _, _, p in group):
                    yield "ip", group[0][0], group[3][1]
                group = []


def _luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        x = int(d) * (1 + i % 2)
        total += x - 9 if x > 9 else x
    return total % 10 == 0


def cards(text: str) -> Iterator[Span]:
    for m in _CARD.finditer(text):
        if 12 <= m.end() - m.start() and 12 <= len(digits := "".join(_DIGIT.findall(m.group()))) <= 19 and _luhn(digits):
            yield "card", m.start(), m.end()


def phones(text: str) -> Iterator[Span]:
    if "+" not in text:
        return
    for m in _PHONE.finditer(text):
        if 9 <= len(_DIGIT.findall(m.group())) <= 15:
            yield "phone", m.start(), m.end()


def base_spans(text: str) -> list[Span]:
    return [*emails(text), *ips(text), *cards(text), *phones(text)]


# Look-alike characters and the ASCII characters they stand for.
_LOOKALIKES = dict(zip("аеорсухіјѕԁһԛԝАВЕКМНОРСТХІЈЅαονρτυικΑΒΕΖΗΙΚΜΝΟΡΤΥΧ", "aeopcyxijsdhqwABEKMHOPCTXIJSaovptuikABEZHIKMNOPTYX", strict=True))
_LOOKALIKES |= {chr(0xFF01 + i): chr(0x21 + i) for i in range(94)} | {"․": ".", "‧": ".", "。": ".", "﹒": ".", "﹫": "@", "‐": "-", "‑": "-", "–": "-", " ": " ", " ": " ", " ": " ", "　": " "}
_LOOKALIKES |= {chr(base + i): str(i) for base in (0x0660, 0x06F0, 0x0966) for i in range(10)} | {chr(0x1D7CE + i): str(i % 10) for i in range(50)}
# The digits' names.
_DIGIT_WORDS = {
    w: str(i)
    for words in ("zero one two three four five six seven eight nine", "null eins zwei drei vier fünf sechs sieben acht neun", "zéro un deux trois quatre cinq six sept huit neuf", "cero uno dos tres cuatro cinco seis siete ocho nueve")
    for i, w in enumerate(words.split())
} | {"oh": "0"}

# Characters without a width, and character references of @ and the point.
_INVISIBLE = "\u00ad\u200b\u200c\u200d\u2060\ufeff"
_REFERENCES = {"64": "@", "x40": "@", "46": ".", "x2e": ".", "commat": "@", "period": "."}
_POINT_WORDS = "dot|punkt|punto|point"

_GLYPH = re.compile("[" + "".join(map(re.escape, [*_LOOKALIKES, *_INVISIBLE])) + "]")
_REFERENCE = re.compile(r"&(?:#0{0,4}(64|x40|46|x2e)|(commat|period));", re.I)
_ANY_DIGIT = "|".join(sorted(map(re.escape, _DIGIT_WORDS), key=len, reverse=True))
#: What may stand between two spelled digits, and between the parts of a disguised address: any white space, a little of it.
_BETWEEN, _GAP = r"(?:,?\s{1,3}|-)?", r"\s{1,3}"
#: At least four in a row, names or digits, with two names or more: shorter runs are ordinary prose. A spelled plus may lead.
_SPELLED = re.compile(rf"(?<!\w)(?:plus{_GAP})?(?:(?:{_ANY_DIGIT}|[0-9])(?!\w){_BETWEEN}){{3,}}(?:{_ANY_DIGIT}|[0-9])(?!\w)", re.I)
_TOKEN = re.compile(rf"plus|{_ANY_DIGIT}|[0-9]|[\s,-]+", re.I)
_BRACKETED = re.compile(rf"\s{{0,3}}[\[({{<]\s?(at|@|arroba|dot|\.|punkt|punto|point)\s?[\])}}>]\s{{0,3}}", re.I)
_WORDED = re.compile(rf"(?<![\w.%+-])([\w.%+-]+){_GAP}(?:at|arroba|klammeraffe|arobase){_GAP}([\w-]+(?:{_GAP}(?:{_POINT_WORDS}){_GAP}[\w-]+)+)(?![\w-])", re.I)
_POINTED = re.compile(rf"{_GAP}(?:{_POINT_WORDS}){_GAP}", re.I)
_NUMBERS = re.compile(rf"(?<![\w.])[0-9]{{1,3}}(?:{_GAP}(?:{_POINT_WORDS}){_GAP}[0-9]{{1,3}}){{3}}(?![\w])", re.I)
_SPACED = re.compile(r"(?<![\w.%+-])([A-Za-z0-9._%+-]+)\s{0,3}@\s{0,3}([A-Za-z0-9-]+(?: ?\. ?[A-Za-z0-9-]{2,})+)(?![\w-])")
#: Single characters with a blank after each, an @ among them.
_LETTERED = re.compile(r"(?<!\S)(?:[A-Za-z0-9._%+-] ){2,64}@(?: [A-Za-z0-9.-]){4,255}(?!\S)")
#: Four times four digits with other signs between them than a card's own.
_GROUPED = re.compile(r"(?<![\w.])[0-9]{4}([._/·•])[0-9]{4}\1[0-9]{4}\1[0-9]{4}(?![\w.])")
_BRACKET_START = re.compile(r"[\[({<]\s?(?:at|@|arroba|dot|\.|punkt|punto|point)\s?[\])}>]", re.I)
#: What a match of _SPACED holds, where only a point has a blank beside it, and where the @ has white space.
_SPACED_POINT = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]{2,})*(?: \. ?|\. )[A-Za-z0-9-]{2}")
_SPACED_AT = re.compile(r"\s@|@\s")
_POINT_WORD = re.compile(rf"\s(?:{_POINT_WORDS})\s", re.I)


_FOLDED = re.compile("[\u0130\u0131\u017f\u212a]")  # letters that patterns without case take for i, s and k
_SPELLED_LOW, _POINT_WORD_LOW = (re.compile(p.pattern) for p in (_SPELLED, _POINT_WORD))
_GROUPED_START = re.compile(r"[0-9]{4}[._/·•][0-9]{4}[._/·•]")
_LATIN = [c for c in _GLYPH.pattern if ord(c) < 256 and not c.isascii()]


def _may_hide(text: str) -> bool:
    """False only if no transducer can change the text: each of their patterns, or what every match of it holds. Most texts end
    here, so what is searched for is narrowed by plain look-ups first."""
    if not text.isascii():
        try:
            text.encode("latin-1")
            other = any(c in text for c in _LATIN)
        except UnicodeEncodeError:
            other = bool(_GLYPH.search(text) or _FOLDED.search(text))
        if other:
            return True
    if "&" in text and _REFERENCE.search(text):
        return True
    if "@" in text and (_SPACED_AT.search(text) or _SPACED_POINT.search(text)):
        return True
    low = text.lower()
    if any(w in low for w in ("dot", "punkt", "punto", "point")) and (_POINT_WORD_LOW.search(low) or _BRACKET_START.search(text)):
        return True
    if any(c in text for c in "[({<") and _BRACKET_START.search(text):
        return True
    return bool(_GROUPED_START.search(text) or _SPELLED_LOW.search(low))


class Tape:
    """A text whose characters know their source spans."""

    def __init__(self, text: str) -> None:
        self.text, self.start, self.end = text, range(len(text)), range(1, len(text) + 1)

    def rewrite(self, changes: list[tuple[int, int, str]]) -> None:
        """Replaces the given spans, in order; every new character stands for its whole span."""
        if not changes:
            return
        text, start, end, at = [], [], [], 0
        for a, b, new in [*changes, (len(self.text), len(self.text), "")]:
            text += [self.text[at:a], new]
            start += [*self.start[at:a], *[self.start[a]] * len(new)] if new else self.start[at:a]
            end += [*self.end[at:a], *[self.end[b - 1]] * len(new)] if new else self.end[at:a]
            at = b
        self.text, self.start, self.end = "".join(text), start, end


def _spelled(text: str) -> list[tuple[int, int, str]]:
    out = []
    for m in _SPELLED.finditer(text):
        parts = [(t.start(), t.end(), t.group().lower()) for t in _TOKEN.finditer(text, m.start(), m.end())]
        if sum(w in _DIGIT_WORDS for _, _, w in parts) < 2:
            continue
        # What stands between single names only parts them.
        out += [(a, b, "+" if w == "plus" else _DIGIT_WORDS.get(w, w if w.isdigit() else "")) for a, b, w in parts]
    return out


# Top-level domains of three letters and more that make "x at y dot z" an address rather than prose, and words of two that don't.
_DOMAINS = frozenset(
    "com org net edu gov mil int info biz example test museum name pro aero coop jobs mobi travel app dev online site tech store cloud xyz club shop blog live email agency company"
    " gmbh berlin hamburg koeln wien paris london nyc amsterdam madrid barcelona cat asia eus post tel".split()
)
_NO_DOMAINS = frozenset("am an as by do go he if is me my of on or so up we".split())


def _is_domain(word: str) -> bool:
    word = word.lower()
    return word in _DOMAINS or len(word) == 2 and word.isascii() and word.isalpha() and word not in _NO_DOMAINS


def _worded(text: str) -> list[tuple[int, int, str]]:
    out = []
    for m in _WORDED.finditer(text):
        if not _is_domain(m.group(2).split()[-1]):
            continue
        out.append((m.end(1), m.start(2), "@"))
        out += [(d.start() + m.start(2), d.end() + m.start(2), ".") for d in _POINTED.finditer(m.group(2))]
    return out


def _numbers(text: str) -> list[tuple[int, int, str]]:
    """The spelled points of four numbers."""
    return [(m.start() + d.start(), m.start() + d.end(), ".") for m in _NUMBERS.finditer(text) for d in _POINTED.finditer(m.group())]


def _lettered(text: str) -> list[tuple[int, int, str]]:
    """The blanks of an address written letter by letter, with a point before at least two more letters."""
    return [(m.start() + k, m.start() + k + 1, "") for m in _LETTERED.finditer(text) if re.search(r"@[A-Za-z0-9-]+(\.[A-Za-z0-9-]{2,})+$", m.group().replace(" ", "")) for k, c in enumerate(m.group()) if c == " "]


def _spaced(text: str) -> list[tuple[int, int, str]]:
    out = []
    for m in _SPACED.finditer(text):
        if re.search(r"\s", m.group()):
            out.append((m.end(1), m.start(2), "@"))
            out += [(d.start() + m.start(2), d.end() + m.start(2), ".") for d in re.finditer(r" ?\. ?", m.group(2)) if d.group() != "."]
    return out


def deobfuscate(text: str) -> Tape:
    tape = Tape(text)
    tape.rewrite([(m.start(), m.end(), _LOOKALIKES.get(m.group(), "")) for m in _GLYPH.finditer(tape.text)])
    tape.rewrite([(m.start(), m.end(), _REFERENCES[(m.group(1) or m.group(2)).lower()]) for m in _REFERENCE.finditer(tape.text)])
    tape.rewrite([(m.start(), m.end(), "@" if m.group(1).lower() in ("at", "@", "arroba") else ".") for m in _BRACKETED.finditer(tape.text)])
    for change in (_lettered, _worded, _spaced, _numbers, _spelled):
        tape.rewrite(change(tape.text))
    tape.rewrite([(m.start() + k, m.start() + k + 1, " ") for m in _GROUPED.finditer(tape.text) for k in (4, 9, 14)])
    return tape


def find(text: str | None) -> tuple[list[Span], list[Span]]:
    """(base spans, added spans), each by start and then by kind."""
    text = text or ""
    order = lambda s: (s[1], KINDS.index(s[0]), s[2])
    base = sorted(base_spans(text), key=order)
    if not _may_hide(text):
        return base, []
    tape = deobfuscate(text)
    if tape.text == text:
        return base, []
    shut = bytearray(len(text) + 1)
    for _, a, b in base:
        shut[a:b] = b"\1" * (b - a)
    taken = {kind: bytearray(shut) for kind in KINDS}
    added = []
    for kind, a, b in base_spans(tape.text):
        a, b = tape.start[a], tape.end[b - 1]
        if not any(taken[kind][a:b]):
            added.append((kind, a, b))
            taken[kind][a:b] = b"\1" * (b - a)
    return base, sorted(added, key=order)


def joined(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone (base and added), base_sha256, spans, n_added: one row per row of docs."""

    def each(doc_id: int | None, text: str | None) -> list[tuple]:
        base, added = find(text)
        spans = sorted(base + added, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))
        n = Counter(k for k, _, _ in spans)
        return [(doc_id, *[n[k] for k in KINDS], hashlib.sha256(joined(base).encode()).hexdigest(), joined(spans), len(added))]

    schema = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long"
    return map_rows(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), lambda: each, schema)
