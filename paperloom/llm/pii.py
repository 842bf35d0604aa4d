"""Personal data with offset-preserving deobfuscation.

Base detection finds e-mail addresses, IPv4 addresses, card and phone numbers as written. The method then rewrites a
text with transducers that keep, for each character they put out, the span of source characters it came from: look-
alike characters and full-width forms become ASCII, invisible characters vanish, runs of spelled digits become digits,
and at/dot disguises become "@" and ".": bracketed ones, spaced at signs, spoken dots between digits, and a spoken at
before a domain with a spoken dot, or with written dots if what stands before it looks like a login (letters with an
inner dot, underscore or plus, or three letters and digits) or follows a word such as "mail". Detection runs on the rewritten text and its spans are mapped back. A mapped
span is added unless it lies within a base span of its kind; one that reaches beyond a base span covers it.

Nulls: a null text counts as empty, a null id is kept; empty texts have no spans. Offsets are code points, ends
exclusive. Repeated rows give repeated rows.
"""

from __future__ import annotations

import bisect
import hashlib
import re
import unicodedata

from pyspark.sql import DataFrame

from .common import map_rows, texts, with_text

KINDS = ("email", "ip", "card", "phone")
EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
# the look-behind and the possessive repeat change no match, but keep a long run of digits from being read again from each digit
IP = re.compile(r"(?<![0-9])[0-9]++(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
LOCAL = re.compile(r"[A-Za-z0-9._%+-]*")
NOT_DIGIT = re.compile(r"[^0-9]")
ANY_DIGIT = re.compile(r"[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else 2 * d - 9 * (d > 4)
    return total % 10 == 0


def _ip(m: str) -> bool:
    return all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m.split("."))


def _card(m: str) -> bool:
    digits = NOT_DIGIT.sub("", m)
    return 14 <= len(digits) <= 19 and luhn(digits)


def _phone(m: str) -> bool:
    return 10 <= len(NOT_DIGIT.sub("", m)) <= 15


def _emails(t: str) -> list[tuple[int, int]]:
    """The pattern's matches, begun at the @ signs: scanning every word for one would be slow."""
    out, at, last = [], t.find("@"), 0
    allowed = set("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
    while at >= 0:
        start = at
        while start > last and t[start - 1] in allowed:
            start -= 1
        m = EMAIL.match(t, start) if start < at else None
        if m:
            out.append(m.span())
            last = m.end()
        at = t.find("@", max(at + 1, last))
    return out


def detect(t: str) -> dict[str, list[tuple[int, int]]]:
    """Base spans by kind: leftmost, not overlapping within a kind, failing matches dropped."""
    found = {"email": _emails(t) if "@" in t else [], "ip": [], "card": [], "phone": []}
    if ANY_DIGIT.search(t):
        found["ip"] = [m.span() for m in IP.finditer(t) if _ip(m[0])]
        found["card"] = [m.span() for m in CARD.finditer(t) if len(m[0]) >= 14 and _card(m[0])]
        if "+" in t:
            found["phone"] = [m.span() for m in PHONE.finditer(t) if _phone(m[0])]
    return found


# Letters of other scripts that look like ASCII ones.
LOOKALIKES = {
    "А": "A", "В": "B", "С": "C", "Е": "E", "Н": "H", "І": "I", "Ј": "J", "К": "K", "М": "M", "О": "O", "Р": "P", "Ѕ": "S", "Т": "T", "Х": "X", "У": "Y",
    "а": "a", "с": "c", "ԁ": "d", "е": "e", "һ": "h", "і": "i", "ј": "j", "к": "k", "м": "m", "о": "o", "р": "p", "ԛ": "q", "ѕ": "s", "т": "t", "у": "y", "ԝ": "w", "х": "x",
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X",
    "α": "a", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ı": "i", "ɑ": "a", "ɡ": "g", "ℓ": "l",
    "。": ".", "․": ".", "‧": ".", "·": ".", "•": ".", "∙": ".", "‐": "-", "‑": "-", "‒": "-", "–": "-", "—": "-", "−": "-", " ": " ",
}
# Digits spelled out, in English, German, French and Spanish.
SPELLED = {
    "0": "zero oh null zéro cero", "1": "one eins un une uno", "2": "two zwei zwo deux dos", "3": "three drei trois tres", "4": "four vier quatre cuatro",
    "5": "five fünf cinq cinco", "6": "six sechs seis", "7": "seven sieben sept siete", "8": "eight acht huit ocho", "9": "nine neun neuf nueve",
}
DIGIT_OF = {w: d for d, words in SPELLED.items() for w in words.split()}
INVISIBLE = {chr(c) for c in (0xAD, 0x180E, 0x200B, 0x200C, 0x200D, 0x2060, 0xFEFF)}
MIN_SPELLED = 4
_WORD = "|".join(sorted(DIGIT_OF, key=len, reverse=True))
_RUN = re.compile(rf"(?i)(?<![^\W_])(?:\+\s?|plus[\s-]+)?(?:{_WORD}|[0-9])(?:[\s,.-]{{1,2}}(?:(?:dot|point|punkt|punto)\s)?(?:{_WORD}|[0-9]+)){{{MIN_SPELLED - 1},}}(?![^\W_])")
_TOKEN = re.compile(rf"(?i)plus|dot|point|punkt|punto|{_WORD}|[0-9]|\+|\.")
_DOT_WORD = {"dot", "point", "punkt", "punto"}
# blanks and words are read from the start of their run only, for time in proportion to the text
_BRACKET_AT = re.compile(r"(?i)(?:(?<!\s)\s++)?[\[({<]\s*(?:at|@|arroba|ät)\s*[\])}>]\s*")
_BRACKET_DOT = re.compile(r"(?i)(?:(?<!\s)\s++)?[\[({<]\s*(?:dot|\.|point|punkt|punto)\s*[\])}>]\s*")
_SPACED_HERE = re.compile(r"(?i)([a-z0-9._%+-]++)(\s+at\s+|\s*@\s*)([a-z0-9-]+(?:(?:\s+(?:dot|punkt|punto|point)\s+|\.)[a-z0-9-]+)+)")
_SPACED = re.compile("(?i)(?<![a-z0-9._%+-])" + _SPACED_HERE.pattern[4:])
_SPACED_DOT = re.compile(r"(?i)(?<!\s)\s++(?:dot|punkt|punto|point)\s+")
_DIGIT_DOT = re.compile(r"(?i)(?<=[0-9])\s++(?:dot|punkt|punto|point)\s++(?=[0-9])")
# other words before a spoken at and a written domain are mostly prose, as in "available at example.com"
_LOGIN = re.compile(r"(?i)(?=.*[a-z])[a-z0-9%-]+(?:[._+][a-z0-9%-]+)+|[a-z]{3,}[0-9]+")
_CUE = re.compile(r"(?i)(?<![^\W_])(?:e-?mails?|mail|mailto|contact|correo|courriel|kontakt|contacto|adresse|address)(?:\s+(?:me|us|is|to))?[\s:]{1,3}\Z")
_DOMAIN = re.compile(r"(?i)(?!www\.)[a-z0-9-]+(?:\.[a-z0-9-]+)*\.[a-z]{2,}")
_TOKENS = re.compile(r"[^\W_]+")
#: Texts without any of these cannot be disguised in a way the transducers undo.
_ODD = re.compile("[^\\x00-\\x7f\\xa1-\\xac\\xae-\\xb6\\xb8-\\u0130\\u0132-\\u017f]")
_HINT = re.compile(r"(?i)[\[({<]\s*(?:at|@|arroba|ät|dot|\.|point|punkt|punto)\s*[\])}>]|\s(?:dot|punkt|punto|point)\s|\s@|@\s|\sat\s+[a-z0-9-]+\.[a-z0-9]")


def may_spell(t: str) -> bool:
    """Whether two spelled digits stand with only digits and dots between them; looking for runs in every text would be slow."""
    words = _TOKENS.findall(t.lower())
    at = [i for i, w in enumerate(words) if w in DIGIT_OF]
    return any(all(w.isdigit() or w in _DOT_WORD for w in words[a + 1 : b]) for a, b in zip(at, at[1:]))


class Mapped:
    """A rewritten text and, for each of its characters, the start and end of its source."""

    def __init__(self, text: str):
        self.text, self.starts, self.ends = text, list(range(len(text))), list(range(1, len(text) + 1))

    def replace(self, edits: list[tuple[int, int, str]]) -> None:
        """Replace spans (ascending, disjoint) of the current text; new characters stand for the whole span."""
        if not edits:
            return
        text, starts, ends, at = [], [], [], 0
        for a, b, new in edits:
            text += [self.text[at:a], new]
            starts += self.starts[at:a] + [self.starts[a]] * len(new)
            ends += self.ends[at:a] + [self.ends[b - 1]] * len(new)
            at = b
        text.append(self.text[at:])
        self.text, self.starts, self.ends = "".join(text), starts + self.starts[at:], ends + self.ends[at:]

    def source(self, a: int, b: int) -> tuple[int, int]:
        return self.starts[a], self.ends[b - 1]


def plain_char(c: str) -> str:
    """What a character looks like in ASCII; itself where nothing is known."""
    if c in INVISIBLE:
        return ""
    if c in LOOKALIKES:
        return LOOKALIKES[c]
    d = unicodedata.digit(c, None)
    if d is not None:
        return str(d)
    n = unicodedata.normalize("NFKC", c)
    return n if len(n) == 1 and n.isascii() else c


def fold_characters(m: Mapped) -> None:
    m.replace([(x.start(), x.end(), n) for x in _ODD.finditer(m.text) if (n := plain_char(x[0])) != x[0]])


def fold_spelled_digits(m: Mapped) -> None:
    """Each run of spelled digits becomes digits; separators between them go, spoken dots become dots."""
    edits = []
    for run in _RUN.finditer(m.text):
        spelled = [(x.start() + run.start(), x.end() + run.start(), x[0].lower()) for x in _TOKEN.finditer(run[0])]
        if sum(w in DIGIT_OF for _, _, w in spelled) < 2:
            continue
        at = run.start()
        for a, b, w in spelled:
            new = DIGIT_OF.get(w) or ("." if w in _DOT_WORD else "+" if w in ("plus", "+") else w)
            if a > at and not (edits and edits[-1][1] == a):
                edits.append((at, a, ""))
            edits.append((a, b, new))
            at = b
    m.replace([e for e in edits if e[0] < e[1]])


def _spaced(t: str):
    """Addresses with a spaced or spoken at; one may begin where the one before ends, else at the start of a word."""
    at = 0
    while m := _SPACED_HERE.match(t, at) or _SPACED.search(t, at):
        yield m
        at = m.end()


def _spoken_at(t: str, x: re.Match) -> bool:
    """Whether the at before a domain with written dots is a disguise."""
    return bool(_DOMAIN.fullmatch(x[3]) and (_LOGIN.fullmatch(x[1]) or _CUE.search(t, max(0, x.start() - 40), x.start())))


def fold_at_and_dot(m: Mapped) -> None:
    m.replace([(x.start(), x.end(), ".") for x in _DIGIT_DOT.finditer(m.text)])
    m.replace([(x.start(), x.end(), "@") for x in _BRACKET_AT.finditer(m.text)])
    m.replace([(x.start(), x.end(), ".") for x in _BRACKET_DOT.finditer(m.text)])
    edits = []
    for x in _spaced(m.text):
        if x.group(2).strip() == "@" or _SPACED_DOT.search(x[3]) or _spoken_at(m.text, x):
            edits.append((x.start(2), x.end(2), "@"))
            edits += [(x.start(3) + d.start(), x.start(3) + d.end(), ".") for d in _SPACED_DOT.finditer(x[3])]
    m.replace(edits)


def disguised(t: str) -> list[Mapped]:
    """Rewritten forms of a text; none if nothing in it hints at a disguise."""
    odd, hint, spelled = _ODD.search(t), _HINT.search(t), may_spell(t)
    if not (odd or hint or spelled):
        return []
    m = Mapped(t)
    if odd:
        fold_characters(m)
    if spelled or odd:
        fold_spelled_digits(m)
    if hint or odd or spelled:
        fold_at_and_dot(m)
    return [m] if m.text != t else []


Span = tuple[int, int, int]


def find(text: str | None) -> tuple[list[Span], list[Span]]:
    """Base spans and added spans as (start, number of the kind, end), sorted."""
    t = text or ""
    base = detect(t)
    added: list[Span] = []
    for m in disguised(t):
        found = detect(m.text)
        for k, kind in enumerate(KINDS):
            # both lists are in order: what could hold a span is the last base span that begins before it, or an added one
            starts, reach = [x for x, _ in base[kind]], -1
            for a, b in found[kind]:
                s, e = m.source(a, b)
                at = bisect.bisect_right(starts, s) - 1
                if e > reach and (at < 0 or base[kind][at][1] < e):
                    added.append((s, k, e))
                    reach = e
    return sorted((s, k, e) for k, kind in enumerate(KINDS) for s, e in base[kind]), sorted(added)


def listing(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def redacted(text: str, spans: list[Span]) -> str:
    """The text with each span, and what overlaps it, replaced by its kind in angle brackets."""
    out, at = [], 0
    for s, k, e in spans:
        if s >= at:
            out += [text[at:s], f"<{KINDS[k]}>"]
        at = max(at, e)
    return "".join(out) + text[at:]


DDL = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long"


def scan(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Counts and digest of base spans, and all spans, for each whole text."""

    def rows(ids, found):
        out = []
        for i, t in zip(ids, found):
            base, added = find(t)
            counts = [sum(k == n for _, k, _ in base) for n in range(4)]
            out.append((i, *counts, hashlib.sha256(listing(base).encode()).hexdigest(), listing(sorted(base + added)), len(added)))
        return dict(zip((c.split()[0] for c in DDL.split(", ")), zip(*out)))

    return map_rows(texts(docs, id_col, text_col), rows, DDL)


def redact(docs: DataFrame, *, text_col: str = "text") -> DataFrame:
    """``docs`` with every span of the text column replaced by its kind; other columns, whatever their names, and nulls stay.

    An empty table gives one; empty texts stay empty.
    """
    return with_text(docs, text_col, lambda found: [None if t is None else redacted(t, sorted(sum(find(t), []))) for t in found])
