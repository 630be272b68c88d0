"""Personal data in texts: base patterns, and candidates that boosted trees choose among.

Base spans (email, ip, card, phone) are fixed by their patterns and always stay.
High-recall generators propose further, overlapping spans: disguised addresses,
national phone numbers, identity numbers, account numbers and IPv6 addresses.
Trees score each by its format and the words around it; a span is kept at its
kind's calibrated threshold unless it overlaps a base span or a better one.
The trees learn from samples that this module writes by rule with a fixed seed.

Defined results: null and empty texts have no spans; spans are in code points,
end exclusive, ordered by start, then kind; equal texts give equal spans; all
patterns take time linear in the text.
"""

from __future__ import annotations

import bisect
import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm.arrow import map_texts, pieces
from factloom.llm.boosting import Boosting

BASE_KINDS = ("email", "ip", "card", "phone")
MORE_KINDS = ("masked_email", "local_phone", "identity", "account", "ipv6")
KINDS = BASE_KINDS + MORE_KINDS
ORDER = {k: i for i, k in enumerate(KINDS)}

LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
AT_DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
AT = re.compile("@")
QUAD = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
DIGIT = re.compile("[0-9]")

GENERATORS = {
    "masked_email": re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64} ?[\[({<] ?(?:at|AT) ?[\])}>] ?[A-Za-z0-9-]{1,63}(?:(?:\.| ?[\[({<] ?(?:dot|DOT) ?[\])}>] ?)[A-Za-z0-9-]{1,63}){1,6}"),
    "local_phone": re.compile(r"(?<![0-9+.])\(?[0-9]{2,5}\)?[ ./-]{1,2}[0-9]{3,4}(?:[ ./-][0-9]{2,4}){1,3}(?![0-9])"),
    "identity": re.compile(r"(?<![0-9-])[0-9]{3}[- ][0-9]{2}[- ][0-9]{4}(?![0-9-])"),
    "account": re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"),
    "ipv6": re.compile(r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:])"),
}
#: Kinds whose last group may be a number that follows by chance.
SHORTER = ("local_phone", "account")
LAST_GROUP = re.compile(r"[ ./-][A-Z0-9]+\Z")
MASK = re.compile(r"[\[({<] ?(?:at|AT) ?[\])}>]")
ENDING = re.compile(r"(?i)[^a-z](?:com|org|net|edu|gov|int|info|biz|[a-z]{2})$")
#: A further group stands after the span.
FOLLOWS = re.compile(r"[ ./-][A-Z0-9]+(?![a-z])")
CONTEXT = 28
#: No threshold lies below this: the samples' look-alikes are fewer in kind than those of real texts.
FLOOR = 0.3
#: Words near a span that speak for or against it.
HINTS = (
    re.compile(r"(?i)\b(?:tel|phone|call|mobile|cell|fax|whatsapp|telefon|tél|móvil)"),
    re.compile(r"(?i)\b(?:ssn|social security|identity|passport|ausweis|sécu|dni)"),
    re.compile(r"(?i)\b(?:iban|account|konto|compte|cuenta|bank)"),
    re.compile(r"(?i)\b(?:e-?mail|contact|write|address|mail)"),
    re.compile(r"(?i)\b(?:date|year|page|version|isbn|issn|order|invoice|ref|part|no\.|art|item|code|doi|score|build)"),
)


def _luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = ord(c) - 48
        if i % 2:
            n = n * 2 - 9 * (n > 4)
        total += n
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """The base matches of each kind, leftmost and non-overlapping; matches that fail their check are dropped."""
    found: list[tuple[str, int, int]] = []
    if "@" in text:
        left = 0  # the part before an @ reaches back to the last @ or match at most
        domains = {m.start(): m.end() for m in AT_DOMAIN.finditer(text)}
        for at in (m.start() for m in AT.finditer(text)):
            before = text[left:at]
            local = len(before) - len(before.rstrip(LOCAL))
            left = at + 1
            if local and at in domains:
                found.append(("email", at - local, domains[at]))
                left = domains[at]
    if not DIGIT.search(text):
        return found
    for m in QUAD.finditer(text):
        if all(len(p) <= 3 and int(p) <= 255 for p in (x.lstrip("0") or "0" for x in m[0].split("."))):
            found.append(("ip", m.start(), m.end()))
    for m in CARD.finditer(text):
        if 12 <= m.end() - m.start() <= 37:
            digits = m[0].replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19 and _luhn(digits):
                found.append(("card", m.start(), m.end()))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
                found.append(("phone", m.start(), m.end()))
    return found


def proposals(text: str) -> Iterator[tuple[str, int, int]]:
    """Overlapping candidates of the further kinds: each match, and where its last group may belong to what follows
    the shorter reading without it."""
    has_digit = DIGIT.search(text) is not None
    for kind, pattern in GENERATORS.items():
        if MASK.search(text) if kind == "masked_email" else has_digit and (kind != "ipv6" or ":" in text):
            for m in pattern.finditer(text):
                yield kind, m.start(), m.end()
                if kind in SHORTER and (cut := LAST_GROUP.search(m[0])) and pattern.fullmatch(text, m.start(), m.start() + cut.start()):
                    yield kind, m.start(), m.start() + cut.start()


def _mod97(text: str) -> bool:
    moved = text[4:] + text[:4]
    return int("".join(str(int(c, 36)) for c in moved)) % 97 == 1


def features(text: str, kind: str, start: int, end: int) -> list[float]:
    """Format of the span, and what stands around it."""
    span = text[start:end]
    before, after = text[max(0, start - CONTEXT) : start], text[end : end + CONTEXT]
    groups = re.findall("[0-9]+", span)
    solid = span.replace(" ", "")
    first = int(groups[0]) if groups and len(groups[0]) < 5 else -1
    last = int(groups[-1]) if groups and len(groups[-1]) < 5 else -1
    return [
        *(float(kind == k) for k in MORE_KINDS),
        len(span),
        sum(map(len, groups)),
        len(groups),
        float("(" in span),
        span.count("."),
        span.count("/"),
        span.count("-"),
        span.count(" "),
        float(1900 <= first <= 2099 or 1900 <= last <= 2099),
        float(len(groups) == 3 and 1 <= int(groups[1][:4]) <= 31 and 1 <= first <= 31),
        float(span[:1] in "(0"),
        float(kind == "account" and solid.isascii() and _mod97(solid)),
        float(kind == "masked_email" and ENDING.search(span) is not None),
        *(float(h.search(before) is not None) for h in HINTS),
        float(HINTS[4].search(after) is not None),
        float(before[-1:].isalnum()),
        float(after[:1].isalnum()),
        float(before[-1:] in "$€£#%=*/.:"),
        float(after[:1] in "%€$/*=:"),
        float(FOLLOWS.match(after) is not None),
        float(len(groups) > 1 and span[-len(groups[-1]) - 1 :][:1] != span[len(groups[0]) + span.find(groups[0]) :][:1]),
    ]


def samples(count: int, seed: int = 7) -> list[tuple[str, str, int, int, int]]:
    """(text, kind, start, end, label) written by rule: personal data with and without hints, and look-alikes."""
    rng = np.random.default_rng(seed)
    pick = lambda xs: xs[int(rng.integers(len(xs)))]
    digits = lambda n: "".join(map(str, rng.integers(0, 10, n)))
    word = lambda: "".join(pick(["an", "er", "tho", "li", "ge", "cion", "re", "sta", "mo", "que"]) for _ in range(int(rng.integers(1, 5))))
    hint = {"masked_email": ["mail ", "contact: ", "write to "], "local_phone": ["call ", "tel. ", "phone: ", "fax ", "mobile "], "identity": ["SSN ", "social security ", "identity no. "], "account": ["IBAN ", "bank account ", "konto "], "ipv6": ["host ", "address ", "from "]}
    against = ["page ", "date ", "version ", "order ", "ISBN ", "invoice ", "ref ", "part ", "score ", "item "]

    def account() -> str:
        body = "".join(pick("0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ") for _ in range(int(rng.integers(11, 24))))
        country = pick(["DE", "FR", "ES", "GB", "NL"])
        check = 98 - int("".join(str(int(c, 36)) for c in body + country + "00")) % 97
        solid = f"{country}{check:02d}{body}"
        return " ".join(solid[i : i + 4] for i in range(0, len(solid), 4)) if rng.random() < 0.5 else solid

    def person(kind: str) -> str:
        s = pick([" ", "-", "."])
        return {
            "masked_email": lambda: f"{word()}{pick(['.', '_', ''])}{word()}{pick([' [at] ', '(at)', ' (AT) ', '[at]'])}{word()}{pick(['.', ' [dot] ', '(dot)'])}{pick(['com', 'org', 'de', 'net'])}",
            "local_phone": lambda: pick([f"({digits(3)}) {digits(3)}-{digits(4)}", f"0{digits(2)}{s}{digits(4)}{s}{digits(4)}", f"{digits(3)}{s}{digits(3)}{s}{digits(4)}", f"0{digits(1)}{s}{digits(3)}{s}{digits(2)}{s}{digits(2)}"]),
            "identity": lambda: f"{digits(3)}-{digits(2)}-{digits(4)}",
            "account": account,
            "ipv6": lambda: ":".join(f"{int(x):x}" for x in rng.integers(0, 65536, 8)),
        }[kind]()

    def other(kind: str) -> str:
        year = int(rng.integers(1900, 2099))
        return {
            "masked_email": lambda: f"{word()} {pick(['(at) ', '<at> ', '[at] '])}{word()}{pick(['.', ' (dot) '])}{word()}que",
            "local_phone": lambda: pick([f"{digits(2)}/{digits(3)}/{digits(2)}", f"{digits(3)}.{digits(3)}.{digits(3)}", f"{digits(2)} {digits(3)} {digits(3)}", f"{year} {digits(3)} {digits(3)}", f"{digits(3)}/{digits(3)}/{digits(3)}", f"{digits(2)}-{digits(4)}-{digits(2)}"]),
            "identity": lambda: pick([f"{digits(3)} {digits(2)} {year}", f"{digits(3)} {digits(2)} {digits(4)}"]),
            "account": lambda: f"{pick(['AB', 'XK', 'ER', 'TH'])}{digits(2)}" + "".join(pick("0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ") for _ in range(4 * int(rng.integers(2, 7)))),
            "ipv6": lambda: ":".join(digits(2) for _ in range(8)),
        }[kind]()

    out = []
    while len(out) < count:
        kind, label = pick(MORE_KINDS), int(rng.random() < 0.5)
        lead = f"{word()} {word()} "
        if label:
            lead += pick(hint[kind]) if rng.random() < (0.95 if kind == "identity" else 0.6) else pick(against) if rng.random() < 0.05 else ""
            span = person(kind)
            stray = kind in SHORTER and rng.random() < 0.15
        else:
            stray = False
            alike = kind in ("local_phone", "identity", "account") and rng.random() < 0.2  # a code of the same format
            lead += pick(against) if alike or rng.random() < 0.5 else pick(["", "", "$", "#", "x="])
            span = person(kind) if alike else other(kind)
        text = f"{lead}{span}{' ' + digits(2) + ' ' if stray else pick(['', ' ', '. ', ', ', '%' if not label else ' '])}{word()} {word()}"
        got = [(k, a, b) for k, a, b in proposals(text) if k == kind and a < len(lead) + len(span) and b > len(lead)]
        out += [(text, k, a, b, int(label and (a, b) == (len(lead), len(lead) + len(span)))) for k, a, b in got]
    return out[:count]


@cache
def model(trained: int = 4000, scaled: int = 1500, held: int = 2500, precision: float = 0.99) -> tuple[Boosting, dict[str, float]]:
    """The trees, fitted, scaled to probabilities and given each kind's least threshold (FLOOR at least) at which
    precision holds, on three separate sets of rows."""
    rows = samples(trained + scaled + held)
    x = np.array([features(t, k, a, b) for t, k, a, b, _ in rows])
    y = np.array([label for *_, label in rows], float)
    first, second = trained, trained + scaled
    trees = Boosting().fit(x[:first], y[:first]).calibrate(x[first:second], y[first:second])
    p, y, limits = trees.probability(x[second:]), y[second:], {}
    for kind in MORE_KINDS:
        own = np.array([r[1] == kind for r in rows[second:]])
        limits[kind] = next((float(c) for c in np.arange(FLOOR, 0.99, 0.01) if not (own & (p >= c)).any() or y[own & (p >= c)].mean() >= precision), 0.99)
    return trees, limits


def all_spans(text: str, trees: Boosting, limits: dict[str, float]) -> list[dict]:
    """Base spans and the chosen candidates, by start and kind."""
    base = base_spans(text)
    out = [{"kind": k, "start": a, "end": b, "base": True, "score": 1.0} for k, a, b in base]
    offered = list(proposals(text))
    if offered:
        taken = _united([(a, b) for _, a, b in base])
        score = trees.probability(np.array([features(text, *c) for c in offered]))
        for (kind, a, b), s in sorted(zip(offered, score), key=lambda x: (-x[1], x[0][1], ORDER[x[0][0]])):
            if s >= limits[kind] and _free(taken, a, b):
                out.append({"kind": kind, "start": a, "end": b, "base": False, "score": float(s)})
    return sorted(out, key=lambda s: (s["start"], ORDER[s["kind"]]))


def _united(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Sorted intervals without overlap that cover the same places (base spans of several kinds may overlap)."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a < out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _free(taken: list[tuple[int, int]], a: int, b: int) -> bool:
    """Whether [a, b) overlaps none of the intervals taken, which are sorted and apart; if so it is taken now."""
    at = bisect.bisect_left(taken, (b, 0))
    if at and taken[at - 1][1] > a:
        return False
    taken.insert(at, (a, b))
    return True


SPAN = "array<struct<kind:string,start:int,end:int,base:boolean,score:double>>"
SPAN_TYPE = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("base", pa.bool_()), ("score", pa.float64())]))


def find_spans(rows: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Columns: the id, and spans (kind, start, end, base, score)."""
    trees, limits = model()

    def make():
        return lambda _, texts: [pa.array([all_spans(t, trees, limits) for t in texts], SPAN_TYPE)]

    return map_texts(rows, id_col, text_col, make, f"spans {SPAN}")


def redact(rows: DataFrame, text_col: str = "text") -> DataFrame:
    """The same rows and columns, every span of a text replaced by its kind in brackets; spans that overlap leave their
    kinds one after the other, by start and kind. Null stays null."""
    trees, limits = model()
    at = rows.columns.index(text_col)

    def clean(text: str | None) -> str | None:
        if not text:
            return text
        out, done = [], 0
        for s in all_spans(text, trees, limits):
            if s["end"] > done or s["start"] >= done:
                out.append(text[done : s["start"]])
                done = s["end"]
            out.append(f"[{s['kind'].upper()}]")
        return "".join([*out, text[done:]]) if out else text

    def run(batches):
        for batch in batches:
            for part in pieces(batch, at):
                columns = part.columns
                columns[at] = pa.array(map(clean, columns[at].to_pylist()), columns[at].type)
                yield pa.RecordBatch.from_arrays(columns, schema=part.schema)

    return rows.mapInArrow(run, rows.schema)


def written(spans, keep=None):
    """kind:start:end of the spans, comma-joined."""
    chosen = F.filter(spans, keep) if keep else spans
    return F.array_join(F.transform(chosen, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
