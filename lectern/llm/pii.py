"""Personal data: exact patterns plus a character-level BiLSTM-CRF for spellings and kinds that the patterns miss.

The base patterns are matched over whole texts, leftmost and non-overlapping for each kind; a match that fails its check
is dropped. The tagger decodes overlapping windows over every stretch of a text in which one of its kinds can stand, with
MARGIN characters on both sides: cards, phones and ips have digits, and runs with digits are read whole; addresses have an
`@` or an "at", around which all that can be a local part and a domain is read; secrets follow an equals sign or a colon,
stand in quotes, or are a long run of hexadecimal digits, and of these every run of VALUE characters or more is read whole. A tagged span takes in the rest of its word, an address the rest of its local part and domain. It is added where the
mean of the CRF's marginals is at least CONFIDENCE, where it has what its kind must have (`sound`: four bytes,
a card's check digit, a phone's length, an at and a dot), and where it touches no base span and no earlier added one. `secret` (tokens,
keys, passwords) is a kind of the tagger alone.

Scoring is narrow: one pass, no shuffle. Defined results: null and empty texts have no spans; repeated rows give
repeated results; other columns are ignored; texts of any length are read whole, with window batches of fixed size.
"""

from __future__ import annotations

import functools
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import bound_batches, lean, slices
from lectern.llm.tagger import KINDS, WINDOW, Tagger, encode, tag_codes

SLICE = 1 << 20
MARGIN = 24
#: Least mean marginal probability of an added span.
CONFIDENCE = 0.75
#: The shortest secret.
VALUE = 8
#: Kinds of the base patterns.
BASE = KINDS[:4]
SPAN = "array<struct<kind:string,start:bigint,end:bigint>>"

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# a run of digits that fails from its start fails from inside, so the look-behind only saves time
_IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_TRIGGER = re.compile(r"[0-9@=]|[\[({<]\s*[aA][tT]\s*[\])}>]")


#: What may be a secret: the run after an equals sign or a colon, a run in quotes, and a long run of hexadecimal digits.
_VALUES = re.compile(rf"""[=:]\s*["']?(?=\S{{{VALUE}}})\S+|["'](?=[^\s"']{{{VALUE}}})[^\s"']+["']|\b[0-9A-Fa-f]{{24,}}""")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def _small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) <= 3 and int(part or "0") <= 255


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Spans of the four patterns, by kind as listed in KINDS, then by start."""
    out: list[tuple[str, int, int]] = []
    floor, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > floor and text[start - 1] in _LOCAL:
            start -= 1
        match = _DOMAIN.match(text, at + 1) if start < at else None
        floor = match.end() if match else at + 1
        if match:
            out.append(("email", start, match.end()))
        at = text.find("@", floor)
    out += [("ip", m.start(), m.end()) for m in _IP.finditer(text) if all(map(_small, m.group().split(".")))]
    for m in _CARD.finditer(text):
        digits = _digits(m.group())
        if 13 <= len(digits) <= 19 and luhn(digits):
            out.append(("card", m.start(), m.end()))
    out += [("phone", m.start(), m.end()) for m in _PHONE.finditer(text) if 9 <= len(_digits(m.group())) <= 15]
    return out


_AT = re.compile(r"(?i)@|[\[({<]\s*at\s*[\])}>]|\bat\b")
_TAIL = re.compile(r"(?i)\s*[a-z0-9-]+(?:\s*(?:\.|[\[({<]\s*dot\s*[\])}>]|\bdot\b)\s*[a-z0-9-]+)+")
_LABEL = re.compile(r"[A-Za-z0-9-]*")
_NUMBERS = re.compile(r"[0-9 ()./_-]+")
_PARTS = re.compile(r"[0-9]+(?:\s*(?:[\[(]\s*)?(?:\.|dot)\s*(?:[\])]\s*)?[0-9]+)+")
_SIGN = re.compile(r"(?i)@|[\[({<]\s*at\s*[\])}>]|\bat\b")
#: An at and, after it, a dot between two labels; words and signs are not mixed with a full stop before a space.
_TWO_LABELS = re.compile(r"(?i)(?:@|[\[({<]\s*at\s*[\])}>]).*?(?:[a-z0-9-]\s*\.\s*|\bdot\b.*)[a-z0-9-]|\bat\b.*?(?:[a-z0-9-]\.|\sdot\s+)[a-z0-9-]")
#: What belongs to the domain of a tagged address, whatever part of it was tagged.
_DOMAIN_SPELT = re.compile(r"(?i)\s*[a-z0-9-]+(?:\.[a-z0-9-]+|\s*[\[({<]\s*dot\s*[\])}>]\s*[a-z0-9-]+|\s+dot\s+[a-z0-9-]+)*")


def sound(kind: str, span: str) -> bool:
    """What an added span must have: the digits of its kind, or an at and a dot between labels, however spelt."""
    digits = _digits(span)
    if kind == "ip":
        parts = re.findall(r"[0-9]+", span)
        return len(parts) == 4 and all(map(_small, parts))
    if kind == "card":
        return 13 <= len(digits) <= 19 and luhn(digits)
    if kind == "phone":
        return 9 <= len(digits) <= 15
    if kind == "email":
        return bool(_TWO_LABELS.search(span))
    return len(span) >= VALUE


def labelled_examples(n: int = 3600, seed: int = 23) -> list[tuple[str, list[tuple[str, int, int]]]]:
    """Texts with labelled spans for training: spans in many spellings among invented words and look-alikes."""
    rng = np.random.default_rng(seed)
    pick = lambda *x: x[int(rng.integers(len(x)))]
    letters = "abcdefghijklmnopqrstuvwxyz" * 4 + "éäñüßç"
    word = lambda most=9: "".join(letters[c] for c in rng.integers(0, len(letters), int(rng.integers(2, most))))
    plain = lambda most=9: "".join(chr(97 + c) for c in rng.integers(0, 26, int(rng.integers(2, most))))
    num = lambda k: "".join(map(str, rng.integers(0, 10, k)))
    byte = lambda: str(int(rng.integers(0, 256)))
    chars = lambda k, of: "".join(of[c] for c in rng.integers(0, len(of), k))
    lower, digits = "abcdefghijklmnopqrstuvwxyz", "0123456789"
    mixed = lower + lower.upper() + digits

    def prose(most: int) -> str:
        small = ("at", "the", "of", "dot", "in", "und", "de", "la", "to", "a")
        out = [pick(*small) if rng.random() < 0.3 else word() for _ in range(int(rng.integers(0, most)))]
        for k in range(len(out)):
            if rng.random() < 0.12 and k + 1 < len(out):
                out[k], out[k + 1] = out[k] + ".", out[k + 1].capitalize()
            elif rng.random() < 0.1:
                out[k] += pick(",", ",", "!", ";")
        return " ".join(out)

    def email() -> str:
        at, dot = pick(("@", "."), (" [at] ", " [dot] "), ("[at]", "[dot]"), (" (at) ", "."), ("(at)", "(dot)"), (" (at) ", " (dot) "), (" @ ", " . "), (" at ", " dot "), (" at ", " dot "), (" AT ", " DOT "), ("{at}", "{dot}"))
        inner = dot if dot == " dot " and rng.random() < 0.5 else "."
        local = pick(plain(), plain() + inner + plain(11), plain() + num(2), plain() + "." + plain() + "." + plain(), "." + num(2))
        return local + at + pick(plain(), plain(16), plain() + num(1)) + dot + pick("com", "org", "net", "edu", "de", "example" + dot + "com")

    def card() -> str:
        body = pick("4", "5", "3", "6") + num(14)
        d = next(body + str(c) for c in range(10) if luhn(body + str(c)))
        s = pick("", " ", "-", ".", "_", "/", " - ", "  ")
        return s.join((d[:4], d[4:8], d[8:12], d[12:]))

    def phone() -> str:
        a, b, c = num(3), num(3), num(4)
        return pick(f"+1 ({a}) {b}-{c}", f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"+{num(2)} {num(3)} {num(4)} {num(2)}", f"00{num(2)} {num(2)} {num(7)}", f"0{num(3)}/{num(6)}")

    def ip() -> str:
        s = pick(".", ".", "[.]", " . ", "(.)", "[dot]", " dot ")
        return s.join((byte(), byte(), byte(), byte()))

    def secret() -> tuple[str, str, str]:
        """What stands before a secret, the secret, and what stands after it."""
        quote = pick('"', '"', "'", "")
        name = pick("token", "api_key", "apikey", "secret", "password", "access_key", "auth", "TOKEN", "key") + pick(" = ", "=", ": ", " = ") + quote
        value = pick(chars(40, digits + "abcdef"), chars(40, digits + "ABCDEF"), chars(int(rng.integers(24, 65)), digits + "abcdef"), chars(int(rng.integers(16, 45)), mixed), pick("sk_live_", "ghp_", "AKIA") + chars(24, mixed), "-".join(chars(k, digits + "abcdef") for k in (8, 4, 4, 4, 12)), chars(int(rng.integers(9, 15)), mixed + "!$#"))
        long_hex = len(value) >= 32 and not set(value.lower()) - set("0123456789abcdef")
        return ("", value, "") if long_hex and rng.random() < 0.3 else (name, value, quote)

    makers = {"email": email, "card": card, "phone": phone, "ip": ip}
    other = (
        lambda: f"version {num(1)}.{num(1)}", lambda: f"20{num(2)}-0{pick('1', '5')}-1{num(1)}", lambda: f"{num(2)}:{num(2)}", lambda: f"${num(3)}.{num(2)}", lambda: num(int(rng.integers(1, 13))), lambda: f"@{plain()}",
        lambda: f"{num(4)}/{num(2)}/{num(2)}", lambda: f"no. {num(5)}", lambda: f"meet at {num(1)} dot", lambda: f"{num(1)}.{num(1)}.{num(2)}", lambda: f'{plain()} = "{plain()}"', lambda: f"{plain()}={num(2)}", lambda: f"CC BY {num(1)}.{num(1)}",
        lambda: f"{word()} at {word()}. {word()}", lambda: f"{word()} at {word()} {word()}. {word()}", lambda: f"the dot {word()}", lambda: f"{chars(7, digits + 'abcdef')}", lambda: f"at {word()}.", lambda: f"{word()}{num(1)} {word()}{num(2)}", lambda: f"key = {plain()}", lambda: f"{num(1)}.{num(2)}.",
    )
    out = []
    for i in range(n):
        # every fifth text is prose around an "at", of which none is an address
        text, spans = prose(6) if i % 5 else f"{prose(14)} {word()} {pick('at', 'at', 'At')} {prose(14)}", []
        for _ in range(int(rng.integers(1, 3)) if i % 5 else 0):
            text += pick(" ", " ", ": ", ", ", "\n", " (", " | ") if text else ""
            if rng.random() < 0.6:
                kind = KINDS[int(rng.integers(len(KINDS)))]
                before, span, after = secret() if kind == "secret" else ("", makers[kind](), "")
                text += before
                spans.append((kind, len(text), len(text) + len(span)))
                text += span + after
            else:
                text += pick(*other)()
            text += pick(" ", ". ", ", ", ") ", "### ", "!! ", " | ") + prose(6)
        if rng.random() < 0.1:
            text = text.upper() if len(text.upper()) == len(text) else text
        out.append((text, spans))
    return out


@functools.lru_cache(maxsize=4)
def trained(n: int = 3600, seed: int = 23, epochs: int = 5) -> Tagger:
    """A tagger trained on labelled_examples(n, seed); kept for this process."""
    codes, tags = [], []
    for text, spans in labelled_examples(n, seed):
        code, tag = encode(text), tag_codes(len(text), spans)
        for at in range(0, max(1, len(code) - WINDOW // 2), WINDOW // 2):
            row, mark = np.ones(WINDOW, np.int8), np.zeros(WINDOW, np.int64)
            own = code[at : at + WINDOW]
            row[: len(own)], mark[: len(own)] = own, tag[at : at + WINDOW]
            codes.append(row)
            tags.append(mark)
    return Tagger().fit(np.stack(codes), np.stack(tags), epochs=epochs)


def _addresses(text: str) -> list[tuple[int, int]]:
    """Around each "at": all that can be its local part, to the end of all that can be its domain."""
    out: list[tuple[int, int]] = []
    floor, first, done = 0, 0, 0
    for m in _AT.finditer(text):
        start = m.start()
        while start > floor and text[start - 1].isspace():
            start -= 1
        while start > floor and text[start - 1] in _LOCAL:
            start -= 1
        # what touches the "at" before may belong to its local part
        start = first if start == floor else start
        floor, first = m.end(), start
        # an "at" inside a label has the same tail as the one before
        tail = None if m.end() < done else _TAIL.match(text, m.end())
        done = max(done, _LABEL.match(text, m.end()).end()) if m.end() >= done else done
        if tail or m.group() not in ("at", "At", "aT", "AT"):
            out.append((start, tail.end() if tail else m.end()))
    return out


def regions(text: str, number: int) -> list[tuple[int, int, int]]:
    """Stretches that could hold a span, with MARGIN characters around, in which every window is read."""
    cores = [m.span() for m in _TRIGGER.finditer(text)]
    if cores:
        cores += [m.span() for m in _NUMBERS.finditer(text) if any("0" <= c <= "9" for c in m.group())]
        cores += [m.span() for m in _PARTS.finditer(text)]
    cores += [m.span() for m in _VALUES.finditer(text)]
    cores += _addresses(text)
    out: list[tuple[int, int, int]] = []
    for start, end in sorted(cores):
        lo, hi = max(0, start - MARGIN), min(len(text), end + MARGIN)
        if out and lo <= out[-1][2]:
            out[-1] = (number, out[-1][1], max(hi, out[-1][2]))
        else:
            out.append((number, lo, hi))
    return out


def find(texts: list[str], tagger: Tagger) -> tuple[list[list[tuple[str, int, int]]], list[list[tuple[str, int, int]]]]:
    """Base and added spans of each text."""
    base, places, codes = [], [], {}
    for i, text in enumerate(texts):
        hot = regions(text, i)
        base.append(base_spans(text) if hot else [])
        if hot:
            codes[i] = encode(text)
            places += hot
    added: list[list[tuple[str, int, int]]] = [[] for _ in texts]
    if places:
        for i, k, start, end, sure in tagger.tag(codes, places):
            if sure < CONFIDENCE:
                continue
            text = texts[i]
            while start < end and text[start].isspace():
                start += 1
            while end > start and text[end - 1].isspace():
                end -= 1
            # a span holds whole words
            while start < end and start and text[start].isalnum() and text[start - 1].isalnum():
                start -= 1
            while start < end < len(text) and text[end - 1].isalnum() and text[end].isalnum():
                end += 1
            if KINDS[k] == "email":
                while start and text[start - 1] in _LOCAL:
                    start -= 1
                sign = _SIGN.search(text, start, end)
                domain = _DOMAIN_SPELT.match(text, sign.end()) if sign else None
                end = max(end, domain.end()) if domain else end
                while start < end and text[start] not in _LOCAL:
                    start += 1
                while end > start and not text[end - 1].isalnum():
                    end -= 1
            if any(start < z and a < end for _, a, z in (*base[i], *added[i])) or not sound(KINDS[k], text[start:end]):
                continue
            added[i].append((KINDS[k], start, end))
    return base, added


def detect(docs: DataFrame, n: int = 3600, seed: int = 23, epochs: int = 5, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, text, base and added spans for each row (and the columns named in keep)."""
    bound_batches(docs.sparkSession)
    tagger = trained(n, seed, epochs)
    kept = [F.col(c).alias(f"kept_{c}") for c in keep]
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *kept)
    names = ["doc_id", "text", *(f"kept_{c}" for c in keep)]
    struct = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text", SLICE):
                base, added = find([t or "" for t in part.column("text").to_pylist()], tagger)
                as_rows = lambda found: pa.array([[{"kind": k, "start": a, "end": z} for k, a, z in x] for x in found], struct)
                yield pa.RecordBatch.from_arrays([*(part.column(n) for n in names), as_rows(base), as_rows(added)], names=[*names, "base", "added"])

    types = dict(rows.dtypes)
    schema = ", ".join([*(f"`{n}` {types[n]}" for n in names), f"base {SPAN}", f"added {SPAN}"])
    return rows.mapInArrow(lean(run), schema).select("doc_id", "text", "base", "added", *(F.col(f"kept_{c}").alias(c) for c in keep))


def mask(text, spans):
    """A text column with each span replaced by its kind in brackets; overlapping spans are one, named by the first."""
    ordered = F.array_sort(spans, lambda a, b: F.when(a["start"] != b["start"], F.when(a["start"] < b["start"], -1).otherwise(1)).otherwise(F.when(a["end"] > b["end"], -1).when(a["end"] < b["end"], 1).otherwise(0)))
    start = F.struct(F.lit("").alias("out"), F.lit(0).cast("long").alias("at"))

    def step(acc, s):
        fresh = s["start"] >= acc["at"]
        piece = F.substring(text, (acc["at"] + 1).cast("int"), (s["start"] - acc["at"]).cast("int"))
        return F.struct(F.when(fresh, F.concat(acc["out"], piece, F.lit("["), F.upper(s["kind"]), F.lit("]"))).otherwise(acc["out"]).alias("out"), F.greatest(acc["at"], s["end"]).alias("at"))

    return F.when(text.isNull() | (F.size(spans) == 0), text).otherwise(F.aggregate(ordered, start, step, lambda acc: F.concat(acc["out"], F.substring(text, (acc["at"] + 1).cast("int"), F.length(text)))))
