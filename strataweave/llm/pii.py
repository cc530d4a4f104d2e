"""Surrogates for personal data.

Detected entities get keyed replacements of their own type and format: digits
for digits, letters for letters, the same separators, letter case and length;
cards keep whether their check digit holds, addresses of private networks stay
private, names keep script and gender.  The replacement depends only on the key
and the canonical entity (case and separators aside), so the same entity gets
the same surrogate in every document and in every spelling, and parts of a name
are mapped one by one, so a family name alone still refers to the same person.

People are found behind titles and behind words that introduce a name; the
words of a name found so are then found in the rest of the document too.  The
gender of a given name is what its titles over the whole corpus agree on, and
neither if they don't, so it has one surrogate whatever stands before it.
Initials are replaced by initials.

Distinctness is checked over the whole corpus: two entities of a kind never
share a surrogate, and no surrogate is an entity that occurs.  Of those that
clash the smallest keeps it, the others draw again, until none clashes.  After
every ``WIDEN`` draws the format gives way, as it may be full: private addresses
move to the 10 network, then out of it, the others get longer.  What differs
from a document's own first draw reaches it by a join on the id, which Spark
broadcasts only if it is small enough.

Defined cases: null texts stay null with no entity; empty and clean texts stay
as they are; repeated rows get the same text; null ids are joined as equal;
overlapping finds: the leftmost counts, of those the kind listed first; an
empty table gives no row; other columns pass through whatever their names are
(working columns start with ``__pii_``).
"""

from __future__ import annotations

import bisect
import hashlib
import hmac
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strataweave.llm import words
from strataweave.session import written

ROUNDS = 200
#: Draws after which a format is widened.
WIDEN = 8

# Titles with the gender they tell (m, f, or n for neither).
TITLES = {
    "Mr": "m", "Mister": "m", "Herr": "m", "Monsieur": "m", "Señor": "m", "Signor": "m", "Господин": "m", "Κύριος": "m",
    "Mrs": "f", "Ms": "f", "Miss": "f", "Frau": "f", "Madame": "f", "Mme": "f", "Señora": "f", "Señorita": "f", "Signora": "f", "Госпожа": "f", "Κυρία": "f",
    "Dr": "n", "Prof": "n", "Professor": "n",
}
# Syllables of generated names by script, and endings of given names by gender.
SYLLABLES = {
    "latin": "ba be bo da de do fa fe ga go ha he ka ke ko la le lo ma me mo na ne no pa pe ra re ro sa se so ta te to va ve wa we za".split(),
    "cyrillic": "ба бе бо ва ве во га го да де до жа за зо ка ке ко ла ле ло ма ме мо на не но па пе по ра ре ро са се со та те то".split(),
    "greek": "βα βε βο γα γε δα δε δο ζα θα θε κα κε κο λα λε λο μα με μο να νε νο πα πε πο ρα ρε ρο σα σε σο τα τε το φα φε".split(),
}
ENDINGS = {
    "latin": {"m": "n", "f": "lia", "n": "s", "family": "rd"},
    "cyrillic": {"m": "н", "f": "лия", "n": "к", "family": "ров"},
    "greek": {"m": "ς", "f": "λια", "n": "ν", "family": "δης"},
}
_NAME = r"[^\W\d_a-zа-яα-ω]\w*(?:['’-]\w+)*"
_TITLE = "|".join(sorted(TITLES, key=len, reverse=True))
_INITIAL = r"[^\W\d_a-zа-яα-ω]\.[  ]?"
# What introduces a name without a title.
CUES = ("My name is ", "my name is ", "Name: ", "name: ", "I am called ")
_CUE = "(?:" + "|".join(CUES) + rf")(?!(?:{_TITLE})\b)"
_MORE = rf"(?:[  ](?:{_INITIAL})*(?!(?:{_TITLE})\.?[  ][^\W\d_a-zа-яα-ω]|[A-Z]{{2}}\d{{2}}){_NAME}){{0,2}}"
# What a further group of a phone must not start: an IPv4 address or a whole card.
_NEXT = r"(?!(?:\d{1,3}\.){3}\d|\d{4}[ -]\d{4}[ -]\d{4}[ -]\d{1,7}(?![ -]?\d)|\d{13}|3[47]\d{2}(?: \d{6} |-\d{6}-)\d{5}|1[ .-]\d{3}[ .-]\d{3}[ .-]\d{4})"
_CODE = r"(?<![\w+])\+\d{1,3}[ .-]?(?:\(\d{1,4}\)|\d{1,4})"
#: Plans of fixed length first, then a form that ends where no number goes on, then any; then forms without a country.
_PHONE = "|".join((
    r"(?<![\w+])\+1[ .-]?(?:\(\d{3}\)|\d{3})[ .-]?\d{3}[ .-]?\d{4}(?!\d)",
    r"(?<![\w+])\+7[ .-]?(?:\(\d{3}\)|\d{3})[ .-]?\d{3}[ .-]?\d{2}[ .-]?\d{2}(?!\d)",
    _CODE + rf"(?:[ .-]?\d{{2,4}}){{2}}(?:(?:[ -]{_NEXT}|\.?)\d{{2,4}}){{0,2}}(?![.-]?\d|[0-9A-Fa-f]{{0,2}}:[0-9A-Fa-f])",
    _CODE + r"(?:[ .-]?\d{2,4}){2,4}(?!\d)",
    r"(?<!\d)\(\d{3}\) ?\d{3}[ .-]\d{4}(?!\d)",
    r"(?<![\w.+-])1[ .-]\d{3}[ .-]\d{3}[ .-]\d{4}(?![\d-])",
    r"(?<![\d.-])\d{3}([.-])\d{3}\1\d{4}(?![\d-])",
))
#: kind and pattern, in the order that decides where two start at one place.
PATTERNS = (
    ("email", r"[A-Za-z0-9][A-Za-z0-9._%+-]*@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}"),
    ("iban", r"\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?\b"),
    ("mac", r"\b(?:[0-9A-Fa-f]{2}[:-]){5}[0-9A-Fa-f]{2}\b"),
    ("ipv6", r"\b(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}\b|(?:\b(?<!:)(?=[A-Fa-f:]*\d)(?:(?:[0-9A-Fa-f]{1,4}:){1,6}(?::[0-9A-Fa-f]{1,4}){1,6}|(?:[0-9A-Fa-f]{1,4}:){2,7}:)|(?<![\w:])::(?=[A-Fa-f:]*\d)(?:[0-9A-Fa-f]{1,4}:){0,6}[0-9A-Fa-f]{1,4})(?![\w:])"),
    ("ipv4", r"(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?!\.?\d)"),
    ("phone", _PHONE),
    ("ssn", r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])"),
    ("card", r"(?<![\w.-])\d{4}([ -])\d{4}\2\d{4}\2\d{1,7}(?![\w-])|(?<![\w.-])\d{13,19}(?![\w-])|(?<![\w.-])3[47]\d{2}(?: \d{6} |-\d{6}-)\d{5}(?![\w-])"),
    ("person", rf"\b(?:(?:{_TITLE})\.?[  ]|{_CUE})(?:{_INITIAL})*{_NAME}{_MORE}"),
)


def _pattern() -> str:
    """One alternation of all kinds: ASCII digits only, and own names for the separators that must repeat."""
    out = []
    for n, (kind, p) in enumerate(PATTERNS):
        p = re.sub(r"\[[^\]]*\]", lambda m: m[0].replace(r"\d", "0-9"), p).replace(r"\d", "[0-9]")
        for ref in ("1", "2"):
            p = p.replace("\\" + ref, f"(?P=s{n})")
        out.append(f"(?P<{kind}>" + p.replace("([.-])", f"(?P<s{n}>[.-])").replace("([ -])", f"(?P<s{n}>[ -])") + ")")
    return "|".join(out)


FIND = re.compile(_pattern())
#: Every text with an entity matches this, cheaply (RE2).
MAY = r"@|\d[\d.() -]{6}|[0-9A-Fa-f][:-][0-9A-Fa-f]|[0-9A-Fa-f]::|::[0-9A-Fa-f]|" + "|".join(CUES) + r"|[A-Z]{2}\d{2}|(?:" + "|".join(TITLES) + r")\.?[ \x{00a0}]"


def _draw(key: bytes, *parts: str) -> Iterator[int]:
    """An endless stream of bytes that the key and the parts fix."""
    seed = hmac.new(key, "\x1f".join(parts).encode(), hashlib.sha256).digest()
    n = 0
    while True:
        yield from hashlib.sha256(seed + n.to_bytes(4, "big")).digest()
        n += 1


def _below(draw: Iterator[int], n: int) -> int:
    return (next(draw) << 24 | next(draw) << 16 | next(draw) << 8 | next(draw)) % n


def _luhn(digits: str) -> int:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10


def _mod97(text: str) -> int:
    return int("".join(str(int(c, 36)) for c in text)) % 97


def script(word: str) -> str:
    return "cyrillic" if re.search("[Ѐ-ӿ]", word) else "greek" if re.search("[Ͱ-Ͽ]", word) else "latin"


#: Words of a name; initials have a dot behind them.
_WORDS = re.compile(rf"(?P<initial>{_INITIAL})|{_NAME}")


def parts(kind: str, value: str) -> list[tuple[int, int, str, str, str]]:
    """(start, end, kind, canonical entity, gender of the title) of what is mapped inside a found value."""
    if kind == "person":
        title = re.match(rf"({_TITLE})\b\.?[  ]", value)
        begin, gender = (title.end(), TITLES[title[1]]) if title else (next(len(c) for c in CUES if value.startswith(c)), "n")
        out, last = [], None
        for m in _WORDS.finditer(value, begin):
            if m["initial"]:
                out.append((m.start(), m.start() + 1, "initial", m[0][0].lower(), ""))
                continue
            end = m.end() - 2 * m[0].endswith(("'s", "’s"))  # of the person, not of the name
            word = value[m.start() : end]
            last = len(out)
            out.append((m.start(), end, f"given-{script(word)}", word.lower(), gender))
        if title or len(out) > 1:
            a, b, k, e, _ = out[last]
            out[last] = (a, b, k.replace("given", "family"), e, "")
        return out
    if kind in ("email", "ipv4", "ipv6", "mac"):
        return [(0, len(value), kind, value.lower(), "")]
    return [(0, len(value), kind, re.sub(r"[^0-9A-Z+]", "", value), "")]


def surrogate(kind: str, entity: str, attempt: int, key: bytes, gender: str = "n") -> str:
    """The canonical replacement of a canonical entity at one draw; as long as the entity but for names and widened formats."""
    draw, wider = _draw(key, kind, entity, str(attempt)), attempt // WIDEN
    digit = lambda: str(_below(draw, 10))
    if kind.startswith(("given", "family")):
        where = kind.rsplit("-", 1)[1]
        end = ENDINGS[where]["family" if kind.startswith("family") else gender]
        return "".join(SYLLABLES[where][_below(draw, len(SYLLABLES[where]))] for _ in range(2 + (attempt > 2) + wider)) + end
    if kind == "initial":
        letters = {"latin": "abcdefghijklmnopqrstuvwxyz", "cyrillic": "абвгдежзиклмнопрстуфхцчшэюя", "greek": "αβγδεζηθικλμνξοπρστυφχψω"}[script(entity)].replace(entity, "")
        return letters[_below(draw, len(letters))]
    if kind == "ipv4":
        a = [int(x) for x in entity.split(".")]
        kept = 1 if a[0] in (10, 127) else 2 if (a[0], a[1]) == (192, 168) or (a[0] == 172 and 16 <= a[1] < 32) else 0
        if kept and wider:  # its network may be full
            kept, a = (1, [10]) if wider < 8 and a[0] != 10 else (0, [])
        first = [x for x in range(1, 224) if x not in (10, 127, 172, 192)]
        new = [first[_below(draw, len(first))], *(_below(draw, 256) for _ in range(3))]
        return ".".join(map(str, a[:kept] + new[kept:]))
    if kind in ("ipv6", "mac"):
        hexes = lambda x: "".join("0123456789abcdef"[_below(draw, 16)] if c not in ":-" else c for c in x)
        return hexes(entity + ":0000" * min(wider, 7 - entity.count(":")) if "::" in entity and not entity.endswith("::") else entity)
    if kind == "email":
        local, host = entity.split("@")
        kept = ".example.com" if host.endswith(".example.com") else "." + host.rsplit(".", 1)[1]
        kept = "example.com" if host == "example.com" else kept
        swap = lambda s: "".join("abcdefghijklmnopqrstuvwxyz"[_below(draw, 26)] if c.isalpha() else digit() if c.isdigit() else c for c in s)
        more = swap("a" * wider)
        return swap(local) + more + "@" + swap(host[: len(host) - len(kept)]) + kept
    if kind == "iban":
        body = "".join(digit() for _ in range(wider)) + "".join(digit() if c.isdigit() else "ABCDEFGHIJKLMNOPQRSTUVWXYZ"[_below(draw, 26)] for c in entity[4:])
        return entity[:2] + f"{98 - _mod97(body + entity[:2] + '00'):02d}" + body
    if kind == "card":
        new = entity[0] + "".join(digit() for _ in entity[1:-1] + "0" * wider)
        check = next(d for d in "0123456789" if _luhn(new + d) == 0)
        return new + (check if _luhn(entity) == 0 else str((int(check) + 1 + _below(draw, 9)) % 10))
    if kind == "phone" and entity[0] == "+":
        code = 2 if entity[1] in "17" else 3
        return entity[:code] + str(2 + _below(draw, 8)) + "".join(digit() for _ in entity[code + 1 :] + "0" * wider)
    return str(2 + _below(draw, 7)) + "".join(digit() for _ in entity[1:] + "0" * wider)


def formatted(kind: str, value: str, new: str) -> str:
    """The canonical replacement in the spelling of ``value``."""
    if kind.startswith(("given", "family", "initial")):
        return new.upper() if kind == "initial" or value.isupper() and len(value) > 1 else new.capitalize()
    if kind in ("email", "mac", "ipv6"):
        return "".join(n.upper() if i < len(value) and value[i].isupper() else n for i, n in enumerate(new))
    if kind == "ipv4":
        return new
    left = iter(new)
    return "".join(next(left) if re.match("[0-9A-Z+]", c) else c for c in value) + "".join(left)


def found_in(text: str) -> list[tuple[int, int, str, str, str, str]]:
    """(start, end, kind, canonical entity, spelling, gender of its title) of all that is mapped in a text, in order."""
    out, names, taken = [], {}, []
    for m in FIND.finditer(text):
        kind = next(k for k, _ in PATTERNS if m[k] is not None)
        taken.append((m.start(), m.end()))
        for a, b, k, e, g in parts(kind, m[0]):
            out.append((m.start() + a, m.start() + b, k, e, m[0][a:b], g))
            if kind == "person" and k != "initial" and b - a > 1:
                for spelled in {m[0][a:b], m[0][a:b].upper(), m[0][a:b].capitalize()}:
                    if k.startswith("family") or spelled not in names:
                        names[spelled] = (k, e)
    if names:  # the same people further on, or before
        again = re.compile(r"(?<!\w)(?:" + "|".join(map(re.escape, sorted(names, key=len, reverse=True))) + r")(?!\w)")
        starts = [a for a, _ in taken]
        for m in again.finditer(text):
            i = bisect.bisect_right(starts, m.start()) - 1
            if (i < 0 or taken[i][1] <= m.start()) and (i + 1 == len(taken) or m.end() <= taken[i + 1][0]):
                k, e = names[m[0]]
                out.append((m.start(), m.end(), k, e, m[0], "n" if k.startswith("given") else ""))
        out.sort()
    return out


def entities(text: str) -> list[tuple[int, int, str, str, str]]:
    """(start, end, kind, canonical entity, spelling) of all that is mapped in a text, in order."""
    return [x[:5] for x in found_in(text)]


def genders(found: list[tuple]) -> dict[tuple[str, str], str]:
    """The gender that the titles of one document give each entity: m, f, or n where they tell none or both; empty for what has none."""
    out: dict[tuple[str, str], str] = {}
    for _, _, k, e, _, g in found:
        had = out.get((k, e))
        out[k, e] = g if had in (None, "n") else had if g in (had, "n") else "b"
    return {x: "n" if g == "b" else g for x, g in out.items()}


def replaced(text: str, told: dict[tuple[str, str], tuple[int, str]], key: bytes) -> tuple[str, int, str]:
    """The new text, how many entities, and their spans ``kind:start:end`` in the old text; ``told``: draws and genders other than the document's own."""
    found = found_in(text)
    own = genders(found)
    out, done = [], 0
    for a, b, kind, entity, value, _ in found:
        attempt, gender = told.get((kind, entity), (0, own[kind, entity]))
        out += [text[done:a], formatted(kind, value, surrogate(kind, entity, attempt, key, gender))]
        done = b
    return "".join([*out, text[done:]]), len(found), ",".join(f"{k}:{a}:{b}" for a, b, k, *_ in found)


def _may(texts: pa.Array) -> list[bool]:
    return pc.fill_null(pc.match_substring_regex(texts, MAY), False).to_pylist()


def occurring(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """The written table of (id, kind, entity, gender), each entity once per document."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for ident, raw, may in zip(batch.column(0), batch.column(1), _may(batch.column(1))):
                if may:
                    rows += [(ident.as_py(), k, e, g) for (k, e), g in sorted(genders(found_in(raw.as_py())).items()) if k != "initial"]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (batch.schema.field(0).type, pa.string(), pa.string(), pa.string()))], ["id", "kind", "entity", "gender"])
        words.trim()

    kind = docs.schema[key].dataType.simpleString()
    return written(docs.select(key, text).mapInArrow(find, f"id {kind}, kind string, entity string, gender string"), "pii-found")


def _drawn(secret: bytes, attempt: int):
    def draw(kinds: pa.Array, found: pa.Array, sexes: pa.Array) -> pa.Array:
        return pa.array([surrogate(k, e, attempt, secret, g) for k, e, g in zip(kinds.to_pylist(), found.to_pylist(), sexes.to_pylist())], pa.string())

    return F.arrow_udf(draw, T.StringType())("kind", "entity", "gender")


def settled(found: DataFrame, secret: bytes) -> DataFrame:
    """(kind, entity, gender, attempt, new) of all entities: distinct within a kind, and none that occurs.

    A round draws for those that have none yet; a draw that occurs or is held
    already is lost, and of equal ones the smallest entity's stays.
    """
    said = lambda g: F.max(F.col("gender") == g)
    gender = F.when(F.max("gender") == "", "").when(said("m") & ~said("f"), "m").when(said("f") & ~said("m"), "f").otherwise("n")
    real = written(found.groupBy("kind", "entity").agg(gender.alias("gender")), "pii-entities")
    occurs = real.select("kind", F.col("entity").alias("new"))
    waiting, done = real, None
    for attempt in range(ROUNDS):
        drawn = written(waiting.select("kind", "entity", "gender", F.lit(attempt).alias("attempt"), _drawn(secret, attempt).alias("new")), "pii-draws")
        free = drawn.join(occurs, ["kind", "new"], "left_anti")
        if done is not None:
            free = free.join(done.select("kind", "new"), ["kind", "new"], "left_anti")
        won = free.groupBy("kind", "new").agg(F.min_by(F.struct("entity", "gender", "attempt"), "entity").alias("x"))
        won = written(won.select("kind", "x.*", "new"), "pii-settled")
        done = won if done is None else done.unionByName(won)
        waiting = written(drawn.join(won, ["kind", "entity"], "left_anti").select("kind", "entity", "gender"), "pii-waiting")
        if waiting.isEmpty():
            return done.select("kind", "entity", "gender", "attempt", "new")
    raise ValueError(f"after {ROUNDS} draws two entities still share a surrogate")


SWAPPED = T.StructType([T.StructField("text", T.StringType()), T.StructField("n", T.LongType()), T.StructField("spans", T.StringType())])


def _swapper(secret: bytes):
    def swap(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        """Only texts that may hold something become Python's; the others stay in the batch they came in."""
        for texts, more in batches:
            may = np.array(_may(texts), bool)
            n, spans, new = np.zeros(len(texts), np.int64), [""] * len(texts), []
            for i in np.flatnonzero(may).tolist():
                told = {(d["kind"], d["entity"]): (d["attempt"], d["is"]) for d in more[i].as_py() or ()}
                value, n[i], spans[i] = replaced(texts[i].as_py(), told, secret)
                new.append(value)
            out = pc.replace_with_mask(texts, pa.array(may), pa.array(new, texts.type))
            yield pa.StructArray.from_arrays([out, pa.array(n), pa.array(spans, pa.string())], ["text", "n", "spans"])
        words.trim()

    return swap


def with_surrogates(docs: DataFrame, secret: bytes, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``docs`` with the text replaced under the key ``secret``, and __pii_n and __pii_spans."""
    found = occurring(docs, text, key)
    told = settled(found, secret).select("kind", "entity", "attempt", F.col("gender").alias("is"))
    redrawn = found.join(told, ["kind", "entity"]).filter((F.col("attempt") > 0) | (F.col("gender") != F.col("is")))
    redrawn = redrawn.groupBy(F.col("id").alias("__pii_id")).agg(F.collect_set(F.struct("kind", "entity", "attempt", "is")).alias("__pii_redrawn"))
    redrawn = written(redrawn, "pii-redrawn")

    rows = docs.join(redrawn, F.col(key).eqNullSafe(F.col("__pii_id")), "left")
    rows = rows.withColumn("__pii", F.arrow_udf(_swapper(secret), SWAPPED)(F.col(text), F.col("__pii_redrawn")))
    rows = rows.withColumns({text: F.col("__pii.text"), "__pii_n": F.col("__pii.n"), "__pii_spans": F.col("__pii.spans")})
    return rows.drop("__pii", "__pii_id", "__pii_redrawn")
