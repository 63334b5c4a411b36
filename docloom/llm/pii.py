"""Personal data replaced by keyed surrogates.

Detected: e-mail, IPv4 and IPv6 addresses, telephone numbers (international, North American, national with a leading 0),
card, bank account (IBAN, by its check digits) and social security numbers, secrets (``token = "..."`` and long hexadecimal
strings), and names after titles, in Latin or Cyrillic letters, with apostrophes, hyphens, inner capitals, initials or all in
capitals. A surname that has a title somewhere in a text is replaced throughout that text, with a given name of the text before
it. Not detected: names that have no title anywhere in their text, and addresses of streets. A surrogate depends on the key, the kind and the entity only, so
an entity has one surrogate in the whole corpus, whatever its punctuation there:

* characters are permuted within their class (digit, lower, upper, hexadecimal) by a keyed bijection of all strings of
  that shape without fixed points: entities of one shape never share a surrogate, none stays as it is, and a corpus
  that has every string of a shape maps onto itself. Separators, lengths and case stay; a phone's country code or leading 0, an IP's
  kind (private or not) or first group, a card's Luhn validity, an account's country and validity, and a mail's top-level domain stay too;
* names are built word by word from syllables of their script (Latin or Cyrillic), given names with an ending of
  their title's gender (by their own ending after titles of none), in the case of the original: ``Mr. John Smith`` and ``Mr. Smith`` keep a common surname. Endings
  differ by kind, so kinds never meet.

Collisions are looked for over the distinct entities of the corpus, as a table: surrogates that two entities share
(names, mails whose letters outside ASCII had to be spelt, secrets of different shapes), and names that are a name of the
corpus, get the next attempt until none are left. A name is a syllable longer with each attempt, so there is always
room. The entities that needed one are sent to all tasks if they are few; else documents are joined with those of their
own. Usually the text is read twice and never shuffled.

Edge cases: a null text stays null, an empty one empty; other columns are kept as they are, whatever their names;
equal rows are replaced alike; an empty table gives an empty one.
"""

from __future__ import annotations

import hashlib
import hmac
import ipaddress
import re
import warnings
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, table
from .repeats import keyed, text_keys

#: For the registered queries and tests only, where the session doesn't name one: who knows the key can invert surrogates.
EXAMPLE_KEY = b"docloom example key"
#: Entities (and their characters) beyond a first attempt that are sent to all tasks at most.
FEW, FEW_CHARS = 20_000, 2_000_000
#: Texts rewritten at a time.
STEP = 500


def key_of(spark: SparkSession) -> bytes:
    """The session's ``spark.docloom.pii.key``, else, with a warning, the example key."""
    key = spark.conf.get("spark.docloom.pii.key", None)
    if key is None:
        warnings.warn("spark.docloom.pii.key is unset: surrogates under the published example key can be inverted by anyone", stacklevel=2)
    return EXAMPLE_KEY if key is None else key.encode()


_TITLES = {
    "m": ["Mr", "Mister", "Sir", "Herr", "Señor", "Monsieur", "Don", "г-н", "господин"],
    "f": ["Mrs", "Ms", "Miss", "Madam", "Frau", "Señora", "Señorita", "Madame", "Mme", "Mlle", "Doña", "г-жа", "госпожа"],
}
_TITLES["n"] = ["Dr", "Doctor", "Doktor", "Prof", "Professor", "Rev", "Dra", "д-р", "доктор", "профессор"]
_GENDER = {t: g for g, ts in _TITLES.items() for t in ts}
#: Letters of Latin (with its extensions) and Cyrillic, by case.
_LETTERS = [chr(c) for c in (*range(0x41, 0x250), *range(0x400, 0x530), *range(0x1E00, 0x1F00))]
_CAPITAL, _SMALL = "".join(c for c in _LETTERS if c.isupper()), "".join(c for c in _LETTERS if c.islower())
_PATTERNS = [
    ("email", re.compile(r"[\w.+%-]+@[\w-]+(?:\.[\w-]+)*\.[^\W\d_]{2,}")),
    ("secret", re.compile(r"(?i)\b(?:token|secret|password|passwd|api[_ -]?key)\s*[=:]\s*[\"']?([A-Za-z0-9_+/-]{16,})")),
    ("secret", re.compile(r"(?<![0-9A-Za-z])([0-9a-f]{32,64}|[0-9A-F]{32,64})(?![0-9A-Za-z])")),
    ("iban", re.compile(r"(?<!\w)[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?!\w)")),
    ("ip6", re.compile(r"(?<![\w:.])[0-9A-Fa-f]{0,4}(?::[0-9A-Fa-f]{0,4}){2,7}(?![\w:])")),
    ("ip", re.compile(r"(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?![\d]|\.\d)")),
    ("phone", re.compile(r"(?<![\w+])\+\d{1,3}[ .-]?(?:\(\d{1,4}\)|\d{1,4})(?:[ .-]?\d{2,4}){2,4}(?!\d)")),
    ("ssn", re.compile(r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])")),
    ("card", re.compile(r"(?<![\d.])(?:\d{4}[ -]\d{4}[ -]\d{4}[ -]\d{1,7}|\d{4}[ -]\d{6}[ -]\d{5}|\d{13,19})(?!\d)")),
    ("phone", re.compile(r"(?<![\w(])(?:\(\d{3}\) ?|\d{3}[ .-])\d{3}[ .-]\d{4}(?!\d)")),
]
_PATTERNS.append(("phone", re.compile(r"(?<![\w.+/-])0\d{2,4}[ /-]\d{3,4}[ -]?\d{2,5}(?![\w/]|[.-]\d)")))
#: A capital, then letters of either case; an apostrophe only before a capital that goes on, so that a genitive stays outside.
_WORD = rf"[{_CAPITAL}](?:[{_CAPITAL}{_SMALL}]|['’](?=[{_CAPITAL}]\w))+"
_TITLE = rf"(?:(?:{'|'.join(_GENDER)})\.?|(?:{'|'.join(t.upper() for t in _GENDER)})\.) "
_NAME = re.compile(rf"(?<!\w)((?:{_TITLE})+)(?:[{_CAPITAL}]\. ?)*({_WORD}(?:[ -]{_WORD}){{0,2}})(?!\w)")
_ANY_NAME = re.compile(rf"(?<![\w]){_WORD}(?!\w)")
_OF_TITLE = {**_GENDER, **{t.upper(): g for t, g in _GENDER.items()}}


def _gender(titles: str, given: str) -> str:
    """Of the first title that has one, else by the name's ending."""
    told = [g for t in titles.split() if (g := _OF_TITLE[t.rstrip(".")]) != "n"]
    return told[0] if told else "f" if given[-1].lower() in "aeая" else "m"


def _valid(kind: str, said: str) -> bool:
    """Whether what looks like an account or an address of version 6 is one."""
    if kind == "iban":
        return _mod97(re.sub(" ", "", said)) == 1
    if kind == "ip6":
        try:
            ipaddress.IPv6Address(said)
        except ValueError:
            return False
        return sum(map(bool, said.split(":"))) > 2 and any(c.isdigit() for c in said)
    return True


def _mod97(iban: str) -> int:
    return int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97


def luhn(digits: str) -> bool:
    return sum(d if k % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d) for k, d in enumerate(map(int, reversed(digits)))) % 10 == 0


def find(text: str) -> list[tuple[int, int, str, str]]:
    """(start, end, kind, entity) in order, none overlapping; a name gives one for each word. Entities are without punctuation."""
    spans: list[tuple[int, int, str, str]] = []
    taken = bytearray(len(text))
    patterns = _PATTERNS if re.search(r"\d", text) else _PATTERNS[:2] if "@" in text or re.search(r"[=:]", text) else []

    def free(a: int, b: int) -> bool:
        return not any(taken[a:b])

    for kind, pattern in patterns:
        if kind == "email" and "@" not in text:
            continue
        for m in pattern.finditer(text):
            a, b = m.span(pattern.groups)
            if free(a, b) and _valid(kind, said := m.group(pattern.groups)):
                spans.append((a, b, kind, canonical(kind, said)))
                taken[a:b] = b"\x01" * (b - a)
    named: dict[str, str] = {}
    for m in _NAME.finditer(text):
        words = list(re.finditer(r"[^\s-]+", m[2]))
        if len(words) > 2 and words[1][0].isupper() and words[2][0].isupper():
            words = words[:2]  # a heading in capitals goes on after the name
        for k, w in enumerate(words):
            a, b = m.start(2) + w.start(), m.start(2) + w.end()
            if free(a, b):
                kind = "surname" if k == len(words) - 1 else f"given {_gender(m[1], w[0])}"
                spans.append((a, b, kind, canonical(kind, w[0])))
                taken[a:b] = b"\x01" * (b - a)
                if named.get(spans[-1][3]) != "surname":
                    named[spans[-1][3]] = kind
    last = None
    for m in _ANY_NAME.finditer(text) if "surname" in named.values() else ():
        kind = named.get(canonical("surname", m[0]))
        if kind == "surname":
            before = last if last and text[last.end() : m.start()] in (" ", "-") else None
            for w in (before, m):
                if w and free(*w.span()) and (of := named.get(canonical("surname", w[0]))):
                    spans.append((*w.span(), of, canonical(of, w[0])))
                    taken[w.start() : w.end()] = b"\x01" * (w.end() - w.start())
        last = m
    return sorted(spans)


def canonical(kind: str, said: str) -> str:
    if kind in ("phone", "card", "ssn"):
        return ("+" if said.startswith("+") else "") + re.sub(r"\D", "", said)
    if kind == "ip6":
        return f"{int(ipaddress.IPv6Address(said)):032x}"
    if kind == "iban":
        return said.replace(" ", "")
    if kind == "email" or kind == "surname" or kind.startswith("given"):
        return said.lower().replace("’", "'")
    return said


_CLASSES = {"d": "0123456789", "l": "abcdefghijklmnopqrstuvwxyz", "u": "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "x": "0123456789abcdef", "X": "0123456789ABCDEF"}


def _digest(key: bytes, *parts) -> int:
    return int.from_bytes(hmac.new(key, "\x00".join(map(str, parts)).encode("utf-8", "surrogatepass"), hashlib.sha256).digest(), "big")


def permute(key: bytes, tweak: str, symbols: str, classes: str) -> str:
    """A bijection without fixed points of the strings of these classes ('-' keeps its symbol).

    A keyed Feistel network numbers the strings; the string of the number a keyed distance ahead takes this one's place.
    """
    places = [k for k, c in enumerate(classes) if c != "-"]
    halves = places[::2], places[1::2]
    value, size = [0, 0], [1, 1]
    for h in (0, 1):
        for k in halves[h]:
            alphabet = _CLASSES[classes[k]]
            value[h], size[h] = value[h] * len(alphabet) + alphabet.index(symbols[k]), size[h] * len(alphabet)
    whole = size[0] * size[1]
    if whole < 2:
        return symbols
    kept = "".join(s for s, c in zip(symbols, classes, strict=True) if c == "-")
    context = f"{tweak}\x00{classes}\x00{kept}"
    step = lambda r: _digest(key, context, r, value[1 - r % 2])
    for r in range(8):
        value[r % 2] = (value[r % 2] + step(r)) % size[r % 2]
    number = (value[0] * size[1] + value[1] + 1 + _digest(key, context, "ahead") % (whole - 1)) % whole
    value = list(divmod(number, size[1]))
    for r in reversed(range(8)):
        value[r % 2] = (value[r % 2] - step(r)) % size[r % 2]
    out = list(symbols)
    for h in (0, 1):
        for k in reversed(halves[h]):
            alphabet = _CLASSES[classes[k]]
            value[h], place = divmod(value[h], len(alphabet))
            out[k] = alphabet[place]
    return "".join(out)


def _shape(text: str) -> str:
    return "".join("d" if c in _CLASSES["d"] else "l" if c in _CLASSES["l"] else "u" if c in _CLASSES["u"] else "-" for c in text)


def _words_of(key: bytes, kind: str, entity: str, attempt: int) -> str:
    cyrillic = re.search("[а-яё]", entity) is not None
    onsets, vowels = ("бвгдзклмнпрст", "аеиоу") if cyrillic else ("bdfgklmnprstvz", "aeiou")
    ends = {"given m": ["ан", "ир", "ев"] if cyrillic else ["an", "ek", "or", "us"], "given f": ["ана", "ия", "ина"] if cyrillic else ["a", "ina", "elle", "ia"]}.get(kind, ["ов", "енко", "ский"] if cyrillic else ["er", "son", "ard", "well"])
    n = _digest(key, kind, attempt, entity)
    out = ""
    for _ in range(min(3 + attempt, 24)):
        n, o = divmod(n, len(onsets))
        n, v = divmod(n, len(vowels))
        out += onsets[o] + vowels[v]
    return out[:-1] + ends[n % len(ends)]


def surrogate(key: bytes, kind: str, entity: str, attempt: int = 0) -> str:
    """What stands for a canonical entity."""
    tweak = f"{kind} {attempt}"
    if kind == "surname" or kind.startswith("given"):
        return _words_of(key, kind, entity, attempt)
    if kind == "email":
        local, _, domain = entity.rpartition("@")
        hide = lambda what, s: permute(key, f"{tweak} {what}", s, _shape(s)) if _shape(s).strip("-") else permute(key, f"{tweak} {what}", s + "a", "-" * len(s) + "l")
        plain = re.sub(r"[^\x00-\x7f]", lambda m: f"{ord(m[0]):x}", local)  # letters outside ASCII are spelt, else they would stay
        labels = domain.split(".")
        return hide("local " + domain, plain) + "@" + ".".join([*(hide("label", re.sub(r"[^\x00-\x7f]", lambda m: f"{ord(m[0]):x}", x)) for x in labels[:-1]), labels[-1]])
    if kind == "ip":
        a, b, c, d = map(int, entity.split("."))
        keep = {10: 1, 127: 1}.get(a, 2 if (a, b) == (192, 168) else 0)
        size = 256 ** (4 - keep)
        hidden = [a, b, c, d][keep:]
        value = 0
        for x in hidden:
            value = value * 256 + x
        text = permute(key, f"{tweak} {entity.split('.')[:keep]}", f"{value:0{2 * len(hidden)}x}", "x" * 2 * len(hidden))
        value = int(text, 16) % size
        return ".".join(map(str, [*([a, b][:keep]), *(value >> 8 * k & 255 for k in reversed(range(len(hidden))))]))
    if kind == "secret":
        hexadecimal = "x" if re.fullmatch("[0-9a-f]+", entity) else "X" if re.fullmatch("[0-9A-F]+", entity) else None
        return permute(key, tweak, entity, hexadecimal * len(entity) if hexadecimal else _shape(entity))
    if kind == "card":
        body = permute(key, tweak + str(luhn(entity)), entity[:-1], "d" * (len(entity) - 1))
        check = next(c for c in "0123456789" if luhn(body + c))
        if luhn(entity):
            return body + check
        wrong = [c for c in "0123456789" if c != check]
        real = next(c for c in "0123456789" if luhn(entity[:-1] + c))
        return body + wrong[[c for c in "0123456789" if c != real].index(entity[-1])]
    if kind == "ip6":
        return permute(key, tweak, entity, "-" * 4 + "x" * 28)
    if kind == "iban":
        body = permute(key, f"{tweak} {entity[:2]}", entity[4:], _shape(entity[4:]))
        return f"{entity[:2]}{98 - _mod97(f'{entity[:2]}00{body}'):02d}{body}"
    keep = int(kind == "phone" and entity.startswith("0"))
    if kind == "phone" and entity.startswith("+"):
        keep = 1 + max(1, len(entity) - 11)  # the sign and the country code
    return permute(key, tweak, entity, "-" * keep + "d" * (len(entity) - keep))


def dressed(said: str, kind: str, new: str) -> str:
    """The surrogate with the punctuation and case of the original."""
    if kind in ("phone", "card", "ssn"):
        digits = iter(re.sub(r"\D", "", new))
        return "".join(next(digits) if c.isdigit() else c for c in said)
    if kind == "email":
        return new.upper() if said.isupper() else new
    if kind == "iban":
        symbols = iter(new)
        return "".join(" " if c == " " else next(symbols) for c in said)
    if kind == "ip6":
        address = str(ipaddress.IPv6Address(int(new, 16)))
        return address.upper() if said.isupper() else address
    if kind == "surname" or kind.startswith("given"):
        return new.upper() if said.isupper() and len(said) > 1 else new[:1].upper() + new[1:]
    return new


def entities(texts: DataFrame) -> DataFrame:
    """(k1, k2, text) -> k1, k2, kind, entity: each once for a text."""

    names, kinds = ["k1", "k2", "kind", "entity"], [pa.int64(), pa.int64(), pa.string(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [(x, y, *e) for x, y, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True) for e in {(s[2], s[3]) for s in find(t.as_py() or "")}]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], kind) for k, kind in enumerate(kinds)], names)

    return texts.select("k1", "k2", "text").mapInArrow(run, "k1 long, k2 long, kind string, entity string")


def attempts(found: DataFrame, key: bytes, most: int = 50) -> DataFrame:
    """(kind, entity), distinct -> kind, entity, attempt for the entities whose first surrogate is another's too, or, of names, another entity."""

    @F.pandas_udf("string")
    def new(kind: pd.Series, entity: pd.Series, attempt: pd.Series) -> pd.Series:
        return pd.Series([surrogate(key, k, e, int(a)) for k, e, a in zip(kind, entity, attempt, strict=True)], dtype=object)

    named = (F.col("kind") == "surname") | F.col("kind").startswith("given")
    settled = cut(found.withColumn("attempt", F.lit(0)).withColumn("s", new("kind", "entity", "attempt")))
    own = found.filter(named).select(F.col("entity").alias("s")).distinct()
    for _ in range(most):
        # The one with the lowest attempt, then the lowest entity, keeps a shared surrogate.
        owner = settled.groupBy("kind", "s").agg(F.min(F.struct("attempt", "entity")).alias("owner"), F.count("*").alias("n")).filter("n > 1").select("kind", "s", F.col("owner.entity").alias("owner"))
        taken = settled.filter(named).join(own, "s", "left_semi").select("kind", "entity")
        clash = settled.join(owner, ["kind", "s"]).filter("entity <> owner").select("kind", "entity").union(taken).distinct()
        clash = cut(clash.withColumn("clash", F.lit(1)))
        if clash.isEmpty():
            return settled.filter("attempt > 0").select("kind", "entity", "attempt")
        moved = settled.join(clash, ["kind", "entity"], "left").withColumn("attempt", F.col("attempt") + F.coalesce("clash", F.lit(0)))
        settled = cut(moved.select("kind", "entity", "attempt", F.when(F.col("clash").isNotNull(), new("kind", "entity", "attempt")).otherwise(F.col("s")).alias("s")))
    raise ValueError("surrogates still collide")


def replace(docs: DataFrame, key: bytes, count_as: str | None = "n_entities") -> DataFrame:
    """The given columns with ``text`` replaced, and how many spans were, as ``count_as`` (in the place of a given column of that name), or not if None."""
    texts = keyed(docs)
    found = entities(texts)
    moved = cut(attempts(cut(found.select("kind", "entity").distinct()), key))
    n, chars = moved.agg(F.count("*"), F.coalesce(F.sum(F.length("entity")), F.lit(0))).first()
    few = n <= FEW and chars <= FEW_CHARS
    everywhere = {(r["kind"], r["entity"]): r["attempt"] for r in moved.collect()} if few else {}

    def some(text: pa.Array, special: pa.Array) -> pa.Array:
        out, counts = [], []
        for t, s in zip(text, special, strict=True):
            t, s = t.as_py(), s.as_py()
            spans = find(t) if t else []
            tries = {(x["kind"], x["entity"]): x["attempt"] for x in s} if s is not None else everywhere
            parts, last = [], 0
            for a, b, kind, entity in spans:
                parts += [t[last:a], dressed(t[a:b], kind, surrogate(key, kind, entity, tries.get((kind, entity), 0)))]
                last = b
            out.append("".join([*parts, t[last:]]) if spans else t)
            counts.append(len(spans))
        return pa.StructArray.from_arrays([pa.array(out, pa.string()), pa.array(counts, pa.int64())], ["text", "n"])

    @F.arrow_udf("text string, n long")
    def rewrite(text: pa.Array, special: pa.Array) -> pa.Array:
        # Few texts at a time are Python strings.
        return pa.concat_arrays([some(text.slice(k, STEP), special.slice(k, STEP)) for k in range(0, max(1, len(text)), STEP)])

    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("text").cast("string").alias("text"))
    if few:
        rows = rows.withColumn("special", F.lit(None).cast("array<struct<kind:string,entity:string,attempt:int>>"))
    else:
        special = found.join(moved, ["kind", "entity"]).groupBy("k1", "k2").agg(F.collect_list(F.struct("kind", "entity", "attempt")).alias("special"))
        k1, k2 = text_keys(F.coalesce(F.col("text"), F.lit("")))
        rows = rows.withColumn("k1", k1).withColumn("k2", k2).join(special, ["k1", "k2"], "left")
    rows = rows.select("row", rewrite("text", "special").alias("new"))
    kept = [F.col("new.text").alias("text") if c == "text" else F.col(f"row.`{c}`") for c in docs.columns if c != count_as]
    return rows.select(*kept, *([F.col("new.n").alias(count_as)] if count_as else []))


def op6_pii(spark, sf_dir):
    return replace(table(spark, sf_dir, "documents"), key_of(spark)).select("doc_id", "text", "n_entities")
