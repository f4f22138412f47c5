"""Surrogates for personal data: keyed, type-consistent, distinct and the same wherever an entity returns."""

from __future__ import annotations

import hashlib
import hmac
import ipaddress
import re
from collections.abc import Iterator
from itertools import count

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fresh_name, staged, texts_of

#: Honorifics by gender and language form (fixed values); a capitalised name must follow one of them.
FEMALE_TITLES = ("Mrs.", "Mrs", "Ms.", "Ms", "Miss", "Frau", "Madame", "Mme", "Señora", "Sra.", "Госпожа")
MALE_TITLES = ("Mr.", "Mr", "Herr", "Monsieur", "Señor", "Sr.", "Господин")
NEUTRAL_TITLES = ("Dr.", "Prof.")
#: Lower-case words inside names (fixed values); they stay as they are.
PARTICLES = frozenset("von vom van der den dem de del della di da do dos das du des la le las los el al bin ibn ben zu zum zur ter ten und y e".split())
#: What surrogate names end in, by script, part and gender (fixed values); before it they are made of syllables.
ENDINGS = {
    ("latin", "given"): {"f": "a", "m": "us", "n": "i"},
    ("latin", "family"): {"f": "", "m": "", "n": ""},
    ("cyrillic", "given"): {"f": "а", "m": "ан", "n": "и"},
    ("cyrillic", "family"): {"f": "ова", "m": "ов", "n": "ко"},
}
DIGITS = "0123456789"
LETTERS = {"latin": "abcdefghijklmnopqrstuvwxyz", "cyrillic": "абвгдежзиклмнопрстуфхцчшэюя"}
SYLLABLES = {
    "latin": [c + v for c in "bdfgklmnprstvz" for v in "aeiou"],
    "cyrillic": [c + v for c in "бвгдзклмнпрст" for v in "аеиоу"],
}
WORD = r"[^\W\d_]+(?:['’-][^\W\d_]+)*"
WORDS, LETTER_RUNS = re.compile(WORD), re.compile(r"[^\W\d_]+")
#: White space inside a name: any, but no empty line.
GAP = r"(?:[^\S\n]*\n)?[^\S\n]*"
#: The next part of a name: white space, a word, and the full stop if it is an initial.
PART = re.compile(rf"({GAP})({WORD})(?:(?<=\b[^\W\d_])\.)?")
POSSESSIVE = re.compile(r"(?<=.)['’]s$", re.I)
TITLE = "|".join(re.escape(t) for t in sorted((*FEMALE_TITLES, *MALE_TITLES, *NEUTRAL_TITLES), key=len, reverse=True))
OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
#: Kinds in order of precedence; spans do not overlap.
PATTERNS = re.compile(
    "|".join(
        (
            r"(?P<email>(?<![\w.%+-])[\w.%+-]+@(?:[^\W_]|-)+(?:\.(?:[^\W_]|-)+)*\.(?:xn--[A-Za-z0-9-]+|[^\W\d_]{2,}))",
            rf"(?P<address>(?<![\w.])(?:{OCTET}\.){{3}}{OCTET}(?![\w]|\.\d))",
            r"(?P<address6>(?<![\w:.])[0-9A-Fa-f]{0,4}(?::[0-9A-Fa-f]{0,4}){2,8}(?:(?:\.\d{1,3}){3})?(?![\w:]))",
            r"(?P<social>(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-]))",
            r"(?P<account>(?<![\w])[A-Z]{2}\d{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?!\w))",
            r"(?P<phone>(?<![\w+])(?:\+\d{1,3}[\x20.-]?\(?\d{1,4}\)?(?:[\x20.-]?\d{2,4}){2,4}|\(\d{3}\)\x20?\d{3}[.-]\d{4}|\d{3}-\d{3}-\d{4}|(?<!\.)\d{3}\.\d{3}\.\d{4}(?!\.\d))(?!\w))",
            r"(?P<card>(?<![\w])(?:\d{16}|\d{15}|\d{4}(?:[\x20-]\d{4}){3})(?!\w))",
            rf"(?P<name>(?<!\w)(?:(?:{TITLE})\s+)+(?=[^\W\d_]))",
        )
    )
)
#: What a kind needs before the pattern is worth trying.
HINT = re.compile(rf"[@\d]|(?:{TITLE})\s")
MARKS = re.compile(r"[^A-Z0-9+]")


def entities(text: str) -> list[tuple[int, int, str, str]]:
    """(start, end, kind, canonical form) of each entity: kinds never overlap. A name is what follows honorifics: any number
    of capitalised words, initials and particles. The last word is the family name and the others are given names,
    entities of their own, so a person keeps them in full and in short; initials are given names, too. Where the text has a
    word of such a name again without an honorific, it is the same entity. Canonical forms ignore case in
    mail addresses, grouping marks in numbers and the way an address is shortened."""
    out = []
    if not HINT.search(text):
        return out
    at, known = 0, {}
    while found := PATTERNS.search(text, at):
        kind, value, start = found.lastgroup, found.group(), found.start()
        at = found.end()
        if kind == "name":
            parts = name_parts(text, at)
            gender = next((g for g in map(gender_of, value.split()) if g != "n"), "n")
            for i, (begin, end, word) in enumerate(parts):
                part = "given" if i + 1 < len(parts) else "family"
                script = script_of(word)
                # Latin family names are the same for all; other names have a gender
                own = "n" if (script, part) == ("latin", "family") else gender
                out.append((begin, end, f"{part}_{script}_{own}", word.lower()))
                if len(word) > 1:
                    known.setdefault(word.lower(), f"{part}_{script}_{own}")
                at = end
        elif kind == "email":
            out.append((start, found.end(), kind, value.lower()))
        elif kind == "address":
            out.append((start, found.end(), kind, value))
        elif kind == "address6":
            if (plain := plain_address(value)) is not None:
                out.append((start, found.end(), kind, plain))
        else:
            out.append((start, found.end(), kind, MARKS.sub("", value)))
    return bare_mentions(text, out, known) if known else out


def name_parts(text: str, at: int) -> list[tuple[int, int, str]]:
    """(start, end, word) of the capitalised words and initials of the name that begins at ``at``."""
    out, after_initial = [], False
    while found := PART.match(text, at):
        gap, word, start = found[1], found[2], found.start(2)
        if out and not gap and not after_initial:
            break
        word = POSSESSIVE.sub("", word)
        if word[0].isupper():
            whole = word == found[2]
            after_initial = whole and text[found.end() - 1] == "."
            out.append((start, found.end() if whole else start + len(word), word))
            if not whole:
                break
        elif word not in PARTICLES:
            break
        at = found.end()
    return out


def bare_mentions(text: str, spans: list[tuple[int, int, str, str]], known: dict[str, str]) -> list[tuple[int, int, str, str]]:
    """``spans`` and, between them, every capitalised word of ``known``, on its own or inside a compound."""
    more, low = [], 0
    for high, following in [*((s, e) for s, e, _, _ in spans), (len(text), len(text))]:
        for found in WORDS.finditer(text, low, high):
            whole = found.group()
            words = [(found.start(), whole)] if whole.lower() in known else [(found.start() + m.start(), m.group()) for m in LETTER_RUNS.finditer(whole)]
            more += [(at, at + len(w), known[w.lower()], w.lower()) for at, w in words if w[0].isupper() and w.lower() in known]
        low = following
    return sorted(spans + more)


def plain_address(value: str) -> str | None:
    """The shortest form of an IPv6 address, None for what only looks like one (times, scopes in code)."""
    if sum(map(bool, re.split("[:.]", value))) < 2 or not any(c.isdigit() for c in value):
        return None
    try:
        return ipaddress.IPv6Address(value).compressed
    except ValueError:
        return None


def gender_of(title: str) -> str:
    return "f" if title in FEMALE_TITLES else "m" if title in MALE_TITLES else "n"


def script_of(word: str) -> str:
    return "cyrillic" if any("\u0400" <= c <= "\u04ff" for c in word) else "latin"


def draws(key: bytes, kind: str, value: str, attempt: int) -> Iterator[int]:
    """Keyed numbers of an entity, as many as are asked for."""
    for block in count():
        digest = hmac.new(key, f"{kind}\x00{value}\x00{attempt}\x00{block}".encode(), hashlib.sha256).digest()
        for i in range(0, 32, 4):
            yield int.from_bytes(digest[i : i + 4], "big")


def surrogate(key: bytes, kind: str, value: str, attempt: int) -> str:
    """The replacement of a canonical form, itself canonical: digits for digits and letters for letters of the same
    script at the same places, a check digit for cards, names of the same part, script and gender. A different
    ``attempt`` gives another."""
    stream = draws(key, kind, value, attempt)

    def pick(options):
        return options[next(stream) % len(options)]

    def alike(c: str) -> str:
        if c.isdigit():
            return pick(DIGITS)
        if not c.isalpha():
            return c
        return pick(LETTERS[script_of(c)]).upper() if c.isupper() else pick(LETTERS[script_of(c)])

    if kind == "email":
        body, _, top = value.rpartition(".")
        return f"{''.join(map(alike, body))}.{top}"
    if kind == "address":
        return ".".join(str(pick(range(1, 255))) for _ in range(4))
    if kind == "address6":
        return ":".join(["2001", *(f"{pick(range(0x1000, 0x10000)):x}" for _ in range(7))])
    if kind.startswith(("given", "family")):
        part, script, gender = kind.split("_")
        return "".join(pick(SYLLABLES[script]) for _ in range(4)) + ENDINGS[script, part][gender]
    if kind == "account":
        return value[:2] + "".join(map(alike, value[2:]))
    if kind == "phone":
        kept = 2 if value[0] == "+" else 0  # the sign and the first digit of the country
        return value[:kept] + pick("23456789") + "".join(map(alike, value[kept + 1 :]))
    if kind == "card":
        body = value[0] + "".join(map(alike, value[1:-1]))  # the first digit names the issuer's kind
        return body + check_digit(body)
    return "".join(map(alike, value))


def check_digit(body: str) -> str:
    """The last digit of a card number, by doubling every second digit."""
    total = 0
    for i, c in enumerate(reversed(body)):
        d = int(c) * (2 if i % 2 == 0 else 1)
        total += d - 9 if d > 9 else d
    return str(-total % 10)


def dressed(written: str, kind: str, value: str) -> str:
    """A canonical surrogate in the way the entity is written: its case, and its grouping marks in numbers."""
    if kind == "email":
        if len(written) != len(value):
            return value
        return "".join(n.upper() if o.isupper() else n for o, n in zip(written, value))
    if kind in ("address", "address6"):
        return value
    if kind.startswith(("given", "family")):
        return value.upper() if len(written.rstrip(".")) > 1 and written.isupper() else value.capitalize()
    marks = iter(value)
    return "".join(c if MARKS.match(c) else next(marks) for c in written)


def rewritten(text: str, names: dict[tuple[str, str], str]) -> str:
    out, at = [], 0
    for start, end, kind, value in entities(text):
        out.append(text[at:start])
        out.append(dressed(text[start:end], kind, names[kind, value]))
        if text[end - 1] == "." and text[end : end + 1].isalpha():
            out.append(" ")  # initials without a blank between become names
        at = end
    return "".join(out) + text[at:]


ENTITY = T.StructType([T.StructField("kind", T.StringType()), T.StructField("value", T.StringType())])


def assign_surrogates(found: DataFrame, key: bytes, rounds: int = 20) -> DataFrame:
    """``kind``, ``value`` and ``surrogate`` of each distinct entity of ``found`` (kind, value).

    A surrogate is refused if another entity of its kind has it (the smallest entity keeps it) or if it is itself an
    entity of the corpus; refused entities draw again. Entities are counted and compared by shuffles on the surrogate; the
    driver learns only whether any is left. After ``rounds`` draws the job fails rather than repeat a surrogate."""
    distinct = found.select("kind", "value").distinct()

    def drawn(attempt):
        def run(batches):
            for batch in batches:
                kinds, values = batch.column("kind").to_pylist(), batch.column("value").to_pylist()
                made = [surrogate(key, k, v, attempt) for k, v in zip(kinds, values)]
                yield pa.RecordBatch.from_arrays([batch.column("kind"), batch.column("value"), pa.array(made, pa.string())], names=["kind", "value", "surrogate"])

        return run

    distinct = staged(distinct, "entities")
    open_entities, settled = distinct, None
    # a surrogate must be free among all names of its part, whatever their script and gender
    family = F.split("kind", "_")[0]
    real = distinct.select(family.alias("family"), F.col("value").alias("surrogate")).distinct()
    for attempt in range(rounds):
        made = open_entities.mapInArrow(drawn(attempt), "kind string, value string, surrogate string").withColumn("family", family)
        made = made.join(real.withColumn("taken", F.lit(True)), ["family", "surrogate"], "left")
        if settled is not None:
            used = settled.select("family", "surrogate", F.lit(True).alias("used"))
            made = made.join(used, ["family", "surrogate"], "left")
        else:
            made = made.withColumn("used", F.lit(None).cast("boolean"))
        made = staged(made.withColumn("free", F.col("taken").isNull() & F.col("used").isNull()), "drawn")
        first = made.filter("free").groupBy("family", "surrogate").agg(F.min(F.struct("kind", "value")).alias("keeps"))
        won = first.select("family", "surrogate", "keeps.kind", "keeps.value")
        lost = made.join(won, ["kind", "value"], "left_anti").select("kind", "value")
        settled = won if settled is None else settled.unionByName(won)
        settled, open_entities = staged(settled, "settled"), staged(lost, "open")
        if open_entities.isEmpty():
            return settled.select("kind", "value", "surrogate")
    raise ValueError(f"no distinct surrogate for every entity after {rounds} draws; a kind has too few forms")


def replace_entities(docs: DataFrame, key: str = "surrogates", text_column: str = "text", length_column: str | None = None) -> DataFrame:
    """``docs`` with every entity of ``text_column`` replaced by its surrogate, and ``n_entities`` added (under another
    name if it is taken). Further columns are kept as they are; ``length_column``, if given, follows the new text.

    Texts are searched once and written with what was found to the shared folder. The distinct entities draw their surrogates
    there, and each text that has entities gets the surrogates of its own distinct ones: a mention joins on the
    entity, spread over salts so that one found everywhere is no hot key, and a row's surrogates come
    back to it as one list. Texts without entities never leave their split. Null texts stay null, empty ones empty;
    repeated rows are rewritten alike; an empty table gives no rows."""
    mark, listed = fresh_name(docs, "_row"), fresh_name(docs, "_found")
    number = fresh_name(docs, "n_entities")

    def search(batches):
        for batch in batches:
            found, counts = [], []
            for text in texts_of(batch, text_column):
                here = entities(text)
                counts.append(len(here))
                found.append([{"kind": k, "value": v} for k, v in sorted({(k, v) for _, _, k, v in here})] or None)
            kind = pa.list_(pa.struct([("kind", pa.string()), ("value", pa.string())]))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(counts, pa.int64()), pa.array(found, kind)], names=[*batch.schema.names, number, listed])

    schema = T.StructType([*docs.schema.fields, T.StructField(number, T.LongType()), T.StructField(listed, T.ArrayType(ENTITY))])
    rows = docs.mapInArrow(search, schema)
    rows = staged(rows.withColumn(mark, F.monotonically_increasing_id()), "searched")
    clean = rows.filter(F.col(listed).isNull()).drop(mark, listed)
    marked = rows.filter(F.col(listed).isNotNull())
    mentions = marked.select(F.col(mark).alias("row"), F.explode(listed).alias("e")).select("row", "e.kind", "e.value")
    table = assign_surrogates(mentions, key.encode())
    salts = 16
    spread = table.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    named = mentions.withColumn("salt", F.pmod(F.xxhash64("row"), F.lit(salts)).cast("int")).join(spread, ["kind", "value", "salt"])
    named = named.groupBy("row").agg(F.collect_list(F.struct("kind", "value", "surrogate")).alias("names"))
    joined = marked.drop(listed).join(named.select(F.col("row").alias(mark), F.col("names").alias(listed)), mark)

    def rewrite(batches):
        at = None
        for batch in batches:
            at = batch.schema.names.index(text_column)
            texts, lists = texts_of(batch, text_column), batch.column(listed).to_pylist()
            new = [rewritten(t, {(x["kind"], x["value"]): x["surrogate"] for x in names}) for t, names in zip(texts, lists)]
            kept = [pa.array(new, pa.string()) if i == at else c for i, c in enumerate(batch.columns)]
            keep = [i for i, n in enumerate(batch.schema.names) if n not in (mark, listed)]
            yield pa.RecordBatch.from_arrays([kept[i] for i in keep], names=[batch.schema.names[i] for i in keep])

    out = joined.mapInArrow(rewrite, clean.schema).unionByName(clean)
    return out.withColumn(length_column, F.length(text_column).cast("long")) if length_column else out
