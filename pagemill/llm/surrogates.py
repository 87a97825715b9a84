r"""Surrogates for personal data.

Found are: e-mail addresses, IPv4 and IPv6 addresses, card numbers, IBANs, telephone numbers, social security numbers,
secrets (long hexadecimal strings and assigned keys) and names: a listed given name and a family name, a title and one
or two words, and, in a document that holds such a name, its parts where they stand alone.  An entity's canonical value
(case and layout taken off) goes through a keyed permutation of all values of its kind and shape, and the result is laid
out like the original: digits for digits, letters of the same case and script, valid checksums for valid ones, a given
name of the same gender and script.  Names go word by word, so "Ms Smith" follows "Alice Smith".  One value has one
surrogate in all documents (coreference), and shapes don't mix.

A surrogate that is a real value of the corpus, or another value's surrogate, is found by a join and drawn again until
there is none.  Where a shape is crowded its surrogates grow by a letter a round, so the search ends; kinds of a fixed
format can't grow, and a corpus that holds too much of such a space stops the run: no surrogate that is real or shared
gets out.

The key decides all surrogates and undoes them; it belongs with the corpus' owner, not in code.

Defined cases: a null text stays null; texts without entities stay as they are; repeated rows get equal surrogates; an
empty table gives an empty table; whole texts are read; other columns travel along untouched, one called
``n_entities`` is replaced.
"""

from __future__ import annotations

import hashlib
import ipaddress
import math
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.functions import arrow_udf

from pagemill.llm.names import fresh, quoted
from pagemill.llm.scratch import Scratch

#: Given names by script and gender.
GIVEN = {
    ("latin", "f"): "Alice Amina Anna Ayesha Barbara Charlotte Clara Elena Emma Fatima Hannah Helen Jane Julia Laura Linda Maria Martha Mary Mei Nora Olivia Priya Rosa Sarah Sophie Susan Yuki Zoë".split(),
    ("latin", "m"): "Adam Ahmed Andrew Bob Carlos Charles Daniel David Edward Felix Frank George Henry Jack James John Karl Louis Martin Michael Mohammed Oscar Paul Peter Rahul Robert Thomas William".split(),
    ("cyrillic", "f"): "Анна Вера Дарья Елена Ирина Мария Надежда Ольга Светлана Татьяна".split(),
    ("cyrillic", "m"): "Алексей Андрей Борис Владимир Дмитрий Иван Михаил Николай Павел Сергей".split(),
    ("greek", "f"): "Αικατερίνη Άννα Γεωργία Ελένη Μαρία Σοφία".split(),
    ("greek", "m"): "Ανδρέας Γεώργιος Δημήτριος Ιωάννης Κωνσταντίνος Νικόλαος".split(),
}
#: Titles that may stand before a name.
TITLES = "Mr Mrs Ms Dr Prof Herr Frau Señor Señora Monsieur Madame".split()
#: Letters that take each other's place in family names, by script: vowels, consonants.
LETTERS = {
    "latin": ("aeiou", "bcdfghjklmnpqrstvwxyz"),
    "cyrillic": ("аеиоуыэюя", "бвгджзйклмнпрстфхцчшщ"),
    "greek": ("αεηιου", "βγδζθκλμνξπρστφχψ"),
}
_ALL_NAMES = sorted({n for names in GIVEN.values() for n in names})
_NAMES, _TITLES = "|".join(sorted(_ALL_NAMES, key=lambda n: (-len(n), n))), "|".join(TITLES)
_WORD = r"[^\W\d_a-zа-яα-ω][^\W\d_]+(?:['’-][^\W\d_]+)?"
_OPEN = r"(?:(?<=\s)|(?<=^)|(?<=[(\"]))"
_KINDS = (
    ("email", r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9](?:[A-Za-z0-9._%+-]{0,62}[A-Za-z0-9])?@(?:[A-Za-z0-9](?:[A-Za-z0-9-]{0,61}[A-Za-z0-9])?\.)+[A-Za-z]{2,24}(?![A-Za-z0-9])"),
    ("secret", r"(?<![A-Za-z0-9])(?:[0-9a-f]{32,128}|[0-9A-F]{32,128}|AKIA[0-9A-Z]{16}|(?:sk|ghp|xox[bp])[-_][A-Za-z0-9]{16,64})(?![A-Za-z0-9])"),
    ("iban", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"),
    ("ip6", r"(?<![0-9A-Za-z:.])(?:(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}|(?:[0-9A-Fa-f]{1,4}:){2,6}(?::[0-9A-Fa-f]{1,4}){1,5}|[0-9A-Fa-f]{1,4}:(?::[0-9A-Fa-f]{1,4}){2,6})(?![0-9A-Za-z:])"),
    ("ip", r"(?<![0-9.])(?:(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])(?![0-9]|\.[0-9])"),
    ("ssn", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"),
    ("card", r"(?<![0-9])(?:(?:[0-9]{4}[ -]?){3}[0-9]{4}|3[47][0-9]{2}[ -]?[0-9]{6}[ -]?[0-9]{5})(?![0-9])"),
    ("phone", r"(?<![0-9A-Za-z])(?:(?:\+[0-9]{1,3}[ .-]?)?(?:\([0-9]{2,4}\)[ .-]?|[0-9]{2,4}[ .-])[0-9]{3,4}[ .-][0-9]{3,4}|\+[0-9]{8,15}|(?:(?<=(?i:tel) )|(?<=(?i:tel): )|(?<=(?i:call) )|(?<=(?i:phone) )|(?<=(?i:phone): )|(?<=(?i:fax) )|(?<=(?i:mobile) ))[2-9][0-9]{9})(?![0-9])"),
    ("name", rf"{_OPEN}(?:(?:{_TITLES})\.?[ ])?(?:{_NAMES})(?:[ ]\w\.)?[ ]{_WORD}"),
    ("titled", rf"{_OPEN}(?:{_TITLES})\.?[ ]{_WORD}(?:[ ]{_WORD})?"),
)
PATTERN = re.compile("|".join(f"(?P<{kind}>{p})" for kind, p in _KINDS))
_UNNAMED = re.compile("|".join(f"(?P<{kind}>{p})" for kind, p in _KINDS if kind not in ("name", "titled")))
_DIGIT, _HEX_LETTERS = re.compile("[0-9]"), re.compile("[a-f]{32}|[A-F]{32}")
_MARKS = ("@", "AKIA", "sk-", "sk_", "ghp-", "ghp_", "xoxb-", "xoxb_", "xoxp-", "xoxp_", "::")
_CUES = (*_ALL_NAMES, *(t + " " for t in TITLES), *(t + ". " for t in TITLES))
_PARTS = re.compile(rf"(?P<title>(?:{_TITLES})\.?(?= ))|(?P<initial>\w)\.|(?P<word>{_WORD})")
#: Rounds after which crowded shapes grow, and after which the search gives up.
PLAIN_ROUNDS, MOST_ROUNDS = 3, 64


def _round(key: bytes, *parts) -> int:
    return int.from_bytes(hashlib.blake2b("\x1f".join(map(str, parts)).encode(), key=key, digest_size=16).digest(), "big")


def permute(key: bytes, space: str, n: int, value: int) -> int:
    """A keyed permutation of 0..n-1: ten Feistel rounds over a rectangle that holds n, walked until inside."""
    if n < 2:
        return value
    a = math.isqrt(n - 1) + 1
    b = -(-n // a)
    while True:
        left, right = divmod(value, b)
        for i in range(10):
            if i % 2:
                right = (right + _round(key, space, n, i, left)) % b
            else:
                left = (left + _round(key, space, n, i, right)) % a
        value = left * b + right
        if value < n:
            return value


def by_shape(key: bytes, space: str, text: str, classes: dict[str, str]) -> str:
    """Letters and digits to others of their class, place by place; the rest stays."""
    sets = [classes.get(c) for c in text]
    n = math.prod(len(s) for s in sets if s)
    value = 0
    for c, s in zip(text, sets, strict=True):
        if s:
            value = value * len(s) + s.index(c)
    shape = "".join(s[0] if s else c for c, s in zip(text, sets, strict=True))
    value, out = permute(key, f"{space}:{shape}", n, value), []
    for c, s in zip(reversed(text), reversed(sets), strict=True):
        if s:
            value, at = divmod(value, len(s))
            c = s[at]
        out.append(c)
    return "".join(reversed(out))


@lru_cache(8)
def _classes(kind: str) -> dict[str, str]:
    low, digits = "abcdefghijklmnopqrstuvwxyz", "0123456789"
    if kind == "hex":
        return {c: "0123456789abcdef" for c in "0123456789abcdef"}
    if kind == "digits":
        return {c: digits for c in digits}
    if kind == "names":
        return {c: s for sets in LETTERS.values() for s in sets for c in s}
    return {c: s for s in (low, low.upper(), digits) for c in s}


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def canonical(kind: str, text: str) -> str:
    """The value without case and layout where these don't tell entities apart."""
    if kind == "email":
        return text.lower()
    if kind == "secret":
        return text.lower() if re.fullmatch("[0-9a-fA-F]+", text) else text
    if kind in ("card", "ssn"):
        return re.sub("[^0-9]", "", text)
    if kind == "iban":
        return text.replace(" ", "")
    if kind == "ip6":
        return ipaddress.IPv6Address(text).exploded
    if kind == "family":
        return text.lower()
    if kind == "phone":
        head = re.match(r"\+[0-9]{1,3}(?=[ .(-])", text)
        return f"{head[0] if head else ''}:{re.sub('[^0-9]', '', text[head.end() if head else 0:])}"
    return text


def _given(name: str) -> tuple[list[str], int] | None:
    for names in GIVEN.values():
        if name in names:
            return names, names.index(name)
    return None


def iban_check(value: str) -> int:
    """The remainder of an IBAN: 1 if it is sound."""
    return int("".join(str(int(c, 36)) for c in value[4:] + value[:4])) % 97


def surrogate(key: bytes, kind: str, value: str, attempt: int = 0) -> str:
    """The canonical surrogate of a canonical value; from some attempt on a longer one, where the kind allows."""
    space = f"{kind}:{attempt}"
    more = max(0, attempt - PLAIN_ROUNDS)
    if kind == "email":
        local, _, domain = value.partition("@")
        local += "a" * more
        name, dot, top = domain.rpartition(".")
        return by_shape(key, space, f"{local}@{name}", _classes("plain")) + dot + top
    if kind == "secret":
        if re.fullmatch("[0-9a-f]+", value):
            return by_shape(key, space, value, _classes("hex"))  # 16 ** 32 values and more are never crowded
        head = re.match("AKIA|sk[-_]|ghp[-_]|xox[bp][-_]", value)[0]
        return head + by_shape(key, space, value[len(head) :], _classes("plain"))
    if kind == "ip":
        number = permute(key, space, 1 << 32, int.from_bytes(bytes(map(int, value.split("."))), "big"))
        return ".".join(map(str, number.to_bytes(4, "big")))
    if kind == "card":
        # valid numbers to valid ones, others to others: walk until of the same sort
        if luhn(value):
            head = by_shape(key, space, value[:-1], _classes("digits"))
            return next(head + c for c in "0123456789" if luhn(head + c))
        while luhn(value := by_shape(key, space, value, _classes("digits"))):
            pass
        return value
    if kind == "phone":
        head, _, digits = value.partition(":")
        return f"{head}:{by_shape(key, space, digits, _classes('digits'))}"
    if kind == "ip6":
        return ipaddress.IPv6Address(permute(key, space, 1 << 128, int(ipaddress.IPv6Address(value)))).exploded
    if kind == "iban":
        inner = by_shape(key, space + value[:2], value[4:], _classes("plain"))
        return f"{value[:2]}{98 - iban_check(value[:2] + '00' + inner):02d}{inner}"
    if kind == "given":
        names, at = _given(value)
        order = sorted(range(len(names)), key=lambda i: _round(key, "given", names[0], i))
        return names[order[(order.index(at) + 1) % len(order)]]
    if kind == "family":
        sets = next((v for v in LETTERS.values() if any(c in v[0] + v[1] for c in value)), LETTERS["latin"])
        return by_shape(key, space, value + "".join(sets[i % 2][0] for i in range(more)), _classes("names"))
    return by_shape(key, space, value, _classes("plain" if kind != "ssn" else "digits"))


def laid_out(kind: str, text: str, value: str) -> str:
    """The canonical surrogate in the layout and case of the original."""
    if kind in ("card", "ssn", "phone"):
        head = re.match(r"\+[0-9]{1,3}(?=[ .(-])", text) if kind == "phone" else None
        start, digits = head.end() if head else 0, iter(value.rpartition(":")[2])
        return text[:start] + "".join(next(digits) if c.isdigit() else c for c in text[start:])
    if kind == "given":
        return value.upper() if text.isupper() else value
    if kind == "family":
        shown = "".join(v.upper() if c.isupper() else v for c, v in zip(text, value, strict=False)) + value[len(text) :]
        return shown.upper() if text.isupper() else shown
    if kind == "iban":
        letters = iter(value)
        return "".join(c if c == " " else next(letters) for c in text)
    if kind == "ip6":
        short = value if text.count(":") == 7 and "::" not in text and len(text) == 39 else str(ipaddress.IPv6Address(value))
        return short.upper() if text.upper() == text and text.lower() != text else short
    if kind == "email" and len(value) != len(text):
        return value.upper() if text.isupper() else value
    if kind in ("email", "secret") and len(value) == len(text):
        if text.isupper() or text.upper() == text:
            return value.upper()
        if text.lower() != text:
            return "".join(v.upper() if c.isupper() else v for c, v in zip(text, value, strict=True)) if kind == "email" else value
    return value


def _sound(kind: str, text: str) -> bool:
    """What a pattern alone can't tell."""
    if kind == "iban":
        return iban_check(canonical(kind, text)) == 1
    if kind == "card":
        digits = canonical(kind, text)
        return len(digits) == 16 or luhn(digits)
    if kind == "ip6":
        try:
            ipaddress.IPv6Address(text)
        except ValueError:
            return False
    return True


def _words_of(start: int, text: str) -> Iterator[tuple[int, int, str, str]]:
    """The given name and the family name of a name; title and initials stay."""
    for m in _PARTS.finditer(text):
        if m.lastgroup == "word":
            yield start + m.start(), start + m.end(), "given" if _given(m[0]) else "family", m[0]


def entities(text: str) -> list[tuple[int, int, str, str]]:
    """Start, end, kind and text of each entity, from left to right; names word by word.

    Every entity holds a given name or title, a digit, a mark or a long run of hexadecimal letters; texts without skip
    the patterns.
    """
    named = any(n in text for n in _CUES)
    if not named and not (_DIGIT.search(text) or any(m in text for m in _MARKS) or _HEX_LETTERS.search(text)):
        return []
    found, people = [], set()
    for m in (PATTERN if named else _UNNAMED).finditer(text):
        if m.lastgroup in ("name", "titled"):
            own = list(_words_of(m.start(), m[0]))
            people.update(x[3] for x in own)
            found += own
        elif _sound(m.lastgroup, m[0]):
            found.append((m.start(), m.end(), m.lastgroup, m[0]))
    if people:
        alone = re.compile(rf"(?<![\w@.-])(?:{'|'.join(sorted(map(re.escape, people), key=lambda x: (-len(x), x)))})(?![\w@-])")
        taken = [(s, e) for s, e, _, _ in found]
        at = 0
        for m in alone.finditer(text):
            while at < len(taken) and taken[at][1] <= m.start():
                at += 1
            if at == len(taken) or m.end() <= taken[at][0]:
                found.append((m.start(), m.end(), "given" if _given(m[0]) else "family", m[0]))
        found.sort()
    return found


def replace(key: bytes, text: str, attempts: dict[tuple[str, str], int]) -> tuple[str, int]:
    out, at, n = [], 0, 0
    for start, end, kind, found in entities(text):
        value = canonical(kind, found)
        out += [text[at:start], laid_out(kind, found, surrogate(key, kind, value, attempts.get((kind, value), 0)))]
        at, n = end, n + 1
    return ("".join([*out, text[at:]]), n) if n else (text, 0)


def _values(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = {(kind, canonical(kind, x)) for text in batch.column(0).to_pylist() if text for _, _, kind, x in entities(text)}
        yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in found], pa.string()), pa.array([v for _, v in found], pa.string())], ["kind", "value"])


#: Kinds that a bijection of few fixed values replaces: their surrogates are real values of others, by design.
_LISTED = ("given",)


def redrawn(docs: DataFrame, key: bytes, scratch: Scratch, text_col: str = "text") -> DataFrame:
    """``(kind, value, attempt)`` of the values whose first surrogate is a real value or another's surrogate."""

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kinds, values, attempts = (batch.column(i).to_pylist() for i in range(3))
            drawn = [surrogate(key, k, v, a) for k, v, a in zip(kinds, values, attempts, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(drawn, pa.string())], ["kind", "value", "attempt", "drawn"])

    real = scratch.write("values", docs.select(text_col).mapInArrow(_values, "kind string, value string").where(~F.col("kind").isin(*_LISTED)).distinct())
    schema = "kind string, value string, attempt int, drawn string"
    now = scratch.write("drawn-0", real.withColumn("attempt", F.lit(0)).mapInArrow(draw, schema))
    for k in range(1, MOST_ROUNDS + 1):
        met = now.join(real.select("kind", F.col("value").alias("drawn")), ["kind", "drawn"], "left_semi").select("kind", "value")
        # of values that drew the same surrogate the first keeps it
        twice = now.groupBy("kind", "drawn").agg(F.min("value").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
        again = met.union(now.join(twice, ["kind", "drawn"]).where("value <> first").select("kind", "value")).distinct()
        again = scratch.write(f"again-{k}", again)
        if again.isEmpty():
            return now.where("attempt > 0").select("kind", "value", "attempt")
        moved = now.join(again, ["kind", "value"], "left_semi").select("kind", "value", (F.col("attempt") + 1).cast("int").alias("attempt")).mapInArrow(draw, schema)
        now = scratch.write(f"drawn-{k}", now.join(again, ["kind", "value"], "left_anti").select("kind", "value", "attempt", "drawn").union(moved))
        scratch.drop(f"drawn-{k - 1}", f"again-{k}")
    raise RuntimeError("the corpus holds too many values of one format for surrogates that are neither real nor shared")


def pseudonymise(docs: DataFrame, key: bytes, text_col: str = "text") -> DataFrame:
    """The documents with surrogates in their texts, and ``n_entities``, the number of replaced spans."""
    scratch = Scratch(docs.sparkSession, "surrogates")
    again = redrawn(docs, key, scratch, text_col).checkpoint()
    scratch.drop()
    result = "text string, n_entities bigint"

    def told(texts: pa.Array, attempts: list[dict]) -> pa.Array:
        rows = [replace(key, t, a) if t is not None else (None, 0) for t, a in zip(texts.to_pylist(), attempts, strict=True)]
        return pa.StructArray.from_arrays([pa.array([t for t, _ in rows], pa.string()), pa.array([n for _, n in rows], pa.int64())], ["text", "n_entities"])

    docs = docs.drop(*[c for c in docs.columns if c.lower() == "n_entities"])
    r, h, list_ = fresh(docs, "r", "h", "again")
    others = [F.col(quoted(c)) if c != text_col else F.col(f"{r}.text").alias(text_col) for c in docs.columns]
    count = F.col(f"{r}.n_entities").alias("n_entities")
    if again.isEmpty():

        @arrow_udf(result)
        def plain(texts: pa.Array) -> pa.Array:
            return told(texts, [{}] * len(texts))

        return docs.withColumn(r, plain(F.col(text_col))).select(*others, count)

    # the few texts that hold a redrawn value meet its attempt on a hash of the text
    def holders(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = {(h, kind, canonical(kind, x)) for h, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) if text for _, _, kind, x in entities(text)}
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.string()), pa.array([r[2] for r in rows], pa.string())], ["h", "kind", "value"])

    hashed = F.xxhash64(F.col(text_col))
    held = docs.select(hashed.alias("h"), F.col(text_col)).mapInArrow(holders, "h bigint, kind string, value string")
    lists = held.join(again, ["kind", "value"]).distinct().groupBy("h").agg(F.collect_list(F.struct("kind", "value", "attempt")).alias("again")).toDF(h, list_)

    @arrow_udf(result)
    def with_attempts(texts: pa.Array, again: pa.Array) -> pa.Array:
        return told(texts, [{(x["kind"], x["value"]): x["attempt"] for x in a or []} for a in again.to_pylist()])

    joined = docs.withColumn(h, hashed).join(lists, h, "left")
    return joined.withColumn(r, with_attempts(F.col(text_col), F.col(list_))).select(*others, count)
