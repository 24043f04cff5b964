"""Personal data: keyed, type-consistent surrogates.

Every mention of an entity is replaced by a surrogate that a secret key and
the entity's canonical form determine, so the same person, number or address
gets the same surrogate in every document (coreference).  Surrogates keep the
mention's format (separators, case, length, country code, issuer digit, check
digits), names also gender and script.  Distinctness is checked over the whole
corpus: a surrogate must neither equal another entity's nor occur as an
original; the entities that lose try again with the next attempt number until
all are settled.

Only entities whose attempt is not zero have to be told to the tasks, as the
rest follows from the key.  Texts are not shuffled while what those few
documents need is small enough to broadcast (``MAX_BROADCAST`` bytes, measured
before).

What counts: card numbers are 16 digits, or 13 to 19 with a right check digit,
not behind a decimal point; an SSN with blanks and a dotted quad need their
neighbourhood (a label, no "version"); a name is what follows a title or begins
with a known given name, and, once a document has named somebody so, every
later bare mention of that surname in it.
"""

from __future__ import annotations

import hashlib
import hmac
import re

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxelloom.llm.common import fresh, query, table, whole_text
from voxelloom.session import cut

MAX_BROADCAST = 32 << 20
DEMO_KEY = b"replace-me"  # for tests and the registered query; a real run passes its own

#: Letters of an address before its ``@``, and what follows it; lengths are those the format allows.
LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
DOMAIN = re.compile(r"(?:[A-Za-z0-9-]{1,63}\.){1,8}[A-Za-z]{2,63}")
#: Where a number may stand; whether one does is judged match by match.
WINDOW = re.compile(r"[+(]?\d[\d()., :-]*\d")
NUMBER = re.compile(
    r"(?:(?P<ip>(?<![\w@.])\d{1,3}(?:\.\d{1,3}){3}(?!\.?\d))"
    r"|(?P<phone>(?<![\w@])(?:\+1[ .-]?\(?\d{3}\)?[ .-]?\d{3}[ .-]?\d{4}(?!\d)|\+\d{1,3}(?:[ .-]?\(?\d{2,4}\)?){2,4}(?!\d)))"
    r"|(?P<ssn>(?<![\w@])\d{3}(?:-\d{2}-|\x20\d{2}\x20)\d{4})"
    r"|(?P<card>(?<![\w@.])(?:\d{13,19}|\d{4}(?:[ -]\d{4}){3}|\d{4}[ -]\d{6}[ -]\d{5}))"
    r"|(?P<local>(?:(?<!\d)\(\d{3}\) ?|(?<![\w@])\d{3}[ .-])\d{3}[ .-]\d{4}))(?!\w)")
IBAN = re.compile(r"\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?\b")
IBAN_START = re.compile(r"[A-Z]{2}\d{2} ?[A-Z0-9]{4}")
IPV6 = re.compile(r"(?<![\w:.])(?:(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}|(?:[0-9A-Fa-f]{1,4}:){1,6}(?::[0-9A-Fa-f]{1,4}){1,6})(?![\w:])")
MAC = re.compile(r"\b[0-9A-Fa-f]{2}(?::[0-9A-Fa-f]{2}){5}\b")

# Pools of common names, by script and gender; public knowledge, in no way complete.
GIVEN = {
    ("latin", "f"): "Alice Amelia Anna Carmen Charlotte Claire Clara Elena Emily Emma Greta Helen Isabel Julia Katherine Laura Louise Lucia Margaret Maria Martha Olivia Rosa Sarah Sophie Teresa".split(),
    ("latin", "m"): "Albert Alexander Andrew Antoine Carlos Charles Daniel David Edward Felix Francisco George Henry James John Joseph Lukas Martin Michael Miguel Oliver Pablo Paul Peter Robert Thomas William".split(),
    ("cyrillic", "f"): "Анна Вера Дарья Екатерина Елена Ирина Мария Наталья Ольга Светлана Софья Татьяна".split(),
    ("cyrillic", "m"): "Александр Алексей Борис Владимир Дмитрий Иван Михаил Николай Олег Павел Сергей Юрий".split(),
    ("greek", "f"): "Αγγελική Βασιλική Δήμητρα Ελένη Ιωάννα Κατερίνα Μαρία Σοφία".split(),
    ("greek", "m"): "Αλέξανδρος Βασίλης Γιώργος Δημήτρης Κώστας Νίκος Παύλος Χρήστος".split(),
}
SURNAMES = {
    "latin": "Adams Bauer Baker Becker Bernard Carter Castillo Clarke Dubois Fischer Foster Garcia Hughes Keller Lambert Lopez Marchand Mason Moreau Navarro Palmer Romero Schneider Turner Vogel Wagner Walker Weber".split(),
    "cyrillic": "Белов Волков Зайцев Козлов Лебедев Морозов Новиков Орлов Павлов Соколов Тихонов Фёдоров".split(),
    "greek": "Αλεξίου Βλάχος Γεωργίου Δημητρίου Ιωάννου Καραγιάννης Νικολάου Παππάς".split(),
}
SYLLABLES = {
    "latin": "al ben cor dan el far gar hol im jor kel lan mor nel or pen ros sel tan ul ver wil".split(),
    "cyrillic": "ал бор вел гор дан ел зар кон лад мир нов ор пол род сав тан".split(),
    "greek": "αλ βασ γερ δαν ελ θεο καρ λεο μαν νικ παν σοφ".split(),
}
# Titles that tell a gender ("" for none).
TITLES = {"Mr.": "m", "Mrs.": "f", "Ms.": "f", "Miss": "f", "Dr.": "", "Prof.": "", "Herr": "m", "Frau": "f", "Monsieur": "m", "Madame": "f", "Mme": "f",
          "Señor": "m", "Señora": "f", "Sra.": "f", "господин": "m", "госпожа": "f", "κύριος": "m", "κυρία": "f"}
GENDER = {n: g for (_, g), names in GIVEN.items() for n in names}
# Words inside a name that stay as they are, and initials, which stay too.
PARTICLES = "van von de der den la le di da del dos du ter ten bin ibn al el".split()
NAME = r"[^\W\d_a-z](?:[^\W\d_]+(?:[-'’][^\W\d_]+)*|(?:[-'’][^\W\d_]+)+)"
INNER = rf"(?:(?:{'|'.join(PARTICLES)}) |[^\W\d_a-z]\. )"
TITLED = re.compile(r"(?<!\w)(%s)\.? ((?:%s){0,2}%s(?: %s{0,2}%s){0,2})" % ("|".join(re.escape(t.rstrip(".")) for t in TITLES), INNER, NAME, INNER, NAME))
GIVEN_NAMES = sorted({form for n in GENDER for form in (n, n.upper())}, key=len, reverse=True)
KNOWN = re.compile(r"(?<!\w)(%s) (?:%s{0,3}%s)" % ("|".join(map(re.escape, GIVEN_NAMES)), INNER, NAME))
GENDER_OF = {n.casefold(): g for n, g in GENDER.items()}
TITLE_GENDER = {t.rstrip("."): g for t, g in TITLES.items()}
SPELLING = {n.casefold(): n for pool in (*GIVEN.values(), *SURNAMES.values()) for n in pool}
WORDS = re.compile(rf"(?<![\w'’-]){NAME}(?![\w'’-])")
VERSION = re.compile(r"(?:\b(?:version|release|ver|build|firmware)\.?|\bv\.?)\s*$", re.IGNORECASE)


def script_of(word: str) -> str:
    c = ord(word[0])
    return "cyrillic" if 0x400 <= c < 0x530 else "greek" if 0x370 <= c < 0x400 or 0x1F00 <= c < 0x2000 else "latin"


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        total += d if i % 2 == 0 else 2 * d - 9 * (d > 4)
    return total % 10 == 0


def mentions(text: str) -> list[tuple[int, int, str, str]]:
    """(start, end, kind, canonical form) of the mentions, left to right,
    without overlaps; on the same place the longer one counts."""
    found = []
    at = text.find("@")
    while at >= 0:
        before = text[max(0, at - 64) : at]
        local, domain = len(before) - len(before.rstrip(LOCAL)), DOMAIN.match(text, at + 1)
        if local and domain:
            found.append((at - local, domain.end(), "email", text[at - local : domain.end()].lower()))
        at = text.find("@", at + 1)
    for w in WINDOW.finditer(text):
        a, b = w.span()
        if b - a < 7:
            continue
        for m in NUMBER.finditer(text, a, b + 2):  # the boundary tests see the text around the window
            kind, digits = m.lastgroup, re.sub(r"\D", "", m[0])
            if kind == "ip" and max(map(int, m[0].split("."))) > 255 or kind == "phone" and not 8 <= len(digits) <= 15:
                continue
            if kind == "ip" and VERSION.search(text[max(0, m.start() - 16) : m.start()]):
                continue
            if kind == "card" and len(digits) != 16 and not luhn(digits):
                continue
            if kind == "ssn" and " " in m[0] and not re.search(r"ssn|social", text[max(0, m.start() - 24) : m.start()], re.IGNORECASE):
                continue
            if kind in ("phone", "local"):
                kind, digits = "phone", digits[-10:] if len(digits) >= 10 else digits
            found.append((m.start(), m.end(), kind, m[0] if kind == "ip" else digits))
    if IBAN_START.search(text):
        for m in IBAN.finditer(text):
            plain = m[0].replace(" ", "")
            if 15 <= len(plain) <= 34 and mod97(plain) == 1:
                found.append((m.start(), m.end(), "iban", plain))
    if ":" in text:
        found += [(m.start(), m.end(), "mac", m[0].lower().replace(":", "")) for m in MAC.finditer(text)]
        found += [(m.start(), m.end(), "ipv6", m[0].lower()) for m in IPV6.finditer(text)]
    named = [x for m in TITLED.finditer(text) for x in names_in(m[2], m.start(2), TITLE_GENDER[m[1]])] if any(t in text for t in TITLE_GENDER) else []
    named += [x for m in KNOWN.finditer(text) for x in names_in(m[0], m.start(), GENDER_OF[m[1].casefold()])]
    found += named
    surnames: dict[str, tuple[int, str]] = {}
    for x in sorted(named):
        if x[2].startswith("surname"):
            surnames.setdefault(x[3], (x[1], x[2]))
    if surnames:  # somebody named in full goes by the bare surname later on
        for m in WORDS.finditer(text, min(end for end, _ in surnames.values())):
            known = surnames.get(m[0].casefold())
            if known and m.start() >= known[0]:
                found.append((m.start(), m.end(), known[1], m[0].casefold()))
    found.sort(key=lambda x: (x[0], -x[1]))
    out, end = [], 0
    for x in found:
        if x[0] >= end:
            out.append(x)
            end = x[1]
    return out


def names_in(words: str, at: int, gender: str):
    """The words of one person's name; the last one is the surname."""
    out = []
    parts = words.split(" ")
    for i, word in enumerate(parts):
        inflected = ":f" if script_of(word) == "cyrillic" and word.endswith(("ова", "ева", "ина")) else ""
        folded = word.casefold()
        kind = f"surname:{script_of(word)}{inflected}" if i == len(parts) - 1 else f"given:{script_of(word)}:{GENDER_OF.get(folded, gender) or 'm'}"
        if i == len(parts) - 1 or folded not in PARTICLES and not word.endswith("."):
            out.append((at, at + len(word), kind, folded))
        at += len(word) + 1
    return out


def mod97(iban: str) -> int:
    return int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97


class Draw:
    """Endless keyed choices."""

    def __init__(self, key: bytes, *what):
        self.key, self.what, self.block, self.pool = key, "\0".join(map(str, what)).encode("utf-8", "surrogatepass"), 0, b""

    def below(self, n: int) -> int:
        while True:
            if len(self.pool) < 4:
                self.pool += hmac.new(self.key, self.what + b"\0%d" % self.block, hashlib.sha256).digest()
                self.block += 1
            value, self.pool = int.from_bytes(self.pool[:4], "big"), self.pool[4:]
            if value < (1 << 32) // n * n:
                return value % n

    def like(self, c: str) -> str:
        for a, b in ("09", "az", "AZ"):
            if a <= c <= b:
                return chr(ord(a) + self.below(ord(b) - ord(a) + 1))
        return c

    def like_hex(self, place: int, more: int) -> str:
        """A hexadecimal digit, not zero at the first place of a group."""
        first = place == 0 and not more
        return "0123456789abcdef"[first + self.below(16 - first)]

    def word(self, s: str) -> str:
        return "".join(map(self.like, s))


#: Attempts before a crowded format may grow longer.
PATIENCE = 16


def surrogate(key: bytes, kind: str, canonical: str, attempt: int = 0) -> str:
    """Canonical form of the surrogate.  From ``PATIENCE`` attempts on it
    grows, so that an attempt that is free always comes."""
    d = Draw(key, kind, canonical, attempt)
    more = max(0, attempt - PATIENCE + 1)
    if kind == "email":
        local, domain = canonical.split("@")
        stem, _, top = domain.rpartition(".")
        host = Draw(key, "domain", domain)  # one surrogate per domain, whoever writes from it
        return d.word(local) + "".join(chr(97 + d.below(26)) for _ in range(more)) + "@" + host.word(stem) + "." + top
    if kind == "ip":
        out = []
        for part in canonical.split("."):
            low, high = {1: (1, 9), 2: (10, 99), 3: (100, 254)}[len(str(int(part)))] if not more else (1, 254)
            out.append(str(low + d.below(high - low + 1)))
        return ".".join(out)
    if kind == "ipv6":
        return ":".join("".join(d.like_hex(i, more) for i in range(len(group))) for group in canonical.split(":"))
    if kind == "card":
        body = canonical[0] + d.word(canonical[1:-1]) + d.word("0" * more)
        if luhn(canonical):
            return next(body + str(i) for i in range(10) if luhn(body + str(i)))
        return body + d.word("0")
    if kind == "iban":
        body = canonical[:2] + "00" + d.word(canonical[4:])
        return f"{canonical[:2]}{98 - mod97(body):02d}{body[4:]}"
    if kind == "mac":
        return "".join("0123456789abcdef"[d.below(16)] for _ in canonical)
    if kind in ("phone", "ssn"):
        first = str(2 + d.below(8)) if canonical[0] not in "01" else d.word("0")
        return first + d.word(canonical[1:]) + d.word("0" * more)
    sort, script, *gender = kind.split(":")
    pool = SURNAMES[script] if sort == "surname" else GIVEN[script, gender[0]]
    if attempt < 4:
        return pool[d.below(len(pool))].casefold() + ("а" if sort == "surname" and gender else "")
    stem = "".join(SYLLABLES[script][d.below(len(SYLLABLES[script]))] for _ in range(2 + attempt // 4))
    feminine = {"latin": "a", "cyrillic": "а", "greek": "α"}[script]
    return stem + (feminine if gender == ["f"] else "")


def dress(mention: str, kind: str, canonical: str, core: str) -> str:
    """The surrogate in the mention's format."""
    if kind in ("phone", "card", "ssn"):
        digits = [i for i, c in enumerate(mention) if c.isdigit()]
        digits = digits[len(digits) - len(canonical) :]  # a country code before them stays
        out = list(mention)
        for i, c in zip(digits, core):
            out[i] = c
        return "".join(out) + core[len(canonical) :]
    if kind == "iban":
        it = iter(core)
        return "".join(c if c == " " else next(it) for c in mention)
    if kind == "mac":
        pairs = ":".join(core[i : i + 2] for i in range(0, 12, 2))
        return pairs.upper() if mention.upper() == mention else pairs
    if kind == "ip":
        return core
    if kind == "ipv6":
        return core.upper() if mention.upper() == mention else core
    if kind == "email":
        return "".join(c.upper() if i < len(mention) and mention[i].isupper() else c for i, c in enumerate(core))
    if mention.isupper() and len(mention) > 1:
        return core.upper()
    named = SPELLING.get(core) or core.capitalize()
    return named[:-1] + "ς" if named.endswith("σ") else named


def rewrite(text: str, key: bytes, attempts: dict[tuple[str, str], int]) -> tuple[str, list[str]]:
    out, at, kinds = [], 0, []
    for a, b, kind, canonical in mentions(text):
        core = surrogate(key, kind, canonical, attempts.get((kind, canonical), 0))
        out += [text[at:a], dress(text[a:b], kind, canonical, core)]
        at = b
        kinds.append(kind.split(":")[0])
    return "".join(out) + text[at:], kinds


def space(kind: str) -> str:
    """Surrogates of one space must differ from each other and its originals."""
    return kind.split(":")[0]


def settle(entities: DataFrame, key: bytes) -> DataFrame:
    """``kind, canonical, attempt`` for the entities that can't have attempt 0.

    In each round the open entities propose; a proposal stands unless it is
    an original, is taken, or a smaller canonical form proposes the same.
    """

    def propose(batches):
        for b in batches:
            yield b.assign(core=[surrogate(key, k, c, int(n)) for k, c, n in zip(b["kind"], b["canonical"], b["attempt"])])

    schema = "kind string, canonical string, attempt int, space string, core string"
    open_ = entities.withColumn("attempt", F.lit(0)).withColumn("space", F.substring_index("kind", ":", 1))
    originals = open_.select("space", F.col("canonical").alias("core")).distinct()
    held = None
    while True:
        tried = cut(open_.mapInPandas(propose, schema))
        first = tried.groupBy("space", "core").agg(F.min(F.struct("canonical", "kind")).alias("_first"))
        free = first.join(originals, ["space", "core"], "left_anti")
        if held is not None:
            free = free.join(held.select("space", "core"), ["space", "core"], "left_anti")
        judged = cut(tried.join(free, ["space", "core"], "left").withColumn(
            "_won", F.coalesce(F.col("_first") == F.struct("canonical", "kind"), F.lit(False))).drop("_first"))
        won = judged.where("_won").drop("_won")
        held = won if held is None else cut(held.unionByName(won))
        lost = judged.where("not _won")
        if lost.isEmpty():
            return held.where("attempt > 0").select("kind", "canonical", "attempt")
        open_ = lost.select("kind", "canonical", (F.col("attempt") + 1).cast("int").alias("attempt"), "space")


def pseudonymise(docs: DataFrame, key: bytes, max_broadcast: int = MAX_BROADCAST) -> DataFrame:
    """``docs`` with mentions replaced in ``text``, plus ``pii_kinds``
    (array: the kind of each replaced mention, in order; ``pii_kinds_`` where
    the input has a column of that name).

    Null texts become empty; texts without mentions stay as they are, and
    repeated rows come out alike.
    """

    def find(batches):
        for b in batches:
            rows = [(k, kind, canonical) for k, t in zip(b["_k"], b["_text"]) for kind, canonical in dict.fromkeys((m[2], m[3]) for m in mentions(t))]
            yield pd.DataFrame(rows, columns=["_k", "kind", "canonical"])

    mark = F.xxhash64("doc_id", whole_text())  # a clash would only tell a document of an entity it hasn't got
    seen = cut(docs.select(mark.alias("_k"), whole_text().alias("_text")).mapInPandas(find, "_k long, kind string, canonical string"))
    again = settle(seen.select("kind", "canonical").distinct(), key)
    key_, again_, new_, kinds_ = fresh(docs, "_k", "_again", "_new", "pii_kinds")
    told = cut(seen.join(again, ["kind", "canonical"]).groupBy(F.col("_k").alias(key_)).agg(
        F.collect_set(F.struct("kind", "canonical", "attempt")).alias(again_)))
    size = told.agg(F.sum(64 + 2 * F.octet_length(F.to_json(again_)))).first()[0] or 0
    if size <= max_broadcast:
        told = F.broadcast(told)

    @F.pandas_udf("text string, kinds array<string>")
    def replaced(text: pd.Series, tries: pd.Series) -> pd.DataFrame:
        rows = [rewrite(t, key, {} if a is None else {(x["kind"], x["canonical"]): x["attempt"] for x in a}) for t, a in zip(text, tries)]
        return pd.DataFrame(rows, columns=["text", "kinds"])

    joined = docs.withColumn(key_, mark).join(told, key_, "left").withColumn(new_, replaced(whole_text(), F.col(again_)))
    new = F.col(new_)
    return joined.select(*[new["text"].alias("text") if c == "text" else F.col(f"`{c}`") for c in docs.columns], new["kinds"].alias(kinds_))


@query("op3_pii_surrogates")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pseudonymise(table(spark, sf_dir, "documents"), DEMO_KEY)
    return out.select("doc_id", "text", F.size("pii_kinds").alias("n_replaced"), F.array_join("pii_kinds", ",").alias("kinds"))
