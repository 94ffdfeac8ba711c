"""Keyed surrogates for personal data, type-consistent, distinct and coreferent over the corpus.

Entities (e-mail, phone, IP address, card number, titled name) get surrogates drawn from a keyed
hash of type, canonical form and attempt. Formats stay, but for later attempts: the same length, separators and letter case,
a valid check digit where there was one, the calling code of an international number, octets in range, names of the title's gender and the name's
script. All distinct entities are checked together: a surrogate that another entity also got, or that
is itself an entity of the corpus, is drawn again with the next attempt until none is left, so
different entities never merge and one entity reads the same everywhere. Later attempts draw from more
forms (names of more syllables, longer local parts, at last longer phone numbers), so that there is
always a free one; only IP addresses, whose number is bounded, can run out.

A titled name is the whole run of name words behind the title: any capital and letters of any script,
inner capitals, apostrophes, hyphens, initials, and particles between or before them. Mentions of one text with the
same surname are one entity if neither their titles' genders nor their given names differ, so 'Mr John
Smith', 'Dr John Smith' and 'Mr Smith' share a surrogate; a bare surname goes to the person named last.
Later mentions without a title follow, with or without the given names. A name's surrogate is a given
name (if there was one) and a surname, however many words were there.

Only texts that a cheap native test lets through are shuffled, to meet their replacements.

Defined cases: null text stays null with no entities; repeated rows are rewritten each; an empty
table gives an empty result; other columns are ignored. Replaced texts keep everything else.
"""

from __future__ import annotations

import hashlib
import hmac
import re
import unicodedata
from itertools import count

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Workspace, give_back

KINDS = ("email", "phone", "ip", "card", "name")
SALTS = 8
MALE, FEMALE = ("Mr", "Herr", "Señor", "Monsieur", "г-н"), ("Mrs", "Ms", "Miss", "Frau", "Señora", "Mme", "Madame", "г-жа")
#: Titles, and given names by script and gender (either for titles that tell none).
TITLES = {**dict.fromkeys(MALE, "m"), **dict.fromkeys(FEMALE, "f"), "Dr": "n", "Prof": "n"}
GIVEN = {
    "latin": {"m": ("Adam", "Bruno", "Carl", "Erik", "Hugo", "Jonas", "Leon", "Martin", "Oscar", "Victor"), "f": ("Alma", "Clara", "Edith", "Greta", "Helena", "Julia", "Laura", "Maria", "Nora", "Vera")},
    "cyrillic": {"m": ("Антон", "Борис", "Глеб", "Иван", "Олег", "Павел"), "f": ("Анна", "Вера", "Дарья", "Ирина", "Нина", "Ольга")},
}
SYLLABLES = {"latin": ("ba", "den", "fer", "gol", "har", "kel", "lin", "mar", "nor", "pas", "ren", "sol", "tor", "vin", "wes", "zan"), "cyrillic": ("бар", "вин", "гор", "дан", "зов", "кел", "лин", "мар", "нев", "пас", "рен", "сол", "тор", "фен", "хар", "цев")}

def _ranges(*categories: str) -> str:
    """Characters of Unicode categories, as the inside of a character class."""
    of = [c for c in range(0x20000) if unicodedata.category(chr(c)) in categories]
    starts = [c for c, before in zip(of, [-9, *of], strict=False) if c != before + 1]
    ends = [c for c, after in zip(of, [*of[1:], -9], strict=True) if c + 1 != after]
    return "".join(f"{chr(a)}-{chr(b)}" for a, b in zip(starts, ends, strict=True))


PARTICLES = tuple("af al auf bin da das de del della den der des di dos du el ibn la le ten ter van vom von y zu zum zur".split())
_UPPER = f"[{_ranges('Lu', 'Lt')}]"
_LETTER = r"(?:[^\W\d_][\u0300-\u036f]*)"
#: Letters with inner apostrophes and hyphens, or an initial; an English genitive stays outside.
_WORD = rf"(?:(?:[^\W\d_]{{1,2}}['’])?{_UPPER}[\u0300-\u036f]*(?:\.(?= )|{_LETTER}*(?:(?!['’]s(?!\w))['’-]{_LETTER}+)*))"
_PARTICLES = rf"(?:(?:{'|'.join(PARTICLES)}) )*"
_NAME = rf"{_PARTICLES}{_WORD}(?: {_PARTICLES}{_WORD})*"
PATTERN = re.compile(
    rf"(?P<email>(?<![\w.+-])[\w.+-]+@[\w-]+(?:\.[\w-]+)+)"
    rf"|(?P<ip>(?<![\d.])(?:25[0-5]|2[0-4]\d|1?\d?\d)(?:\.(?:25[0-5]|2[0-4]\d|1?\d?\d)){{3}}(?![\d]|\.\d))"
    rf"|(?P<card>(?<![\d-])(?:\d{{13,19}}|\d{{4}}(?:[ -]\d{{4}}){{3}})(?![\d]))"
    rf"|(?P<phone>(?<![\w+])(?:\+\d{{1,3}}[ .-]?\(?\d{{2,4}}\)?(?:[ .-]?\d{{2,4}}){{2,4}}|\(\d{{3}}\) ?\d{{3}}-\d{{4}}|\d{{3}}-\d{{3}}-\d{{4}})(?!\d))"
    rf"|(?P<name>(?<!\w)(?P<title>{'|'.join(map(re.escape, sorted(TITLES, key=len, reverse=True)))})\.? (?P<who>{_NAME}))"
)
#: What a text must hold to have any entity, in Java's syntax. The first characters of all cases are one
#: class, which the matcher passes over quickly; then each case looks back at its own.
MAYBE = r"[@+\p{Nd}MHFSDPг](?:(?<=@)|(?<=\+)\p{Nd}|(?<=\p{Nd})(?:\p{Nd}\p{Nd}|\.\p{Nd}+\.)|" + "|".join(f"(?<={t[0]}){t[1:]}\\.? " for t in TITLES) + ")"


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


#: Country calling codes of one and two digits; all others have three.
CODES = ("1", "7", *"20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split())


def country_code(digits: str) -> str:
    """The calling code that an international number begins with."""
    return next((digits[:n] for n in (1, 2) if digits[:n] in CODES), digits[:3])


def canonical(kind: str, m: re.Match) -> str:
    """The form that all mentions of an entity share: plain digits, those of international numbers behind a plus sign."""
    text = m[kind]
    if kind in ("phone", "card"):
        return "+" * text.startswith("+") + "".join(str(unicodedata.digit(c)) for c in text if c.isdigit())
    if kind == "name":
        return f"{TITLES[m['title']]} {' '.join(_words(m['who']))}"
    return text.lower()


def _words(who: str) -> list[str]:
    """Given names and surname, without particles."""
    return [w for w in who.split(" ") if w not in PARTICLES]


def _agree(a: list[str], b: list[str]) -> bool:
    """Whether the shorter list of given names may be some of the longer one's, by their initials too."""
    a, b = sorted((a, b), key=len)
    rest = iter(b)
    return all(any(x == y or (x[0] == y[0] and "." in (x[-1], y[-1])) for y in rest) for x in a)


def mentions(text: str) -> list[tuple[re.Match, str, str]]:
    """Match, kind and form of each entity's mention; titled names are those of their person in this text."""
    found = [(m, k, canonical(k, m)) for m in PATTERN.finditer(text) for k in KINDS if m[k]]
    person: dict[int, list] = {}  # gender, given names, surname
    same: dict[str, list] = {}
    for i, (_, kind, form) in enumerate(found):
        if kind == "name":
            gender, *given, surname = form.split(" ")
            same.setdefault(surname, []).append((i, gender, given))

    def meet(gender: str, given: list[str], surname: str, near: list[list]) -> list:
        for p in near:
            if (gender == p[0] or "n" in (gender, p[0])) and _agree(given, p[1]):
                p[0] = gender if p[0] == "n" else p[0]
                p[1] = max(p[1], given, key=lambda g: (len(g), len("".join(g))))
                return p
        return [gender, given, surname]

    for surname, named in same.items():
        people: list[list] = []
        for i, gender, given in named:
            if given:
                person[i] = meet(gender, given, surname, people[::-1])
                people += [person[i]] if person[i] not in people else []
        recent: list[list] = []
        for i, gender, given in named:
            if not given:  # the person named last before, or else the first behind
                person[i] = meet(gender, given, surname, recent + [p for p in people if p not in recent])
            recent = [person[i], *(p for p in recent if p is not person[i])]
    return [(m, k, " ".join([person[i][0], *person[i][1], person[i][2]]) if i in person else f) for i, (m, k, f) in enumerate(found)]


class Draw:
    """An endless keyed stream of small numbers."""

    def __init__(self, key: bytes, *what):
        self.key, self.what, self.n, self.left = key, "\0".join(map(str, what)).encode(), 0, b""

    def below(self, n: int) -> int:
        if len(self.left) < 4:
            self.left += hmac.new(self.key, self.what + b"\0%d" % self.n, hashlib.sha256).digest()
            self.n += 1
        value, self.left = int.from_bytes(self.left[:4], "big"), self.left[4:]
        return value % n


def _script(text: str) -> str:
    return "cyrillic" if re.search(r"[А-Яа-яЁё]", text) else "latin"


def surrogate(key: bytes, kind: str, form: str, attempt: int) -> str:
    d = Draw(key, kind, form, attempt)
    digit = lambda: str(d.below(10))
    if kind == "phone":
        keep = 1 + len(country_code(form[1:])) if form.startswith("+") else 0
        return form[:keep] + "".join(digit() for _ in form[keep:]) + "".join(digit() for _ in range(attempt // 8))
    if kind == "card":
        body = form[0] + "".join(digit() for _ in form[1:-1])
        return body + next(c for c in "0123456789" if luhn(body + c) == luhn(form)) if luhn(form) else body + digit()
    if kind == "ip":
        return ".".join(str(1 + d.below(254)) for _ in form.split("."))
    if kind == "email":
        local, domain = form.split("@", 1)
        top = domain.rfind(".")
        swap = lambda s, r: "".join(digit() if c.isdigit() else (chr((1072 if "а" <= c <= "я" else 97) + r.below(26)) if c.isalpha() else c) for c in s)
        # the domain's surrogate depends on the domain alone: colleagues stay colleagues
        return swap(local + "a" * (attempt // 3), d) + "@" + _domain(key, domain[:top], attempt) + domain[top:]
    gender, who = form.split(" ", 1)
    script = _script(who)
    names = GIVEN[script]["mf"[d.below(2)] if gender == "n" else gender]
    family = "".join(SYLLABLES[script][d.below(16)] for _ in range(3 + d.below(2) + attempt // 2)).capitalize()
    return f"{names[d.below(len(names))]} {family}" if " " in who else family


def _domain(key: bytes, name: str, attempt: int) -> str:
    d = Draw(key, "domain", name, 0)
    return "".join(str(d.below(10)) if c.isdigit() else (chr(97 + d.below(26)) if c.isalpha() else c) for c in name)


def render(kind: str, mention: str, form: str) -> str:
    """The surrogate in the mention's format: its separators, its letter case."""
    if kind in ("phone", "card"):
        it = iter(form.removeprefix("+"))
        return "".join(next(it) if c.isdigit() else c for c in mention) + "".join(it)
    if kind == "email" and len(mention) != len(form):
        return form.upper() if mention.isupper() else form
    if kind == "email":
        return "".join(f.upper() if c.isupper() else f for c, f in zip(mention, form, strict=True))
    return form


def rewrite(text: str, forms: dict[tuple[str, str], str]) -> tuple[str, dict[str, int]]:
    counts = dict.fromkeys(KINDS, 0)
    found = mentions(text)
    latest: dict[str, tuple[str, str]] = {}  # surname: form and surrogate of the person named last, at first the first
    given: dict[str, set[str]] = {}
    for _, kind, form in found:
        if kind == "name":
            who = form[2:].split(" ")
            latest.setdefault(who[-1], (form, forms[kind, form]))
            given.setdefault(who[-1], set()).update(who[:-1])
    either = lambda xs: "|".join(map(re.escape, sorted(xs, key=lambda x: (-len(x), x))))
    one = [rf"(?P<g{i}>(?:(?:{either(given[w])}) )*){_PARTICLES}(?P<s{i}>{re.escape(w)})" if given[w] else rf"{_PARTICLES}(?P<s{i}>{re.escape(w)})" for i, w in enumerate(sorted(latest, key=lambda x: (-len(x), x)))]
    untitled = re.compile(rf"(?<!\w)(?:{'|'.join(one)})(?!\w)") if one else None

    def later(m: re.Match) -> str:
        i = m.lastgroup[1:]
        form, new = latest[m["s" + i]]
        return new if m.groupdict().get("g" + i) else new.split(" ")[-1]

    out, at = [], 0
    for m, kind, form in found:
        between = text[at : m.start()]
        out.append(untitled.sub(later, between) if untitled else between)
        counts[kind] += 1
        new = forms[kind, form]
        if kind == "name":
            who = form[2:].split(" ")
            latest[who[-1]] = form, new
            out.append(m[0][: m.start("who") - m.start()] + (new if len(_words(m["who"])) > 1 else new.split(" ")[-1]))
        else:
            out.append(render(kind, m[kind], new))
        at = m.end()
    out.append(untitled.sub(later, text[at:]) if untitled else text[at:])
    return "".join(out), counts


def _entities(batches):
    import pyarrow as pa

    for batch in batches:
        rows = []
        for key, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            found = {(k, f) for _, k, f in mentions(text.as_py())}
            rows += [(key, k, f) for k, f in sorted(found)]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int64(), pa.string(), pa.string()))], ["row_key", "kind", "form"])


def _drawn(key: bytes):
    def run(batches):
        import pyarrow as pa

        for batch in batches:
            kind, form, attempt = (batch.column(i).to_pylist() for i in range(3))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([surrogate(key, *x) for x in zip(kind, form, attempt, strict=True)], pa.string())], ["kind", "form", "attempt", "surrogate"])

    return run


def surrogates(entities: DataFrame, key: bytes, ws: Workspace) -> DataFrame:
    """kind, form, surrogate for distinct entities (kind, form): all surrogates differ and none is an entity."""
    given = entities.select("kind", "form", F.lit(0).alias("attempt"))
    for i in count():
        if i == 40 and 2 * entities.filter("kind = 'ip'").count() > 254**4:  # a surrogate for each and none an entity
            raise RuntimeError("more IP addresses than could get distinct surrogates")
        drawn = ws.save(given.mapInArrow(_drawn(key), "kind string, form string, attempt int, surrogate string"), f"drawn-{i}")
        real = entities.select("kind", F.col("form").alias("surrogate")).withColumn("real", F.lit(True))
        # names clash by what is read, whatever the gender that their form notes
        real = real.withColumn("surrogate", F.when(F.col("kind") == "name", F.substring("surrogate", 3, 10_000)).otherwise(F.col("surrogate"))).distinct()
        first = drawn.groupBy("kind", "surrogate").agg(F.min(F.struct("attempt", "form")).alias("first"), F.count(F.lit(1)).alias("n"))
        clash = first.join(real, ["kind", "surrogate"], "left").filter("n > 1 OR real").select("kind", "surrogate", F.coalesce("real", F.lit(False)).alias("real"), F.col("first.form").alias("keeper"))
        clash = ws.save(clash, f"clash-{i}")
        if clash.isEmpty():
            return drawn.select("kind", "form", "surrogate")
        bad = drawn.join(clash, ["kind", "surrogate"], "left")
        given = bad.select("kind", "form", (F.col("attempt") + F.when(F.col("keeper").isNotNull() & (F.col("real") | (F.col("form") != F.col("keeper"))), 1).otherwise(0)).alias("attempt"))
    raise RuntimeError("no distinct surrogates: too few forms of one kind are free")


def replace_personal(docs: DataFrame, key: bytes = b"loamlearn", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text, n_email, n_phone, n_ip, n_card, n_name: every row, its personal data replaced."""
    ws = Workspace(docs.sparkSession, "pii")
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    maybe = F.coalesce(F.col("text").rlike(MAYBE), F.lit(False))
    keyed = rows.filter(maybe).withColumn("row_key", F.xxhash64("doc_id", "text"))
    found = ws.save(keyed.select("row_key", "text").mapInArrow(_entities, "row_key long, kind string, form string").distinct(), "found")
    forms = surrogates(found.select("kind", "form").distinct(), key, ws)
    # an entity of a third of all texts meets its surrogate in SALTS tasks
    forms = forms.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    per = found.withColumn("salt", F.pmod("row_key", F.lit(SALTS)).cast("int")).join(forms, ["kind", "form", "salt"]).groupBy("row_key").agg(F.collect_list(F.struct("kind", "form", "surrogate")).alias("forms"))
    names = ["doc_id", "text", *(f"n_{k}" for k in KINDS)]
    none = [F.lit(0).cast("long").alias(n) for n in names[2:]]
    schema = f"doc_id {docs.schema[id_col].dataType.simpleString()}, text string, " + ", ".join(f"{n} long" for n in names[2:])

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            texts, counts = [], []
            for text, forms in zip(batch.column(1), batch.column(2), strict=True):
                got, n = rewrite(text.as_py(), {(x["kind"], x["form"]): x["surrogate"] for x in forms.as_py() or ()})
                texts.append(got)
                counts.append(n)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string()), *[pa.array([n[k] for n in counts], pa.int64()) for k in KINDS]], names)
        give_back()

    met = keyed.join(per, "row_key", "left").select("doc_id", "text", "forms").mapInArrow(run, schema)
    return met.unionByName(rows.filter(~maybe).select("doc_id", "text", *none))
