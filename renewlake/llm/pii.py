"""Surrogates for personal data: keyed, of the same type and format, distinct, the same for every mention."""

from __future__ import annotations

import hashlib
import hmac
import re
from bisect import bisect_left

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from renewlake.llm.common import prepared, stored, texts_of

BROADCAST_MENTIONS = 200_000
PLAIN_ROUNDS = 12  # after so many collisions a surrogate may grow by a sign, an address may have any

# Types in order of precedence where matches overlap; a group named v is the part to replace (fixed patterns).
PATTERNS = (
    ("email", r"[A-Za-z0-9][A-Za-z0-9._%+\-]{0,63}@[A-Za-z0-9\-]{1,63}(?:\.[A-Za-z0-9\-]{1,63}){1,8}"),
    ("secret", r"(?i:password|passwd|secret|token|api[_\-]?key)\s{0,3}[=:]\s{0,3}[\"']?(?P<v>[A-Za-z0-9_\-+/][A-Za-z0-9_\-+/=.~]{6,}[A-Za-z0-9_\-+/=~])"),
    ("access_key", r"(?<![A-Za-z0-9])(?:AKIA|ASIA)(?P<v>[A-Z0-9]{16})(?![A-Za-z0-9])"),
    ("iban", r"(?<![A-Za-z0-9])[A-Z]{2}(?P<v>\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?)(?![A-Za-z0-9])"),
    ("card", r"(?<![\w.+\-])\d(?:[ \-]?\d){12,18}(?![\w\-])"),
    ("ssn", r"(?<![\w\-])\d{3}-\d{2}-\d{4}(?![\w\-])"),
    ("ipv4", r"(?<![\w.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?![\w]|\.\d)"),
    ("phone", r"(?<![\w.])(?:\+(?P<c>\d{1,3})[ .\-]?)?\(\d{2,4}\)[ .\-]?\d{3,4}[ .\-]?\d{3,4}(?![\w\-])"
              r"|(?<![\w.])\+\d{1,3}(?:[ .\-]?\d{2,4}){2,4}(?![\w\-])"
              r"|(?<![\w.\-])\d{3}[.\-]\d{3}[.\-]\d{4}(?![\w\-])"),
)

# Titles that name a person, by the gender they tell (fixed values).
TITLES = {
    "m": "Mr Mister Sir Herr Monsieur Señor Sr господин",
    "f": "Mrs Ms Miss Madam Frau Madame Mme Mlle Señora Señorita Sra госпожа",
    "x": "Dr Prof Professor",
}
GENDER = {title.lower(): gender for gender, titles in TITLES.items() for title in titles.split()}
NAME = r"(?:[A-ZÀ-ÖØ-Þ][a-zà-öø-ÿ]{1,30}|[А-ЯЁ][а-яё]{1,30})(?:-(?:[A-ZÀ-ÖØ-Þ][a-zà-öø-ÿ]{1,30}|[А-ЯЁ][а-яё]{1,30}))?"
PERSON = re.compile(rf"(?<!\w)(?P<t>{'|'.join(t for ts in TITLES.values() for t in ts.split())})\.? (?P<v>{NAME}(?: {NAME}){{0,2}})(?!\w)")

# Sounds that surrogate names are made of, by script (fixed values).
SOUNDS = {"latin": ("b c d f g k l m n p r s t v".split(), "a e i o u".split()),
          "cyrillic": ("б в г д к л м н п р с т".split(), "а е и о у".split())}
ENDS = {"latin": {"m": "on", "f": "ia", "x": "el"}, "cyrillic": {"m": "он", "f": "ия", "x": "ел"}}


DIGIT = re.compile(r"\d")
WORD = re.compile(r"\w+")
DRAWS = 512  # signs that are drawn from one number: dividing a longer one takes the square of its length


def _compiled():
    return [(kind, re.compile(pattern)) for kind, pattern in PATTERNS]


def _luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def canonical(kind: str, mention: str) -> str:
    """What all mentions of one entity have in common."""
    if kind == "email":
        return mention.lower()
    if kind in ("card", "iban", "ssn"):
        return re.sub(r"[^A-Za-z0-9]", "", mention)
    if kind == "phone":
        return re.sub(r"\D", "", mention)
    return mention.lower() if kind.startswith("name_") else mention


def find_entities(text: str, patterns) -> list[tuple[int, int, str, str]]:
    """(start, end, type, canonical form) in order; of matches that overlap the earlier type's stays."""
    starts: list[int] = []
    taken: list[tuple[int, int, str, str]] = []

    def add(a: int, b: int, kind: str) -> None:
        i = bisect_left(starts, a)
        if (i and taken[i - 1][1] > a) or (i < len(taken) and taken[i][0] < b):
            return
        starts.insert(i, a)
        taken.insert(i, (a, b, kind, canonical(kind, text[a:b])))

    for kind, pattern in patterns:
        if _may(kind, text):
            for m in pattern.finditer(text):
                add(*(m.span("v") if "v" in pattern.groupindex else m.span()), kind)
    for m in PERSON.finditer(text):
        names = list(re.finditer(r"[^\s-]+", m["v"]))
        for i, name in enumerate(names):  # a first name has the title's gender, the last name none
            kind = f"name_{GENDER[m['t'].lower()]}" if i < len(names) - 1 else "name_x"
            add(m.start("v") + name.start(), m.start("v") + name.end(), kind)
    # Other mentions of a name that a title told, as written there or in capitals.
    known: dict[str, str] = {}
    for a, b, kind, _ in taken:
        if kind.startswith("name_") and text[a:b].lower() not in GENDER:
            known.setdefault(text[a:b], kind)
            known.setdefault(text[a:b].upper(), kind)
    if known:
        for m in WORD.finditer(text):
            if m[0] in known:
                add(*m.span(), known[m[0]])
    return taken


def _may(kind: str, text: str) -> bool:
    """A quick look whether a type can occur at all."""
    if kind == "email":
        return "@" in text
    if kind == "secret":
        return "=" in text or ":" in text
    if kind == "access_key":
        return "AKIA" in text or "ASIA" in text
    return DIGIT.search(text) is not None


def surrogate(key: bytes, kind: str, entity: str, tries: int) -> str:
    """A keyed stand-in of the same type and format: signs of the same class in the same places."""
    seed = hmac.new(key, f"{kind}\0{entity}\0{tries}".encode(), hashlib.sha256).digest()
    drawn = int.from_bytes(hashlib.shake_256(seed).digest(min(len(entity), DRAWS) * 2 + 32), "big")
    picks = 0

    def pick(n: int) -> int:
        nonlocal drawn, picks
        if picks and picks % DRAWS == 0:
            drawn = int.from_bytes(hashlib.shake_256(seed + str(picks).encode()).digest(DRAWS * 2 + 32), "big")
        picks += 1
        drawn, out = divmod(drawn, n)
        return out

    grow = max(0, tries - PLAIN_ROUNDS)
    if kind.startswith("name_"):
        script = "cyrillic" if re.match(r"[а-яё]", entity) else "latin"
        hard, soft = SOUNDS[script]
        size = max(4, len(entity)) + grow
        body = "".join((hard, soft)[i % 2][pick(len((hard, soft)[i % 2]))] for i in range(size - 2))
        end = ENDS[script][kind[-1]]
        return body + (end if body[-1] in hard else hard[pick(len(hard))] + end)
    if kind == "ipv4":
        if grow:  # octets of any length
            return ".".join(str(pick(256)) for _ in range(4))
        return ".".join(str((pick(10), 10 + pick(90), 100 + pick(156))[len(part) - 1]) for part in entity.split("."))
    chars = []
    hexes = kind == "secret" and re.fullmatch(r"[0-9a-f]+", entity) is not None
    keep = entity.rfind(".") if kind == "email" else len(entity)  # the top-level domain stays
    for i, c in enumerate(entity):
        if i > keep or not c.isalnum() or not c.isascii():
            chars.append(c)
        elif c.isdigit():
            first = kind == "phone" and (i == 0 or len(entity) == 11 and i == 1)
            chars.append(c if kind == "phone" and i == 0 and len(entity) > 10 else str(2 + pick(8) if first else pick(10)))
        else:
            letters = "abcdef" if hexes else "abcdefghijklmnopqrstuvwxyz"
            letter = letters[pick(len(letters))]
            chars.append(letter if c.islower() else letter.upper())
    out = "".join(chars)
    if hexes:
        out = "".join("0123456789abcdef"[pick(16)] for _ in entity)
    if kind == "card":  # as valid, or as invalid, as the original
        last = next(d for d in "0123456789" if _luhn(out[:-1] + d))
        out = out[:-1] + (last if _luhn(entity) else str((int(last) + 1 + pick(9)) % 10))
    if grow:
        extra = "".join(str(pick(10)) for _ in range(grow))
        out = extra + out if kind == "email" else out + extra
    return out


def rendered(mention: str, stand_in: str, kind: str) -> str:
    """The surrogate in the mention's own writing: its separators, and its capitals for names and mail."""
    if kind in ("card", "iban", "ssn", "phone"):
        signs, out = iter(stand_in), []
        for c in mention:
            out.append(next(signs, "") if c.isalnum() else c)
        return "".join(out) + "".join(signs)
    if kind.startswith("name_"):
        return stand_in.upper() if mention.isupper() else stand_in[:1].upper() + stand_in[1:]
    if kind == "email" and len(stand_in) == len(mention):
        return "".join(s.upper() if c.isupper() else s for c, s in zip(mention, stand_in))
    return stand_in


def _surrogates(key: bytes):
    def run(batches):
        for batch in batches:
            kinds, entities, tries = (c.to_pylist() for c in batch.columns)
            made = [surrogate(key, k, e, t) for k, e, t in zip(kinds, entities, tries)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(made, pa.string())],
                                             names=["kind", "entity", "tries", "stand_in"])

    return run


def surrogate_table(entities: DataFrame, key: bytes) -> DataFrame:
    """(kind, entity, tries, stand_in): one surrogate per distinct entity, no two alike, none a real entity.

    Every entity draws; of those that drew alike the one that drew first, then the smallest,
    keeps its draw; the others, and those that drew the text of a real entity, draw again.
    """
    spec = "kind string, entity string, tries int, stand_in string"
    real = stored(entities.select("kind", "entity").distinct(), "entities")
    now = stored(real.withColumn("tries", F.lit(0)).mapInArrow(_surrogates(key), spec), "surrogates")
    kinds = F.when(F.col("kind").startswith("name_"), F.lit("name")).otherwise(F.col("kind"))
    taken = real.select(kinds.alias("sort"), F.col("entity").alias("stand_in")).distinct()
    while True:
        sorted_now = now.withColumn("sort", kinds)
        first = sorted_now.groupBy("sort", "stand_in").agg(
            F.min(F.struct("tries", "kind", "entity")).alias("w"), F.count(F.lit(1)).alias("n"))
        twice = first.where("n > 1").select("sort", "stand_in", "w")
        losers = (sorted_now.join(twice, ["sort", "stand_in"]).where("kind != w.kind or entity != w.entity")
                  .select("kind", "entity", "tries"))
        unreal = sorted_now.join(taken, ["sort", "stand_in"], "left_semi").select("kind", "entity", "tries")
        again = stored(losers.unionAll(unreal).distinct(), "collisions")
        if again.isEmpty():
            return now
        fresh = again.withColumn("tries", F.col("tries") + 1).mapInArrow(_surrogates(key), spec)
        now = stored(now.join(again.select("kind", "entity"), ["kind", "entity"], "left_anti").select(
            "kind", "entity", "tries", "stand_in").unionByName(fresh), "surrogates")


def replace_pii(docs: DataFrame, key: bytes, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_entities, kinds, text): every detected entity of the whole text replaced by its surrogate.

    Types: e-mail, secrets after a name and a sign (of any length, up to the first sign that
    no token has), access keys, IBAN, card and social security numbers, IPv4, phone numbers,
    and names after a title, with all other mentions of such a name in the same text, as
    written or in capitals. A surrogate depends on a
    secret key, the type and the entity alone, so all mentions everywhere get the same one;
    `surrogate_table` keeps them distinct. It has the entity's format: digits for digits,
    letters for letters, the mention's separators and capitals, valid check digits for valid
    ones, a name in the same script that ends as the title's gender wants.

    Defined cases: a null or empty text has no entities and gives ''; repeated rows are replaced
    alike; rows with a null doc_id are replaced too; texts without entities stay as they are; an
    empty table gives an empty table; further columns are ignored.
    """
    spark = prepared(docs.sparkSession)
    rows = texts_of(docs, id_col, text_col).withColumn("text_hash", F.xxhash64("text"))
    kind = pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32()), ("kind", pa.string()), ("entity", pa.string())]))
    schema = "doc_id long, text_hash long, spans array<struct<a:int,b:int,kind:string,entity:string>>"

    def detect(batches):
        patterns = _compiled()
        for batch in batches:
            found = [find_entities(t or "", patterns) for t in batch.column(2).to_pylist()]
            keep = [i for i, f in enumerate(found) if f]
            if keep:
                spans = [[{"a": a, "b": b, "kind": k, "entity": e} for a, b, k, e in found[i]] for i in keep]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(keep)), batch.column(1).take(pa.array(keep)), pa.array(spans, kind)],
                    names=["doc_id", "text_hash", "spans"])

    # The same text in several rows has the same entities: one row of spans per text is enough.
    found = stored(rows.select("doc_id", "text_hash", "text").mapInArrow(detect, schema).select(
        F.coalesce("doc_id", F.lit(0)).alias("of_doc"), F.col("doc_id").isNull().alias("no_id"), "text_hash",
        F.explode("spans").alias("s")).select("of_doc", "no_id", "text_hash", "s.*").distinct(), "mentions")
    table = surrogate_table(found.select("kind", "entity"), key)
    named = found.join(table, ["kind", "entity"])
    per_doc = named.groupBy("of_doc", "no_id", "text_hash").agg(
        F.sort_array(F.collect_list(F.struct("a", "b", "kind", "stand_in"))).alias("spans"))
    per_doc = stored(per_doc, "replacements")
    if found.count() <= BROADCAST_MENTIONS:  # beyond, texts are shuffled
        per_doc = F.broadcast(per_doc)
    keyed = rows.select("doc_id", F.coalesce("doc_id", F.lit(0)).alias("of_doc"), F.col("doc_id").isNull().alias("no_id"),
                        "text_hash", "text")
    marked = keyed.join(per_doc, ["of_doc", "no_id", "text_hash"], "left").select("doc_id", "text", "spans")

    def replace(batches):
        for batch in batches:
            counts, kinds, texts = [], [], []
            for text, spans in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                parts, at, text = [], 0, text or ""
                for s in spans or ():
                    parts += [text[at: s["a"]], rendered(text[s["a"]: s["b"]], s["stand_in"], s["kind"])]
                    at = s["b"]
                counts.append(len(spans or ()))
                kinds.append(sorted({s["kind"] for s in spans or ()}))
                texts.append("".join([*parts, text[at:]]))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(counts, pa.int64()), pa.array(kinds, pa.list_(pa.string())),
                 pa.array(texts, pa.string())], names=["doc_id", "n_entities", "kinds", "text"])

    return marked.mapInArrow(replace, "doc_id long, n_entities long, kinds array<string>, text string")
