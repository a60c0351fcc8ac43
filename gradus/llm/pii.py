"""PII: detected entities get keyed, type-consistent surrogates.

Detection is one pattern over the text: e-mail addresses, telephone numbers, IPv4 and IPv6
addresses, card numbers, account numbers (IBAN), social security numbers, credentials (cloud
key ids, ``password=...``, ``token = "..."``) and names behind a title. A name without a title
is not detected.

What gets a surrogate is the unit behind an entity, so that mentions in other forms corefer:
the digits of a telephone or card number, an address in lower case, the given and the family
name of a person each (``Mr John Smith`` and ``Mr Smith`` get the same family name). A surrogate
depends on a secret key (HMAC-SHA-256), the type and the unit alone, and has the mention's
format: digits for digits, letters for letters of the same case, hex for hex; card numbers
keep their first digit and carry a right check digit if theirs was right; addresses keep
their shape; names are of the gender the title tells and of its script.

Distinctness is checked over the table of distinct units: where two units meet in one
surrogate, or a surrogate is a unit that occurs, all but the first are derived again with
the next attempt number, until none is left. From ``WIDER`` attempts on, addresses, secrets,
telephone numbers and names grow by a character now and then, so crowded formats don't run out.

Only DataFrame operations. Texts without a hint of an entity (one quick scan) are passed
on as they are; only the others are searched. Texts with entities are written down once with
what was found, numbered, and joined to their surrogates by that number, as a map for each
document. The table of entities is aggregated map-side, so an entity in a third of all
documents is one row a task.

Defined results: a null text stays null; empty texts and texts without entities stay as
they are; very long texts are searched whole; rows that repeat, also with a null id, are
treated alike. Empty tables give empty results. A column of the input named ``n_entities`` is
replaced, columns that begin with ``__`` are dropped, all others are passed on.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gradus.llm.common import documents, snapshot

#: The session setting that holds the secret key, and the key of sessions without one (tests).
KEY_SETTING = "spark.gradus.pii.key"
TEST_KEY = "gradus-pii-1"
#: Attempts after which surrogates grow by a character (each so many attempts by one more).
WIDER = 8
ENTITIES_PER_TASK = 5000

# Titles by gender and script, and the names that surrogates are made of.
TITLES = {
    ("m", "latin"): ["Mr", "Herr", "Monsieur", "Señor", "Sr"],
    ("f", "latin"): ["Mrs", "Ms", "Miss", "Frau", "Madame", "Mme", "Señora", "Sra"],
    ("n", "latin"): ["Dr", "Prof"],
    ("m", "cyrillic"): ["Господин", "г-н"],
    ("f", "cyrillic"): ["Госпожа", "г-жа"],
}
GIVEN = {
    ("m", "latin"): ["Adam", "Bruno", "Carl", "David", "Emil", "Felix", "Georg", "Hugo", "Ivan", "Jonas", "Karel", "Louis", "Martin", "Nils", "Oscar", "Paul"],
    ("f", "latin"): ["Alma", "Bella", "Clara", "Dora", "Emma", "Flora", "Greta", "Helen", "Irma", "Julia", "Klara", "Lena", "Marta", "Nora", "Olga", "Paula"],
    ("n", "latin"): ["Alex", "Billie", "Chris", "Dana", "Eden", "Frankie", "Gale", "Harper", "Jamie", "Kim", "Lee", "Morgan", "Noel", "Robin", "Sam", "Toni"],
    ("m", "cyrillic"): ["Антон", "Борис", "Виктор", "Глеб", "Денис", "Егор", "Захар", "Игорь"],
    ("f", "cyrillic"): ["Анна", "Вера", "Галина", "Дарья", "Елена", "Зоя", "Ирина", "Мария"],
}
FAMILY = {
    "latin": ["al", "ber", "dor", "el", "fen", "gar", "hol", "kas", "lin", "mar", "nor", "ros", "sten", "tal", "ven", "wil"],
    "cyrillic": ["ал", "бер", "дор", "ел", "лин", "мар", "нор", "тал"],
}

_TITLE = "|".join(t for ts in TITLES.values() for t in ts)
# A run of labels is entered at its start only and never given back, and a domain has ten labels of 63
# characters at most before its last one: the search is linear, and its depth bounded, in any text.
_LABEL = r"[\p{L}\p{N}_%+-]"
_EMAIL = rf"(?<!{_LABEL})(?<!{_LABEL}\.){_LABEL}++(?:\.{_LABEL}++)*+@(?:[\p{{L}}\p{{N}}-]{{1,63}}\.){{1,10}}\p{{L}}{{2,}}"
_PHONE = r"\+\d{1,3}[ .-]?(?:\(\d{1,4}\)|\d{1,4})(?:[ .-]?\d{2,4}){2,4}(?!\d)|(?<![\d.(-])\(\d{3}\) ?\d{3}-\d{4}(?!\d)"
_IP = r"(?<![\d.])(?:25[0-5]|2[0-4]\d|1?\d?\d)(?:\.(?:25[0-5]|2[0-4]\d|1?\d?\d)){3}(?![\d]|\.\d)"
_CARD = r"(?<![\d.+-])\d(?:[ -]?\d){12,18}(?![\d-])"
_IPV6 = r"(?<![\p{L}\p{N}:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![\p{L}\p{N}:])"
_IBAN = r"(?<![\p{L}\p{N}])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![\p{L}\p{N}])"
_SSN = r"(?<![\d.+-])(?!000|666|9)\d{3}-(?!00)\d{2}-(?!0000)\d{4}(?![\d-])"
_KEY_ID = r"(?<![\p{L}\p{N}])AKIA[0-9A-Z]{16}(?![\p{L}\p{N}])"
_SECRET = r"(?i:(?<![\p{L}\p{N}])(?:password|passwd|pwd|secret|token|api[_-]?key)\s{0,3}[=:]\s{0,3})[\"']?[A-Za-z0-9_./+-]{6,}[\"']?"
_NAME = rf"(?<![\p{{L}}])(?:{_TITLE})\.? (?:\p{{Lu}}[\p{{L}}'-]+)(?: \p{{Lu}}[\p{{L}}'-]+)?"
#: In this order the first that matches at a place wins.
KINDS = {
    "email": _EMAIL, "secret": _SECRET, "key_id": _KEY_ID, "iban": _IBAN, "ipv6": _IPV6, "ip": _IP, "ssn": _SSN, "phone": _PHONE,
    "card": _CARD, "name": _NAME,
}
PATTERN = "|".join(f"(?:{p})" for p in KINDS.values())


def hinted(text: Column) -> Column:
    """False only for texts without any entity: every pattern needs a digit, @ or =, a key id, a word
    with a colon, or a title before a name. Plain substring searches come before patterns.
    """
    secret = text.contains(":") & text.rlike(r"(?i:(?:password|passwd|pwd|secret|token|key)\s{0,3}:)")
    titles = sorted({t for ts in TITLES.values() for t in ts if not any(t != o and t.startswith(o) for os in TITLES.values() for o in os)})
    some = text.contains(titles[0])
    for t in titles[1:]:  # a title that begins with another one is found by it
        some = some | text.contains(t)
    named = some & text.rlike(rf"(?<!\p{{L}})(?:{_TITLE})\.? \p{{Lu}}")
    return F.coalesce(text.rlike("[0-9@=]") | text.contains("AKIA") | secret | named, F.lit(False))


def _whole(pattern: str) -> str:
    return rf"\A(?:{pattern})\z"


def kind_of(entity: Column) -> Column:
    """The type of a detected entity."""
    out = F.lit("name")
    for kind in reversed([k for k in KINDS if k != "name"]):
        out = F.when(entity.rlike(_whole(KINDS[kind])), F.lit(kind)).otherwise(out)
    return out


def detect(text: Column) -> Column:
    """All entities of a text, in order."""
    return F.regexp_extract_all(text, F.lit(PATTERN), F.lit(0))


def _number(digest: Column, at: int) -> Column:
    """A number from four hex digits of a digest."""
    return F.conv(F.substring(digest, at + 1, 4), 16, 10).cast("int")


def _stream(seed: Column, n: Column) -> Column:
    """Hex digits for ``n`` characters, two for each (a digest gives 32 characters' worth)."""
    rounds = F.sequence(F.lit(0), F.floor(n / 32).cast("int"))
    return F.array_join(F.transform(rounds, lambda i: F.sha2(F.concat_ws("|", seed, i.cast("string")), 256)), "")


def _pick(letters: str, value: Column) -> Column:
    return F.substr(F.lit(letters), F.pmod(value, F.lit(len(letters))) + F.lit(1), F.lit(1))


_LOWER, _UPPER, _DIGITS, _HEX = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", "0123456789abcdef"
_CYR = "абвгдежзиклмнопрстуфхцчшэюя"


def _let(value: Column, body) -> Column:
    """``body`` of a value that is evaluated once, however often the body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


#: Characters are looked up inside blocks, as finding a place in a long string takes a scan.
_BLOCK = 64


def _blocks(value: Column, n: int) -> Column:
    return F.regexp_extract_all(value, F.lit(f"(?s).{{1,{n}}}"), F.lit(0))


def _reformat(value: Column) -> Column:
    """Each character replaced by one of its class: digit, letter by case and script, else itself.

    A value of hex digits only, with letters and digits, stays hex. Characters are chosen
    by the key stream in ``__stream``.
    """

    def one(c: Column, n: Column, hexed: Column) -> Column:
        return (
            F.when(hexed, _pick(_HEX, n))
            .when((c >= "0") & (c <= "9"), _pick(_DIGITS, n))
            .when((c >= "a") & (c <= "z"), _pick(_LOWER, n))
            .when((c >= "A") & (c <= "Z"), _pick(_UPPER, n))
            .when(c < "\x7f", c)
            .when(c.rlike(r"\p{IsCyrillic}") & c.rlike(r"\p{Lu}"), F.upper(_pick(_CYR, n)))
            .when(c.rlike(r"\p{IsCyrillic}"), _pick(_CYR, n))
            .when(c.rlike(r"\p{Lu}"), _pick(_UPPER, n))
            .when(c.rlike(r"\p{L}"), _pick(_LOWER, n))
            .otherwise(c)
        )

    def block(v: Column, s: Column, hexed: Column) -> Column:
        number = lambda i: F.conv(F.substr(s, i * 2 - 1, F.lit(2)), 16, 10).cast("int")
        chars = F.transform(F.sequence(F.lit(1), F.length(v)), lambda i: _let(F.struct(F.substr(v, i, F.lit(1)).alias("c"), number(i).alias("n")), lambda x: one(x["c"], x["n"], hexed)))
        return F.when(v.isNull(), "").otherwise(F.array_join(chars, ""))  # the stream is longer than the value

    hexed = value.rlike(r"\A(?=.*[0-9])(?=.*[a-f])[0-9a-f]{8,}\z")
    bound = F.struct(value.alias("v"), F.col("__stream").alias("s"), hexed.alias("hex"))
    blocks = lambda x: F.zip_with(_blocks(x["v"], _BLOCK), _blocks(x["s"], 2 * _BLOCK), lambda v, s: block(v, s, x["hex"]))
    return F.when(F.length(value) > 0, _let(bound, lambda x: F.array_join(blocks(x), ""))).otherwise("")


def _luhn_sum(digits: Column) -> Column:
    """Check sum of a digit string, the last digit counted once."""
    n = F.length(digits)

    def add(total: Column, i: Column) -> Column:
        d = F.substr(digits, n - i + 1, F.lit(1)).cast("int")
        twice = F.when(F.pmod(i, F.lit(2)) == 0, d * 2).otherwise(d)
        return total + F.when(twice > 9, twice - 9).otherwise(twice)

    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), add)


def _card(plain: Column) -> Column:
    """Digits replaced, first digit kept, check digit right if it was right."""

    def checked(p: Column, fresh: Column) -> Column:
        body = F.concat(F.substr(p, F.lit(1), F.lit(1)), F.substr(fresh, F.lit(2), F.length(fresh) - 2))
        check = _let(body, lambda b: F.concat(b, F.pmod(F.lit(10) - F.pmod(_luhn_sum(F.concat(b, F.lit("0"))), F.lit(10)), F.lit(10)).cast("string")))
        plain_end = F.concat(body, F.substr(fresh, F.length(fresh), F.lit(1)))
        return F.when(F.pmod(_luhn_sum(p), F.lit(10)) == 0, check).otherwise(plain_end)

    return _let(F.struct(plain.alias("p"), _reformat(plain).alias("f")), lambda x: checked(x["p"], x["f"]))


def _pour(entity: Column, digits: Column) -> Column:
    """The entity with its digits replaced by these, one after another; what is left over follows."""

    def step(state: Column, i: Column) -> Column:
        c = F.substr(entity, i, F.lit(1))
        digit = (c >= "0") & (c <= "9")
        return F.struct(
            F.concat(state["s"], F.when(digit, F.substr(digits, state["k"], F.lit(1))).otherwise(c)).alias("s"),
            (state["k"] + F.when(digit, 1).otherwise(0)).alias("k"),
        )

    start = F.struct(F.lit("").alias("s"), F.lit(1).alias("k"))
    done = lambda x: F.concat(x["s"], F.substr(digits, x["k"]))
    return F.aggregate(F.sequence(F.lit(1), F.length(entity)), start, step, done)


def _cased(entity: Column, value: Column) -> Column:
    """``value`` with capitals where the entity has them."""

    def block(e: Column, v: Column) -> Column:
        at = lambda x, i: F.substr(x, i, F.lit(1))
        one = lambda i: F.when(at(e, i).rlike(r"\p{Lu}"), F.upper(at(v, i))).otherwise(at(v, i))
        return F.when(v.isNull(), "").when(e.isNull(), v).otherwise(F.array_join(F.transform(F.sequence(F.lit(1), F.length(v)), one), ""))

    return F.array_join(F.zip_with(_blocks(entity, _BLOCK), _blocks(value, _BLOCK), block), "")


_HEAD = rf"\A(?:{_TITLE})\.? "


def _person(title: Column) -> tuple[Column, Column]:
    """(gender, script) that a title tells."""
    gender, script = F.lit("n"), F.lit("latin")
    for (g, s), titles in TITLES.items():
        gender = F.when(title.isin(titles), g).otherwise(gender)
        script = F.when(title.isin(titles), s).otherwise(script)
    return gender, script


def _country(entity: Column) -> Column:
    return F.regexp_extract(entity, r"\A(\+\d{1,3}(?=[ .(-])|\+1|)", 1)


def units(entity: Column, kind: Column) -> Column:
    """What stands behind a mention: an array of (kind, unit), two for a given and a family name."""
    unit = lambda k, u: F.struct(k.alias("ukind"), u.alias("unit"))
    digits = F.regexp_replace(entity, r"[^0-9]", "")
    number = F.regexp_replace(F.substr(entity, F.length(_country(entity)) + 1), r"[^0-9]", "")
    head = F.regexp_extract(entity, _HEAD, 0)
    gender, script = _person(F.regexp_extract(entity, rf"\A({_TITLE})\.? ", 1))
    names = F.split(F.substr(entity, F.length(head) + 1), " ")
    family = unit(F.concat(F.lit("family-"), script), F.element_at(names, -1))
    given = unit(F.concat(F.lit("given-"), gender, F.lit("-"), script), F.element_at(names, 1))
    return (
        F.when(kind == "name", F.when(F.size(names) > 1, F.array(given, family)).otherwise(F.array(family)))
        .when(kind == "email", F.array(unit(kind, F.lower(entity))))
        .when(kind == "phone", F.array(unit(kind, F.concat(_country(entity), F.lit("|"), number))))
        .when(kind.isin("card", "ssn"), F.array(unit(kind, digits)))
        .when(kind == "iban", F.array(unit(kind, F.regexp_replace(entity, " ", ""))))
        .when(kind == "ipv6", F.array(unit(kind, F.lower(entity))))
        .otherwise(F.array(unit(kind, entity)))
    )


def mention(entity: Column, kind: Column, found: Column) -> Column:
    """The surrogate of a mention from those of its units, in the mention's form."""
    first = F.element_at(found, 1)
    spaced = F.regexp_replace(F.regexp_replace(first, r"(.{4})", "$1 "), r" \z", "")
    return (
        F.when(kind == "name", F.concat(F.regexp_extract(entity, _HEAD, 0), F.array_join(found, " ")))
        .when(kind.isin("email", "ipv6"), _cased(entity, first))
        .when(kind.isin("phone", "card", "ssn"), _pour(entity, F.regexp_replace(first, r"[^0-9]", "")))
        .when((kind == "iban") & entity.contains(" "), spaced)
        .otherwise(first)
    )


def surrogate(unit: Column, kind: Column) -> Column:
    """The surrogate of a unit at attempt ``__attempt``; ``__stream`` holds its key stream."""
    digest = F.substring(F.col("__stream"), 1, 64)
    wider = F.floor(F.col("__attempt") / WIDER).cast("int")
    # what is added comes from the end of the stream, which no character of the unit uses
    extra = F.translate(F.substring(F.substr(F.col("__stream"), F.length("__stream") - 31), 1, 32), "0123456789", "ghijklmnop")
    more = F.substr(extra, F.lit(1), F.least(wider, F.lit(32)))
    more_digits = F.substr(F.translate(extra, "abcdefghijklmnop", "0123456789012345"), F.lit(1), F.least(wider, F.lit(32)))
    octet = lambda i: F.when(F.lit(i == 0), F.lit(1) + F.pmod(_number(digest, 4 * i), F.lit(223))).otherwise(F.pmod(_number(digest, 4 * i), F.lit(256)))
    head = F.regexp_extract(unit, r"\A(.*?[=:]\s*[\"']?)", 1)  # what introduces a secret stays
    quote = F.regexp_extract(unit, r"([\"']?)\z", 1)
    inner = F.substr(unit, F.length(head) + 1, F.length(unit) - F.length(head) - F.length(quote))
    secret = F.concat(head, _reformat(inner), more, quote)
    suffix = F.regexp_extract(unit, r"((?:\.example)?\.\p{L}{2,})\z", 1)
    address = F.concat(more, _reformat(F.substr(unit, F.lit(1), F.length(unit) - F.length(suffix))), suffix)
    country = F.regexp_extract(unit, r"\A([^|]*)\|", 1)
    phone = F.concat(country, F.lit("|"), _reformat(F.substr(unit, F.length(country) + 2)), more_digits)
    key_id = F.concat(F.lit("AKIA"), _reformat(F.substr(unit, F.lit(5))))
    iban = F.concat(F.substr(unit, F.lit(1), F.lit(2)), _reformat(F.substr(unit, F.lit(3))))
    group = lambda i: F.lower(F.substring(digest, 4 * i + 1, 4))

    def syllables(parts: list[str], n: Column) -> Column:
        pick = lambda i: F.element_at(F.array(*map(F.lit, parts)), F.pmod(_number(F.sha2(F.concat_ws("|", digest, i.cast("string")), 256), 0), F.lit(len(parts))) + 1)
        return F.when(n > 0, F.array_join(F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), pick), "")).otherwise("")

    out = (
        F.when(kind == "email", address)
        .when(kind == "secret", secret)
        .when(kind == "key_id", key_id)
        .when(kind == "iban", iban)
        .when(kind == "ip", F.concat_ws(".", *[octet(i).cast("string") for i in range(4)]))
        .when(kind == "ipv6", F.concat_ws(":", *[group(i) for i in range(8)]))
        .when(kind == "phone", phone)
        .when(kind == "ssn", F.concat(F.lit("8"), F.substr(_reformat(unit), F.lit(2))))
        .when(kind == "card", _card(unit))
    )
    for script, parts in FAMILY.items():
        family = F.initcap(syllables(parts, F.lit(3) + F.floor(F.col("__attempt") / 4).cast("int")))
        out = out.when(kind == f"family-{script}", family)
    for (gender, script), given in GIVEN.items():
        # given names of the list first, longer ones where those are taken
        name = F.element_at(F.array(*map(F.lit, given)), F.pmod(_number(digest, 8), F.lit(len(given))) + 1)
        name = F.concat(name, syllables(FAMILY[script], F.ceil(F.col("__attempt") / 2).cast("int")))
        out = out.when(kind == f"given-{gender}-{script}", name)
    return out


def _keyed(key: str, *parts) -> Column:
    """HMAC-SHA-256 of the parts, in hex."""
    raw = key.encode()
    raw = (hashlib.sha256(raw).digest() if len(raw) > 64 else raw).ljust(64, b"\0")
    pad = lambda x: F.unhex(F.lit(bytes(b ^ x for b in raw).hex()))
    inner = F.sha2(F.concat(pad(0x36), F.encode(F.concat_ws("|", *parts), "UTF-8")), 256)
    return F.sha2(F.concat(pad(0x5C), F.unhex(inner)), 256)


def unit_surrogates(wanted: DataFrame, key: str) -> DataFrame:
    """(ukind, unit, surrogate) for a table of distinct units; surrogates are distinct."""
    # Units are few bytes but much work, so they are dealt by their number, not their size.
    fresh = snapshot(wanted.select("ukind", "unit"), "units")
    parts = max(wanted.sparkSession.sparkContext.defaultParallelism, -(-fresh.count() // ENTITIES_PER_TASK))
    open_ = fresh.withColumn("__attempt", F.lit(0))
    done: DataFrame | None = None
    while True:  # every round settles the first unit of each surrogate that is free
        seed = _keyed(key, "ukind", "unit", F.col("__attempt").cast("string"))
        # The streams are written down: a character looks its two digits up, it must not
        # make the stream anew.
        dealt = open_.repartition(parts, "unit").withColumn("__stream", _stream(seed, F.length("unit") + 16))
        made = snapshot(dealt, "streams").withColumn("surrogate", surrogate(F.col("unit"), F.col("ukind")))
        made = snapshot(made.drop("__stream"), "surrogates")
        # Not allowed: a unit that occurs, a surrogate given before, a surrogate of two.
        taken = fresh.select(F.col("unit").alias("surrogate"))
        if done is not None:
            taken = taken.unionByName(done.select("surrogate"))
        first = made.groupBy("surrogate").agg(F.min(F.struct("ukind", "unit")).alias("__first"))
        good = first.join(taken, "surrogate", "left_anti").select("surrogate", "__first.*")
        kept = made.join(good, ["surrogate", "ukind", "unit"], "left_semi").select("ukind", "unit", "surrogate")
        done = snapshot(kept if done is None else done.unionByName(kept), "distinct")
        open_ = made.join(done, ["ukind", "unit"], "left_anti").select("ukind", "unit", (F.col("__attempt") + 1).alias("__attempt"))
        if open_.isEmpty():
            return done
        open_ = snapshot(open_, "open")


def surrogate_table(entities: DataFrame, key: str) -> DataFrame:
    """(entity, kind, surrogate) for a table of distinct entities.

    Entities that stand for the same unit get the same surrogate, each in its own form; others
    get different ones.
    """
    kinds = snapshot(entities.select("entity", kind_of(F.col("entity")).alias("kind")), "entities")
    parts = kinds.select("entity", "kind", F.posexplode(units(F.col("entity"), F.col("kind"))).alias("at", "u"))
    parts = snapshot(parts.select("entity", "kind", "at", "u.ukind", "u.unit"), "parts")
    table = unit_surrogates(parts.select("ukind", "unit").distinct(), key)
    found = parts.join(table, ["ukind", "unit"]).groupBy("entity", "kind").agg(  # two rows at most
        F.transform(F.array_sort(F.collect_list(F.struct("at", "surrogate"))), lambda x: x["surrogate"]).alias("__found")
    )
    return found.select("entity", "kind", mention(F.col("entity"), F.col("kind"), F.col("__found")).alias("surrogate"))


def replace_entities(docs: DataFrame, key: str) -> DataFrame:
    """``docs`` with entities replaced in ``text``; adds ``n_entities``. All other columns stay."""
    columns = [c for c in docs.columns if c not in ("text", "n_entities") and not c.startswith("__")]
    maybe = hinted(F.col("text"))
    found = docs.where(maybe).select(*columns, "text", detect(F.col("text")).alias("__found")).where(F.size("__found") > 0)
    # Only texts with entities are written down, numbered by row, whatever their ids are.
    found = snapshot(found.withColumn("__id", F.monotonically_increasing_id()), "found")
    pairs = found.select("__id", F.explode(F.array_distinct("__found")).alias("entity"))
    table = snapshot(surrogate_table(pairs.select("entity").distinct(), key), "mentions")
    # One map for each row that has entities; hot entities are on the left of this join only.
    maps = pairs.join(table.select("entity", "surrogate"), "entity")
    maps = maps.groupBy("__id").agg(F.map_from_entries(F.collect_list(F.struct("entity", "surrogate"))).alias("__map"))
    pieces = F.split("text", PATTERN, -1)
    rebuilt = F.array_join(
        F.flatten(F.zip_with(pieces, "__found", lambda p, e: F.array(p, F.coalesce(F.element_at("__map", e), F.lit(""))))), ""
    )
    changed = found.join(maps, "__id").select(*columns, rebuilt.alias("text"), F.size("__found").cast("long").alias("n_entities"))
    nothing = ~maybe | ~F.col("text").rlike(PATTERN)
    same = docs.where(nothing).select(*columns, "text", F.lit(0).cast("long").alias("n_entities"))
    return same.unionByName(changed)


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = spark.conf.get(KEY_SETTING, TEST_KEY)
    return replace_entities(documents(spark, sf_dir).select("doc_id", "text"), key).select("doc_id", "n_entities", "text")
