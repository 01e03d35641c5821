"""Surrogates for personal data: keyed, type-consistent, distinct and coreferent.

One pattern finds e-mail addresses, phone, card and social security numbers, IPv4
addresses, access tokens, values after words such as ``password=``, and names after a title.  A mention is
reduced to entities (kind, canonical form): the digits of a number, a lower-cased
address, a given name with the title's gender, a surname.  An entity's surrogate
follows from a key, its kind and its canonical form alone, so all mentions of it, in
any document and format, get the same one; it is written in the mention's own
format, case and script.  Card surrogates keep the issuer's digit and whether the
check digit holds.

Two entities may fall on one surrogate, or a surrogate on an entity that the
texts hold.  A grouped check over all distinct entities finds these; all but one
are drawn again until none is left, and only texts with such entities meet their
draws by a join.  Later draws come from larger spaces (longer local parts, syllables and values, all
public addresses), so a few rounds do; ``ROUNDS`` of them end in an error.  All of it is DataFrame expressions.

Letters of any script are replaced: those of the scripts in ``SCRIPTS`` by their own script's, others by Latin ones.

A null text stays null and an empty text empty; repeated rows get equal
texts; a null doc_id changes nothing.  Other columns are kept as they are, whatever their names, but a
column ``n_chars`` follows the new text, and one named ``pii_entities`` gives way to the count of mentions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bramble.llm.common import Workspace, fresh, load

# Every alternative starts at the start of a run of its characters, and runs are possessive: no text takes more than linear time.
GLUE = r"[\s|!.#$%&*-]{0,8}"
OCTET = r"(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
LATIN_TITLES = {"m": "Mr|Herr|Monsieur|Señor|Sr", "f": "Mrs|Ms|Miss|Frau|Madame|Señora|Sra"}
CYRILLIC_TITLES = {"m": "Господин|господин", "f": "Госпожа|госпожа"}
TITLE = "|".join([*LATIN_TITLES.values(), *CYRILLIC_TITLES.values()])
KINDS = {
    "email": r"(?<![\p{L}\p{N}._+-])[\p{L}\p{N}._+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": rf"(?<![0-9.])(?:{OCTET}\.){{3}}{OCTET}(?![0-9]|\.[0-9])",
    "secret": r"(?<![0-9A-Za-z])(?:[0-9A-Fa-f]{32,}+|AKIA[0-9A-Z]{16}|(?:sk|ghp|xoxb|xoxp)[-_][0-9A-Za-z-]{16,}+)(?![0-9A-Za-z])",
    "card": r"(?<![0-9])(?:[0-9]{4}[ -]?[0-9]{4}[ -]?[0-9]{4}[ -]?[0-9]{4}|3[47][0-9]{2}[ -]?[0-9]{6}[ -]?[0-9]{5})(?![0-9])",
    "phone": rf"(?:(?<![0-9])\+?1{GLUE})?\([0-9]{{3}}\){GLUE}[0-9]{{3}}[-. ][0-9]{{4}}(?![0-9])|(?<![0-9-])[2-9][0-9]{{2}}(?:-[0-9]{{3}}-|\.[0-9]{{3}}\.| [0-9]{{3}} )[0-9]{{4}}(?![0-9-])|(?<![0-9])\+[0-9]{{1,3}}(?:[ .-][0-9]{{2,4}}){{2,5}}(?![0-9])|(?<![0-9])\+[0-9]{{8,15}}(?![0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "name": rf"(?<!\p{{L}})(?:{TITLE})\.? \p{{Lu}}\p{{Ll}}++(?: \p{{Lu}}\p{{Ll}}++)?",
}
#: A value after such a word; the short look behind spares most places the long one.
PASSWORD = r"""(?<=[=:"']|[=:] )(?<=(?i:password|passwd|pwd|secret|token|api[_-]?key)["']?\s?[=:]\s?["']?)[0-9A-Za-z+/_~-]{6,}+"""
#: What starts with a digit, a plus or a parenthesis is tried only there.
NUMBERS = ("ip", "card", "phone", "ssn")
PATTERN = "|".join([KINDS["email"], KINDS["secret"], rf"(?=[0-9+(])(?:{'|'.join(KINDS[k] for k in NUMBERS)})", KINDS["name"], PASSWORD])
#: Every mention but a name has one of these.
SIGNS = r"[0-9@=:]|(?<![0-9A-Za-z-])[0-9A-Za-z-]{16}"

GIVEN = {
    "m": ["James", "Peter", "Martin", "Paul", "Thomas", "Daniel", "Simon", "Victor", "Oscar", "Julian", "Adrian", "Leon"],
    "f": ["Anna", "Clara", "Julia", "Laura", "Maria", "Nora", "Paula", "Sofia", "Vera", "Elena", "Emma", "Irene"],
}
GIVEN_CYRILLIC = {
    "m": ["Иван", "Пётр", "Павел", "Антон", "Роман", "Виктор", "Игорь", "Олег"],
    "f": ["Анна", "Мария", "Елена", "Ольга", "Ирина", "Вера", "Нина", "Лариса"],
}
# Ranges of code points, and letters that stand for theirs.
SCRIPTS = [
    (0x30, 0x39, "0123456789"), (0x41, 0x5A, "ABCDEFGHIJKLMNOPQRSTUVWXYZ"), (0x61, 0x7A, "abcdefghijklmnopqrstuvwxyz"), (0xC0, 0xDE, "ABCDEFGHIJKLMNOPQRSTUVWXYZ"),
    (0x391, 0x3A9, "ΑΒΓΔΕΖΗΘΙΚΛΜΝΞΟΠΡΣΤΥΦΧΨΩ"), (0x3AC, 0x3CE, "αβγδεζηθικλμνξοπρστυφχψω"), (0x400, 0x42F, "АБВГДЕЖЗИКЛМНОПРСТУФХЦЧШЭЮЯ"), (0x430, 0x45F, "абвгдежзиклмнопрстуфхцчшэюя"),
    (0x5D0, 0x5EA, "אבגדהוזחטיכלמנסעפצקרשת"), (0x620, 0x64A, "ابتثجحدذرزسشصضطظعغفقكلمنهوي"), (0x660, 0x669, "٠١٢٣٤٥٦٧٨٩"), (0x904, 0x939, "कखगघचछजझटठडढणतथदधनपफबभमयरलवशषसह"), (0xE01, 0xE2E, "กขคงจฉชซญดตถทธนบปผฝพฟมยรลวสหอ"),
    (0x3041, 0x3096, "あいうえおかきくけこさしすせそたちつてとなにぬねの"), (0x30A1, 0x30FA, "アイウエオカキクケコサシスセソタチツテトナニヌネノ"), (0x3400, 0x9FFF, "一丁七万三上下不中主久之九也事二人今他代以任"), (0xAC00, 0xD7A3, "가나다라마바사아자차카타파하거너더러머버서어저"),
]
LETTERS = "abcdefghijklmnopqrstuvwxyz"
#: Rounds of draws after which surrogates that still clash are an error.
ROUNDS = 24


def drawn(key: str, kind: Column, canonical: Column, attempt: Column) -> Column:
    """128 hexadecimal digits from the key and an entity."""
    seed = F.concat_ws("|", F.lit(key), kind, canonical, attempt.cast("string"))
    return F.concat(F.sha2(seed, 256), F.sha2(F.concat(seed, F.lit("|+")), 256))


def number(h: Column, i: Column | int, digits: int = 4) -> Column:
    """The i-th number of a draw."""
    at = (F.lit(i) if isinstance(i, int) else i) * digits % F.lit(128 - 128 % digits) + 1
    return F.conv(F.substr(h, at, F.lit(digits)), 16, 10).cast("int")


def pick(options: str | list[str], n: Column) -> Column:
    if isinstance(options, str):
        return F.substr(F.lit(options), n % len(options) + 1, F.lit(1))
    return F.element_at(F.array(*map(F.lit, options)), n % len(options) + 1)


def masked(text: Column, h: Column, start: int = 0) -> Column:
    """Each letter and digit replaced by another of its class and script; ASCII marks are kept, unless there is nothing else."""
    bare = ~text.rlike(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]")
    scripts = F.expr("array(" + ", ".join(f"named_struct('low', {low}, 'high', {high}, 'letters', '{letters}')" for low, high, letters in SCRIPTS) + ")")

    def one(c, i):
        code = F.ascii(c)
        own = F.try_element_at(F.filter(scripts, lambda x: code.between(x["low"], x["high"])), F.lit(1))["letters"]
        options = F.coalesce(own, F.when((code < 128) & ~bare, c), F.lit(LETTERS))
        # a step from the letter's own place that never ends there
        return bound(options, lambda o: F.substr(o, (F.position(c, o) + number(h, i + start) % F.greatest(F.length(o) - 1, F.lit(1))) % F.length(o) + 1, F.lit(1)))

    return F.array_join(F.transform(F.split(text, ""), one), "")


def bound(value: Column, f) -> Column:
    """f(value), where the value is worked out once, however often ``f`` names it."""
    return F.element_at(F.transform(F.array(value), f), 1)


def grown(h: Column, attempt: Column, letters: str = LETTERS) -> Column:
    """What later draws add: two characters a draw, so that their space outgrows any number of clashes."""
    return F.when(attempt > 0, F.array_join(F.transform(F.sequence(F.lit(1), 2 * F.greatest(attempt, F.lit(1))), lambda i: pick(letters, number(h, i + 9, 3))), "")).otherwise("")


def kind_of(mention: Column) -> Column:
    out = F.lit("secret")  # as a password's value looks like anything
    for kind, pattern in list(KINDS.items())[::-1]:
        out = F.when(mention.rlike(f"^(?:{pattern})$"), F.lit(kind)).otherwise(out)
    return out


def digits(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def gender(mention: Column) -> Column:
    female = "|".join([LATIN_TITLES["f"], CYRILLIC_TITLES["f"]])
    return F.when(mention.rlike(rf"^(?:{female})\b"), F.lit("f")).otherwise(F.lit("m"))


def entities(mention: Column, kind: Column) -> Column:
    """array<struct<kind, canonical>> of a mention: two for a full name, else one."""
    one = lambda k, c: F.struct(k.alias("kind"), c.alias("canonical"))
    d = digits(mention)
    first, second = (F.lower(F.regexp_extract(mention, rf"^(?:{TITLE})\.? (\S+)(?: (\S+))?$", i)) for i in (1, 2))
    whole = F.array(one(F.concat(F.lit("given-"), gender(mention)), first), one(F.lit("surname"), second))
    phone = F.when(F.length(d) == 11, F.regexp_replace(d, "^1", "")).otherwise(d)
    return (
        F.when(kind == "name", F.when(second == "", F.array(one(F.lit("surname"), first))).otherwise(whole))
        .when(kind == "phone", F.array(one(kind, phone)))
        .when(kind.isin("card", "ssn"), F.array(one(kind, d)))
        .when((kind == "email") | (kind == "secret") & mention.rlike("^[0-9A-Fa-f]+$"), F.array(one(kind, F.lower(mention))))
        .otherwise(F.array(one(kind, mention)))
    )


def luhn(d: Column) -> Column:
    """The check sum of digits, mod 10: 0 where the check digit holds."""
    reverse = F.split(F.reverse(d), "")
    weigh = lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise(F.when(c.cast("int") > 4, 2 * c.cast("int") - 9).otherwise(2 * c.cast("int")))
    return F.aggregate(F.transform(reverse, weigh), F.lit(0), lambda a, x: a + x) % 10


def syllables(h: Column, n: Column, cyrillic: Column) -> Column:
    of = lambda c, v: F.array_join(F.transform(F.sequence(F.lit(1), n), lambda i: F.concat(pick(c, number(h, i * 2)), pick(v, number(h, i * 2 + 1)))), "")
    return F.initcap(F.when(cyrillic, of("бвгдзклмнпрст", "аеиоу")).otherwise(of("bcdfghklmnprstvz", "aeiou")))


def surrogate(key: str, kind: Column, canonical: Column, attempt: Column) -> Column:
    """The canonical form of an entity's surrogate."""
    return bound(drawn(key, kind, canonical, attempt), lambda h: _surrogate(h, kind, canonical, attempt))


def _surrogate(h: Column, kind: Column, canonical: Column, attempt: Column) -> Column:
    local, domain = F.regexp_extract(canonical, "^([^@]*)@", 1), F.regexp_extract(canonical, "@(.*)$", 1)
    labels = F.split(domain, r"\.")
    below = F.array_join(F.slice(labels, F.lit(1), F.greatest(F.size(labels) - 2, F.lit(0))), ".")
    end = F.when(F.element_at(labels, -1).isin("com", "net", "org"), F.element_at(labels, -1)).otherwise(F.lit("com"))
    email = F.concat(masked(local, h), grown(h, attempt), F.lit("@"), F.when(below == "", F.lit("")).otherwise(F.concat(masked(below, h, 20), F.lit("."))), F.lit("example."), end)
    octet = lambda i: (number(h, i) % 256).cast("string")
    # inner networks may be fuller than draws can find room in; later draws leave them
    inner = F.when(attempt > 1, F.lit("")).when(canonical.startswith("10."), F.lit("10.")).when(canonical.startswith("192.168."), F.lit("192.168.")).otherwise(F.lit(""))
    ip = F.when(inner == "10.", F.concat_ws(".", F.lit("10"), octet(1), octet(2), octet(3))).when(inner == "192.168.", F.concat_ws(".", F.lit("192.168"), octet(2), octet(3))).otherwise(F.concat_ws(".", (F.lit(11) + number(h, 0) % 100).cast("string"), octet(1), octet(2), octet(3)))
    of_hex = F.array_join(F.transform(F.split(canonical, ""), lambda c, i: pick("0123456789abcdef", number(h, i, 2))), "")
    prefix = F.regexp_extract(canonical, "^(AKIA|sk[-_]|ghp[-_]|xoxb[-_]|xoxp[-_])", 1)
    secret = F.when(canonical.rlike("^[0-9a-f]+$"), of_hex).otherwise(F.concat(prefix, masked(F.substr(canonical, F.length(prefix) + 1), h), grown(h, attempt)))
    body = F.concat(F.substr(canonical, F.lit(1), F.lit(1)), F.array_join(F.transform(F.sequence(F.lit(2), F.length(canonical) - 1), lambda i: pick("0123456789", number(h, i))), ""))
    right = (10 - luhn(F.concat(body, F.lit("0")))) % 10
    check = F.when(luhn(canonical) == 0, right).otherwise((right + 1 + number(h, 0) % 9) % 10)
    card = F.concat(body, check.cast("string"))
    n = F.length(canonical)
    phone = F.array_join(F.transform(F.sequence(F.lit(1), n), lambda i: F.when((n == 10) & i.isin(1, 4), pick("23456789", number(h, i))).otherwise(pick("0123456789", number(h, i)))), "")
    phone = F.concat(phone, grown(h, attempt - 3, "0123456789"))
    ssn = F.concat(F.when(attempt > 1, pick("0123456789", number(h, 12))).otherwise("9"), F.array_join(F.transform(F.sequence(F.lit(2), F.lit(9)), lambda i: pick("0123456789", number(h, i))), ""))
    cyrillic = canonical.rlike(r"\p{IsCyrillic}")
    made = F.concat(syllables(h, attempt + 1, cyrillic), F.when(kind == "given-f", F.when(cyrillic, F.lit("на")).otherwise(F.lit("na"))).otherwise(F.when(cyrillic, F.lit("ман")).otherwise(F.lit("rt"))))
    known = lambda g: F.when(cyrillic, pick(GIVEN_CYRILLIC[g], number(h, 0))).otherwise(pick(GIVEN[g], number(h, 0)))
    given = F.when(attempt > 0, made).when(kind == "given-f", known("f")).otherwise(known("m"))
    return (
        F.when(kind == "email", email).when(kind == "ip", ip).when(kind == "secret", secret).when(kind == "card", card).when(kind == "phone", phone)
        .when(kind == "ssn", ssn).when(kind.startswith("given-"), F.lower(given)).otherwise(F.lower(syllables(h, attempt + 3, cyrillic)))
    )


def written(mention: Column, kind: Column, made: Column) -> Column:
    """Surrogates (array of canonical forms) in the format of the mention."""
    first = F.element_at(made, 1)
    left = lambda i: F.length(digits(F.substr(mention, i)))
    char = lambda i: F.substr(mention, i, F.lit(1))
    # a number longer than its mention goes on behind it
    n = F.length(first) - F.greatest(F.length(first) - F.length(digits(mention)), F.lit(0))
    numbers = F.array_join(F.transform(F.sequence(F.lit(1), F.length(mention)), lambda i: F.when(char(i).rlike("[0-9]") & (left(i) <= n), F.substr(first, n - left(i) + 1, F.lit(1))).otherwise(char(i))), "")
    numbers = F.concat(numbers, F.substr(first, n + 1))
    name = F.concat(F.regexp_extract(mention, rf"^(?:{TITLE})\.? ", 0), F.array_join(F.transform(made, lambda x: F.initcap(x)), " "))
    cased = F.when((F.upper(mention) == mention) & (F.lower(mention) != mention), F.upper(first)).otherwise(first)
    return F.when(kind == "name", name).when(kind.isin("phone", "card", "ssn"), numbers).when(kind == "ip", first).otherwise(cased)


def suspect(text: Column) -> Column:
    """Whether a text has what every mention has some of; spares the others the pattern."""
    out = text.rlike(SIGNS)
    for title in sorted(set(TITLE.split("|"))):
        out = out | text.contains(title)
    return out


def mentions(text: Column) -> Column:
    return F.when(suspect(text), F.regexp_extract_all(text, F.lit(PATTERN), F.lit(0))).otherwise(F.array().cast("array<string>"))


def replaced(text: Column, found: Column, key: str, draws: Column | None) -> Column:
    """``text`` with its mentions replaced; ``draws`` maps "kind|canonical" to the number of a later draw."""
    zero = F.lit(0)
    attempt = lambda e: zero if draws is None else F.coalesce(F.try_element_at(draws, F.concat_ws("|", e["kind"], e["canonical"])), zero)

    def new(mention):
        return bound(kind_of(mention), lambda kind: bound(F.transform(entities(mention, kind), lambda e: surrogate(key, e["kind"], e["canonical"], attempt(e))), lambda made: written(mention, kind, made)))

    between = F.split(text, PATTERN, -1)
    parts = F.zip_with(between, F.array_append(F.transform(found, new), F.lit("")), lambda a, b: F.concat(a, b))
    return F.when(F.size(found) > 0, F.array_join(parts, "")).otherwise(text)


def settled(entities: DataFrame, key: str, work: Workspace) -> tuple[DataFrame, int]:
    """(kind, canonical, attempt): the draw that gives each entity a surrogate of its own, and the rounds this took."""
    draw = lambda attempt: surrogate(key, F.col("kind"), F.col("canonical"), attempt)
    start = entities.withColumn("attempt", F.lit(0))
    made = work.table(start.withColumn("s", draw(F.col("attempt"))).withColumn("kind_", F.regexp_replace("kind", "-.*", "")), "entities-0")
    for k in range(ROUNDS):
        # a name given to a man and to a woman is two entities with surrogates apart
        first = made.groupBy("kind_", "s").agg(F.min(F.struct("attempt", "kind", "canonical")).alias("first"), F.count(F.lit(1)).alias("n"))
        clash = made.join(first.filter("n > 1").drop("n"), ["kind_", "s"]).filter("struct(attempt, kind, canonical) <> first").select("kind", "canonical")
        taken = made.join(made.select("kind_", F.col("canonical").alias("s")).distinct(), ["kind_", "s"]).select("kind", "canonical")
        again = work.table(clash.union(taken).distinct(), f"again-{k}")
        if again.isEmpty():
            return made.select("kind", "canonical", "attempt"), k
        next_ = made.join(again.withColumn("more", F.lit(1)), ["kind", "canonical"], "left").withColumn("attempt", F.col("attempt") + F.coalesce("more", F.lit(0)))
        made = work.table(next_.select("kind", "canonical", "attempt", F.when(F.col("more").isNull(), F.col("s")).otherwise(draw(F.col("attempt"))).alias("s"), "kind_"), f"entities-{k + 1}")
    raise RuntimeError(f"surrogates still clash after {ROUNDS} draws: the texts hold more entities of a kind than there is room for")


def surrogates(docs: DataFrame, key: str, *, column: str = "text") -> DataFrame:
    """``docs`` with all personal data in ``column`` replaced; keeps the columns, and adds ``pii_entities`` (mentions replaced) in place of any such column."""
    work = Workspace(docs.sparkSession, "pii")
    texts = docs.select(F.col(column).cast("string").alias("t")).withColumn("found", mentions(F.col("t"))).filter(F.size("found") > 0)
    flat = texts.select(F.explode("found").alias("m")).groupBy("m").agg(F.count(F.lit(1)).alias("n"))
    flat = flat.withColumn("k", kind_of(F.col("m"))).select(F.explode(entities(F.col("m"), F.col("k"))).alias("e")).select("e.*").distinct()
    table, rounds = settled(flat, key, work)
    text = F.col(column).cast("string")
    found, new, by, drawn_ = fresh(docs, "pii_found", "pii_new", "pii_text", "pii_draws")
    out, draws = docs.withColumn(found, mentions(text)), None
    if rounds:
        later = table.filter("attempt > 0").select(F.concat_ws("|", "kind", "canonical").alias("e"), "attempt")
        held = texts.select(F.sha2("t", 256).alias(by), F.explode(F.array_distinct("found")).alias("m")).distinct().withColumn("k", kind_of(F.col("m")))
        held = held.select(by, F.explode(entities(F.col("m"), F.col("k"))).alias("x")).select(by, F.concat_ws("|", "x.kind", "x.canonical").alias("e")).distinct()
        maps = held.join(later, "e").groupBy(by).agg(F.map_from_entries(F.collect_list(F.struct("e", "attempt"))).alias(drawn_))
        out = out.withColumn(by, F.sha2(text, 256)).join(work.table(maps, "draws"), by, "left")
        draws = F.coalesce(drawn_, F.create_map().cast("map<string,int>"))
    out = out.withColumn(new, replaced(text, F.col(found), key, draws))
    size = F.length(new)
    columns = [F.col(new).alias(c) if c == column else F.when(F.size(found) > 0, size.cast(docs.schema[c].dataType)).otherwise(F.col(c)).alias(c) if c == "n_chars" else F.col(f"`{c}`") for c in docs.columns if c != "pii_entities"]
    return out.select(*columns, F.size(found).alias("pii_entities"))


#: A caller with data of their own names a key of their own.
KEY = "bramble-demo-key"


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with surrogates for personal data."""
    return surrogates(load(spark, sf_dir, "documents"), KEY).select("doc_id", "text", "lang", "source", "n_chars", "pii_entities")
