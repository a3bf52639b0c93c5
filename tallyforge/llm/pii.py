"""Keyed surrogates for personal data, as Spark expressions only.

Entities are found by one pattern.  Each gets a surrogate of its kind and form, drawn from a keyed hash of its canonical spelling, so that it is the same wherever it
stands and however it is spelled.  Names are taken apart: family names and given names have surrogates of their own, so that Mr Smith and Dr John Smith share a family name.
All distinct entities are then checked: a surrogate that another entity has, or that is itself an entity of the corpus, is drawn again with the next attempt.
Bare mentions of a text's names are found in the text between its entities as it was, by a search in a sorted array for each capitalised word.  Texts are rewritten in place; only entities and the rare exceptions (second attempts, given names under titles of several genders) are shuffled.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import field, materialize, packed, table, unpacked

#: Names the session setting that holds the key; where it is unset, the queries take TEST_KEY, whose surrogates are no secret.
KEY_SETTING, TEST_KEY = "spark.tallyforge.pii.key", "no secret"
BROADCAST_ROWS = 100_000
#: From this attempt on, forms of digits grow by four digits an attempt, as their own space may be full; after MOST_ATTEMPTS rounds something is wrong.
LONGER_FROM, MOST_ATTEMPTS = 3, 40
#: Put around entities to cut a text; a text that holds it itself is cut by a second search.
MARK = "\ufdd0"

#: Titles by gender, as they stand before a name.
TITLES = {"m": ("Mr", "Herr", "Señor", "Sr", "Monsieur", "Господин"), "f": ("Mrs", "Ms", "Miss", "Frau", "Señora", "Sra", "Madame", "Mme", "Госпожа"), "n": ("Dr", "Prof")}
#: Given names by gender and script, from which surrogates are made.
GIVEN = {
    ("m", "Latin"): ("Adam", "Bruno", "Carl", "David", "Emil", "Frank", "Georg", "Hugo", "Ivan", "Jonas", "Karl", "Leon", "Martin", "Nils", "Oscar", "Paul"),
    ("f", "Latin"): ("Alma", "Berta", "Clara", "Diana", "Elena", "Frida", "Greta", "Helena", "Irma", "Julia", "Karla", "Laura", "Marta", "Nora", "Olga", "Paula"),
    ("n", "Latin"): ("Alex", "Bobbie", "Charlie", "Dana", "Eden", "Frankie", "Gale", "Harley", "Indigo", "Jamie", "Kim", "Lane", "Morgan", "Noel", "Onyx", "Perry"),
    ("m", "Cyrillic"): ("Антон", "Борис", "Виктор", "Глеб", "Денис", "Егор", "Захар", "Игорь"),
    ("f", "Cyrillic"): ("Алла", "Белла", "Вера", "Галина", "Дарья", "Ева", "Зоя", "Инна"),
    ("n", "Cyrillic"): ("Саша", "Женя", "Валя", "Слава"),
}
#: Syllables of made-up family names.
SYLLABLES = {
    "Latin": ("ba", "ber", "dal", "den", "fel", "gar", "hol", "kel", "lan", "mar", "nor", "per", "ran", "sel", "tor", "win"),
    "Cyrillic": ("ба", "бер", "дал", "ден", "фел", "гар", "хол", "кел", "лан", "мар", "нор", "пер", "ран", "сел", "тор", "вин"),
}

#: Words before a name without a title.
CUES = ("name is", "Name is", "name:", "Name:", "Contact:", "Attn:", "Author:", "Signed,", "Sincerely,", "Regards,")
#: Country calling codes of one and two digits; all others have three.
CALLING_CODE = r"^\+(1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|\d{3})"

ALL_TITLES = "|".join(t for own in TITLES.values() for t in own)
OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
#: A part of a name, up to where its word ends; initials stand before or after the first part.
NAME_PART, INITIALS = r"\p{Lu}[\p{L}\p{M}'’-]++", r"\p{Lu}\.(?: ?\p{Lu}\.)*"
#: A word with a capital at its front, between characters that are in no name.
CAPITAL_WORD = r"(?<![\p{L}\p{M}'’-])\p{Lu}[\p{L}\p{M}'’-]*+"
CUE = rf"(?<=\b(?:{'|'.join(CUES)})[ \n])"
#: Kinds in order of preference; what is of no other kind is a name.
PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]{1,64}+@(?:[A-Za-z0-9-]{1,63}\.){1,8}[A-Za-z]{2,24}",
    "secret": r"(?<![0-9A-Za-z])[0-9A-Fa-f]{32,128}(?![0-9A-Za-z])",
    "ipv4": rf"(?<![\d.])(?:{OCTET}\.){{3}}{OCTET}(?!\d|\.\d)",
    "phone": r"(?<![\d+])(?:\+\d{1,3}[ .-]?(?:\(\d{1,4}\)|\d{2,4})(?:[ .-]?\d{2,4}){2,3}|\(\d{3}\) ?\d{3}[ .-]\d{4}|\d{3}[.-]\d{3}[.-]\d{4}|(?<!\d )\d{3} \d{3} \d{4}(?! \d))(?!\d)",
    "ssn": r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])",
    "iban": r"(?<![0-9A-Za-z])[A-Z]{2}\d{2}(?:(?: ?[A-Z0-9]{4}){3,7}(?:[A-Z0-9]{1,3}| \d{1,3})?|(?: ?[A-Z0-9]{4}){2} ?[A-Z0-9]{3})(?![0-9A-Za-z])",
    "account": r"(?<!\d)\d(?:[ -]?\d){12,18}(?!\d)",
    "name": rf"(?<!\p{{L}})(?:{ALL_TITLES})\.? (?:{INITIALS} ?)?{NAME_PART}(?: {INITIALS})?(?: {NAME_PART}){{0,2}}|{CUE}{NAME_PART}(?: {INITIALS})?(?: {NAME_PART}){{1,2}}",
}
PATTERN = "|".join(f"(?:{p})" for p in PATTERNS.values())
#: Every text with an entity holds one of these.
HINT = rf"[0-9@]|[0-9A-Fa-f]{{32}}|(?<!\p{{L}})(?:{ALL_TITLES})\.? \p{{Lu}}|\b(?:{'|'.join(CUES)})[ \n]\p{{Lu}}"


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with value worked out once, inside a function over arrays too."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def kind_of(entity: Column) -> Column:
    kinds = F.lit("name")
    for name, p in reversed(PATTERNS.items()):
        kinds = kinds if name == "name" else F.when(entity.rlike(f"^(?:{p})$"), name).otherwise(kinds)
    return kinds


def title_of(entity: Column) -> Column:
    """The title with what stands between it and the name; empty where there is none."""
    return F.regexp_extract(entity, rf"^(?:(?:{ALL_TITLES})\.? )?", 0)


def gender_of(title: Column) -> Column:
    word = F.regexp_replace(title, r"\.? $", "")
    return F.when(word.isin(*TITLES["m"]), "m").when(word.isin(*TITLES["f"]), "f").otherwise("n")


def canonical(entity: Column, kind: Column) -> Column:
    """One spelling for all spellings of an entity."""
    digits = F.regexp_replace(entity, "[^0-9A-Za-z]", "")
    return (
        F.when(kind.isin("email", "secret", "family", "given"), F.lower(entity))
        .when(kind == "ipv4", entity)
        .when(kind == "phone", F.concat(F.when(entity.startswith("+"), "+").otherwise(""), digits))
        .otherwise(F.upper(digits))
    )


def atoms(entity: Column) -> Column:
    """What of an entity has a surrogate of its own: structs of kind, canon, entity (as spelled) and gender.  Names come apart into given and family names and initials."""

    def of_name(entity: Column) -> Column:
        title = title_of(entity)

        def parts(tokens: Column) -> Column:
            initial = lambda t: t.rlike(r"^(?:\p{Lu}\.)+$")
            last = F.array_max(F.transform(tokens, lambda t, i: F.when(~initial(t), i)))
            family = F.lower(F.get(tokens, last))
            role = lambda t, i: F.when(initial(t), "initial").when(i == last, "family").otherwise("given")
            canon = lambda t: F.when(initial(t), F.concat(family, F.lit(":"), t)).otherwise(F.lower(t))
            return F.transform(tokens, lambda t, i: F.struct(role(t, i).alias("kind"), canon(t).alias("canon"), t.alias("entity"), gender_of(title).alias("gender")))

        return let(F.split(F.substr(entity, F.length(title) + 1), " "), parts)

    def of(kind: Column) -> Column:
        return F.when(kind == "name", of_name(entity)).otherwise(F.array(F.struct(kind.alias("kind"), canonical(entity, kind).alias("canon"), entity.alias("entity"), F.lit("n").alias("gender"))))

    return let(kind_of(entity), of)


def draw(kind: Column, canon: Column, attempt: Column, key: str) -> Column:
    """256 hex digits."""
    return F.concat(*(F.sha2(F.concat_ws("|", F.lit(key), F.lit(part), attempt.cast("string"), kind, canon).cast("binary"), 512) for part in ("a", "b")))


def hex_at(hexes: Column, at: Column | int, n: int = 2) -> Column:
    """n digits as a number, two digits a step."""
    at = F.lit(at) if isinstance(at, int) else at
    return F.conv(F.substr(hexes, (at * 2 + 1).cast("int"), F.lit(n)), 16, 10).cast("long")


def same_form(text: Column, hexes: Column, keep: Column | None = None) -> Column:
    """Digits become digits, letters letters of their case, by their place among digits and letters; other characters and the first keep of these stay."""
    keep = F.lit(0) if keep is None else keep

    def one(c: Column, i: Column) -> Column:
        def made(rank: Column) -> Column:
            n = hex_at(hexes, rank)
            return F.when(rank < keep, c).when(c.rlike("[0-9]"), (n % 10).cast("string")).when(c.rlike("[A-Z]"), F.char(65 + n % 26)).when(c.rlike("[a-z]"), F.char(97 + n % 26)).otherwise(c)

        return let(F.length(F.regexp_replace(F.substr(text, F.lit(1), i), "[^0-9A-Za-z]", "")), made)

    return F.array_join(F.transform(F.split(text, ""), one), "")


def checked(digits: Column) -> Column:
    """Sum of the Luhn check, over a text of digits."""
    doubled = lambda d: F.when(d * 2 > 9, d * 2 - 9).otherwise(d * 2)
    return F.aggregate(
        F.transform(F.split(F.reverse(digits), ""), lambda c, i: F.when(i % 2 == 1, doubled(c.cast("int"))).otherwise(c.cast("int"))), F.lit(0), lambda a, x: a + F.coalesce(x, F.lit(0))
    )


def account_like(entity: Column, longer: Column, hexes: Column) -> Column:
    """Digits in the form of longer; the last one makes the Luhn check hold where it held for entity."""
    plain = F.regexp_replace(entity, "[^0-9]", "")

    def ended(made: Column) -> Column:
        front = F.substr(made, F.lit(1), F.length(made) - 1)
        last = (10 - checked(F.concat(F.regexp_replace(front, "[^0-9]", ""), F.lit("0"))) % 10) % 10
        return F.when(checked(plain) % 10 == 0, F.concat(front, last.cast("string"))).otherwise(made)

    return let(same_form(longer, hexes), ended)


def mod97(text: Column) -> Column:
    """Of letters (A is 10, B is 11, ...) and digits read as one number."""
    step = lambda a, c: F.when(c.rlike("[0-9]"), a * 10 + F.ascii(c) - 48).otherwise(a * 100 + F.ascii(c) - 55) % 97
    return F.aggregate(F.split(text, ""), F.lit(0), step)


def iban_like(entity: Column, longer: Column, hexes: Column) -> Column:
    """The country stays; the check digits hold where they held for entity."""
    plain = lambda t: F.upper(F.regexp_replace(t, "[^0-9A-Za-z]", ""))
    front_last = lambda t, check: F.concat(F.substr(t, F.lit(5)), F.substr(t, F.lit(1), F.lit(2)), check)
    valid = mod97(front_last(plain(entity), F.substr(plain(entity), F.lit(3), F.lit(2)))) == 1

    def ended(made: Column) -> Column:
        check = F.lpad((98 - mod97(front_last(plain(made), F.lit("00")))).cast("string"), 2, "0")
        return F.when(valid, F.concat(F.substr(made, F.lit(1), F.lit(2)), check, F.substr(made, F.lit(5)))).otherwise(made)

    return let(same_form(longer, hexes, F.lit(2)), ended)


def secret_like(entity: Column, hexes: Column) -> Column:
    own = F.substr(hexes, F.lit(1), F.length(entity))
    return F.when(entity.rlike("[A-F]"), F.upper(own)).otherwise(own)


def email_like(entity: Column, hexes: Column) -> Column:
    made = F.concat(F.substring(hexes, 1, 12), F.lit("@mail"), F.substring(hexes, 13, 6), F.lit(".example."), F.lower(F.substring_index(entity, ".", -1)))
    made = F.concat(F.lit("u"), made)
    return F.when(~entity.rlike("[a-z]"), F.upper(made)).otherwise(made)


def cased(entity: Column, name: Column) -> Column:
    """name in capitals where entity is."""
    return F.when(~entity.rlike(r"\p{Ll}"), F.upper(name)).otherwise(name)


def listed(names: tuple[str, ...]) -> Column:
    return F.expr("array(" + ", ".join(f"'{n}'" for n in names) + ")")


def picked(names: Column, hexes: Column, at: Column | int) -> Column:
    return F.get(names, (hex_at(hexes, at) % F.size(names)).cast("int"))


def script_of(entity: Column) -> Column:
    return F.when(entity.rlike(r"\p{IsCyrillic}"), "Cyrillic").otherwise("Latin")


def syllables(script: Column, hexes: Column, n: Column) -> Column:
    """n syllables, ten at most."""
    parts = F.when(script == "Latin", listed(SYLLABLES["Latin"])).otherwise(listed(SYLLABLES["Cyrillic"]))
    some = let(parts, lambda own: F.array_join(F.transform(F.sequence(F.lit(1), F.least(n, F.lit(10))), lambda i: picked(own, hexes, i)), ""))
    return F.when(n > 0, some).otherwise("")


def given_like(entity: Column, gender: Column, hexes: Column, attempt: Column) -> Column:
    """A given name of the gender and the script, longer by a syllable an attempt."""

    def made(script: Column) -> Column:
        names = F.lit(None).cast("array<string>")
        for (g, own), x in GIVEN.items():
            names = F.when((gender == g) & (script == own), listed(x)).otherwise(names)
        return F.concat(let(names, lambda x: picked(x, hexes, 0)), syllables(script, hexes, attempt))

    return cased(entity, let(script_of(entity), made))


def family_like(entity: Column, hexes: Column, attempt: Column) -> Column:
    """Four syllables in the script of the name, and one more an attempt."""
    return cased(entity, F.initcap(let(script_of(entity), lambda script: syllables(script, hexes, attempt + 4))))


def drawn_like(kind: Column, canon: Column, entity: Column, gender: Column, hexes: Column, attempt: Column) -> Column:
    """A draw of the atom's kind and form.  The space grows with the attempt, so that there are values left however many entities a form has."""
    late = F.greatest(attempt - (LONGER_FROM - 1), F.lit(0))
    longer = F.concat(entity, F.repeat(F.lit("0000"), F.least(late, F.lit(8)).cast("int")))
    octets = F.concat_ws(".", (hex_at(hexes, 0, 4) % 223 + 1).cast("string"), *((hex_at(hexes, i) % 256).cast("string") for i in (2, 3, 4)))
    return (
        F.when(kind == "email", email_like(entity, hexes))
        .when(kind == "secret", secret_like(entity, hexes))
        .when(kind == "ipv4", F.when(late > 0, F.concat(F.lit("2001:db8"), *(F.concat(F.lit(":"), F.substring(hexes, 1 + 4 * i, 4)) for i in range(6)))).otherwise(octets))
        .when(kind == "phone", same_form(longer, hexes, F.length(F.regexp_extract(canon, CALLING_CODE, 1))))
        .when(kind == "iban", iban_like(entity, longer, hexes))
        .when(kind == "account", account_like(entity, longer, hexes))
        .when(kind == "given", given_like(entity, gender, hexes, attempt))
        .when(kind == "family", family_like(entity, hexes, attempt))
        .otherwise(same_form(longer, hexes))
    )


def surrogate(atom: Column, key: str, attempt: Column, gender: Column) -> Column:
    kind, canon, entity = (atom.getField(n) for n in ("kind", "canon", "entity"))
    return let(draw(kind, canon, attempt, key), lambda hexes: drawn_like(kind, canon, entity, gender, hexes, attempt))


def hinted(text: str) -> Column:
    return F.coalesce(F.col(text).rlike(HINT), F.lit(False))


def entities(text: str) -> Column:
    """All entities of a text, in order."""
    return F.regexp_extract_all(text, F.lit(PATTERN), F.lit(0))


def exceptions(docs: DataFrame, text: str, key: str) -> DataFrame:
    """kind, canon, attempt and gender of the distinct atoms whose first draws collide or whose titles don't agree.

    A draw collides if it spells an entity of the corpus (a name part: a given or a family name), or one drawn in an earlier round or, in one round, by an entity that sorts
    before.  Under titles of one gender and of none, a given name has that gender; of both, none.  Only what collides goes on to the next round.
    """
    found = docs.where(hinted(text)).select(F.explode(entities(text)).alias("entity")).select(F.inline(atoms(F.col("entity")))).where("kind <> 'initial'")
    seen = lambda g: F.max(F.col("gender") == g)
    gender = F.when(seen("m") & ~seen("f"), "m").when(seen("f") & ~seen("m"), "f").otherwise("n")
    known = materialize(found.groupBy("kind", "canon").agg(F.min("entity").alias("entity"), gender.alias("gender"), (F.min("gender") != F.max("gender")).alias("mixed")))
    realm = F.when(F.col("kind").isin("given", "family"), "name").otherwise(F.col("kind"))
    real = known.select(realm.alias("realm"), F.col("canon").alias("drawn"), F.lit(True).alias("real")).distinct()
    active, settled, special = known.withColumn("attempt", F.lit(0)), [], []
    for _ in range(MOST_ATTEMPTS):
        made = surrogate(F.struct("kind", "canon", "entity"), key, F.col("attempt"), F.col("gender"))
        drawn = active.withColumn("realm", realm).withColumn("drawn", canonical(made, F.col("kind")))
        drawn = drawn.withColumn("place", F.row_number().over(Window.partitionBy("kind", "drawn").orderBy("canon"))).join(real, ["realm", "drawn"], "left")
        for earlier in settled[:1]:
            drawn = drawn.join(earlier.withColumn("taken", F.lit(True)), ["kind", "drawn"], "left")
        again = (F.col("place") > 1) | F.col("real").isNotNull() | (F.col("taken").isNotNull() if settled else F.lit(False))
        told = materialize(drawn.select(*known.columns, "attempt", "drawn", again.alias("again")))
        fine = told.where("NOT again")
        settled = [e.unionByName(fine.select("kind", "drawn")) for e in settled] or [fine.select("kind", "drawn")]
        special.append(fine.where("attempt > 0 OR mixed").select("kind", "canon", "attempt", "gender"))
        active = told.where("again").drop("drawn", "again").withColumn("attempt", F.col("attempt") + 1)
        if not active.limit(1).count():
            return reduce(DataFrame.unionByName, special)
    raise RuntimeError("surrogates still collide after the last attempt")


def sought(entries: Column, steps: Column, key: Column, of: Callable[[Column], Column] = lambda x: x) -> Column:
    """The entry of a sorted array whose key, of(entry), is key; null if there is none.  steps: halving_steps(entries)."""
    last = F.aggregate(steps, F.lit(-1), lambda at, step: F.when(of(F.get(entries, at + step)) <= key, at + step).otherwise(at))
    return let(F.get(entries, last), lambda x: F.when(of(x) == key, x))


def halving_steps(entries: Column) -> Column:
    """Powers of two, falling to 1, that sum to the array's size at least."""
    n = F.ceil(F.log2(F.size(entries) + F.lit(1.0))).cast("int")
    return F.transform(F.sequence(F.greatest(n, F.lit(1)) - 1, F.lit(0), F.lit(-1)), lambda k: F.pow(F.lit(2.0), k).cast("int"))


def linked(between: Column, told: Column) -> Column:
    """The texts between entities, in which names that a title or cue told (told: title, atoms and made of every entity) stand for themselves.

    A whole name (given names and family name, at most three parts, a blank between them) and a family name alone are rewritten, each part with its own surrogate.  Where whole
    names overlap, a part belongs to the one that begins first, of these the longest.  All are found in the text as it was, so no surrogate is ever rewritten.
    """
    parts = lambda t, *kinds: F.filter(F.arrays_zip(t.getField("atoms"), t.getField("made")), lambda z: z.getField("atoms").getField("kind").isin(*kinds))
    names = F.filter(told, lambda t: F.exists(t.getField("atoms"), lambda a: a.getField("kind") == "family"))
    whole = lambda t: F.array_join(F.transform(parts(t, "given", "family"), lambda z: z.getField("atoms").getField("entity")), " ")
    entry = lambda z: F.struct(z.getField("atoms").getField("entity").alias("entity"), z.getField("made").alias("made"))
    listed = lambda own, kind: F.array_sort(F.flatten(F.transform(own, lambda t: F.transform(parts(t, kind), entry))))
    tables = let(names, lambda own: F.struct(F.array_sort(F.transform(own, whole)).alias("wholes"), listed(own, "given").alias("given"), listed(own, "family").alias("family")))
    tables = let(tables, lambda t: F.struct(t.alias("of"), *(halving_steps(t.getField(n)).alias(n) for n in ("wholes", "given", "family"))))

    def rewritten_piece(piece: Column, tb: Column) -> Column:
        table, steps = lambda n: tb.getField("of").getField(n), tb.getField
        seek = lambda n, key: sought(table(n), steps(n), key, lambda x: x if n == "wholes" else x.getField("entity"))

        def of(p: Column) -> Column:
            word = lambda i: F.get(p.getField("words"), i)
            near = lambda i: F.get(p.getField("gaps"), i) == " "
            two = lambda i: F.when(near(i + 1), F.concat_ws(" ", word(i), word(i + 1)))
            three = lambda i: F.when(near(i + 1) & near(i + 2), F.concat_ws(" ", word(i), word(i + 1), word(i + 2)))
            longest = lambda w, i: F.when(seek("wholes", three(i)).isNotNull(), 3).when(seek("wholes", two(i)).isNotNull(), 2).when(seek("family", w).isNotNull(), 1).otherwise(0)

            def placed(long: Column) -> Column:
                at = lambda i: F.when(i >= 0, F.get(long, i)).otherwise(0)
                family = lambda i: (at(i - 2) == 3) | (at(i - 1) == 2) | ((at(i - 1) < 2) & (at(i) == 1))
                given = lambda i: (at(i - 1) == 3) | (at(i) >= 2)
                out = lambda w, i: F.when(family(i), seek("family", w).getField("made")).when(given(i), seek("given", w).getField("made")).otherwise(w)
                return F.transform(p.getField("words"), out)

            made = let(F.transform(p.getField("words"), longest), placed)
            return F.array_join(F.zip_with(p.getField("gaps"), made, lambda g, w: F.concat(g, F.coalesce(w, F.lit("")))), "")

        return let(F.struct(F.regexp_extract_all(piece, F.lit(CAPITAL_WORD), F.lit(0)).alias("words"), F.split(piece, CAPITAL_WORD, -1).alias("gaps")), of)

    return let(tables, lambda tb: F.when(F.size(tb.getField("of").getField("family")) == 0, between).otherwise(F.transform(between, lambda piece: rewritten_piece(piece, tb))))


def rewritten(rows: DataFrame, key: str, again: bool) -> DataFrame:
    """rows with text rewritten; again: whether they have a column again, a sorted array of structs of kind:canon, attempt and gender."""
    text = F.col("text")
    pairs = F.zip_with(F.split(text, PATTERN, -1), entities("text"), lambda a, b: F.when(b.isNull(), F.array(a)).otherwise(F.array(a, b)))
    pieces = F.when(text.contains(MARK), F.flatten(pairs)).otherwise(F.split(F.regexp_replace(text, PATTERN, f"{MARK}$0{MARK}"), MARK))

    def made(atom: Column, special: Column | None) -> Column:
        if special is None:
            return surrogate(atom, key, F.lit(0), atom.getField("gender"))
        own = sought(special.getField("of"), special.getField("steps"), F.concat(atom.getField("kind"), F.lit(":"), atom.getField("canon")), lambda x: x.getField("k"))
        return let(own, lambda x: surrogate(atom, key, F.coalesce(x.getField("attempt"), F.lit(0)), F.coalesce(x.getField("gender"), atom.getField("gender"))))

    def told(e: Column, special: Column | None) -> Column:
        return let(atoms(e), lambda a: F.struct(title_of(e).alias("title"), a.alias("atoms"), F.transform(a, lambda x: made(x, special)).alias("made")))

    def new(p: Column, special: Column | None) -> Column:
        """The text from its pieces: entities at odd places, the text between them at even ones."""
        found = F.transform(F.filter(p, lambda _, i: i % 2 == 1), lambda e: told(e, special))
        joined = lambda own: F.zip_with(linked(F.filter(p, lambda _, i: i % 2 == 0), own), F.transform(own, lambda t: F.concat(t.getField("title"), F.array_join(t.getField("made"), " "))), lambda a, b: F.concat(a, F.coalesce(b, F.lit(""))))
        return F.array_join(let(found, joined), "")

    def of(p: Column) -> Column:
        if not again:
            return new(p, None)
        return let(F.struct(F.col("again").alias("of"), halving_steps(F.col("again")).alias("steps")), lambda special: new(p, special))

    own = let(F.when(hinted("text"), pieces), lambda p: F.when(F.size(p) > 1, of(p)))
    return rows.withColumn("text", F.coalesce(own, text))


def replace_pii(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """docs with surrogates in text, drawn with the secret key; all other columns and rows stay.  Null and empty texts stay as they are, repeated rows stay equal, an empty
    table stays empty.

    Equal entities get equal surrogates over the whole table, different ones different ones; none spells an entity of the table.
    """
    own = docs.select(F.col(f"`{text}`").alias("text"))
    again = materialize(exceptions(own, "text", key))
    rows = packed(docs).withColumn("text", field(text))
    n = again.count()
    if n:
        held = F.md5(F.coalesce("text", F.lit("")).cast("binary"))
        found = own.where(hinted("text")).select(held.alias("held"), F.explode(F.array_distinct(entities("text"))).alias("entity")).select("held", F.inline(atoms(F.col("entity"))))
        special = again.select("kind", "canon", "attempt", "gender")
        met = found.select("held", "kind", "canon").join(F.broadcast(special) if n <= BROADCAST_ROWS else special, ["kind", "canon"]).select("held", F.concat("kind", F.lit(":"), "canon").alias("k"), "attempt", "gender").distinct()
        lists = materialize(met.groupBy("held").agg(F.array_sort(F.collect_list(F.struct("k", "attempt", "gender"))).alias("again")))
        rows = rows.withColumn("held", held).join(F.broadcast(lists) if lists.count() <= BROADCAST_ROWS else lists, "held", "left")
        rows = rows.withColumn("again", F.coalesce("again", F.array().cast(lists.schema["again"].dataType)))
    return unpacked(rewritten(rows, key, n > 0), **{text: F.col("text")})


def session_key(spark: SparkSession) -> str:
    """The key that the session's setting holds, else the test key."""
    return spark.conf.get(KEY_SETTING, None) or TEST_KEY


def op6_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id and rewritten text of every document; see replace_pii for nulls, repeats and empty tables."""
    docs = table(spark, sf_dir, "documents")
    return replace_pii(docs.select("doc_id", "text"), session_key(spark))
