"""Surrogates against a plain version of the whole replacement."""

import hashlib
import re
from collections import defaultdict

import pytest
import regex
from pyspark.sql import functions as F

import tallyforge.llm.pii as P
from tallyforge.llm.pii import entities, exceptions, replace_pii

KEY = "k"


def kind_of(e):
    return next((n for n, p in P.PATTERNS.items() if n != "name" and regex.fullmatch(p, e)), "name")


def canonical(e, kind):
    plain = re.sub("[^0-9A-Za-z]", "", e)
    if kind in ("email", "secret", "family", "given"):
        return e.lower()
    return e if kind == "ipv4" else ("+" if e.startswith("+") else "") + plain if kind == "phone" else plain.upper()


def atoms(e):
    kind = kind_of(e)
    if kind != "name":
        return "", [(kind, canonical(e, kind), e, "n")]
    title = regex.match(rf"(?:(?:{P.ALL_TITLES})\.? )?", e)[0]
    gender = next((g for g in "mf" if title.strip(" .") in P.TITLES[g]), "n")
    tokens = e[len(title) :].split(" ")
    initial = [bool(regex.fullmatch(r"(?:\p{Lu}\.)+", t)) for t in tokens]
    last = max(i for i, x in enumerate(initial) if not x)
    out = []
    for i, t in enumerate(tokens):
        kind = "initial" if initial[i] else "family" if i == last else "given"
        out.append((kind, f"{tokens[last].lower()}:{t}" if initial[i] else t.lower(), t, gender))
    return title, out


def luhn(digits):
    return sum(d if i % 2 == 0 else d * 2 - 9 * (d * 2 > 9) for i, d in enumerate(map(int, reversed(digits)))) % 10


def mod97(text):
    return int("".join(str(int(c, 36)) for c in text)) % 97


def made(atom, attempt, gender):
    kind, canon, e, _ = atom
    hexes = "".join(hashlib.sha512(f"{KEY}|{part}|{attempt}|{kind}|{canon}".encode()).hexdigest() for part in "ab")
    at = lambda i, n=2: int(hexes[2 * i : 2 * i + n], 16)
    late = max(0, attempt - 2)

    def form(keep=0):
        out, rank = "", -1
        for c in e + "0000" * min(late, 8):
            plain = re.fullmatch("[0-9A-Za-z]", c)
            rank += bool(plain)
            if not plain or rank < keep:
                out += c
            else:
                out += str(at(rank) % 10) if c.isdigit() else chr((65 if c.isupper() else 97) + at(rank) % 26)
        return out

    script = "Cyrillic" if regex.search(r"\p{IsCyrillic}", e) else "Latin"
    syllables = lambda n, i: "".join(P.SYLLABLES[script][at(i + k) % len(P.SYLLABLES[script])] for k in range(min(n, 10)))
    if kind == "email":
        x = f"u{hexes[:12]}@mail{hexes[12:18]}.example.{e.rsplit('.', 1)[1].lower()}"
        return x if re.search("[a-z]", e) else x.upper()
    if kind == "secret":
        return hexes[: len(e)].upper() if re.search("[A-F]", e) else hexes[: len(e)]
    if kind == "ipv4":
        return "2001:db8" + "".join(":" + hexes[4 * i : 4 * i + 4] for i in range(6)) if late else f"{at(0, 4) % 223 + 1}.{at(2) % 256}.{at(3) % 256}.{at(4) % 256}"
    if kind == "phone":
        code = re.match(P.CALLING_CODE, canon)
        return form(len(code[1]) if code else 0)
    if kind == "iban":
        turned = lambda t, check: re.sub(" ", "", t)[4:] + t[:2] + check
        x = form(2)
        return f"{x[:2]}{98 - mod97(turned(x, '00')):02d}{x[4:]}" if mod97(turned(e, e[2:4])) == 1 else x
    if kind == "account":
        x = form()
        digits = re.sub(r"\D", "", x[:-1])
        return x[:-1] + str(-luhn(digits + "0") % 10) if luhn(re.sub(r"\D", "", e)) == 0 else x
    if kind in ("given", "family"):
        names = P.GIVEN[gender, script]
        x = names[at(0) % len(names)] + syllables(attempt, 1) if kind == "given" else syllables(4 + attempt, 1).capitalize()
        return x if regex.search(r"\p{Ll}", e) else x.upper()
    return form()


def slow_replace(texts):
    """Texts with surrogates, round by round as the definition has it."""
    found = [regex.findall(P.PATTERN, t or "") for t in texts]
    known, genders = {}, defaultdict(set)
    for es in found:
        for e in es:
            for a in atoms(e)[1]:
                if a[0] != "initial":
                    known[a[:2]] = min(known.get(a[:2], a), a, key=lambda x: x[2].encode())
                    genders[a[:2]].add(a[3])
    gender = {k: "m" if "m" in g and "f" not in g else "f" if "f" in g and "m" not in g else "n" for k, g in genders.items()}
    attempt = dict.fromkeys(known, 0)
    while True:
        drawn = defaultdict(list)
        for k, a in known.items():
            drawn[k[0], canonical(made(a, attempt[k], gender[k]), k[0])].append((attempt[k], k[1].encode(), k))
        names = ("given", "family")
        again = [x[2] for (kind, d), xs in drawn.items() for i, x in enumerate(sorted(xs)) if i or any((k, d) in known for k in (names if kind in names else (kind,)))]
        if not again:
            break
        for k in again:
            attempt[k] += 1
    of = lambda a: made(a, attempt.get(a[:2], 0), gender.get(a[:2], a[3]))
    out = []
    for t, es in zip(texts, found):
        if not es:
            out.append(t)
            continue
        told = [own for own in (atoms(e)[1] for e in es) if any(a[0] == "family" for a in own)]
        roles = {tuple(a[2] for a in own if a[0] != "initial"): [a for a in own if a[0] != "initial"] for own in told}
        family = {a[2]: a for own in told for a in own if a[0] == "family"}

        def bare(piece):
            words = list(regex.finditer(r"(?<![\p{L}\p{M}'’-])\p{Lu}[\p{L}\p{M}'’-]*", piece))
            atom_of = {}
            for k, w in enumerate(words):  # the whole name that begins first has a word, then the longer one
                for n in (3, 2):
                    own = words[k : k + n]
                    if len(own) == n and all(b.start() - a.end() == 1 and piece[a.end()] == " " for a, b in zip(own, own[1:])) and tuple(m[0] for m in own) in roles:
                        for m, a in zip(own, roles[tuple(m[0] for m in own)]):
                            atom_of.setdefault(m.start(), a)
                        break
            for w in words:
                if w[0] in family:
                    atom_of.setdefault(w.start(), family[w[0]])
            made_up, at = "", 0
            for w in words:
                if w.start() in atom_of:
                    made_up, at = made_up + piece[at : w.start()] + of(atom_of[w.start()]), w.end()
            return made_up + piece[at:]

        new, at = "", 0
        for m in regex.finditer(P.PATTERN, t):
            title, own = atoms(m[0])
            new, at = new + bare(t[at : m.start()]) + title + " ".join(map(of, own)), m.end()
        new += bare(t[at:])
        out.append(new)
    return out


TEXTS = [
    (1, "Mail ann@x.org or ANN@X.ORG, call +1 (017) 555-7713 from 10.2.3.4."),
    (2, "ann@x.org again; +10175557713 and 4111 1111 1111 1111, 4111111111111111; 078-05-1120. 555 123 4567, (555) 123-4567, 555.123.4567 and +44 20 7946 0958"),
    (3, 'token = "f3ef4d6b2755a36d7d9c25bd72c4d5f67e061fda" and Mrs. Anna Schmidt met Mr Schmidt. Frau Müller. Госпожа Анна Иванова! Иванова, Schmidt, Schmidts, Anna Schmidt, ANNA'),
    (4, None), (5, ""), (6, "Nothing here: version 4.0, year 2024, 12 of 30."), (7, "a" * 200_000), (1, "Mail ann@x.org or ANN@X.ORG, call +1 (017) 555-7713 from 10.2.3.4."), (None, "bob@y.de"),
    (8, "Mr John Smith, Mr Smith and Dr John Smith; Ms John Doe, Prof Jane Doe, Mr JOHN SMITH, Dr J. R. Smith, Mr John Q. Public. John Q. Public"),
    (9, "IBAN DE89 3704 0044 0532 0130 00, DE89370400440532013000 EUR, GB33BUKB20201555555555, NO93 8601 1117 947, DE00 3704 0044 0532 0130 00"),
    (10, "My name is Peter Pan. Contact: Wendy Darling\nSigned, Captain James Hook-O'Neil. My name is unknown. Mr X"),
    (11, f"{P.MARK} ann@x.org {P.MARK} Mr Smith {P.MARK}"), (12, "word " * 300_000 + "eve@z.net"), (13, "Mr J. Smith; Dr Łukasz Šimůnek"),
]


def test_surrogates_equal_a_plain_version(spark):
    docs = spark.createDataFrame(TEXTS, "doc_id long, text string").withColumn("again", F.lit("keep")).withColumn("row", F.lit(1)).withColumn("Pieces", F.lit(2)).repartition(3)
    got = replace_pii(docs, KEY).collect()
    assert all(r["again"] == "keep" and r["row"] == 1 for r in got)
    want = slow_replace([t for _, t in TEXTS])
    assert sorted(((r["doc_id"], r["text"]) for r in got), key=repr) == sorted(zip([i for i, _ in TEXTS], want), key=repr)
    assert replace_pii(docs, "another").where("doc_id = 2").first()["text"] != want[1]
    assert replace_pii(docs.where("false"), KEY).count() == 0


def test_spellings_of_one_entity_stay_one_entity():
    """What the plain version, equal to the operator's, keeps together and apart."""
    one, two, _, _, _, _, _, _, _, names, ibans, cues, *_ = slow_replace([t for _, t in TEXTS])
    mails = re.findall(r"\S+@\S+(?=[ ,;])", one + " " + two)
    assert len({m.strip(",;").lower() for m in mails}) == 1 and "ann@x" not in (one + two).lower()
    phone = re.search(r"\+1 \(\d{3}\) \d{3}-\d{4}", one)[0]
    assert "+" + re.sub(r"\D", "", phone) in two and "+44 " in two
    assert len({re.sub(r"\D", "", x) for x in re.findall(r"(?<![\d+])\(?\d{3}\)?[ .]\d{3}[ .-]\d{4}(?! ?\d)", two)}) == 1
    cards = re.search(r"(\d{4} \d{4} \d{4} \d{4}), (\d{16})", two)
    assert cards[1].replace(" ", "") == cards[2] != "4111111111111111" and luhn(cards[2]) == 0
    a, b, c, d, e, *_ = (re.sub("[ ,]", "", x) for x in re.findall(r"[A-Z]{2}\d\d[ 0-9A-Z]+?(?=,| EUR|$)", ibans))
    assert a == b and a[:2] == "DE" and all(mod97(x[4:] + x[:4]) == 1 for x in (a, c, d)) and mod97(e[4:] + e[:4]) != 1
    john = re.match(r"Mr (\S+) (\S+), Mr (\S+) and Dr (\S+) (\S+); Ms (\S+)", names)
    assert john[1] == john[4] == john[6] and john[2] == john[3] == john[5] and f"Mr {john[1].upper()} {john[2].upper()}" in names
    assert "Peter" not in cues and "Darling" not in cues and "unknown" in cues and "Hook" not in cues


def test_collisions_are_drawn_again(spark, monkeypatch):
    real = P.draw
    monkeypatch.setattr(P, "draw", lambda kind, canon, attempt, key: F.when(attempt == 0, F.lit("0" * 256)).otherwise(real(kind, canon, attempt, key)))
    docs = spark.createDataFrame([(1, "a@x.org b@x.org 1.2.3.4"), (2, "b@x.org c@x.org u000000000000@mail000000.example.org")], "doc_id long, text string")
    assert exceptions(docs, "text", "k").count() >= 3
    by = {r["doc_id"]: r["text"].split() for r in replace_pii(docs, "k").collect()}
    assert by[1][1] == by[2][0] and len({by[1][0], by[1][1], by[2][1], by[2][2]}) == 4
    monkeypatch.setattr(P, "BROADCAST_ROWS", -1)
    assert {r["doc_id"]: r["text"].split() for r in replace_pii(docs, "k").collect()} == by


def test_pattern_leaves_plain_numbers_alone(spark):
    docs = spark.createDataFrame([(1, "in 1999, 12-34, 3.14, 100,000 and 1.2.3 or version 10.2; 100 200 3000 40, AB12 is a code")], "doc_id long, text string")
    assert docs.select(F.size(entities("text")).alias("n")).first()["n"] == 0


def test_surrogates_find_room_when_a_form_is_full(spark, monkeypatch):
    """Draws of which only few differ: without growth of the space with the attempt, no round would ever be the last."""
    monkeypatch.setattr(P, "SYLLABLES", {k: v[:2] for k, v in P.SYLLABLES.items()})  # 16 family names of four syllables
    names = [f"Mr {a}{b}" for a in "ABCDEF" for b in ("xu", "yo", "ze", "qi", "wu")]
    out = replace_pii(spark.createDataFrame([(i, t) for i, t in enumerate(names)], "doc_id long, text string"), "k").collect()
    assert len({r["text"] for r in out}) == len(names) and not {r["text"] for r in out} & set(names)
    kinds = (("phone", "+1 12 34 56"), ("ssn", "078-05-1120"), ("ipv4", "1.2.3.4"), ("account", "4111 1111 1111 1111"))
    row = spark.range(1).select(*(P.drawn_like(F.lit(k), F.lit(e), F.lit(e), F.lit("n"), F.lit("5a" * 128), F.lit(9)).alias(k) for k, e in kinds)).first()
    assert len(row["phone"]) > 30 and len(row["ssn"]) > 30 and row["ipv4"].startswith("2001:db8:") and len(row["account"]) > 40
    monkeypatch.setattr(P, "MOST_ATTEMPTS", 1)
    with pytest.raises(RuntimeError):
        exceptions(spark.createDataFrame([(i, t) for i, t in enumerate(names)], "doc_id long, text string"), "text", "k")


def test_titled_names_are_found_to_their_ends(spark):
    names = ["Mr McDonald", "Ms O'Brien", "Mr Smith-Jones", "Dr J. Smith", "Mr JOHN SMITH", "Mr John Q. Public", "Frau Müller"]
    docs = spark.createDataFrame([(i, f"saw {n}, then left") for i, n in enumerate(names)], "doc_id long, text string")
    assert [r["e"] for r in docs.orderBy("doc_id").select(entities("text").alias("e")).collect()] == [[n] for n in names]


def persons_of(spark, texts, key=KEY):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return [r["text"] for r in sorted(replace_pii(docs, key).collect(), key=lambda r: r["doc_id"])]


def test_surrogates_are_never_rewritten(spark):
    """Given names that may be drawn stand as family names of the same text: each person keeps one surrogate, in any order, over the table."""
    drawn = P.GIVEN["m", "Latin"]
    texts = [f"Mr John Smith and Mr {d} met." for d in drawn] + [f"Mr {d} saw Mr John Smith. Smith left; {d} stayed, John Smith too." for d in drawn]
    got = persons_of(spark, texts)
    assert got == slow_replace(texts)
    john, smith = re.match(r"Mr (\S+) (\S+) and Mr (\S+) met", got[0]).groups()[:2]
    others = {}
    for d, first, second in zip(drawn, got, got[len(drawn) :]):
        a = re.fullmatch(r"Mr (\S+) (\S+) and Mr (\S+) met\.", first)
        b = re.fullmatch(r"Mr (\S+) saw Mr (\S+) (\S+)\. (\S+) left; (\S+) stayed, (\S+) (\S+) too\.", second)
        assert a[1] == b[2] == b[6] == john and a[2] == b[3] == b[4] == b[7] == smith and a[3] == b[1] == b[5]
        others[d] = a[3]
    assert len({*others.values(), john, smith}) == len(drawn) + 2 and not {*others.values(), john, smith} & {*drawn, "John", "Smith"}


def test_bare_names_that_overlap_and_chain(spark):
    texts = ["Mr Anna Maria met Ms Maria Schmidt. Anna Maria Schmidt, Maria Anna Maria Schmidt; Anna  Maria, Schmidt-Maria Maria's Schmidt", "Mr Jo Ann Lee and Dr Ann Lee: Jo Ann Lee Jo Ann Lee Ann Lee Lee Ann", "Mr Lee Lee. Lee Lee Lee Lee", "Dr X. Öz of Öz, ÖZ\nÖz Öz"]
    assert persons_of(spark, texts) == slow_replace(texts)


def test_very_many_names_in_one_text(spark):
    """A long text of names takes one pass: thirty times the text, with eight times the names, is far from thirty times eight times the work."""
    import time

    alphabet = [a + b for a in "bdfghklmnprst" for b in "aeiou"]
    names = [f"{alphabet[i % 65].capitalize()}{alphabet[i // 65 % 65]}{alphabet[i // 4225]} Q{alphabet[i % 65]}{alphabet[i // 65 % 65]}x" for i in range(8000)]
    small = " and ".join(f"Mr {n}" for n in names[:1000]) + ". " + ", ".join(names[:1000])
    large = (" and ".join(f"Mr {n}" for n in names) + ". " + ", ".join(names * 9))
    assert len(large) > 30 * len(small)
    persons_of(spark, [small])
    took = []
    for text in (small, large):
        began = time.time()
        out = persons_of(spark, [text])[0]
        took.append(time.time() - began)
        assert not any(n.split(" ")[1] in out for n in names[:50]) and out.count(" and ") == text.count(" and ")
    assert took[1] < 20 * (took[0] + 3)
