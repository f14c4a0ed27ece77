"""Surrogates for personal data and secrets.

Entities are found by pattern: e-mail addresses, IP addresses, telephone, card, social security and bank account
numbers, access keys, values of passwords and tokens, names after a form of address or a title, and known given names
that a capitalised name follows. A value's spellings are one value: spaces and dashes of numbers, the case of addresses
and of names written in capitals don't count. The distinct values of the whole corpus get one keyed surrogate each:
every letter and digit is replaced by one of the same kind, drawn from a SHA-512 stream of key, type, value and attempt,
while length, fixed prefixes (a country code, the mark of an access key, the top-level domain) stay, and check digits of
cards and bank accounts are valid. Each place shows the surrogate in its own spelling. Names get names of the same
gender (by the form of address, else by the given name) and script. The surrogates are then compared: a value whose
surrogate is another value's surrogate, or a real value of its type, moves on to its next attempt, until no two are
alike. So distinct values stay distinct, and one value is the same surrogate wherever it occurs: a surname alone and with
a given name, a secret under any keyword. From the ninth attempt on a surrogate grows by a character each time, so
that even types with few values of their shape come to an end.

Texts are cut at their entities and put together again with the surrogates, so nothing else in them changes. Only DataFrame
functions run. Values are gathered by a grouped aggregation, and a frequent value meets its surrogate in a join that
can be split.

Defined results: a null text stays null, with 0 entities; repeated rows give repeated rows; rows that share an id are told
apart by their text; texts without entities are returned as they are; an empty table gives an empty result; other columns
stay, whatever their names.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm.common import as_rows, discard, field, fields, settle, text_digest

#: Forms of address by gender (m, f) and script, and given names to draw from (fixed values).
ADDRESS = {
    ("m", "latin"): ["Mr", "Mister", "Herr", "Monsieur", "Señor", "Sr"],
    ("f", "latin"): ["Mrs", "Ms", "Miss", "Frau", "Madame", "Mme", "Señora", "Señorita", "Sra"],
    ("m", "cyrillic"): ["господин"],
    ("f", "cyrillic"): ["госпожа"],
    ("m", "greek"): ["κύριος"],
    ("f", "greek"): ["κυρία"],
    ("m", "arabic"): ["السيد"],
    ("f", "arabic"): ["السيدة"],
}
GIVEN = {
    ("m", "latin"): ["Alan", "Bruno", "Carlos", "David", "Emil", "Felix", "Georg", "Henri", "Ivan", "Jonas", "Louis", "Marco", "Noel", "Oscar", "Paul", "Simon"],
    ("f", "latin"): ["Alice", "Berta", "Clara", "Diana", "Elena", "Flora", "Greta", "Helen", "Irene", "Julia", "Laura", "Marie", "Nina", "Olga", "Paula", "Sofia"],
    ("m", "cyrillic"): ["Антон", "Борис", "Виктор", "Денис", "Егор", "Иван", "Максим", "Олег"],
    ("f", "cyrillic"): ["Анна", "Вера", "Дарья", "Елена", "Ирина", "Мария", "Нина", "Ольга"],
    ("m", "greek"): ["Ανδρέας", "Γιάννης", "Κώστας", "Νίκος", "Πέτρος", "Σπύρος"],
    ("f", "greek"): ["Άννα", "Ελένη", "Μαρία", "Νίκη", "Σοφία", "Χαρά"],
    ("m", "arabic"): ["أحمد", "حسن", "خالد", "سامي", "عمر", "كريم"],
    ("f", "arabic"): ["أمل", "سارة", "فاطمة", "ليلى", "مريم", "هدى"],
}
SYLLABLES = {
    "latin": ["ba", "de", "fi", "go", "ka", "le", "mo", "nu", "pa", "re", "si", "to", "va", "we", "zi", "han"],
    "cyrillic": ["ба", "ве", "го", "ди", "ка", "ле", "мо", "ну", "па", "ре", "си", "то", "фа", "хо", "ши", "жа"],
    "greek": ["βα", "γε", "δι", "κα", "λε", "μο", "νυ", "πα", "ρε", "σι", "το", "φα", "χο", "ψι", "ξα", "θε"],
    "arabic": ["با", "تي", "جا", "دو", "را", "سي", "شا", "فو", "قا", "كي", "لا", "مو", "نا", "هي", "وا", "زي"],
}
SCRIPT_CLASS = {"latin": r"\p{IsLatin}", "cyrillic": r"\p{IsCyrillic}", "greek": r"\p{IsGreek}", "arabic": r"\p{IsArabic}"}

#: Titles of either gender, and given names beyond those to draw from (fixed values).
TITLES = ["Dr", "Prof", "Doctor", "Professor", "Professeur", "Doktor"]
KNOWN = {
    "m": "Adam Albert Alejandro Alexander Andreas Andrew Anthony Antoine Benjamin Charles Christian Christopher Daniel Diego Edward Eric Fernando François Frank Frederic George Guillaume Hans Heinrich Henry Jacques James Javier Jean Johann John Jorge José Joseph Juan Julien Jürgen Karl Kevin Klaus Luis Manuel Martin Matthew Matthias Michael Michel Miguel Nicolas Patrick Pedro Peter Philippe Pierre Rafael Richard Robert Sebastian Stefan Stephen Steven Thomas Timothy Werner William Wolfgang".split(),
    "f": "Alexandra Amelia Andrea Angela Anna Anne Barbara Beatriz Carmen Caroline Catherine Céline Charlotte Christine Claudia Deborah Dorothy Elisabeth Elizabeth Emily Emma Eva Françoise Hannah Heike Isabel Isabelle Jennifer Jessica Johanna Juliette Karen Katharina Kathleen Lisa Lucía Margaret María Martha Mary Monika Nathalie Nicole Patricia Pilar Rachel Rebecca Rosa Sabine Sandra Sarah Sophie Stephanie Susan Susanne Teresa Ursula Véronique Virginia".split(),
}
#: Country codes of two digits; +1 and +7 have one, the rest three (fixed values).
TWO_DIGITS = "20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split()
#: Attempts with the value's own length, and attempts at all; the space grows at least tenfold with each beyond WIDEN.
WIDEN, ATTEMPTS = 8, 64

_B, _E = r"(?<![\p{L}\p{N}])", r"(?![\p{L}\p{N}])"
EMAIL = r"[A-Za-z0-9][A-Za-z0-9._%+-]*@(?:[A-Za-z0-9-]+\.)+[A-Za-z]{2,24}"
KEYED = r"(?:[Pp]assword|PASSWORD|[Pp]asswd|[Pp]wd|[Ss]ecret|SECRET|[Tt]oken|TOKEN|[Aa]pi[_-]?[Kk]ey|API[_-]?KEY)\s{0,3}[=:]\s{0,3}[\"']?(?=[+/_.-]*[A-Za-z0-9])[A-Za-z0-9+/_.-]{6,}"
ACCESS = r"(?:AKIA|ASIA)[A-Z0-9]{16}" + _E
IBAN = r"[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?" + _E
SSN = r"[0-9]{3}-[0-9]{2}-[0-9]{4}" + _E
PHONE = r"\+[0-9]{1,3}[ .-]?(?:\([0-9]{1,4}\)[ .-]?)?[0-9]{2,4}(?:[ .-]?[0-9]{2,4}){1,4}" + _E + r"|\([0-9]{3}\) ?[0-9]{3}-[0-9]{4}" + _E + r"|[0-9]{3}[-.][0-9]{3}[-.][0-9]{4}" + _E
CARD = r"[0-9]{4}(?:[ -]?[0-9]{4}){2}[ -]?[0-9]{1,7}" + _E + r"|[0-9]{4}[ -][0-9]{6}[ -][0-9]{4,5}" + _E
IP4 = r"(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?![0-9]|\.[0-9])"
_H = "[0-9A-Fa-f]{1,4}"


def _tail(n: int) -> str:
    """Up to n groups after ::, the last two also as an IPv4 address."""
    return (rf"(?:(?:{_H}:){{0,{n - 2}}}{IP4}|" if n > 1 else "(?:") + (rf"{_H}(?::{_H}){{0,{n - 1}}}{_E})" if n else ")")


#: Compressed addresses have a digit or start as private or multicast ones do, as all that are given out; add::bed is code.
IP6 = rf"(?:{_H}:){{7}}{_H}{_E}|(?:{_H}:){{6}}{IP4}|(?=[0-9A-Fa-f:]*[0-9]|[Ff][C-Fc-f][0-9A-Fa-f]{{2}}:)(?:" + "|".join([rf"{_H}(?::{_H}){{{i - 1}}}::(?:{_tail(7 - i)}|{_E})" for i in range(7, 0, -1)] + [f"::{_tail(7)}"]) + ")"
_FORMS = "|".join(sorted([x for v in ADDRESS.values() for x in v] + TITLES, key=len, reverse=True))


def _tree(words: list[str]) -> str:
    """The words as alternatives under their first letters, which is quicker to try."""
    firsts = sorted({w[0] for w in words})
    return "(?:" + "|".join(f + "(?:" + "|".join(sorted((w[1:] for w in words if w[0] == f), key=lambda w: (-len(w), w))) + ")" for f in firsts) + ")"


def _given(gender: str) -> list[str]:
    """The known given names of a gender, of scripts that have capitals."""
    return sorted({n for (g, script), names in GIVEN.items() if g == gender and script != "arabic" for n in names} | set(KNOWN[gender]))


_PART = r"\p{Lu}[\p{L}'’-]+|[ء-ي]{2,}"
#: Capitalised parts go on as far as they do; Arabic has no capitals to tell a name's end by, so two words count there.
NAME = rf"(?:{_FORMS})\.? (?:{_PART})(?: (?:{_PART}))?(?: \p{{Lu}}[\p{{L}}'’-]+)*"
#: Initials may stand between a known given name and the next capitalised part.
CALLED = _tree(sorted({*_given("m"), *_given("f")})) + rf"(?: \p{{Lu}}\.)*(?: \p{{Lu}}[\p{{L}}'’-]+)+"
#: What the alternatives begin with, looked at first: most places fail there, and the long alternatives are not tried.
_NUMBER, _GROUP, _NAMED = "(?=[0-9+(])", "(?=[0-9A-Fa-f]{0,4}:)", r"(?=[A-Z\x{80}-\x{10FFFF}])"
#: In this order, so that what stands first wins where two begin at the same place.
_IN_WORDS = "|".join([KEYED, ACCESS, IBAN, f"{_GROUP}(?:{IP6})", f"{_NUMBER}(?:{'|'.join([IP4, SSN, PHONE, CARD])})", f"{_NAMED}(?:{NAME}|{CALLED})"])
PATTERN = r"(?<![A-Za-z0-9._%+-])" + EMAIL + "|" + _B + f"(?:{_IN_WORDS})"
#: What an entity needs: without one of these a text holds none, and the long pattern isn't tried.
QUICK = rf"[0-9@=:]|{_NAMED}(?:AKIA|ASIA|(?:{_FORMS})\.? |{_tree(sorted({*_given('m'), *_given('f')}))} \p{{Lu}})"


def _pick(options: list[str], n: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, options)), (n % len(options) + 1).cast("int"))


def _parts(e: Column) -> Column:
    """An entity as an array of (kind, value, plain): plain text stays, values are replaced."""

    def plain(x: Column) -> Column:
        return F.struct(F.lit(None).cast("string").alias("kind"), F.lit(None).cast("string").alias("value"), x.alias("plain"))

    def value(kind: Column | str, x: Column) -> Column:
        return F.struct((F.lit(kind) if isinstance(kind, str) else kind).alias("kind"), x.alias("value"), F.lit(None).cast("string").alias("plain"))

    def whole(p: str) -> Column:
        return e.rlike(f"^(?:{p})$")

    kinds = reduce(lambda rest, kp: F.when(whole(kp[1]), F.lit(kp[0])).otherwise(rest), [("card", CARD), ("phone", PHONE), ("ssn", SSN), ("ip4", IP4), ("ip6", IP6), ("iban", IBAN), ("access", ACCESS), ("email", EMAIL)], F.lit("other"))
    keyed = r"^([A-Za-z_-]+\s{0,3}[=:]\s{0,3}[\"']?)(.*)$"
    form = F.regexp_extract(e, rf"^(?:{_FORMS})(?=\.? )", 0)
    head = F.regexp_extract(e, rf"^(?:{_FORMS})\.? ", 0)
    names = F.split(F.substr(e, F.length(head) + 1), " ")
    by_name = F.when(F.exists(names, lambda x: F.initcap(x).isin(_given("f"))), F.lit("f")).otherwise(F.lit("m"))
    script_of = reduce(lambda rest, k: F.when(F.element_at(names, -1).rlike(SCRIPT_CLASS[k]), F.lit(k)).otherwise(rest), SCRIPT_CLASS, F.lit("latin"))
    group = reduce(lambda rest, g: F.when(form.isin(ADDRESS[g]), F.lit(":".join(g))).otherwise(rest), ADDRESS, F.concat(by_name, F.lit(":"), script_of))
    script = F.substring_index(group, ":", -1)
    last = value(F.concat(F.lit("surname:"), script), F.element_at(names, -1))

    def one(x: Column) -> Column:
        initial = x.rlike(r"^\p{Lu}\.$")
        return F.array(F.when(initial, plain(x)).otherwise(value(F.concat(F.lit("given:"), group), x)), plain(F.lit(" ")))

    given = F.flatten(F.transform(F.slice(names, 1, F.size(names) - 1), one))
    named = F.concat(F.array(plain(head)), given, F.array(last))
    return F.when(whole(KEYED), F.array(plain(F.regexp_extract(e, keyed, 1)), value("secret", F.regexp_extract(e, keyed, 2)))).when(whole(NAME) | whole(CALLED), named).otherwise(F.array(value(kinds, e)))


def normalised(kind: Column, value: Column) -> Column:
    """One form for all spellings of a value."""
    digits, named = kind.isin("phone", "card"), kind.startswith("surname:") | kind.startswith("given:")
    return F.when(digits, F.regexp_replace(value, "[^0-9+]", "")).when(kind == "iban", F.replace(value, F.lit(" "), F.lit(""))).when(kind.isin("email", "ip6") | named, F.lower(value)).otherwise(value)


def spelt(kind: Column, value: Column, made: Column) -> Column:
    """The surrogate of a value as its place spells it: grouped and in capitals as the value is."""
    chars, fresh = F.regexp_extract_all(value, F.lit("(?s)."), F.lit(0)), F.regexp_replace(made, "[^0-9A-Za-z]", "")
    start = F.struct(F.lit("").alias("out"), F.lit(1).alias("at"))

    def put(s: Column, c: Column) -> Column:
        place = c.rlike("[0-9A-Za-z]")
        return F.struct(F.concat(s["out"], F.when(place, F.substr(fresh, s["at"], F.lit(1))).otherwise(c)).alias("out"), (s["at"] + F.when(place, 1).otherwise(0)).alias("at"))

    grouped = F.aggregate(chars, start, put, lambda s: F.concat(s["out"], F.substr(fresh, s["at"])))
    capital = (value == F.upper(value)) & (value != F.lower(value))
    raised = F.array_join(F.transform(F.regexp_extract_all(made, F.lit("(?s)."), F.lit(0)), lambda c, i: F.when(F.coalesce(F.get(chars, i).between("A", "Z"), F.lit(False)), F.upper(c)).otherwise(c)), "")
    named = kind.startswith("surname:") | kind.startswith("given:")
    return F.when(kind.isin("phone", "card", "iban"), grouped).when((kind == "email") & (F.length(made) == F.length(value)), raised).when((named | (kind == "ip6")) & capital, F.upper(made)).otherwise(made)


def _stream(key: str, kind: Column, value: Column, attempt: Column, n: Column) -> Column:
    """An array of at least n numbers below 256, as pairs of hex digits of SHA-512 digests."""
    seed = F.concat_ws("\x1f", F.lit(key), kind, value, attempt.cast("string"))
    blocks = F.sequence(F.lit(0), (n / 64).cast("int"))
    return F.transform(F.flatten(F.transform(blocks, lambda i: F.regexp_extract_all(F.sha2(F.concat_ws("\x1f", seed, i.cast("string")), 512), F.lit(".."), F.lit(0)))), lambda h: F.conv(h, 16, 10).cast("int"))


def _luhn(digits: Column) -> Column:
    """The check digit for an array of digits."""
    n = F.size(digits)
    doubled = F.transform(digits, lambda d, i: F.when((n - i) % 2 == 1, F.when(d > 4, 2 * d - 9).otherwise(2 * d)).otherwise(d))
    return (10 - F.aggregate(doubled, F.lit(0), lambda s, x: s + x) % 10) % 10


def _let(x: Column, body) -> Column:
    """body(x), with x computed once."""
    return F.get(F.transform(F.array(x), body), F.lit(0))


def surrogate(key: str, kind: Column, value: Column, attempt: Column) -> Column:
    """The surrogate of a value at an attempt: the same kind of character in each place that may change."""
    chars = F.regexp_extract_all(value, F.lit("(?s)."), F.lit(0))
    drawn = _stream(key, kind, value, attempt, F.greatest(F.length(value) + attempt, attempt + 4))
    return _let(F.struct(drawn.alias("r"), chars.alias("c")), lambda x: _surrogate(kind, value, attempt, x["r"], x["c"]))


def _surrogate(kind: Column, value: Column, attempt: Column, r: Column, chars: Column) -> Column:
    fixed = F.when(kind == "access", 4).when(kind == "iban", 2).when((kind == "phone") & value.startswith("+"), F.when(F.substring(value, 2, 1).isin("1", "7"), 2).when(F.substring(value, 2, 2).isin(TWO_DIGITS), 3).otherwise(4)).when(kind == "card", 1).otherwise(0)
    until = F.when(kind == "email", F.size(chars) - F.length(F.substring_index(value, ".", -1)) - 1).otherwise(F.size(chars))
    hexed = (kind == "secret") & value.rlike("^[0-9a-f]+$")

    def shaped(p: Column) -> Column:
        def other(c: Column, i: Column) -> Column:
            x = F.get(r, i)
            lead = (i == 0) | ~F.coalesce(F.get(chars, i - 1).between("0", "9"), F.lit(False))  # a number keeps from starting with 0
            digit = F.when(~p["hexed"] & lead & (c != "0"), x % 9 + 1).otherwise(x % 10).cast("string")
            return (
                F.when((i < p["fixed"]) | (i >= p["until"]), c)
                .when(c.between("0", "9"), digit)
                .when(c.between("a", "z"), F.substr(F.lit("abcdefghijklmnopqrstuvwxyz"), x % F.when(p["hexed"], 6).otherwise(26) + 1, F.lit(1)))
                .when(c.between("A", "Z"), F.substr(F.lit("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), x % 26 + 1, F.lit(1)))
                .otherwise(c)
            )

        made = F.array_join(F.transform(chars, other), "")
        # further characters once the value's own shape may have run out
        letters = ~kind.isin("phone", "card", "ssn")
        more = F.array_join(F.transform(F.slice(r, F.size(chars) + 1, F.greatest(attempt - WIDEN, F.lit(0))), lambda x: F.when(letters, F.substr(F.lit("abcdefghijklmnopqrstuvwxyz"), x % F.when(p["hexed"], 6).otherwise(26) + 1, F.lit(1))).otherwise((x % 10).cast("string"))), "")
        more = F.when(kind.isin("access", "iban"), F.upper(more)).otherwise(more)
        return F.when(kind == "email", F.concat(more, made)).otherwise(F.concat(made, more))

    plain = _let(F.struct(fixed.alias("fixed"), until.alias("until"), hexed.alias("hexed")), shaped)

    def card(s: Column) -> Column:  # numbers that pass the check digit keep passing it
        digits = F.transform(F.regexp_extract_all(s, F.lit("[0-9]"), F.lit(0)), lambda d: d.cast("int"))
        mine = F.transform(F.regexp_extract_all(value, F.lit("[0-9]"), F.lit(0)), lambda d: d.cast("int"))
        passes = _luhn(F.slice(mine, 1, F.greatest(F.size(mine) - 1, F.lit(0)))) == F.element_at(mine, -1)
        check = _luhn(F.slice(digits, 1, F.greatest(F.size(digits) - 1, F.lit(0))))
        return F.when(passes, F.concat(F.substr(s, F.lit(1), F.length(s) - 1), check.cast("string"))).otherwise(s)

    def account(x: Column) -> Column:  # the check digits that make the number's remainder by 97 be 1
        own = F.substr(x, F.lit(5))

        def step(s: Column, c: Column) -> Column:
            return F.when(c.between("0", "9"), (s * 10 + c.try_cast("int")) % 97).otherwise((s * 100 + F.ascii(c) - 55) % 97)

        rest = F.aggregate(F.regexp_extract_all(F.concat(own, F.substr(x, F.lit(1), F.lit(2)), F.lit("00")), F.lit("."), F.lit(0)), F.lit(0), step)
        return F.concat(F.substr(x, F.lit(1), F.lit(2)), F.lpad((98 - rest).cast("string"), 2, "0"), own)

    ip = F.array_join(F.transform(F.split(value, r"\."), lambda o, i: (F.get(r, i) % 254 + 1).cast("string")), ".")

    def hexes(c: Column, i: Column) -> Column:
        h = F.substr(F.lit("123456789abcdef0"), F.get(r, i) % F.when((i == 0) | (F.get(chars, i - 1) == ":"), 15).otherwise(16) + 1, F.lit(1))
        return F.when(c == ":", c).when(c.between("A", "F"), F.upper(h)).otherwise(h)

    # short addresses have few of their shape: further attempts, and those with an IPv4 end, draw all eight groups
    groups = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.lower(F.hex((F.get(r, 2 * i) * 256 + F.get(r, 2 * i + 1)).cast("long")))), ":")
    ip6 = F.when((attempt > 0) | value.contains("."), groups).otherwise(F.array_join(F.transform(chars, hexes), ""))
    out = F.when(kind == "card", _let(plain, card)).when(kind == "iban", _let(plain, account)).when(kind == "ip4", ip).when(kind == "ip6", ip6)
    for script, parts in SYLLABLES.items():
        # a syllable more with each attempt, so that there are more surrogates than any number of values; draw 4 is the given name's
        drawn = F.transform(F.sequence(F.lit(0), attempt + 2), lambda i: _pick(parts, F.get(r, F.when(i < 4, i).otherwise(i + 1))))
        made = F.initcap(F.array_join(drawn, ""))
        out = out.when(kind == f"surname:{script}", made)
        for gender in "mf":
            given = _pick(GIVEN[gender, script], F.get(r, F.lit(4)))
            more = F.when(attempt > 0, F.concat(F.lit("-") if script != "arabic" else F.lit(" "), made)).otherwise("")
            out = out.when(kind == f"given:{gender}:{script}", F.concat(given, more))
    return out.otherwise(plain)


def surrogates(values: DataFrame, key: str) -> DataFrame:
    """(kind, value, surrogate) for the distinct (kind, value), no two of a kind alike, and none a value of its kind.

    Values are normalised ones.
    """
    # many columns' worth of work for each value: dealt to all cores, however few bytes there are
    values = values.repartition(int(values.sparkSession.conf.get("spark.sql.shuffle.partitions")), "kind", "value")
    held = settle(values.select("kind", "value", F.lit(0).alias("attempt"), surrogate(key, F.col("kind"), F.col("value"), F.lit(0)).alias("surrogate")), "surrogates")
    for _ in range(ATTEMPTS):
        taken = held.select("kind", F.col("value").alias("surrogate"), F.lit(1).alias("real"), F.lit(None).cast("string").alias("value"))
        drawn = held.select("kind", "surrogate", F.lit(0).alias("real"), "value")
        # the first by value keeps a shared surrogate, unless it is a real value
        owner = taken.union(drawn).groupBy("kind", "surrogate").agg(F.max("real").alias("real"), F.min("value").alias("owner"), F.count("value").alias("n"))
        clash = owner.where("n > 1 or (real = 1 and n > 0)")
        if not clash.limit(1).count():
            return held.select("kind", "value", "surrogate")
        moved = held.join(clash, ["kind", "surrogate"], "left")
        again = F.col("n").isNotNull() & ((F.col("real") == 1) | (F.col("owner") != F.col("value")))
        moved = moved.select("kind", "value", (F.col("attempt") + F.when(again, 1).otherwise(0)).alias("attempt"), F.when(again, F.lit(None)).otherwise(F.col("surrogate")).alias("surrogate"))
        before, held = held, settle(moved.select("kind", "value", "attempt", F.coalesce("surrogate", surrogate(key, F.col("kind"), F.col("value"), F.col("attempt"))).alias("surrogate")), "surrogates")
        discard(before)
    raise RuntimeError(f"surrogates still collide after {ATTEMPTS} attempts")


def entities(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(key, at, sub, kind, value, norm, plain): the parts of each text's entities in order; plain parts have no kind."""
    text = field(text_col)
    key = F.struct(field(id_col).alias("id"), text_digest(text).alias("d"))
    found = as_rows(docs).where(text.rlike(QUICK)).select(key.alias("key"), F.regexp_extract_all(text, F.lit(PATTERN), F.lit(0)).alias("e")).where(F.size("e") > 0)
    each = found.select("key", F.posexplode("e").alias("at", "e"))
    parts = each.select("key", "at", F.posexplode(_parts(F.col("e"))).alias("sub", "p")).select("key", "at", "sub", "p.kind", "p.value", "p.plain").distinct()
    return parts.withColumn("norm", normalised(F.col("kind"), F.col("value")))


def replace(docs: DataFrame, key: str, id_col: str = "doc_id", text_col: str = "text", counts: bool = False) -> DataFrame:
    """docs with surrogates in text_col for all entities; with counts also n_entities, long."""
    parts = settle(entities(docs, id_col, text_col), "entities")
    known = surrogates(parts.where("kind is not null").select("kind", F.col("norm").alias("value")).distinct(), key)
    known = known.select("kind", F.col("value").alias("norm"), "surrogate")
    placed = parts.join(known, ["kind", "norm"], "left").select("key", "at", "sub", F.coalesce(spelt(F.col("kind"), F.col("value"), F.col("surrogate")), "plain").alias("out"))
    each = placed.groupBy("key", "at").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("sub", "out"))), lambda x: x["out"]), "").alias("out"))
    per = each.groupBy("key").agg(F.transform(F.sort_array(F.collect_list(F.struct("at", "out"))), lambda x: x["out"]).alias("outs"))
    per = per.select(F.col("key.id").alias("id"), F.col("key.d").alias("d"), "outs")
    marked = as_rows(docs).withColumn("digest", text_digest(field(text_col)))
    rows = marked.join(per, field(id_col).eqNullSafe(per["id"]) & (marked["digest"] == per["d"]), "left")
    between = F.split(field(text_col), PATTERN)
    put = F.array_join(F.flatten(F.zip_with(between, F.col("outs"), lambda p, o: F.array(p, F.coalesce(o, F.lit(""))))), "")
    text = F.when(F.col("outs").isNotNull(), put).otherwise(field(text_col))
    n = F.when(F.col("outs").isNotNull(), F.size("outs")).otherwise(0).cast("long")
    return rows.select(*fields(docs, **{text_col: text}), *([n.alias("n_entities")] if counts else []))
