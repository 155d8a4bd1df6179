"""PII surrogates: detected entities get keyed replacements of the same type, format, gender and script.

One pattern finds all mentions. A mention has one or more parts with a canonical form (digits only for
numbers, lower case for addresses, each given name and the family name apart), so that mentions of one entity in
different formats stay one entity. Each distinct (type, canonical form) of the corpus draws a
surrogate from a keyed hash; those that equal another's surrogate or a real entity of the corpus draw
again, with the number of the attempt in the hash, until none collides. Mentions are then written
in their own format: digits replace digits and letters replace letters of the same case, card numbers
keep their check digit valid, names follow the title's gender and their own script.

All work is DataFrame functions; there is no UDF. Only texts with a mention are shuffled, joined with
their replacements by the text's digest. The number of rounds of drawing depends on collisions only;
a form with too few values left is lengthened, so that drawing always ends.

Defined results: a null text stays null and an empty one empty, with 0 entities; texts without a
mention stay as they are; repeated rows are replaced alike; columns of documents pass through; a
new column whose name is taken gets underscores before it.
"""

from __future__ import annotations

from itertools import count

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from ledgerloom.llm.common import free_name, save

KEY = "example key; set your own"
# after so many draws in the mention's own form each further draw is one character longer
SAME_FORM = 6

# fixed values: titles, with the gender they tell
TITLES = {"m": ("Mr", "Herr", "Monsieur", "Señor", "Господин", "Κύριος"),
          "f": ("Mrs", "Miss", "Ms", "Frau", "Madame", "Señora", "Госпожа", "Κυρία")}
# fixed values: one syllable per hexadecimal digit, and endings, to build names of a script
SYLLABLES = {
    "latin": ("ba be bo da de do ka ke la le ma mi na ni ra ri", {"m": "ko", "f": "na", "": "sen"}),
    "cyrillic": ("ба бе бо да де до ка ке ла ле ма ми на ни ра ри",
                 {"m": "слав", "f": "на", "": "енко"}),
    "greek": ("βα βε βο δα δε δο κα κε λα λε μα μι να νι ρα ρι",
              {"m": "ος", "f": "να", "": "ίδης"})}

_OCTET = r"(?:25[0-5]|2[0-4]\d|1?\d?\d)"
_TITLE = "|".join(sorted((t for ts in TITLES.values() for t in ts), key=len, reverse=True))
# a secret's name and separator, and its value: up to the closing quote, or else to a delimiter
_NAMED = (r"(?i:pass(?:word|wd|phrase)|pwd|secret(?:[_-]?key)?|token|(?:api|access|auth|private)[_-]?key)"
          r"[\"']?[ \t]*+(?:=>|[=:]=?)[ \t]*+")
_VALUES = (r"\"(?:[^\"\\\r\n]|\\.){6,}+\"", r"'(?:[^'\\\r\n]|\\.){6,}+'",
           r"[\"']?[^\s\"'<>,;]{6,}+")
# a capitalised word with its hyphens and apostrophes, without the 's of a genitive
_WORD = r"\p{Lu}(?:(?!['’]s(?!\p{L}))['’-]?[\p{L}\p{M}]++)++"
PATTERNS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@(?=[A-Za-z0-9.-]*?\.[A-Za-z]{2})"
             r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)*+",
    "secret": f"{_NAMED}(?:{'|'.join(_VALUES)})",
    "key": r"(?<![A-Za-z0-9])(?:AKIA[0-9A-Z]{16}|ghp_[A-Za-z0-9]{36,}+|sk-[A-Za-z0-9_-]{20,}+)"
           r"(?![A-Za-z0-9])",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "ip": rf"(?<![\w.]){_OCTET}(?:\.{_OCTET}){{3}}(?![\w]|\.\d)",
    "card": r"(?<![\w.+-])\d{4}(?:[ -]?\d{4}){2}[ -]?\d{1,7}(?![\w-])",
    "ssn": r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])",
    "phone": r"(?<![\w+])\+\d{1,3}[ .-]?(?:\(\d{1,4}\)|\d{1,4})(?:[ .-]?\d{2,4}){1,4}(?!\w)"
             r"|(?<!\w)\(\d{3}\) ?\d{3}[ .-]\d{4}(?!\w)"
             r"|(?<![\w.-])\d{3}[.-]\d{3}[.-]\d{4}(?![\w-])",
    "name": rf"(?<!\p{{L}})(?:{_TITLE})\.? {_WORD}(?: (?!(?:{_TITLE})(?!\p{{L}})){_WORD})*+",
}
# a look at the next character keeps most places of a text from trying a kind at all
_BEGINS = {"email": "A-Za-z0-9._%+-", "secret": "PpSsTtAa", "key": "Ags", "iban": "A-Z", "ip": "0-9",
           "card": "0-9", "ssn": "0-9", "phone": "0-9(+", "name": "".join(sorted(
               {t[0] for ts in TITLES.values() for t in ts}))}
PATTERN = "|".join(f"(?=[{_BEGINS[k]}])(?:{p})" for k, p in PATTERNS.items())
# what every mention has in it: a digit, an at sign or a separator, a key's beginning, or a title
HINTS = ("[0-9@=:]", "[Ags](?:KIA|hp_|k-)",
         f"[{_BEGINS['name']}](?:{'|'.join(t[1:] for t in _TITLE.split('|'))})\\.? ")


def has_mention(text: Column) -> Column:
    """Whether a text has a mention; the quick look for a hint spares most texts the pattern."""
    hint = text.rlike(HINTS[0]) | text.rlike(HINTS[1]) | text.rlike(HINTS[2])
    return F.coalesce(hint & text.rlike(PATTERN), F.lit(False))


def mentions_of(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(PATTERN), F.lit(0))


# -- types and canonical forms -----------------------------------------------------------------------

def _is(mention: Column, kind: str) -> Column:
    # look-arounds hold where the mention was found; alone, the mention begins and ends the string
    return mention.rlike(f"^(?:{PATTERNS[kind]})$")


def _part(kind: Column | str, canon: Column) -> Column:
    kind = F.lit(kind) if isinstance(kind, str) else kind
    return F.struct(kind.alias("type"), canon.alias("canon"))


def _script(word: Column) -> Column:
    return (F.when(word.rlike(r"\p{IsCyrillic}"), "cyrillic").when(word.rlike(r"\p{IsGreek}"), "greek")
            .otherwise("latin"))


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, r"\D", "")


def parts_of(mention: Column) -> Column:
    """The mention's parts, each (type, canon), in the order in which they are written."""
    title = F.regexp_extract(mention, rf"^({_TITLE})", 1)
    gender = F.when(title.isin(*TITLES["m"]), "m").otherwise("f")
    names = F.split(F.regexp_extract(mention, rf"^(?:{_TITLE})\.? (.*)$", 1), " ")
    family, given = F.element_at(names, -1), F.slice(names, 1, F.size(names) - 1)
    last = _part(F.concat(F.lit("family:"), _script(family)), F.lower(family))
    first = F.transform(given, lambda name: _part(
        F.concat(F.lit("given:"), _script(name), F.lit(":"), gender), F.lower(name)))
    out = F.when(_is(mention, "email"), F.array(_part("email", F.lower(mention))))
    value = _value(mention)
    out = out.when(_is(mention, "secret"), F.array(_part(
        F.when(_is(value, "key"), "key").otherwise("secret"), value)))
    out = out.when(_is(mention, "key"), F.array(_part("key", mention)))
    out = out.when(_is(mention, "ip"), F.array(_part("ip", mention)))
    for kind in ("card", "ssn", "phone"):
        out = out.when(_is(mention, kind), F.array(_part(kind, _digits(mention))))
    out = out.when(_is(mention, "iban"),
                   F.array(_part("iban", F.regexp_replace(mention, " ", ""))))
    out = out.when(_is(mention, "name"), F.concat(first, F.array(last)))
    return out.otherwise(F.array(_part("other", mention)))


def _value(secret: Column) -> Column:
    """What stands after the name of a secret, without quotes."""
    value = F.regexp_replace(secret, f"^{_NAMED}", "")
    return F.regexp_replace(value, r"(?s)^([\"'])(.*?)\1?$", "$2")


def _around(secret: Column) -> tuple[Column, Column]:
    """What stands before and after the value of a secret."""
    n = F.length(_value(secret))
    head = F.regexp_extract(secret, f"^({_NAMED}[\"']?)", 1)
    return head, secret.substr(F.length(head) + n + 1, F.length(secret))


# -- surrogates --------------------------------------------------------------------------------------

def _number(key: str, kind: Column, canon: Column, attempt: Column, place: Column) -> Column:
    """A keyed number below 2**28 for one place of a surrogate."""
    message = F.concat_ws("\x1f", F.lit(key), kind, canon, attempt.cast("string"),
                          place.cast("string"))
    return F.conv(F.substring(F.sha2(message, 256), 1, 7), 16, 10).cast("int")


def _of(alphabet: str, number: Column) -> Column:
    return F.substring(F.lit(alphabet), F.pmod(number, F.lit(len(alphabet))) + 1, F.lit(1))


def _letters(text: Column, number) -> Column:
    """Same classes, other characters; number gives the keyed number of a place.

    Marks that divide a text stay, unless it has nothing else.
    """
    filled = text.rlike(r"[\p{L}\p{N}]")

    def one(c: Column, i: Column) -> Column:
        def of(alphabet: str) -> Column:
            return _of(alphabet, number(i))
        return (F.when(c.rlike("[0-9]"), of(_DIGITS)).when(c.rlike("[A-Z]"), of(_UPPER))
                .when(c.rlike("[a-z]"), of(_UPPER.lower()))
                .when(filled & c.rlike(r"[\s\\\p{Punct}&&[^*#]]"), c)
                .when(c.rlike(r"[\p{IsCyrillic}&&\p{Lu}]"), of(_CYRILLIC))
                .when(c.rlike(r"\p{IsCyrillic}"), of(_CYRILLIC.lower()))
                .when(c.rlike(r"[\p{IsGreek}&&\p{Lu}]"), of(_GREEK))
                .when(c.rlike(r"\p{IsGreek}"), of(_GREEK.lower()))
                .when(c.rlike(r"\p{N}"), of(_DIGITS)).when(c.rlike(r"\p{Lu}"), of(_UPPER))
                .otherwise(of(_UPPER.lower())))
    return F.array_join(F.transform(F.split(text, ""), one), "")


_DIGITS = "0123456789"
_CYRILLIC = "АБВГДЕЖЗИКЛМНОПРСТУФХЦЧШЭЮЯ"
_GREEK = "ΑΒΓΔΕΖΗΘΙΚΛΜΝΞΟΠΡΣΤΥΦΧΨΩ"
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def _check_digit(digits: Column) -> Column:
    """The last digit that makes a card number valid (sum of digits, every second one doubled)."""
    n = F.length(digits)

    def add(total: Column, i: Column) -> Column:
        d = F.substring(digits, i, F.lit(1)).cast("int")
        twice = F.when(d > 4, 2 * d - 9).otherwise(2 * d)
        return total + F.when(F.pmod(n - i, F.lit(2)) == 0, twice).otherwise(d)

    total = F.aggregate(F.sequence(F.lit(1), n), F.lit(0), add)
    return F.pmod(F.lit(10) - F.pmod(total, F.lit(10)), F.lit(10)).cast("string")


def _iban_check(country: Column, account: Column) -> Column:
    """The two digits that make an account number valid: letters count from 10, modulo 97."""
    def add(total: Column, c: Column) -> Column:
        return F.when(c.rlike("[0-9]"), (total * 10 + c.cast("int")) % 97).otherwise(
            (total * 100 + F.ascii(c) - 55) % 97)

    written = F.split(F.upper(F.concat(account, country, F.lit("00"))), "")
    return F.lpad((F.lit(98) - F.aggregate(written, F.lit(0), add)).cast("string"), 2, "0")


def draw(kind: Column, canon: Column, attempt: Column, key: str) -> Column:
    """The surrogate's canonical form at an attempt; from SAME_FORM on it grows with the attempt."""
    def number(i: Column) -> Column:
        return _number(key, kind, canon, attempt, i)

    def name(script: str, gender: str) -> Column:
        syllables, endings = SYLLABLES[script]
        table = F.array(*[F.lit(s) for s in syllables.split()])
        places = F.sequence(F.lit(1), F.lit(3) + attempt)
        body = F.transform(places, lambda i: F.element_at(table, F.pmod(number(i), F.lit(16)) + 1))
        return F.concat(F.array_join(body, ""), F.lit(endings[gender]))

    extra = F.greatest(attempt - (SAME_FORM - 1), F.lit(0))

    def more(alphabet: str) -> Column:
        places = F.slice(F.sequence(F.lit(1), extra + 1), F.lit(1), extra)
        return F.array_join(F.transform(places, lambda i: _of(alphabet, number(-i))), "")

    local = F.regexp_extract(canon, "^(.*)@", 1)
    domain = F.regexp_extract(canon, "@(.*)$", 1)
    host = F.substring(F.sha2(F.concat_ws("\x1f", F.lit(key), F.lit("domain"), domain), 256), 1, 8)
    plain = _letters(canon, number)
    swapped = F.concat(F.substring(canon, 1, 1), plain.substr(F.lit(2), F.length(canon)))
    card = F.concat(swapped.substr(F.lit(1), F.length(canon) - 1), more(_DIGITS))
    octets = F.transform(F.sequence(F.lit(1), extra + 4),
                         lambda i: (F.pmod(number(i), F.lit(254)) + 1).cast("string"))
    country = F.substring(canon, 1, 2)
    account = F.concat(plain.substr(F.lit(5), F.length(canon)), more(_DIGITS))
    prefix = F.regexp_extract(canon, "^(AKIA|ghp_|sk-)", 1)
    out = (F.when(kind == "email", F.concat(_letters(local, number), more(_UPPER.lower()),
                                            F.lit("@m"), host, F.lit(".example.com")))
           .when(kind == "ip", F.array_join(octets, "."))
           .when(kind == "card", F.concat(card, _check_digit(card)))
           .when(kind.isin("ssn", "phone"), F.concat(swapped, more(_DIGITS)))
           .when(kind == "key", F.concat(prefix, plain.substr(F.length(prefix) + 1, F.length(canon)),
                                         more(_UPPER)))
           .when(kind == "iban", F.concat(country, _iban_check(country, account), account)))
    for script in SYLLABLES:
        out = out.when(kind == f"family:{script}", name(script, ""))
        for gender in "mf":
            out = out.when(kind == f"given:{script}:{gender}", name(script, gender))
    return out.otherwise(F.concat(plain, more(_UPPER.lower())))


def _spread(rows: DataFrame) -> DataFrame:
    """Rows of few bytes with much to compute, spread over all cores."""
    return rows.repartition(rows.sparkSession.sparkContext.defaultParallelism)


def assign(entities: DataFrame, key: str = KEY) -> DataFrame:
    """(type, canon, surrogate) of distinct entities; no two of a type share a surrogate.

    Nor does a surrogate equal a real entity of its type.
    """
    entities = save(entities.select("type", "canon").distinct())
    real = entities.withColumnRenamed("canon", "surrogate")
    done, pending = None, entities
    for attempt in count():
        drawn = _spread(pending).withColumn(
            "surrogate", draw(F.col("type"), F.col("canon"), F.lit(attempt), key))
        first = F.row_number().over(W.Window.partitionBy("type", "surrogate").orderBy("canon")) == 1
        drawn = drawn.withColumn("first", first).join(
            real.withColumn("real", F.lit(True)), ["type", "surrogate"], "left")
        if done is not None:
            drawn = drawn.join(done.select("type", "surrogate", F.lit(True).alias("taken")),
                               ["type", "surrogate"], "left")
        else:
            drawn = drawn.withColumn("taken", F.lit(None).cast("boolean"))
        drawn = save(drawn.select("type", "canon", "surrogate",
                                  (F.col("first") & F.col("real").isNull()
                                   & F.col("taken").isNull()).alias("good")))
        good = drawn.where("good").select("type", "canon", "surrogate")
        done = good if done is None else done.unionByName(good)
        pending = drawn.where("NOT good").select("type", "canon")
        if pending.isEmpty():
            return done


def write_mention(mention: Column, surrogates: Column) -> Column:
    """The surrogates of a mention's parts in the mention's own format."""
    only = F.element_at(surrogates, 1)
    letters = "[A-Za-z0-9]"

    def fill(pattern: str) -> Column:
        """Characters of the pattern are taken from the surrogate one after the other.

        What a longer surrogate has left comes at the end.
        """
        def one(c: Column, i: Column) -> Column:
            seen = F.length(F.regexp_replace(mention.substr(F.lit(1), i), f"[^{pattern[1:]}", ""))
            return F.when(c.rlike(pattern), only.substr(seen + 1, F.lit(1))).otherwise(c)
        places = F.length(F.regexp_replace(mention, f"[^{pattern[1:]}", ""))
        return F.concat(F.array_join(F.transform(F.split(mention, ""), one), ""),
                        only.substr(places + 1, F.length(only)))

    before, after = _around(mention)
    title = F.regexp_extract(mention, rf"^((?:{_TITLE})\.? )", 1)
    names = F.array_join(F.transform(surrogates, F.initcap), " ")
    return (F.when(_is(mention, "email") | _is(mention, "key") | _is(mention, "ip"), only)
            .when(_is(mention, "card") | _is(mention, "ssn") | _is(mention, "phone"), fill("[0-9]"))
            .when(_is(mention, "iban"), fill(letters))
            .when(_is(mention, "secret"), F.concat(before, only, after))
            .when(_is(mention, "name"), F.concat(title, names)).otherwise(only))


def replacements(mentions: DataFrame, key: str = KEY) -> DataFrame:
    """(mention, replacement) of distinct mentions."""
    parts = save(_spread(mentions.distinct()).select("mention", F.posexplode(parts_of(F.col("mention")))
                                            .alias("place", "part"))
                 .select("mention", "place", "part.type", "part.canon"))
    map_ = assign(parts, key)
    drawn = (parts.join(map_, ["type", "canon"]).groupBy("mention")
             .agg(F.sort_array(F.collect_list(F.struct("place", "surrogate"))).alias("s")))
    return (_spread(drawn).select("mention", write_mention(F.col("mention"), F.col("s.surrogate"))
                    .alias("replacement")))


def replace_pii(docs: DataFrame, text: str = "text", key: str = KEY) -> DataFrame:
    """Every row of docs with its text's mentions replaced, and n_entities, the number of mentions."""
    count, digest, found, swap = (free_name(docs, c) for c in ("n_entities", "digest", "found", "swap"))
    t = F.col(f"`{text}`")
    has = has_mention(t)
    some = docs.where(has).withColumn(digest, F.sha2(t, 256)).withColumn(found, mentions_of(t))
    seen = save(some.select(F.col(digest).alias("digest"), F.array_distinct(found).alias("found"))
                .distinct().select("digest", F.explode("found").alias("mention")))
    table = replacements(seen.select("mention"), key)
    per_text = (seen.join(table, "mention").groupBy("digest")
                .agg(F.map_from_entries(F.collect_list(F.struct("mention", "replacement")))
                     .alias("swap"))
                .select(F.col("digest").alias(digest), F.col("swap").alias(swap)))
    gaps = F.split(t, PATTERN, -1)
    new = F.concat(F.transform(found, lambda m: F.element_at(F.col(swap), m)), F.array(F.lit("")))
    joined = F.array_join(F.zip_with(gaps, new, lambda a, b: F.concat(a, b)), "")
    done = some.join(per_text, digest)
    columns = [F.col(f"`{c}`") for c in docs.columns]
    replaced = done.select(*[joined.alias(text) if c == text else F.col(f"`{c}`")
                             for c in docs.columns], F.size(found).cast("bigint").alias(count))
    return docs.where(~has).select(*columns, F.lit(0).cast("bigint").alias(count)).unionByName(replaced)
