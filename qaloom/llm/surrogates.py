"""Keyed surrogates for personal data, with DataFrame functions only.

One pattern finds e-mail and IP addresses, telephone, card, account and social-security
numbers, secrets and titled names. Mentions are brought to a canonical form, so that one
entity written in several ways stays one entity; each distinct entity gets a surrogate
from a keyed hash that keeps its type: digits for digits, letters for letters of the same
script, the country code of a number, the validity of a card's check digit, the last label
of a domain (and equal domains stay equal), the gender of a name. Surrogates that meet
another surrogate, or a real entity of the corpus, are drawn again until none does, so
distinct entities stay distinct. The surrogate is then written in the format of every
mention. Who holds the key can repeat the mapping; nobody else can.

Only mentions and distinct entities are shuffled, and the texts that have any; others pass
through. An entity in very many documents is joined by plain sides that Spark splits.

Defined results: a null text stays null with no entities; rows repeated whole get the same
text. A name without a title is no entity. When a number's form has no free surrogate
left, the surrogate grows by a digit. An empty table gives an empty result. Other columns
are kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from qaloom.lineage import written
from qaloom.llm.registry import free_name

OCTET = r"(?:25[0-5]|2[0-4]\d|1?\d?\d)"
GAP = r"[^\w\n]{1,5}"
MALE = "Mr|Mister|Herr|Monsieur|Señor|господин|г-н"
FEMALE = "Mrs|Ms|Miss|Frau|Madame|Señora|госпожа|г-жа"

# Type -> pattern; where two could match at one place, the first does.
PATTERNS = {
    "email": r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]{1,64}+@[\p{L}\p{N}-]{1,63}(?:\.[\p{L}\p{N}-]{1,63})*\.\p{L}{2,24}",
    "ip": rf"(?<![\w.])(?:{OCTET}\.){{3}}{OCTET}(?!\w|\.\d)",
    "phone": rf"(?<![\w+])\+\d{{1,3}}{GAP}\d{{2,4}}{GAP}\d{{3,4}}{GAP}\d{{3,4}}(?!\w)|(?<!\w)\(\d{{3}}\) ?\d{{3}}[ .-]\d{{4}}(?!\w)|(?<![\w.-])\d{{3}}[.-]\d{{3}}[.-]\d{{4}}(?!\w)",
    "ssn": r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])",
    "iban": r"(?<!\w)[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?!\w)",
    "card": r"(?<![\w-])(?:\d{13,19}|\d{4}(?:[ -]\d{4}){3}|\d{4}[ -]\d{6}[ -]\d{5})(?!\w)",
    "secret": r"(?<!\w)(?:[0-9a-fA-F]{32,128}|AKIA[0-9A-Z]{16})(?!\w)",
    "name": rf"(?<![\p{{L}}\p{{N}}])(?:{MALE}|{FEMALE})\.? \p{{Lu}}\p{{L}}+(?: \p{{Lu}}\p{{L}}+)?",
}
ANY = "|".join(f"(?:{p})" for p in PATTERNS.values())
# What every mention contains, cheap to look for.
HINT = rf"[0-9@]|(?:{MALE}|{FEMALE})\.? \p{{Lu}}|[a-fA-F]{{32}}"

SYLLABLES = {
    "latin": "ba be bi bo da de di do fa fe ga go ka ke la le li lo ma me mi mo na ne ni no ra re ri ro sa se so ta te ti to va ve".split(),
    "cyrillic": "ба бе би бо да де ди до ка ки ла ле ли ло ма ме ми мо на не ни но ра ре ри ро са се со та те ти то ва ве".split(),
}
ALPHABETS = {
    "[a-z]": "abcdefghijklmnopqrstuvwxyz",
    "[0-9]": "0123456789",
    "[а-яё]": "абвгдежзийклмнопрстуфхцчшщыэюя",
    "[α-ωά-ώ]": "αβγδεζηθικλμνξοπρστυφχψω",
    r"[\p{L}&&\p{IsLatin}]": "àáâäåæçèéêëíîïñóôöøúüß",
    r"\p{L}": "一丁七万三上下不与中串主之也习书云五井亡",
}
STREAM = 80  # draws of three hex digits from two hashes
TRIES_IN_FORM = 16


def tokens(key: str, kind: Column, value: Column, attempt: Column) -> Column:
    """Hex digits that depend on key, type, value and attempt."""
    seed = F.concat_ws("\x1f", F.lit(key), kind, value, attempt.cast("string"))
    return F.concat(F.sha2(F.concat(seed, F.lit("0")), 512), F.sha2(F.concat(seed, F.lit("1")), 512))


def draw(stream: Column, i: Column, size: int) -> Column:
    """The i-th draw (from 1) below ``size``."""
    digits = F.substring(stream, ((i - 1) % STREAM) * 3 + 1, F.lit(3))
    return F.conv(digits, 16, 10).cast("int") % size


def redrawn(value: Column, stream: Column, shift: int = 0) -> Column:
    """``value`` with every letter and digit drawn anew from its own alphabet."""

    def one(i: Column) -> Column:
        c = F.substring(value, i, F.lit(1))
        out = c
        for pattern, letters in reversed(ALPHABETS.items()):
            out = F.when(c.rlike(f"^{pattern}$"), F.substring(F.lit(letters), draw(stream, i + shift, len(letters)) + 1, F.lit(1))).otherwise(out)
        return out

    return F.when(F.length(value) == 0, value).otherwise(F.array_join(F.transform(F.sequence(F.lit(1), F.length(value)), one), ""))


def digits_of(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def typed(mention: Column) -> Column:
    out = F.lit("name")
    for kind, pattern in reversed(list(PATTERNS.items())[:-1]):
        out = F.when(mention.rlike(f"^(?:{pattern})$"), kind).otherwise(out)
    return out


def canonical(kind: Column, mention: Column) -> Column:
    """One form for all ways to write an entity."""
    country = F.regexp_extract(mention, r"^\+(\d{1,3})", 1)
    number = digits_of(mention)
    title = F.regexp_extract(mention, rf"^(?:{MALE}|{FEMALE})\.? ", 0)
    name = F.substring(mention, F.length(title) + 1, F.length(mention))
    gender = F.when(title.rlike(rf"^(?:{FEMALE})\.? $"), "f").otherwise("m")
    script = F.when(name.rlike(r"\p{IsCyrillic}"), "cyrillic").otherwise("latin")
    return (
        F.when(kind == "phone", F.concat_ws("|", country, F.substring(number, F.length(country) + 1, F.length(number))))
        .when(kind.isin("card", "ssn"), number)
        .when(kind == "iban", F.lower(F.regexp_replace(mention, " ", "")))
        .when(kind == "name", F.concat_ws("|", gender, script, F.lower(name)))
        .otherwise(F.lower(mention))
    )


def grown(value: Column, stream: Column, attempt: Column) -> Column:
    """A few digits more once the form seems to have no surrogate left."""
    more = F.floor(attempt / TRIES_IN_FORM).cast("int")
    return F.when(more > 0, F.concat(value, F.lpad(F.conv(F.substring(stream, 200, 12), 16, 10), 16, "0").substr(F.lit(1), more))).otherwise(value)


def surrogate(key: str, kind: Column, canon: Column, attempt: Column) -> Column:
    """The surrogate of a canonical form, itself canonical."""
    stream = tokens(key, kind, canon, attempt)
    local, domain = F.substring_index(canon, "@", 1), F.substring_index(canon, "@", -1)
    host = F.regexp_replace(domain, r"\.[^.]*$", "")
    of_host = tokens(key, F.lit("host"), host, F.lit(0))
    email = F.concat(grown(redrawn(local, stream), stream, attempt), F.lit("@"), redrawn(host, of_host), F.lit("."), F.substring_index(domain, ".", -1))
    ip = F.array_join(F.transform(F.sequence(F.lit(1), F.lit(4)), lambda i: (draw(stream, i, 254) + 1).cast("string")), ".")
    country, number = F.substring_index(canon, "|", 1), F.substring_index(canon, "|", -1)
    phone = F.concat_ws("|", country, grown(redrawn(number, stream), stream, attempt))
    head = grown(redrawn(F.substring(canon, F.lit(1), F.length(canon) - 1), stream), stream, attempt)
    checks = F.filter(F.transform(F.sequence(F.lit(0), F.lit(9)), lambda d: F.concat(head, d.cast("string"))), lambda n: F.call_function("luhn_check", n) == F.call_function("luhn_check", canon))
    card = F.get(checks, draw(stream, F.lit(STREAM), 1 << 12) % F.size(checks))
    secret = F.when(
        canon.rlike("^[0-9a-f]+$"),
        F.array_join(F.transform(F.sequence(F.lit(1), F.length(canon)), lambda i: F.substring(F.lit("0123456789abcdef"), draw(stream, i, 16) + 1, F.lit(1))), ""),
    ).otherwise(F.concat(F.lit("akia"), redrawn(F.substring(canon, F.lit(5), F.length(canon)), stream)))
    iban = F.concat(F.substring(canon, 1, 2), redrawn(F.substring(canon, F.lit(3), F.length(canon)), stream))
    parts = F.split(canon, r"\|")
    gender, script, name = parts[0], parts[1], parts[2]

    def spoken(k: Column, syllables: list[str]) -> Column:
        picks = F.sequence(F.lit(1), F.lit(2) + F.floor(attempt / 4).cast("int"))
        return F.array_join(F.transform(picks, lambda i: F.get(F.array(*map(F.lit, syllables)), draw(stream, k * 11 + i, len(syllables)))), "")

    def word(k: Column) -> Column:
        made = {alphabet: spoken(k, syllables) for alphabet, syllables in SYLLABLES.items()}
        end = {"latin": ("na", "n"), "cyrillic": ("на", "й")}
        out = F.lit(None).cast("string")
        for alphabet, text in made.items():
            ending = F.when(gender == "f", end[alphabet][0]).otherwise(end[alphabet][1])
            out = F.when(script == alphabet, F.concat(text, ending)).otherwise(out)
        return out

    words = F.array_join(F.transform(F.sequence(F.lit(0), F.size(F.split(name, " ")) - 1), word), " ")
    return (
        F.when(kind == "email", email)
        .when(kind == "ip", ip)
        .when(kind == "phone", phone)
        .when(kind == "card", card)
        .when(kind == "ssn", grown(redrawn(canon, stream), stream, attempt))
        .when(kind == "secret", secret)
        .when(kind == "iban", iban)
        .otherwise(F.concat_ws("|", gender, script, words))
    )


def rendered(kind: Column, mention: Column, chosen: Column) -> Column:
    """A surrogate in the format of a mention."""
    number = digits_of(chosen)
    place = lambda i: F.length(digits_of(F.substring(mention, F.lit(1), i)))

    def filled(i: Column) -> Column:
        c = F.substring(mention, i, F.lit(1))
        return F.when(c.rlike("[0-9]"), F.substring(number, place(i), F.lit(1))).otherwise(c)

    size = F.length(digits_of(mention))
    numeric = F.concat(F.array_join(F.transform(F.sequence(F.lit(1), F.length(mention)), filled), ""), F.substring(number, size + 1, F.lit(64)))
    spaced = F.array_join(
        F.transform(
            F.sequence(F.lit(1), F.length(mention)),
            lambda i: F.when(F.substring(mention, i, F.lit(1)) == " ", " ").otherwise(
                F.substring(F.upper(chosen), F.length(F.regexp_replace(F.substring(mention, F.lit(1), i), " ", "")), F.lit(1))
            ),
        ),
        "",
    )
    cased = F.when((mention == F.upper(mention)) & (mention != F.lower(mention)), F.upper(chosen)).otherwise(chosen)
    name = F.initcap(F.substring_index(chosen, "|", -1))
    title = F.regexp_extract(mention, rf"^(?:{MALE}|{FEMALE})\.? ", 0)
    return (
        F.when(kind.isin("phone", "card", "ssn"), numeric).when(kind == "iban", spaced).when(kind == "name", F.concat(title, name)).otherwise(cased)
    )


def distinct_surrogates(entities: DataFrame, key: str) -> DataFrame:
    """``kind``, ``canon``, ``chosen`` for distinct entities: no two alike, none equal to an entity."""
    kind, canon = F.col("kind"), F.col("canon")
    open_ = written(entities.select("kind", "canon").distinct(), "surrogates-entities")
    everyone, settled, attempt = open_, None, 0
    while True:
        drawn = open_.select("kind", "canon", surrogate(key, kind, canon, F.lit(attempt)).alias("chosen"))
        firsts = drawn.groupBy("kind", "chosen").agg(F.min("canon").alias("canon"))
        taken = everyone.select("kind", F.col("canon").alias("chosen"))
        if settled is not None:
            taken = taken.union(settled.select("kind", "chosen"))
        fine = written(firsts.join(taken, ["kind", "chosen"], "left_anti").select("kind", "canon", "chosen"), "surrogates-settled")
        settled = fine if settled is None else settled.union(fine)
        open_ = written(open_.join(fine, ["kind", "canon"], "left_anti"), "surrogates-open")
        if not open_.limit(1).count():
            return settled
        attempt += 1


def mentions_of(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``th``, ``pos``, ``mention``, ``kind``, ``canon``, in the order of the text."""
    found = docs.where(F.col("text").rlike(HINT)).select(
        "doc_id", F.xxhash64("text").alias("th"), F.posexplode(F.regexp_extract_all("text", F.lit(ANY), 0)).alias("pos", "mention")
    )
    found = found.distinct().withColumn("kind", typed(F.col("mention")))
    return found.withColumn("canon", canonical(F.col("kind"), F.col("mention")))


def pseudonymized(docs: DataFrame, key: str, out: str = "entities") -> DataFrame:
    """``docs`` with surrogates in the text, and ``out``: how many entities each text mentioned."""
    if any(c.lower() == out.lower() for c in docs.columns):
        raise ValueError(f"column {out} exists; name another with out=")
    mentions = written(mentions_of(docs.select("doc_id", "text")), "surrogates-mentions")
    chosen = written(distinct_surrogates(mentions, key), "surrogates-chosen")
    replaced = mentions.join(chosen, ["kind", "canon"]).select(
        "doc_id", "th", "pos", rendered(F.col("kind"), F.col("mention"), F.col("chosen")).alias("new")
    )
    per_text = replaced.groupBy(F.col("doc_id").alias("new_id"), F.col("th").alias("new_th")).agg(
        F.transform(F.sort_array(F.collect_list(F.struct("pos", "new"))), lambda x: x["new"]).alias("new")
    )
    per_text = written(per_text, "surrogates-texts")
    hashed = free_name(docs, "text_hash")
    hinted = F.coalesce(F.col("text").rlike(HINT), F.lit(False))
    plain = docs.where(~hinted).select(*docs.columns, F.lit(0).alias(out))
    some = docs.where(hinted).withColumn(hashed, F.xxhash64("text"))
    new = per_text["new"]
    joined = some.join(per_text, some["doc_id"].eqNullSafe(per_text["new_id"]) & (some[hashed] == per_text["new_th"]), "left")
    between = F.split(some["text"], ANY, -1)
    text = F.array_join(F.zip_with(between, F.concat(new, F.array(F.lit(""))), lambda a, b: F.concat(a, b)), "")
    columns = [F.when(new.isNull(), some["text"]).otherwise(text).alias("text") if c == "text" else some[c] for c in docs.columns]
    return joined.select(*columns, F.coalesce(F.size(new), F.lit(0)).alias(out)).union(plain)
