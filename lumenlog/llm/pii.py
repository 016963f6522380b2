"""PII surrogates from built-in expressions: keyed, type-consistent, distinct and coreferent.

Entities (e-mail, IPv4, phone, card, social security number, titled person name) are found by one pattern, and a document's full
names also where they stand without a title. An entity's canonical form (digits only, lower case, ...) and a secret key give a
digest, and the digest the surrogate, so equal entities get equal surrogates in all documents without any lookup. The words of a
name are entities of their own, given names and surnames apart, so names that share a surname share its surrogate. Only the distinct entities are shuffled, to check that no two share a
surrogate and that none is another real entity; those that do are drawn again, and just these few exceptions are joined back.
Texts are rewritten in place: the pieces between the matches with the surrogates between them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenlog.llm.common import materialize, row_key, whole_text

MALE = ["Mr", "Sir", "Herr", "Herrn", "Señor", "Monsieur", "Г-н", "Κύριος"]
FEMALE = ["Mrs", "Ms", "Miss", "Madam", "Frau", "Señora", "Madame", "Mme", "Г-жа", "Κυρία"]
NEUTRAL = ["Dr", "Prof"]


def _titles(titles: list[str]) -> str:
    return "(?:" + "|".join(sorted({*titles, *(t.upper() for t in titles)}, key=lambda t: (-len(t), t))) + r")\.?"


TITLE = _titles(MALE + FEMALE + NEUTRAL)
TITLES = f"(?:{TITLE} )"
EMAIL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+"
IPV4 = r"(?<![0-9.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?![0-9])"
SSN = r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"
CARD = r"(?<![0-9+])[3-6](?:[0-9]{12,18}|[0-9]{3}(?:[ -][0-9]{4}){3})(?![0-9])"
NATIONAL = r"(?<![0-9+])(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9])"
#: +1 and 3-3-4 digits, other international numbers, national ones. No group is the start of an entity of its own, and a last
#: group set apart makes no more than the 15 digits of E.164
_D = "(?:[0-9][ .()-]{0,2})"
_OTHER = f"(?!{EMAIL}|{IPV4}|{CARD})"
_NEXT = f"(?!{EMAIL}|{IPV4}|{CARD}|{SSN}|{NATIONAL})"
PHONE = (r"\+1[ .-]?\(?[0-9]{3}\)?[ .-]?[0-9]{3}[ .-]?[0-9]{4}(?![0-9])"
         rf"|\+[0-9]{{1,3}}[ .-]?\(?[0-9]{{2,4}}\)?[ .-]?{_OTHER}[0-9]{{2,4}}[ .-]?{_NEXT}[0-9]{{2,4}}"
         rf"(?:[0-9]{{2,4}}|[ .-]{_NEXT}[0-9]{{2,4}}(?<!\+{_D * 15}(?:{_D}(?:{_D}{_D}?)?)?[0-9]))?(?![0-9])"
         rf"|{NATIONAL}")
#: a word of a name: inner capitals, hyphens and apostrophes are its own, a possessive 's is not
WORD = (r"(?:\p{Lu}\.-?)*+(?:\p{Lu}['’]\p{L}|\p{Lu})[\p{L}\p{M}]++"
        r"(?:-\p{L}[\p{L}\p{M}]*+|['’](?!S(?!\p{L}))\p{Lu}[\p{L}\p{M}]*+)*+")
INITIAL = r"(?:(?:\p{Lu}\.-?)++|\p{Lu})(?= \p{Lu})"
_PART = rf"(?:{INITIAL} )*+(?!{TITLES}){WORD}"
NAME = rf"(?<!\p{{L}})(?=\p{{Lu}}){TITLES}++{_PART}(?: (?!{TITLES}){_PART})*+"
ANY = "|".join([EMAIL, IPV4, SSN, CARD, PHONE, NAME])
KINDS = ["email", "ip", "ssn", "card", "phone", "name"]
#: syllables of made-up names, by script
SYLLABLES = {"latin": "ba be bi bo da de di do fa fe fi fo ga ge gi go ka ke ki ko la le li lo ma me mi mo na ne ni no "
                      "pa pe pi po ra re ri ro sa se si so ta te ti to va ve vi vo za ze zi zo ha he hi ho ja je ji jo".split(),
             "cyrillic": "ба бе би бо да де ди до га ге ги го ка ке ки ко ла ле ли ло ма ме ми мо на не ни но па пе пи по "
                         "ра ре ри ро са се си со та те ти то ва ве ви во за зе зи зо фа фе фи фо ха хе хи хо ша ше ши шо".split(),
             "greek": "βα βε βι βο γα γε γι γο δα δε δι δο ζα ζε ζι ζο θα θε θι θο κα κε κι κο λα λε λι λο μα με μι μο "
                      "να νε νι νο πα πε πι πο ρα ρε ρι ρο σα σε σι σο τα τε τι το φα φε φι φο χα χε χι χο ξα ξε ξι ξο".split()}
ENDINGS = {"latin": ("a", "o"), "cyrillic": ("а", "он"), "greek": ("α", "ος")}
#: kinds of the words of a name
WORDS = ["given", "surname"]
MAX_ROUNDS = 20
#: from this attempt on a surrogate is made longer, so that even a tiny space of forms runs out of collisions
LONGER = 3
CYRILLIC, GREEK = r"^\p{IsCyrillic}", r"^\p{IsGreek}"


def kind_of(m: Column) -> Column:
    return (F.when(m.contains("@"), "email").when(m.rlike(r"^([0-9]{1,3}\.){3}[0-9]{1,3}$"), "ip")
            .when(m.rlike("^[0-9]{3}-[0-9]{2}-[0-9]{4}$"), "ssn")
            .when(m.rlike("^[3-6]([0-9]{12,18}|[0-9]{3}([ -][0-9]{4}){3})$"), "card").when(m.rlike("^[+(0-9]"), "phone").otherwise("name"))


def digits_of(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def untitled(m: Column) -> Column:
    return F.regexp_replace(m, f"^{TITLES}+", "")


def gender(m: Column) -> Column:
    """f, m, or n for unknown, by the titles."""
    titles = F.regexp_extract(m, f"^{TITLES}*", 0)
    return F.when(titles.rlike(f"(^| ){_titles(FEMALE)} "), "f").when(titles.rlike(f"(^| ){_titles(MALE)} "), "m").otherwise("n")


def folded(name: Column) -> Column:
    return F.lower(F.translate(name, "’", "'"))


def canonical(m: Column, kind: Column) -> Column:
    """What makes two mentions the same entity; names: see words()."""
    return (F.when(kind == "email", F.lower(m)).when(kind == "ip", m)
            .when(m.startswith("+"), F.concat(F.lit("+"), digits_of(m))).otherwise(digits_of(m)))


def written_words(m: Column) -> Column:
    return F.split(F.regexp_replace(untitled(m), r"\.-?(?=\p{L})", ". "), " ")


def words(written: Column) -> Column:
    """Array of (kind, canon, as written): the words of a name, the last one its surname."""
    return F.transform(written, lambda w, i: F.struct(
        F.when(i == F.size(written) - 1, "surname").otherwise("given").alias("kind"), folded(w).alias("canon"), w.alias("w")))


def number(digest: Column, at: int, size: int = 4) -> Column:
    """``size`` hex digits of the digest as a number."""
    return F.conv(F.substr(digest, F.lit(at + 1), F.lit(size)), 16, 10).cast("long")


def other_digits(digest: Column) -> Column:
    """64 decimal digits of a digest of 64 hex digits."""
    return F.translate(digest, "abcdef", "012345")


def luhn(body: Column) -> Column:
    """The check digit of a string of digits."""
    n = F.length(body)
    total = F.aggregate(F.transform(F.sequence(F.lit(1), n), lambda i: F.when((n - i) % 2 == 0, F.lit(2)).otherwise(1) * F.substr(body, i, F.lit(1)).cast("int")),
                        F.lit(0), lambda a, x: a + F.when(x > 9, x - 9).otherwise(x))
    return ((10 - total % 10) % 10).cast("string")


def letters(word: Column, digest: Column, skip: int = 0) -> Column:
    """Each letter by a letter, each digit by a digit; other characters stay. The digest goes round for long words."""
    def one(c, i):
        at = (i * 2 + skip) % 62 + 1
        x = F.conv(F.substr(digest, at, F.lit(2)), 16, 10).cast("int") + i
        return F.when(c.rlike("[a-z]"), F.substr(F.lit("abcdefghijklmnopqrstuvwxyz"), x % 26 + 1, F.lit(1))).when(
            c.rlike("[0-9]"), F.substr(F.lit("0123456789"), x % 10 + 1, F.lit(1))).otherwise(c)
    return F.array_join(F.transform(F.split(word, ""), one), "")


def keyed(canon: Column, kind: Column, attempt: Column, key: str) -> Column:
    """The digest an entity's surrogate is made of."""
    return F.sha2(F.concat_ws("|", F.lit(key), kind, canon, attempt.cast("string")), 256)


def surrogate(canon: Column, kind: Column, attempt: Column, digest: Column, key: str) -> Column:
    """The canonical form of the surrogate; ``digest``: keyed()."""
    fill = other_digits(digest)
    # e-mail: local part and domain labels apart, so one domain stays one domain; the last label is reserved for examples
    local, domain = F.substring_index(canon, "@", 1), F.substring_index(canon, "@", -1)
    labels = F.regexp_replace(domain, r"[.][^.]*$", "")
    longer = F.when(attempt >= LONGER, F.substr(digest, F.lit(1), F.lit(12))).otherwise("")
    email = F.concat(letters(local, digest), longer, F.lit("@"), letters(labels, F.sha2(F.concat_ws("|", F.lit(key), labels), 256)), F.lit(".example"))
    ip = F.concat_ws(".", *[(number(digest, 4 * i) % 254 + 1).cast("string") for i in range(4)])
    # phone: the country code stays
    code = F.when(canon.rlike("^[+][17]"), 2).when(canon.startswith("+"), 3).otherwise(0)
    phone = F.concat(F.substr(canon, F.lit(1), code), F.substr(fill, F.lit(1), F.length(canon) - code))
    body = F.concat(F.substr(canon, F.lit(1), F.lit(1)), F.substr(fill, F.lit(1), F.length(canon) - 2))

    def spell(script):
        table = F.array(*map(F.lit, SYLLABLES[script]))
        n = F.when(attempt >= LONGER, 5).otherwise(3)
        return F.array_join(F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.element_at(table, (F.conv(F.substr(
            digest, i * 4 + 1, F.lit(4)), 16, 10).cast("int") % len(SYLLABLES[script]) + 1))), "")
    word = F.when(canon.rlike(CYRILLIC), spell("cyrillic")).when(canon.rlike(GREEK), spell("greek")).otherwise(spell("latin"))
    return (F.when(kind == "email", email).when(kind == "ip", ip).when(kind == "ssn", F.substr(fill, F.lit(1), F.lit(9)))
            .when(kind == "card", F.concat(body, luhn(body))).when(kind == "phone", phone).otherwise(word))


def in_format(m: Column, kind: Column, other: Column) -> Column:
    """The surrogate in the form of this mention: its punctuation, upper case if all of it is."""
    number_ = F.regexp_replace(other, "[^0-9]", "")
    shaped = F.array_join(F.transform(F.split(m, ""), lambda c, i: F.when(c.rlike("[0-9]"), F.substr(
        number_, F.length(F.regexp_replace(F.substr(m, F.lit(1), i + 1), "[^0-9]", "")), F.lit(1))).otherwise(c)), "")
    email = F.when((m == F.upper(m)) & (m != F.lower(m)), F.upper(other)).otherwise(other)
    return F.when(kind == "email", email).when(kind == "ip", other).otherwise(shaped)


def name_word(w: Column, other: Column, sex: Column) -> Column:
    """A surrogate word of a name with the ending of its gender, in capitals if the word is."""
    def end(script):
        return F.when(sex == "f", ENDINGS[script][0]).when(sex == "m", ENDINGS[script][1]).otherwise("")
    word = F.concat(other, F.when(w.rlike(CYRILLIC), end("cyrillic")).when(w.rlike(GREEK), end("greek")).otherwise(end("latin")))
    return F.when((w == F.upper(w)) & ~w.rlike(r"^\p{Lu}\.?$"), F.upper(word)).otherwise(F.initcap(word))


def _mentions(matches: Column) -> Column:
    """Array of (m, kind, parts), parts: (kind, canon, as written) of the words of a name, one of anything else. Step by
    step, so that what is used often is computed once a mention."""
    kinds = F.transform(matches, lambda m: F.struct(m.alias("m"), kind_of(m).alias("kind")))
    split = F.transform(kinds, lambda s: F.struct(s["m"].alias("m"), s["kind"].alias("kind"), F.when(s["kind"] == "name", written_words(s["m"])).alias("ws")))
    return F.transform(split, lambda s: F.struct(s["m"].alias("m"), s["kind"].alias("kind"), F.when(s["kind"] == "name", words(s["ws"])).otherwise(
        F.array(F.struct(s["kind"].alias("kind"), canonical(s["m"], s["kind"]).alias("canon"), s["m"].alias("w")))).alias("parts")))


def _full_names(matches: Column) -> Column:
    """Array of (name, canon, sex): the names of two or more words among the matches, without their titles."""
    names = F.transform(F.filter(matches, lambda m: kind_of(m) == "name"), lambda m: F.struct(untitled(m).alias("name"), gender(m).alias("sex")))
    full = F.transform(names, lambda n: F.struct(n["name"].alias("name"), folded(n["name"]).alias("canon"), n["sex"].alias("sex")))
    return F.array_distinct(F.filter(full, lambda n: n["name"].contains(" ")))


def _pattern(names: Column) -> Column:
    """ANY, or one of the names without a title; the longest first."""
    longest = F.sort_array(F.array_distinct(F.transform(names, lambda n: F.struct(F.length(n["name"]).alias("n"), n["name"].alias("name")))), asc=False)
    either = F.array_join(F.transform(longest, lambda n: F.concat(F.lit(r"\Q"), n["name"], F.lit(r"\E"))), "|")
    return F.concat(F.lit(ANY + r"|(?<![\p{L}\p{M}])(?=\p{Lu})(?iu:"), either, F.lit(r")(?![\p{L}\p{M}])"))


def _entities(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(_id, _th, kind, canon), distinct per document."""
    parts = F.flatten(F.transform(_mentions(F.regexp_extract_all(whole_text(text_col), F.lit(ANY), F.lit(0))), lambda s: s["parts"]))
    found = F.transform(parts, lambda p: F.struct(p["kind"].alias("kind"), p["canon"].alias("canon")))
    return docs.select(*row_key(id_col, text_col), F.explode(F.array_distinct(found)).alias("e")).select("_id", "_th", "e.*")


def collision_exceptions(entities: DataFrame, key: str) -> DataFrame:
    """(kind, canon, attempt) of the entities whose first surrogate is another one's, or a real entity: attempt > 0."""
    settled = materialize(entities.select("kind", "canon").distinct().withColumn("attempt", F.lit(0)), "entities")
    # words of names are taken as given names and as surnames, with and without an ending
    is_word = F.col("kind").isin(WORDS)
    bare = F.regexp_replace("canon", "(?:" + "|".join(e for pair in ENDINGS.values() for e in pair) + ")$", "")
    real = settled.select(F.explode(F.when(is_word, F.array(*map(F.lit, WORDS))).otherwise(F.array("kind"))).alias("kind"), "canon").select(
        "kind", F.explode(F.when(is_word, F.array("canon", bare)).otherwise(F.array("canon"))).alias("s"))
    for _ in range(MAX_ROUNDS):
        drawn = settled.withColumn("digest", keyed(F.col("canon"), F.col("kind"), F.col("attempt"), key)).withColumn(
            "s", surrogate(F.col("canon"), F.col("kind"), F.col("attempt"), F.col("digest"), key)).drop("digest")
        # of those that share a surrogate, one keeps it: the one drawn earliest, then the least
        keeper = drawn.groupBy("kind", "s").agg(F.min(F.struct("attempt", "canon")).alias("k"), F.count(F.lit(1)).alias("n"))
        shared = (drawn.join(keeper.where("n > 1"), ["kind", "s"]).where("struct(attempt, canon) <> k").select("kind", "canon"))
        taken = drawn.join(real, ["kind", "s"], "left_semi").select("kind", "canon")
        bad = materialize(shared.union(taken).distinct().withColumn("more", F.lit(1)), "collisions")
        if bad.isEmpty():
            return settled.where("attempt > 0")
        settled = materialize(settled.join(bad, ["kind", "canon"], "left").select(
            "kind", "canon", (F.col("attempt") + F.coalesce("more", F.lit(0))).alias("attempt")), "entities")
    raise RuntimeError(f"surrogates still collide after {MAX_ROUNDS} rounds")


def pii_surrogates(docs: DataFrame, key: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with ``_clean`` (the text with surrogates) and ``_n_<kind>`` for each kind of entity added.

    A mention's surrogate keeps its kind and format: digits and punctuation of phones and numbers, the country code, a card's
    first digit and a valid check digit, e-mail shape (under the reserved domain ``example``), title, gender and script of names.
    Names are found by a title (MALE, FEMALE, NEUTRAL) and run on as far as their words begin with a capital, one space apart;
    a document's names of two or more words go without their title as well, single words without one stay. Surnames, as the
    last word, are the same surrogate in all names but for the ending of the gender.
    Equal entities get equal surrogates in all documents and under one key, different ones different surrogates, and
    no surrogate is an entity of the table. Null and empty texts give empty texts; repeated rows get the same
    result each; rows without doc_id are told apart by their text; an empty table gives an empty result; columns of other
    names pass through."""
    entities = materialize(_entities(docs, id_col, text_col), "mentions")  # mentions only, no text
    again = materialize(collision_exceptions(entities, key), "exceptions")
    per_doc = entities.distinct().join(again, ["kind", "canon"]).groupBy("_id", "_th").agg(
        F.map_from_entries(F.collect_list(F.struct(F.concat_ws("|", "kind", "canon"), "attempt"))).alias("_again"))
    rows = docs.select(F.struct("*").alias("_row"), *row_key(id_col, text_col)).join(per_doc, ["_id", "_th"], "left")
    text = whole_text("_t")
    rows = rows.withColumn("_t", F.col("_row")[text_col]).select("_row", "_again", text.alias("_t"), F.regexp_extract_all(
        text, F.lit(ANY), F.lit(0)).alias("_m"))
    rows = rows.withColumn("_names", _full_names(F.col("_m")))
    plain = F.size("_names") == 0
    rows = rows.withColumn("_any", F.when(plain, F.lit(ANY)).otherwise(_pattern(F.col("_names"))))
    rows = rows.select("_row", "_again", "_names", F.when(plain, F.col("_m")).otherwise(F.regexp_extract_all("_t", F.col("_any"), F.lit(0))).alias("_m"),
                       F.when(plain, F.split("_t", ANY, -1)).otherwise(F.split("_t", F.col("_any"), F.lit(-1))).alias("_p"))

    rows = rows.withColumn("_m", _mentions(F.col("_m")))
    tried = F.transform("_m", lambda s: F.struct(s["m"].alias("m"), s["kind"].alias("kind"), F.transform(s["parts"], lambda p: F.struct(
        p["kind"].alias("kind"), p["canon"].alias("canon"), p["w"].alias("w"),
        F.coalesce(F.element_at("_again", F.concat_ws("|", p["kind"], p["canon"])), F.lit(0)).alias("attempt"))).alias("parts")))
    drawn = F.transform(tried, lambda s: F.struct(s["m"].alias("m"), s["kind"].alias("kind"), F.transform(s["parts"], lambda p: F.struct(
        p["kind"].alias("kind"), p["canon"].alias("canon"), p["w"].alias("w"), p["attempt"].alias("attempt"),
        keyed(p["canon"], p["kind"], p["attempt"], key).alias("digest"))).alias("parts")))
    named = F.transform(drawn, lambda s: F.struct(s["m"].alias("m"), s["kind"].alias("kind"), F.transform(s["parts"], lambda p: F.struct(
        p["w"].alias("w"), surrogate(p["canon"], p["kind"], p["attempt"], p["digest"], key).alias("other"))).alias("parts"),
        F.when(s["kind"] == "name", F.struct(gender(s["m"]).alias("own"), folded(untitled(s["m"])).alias("canon"))).alias("sex")))
    # without a title that tells, the gender of the document's person of that name
    sexed = F.transform(named, lambda s: F.struct(s["m"].alias("m"), s["kind"].alias("kind"), s["parts"].alias("parts"), F.when(
        s["sex"]["own"] == "n", F.coalesce(F.array_min(F.transform(F.filter("_names", lambda n: n["canon"] == s["sex"]["canon"]), lambda n: n["sex"])),
                                           F.lit("n"))).otherwise(s["sex"]["own"]).alias("sex")))
    new = F.transform(sexed, lambda s: F.when(s["kind"] == "name", F.concat(F.regexp_extract(s["m"], f"^{TITLES}*", 0), F.array_join(
        F.transform(s["parts"], lambda p: name_word(p["w"], p["other"], s["sex"])), " "))).otherwise(
            in_format(s["m"], s["kind"], F.element_at(s["parts"], 1)["other"])))
    clean = F.array_join(F.zip_with("_p", new, lambda p, s: F.concat(p, F.coalesce(s, F.lit("")))), "")
    kinds = F.transform("_m", lambda s: s["kind"])

    def count(name):
        return F.size(F.filter(kinds, lambda k: k == name)).cast("long").alias(f"_n_{name}")
    counts = [count(name) for name in KINDS]
    rows = rows.select("_row", clean.alias("_clean"), *counts)
    return rows.select("_row.*", "_clean", *[f"_n_{name}" for name in KINDS])
