"""Keyed surrogates for personal data and secrets.

Every entity found in a text is replaced by one of the same kind and format, drawn from a keyed hash of
its canonical value: the same entity gets the same surrogate everywhere, another key gives other ones.
Digits stay digits, letters keep their case, punctuation stays where it was; card numbers keep their
first digit and stay valid if they were, account numbers get matching check digits, addresses keep valid
octets, and names keep title, number of words, script and the gender that a title tells. A name is the
same with another title or full stops, unless titles tell two genders.

Surrogates are checked over the whole corpus: two entities never share one, and none is itself an entity
of the corpus. Entities that clash are drawn again until none do, after some draws in a longer format
(other octets, more syllables, letters or digits), as a short one may have no value left; by tables of distinct entities only;
counting them combines on the map side, so an entity in a third of all documents is one row a task.
Documents without entities are not shuffled.

Null texts stay null. Rows that repeat a ``doc_id``, or have none, are told apart by their text. An
empty table gives an empty result. Columns other than ``doc_id`` and ``text`` are not read.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsweft.llm.store import saved

KEY = "newsweft"
OWN_FORMAT = 8  # draws before an entity gets a longer format, by one more character with each draw

# What counts as an entity. Repetition is bounded or possessive, so that long runs of letters stay linear.
SOLID = r"(?=[^\s\p{Z}\p{L}\p{N}]*+[\p{L}\p{N}])"  # a value has a letter or digit before the next white space
# A value without quotes around it ends at white space, or at a quote that no letter or digit follows.
VALUE = r"(?:[^\s\p{Z}\"'”’»]|[\"'”’»](?=[\p{L}\p{N}])){8,}+"
WORD = r"(?:\p{Lu}\.?(?= \p{Lu})|\p{Lu}[\p{L}\p{M}]++(?:['’-]\p{Lu}[\p{L}\p{M}]*+)*+|\p{Lu}['’-]\p{Lu}[\p{L}\p{M}]++)"  # of a name: J. (before another word), Smith-Jones, O'Brien
TITLES = {
    "f": ("Mrs", "Ms", "Miss", "Frau", "Madame", "Mme", "Señora", "Sra", "г-жа"),
    "m": ("Mr", "Herr", "Monsieur", "Señor", "Sr", "г-н"),
    "n": ("Dr", "Prof"),
}
KINDS = {
    "email": r"(?<![\p{L}\p{M}\p{N}._%+-])[\p{L}\p{M}\p{N}._%+-]++@[\p{L}\p{M}\p{N}-]{1,63}(?:\.[\p{L}\p{M}\p{N}-]{1,63}){1,8}(?<![.-])",
    "secret": r"(?<![A-Za-z0-9])AKIA[A-Z0-9]{16}(?![A-Za-z0-9])"
    r"|(?<![\p{L}\p{N}])(?i:password|passwd|secret|api[_-]?key|token) ?[=:] ?(?:\"" + SOLID + r"[^\"\r\n]{8,}+(?=\")|'" + SOLID + r"[^'\r\n]{8,}+(?='(?![\p{L}\p{N}]))|[\"']?" + SOLID + VALUE + ")",
    "phone": r"(?<![0-9+])\+[0-9]{1,3} \([0-9]{2,4}\) [0-9]{3,4}-[0-9]{3,4}(?![0-9])|(?<![0-9+])\+[0-9]{1,3}(?:[ -][0-9]{2,4}){3,4}(?![0-9])"
    r"|(?<![0-9])\([0-9]{3}\) [0-9]{3}-[0-9]{4}(?![0-9])|(?<![0-9-])[0-9]{3}-[0-9]{3}-[0-9]{4}(?![0-9-])",
    "social": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "ip": r"(?<![0-9.])(?:(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])(?![0-9]|\.[0-9])",
    "account": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "card": r"(?<![0-9-])(?:[0-9]{13,19}|[0-9]{4}(?:[ -][0-9]{4}){3})(?![0-9-])",
    "name": r"(?<!\p{L})(?:" + "|".join(t for of in TITLES.values() for t in of) + r")\.? " + WORD + "(?: " + WORD + ")*+",
}
PATTERN = "|".join(f"(?:{p})" for p in KINDS.values())
LABEL = r"^[A-Za-z_-]+ ?[=:] ?[\"']?"  # what stands before a secret's value
# Syllables and endings of invented names.
SYLLABLES = {
    "latin": ("ba be bi bo da de di do fa fe fi ga ge go ha he hi ka ke ki la le li lo ma me mi mo na ne ni no pa pe pi ra re ri ro sa se si so ta te ti to va ve vi".split(), {"f": "na", "m": "ron", "n": "den"}),
    "cyrillic": ("ба бе би бо ва ве ви во га ге го да де ди до ка ке ки ко ла ле ли ло ма ме ми мо на не ни но па пе пи ра ре ри ро са се си со та те ти то ша ше ши жа же".split(), {"f": "на", "m": "рон", "n": "ден"}),
    "greek": ("βα βε βι βο γα γε γι γο δα δε δι δο κα κε κι κο λα λε λι λο μα με μι μο να νε νι νο πα πε πι πο ρα ρε ρι ρο σα σε σι σο τα τε τι το φα φε".split(), {"f": "να", "m": "ρος", "n": "δεν"}),
}


def kind_of(value: Column) -> Column:
    return F.coalesce(*[F.when(value.rlike(f"^(?:{p})$"), k) for k, p in KINDS.items() if k != "secret"], F.lit("secret"))


def may_hold_entity(text: Column) -> Column:
    """True for every text with an entity, by searches much cheaper than its pattern."""
    marks = [t for of in TITLES.values() for t in of] + ["AKIA"]
    named = text.rlike("[=:]") & text.rlike("(?i)passw|secret|api[_-]?key|token")
    return reduce(lambda out, m: out | text.contains(m), marks, text.rlike("[0-9@]") | named)


def title_gender(value: Column) -> Column:
    """f, m or n by the title of a name."""
    title = F.regexp_replace(F.substring_index(value, " ", 1), r"\.$", "")
    return F.when(title.isin(*TITLES["f"]), "f").when(title.isin(*TITLES["m"]), "m").otherwise("n")


def bare_name(value: Column) -> Column:
    """The words of a name without its title and full stops."""
    return F.regexp_replace(F.regexp_replace(value, r"^\S+ ", ""), r"\.", "")


def canonical(kind: Column, value: Column) -> Column:
    """Entities with the same canonical value are the same one, but for names, which have a gender too
    (``with_gender``). What ends a sentence after a secret does not count."""
    bare = F.regexp_replace(value, r"(?<![^\p{L}\p{N}])[^\p{L}\p{N}]++$", "")
    return (
        F.when(kind == "email", F.lower(value))
        .when(kind == "secret", bare)
        .when(kind == "name", bare_name(value))
        .when(kind.isin("phone", "card", "account", "social"), F.regexp_replace(value, "[^0-9A-Za-z+]", ""))
        .otherwise(value)
    )


def with_gender(places: DataFrame) -> DataFrame:
    """Adds ``gender``. Mr and Mrs Smith are two people; a title without a gender, like Dr, goes with
    the one whose gender the corpus tells (f, if it tells both), so Dr Smith is one of them."""
    told = places.where("kind = 'name'").withColumn("gender", title_gender(F.col("value")))
    known = told.where("gender <> 'n'").groupBy("canon").agg(F.min("gender").alias("known"))
    names = told.join(known, "canon", "left").withColumn("gender", F.when(F.col("gender") == "n", F.coalesce("known", "gender")).otherwise(F.col("gender")))
    return places.where("kind <> 'name'").withColumn("gender", F.lit("")).unionByName(names.drop("known"))


def _byte(digest: Column, i: Column) -> Column:
    return F.conv(F.substring(digest, F.lit(1) + (i * 2) % 63, F.lit(2)), 16, 10).cast("int")


def _letter(first: str, n: Column) -> Column:
    return F.char(F.lit(ord(first)) + n)


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value worked out once, not for each element of the arrays in ``use``,
    and written once in the plan, however often ``use`` names it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _swapped(c: Column, b: Column, hexadecimal: Column) -> Column:
    """A character of the same class; punctuation stays."""
    return (
        F.when(~_is_swapped(c), c)
        .when(hexadecimal, F.lower(F.conv(b % 16, 10, 16)))
        .when(c == "0", (b % 10).cast("string"))
        .when(c.between("0", "9"), (1 + b % 9).cast("string"))
        .when(c.between("A", "Z"), _letter("A", b % 26))
        .otherwise(_letter("a", b % 26))
    )


def _is_swapped(c: Column) -> Column:
    return c.between("0", "9") | c.between("a", "z") | c.between("A", "Z")


OTHER_SCRIPT = r"[\p{L}\p{M}\p{N}&&[^\x00-\x7F]]"
HEX = "^(?=.*[a-f])[0-9a-f]+$"


def _secret(value: Column, digest: Column, keep: Column) -> Column:
    """What follows the first ``keep`` characters, as ``_remapped`` but in time linear in the length. Letters and digits of other scripts become Latin letters."""
    rest = F.regexp_replace(F.substring(value, keep + 1, F.length(value)), OTHER_SCRIPT, "a")
    characters = F.regexp_extract_all(rest, F.lit("(?s)."), F.lit(0))
    parts = F.struct(characters.alias("all"), digest.alias("digest"), rest.rlike(HEX).alias("hex"))
    new = _once(parts, lambda p: F.array_join(F.transform(p["all"], lambda c, i: _swapped(c, _byte(p["digest"], i), p["hex"])), ""))
    return new


def _remapped(value: Column, digest: Column, keep: Column) -> Column:
    """Each character after the first ``keep`` by one of its own class. The place in the digest counts
    characters other than punctuation, so that two ways of writing one entity get the same digits."""
    empty = F.struct(
        F.lit("").alias("out"),
        F.lit(0).alias("i"),
        F.lit(0).alias("place"),
        keep.cast("int").alias("keep"),
        F.substring(value, keep + 1, F.length(value)).rlike(HEX).alias("hex"),
        digest.alias("digest"),
    )

    def one(acc: Column, c: Column) -> Column:
        new = F.when(acc["i"] < acc["keep"], c).otherwise(_swapped(c, _byte(acc["digest"], acc["place"]), acc["hex"]))
        return F.struct(
            F.concat(acc["out"], new).alias("out"),
            (acc["i"] + 1).alias("i"),
            (acc["place"] + F.when(_is_swapped(c), 1).otherwise(0)).alias("place"),
            acc["keep"].alias("keep"),
            acc["hex"].alias("hex"),
            acc["digest"].alias("digest"),
        )

    characters = F.transform(F.sequence(F.lit(1), F.length(value)), lambda i: F.substring(value, i, F.lit(1)))
    return F.aggregate(characters, empty, one, lambda acc: acc["out"])


def _luhn(digits: Column) -> Column:
    """The checksum of a card number, 0 (modulo 10) if it is valid."""

    def checksum(digits: Column) -> Column:
        n = F.length(digits)

        def add(total: Column, i: Column) -> Column:
            d = F.substring(digits, i, F.lit(1)).cast("int") * (1 + (n - i) % 2)
            return total + d.cast("int") - F.when(d > 9, 9).otherwise(0)

        return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), add) % 10

    return _once(digits, checksum)


def _bare(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9A-Za-z]", "")


def _card(value: Column, digest: Column) -> Column:
    def checked(new: Column) -> Column:
        head = F.substring(new, F.lit(1), F.length(new) - 1)
        check = (10 - _luhn(F.concat(_bare(head), F.lit("0")))) % 10
        return F.when(_luhn(_bare(value)) == 0, F.concat(head, check.cast("string"))).otherwise(new)

    return _once(_remapped(value, digest, F.lit(1)), checked)


def _account(value: Column, digest: Column) -> Column:
    """Country as it was, other characters by class, check digits by the modulo-97 rule."""

    def rest(bare: Column) -> Column:
        def add(rest: Column, i: Column) -> Column:
            c = F.substring(bare, i, F.lit(1))
            n = F.when(c.rlike("[0-9]"), c.cast("int")).otherwise(F.ascii(c) - 55)
            return ((rest * F.when(n > 9, 100).otherwise(10) + n) % 97).cast("int")

        return F.aggregate(F.sequence(F.lit(1), F.length(bare)), F.lit(0), add)

    def checked(new: Column) -> Column:
        bare = F.concat(F.substring(_bare(new), F.lit(5), F.length(new)), F.substring(new, 1, 2), F.lit("00"))
        check = F.lit(98) - _once(bare, rest)
        return F.concat(F.substring(new, 1, 2), F.lpad(check.cast("string"), 2, "0"), F.substring(new, F.lit(5), F.length(new)))

    return _once(_remapped(value, digest, F.lit(4)), checked)


def _more(digest: Column, n: Column, letters: bool) -> Column:
    """``n`` letters or digits besides those of the digest itself."""
    new = F.sha2(F.concat(digest, F.lit("more")), 256)
    new = F.translate(new, "0123456789", "ghijklmnop") if letters else F.translate(new, "abcdef", "123456")
    return F.substring(new, F.lit(1), n)


def _ip(value: Column, digest: Column, extra: Column) -> Column:
    """Octets as long as they were; when those run out any octets, and a fifth part when even these do."""
    def octet(part: Column, i: Column) -> Column:
        b = _byte(digest, i)
        return F.when(extra > 0, 1 + b % 254).when(F.length(part) == 1, 1 + b % 9).when(F.length(part) == 2, 10 + b % 90).otherwise(100 + b % 155).cast("string")

    fifth = F.when(extra > OWN_FORMAT, F.concat(F.lit("."), _more(digest, extra, False))).otherwise("")
    return F.concat(F.array_join(F.transform(F.split(value, r"\."), octet), "."), fifth)


def _name(value: Column, digest: Column, extra: Column, gender: Column) -> Column:
    words = F.split(value, " ")
    rest = F.slice(words, F.lit(2), F.size(words))

    def invented(script: str) -> Column:
        syllables, endings = SYLLABLES[script]
        pick = lambda d, i: F.element_at(F.split(F.lit(" ".join(syllables)), " "), 1 + _byte(d, i) % len(syllables))
        given = reduce(lambda out, g: F.when(gender == g, endings[g]).otherwise(out), ("f", "m"), F.lit(endings["n"]))
        word = lambda d, i: F.concat(pick(d, i * 3), pick(d, i * 3 + 1), pick(d, i * 3 + 2), F.when(i == 0, F.concat(longer(d), given)).otherwise(""))
        longer = lambda d: F.when(extra > 0, F.array_join(F.transform(F.sequence(F.lit(1), extra), lambda j: pick(F.sha2(d, 256), j)), "")).otherwise("")
        parts = F.struct(rest.alias("rest"), digest.alias("digest"))
        return _once(parts, lambda p: F.transform(p["rest"], lambda _, i: F.initcap(word(p["digest"], i))))

    spelled = F.when(value.rlike(r"\p{IsCyrillic}"), invented("cyrillic")).when(value.rlike(r"\p{IsGreek}"), invented("greek")).otherwise(invented("latin"))
    return F.concat_ws(" ", F.element_at(words, 1), F.array_join(spelled, " "))


def surrogate(kind: Column, value: Column, canon: Column, gender: Column, attempt: Column, key: str) -> Column:
    digest = F.sha2(F.concat_ws("\x1f", F.lit(key), kind, attempt.cast("string"), canon, gender), 256)
    label = F.regexp_extract(value, LABEL, 0)
    keep = F.when((kind == "secret") & (label != ""), F.length(label)).when(value.startswith("AKIA"), 4).when(value.rlike(r"^\+1 "), 2).when(value.startswith("+"), F.length(F.regexp_extract(value, r"^\+[0-9]{1,3}", 0))).otherwise(0)
    extra = F.greatest(attempt - (OWN_FORMAT - 1), F.lit(0))

    def of_kind(parts: Column) -> Column:
        digest, keep, extra = parts["digest"], parts["keep"], parts["extra"]
        # letters of other scripts in an address become Latin ones, as no letter may stay
        latin = F.when(kind == "email", F.regexp_replace(value, OTHER_SCRIPT, "a")).otherwise(value)
        remapped = _remapped(latin, digest, keep)
        letters, digits = _more(digest, extra, True), _more(digest, extra, False)
        top = F.regexp_extract(value, r"\.[\p{L}\p{M}\p{N}-]+$", 0)  # the top-level domain stays
        return (
            F.when(kind == "secret", F.concat(F.substring(value, F.lit(1), keep), letters, _secret(value, digest, keep)))
            .when(kind == "email", F.concat(letters, F.substring(remapped, F.lit(1), F.length(value) - F.length(top)), top))
            .when(kind == "card", _card(value, digest))
            .when(kind == "account", _account(value, digest))
            .when(kind == "ip", _ip(value, digest, extra))
            .when(kind == "name", _name(value, digest, extra, gender))
            .otherwise(F.concat(remapped, digits))
        )

    return _once(F.struct(digest.alias("digest"), keep.alias("keep"), extra.alias("extra")), of_kind)


def _drawn(entities: DataFrame, key: str) -> DataFrame:
    new = surrogate(F.col("kind"), F.col("shown"), F.col("canon"), F.col("gender"), F.col("attempt"), key)
    # a column of its own, as ``canonical`` names it many times and the plan would hold all of it each time
    return entities.withColumn("new", new).withColumn("new_canon", canonical(F.col("kind"), F.col("new"))).drop("new")


def attempts(entities: DataFrame, key: str = KEY) -> DataFrame:
    """kind, canon, gender, attempt: the draw at which each entity's surrogate clashes with nothing.

    ``entities``: kind, canon, gender, shown (one way the entity is written). Of entities that draw the
    same surrogate the smallest keeps it; nobody keeps one that is an entity of the corpus."""
    # by number, as a small table takes long too
    entities = entities.repartition(int(entities.sparkSession.conf.get("spark.sql.shuffle.partitions")), "kind", "canon", "gender")
    real = entities.select("kind", F.col("canon").alias("new_canon"), F.lit(True).alias("real")).distinct()
    now = saved(_drawn(entities.withColumn("attempt", F.lit(0)), key), "drawn")
    while True:  # every draw after OWN_FORMAT has a larger space, so this ends
        first = now.groupBy("kind", "new_canon").agg(F.min(F.struct("canon", "gender")).alias("owner"))
        seen = now.join(first, ["kind", "new_canon"]).join(real, ["kind", "new_canon"], "left")
        clash = F.col("real").isNotNull() | (F.col("owner") != F.struct("canon", "gender"))
        judged = saved(seen.select("kind", "canon", "gender", "shown", "attempt", "new_canon", clash.alias("clash")), "judged")
        if judged.where("clash").limit(1).count() == 0:
            return judged.select("kind", "canon", "gender", "attempt")
        again = _drawn(judged.where("clash").withColumn("attempt", F.col("attempt") + 1).drop("new_canon", "clash"), key)
        now = saved(judged.where("not clash").drop("clash").unionByName(again), "drawn")


def with_surrogates(docs: DataFrame, key: str = KEY) -> DataFrame:
    """doc_id, text (entities replaced), n_entities for every row of ``docs``."""
    slim = docs.select("doc_id", "text")
    likely = F.coalesce(may_hold_entity(F.col("text")), F.lit(False))
    found = F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(PATTERN), F.lit(0))
    row = F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit("\x1f"), F.col("text")))
    having = saved(slim.where(likely).withColumn("found", found).where(F.size("found") > 0).withColumn("row", row), "having")
    places = having.select("row", F.posexplode("found").alias("place", "value"))
    places = saved(places.withColumn("kind", kind_of(F.col("value"))).withColumn("canon", canonical(F.col("kind"), F.col("value"))), "found")
    places = saved(with_gender(places), "places")
    entities = places.groupBy("kind", "canon", "gender").agg(F.min("value").alias("shown"))
    known = attempts(saved(entities, "entities"), key)
    new = surrogate(F.col("kind"), F.col("value"), F.col("canon"), F.col("gender"), F.col("attempt"), key)
    drawn = places.join(known, ["kind", "canon", "gender"]).select("row", "place", new.alias("new"))
    # no more than a text has entities
    by_row = drawn.groupBy("row").agg(F.array_sort(F.collect_set(F.struct("place", "new"))).alias("put"))
    pieces = F.split("text", PATTERN, -1)
    text = F.array_join(F.transform(pieces, lambda p, i: F.concat(p, F.coalesce(F.get(F.col("put.new"), i), F.lit("")))), "")
    changed = having.join(by_row, "row").select("doc_id", text.alias("text"), F.size("found").cast("long").alias("n_entities"))
    clear = F.when(likely, ~F.regexp_like("text", F.lit(PATTERN))).otherwise(True)
    untouched = slim.where(clear).withColumn("n_entities", F.lit(0).cast("long"))
    return untouched.unionByName(changed)
