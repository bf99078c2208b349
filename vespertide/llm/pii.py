"""Surrogates for personal data: keyed, of the same type, gender, script and format.

Detection is one regular expression per kind (e-mail address, IP address of either version, payment card and
bank account with valid check digits, phone number, social security number, names after a form of address). A
mention is brought to a canonical form, so one entity written in several formats (spaces, dashes, capitals, a
phone number with or without the country) stays one entity and its mentions get one surrogate, each poured into
the format of its mention. Of a name every word is an entity, whatever stands beside it, so "Mr. John Smith" and
"Mr. Smith" agree; further places of these words in the same document, without a form of address, are replaced
alike. Whether a word is a given name or a surname and which gender it has is settled by the mentions of the
whole corpus: what most of them say, so "Dr. Maria Lopez" and "Mrs. Maria Lopez" are one.

A surrogate is drawn from a keyed SHA-256 of (kind, canonical form, attempt). Draws are checked over
the whole corpus: one that equals a real entity of its kind, or that another entity has taken, is drawn
again with the next attempt, from a space that grows. Names are made of syllables, as many as give SPARE
names for each real one, so nearly all entities keep attempt 0, whose surrogate is computed from the mention
where the document is read; only the exceptions (later attempts, and words whose mentions disagree) are looked
up. They are broadcast where their number allows it; beyond BROADCAST_ROWS documents with exceptions, texts are
joined with them by one shuffle.

Cases: a null text stays null and has no entities; empty texts stay empty; repeated rows get the
same result; texts of any length are replaced whole; a null or repeated doc_id is no matter, as rows
are told apart by id and text; an empty table gives an empty result; other columns are kept. Names in
scripts other than Latin, Cyrillic and Greek get Latin surrogates; scripts without capitals have no names here.
An empty key is refused.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vespertide.llm.common import discard, materialize, read_table, row_key

KEY_CONF = "vespertide.pii.key"
#: Key of the registered query where the session sets none, so that its runs compare.
QUERY_KEY = "registered-query"
BROADCAST_ROWS = 200_000
ROW = ["__vt_id", "__vt_text_hash"]
#: Attempts within spaces that are reserved for examples; later ones may use all values of a kind.
RESERVED_ATTEMPTS = 8
#: From this attempt on numbers get one more digit for every RESERVED_ATTEMPTS, so a space that is full doesn't hold up the drawing.
WIDER_ATTEMPTS = 3 * RESERVED_ATTEMPTS
#: Names that the syllables can make for each real one.
SPARE = 50
DRAW_ROWS = 2_000

# Forms of address by the gender they tell, and where none is told.
MALE = ["Mr", "Herr", "Herrn", "M", "Monsieur", "Señor", "Don", "Г-н", "Господин"]
FEMALE = ["Mrs", "Ms", "Miss", "Frau", "Mme", "Mlle", "Madame", "Señora", "Señorita", "Doña", "Г-жа", "Госпожа"]
NEUTRAL = ["Dr", "Prof"]
# Syllables that names are made of, by script: beginnings, middles, and ends of given names (m, f, u) and of surnames (s, sf).
SYLLABLES = {
    "latin": {
        "start": "Al Ber Bran Car Cor Dan Del El Fer Gar Hal Hen Jor Kar Lan Lor Mar Mel Nor Os Per Ral Ren Ser Sil Tor Val Var Wil Yor".split(),
        "mid": "a am an ar e el em en i il in ir o ol on or u ul um ur".split(),
        "m": "bert do fred gar ko lo man mir nard ric son ton vin win".split(),
        "f": "beth da dine ella ette ia ina issa la line na ra sa ta".split(),
        "u": "bin dan dy ley lin ny rey rin ry sey".split(),
        "s": "berg den feld ford gren ham lund mond more rand sen stad stein ston vale well wick wood".split(),
    },
    "cyrillic": {
        "start": "Ал Бор Вад Вер Гал Дан Ел Жан Зор Ин Кир Лар Мар Ник Ол Пав Рос Сав Там Фед".split(),
        "mid": "а ал ан е ел ен и ил ин о ол ор у ул ур".split(),
        "m": "ан ей ий им ир ис он слав".split(),
        "f": "ана еса ида ика ина ия на са".split(),
        "s": "ев ин ов ский".split(),
        "sf": "ева ина ова ская".split(),
    },
    "greek": {
        "start": "Αλ Βασ Γερ Δημ Ελ Θεο Ιων Καλ Λεων Μαρ Νικ Ορ Παν Σωτ Τιμ Φιλ".split(),
        "mid": "α αν αρ ε ελ εν ι ιλ ιν ο ολ ορ".split(),
        "m": "ας ης ιος ος ων".split(),
        "f": "α η ια ινα ω".split(),
        "s": "άκης άτος ίδης όπουλος".split(),
        "sf": "άκη άτου ίδου οπούλου".split(),
    },
}
VARIANTS = ["s", "m", "f", "u"]

NAME_WORD = r"\p{Lu}(?:['’]\p{Lu})?[\p{L}\p{M}]+(?:['’]\p{Ll}[\p{L}\p{M}]+)?"
NAME_WORDS = rf"{NAME_WORD}(?:[ -]{NAME_WORD})*+"
# Forms of address also in capitals, as in "MR. SMITH".
MALE, FEMALE, NEUTRAL = ([*forms, *(x.upper() for x in forms if x.upper() not in forms)] for forms in (MALE, FEMALE, NEUTRAL))
ADDRESS = "|".join(sorted(MALE + FEMALE + NEUTRAL, key=lambda x: (-len(x), x)))
PATTERNS = {
    "email": r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]++@[\p{L}\p{N}-]++(?:\.[\p{L}\p{N}-]++)+",
    "ip": r"(?<![\p{L}\p{N}.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?![\p{L}\p{N}]|\.\d)",
    "ipv6": r"(?<![\p{L}\p{N}:.])(?=[0-9A-Fa-f:]*[0-9])(?:(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}|(?:[0-9A-Fa-f]{1,4}:){1,6}(?::[0-9A-Fa-f]{1,4}){1,6})(?![\p{L}\p{N}:])",
    "iban": r"(?<![\p{L}\p{N}])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![\p{L}\p{N}])",
    "card": r"(?<![\p{L}\p{N}+-])(?:4\d{3}|5[1-5]\d{2}|2[2-7]\d{2}|6011|6[45]\d{2}|35\d{2})([ -]?)\d{4}\1\d{4}\1\d{4}(?![\p{L}\p{N}]|-\d)|(?<![\p{L}\p{N}+-])3[47]\d{2}([ -]?)\d{6}\2\d{5}(?![\p{L}\p{N}]|-\d)",
    "ssn": r"(?<![\p{L}\p{N}-])\d{3}-\d{2}-\d{4}(?![\p{L}\p{N}]|-\d)",
    "phone": r"(?<![\p{L}\p{N}])\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{2,4}(?:[ .-]?\d{2,4}){1,4}(?!\p{L}|\d)|(?<![\p{L}\p{N}+(])\(\d{3}\) ?\d{3}-\d{4}(?![\p{L}\p{N}])|(?<![\p{L}\p{N}-])[2-9]\d{2}-\d{3}-\d{4}(?![\p{L}\p{N}]|-\d)",
    "name": rf"(?<![\p{{L}}\p{{N}}.])(?:{ADDRESS})\.? {NAME_WORDS}(?![\p{{L}}])",
}
DIGIT_KINDS = ["card", "ssn", "phone"]
POURED_KINDS = [*DIGIT_KINDS, "iban"]


def combined(kinds: list[str] | None = None) -> str:
    """One pattern for several kinds; back references of one are moved behind the groups of those before it."""
    out, groups = [], 0
    for kind, pattern in PATTERNS.items():
        if kinds is not None and kind not in kinds:
            continue
        own = pattern
        count = pattern.count("([ -]?)")
        for k in range(count, 0, -1):
            own = own.replace(f"\\{k}", f"\\{k + groups}")
        out.append(own)
        groups += count
    return "|".join(out)


def with_pattern(text: Column, act) -> Column:
    """act(pattern), with the kinds that the text can hold at all: most texts have no @, many no digit."""
    digits = ["ip", "ipv6", "iban", "card", "ssn", "phone"]
    some, mail = text.rlike("[0-9]"), F.contains(text, F.lit("@"))
    return F.when(some & mail, act(combined())).when(some, act(combined([*digits, "name"]))).when(mail, act(combined(["email", "name"]))).otherwise(act(combined(["name"])))


def kind_of(mention: Column) -> Column:
    """Kind of a whole mention, the first that fits in the order of PATTERNS; "number" for what only looks like a card."""
    kinds = F.when(F.lit(False), F.lit(""))
    bare = lambda p: "^(?:" + p.replace(r"(?<![\p{L}\p{N}+-])", "") + ")$"
    for kind, pattern in PATTERNS.items():
        kinds = kinds.when(mention.rlike(bare(pattern)), F.lit(kind))
    digits = F.regexp_replace(mention, "[^0-9]", "")
    account = F.regexp_replace(mention, " ", "")

    def checked(found: Column) -> Column:
        wrong = ((found == "card") & ~luhn_valid(digits)) | ((found == "iban") & (account_rest(account) != 1))
        return F.when(wrong, F.lit("number")).otherwise(found)

    return let(kinds.otherwise(F.lit("phone")), checked)


def account_rest(account: Column) -> Column:
    """Remainder modulo 97 of an account number whose first four characters are moved to its end, letters read as 10 to 35."""
    turned = F.concat(F.substring(account, F.lit(5), F.length(account)), F.substring(account, 1, 4))

    def add(rest: Column, c: Column) -> Column:
        return F.when(c.rlike("^[0-9]$"), rest * 10 + c.cast("int")).otherwise(rest * 100 + F.ascii(c) - 55) % 97

    return F.aggregate(F.split(turned, ""), F.lit(0), add)


def let(value: Column, body) -> Column:
    """body(value), with value computed once and named once in the plan, however often body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def is_name(mention: Column) -> Column:
    return mention.rlike(rf"^(?:{ADDRESS})\.? \p{{Lu}}")


def literal_array(values: list[str]) -> Column:
    return F.array(*[F.lit(v) for v in values])


def drawn(seed: Column, salt: Column | int | str, count: Column | int) -> Column:
    """A number below count, from a seed (the keyed digest) and what it is for."""
    salt = salt if isinstance(salt, Column) else F.lit(salt)
    count = count if isinstance(count, Column) else F.lit(count)
    return F.pmod(F.xxhash64(seed, salt), count.cast("long")).cast("int")


def pick(values: list[str], seed: Column, salt: Column | str) -> Column:
    return F.element_at(literal_array(values), drawn(seed, salt, len(values)) + 1)


def title_of(mention: Column) -> Column:
    return F.regexp_extract(mention, rf"^((?:{ADDRESS})\.? )", 1)


def name_words(mention: Column) -> Column:
    return F.regexp_extract_all(F.substring(mention, F.length(title_of(mention)) + 1, F.length(mention)), F.lit(NAME_WORD), F.lit(0))


def name_parts(mention: Column) -> Column:
    """(text, kind, canonical, variant) of the words of a name. What follows the last blank is a surname, what is before it given names."""
    bare = F.regexp_replace(title_of(mention), r"[. ]", "")
    gender = let(bare, lambda t: F.when(t.isin(MALE), "m").when(t.isin(FEMALE), "f").otherwise("u"))
    surnames = F.size(F.regexp_extract_all(F.substring_index(mention, " ", -1), F.lit(NAME_WORD), F.lit(0)))

    def parts(x: Column) -> Column:
        def part(word: Column, i: Column) -> Column:
            variant = F.when(i < F.size(x["words"]) - x["surnames"], x["gender"]).otherwise(F.lit("s"))
            return F.struct(word.alias("text"), F.lit("name").alias("kind"), F.lower(word).alias("canonical"), variant.alias("variant"))

        return F.transform(x["words"], part)

    return let(F.struct(name_words(mention).alias("words"), gender.alias("gender"), surnames.alias("surnames")), parts)


def entities_of(mention: Column) -> Column:
    """Array of (text, kind, canonical, variant) of a mention: one, or for names one a word."""
    digits = F.regexp_replace(mention, "[^0-9]", "")

    def of(kind: Column) -> Column:
        # A number of ten digits is one of the country 1.
        phone = F.when((F.length(digits) == 10) & ~mention.startswith("+"), F.concat(F.lit("1"), digits)).otherwise(digits)
        canonical = F.when(kind == "phone", phone).when(kind.isin(DIGIT_KINDS), digits).when(kind == "iban", F.lower(F.regexp_replace(mention, " ", ""))).otherwise(F.lower(mention))
        return F.array(F.struct(mention.alias("text"), kind.alias("kind"), canonical.alias("canonical"), F.lit("").alias("variant")))

    return F.when(is_name(mention), name_parts(mention)).otherwise(let(kind_of(mention), of))


def luhn_sum(digits: Column) -> Column:
    """Sum of the digits of all but the last place, every other one doubled from the right."""
    n = F.length(digits)

    def add(total: Column, i: Column) -> Column:
        twice = F.substring(digits, i, F.lit(1)).cast("int") * (F.pmod(n - i, F.lit(2)) + 1)
        return total + twice % 10 + F.floor(twice / 10).cast("int")

    return F.aggregate(F.sequence(F.lit(1), n - 1), F.lit(0), add)


def luhn_valid(digits: Column) -> Column:
    return F.pmod(luhn_sum(digits) + F.substring(digits, -1, 1).cast("int"), F.lit(10)) == 0


def redrawn_letters(text: Column, seed: Column) -> Column:
    """Each digit a digit and each letter a letter of its script; the rest stays."""

    def one(c: Column, i: Column) -> Column:
        def of(first: str, count: int) -> Column:
            return F.chr(drawn(seed, i, count) + ord(first)) if ord(first) < 128 else pick([chr(ord(first) + k) for k in range(count)], seed, i)

        return F.when(c.rlike("^[0-9]$"), of("0", 10)).when(c.rlike(r"^\p{IsCyrillic}$"), of("а", 32)).when(c.rlike(r"^\p{IsGreek}$"), of("α", 17)).when(c.rlike(r"^\p{L}$"), of("a", 26)).otherwise(c)

    return F.array_join(F.transform(F.split(text, ""), one), "")


def made_name(canonical: Column, variant: Column, seed: Column, syllables: Column) -> Column:
    """A name of the script of canonical: a beginning, so many middles, and an end that fits the variant."""

    def of(script: str) -> Column:
        parts = SYLLABLES[script]
        end = pick(parts["s"], seed, "end")
        if "sf" in parts:
            # Such surnames tell the gender by their own end.
            end = F.when(canonical.rlike("[аяηου]$"), pick(parts["sf"], seed, "end")).otherwise(end)
        ends = F.when(variant == "m", pick(parts["m"], seed, "end")).when(variant == "f", pick(parts["f"], seed, "end")).when(variant == "u", pick(parts.get("u", parts["m"]), seed, "end")).otherwise(end)
        middles = F.array_join(F.transform(F.sequence(F.lit(1), syllables), lambda i: pick(parts["mid"], seed, i)), "")
        return F.concat(pick(parts["start"], seed, "start"), middles, ends)

    return F.lower(F.when(canonical.rlike(r"^\p{IsCyrillic}"), of("cyrillic")).when(canonical.rlike(r"^\p{IsGreek}"), of("greek")).otherwise(of("latin")))


def surrogate(kind: Column, canonical: Column, variant: Column, attempt: Column, key: str, syllables: int = 1) -> Column:
    """Canonical form of the surrogate of an entity."""
    seed = F.sha2(F.concat_ws("\x1f", F.lit(key), kind, canonical, attempt.cast("string")).cast("binary"), 256)

    def of(seed: Column) -> Column:
        digits = lambda begin, n: F.array_join(F.transform(F.sequence(begin if isinstance(begin, Column) else F.lit(begin), n), lambda i: drawn(seed, i, 10).cast("string")), "")
        free = attempt >= RESERVED_ATTEMPTS
        size = F.length(canonical)
        more = F.greatest(F.lit(0), F.floor((attempt - WIDER_ATTEMPTS) / RESERVED_ATTEMPTS).cast("int") + 1)
        wider = lambda number: F.when(more > 0, F.concat(number, digits(size + 1, size + more))).otherwise(number)
        hosts = F.when(attempt < RESERVED_ATTEMPTS, 100_000).otherwise(1_000_000_000)

        email = F.concat(redrawn_letters(F.substring_index(canonical, "@", 1), seed), F.lit("@mail"), drawn(seed, "host", hosts).cast("string"), F.lit(".example"))
        octet = lambda n, low, high: (drawn(seed, f"octet{n}", high - low + 1) + low).cast("string")
        ip = F.concat_ws(".", F.when(free, octet(1, 1, 223)).otherwise(F.lit("10")), octet(2, 0, 255), octet(3, 0, 255), octet(4, 1, 254))
        # Groups of the block for documentation, short or long as the address is.
        groups = F.transform(F.sequence(F.lit(1), F.when(F.contains(canonical, F.lit("::")), F.lit(4)).otherwise(F.lit(6))), lambda i: F.lower(F.hex(drawn(seed, i, 65_535) + 1)))
        ipv6 = F.concat(F.lit("2001:db8:"), F.when(F.contains(canonical, F.lit("::")), F.lit(":")).otherwise(F.lit("")), F.array_join(groups, ":"))
        country = F.substring(canonical, 1, 2)
        check = lambda own: F.lpad((98 - account_rest(F.upper(F.concat(country, F.lit("00"), own)))).cast("string"), 2, "0")
        iban = let(redrawn_letters(F.substring(canonical, F.lit(5), size), seed), lambda own: F.concat(country, check(own), own))
        card = let(F.concat(F.substring(canonical, 1, 1), digits(2, size - 1)), lambda body: F.concat(body, F.pmod(-luhn_sum(F.concat(body, F.lit("0"))), F.lit(10)).cast("string")))
        ssn = wider(F.when(free, digits(1, F.lit(9))).otherwise(F.concat(F.lit("9"), digits(2, F.lit(9)))))
        american = F.concat(F.lit("1"), (drawn(seed, "area", 8) + 2).cast("string"), digits(3, F.lit(4)), F.when(free, digits(5, F.lit(7))).otherwise(F.lit("555")), digits(8, F.lit(11)))
        phone = wider(F.when((size == 11) & canonical.startswith("1"), american).when(free, digits(1, size)).otherwise(F.concat(F.substring(canonical, 1, 2), digits(3, size))))
        # Later attempts take longer names, so there are always enough.
        name = made_name(canonical, variant, seed, F.lit(syllables) + F.floor(attempt / 2).cast("int"))
        return F.when(kind == "email", email).when(kind == "ip", ip).when(kind == "ipv6", ipv6).when(kind == "iban", iban).when(kind == "card", card).when(kind == "ssn", ssn).when(kind == "phone", phone).otherwise(name)

    return let(seed, of)


def poured(kind: Column, text: Column, canonical: Column) -> Column:
    """The surrogate in the format of the mention: its separators, or its capitals."""
    fits = F.when(kind == "iban", r"^[0-9A-Za-z]$").otherwise("^[0-9]$")
    places = F.filter(F.split(text, ""), lambda c: c.rlike(r"^[0-9A-Za-z]$") & ((kind == "iban") | c.rlike("^[0-9]$")))

    def next_place(state: Column, c: Column) -> Column:
        taken = F.regexp_like(c, fits)
        return F.struct(
            F.concat(state["out"], F.when(taken, F.substring(canonical, state["used"] + 1, F.lit(1))).otherwise(c)).alias("out"),
            (state["used"] + taken.cast("int")).alias("used"),
        )

    # A phone number of ten digits without its country takes those behind the country.
    first = F.when((kind == "phone") & (F.size(places) == 10) & ~text.startswith("+"), 1).otherwise(0)
    # Digits that a number got beyond its own stand at its end.
    in_format = F.aggregate(F.split(text, ""), F.struct(F.lit("").alias("out"), first.alias("used")), next_place, lambda s: F.concat(s["out"], F.substring(canonical, s["used"] + 1, F.length(canonical))))
    loud = text == F.upper(text)
    named = F.when(loud, F.upper(canonical)).otherwise(F.concat(F.upper(F.substring(canonical, 1, 1)), F.substring(canonical, F.lit(2), F.length(canonical))))
    cased = F.when(kind.isin("email", "ipv6") & loud & text.rlike(r"\p{L}"), F.upper(canonical)).otherwise(canonical)
    return F.when(kind == "iban", F.upper(in_format)).when(kind.isin(POURED_KINDS), in_format).when(kind == "name", named).otherwise(cased)


def mentions(text: Column) -> Column:
    return with_pattern(text, lambda p: F.regexp_extract_all(text, F.lit(p), F.lit(0)))


def documents_with_mentions(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The row keys and distinct mentions of the documents that have any."""
    found = row_key(docs, text_col=text_col).select(*ROW, F.array_distinct(mentions(F.col(text_col))).alias("mentions"))
    return found.where(F.size("mentions") > 0)


def entities(found: DataFrame) -> DataFrame:
    """Distinct (kind, canonical) of the corpus with the variant that most mentions say, and whether they disagree, from the mentions of its documents."""
    each = found.select(F.explode("mentions").alias("m")).groupBy("m").agg(F.count("*").alias("n"))
    votes = each.select("n", F.explode(entities_of(F.col("m"))).alias("e")).where("e.kind <> 'number'").groupBy("e.kind", "e.canonical", "e.variant").agg(F.sum("n").alias("n"))
    order = F.array_position(F.array(*map(F.lit, VARIANTS)), F.col("variant"))
    return votes.groupBy("kind", "canonical").agg(F.max_by("variant", F.struct("n", -order)).alias("variant"), (F.count("*") > 1).alias("disagree"))


def syllables_for(real: DataFrame) -> int:
    """Middle syllables that give SPARE names for each real one."""
    n, parts, k = real.where("kind = 'name'").count(), SYLLABLES["latin"], 1
    while len(parts["start"]) * len(parts["mid"]) ** k * min(len(parts[v]) for v in VARIANTS) < SPARE * n:
        k += 1
    return k


def settled(real: DataFrame, key: str, syllables: int = 1) -> DataFrame:
    """(kind, canonical, variant, attempt, surrogate): all entities, no two of a kind with one surrogate, none with that of a real one."""
    who = ["kind", "canonical", "variant"]
    waiting, attempt = real.select(*who), 0
    done: DataFrame | None = None
    taken = real.select("kind", F.col("canonical").alias("surrogate"))
    tasks = max(1, real.count() // DRAW_ROWS)
    while True:
        draw = waiting.repartition(tasks, "canonical").withColumn("attempt", F.lit(attempt))
        draw = draw.withColumn("surrogate", surrogate(F.col("kind"), F.col("canonical"), F.col("variant"), F.col("attempt"), key, syllables))
        fresh = draw.join(taken, ["kind", "surrogate"], "left_anti")
        if done is not None:
            fresh = fresh.join(done.select("kind", "surrogate"), ["kind", "surrogate"], "left_anti")
        won = fresh.groupBy("kind", "surrogate").agg(F.min(F.struct("canonical", "variant", "attempt")).alias("w")).select("kind", "w.*", "surrogate")
        won = materialize(won if done is None else done.unionByName(won), "pii-settled")
        waiting, attempt = real.select(*who).join(won, ["kind", "canonical"], "left_anti"), attempt + 1
        if done is not None:
            discard(done)
        done = won
        if waiting.isEmpty():
            return done


def replace_entities(docs: DataFrame, key: str, text_col: str = "text") -> DataFrame:
    """docs with surrogates in the text column, and __vt_n_entities."""
    if not key:
        raise ValueError("surrogates need a key")
    found = materialize(documents_with_mentions(docs, text_col), "pii-mentions")
    real = materialize(entities(found), "pii-entities")
    syllables = syllables_for(real)
    done = settled(real.select("kind", "canonical", "variant"), key, syllables)
    odd = done.join(real.select("kind", "canonical", "disagree"), ["kind", "canonical"]).where("attempt > 0 OR disagree")
    again = materialize(odd.select("kind", "canonical", "variant", "attempt"), "pii-again")
    discard(done)
    discard(real)
    text = F.col(text_col)
    keyed = row_key(docs, text_col=text_col).withColumn("__vt_mentions", F.coalesce(mentions(text), F.array().cast("array<string>")))
    if again.isEmpty():
        keyed = keyed.withColumn("__vt_again", F.array().cast("array<struct<kind: string, canonical: string, variant: string, attempt: int>>"))
    else:
        small = again.count() <= BROADCAST_ROWS
        each = found.select(*ROW, F.explode("mentions").alias("m")).select(*ROW, F.explode(entities_of(F.col("m"))).alias("e"))
        hit = each.select(*ROW, "e.kind", "e.canonical").distinct().join(F.broadcast(again) if small else again, ["kind", "canonical"])
        by_doc = materialize(hit.groupBy(*ROW).agg(F.collect_set(F.struct("kind", "canonical", "variant", "attempt")).alias("__vt_again")), "pii-by-document")
        side = F.broadcast(by_doc) if by_doc.count() <= BROADCAST_ROWS else by_doc
        a, b = keyed.alias("a"), side.alias("b")
        same = F.col("a.__vt_id").eqNullSafe(F.col("b.__vt_id")) & (F.col("a.__vt_text_hash") == F.col("b.__vt_text_hash"))
        keyed = a.join(b, same, "left").select("a.*", "b.__vt_again")
    discard(found)

    def new_text(e: Column) -> Column:
        own = F.get(F.filter("__vt_again", lambda x: (x["kind"] == e["kind"]) & (x["canonical"] == e["canonical"])), F.lit(0))
        drawn_ = let(own, lambda x: surrogate(e["kind"], e["canonical"], F.coalesce(x["variant"], e["variant"]), F.coalesce(x["attempt"], F.lit(0)), key, syllables))
        return let(drawn_, lambda x: poured(e["kind"], e["text"], x))

    def in_place(mention: Column) -> Column:
        title = title_of(mention)
        between = F.regexp_extract_all(F.substring(mention, F.length(title) + 1, F.length(mention)), F.lit("[ -]"), F.lit(0))
        # Within other mentions nothing stands between parts, as there is one.
        separators = F.when(is_name(mention), between).otherwise(F.array().cast("array<string>"))
        parts = F.transform(entities_of(mention), lambda e: F.when(e["kind"] == "number", e["text"]).otherwise(new_text(e)))
        return F.concat(F.when(is_name(mention), title).otherwise(F.lit("")), F.array_join(F.zip_with(parts, separators, lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), ""))

    # Words of the names of a document and what they become, for places without a form of address.
    of_name = F.flatten(F.transform(F.filter("__vt_mentions", is_name), name_parts))
    known = F.array_distinct(F.transform(of_name, lambda e: F.struct(e["text"].alias("text"), new_text(e).alias("to"))))
    keyed = keyed.withColumn("__vt_names", F.when(F.exists("__vt_mentions", is_name), known))

    def also(segment: Column) -> Column:
        whole = lambda word: F.concat(F.lit(r"(?<![\p{L}\p{N}])\Q"), word, F.lit(r"\E(?![\p{L}\p{N}])"))
        return F.aggregate("__vt_names", segment, lambda t, e: F.regexp_replace(t, whole(e["text"]), e["to"]))

    count = F.size("__vt_mentions")
    real_count = F.when(count > 0, F.size(F.filter("__vt_mentions", lambda m: kind_of(m) != "number"))).otherwise(0)
    around = with_pattern(text, lambda p: F.split(text, p, -1))
    around = F.when(F.size("__vt_names") > 0, F.transform(around, also)).otherwise(around)
    # The text is what stands around the mentions, with the surrogates in between.
    rebuilt = F.array_join(F.zip_with(around, F.transform("__vt_mentions", in_place), lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")
    out = keyed.withColumn(text_col, F.when(count > 0, rebuilt).otherwise(text)).withColumn("__vt_n_entities", real_count.cast("long"))
    return out.select(*docs.columns, "__vt_n_entities")


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with surrogates for the personal data found in it. The key is that of the session, or QUERY_KEY."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    out = replace_entities(docs, spark.conf.get(KEY_CONF, None) or QUERY_KEY)
    return out.select("doc_id", F.col("__vt_n_entities").alias("n_entities"), "text")
