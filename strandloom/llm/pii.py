"""Pseudonyms for personal data: keyed, type-consistent surrogates, native expressions only.

Entities are found by one pattern and reduced to what names them: the digits of a number, letters and
digits of an account, a person's name without title, all without letter case.  Each gets a surrogate
once per corpus: a format-preserving keyed image that keeps the type, the script of every letter
(letters of rare scripts become Latin), the country code of a telephone number, valid check digits of
cards and accounts, and the gender of a name.  A surrogate that equals another entity's, or any entity
that really occurs, is drawn again, and grows after GROWS draws; so different entities stay different
and all mentions of one entity stay one, in every document.  A mention keeps its own punctuation,
title and letter case.  Names are found after a title, or where a common given name begins them.

Results for odd input: null text stays null with 0 entities; empty texts and texts without
entities are unchanged; repeated rows get equal results, one row each; null ids are kept; long
texts are taken whole; an empty table gives an empty result; other columns of the input are
ignored, whatever their names.
"""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column, DataFrame, functions as F

from .common import cut
from .spans import quoted

# Marks belong to the letters of many scripts.  Every part of an address holds a letter or a digit.
_WORD = r"\p{L}\p{M}\p{N}._%+-"
_LABEL = r"-*+[\p{L}\p{N}][\p{L}\p{M}\p{N}-]*+"
# Titles and given names by gender and script, family names by script.
TITLES_F = ["Mrs", "Ms", "Miss", "Frau", "Madame", "Mme", "Señora", "Sra", "Госпожа"]
TITLES_M = ["Mr", "Herr", "Monsieur", "Señor", "Sr", "Господин"]
GIVEN = {
    ("f", "latin"): "Alice Anna Brenda Carla Clara Diana Elena Emma Eva Fiona Greta Hannah Irene Julia Karen Laura Lena Lucia Maria Marta Nadia Nora Olivia Paula Rosa Sara Sofia Teresa Ursula Vera".split(),
    ("m", "latin"): "Adam Albert Boris Carlos Daniel David Edgar Emil Felix Frank Georg Hugo Ivan Jonas Karl Leon Lucas Marco Martin Nils Oscar Paul Peter Ralph Robert Samuel Simon Thomas Victor Walter".split(),
    ("f", "cyrillic"): "Алина Анна Вера Дарья Елена Ирина Ксения Лидия Мария Нина Ольга Полина Светлана Софья Татьяна".split(),
    ("m", "cyrillic"): "Алексей Андрей Борис Виктор Денис Егор Иван Кирилл Леонид Максим Никита Олег Павел Роман Сергей".split(),
}
FAMILY = {
    "latin": "Adler Baker Berger Castillo Cooper Dupont Fischer Fontaine Garcia Gruber Hansen Keller Lambert Lopez Marin Meyer Moreau Nielsen Ortega Palmer Ramos Roth Santos Schmid Torres Turner Vidal Weber Winter Young".split(),
    "cyrillic": "Беляев Волков Громов Егоров Жуков Зайцев Иванов Козлов Лебедев Морозов Новиков Орлов Павлов Соколов Титов".split(),
}

# Titles of either gender, further given names.
TITLES_N = ["Dr", "Prof"]
MORE_F = "Amelie Barbara Catherine Charlotte Christine Elisabeth Elizabeth Emily Isabel Jane Jennifer Katharina Linda Lisa Margaret Marie Mary Monika Nathalie Patricia Sabine Sarah Susan Ursula".split()
MORE_M = "Alexander Andreas Antonio Bob Charles Christian Diego Francisco George Hans Henry Jack Jacques James Jean Johann John José Juan Klaus Louis Luis Manuel Mark Michael Miguel Pablo Pedro Philippe Pierre Richard Stefan Wolfgang William".split()
KNOWN = {"f": GIVEN["f", "latin"] + GIVEN["f", "cyrillic"] + MORE_F, "m": GIVEN["m", "latin"] + GIVEN["m", "cyrillic"] + MORE_M}
# The country codes of one and of two digits; others have three.
CODES = {1: "[17]", 2: "2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]"}

_TITLE = r"(?:(?:" + "|".join(TITLES_F + TITLES_M + TITLES_N) + r")\.? )+"
_PART = r"\p{Lu}[\p{Ll}\p{M}]+(?:-\p{Lu}[\p{Ll}\p{M}]+)*"
_GIVEN = r"(?=\p{Lu})(?:" + "|".join(sorted({n for names in KNOWN.values() for n in names})) + ")"
#: Type -> pattern, in the order in which they are tried at a place.
PATTERNS = {
    "email": rf"(?<![{_WORD}])(?=[._%+\p{{M}}-]*+[\p{{L}}\p{{N}}])[{_WORD}]++@{_LABEL}(?:\.{_LABEL})+",
    "ip": r"(?<![0-9.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?![0-9])",
    "phone": r"(?<![0-9+])\+1[ .-]?(?:\([0-9]{3}\)|[0-9]{3})[ .-]?[0-9]{3}[ .-]?[0-9]{4}(?![0-9])"
    r"|(?<![0-9+])\+(?=(?:[ .()-]{0,2}[0-9]){8})[2-9][0-9]{0,2}(?:[ .-]?(?:\([0-9]{1,4}\)|[0-9]{1,4})){2,6}(?![0-9])"
    r"|(?<![0-9+])\+[0-9]{1,3}[ .-]?(?:\([0-9]{2,4}\)|[0-9]{2,4})(?:[ .-]?[0-9]{2,4}){2,3}(?![0-9])|(?<![0-9])\([0-9]{3}\) ?[0-9]{3}-[0-9]{4}(?![0-9])|(?<![0-9-])[0-9]{3}-[0-9]{3}-[0-9]{4}(?![0-9-])",
    "card": r"(?<![0-9A-Za-z])(?:[0-9]{4}[ -]?){3}[0-9]{4}(?![0-9A-Za-z])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "name": rf"(?<!\p{{L}}){_TITLE}{_PART}(?: {_PART})?|(?<!\p{{L}}){_GIVEN} {_PART}",
}
TYPES = list(PATTERNS)
ANY = "|".join(f"(?:{p})" for p in PATTERNS.values())
#: A cheap sign that a text may hold an entity at all: a digit, an at sign, a title or a given name.
HINT = rf"[0-9@]|(?<!\p{{L}}){_TITLE}\p{{Lu}}|(?<!\p{{L}}){_GIVEN} \p{{Lu}}"
#: Draws after which surrogates grow, so that small spaces do not run out; the loop then ends soon.
GROWS = 8
#: Java's script -> its letters, from ranges that hold the common ones; other scripts become Latin.
SCRIPTS = {
    script: "".join(c for c in map(chr, range(first, last + 1)) if unicodedata.category(c) in ("Lo", "Ll"))
    for script, first, last in [
        ("Han", 0x4E00, 0x51FF), ("Hiragana", 0x3042, 0x3093), ("Katakana", 0x30A2, 0x30F3), ("Hangul", 0xAC00, 0xAFFF), ("Arabic", 0x0628, 0x064A), ("Hebrew", 0x05D0, 0x05EA),
        ("Devanagari", 0x0905, 0x0939), ("Bengali", 0x0985, 0x09B9), ("Tamil", 0x0B85, 0x0BB9), ("Telugu", 0x0C05, 0x0C39), ("Thai", 0x0E01, 0x0E2E), ("Armenian", 0x0561, 0x0586), ("Georgian", 0x10D0, 0x10F0),
    ]
}


def entity_type(entity: str) -> Column:
    """The first type whose pattern matches the whole entity."""
    cases = " ".join(f"WHEN {entity} RLIKE {quoted(f'^(?:{p})$')} THEN '{t}'" for t, p in PATTERNS.items())
    return F.expr(f"CASE {cases} END")


def _array(values: list[str]) -> str:
    return "array(" + ", ".join(f"'{v}'" for v in values) + ")"


def _letters(seed: str) -> str:
    """SQL of a character-wise image of ``canon`` that keeps class, script and punctuation."""

    def shift(first: int, size: int) -> str:
        return f"char({first} + pmod(xxhash64({seed}, i, 'c'), {size}))"

    # Letters beyond ASCII move inside their own script's block; char() covers one byte only.
    latin, cyrillic, greek = "áàâäãåçéèêëíìîïñóòôöõúùûüýß", "абвгдежзийклмнопрстуфхцчшщъыьэюя", "αβγδεζηθικλμνξοπρστυφχψω"
    pick = lambda s: f"substring('{s}', 1 + pmod(xxhash64({seed}, i, 'c'), {len(s)}), 1)"
    other = " ".join(f"WHEN c RLIKE {quoted(rf'^\p{{Is{script}}}')} THEN {pick(letters)}" for script, letters in {**SCRIPTS, "Cyrillic": cyrillic, "Greek": greek}.items())
    return f"""array_join(transform(split(canon, ''), (c, i) -> CASE
        WHEN c BETWEEN '0' AND '9' THEN {shift(48, 10)}
        WHEN c BETWEEN 'a' AND 'z' THEN {shift(97, 26)}
        WHEN c BETWEEN 'A' AND 'Z' THEN {shift(65, 26)}
        WHEN instr('{latin}', c) > 0 THEN {pick(latin)}
        WHEN instr('{cyrillic}', c) > 0 THEN {pick(cyrillic)}
        WHEN instr('{greek}', c) > 0 THEN {pick(greek)}
        WHEN c <= '~' THEN c
        {other}
        WHEN c RLIKE {quoted(r"^\p{N}")} THEN {shift(48, 10)}
        WHEN c RLIKE {quoted(r"^\p{IsLatin}")} THEN {pick(latin)}
        WHEN c RLIKE {quoted(r"^[\p{L}\p{M}]")} THEN {shift(97, 26)}
        ELSE c END), '')"""


def _luhn(digits: str) -> str:
    """SQL of the Luhn sum, mod 10, of a string of digits read from the right."""
    return f"""pmod(aggregate(sequence(1, length({digits})), 0, (s, k) -> s + CASE
        WHEN k % 2 = 1 THEN CAST(substring({digits}, -k, 1) AS int)
        WHEN CAST(substring({digits}, -k, 1) AS int) < 5 THEN 2 * CAST(substring({digits}, -k, 1) AS int)
        ELSE 2 * CAST(substring({digits}, -k, 1) AS int) - 9 END), 10)"""


def _mod97(text: str) -> str:
    """SQL of the remainder by 97 of a string of digits and small letters (a is 10)."""
    return f"""aggregate(split({text}, ''), 0, (s, c) -> CASE WHEN c = '' THEN s
        WHEN c <= '9' THEN pmod(s * 10 + try_cast(c AS int), 97) ELSE pmod(s * 100 + ascii(c) - 87, 97) END)"""


def with_surrogates(entities: DataFrame, key: str, attempt: int) -> DataFrame:
    """Add ``surrogate`` to (type, canon, gender)."""
    seed = "_seed"
    # The n-th draw depends on the key, the type, the entity and the number of the attempt.
    df = entities.withColumn(seed, F.sha2(F.concat_ws("\u0000", F.lit(key), "type", "canon", F.lit(str(attempt))).cast("binary"), 256))
    df = df.withColumn("_image", F.expr(_letters(seed)))
    more = attempt - GROWS + 1
    grown = lambda x: f"concat({x}, translate(substring({seed}, 1, {more}), 'abcdef', '012345'))" if more > 0 else x
    octets = f"array_join(transform(split(canon, '[.]'), (o, i) -> CAST(1 + pmod(xxhash64({seed}, i, 'o'), 254) AS string)), '.')"
    local = f"concat(substring_index(_image, '@', 1), substring({seed}, 1, {more}))" if more > 0 else "substring_index(_image, '@', 1)"
    email = f"concat({local}, '@', CASE WHEN instr(substring_index(canon, '@', -1), '.') > 0 THEN concat(substring(substring_index(_image, '@', -1), 1, length(substring_index(canon, '@', -1)) - length(substring_index(canon, '.', -1))), substring_index(canon, '.', -1)) ELSE substring_index(_image, '@', -1) END)"
    code = f"(CASE WHEN canon NOT LIKE '+%' THEN 0 WHEN canon RLIKE '^[+](?:{CODES[1]})' THEN 2 WHEN canon RLIKE '^[+](?:{CODES[2]})' THEN 3 ELSE 4 END)"
    phone = grown(f"concat(substring(canon, 1, {code}), substring(_image, 1 + {code}))")
    # Check digits are right where the entity's are.
    head = "substring(_image, 1, length(_image) - 1)"
    card = grown(f"""CASE WHEN {_luhn("canon")} = 0 THEN concat({head}, CAST(pmod(10 - {_luhn(f"concat({head}, '0')")}, 10) AS string)) ELSE _image END""")
    land, rest = "substring(canon, 1, 2)", grown("substring(_image, 5)")
    check = f"lpad(CAST(98 - {_mod97(f"concat({rest}, {land}, '00')")} AS string), 2, '0')"
    iban = f"concat({land}, CASE WHEN {_mod97(f"concat(substring(canon, 5), substring(canon, 1, 4))")} = 1 THEN {check} ELSE substring(_image, 3, 2) END, {rest})"
    female = f"(gender = 'f' OR gender = '' AND pmod(xxhash64({seed}, 's'), 2) = 0)"
    cyrillic = "canon RLIKE '[а-яё]'"

    def given(gender: str) -> str:
        one = lambda script: f"element_at({_array(GIVEN[gender, script])}, 1 + CAST(pmod(xxhash64({seed}, 'g'), {len(GIVEN[gender, script])}) AS int))"
        return f"IF({cyrillic}, {one('cyrillic')}, {one('latin')})"

    one = lambda script: f"element_at({_array(FAMILY[script])}, 1 + CAST(pmod(xxhash64({seed}, 'f'), {len(FAMILY[script])}) AS int))"
    # Names come from short lists; later attempts, and many people, get a further part to stay apart.
    further = f"concat('-', substring(translate(_image, ' .-', ''), 1, {2 + attempt}), substring({seed}, 1, {max(more, 0)}))" if attempt else "''"
    family = f"concat(' ', IF({cyrillic}, concat({one('cyrillic')}, IF({female}, 'а', '')), {one('latin')}), {further})"
    name = f"lower(concat(IF({female}, {given('f')}, {given('m')}), IF(canon LIKE '% %' OR {attempt} > 0, {family}, '')))"
    cases = {"ip": octets, "email": email, "phone": phone, "card": card, "ssn": grown("_image"), "iban": iban, "name": name}
    made = F.expr("CASE type " + " ".join(f"WHEN '{t}' THEN {sql}" for t, sql in cases.items()) + " END")
    return df.withColumn("surrogate", made).drop(seed, "_image")


def surrogate_map(entities: DataFrame, key: str) -> DataFrame:
    """(type, canon, surrogate), one row for each distinct entity, surrogates distinct and unused.

    A ``gender`` may say f or m of names; of one name's, the greatest counts.  Each round draws for the
    entities still without a surrogate; the least entity of a clash keeps the draw.  Rounds after the
    first concern the few that clashed.
    """
    if "gender" not in entities.columns:
        entities = entities.withColumn("gender", F.lit(""))
    left = cut(entities.groupBy("type", "canon").agg(F.max("gender").alias("gender")), "entities")
    real = left.select(F.col("canon").alias("surrogate"))
    done, attempt = None, 0
    while True:
        drawn = cut(with_surrogates(left, key, attempt), "drawn")
        first = drawn.groupBy("surrogate").agg(F.min("canon").alias("_first"))
        taken = real if done is None else real.unionByName(done.select("surrogate"))
        first = first.join(taken, "surrogate", "left_anti")
        settled = drawn.join(first, "surrogate", "left")
        settled = cut(settled.select("type", "canon", "gender", "surrogate", F.coalesce(F.col("_first") == F.col("canon"), F.lit(False)).alias("ok")), "settled")
        won = settled.where("ok").select("type", "canon", "surrogate")
        done = won if done is None else done.unionByName(won)
        left = settled.where("NOT ok").select("type", "canon", "gender")
        if left.isEmpty():
            return done
        attempt += 1


_BARE = f"regexp_replace(entity, {quoted('^' + _TITLE)}, '')"


def _canon() -> str:
    """SQL of what an ``entity`` of ``type`` is called in every mention."""
    return f"""CASE WHEN type = 'phone' THEN concat(IF(entity LIKE '+%', '+', ''), regexp_replace(entity, '[^0-9]', ''))
        WHEN type IN ('card', 'ssn') THEN regexp_replace(entity, '[^0-9]', '')
        WHEN type = 'iban' THEN lower(regexp_replace(entity, '[^A-Za-z0-9]', ''))
        WHEN type = 'name' THEN lower({_BARE}) ELSE lower(entity) END"""


def _gender() -> str:
    """SQL of the gender that a name's title or its given name tells."""
    title = lambda names: f"entity RLIKE {quoted('^(?:(?:' + '|'.join(TITLES_N) + r')\.? )*(?:' + '|'.join(names) + r')\.? ')}"
    known = lambda g: f"substring_index({_BARE}, ' ', 1) IN ({', '.join(repr(n) for n in KNOWN[g])})"
    return f"CASE WHEN type <> 'name' THEN '' WHEN {title(TITLES_F)} THEN 'f' WHEN {title(TITLES_M)} THEN 'm' WHEN {known('f')} THEN 'f' WHEN {known('m')} THEN 'm' ELSE '' END"


def _shown() -> str:
    """SQL of the mention ``entity`` with its ``surrogate``: its own punctuation, title and letter case."""
    plain = "translate(surrogate, '+', '')"
    before = "length(regexp_replace(substring(entity, 1, i), '[^0-9A-Za-z]', ''))"
    letter = f"substring({plain}, 1 + {before}, 1)"
    filled = f"""concat(array_join(transform(split(entity, ''), (c, i) -> CASE WHEN c BETWEEN 'A' AND 'Z' THEN upper({letter}) WHEN c RLIKE '[0-9a-z]' THEN {letter} ELSE c END), ''),
        substring({plain}, 1 + length(regexp_replace(entity, '[^0-9A-Za-z]', ''))))"""
    return f"""CASE WHEN type IN ('phone', 'card', 'ssn', 'iban') THEN {filled}
        WHEN type = 'name' THEN concat(substring(entity, 1, length(entity) - length({_BARE})), IF({_BARE} = upper({_BARE}), upper(surrogate), initcap(surrogate)))
        WHEN entity = lower(entity) THEN surrogate WHEN entity = upper(entity) THEN upper(surrogate)
        ELSE concat(upper(substring(surrogate, 1, 1)), substring(surrogate, 2)) END"""


def pseudonymise(docs: DataFrame, key: str) -> DataFrame:
    """doc_id, text (with surrogates) and n_entities of every row."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    pattern = quoted(ANY)
    found = texts.withColumn(
        "_found", F.expr(f"CASE WHEN text RLIKE {quoted(HINT)} THEN regexp_extract_all(text, {pattern}, 0) ELSE CAST(array() AS array<string>) END")
    )
    # Written once: the pattern costs far more than the texts' way to the disk and back.
    found = cut(found, "found")
    clean = found.where("_found IS NULL OR size(_found) = 0").select("doc_id", "text", F.lit(0).cast("long").alias("n_entities"))
    # Rows are told apart by id and two hashes of their text; equal rows share one rebuilt text.
    keyed = found.where("size(_found) > 0").withColumn("_row", F.struct(F.xxhash64("doc_id", "text").alias("a"), F.xxhash64("text", F.lit(1)).alias("b")))
    mentions = cut(
        keyed.select("_row", F.posexplode("_found").alias("pos", "entity"))
        .withColumn("type", entity_type("entity"))
        .withColumn("canon", F.expr(_canon())),
        "mentions",
    )
    names = surrogate_map(mentions.select("type", "canon", F.expr(_gender()).alias("gender")), key)
    per_row = mentions.join(names, ["type", "canon"]).groupBy("_row").agg(F.array_sort(F.collect_set(F.struct("pos", F.expr(_shown()).alias("s")))).alias("_names"))
    rebuilt = F.expr(f"array_join(flatten(zip_with(split(text, {pattern}, -1), _names, (g, n) -> array(g, coalesce(n.s, '')))), '')")
    changed = keyed.join(per_row, "_row").select("doc_id", rebuilt.alias("text"), F.size("_found").cast("long").alias("n_entities"))
    return clean.unionByName(changed)
